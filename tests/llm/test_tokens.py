"""Token counts, token-id files and pieces against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamframe.llm import common, pieces, token_counts, token_store, tokens

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", "  a  b\n\n c\t'ss don't  ", "x<|endoftext|>y <|endoftext|> z", "a　 \tb \xa0c", "H̱ É é Ünï123abc4.5!!!'s", "\x85 \x1c a ​", "ΣΑΣ 你好 世界 😀😀", "   ", "\n"]


def garbage(n=600, seed=1):
    rnd, letters = random.Random(seed), ["aB", " ", "c", ".", "\n", "'", "1", "é", "　", "<|endoftext|>", "\t", "#", "́", "\xa0", "☃", "▁", "  "]
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_word_encoder_equals_the_library():
    lib, encode = Tokenizer.from_file(WORDS), tokens.WordEncoder(WORDS)
    for text, ids in zip(garbage(), encode(garbage())):
        assert np.frombuffer(ids, "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_counts_equal_the_library(block):
    lib, count = Tokenizer.from_file(BYTES), token_counts.PieceCounter(BYTES, block=block)
    assert count(garbage(seed=2)) == [len(lib.encode(t, add_special_tokens=False).ids) for t in garbage(seed=2)]


def test_caches_may_fill_up():
    lib, count = Tokenizer.from_file(BYTES), token_counts.PieceCounter(BYTES, kept=10, block=50)
    assert count(garbage(60)) == [len(lib.encode(t, add_special_tokens=False).ids) for t in garbage(60)]


def test_count_tokens(docs, empty, made):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(docs, BYTES, keep=["doc_id", "n_words"]).collect()
    want = [(r[0], -1, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in made[0]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_token_store(spark, docs, empty, made):
    lib = Tokenizer.from_file(WORDS)
    index = token_store.write_token_store(docs, common.new_folder(spark, "t"), WORDS, 2, frame_bytes=500)
    got = sorted(map(tuple, token_store.read_token_store(index).collect()), key=lambda r: r[1])
    want = {}
    for r in made[0]:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in made[0]), key=lambda i: (i is not None, i))  # nulls first
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    for key, own in want.items():
        assert sorted(r[2:] for r in got if r[0] == key) == sorted(own)
    wanted = spark.createDataFrame([(7,), (3,), (99_999,)], "doc_id long")
    fetched = token_store.fetch_documents(index, wanted).collect()
    assert sorted((r[0], len(r[1])) for r in fetched) == sorted((k, n) for k in (3, 7) for n, _ in want[k])
    nothing = token_store.write_token_store(empty, common.new_folder(spark, "t"), WORDS, 2)
    assert token_store.read_token_store(nothing).count() == 0


def test_whole_texts_for_other_vocabularies(spark, docs, made):
    lib = Tokenizer.from_file(BYTES)
    index = token_store.write_token_store(docs, common.new_folder(spark, "t"), BYTES, 50256, words_apart=False)
    assert sorted(r[0] for r in index.select("n_tokens").collect()) == sorted(len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in made[0])


def test_a_changed_frame_is_noticed(spark, docs):
    index = token_store.write_token_store(docs.where("doc_id = 9"), common.new_folder(spark, "t"), WORDS, 2)
    path = index.first()["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    reader = token_store.FrameReader(path)
    with pytest.raises(Exception):
        list(reader.frame(0))


def test_seek_table_is_readable_as_plain_zstandard(spark, docs):
    import io

    import zstandard

    index = token_store.write_token_store(docs, common.new_folder(spark, "t"), WORDS, 2, frame_bytes=1000)
    path = index.first()["file"]
    reader = token_store.FrameReader(path)
    raw = open(path.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(plain) == sum(e[1] for e in reader.entries) and len(reader.entries) > 2


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram encoder over the same pieces and scores."""
    import sentencepiece
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    p, model = pieces.load_pieces(PIECES), proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if p.scores[i] > pieces.UNUSED:
            piece.score = float(p.scores[i])
        elif piece.type == 1:
            piece.type = 5
    return p, sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_best_paths_equal_the_library(unigram, made):
    p, lib = unigram
    texts = garbage(seed=3) + [r[1] for r in made[0] if r[1] and len(r[1]) < 2000]
    for text, got in zip(texts, pieces.Encoder(p, "test")(texts)):
        ids, want = np.frombuffer(got, "<u2").tolist(), lib.encode(text)
        if ids != want:  # the library adds in single precision: its path may be as good or worse, never better
            score = [sum(max(p.scores[i], p.unknown) for i in path) for path in (ids, want)]
            assert score[0] >= score[1] - 1e-6, repr(text)


def test_long_parts_take_the_same_path(unigram):
    for text in garbage(seed=4):
        word = text.replace(" ", "").replace("\n", "").encode()
        if word:
            assert pieces.best_paths([word], unigram[0])[0].tolist() == pieces.long_path(word, unigram[0])


def test_encode_pieces(docs, empty, made):
    got = pieces.encode_pieces(docs, PIECES, keep=["doc_id"]).collect()
    assert len(got) == len(made[0])
    for r in got:
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes())
    assert sorted(r["decoded_crc32"] for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in made[0])
    assert pieces.encode_pieces(empty, PIECES).count() == 0

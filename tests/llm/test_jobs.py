"""Quality rules, archives, shards and the pipeline against brute force."""

import collections
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_copies import class_heads
from test_passages import hits, repeats

import corpus_pipeline
from loamframe.llm import common, pieces, rule_lists, sharding, warc


def plain_statistics(text):
    text = text or ""
    words = text.encode().split()
    runs = list(zip(words, words[1:], words[2:]))
    seen, covered = collections.Counter(runs), set()
    for k, run in enumerate(runs):
        if seen[run] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_text_statistics(spark, docs, empty, made):
    odd = ["a\n\n\n \n \nb", "x x x", "a b a b a b", "#*$%&|<>", "é\n é\né", "a b c\ta b c", "w " * 50 + "\x0b\x0b"]
    texts = [r[1] for r in made[0]] + odd
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rule_lists.with_statistics(df).select("_statistics.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(plain_statistics, texts))
    kept = rule_lists.with_statistics(docs)
    assert "kept" not in kept.columns and kept.count() == len(made[0])
    assert rule_lists.with_statistics(empty).count() == 0


def labelled(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.randint(0, 100), rnd.randint(0, 100)
        rows.append((a, b, (a > 70 and b <= 40) or b > 90, i % 3 == 0))
    return spark.createDataFrame(rows, "a long, b long, bad boolean, held boolean")


def test_rules_find_planted_conjunctions(spark):
    rows = labelled(spark)
    rules = rule_lists.learn_rules(rows, ["a", "b"])
    judged = rows.withColumn("rule", rule_lists.verdict(rules, {"a": F.col("a"), "b": F.col("b")}))
    wrong = judged.where(F.col("bad") != (F.col("rule") > 0)).count()
    assert wrong <= 0.04 * 600 and any(len(r) == 2 for r in rules)
    assert rules == rule_lists.learn_rules(rows.repartition(7), ["a", "b"])  # the order of rows does not matter


def test_rules_without_a_pattern_or_labels(spark):
    rnd = random.Random(2)
    noise = spark.createDataFrame([(rnd.randint(0, 9), bool(rnd.getrandbits(1)), i % 3 == 0) for i in range(300)], "a long, bad boolean, held boolean")
    assert rule_lists.learn_rules(noise, ["a"]) == []
    assert rule_lists.learn_rules(noise.limit(0), ["a"]) == []
    assert rule_lists.learn_rules(noise.where("bad"), ["a"]) == []
    nulls = noise.select(F.lit(None).cast("long").alias("a"), "bad", "held")
    assert rule_lists.learn_rules(nulls, ["a"]) == []


def test_judge_with_bad_labels(spark, docs, made):
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 1), (2, 0), (9_999, 0)], "doc_id long, quality int")
    counted = common.durable(rule_lists.with_statistics(docs))
    got = rule_lists.judge(counted, rule_lists.rules_from_labels(counted, labels)).collect()
    want = [(n < 50 or 100 * again > 50 * n) for n, *_, again in (plain_statistics(r[1]) for r in made[0])]
    assert sum(r["base_failed"] for r in got) == sum(want) and all(r["kept"] != r["base_failed"] for r in got)


PAGES = "record_id long, uri string, payload binary"


def test_archives(spark):
    rnd = random.Random(4)
    big = bytes(rnd.getrandbits(8) for _ in range(5_000))
    same = b"<html>" + b"copy " * 40
    payloads = [b"", b"", b"short", b"short", big, same, same, same, b"line\r\n\r\nWARC/1.1\r\n" * 9, "é☃".encode() * 60, b"\x00\xff" * 70]
    rows = [(i, ["http://x/é y\r\nEvil: 1", None, ""][i % 3], bytearray(p)) for i, p in enumerate(payloads)] + [(6, "again", bytearray(same)), (None, "no id", bytearray(same))]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    files = warc.write_warc(warc.record_chunks(warc.decide_revisits(pages), chunk_bytes=64), common.new_folder(spark, "w"), file_bytes=1_000)
    assert files.count() > 3
    chunks = warc.read_warc(files, chunk_bytes=100).collect()
    last = [r for r in chunks if r["is_last"]]
    assert len(last) == len(rows)
    for r in last:
        own = sorted((c for c in chunks if c["record_id"] == r["record_id"] and c["record_type"] == r["record_type"]), key=lambda c: c["chunk_no"])
        body = next(bytes(p) for i, _, p in rows if i == r["record_id"])
        head = min((i for i, _, p in rows if i is not None and bytes(p) == body), default=None)
        revisit = len(body) >= 100 and r["record_id"] is not None and r["record_id"] != head
        assert (r["record_type"], r["refers_to"]) == (("revisit", head) if revisit else ("response", None))
        assert r["payload_digest"] == r["running_digest"] == hashlib.sha256(body).hexdigest() and r["payload_bytes"] == len(body)
        if not revisit:
            assert b"".join(bytes(c["data"]) for c in own) == body and len(own) == max(1, -(-len(body) // 100))
            so_far = b""
            for c in own:
                so_far += bytes(c["data"])
                assert c["running_digest"] == hashlib.sha256(so_far).hexdigest()
    none = warc.write_warc(warc.record_chunks(warc.decide_revisits(pages.limit(0))), common.new_folder(spark, "w"))
    assert warc.read_warc(none).count() == 0


def test_a_changed_archive_is_noticed(spark):
    import gzip

    pages = spark.createDataFrame([(1, "u", bytearray(b"payload " * 30))], PAGES)
    files = warc.write_warc(warc.record_chunks(warc.decide_revisits(pages)), common.new_folder(spark, "w"))
    path = files.first()["file"].removeprefix("file://")
    raw = gzip.open(path).read()
    with open(path, "wb") as out:
        out.write(gzip.compress(raw.replace(b"payload payload", b"payload paYload", 1)))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(files).collect()


def plain_shards(rows, shards):
    got = collections.defaultdict(list)
    for r in rows:
        got[r["shard"]].append(r)
    return got


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(spark, docs, empty, made, shards):
    out = sharding.write_shards(docs, common.new_folder(spark, "s"), shards).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(r[0]), str(r[1])) for r in made[0])
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    got = plain_shards(out, shards)
    assert set(got) <= set(range(shards))
    for own in got.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sharding.write_shards(empty, common.new_folder(spark, "s"), 4).count() == 0


@pytest.mark.parametrize("kind", ["plain", "one id", "null ids", "wide ids"])
def test_shards_are_even(spark, kind):
    rnd = random.Random(6)
    n, low, high = 4_000, -(1 << 63), (1 << 63) - 1
    ids = {"plain": range(n), "one id": [7 if i % 3 else i for i in range(n)], "null ids": [None if i % 3 else i for i in range(n)],
           "wide ids": [rnd.choice([low, high, rnd.randint(low, high)]) if i % 5 == 0 else rnd.randint(low, high) for i in range(n)]}[kind]
    rows = [(i, f"{k} " + "x" * rnd.randint(0, 50)) for k, i in enumerate(ids)]
    out = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), common.new_folder(spark, "s"), 16).collect()
    sizes = [sum(r["size"] for r in own) for own in plain_shards(out, 16).values()]
    mean = sum(sizes) / 16
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.004 * mean + 2 * 60


def test_repeated_rows_stay_together(spark):
    rows = [(1, "same text")] * 300 + [(i, "other") for i in range(2, 300)]
    out = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), common.new_folder(spark, "s"), 4).collect()
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1 and len(out) == len(rows)


def rejects(rules, statistics):
    """The rules read condition by condition, on features worked out from plain statistics."""
    words, chars, symbols, lines, again = statistics
    per = max(words, 1)
    value = {"n_words": words, "chars_per_1000_words": chars * 1000 // per, "symbols_per_1000_words": symbols * 1000 // per, "n_dup_lines": lines,
             "repeated_per_1000_words": again * 1000 // per}
    return any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)


def test_pipeline_equals_brute_force(spark, docs, items, tmp_path, monkeypatch):
    """Every stage on its own input, with nulls, ties, repeated rows and clashing columns in it."""
    rnd = random.Random(8)
    bad = [(1000 + i, "".join(rnd.choice(["word ", "### ", "&&& "]) + str(rnd.random()) + " " for _ in range(120))) for i in range(60)]
    good = [(2000 + i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 200)))) for i in range(60)]
    more = spark.createDataFrame([(i, t, "en", len(t), 1, 1, 1, False, "", "", "") for i, t in bad + good], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, state, learned, learn = rows.columns, rows, [], rule_lists.learn_rules
    monkeypatch.setattr(rule_lists, "learn_rules", lambda *a, **b: learned.append(learn(*a, **b)) or learned[-1])
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in state.collect()]
        state = common.durable(stage(spark, state, str(tmp_path)))
        after = [r.asDict() for r in state.collect()]
        texts = [r["text"] for r in before]
        if name != "sentencepiece":
            assert state.columns == columns
        if name == "quality rules":
            statistics = [plain_statistics(t) for t in texts]
            passed = [r for r, s in zip(before, statistics) if not (s[0] < 50 or 100 * s[4] > 50 * s[0])]
            assert sorted(map(repr, after)) == sorted(repr(r) for r in passed if not rejects(learned[0], plain_statistics(r["text"])))
            ids = {r["doc_id"] for r in after}
            assert not ids & {i for i, _ in bad} and ids >= {i for i, _ in good}
        elif name == "near-duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == class_heads([(r["doc_id"], r["text"]) for r in before])
        elif name == "substring dedup":
            want = [r | ({"text": kept, "n_chars": len(kept)} if gone else {}) for r, (_, gone, kept) in zip(before, repeats(texts, 35))]
            assert sorted(map(repr, after)) == sorted(map(repr, want))
        elif name == "decontamination":
            clean = [r for r, h in zip(before, hits(texts, [tuple(r) for r in items.collect()])) if not h[4]]
            assert sorted(map(repr, after)) == sorted(map(repr, clean)) and len(clean) < len(before)
        else:
            assert len(after) == len(before) and all(r["round_trip"] for r in after)
            assert sorted(r["decoded_crc32"] for r in after) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
    assert pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model")).longest > 3


def test_pipeline_on_empty_tables(spark, empty, items, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

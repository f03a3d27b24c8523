"""Hashes of words on words that polynomial hashes modulo a power of two confuse."""

import random

import numpy as np

from loamframe.llm import decontaminate, substring_dedup
from loamframe.llm.hashing import BASES, Words, byte_hashes, separator_table


def thue_morse(n):
    """A word of n letters (a power of two) and its complement: equal under any odd base modulo 2^64."""
    letters = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in letters), "".join("ba"[x] for x in letters)


def test_regular_words_differ():
    for n in (64, 1024, 4096):
        texts = [w.encode() for w in thue_morse(n)]
        words = Words(texts, separator_table(b" \n"), twice=True)
        assert len(set(words.hashes.tolist())) == len(set(words.others.tolist())) == 2


def test_equal_words_agree_wherever_they_stand():
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    text = " ".join(rnd.choice(some) for _ in range(5000))
    for block in (100, 5000, 1 << 20):
        words = Words([text.encode()] * 2, separator_table(b" \n"), block=block, twice=True)
        spelled = [words.data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        for hashes in (words.hashes, words.others):
            assert len({(w, h) for w, h in zip(spelled, hashes.tolist())}) == len(set(spelled)) == len(set(hashes.tolist()))


def test_very_long_words():
    values = np.random.default_rng(1).integers(1, 255, (1 << 24) + 50).astype(np.uint8)
    values[-20:] = values[:20]
    ends = np.array([20, len(values)])
    first, last = byte_hashes(values, np.array([0, len(values) - 20]), ends, BASES[:2])
    whole = byte_hashes(values[:20], np.array([0]), np.array([20]), BASES[:2])[0]
    assert first == last == whole


def test_windows_of_regular_words_stay(spark):
    """Two texts of 35 words that differ in the first word only lose nothing; a third, equal one makes both copies go."""
    rest = " ".join(f"word{k}" for k in range(34))
    rows = [(k, f"{w} {rest}") for k, w in enumerate(thue_morse(1024))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    more = spark.createDataFrame([*rows, (2, rows[0][1])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(more).collect()} == {0: 35, 1: 0, 2: 35}


def test_benchmark_of_regular_words(spark):
    a, b = thue_morse(1024)
    rest = " ".join(f"word{k}" for k in range(9))
    docs = spark.createDataFrame([(0, f"{a} {rest}"), (1, f"{b} {rest}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{a} {rest}")], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.mark_overlaps(docs, items).collect()} == {0: 10, 1: 0}

"""Near copies of the pipeline's second stage against brute force."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_passages import classes

import corpus_pipeline
from loamframe.llm import near_copies


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_edited_copies_are_dropped(spark):
    """Words replaced, merged or deleted: coefficients on both sides of 0.8, in pairs, chains and a group of 60."""
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            k = rnd.randrange(len(words) - 1)
            words[k : k + 2] = rnd.choice([["new", words[k + 1]], [words[k] + words[k + 1]], [words[k + 1]]])
        return words

    texts = []
    for _ in range(40):
        one = prose(rnd.randint(60, 400))
        texts += [one, edited(one, max(1, len(one) // rnd.randint(30, 90)))]
    chain, hub = prose(200), prose(300)
    for _ in range(6):
        chain = edited(chain, 3)
        texts.append(chain)
    texts += [hub] + [edited(hub, 3) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, "  "), (903, "two words"), (904, "Two  WORDS"), (3, " ".join(texts[3])), (None, " ".join(texts[5]))]
    sets = [shingles(t) for _, t in rows]
    coefficient = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if coefficient(sets[a], sets[b]) >= 0.8]
    assert 30 < sum(coefficient(sets[a], sets[b]) < 1 for a, b in linked)
    best = {}
    for root, (i, _) in zip(classes(len(rows), linked), rows):
        best.setdefault(root, []).append((i is None, i or 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(map(min, best.values()))


def class_heads(rows):
    """{(id, text)} that brute force keeps of rows (id, text): the least of each class, nulls last."""
    distinct = list(dict.fromkeys(rows))
    sets = [frozenset(shingles(t)) for _, t in distinct]
    first = {}
    linked = []
    for k, s in enumerate(sets):  # equal sets are linked through the first of them
        if first.setdefault(s, k) != k:
            linked.append((k, first[s]))
    kinds = sorted(first.values())
    for n, a in enumerate(kinds):
        for b in kinds[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and small:
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (small + large - common) - 1e-9:
                    linked.append((a, b))
    groups = {}
    for root, row in zip(classes(len(distinct), linked), distinct):
        groups.setdefault(root, []).append((row[0] is None, row[0] or 0))
    return sorted(min(g) for g in groups.values())


def template_texts(n, words, replaced, seed):
    rnd = random.Random(seed)
    template = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(template)
        for k in rnd.sample(range(words), replaced):
            own[k] = f"x{rnd.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n, replaced, tile", [(900, 5, 1024), (600, 4, 64), (300, 2, 50)])
def test_no_link_is_lost_in_a_crowded_key(spark, monkeypatch, n, replaced, tile):
    """Texts from one template share their keys; whatever lies at 0.8 is linked, as by brute force."""
    monkeypatch.setattr(near_copies, "tiled_links", functools.partial(near_copies.tiled_links, tile=tile))
    rows = list(enumerate(template_texts(n, 300, replaced, seed=n)))
    got = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    want = class_heads(rows)
    assert sorted((False, r["doc_id"]) for r in got) == want and len(want) < n


def test_odd_rows(spark, docs, made, empty):
    """Nulls, blanks, a very long text, repeated rows and clashing columns."""
    rows = [(r[0], r[1]) for r in made[0]]
    packed = corpus_pipeline.near_duplicates(spark, docs, "")
    got = packed.collect()
    assert packed.columns == docs.columns and all(r["_row"] == 4 and r["size"] == "q" for r in got)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == class_heads(rows)
    assert near_copies.without_near_copies(empty).count() == 0 == near_copies.near_copies(empty).count()
    labelled = near_copies.near_copies(docs.withColumn("component_id", docs["n_chars"]), keep=["doc_id", "component_id"])
    assert labelled.columns == ["doc_id", "component_id", "is_head"] and labelled.count() == len(rows)


def test_matrix_of_common_shingles():
    rnd = np.random.default_rng(2)
    sides = [[np.unique(rnd.integers(0, 9000, rnd.integers(0, 6000)).astype("<u8")) for _ in range(n)] for n in (7, 5)]
    got = near_copies.common_counts(*sides)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]


def test_connecting_links_keep_classes():
    rnd = random.Random(4)
    for _ in range(200):
        n, m = rnd.randint(1, 7), rnd.randint(1, 7)
        linked = np.array([[rnd.random() < 0.25 for _ in range(m)] for _ in range(n)])
        across, along = near_copies.connecting(linked)
        own = classes(n + m, [(i, n + j) for i, j in across] + [(n + i, n + j) for i, j in along])
        full = classes(n + m, [(i, n + j) for i in range(n) for j in range(m) if linked[i, j]])
        same = lambda c: [[x == y for y in c] for x in c]
        assert same(own) == same(full) and len(across) + len(along) <= n + m


def test_fingerprints_nominate_on_their_own(spark, monkeypatch):
    """Long texts with one word changed are found by SimHash alone; those far apart are judged by the exact coefficient."""
    rnd, plain = random.Random(8), near_copies.with_bands
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
        texts += [" ".join(words), " ".join([*words[:1500], "changed", *words[1501:]])]
    rows = list(enumerate(texts))
    prints = [near_copies.set_fingerprint(near_copies.shingle_set(t.encode())) for t in texts]
    close = [n for n in range(0, 24, 2) if (prints[n] ^ prints[n + 1]).bit_count() <= 2]
    no_keys = lambda *args: plain(*args).withColumn("_bands", F.array("_set"))
    monkeypatch.setattr(near_copies, "with_bands", no_keys)
    got = {r["doc_id"] for r in near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(close) > 6 and got == set(range(24)) - {n + 1 for n in close}

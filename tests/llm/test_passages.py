"""Repeated passages, benchmark passages, licences and near-duplicates against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from loamframe.llm import components, decontaminate, license_scan, simhash, substring_dedup
from loamframe.llm.licence_templates import TEMPLATES


def repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [3, 12, 35])
def test_remove_repeats(docs, empty, made, window):
    got = substring_dedup.remove_repeats(docs, window=window, chunk_bytes=3_000)
    assert sorted(map(tuple, got.select("n_words", "n_removed", "kept_text").collect())) == sorted(repeats([r[1] for r in made[0]], window))
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_few_words(spark):
    """Runs, alternations and repeats inside one text."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120))) for _ in range(40)] + ["a " * 20, "a " * 12, "a b " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, window=12, chunk_bytes=500).orderBy("doc_id").select("n_words", "n_removed", "kept_text").collect()
    assert list(map(tuple, got)) == repeats(texts, 12)


def test_windows_keep_a_common_symbol():
    """Whatever surrounds a window, a boundary of the last round stands in its first words at the same place."""
    rnd = np.random.default_rng(5)
    for window in (5, 12, 35, 50):
        rounds = substring_dedup.schedule(window)
        assert sum(rounds) <= (window - 1) // 2
        for _ in range(60):
            inner = rnd.integers(0, 9, window).astype(np.uint64)
            found = []
            for _ in range(2):
                left = rnd.integers(0, 9, rnd.integers(0, 40)).astype(np.uint64)
                row = np.concatenate([left, inner, rnd.integers(0, 9, 30).astype(np.uint64)])
                starts = substring_dedup.symbol_starts(row, np.zeros(len(row), int), rounds) - len(left)
                found.append({int(s) for s in starts if 0 <= s <= sum(rounds)})
            assert found[0] & found[1]


def hits(texts, items, window=10):
    cut = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for key, text in items:
        w = cut.findall((text or "").encode().lower())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if key is None else str(key))
    out = []
    for text in texts:
        w, at, ids = cut.findall((text or "").encode().lower()), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    at |= set(range(k, k + n))
                    ids |= own
        out.append((len(w), len(at), len(ids), sorted(ids), bool(at)))
    return out


def test_mark_overlaps(spark, docs, empty, items, made):
    got = decontaminate.mark_overlaps(docs, items)
    rows = [(r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in got.collect()]
    want = hits([r[1] for r in made[0]], [tuple(r) for r in items.collect()])
    assert sorted(rows) == sorted(want) and any(r[4] for r in want)
    assert decontaminate.mark_overlaps(empty, items).count() == 0
    none = decontaminate.mark_overlaps(docs, items.limit(0))
    assert none.where("contaminated OR n_items > 0").count() == 0 and none.count() == len(rows)


def test_overlaps_of_few_words(spark):
    """Many ties between fingerprints, windows of every length, items that share windows."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    items = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 16)))) for k in range(25)]
    got = decontaminate.mark_overlaps(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in got] == hits(texts, items)


def licences(text, least=0.8):
    cut = re.compile(rb"[0-9a-z\x80-\xff]+")
    pairs = lambda w: collections.Counter(zip(w, w[1:]))
    lines = [(k, cut.findall(line.encode().lower())) for k, line in enumerate((text or "").split("\n"))]
    lines, out = [x for x in lines if x[1]], []
    for licence, form, body in TEMPLATES:
        template, best = pairs(cut.findall(body.encode().lower())), None
        size = sum(template.values())
        for i in range(len(lines)):
            words = []
            for number, own in lines[i:]:
                words = words + own
                if len(words) > 2 * size:
                    break
                dice = 2 * sum((pairs(words) & template).values()) / (len(words) - 1 + size)
                if dice >= least and (best is None or dice > best[0]):
                    best = (dice, lines[i][0], number)
        if best:
            out.append((licence, form, *best))
    return out


def test_scan_licences(spark, docs, empty, made):
    mit = TEMPLATES[0][2]
    texts = [f"Some head\n\n{mit}\n\ntail words", mit.replace("Software", "Program").upper(), mit.replace("\n", " "), mit[: len(mit) // 2], "licensed under CC BY 4.0",
             "Licensed\nunder the\nApache License, Version 2.0.\nx", "\n".join([TEMPLATES[1][2]] * 3), TEMPLATES[4][2] + "\n" + mit, None, ""]
    texts += [r[1] for r in made[0]][60:]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, dice string")
    got = sorted(tuple(r) for r in license_scan.scan_licences(df).collect())
    assert got == sorted((i, *row) for i, t in enumerate(texts) for row in licences(t)) and len(got) > 8
    assert license_scan.scan_licences(empty).count() == 0


def plain_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(r, 42) >> k & 1 for r in runs) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(runs))


def classes(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_near_duplicates(docs, empty, made):
    got = simhash.near_duplicates(docs, keep=["doc_id"]).collect()
    prints = [plain_fingerprint(r[1]) for r in made[0]]
    root = classes(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    ids = collections.defaultdict(list)
    for k, r in zip(root, made[0]):
        ids[k].append(r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(min((i for i in ids[k] if i is not None), default=None))) for r, p, k in zip(made[0], prints, root))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert sum(r["is_head"] for r in got) == len(ids)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("pairwise", [1, 3, 32])
def test_links_of_clustered_fingerprints(spark, pairwise):
    rnd = random.Random(pairwise)
    prints = {rnd.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for start in list(prints)[:4]:
        for _ in range(40):
            prints.add(start ^ sum(1 << rnd.randrange(64) for _ in range(1)) ^ (1 << rnd.randrange(64)) ^ rnd.choice([0, 1 << rnd.randrange(8)]))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"), pairwise=pairwise)
    pairs = {tuple(r) for r in links.collect()}
    close = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2
    assert all(close(a, b) for a, b in pairs)
    place = {p: k for k, p in enumerate(prints)}
    want = classes(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if close(prints[a], prints[b])])
    assert classes(len(prints), [(place[a], place[b]) for a, b in pairs]) == want
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert [place[found.get(p, p)] for p in prints] == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 70)] + [(500, k) for k in range(501, 560)] + [(900, 900), (-5, 3), (600, 559)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {-5, 500} and got[70] == -5 and got[600] == 500 and got[500] == 500 and 900 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

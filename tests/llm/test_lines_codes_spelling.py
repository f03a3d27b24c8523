"""Line dedup, vector codes and spelling variants against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe.llm import automata, common_lines, spelling, vector_codes

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, documents=3, least=20):
    """[(id, n_lines, n_dropped, kept)] of rows (id, text)."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = collections.defaultdict(list)
    for i, lines in split:
        for k in {key(x) for x in lines}:
            if len(k) >= least:
                holders[k].append(i)
    owner = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= documents}
    out = []
    for i, lines in split:
        kept = [x for x in lines if not (key(x) in owner and owner[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rnd = random.Random(3)
    line = lambda n: "".join(rnd.choice("abcdeé fghij") for _ in range(n))
    shared = [line(rnd.randint(15, 40)) for _ in range(30)] + ["x" * 19, "é" * 20, "é" * 19, "Ünique Line that is shared", " " * 30]
    rows = []
    for i in range(120):
        lines = [rnd.choice(shared) if rnd.random() < 0.4 else line(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 9))]
        lines = [rnd.choice([x, x.upper() if x.isascii() else x, f"  {x}\t", x + "\r", "\x0b" + x]) for x in lines]
        rows.append((i, "\n".join(lines)))
    # one line in a third of all rows, a text of many lines, one line often in few documents
    rows += [(1000 + i, f"the very common line of them\n{line(40)}") for i in range(60)]
    rows += [(2000, "\n".join(line(25) for _ in range(5000)) + "\nthe very common line of them"), (2001, "twice in one document only\n" * 50), (2002, "twice in one document only")]
    rows += [(None, "the very common line of them"), (None, None), (7, None), (8, ""), (9, "\n\n"), (3000, "z" * 200_000), (3000, "z" * 200_000), (3001, "z" * 200_000)]
    rows += [(None, "only null ids hold this line")] * 3 + [(50, "the same row three times over")] * 3 + [(51, "the same row three times over")]
    return rows


def test_common_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 5, "k", "h") for i, t in rows], "doc_id long, text string, n_lines int, key string, holder string").repartition(7)
    got = common_lines.drop_common_lines(df)
    assert got.columns == ["doc_id", "text", "key", "holder", "n_lines", "n_dropped", "kept_text"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()]
    want = plain_lines(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[2] for r in want) > 100
    assert common_lines.drop_common_lines(df.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With far too few bits every line is suspected: more is shuffled, the result is the same."""
    monkeypatch.setattr(common_lines, "LEAST_BITS", common_lines.SEGMENT)
    monkeypatch.setattr(common_lines, "MOST_BITS", common_lines.SEGMENT)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in common_lines.drop_common_lines(df, keep=["doc_id"]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_lines(rows)))


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{key: (code, error, label_error)} and digest of rows (id, vector, label, key), in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    floor = lambda x: int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024)
    width = len(kept[0][1]) // parts
    vectors = [[[floor(x) for x in r[1][k * width : (k + 1) * width]] for k in range(parts)] for r in kept]
    books = [[list(v[k]) for v in vectors[:entries]] for k in range(parts)]

    def assign():
        out = []
        for v in vectors:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[k], e)), i) for i, e in enumerate(books[k])) for k in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            groups = collections.defaultdict(list)
            for v, best in zip(vectors, found):
                groups[best[k][1]].append(v[k])
            for i, own in groups.items():
                books[k][i] = [sum(c) // len(own) for c in zip(*own)]
    found, most = assign(), (1 << 63) - 1
    error = [min(sum(d for d, _ in best), most) for best in found]
    by_label = collections.Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for row in book for x in row).encode()).hexdigest()
    return {r[3]: ("".join(f"{i:02x}" for _, i in best), e, min(by_label[r[2]], most)) for r, best, e in zip(kept, found, error)}, digest


VECTORS = "vec_id long, embedding array<double>, label int, key int, code string, error int"


def coded(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS).repartition(5)
    out, books = vector_codes.compress_vectors(df, **settings)
    return {r["key"]: (r["code"], r["error"], r["label_error"]) for r in out.collect()}, vector_codes.codebook_digest(books), out.columns


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "huge", "few"])
def test_vector_codes(spark, kind):
    rnd = random.Random(kind)
    width, n = {"plain": (20, 330), "ties": (8, 300), "wide": (4, 280), "huge": (8, 270), "few": (12, 9)}[kind]
    draw = {"plain": lambda: rnd.gauss(0, 1), "ties": lambda: rnd.choice([-1.0, 0.0, 1.0]) / 1024, "wide": lambda: rnd.uniform(-3e4, 3e4),
            "huge": lambda: rnd.choice([1.5, -2.25, 1e18, -3e38, 1e300, 0.0]), "few": lambda: rnd.random()}[kind]
    rows = [(i // 2 if i % 50 == 1 else i, [draw() for _ in range(width)], rnd.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [(None, [draw() for _ in range(width)], None), rows[3], rows[3]]
    good = len(rows)
    rows += [(1, None, 1), (2, [None] * width, 1), (0, [float("nan")] + [0.0] * (width - 1), 1), (0, [float("-inf")] * width, None), (0, [0.0] * (width + 1), 1), (0, [], 1)]
    rows = [(*r, k) for k, r in enumerate(rows)]
    got, digest, columns = coded(spark, rows)
    want, expected = plain_codes(rows[:good])
    assert got == want and digest == expected
    assert columns == ["vec_id", "embedding", "label", "key", "code", "error", "label_error"][:4] + ["code", "error", "label_error"]


def test_vector_lengths(spark):
    """A length that parts do not divide is filled up with zeros; empty tables and empty vectors."""
    rnd = random.Random(4)
    rows = [(i, [rnd.random() for _ in range(7)], 1, i) for i in range(40)]
    filled = [(i, [*v[:7], 0.0], label, k) for i, v, label, k in rows]
    assert coded(spark, rows)[:2] == coded(spark, filled)[:2]
    assert coded(spark, [])[0] == {}
    assert coded(spark, [(1, [], 1, 0), (2, [], 1, 1)])[0] == {0: ("00000000", 0, 0), 1: ("00000000", 0, 0)}


def test_transform_keeps_distances():
    """Sequency order has one more sign change each row, and n times the squared distance comes out."""
    for n in (1, 2, 4, 16):
        rows = vector_codes.transform(np.eye(n, dtype=np.int64))
        changes = (np.diff(rows.T, axis=1) != 0).sum(axis=1) if n > 1 else np.zeros(1)
        assert changes.tolist() == list(range(n))
    a, b = np.random.default_rng(1).integers(-1000, 1000, (2, 5, 11))
    assert (((vector_codes.transform(a) - vector_codes.transform(b)) ** 2).sum(axis=1) == 16 * ((a - b) ** 2).sum(axis=1)).all()


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts):
    """[(word, form, root, n, n_near, form_n)] of {word: n}."""
    variants, forms, rows = collections.defaultdict(set), {}, []
    for w in counts:  # words at one edit share a word with one code point less, or are one
        for x in {w, *(w[:i] + "\0" + w[i + 1 :] for i in range(len(w))), *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            variants[x].add(w)
    near = collections.defaultdict(set)
    for group in variants.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            forms[w] = best
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, len(near[w]), counts[forms[w]] if w in forms else None))
    return sorted(rows, key=repr)


def test_acceptors_enumerate_every_pair_once():
    rnd = random.Random(1)
    for trial in range(40):
        rows = []
        for block in range(rnd.randint(1, 4)):
            words = {"".join(rnd.choice("abcé" if trial % 2 else "ab") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 60))}
            rows += [(block, w) for w in sorted(words)]
        labels = np.array([ord(c) + 1 for _, w in rows for c in w], dtype=np.int64)
        made = automata.Acceptor(np.array([b for b, _ in rows]), labels, np.array([len(w) for _, w in rows]))
        u, v = automata.near_words(made, np.zeros(4, np.int64))
        got = sorted((min(p), max(p)) for p in zip(u.tolist(), v.tolist()))
        assert got == [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][0] == rows[b][0] and one_edit(rows[a][1], rows[b][1])]


def test_acceptor_is_minimal():
    words = ["ab", "bb", "cab", "cbb"]
    made = automata.Acceptor(np.zeros(4, np.int64), np.array([ord(c) + 1 for w in words for c in w]), np.array([2, 2, 3, 3]))
    assert len(made.final) == 4  # after nothing, after c, after a first letter, at the end


@pytest.mark.parametrize("most", [1, 7, 60, 100_000])
def test_variants_at_every_split(spark, most, monkeypatch):
    """The same groups however early prefixes are split, with a hot prefix, long words, and few rows at once."""
    monkeypatch.setattr(spelling, "AT_ONCE", 50)
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(250)}
    words |= {"hotprefix" + "".join(rnd.choice("xy") for _ in range(rnd.randint(0, 6))) for _ in range(120)}
    words |= {"l" * 400, "l" * 401, "l" * 200 + "k" + "l" * 199, "aaaaa", "aaaaaa", "aaaaaaa"}
    counts = {w: rnd.choice([1, 2, 3, 6, 12, 25, 60]) for w in words}
    df = spark.createDataFrame([(w, n - 1, 4) for w, n in counts.items()] + [(w, 1, 4) for w in counts] + [(None, 5, 5)], "word string, n long, form_n int")
    got = spelling.variant_forms(df, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(counts)
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[1] and r[2] != r[1] for r in want)


def test_words_of_documents(spark, docs, made, empty):
    """Counts over whole texts with the planted slips, then the groups."""
    rows = [(r[0], r[1]) for r in made[0]]
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    got = spelling.variant_forms(spelling.word_counts(docs, alter=spelling.slip), most=500)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(counts) and len(counts) > 1000
    assert spelling.variant_forms(spelling.word_counts(empty)).count() == 0


def test_no_forms_of_equal_frequency(spark):
    with pytest.raises(ValueError):
        spelling.variant_forms(spark.createDataFrame([("abcde", 1)], "word string, n long"), times=1)


def test_queries_on_whole_tables(spark):
    """The registered query of operator 12 over the smallest table."""
    from loamframe.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = collections.Counter()
    for i, t in rows:
        for run, n in collections.Counter(re.findall("[A-Za-zÀ-ÿ]+", t or "")).items():
            counts[spelling.slip(i, run.translate(LOWER))] += n
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    got = queries.op12_spelling_variants(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(counts)
    assert got.select(F.sum("n")).first()[0] == sum(counts.values())

"""Near copies by word shingles: SimHash and MinHash nominate pairs, the exact Jaccard coefficient of the shingle sets decides.

Texts with equal sets are one node.  Sets whose 64-bit SimHash fingerprints differ in at most two bits are found by deletion-variant
signatures (``simhash.link_fingerprints``).  At a coefficient of 0.8 fingerprints differ in more bits than such signatures tell from
chance, so MinHash nominates what lies beyond: a set has ``BANDS`` keys of ``ROWS`` minima each: two sets of coefficient J share one with
1 - (1 - J ** ROWS) ** BANDS, that is 0.9993 at 0.8.  All pairs that share a key are judged:

* keys of up to ``PAIRWISE`` sets give their pairs; a sketch of the minima (one byte each) drops those that are far below the
  least coefficient, the sets of the others are compared;
* the members of a larger key are first compared with ``CENTRES`` of them.  Members outside the largest class that comes of it
  are then compared with all members, in tiles of ``TILE`` by ``TILE`` sets, where one matrix product counts what each pair has in
  common.  A tile hands out links that connect what it found, never its pairs.

Texts are not stored or shuffled: rows are known by id and 128 bits of hash of their text, and only rows that a filter of the
wanted keys lets through are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from loamframe.llm.common import byte_slices, durable, passed_on, small_batches
from loamframe.llm.common_lines import filter_bits, filters_of, hit, merged_filter
from loamframe.llm.components import components
from loamframe.llm.simhash import link_fingerprints

BANDS, ROWS, PAIRWISE, CENTRES, TILE = 24, 6, 32, 4, 1024
KEYS = ["_id", "_k1", "_k2"]


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42):
    """Sorted distinct XXH64 hashes of the runs of ``shingle`` words (of all words where there are fewer; none without words)."""
    from itertools import repeat

    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, dtype="<u8")
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(seed)), dtype="<u8"))


def set_fingerprint(hashes) -> int:
    """SimHash of a shingle set: bits set in over half its hashes; 0 without shingles."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(hashes)))


def keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``df`` with what a row is known by: ``_id`` and two hashes of its text."""
    full = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_k1": F.xxhash64(full), "_k2": F.xxhash64(F.lit("second"), full), "_text": full})


def with_bands(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """The keys of ``rows`` with ``_set`` (a hash of the shingle set), ``_fp`` (its SimHash), ``_bands`` (its MinHash keys) and ``_sketch``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rnd = np.random.default_rng(7)
        times = (rnd.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        plus = rnd.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
        for batch in byte_slices(batches, "_text"):
            sets, prints, keys, sketches = [], [], [], []
            for t in batch.column("_text").to_pylist():
                own = shingle_set((t or "").encode(), shingle)
                sets.append(xxh64_intdigest(own.tobytes(), 1))
                prints.append(set_fingerprint(own))
                short, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
                for at in range(0, len(short), 512):
                    np.minimum(least, (short[at : at + 512, None] * times + plus).min(axis=0), out=least)
                keys.extend(xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, BANDS * ROWS, ROWS))
                sketches.append((least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            as_longs = lambda v: pa.array(np.array(v, dtype="<u8").view("<i8"))
            ends = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), as_longs(sets), as_longs(prints),
                                              pa.ListArray.from_arrays(ends, as_longs(keys)), pa.array(sketches, pa.binary())],
                                             names=[*KEYS, "_set", "_fp", "_bands", "_sketch"])

    rows = rows.select(*KEYS, "_text")
    return rows.mapInArrow(compute, rows.drop("_text").schema.add("_set", "long").add("_fp", "long").add("_bands", ArrayType(LongType())).add("_sketch", BinaryType()))


def close_prints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the ``sets`` (node, fp) whose fingerprints differ in at most two bits."""
    firsts = durable(sets.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = sets.join(firsts.hint("merge"), "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = link_fingerprints(firsts.select("fp"))
    links = links.join(firsts.select(F.col("fp").alias("a"), F.col("rep").alias("u")).hint("merge"), "a")
    links = links.join(firsts.select(F.col("fp").alias("b"), F.col("rep").alias("v")).hint("merge"), "b")
    return equal.unionByName(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))


def in_sketch(least: float) -> int:
    """Equal bytes that two sketches of coefficient ``least`` have at the least: more than six standard deviations below the mean."""
    n = BANDS * ROWS
    return int(n * least - 6.2 * (n * least * (1 - least)) ** 0.5)


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches (``nodes``: node, sketch) do not rule out a coefficient of ``least``."""
    sketched = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a")
    sketched = sketched.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
    enough = in_sketch(least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= enough))

    return sketched.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (``sets``: node, s) have a coefficient of at least ``least``."""
    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    held = held.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return held.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def common_counts(left: list, right: list):
    """How many values each set on the left has in common with each on the right (sorted distinct arrays)."""
    import numpy as np

    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, dtype="<u8") for side in (left, right)]
    values = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    places = []
    for own, size in zip(flat, sizes):
        row = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(values, own)
        found = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own) if len(values) else np.zeros(len(own), dtype=bool)
        order = np.argsort(at[found], kind="stable")
        places.append((row[found][order], at[found][order]))
    for start in range(0, len(values), 4096):
        sides = []
        for (row, at), n in zip(places, (len(left), len(right))):
            i, j = np.searchsorted(at, [start, start + 4096])
            dense = np.zeros((n, min(4096, len(values) - start)), dtype=np.float32)
            dense[row[i:j], at[i:j] - start] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def connecting(linked):
    """(row, column) links that connect rows and columns as all links of the matrix do, at most one for each of them."""
    import numpy as np

    rows, cols = linked.shape
    none = rows + cols
    label, other = np.arange(rows), np.full(cols, none)
    while True:
        new_other = np.minimum(other, np.where(linked, label[:, None], none).min(axis=0))
        new_label = np.minimum(label, np.where(linked, new_other[None, :], none).min(axis=1))
        if (new_other == other).all() and (new_label == label).all():
            break
        label, other = new_label, new_other
    ones = [(int(i), int(np.flatnonzero(linked[i] & (other == label[i]))[0])) for i in np.flatnonzero(linked.any(axis=1))]
    # rows of a class hang on columns of it, the columns of a class on one of its columns
    columns: dict = {}
    for j in np.flatnonzero(other < none):
        columns.setdefault(int(other[j]), []).append(int(j))
    return ones, [(group[0], j) for group in columns.values() for j in group[1:]]


def tiled_links(members: DataFrame, sets: DataFrame, labels: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) between members (key, node) of crowded keys that ``labels`` (node, component) leaves apart.

    In each key the members outside its largest class are compared with all members; tiles hold at most about ``tile`` sets a side.
    """
    placed = durable(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n"))
    split = durable(largest.where(F.col("top.m") < F.col("n")).select(
        "key", F.col("top.component").alias("top"), F.ceil(F.col("n") / tile).cast("int").alias("wide"),
        F.ceil((F.col("n") - F.col("top.m")) / tile).cast("int").alias("high")))
    rows = placed.join(split.hint("merge"), "key").join(sets.hint("merge"), "node")
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    at = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), F.lit(minor).alias("minor"))
    everyone = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: at(i, F.col("_wide"), False))
    minor = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: at(F.col("_high"), j, True))
    places = F.concat(everyone, F.when(F.col("component") != F.col("top"), minor).otherwise(F.slice(minor, 1, 0)))
    dealt = rows.withColumns({"_wide": block("wide", 2), "_high": block("high", 1)}).select("key", "node", "component", "s", F.inline(places))

    def compare(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        side = table.column("minor").to_numpy()
        own = [np.frombuffer(v, dtype="<u8") for v in table.column("s").to_pylist()]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        size = np.array([len(s) for s in own])
        common = common_counts([own[k] for k in left], [own[k] for k in right])
        linked = common >= least * (size[left][:, None] + size[right][None, :] - common) - 1e-9
        linked &= component[left][:, None] != component[right][None, :]
        across, along = connecting(linked) if linked.any() else ([], [])
        pairs = [(node[left[i]], node[right[j]]) for i, j in across] + [(node[right[i]], node[right[j]]) for i, j in along]
        return pa.table({"a": pa.array([int(p[0]) for p in pairs], pa.int64()), "b": pa.array([int(p[1]) for p in pairs], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def rows_hit(rows: DataFrame, shared, bits: int, wanted: bool) -> DataFrame:
    """The rows whose ``_k1`` the broadcast filter lets through, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes = batch.column("_k1").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(hit(shared.value, hashes, bits) == wanted))

    return rows.mapInArrow(run, rows.schema)


def key_filter(keys: DataFrame):
    """(broadcast filter, its bits) of the ``_k1`` of a stored table."""
    bits = filter_bits(keys.count())
    hashes = lambda batch: ([k & 0xFFFFFFFFFFFFFFFF] for k in batch.column("_k1").to_pylist())
    return keys.sparkSession.sparkContext.broadcast(merged_filter(filters_of(keys.select("_k1"), hashes, bits), bits, twice=False)), bits


def same_key(a: str, b: str):
    return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._k1") == F.col(f"{b}._k1")) & (F.col(f"{a}._k2") == F.col(f"{b}._k2"))


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(``_id``, ``_k1``, ``_k2``, ``rows``, ``component_id``, ``is_head``) of each distinct id and text, as a stored table.

    Ids and texts are linked where the Jaccard coefficient of their shingle sets is at least ``least``.  ``component_id`` is the
    smallest id reachable (null if all are null); the head is the row of the smallest id, nulls last, equal ids by the hash of their
    texts.  Texts without words (null, empty, blank) have equal, empty sets and are one class.  ``rows`` counts repeated rows.  An
    empty table gives no classes.
    """
    small_batches(df.sparkSession)
    rows = keyed(df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), id_col, text).select(*KEYS, "_text")
    base = durable(with_bands(rows, shingle).groupBy(*KEYS, "_set").agg(F.count("*").alias("rows"), F.first("_fp").alias("fp"),
                                                                       F.first("_bands").alias("bands"), F.first("_sketch").alias("sketch")))
    order = F.struct(F.col("_id").isNull().alias("none"), *KEYS)
    # the first row of each set: smallest id, null ids last
    first = durable(base.groupBy(F.col("_set").alias("node")).agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    index = first.select("node", F.explode("bands").alias("key"))
    centres = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(CENTRES)]))
    groups = durable(index.groupBy("key").agg(F.count("*").alias("n"), centres.alias("centres")).where("n > 1"))
    members = durable(index.join(groups.hint("merge"), "key"))
    few = members.where(F.col("n") <= PAIRWISE).select("key", "node")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    many = members.where(F.col("n") > PAIRWISE)
    stars = many.select(F.col("node").alias("u"), F.explode("centres").alias("v")).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    close = close_prints(first.select("node", "fp"))
    pairs = durable(likely(pairs.unionByName(stars).unionByName(close).distinct(), first.select("node", "sketch"), least))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    wanted = durable(first.join(nodes, "node").select("node", *[F.col(f"first.{c}").alias(c) for c in KEYS]))
    shared, bits = key_filter(wanted)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in byte_slices(batches, "_text"):
            hashes = batch.column("_k1").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            batch = batch.filter(pa.array(hit(shared.value, hashes, bits)))
            found = [shingle_set((t or "").encode(), shingle).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(found, pa.binary())], names=[*KEYS, "s"])

    sets = rows.mapInArrow(to_sets, "_id long, _k1 long, _k2 long, s binary").alias("d").join(wanted.alias("w"), same_key("d", "w"))
    sets = durable(sets.select("w.node", "d.s").dropDuplicates(["node"]))
    links = durable(alike(pairs, sets, least))
    labels = components(links)
    if not many.isEmpty():
        labels = components(links.unionByName(durable(tiled_links(many.select("key", "node"), sets, durable(labels), least))))
    labelled = durable(first.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    heads = durable(labelled.groupBy("component").agg(F.min("first").alias("head")))
    place = durable(labelled.join(heads.hint("merge"), "component").select(F.col("node").alias("_set"), "head"))
    return durable(base.join(place, "_set").select(
        *KEYS, "rows", F.col("head._id").alias("component_id"),
        (F.col("head._id").eqNullSafe(F.col("_id")) & (F.col("head._k1") == F.col("_k1")) & (F.col("head._k2") == F.col("_k2"))).alias("is_head")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``keep`` (default: all columns), ``component_id`` and ``is_head`` of each row (see ``classes``; repeated rows are heads alike)."""
    keep = passed_on(df.columns if keep is None else keep, {"component_id", "is_head", "rows", "_text", *KEYS})
    found = classes(df, id_col, text, shingle, least).alias("v")
    rows = keyed(df, id_col, text).select(*[F.col(f"`{c}`") for c in keep], *KEYS).alias("d")
    return rows.join(found, same_key("d", "v")).select(*[F.col(f"d.`{c}`") for c in keep], "v.component_id", "v.is_head")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` that are the heads of their classes, one row of each class; columns as they are.

    Only rows that a filter of the rows to drop lets through are shuffled.  ``df`` has no columns named as in ``keyed``.
    """
    found = classes(df, id_col, text, shingle, least)
    asked = durable(found.where(~F.col("is_head") | (F.col("rows") > 1)).select(*KEYS, "is_head"))
    shared, bits = key_filter(asked)
    rows = keyed(df, id_col, text).drop("_text")
    clear = rows_hit(rows, shared, bits, False).drop(*KEYS)
    judged = rows_hit(rows, shared, bits, True).alias("d").join(asked.alias("v"), same_key("d", "v"), "left")
    kept = judged.where("v.is_head IS NULL").select("d.*").drop(*KEYS)
    repeated = judged.where("v.is_head").select("d.*").dropDuplicates(KEYS).drop(*KEYS)
    return clear.unionByName(kept).unionByName(repeated)

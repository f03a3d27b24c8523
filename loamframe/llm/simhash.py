"""Near-duplicates by SimHash with deletion-variant signatures (operator 8).

Two 64-bit fingerprints that differ in at most 2 bits, cut into 2 segments, differ by at most one bit in one segment.  Each
segment is indexed under its 32 one-wildcard variants, equal variants are joined and the whole fingerprints compared.
Only distinct fingerprints are indexed.  A variant that many fingerprints share is not expanded into pairs: its
members meet at the points one bit away from their other segment, which is the same comparison, linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, durable, passed_on, small_batches
from loamframe.llm.components import components

#: Groups up to this size are compared pair by pair; larger ones by meeting points.  Either way gives all links.
PAIRWISE = 32


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the shingles; 0 without words."""
    from itertools import repeat

    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = words[start : start + (1 << 16) + shingle - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
        hashes = np.fromiter(map(xxh64_intdigest, runs, repeat(seed)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``keep`` (default: all columns) and ``_fp``, the fingerprint as a long."""
    keep = df.columns if keep is None else keep
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in byte_slices(batches, "_text"):
            found = [fingerprint_of((t or "").encode(), shingle, seed) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.array(found, dtype="<u8").view("<i8"))], names=[*keep, "_fp"])

    return rows.mapInArrow(compute, rows.drop("_text").schema.add("_fp", "long"))


def link_fingerprints(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) that connect all pairs of the distinct longs ``fp`` with at most two differing bits.

    Pairs of a group above ``pairwise`` are joined through their meeting points instead of one by one, so every class
    is connected as by all its pairs.
    """
    variant = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    # v: 32 x segment + the bit left out; key: v and the segment without that bit
    index = prints.select("fp", variant).select("fp", "v", F.expr(
        "shiftleft(cast(v AS bigint), 32) | (shiftrightunsigned(fp, v & 32) & 4294967295L & ~shiftleft(1L, v & 31))").alias("key"))
    groups = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    groups = durable(groups)
    # both sides are shuffled at every size: Spark then splits a crowded key, and the work grows evenly
    twos = groups.where("n = 2").select("a", "b")
    members = durable(index.join(groups.where("n > 2").select("key", "n").hint("merge"), "key"))
    near = members.where(F.col("n") <= pairwise)
    some = near.select("key", F.col("fp").alias("a")).join(near.select("key", F.col("fp").alias("b")), "key").where("a < b")
    pairs = twos.unionByName(some.select("a", "b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()
    many = members.where(F.col("n") > pairwise).select(
        "key", "fp", F.expr("shiftrightunsigned(fp, v) & 1").alias("bit"), F.expr("shiftrightunsigned(fp, 32 - (v & 32)) & 4294967295L").alias("other"))
    around = "concat(array(other), transform(sequence(0, 31), j -> other ^ shiftleft(1L, j)))"
    # the left-out bit agrees: up to two bits of the other segment; it differs: up to one
    apart = f"CASE WHEN bit = 0 THEN {around} ELSE array(other) END"
    meet = many.select("key", "fp", "bit", F.explode(F.expr(around)).alias("point"))
    meet = meet.unionByName(many.select("key", "fp", F.lit(2).cast("long").alias("bit"), F.explode(F.expr(apart)).alias("point")))
    least = meet.groupBy("key", "bit", "point").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = meet.join(least, ["key", "bit", "point"]).select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """``keep`` (default: all columns), ``fingerprint`` (16 hex digits), ``component_id`` and ``is_head`` of each row.

    ``component_id`` is the smallest id reachable over links of at most 2 bits, the row itself included; null ids count
    for nothing and a component of them alone has none.  ``is_head`` marks one row of each component: the one of the
    smallest id (of repeated rows one).  Null, empty and blank texts have fingerprint 0 and are linked like others.
    An empty table gives no rows.  Columns of ``df`` with result names give way.
    """
    own = {"fingerprint", "component_id", "is_head", "_fp", "_id", "_row", "_text", "_head"}
    keep = passed_on(df.columns if keep is None else keep, own)
    named = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], F.col(f"`{id_col}`").cast("long").alias("_id"))
    base = durable(with_fingerprints(named, text, [*keep, "_id"], shingle).withColumn("_row", F.monotonically_increasing_id()))
    # the first row of each fingerprint: smallest id, null ids last
    first = durable(base.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")))
    labels = components(link_fingerprints(first.select("fp")))
    labelled = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    heads = labelled.groupBy("component").agg(F.min("first").alias("head"))
    place = durable(labelled.join(heads, "component").select(F.col("fp").alias("_fp"), F.col("head._id").alias("component_id"), F.col("head._row").alias("_head")))
    return base.join(place, "_fp").select(
        *[F.col(f"`{c}`") for c in keep], F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id",
        (F.col("_row") == F.col("_head")).alias("is_head"))

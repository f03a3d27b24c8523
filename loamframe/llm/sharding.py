"""Shards of near equal bytes by histogram sort (operator 7), in DataFrame operations only.

Exact bytes below candidate boundaries are counted over all partitions; only the intervals that hold a splitter are
probed again, until each splitter is within the tolerance or stands on a single key.  A key too heavy for that is cut
by a second key.  The rows then move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamframe.llm.common import durable, passed_on

_WIDE = "decimal(20,0)"


@dataclass
class Splitter:
    """Keys up to ``high`` lie below; ``low`` is known to be too low.  ``below``: exact bytes up to ``low``."""

    target: int
    low: int
    high: int
    below: int
    upto: int


def _probe(df: DataFrame, key: str, spans: list[tuple[int, int]], probes: int) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """For each span (low, high]: (key before, last key, bytes) of its equal cells with rows, in order.  One aggregation of at most spans x probes rows."""
    place = F.lit(None).cast("struct<span:int,cell:long>")
    steps = []
    for n, (low, high) in enumerate(spans):
        step = -(-(high - low) // probes)
        steps.append(step)
        cell = F.floor((F.col(key).cast(_WIDE) - F.lit(low + 1).cast(_WIDE)) / F.lit(step).cast(_WIDE)).cast("long")
        inside = (F.col(key) > F.lit(low)) & (F.col(key) <= F.lit(high)) if low >= -(1 << 63) else F.col(key) <= F.lit(high)
        place = F.when(inside, F.struct(F.lit(n).alias("span"), cell.alias("cell"))).otherwise(place)
    counted = df.select(place.alias("at"), "size").where("at is not null").groupBy("at.span", "at.cell").agg(F.sum("size").alias("size"))
    cells: dict = {span: [] for span in spans}
    for row in sorted(counted.collect()):  # spans x probes rows at most
        (low, high), step = spans[row["span"]], steps[row["span"]]
        cells[low, high].append((low + row["cell"] * step, min(high, low + (row["cell"] + 1) * step), row["size"]))
    return cells


def _refine(df: DataFrame, key: str, low: int, high: int, base: int, total: int, targets: list[int], slack: int, probes: int) -> list[Splitter]:
    """Splitters over one key column: keys in (low, high] hold the bytes base .. base + total."""
    found = [Splitter(t, low, high, base, base + total) for t in targets]
    while wide := [s for s in found if s.high - s.low > 1 and s.upto - s.target > slack and s.target - s.below > slack]:
        spans = sorted({(s.low, s.high) for s in wide})
        cells = _probe(df, key, spans, max(16, probes // len(spans)))
        for s in wide:
            for before, last, size in cells[s.low, s.high]:
                if s.below + size >= s.target:
                    s.low, s.high, s.upto = before, last, s.below + size
                    break
                s.below, s.low = s.below + size, last
    for s in found:  # the end nearer to the target is the boundary
        if s.target - s.below <= min(slack, s.upto - s.target):
            s.high, s.upto = s.low, s.below
        elif s.upto - s.target <= slack:
            s.low, s.below = s.high, s.upto
    return found


def find_splitters(sizes: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 1024) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (key, tie): rows up to and including them lie below.

    ``sizes`` has ``key`` and ``tie`` (long, not null) and ``size`` (long).  Each shard's bytes differ from the mean by
    less than ``tolerance`` of it or by one (key, tie) pair.
    """
    low, high, total = sizes.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if not total:
        return [(0, 0)] * (shards - 1)
    slack = int(total / shards * tolerance / 2)
    targets = [total * n // shards for n in range(1, shards)]
    first = _refine(sizes, "key", low - 1, high, 0, total, targets, slack, probes)
    out, heavy = [], {}
    for s in first:
        if s.low == s.high:
            out.append((s.high, (1 << 63) - 1))
        else:  # one key spans the target
            heavy.setdefault((s.high, s.below, s.upto), []).append(s.target)
    for (key, below, upto), wanted in heavy.items():
        ties = sizes.where(F.col("key") == key)
        bottom, top = ties.agg(F.min("tie"), F.max("tie")).first()
        for s in _refine(ties, "tie", bottom - 1, top, below, upto - below, wanted, slack, probes):
            nearer = s.low if s.target - s.below < s.upto - s.target else s.high
            out.append((key - 1, (1 << 63) - 1) if nearer < bottom else (key, nearer))
    return sorted(out)


def shard_number(key: Column, tie: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters lie below (key, tie): a balanced tree of conditions."""
    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        k, t = splitters[mid]
        below = (key < F.lit(k)) | ((key == F.lit(k)) & (tie <= F.lit(t))) if k >= -(1 << 63) else F.lit(False)
        return F.when(below, tree(a, mid)).otherwise(tree(mid + 1, b))

    return tree(0, len(splitters)).cast("int")


def write_shards(df: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text: str = "text", tolerance: float = 0.002) -> DataFrame:
    """Put every row into one of ``shards`` by (id, hash of text) so that bytes are near equal, and write them.

    Returns the written rows, all columns of ``df`` with ``shard``, ``slot`` (0, 1, ... without gaps in each shard) and
    ``size`` (UTF-8 bytes of ``text``, null 0, plus 1).  Null ids come first; a heavy id is cut by the texts' hashes;
    rows equal in both stay together (in any order, which no column shows).  An empty table gives no rows.  Columns of
    ``df`` with result names give way.  The sizes are read once from the input, the rounds read that small table.
    """
    own = {"shard", "slot", "size", "_key", "_tie", "_place", "_part", "_row", "_offset"}
    df = df.select(*[F.col(f"`{c}`") for c in passed_on(df.columns, own)])
    least = -(1 << 63)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(least))
    tie = F.xxhash64(F.col(f"`{text}`").cast("string"))
    size = (F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)) + 1).cast("long")
    sizes = durable(df.select(key.alias("key"), tie.alias("tie"), size.alias("size")))
    splitters = find_splitters(sizes, shards, tolerance)
    placed = df.withColumns({"size": size, "_key": key, "_tie": tie}).withColumn("shard", shard_number(F.col("_key"), F.col("_tie"), splitters))
    moved = placed.repartitionByRange("shard", "_key", "_tie").sortWithinPartitions("shard", "_key", "_tie")
    # the id counts a partition's rows in their order: partition in the upper bits, row in the lower 33
    moved.withColumn("_place", F.monotonically_increasing_id()).drop("_key", "_tie").write.partitionBy("shard").parquet(folder)
    # the whole schema is known; a table without rows has no file to read it from
    written = df.sparkSession.read.schema(moved.drop("_key", "_tie", "shard").schema.add("_place", "long").add("shard", "integer")).parquet(folder)
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    runs = written.groupBy("shard", part.alias("_part")).agg(F.min(row).alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # partitions are ranges that follow the shards, so there are at most partitions + shards runs: small whatever the table's size
    return (written.withColumns({"_part": part, "_row": row}).join(F.broadcast(offsets), ["shard", "_part"])
            .withColumn("slot", F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset", "_place"))

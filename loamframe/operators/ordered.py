"""Row numbers, lags and running sums that survive a group holding most rows.

A plain window puts a whole group into one task.  Here groups with more than
``hot_rows`` rows are first cut into order-preserving slices, every window runs
inside one slice, and per-slice totals (a table of at most ``slices`` rows per
hot group) carry the result over from slice to slice.  Ordinary groups have one
slice, so they cost one shuffle like a plain window.

Slices are read off a hash sample of the *distinct* order keys: deterministic
under recomputation, and copies of one row cannot inflate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 2_000_000
SLICES = 256
_SAMPLE_PER_SLICE = 40
_HASH_RANGE = 1_000_000


def _key(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])


def sliced(df: DataFrame, group: list[str], order: list[Column], hot_rows: int = HOT_ROWS,
           slices: int = SLICES) -> DataFrame:
    """Add ``_ord_slice``: 0 in ordinary groups, 0..n in ascending order keys inside hot groups."""
    key = _key(order)
    keyed = df.select(*group, key.alias("_ord_key"))
    hot = (
        keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_ord_n")).filter(F.col("_ord_n") > hot_rows)
        .withColumn("_ord_share", F.lit(float(slices * _SAMPLE_PER_SLICE * _HASH_RANGE)) / F.col("_ord_n"))
    )
    sample = (
        keyed.join(F.broadcast(hot), group)
        .filter(F.pmod(F.xxhash64("_ord_key"), F.lit(_HASH_RANGE)) < F.col("_ord_share"))
        .select(*group, "_ord_key").distinct()
        .groupBy(*group).agg(F.array_sort(F.collect_list("_ord_key")).alias("_ord_sample"))
    )
    stride = F.greatest(F.lit(1), F.ceil(F.size("_ord_sample") / slices).cast("int"))
    at = F.sequence(F.lit(0), F.greatest(F.size("_ord_sample") - 1, F.lit(0)), stride)
    cuts = sample.select(*group, F.transform(at, lambda i: F.get(F.col("_ord_sample"), i)).alias("_ord_cuts"))
    with_cuts = df.join(F.broadcast(cuts), group, "left")
    place = place_among(F.col("_ord_cuts"), key)
    hot_row = F.col("_ord_cuts").isNotNull()
    return with_cuts.withColumns({
        "_ord_slice": F.coalesce(F.when(hot_row, place), F.lit(0)), "_ord_hot": hot_row}).drop("_ord_cuts")


def _hot_part(cut: DataFrame) -> DataFrame:
    """Rows of hot groups: only they have carries.  Without hot groups Spark finds this join empty
    at run time and skips the pass."""
    return cut.filter("_ord_hot")


BLOCK = 16


def place_among(cuts: Column, value: Column) -> Column:
    """How many entries of an ascending array are below ``value``: block first, then inside it."""
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cuts) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.get(cuts, i))
    block = F.size(F.filter(heads, lambda c: c < value))
    start = (block - 1) * BLOCK
    inside = F.size(F.filter(F.slice(cuts, start + 1, F.lit(BLOCK)), lambda c: c < value))
    return F.when(block == 0, F.lit(0)).otherwise(start + inside)


def _grouped(df: DataFrame, group: list[str]):
    """The whole table is one group under a constant key."""
    return (df, group) if group else (df.withColumn("_ord_all", F.lit(0)), ["_ord_all"])


def _inside(group: list[str], order: list[Column]):
    return Window.partitionBy(*group, "_ord_slice").orderBy(*order)


def _across(group: list[str]):
    return Window.partitionBy(*group).orderBy("_ord_slice")


def _carry(df: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Total of ``value`` in all earlier slices, one row per (group, slice)."""
    totals = df.groupBy(*group, "_ord_slice").agg(value.alias("_ord_total"))
    before = _across(group).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_ord_slice", F.coalesce(F.sum("_ord_total").over(before), F.lit(0)).alias(name))


def _add_carry(df: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    """Attach the carry of slices after the first; slice 0 (every ordinary group) needs none.

    The carry table has at most ``slices`` rows per hot group.
    """
    return df.join(F.broadcast(carry.filter(F.col("_ord_slice") > 0)), [*group, "_ord_slice"], "left")


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "position",
                start: int = 1, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Contiguous row number per group in ``order`` (``group=[]``: over the whole table)."""
    df, group = _grouped(df, group)
    cut = sliced(df, group, order, hot_rows, slices)
    inside = _inside(group, order)
    carry = _carry(_hot_part(cut).select(*group, "_ord_slice"), group, F.count(F.lit(1)), "_ord_before")
    numbered = _add_carry(cut.withColumn("_ord_rn", F.row_number().over(inside)), carry, group)
    value = (F.col("_ord_rn") + F.coalesce(F.col("_ord_before"), F.lit(0)) + (start - 1)).cast("long")
    return numbered.withColumn(name, value).drop("_ord_rn", "_ord_before", "_ord_slice", "_ord_hot", "_ord_all")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, name: str,
                hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Cumulative sum of ``value`` in ``order``."""
    df, group = _grouped(df, group)
    cut = sliced(df, group, order, hot_rows, slices)
    inside = _inside(group, order)
    frame = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = _carry(_hot_part(cut).select(*group, "_ord_slice", value), group, F.sum(value), "_ord_before")
    summed = _add_carry(cut.withColumn("_ord_rs", F.sum(value).over(frame)), carry, group)
    return summed.withColumn(name, F.col("_ord_rs") + F.coalesce(F.col("_ord_before"), F.lit(0))).drop(
        "_ord_rs", "_ord_before", "_ord_slice", "_ord_hot", "_ord_all"
    )


def previous_value(df: DataFrame, group: list[str], order: list[Column], value: str, name: str,
                   first_flag: str | None = None, hot_rows: int = HOT_ROWS,
                   slices: int = SLICES) -> DataFrame:
    """``lag(value)`` in ``order``; ``first_flag`` marks the first row of each group."""
    df, group = _grouped(df, group)
    cut = sliced(df, group, order, hot_rows, slices)
    inside = _inside(group, order)
    by_group = _across(group)
    last = _hot_part(cut).groupBy(*group, "_ord_slice").agg(F.max_by(F.struct(F.col(value).alias("v")), _key(order)).alias("_ord_last"))
    carry = last.select(*group, "_ord_slice", F.lag("_ord_last").over(by_group).alias("_ord_carried"))
    marked = cut.withColumns({
        "_ord_rn": F.row_number().over(inside), "_ord_lag": F.lag(value).over(inside),
    })
    joined = _add_carry(marked, carry, group)
    out = joined.withColumn(
        name, F.when(F.col("_ord_rn") > 1, F.col("_ord_lag")).otherwise(F.col("_ord_carried.v"))
    )
    if first_flag:
        out = out.withColumn(first_flag, (F.col("_ord_rn") == 1) & F.col("_ord_carried").isNull())
    return out.drop("_ord_rn", "_ord_lag", "_ord_carried", "_ord_slice", "_ord_hot", "_ord_all")


def neighbour_values(df: DataFrame, group: list[str], order: list[Column], value: str, before: str,
                     after: str, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Nearest non-null ``value`` strictly before and strictly after each row."""
    df, group = _grouped(df, group)
    cut = sliced(df, group, order, hot_rows, slices)
    inside = _inside(group, order)
    known = F.when(F.col(value).isNotNull(), _key(order))
    by_group = _across(group)
    ends = _hot_part(cut).groupBy(*group, "_ord_slice").agg(
        F.max_by(value, known).alias("_ord_hi"), F.min_by(value, known).alias("_ord_lo")
    )
    carry = ends.select(
        *group, "_ord_slice",
        F.last("_ord_hi", True).over(by_group.rowsBetween(Window.unboundedPreceding, -1)).alias("_ord_carry_lo"),
        F.first("_ord_lo", True).over(by_group.rowsBetween(1, Window.unboundedFollowing)).alias("_ord_carry_hi"),
    )
    # what follows is read backwards: a frame that ends with the slice would be worked out anew for each row
    backwards = Window.partitionBy(*group, "_ord_slice").orderBy(F.desc("_ord_rn"))
    earlier = (Window.unboundedPreceding, -1)
    local = cut.withColumns({"_ord_b": F.last(value, True).over(inside.rowsBetween(*earlier)), "_ord_rn": F.row_number().over(inside)})
    local = local.withColumn("_ord_a", F.last(value, True).over(backwards.rowsBetween(*earlier))).drop("_ord_rn")
    # slice 0 of a hot group may look ahead, so carries of all slices are kept here
    joined = local.join(F.broadcast(carry.filter(
        F.col("_ord_carry_lo").isNotNull() | F.col("_ord_carry_hi").isNotNull())), [*group, "_ord_slice"], "left")
    return joined.withColumns({
        before: F.coalesce("_ord_b", "_ord_carry_lo"), after: F.coalesce("_ord_a", "_ord_carry_hi"),
    }).drop("_ord_b", "_ord_a", "_ord_carry_lo", "_ord_carry_hi", "_ord_slice", "_ord_hot", "_ord_all")


def _field(name: str):
    return lambda row: row[name]


def series_arrays(df: DataFrame, group: list[str], order: list[Column], values: list[str],
                  chunk_rows: int = 10_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Parallel arrays of ``values`` per group in ``order``.

    A group longer than ``chunk_rows`` continues in further rows (``chunk`` = 0, 1, …), so
    no array and no task ever holds an unbounded group.
    """
    numbered = number_rows(df, group, order, "_ord_pos", hot_rows=hot_rows)
    chunked = numbered.withColumn("chunk", F.floor((F.col("_ord_pos") - 1) / chunk_rows).cast("int"))
    packed = chunked.groupBy(*group, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_ord_pos", *values))).alias("_ord_rows")
    )
    return packed.select(
        *group, "chunk", *[F.transform("_ord_rows", _field(v)).alias(v) for v in values]
    )

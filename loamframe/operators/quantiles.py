"""Exact percentiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.  That
is right for groups with a natural bound (one pixel's dates).  For open groups a
sketch first brackets each wanted rank; one aggregation then counts what lies below
each bracket and keeps only the values inside it, a small share of the rows, to be
ordered.  The ranks are checked against the counts, so the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamframe.operators import ordered

ACCURACY = 4000
MARGIN = 4.0 / ACCURACY


def exact_percentiles(df: DataFrame, group: list[str], value: str, probabilities: dict[str, float],
                      hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """One row per group with each named percentile, linearly interpolated; NULL and NaN skipped."""
    keys = [f"_g{n}" for n in range(len(group))] or ["_g0"]
    named = [F.col(g).alias(k) for g, k in zip(group, keys)] or [F.lit(0).alias("_g0")]
    number = F.col(value).cast("double")
    values = df.filter(number.isNotNull() & ~F.isnan(number)).select(*named, number.alias("_v"))
    bounds = [min(max(p + side * MARGIN, 0.0), 1.0) for p in probabilities.values() for side in (-1, 1)]
    # a small group keeps all its values: there a margin in shares could be less than one rank
    small = F.count(F.lit(1)) <= ACCURACY
    ends_of_group = F.array(*[F.min("_v"), F.max("_v")] * len(probabilities))
    brackets = values.groupBy(*keys).agg(
        F.when(small, ends_of_group).otherwise(F.percentile_approx("_v", bounds, ACCURACY)).alias("_q"))
    # without groups the bracket table is one row; with groups Spark decides on its real size
    joined = values.join(brackets if group else F.broadcast(brackets), keys)
    states = {
        f"_s{n}": F.when(F.col("_v") < F.get("_q", F.lit(2 * n)), 0).when(F.col("_v") <= F.get("_q", F.lit(2 * n + 1)), 1).otherwise(2)
        for n in range(len(probabilities))
    }
    placed = joined.withColumns(states)
    inside_any = F.greatest(*[(F.col(s) == 1).cast("int") for s in states], F.lit(0)) == 1
    # rows outside all brackets collapse, map-side, to one row per state
    counted = placed.withColumn("_v", F.when(inside_any, F.col("_v"))).groupBy(*keys, *states, "_v").agg(F.count(F.lit(1)).alias("_n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.col(f"_s{n}").alias("state"))
        for n, (name, p) in enumerate(probabilities.items())
    ]))
    rows = counted.select(*keys, "_v", "_n", each.alias("_e")).select(*keys, "_v", "_n", "_e.*")
    below = rows.groupBy(*keys, "name", "p").agg(
        F.sum(F.when(F.col("state") == 0, F.col("_n")).otherwise(F.lit(0))).alias("_below"), F.sum("_n").alias("_total"))
    inside = rows.filter(F.col("state") == 1).groupBy(*keys, "name", "_v").agg(F.sum("_n").alias("_n"))
    ranked = ordered.running_sum(inside, [*keys, "name"], [F.col("_v")], "_n", "_end", hot_rows)
    spans = ranked.join(below, [*keys, "name"])
    position = F.col("p") * (F.col("_total") - 1)
    last = F.col("_below") + F.col("_end") - 1
    first = last - F.col("_n") + 1

    def at(rank):
        return F.max(F.when((rank >= first) & (rank <= last), F.col("_v")))

    ends = spans.groupBy(*keys, "name").agg(
        at(F.floor(position)).alias("_lo"), at(F.ceil(position)).alias("_hi"), F.first(position - F.floor(position)).alias("_part"))
    checked = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("rank outside its bracket")).cast("double")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    wide = ends.select(*keys, "name", checked.alias("_a")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("_a"))).alias(name) for name in probabilities])
    return wide.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], *probabilities)

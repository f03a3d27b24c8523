"""Row identity: ids, keys, duplicates, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamframe.operators import ordered


def assign_gid(df: DataFrame, order: list[str], name: str = "gid", offset: int = 0,
               hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Contiguous, stable ids 1 + offset, 2 + offset, … in the given order, no single-task window."""
    return ordered.number_rows(df, [], [F.col(c) for c in order], name, start=1 + offset, hot_rows=hot_rows)


def number_fields(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """0-based number in list order."""
    return ordered.number_rows(df, [], [F.col(c) for c in order], name, start=0)


def repair_null_gid(df: DataFrame, order: list[str], gid: str = "gid") -> DataFrame:
    """Missing or unreadable ids become max + 1, max + 2, …; good ids stay."""
    number = F.col(gid).try_cast("double")
    typed = df.withColumn(gid, F.when(number == F.floor(number), number.cast("bigint")))
    top = typed.agg(F.coalesce(F.max(gid), F.lit(0)).cast("bigint").alias("_top")).withColumn("_one", F.lit(1))
    missing = ordered.number_rows(
        typed.filter(F.col(gid).isNull()).drop(gid), [], [F.col(c) for c in order if c != gid], "_n"
    ).withColumn("_one", F.lit(1))
    filled = missing.join(F.broadcast(top), "_one").withColumn(gid, F.col("_top") + F.col("_n")).drop("_one", "_top", "_n")
    return typed.filter(F.col(gid).isNotNull()).unionByName(filled)


def ensure_gid(df: DataFrame, order: list[str]) -> DataFrame:
    """Keep a gid column, repairing its gaps; make one when there is none."""
    if "gid" in df.columns:
        return repair_null_gid(df, [c for c in order if c != "gid"])
    return assign_gid(df, order)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key.  ``min_by`` combines map-side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    # maps cannot be hashed: their JSON text can
    kinds = dict(df.dtypes)
    content = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in rest])
    by = F.struct(F.col(version), content) if version else F.struct(content)
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def validate_key(df: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """One row: rows, nulls, duplicate rows, non-integers, negatives and example duplicates."""
    if key not in df.columns:
        raise ValueError(f"key column {key!r} is missing")
    number = F.col(key).try_cast("double")
    per_value = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_value.withColumn(key, F.col("_k")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull() & (number.isNull() | (number != F.floor(number))), F.col("_n"))),
                   F.lit(0)).alias("non_integers"),
        F.coalesce(F.sum(F.when(number < 0, F.col("_n"))), F.lit(0)).alias("negatives"),
    ).withColumn("_one", F.lit(1))
    shown = (
        per_value.filter(F.col("_k").isNotNull() & (F.col("_n") > 1)).orderBy("_k").limit(examples)
        .agg(F.array_sort(F.collect_list("_k")).alias("examples")).withColumn("_one", F.lit(1))
    )
    return totals.join(F.broadcast(shown), "_one").drop("_one")


def fk_orphans(source: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """One report row for a declared reference: duplicate target keys, orphan source rows."""
    duplicates = target.groupBy(key).count().filter("count > 1").agg(
        F.count(F.lit(1)).alias("duplicate_targets")).withColumn("_one", F.lit(1))
    # counted per distinct value first: a hot value joins as a single row
    values = source.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = values.join(target.select(F.col(key).alias("_v")).distinct(), "_v", "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_values")
    ).withColumn("_one", F.lit(1))
    report = duplicates.join(F.broadcast(orphans), "_one").drop("_one")
    return report.select(F.lit(column).alias("from_column"), F.lit(key).alias("to_column"), "*")


def purge(df: DataFrame, finished: str, now: Column, days: int) -> DataFrame:
    """Rows not finished, or finished within the last ``days`` days."""
    return df.filter(F.col(finished).isNull() | (F.col(finished) >= F.date_sub(now, days)))

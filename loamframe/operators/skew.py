"""Joins that hold when one key carries a large part of all rows.

A key is *hot* when the left side has more than ``hot_rows`` rows of it.  There
are at most ``rows / hot_rows`` hot keys, so their table is always small enough
to broadcast, whatever the data size.  Hot keys get salted: the left rows are
spread over ``ceil(count / hot_rows)`` salts and the right rows are copied to
each.  All other keys keep a single salt, so nothing is copied for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of salts they need."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    return counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    spread_right: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join on ``keys`` (inner or left) with hot left keys spread over salts.

    ``spread`` is any deterministic left-side expression that differs from row to
    row (a row id); it only decides which salt a row gets.  With ``spread_right`` (inner
    joins) hot keys of the right side are spread as well, and a key that is hot on both
    sides becomes a grid of salts.  ``tasks`` fixes the number of tasks: merged by bytes, small entries that give many pairs
    would end up in few.
    """
    if spread_right is not None and how != "inner":
        raise ValueError("the right side can be spread in inner joins only")
    hot = hot_keys(left.select(*keys), keys, hot_rows)
    if spread_right is None:
        hot = hot.withColumn("_salts_r", F.lit(1))
    else:
        hot = hot.join(hot_keys(right.select(*keys), keys, hot_rows).withColumnRenamed("_salts", "_salts_r"), keys, "full")

    def dealt(value: Column | None, salts: str) -> Column:
        return F.lit(0) if value is None else F.pmod(F.xxhash64(value), F.coalesce(F.col(salts), F.lit(1))).cast("int")

    def copied(salts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))

    spread_left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", dealt(spread, "_salts"))
    spread_left = spread_left.withColumn("_salt_r", copied("_salts_r") if spread_right is not None else F.lit(0)).drop("_salts", "_salts_r")
    copied_right = right.join(F.broadcast(hot), keys, "left").withColumn("_salt_r", dealt(spread_right, "_salts_r"))
    copied_right = copied_right.withColumn("_salt", copied("_salts")).drop("_salts", "_salts_r")
    on = [*keys, "_salt", "_salt_r"]
    if tasks:
        # by name: Spark takes exploded entries for no larger than their table, and would broadcast them
        spread_left, copied_right = spread_left.repartition(tasks, *on), copied_right.repartition(tasks, *on).hint("merge")
    return spread_left.join(copied_right, on, how).drop("_salt", "_salt_r")


#: A side is broadcast by hand only up to this many bytes.
BROADCAST_BYTES = 32 << 20
FIXED_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value, from the lengths of what varies in it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        total = F.lit(0).cast("long")
        for field in kind:
            total = total + _value_bytes(value[field.name], field.dataType)
        return total
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(8).cast("long"), lambda acc, v: acc + _value_bytes(v, inner)), F.lit(8).cast("long"))
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * FIXED_BYTES.get(type(inner), 8)
    return F.lit(FIXED_BYTES.get(type(kind), 8)).cast("long")


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """About how many bytes the named columns of a row take."""
    total = F.lit(0).cast("long")
    for name in dict.fromkeys(columns):
        total = total + _value_bytes(F.col(f"`{name}`"), df.schema[name].dataType)
    return total


def over_all_tasks(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by key over all cores, for work that is heavy for each row.

    Small files are read by few tasks and small shuffles are merged into few; a number asked for is kept.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def small(df: DataFrame, limit_rows: int = 200_000) -> bool:
    """Has ``df`` at most ``limit_rows`` rows?  Reads no more than that many plus one."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def lookup_join(left: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
                limit_rows: int = 200_000) -> DataFrame:
    """Join a lookup: broadcast it when its size has been checked, shuffle otherwise (AQE splits
    hot keys of the big side then)."""
    return left.join(F.broadcast(table) if small(table, limit_rows) else table, keys, how)

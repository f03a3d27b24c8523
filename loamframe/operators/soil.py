"""Soil components, horizons, hydrologic groups, land use and crop codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes
from loamframe.functions.text import valid_hydro_group
from loamframe.operators import harmonize, ordered


#: Component rows of a task.
TASK_ROWS = 200_000


def components_with_hydro(components: DataFrame, hydro: DataFrame, polygon_codes: DataFrame | list | None = None,
                          code: str = "code_polygone", component: str = "composante", task_rows: int = TASK_ROWS) -> DataFrame:
    """Components of the given polygons with their soil code and hydrologic group (left join).

    Above ``task_rows`` rows for each task that Spark would take, tasks are told by rows: merged by bytes, short rows
    end up as some millions in one task.  The result is then dealt by component.
    """
    tasks = math.ceil(components.count() / task_rows)
    if tasks <= components.sparkSession.sparkContext.defaultParallelism:
        wanted = components if polygon_codes is None else harmonize.in_list(components, code, polygon_codes)
        return wanted.join(hydro, component, "left")
    if isinstance(polygon_codes, DataFrame):
        components, polygon_codes = components.repartition(tasks, code), polygon_codes.toDF(code).repartition(tasks, code)
    wanted = components if polygon_codes is None else harmonize.in_list(components, code, polygon_codes)
    return wanted.repartition(tasks, component).join(hydro.repartition(tasks, component), component, "left")


def component_shares(fractions: DataFrame, components: DataFrame, parcel_id: str, code: str = "code_polygone",
                     component: str = "composante", percent: str = "pourcentage", keep: list[str] = ()) -> DataFrame:
    """Percent of each parcel by component: overlap fraction × component percent, summed."""
    joined = fractions.select(parcel_id, code, "fraction").join(components.select(code, component, percent, *keep), code)
    return joined.groupBy(parcel_id, component).agg(
        F.sum(F.col("fraction") * F.col(percent)).alias("share_pct"),
        *[F.min(c).alias(c) for c in keep],
    )


#: Components of a polygon that are packed into one row.
PACKED = 5_000


def packed_components(components: DataFrame, hydro: DataFrame, polygon_codes: DataFrame, code: str = "code_polygone", component: str = "composante",
                      percent: str = "pourcentage", keep: list[str] = (), packed: int = PACKED) -> DataFrame:
    """(code, ``parts``): the components of a polygon code as an array of (component, kept columns, percent).

    The kept columns of ``hydro`` belong to the component: of several rows the least value is taken, and each counts its percent.  A code
    with more than about ``packed`` components has several rows.
    """
    named = hydro.groupBy(component).agg(F.count(F.lit(1)).alias("_times"), *[F.min(c).alias(c) for c in keep])
    described = components_with_hydro(components, named, polygon_codes, code, component)
    weight = (F.col(percent) * F.coalesce("_times", F.lit(1))).alias(percent)
    rows = described.select(code, F.struct(component, *keep, weight).alias("_part"))
    most = components.groupBy(code).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    chunk = F.pmod(F.xxhash64(f"_part.{component}"), F.lit(math.ceil(most / packed) or 1))
    return rows.groupBy(code, chunk.alias("_chunk")).agg(F.collect_list("_part").alias("parts")).drop("_chunk")


def described_pct(shares: DataFrame, parcel_id: str) -> DataFrame:
    return shares.groupBy(parcel_id).agg(F.round(F.sum(F.round("share_pct", 2)), 2).alias("described_pct"))


def dominant_group(shares: DataFrame, parcel_id: str, group: str = "groupe_hydrologique") -> DataFrame:
    """Hydrologic group with the largest summed share; unknown groups do not count.

    Ties go to the group that sorts first.
    """
    known = shares.withColumn("_g", valid_hydro_group(F.col(group))).filter(F.col("_g").isNotNull())
    totals = known.groupBy(parcel_id, "_g").agg(F.sum("share_pct").alias("_t"))
    return totals.groupBy(parcel_id).agg(
        F.min_by("_g", F.struct(-F.round("_t", 9), "_g")).alias("dominant_group"))


def parcel_summary(shares: DataFrame, parcel_id: str, group: str = "groupe_hydrologique") -> DataFrame:
    """``described_pct`` and ``dominant_group`` of each parcel in one pass over its component rows."""
    by_group = shares.groupBy(parcel_id, valid_hydro_group(F.col(group)).alias("_g")).agg(
        F.sum("share_pct").alias("_t"), F.sum(F.round("share_pct", 2)).alias("_p"))
    rank = F.when(F.col("_g").isNotNull(), F.struct(-F.round("_t", 9), F.col("_g")))  # min_by leaves out rows without a rank
    return by_group.groupBy(parcel_id).agg(F.round(F.sum("_p"), 2).alias("described_pct"), F.min_by("_g", rank).alias("dominant_group"))


def prefer_primary(primary: DataFrame, fallback: DataFrame, soil: str, names: tuple[str, str]) -> DataFrame:
    """Rows of the primary source, and of the fallback for soils the primary lacks."""
    missing = fallback.join(primary.select(soil).distinct(), soil, "left_anti")
    return primary.withColumn("source", F.lit(names[0])).unionByName(
        missing.withColumn("source", F.lit(names[1])), allowMissingColumns=True)


def top_depth(horizons: DataFrame, soil: str, order: list[Column], bottom: str, name: str = "depth_top_cm",
              hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Top of each horizon: the previous horizon's bottom, 0 for the first."""
    lagged = ordered.previous_value(horizons, [soil], order, bottom, name, "_first", hot_rows)
    return lagged.withColumn(name, F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col(name))).drop("_first")


def _depth_order() -> list[Column]:
    """By depth, unknown depth last, then by name and value so that the order is total."""
    return [F.coalesce(F.col("depth_bottom_cm"), F.lit(float("inf"))), F.col("horizon"), F.col("g_cm3")]


def horizon_rows(primary: DataFrame, fallback: DataFrame, soil: str = "code_sol",
                 names: tuple[str, str] = ("eessaq", "inventaire_1990"), hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Ordered horizons per soil, long form: one source per soil, top depths for the primary only.

    ``primary``: soil, horizon, depth_bottom_cm, g_cm3; ``fallback``: soil, horizon, g_cm3.
    """
    first = primary.filter(F.col("g_cm3").isNotNull())
    second = fallback.filter(F.col("g_cm3").isNotNull()).withColumn("depth_bottom_cm", F.lit(None).cast("double"))
    rows = prefer_primary(first.select(soil, "horizon", "depth_bottom_cm", "g_cm3"),
                          second.select(soil, "horizon", "depth_bottom_cm", "g_cm3"), soil, names)
    order = _depth_order()
    deep = top_depth(rows, soil, order, "depth_bottom_cm", hot_rows=hot_rows)
    return deep.select(
        soil, "source", "horizon",
        F.round(F.when(F.col("source") == names[0], F.col("depth_top_cm")), 2).alias("depth_top_cm"),
        F.round("depth_bottom_cm", 2).alias("depth_bottom_cm"), F.round("g_cm3", 3).alias("g_cm3"),
    )


def horizon_profile(rows: DataFrame, soil: str = "code_sol", chunk_rows: int = 10_000) -> DataFrame:
    """Horizon arrays per soil, in depth order (unknown depth last)."""
    return ordered.series_arrays(rows, [soil, "source"], _depth_order(), ["horizon", "depth_top_cm", "depth_bottom_cm", "g_cm3"], chunk_rows)


def code_lookup(values: DataFrame, code: str, table: DataFrame | None = None, default: str = codes.DEFAULT_CROP_GROUP) -> DataFrame:
    """Raster class → crop group; classes without a group get the default."""
    if table is None:
        table = values.sparkSession.createDataFrame(list(codes.CROP_GROUPS.items()), f"{code} int, crop_group string")
    joined = values.join(F.broadcast(table), code, "left")  # the fixed code table
    return joined.withColumn("crop_group", F.coalesce("crop_group", F.lit(default)))


def land_use_rows(items: DataFrame, parcel: str, when: str, use: str) -> DataFrame:
    """(parcel, year, land_use) of items that have a datetime; missing use → ``unknown``."""
    return items.filter(F.col(when).isNotNull()).select(
        parcel, F.year(when).alias("year"), F.coalesce(use, F.lit("unknown")).alias("land_use"))


def land_use_history(rows: DataFrame, parcel: str, chunk_rows: int = 10_000) -> DataFrame:
    """Years and land uses per parcel as parallel arrays."""
    return ordered.series_arrays(rows, [parcel], [F.col("year"), F.col("land_use")], ["year", "land_use"], chunk_rows)

"""Tables of requests: locations, validation, ranges, guards.  Each check returns reasons, so a
bad request becomes a rejected row instead of a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.operators import skew


def reasons(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks]))


def split_valid(df: DataFrame, why: str = "reasons"):
    """(valid rows without the reasons, rejected rows with them)."""
    return df.filter(F.size(why) == 0).drop(why), df.filter(F.size(why) > 0)


def validate_coords(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` for location requests with columns location_type, farm_id, lon, lat,
    minx, miny, maxx, maxy, polygon."""
    kind = F.col("location_type")
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    missing_box = geo.any_of([c.isNull() for c in box])
    return df.withColumn("reasons", reasons(
        ("unknown location type", kind.isNull() | ~kind.isin("farm_id", "point", "bbox", "polygon")),
        ("farm_id missing", (kind == "farm_id") & F.col("farm_id").isNull()),
        ("farm_id not a positive number", (kind == "farm_id") & F.col("farm_id").isNotNull()
         & ~F.coalesce(F.col("farm_id").try_cast("bigint") > 0, F.lit(False))),
        ("point missing", (kind == "point") & (F.col("lon").isNull() | F.col("lat").isNull())),
        ("bbox missing", (kind == "bbox") & missing_box),
        ("polygon missing", (kind == "polygon") & F.col("polygon").isNull()),
        ("longitude out of range", ~F.col("lon").between(-180, 180)),
        ("latitude out of range", ~F.col("lat").between(-90, 90)),
        ("minx must be below maxx", box[0] >= box[2]),
        ("miny must be below maxy", box[1] >= box[3]),
    ))


def resolve_locations(df: DataFrame, farms: DataFrame):
    """(resolved rows with bounds and optional polygon, rejected rows with reasons).

    ``farms``: farm_id, geom.
    """
    valid, rejected = split_valid(validate_coords(df))
    kind = F.col("location_type")
    keyed = valid.withColumn("_farm", F.when(kind == "farm_id", F.col("farm_id").try_cast("bigint")))
    table = farms.select(F.col("farm_id").cast("bigint").alias("_farm"), F.col("geom").alias("_farm_geom"))
    joined = skew.lookup_join(keyed, table, ["_farm"])
    shape = F.when(kind == "polygon", F.col("polygon")).when(kind == "farm_id", F.col("_farm_geom"))
    box = geo.bounds(shape)
    value = {
        "minx": F.when(kind == "point", F.col("lon")).when(kind == "bbox", F.col("minx")).otherwise(box["minx"]),
        "miny": F.when(kind == "point", F.col("lat")).when(kind == "bbox", F.col("miny")).otherwise(box["miny"]),
        "maxx": F.when(kind == "point", F.col("lon")).when(kind == "bbox", F.col("maxx")).otherwise(box["maxx"]),
        "maxy": F.when(kind == "point", F.col("lat")).when(kind == "bbox", F.col("maxy")).otherwise(box["maxy"]),
    }
    placed = joined.withColumns({**value, "polygon": shape}).drop("_farm", "_farm_geom")
    unknown = placed.filter(F.col("minx").isNull()).withColumn("reasons", F.array(F.lit("unknown farm")))
    return (
        placed.filter(F.col("minx").isNotNull()),
        rejected.unionByName(unknown.select(*rejected.columns), allowMissingColumns=True),
    )


def min_bbox(df: DataFrame, least: float = 1.0) -> DataFrame:
    """A box narrower or lower than ``least`` degrees becomes a centred ``least`` × ``least`` box."""
    minx, miny, maxx, maxy = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    enough = (maxx - minx >= least) & (maxy - miny >= least)
    cx, cy, half = (minx + maxx) / 2, (miny + maxy) / 2, least / 2
    grown = {"minx": cx - half, "miny": cy - half, "maxx": cx + half, "maxy": cy + half}
    return df.withColumns({c: F.when(enough, F.col(c)).otherwise(v) for c, v in grown.items()})


def area_guard(df: DataFrame, max_km2: float):
    """(boxes up to the limit, rejected larger ones), each with its ``area_km2``."""
    sized = df.withColumn("area_km2", geo.bbox_area_km2(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    return sized.filter(F.col("area_km2") <= max_km2), sized.filter(F.col("area_km2") > max_km2)


def effective_range(requests: DataFrame, datasets: DataFrame, today: Column):
    """Bound each request by its dataset's last day: rolling ones end ``lag_days`` before today.

    ``datasets``: dataset, rolling, lag_days, valid_start, valid_end (a registry, checked small).
    """
    ends = datasets.withColumn(
        "effective_end", F.when(F.col("rolling"), F.date_sub(today, F.col("lag_days"))).otherwise(F.col("valid_end"))
    ).select("dataset", "valid_start", "effective_end")
    judged = skew.lookup_join(requests, ends, ["dataset"]).withColumn("reasons", reasons(
        ("unknown dataset", F.col("effective_end").isNull()),
        ("ends after the data", F.col("end_date") > F.col("effective_end")),
        ("starts before the data", F.col("start_date") < F.col("valid_start")),
    ))
    return split_valid(judged)


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` for indicator requests: dates, indicator, projection fields, limits."""
    start, end = F.try_to_date("start_date", "yyyy-MM-dd"), F.try_to_date("end_date", "yyyy-MM-dd")
    projected = F.col("dataset") == "cmip6_espo_g6_r2"
    return df.withColumn("reasons", reasons(
        ("start_date is no ISO date", F.col("start_date").isNull() | start.isNull()),
        ("end_date is no ISO date", F.col("end_date").isNull() | end.isNull()),
        ("start_date after end_date", start > end),
        ("unknown indicator", ~F.coalesce(F.col("indicator").isin(list(codes.INDICATOR_VARIABLES)), F.lit(False))),
        ("scenario required", projected & F.col("scenario").isNull()),
        ("unknown scenario", ~F.col("scenario").isin(codes.SCENARIOS)),
        ("model required", projected & F.col("model").isNull()),
        ("base_temp out of range", ~F.col("base_temp").between(0, 15)),
        ("threshold out of range", ~F.col("threshold").between(0, 50)),
    ))


def validate_limits(df: DataFrame) -> DataFrame:
    """Adds ``reasons`` for spatial requests: cut-off, tolerance, described share."""
    return df.withColumn("reasons", reasons(
        ("max_distance_m out of range", ~F.col("max_distance_m").between(0, 100_000)),
        ("tolerance_m out of range", ~F.col("tolerance_m").between(0, 500)),
        ("min_described_pct out of range", ~F.col("min_described_pct").between(0, 100)),
    ))


def validate_station_requests(df: DataFrame, collections: DataFrame) -> DataFrame:
    """Adds ``reasons`` for station requests; ``collections``: collection, variables array."""
    start, end = F.try_to_date("start_date", "yyyy-MM-dd"), F.try_to_date("end_date", "yyyy-MM-dd")
    known = collections.select("collection", F.col("variables").alias("_known"))
    joined = skew.lookup_join(df.withColumn("variables", F.array_distinct("variables")), known, ["collection"])
    return joined.withColumn("reasons", reasons(
        ("unknown collection", F.col("_known").isNull()),
        ("variable not in collection", F.size(F.array_except("variables", "_known")) > 0),
        ("start_date is no ISO date", start.isNull()), ("end_date is no ISO date", end.isNull()),
        ("start_date after end_date", start > end),
    )).drop("_known")

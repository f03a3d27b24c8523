"""Parcel jobs: soil properties, soil coverage, water distance, field match, one-row portrait."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamframe.functions import geometry as geo
from loamframe.functions.text import valid_hydro_group
from loamframe.operators import overlay, pixels as px, skew, soil, spatial
from loamframe.session import durable


def pedo_components(parcels: DataFrame, polygons: DataFrame, components: DataFrame, hydro: DataFrame, parcel_id: str = "gid",
                    code: str = "code_polygone") -> DataFrame:
    """Long component rows per parcel with share, soil code and hydrologic group.

    They may be far more than parcels and polygons together, so they are neither shuffled nor written on the way.
    """
    keep = ["code_sol", "groupe_hydrologique"]
    packed = soil.packed_components(components, hydro, polygons.select(code).distinct(), code, keep=keep)
    carrying = durable(polygons.select("polygon_id", code, "geom", *spatial.BOX).join(packed, code))
    shares = overlay.part_shares(parcels, carrying, parcel_id, "polygon_id", "parts", ["composante", *keep], "pourcentage")
    return shares.select(parcel_id, "composante", "share_pct", "code_sol", valid_hydro_group(F.col("groupe_hydrologique")).alias("groupe_hydrologique"))


def pedo_properties(parcels: DataFrame, polygons: DataFrame, components: DataFrame, hydro: DataFrame, density: DataFrame,
                    density_fallback: DataFrame, parcel_id: str = "gid"):
    """(summary per parcel, component rows per parcel, horizon profile per soil).

    Three tables instead of one nested document: horizons are joined per soil once,
    not repeated in every parcel that has the soil.
    """
    shares = pedo_components(parcels, polygons, components, hydro, parcel_id)
    used = shares.select("code_sol").filter(F.col("code_sol").isNotNull()).distinct()
    horizons = soil.horizon_rows(density.join(used, "code_sol", "left_semi"), density_fallback.join(used, "code_sol", "left_semi"))
    summary = parcels.select(parcel_id).join(soil.parcel_summary(shares, parcel_id), parcel_id, "left").withColumn(
        "described_pct", F.coalesce("described_pct", F.lit(0.0)))
    rows = shares.withColumn("share_pct", F.round("share_pct", 2))
    return summary, rows, soil.horizon_profile(horizons)


def _as_polygon(parcels: DataFrame, metres: float = 5.0) -> DataFrame:
    """Point parcels become small discs, so that shares of their area exist."""
    x, y = F.get(geo.xs_of(F.col("geom")), F.lit(0)), F.get(geo.ys_of(F.col("geom")), F.lit(0))
    shape = F.when(F.col("geom.kind") == "POINT", geo.buffer_point(x, y, metres)).otherwise(F.col("geom"))
    return geo.with_bounds(parcels.withColumn("geom", shape))


def pedo_coverage(parcels: DataFrame, first: DataFrame, second: DataFrame, min_pct: float, parcel_id: str = "gid",
                  names: tuple[str, str] = ("irda_2026", "irda_2022")) -> DataFrame:
    """Long class shares per parcel with the release used.

    ``first``: soil_id, symbol, geom; ``second``: soil_id, symbol, description, geom.
    """
    shapes = _as_polygon(parcels)
    # both releases are read twice by the choice below: written out once
    a = overlay.class_shares(overlay.overlap_join(shapes, first, parcel_id, "soil_id", ["symbol"]), parcel_id, "symbol")
    a = durable(a)
    b = overlay.class_shares(
        overlay.overlap_join(shapes, second, parcel_id, "soil_id", ["symbol", "description"]), parcel_id, "symbol", "description")
    b = durable(b)
    a = a.withColumn("description", F.lit(None).cast("string")).select(*b.columns)
    return overlay.coverage_with_fallback(parcels, a, b, parcel_id, "symbol", min_pct, names)


def coverage_summary(coverage: DataFrame, parcel_id: str = "gid") -> DataFrame:
    """One row per parcel: source, dominant class, count, described percent, classes."""
    found = coverage.filter(F.col("symbol").isNotNull() | F.col("share_pct").isNotNull())
    packed = overlay.describe_parcel(found, parcel_id, "symbol", "description")
    sources = coverage.groupBy(parcel_id).agg(F.max("source").alias("source"))
    return sources.join(packed, parcel_id, "left").withColumns({
        "count": F.coalesce("count", F.lit(0)), "described_pct": F.coalesce("described_pct", F.lit(0.0))})


def water_distance(parcels: DataFrame, water: DataFrame, max_m: float, parcel_id: str = "gid", water_id: str = "water_id",
                   k: int = 5) -> DataFrame:
    """Distance from each parcel's interior point to the nearest water feature."""
    # a generator: as a plain column the point would be worked out again for every condition on it
    at = F.inline(F.array(geo.interior_point(F.col("geom"))))
    placed = skew.over_all_tasks(parcels.select(parcel_id, "geom"), parcel_id).select(parcel_id, at)
    return spatial.nearest_distance(placed, water, parcel_id, water_id, "x", "y", max_m, k)


def som_field_match(parcels: DataFrame, fields: DataFrame, tolerance_m: float, parcel_id: str = "parcel_id",
                    field_id: str = "gid", flag: str = "has_gee_data") -> DataFrame:
    """Fields within the tolerance (0–500 m) of each parcel, flagged first, then by distance."""
    if not 0 <= tolerance_m <= 500:
        raise ValueError("tolerance must be 0..500 m")
    return spatial.within_distance(parcels, fields, parcel_id, field_id, flag, tolerance_m)


def parcel_portrait(parcels: DataFrame, coverage: DataFrame, shares: DataFrame, water: DataFrame, pixel_stats: dict[str, DataFrame],
                    precipitation: DataFrame, parcel_id: str = "gid") -> DataFrame:
    """One row per parcel out of the separate results.

    ``coverage``: coverage summary; ``shares``: component rows; ``water``: distances;
    ``pixel_stats``: name → zonal statistics; ``precipitation``: nearest-station totals.
    All inputs have one row per parcel but ``shares``, which is summarised first.
    """
    out = parcels.select(parcel_id, (geo.area_m2(F.col("geom")) / 10_000).alias("area_ha"))
    out = out.join(coverage.select(parcel_id, F.col("symbol").alias("soil_symbol"), F.col("described_pct").alias("soil_pct")), parcel_id, "left")
    out = out.join(soil.dominant_group(shares, parcel_id), parcel_id, "left")
    out = out.join(water, parcel_id, "left")
    for name, stats in pixel_stats.items():
        out = out.join(stats.select(parcel_id, F.col("mean").alias(f"{name}_mean")), parcel_id, "left")
    return out.join(precipitation.select(parcel_id, F.col("total").alias("recent_precipitation")), parcel_id, "left")


def zonal_means(parcels: DataFrame, layers: dict[str, DataFrame], parcel_id: str = "gid") -> dict[str, DataFrame]:
    return {name: px.zonal_stats(layer, parcels, parcel_id) for name, layer in layers.items()}

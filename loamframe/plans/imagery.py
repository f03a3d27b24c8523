"""Imagery jobs: satellite products, terrain products, bare-soil features, mask comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamframe.functions import indices
from loamframe.operators import pixels as px, reports, requests as rq, spatial
from loamframe.session import durable
from loamframe.sources import landed


def sentinel_products(pixels: DataFrame, scenes: DataFrame, parcels: DataFrame, box, start, end, max_cloud: float | None = None,
                      masked: bool = True, method: str = "median", parcel_id: str = "gid", max_km2: float = 1e9):
    """Composite and index statistics: (composite pixels with NDVI, EVI, SAVI, statistics per parcel and index).

    Order matters and is kept: mask before scaling, reduce time before the index.
    """
    bands = ["b02", "b03", "b04", "b08"]
    accepted, _ = rq.area_guard(parcels, max_km2)
    rows = landed.load_scenes(pixels, scenes, box, start, end, [*bands, "scl"], max_cloud)
    if masked:
        rows = px.scl_mask(rows, bands)
    scaled = rows.withColumns({b: indices.scale_reflectance(F.col(b)) for b in bands})
    composite = px.temporal_composite(scaled, ["x", "y"], bands, method)
    products = composite.withColumns({
        "pixel_id": F.struct("x", "y"),
        "ndvi": indices.ndvi(F.col("b08"), F.col("b04")), "evi": indices.evi(F.col("b08"), F.col("b04"), F.col("b02")),
        "savi": indices.savi(F.col("b08"), F.col("b04")),
    })
    inside = px.pixels_in_polygons(products, accepted, parcel_id, ["ndvi", "evi", "savi"])
    stats = px.band_stats(px.long_bands(inside, [parcel_id], ["ndvi", "evi", "savi"]), [parcel_id, "band"])
    return products, stats


def lidar_products(tiles_pixels: DataFrame, parcels: DataFrame, box, cell_size: float, parcel_id: str = "gid"):
    """(mosaic with slope and aspect, terrain statistics per parcel) from overlapping elevation tiles.

    ``tiles_pixels``: tile_id, row, col, x, y, value.
    """
    clipped = px.clip_pixels(tiles_pixels, box)
    merged = px.mosaic(clipped, "tile_id", keys=("row", "col", "x", "y")).withColumn("raster_id", F.lit("mosaic"))
    graded = px.terrain(merged, cell_size).withColumn("pixel_id", F.struct("row", "col"))
    inside = px.pixels_in_polygons(graded, parcels, parcel_id, ["value", "slope_pct", "aspect_deg"])
    stats = inside.groupBy(parcel_id).agg(
        *px.stats_of(F.col("value"), "elevation_"), *px.slope_stats(F.col("slope_pct")),
        px.circular_mean(F.col("aspect_deg")).alias("aspect_mean"))
    return graded, stats


def bare_soil_features(fields: DataFrame, pixels: DataFrame, scenes: DataFrame, year: int, samples: DataFrame, soils: DataFrame,
                       static: DataFrame | None = None, field_id: str = "FIELD_ID") -> DataFrame:
    """Feature rows (field, image) for the model, with the field's sample statistics."""
    chosen = px.scene_filter(scenes, year).select("scene_id", indices_image("t"))
    rows = pixels.join(chosen, "scene_id")
    located = spatial.spatial_join(fields, rows, field_id, "pixel_id", [], [c for c in ("Image_ID", *BANDS) if c in rows.columns])
    indexed = px.snow_mask(indices.with_indices(located))
    # written out: the plan of either is large, and both are small
    features = durable(px.field_features(indexed, field_id, "Image_ID", static))
    stats = durable(spatial.field_sample_stats(fields, samples, soils, field_id))
    labelled = features.join(stats.select(
        field_id, F.col("m").alias("mean_SOM"), F.col("sd").alias("stdDev_SOM"), F.col("n").alias("sampleCount"),
        F.concat(F.lit("["), F.array_join("types", ", "), F.lit("]")).alias("soilTypes")), field_id)
    means = [c for c in labelled.columns if c.endswith("_mean")]
    return px.complete_rows(labelled, [c for c in means if c.split("_")[0].isupper()])


BANDS = ["b02", "b03", "b04", "b08", "b11"]


def indices_image(time: str):
    from loamframe.functions.times import image_id

    return image_id(F.col(time)).alias("Image_ID")


def field_id_map(fields_stats: DataFrame, feature_stats: DataFrame, field_id: str = "gid", feature_id: str = "FIELD_ID"):
    """Feature ids paired with field ids by their sample signature, ambiguous ones resolved."""
    exact, rounded = ["n", "types"], ["m", "sd"]
    signature = lambda df: df.withColumn("types", F.array_join("types", "|"))
    candidates = spatial.match_by_signature(signature(feature_stats), signature(fields_stats), feature_id, field_id, exact, rounded)
    mapping = spatial.resolve_ambiguous(candidates, feature_id, field_id)
    return mapping.join(fields_stats.select(field_id, F.col("n").alias("sampleCount")), field_id, "left")


def mask_comparison(masked: DataFrame, unmasked: DataFrame, scenes: DataFrame, parcel: str = "parcel", value: str = "ndvi_mean"):
    """(summary per group, date summary) of masked minus unmasked index means."""
    both = masked.withColumn("cloud_mask", F.lit(True)).unionByName(unmasked.withColumn("cloud_mask", F.lit(False)))
    pairs = reports.paired_difference(both, parcel, "cloud_mask", value)
    return reports.difference_summary(pairs, scenes, parcel), reports.date_summary(pairs, scenes, parcel)

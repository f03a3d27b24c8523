"""Pixel tables: masks, statistics, composites, terrain, mosaics, zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.functions.values import finite
from loamframe.operators import quantiles, skew, spatial


# --- masks --------------------------------------------------------------------
def scl_mask(pixels: DataFrame, bands: list[str], scl: str = "scl") -> DataFrame:
    """Bands of cloud and shadow pixels become NULL (unclassified pixels stay); before scaling."""
    clear = ~F.coalesce(F.col(scl).isin(codes.CLOUD_CLASSES), F.lit(False))
    return pixels.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def snow_mask(pixels: DataFrame, ndsi: str = "NDSI", limit: float = 0.4) -> DataFrame:
    return pixels.filter(F.col(ndsi) <= limit)


def bare_soil_mask(pixels: DataFrame, field: str, image: str, bsi: str = "BSI") -> DataFrame:
    """Pixels whose bare-soil index is above the mean of their field in that image.

    The means are one combined row per (field, image); joining them back leaves a big field
    spread out, where a window would put all its pixels into one task.
    """
    means = pixels.groupBy(field, image).agg(F.avg(finite(F.col(bsi))).alias("_mean_bsi"))
    joined = skew.salted_join(pixels, means, [field, image], F.xxhash64(*pixels.columns))
    return joined.filter(finite(F.col(bsi)) > F.col("_mean_bsi")).drop("_mean_bsi")


def scene_filter(scenes: DataFrame, year: int, time: str = "t", cloud: str = "cloud_cover", max_cloud: float = 1.0) -> DataFrame:
    """Spring (April–June) and autumn (September–December) scenes of a year with little cloud."""
    month = F.month(time)
    return scenes.filter(
        (F.year(time) == year) & (month.between(4, 6) | month.between(9, 12)) & (F.col(cloud) < max_cloud))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


# --- statistics ---------------------------------------------------------------
def stats_of(value: Column, prefix: str = "") -> list[Column]:
    """min, max, mean, population deviation and count of finite values; NULL when there is none."""
    good = finite(value)
    return [
        F.min(good).alias(f"{prefix}min"), F.max(good).alias(f"{prefix}max"), F.avg(good).alias(f"{prefix}mean"),
        F.stddev_pop(good).alias(f"{prefix}std"), F.count(good).alias(f"{prefix}count"),
    ]


def band_stats(pixels: DataFrame, keys: list[str], value: str = "value", nodata: float | None = None) -> DataFrame:
    """Statistics per band; a band without valid pixels has no row."""
    good = finite(F.col(value))
    rows = pixels.filter(good.isNotNull() & ((F.col(value) != nodata) if nodata is not None else F.lit(True)))
    return rows.groupBy(*keys).agg(*stats_of(F.col(value)))


def long_bands(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return pixels.unpivot(keys, bands, "band", "value")


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, polygon_id: str, keep: list[str], pixel_id: str = "pixel_id",
                       geom: str = "geom", cell: float = spatial.FINEST_CELL) -> DataFrame:
    """Pixels whose centre is in a polygon, once per polygon."""
    return spatial.spatial_join(polygons, pixels, polygon_id, pixel_id, [], keep, geom=geom, cell=cell)


def zonal_stats(pixels: DataFrame, polygons: DataFrame, polygon_id: str, value: str = "value", nodata: float | None = None,
                pixel_id: str = "pixel_id", cell: float = spatial.FINEST_CELL) -> DataFrame:
    """Statistics of valid pixels by polygon."""
    good = pixels.filter(finite(F.col(value)).isNotNull())
    if nodata is not None:
        good = good.filter(F.col(value) != nodata)
    inside = pixels_in_polygons(good, polygons, polygon_id, [value], pixel_id, cell=cell)
    return inside.groupBy(polygon_id).agg(*stats_of(F.col(value)))


def slope_stats(percent: Column) -> list[Column]:
    """Mean slope in percent and mean of the per-pixel degrees."""
    return [
        F.avg(finite(percent)).alias("slope_mean_pct"),
        F.avg(F.degrees(F.atan(finite(percent) / 100))).alias("slope_mean_deg"),
    ]


def circular_mean(angle: Column) -> Column:
    """Mean direction in [0, 360)."""
    rad = F.radians(finite(angle))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))


def render_range(pixels: DataFrame, keys: list[str], band: str = "band", value: str = "value", rgb: str | None = None) -> DataFrame:
    """``(bidx, "min,max")`` of real values; none for empty, constant or colour rasters."""
    rows = pixels.filter(~F.col(rgb)) if rgb else pixels
    limits = rows.groupBy(*keys, band).agg(F.min(finite(F.col(value))).alias("lo"), F.max(finite(F.col(value))).alias("hi"))
    return limits.filter(F.col("lo") < F.col("hi")).select(
        *keys, F.col(band).alias("bidx"), F.concat_ws(",", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("rescale"))


def temporal_composite(pixels: DataFrame, keys: list[str], bands: list[str], method: str = "median",
                       open_groups: bool = False) -> DataFrame:
    """Reduce the time axis per pixel and band with median, max, min or mean.

    A pixel has one value per date, so ``median`` holds that many; ``open_groups`` takes
    the counting median for keys without such a bound.
    """
    functions = {"median": F.median, "max": F.max, "min": F.min, "mean": F.avg}
    if method not in functions:
        raise ValueError(f"unsupported method: {method}")
    if method == "median" and open_groups:
        long = pixels.unpivot(keys, bands, "_band", "_value")
        medians = quantiles.exact_percentiles(long, [*keys, "_band"], "_value", {"_m": 0.5})
        return medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_band") == b, F.col("_m"))).alias(b) for b in bands])
    return pixels.groupBy(*keys).agg(*[functions[method](finite(F.col(b))).alias(b) for b in bands])


# --- rasters ------------------------------------------------------------------
def clip_pixels(pixels: DataFrame, box) -> DataFrame:
    minx, miny, maxx, maxy = box
    return pixels.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))


def mosaic(pixels: DataFrame, order: str, value: str = "value", keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One value per place out of overlapping tiles: the first valid one in tile order."""
    good = pixels.filter(finite(F.col(value)).isNotNull())
    return good.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias(value))


def overview(pixels: DataFrame, factor: int, keys: list[str], value: str = "value", categorical: bool = False) -> DataFrame:
    """Reduced resolution: mean of each block, or its first pixel for classes."""
    block = {"row": F.floor(F.col("row") / factor).cast("int"), "col": F.floor(F.col("col") / factor).cast("int")}
    how = F.min_by(value, F.struct("row", "col")) if categorical else F.avg(finite(F.col(value)))
    blocks = pixels.withColumns({f"_{k}": v for k, v in block.items()})
    return blocks.groupBy(*keys, "_row", "_col").agg(how.alias(value)).withColumnsRenamed({"_row": "row", "_col": "col"})


def terrain(dem: DataFrame, cell_size: float, raster: str = "raster_id", value: str = "value") -> DataFrame:
    """Slope (percent) and compass aspect from a DEM by the 3 × 3 third-order difference.

    Two windows, along rows and then along columns, give every pixel its neighbours
    without copying it; one raster row or column is the largest group.  Border pixels
    and pixels with a missing neighbour have no result; flat ones have no aspect.
    """
    row, col, z = F.col("row"), F.col("col"), F.col(value)
    along = Window.partitionBy(raster, "row").orderBy("col")

    def side(direction, step):
        other = direction("col").over(along)
        return F.when(other == col + step, direction(value).over(along))

    strip = dem.withColumn("_s", F.struct(
        side(F.lag, -1).alias("w"), z.alias("c"), side(F.lead, 1).alias("e")))
    down = Window.partitionBy(raster, "col").orderBy("row")

    def strip_at(direction, step):
        other = direction("row").over(down)
        return F.when(other == row + step, direction("_s").over(down))

    full = strip.withColumns({"_n": strip_at(F.lag, -1), "_b": strip_at(F.lead, 1)})
    n, m, s = F.col("_n"), F.col("_s"), F.col("_b")
    dx = ((n["e"] + 2 * m["e"] + s["e"]) - (n["w"] + 2 * m["w"] + s["w"])) / (8 * cell_size)
    dy = ((s["w"] + 2 * s["c"] + s["e"]) - (n["w"] + 2 * n["c"] + n["e"])) / (8 * cell_size)
    graded = full.withColumns({"_dx": dx, "_dy": dy})
    dx, dy = F.col("_dx"), F.col("_dy")
    flat = (dx == 0) & (dy == 0)
    # downslope direction, clockwise from north (rows grow southwards)
    aspect = F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0))
    return graded.select(
        *dem.columns, (F.sqrt(dx * dx + dy * dy) * 100).alias("slope_pct"), F.when(~flat, aspect).alias("aspect_deg"))


def pixel_at(points: DataFrame, pixels: DataFrame, rasters: DataFrame, band: int = 1) -> DataFrame:
    """Raster value under each point; no data gives no row.

    ``rasters``: raster_id, x0, y0 (upper left corner), dx, dy, nodata — one row per raster.
    Points carry their raster_id.
    """
    small = F.broadcast(rasters) if skew.small(rasters) else rasters
    located = points.join(small, "raster_id").withColumns({
        "row": F.floor((F.col("y0") - F.col("y")) / F.col("dy")).cast("int"),
        "col": F.floor((F.col("x") - F.col("x0")) / F.col("dx")).cast("int"),
    }).drop("x0", "y0", "dx", "dy")
    values = pixels.filter(F.col("band") == band).select("raster_id", "row", "col", "value")
    hits = located.join(values, ["raster_id", "row", "col"])
    return hits.filter(finite(F.col("value")).isNotNull() & ~F.coalesce(F.col("value") == F.col("nodata"), F.lit(False))).drop("nodata")


# --- features and products ----------------------------------------------------
def field_features(pixels: DataFrame, field: str = "FIELD_ID", image: str = "Image_ID", static: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of the eleven indices over bare-soil pixels per field and image,
    with static terrain and climate columns joined by field."""
    bare = bare_soil_mask(pixels, field, image)
    stats = bare.groupBy(field, image).agg(*[
        f(finite(F.col(i))).alias(f"{i}_{suffix}")
        for i in codes.SPECTRAL_INDICES for f, suffix in ((F.avg, "mean"), (F.stddev_pop, "stdDev"))
    ])
    return stats if static is None else stats.join(static, field, "left")


def asset_union(old: DataFrame, new: DataFrame, item: str = "item_id", name: str = "asset", href: str = "href") -> DataFrame:
    """Assets of each item as one map; a product fetched now replaces the earlier one.

    Assets are first reduced to one per (item, name), so a map holds at most the product names.
    """
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    latest = both.groupBy(item, name).agg(F.min_by(href, F.struct("_age", href)).alias(href))
    entries = F.array_sort(F.collect_list(F.struct(name, href)))
    return latest.groupBy(item).agg(F.map_from_entries(entries).alias("assets"))

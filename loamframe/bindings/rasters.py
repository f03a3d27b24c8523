"""Pixel tables: masks, indices, statistics, composites, terrain, zones, products."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.bindings.tables import BANDS, FARMS, PARCELS, PIXELS, farms, parcels, pixels, query, read
from loamframe.functions import indices as ix
from loamframe.operators import pixels as px
from loamframe.plans import imagery
from loamframe.sources import landed

_IDX = {
    "NDVI": "(b08 - b04) / (b08 + b04)", "BSI": "((b11 + b04) - (b08 + b02)) / ((b11 + b04) + (b08 + b02))",
    "SAVI": "1.5 * (b08 - b04) / (b08 + b04 + 0.5)", "NDMI": "(b08 - b11) / (b08 + b11)", "CI": "(b04 - b03) / (b04 + b03)",
    "OMI": "1 / (b03 * b03)", "EVI": "2.5 * (b08 - b04) / nullif(b08 + 6 * b04 - 7.5 * b02 + 1, 0)", "SI": "(b04 - b02) / (b04 + b02)",
    "RI": "b04 * b04 / (b02 * b03 * b03)", "CAI": "0.5 * ((b11 - b08) - (b04 - b02))", "BI": "sqrt((b02 * b02 + b03 * b03 + b04 * b04) / 3)",
    "NDSI": "(b03 - b11) / (b03 + b11)",
}
_INDEXED = f"{PIXELS}, indexed AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _IDX.items()) + " FROM pixels)"


@query(f"WITH {_INDEXED} SELECT pixel_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in _IDX) + " FROM indexed")
def spectral_indices(spark, sf_dir):
    return ix.with_indices(pixels(spark, sf_dir)).select("pixel_id", *[F.round(k, 6).alias(k) for k in _IDX])


@query(f"WITH {PIXELS} SELECT pixel_id, b04, b03, b02 FROM pixels")
def true_color(spark, sf_dir):
    return ix.true_color(pixels(spark, sf_dir), ["pixel_id"])


@query(f"WITH {PIXELS} SELECT pixel_id, {', '.join(BANDS)} FROM pixels")
def raw_bands(spark, sf_dir):
    return ix.raw_bands(pixels(spark, sf_dir), ["pixel_id"], BANDS)


@query(f"WITH {PIXELS} SELECT pixel_id, CASE WHEN scl NOT IN (3, 8, 9, 10) THEN round(b04 * 0.0001::DOUBLE, 9) END AS b04 FROM pixels")
def scl_mask_and_scale(spark, sf_dir):
    return px.scl_mask(pixels(spark, sf_dir), ["b04"]).select("pixel_id", F.round(ix.scale_reflectance(F.col("b04")), 9).alias("b04"))


@query(f"WITH {_INDEXED} SELECT pixel_id FROM indexed WHERE NDSI <= 0.4")
def snow_mask(spark, sf_dir):
    return px.snow_mask(ix.with_indices(pixels(spark, sf_dir))).select("pixel_id")


@query(f"WITH {_INDEXED}, m AS (SELECT label, pixel_id % 2 AS image, avg(BSI) AS mean_bsi FROM indexed GROUP BY 1, 2) SELECT pixel_id FROM indexed i JOIN m ON m.label = i.label AND m.image = i.pixel_id % 2 WHERE BSI > mean_bsi")
def bare_soil_mask(spark, sf_dir):
    rows = ix.with_indices(pixels(spark, sf_dir)).withColumn("image", F.col("pixel_id") % 2)
    return px.bare_soil_mask(rows, "label", "image").select("pixel_id")


_SCENES = "scenes AS (SELECT o_orderkey AS scene_id, o_orderdate AS t, (o_orderkey % 200) / 10.0::DOUBLE AS cloud_cover FROM orders)"


def _scenes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("t"), ((F.col("o_orderkey") % 200) / F.lit(10.0)).alias("cloud_cover"))


@query(f"WITH {_SCENES} SELECT scene_id FROM scenes WHERE year(t) = 1999 AND (month(t) BETWEEN 4 AND 6 OR month(t) BETWEEN 9 AND 12) AND cloud_cover < 1")
def scene_filter(spark, sf_dir):
    return px.scene_filter(_scenes(spark, sf_dir), 1999).select("scene_id")


# line items are the pixels of a scene (order), placed by part and supplier
_CUBE = f"""{_SCENES}, cube AS (SELECT l_orderkey AS scene_id, t, CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 25 AS INTEGER) AS col, -79.7::DOUBLE + (l_suppkey % 25) * 0.95::DOUBLE AS x,
45.05::DOUBLE + (l_partkey % 40) * 0.43::DOUBLE AS y, l_quantity * 100 AS b02, l_extendedprice / 20 AS b03, l_extendedprice / 11 AS b04, l_quantity * 170 AS b08, CAST(l_linenumber + 2 AS INTEGER) AS scl
FROM lineitem JOIN scenes ON l_orderkey = scene_id)"""


def _cube(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("scene_id"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col"),
        (F.lit(-79.7) + (F.col("l_suppkey") % 25) * F.lit(0.95)).alias("x"), (F.lit(45.05) + (F.col("l_partkey") % 40) * F.lit(0.43)).alias("y"),
        (F.col("l_quantity") * 100).alias("b02"), (F.col("l_extendedprice") / 20).alias("b03"), (F.col("l_extendedprice") / 11).alias("b04"),
        (F.col("l_quantity") * 170).alias("b08"), (F.col("l_linenumber") + 2).cast("int").alias("scl"))
    return rows.join(_scenes(spark, sf_dir).select("scene_id", "t"), "scene_id")


_WHEN = "t BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'"


def _span():
    return F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-12-31").cast("timestamp_ntz")


@query(f"WITH {_CUBE} SELECT c.scene_id, count(*) AS n, round(sum(b04), 3) AS total FROM cube c JOIN scenes s USING (scene_id) WHERE c.{_WHEN} AND cloud_cover <= 12.5 AND x BETWEEN -75 AND -60 AND y BETWEEN 46 AND 60 GROUP BY 1")
def load_scenes(spark, sf_dir):
    rows = landed.load_scenes(_cube(spark, sf_dir), _scenes(spark, sf_dir), (-75, 46, -60, 60), *_span(), ["b04"], 12.5)
    return rows.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b04"), 3).alias("total"))


def _composite(method: str, sql: str):
    @query(f"WITH {_CUBE} SELECT row, col, round({sql}(b04), 4) AS b04, round({sql}(b08), 4) AS b08 FROM cube GROUP BY 1, 2", name=f"composite_{method}")
    def run(spark, sf_dir):
        out = px.temporal_composite(_cube(spark, sf_dir), ["row", "col"], ["b04", "b08"], method)
        return out.select("row", "col", F.round("b04", 4).alias("b04"), F.round("b08", 4).alias("b08"))

    return run


for _m, _s in (("median", "median"), ("max", "max"), ("min", "min"), ("mean", "avg")):
    _composite(_m, _s)


@query(f"WITH {_CUBE} SELECT row, round(median(b04), 4) AS b04, round(median(b08), 4) AS b08 FROM cube GROUP BY 1")
def composite_open_groups(spark, sf_dir):
    out = px.temporal_composite(_cube(spark, sf_dir), ["row"], ["b04", "b08"], "median", open_groups=True)
    return out.select("row", F.round("b04", 4).alias("b04"), F.round("b08", 4).alias("b08"))


_LONG = f"{PIXELS}, long AS (SELECT label, pixel_id, band, value FROM pixels UNPIVOT (value FOR band IN (b02, b03, b04)))"


@query(f"WITH {_LONG} SELECT band, min(value) AS \"min\", max(value) AS \"max\", round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std, count(*) AS \"count\" FROM long WHERE pixel_id % 7 <> 0 GROUP BY 1")
def band_stats(spark, sf_dir):
    spoiled = pixels(spark, sf_dir).withColumns({b: F.when(F.col("pixel_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col(b)) for b in ("b02", "b03", "b04")})
    stats = px.band_stats(px.long_bands(spoiled, ["pixel_id"], ["b02", "b03", "b04"]), ["band"])
    return stats.withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query(f"WITH {PIXELS}, {PARCELS} SELECT gid, round(avg(b08), 6) AS mean, round(stddev_pop(b08), 6) AS std, count(*) AS \"count\" FROM pixels JOIN parcels ON x >= minx AND x < maxx AND y >= miny AND y < maxy WHERE scl <> 4 GROUP BY 1")
def zonal_stats(spark, sf_dir):
    layer = pixels(spark, sf_dir).withColumn("value", F.when(F.col("scl") == 4, F.lit(-9999.0)).otherwise(F.col("b08")))
    stats = px.zonal_stats(layer, parcels(spark, sf_dir), "gid", nodata=-9999.0)
    return stats.select("gid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS slope_mean_pct, round(avg(degrees(atan(l_quantity / 100))), 6) AS slope_mean_deg FROM lineitem GROUP BY 1")
def slope_stats(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*px.slope_stats(F.col("l_quantity")))
    return out.select("l_suppkey", F.round("slope_mean_pct", 6).alias("slope_mean_pct"), F.round("slope_mean_deg", 6).alias("slope_mean_deg"))


@query("""WITH a AS (SELECT l_suppkey, degrees(atan2(avg(sin(radians(l_quantity * 7))), avg(cos(radians(l_quantity * 7))))) AS d FROM lineitem GROUP BY 1) SELECT l_suppkey, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS aspect FROM a""")
def circular_mean(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(px.circular_mean(F.col("l_quantity") * 7), 4).alias("aspect"))


@query("SELECT l_suppkey, CAST(l_linenumber AS INTEGER) AS bidx, CAST(min(l_quantity) AS VARCHAR) || ',' || CAST(max(l_quantity) AS VARCHAR) AS rescale FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2 HAVING min(l_quantity) < max(l_quantity)")
def render_range(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("band"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("rgb"))
    return px.render_range(rows, ["l_suppkey"], rgb="rgb")


@query(f"WITH {_CUBE} SELECT row, col, arg_min(b03, (scene_id, b03)) AS value FROM cube WHERE scl <> 5 GROUP BY 1, 2")
def mosaic(spark, sf_dir):
    tiles = _cube(spark, sf_dir).select("row", "col", F.col("scene_id").alias("tile_id"), F.when(F.col("scl") != 5, F.col("b03")).alias("value"))
    return px.mosaic(tiles, "tile_id", keys=("row", "col"))


@query(f"WITH {PIXELS} SELECT pixel_id FROM pixels WHERE x BETWEEN -75 AND -65 AND y BETWEEN 46 AND 55")
def clip_pixels(spark, sf_dir):
    return px.clip_pixels(pixels(spark, sf_dir), (-75, 46, -65, 55)).select("pixel_id")


@query(f"WITH {PIXELS} SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(avg(b03), 8) AS value FROM pixels GROUP BY 1, 2")
def overview_mean(spark, sf_dir):
    return px.overview(pixels(spark, sf_dir).withColumn("value", F.col("b03")), 4, []).withColumn("value", F.round("value", 8))


@query(f"WITH {PIXELS} SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, CAST(arg_min(label, row * 1000 + col) AS INTEGER) AS value FROM pixels GROUP BY 1, 2")
def overview_categories(spark, sf_dir):
    return px.overview(pixels(spark, sf_dir).withColumn("value", F.col("label")), 4, [], categorical=True)


@query(f"""WITH {PIXELS}, n AS (SELECT a.pixel_id, (ne.b02 + 2 * e.b02 + se.b02 - nw.b02 - 2 * w.b02 - sw.b02) / 8 AS dx, (sw.b02 + 2 * s.b02 + se.b02 - nw.b02 - 2 * n.b02 - ne.b02) / 8 AS dy FROM pixels a
LEFT JOIN pixels n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN pixels s ON s.row = a.row + 1 AND s.col = a.col LEFT JOIN pixels w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN pixels e ON e.row = a.row AND e.col = a.col + 1
LEFT JOIN pixels nw ON nw.row = a.row - 1 AND nw.col = a.col - 1 LEFT JOIN pixels ne ON ne.row = a.row - 1 AND ne.col = a.col + 1 LEFT JOIN pixels sw ON sw.row = a.row + 1 AND sw.col = a.col - 1 LEFT JOIN pixels se ON se.row = a.row + 1 AND se.col = a.col + 1)
SELECT pixel_id, round(sqrt(dx * dx + dy * dy) * 100, 4) AS slope_pct, round(CASE WHEN atan2(-dx, dy) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 3) AS aspect_deg FROM n""")
def terrain(spark, sf_dir):
    dem = pixels(spark, sf_dir).select("pixel_id", F.lit("dem").alias("raster_id"), "row", "col", F.col("b02").alias("value"))
    out = px.terrain(dem, 1.0)
    return out.select("pixel_id", F.round("slope_pct", 4).alias("slope_pct"), F.round("aspect_deg", 3).alias("aspect_deg"))


_SPOTS = f"{FARMS}, {PIXELS}, spots AS (SELECT gid, CAST(floor((62.75::DOUBLE - y) / 0.7::DOUBLE) AS INTEGER) AS row, CAST(floor((x - (-79.75)::DOUBLE) / 0.95::DOUBLE) AS INTEGER) AS col FROM farms)"


@query(f"WITH {_SPOTS} SELECT gid, b03 AS value FROM spots JOIN pixels USING (row, col) WHERE label <> 3")
def pixel_at(spark, sf_dir):
    raster = pixels(spark, sf_dir).select(F.lit("r1").alias("raster_id"), F.lit(1).alias("band"), "row", "col", F.when(F.col("label") == 3, F.lit(-1.0)).otherwise(F.col("b03")).alias("value"))
    about = spark.sql("SELECT 'r1' AS raster_id, -79.75D AS x0, 62.75D AS y0, 0.95D AS dx, 0.7D AS dy, -1.0D AS nodata")
    points = farms(spark, sf_dir).select("gid", "x", "y", F.lit("r1").alias("raster_id"))
    return px.pixel_at(points, raster, about).select("gid", "value")


@query(f"""WITH {_INDEXED}, m AS (SELECT label, pixel_id % 2 AS image, avg(BSI) AS mean_bsi FROM indexed GROUP BY 1, 2), b AS (SELECT i.*, image FROM indexed i JOIN m ON m.label = i.label AND m.image = i.pixel_id % 2 WHERE BSI > mean_bsi)
SELECT label AS "FIELD_ID", image AS "Image_ID", """ + ", ".join(f"round(avg({k}), 6) AS \"{k}_mean\", round(stddev_pop({k}), 6) AS \"{k}_stdDev\"" for k in _IDX if k != "NDSI") + " FROM b GROUP BY 1, 2")
def field_features(spark, sf_dir):
    rows = ix.with_indices(pixels(spark, sf_dir)).withColumns({"FIELD_ID": F.col("label"), "Image_ID": F.col("pixel_id") % 2})
    out = px.field_features(rows)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_stdDev"))})


@query("""WITH a AS (SELECT o_custkey AS item_id, 'p' || (o_orderkey % 4) AS asset, 'h' || o_orderkey AS href, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS age FROM orders),
l AS (SELECT item_id, asset, arg_min(href, (age, href)) AS href FROM a GROUP BY 1, 2) SELECT item_id, string_agg(asset || '=' || href, ';' ORDER BY asset) AS assets FROM l GROUP BY 1""")
def asset_union(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 4).cast("string")).alias("asset"),
                                             F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("href"), "o_orderstatus")
    merged = px.asset_union(a.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), a.filter("o_orderstatus = 'F'").drop("o_orderstatus"))
    text = F.transform(F.map_entries("assets"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("item_id", F.array_join(text, ";").alias("assets"))


@query(f"""WITH {FARMS}, {PARCELS}, u AS (SELECT p.gid AS request_id, 'mnt' AS product, 'https://t/' || f.gid || '/mnt' AS url FROM parcels p JOIN farms f ON x <= maxx AND x + 0.2::DOUBLE >= minx AND y <= maxy AND y + 0.2::DOUBLE >= miny
UNION ALL SELECT p.gid, 'ombre', 'https://t/' || f.gid || '/o' FROM parcels p JOIN farms f ON x <= maxx AND x + 0.2::DOUBLE >= minx AND y <= maxy AND y + 0.2::DOUBLE >= miny WHERE f.gid % 2 = 0)
SELECT request_id, product, url FROM u""")
def tile_index_lookup(spark, sf_dir):
    return landed.tile_index_lookup(*_tiles(spark, sf_dir)).select("request_id", "product", "url")


def _tiles(spark, sf_dir):
    """Tiles, requests and products."""
    path = lambda tail: F.concat(F.lit("https://t/"), F.col("gid").cast("string"), F.lit(tail))
    tiles = farms(spark, sf_dir).select(F.col("gid").alias("tile_id"), "minx", "miny", (F.col("x") + F.lit(0.2)).alias("maxx"), (F.col("y") + F.lit(0.2)).alias("maxy"),
                                        path("/mnt").alias("mnt"), F.when(F.col("gid") % 2 == 0, path("/o")).alias("ombre"))
    return tiles, parcels(spark, sf_dir).withColumnRenamed("gid", "request_id"), ["mnt", "ombre"]


@query(f"""WITH {FARMS}, {PARCELS} SELECT p.gid AS request_id, 'mnt' AS product, 0 AS chunk, string_agg('https://t/' || f.gid || '/mnt', ' ' ORDER BY f.gid) AS urls FROM parcels p JOIN farms f ON x <= maxx AND x + 0.2::DOUBLE >= minx AND y <= maxy AND y + 0.2::DOUBLE >= miny GROUP BY 1
UNION ALL SELECT p.gid, 'ombre', 0, string_agg('https://t/' || f.gid || '/o', ' ' ORDER BY f.gid) FROM parcels p JOIN farms f ON x <= maxx AND x + 0.2::DOUBLE >= minx AND y <= maxy AND y + 0.2::DOUBLE >= miny WHERE f.gid % 2 = 0 GROUP BY 1""")
def tile_url_lists(spark, sf_dir):
    packed = landed.tile_url_lists(*_tiles(spark, sf_dir))
    return packed.select("request_id", "product", "chunk", F.array_join("url", " ").alias("urls"))


# --- jobs ---------------------------------------------------------------------------
def _cube_wide(spark, sf_dir):
    return _cube(spark, sf_dir)


_PRODUCT = f"""WITH {_CUBE}, {PARCELS}, m AS (SELECT x, y, median(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b02 * 0.0001::DOUBLE END) AS b02, median(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b04 * 0.0001::DOUBLE END) AS b04,
median(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b08 * 0.0001::DOUBLE END) AS b08 FROM cube c JOIN scenes s USING (scene_id) WHERE c.{_WHEN} AND cloud_cover <= 15 AND x BETWEEN -80 AND -55 AND y BETWEEN 45 AND 63 GROUP BY 1, 2),
i AS (SELECT x, y, (b08 - b04) / (b08 + b04) AS ndvi, 2.5 * (b08 - b04) / nullif(b08 + 6 * b04 - 7.5 * b02 + 1, 0) AS evi, 1.5 * (b08 - b04) / (b08 + b04 + 0.5) AS savi FROM m)"""


def _products(spark, sf_dir, masked=True):
    return imagery.sentinel_products(_cube_wide(spark, sf_dir), _scenes(spark, sf_dir), parcels(spark, sf_dir), (-80, 45, -55, 63), *_span(), 15.0, masked=masked)


@query(f"{_PRODUCT} SELECT round(x, 4) AS x, round(y, 4) AS y, round(ndvi, 6) AS ndvi, round(evi, 5) AS evi, round(savi, 6) AS savi FROM i")
def sentinel_composite(spark, sf_dir):
    return _products(spark, sf_dir)[0].select(*[F.round(c, d).alias(c) for c, d in (("x", 4), ("y", 4), ("ndvi", 6), ("evi", 5), ("savi", 6))])


@query(f"""{_PRODUCT}, l AS (SELECT gid, band, value FROM (SELECT gid, ndvi, evi, savi FROM i JOIN parcels ON x >= minx AND x < maxx AND y >= miny AND y < maxy) UNPIVOT (value FOR band IN (ndvi, evi, savi)))
SELECT gid, band, round(min(value), 5) AS "min", round(max(value), 5) AS "max", round(avg(value), 5) AS mean, count(*) AS "count" FROM l GROUP BY 1, 2""")
def sentinel_parcel_stats(spark, sf_dir):
    return _products(spark, sf_dir)[1].select("gid", "band", *[F.round(c, 5).alias(c) for c in ("min", "max", "mean")], "count")


_LIDAR = f"""WITH {_CUBE}, {PARCELS}, z AS (SELECT row, col, x, y, arg_min(b03, (scene_id, b03)) AS v FROM cube GROUP BY 1, 2, 3, 4), g AS (SELECT a.x, a.y, a.v, (ne.v + 2 * e.v + se.v - nw.v - 2 * w.v - sw.v) / 240000 AS dx, (sw.v + 2 * s.v + se.v - nw.v - 2 * n.v - ne.v) / 240000 AS dy FROM z a
LEFT JOIN z n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN z s ON s.row = a.row + 1 AND s.col = a.col LEFT JOIN z w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN z e ON e.row = a.row AND e.col = a.col + 1
LEFT JOIN z nw ON nw.row = a.row - 1 AND nw.col = a.col - 1 LEFT JOIN z ne ON ne.row = a.row - 1 AND ne.col = a.col + 1 LEFT JOIN z sw ON sw.row = a.row + 1 AND sw.col = a.col - 1 LEFT JOIN z se ON se.row = a.row + 1 AND se.col = a.col + 1)"""


@query(f"{_LIDAR} SELECT gid, count(v) AS elevation_count, round(avg(v), 4) AS elevation_mean, round(avg(sqrt(dx * dx + dy * dy) * 100), 6) AS slope_mean_pct, round(avg(degrees(atan(sqrt(dx * dx + dy * dy)))), 6) AS slope_mean_deg FROM g JOIN parcels ON x >= minx AND x < maxx AND y >= miny AND y < maxy GROUP BY 1")
def lidar_parcel_stats(spark, sf_dir):
    tiles = _cube(spark, sf_dir).select(F.col("scene_id").alias("tile_id"), "row", "col", "x", "y", F.col("b03").alias("value"))
    _, stats = imagery.lidar_products(tiles, parcels(spark, sf_dir), (-180, -90, 180, 90), 30_000.0)
    return stats.select("gid", "elevation_count", F.round("elevation_mean", 4).alias("elevation_mean"), F.round("slope_mean_pct", 6).alias("slope_mean_pct"), F.round("slope_mean_deg", 6).alias("slope_mean_deg"))

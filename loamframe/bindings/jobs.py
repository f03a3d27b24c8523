"""Whole jobs, streams replayed as tables, and leftovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.bindings.soils import _box_area, coverage
from loamframe.bindings.tables import (
    DAILY, FARMS, ITEMS, OBSERVATIONS, PARCELS, SOILS, daily, farms, items, new_store, observations, parcels, pixels, query, read, soils, stations,
)
from loamframe.functions import geometry as geo, indices
from loamframe.operators import overlay, selfcross, skew, spatial, split
from loamframe.plans import imagery, ingest, parcels as pp
from loamframe.session import durable
from loamframe.sources import buckets
from loamframe.streaming import live


@query(f"""WITH {SOILS} SELECT DISTINCT soil_id AS gid, symbol, CASE WHEN description <> 'SMALL' THEN description END AS description, minx, maxy FROM soils WHERE soil_id % 10 <> 4""")
def ingest_layer(spark, sf_dir):
    """Duplicate rows, clockwise rings, null spellings and missing geometries, all put right."""
    s, k = soils(spark, sf_dir), F.col("soil_id")
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    clockwise = geo.polygon(F.array(x0, x0, x1, x1, x0), F.array(y0, y1, y1, y0, y0))
    raw = s.select(k.alias("ID"), F.col("symbol").alias("Symbol"), F.when(F.col("description") == "SMALL", F.lit("n/a")).otherwise(F.col("description")).alias("DESCR_SOL"),
                   F.when(k % 10 == 4, F.lit(None)).when(k % 3 == 0, clockwise).otherwise(F.col("geom")).alias("geom"))
    clean, _ = ingest.harmonise_layer(raw.unionByName(raw.filter("ID % 5 = 0")), "EPSG:4326", declared={"ID": "int32"})
    return clean.select("gid", "symbol", "description", "minx", "maxy")


@query(f"WITH {ITEMS} SELECT collection, id, round(minx, 6) AS minx, strftime(datetime, '%Y-%m-%d') AS day FROM items WHERE page_id % 10 <> 7 AND page_id % 4 > 0")
def ingest_raster(spark, sf_dir):
    merged, _, _ = _raster(spark, sf_dir)
    return merged.select("collection", "id", F.round("minx", 6).alias("minx"), F.date_format("datetime", "yyyy-MM-dd").alias("day"))


@query(f"WITH {ITEMS} SELECT collection AS id, count(*) AS items, round(min(minx), 6) AS minx FROM items WHERE page_id % 10 <> 7 AND page_id % 4 > 0 GROUP BY 1")
def ingest_raster_collections(spark, sf_dir):
    return _raster(spark, sf_dir)[1].select("id", "items", F.round(F.get("extent.bbox", F.lit(0)), 6).alias("minx"))


def _raster(spark, sf_dir):
    from loamframe.bindings.catalogue import _raster_meta

    i = items(spark, sf_dir)
    extra = i.select("id", "collection", F.date_format("datetime", "yyyy-MM-dd").alias("datetime"), F.create_map(F.lit("gsd"), F.lit("10")).alias("metadata"),
                     F.create_map(F.lit("sensor"), F.lit("a")).alias("tags"), F.lit(None).cast("string").alias("description"))
    meta = _raster_meta(spark, sf_dir).join(extra, "id")
    known = meta.filter("page_id % 20 = 1").select(
        "collection", "id", F.lit("2000-01-01").cast("timestamp").alias("datetime"), F.col("metadata").alias("properties"), "minx", "miny", "maxx", "maxy")
    documents = i.select(F.col("collection").alias("id")).distinct()
    return ingest.ingest_raster(meta, known, documents, {"provider": "lab"})


@query(f"""WITH {PARCELS}, {SOILS} SELECT source, water_id, minx FROM (SELECT source, minx, row_number() OVER (ORDER BY source, minx, miny, maxx, maxy) AS water_id FROM
(SELECT 'grhq_a' AS source, minx, miny, maxx, maxy FROM parcels UNION ALL SELECT 'grhq_b', minx, miny, maxx, maxy FROM soils))""")
def water_union(spark, sf_dir):
    layers = {"grhq_a": parcels(spark, sf_dir), "grhq_b": soils(spark, sf_dir), "grhq_old": soils(spark, sf_dir), "roads": soils(spark, sf_dir)}
    return ingest.water_union(layers, "grhq%", "%old").select("source", "water_id", "minx")


@query(f"""WITH {PARCELS}, {FARMS} SELECT 'parcels' AS collection, count(*) AS feature_count, 'gid' AS id_column, 'geom' AS geometry_column FROM parcels
UNION ALL SELECT 'farms', count(*), 'gid', NULL FROM farms UNION ALL SELECT 'orders', count(*), NULL, NULL FROM orders""")
def catalog_walk(spark, sf_dir):
    walked = ingest.catalog_walk({"parcels": parcels(spark, sf_dir), "farms": farms(spark, sf_dir), "orders": read(spark, sf_dir, "orders")})
    return walked.select("collection", "feature_count", "id_column", "geometry_column")


@query(f"WITH {PARCELS} SELECT gid, s_name, s_acctbal IS NOT NULL AS has_value FROM parcels WHERE gid % 2 = 0 UNION ALL SELECT gid, s_name, FALSE FROM parcels WHERE gid % 2 = 1")
def refresh_copy(spark, sf_dir):
    p = parcels(spark, sf_dir)
    store = new_store(spark)
    store.commit(store.stage_table("parcels", p.select("gid", "s_name"), ["gid"], 16))
    buckets.refresh_columns(store, "parcels", p.filter("gid % 2 = 0").select("gid", "s_acctbal"))
    return store.read("parcels").select("gid", "s_name", F.col("s_acctbal").isNotNull().alias("has_value"))


# --- overlay of other shapes, splitting, self-crossing --------------------------------
def _triangles(spark, sf_dir):
    """Right triangles inscribed in the soil boxes."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    return soils(spark, sf_dir).withColumn("geom", geo.polygon(F.array(x0, x1, x1, x0), F.array(y0, y0, y1, y0)))


@query(f"""WITH {SOILS} SELECT soil_id, round({_box_area('minx', 'miny', 'maxx', 'maxy')} / 1e6, 1) AS square_km FROM soils""")
def overlap_of_triangles(spark, sf_dir):
    """A box cut by its two triangles gives its whole area again."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    upper = geo.polygon(F.array(x0, x1, x0, x0), F.array(y0, y1, y1, y0))
    lower = geo.polygon(F.array(x0, x1, x1, x0), F.array(y0, y0, y1, y0))
    s = skew.over_all_tasks(soils(spark, sf_dir), "soil_id").withColumns({"u": upper, "l": lower})
    # over a diagonal the sphere-linear edge of both triangles is the same, so the sum is exact
    both = overlay.intersection_area(F.col("u"), F.col("geom")) + overlay.intersection_area(F.col("l"), F.col("geom"))
    return s.select("soil_id", F.round(both / 1e6, 1).alias("square_km"))


@query(f"WITH {SOILS} SELECT soil_id, CASE WHEN soil_id % 4 = 0 THEN 2 ELSE 1 END AS parts, round({_box_area('minx', 'miny', 'maxx', 'maxy')} / 1e6, 2) AS square_km FROM soils")
def split_large(spark, sf_dir):
    """Boxes with extra vertices are halved; area is kept and pieces counted."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    mid = (x0 + x1) / 2
    heavy = geo.polygon(F.array(x0, mid, x1, x1, x1, mid, x0, x0, x0), F.array(y0, y0, y0, (y0 + y1) / 2, y1, y1, y1, (y0 + y1) / 2, y0))
    s = soils(spark, sf_dir).withColumn("geom", F.when(F.col("soil_id") % 4 == 0, heavy).otherwise(F.col("geom")))
    pieces = split.split_large(s.withColumnRenamed("soil_id", "gid").select("gid", "geom"), ["gid"], max_vertices=7)
    return pieces.groupBy(F.col("split_source_gid").alias("soil_id")).agg(
        F.max("split_part").alias("parts"), F.round(F.sum(geo.area_m2(F.col("geom"))) / 1e6, 2).alias("square_km"))


@query(f"WITH {PARCELS} SELECT gid FROM parcels WHERE gid % 6 = 5")
def self_intersecting(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    bow = geo.polygon(F.array(x0, x1, x0, x1, x0), F.array(y0, y1, y1, y0, y0))
    p = parcels(spark, sf_dir).withColumn("geom", F.when(F.col("gid") % 6 == 5, bow).otherwise(F.col("geom")))
    return selfcross.self_intersecting(p, "gid", cell=0.5)


# --- compositions ---------------------------------------------------------------------
@query()
def parcel_portrait(spark, sf_dir):
    from loamframe.bindings.soils import pedo_tables

    p = parcels(spark, sf_dir)
    at = p.select("gid", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    water = farms(spark, sf_dir).select(F.col("gid").alias("water_id"), geo.point(F.col("x"), F.col("y")).alias("geom"), "minx", "miny", "maxx", "maxy")
    layers = {"ndvi": pixels(spark, sf_dir).withColumn("value", indices.ndvi(F.col("b08"), F.col("b04"))), "elevation": pixels(spark, sf_dir).withColumn("value", F.col("b02"))}
    rain = spatial.nearest_with_data(at, observations(spark, sf_dir).filter("variable = 'purchase'"), stations(spark, sf_dir), "gid", "station_id", "value")
    portrait = pp.parcel_portrait(p, pp.coverage_summary(coverage(spark, sf_dir)), pedo_tables(spark, sf_dir)[1],
                                  pp.water_distance(p, water, 100_000.0), pp.zonal_means(p, layers), rain)
    return portrait.withColumns({c: F.round(c, 4) for c, t in portrait.dtypes if t == "double"})


@query("""WITH f AS (SELECT l_suppkey AS gid, count(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT gid + 5 AS "FIELD_ID", gid, 'unique' AS method, n AS "sampleCount" FROM f""")
def field_id_map(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gid"), F.col("l_extendedprice").alias("som"), F.col("l_returnflag").alias("symbol"))
    # written out once: sums worked out twice may differ in the last bits and so on both sides of a rounding
    ours = durable(spatial.sample_stats(li.withColumn("quantity", F.col("som")), "gid", "som", "symbol"))
    theirs = ours.withColumn("FIELD_ID", F.col("gid") + 5).drop("gid")
    return imagery.field_id_map(ours, theirs)


def _ndvi_rows(spark, sf_dir, *flags: str):
    o = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(*flags))
    return o.groupBy(F.col("l_suppkey").alias("parcel")).agg(F.avg("l_tax").alias("ndvi_mean"))


_MASKED = "d AS (SELECT parcel, a - b AS difference FROM (SELECT l_suppkey AS parcel, avg(l_tax) FILTER (l_returnflag IN ('A', 'R')) AS a, avg(l_tax) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL)"
_DATES = "s AS (SELECT o_custkey AS parcel, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates FROM orders GROUP BY 1)"


@query(f"""WITH {_MASKED}, {_DATES}, u AS (SELECT 'all' AS part, difference FROM d UNION ALL SELECT CASE WHEN dates <= 3 THEN 'le3' ELSE 'gt3' END, difference FROM d JOIN s USING (parcel))
SELECT part, count(*) AS n_parcels, round(avg(abs(difference)), 8) AS mean_abs_diff, round(median(abs(difference)), 8) AS median_abs_diff FROM u GROUP BY 1""")
def mask_comparison(spark, sf_dir):
    dates = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parcel")).agg(F.count_distinct(F.to_date("o_orderdate")).alias("retained_dates"))
    summary, _ = imagery.mask_comparison(_ndvi_rows(spark, sf_dir, "A", "R"), _ndvi_rows(spark, sf_dir, "N"), dates)
    return summary.select("part", "n_parcels", F.round("mean_abs_diff", 8).alias("mean_abs_diff"), F.round("median_abs_diff", 8).alias("median_abs_diff"))


@query()
def bare_soil_features(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    wide = parcels(spark, sf_dir).select(F.col("gid").alias("FIELD_ID"), geo.rectangle(x0 - 1.5, y0 - 1.5, x1 + 1.5, y1 + 1.5).alias("geom"))
    fields = geo.with_bounds(wide)
    day = F.date_add(F.lit("1999-05-01").cast("date"), (F.col("scene_id") % 2).cast("int"))
    keyed = pixels(spark, sf_dir).withColumn("scene_id", F.col("pixel_id"))
    scenes = keyed.select("scene_id", day.alias("t"), F.lit(0.5).alias("cloud_cover"))
    samples = farms(spark, sf_dir).select(F.col("gid").alias("pid"), F.col("c_acctbal").alias("som"), "x", "y")
    zones = soils(spark, sf_dir).select("soil_id", "symbol", "geom", "minx", "miny", "maxx", "maxy")
    out = imagery.bare_soil_features(fields, keyed, scenes, 1999, samples, zones)
    return out.select("FIELD_ID", "Image_ID", F.round("NDVI_mean", 6).alias("NDVI_mean"), "sampleCount", "soilTypes")


# --- streams on a finished table ---------------------------------------------------------
@query(f"""WITH {OBSERVATIONS}, u AS (SELECT station_id, time, any_value(value) AS value FROM observations GROUP BY 1, 2)
SELECT strftime(date_trunc('day', time), '%Y-%m-%d') AS day, station_id, count(value) AS n, round(sum(value), 4) AS total FROM u GROUP BY 1, 2""")
def daily_station_windows(spark, sf_dir):
    out = live.stream_station_series(observations(spark, sf_dir), "station_id", "time", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "station_id", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {DAILY}, w AS (SELECT *, CAST(floor(epoch(CAST(time AS TIMESTAMP)) / (30 * 86400)) AS BIGINT) AS k FROM daily) SELECT station_id, k, count(*) FILTER (tasmin < 0) AS frost_days, count(*) FILTER (tasmax > 30) AS heat_stress_days,
count(*) FILTER (pr > 1) AS pr_days FROM w GROUP BY 1, 2""")
def indicator_windows(spark, sf_dir):
    out = live.stream_indicators(daily(spark, sf_dir), "station_id")
    return out.select("station_id", F.floor(F.unix_timestamp("start") / (30 * 86400)).cast("bigint").alias("k"), "frost_days", "heat_stress_days", "pr_days")

"""Catalogue items, metadata, and operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe import codes
from loamframe.bindings.tables import ITEMS, items, new_store, query, read
from loamframe.functions import values
from loamframe.operators import catalog as cat, reports
from loamframe.sources import buckets, landed


@query(f"""WITH {ITEMS} SELECT id, strftime(datetime, '%Y-%m-%d') AS day FROM items WHERE collection IN ('set_1', 'set_2', 'set_3') AND minx <= -60 AND maxx >= -76 AND miny <= 58 AND maxy >= 46
AND datetime >= TIMESTAMP '2019-06-01' AND datetime <= TIMESTAMP '2023-12-31' AND cloud < 70 ORDER BY datetime DESC, id LIMIT 40""")
def catalog_search(spark, sf_dir):
    hits = cat.catalog_search(items(spark, sf_dir), ["set_1", "set_2", "set_3"], (-76, 46, -60, 58), "2019-06-01", "2023-12-31", "cloud < 70", 40)
    return hits.select("id", F.date_format("datetime", "yyyy-MM-dd").alias("day"))


@query("""WITH i AS (SELECT 'item_' || o_orderkey AS id, o_custkey % 50 AS k, o_orderkey % 2 = 0 AS masked, CASE WHEN o_orderkey % 3 = 0 THEN 'ndvi' ELSE 'evi' END AS asset FROM orders)
SELECT c_custkey AS request_id, min(i.id) AS id FROM customer c JOIN i ON i.k = c.c_custkey % 50 AND i.masked = (c.c_custkey % 2 = 0) AND i.asset = 'ndvi' GROUP BY 1""")
def cached_item(spark, sf_dir):
    def box(k, wobble):
        return {"minx": F.lit(-75.0) + (k % 50) * 0.01 + wobble, "miny": F.lit(45.0) + wobble, "maxx": F.lit(-74.0) + (k % 50) * 0.01, "maxy": F.lit(46.0) + wobble}

    fixed = {"version": F.lit("v2"), "start": F.lit("2024-05-01"), "end": F.lit("2024-06-01")}
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    known = o.withColumns({**box(F.col("o_custkey"), 0.00001), **fixed, "masked": F.col("o_orderkey") % 2 == 0,
                           "id": F.concat(F.lit("item_"), F.col("o_orderkey").cast("string")),
                           "assets": F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("ndvi"))).otherwise(F.array(F.lit("evi")))})
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))
    asked = c.withColumns({**box(F.col("request_id"), 0.00002), **fixed, "masked": F.col("request_id") % 2 == 0, "asset": F.lit("ndvi")})
    return cat.cached_item(known, asked)


def _match(spark, sf_dir):
    i = items(spark, sf_dir).select(F.when(F.col("page_id") % 2 == 0, F.lit("vector")).otherwise(F.lit("raster")).alias("api"), "id")
    patterns = spark.sql("SELECT * FROM VALUES ('tens', 'vector', '^item_\\\\d0$'), ('ones', 'raster', '1$'), ('ones', 'vector', '2$') AS t(block, api, pattern)")
    excludes = spark.sql("SELECT * FROM VALUES ('raster', '^item_9') AS t(api, pattern)")
    return cat.match_catalog(i, patterns, excludes)


_API = f"{ITEMS}, r AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'vector' ELSE 'raster' END AS api, id FROM items), m AS (SELECT CASE WHEN api = 'vector' AND regexp_matches(id, '^item_\\d0$') THEN 'tens' WHEN (api = 'raster' AND regexp_matches(id, '1$')) OR (api = 'vector' AND regexp_matches(id, '2$')) THEN 'ones' END AS block, api, id FROM r)"


@query(f"WITH {_API} SELECT block, api, id FROM m WHERE block IS NOT NULL")
def match_catalog(spark, sf_dir):
    return _match(spark, sf_dir)[0]


@query(f"WITH {_API} SELECT api, id FROM m WHERE block IS NULL AND NOT (api = 'raster' AND id LIKE 'item_9%')")
def unmatched_records(spark, sf_dir):
    return _match(spark, sf_dir)[1]


@query("""SELECT o_custkey % 100 AS block, CASE WHEN min(y) = max(y) THEN CAST(min(y) AS VARCHAR) ELSE CAST(min(y) AS VARCHAR) || '–' || CAST(max(y) AS VARCHAR) END AS years FROM
(SELECT o_custkey, year(o_orderdate) AS y FROM orders UNION ALL SELECT o_custkey, 1990 + o_custkey % 100 FROM orders WHERE o_custkey % 100 < 10) GROUP BY 1""")
def year_span(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    extra = F.when(F.col("o_custkey") % 100 < 10, 1990 + F.col("o_custkey") % 100)
    rows = o.select((F.col("o_custkey") % 100).alias("block"), F.concat(F.lit("crops_"), F.year("o_orderdate").cast("string"), F.lit("_v1")).alias("id"), extra.alias("start"))
    return cat.year_span(rows, "block", "id", "start")


@query(f"WITH {ITEMS} SELECT collection, strftime(min(datetime), '%Y-%m-%d') AS \"start\", strftime(max(datetime), '%Y-%m-%d') AS \"end\" FROM items GROUP BY 1")
def temporal_extent(spark, sf_dir):
    found = cat.temporal_extent(items(spark, sf_dir), ["collection"])
    return found.select("collection", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start", "end")])


@query(f"WITH {ITEMS} SELECT collection AS id, 'Set ' || collection[5:] AS title, min(minx) AS minx, max(maxy) AS maxy, strftime(min(datetime), '%Y-%m-%d') AS \"start\", count(*) AS items FROM items GROUP BY collection")
def collection_document(spark, sf_dir):
    docs = cat.collection_document(items(spark, sf_dir))
    return docs.select("id", "title", F.get("extent.bbox", F.lit(0)).alias("minx"), F.get("extent.bbox", F.lit(3)).alias("maxy"),
                       F.date_format(F.get("extent.interval", F.lit(0)), "yyyy-MM-dd").alias("start"), "items")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'nan' WHEN l_quantity < 20 THEN 'inf' ELSE CAST(l_quantity AS VARCHAR) END AS nodata, count(*) AS n FROM lineitem GROUP BY ALL")
def nodata_text(spark, sf_dir):
    q = F.col("l_quantity")
    value = F.when(q < 10, F.lit(float("nan"))).when(q < 20, F.lit(float("inf"))).otherwise(q)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", values.nodata_text(value).alias("nodata")).agg(F.count(F.lit(1)).alias("n"))


def _raster_meta(spark, sf_dir):
    i = items(spark, sf_dir)
    return i.select(
        "id", "page_id", F.when(F.col("page_id") % 10 != 7, F.lit("EPSG:4326")).alias("crs"), "minx", "miny", "maxx", "maxy",
        F.lit(110).alias("width"), F.lit(110).alias("height"), (F.col("page_id") % 4).cast("int").alias("n_bands"),
        F.array(F.struct(F.lit("b1").alias("name"), F.lit("float32").alias("dtype"), F.lit(float("nan")).alias("nodata"))).alias("bands"), F.col("url").alias("file_url"))


@query(f"WITH {ITEMS} SELECT id, 'Polygon' AS kind FROM items WHERE page_id % 10 <> 7 AND page_id % 4 > 0")
def raster_catalog(spark, sf_dir):
    return landed.raster_catalog(_raster_meta(spark, sf_dir))[0].select("id", F.initcap("geom.kind").alias("kind"))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN page_id % 10 = 7 THEN 'no coordinate system' ELSE 'no bands' END AS reason FROM items WHERE page_id % 10 = 7 OR page_id % 4 = 0")
def raster_catalog_skipped(spark, sf_dir):
    return landed.raster_catalog(_raster_meta(spark, sf_dir))[1].select("id", "reason")


@query(f"WITH {ITEMS} SELECT id, 'Feature' AS type, 4326 AS epsg, round(minx, 6) AS minx, round(maxy, 6) AS maxy, 0.01::DOUBLE AS step, url AS href, 'nan' AS nodata FROM items WHERE page_id % 10 <> 7")
def item_struct(spark, sf_dir):
    built = cat.to_item_struct(_raster_meta(spark, sf_dir).filter("crs is not null")).select("id", "item.type", "item.proj", "item.bbox", "item.assets")
    data = F.col("assets")["data"]
    return built.select("id", "type", "proj.epsg", F.round(F.get("bbox", F.lit(0)), 6).alias("minx"), F.round(F.get("bbox", F.lit(3)), 6).alias("maxy"),
                        F.round(F.get("proj.transform", F.lit(0)), 9).alias("step"), data["href"].alias("href"), F.get(data["bands"], F.lit(0))["nodata"].alias("nodata"))


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN page_id % 3 = 0 THEN '2022-03-04' WHEN page_id % 3 = 1 THEN strftime(datetime, '%Y-%m-%d') ELSE '1950-01-01' END AS day,
CASE WHEN page_id % 2 = 0 THEN 'late' ELSE 'early' END AS gsd, 'lab' AS provider, id AS title, page_id % 5 = 0 AS has_description FROM items""")
def item_properties(spark, sf_dir):
    i, k = items(spark, sf_dir), F.col("page_id")
    day = F.date_format("datetime", "yyyy-MM-dd")
    meta = F.when(k % 3 == 1, F.create_map(F.lit("acq_date"), day, F.lit("gsd"), F.lit("early"))).otherwise(F.create_map(F.lit("gsd"), F.lit("early"), F.lit("void"), F.lit(None).cast("string")))
    tags = F.when(k % 2 == 0, F.create_map(F.lit("gsd"), F.lit("late")))
    rows = i.select("id", F.when(k % 3 == 0, F.lit("2022-03-04T10:00:00Z")).alias("datetime"), meta.alias("metadata"), tags.alias("tags"), F.lit("plain.tif").alias("file_url"),
                    F.when(k % 5 == 0, F.lit("a map")).alias("description"))
    out = cat.item_properties(rows, {"provider": "lab", "gsd": "unset"})
    return out.select("id", F.date_format("datetime", "yyyy-MM-dd").alias("day"), F.col("properties")["gsd"].alias("gsd"), F.col("properties")["provider"].alias("provider"),
                      F.col("properties")["title"].alias("title"), F.map_contains_key("properties", "description").alias("has_description"))


def _metas(spark, sf_dir):
    k = F.col("page_id")
    four = F.array(*[F.col(c).cast("string") for c in ("minx", "miny", "maxx", "maxy")])
    box = F.when(k % 5 == 1, F.slice(four, 1, 3)).when(k % 5 == 2, F.array(F.lit("west"), F.lit("1"), F.lit("2"), F.lit("3"))).otherwise(four)
    return items(spark, sf_dir).select(F.when(k % 5 != 3, k).alias("gid"), box.alias("bbox"), F.when(k % 5 != 4, F.col("url")).alias("file_url"), k.alias("page_id"))


@query(f"WITH {ITEMS} SELECT page_id, CAST(page_id AS VARCHAR) AS gid, minx FROM items WHERE page_id % 5 = 0")
def normalize_meta(spark, sf_dir):
    return cat.normalize_meta(_metas(spark, sf_dir))[0].select("page_id", "gid", F.get("bbox", F.lit(0)).alias("minx"))


@query(f"WITH {ITEMS} SELECT page_id, (['', 'bbox needs four values', 'bbox value is no number', 'gid missing', 'file_url missing'])[1 + page_id % 5] AS reasons FROM items WHERE page_id % 5 > 0")
def rejected_meta(spark, sf_dir):
    return cat.normalize_meta(_metas(spark, sf_dir))[1].select("page_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"WITH {ITEMS} SELECT CASE WHEN page_id % 6 = 1 THEN 'batch_' || page_id ELSE id END AS id, concat_ws(';', CASE WHEN page_id % 6 = 2 THEN 'type must be Feature' END, CASE WHEN page_id % 6 = 3 THEN 'datetime missing' END, CASE WHEN page_id % 6 = 4 THEN 'assets missing' END) AS reasons FROM items")
def validate_items(spark, sf_dir):
    k = F.col("page_id")
    rows = items(spark, sf_dir).select(
        F.lit("batch").alias("source"), k.alias("index"), F.when(k % 6 != 1, F.col("id")).alias("id"), F.when(k % 6 != 2, F.lit("Feature")).alias("type"),
        F.array("minx", "miny", "maxx", "maxy").alias("bbox"), F.lit(True).alias("has_geometry"), F.when(k % 6 != 3, F.col("datetime")).alias("datetime"),
        F.when(k % 6 != 4, F.create_map(F.lit("data"), F.col("url"))).alias("assets"))
    good, bad = cat.validate_items(rows)
    return good.select("id", F.lit("").alias("reasons")).unionByName(bad.select("id", F.array_join("reasons", ";").alias("reasons")))


@query(f"WITH {ITEMS} SELECT id, collection FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY id) AS rn FROM items) WHERE rn = 1")
def first_items(spark, sf_dir):
    return cat.first_items(items(spark, sf_dir)).select("id", "collection")


@query(f"WITH {ITEMS} SELECT collection, id, cloud + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS cloud FROM items")
def publish_catalog(spark, sf_dir):
    i = items(spark, sf_dir).select("collection", "id", "cloud", "page_id")
    newer = i.filter("page_id % 3 = 0").withColumn("cloud", F.col("cloud") + 1)
    cols = i.select(F.col("collection").alias("id")).distinct()
    store = new_store(spark)
    buckets.publish_catalog(store, i, cols, buckets=16)
    buckets.publish_catalog(store, newer, cols)
    return store.read("items").select("collection", "id", "cloud")


@query(f"WITH {ITEMS} SELECT id, CAST(b AS INTEGER) AS band, CASE WHEN b <= page_id % 3 THEN 'layer ' || b ELSE 'band_' || b END AS description FROM items, generate_series(1, 3) t(b)")
def band_descriptions(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda b: F.when(b <= F.col("page_id") % 3, F.concat(
        F.lit("<PAMRasterBand><Description>layer "), b.cast("string"), F.lit("</Description></PAMRasterBand>"))).otherwise(F.lit("<PAMRasterBand/>")))
    xml = items(spark, sf_dir).select("id", F.concat(F.lit("<PAMDataset>"), F.array_join(names, ""), F.lit("</PAMDataset>")).alias("xml"), F.lit(3).alias("n_bands"))
    return landed.band_descriptions(xml).select("id", "band", "description")


# --- reports ------------------------------------------------------------------------
@query("""SELECT coalesce(event_type, 'all') AS event_type, count(*) FILTER (s = 'processed') AS processed, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'skipped') AS skipped FROM
(SELECT event_type, (['processed', 'error', 'skipped'])[1 + event_id % 3] AS s FROM events) GROUP BY ROLLUP (event_type)""")
def run_report(spark, sf_dir):
    status = F.element_at(F.array(F.lit("processed"), F.lit("error"), F.lit("skipped")), (F.col("event_id") % 3 + 1).cast("int"))
    return reports.run_report(read(spark, sf_dir, "events").withColumn("status", status), "event_type", "status", ["processed", "error", "skipped"])


@query("""WITH g AS (SELECT user_id AS label, value FROM events WHERE event_type <> 'error') SELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd,
min(value) AS "min", max(value) AS "max", round(median(value), 6) AS median, round(avg(value) - (CASE WHEN count(*) >= 30 THEN 1.96::DOUBLE """ + " ".join(f"WHEN count(*) = {d + 1} THEN {t}::DOUBLE" for d, t in codes.STUDENT_T_975.items())
+ """ ELSE 0 END) * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci_low FROM g GROUP BY 1""")
def latency_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "label")
    out = reports.latency_summary(e, "label", "value", F.col("event_type") != "error")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "min", "max", F.round("median", 6).alias("median"), F.round("ci_low", 6).alias("ci_low"))


@query("""SELECT o_custkey AS parcel, count(*) FILTER (cloud <= 40) AS retained_items, count(DISTINCT d) FILTER (cloud <= 40) AS retained_dates, count(DISTINCT d) AS all_dates, round(median(cloud) FILTER (cloud <= 40), 1) AS median_cloud_cover_retained,
string_agg(DISTINCT tile, ' ' ORDER BY tile) AS tiles FROM (SELECT o_custkey, (o_orderkey % 100)::DOUBLE AS cloud, CAST(o_orderdate AS DATE) AS d, 'T' || (o_orderkey % 5) AS tile FROM orders) GROUP BY 1""")
def scene_counts(spark, sf_dir):
    return _scene_counts(spark, sf_dir)


def _scene_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parcel"), F.col("o_orderdate").alias("t"), (F.col("o_orderkey") % 100).cast("double").alias("cloud"),
                                             F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string")).alias("tile"))
    return reports.scene_counts(o, "parcel", "t", "cloud", "tile", 40)


_PAIRED = """p AS (SELECT l_suppkey AS parcel, max(l_tax * l_quantity) FILTER (l_returnflag <> 'N') AS with_flag, max(l_discount * l_quantity) FILTER (l_returnflag = 'N') AS without_flag FROM lineitem WHERE NOT (l_suppkey % 9 = 0 AND l_returnflag <> 'N') GROUP BY 1),
d AS (SELECT *, with_flag - without_flag AS difference FROM p WHERE with_flag IS NOT NULL AND without_flag IS NOT NULL)"""


def _paired(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    masked = F.col("l_returnflag") != "N"
    value = F.when(masked, F.when(F.col("l_suppkey") % 9 != 0, F.col("l_tax") * F.col("l_quantity")).otherwise(F.lit(float("nan")))).otherwise(F.col("l_discount") * F.col("l_quantity"))
    return reports.paired_difference(li.select(F.col("l_suppkey").alias("parcel"), masked.alias("cloud_mask"), value.alias("v")), "parcel", "cloud_mask", "v")


@query(f"WITH {_PAIRED} SELECT parcel, with_flag, without_flag, round(difference, 9) AS difference FROM d")
def paired_difference(spark, sf_dir):
    return _paired(spark, sf_dir).withColumn("difference", F.round("difference", 9))


_DATES = "s AS (SELECT o_custkey AS parcel, count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 100 <= 40) AS dates FROM orders GROUP BY 1)"


@query(f"""WITH {_PAIRED}, {_DATES}, u AS (SELECT 'all' AS part, difference FROM d UNION ALL SELECT CASE WHEN dates <= 3 THEN 'le3' ELSE 'gt3' END, difference FROM d JOIN s USING (parcel))
SELECT part, count(*) AS n_parcels, round(avg(difference), 8) AS mean_diff, round(avg(abs(difference)), 8) AS mean_abs_diff, round(max(abs(difference)), 8) AS max_abs_diff, round(median(abs(difference)), 8) AS median_abs_diff FROM u GROUP BY 1""")
def difference_summary(spark, sf_dir):
    out = reports.difference_summary(_paired(spark, sf_dir), _scene_counts(spark, sf_dir), "parcel")
    return out.select("part", "n_parcels", *[F.round(c, 8).alias(c) for c in ("mean_diff", "mean_abs_diff", "max_abs_diff", "median_abs_diff")])


@query(f"WITH {_PAIRED}, {_DATES} SELECT min(dates) AS dates_min, max(dates) AS dates_max, median(dates) AS dates_median FROM s JOIN d USING (parcel)")
def date_summary(spark, sf_dir):
    return reports.date_summary(_paired(spark, sf_dir), _scene_counts(spark, sf_dir), "parcel")



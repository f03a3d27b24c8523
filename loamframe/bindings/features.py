"""Feature queries: boxes, ids, paging, counts, extents, profiles, tiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loamframe.bindings.tables import FARMS, PARCELS, SOILS, farms, parcels, query, read, soils
from loamframe.operators import harmonize, keys, query as q
from loamframe.sources import files, writers

BOX = (-75.0, 46.0, -64.0, 56.0)
IN_BOX = "x <= -64.0 AND x >= -75.0 AND y <= 56.0 AND y >= 46.0"


@query(f"""WITH {FARMS} SELECT c_mktsegment, count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
FROM farms WHERE {IN_BOX} GROUP BY 1 ORDER BY 1 LIMIT 10""")
def farms_in_box(spark, sf_dir):
    inside = q.bbox_filter(farms(spark, sf_dir), BOX)
    counts = inside.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return q.page(counts.join(q.extent(inside, ["c_mktsegment"]), "c_mktsegment"), ["c_mktsegment"], 10)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def read_collection(spark, sf_dir):
    return files.read_collection(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


@query("""SELECT c_nationkey IS NOT NULL AS from_first, s_nationkey IS NOT NULL AS from_second, count(*) AS n FROM
(SELECT c_nationkey, NULL AS s_nationkey FROM customer UNION ALL SELECT NULL, s_nationkey FROM supplier) GROUP BY 1, 2""")
def union_by_name(spark, sf_dir):
    both = files.read_union_by_name(spark, f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet")
    return both.groupBy(F.col("c_nationkey").isNotNull().alias("from_first"), F.col("s_nationkey").isNotNull().alias("from_second")).agg(
        F.count(F.lit(1)).alias("n"))


@query(f"WITH {FARMS} SELECT gid, x, y FROM farms WHERE {IN_BOX}")
def bbox_filter(spark, sf_dir):
    return q.bbox_filter(farms(spark, sf_dir), BOX).select("gid", "x", "y")


@query(f"WITH {PARCELS} SELECT gid FROM parcels WHERE minx <= -64.0 AND maxx >= -75.0 AND miny <= 56.0 AND maxy >= 46.0")
def bbox_filter_exact(spark, sf_dir):
    return q.bbox_filter(parcels(spark, sf_dir), BOX, geom="geom").select("gid")


@query(f"WITH {FARMS} SELECT count(*) AS number_matched FROM farms WHERE {IN_BOX}")
def number_matched(spark, sf_dir):
    return q.number_matched(q.bbox_filter(farms(spark, sf_dir), BOX))


@query(f"WITH {FARMS} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM farms")
def layer_extent(spark, sf_dir):
    return q.extent(farms(spark, sf_dir))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def item_by_id(spark, sf_dir):
    return q.item_by_id(read(spark, sf_dir, "customer"), 77, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name, n_nationkey) AS rn FROM nation) WHERE rn = 5")
def item_by_row_number(spark, sf_dir):
    return q.item_by_id(read(spark, sf_dir, "nation"), 5, None, ["n_name", "n_nationkey"]).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 200")
def feature_page(spark, sf_dir):
    return q.page(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 100, 200).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first_page(spark, sf_dir):
    newest = q.page(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 50, descending=True)
    return newest.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_custkey, o_orderkey LIMIT 500
OFFSET 1200""")
def deep_page(spark, sf_dir):
    deep = q.page_by_key(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 500, 1200)
    return deep.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 500)
ORDER BY o_custkey, o_orderkey LIMIT 100""")
def page_after_key(spark, sf_dir):
    return q.page_after(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], (40, 500), 100).select("o_orderkey", "o_custkey")


@query("""WITH page AS (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 200 OFFSET 100), run AS
(SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running_size FROM page), kept AS (SELECT * FROM run WHERE running_size <= 60000)
SELECT doc_id, n_chars, CAST(running_size AS BIGINT) AS running_size, (SELECT count(*) FROM kept) + 100 AS next_offset FROM kept""")
def page_within_budget(spark, sf_dir):
    page = q.page(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 200, 100)
    return q.page_within_budget(page, ["doc_id"], "n_chars", 60_000, 100)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus IN ('F','P')
AND NOT (o_orderpriority LIKE '1%') AND o_custkey IS NOT NULL""")
def attribute_filter(spark, sf_dir):
    text = ("o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus IN ('F','P') AND NOT (o_orderpriority LIKE '1%') "
            "AND o_custkey IS NOT NULL")
    return q.attribute_filter(read(spark, sf_dir, "orders"), text).select("o_orderkey", "o_totalprice")


@query(f"""WITH {PARCELS} SELECT 'parcels' AS collection, 'gid' AS id_column, 'geom' AS geometry_column, count(*) AS feature_count,
min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, 'number' AS acctbal_type, 'string' AS name_type FROM parcels""")
def collection_profile(spark, sf_dir):
    p = q.profile(parcels(spark, sf_dir), "parcels")
    return p.select("collection", "id_column", "geometry_column", "feature_count", "minx", "miny", "maxx", "maxy",
                    p.property_types["s_acctbal"].alias("acctbal_type"), p.property_types["s_name"].alias("name_type"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3, 5, 7)")
def in_list_short(spark, sf_dir):
    return harmonize.in_list(read(spark, sf_dir, "customer"), "c_nationkey", [1, 3, 5, 7]).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def in_list_table(spark, sf_dir):
    small = read(spark, sf_dir, "part").filter("p_size < 5").select("p_partkey")
    return harmonize.in_list(read(spark, sf_dir, "lineitem"), "l_partkey", small).select("l_orderkey", "l_linenumber", "l_extendedprice")


_N = 2**6


@query(f"""WITH {FARMS}, t AS (SELECT gid, 6 AS z, CAST(floor((x + 180.0) / 360.0 * {_N}) AS BIGINT) AS tx,
CAST(floor((1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / {math.pi!r}) / 2 * {_N}) AS BIGINT) AS ty FROM farms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY z, tx, ty ORDER BY gid) AS INTEGER) AS tile_rank FROM t)
SELECT gid, z, tx, ty, tile_rank FROM r WHERE tile_rank <= 20""")
def tile_limit(spark, sf_dir):
    tiled = q.tile_limit(farms(spark, sf_dir), 6, ["gid"], limit=20)
    return tiled.select("gid", "z", "tx", "ty", "tile_rank")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR o_orderdate >= DATE '2001-08-01' - 365")
def purge_old(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").withColumn("finished", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date")))
    return keys.purge(runs, "finished", F.lit("2001-08-01").cast("date"), 365).select("o_orderkey", "o_orderstatus")


@query(f"""WITH {PARCELS} SELECT gid, '{{"type":"Polygon","coordinates":[[[' || minx || ',' || miny || '],[' || maxx || ',' || miny || '],[' || maxx
|| ',' || maxy || '],[' || minx || ',' || maxy || '],[' || minx || ',' || miny || ']]]}}' AS geometry,
'{{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}}' AS properties FROM parcels""")
def feature_json(spark, sf_dir):
    rows = parcels(spark, sf_dir).drop("s_acctbal")
    out = writers.to_feature_json(rows.select("gid", "s_name", "s_nationkey", "geom"), "gid")
    return out.select("gid", F.get_json_object("feature", "$.geometry").alias("geometry"),
                      F.regexp_replace(F.get_json_object("feature", "$.properties"), '"gid":[0-9]+,', "").alias("properties"))


@query(f"""WITH {SOILS} SELECT soil_id, minx, miny, CAST(floor(minx / 0.5) AS BIGINT) AS cx, CAST(floor(miny / 0.5) AS BIGINT) AS cy FROM soils""")
def spatial_layout_key(spark, sf_dir):
    return writers.with_layout_key(soils(spark, sf_dir)).select("soil_id", "minx", "miny", "cx", "cy")

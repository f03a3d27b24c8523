"""Harmonising, keys, and text, date and value functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.bindings.tables import FARMS, PARCELS, SOILS, farms, new_store, parcels, query, read, soils
from loamframe.functions import geometry as geo, text, times, values
from loamframe.operators import encoding, harmonize, keys
from loamframe.sources import buckets, files, writers

# --- sources -------------------------------------------------------------------
_EXT = ["GeoJSON", "csv", "TIF", "parquet", "txt", "shp"]
_PATH_SQL = """SELECT page_id, '/landing/' || CASE WHEN page_id % 40 = 0 THEN 'layer_styles' WHEN page_id % 40 = 1 THEN 'reseau_agrometeo'
WHEN page_id % 40 = 2 THEN 'N_1_Net' ELSE 'set_' || (page_id % 9) END || '.' || (['GeoJSON','csv','TIF','parquet','txt','shp'])[1 + page_id % 6] AS path FROM pages"""


@query(f"""WITH f AS ({_PATH_SQL}), g AS (SELECT page_id, path, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS id,
lower(regexp_extract(path, '(\\.[^.]+)$', 1)) AS ext FROM f) SELECT page_id, path, id, CASE WHEN id = 'reseau_agrometeo' THEN 'Reseau Agrometeo' ELSE 'Set ' || id[5:] END AS title,
CASE WHEN ext='.tif' THEN 'raster' WHEN ext='.csv' THEN 'csv' WHEN ext='.parquet' THEN 'collection' ELSE 'vector' END AS kind,
CASE WHEN ext='.csv' THEN levenshtein(id, 'reseau_agrometeo') <= 3 ELSE TRUE END AS is_spatial
FROM g WHERE ext <> '.txt' AND id NOT IN ('layer_styles', 'N_1_Net')""")
def classify_files(spark, sf_dir):
    k = F.col("page_id")
    stem = (F.when(k % 40 == 0, F.lit("layer_styles")).when(k % 40 == 1, F.lit("reseau_agrometeo"))
            .when(k % 40 == 2, F.lit("N_1_Net")).otherwise(F.concat(F.lit("set_"), (k % 9).cast("string"))))
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (k % 6 + 1).cast("int"))
    listing = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/landing/"), stem, F.lit("."), ext).alias("path"))
    kinds = files.classify_files(listing.select("path").distinct())
    return listing.join(kinds, "path").select("page_id", "path", "id", "title", "kind", "is_spatial")


@query(f"""WITH {FARMS} SELECT gid, CASE WHEN gid % 7 = 0 THEN NULL ELSE x END AS x, CASE WHEN gid % 7 = 0 THEN NULL ELSE y END AS y,
'EPSG:4326' AS crs FROM farms""")
def csv_points(spark, sf_dir):
    raw = farms(spark, sf_dir).select("gid", F.col("x").cast("string").alias("LONG"),
                                      F.when(F.col("gid") % 7 == 0, F.lit("n/a")).otherwise(F.col("y").cast("string")).alias("Lat"))
    placed = files.csv_points(raw, "reseau_agrometeo")
    at = geo.centroid_vertices(F.col("geom"))
    return placed.select("gid", at["x"].alias("x"), at["y"].alias("y"), "crs")


@query(f"WITH {PARCELS} SELECT gid, 5 AS points, minx, miny, maxx, maxy FROM parcels")
def geojson_round_trip(spark, sf_dir):
    written = writers.to_feature_json(parcels(spark, sf_dir), "gid")
    parsed = written.select("gid", geo.from_geojson(F.get_json_object("feature", "$.geometry")).alias("geom"))
    return geo.with_bounds(parsed.withColumn("points", geo.num_points(F.col("geom")))).drop("geom")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n_chars, CAST(n_chars AS DOUBLE) / 2 AS half FROM documents""")
def declared_types(spark, sf_dir):
    raw = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("?")).otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
        (F.col("n_chars") / 2).cast("string").alias("half"))
    return files.apply_declared_types(raw, {"doc_id": "int32", "n_chars": "Integer:9", "half": "float32"})


# --- columns --------------------------------------------------------------------
@query("SELECT c_custkey AS gid, c_name AS nom_du_client, c_acctbal AS latitude, c_mktsegment AS description FROM customer")
def normalize_columns(spark, sf_dir):
    raw = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return harmonize.normalize_columns(raw.toDF("Identif", "Nom dù-Client", "LAT", "DESCR_SOL"))


@query("SELECT c_custkey AS gid, c_name, c_acctbal AS longitude FROM customer")
def resolve_aliases(spark, sf_dir):
    raw = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("gid"), F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").alias("lon"))
    return harmonize.resolve_aliases(raw)


@query("SELECT count(*) FILTER (c_custkey % 10 = 0) AS id__gid FROM customer WHERE c_custkey > 0")
def alias_conflicts(spark, sf_dir):
    raw = read(spark, sf_dir, "customer").filter("c_custkey > 0").select(
        F.col("c_custkey").alias("gid"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("id"))
    return harmonize.alias_conflicts(raw, [("id", "gid")])


_WORDS = ["active", "N/A", "", "na", "NULL", "n/a", "Na", "NA"]


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'active' WHEN doc_id % 8 = 4 THEN 'NULL' END AS status, lang FROM documents""")
def nullify(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return harmonize.nullify(read(spark, sf_dir, "documents").select("doc_id", status.alias("status"), "lang"))


@query(f"WITH {FARMS} SELECT gid FROM farms WHERE gid % 9 <> 0")
def drop_null_geometry(spark, sf_dir):
    geom = F.when(F.col("gid") % 9 != 0, geo.point(F.col("x"), F.col("y")))
    return harmonize.drop_null_geometry(farms(spark, sf_dir).withColumn("geom", geom)).select("gid")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 2 END AS number FROM documents")
def cast_expected(spark, sf_dir):
    raw = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise((F.col("doc_id") * 2).cast("string")).alias("number"))
    return harmonize.cast_expected(raw, {"number": "bigint", "absent": "double"})


@query(f"WITH {PARCELS} SELECT gid, s_name, minx, miny, maxx, maxy FROM parcels")
def star_except(spark, sf_dir):
    rows = parcels(spark, sf_dir).drop("s_acctbal", "s_nationkey").withColumn("blob", F.encode("s_name", "utf-8"))
    return harmonize.star_except(rows, "geom")


@query(f"""WITH {FARMS} SELECT 'layer' AS kind, count(*) AS rows, count(*) FILTER (gid % 9 = 0) AS null_geometries,
'coordinate system has no code' AS reasons FROM farms""")
def validate_layer(spark, sf_dir):
    geom = F.when(F.col("gid") % 9 != 0, geo.point(F.col("x"), F.col("y")))
    report = harmonize.validate_layer(farms(spark, sf_dir).withColumn("geom", geom), "LOCAL_CS")
    return report.withColumn("reasons", F.array_join("reasons", ";"))


@query(f"""WITH {PARCELS}, {SOILS} SELECT source, count(*) AS n, min(minx) AS minx FROM (SELECT 'water_a' AS source, minx FROM parcels
UNION ALL SELECT 'water_b', minx FROM soils) GROUP BY 1""")
def union_layers(spark, sf_dir):
    layers = {"water_a": parcels(spark, sf_dir).select("minx", "geom"), "water_b": soils(spark, sf_dir).select("minx", "geom"),
              "water_points": farms(spark, sf_dir).select("minx", geo.point(F.col("x"), F.col("y")).alias("geom"))}
    union = harmonize.union_layers(layers, "water%")
    return union.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"))


@query("SELECT lang, count(*) AS n FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY 1")
def drop_duplicate_rows(spark, sf_dir):
    return harmonize.drop_duplicate_rows(read(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"))


@query("SELECT quality, toxic, count(*) AS n FROM (SELECT * FROM labels WHERE quality = 1 UNION ALL SELECT * FROM labels WHERE toxic = 1) GROUP BY 1, 2")
def concat_training(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    both = harmonize.concat_training(rows.filter("quality = 1"), rows.filter("toxic = 1"))
    return both.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


# --- keys and references -----------------------------------------------------------
@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS gid FROM orders")
def assign_gid(spark, sf_dir):
    return keys.assign_gid(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"],
                           offset=1000).select("o_orderkey", "gid")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS number FROM part")
def number_fields(spark, sf_dir):
    return keys.number_fields(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "number")


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END AS gid FROM customer), m AS (SELECT max(gid) AS top FROM r)
SELECT c_custkey, gid FROM r WHERE gid IS NOT NULL UNION ALL
SELECT c_custkey, top + row_number() OVER (ORDER BY c_custkey) FROM r, m WHERE gid IS NULL""")
def repair_null_gid(spark, sf_dir):
    raw = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.lit("bad")).otherwise(F.col("c_custkey").cast("string")).alias("gid"))
    return keys.repair_null_gid(raw, ["c_custkey"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
FROM orders) WHERE rn = 1""")
def first_per_key(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return keys.first_per_key(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""WITH v AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT (SELECT count(*) FROM orders) AS rows, 0::BIGINT AS nulls,
(SELECT CAST(sum(n - 1) AS BIGINT) FROM v) AS duplicates, 0::BIGINT AS non_integers, 0::BIGINT AS negatives,
(SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT k FROM v WHERE n > 1 ORDER BY k LIMIT 10)) AS examples""")
def validate_key(spark, sf_dir):
    return keys.validate_key(read(spark, sf_dir, "orders"), "o_custkey").withColumn(
        "examples", F.array_join(F.transform("examples", lambda v: v.cast("string")), ","))


@query("""SELECT 'l_orderkey' AS from_column, 'o_orderkey' AS to_column, 0::BIGINT AS duplicate_targets, count(*) AS orphan_rows,
count(DISTINCT l_orderkey) AS orphan_values FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)""")
def fk_orphans(spark, sf_dir):
    return keys.fk_orphans(read(spark, sf_dir, "lineitem"), "l_orderkey", read(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 3"), "o_orderkey")


@query("SELECT d.doc_id, l.quality, l.quality IS NOT NULL AS has_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def stamp_flags(spark, sf_dir):
    return harmonize.stamp_flags(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), ["doc_id"],
                                 "quality", "has_quality")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def mapped_ids(spark, sf_dir):
    return harmonize.mapped_ids(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])[0]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_ids(spark, sf_dir):
    return harmonize.mapped_ids(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), ["doc_id"])[1]


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ids_without_data(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select("c_custkey")
    return harmonize.id_difference(asked, read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def ids_in_both(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select("c_custkey")
    return harmonize.id_intersect(asked, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_ids(spark, sf_dir):
    return harmonize.distinct_ids(read(spark, sf_dir, "lineitem"), "l_suppkey")


@query("SELECT 'props' AS \"column\", count(props) AS sampled, 'json' AS logical_type FROM events")
def infer_logical_type(spark, sf_dir):
    return harmonize.infer_logical_type(read(spark, sf_dir, "events"), "props")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 100000000, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 8 = 0""")
def upsert_rows(spark, sf_dir):
    target = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = target.filter("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    added = target.filter("c_custkey % 8 = 0").withColumns({"c_custkey": F.col("c_custkey") + 100000000, "c_acctbal": F.col("c_acctbal") + 1})
    store = new_store(spark)
    buckets.upsert_table(store, "customers", target, ["c_custkey"], buckets=16)
    buckets.upsert_table(store, "customers", changed.unionByName(added), ["c_custkey"])
    return store.read("customers")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus <> 'P')")
def append_pending(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("timeout")).alias("error"))
    store = new_store(spark)
    store.commit(store.stage_table("results", done.withColumn("run", F.lit(1)), ["o_orderkey"], 16))
    buckets.append_pending(store, "results", o.select("o_orderkey", F.lit(None).cast("string").alias("error"), F.lit(2).alias("run")))
    return store.read("results").filter("run = 2").select("o_orderkey")


# --- functions ---------------------------------------------------------------------
@query("""WITH c AS (SELECT page_id, url, trim(regexp_replace(lower(url), '[^0-9a-zA-Z_]+', '_', 'g'), '_') AS n FROM pages)
SELECT page_id, CASE WHEN length(n) > 30 THEN n[1:23] || '_' || md5(n)[1:6] ELSE n END AS name FROM c""")
def harmonize_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.harmonize_name(F.col("url"), 30).alias("name"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents")
def ascii_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, p_type || '|' || p_brand || '|' || p_name AS classes, 3 AS n FROM part")
def parse_soil_list(spark, sf_dir):
    listed = F.concat(F.lit("['"), "p_type", F.lit("', "), F.lit(" "), "p_brand", F.lit(" ,, '"), "p_name", F.lit("']"))
    parsed = read(spark, sf_dir, "part").select("p_partkey", text.parse_soil_list(listed).alias("c"))
    return parsed.select("p_partkey", F.array_join("c", "|").alias("classes"), F.size("c").alias("n"))


@query("""SELECT p_partkey, CAST(p_type='ECONOMY' AS INTEGER) AS "ECONOMY", CAST(p_type='LARGE' AS INTEGER) AS "LARGE",
CAST(p_type='MEDIUM' AS INTEGER) AS "MEDIUM", CAST(p_type='PROMO' AS INTEGER) AS "PROMO", CAST(p_type='SMALL' AS INTEGER) AS "SMALL",
CAST(p_type='STANDARD' AS INTEGER) AS "STANDARD" FROM part""")
def multi_hot(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array("p_type").alias("types"))
    return encoding.multi_hot(rows, "types", encoding.fit_classes(rows, "types")).drop("types")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:34:56'
WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y') || '-01-01 00:00:00' END AS moment FROM orders""")
def datetime_from_name(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    name = (F.when(k % 4 == 0, F.concat(F.lit("S2_"), d, F.lit("T123456_x.tif"))).when(k % 4 == 1, F.concat(F.lit("dem_"), d, F.lit("_b")))
            .when(k % 4 == 2, F.concat(F.lit("crop_an_"), F.substring(d, 1, 4), F.lit("_v2"))).otherwise(F.lit("no date here")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.datetime_from_name(name), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00'
WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS moment FROM orders""")
def to_utc(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 3 == 0, F.concat(d, F.lit("T05:00:00-05:00"))).when(k % 3 == 1, d).otherwise(F.lit("soon"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.to_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 8 WHEN 1 THEN ' 10:15:30' WHEN 3 THEN ' 18:05:00' WHEN 5 THEN ' 07:30:00' ELSE ' 00:00:00' END AS moment FROM orders""")
def to_utc_written(spark, sf_dir):
    """Dates as people and instruments write them."""
    at = lambda pattern: F.date_format("o_orderdate", pattern)
    forms = [at("yyyyMMdd"), F.concat(at("yyyyMMdd"), F.lit("T101530")), at("yyyy/M/d"), F.concat(at("MMMM d yyyy"), F.lit(", 6:05 pm")), at("d MMM yyyy"),
             F.concat(at("yyyy.MM.dd"), F.lit(" 05:30 -0200")), at("EEE, d MMM yyyy"), at("MM/dd/yyyy")]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.to_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y') || '-01-01' ELSE '1950-01-01' END AS day FROM orders""")
def datetime_from_map(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    found = F.when(k % 4 == 0, F.create_map(F.lit("note"), F.lit("2030-01-01"), F.lit("ACQ_DATE"), d)).when(
        k % 4 == 1, F.create_map(F.lit("note"), F.lit("free text"), F.lit("seen"), d)).otherwise(
        F.create_map(F.lit("note"), F.lit("none"), F.lit("seen"), F.lit("never")))
    name = F.when(k % 4 == 2, F.concat(F.lit("map_"), F.substring(d, 1, 4))).otherwise(F.lit("map"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.datetime_from_map(found, name), "yyyy-MM-dd").alias("day"))


@query("""SELECT vec_id, count(*) FILTER (abs(v) <= 0.2) AS kept, round(sum(v) FILTER (abs(v) <= 0.2), 6) AS total FROM
(SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1""")
def clean_nan(spark, sf_dir):
    spoiled = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) <= 0.2, v.cast("double")).otherwise(F.lit(float("nan"))))
    nested = read(spark, sf_dir, "embeddings").select("vec_id", F.struct(spoiled.alias("vals"), F.lit(float("inf")).alias("edge")).alias("n"))
    clean = nested.withColumn("n", values.clean_nan(F.col("n"), nested.schema["n"].dataType))
    kept = F.filter("n.vals", lambda v: v.isNotNull())
    return clean.filter("n.edge is null").select("vec_id", F.size(kept).cast("bigint").alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT n_nationkey, n_name[1:1] || lower(n_name[2:6]) || ' ' || n_nationkey AS title FROM nation")
def collection_title(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", text.title(F.col("n_name")).alias("title"))


@query(f"""WITH {PARCELS} SELECT gid, CASE WHEN gid % 3 = 0 THEN s_acctbal WHEN gid % 3 = 1 THEN s_acctbal / 10000.0::DOUBLE ELSE gid / 10000.0::DOUBLE END AS hectares FROM parcels""")
def area_hectares(spark, sf_dir):
    k = F.col("gid")
    return parcels(spark, sf_dir).select("gid", values.area_hectares(
        k.cast("double"), F.when(k % 3 == 0, F.col("s_acctbal")), square_metres=F.when(k % 3 == 1, F.col("s_acctbal"))).alias("hectares"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 2026 WHEN o_orderkey % 4 = 1 THEN 2000 + CAST(o_orderkey % 20 AS INTEGER)
WHEN o_orderkey % 4 = 2 AND year(o_orderdate) < 2000 THEN 2026 ELSE year(o_orderdate)::INTEGER END AS year FROM orders""")
def year_of(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    name = (F.when(k % 4 == 0, F.concat(F.lit("crops_2011_an_"), y)).when(k % 4 == 1, F.concat(F.lit("a20999_"), (2000 + k % 20).cast("string"), F.lit("-b")))
            .when(k % 4 == 2, F.concat(F.lit("v"), y)).otherwise(F.lit("none")))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", text.year_of(name, 2026).alias("year"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y_%m%d') AS image_id FROM orders")
def image_id(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", times.image_id(F.col("o_orderdate")).alias("image_id"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN -72.5 WHEN 1 THEN -74.0 END::DOUBLE AS minx, CASE c_custkey % 3 WHEN 0 THEN 45.8 WHEN 1 THEN 45.7 END::DOUBLE AS maxy FROM customer""")
def region_box(spark, sf_dir):
    name = F.element_at(F.array(F.lit(" Estrie"), F.lit("MONTÉRÉGIE"), F.lit("elsewhere")), (F.col("c_custkey") % 3 + 1).cast("int"))
    box = values.region_box(name)
    return read(spark, sf_dir, "customer").select("c_custkey", box["minx"].alias("minx"), box["maxy"].alias("maxy"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'A' END AS grp, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def valid_hydro_group(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", text.valid_hydro_group(F.col("l_returnflag")).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 10.0::DOUBLE END * p_retailprice AS value, round(p_retailprice, 1) AS short FROM part")
def unit_factor(spark, sf_dir):
    unit = F.when(F.col("p_size") % 2 == 0, F.lit("pct")).otherwise(F.lit("gkg"))
    return read(spark, sf_dir, "part").select("p_partkey", (values.unit_factor(unit) * F.col("p_retailprice")).alias("value"),
                                              values.round_null(F.col("p_retailprice"), 1).alias("short"))

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import harmonize, query
from loamframe.plans import ingest
from loamframe.session import durable
from loamframe.sources import files, writers


def boxes(spark, n=20):
    x, y = (F.col("gid") % 5).cast("double"), (F.col("gid") / 5).cast("int").cast("double")
    df = spark.range(1, n + 1).select(F.col("id").alias("gid")).withColumn("name", F.concat(F.lit("f"), "gid"))
    return geo.with_bounds(df.withColumn("geom", geo.rectangle(x, y, x + 0.5, y + 0.5)))


def test_discovery_kinds_and_spatial_csv(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Farms.GeoJSON").write_text("{}")
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    (tmp_path / "points.csv").write_text("Lat;LONG;v\n45;-72;1\n")
    (tmp_path / "reseau_agrometeo.csv").write_text("a,b\n1,2\n")
    (tmp_path / "layer_styles.csv").write_text("a\n")
    (tmp_path / "dem.TIF").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("x")
    got = {r["id"]: (r["kind"], r["is_spatial"]) for r in files.discover_files(spark, str(tmp_path)).collect()}
    assert got == {"Farms": ("vector", True), "plain": ("csv", False), "points": ("csv", True), "reseau_agrometeo": ("csv", True), "dem": ("raster", True)}


def test_csv_encoding_and_separator(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("nom;val\nMontérégie;1\n".encode("latin1"))
    row = files.read_csv_any(spark, str(tmp_path / "l.csv")).first()
    assert row["nom"] == "Montérégie" and row["val"] == 1
    (tmp_path / "u.csv").write_text("nom,val\nMontérégie,2\n", encoding="utf-8")
    assert files.read_csv_any(spark, str(tmp_path / "u.csv")).first()["nom"] == "Montérégie"


def test_geojson_document_and_lines(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","id":1,"properties":{"name":"a","v":1.5},"geometry":{"type":"Point","coordinates":[-72,45,3]}},{"type":"Feature","properties":{"name":"b"},"geometry":null}]}'
    (tmp_path / "d.geojson").write_text(doc)
    rows = {r["name"]: r for r in files.read_geojson(spark, str(tmp_path / "d.geojson")).collect()}
    assert rows["a"]["v"] == 1.5 and rows["a"]["minx"] == -72 and rows["b"]["geom"] is None
    writers.write_feature_text(boxes(spark), str(tmp_path / "seq"), "gid")
    back = files.read_geojson(spark, str(tmp_path / "seq"), "name string", line_delimited=True)
    assert back.count() == 20 and back.agg(F.sum(geo.num_points(F.col("geom")))).first()[0] == 100
    writers.write_feature_text(boxes(spark), str(tmp_path / "csv"), "gid", fmt="csv")
    assert "POLYGON" in spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["wkt"]


def test_feature_json_text(spark):
    row = writers.to_feature_json(boxes(spark, 1).withColumn("blob", F.encode("name", "utf-8")), "gid").first()["feature"]
    import json

    feature = json.loads(row)
    assert feature["id"] == 1 and feature["properties"] == {"gid": 1, "name": "f1"} and feature["geometry"]["type"] == "Polygon"


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(3).toDF("a"), path)
    writers.write_table(spark.range(9).toDF("a"), path, overwrite=False)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        writers.write_table(spark.range(0).toDF("a"), path)
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1).toDF("a"), str(tmp_path / "bad name!"))
    writers.write_features(boxes(spark).withColumnRenamed("gid", "id"), str(tmp_path / "f"))
    assert {"gid", "minx"} <= set(spark.read.parquet(str(tmp_path / "f")).columns)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_features(boxes(spark), str(tmp_path / "f"))
    writers.export_table(boxes(spark).withColumn("lat", F.lit(1.0)).select("gid", "lat"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["gid", "latitude"]


def test_alias_clash_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 3)], "gid int, id int")
    with pytest.raises(ValueError, match="id__gid"):
        harmonize.resolve_aliases(df)


def test_staged_parts_merge(spark, tmp_path):
    boxes(spark, 3).drop("name").write.parquet(str(tmp_path / "p1"))
    boxes(spark, 6).filter("gid > 3").write.parquet(str(tmp_path / "p2"))
    row = writers.merge_staged(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")], str(tmp_path / "all")).first()
    assert row["rows"] == 6 and row["minx"] == 0 and row["maxx"] == 4.5
    assert spark.read.parquet(str(tmp_path / "all")).filter("name is null").count() == 3


def test_load_modes_and_upsert(spark):
    spark.sql("DROP TABLE IF EXISTS loaded")
    df = boxes(spark, 4).select("gid", "name")
    writers.load_table(df, "loaded", "replace")
    writers.load_table(df.withColumn("gid", F.col("gid") + 10), "loaded", "append")
    assert spark.table("loaded").count() == 8
    with pytest.raises(Exception):
        writers.load_table(df, "loaded", "fail")
    with pytest.raises(ValueError, match="key"):
        writers.load_table(df.unionByName(df), "loaded", "append")
    updates = spark.createDataFrame([(1, "new", 1), (1, "newest", 2), (99, "added", 1)], "gid long, name string, version int")
    merged = {r["gid"]: r["name"] for r in writers.upsert(df, updates, ["gid"], "version").collect()}
    assert merged[1] == "newest" and merged[99] == "added" and len(merged) == 5
    spark.sql("DROP TABLE loaded")


def test_clustered_layout_answers_the_same(spark, tmp_path):
    layer = boxes(spark, 500)
    writers.build_spatial_layout(layer, str(tmp_path / "c"), partitions=4)
    stored = spark.read.parquet(str(tmp_path / "c"))
    box = (1.0, 2.0, 3.2, 40.0)
    assert query.bbox_filter(stored, box, "geom").count() == query.bbox_filter(layer, box, "geom").count()
    plan = query.bbox_filter(stored, box)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(minx" in plan


def test_exact_filter_and_arguments(spark):
    with pytest.raises(ValueError):
        query.bbox_filter(boxes(spark), (5, 0, 1, 1))
    with pytest.raises(ValueError):
        query.page(boxes(spark), ["gid"], 0)


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect() and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_ingest_isolates_bad_layers(spark, tmp_path):
    (tmp_path / "pts.csv").write_text("id,lat,lon,status\n1,45.1,-72.0,N/A\n2,45.2,-72.1,ok\n2,45.2,-72.1,ok\n")
    (tmp_path / "bad.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    report = {r["name"]: r["status"] for r in ingest.ingest_vector(spark, {"pts": str(tmp_path / "pts.csv"), "bad": str(tmp_path / "bad.geojson")}, str(tmp_path / "out")).collect()}
    assert report == {"pts": "processed", "bad": "error"}
    rows = {r["gid"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out" / "pts")).collect()}
    assert rows == {1: None, 2: "ok"}


def test_rejected_polygons_are_reported(spark):
    bow = ("POLYGON", [(0, False, [0.0, 1.0, 0.0, 1.5, 0.0], [0.0, 1.0, 1.0, 0.0, 0.0])])
    fine = ("POLYGON", [(0, False, [5.0, 6.0, 6.0, 5.0, 5.0], [0.0, 0.0, 1.0, 1.0, 0.0])])
    df = spark.createDataFrame([(1, bow), (2, fine)], f"gid long, geom {geo.GEOM_TYPE}")
    clean, rejected = ingest.harmonise_layer(df, "EPSG:4326")
    assert [r["gid"] for r in clean.collect()] == [2] and rejected.first()["reasons"][0] == "self_intersection"

"""Inputs the generic tables do not contain: several grids, few fields, touching rings, NaN, failing collections."""

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import climate, model, pixels, selfcross, spatial
from loamframe.plans import ingest
from loamframe.sources import writers

REQUEST = "request_id long, dataset string, minx double, miny double, maxx double, maxy double"


def cells(spark, rows):
    return spark.createDataFrame(rows, "dataset string, i int, j int, lat double, lon double")


def test_cells_come_from_the_requests_own_grid(spark):
    grid = cells(spark, [("a", 0, 0, 45.0, -73.0), ("a", 0, 1, 45.0, -72.0), ("b", 0, 0, 60.0, -100.0), ("b", 0, 1, 45.1, -73.1)])
    wanted = spark.createDataFrame([(1, "a", -73.5, 44.5, -72.5, 45.5), (2, "b", -73.5, 44.5, -72.5, 45.5), (3, "b", -73.0, 45.0, -73.0, 45.0), (4, "c", 0.0, 0.0, 0.0, 0.0)], REQUEST)
    wanted = wanted.withColumn("polygon", F.lit(None).cast(geo.GEOM_TYPE))
    got = climate.cells_of_requests(wanted, grid, ["dataset"])
    assert sorted(map(tuple, got.select("request_id", "dataset", "i", "j").collect())) == [(1, "a", 0, 0), (2, "b", 0, 1), (3, "b", 0, 1)]


def test_points_on_a_rotated_grid(spark):
    rows = [("r", i, j, 45 + 0.5 * i + 0.2 * j, -73 + 0.5 * j - 0.2 * i) for i in range(6) for j in range(6)]
    asked = [(k, "r", x, y, x, y) for k, (x, y) in enumerate([(-72.1, 46.3), (-70.0, 49.0), (-75.0, 44.0), (120.0, -40.0)])]
    wanted = spark.createDataFrame(asked, REQUEST).withColumn("polygon", F.lit(None).cast(geo.GEOM_TYPE))
    got = {r["request_id"]: (r["i"], r["j"]) for r in climate.cells_of_requests(wanted, cells(spark, rows), ["dataset"]).collect()}
    for k, _, x, y, _, _ in asked:
        assert got[k] == min((((lon - x) ** 2 + (lat - y) ** 2), lat, lon, (i, j)) for _, i, j, lat, lon in rows)[-1]


def test_no_image_is_lost(spark):
    rows = [(float(f), f"2020_{im:02d}", im + f % 3 + 0.1 * r, 0.5 * im + f + 0.2 * r) for im in range(12) for f in (2 * im, 2 * im + 1) for r in range(6)]
    rows += [(99.0, "2020_99", 1.0 + r, 2.0 + r) for r in range(12)]  # one field
    df = spark.createDataFrame(rows, "FIELD_ID double, Image_ID string, x double, log_SOM double")
    scores = {r["Image_ID"]: r["CV_RMSE"] for r in model.score_images(df, ["x"], 0.01).collect()}
    assert all(scores[f"2020_{im:02d}"] == scores[f"2020_{im:02d}"] for im in range(12))
    ranked = model.rank_images(df, ["x"], 0.01)
    assert sorted(ranked) == sorted({r[1] for r in rows}) and ranked[-1] == "2020_99"


def polygon(*rings):
    part = lambda xy, hole, n: {"part": n, "hole": hole, "xs": [float(p[0]) for p in xy], "ys": [float(p[1]) for p in xy]}
    return {"kind": "POLYGON", "parts": [part(xy, hole, n) for n, hole, xy in rings]}


def test_rings_may_touch_in_points(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    shapes = {
        1: polygon((0, False, square), (0, True, [(0, 2), (1, 1), (1, 3), (0, 2)])),  # the hole touches the shell
        2: polygon((0, False, square), (1, False, [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)])),  # parts share a corner
        3: polygon((0, False, [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])),  # a bow tie
        4: polygon((0, False, square), (0, True, [(2, 2), (6, 2), (6, 3), (2, 2)])),  # the hole leaves the shell
        5: polygon((0, False, square), (0, True, [(0, 1), (0, 3), (1, 2), (0, 1)])),  # the hole lies along the shell
    }
    df = spark.createDataFrame(list(shapes.items()), f"gid long, geom {geo.GEOM_TYPE}")
    got = selfcross.self_intersecting(df.withColumns(geo.bounds_columns(F.col("geom"))) if hasattr(geo, "bounds_columns") else df, "gid", cell=1.0)
    assert sorted(r["gid"] for r in got.collect()) == [3, 4, 5]


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "a", nan)], "f long, image string, BSI double")
    assert model.column_means(df, ["BSI"]).first()["BSI"] == 2.0
    assert sorted(r["BSI"] for r in model.impute(df, {"BSI": 2.0}).collect()) == [1.0, 2.0, 3.0]
    assert [r["BSI"] for r in pixels.bare_soil_mask(df, "f", "image").collect()] == [3.0]
    stats = spatial.sample_stats(df.withColumn("soil", F.lit("s")), "f", "BSI", "soil").first()
    assert (stats["n"], stats["m"]) == (2, 2.0)


def test_far_stations_and_none(spark):
    at = spark.createDataFrame([(1, -70.0, 45.0), (2, 150.0, -30.0)], "gid long, x double, y double")
    stations = spark.createDataFrame([("s", 10.0, 50.0), ("t", -71.0, 45.0)], "station_id string, lon double, lat double")
    values = spark.createDataFrame([("s", 2.0), ("s", float("nan")), ("t", float("nan"))], "station_id string, value double")
    got = {r["gid"]: (r["station_id"], r["total"], r["n_values"]) for r in spatial.nearest_with_data(at, values, stations, "gid", "station_id", "value").collect()}
    assert got == {1: ("s", 2.0, 1), 2: ("s", 2.0, 1)}
    none = spatial.nearest_with_data(at, values.limit(0), stations, "gid", "station_id", "value").collect()
    assert [(r["gid"], r["station_id"]) for r in none] == [(1, None), (2, None)] or {r["station_id"] for r in none} == {None}


def test_appended_ids_go_on(spark):
    table = "answers_appended"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    first = spark.createDataFrame([("a",), ("b",)], "name string")
    writers.load_table(first, table, "replace")
    writers.load_table(spark.createDataFrame([("c",)], "name string"), table, "append")
    assert sorted(r["gid"] for r in spark.table(table).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        writers.load_table(spark.createDataFrame([(2, "d")], "gid long, name string").select("name", "gid"), table, "append")
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_a_failing_collection_is_a_row(spark):
    good = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "gid long, minx double, miny double, maxx double, maxy double")
    broken = good.withColumn("gid", F.raise_error(F.lit("unreadable")).cast("long")).withColumn("minx", F.raise_error(F.lit("unreadable")).cast("double"))
    rows = {r["collection"]: r["error"] for r in ingest.catalog_walk({"good": good, "broken": broken}).collect()}
    assert rows["good"] is None and "unreadable" in rows["broken"]


def test_names_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 150, set(e.oracle_sql()) <= set(e.queries()))"],
                          cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True"], said.stderr

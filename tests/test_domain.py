import math

import pytest
from pyspark.sql import functions as F

from loamframe.functions import text, times
from loamframe.operators import catalog, climate, pixels as px, reports, requests as rq, soil, stations
from loamframe.sources import landed


def test_indicators_known_values(spark):
    rows = [(1, d, tx, tn, pr) for d, tx, tn, pr in ((1, 20.0, 10.0, 0.5), (2, 18.0, 8.0, 2.0), (3, 15.0, 5.0, float("nan")))]
    df = spark.createDataFrame(rows, "s int, time int, tasmax double, tasmin double, pr double")
    daily = [r["g"] for r in df.orderBy("time").select(climate.gdd_daily(F.col("tasmax"), F.col("tasmin")).alias("g")).collect()]
    assert daily == [10.0, 8.0, 5.0]
    row = climate.indicators(df, ["s"]).first()
    assert (row["gdd"], row["frost_days"], row["heat_stress_days"], row["pr_total"], row["pr_days"]) == (23.0, 0, 0, 2.5, 1)


@pytest.fixture(scope="module")
def cube(spark):
    rows = [("era5_land", "tasmin", f"2024-01-0{d}", i, j, 45 + i * 0.25, -72 + j * 0.25, 280.0 + i + j + d) for d in range(1, 6) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "dataset string, variable string, time string, i int, j int, lat double, lon double, value double").withColumn("time", F.col("time").cast("date"))


def test_bbox_subset_of_the_cube(cube):
    cells = {(r["lat"], r["lon"]) for r in climate.grid_subset(cube, (-72, 45, -71.8, 45.3)).collect()}
    assert cells == {(45.0, -72.0), (45.25, -72.0)}
    with pytest.raises(ValueError):
        climate.grid_subset(cube, (0, 0, 1, 1), check=True)
    assert {(r["lat"], r["lon"]) for r in climate.grid_nearest(cube, -71.6, 45.2).collect()} == {(45.25, -71.5)}


def test_series_for_point_and_box(spark, cube):
    asks = spark.createDataFrame(
        [(1, -72.0, 45.0, -71.8, 45.3), (2, -71.6, 45.2, -71.6, 45.2)], "request_id int, minx double, miny double, maxx double, maxy double").withColumns({
            "dataset": F.lit("era5_land"), "variable": F.lit("tasmin"), "start_date": F.lit("2024-01-02"), "end_date": F.lit("2024-01-03"),
            "polygon": F.lit(None).cast("struct<kind:string,parts:array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>>")})
    out = climate.timeseries(cube, asks, landed.grid_registry(spark))
    got = {(r["request_id"], str(r["time"])): r["value"] for r in out.collect()}
    assert got == {(1, "2024-01-02"): 9.35, (1, "2024-01-03"): 10.35, (2, "2024-01-02"): 11.85, (2, "2024-01-03"): 12.85}
    arrays = climate.series_as_arrays(out).filter("request_id = 1").first()
    assert arrays["value"] == [9.35, 10.35]


def test_missing_grid_variable(cube):
    with pytest.raises(ValueError, match="pr"):
        landed.read_grid(cube, "era5_land", ["tasmin", "pr"])


def test_small_box_grows_to_one_degree(spark):
    df = spark.createDataFrame([(-72.0, 45.0, -72.0, 45.0)], "minx double, miny double, maxx double, maxy double")
    assert tuple(rq.min_bbox(df).first()) == (-72.5, 44.5, -71.5, 45.5)


def test_station_series_known_order(spark):
    rows = [("A", "2024-01-02 00:00:00", 2.00004), ("A", "2024-01-01 00:00:00", None), ("B", "2024-01-01 00:00:00", 7.0)]
    df = spark.createDataFrame(rows, "station_id string, time string, tasmin double")
    out = {r["station_id"]: r for r in stations.station_series(df, "station_id", "time", ["tasmin"]).collect()}
    assert out["A"]["time"] == ["2024-01-01", "2024-01-02"] and out["A"]["tasmin"] == [None, 2.0] and out["B"]["tasmin"] == [7.0]


@pytest.fixture(scope="module")
def pedo(spark):
    components = spark.createDataFrame([("P1", "21Cw", 60), ("P1", "21All", 40), ("P2", "21Cw", 100), ("P3", "21Xx", 100)], "code_polygone string, composante string, pourcentage long")
    hydro = spark.createDataFrame([("21Cw", "CWA", "C"), ("21All", "ALL", "B"), ("21Xx", "XXX", "NA")], "composante string, code_sol string, groupe_hydrologique string")
    return components, hydro


def test_component_shares_and_dominant_group(spark, pedo):
    fractions = spark.createDataFrame([(1, "P1", 0.5), (1, "P2", 0.5), (2, "P3", 1.0)], "gid int, code_polygone string, fraction double")
    shares = soil.component_shares(fractions, soil.components_with_hydro(*pedo), "gid", keep=["code_sol", "groupe_hydrologique"])
    got = {(r["gid"], r["composante"]): r["share_pct"] for r in shares.collect()}
    assert got == {(1, "21Cw"): pytest.approx(80), (1, "21All"): pytest.approx(20), (2, "21Xx"): pytest.approx(100)}
    assert [(r["gid"], r["dominant_group"]) for r in soil.dominant_group(shares, "gid").collect()] == [(1, "C")]


@pytest.mark.parametrize("hot", [10**9, 1])
def test_horizons_prefer_the_primary_source(spark, hot):
    first = spark.createDataFrame([("CWA", "B", None, 1.45), ("CWA", "Ap1", 15.0, 1.1667), ("CWA", "Ap2", 30.0, 1.33)], "code_sol string, horizon string, depth_bottom_cm double, g_cm3 double")
    second = spark.createDataFrame([("ALL", "1", 1.2), ("ALL", "2", None), ("CWA", "1", 9.99)], "code_sol string, horizon string, g_cm3 double")
    packed = {r["code_sol"]: r for r in soil.horizon_profile(soil.horizon_rows(first, second, hot_rows=hot)).collect()}
    assert packed["CWA"]["horizon"] == ["Ap1", "Ap2", "B"] and packed["CWA"]["depth_top_cm"] == [0.0, 15.0, 30.0] and packed["CWA"]["g_cm3"] == [1.167, 1.33, 1.45]
    assert packed["ALL"]["source"] == "inventaire_1990" and packed["ALL"]["horizon"] == ["1"] and packed["ALL"]["depth_top_cm"] == [None]


def test_left_half_zonal_statistics(spark):
    from loamframe.functions import geometry as geo

    pixels = spark.range(16).select(F.col("id").alias("pixel_id"), (F.lit(-72.0) + (F.col("id") % 4) * 0.01 + 0.005).alias("x"),
                                    (F.lit(46.0) - (F.col("id") / 4).cast("int") * 0.01 - 0.005).alias("y"), (F.col("id") + 1).cast("double").alias("value"))
    half = geo.with_bounds(spark.range(1).select(F.col("id").alias("gid"), geo.rectangle(*map(F.lit, (-72.0, 45.96, -71.98, 46.0))).alias("geom")))
    row = px.zonal_stats(pixels, half, "gid").first()
    values = [1, 2, 5, 6, 9, 10, 13, 14]
    assert row["count"] == 8 and row["mean"] == pytest.approx(sum(values) / 8) and (row["min"], row["max"]) == (1, 14)


def test_circular_mean_crosses_north(spark):
    df = spark.createDataFrame([(350.0,), (10.0,), (20.0,)], "a double")
    assert df.agg(px.circular_mean(F.col("a")).alias("m")).first()["m"] == pytest.approx(6.67, abs=0.05)


def test_terrain_of_a_plane(spark):
    # rises 1 per cell to the east: slope 10 % at cell size 10, downslope faces west
    dem = spark.range(25).select(F.lit("d").alias("raster_id"), (F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), (F.col("id") % 5).cast("double").alias("value"))
    rows = px.terrain(dem, 10.0).filter("slope_pct is not null").collect()
    assert len(rows) == 9 and all(r["slope_pct"] == pytest.approx(10) and r["aspect_deg"] == pytest.approx(270) for r in rows)
    flat = px.terrain(dem.withColumn("value", F.lit(3.0)), 10.0).filter("slope_pct is not null")
    assert flat.filter("aspect_deg is not null").isEmpty()


def test_constant_and_empty_rasters_have_no_range(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 0.5), ("b", 1, 2.0), ("c", 1, float("nan"))], "r string, band int, value double")
    assert [(x["r"], x["rescale"]) for x in px.render_range(df, ["r"]).collect()] == [("b", "0.5,2.0")]


def test_field_metrics_golden(spark):
    rows = [(10, "i1", 0.58, 0.70), (10, "i2", 0.55, 0.65), (20, "i1", 0.48, 0.60)]
    df = spark.createDataFrame(rows, "FIELD_ID long, Image_ID string, y_true_log double, y_pred_log double").withColumns({
        "y_true_lin": F.pow(F.lit(10.0), "y_true_log"), "y_pred_lin": F.pow(F.lit(10.0), "y_pred_log"), "algo": F.lit("RF"), "scenario": F.lit("S1")})
    m = reports.regression_metrics(reports.field_predictions(df), ["algo", "scenario"]).first()
    truth, pred = [0.565, 0.48], [0.675, 0.60]
    errors = [t - p for t, p in zip(truth, pred)]
    assert m["MAE_log"] == pytest.approx(0.115) and m["RMSE_log"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / 2))
    mean = sum(truth) / 2
    assert m["R2_log"] == pytest.approx(1 - sum(e * e for e in errors) / sum((t - mean) ** 2 for t in truth)) and m["avg_images_per_field"] == 1.5
    one = reports.regression_metrics(reports.field_predictions(df.filter("FIELD_ID = 20")), ["scenario"]).first()
    assert one["R2_log"] is None


def test_latency_interval_small_sample(spark):
    df = spark.createDataFrame([("a", v, True) for v in (1.0, 2.0, 3.0)] + [("a", 99.0, False)], "label string, ms double, ok boolean")
    row = reports.latency_summary(df, "label", "ms", F.col("ok")).first()
    assert row["median"] == 2 and row["ci_high"] - row["mean"] == pytest.approx(4.303 / math.sqrt(3))


def test_names_and_dates(spark):
    row = spark.range(1).select(
        text.harmonize_name(F.lit("  Été 2024 -- Sols ")).alias("a"), text.harmonize_name(F.lit("x" * 60)).alias("b"), text.harmonize_name(F.lit("  ")).alias("c"),
        text.ascii_fold(F.lit("Rivière-du-Loup ©")).alias("d"), times.datetime_from_name(F.lit("a_20249999_2020")).alias("e"),
        times.datetime_from_map(F.create_map(F.lit("k"), F.lit("v"))).alias("f")).first()
    assert row["a"] == "t_2024_sols" and len(row["b"]) == 50 and row["c"] is None and row["d"] == "Riviere-du-Loup "
    assert row["e"].year == 2020 and row["f"].year == 1950


def test_catalogue_item_found(spark):
    df = spark.createDataFrame([("i1", "c", "2024-06-15 12:00:00", -73.5, 45.5, -73.4, 45.6)], "id string, collection string, datetime string, minx double, miny double, maxx double, maxy double").withColumn("datetime", F.to_timestamp("datetime"))
    assert catalog.catalog_search(df, ["c"], (-74, 45, -73, 46), "2024-01-01", "2024-12-31").count() == 1
    assert catalog.catalog_search(df, ["c"], (0, 0, 1, 1)).count() == 0


def test_components_are_dealt_by_rows(spark):
    """Tasks of the join are told by the number of rows, on both ways with the same rows as the plain join."""
    n = spark.sparkContext.defaultParallelism + 3
    components = spark.range(40 * n).select((F.col("id") % 50).cast("string").alias("code_polygone"), (F.col("id") % 30).cast("string").alias("composante"), F.col("id").cast("double").alias("pourcentage"))
    hydro = spark.range(20).select(F.col("id").cast("string").alias("composante"), F.lit("A").alias("groupe_hydrologique"))
    wanted = spark.range(25).select(F.col("id").cast("string").alias("code"))
    listed = lambda df: sorted(map(tuple, df.select(*components.columns, "groupe_hydrologique").collect()), key=str)
    for codes in (None, wanted, ["1", "2"]):
        plain = soil.components_with_hydro(components, hydro, codes)
        dealt = soil.components_with_hydro(components, hydro, codes, task_rows=40)
        assert listed(dealt) == listed(plain)
        assert "hashpartitioning(composante#" in dealt._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()

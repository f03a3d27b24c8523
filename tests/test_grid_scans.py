"""Stored grids: asked data sets, variables, periods and cells reach the scan."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from loamframe.operators import climate
from loamframe.sources import landed

ASKED = "request_id int, dataset string, variable string, start_date string, end_date string, minx double, miny double, maxx double, maxy double"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two data sets, three variables, three years on a grid of 8 x 8 cells."""
    days = spark.range(36).select(F.add_months(F.lit("2021-01-15").cast("date"), F.col("id").cast("int")).alias("time"))
    names = spark.createDataFrame([(d, v) for d in ("era5_land", "agera5") for v in ("tasmin", "tasmax", "pr")], "dataset string, variable string")
    cells = spark.range(64).select((F.col("id") % 8).cast("int").alias("i"), (F.col("id") / 8).cast("int").alias("j"))
    grid = names.crossJoin(days).crossJoin(cells).select(
        "*", (45.0 + F.col("i") * 0.25).alias("lat"), (-72.0 + F.col("j") * 0.25).alias("lon"),
        (F.lit(270.0) + F.month("time") + F.col("i") / 8 + F.col("j") / 64).alias("value"))
    path = str(tmp_path_factory.mktemp("grid") / "g")
    landed.store_grid(grid, path)
    return grid, *landed.open_grid(spark, path)


def requests(spark):
    rows = [(1, "era5_land", "tasmin", "2022-02-01", "2022-05-31", -72.0, 45.0, -71.7, 45.3), (2, "era5_land", "tasmin", "2022-03-01", "2022-04-30", -71.6, 45.2, -71.6, 45.2)]
    return spark.createDataFrame(rows, ASKED).withColumn(
        "polygon", F.lit(None).cast("struct<kind:string,parts:array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>>"))


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_series_of_a_stored_grid_equal_those_of_the_table(spark, stored):
    grid, values, cells = stored
    registry = landed.grid_registry(spark)
    plain = climate.timeseries(grid, requests(spark), registry)
    pruned = climate.timeseries(values, requests(spark), registry, cells=cells)
    key = lambda df: sorted((r["request_id"], str(r["time"]), round(r["value"], 9)) for r in df.collect())
    assert key(plain) == key(pruned) and len(key(plain)) == 4 + 2


def test_partitions_and_row_groups_are_pruned(spark, stored):
    _, values, cells = stored
    plan = plan_of(climate.timeseries(values, requests(spark), landed.grid_registry(spark), cells=cells))
    scan = next(part for part in plan.split("\n\n") if "Scan parquet" in part and "PartitionFilters" in part and "year" in part)
    partitions = re.search(r"PartitionFilters: \[(.*)\]", scan).group(1)
    pushed = re.search(r"PushedFilters: \[(.*)\]", scan).group(1)
    assert "era5_land" in partitions and "tasmin" in partitions and "2022" in partitions, scan
    for wanted in ("GreaterThanOrEqual(time,2022-02-01)", "LessThan(time,2022-06-01)", "LessThanOrEqual(i,", "LessThanOrEqual(j,"):
        assert wanted in pushed, (wanted, scan)
    assert "lat" not in re.search(r"ReadSchema: (.*)", scan).group(1), scan


def test_requests_of_nothing_give_nothing(spark, stored):
    _, values, cells = stored
    registry = landed.grid_registry(spark)
    for none in (requests(spark).limit(0), requests(spark).withColumn("variable", F.lit("unknown")), requests(spark).withColumn("end_date", F.lit(None).cast("string"))):
        assert climate.timeseries(values, none, registry, cells=cells).collect() == []
        assert climate.timeseries(values, none, registry).collect() == []


def test_each_variable_keeps_its_own_span(spark, stored):
    _, values, cells = stored
    wanted = spark.createDataFrame([("era5_land", "pr", 1, 1, "2021-01-01", "2021-02-28"), ("agera5", "tasmin", 2, 2, "2023-11-01", "2023-12-31")],
                                   "dataset string, variable string, i int, j int, start_date string, end_date string")
    got = climate.prune_grid(values, wanted).groupBy("dataset", "variable").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("era5_land", "pr"): 2, ("agera5", "tasmin"): 2}

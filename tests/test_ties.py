"""Frames that grow with a slice, and ties that only the last bits of a distance break."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import ordered, spatial, split


def test_neighbours_are_read_by_growing_frames_only(spark):
    """A frame up to the end of the slice is worked out anew for each row: quadratic."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 7 == 0, F.col("id") * 10).alias("v"))
    out = ordered.neighbour_values(df, [], [F.col("id")], "v", "lower", "upper")
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "_ord_lo" not in line]
    assert windows and not any("unboundedfollowing" in line.lower() for line in windows)
    got = {r.id: (r.lower, r.upper) for r in out.collect()}
    for n in range(4000):
        low, high = (n - 1) // 7 * 7, n // 7 * 7 + 7
        assert got[n] == (low * 10 if n else None, high * 10 if high < 4000 else None)


def test_distances_that_tie_go_to_the_lower_id(spark):
    at = spark.createDataFrame([(1, 10.05, 50.0)], "gid long, x double, y double")
    # both 0.1 away; 10.05 + 0.1 and 10.05 - 0.1 differ from it in the last bits
    rows = [(5, 10.05 + 0.1 + 1e-14, 50.0), (9, 10.05 - 0.1 + 2e-14, 50.0), (7, 10.05, 50.4)]
    features = spatial.as_boxes(spark.createDataFrame(rows, "f long, x double, y double").withColumn("geom", geo.point(F.col("x"), F.col("y"))))
    best = spatial.nearest(at, features, "gid", "f", "x", "y", 2, F.lit(1000.0)).select("f", "rank").collect()
    assert sorted(map(tuple, best)) == [(5, 1), (9, 2)]


def test_pieces_are_cut_once_and_then_numbered(spark):
    """Numbering reads its rows several times; the cutting must not be part of each pass."""
    x = [float(n) for n in range(10)]
    ring = geo.polygon(F.array(*map(F.lit, [*x, *reversed(x), 0.0])), F.array(*map(F.lit, [0.0] * 10 + [1.0] * 10 + [0.0])))
    cut = split.split_large(spark.range(3).select(F.col("id").alias("gid"), ring.alias("geom")), ["gid"], max_vertices=12)
    assert "MapInPandas" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.select("gid").distinct().count() == cut.count() >= 6

"""Rows of a grid are summed by cell and time before requests meet them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import climate


def test_grid_rows_are_summed_before_they_meet_requests(spark, monkeypatch):
    grid = spark.range(900).select(
        F.lit("d").alias("dataset"), F.lit("pr").alias("variable"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("time"),
        F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(45.0).alias("lat"), F.lit(-72.0).alias("lon"), F.col("id").cast("double").alias("value"))
    asked = spark.range(4).select(
        F.col("id").alias("request_id"), F.lit("d").alias("dataset"), F.lit("pr").alias("variable"), F.lit("2024-01-01").alias("start_date"),
        F.lit("2024-01-02").alias("end_date"), F.lit(-72.1).alias("minx"), F.lit(44.9).alias("miny"), F.lit(-71.9).alias("maxx"), F.lit(45.1).alias("maxy"),
        F.lit(None).cast(geo.GEOM_TYPE).alias("polygon"))
    registry = spark.sql("SELECT 'd' AS dataset, 'pr' AS variable, 1.0D AS scale, 0.0D AS offset, 'mm' AS units")
    written, kept = [], climate.durable
    grid, asked = kept(grid), kept(asked)
    monkeypatch.setattr(climate, "durable", lambda df: written.append(kept(df)) or written[-1])
    for aggregation, want in (("daily", {448.5, 449.5}), ("monthly", {449.0})):
        got = climate.timeseries(grid, asked, registry, aggregation).collect()
        assert len(got) == 4 * len(want) and {r.value for r in got} == want
        assert any("_s" in df.columns and df.count() == 2 for df in written)

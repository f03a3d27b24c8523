"""Steps that are used several times are worked out once, and rows that are heavy go to all tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.plans import ingest, parcels as pp


def _boxes(spark, n: int = 40):
    x = F.col("gid").cast("double")
    return geo.with_bounds(spark.range(n).select(F.col("id").alias("gid")).withColumn("geom", geo.rectangle(x, x, x + 1, x + 2)))


@pytest.mark.parametrize("use", [geo.interior_point, lambda g: geo.invalid_reasons(geo.repair(g))])
def test_steps_of_a_geometry_are_written_once(spark, use):
    plan = _boxes(spark).select("geom").select(use(F.col("geom")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000


def test_a_layer_is_repaired_once_before_it_is_numbered(spark, monkeypatch):
    written = []
    kept = ingest.durable
    monkeypatch.setattr(ingest, "durable", lambda df: written.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or kept(df))
    clean, _ = ingest.harmonise_layer(_boxes(spark).select("gid", "geom"), "EPSG:4326")
    assert clean.count() == 40 and max(written) < 100_000


def test_interior_points_are_not_worked_out_for_each_condition(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pp.spatial, "nearest_distance", lambda placed, *rest: seen.append(placed) or placed)
    pp.water_distance(_boxes(spark), None, 1.0)
    plan = seen[0].filter("x IS NOT NULL AND y IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 4 and "RepartitionByExpression" in plan
    assert {tuple(r) for r in seen[0].collect()} == {(n, n + 0.5, n + 1.0) for n in range(40)}

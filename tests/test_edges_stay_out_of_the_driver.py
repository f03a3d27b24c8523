"""Edges of a layer are many times its rows: they are never broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import selfcross
from loamframe.session import durable


def test_edges_are_not_broadcast(spark):
    x, y = F.col("id") * 2.0, F.lit(0.0)
    box = geo.rectangle(x, y, x + 1, y + 1)
    bow = geo.polygon(F.array(x, x + 1, x, x + 1, x), F.array(y, y + 1, y + 1, y, y))
    layer = durable(spark.range(60).select(F.col("id").alias("gid"), F.when(F.col("id") % 7 == 0, bow).otherwise(box).alias("geom")))
    found = selfcross.self_intersecting(layer, "gid")
    assert sorted(r["gid"] for r in found.collect()) == list(range(0, 60, 7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2

"""The sides of an overlay are worked out once, over all tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import overlay


def _boxes(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name} long, x0 double, y0 double, x1 double, y1 double")
    return geo.with_bounds(df.select(name, geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("geom")))


def test_long_expressions_stay_out_of_the_join(spark):
    a = _boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "gid")
    # half of the first, an edge of it, a corner of the second
    b = _boxes(spark, [(10, 0.5, 0.0, 2.0, 1.0), (11, 1.0, 0.0, 2.0, 1.0), (12, 6.0, 6.0, 7.0, 7.0)], "soil_id")
    pairs = overlay.overlap_join(a, b, "gid", "soil_id")
    assert "ATANH" not in pairs._jdf.queryExecution().optimizedPlan().toString().upper()
    assert [(r.gid, r.soil_id, round(r.fraction, 9)) for r in pairs.collect()] == [(1, 10, 0.5)]


def test_triangles_and_boxes_meet_in_every_combination(spark):
    box = _boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "gid")
    corners = F.array(*map(F.lit, [0.0, 1.0, 1.0, 0.0])), F.array(*map(F.lit, [0.0, 0.0, 1.0, 0.0]))
    both = box.unionByName(geo.with_bounds(box.select(F.lit(2).cast("long").alias("gid"), geo.polygon(*corners).alias("geom"))).select(*box.columns))
    both = both.unionByName(box.withColumns({"gid": F.lit(3).cast("long"), "geom": F.lit(None).cast(geo.GEOM_TYPE)}))  # no shape, no pair
    pairs = overlay.overlap_join(both, both.withColumnRenamed("gid", "soil_id"), "gid", "soil_id")
    got = {(r.gid, r.soil_id): round(r.fraction, 2) for r in pairs.collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 1.0, (2, 2): 1.0}

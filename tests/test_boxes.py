"""Rectangles meet as numbers: same results as by their geometries, nothing of these carried, nothing sorted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import overlay, spatial


def _shapes(spark, rows, identity):
    """(id, kind, x0, y0, x1, y1): a box, or the lower right triangle of one."""
    df = spark.createDataFrame(rows, f"{identity} long, kind string, x0 double, y0 double, x1 double, y1 double")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    triangle = geo.polygon(F.array(x0, x1, x1, x0), F.array(y0, y0, y1, y0))
    return geo.with_bounds(df.withColumn("geom", F.when(F.col("kind") == "box", geo.rectangle(x0, y0, x1, y1)).otherwise(triangle))).drop("x0", "y0", "x1", "y1")


PARCELS = [(1, "box", 0.0, 0.0, 1.0, 1.0), (2, "box", 0.5, 0.5, 1.5, 1.5), (3, "triangle", 0.0, 0.0, 2.0, 2.0)]


@pytest.fixture()
def parcels(spark):
    return _shapes(spark, PARCELS, "gid")


@pytest.fixture()
def points(spark):
    return spark.createDataFrame([(n, (n % 9) / 4.0, (n // 9) / 4.0) for n in range(81)], "pid long, x double, y double")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_a_path_there_and_back_is_no_rectangle(spark):
    path = geo.polygon(F.array(*map(F.lit, (0.0, 1.0, 1.0, 1.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0, 0.0))))
    box = geo.rectangle(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    assert tuple(spark.range(1).select(overlay.is_rectangle(path), overlay.is_rectangle(box)).first()) == (False, True)


def test_shared_areas_of_boxes_and_others(spark, parcels):
    soils = _shapes(spark, [(1, "box", 0.25, 0.25, 0.75, 2.0), (2, "triangle", 0.0, 0.0, 1.0, 1.0)], "soil_id")
    got = {(r[0], r[1]): r[2] for r in overlay.overlap_join(parcels, soils, "gid", "soil_id").collect()}
    a, b = parcels.select("gid", F.col("geom").alias("a")), soils.select("soil_id", F.col("geom").alias("b"))
    want = {(r[0], r[1]): r[2] for r in a.crossJoin(b).select("gid", "soil_id", overlay.intersection_area(F.col("a"), F.col("b")).alias("m")).filter("m > 1").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-4 for k in want)  # edges of triangles bend on the sphere


def test_boxes_carry_no_geometry_into_the_join(spark, parcels):
    boxes = parcels.filter("kind = 'box'")
    soils = boxes.withColumnRenamed("gid", "soil_id")
    joined = overlay.overlap_join(boxes, soils, "gid", "soil_id")
    join = _plan(joined)[0].split("Join Inner")[0]
    assert "_ga" not in join and "filter(" not in join


def test_points_in_boxes_and_others(parcels, points):
    want = {(r[0], r[1]) for r in points.crossJoin(parcels).filter(geo.contains_point(F.col("geom"), F.col("x"), F.col("y"))).select("pid", "gid").collect()}
    for some in (parcels, parcels.filter("kind = 'box'")):
        ids = {r[0] for r in some.select("gid").collect()}
        got = [tuple(r) for r in spatial.spatial_join(some, points, "gid", "pid").select("pid", "gid").collect()]
        assert sorted(got) == sorted(w for w in want if w[1] in ids)


def test_first_label_is_reduced_in_place(parcels, points):
    labelled = parcels.withColumn("label", F.concat(F.lit("zone "), F.col("gid").cast("string")))
    out = spatial.first_match_label(points, labelled, "pid", "gid", "label")
    assert "SortAggregate" not in _plan(out)[1]
    hits = spatial.spatial_join(parcels, points, "gid", "pid").groupBy("pid").agg(F.min("gid").alias("g"))
    want = {r.pid: f"zone {r.g}" for r in hits.collect()}
    assert {r.pid: r.label for r in out.collect()} == {n: want.get(n) for n in range(81)}


def test_first_label_with_an_id_in_two_rows(parcels, points):
    twice = parcels.withColumn("gid", F.lit(7)).withColumn("label", F.lit("one"))
    out = spatial.first_match_label(points, twice, "pid", "gid", "label").filter("label IS NOT NULL")
    assert out.count() == spatial.spatial_join(parcels, points, "gid", "pid").select("pid").distinct().count()


def test_clicks_hit_the_first_polygon_inside_then_the_first_near(parcels, points):
    clicks = points.withColumn("x", F.col("x") + 0.0001)
    out = spatial.point_hit(clicks, parcels, "pid", "gid")
    assert "SortAggregate" not in _plan(out)[1]
    near = clicks.crossJoin(parcels).filter("x - 0.0002 <= maxx AND x + 0.0002 >= minx AND y - 0.0002 <= maxy AND y + 0.0002 >= miny")
    inside = geo.contains_point(F.col("geom"), F.col("x"), F.col("y"))
    want = near.groupBy("pid").agg(F.min(F.struct((~inside).alias("o"), F.col("gid").alias("g"))).alias("b")).select("pid", "b.g", ~F.col("b.o"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_distances_from_boxes_and_others(spark, parcels, points):
    fields = spatial.as_boxes(points).select(F.col("pid").alias("fid"), (F.col("pid") % 2 == 0).alias("flag"), geo.point(F.col("x"), F.col("y")).alias("geom"), "minx", "miny", "maxx", "maxy")
    both = parcels.crossJoin(fields.select("fid", F.col("geom").alias("p"))).withColumn("d", geo.distance_m(F.col("geom"), F.col("p"))).filter("d <= 30000")
    want = {(r[0], r[1]): r[2] for r in both.select("gid", "fid", F.round("d", 1)).collect()}
    got = {(r[0], r[1]): r[2] for r in spatial.within_distance(parcels, fields, "gid", "fid", "flag", 30_000.0).select("gid", "fid", "dist_m").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.11 for k in want)


def test_sample_statistics_of_a_field_with_many_classes(spark):
    rows = [(1, float(n % 7), f"c{n % 300}") for n in range(900)] + [(1, None, "c1"), (1, float("nan"), None), (2, None, "a"), (3, 1.0, None)]
    joined = spark.createDataFrame(rows, "gid long, som double, symbol string")
    out = spatial.sample_stats(joined, "gid", "som", "symbol")
    got = {r.gid: r for r in out.collect()}
    want = joined.filter("som IS NOT NULL AND NOT isnan(som)").groupBy("gid").agg(F.count("som").alias("n"), F.avg("som").alias("m"), F.stddev_pop("som").alias("sd")).filter("gid = 1").first()
    assert got.keys() == {1, 2} and len(got[1].types) == 300 and got[1].types == sorted(got[1].types)
    assert got[1].n == want.n and abs(got[1].m - want.m) < 1e-12 and abs(got[1].sd - want.sd) < 1e-9
    assert (got[2].n, got[2].m, got[2].sd, got[2].types) == (0, None, None, ["a"])


def test_a_clipped_ring_is_worked_out_once(parcels):
    """Each mention of a ring used to work out the whole clipping again."""
    text = _plan(parcels.select(overlay.intersection_area(F.col("geom"), F.col("geom")).alias("m")))[0]
    assert len(text) < 20_000

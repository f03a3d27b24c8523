"""Rows at one place are met once, and joins get tasks by the pairs that come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import spatial


def _crowd(spark, places: int, n: int = 600):
    at = (F.col("id") % places) + 0.5
    return spark.range(n).select(F.col("id").alias("pid"), at.alias("x"), at.alias("y"))


def _zones(spark, n: int):
    x = F.col("zone").cast("double")
    return geo.with_bounds(spark.range(n).select(F.col("id").alias("zone"), F.concat(F.lit("z"), "id").alias("label")).withColumn("geom", geo.rectangle(x, x, x + 2, x + 2)))


def _joined(monkeypatch):
    seen, join = [], spatial.bbox_join
    monkeypatch.setattr(spatial, "bbox_join", lambda a, b, *rest, **more: seen.append((a.count(), b.count())) or join(a, b, *rest, **more))
    return seen


def test_labels_and_distances_are_looked_up_once_for_a_place(spark, monkeypatch):
    seen, points, zones = _joined(monkeypatch), _crowd(spark, 6), _zones(spark, 5)
    got = {r.pid: r.label for r in spatial.first_match_label(points, zones, "pid", "zone", "label").collect()}
    assert got == {n: f"z{max(0, n % 6 - 1)}" if n % 6 < 6 else None for n in range(600)}
    fields = spatial.as_boxes(points.select("pid", "x", "y", (F.col("pid") % 2 == 0).alias("flag"))).withColumn("geom", geo.point(F.col("x"), F.col("y")))
    near = spatial.within_distance(zones, fields, "zone", "pid", "flag", 100.0)
    assert {(r.zone, r.pid) for r in near.collect()} == {(z, n) for z in range(5) for n in range(600) if z <= n % 6 + 0.5 < z + 2}
    assert near.filter("dist_m <> 0 OR flag <> (pid % 2 = 0)").isEmpty()
    assert max(min(pair) for pair in seen) <= 6


def test_sample_statistics_by_place_are_those_of_the_samples(spark):
    points = _crowd(spark, 6).withColumn("som", F.when(F.col("pid") % 7 > 0, 1e6 + F.col("pid") * 0.37))
    soils, fields = _zones(spark, 5).withColumnsRenamed({"zone": "soil_id", "label": "symbol"}), _zones(spark, 4).withColumnRenamed("zone", "gid").drop("label")
    got = {r.gid: r for r in spatial.field_sample_stats(fields, points, soils).collect()}
    rows = [(n, n % 6 + 0.5, 1e6 + n * 0.37 if n % 7 else None) for n in range(600)]
    for gid, r in got.items():
        values = [v for _, at, v in rows if gid <= at < gid + 2 and v is not None]
        mean = sum(values) / len(values)
        assert r.n == len(values) and abs(r.m - mean) < 1e-6 and abs(r.sd - (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5) < 1e-6
        assert r.types == sorted({f"z{max(0, int(at) - 1)}" for _, at, _ in rows if gid <= at < gid + 2})
    assert sorted(got) == [0, 1, 2, 3]


def test_a_place_is_searched_once_for_its_nearest(spark, monkeypatch):
    seen, search = [], spatial.pyramid.near_features
    monkeypatch.setattr(spatial.pyramid, "near_features", lambda points, *rest: seen.append(points.count()) or search(points, *rest))
    features = spatial.as_boxes(_crowd(spark, 5, 5).withColumn("geom", geo.point(F.col("x"), F.col("y"))).withColumnRenamed("pid", "f"))
    best = spatial.nearest(_crowd(spark, 6), features, "pid", "f", "x", "y", 1, F.lit(100.0))
    assert {(r.pid, r.f) for r in best.collect()} == {(n, min(4, n % 6)) for n in range(600)} and seen == [6]


def test_tasks_are_told_by_pairs_where_entries_are_few(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_PAIRS", 1000)
    a, b = (spark.range(300).select(F.col("id").alias(k)).withColumns(
        {"minx": F.lit(0.0), "miny": F.lit(0.0), "maxx": F.lit(1.0), "maxy": F.lit(1.0)}) for k in "ab")
    assert spatial.bbox_join(a, b, "a", "b").rdd.getNumPartitions() == 90
    salted = spatial.bbox_join(a, b, "a", "b", hot_rows=100, broadcast_bytes=0)
    assert salted.count() == 90_000 and salted.rdd.getNumPartitions() == 90


def test_no_task_writes_all_entries_of_a_join(spark, monkeypatch):
    """A layer read from one small file: its cell entries are written by many tasks, and the pairs stay the same."""
    rows = [(n, n % 40 / 10.0, n // 40 / 10.0) for n in range(800)]
    boxes = spark.createDataFrame(rows, "soil_id long, minx double, miny double").coalesce(1)
    boxes = boxes.withColumns({"maxx": F.col("minx") + 0.15, "maxy": F.col("miny") + 0.15})
    boxes = boxes.withColumn("geom", geo.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    want = set(map(tuple, spatial.overlapping_pairs(boxes, "soil_id").collect()))
    seen, join, plain = [], spatial.skew.salted_join, spatial.bbox_join

    def watched(left, right, *args, **settings):
        seen.extend([left.rdd.getNumPartitions(), right.rdd.getNumPartitions()])
        return join(left, right, *args, **settings)

    monkeypatch.setattr(spatial.skew, "salted_join", watched)
    monkeypatch.setattr(spatial, "bbox_join", lambda *args, **settings: plain(*args, **settings, hot_rows=100, broadcast_bytes=0))
    assert set(map(tuple, spatial.overlapping_pairs(boxes, "soil_id").collect())) == want and len(want) > 800
    assert len(seen) == 2 and min(seen) > 1


def test_a_layer_that_meets_itself_is_shuffled_once(spark, monkeypatch):
    """Boxes of several levels; both sides of the join read the same exchange, and a crowded cell takes the salted way to the same pairs."""
    monkeypatch.setattr(spatial, "SELF_ROWS", 0)
    rows = [(n, n % 17 * 0.7, n % 13 * 0.9, (0.1, 0.6, 3.0)[n % 3]) for n in range(400)] + [(900, -5.0, -5.0, 40.0), (901, 50.0, 50.0, 0.0), (902, 50.0, 50.0, 0.0)]
    boxes = spark.createDataFrame(rows, "soil_id long, x double, y double, w double")
    boxes = geo.with_bounds(boxes.select("soil_id", geo.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("geom")))
    want = {(a[0], b[0]) for a in rows for b in rows
            if a[0] != b[0] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[3] and b[2] <= a[2] + a[3]}
    pairs = spatial.overlapping_pairs(boxes, "soil_id")
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    assert spatial._self_join(spatial.with_box(boxes, "geom"), "soil_id", [], hot_rows=20) is None
    monkeypatch.setattr(spatial, "SELF_ROWS", 1_000_000)
    assert spatial._self_join(spatial.with_box(boxes, "geom"), "soil_id", []) is None

"""Nearest features against brute force: points, lines, polygons, dense places, far points, ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import pyramid, spatial

SCHEMA = f"fid long, geom {geo.GEOM_TYPE}"


def shape(kind, *rings):
    return {"kind": kind, "parts": [{"part": n, "hole": False, "xs": [float(x) for x, _ in r], "ys": [float(y) for _, y in r]} for n, r in enumerate(rings)]}


def to_edge(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
    t = max(0.0, min(1.0, t))
    return math.hypot(a[0] + t * dx - px, a[1] + t * dy - py)


def inside(px, py, rings):
    hits = 0
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a[1] > py) != (b[1] > py) and px < a[0] + (py - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                hits += 1
    return hits % 2 == 1


def distance(px, py, g):
    rings = [list(zip(p["xs"], p["ys"])) for p in g["parts"]]
    if g["kind"] == "POLYGON" and inside(px, py, rings):
        return 0.0
    return min(to_edge(px, py, a, b) for r in rings for a, b in (zip(r, r[1:]) if len(r) > 1 else [(r[0], r[0])]))


def layer_of(rnd):
    """Points, rivers and lakes, a dense town, two features at one place, a line across everything."""
    out = []
    at = lambda: (rnd.uniform(-80, -60), rnd.uniform(45, 60))
    for _ in range(60):
        out.append(shape("POINT", [at()]))
    for _ in range(25):
        x, y = at()
        line = [(x, y)]
        for _ in range(rnd.randint(1, 30)):
            x, y = x + rnd.uniform(-0.4, 0.4), y + rnd.uniform(-0.4, 0.4)
            line.append((x, y))
        out.append(shape("LINE", line))
    for _ in range(25):
        (x, y), r, n = at(), rnd.uniform(0.01, 2), rnd.randint(3, 40)
        corners = [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
        out.append(shape("POLYGON", [*corners, corners[0]]))
    out += [shape("POINT", [(-70 + rnd.gauss(0, 0.003), 50 + rnd.gauss(0, 0.003))]) for _ in range(300)]
    out += [shape("POINT", [(-65.0, 47.0)])] * 3 + [shape("LINE", [(-179.0, -60.0), (170.0, 80.0)]), shape("POINT", [(-64.0, 64.0)])]
    return out


@pytest.mark.parametrize("k, crowded", [(1, 32), (4, 5)])
def test_nearest_equals_brute_force(spark, monkeypatch, k, crowded):
    rnd = random.Random(k)
    monkeypatch.setattr(pyramid.Pyramid.__init__, "__defaults__", ("geom", crowded, 9))
    shapes = layer_of(rnd)
    features = geo.with_bounds(spark.createDataFrame(list(enumerate(shapes)), SCHEMA)).withColumn("note", F.col("fid") * 2).repartition(4)
    spots = [(rnd.uniform(-82, -58), rnd.uniform(44, 62)) for _ in range(50)] + [(-70.0, 50.0), (-70.02, 50.0), (-65.0, 47.0), (-64.0, 64.0), (150.0, -80.0), (-69.9, 50.001)]
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(spots)] + [(999, None, 1.0)], "pid long, x double, y double")
    limit = 25.0
    got = {}
    for r in spatial.nearest(points, features, "pid", "fid", "x", "y", k, F.lit(limit), keep=["note"]).collect():
        got.setdefault(r["pid"], []).append((r["rank"], r["fid"], round(r["planar"], 9)))
        assert r["note"] == 2 * r["fid"] and r["geom"] is not None
    for n, (x, y) in enumerate(spots):
        ranked = sorted((round(distance(x, y, g), 12), f) for f, g in enumerate(shapes))
        want = [(i + 1, f, round(d, 9)) for i, (d, f) in enumerate([p for p in ranked if p[0] <= limit][:k])]
        assert [w[2] for w in want] == [g[2] for g in sorted(got.get(n, []))], (n, want, got.get(n))
        if len({d for d, _ in ranked[: k + 1]}) == k + 1:
            assert sorted(got.get(n, [])) == want
    assert 999 not in got


def test_few_and_no_features(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "pid long, x double, y double")
    two = geo.with_bounds(spark.createDataFrame([(1, shape("POINT", [(1, 1)])), (2, shape("POINT", [(1, 1)]))], SCHEMA))
    got = spatial.nearest(points, two, "pid", "fid", "x", "y", 5, F.lit(5.0))
    assert sorted((r["pid"], r["rank"], r["fid"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 2)]
    assert spatial.nearest(points, two.limit(0), "pid", "fid", "x", "y", 5, F.lit(5.0)).count() == 0
    assert spatial.nearest(points.limit(0), two, "pid", "fid", "x", "y", 5, F.lit(5.0)).count() == 0


def test_a_dense_place_costs_about_k(spark):
    """40 000 features within 100 metres: points in it, at its border and far away meet a few leaves each."""
    n = 40_000
    x, y = (F.lit(v) + F.rand(s) * 0.001 for v, s in ((-70.0, 1), (50.0, 2)))
    town = spark.range(n).select(F.col("id").alias("fid"), geo.point(x, y).alias("geom"))
    wide = spark.range(n, n + 2000).select(F.col("id").alias("fid"), geo.point(F.lit(-80.0) + F.rand(3) * 20, F.lit(45.0) + F.rand(4) * 15).alias("geom"))
    layer = pyramid.Pyramid(town.unionByName(wide), "fid")
    spots = [(-70.0 + 0.0005, 50.0005), (-69.9989, 50.0005), (-69.99, 50.01), (-69.0, 50.0), (-60.0, 45.0), (-70.0, 50.0)]
    points = spark.createDataFrame([(i, a, b, 500.0) for i, (a, b) in enumerate(spots)], "_who long, px double, py double, _max double")
    met = pyramid.candidates(points, layer, 5).join(layer.leaves, pyramid.CELL).groupBy("_who").count()
    counts = {r["_who"]: r["count"] for r in met.collect()}
    assert len(counts) == len(spots) and max(counts.values()) < 2500
    assert layer.leaves.count() == n + 2000 and layer.nodes.count() < n


def test_a_long_edge_is_not_copied_everywhere(spark):
    """Ten edges across the map beside 3 000 points: each lies in the leaves that it runs through, empty places keep large ones."""
    lines = [(i, shape("LINE", [(-80.0, 45.0 + i), (-60.0, 46.0 + i)])) for i in range(10)]
    rnd = random.Random(1)
    lines += [(100 + i, shape("POINT", [(-70 + rnd.random() / 50, 50 + rnd.random() / 50)])) for i in range(3000)]
    layer = pyramid.Pyramid(spark.createDataFrame(lines, SCHEMA), "fid")
    assert layer.leaves.filter("_f < 100").count() < 10 * 120

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import overlay, selfcross, spatial, split

SQUARE = ([-72.0, -71.99, -71.99, -72.0, -72.0], [45.0, 45.0, 45.01, 45.01, 45.0])


def shape(kind, *rings):
    return (kind, [(number, hole, list(map(float, xs)), list(map(float, ys))) for number, hole, xs, ys in rings])


def frame(spark, rows, key="gid"):
    df = spark.createDataFrame(rows, f"{key} long, geom {geo.GEOM_TYPE}")
    return geo.with_bounds(df)


def test_parcel_square_area_and_distance(spark):
    df = frame(spark, [(1, shape("POLYGON", (0, False, *SQUARE)))])
    g = F.col("geom")
    row = df.select(geo.area_m2(g).alias("a"), geo.point_distance_m(g, F.lit(-71.98), F.lit(45.005)).alias("d"),
                    geo.point_distance_m(g, F.lit(-71.995), F.lit(45.005)).alias("inside"), geo.num_points(g).alias("n")).first()
    assert row["a"] == pytest.approx(876_163, rel=1e-4) and row["n"] == 5 and row["inside"] == 0
    assert row["d"] == pytest.approx(math.radians(0.01) * math.cos(math.radians(45.005)) * 6371008.8, rel=1e-4)


def test_hole_is_outside_and_taken_off(spark):
    hole = ([0.25, 0.25, 0.75, 0.75, 0.25], [0.25, 0.75, 0.75, 0.25, 0.25])
    df = frame(spark, [(1, shape("POLYGON", (0, False, [0, 1, 1, 0, 0], [0, 0, 1, 1, 0]), (0, True, *hole)))])
    g = F.col("geom")
    row = df.select(geo.contains_point(g, F.lit(0.5), F.lit(0.5)).alias("mid"), geo.contains_point(g, F.lit(0.1), F.lit(0.5)).alias("edge"),
                    (geo.area_m2(g) / geo.box_area_m2(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).alias("share"), geo.interior_point(g).alias("p")).first()
    assert not row["mid"] and row["edge"] and row["share"] == pytest.approx(0.75, abs=1e-3)
    assert not (0.25 < row["p"]["x"] < 0.75 and 0.25 < row["p"]["y"] < 0.75)


def test_geojson_round_trip_of_every_kind(spark):
    texts = [
        '{"type":"Point","coordinates":[1.5,2.0]}', '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}',
        '{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]}', '{"type":"MultiLineString","coordinates":[[[0.0,0.0],[1.0,1.0]],[[2.0,2.0],[3.0,3.0]]]}',
        '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,5.0]]]]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = [r["b"] for r in df.select(geo.as_geojson(geo.from_geojson(F.col("t"))).alias("b")).collect()]
    assert sorted(back) == sorted(texts)
    z = spark.createDataFrame([('{"type":"Point","coordinates":[1.0,2.0,9.0]}',)], "t string")
    assert z.select(geo.as_geojson(geo.from_geojson(F.col("t"))).alias("b")).first()["b"] == '{"type":"Point","coordinates":[1.0,2.0]}'


def test_exact_bbox_test_is_tighter_than_bounds(spark):
    triangle = shape("POLYGON", (0, False, [0, 10, 0, 0], [0, 0, 10, 0]))
    df = frame(spark, [(1, triangle), (2, shape("LINE", (0, False, [0, 10], [0, 10])))])
    hits = lambda box: {r["gid"] for r in df.filter(geo.intersects_bbox(F.col("geom"), box)).collect()}
    assert hits((8, 8, 9, 9)) == {2} and hits((1, 1, 2, 2)) == {1, 2} and hits((4, 1, 5, 2)) == {1} and hits((20, 20, 21, 21)) == set()


def test_reprojection_known_points(spark):
    # the origin of the projection maps to (0, 0)
    for code, lon, lat in (("EPSG:32198", -68.5, 44.0), ("EPSG:3978", -95.0, 49.0)):
        x, y = geo.reproject_xy(F.lit(lon), F.lit(lat), "EPSG:4326", code)
        row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert abs(row["x"]) < 1e-6 and abs(row["y"]) < 1e-6
    with pytest.raises(ValueError):
        geo.reproject(F.lit(None), "", "EPSG:4326")


def brute_area(p, q, n=400):
    """Share of q's unit box covered by both polygons, by sampling (even-odd)."""
    def inside(ring, x, y):
        r = np.zeros(x.shape, bool)
        xs, ys = np.array(ring[0], float), np.array(ring[1], float)
        for i in range(len(xs) - 1):
            span = (ys[i] > y) != (ys[i + 1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                r ^= span & (x < xs[i] + (y - ys[i]) * (xs[i + 1] - xs[i]) / (ys[i + 1] - ys[i]))
        return r

    g = (np.arange(n) + 0.5) / n
    x, y = np.meshgrid(g, g)
    return (inside(p, x, y) & inside(q, x, y)).mean()


def test_overlay_of_concave_shapes_matches_sampling(spark):
    star = ([0.1, 0.5, 0.9, 0.6, 0.8, 0.5, 0.2, 0.4, 0.1], [0.1, 0.3, 0.1, 0.5, 0.9, 0.7, 0.9, 0.5, 0.1])
    comb = ([0.0, 1.0, 1.0, 0.7, 0.7, 0.3, 0.3, 0.0, 0.0], [0.2, 0.2, 0.8, 0.8, 0.4, 0.4, 0.8, 0.8, 0.2])
    a = frame(spark, [(1, shape("POLYGON", (0, False, *star)))])
    b = frame(spark, [(7, shape("POLYGON", (0, False, *comb)))], "sid")
    row = overlay.overlap_join(a, b, "gid", "sid", cell=0.25).first()
    unit = spark.range(1).select(geo.box_area_m2(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).first()[0]
    assert row["inter_area"] / unit == pytest.approx(brute_area(star, comb), abs=3e-3)
    back = overlay.overlap_join(b, a, "sid", "gid", cell=0.25).first()
    # clipping adds vertices on straight lon/lat edges, which bend the area by their curvature
    assert back["inter_area"] == pytest.approx(row["inter_area"], rel=1e-4)


def test_nearest_distance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    px, py = rng.uniform(-75, -70, 60), rng.uniform(45, 48, 60)
    fx, fy = np.concatenate([rng.uniform(-75, -70, 40), rng.normal(-72, 0.01, 200)]), np.concatenate([rng.uniform(45, 48, 40), rng.normal(46, 0.01, 200)])
    parcels = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(px, py))], "gid long, x double, y double")
    water = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(fx, fy))], "wid long, x double, y double")
    water = spatial.as_boxes(water.withColumn("geom", geo.point(F.col("x"), F.col("y"))))
    got = {r["gid"]: r["distance_m"] for r in spatial.nearest_distance(parcels, water, "gid", "wid", "x", "y", 30_000.0, 5).collect()}
    for i in range(60):
        order = np.argsort(np.hypot(fx - px[i], fy - py[i]))[:5]
        a = np.sin(np.radians(fy[order] - py[i]) / 2) ** 2 + np.cos(np.radians(py[i])) * np.cos(np.radians(fy[order])) * np.sin(np.radians(fx[order] - px[i]) / 2) ** 2
        best = (2 * 6371008.8 * np.arcsin(np.sqrt(a))).min()
        assert (got[i] is None) == (best > 30_000) and (got[i] is None or got[i] == pytest.approx(best, rel=1e-9))


def test_field_match_prefers_flagged_then_near(spark):
    box = lambda x: shape("POLYGON", (0, False, [x, x + 0.01, x + 0.01, x, x], [45.0, 45.0, 45.01, 45.01, 45.0]))
    parcel = frame(spark, [(1, box(-72.0))], "pid")
    fields = frame(spark, [(10, box(-71.989)), (11, box(-71.988)), (12, box(-71.995)), (13, box(-71.9))]).withColumn("flag", F.col("gid") == 11)
    rows = spatial.flag_then_distance(spatial.within_distance(parcel, fields, "pid", "gid", "flag", 200.0), "flag").collect()
    assert [r["gid"] for r in rows] == [11, 12, 10] and rows[1]["dist_m"] == 0


def test_bbox_join_with_salted_hot_cell(spark):
    points = spatial.as_boxes(spark.range(500).select(F.col("id").alias("pid"), (F.col("id") % 10 / 100.0).alias("x"), F.lit(0.05).alias("y")))
    zones = frame(spark, [(1, shape("POLYGON", (0, False, [0, 0.05, 0.05, 0, 0], [0, 0, 0.1, 0.1, 0])))])
    from loamframe.operators import skew

    plain = spatial.bbox_join(points, zones, "pid", "gid").count()
    original, skew.small = skew.small, lambda *_: False
    try:
        salted = spatial.bbox_join(points, zones, "pid", "gid", hot_rows=20).count()
    finally:
        skew.small = original
    assert plain == salted == 300


def test_split_keeps_area_holes_and_attributes(spark):
    t = np.linspace(0, 2 * np.pi, 401)
    t[-1] = 0
    outer = (np.cos(t).tolist(), np.sin(t).tolist())
    hole = ((0.3 * np.cos(-t)).tolist(), (0.3 * np.sin(-t)).tolist())
    df = frame(spark, [(1, shape("POLYGON", (0, False, *outer), (0, True, *hole))), (2, shape("POLYGON", (0, False, *SQUARE)))]).withColumn("name", F.concat(F.lit("n"), "gid"))
    pieces = split.split_large(df, ["gid"], max_vertices=150).cache()
    assert pieces.agg(F.max(geo.num_points(F.col("geom")))).first()[0] <= 150
    before = df.agg(F.sum(geo.area_m2(F.col("geom")))).first()[0]
    assert pieces.agg(F.sum(geo.area_m2(F.col("geom")))).first()[0] == pytest.approx(before, rel=1e-9)
    assert pieces.filter(geo.contains_point(F.col("geom"), F.lit(0.05), F.lit(0.05))).isEmpty()
    assert pieces.filter(geo.contains_point(F.col("geom"), F.lit(0.6), F.lit(0.1))).count() == 1
    assert sorted(r["gid"] for r in pieces.collect()) == list(range(1, pieces.count() + 1))
    assert {(r["split_source_gid"], r["name"]) for r in pieces.collect()} == {(1, "n1"), (2, "n2")}
    assert split.split_large(df, ["gid"], max_vertices=5000).columns == df.columns


def test_self_intersection_found(spark):
    bow = shape("POLYGON", (0, False, [0, 1, 0, 1, 0], [0, 1, 1, 0, 0]))
    df = frame(spark, [(1, bow), (2, shape("POLYGON", (0, False, *SQUARE)))])
    assert [r["gid"] for r in selfcross.self_intersecting(df, "gid", cell=0.5).collect()] == [1]


def test_overlapping_pairs_both_directions(spark):
    box = lambda x: shape("POLYGON", (0, False, [x, x + 1, x + 1, x, x], [0, 0, 1, 1, 0]))
    df = frame(spark, [(1, box(0)), (2, box(0.5)), (3, box(5))])
    assert {(r["id_a"], r["id_b"]) for r in spatial.overlapping_pairs(df, "gid").collect()} == {(1, 2), (2, 1)}


def test_ambiguous_ids_resolved_by_offset_then_elimination(spark):
    pairs = [(1, 11), (2, 12), (2, 13), (3, 13), (3, 12), (4, 14), (7, 30), (7, 14)]
    rows = spatial.resolve_ambiguous(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    got = {r["a"]: (r["b"], r["method"]) for r in rows}
    assert got == {1: (11, "unique"), 4: (14, "unique"), 2: (12, "block_offset"), 3: (13, "block_offset"), 7: (30, "elimination")}

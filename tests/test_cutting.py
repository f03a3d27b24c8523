"""Cutting polygons and telling crossing rings from touching ones, on shapes made for each case."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.operators import cutting, selfcross, split

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
U = [(0, 0), (6, 0), (6, 9), (4, 9), (4, 2), (2, 2), (2, 9), (0, 9), (0, 0)]


def ring(points):
    return np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)


def points_of(polygons):
    return {(x, y) for rings in polygons for xs, ys in rings for x, y in zip(xs.tolist(), ys.tolist())}


def area(polygons):
    return sum(abs(cutting.signed_area(*r)) * (-1 if k else 1) for rings in polygons for k, r in enumerate(rings))


def cut(rings, axis, at):
    made = [ring(r) for r in rings]
    return cutting.half(made, axis, at, True), cutting.half(made, axis, at, False)


def test_a_u_gives_two_polygons():
    low, high = cut([U], 1, 4.5)
    assert len(low) == 1 and len(high) == 2 and all(len(p) == 1 for p in high)
    assert sorted(area([p]) for p in high) == [9.0, 9.0] and area(low) == 54 - 14 - 18


def test_a_hole_on_the_line_joins_the_shell():
    low, high = cut([SQUARE, [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]], 0, 2)
    assert [len(p) for p in low + high] == [1, 1] and area(low) == area(high) == 6


def test_a_hole_that_touches_the_line_stays_a_hole():
    hole = [(2, 2), (1, 1), (1, 3), (2, 2)]
    low, high = cut([SQUARE, hole], 0, 2)
    assert [len(p) for p in low] == [2] and area(low) == 7 and [len(p) for p in high] == [1] and area(high) == 8


def test_a_notch_that_touches_the_line_parts_the_piece():
    low, high = cut([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 3), (2, 2), (0, 1), (0, 0)]], 0, 2)
    assert len(low) == 2 and area(low) == 6 and len(high) == 1


def test_an_edge_along_the_line_keeps_its_vertices():
    shape = [[(0, 0), (2, 0), (2, 1), (2, 2), (2, 3), (4, 3), (4, 5), (0, 5), (0, 0)]]
    low, high = cut(shape, 0, 2)
    assert points_of([[ring(shape[0])]]) <= points_of(low + high) and area(low + high) == 14


def test_holes_go_to_their_shells():
    small = lambda x: [(x + 0.2, 0.2), (x + 0.2, 0.4), (x + 0.4, 0.4), (x + 0.4, 0.2), (x + 0.2, 0.2)]
    comb = [(0, 0), (1, 0), (1, 2), (2, 2), (2, 0), (3, 0), (3, 3), (0, 3), (0, 0)]
    low, _ = cut([comb, small(0), small(2)], 1, 1.5)
    assert sorted(len(p) for p in low) == [2, 2] and area(low) == pytest.approx(3 - 0.08)
    assert all(cutting.inside_ring(p[0], *[float(v.mean()) for v in p[1]]) for p in low)


def test_crossing_rings_are_refused():
    with pytest.raises(cutting.CrossingRings):
        cut([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(2, 2), (2, 6), (3, 6), (3, 2), (2, 2)]], 1, 5)


def polyomino(rnd, n):
    """Rings of a random union of unit cells without corner contacts, or None."""
    cells = {(0, 0)}
    while len(cells) < n:
        x, y = rnd.choice(sorted(cells))
        dx, dy = rnd.choice([(1, 0), (-1, 0), (0, 1), (0, -1)])
        cells.add((x + dx, y + dy))
    nxt = {}
    for x, y in cells:
        corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        for k, beside in enumerate([(x, y - 1), (x + 1, y), (x, y + 1), (x - 1, y)]):
            if beside not in cells:
                if corners[k] in nxt:
                    return None
                nxt[corners[k]] = corners[(k + 1) % 4]
    rings = []
    while nxt:
        path = [next(iter(nxt))]
        while path[-1] in nxt:
            path.append(nxt.pop(path[-1]))
        rings.append(ring(path))
    return len(cells), [r for r in rings if cutting.signed_area(*r) > 0] + [r for r in rings if cutting.signed_area(*r) < 0]


def test_random_shapes_lose_nothing():
    """Cuts through, beside and along edges: area and vertices stay, rings stay simple."""
    rnd, tried = random.Random(5), 0
    while tried < 150:
        made = polyomino(rnd, rnd.randint(2, 70))
        if not made:
            continue
        tried += 1
        cells, rings = made
        for at in (float(rnd.randint(-3, 3)), rnd.uniform(-3, 3)):
            for axis in (0, 1):
                parts = [*cutting.half(rings, axis, at, True), *cutting.half(rings, axis, at, False)]
                assert area(parts) == pytest.approx(cells, abs=1e-9) and points_of([rings]) <= points_of(parts)
                for polygon in parts:
                    for xs, ys in polygon:
                        corners = list(zip(xs.tolist(), ys.tolist()))[:-1]
                        assert len(set(corners)) == len(corners)
        groups = cutting.halve([rings], 14, 48)
        assert sum(map(area, groups)) == pytest.approx(cells) and max(map(cutting.vertices, groups)) <= 14


def shape(*parts):
    return {"kind": "POLYGON", "parts": [{"part": n, "hole": hole, "xs": [float(p[0]) for p in xy], "ys": [float(p[1]) for p in xy]} for n, hole, xy in parts]}


def disc(x, y, n, radius=1.0):
    return [(x + radius * math.cos(2 * math.pi * (k % n) / n), y + radius * math.sin(2 * math.pi * (k % n) / n)) for k in range(n + 1)]


def layer(spark, shapes, schema=f"gid long, name string, geom {geo.GEOM_TYPE}"):
    return spark.createDataFrame([(g, f"n{g}", s) for g, s in shapes], schema)


def test_pieces_of_polygons_and_of_multipolygons(spark):
    teeth = [(0, 0)] + [p for k in range(30) for p in ((k, 0), (k + 0.4, 0), (k + 0.4, 5), (k + 0.6, 5), (k + 0.6, 0), (k + 1, 0))][1:] + [(30, 0), (30, -1), (0, -1), (0, 0)]
    teeth = teeth[::-1]
    df = layer(spark, [(1, shape((0, False, teeth))), (2, shape((0, False, disc(0, 20, 300)), (1, False, disc(3, 20, 300)))), (3, shape((0, False, SQUARE))), (4, None)])
    pieces = split.split_large(df, ["gid"], max_vertices=40)
    rows = pieces.collect()
    assert sorted(r["gid"] for r in rows) == list(range(1, len(rows) + 1))
    by = {g: [r for r in rows if r["split_source_gid"] == g] for g in (1, 2, 3, 4)}
    assert [sorted(r["split_part"] for r in by[g]) for g in (1, 2)] == [list(range(1, len(by[1]) + 1)), list(range(1, len(by[2]) + 1))]
    assert all(len({p["part"] for p in r["geom"]["parts"]}) == 1 for r in by[1]) and len(by[1]) >= 8
    assert any(len({p["part"] for p in r["geom"]["parts"]}) == 2 for r in by[2]) or len(by[2]) > 2
    assert by[4][0]["geom"] is None and by[4][0]["split_part"] == 1 and {r["name"] for r in by[2]} == {"n2"}
    assert pieces.filter(geo.num_points(F.col("geom")) > 40).isEmpty()
    for g in (1, 2):
        before = df.filter(F.col("gid") == g).select(geo.area_m2(F.col("geom"))).first()[0]
        after = pieces.filter(F.col("split_source_gid") == g).agg(F.sum(geo.area_m2(F.col("geom")))).first()[0]
        assert after == pytest.approx(before, rel=1e-9)
    assert selfcross.self_intersecting(pieces, "gid").isEmpty()


def test_report_of_a_split(spark):
    crossing = shape((0, False, disc(0, 0, 200)), (0, True, [(x, y) for x, y in disc(0, 1, 60, 0.5)][::-1]))
    df = layer(spark, [(1, shape((0, False, disc(0, 0, 500)))), (2, shape((0, False, SQUARE))), (3, crossing)])
    report = {r["gid"]: r for r in split.split_report(df, 100).collect()}
    assert set(report) == {1, 3} and report[1]["event"] == "feature_split" and report[1]["largest_piece"] <= 100 and report[1]["vertices"] == 501
    assert report[3]["event"] == "feature_split_incomplete" and report[3]["parts"] >= 1
    guarded = {r["gid"]: r for r in split.split_report(df, 100, max_depth=1).collect()}
    assert guarded[1]["event"] == "feature_split_incomplete" and guarded[1]["largest_piece"] > 100 and guarded[1]["parts"] == 2
    taken = df.withColumn(codes.SPLIT_PART_COLUMN, F.lit("mine"))
    assert {r["reason"] for r in split.split_report(taken, 100).collect()} == {"column_conflict"}
    assert split.split_large(taken, ["gid"], 100).columns == taken.columns


def test_a_quarter_of_a_million_vertices(spark):
    df = layer(spark, [(1, shape((0, False, disc(0, 0, 250_000))))])
    rows = split.split_report(df).collect()
    assert rows[0]["event"] == "feature_split" and rows[0]["parts"] >= 3 and rows[0]["largest_piece"] <= codes.SPLIT_MAX_VERTICES


BAD = {
    "hole half outside, through vertices on the shell": shape((0, False, SQUARE), (0, True, [(2, 2), (4, 1), (6, 2), (4, 3), (2, 2)])),
    "parts cross through shared vertices": shape((0, False, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), (1, False, [(1, 1), (2, 0), (3, 1), (2, 2), (1, 1)])),
    "an edge passes through another ring's vertex into it": shape((0, False, SQUARE), (1, False, [(4, 4), (2, 2), (6, 2), (4, 4)])),
    "bow tie": shape((0, False, [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])),
    "edge along the shell": shape((0, False, SQUARE), (0, True, [(0, 1), (0, 3), (1, 2), (0, 1)])),
    "a spike": shape((0, False, [(0, 0), (4, 0), (4, 4), (2, 4), (2, 8), (2, 4), (0, 4), (0, 0)])),
    "a ring that touches itself": shape((0, False, [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)])),
}
GOOD = {
    "hole touches the shell inside an edge": shape((0, False, SQUARE), (0, True, [(0, 2), (1, 1), (1, 3), (0, 2)])),
    "hole touches at a vertex of the shell": shape((0, False, [(0, 0), (4, 0), (4, 2), (4, 4), (0, 4), (0, 0)]), (0, True, [(2, 2), (3, 3), (4, 2), (3, 1), (2, 2)])),
    "parts share a corner": shape((0, False, SQUARE), (1, False, [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)])),
    "a part touches an edge from outside": shape((0, False, SQUARE), (1, False, [(4, 2), (6, 1), (6, 3), (4, 2)])),
    "three holes meet in a point": shape((0, False, [(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)]), *[
        (0, True, [(0, 0), *[(5 * math.cos(t), 5 * math.sin(t)) for t in (a + 0.5, a)], (0, 0)]) for a in (0.1, 2.1, 4.1)]),
    "nested at a corner": shape((0, False, [(0, 0), (8, -8), (8, 8), (0, 0)]), (0, True, [(0, 0), (5, 2), (5, -2), (0, 0)]), (1, False, [(0, 0), (-3, 1), (-3, -1), (0, 0)])),
    "a plain square": shape((0, False, SQUARE)),
}


@pytest.mark.parametrize("cell", [None, 0.5, 100.0])
def test_crossing_and_touching_rings(spark, cell):
    shapes = list(enumerate([*BAD.values(), *GOOD.values()], start=1))
    got = {r["gid"] for r in selfcross.self_intersecting(layer(spark, shapes), "gid", cell=cell).collect()}
    assert got == set(range(1, len(BAD) + 1))


def test_edges_meet_those_of_their_own_polygon_only(spark):
    """Copies of one shape at one place: each is judged alone; an owner's rows grow with its edges, long edges included."""
    star = shape((0, False, disc(0, 0, 2000) + []))
    fan = shape((0, False, [(0, 0), (1000, 0), (1000, 1), *[(1000 - k / 2, 1 + (k % 2) / 10) for k in range(1, 2000)], (0, 1), (0, 0)]))
    df = layer(spark, [(g, star) for g in range(1, 40)] + [(40, fan)])
    assert selfcross.self_intersecting(df, "gid").isEmpty()
    edges = selfcross.ring_edges(df, "gid")
    counts = edges.groupBy("_own").count().join(selfcross.in_cells(edges).groupBy("_own").agg(F.count("*").alias("rows")), "_own")
    assert counts.filter("rows > 6 * count").isEmpty()

"""Box joins on nested levels and polygons in bands, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import skew, spatial

BOXES = "{0} long, minx double, miny double, maxx double, maxy double, note_{0} string"


def boxes(rng, n, prefix):
    """Boxes from points to half the world, many of them in one place, with edges on cell borders."""
    rows = []
    for i in range(n):
        size = rng.choice([0.0, 0.0, 0.001, 0.25, 0.5, 1.0, 7.3, 120.0])
        x = rng.choice([0.0, 0.5, -72.0, rng.uniform(-180, 180), -71.9 + rng.random() / 50])
        y = rng.choice([0.0, -0.25, 45.0, rng.uniform(-80, 80), 45.1 + rng.random() / 50])
        rows.append((i, x, y, x + size, y + size * rng.choice([1.0, 0.1]), f"{prefix}{i}"))
    return rows + [(n, None, 0.0, 1.0, 1.0, "null"), (n + 1, float("nan"), 0.0, 1.0, 1.0, "nan"),
                   (n + 2, 0.0, 0.0, float("inf"), 1.0, "endless"), (n + 3, 2.0, 0.0, 1.0, 1.0, "reversed")]


def finite_box(r):
    return r[1] is not None and all(math.isfinite(v) for v in r[1:5]) and r[1] <= r[3] and r[2] <= r[4]


@pytest.mark.parametrize("settings", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 20}, {"cell": 0.5}])
def test_pairs_equal_all_pairs(spark, settings):
    rng = random.Random(11)
    a, b = boxes(rng, 160, "a"), boxes(rng, 140, "b")
    left, right = (spark.createDataFrame(rows, BOXES.format(key)) for rows, key in ((a, "p"), (b, "q")))
    got = spatial.bbox_join(left, right, "p", "q", ["note_p"], ["note_q"], **settings).collect()
    wanted = {(r[0], s[0]) for r in a for s in b if finite_box(r) and finite_box(s)
              and r[1] <= s[3] and r[3] >= s[1] and r[2] <= s[4] and r[4] >= s[2]}
    assert len(got) == len(wanted) and {(r["p"], r["q"]) for r in got} == wanted
    assert all(r["note_p"] == f"a{r['p']}" and r["note_q"] == f"b{r['q']}" for r in got)


def test_empty_sides_give_an_empty_result(spark):
    some = spark.createDataFrame(boxes(random.Random(1), 5, "a"), BOXES.format("p"))
    none = spark.createDataFrame([], BOXES.format("q"))
    assert spatial.bbox_join(some, none, "p", "q", [], ["note_q"]).collect() == []
    assert spatial.bbox_join(none, some, "q", "p").columns == ["q", "p"]


def test_a_huge_box_is_not_copied_to_small_cells(spark):
    """A box of half the world and a thousand points: four cells for the box, one for each point."""
    world = spark.createDataFrame([(1, -170.0, -80.0, 170.0, 80.0, "w")], BOXES.format("q"))
    points = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") / 10.0).alias("x"), F.lit(1.0).alias("y"))
    a = spatial._side(spatial.as_boxes(points), "a", "p", [], spatial.FINEST_CELL)
    b = spatial._side(world, "b", "q", ["note_q"], spatial.FINEST_CELL)
    assert [r["_level"] for r in b.select("_level").collect()] == [9]
    assert [r["_level"] for r in a.select("_level").distinct().collect()] == [-20]
    meets = spatial._levels([9], 0)
    assert spatial._entries(b, "b", meets, "right").count() == 4 and spatial._entries(a, "a", meets, "left").count() == 1000
    assert spatial.bbox_join(spatial.as_boxes(points), world, "p", "q").count() == 1000


def test_keys_hot_on_both_sides_are_spread(spark):
    left = spark.range(300).select(F.col("id").alias("l"), F.lit(1).alias("k"))
    right = spark.range(200).select(F.col("id").alias("r"), F.lit(1).alias("k"))
    joined = skew.salted_join(left, right, ["k"], F.col("l"), hot_rows=50, spread_right=F.col("r"))
    assert joined.count() == 60_000 and joined.distinct().count() == 60_000 and set(joined.columns) == {"k", "l", "r"}
    with pytest.raises(ValueError):
        skew.salted_join(left, right, ["k"], F.col("l"), how="left", spread_right=F.col("r"))


def test_row_bytes_grow_with_what_a_row_holds(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0], None), ("", [], "x" * 100)], "s string, v array<double>, t string")
    assert [r[0] for r in df.select(skew.row_bytes(df, ["s", "v", "t"])).collect()] == [19, 100]


def ring(rng, n, cx, cy, radius):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    far = [radius * rng.uniform(0.4, 1.0) for _ in turns]
    xs, ys = [cx + r * math.cos(t) for r, t in zip(far, turns)], [cy + r * math.sin(t) for r, t in zip(far, turns)]
    return xs + xs[:1], ys + ys[:1]


def test_bands_answer_as_whole_polygons(spark):
    """Stars of many vertices with a hole, some rows repeated, one id with two shapes; points on vertices and edges as well."""
    rng = random.Random(5)
    rows = []
    for gid in range(6):
        cx, cy = rng.uniform(-2, 2), rng.uniform(-2, 2)
        outer, hole = ring(rng, 400, cx, cy, 3.0), ring(rng, 60, cx, cy, 0.8)
        rows.append((gid, ("POLYGON", [(0, False, *outer), (0, True, *hole)]), f"n{gid}"))
    square = ([-1.0, 1.0, 1.0, -1.0, -1.0], [-1.0, -1.0, 1.0, 1.0, -1.0])
    rows += [rows[0], (1, rows[2][1], "other shape"), (9, ("POLYGON", [(0, False, *square)]), "small"), (10, None, "none"),
             (11, ("LINESTRING", [(0, False, *ring(rng, 300, 0, 0, 2.0))]), "line")]
    layer = geo.with_bounds(spark.createDataFrame(rows, f"gid long, geom {geo.GEOM_TYPE}, name string"))
    places = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(600)]
    places += [(600 + i, rows[0][1][1][0][2][i], rows[0][1][1][0][3][i]) for i in range(40)] + [(700, None, 1.0), (701, 0.0, 1.0), (702, 1.0, -1.0)]
    points = spark.createDataFrame(places, "pid long, x double, y double")
    whole = spatial.spatial_join(layer, points, "gid", "pid", ["name"], band_points=10**9)
    bands = spatial.spatial_join(layer, points, "gid", "pid", ["name"], band_points=32)
    assert whole.columns == bands.columns
    wanted = sorted(map(tuple, whole.collect()), key=repr)
    assert sorted(map(tuple, bands.collect()), key=repr) == wanted and len(wanted) > 500


def test_a_band_holds_few_edges(spark):
    rng = random.Random(3)
    layer = geo.with_bounds(spark.createDataFrame([(1, ("POLYGON", [(0, False, *ring(rng, 20_000, 0, 0, 3.0))]))], f"gid long, geom {geo.GEOM_TYPE}"))
    bands = spatial.polygon_bands(layer, "gid").select(F.size("_edges").alias("n")).agg(F.max("n"), F.count("*"), F.avg("n")).first()
    assert bands[1] > 100 and bands[0] < 20_000 / 5, bands

"""Polygons whose rings cross or overlap, found by joining edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamframe.functions.geometry import _orient

_ENDS = ("x1", "y1", "x2", "y2")


def ring_edges(df: DataFrame, identity: str, geom: str = "geom") -> DataFrame:
    """One row per edge: owner, ring, edge number, number of edges of its ring, end points."""
    rings = df.filter(F.col(f"{geom}.kind") == "POLYGON").select(F.col(identity).alias("_own"), F.posexplode(f"{geom}.parts").alias("_ring", "_p"))
    n = F.greatest(F.size("_p.xs") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice("_p.xs", 1, n).alias("x1"), F.slice("_p.ys", 1, n).alias("y1"),
                          F.slice("_p.xs", 2, n).alias("x2"), F.slice("_p.ys", 2, n).alias("y2"))
    moving = F.filter(zipped, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))  # a repeated vertex is no edge
    edges = rings.select("_own", "_ring", moving.alias("_edges"))
    return edges.select("_own", "_ring", F.size("_edges").alias("_n"), F.posexplode("_edges").alias("_e", "_xy")).select("_own", "_ring", "_n", "_e", "_xy.*")


def in_cells(edges: DataFrame, cell: float | None = None) -> DataFrame:
    """Edges in the cells that they run through, of a grid as wide as their owner's mean edge (or as ``cell``).

    So an owner of n edges has a few n rows, whatever its size and however long some of its edges are.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    if cell:
        stepped = edges.withColumn("_step", F.lit(float(cell)))
    else:
        mean = edges.groupBy("_own").agg(F.avg(length).alias("_mean"))
        # a power of two: cell borders are exact
        step = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("_mean", F.lit(1e-12)))))
        # asked for by name: Spark takes exploded rows for no larger than the rows that they come from, and would broadcast them
        stepped = edges.join(mean.hint("merge"), "_own").withColumn("_step", step).drop("_mean")
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    column = lambda c: F.floor(c / F.col("_step")).cast("long")
    columns = stepped.withColumn("_cx", F.explode(F.sequence(column(low), column(high))))
    # the rows that the edge can touch inside the column, one more on each side against rounding
    left, right = F.greatest(low, F.col("_cx") * F.col("_step")), F.least(high, (F.col("_cx") + 1) * F.col("_step"))
    at = lambda x: F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    flat = F.col("x1") == F.col("x2")
    ya, yb = F.when(flat, F.col("y1")).otherwise(at(left)), F.when(flat, F.col("y2")).otherwise(at(right))
    slack = F.col("_step") * 1e-6 + (F.abs("y1") + F.abs("y2")) * 1e-15
    bottom = F.greatest(F.least(ya, yb) - slack, F.least("y1", "y2"))
    top = F.least(F.greatest(ya, yb) + slack, F.greatest("y1", "y2"))
    return columns.withColumn("_cy", F.explode(F.sequence(column(F.least(bottom, top)), column(F.greatest(bottom, top))))).drop("_step")


def with_sides(pairs: DataFrame) -> DataFrame:
    """Pairs of edges that share a point, with the side of each end point against the other edge's line (o1 .. o4).

    The sides come out of a generator, so that Spark does not write their arithmetic out again wherever they are used.
    """
    a, b, c, d = [(F.col(f"a{x}"), F.col(f"a{y}")) for x, y in (("x1", "y1"), ("x2", "y2"))] + [(F.col(f"b{x}"), F.col(f"b{y}")) for x, y in (("x1", "y1"), ("x2", "y2"))]
    boxes = (F.least(a[0], b[0]) <= F.greatest(c[0], d[0])) & (F.least(c[0], d[0]) <= F.greatest(a[0], b[0])) & (
        F.least(a[1], b[1]) <= F.greatest(c[1], d[1])) & (F.least(c[1], d[1]) <= F.greatest(a[1], b[1]))
    sides = {"o1": _orient(*a, *b, *c), "o2": _orient(*a, *b, *d), "o3": _orient(*c, *d, *a), "o4": _orient(*c, *d, *b)}
    sided = pairs.filter(boxes).select("*", F.inline(F.array(F.struct(*[F.signum(v).alias(k) for k, v in sides.items()]))))
    return sided.filter("o1 * o2 <= 0 AND o3 * o4 <= 0")


#: Edges cross inside both, or lie on one line and share more than a point of it.
_CROSS_OR_OVERLAP = """(o1 * o2 < 0 AND o3 * o4 < 0) OR (o1 = 0 AND o2 = 0 AND greatest(
  least(greatest(ax1, ax2), greatest(bx1, bx2)) - greatest(least(ax1, ax2), least(bx1, bx2)),
  least(greatest(ay1, ay2), greatest(by1, by2)) - greatest(least(ay1, ay2), least(by1, by2))) > 0)"""

#: End points of either edge that lie on the other one, for edges that share a point but not a line.
_SHARED_ENDS = """array_distinct(array_compact(array(
  IF(o1 = 0 AND bx1 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by1 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2), struct(bx1 AS x, by1 AS y), NULL),
  IF(o2 = 0 AND bx2 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by2 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2), struct(bx2 AS x, by2 AS y), NULL),
  IF(o3 = 0 AND ax1 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay1 BETWEEN least(by1, by2) AND greatest(by1, by2), struct(ax1 AS x, ay1 AS y), NULL),
  IF(o4 = 0 AND ax2 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay2 BETWEEN least(by1, by2) AND greatest(by1, by2), struct(ax2 AS x, ay2 AS y), NULL))))"""


def crossing_at_points(touches: DataFrame) -> DataFrame:
    """Owners (``_own``) with two rings that change sides at a shared point.

    ``touches`` has an owner, a point (px, py), a ring and one of its edges (x1 .. y2) through the point.  Each ring leaves the
    point in two directions.  In angular order rings that only touch are nested like brackets: between the two directions of
    a ring every other ring has both of its own or none, and a sum of signatures over that sector comes out as zero.
    """
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    away = F.filter(ends, lambda e: (e["x"] != F.col("px")) | (e["y"] != F.col("py")))
    rays = touches.select("_own", "px", "py", "_ring", F.explode(away).alias("_to")).select(
        "_own", "px", "py", "_ring", F.atan2(F.col("_to.y") - F.col("py"), F.col("_to.x") - F.col("px")).alias("_angle")).distinct()
    point = ["_own", "px", "py"]
    so_far = Window.partitionBy(*point).orderBy("_angle", "_ring").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signed = rays.withColumn("_sum", F.bit_xor(F.xxhash64(F.lit("ring"), "_ring")).over(so_far))
    # the sums before the first and after the second direction of a ring agree if the sector between holds whole rings only
    own = F.xxhash64(F.lit("ring"), "_ring")
    sectors = signed.groupBy(*point, "_ring").agg(F.min(F.struct("_angle", F.col("_sum").bitwiseXOR(own).alias("s"))).alias("_a"), F.max(F.struct("_angle", F.col("_sum").alias("s"))).alias("_b"))
    return sectors.filter(F.col("_a.s") != F.col("_b.s")).select("_own").distinct()


def self_intersecting(df: DataFrame, identity: str, geom: str = "geom", cell: float | None = None) -> DataFrame:
    """Ids of polygons with two edges that cross or overlap, a ring that touches itself, or rings that cross at a shared point.

    Different rings may meet in single points as long as neither changes sides there: a hole touches its shell, two parts share a
    corner.  Edges meet only those of their own polygon.
    """
    edges = in_cells(ring_edges(df, identity, geom), cell)
    key = ["_own", "_cx", "_cy"]
    a = edges.select(*key, F.struct("_ring", "_e").alias("ea"), F.col("_n").alias("na"), *[F.col(c).alias(f"a{c}") for c in _ENDS])
    b = edges.select(*key, F.struct("_ring", "_e").alias("eb"), *[F.col(c).alias(f"b{c}") for c in _ENDS])
    met = a.join(b.hint("merge"), key).filter(F.col("ea") < F.col("eb"))  # not a broadcast of all edges, as in in_cells
    gap, same_ring = F.col("eb._e") - F.col("ea._e"), F.col("ea._ring") == F.col("eb._ring")
    neighbours = same_ring & ((gap == 1) | (gap == F.col("na") - 1))
    # neighbours share their common end, but must not run back over each other; other edges of a ring share nothing
    wrong = F.expr(_CROSS_OR_OVERLAP)
    shared = F.when(~same_ring, F.expr(_SHARED_ENDS))
    found = F.struct((wrong | (same_ring & ~neighbours)).alias("_bad"), shared.alias("_points"))
    judged = with_sides(met).select("*", F.inline(F.array(found))).filter(F.col("_bad") | (F.size("_points") > 0))
    sure = judged.filter("_bad").select("_own")
    at = judged.filter(~F.col("_bad")).withColumn("_point", F.explode("_points"))
    side = lambda s: at.select("_own", F.col("_point.x").alias("px"), F.col("_point.y").alias("py"), F.col(f"e{s}._ring").alias("_ring"),
                               *[F.col(f"{s}{c}").alias(c) for c in _ENDS])
    return sure.unionByName(crossing_at_points(side("a").unionByName(side("b")))).distinct().withColumnRenamed("_own", identity)

"""Nearest features through a pyramid of cells, each level a quarter as wide as the last.

Features are pieces: their points or edges.  A cell with more than ``CROWDED`` pieces is split into sixteen, so dense places get
small cells and empty ones large cells.  A point starts at the smallest cell around it that holds k features, which bounds how
far its k nearest can be.  From there its search goes down: of the cells in reach, one that holds k features brings the bound
down to its far corner, and cells beyond the bound are left.  Ids and cells are joined, geometries only after ranking.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loamframe.functions import geometry as geo
from loamframe.session import durable

#: Width of the cells of level 0 in coordinate units, pieces that a cell keeps, and the last level.
TOP, CROWDED, LAST = 256.0, 32, 13
CELL = ["z", "cx", "cy"]
#: Bounds are wider by this much, so that features whose distances tie to nine decimals are all met.
TIE = 2e-9


def width(z: Column | int) -> Column:
    return F.lit(TOP) * F.pow(F.lit(4.0), -(F.lit(z) if isinstance(z, int) else z))


def pieces_of(features: DataFrame, feature_id: str, geom: str = "geom") -> DataFrame:
    """(``_f``, x1, y1, x2, y2): every edge of a line or ring, every point as an edge of no length."""
    parts = features.select(F.col(feature_id).alias("_f"), F.explode(F.col(f"{geom}.parts")).alias("_p"))
    n = F.size("_p.xs")
    edges = F.arrays_zip(F.slice("_p.xs", 1, n - 1).alias("x1"), F.slice("_p.ys", 1, n - 1).alias("y1"),
                         F.slice("_p.xs", 2, n - 1).alias("x2"), F.slice("_p.ys", 2, n - 1).alias("y2"))
    alone = F.arrays_zip(*[F.col(f"_p.{c}s").alias(f"{c}{k}") for k in (1, 2) for c in "xy"])
    return parts.filter(n > 0).select("_f", F.inline(F.when(n > 1, edges).otherwise(alone)))


def _in_children(rows: DataFrame, z: int) -> DataFrame:
    """Pieces in the cells of level ``z`` that they run through, inside their cell of the level before (cx, cy) if they have one."""
    size = TOP * 4.0**-z
    low = lambda c: F.floor(F.least(f"{c}1", f"{c}2") / size).cast("long")
    high = lambda c: F.floor(F.greatest(f"{c}1", f"{c}2") / size).cast("long")
    inside = "cx" in rows.columns
    for c in ("x", "y"):
        first, last = low(c), high(c)
        if inside:
            first, last = F.greatest(first, F.col(f"c{c}") * 4), F.least(last, F.col(f"c{c}") * 4 + 3)
        steps = F.when(first <= last, F.sequence(first, last))
        rows = rows.withColumn(f"_n{c}", F.explode(steps))
    slack = size * 1e-9
    box = [F.col("_nx") * size - slack, F.col("_ny") * size - slack, (F.col("_nx") + 1) * size + slack, (F.col("_ny") + 1) * size + slack]
    hits = geo._segment_hits_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), box)
    straight = (F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))
    kept = rows.filter(straight | hits)
    return kept.select("_f", "x1", "y1", "x2", "y2", F.col("_nx").alias("cx"), F.col("_ny").alias("cy"))


class Pyramid:
    """Stored tables of a feature layer: ``nodes`` (z, cx, cy, features, leaf) and the pieces of its ``leaves``."""

    def __init__(self, features: DataFrame, feature_id: str, geom: str = "geom", crowded: int = CROWDED, last: int = LAST):
        pieces = durable(pieces_of(features, feature_id, geom))
        about = pieces.agg(F.count("*").alias("n"), *[f(f"{c}1").alias(f"{c}_{f.__name__}") for c in "xy" for f in (F.min, F.max)]).first()
        self.first = self._start(about, crowded, last) if about["n"] else 0
        placed = durable(_in_children(pieces, self.first))
        # coarser levels only say how many features a cell holds
        up = [F.struct(F.lit(z).alias("z"), *[F.floor(F.col(c) / 4 ** (self.first - z)).cast("long").alias(c) for c in ("cx", "cy")]) for z in range(self.first)]
        nodes, leaves = [], []
        if up:
            above = placed.select("_f", F.inline(F.array(*up))).distinct().groupBy(*CELL).agg(F.count("*").alias("features"))
            nodes.append(durable(above.withColumn("leaf", F.lit(False))))
        for z in range(self.first, last + 1):
            each = placed.groupBy("cx", "cy", "_f").agg(F.count("*").alias("m"))
            counts = durable(each.groupBy("cx", "cy").agg(F.count("*").alias("features"), (F.sum("m") <= crowded).alias("leaf")))
            if z == last:
                counts = counts.withColumn("leaf", F.lit(True))
            nodes.append(counts.select(F.lit(z).alias("z"), "cx", "cy", "features", "leaf"))
            own = placed.join(counts.filter("leaf").select("cx", "cy"), ["cx", "cy"], "left_semi")
            leaves.append(durable(own.select(F.lit(z).alias("z"), "cx", "cy", "_f", "x1", "y1", "x2", "y2")))
            dense = counts.filter("NOT leaf").select("cx", "cy")
            if z == last or dense.isEmpty():
                break
            placed = durable(_in_children(placed.join(dense, ["cx", "cy"], "left_semi"), z + 1))
        self.last = z
        # unions of stored tables
        self.nodes, self.leaves = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, leaves)

    @staticmethod
    def _start(about, crowded: int, last: int) -> int:
        """Level at which evenly spread pieces would be somewhat crowded."""
        area = max((about["x_max"] - about["x_min"]) * (about["y_max"] - about["y_min"]), 1e-9)
        wanted = math.sqrt(area * crowded / about["n"])
        return min(last, max(0, math.floor(math.log(TOP / wanted, 4))))


def _reach(df: DataFrame) -> DataFrame:
    """Least and greatest distance (``_low``, ``_far``) from (px, py) to the cell."""
    size = width(F.col("z"))
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    gap = lambda p, a: F.greatest(a - p, p - (a + size), F.lit(0.0))
    far = lambda p, a: F.greatest(F.abs(p - a), F.abs(p - (a + size)))
    px, py = F.col("px"), F.col("py")
    return df.withColumns({"_low": F.hypot(gap(px, x0), gap(py, y0)), "_far": F.hypot(far(px, x0), far(py, y0)) + TIE})


def candidates(points: DataFrame, layer: Pyramid, k: int) -> DataFrame:
    """(``_who``, px, py, z, cx, cy): the leaves that can hold one of the k nearest features of each point.

    ``points``: ``_who``, px, py and ``_max``, the farthest that counts.
    """
    levels = [F.struct(F.lit(z).alias("z"), *[F.floor(F.col(p) / (TOP * 4.0**-z)).cast("long").alias(c) for p, c in (("px", "cx"), ("py", "cy"))])
              for z in range(layer.last + 1)]
    around = points.select("_who", "px", "py", "_max", F.inline(F.array(*levels)))
    enough = layer.nodes.filter(F.col("features") >= k).select(*CELL)
    found = _reach(around.join(enough, CELL)).groupBy("_who").agg(F.max_by(F.struct("z", "_far"), "z").alias("_s"))
    start = points.join(found, "_who", "left").select(
        "_who", "px", "py", F.least("_max", F.coalesce("_s._far", "_max")).alias("_r"), F.coalesce("_s.z", F.lit(0)).alias("z"))
    size = width(F.col("z"))
    column = lambda p, sign: F.floor((F.col(p) + sign * F.col("_r")) / size).cast("long")
    # a leaf above the starting level stands for all cells below it
    every = start.select("_who", "px", "py", "_r", F.col("z").alias("_z"), F.explode(F.sequence(F.lit(0), F.col("z"))).alias("z"))
    cells = every.withColumn("cx", F.explode(F.sequence(column("px", -1), column("px", 1)))).withColumn(
        "cy", F.explode(F.sequence(column("py", -1), column("py", 1))))
    frontier = cells.join(layer.nodes, CELL).filter(F.col("leaf") | (F.col("z") == F.col("_z"))).drop("_z")
    done = None
    while True:
        frontier = _reach(frontier).filter(F.col("_low") <= F.col("_r"))
        bound = frontier.groupBy("_who").agg(F.min(F.when(F.col("features") >= k, F.col("_far"))).alias("_b"))
        near = frontier.join(bound, "_who").withColumn("_r", F.least("_r", F.coalesce("_b", "_r"))).filter(F.col("_low") <= F.col("_r"))
        near = durable(near.select("_who", "px", "py", "_r", *CELL, "features", "leaf"))
        leaves = near.filter("leaf").select("_who", "px", "py", "_r", *CELL)
        done = leaves if done is None else done.unionByName(leaves)
        rest = near.filter("NOT leaf")
        if rest.isEmpty():
            break
        step = F.explode(F.array(*[F.struct((F.col("cx") * 4 + i).alias("cx"), (F.col("cy") * 4 + j).alias("cy")) for i in range(4) for j in range(4)]))
        below = rest.select("_who", "px", "py", "_r", (F.col("z") + 1).alias("z"), step.alias("_c")).select("_who", "px", "py", "_r", "z", "_c.*")
        frontier = below.join(layer.nodes, CELL)
    # a bound found later holds for leaves found earlier
    last = done.groupBy("_who").agg(F.min("_r").alias("_r"))
    return _reach(done.drop("_r").join(last, "_who")).filter(F.col("_low") <= F.col("_r")).select("_who", "px", "py", *CELL)


def piece_distance() -> Column:
    """Distance in coordinate units from (px, py) to the piece."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(F.col("x1") + t * dx - F.col("px"), F.col("y1") + t * dy - F.col("py"))


def near_features(points: DataFrame, layer: Pyramid, k: int) -> DataFrame:
    """(``_who``, ``_f``, planar) of pieces near each point, one of each of the k nearest features included; polygons by their borders."""
    met = candidates(points, layer, k).join(layer.leaves, CELL)
    return met.select("_who", "_f", piece_distance().alias("planar"))

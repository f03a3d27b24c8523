"""Concave shapes with holes, made from the boxes of the given tables: cutting and validity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loamframe.bindings.soils import _box_area
from loamframe.bindings.tables import PARCELS, SOILS, parcels, query, soils
from loamframe.functions import geometry as geo
from loamframe.operators import selfcross, split


def ring(corners: list[tuple[Column, Column]], number: int = 0, hole: bool = False) -> Column:
    closed = [*corners, corners[0]]
    return geo.part(F.array(*[c[0] for c in closed]), F.array(*[c[1] for c in closed]), number, hole)


def _u_with_hole() -> Column:
    """A U open to the north with a hole in its base."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    w, h, middle = x1 - x0, y1 - y0, (y0 + y1) / 2
    xa, xb = x0 + w / 4, x0 + w * 0.75
    shell = ring([(x0, y0), (x1, y0), (x1, y1), (xb, y1), (xb, middle), (xa, middle), (xa, y1), (x0, y1)])
    left, right, low, high = x0 + w * 0.375, x0 + w * 0.625, y0 + h / 8, y0 + h * 0.375
    return geo.shape("POLYGON", shell, ring([(left, low), (left, high), (right, high), (right, low)], 0, True))


_BASE = f"""WITH {SOILS}, u AS (SELECT soil_id, maxx - minx >= maxy - miny AS wide, minx AS x0, miny AS y0, maxx AS x1, maxy AS y1, maxx - minx AS w, maxy - miny AS h FROM soils)"""


@query(f"""{_BASE} SELECT soil_id, CASE WHEN wide THEN 2 ELSE 3 END AS parts, CAST(CASE WHEN wide THEN 0 ELSE 1 END AS BIGINT) AS holes, CAST(22 AS BIGINT) AS vertices,
round(({_box_area('x0', 'y0', 'x1', 'y1')} - {_box_area('(x0 + w / 4)', '((y0 + y1) / 2)', '(x0 + w * 0.75)', 'y1')}
 - {_box_area('(x0 + w * 0.375)', '(y0 + h / 8)', '(x0 + w * 0.625)', '(y0 + h * 0.375)')}) / 1e6, 1) AS square_km FROM u""")
def split_concave(spark, sf_dir):
    """U shapes with a hole: a cut from the south opens the hole and the U, one from the west parts the arms."""
    shapes = soils(spark, sf_dir).select(F.col("soil_id").alias("gid"), _u_with_hole().alias("geom"))
    pieces = split.split_large(shapes, ["gid"], max_vertices=12)
    holes = F.size(F.filter("geom.parts", lambda p: p["hole"]))
    return pieces.groupBy(F.col("split_source_gid").alias("soil_id")).agg(
        F.max("split_part").alias("parts"), F.sum(holes).alias("holes"), F.sum(geo.num_points(F.col("geom"))).alias("vertices"),
        F.round(F.sum(geo.area_m2(F.col("geom"))) / 1e6, 1).alias("square_km"))


@query(f"""{_BASE} SELECT soil_id, CASE WHEN wide THEN 'feature_split' ELSE 'feature_split_incomplete' END AS event, 14 AS vertices, CASE WHEN wide THEN 2 ELSE 3 END AS parts,
CASE WHEN wide THEN 11 ELSE 12 END AS largest_piece FROM u""")
def split_report(spark, sf_dir):
    """One cut only: halves of 11 vertices are small enough, a part of 12 is reported."""
    shapes = soils(spark, sf_dir).select(F.col("soil_id").alias("gid"), _u_with_hole().alias("geom"))
    return split.split_report(shapes, max_vertices=11, max_depth=1).select(
        F.col("gid").alias("soil_id"), "event", "vertices", F.col("parts").cast("int").alias("parts"), "largest_piece")


@query(f"""WITH {SOILS} SELECT soil_id, CAST(row_number() OVER (PARTITION BY soil_id ORDER BY k) AS INTEGER) AS split_part
FROM (SELECT soil_id, unnest(range(CASE WHEN maxx - minx >= maxy - miny THEN 2 ELSE 3 END)) AS k FROM soils)""", name="split_part_number")
def split_part_number(spark, sf_dir):
    """Numbers of the pieces within their source feature."""
    shapes = soils(spark, sf_dir).select(F.col("soil_id").alias("gid"), _u_with_hole().alias("geom"))
    return split.split_large(shapes, ["gid"], max_vertices=12).select(F.col("split_source_gid").alias("soil_id"), "split_part")


_SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
#: Rings (polygon number, hole, corners in units of the box) of one shape for each remainder of gid.
_RINGS = [
    [(0, False, _SQUARE)],
    [(0, False, [(0, 0), (1, 1), (1, 0), (0, 1)])],
    [(0, False, _SQUARE), (0, True, [(0, 0.5), (0.5, 0.25), (0.5, 0.75)])],
    [(0, False, _SQUARE), (0, True, [(0.5, 0.5), (1, 0.25), (2, 0.5), (1, 0.75)])],
    [(0, False, _SQUARE), (1, False, [(1, 1), (2, 1), (2, 2)])],
    [(0, False, _SQUARE), (1, False, [(0.5, 0.5), (1, 0), (2, 0.5), (1, 1)])],
    [(0, False, _SQUARE), (0, True, [(0.5, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 0.5)])],
    [(0, False, [(0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 2), (0.5, 1), (0, 1)])],
    [(0, False, _SQUARE), (1, False, [(1, 0.5), (2, 0.25), (2, 0.75)])],
]


@query(f"WITH {PARCELS} SELECT gid FROM parcels WHERE gid % 9 IN (1, 3, 5, 7)")
def crossing_rings(spark, sf_dir):
    """Rings that cross through vertices, overlap or run back are found; rings that touch are left alone."""
    unit = [(kind, [(part, hole, [float(x) for x, _ in (*c, c[0])], [float(y) for _, y in (*c, c[0])]) for part, hole, c in rings])
            for kind, rings in enumerate(_RINGS)]
    shapes = spark.createDataFrame(unit, "kind int, parts array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>")
    x0, y0, w, h = F.col("minx"), F.col("miny"), F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    parts = F.transform("parts", lambda p: F.struct(
        p["part"].alias("part"), p["hole"].alias("hole"), F.transform(p["xs"], lambda f: x0 + f * w).alias("xs"), F.transform(p["ys"], lambda f: y0 + f * h).alias("ys")))
    boxes = parcels(spark, sf_dir).withColumn("kind", (F.col("gid") % 9).cast("int"))
    layer = boxes.join(F.broadcast(shapes), "kind").select("gid", F.struct(F.lit("POLYGON").alias("kind"), parts.alias("parts")).alias("geom"))
    return selfcross.self_intersecting(layer, "gid")

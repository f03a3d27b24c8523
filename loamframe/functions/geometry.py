"""Geometry functions on a plain struct, all as column expressions.

``geom = struct<kind string, parts array<struct<part int, hole boolean,
xs array<double>, ys array<double>>>>`` with kind POINT, LINE or POLYGON.  One
entry of ``parts`` is one ring, line or point; rings are closed, outer rings
counter-clockwise, holes clockwise.  Coordinates are lon/lat degrees unless a
function says otherwise.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from loamframe import codes

GEOM_TYPE = (
    "struct<kind:string,parts:array<struct<part:int,hole:boolean,"
    "xs:array<double>,ys:array<double>>>>"
)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: written out, it would be copied to every place that uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- building ---------------------------------------------------------------
def part(xs: Column, ys: Column, number: int = 0, hole: bool = False) -> Column:
    return F.struct(
        F.lit(number).alias("part"), F.lit(hole).alias("hole"), xs.alias("xs"), ys.alias("ys")
    )


def shape(kind: str, *parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*parts).alias("parts"))


def point(x: Column, y: Column) -> Column:
    """Point, NULL when a coordinate is missing."""
    built = shape("POINT", part(F.array(x.cast("double")), F.array(y.cast("double"))))
    return F.when(x.isNotNull() & y.isNotNull(), built)


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return shape(
        "POLYGON",
        part(F.array(minx, maxx, maxx, minx, minx), F.array(miny, miny, maxy, maxy, miny)),
    )


def polygon(xs: Column, ys: Column) -> Column:
    return shape("POLYGON", part(xs, ys))


def line(xs: Column, ys: Column) -> Column:
    return shape("LINE", part(xs, ys))


def buffer_point(x: Column, y: Column, metres: float = 5.0, sides: int = 32) -> Column:
    """Regular polygon standing for a small disc around a point."""
    per_degree = math.radians(1.0) * codes.EARTH_RADIUS_M
    step = 2.0 * math.pi / sides
    turns = F.sequence(F.lit(0), F.lit(sides))
    # the last vertex repeats angle zero so that the ring closes exactly
    angle = lambda i: (i % sides).cast("double") * step
    xs = F.transform(turns, lambda i: x + F.cos(angle(i)) * metres / (per_degree * F.cos(F.radians(y))))
    ys = F.transform(turns, lambda i: y + F.sin(angle(i)) * metres / per_degree)
    return polygon(xs, ys)


# --- reading ----------------------------------------------------------------
def xs_of(geom: Column) -> Column:
    return F.flatten(F.transform(geom["parts"], lambda p: p["xs"]))


def ys_of(geom: Column) -> Column:
    return F.flatten(F.transform(geom["parts"], lambda p: p["ys"]))


def bounds(geom: Column) -> Column:
    return F.struct(
        F.array_min(xs_of(geom)).alias("minx"), F.array_min(ys_of(geom)).alias("miny"),
        F.array_max(xs_of(geom)).alias("maxx"), F.array_max(ys_of(geom)).alias("maxy"),
    )


def with_bounds(df, geom: str = "geom"):
    """Add minx, miny, maxx, maxy columns beside a geometry column."""
    box = bounds(F.col(geom))
    return df.withColumns({c: box[c] for c in ("minx", "miny", "maxx", "maxy")})


def num_points(geom: Column) -> Column:
    """Vertex count; 0 for a missing geometry."""
    total = F.aggregate(geom["parts"], F.lit(0), lambda acc, p: acc + F.size(p["xs"]))
    return F.coalesce(total, F.lit(0))


def outer_xs(geom: Column) -> Column:
    return F.get(geom["parts"], F.lit(0))["xs"]


def outer_ys(geom: Column) -> Column:
    return F.get(geom["parts"], F.lit(0))["ys"]


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def centroid_vertices(geom: Column) -> Column:
    """Mean of the outer ring's vertices, closing vertex left out."""
    n = F.greatest(F.size(outer_xs(geom)) - 1, F.lit(1))
    return F.struct(
        _mean(F.slice(outer_xs(geom), F.lit(1), n)).alias("x"),
        _mean(F.slice(outer_ys(geom), F.lit(1), n)).alias("y"),
    )


def force_2d(parts_with_z: Column) -> Column:
    """Rebuild parts that carry a ``zs`` array with x and y only."""
    return F.transform(
        parts_with_z,
        lambda p: F.struct(
            p["part"].alias("part"), p["hole"].alias("hole"), p["xs"].alias("xs"), p["ys"].alias("ys")
        ),
    )


# --- text -------------------------------------------------------------------
def _pairs(p: Column) -> Column:
    return F.zip_with(p["xs"], p["ys"], lambda x, y: F.array(x, y))


def _polygons(geom: Column) -> Column:
    """Rings grouped by polygon number: array of arrays of rings of positions."""
    numbers = F.array_sort(F.array_distinct(F.transform(geom["parts"], lambda p: p["part"])))
    return F.transform(
        numbers,
        lambda n: F.transform(F.filter(geom["parts"], lambda p: p["part"] == n), _pairs),
    )


def as_geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry; several polygons or lines give a Multi type."""
    first = F.get(geom["parts"], F.lit(0))
    single_point = F.array(F.get(first["xs"], F.lit(0)), F.get(first["ys"], F.lit(0)))

    def doc(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    many_points = F.size(geom["parts"]) > 1
    polys = _polygons(geom)
    return (
        F.when((geom["kind"] == "POINT") & ~many_points, doc("Point", single_point))
        .when(geom["kind"] == "POINT",
              doc("MultiPoint", F.transform(geom["parts"], lambda p: F.get(_pairs(p), F.lit(0)))))
        .when((geom["kind"] == "LINE") & ~many_points, doc("LineString", _pairs(first)))
        .when(geom["kind"] == "LINE", doc("MultiLineString", F.transform(geom["parts"], _pairs)))
        .when(F.size(polys) == 1, doc("Polygon", F.get(polys, F.lit(0))))
        .otherwise(doc("MultiPolygon", polys))
    )


def _ring_from(positions: Column, number: Column, hole: Column) -> Column:
    return F.struct(
        number.cast("int").alias("part"), hole.alias("hole"),
        F.transform(positions, lambda c: F.get(c, F.lit(0))).alias("xs"),
        F.transform(positions, lambda c: F.get(c, F.lit(1))).alias("ys"),
    )


def from_geojson(text: Column) -> Column:
    """Parse GeoJSON geometry text; a third coordinate is dropped; NULL when unknown."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")
    zero, no = F.lit(0), F.lit(False)

    def parse(depth: int) -> Column:
        return F.from_json(raw, "array<" * depth + "double" + ">" * depth)

    def rings(polygon_rings: Column, number: Column) -> Column:
        return F.transform(polygon_rings, lambda ring, i: _ring_from(ring, number, i > 0))

    def geometry(name: str, parts: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), parts.alias("parts"))

    return (
        F.when(kind == "Point", geometry("POINT", F.array(_ring_from(F.array(parse(1)), zero, no))))
        .when(kind == "MultiPoint", geometry("POINT", F.transform(parse(2), lambda c, i: _ring_from(F.array(c), i, no))))
        .when(kind == "LineString", geometry("LINE", F.array(_ring_from(parse(2), zero, no))))
        .when(kind == "MultiLineString", geometry("LINE", F.transform(parse(3), lambda ln, i: _ring_from(ln, i, no))))
        .when(kind == "Polygon", geometry("POLYGON", rings(parse(3), zero)))
        .when(kind == "MultiPolygon", geometry("POLYGON", F.flatten(F.transform(parse(4), rings))))
    )


def wkt(geom: Column) -> Column:
    """Well-known text, for stores that know no coordinate system."""
    def positions(p: Column) -> Column:
        pairs = F.zip_with(p["xs"], p["ys"], lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string")))
        return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))

    rings = F.array_join(F.transform(geom["parts"], positions), ", ")
    numbers = F.array_sort(F.array_distinct(F.transform(geom["parts"], lambda p: p["part"])))
    bodies = F.array_join(
        F.transform(
            numbers,
            lambda n: F.concat(
                F.lit("("),
                F.array_join(F.transform(F.filter(geom["parts"], lambda p: p["part"] == n), positions), ", "),
                F.lit(")"),
            ),
        ),
        ", ",
    )
    many = F.size(geom["parts"]) > 1
    return (
        F.when((geom["kind"] == "POINT") & ~many, F.concat(F.lit("POINT "), rings))
        .when(geom["kind"] == "POINT", F.concat(F.lit("MULTIPOINT ("), rings, F.lit(")")))
        .when((geom["kind"] == "LINE") & ~many, F.concat(F.lit("LINESTRING "), rings))
        .when(geom["kind"] == "LINE", F.concat(F.lit("MULTILINESTRING ("), rings, F.lit(")")))
        .when(F.size(numbers) > 1, F.concat(F.lit("MULTIPOLYGON ("), bodies, F.lit(")")))
        .otherwise(F.concat(F.lit("POLYGON "), bodies))
    )


# --- predicates -------------------------------------------------------------
def _segments(n: Column) -> Column:
    """1-based start positions of the segments of an ``n``-vertex ring or line (none if n < 2)."""
    return F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i)


def _crossings(p: Column, x: Column, y: Column) -> Column:
    """How many edges of a ring a ray from (x, y) to the east crosses."""
    xs, ys = p["xs"], p["ys"]

    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = _at(xs, i - 1), _at(ys, i - 1), _at(xs, i), _at(ys, i)
        spans = (y1 > y) != (y2 > y)
        at = x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1)
        return spans & (x < at)

    return F.size(F.filter(_segments(F.size(xs)), crosses))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Point in polygon by the even–odd rule over all rings, so holes are outside."""
    total = F.aggregate(geom["parts"], F.lit(0), lambda acc, p: acc + _crossings(p, x, y))
    return (geom["kind"] == "POLYGON") & (total % 2 == 1)


def is_rectangle(geom: Column) -> Column:
    """A polygon of one closed ring whose five vertices run along a box; written without lambdas, so it is compiled."""
    ring = F.get(geom["parts"], F.lit(0))
    xs, ys = ([F.get(ring[c], F.lit(i)) for i in range(5)] for c in ("xs", "ys"))
    level = [(xs[i] != xs[i + 1]) & (ys[i] == ys[i + 1]) for i in range(4)]
    upright = [(xs[i] == xs[i + 1]) & (ys[i] != ys[i + 1]) for i in range(4)]
    turns = (level[0] & upright[1] & level[2] & upright[3]) | (upright[0] & level[1] & upright[2] & level[3])
    one = (geom["kind"] == "POLYGON") & (F.size(geom["parts"]) == 1) & (F.size(ring["xs"]) == 5) & ~ring["hole"]
    return F.coalesce(one & turns & (xs[0] == xs[4]) & (ys[0] == ys[4]), F.lit(False))


def rectangle_bounds(geom: Column) -> list[Column]:
    """minx, miny, maxx, maxy of a geometry known to be a rectangle."""
    ring = F.get(geom["parts"], F.lit(0))
    ends = {c: [F.get(ring[c], F.lit(i)) for i in (0, 2)] for c in ("xs", "ys")}
    return [F.least(*ends["xs"]), F.least(*ends["ys"]), F.greatest(*ends["xs"]), F.greatest(*ends["ys"])]


def box_contains(minx: Column, miny: Column, maxx: Column, maxy: Column, x: Column, y: Column) -> Column:
    """``contains_point`` of a rectangle: the even-odd rule counts its west and south sides in, the others out."""
    return (x >= minx) & (x < maxx) & (y >= miny) & (y < maxy)


def bbox_overlaps(minx: Column, miny: Column, maxx: Column, maxy: Column, box) -> Column:
    """Range predicate on the bounds columns; this is the part a Parquet scan can prune on."""
    bx0, by0, bx1, by1 = (c if isinstance(c, Column) else F.lit(float(c)) for c in box)
    return (minx <= bx1) & (maxx >= bx0) & (miny <= by1) & (maxy >= by0)


def _segment_hits_box(x1, y1, x2, y2, box) -> Column:
    """Segment against a closed box: clip the parameter range by the four sides."""
    bx0, by0, bx1, by1 = box
    dx, dy = x2 - x1, y2 - y1

    def span(delta, start, low, high):
        a, b = F.try_divide(low - start, delta), F.try_divide(high - start, delta)
        flat_ok = (start >= low) & (start <= high)
        lo = F.when(delta == 0, F.when(flat_ok, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(a, b))
        hi = F.when(delta == 0, F.when(flat_ok, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(a, b))
        return lo, hi

    lo_x, hi_x = span(dx, x1, bx0, bx1)
    lo_y, hi_y = span(dy, y1, by0, by1)
    return F.greatest(lo_x, lo_y, F.lit(0.0)) <= F.least(hi_x, hi_y, F.lit(1.0))


def intersects_bbox(geom: Column, box) -> Column:
    """Exact test of a geometry against an envelope."""
    box = [c if isinstance(c, Column) else F.lit(float(c)) for c in box]
    bx0, by0, bx1, by1 = box

    def touches(p: Column) -> Column:
        xs, ys = p["xs"], p["ys"]
        inside = F.exists(
            F.arrays_zip(xs.alias("xs"), ys.alias("ys")),
            lambda v: (v["xs"] >= bx0) & (v["xs"] <= bx1) & (v["ys"] >= by0) & (v["ys"] <= by1),
        )
        crossing = F.exists(
            _segments(F.size(xs)),
            lambda i: _segment_hits_box(_at(xs, i - 1), _at(ys, i - 1), _at(xs, i), _at(ys, i), box),
        )
        return inside | crossing

    return F.exists(geom["parts"], touches) | contains_point(geom, bx0, by0)


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Do two closed segments share a point?"""
    o1, o2 = _orient(ax, ay, bx, by, cx, cy), _orient(ax, ay, bx, by, dx, dy)
    o3, o4 = _orient(cx, cy, dx, dy, ax, ay), _orient(cx, cy, dx, dy, bx, by)
    boxes = (
        (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx))
        & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    )
    return boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def intersects(a: Column, b: Column) -> Column:
    """Exact intersection test of any two geometries."""
    def parts_cross(p: Column, q: Column) -> Column:
        return F.exists(
            _segments(F.size(p["xs"])),
            lambda i: F.exists(
                _segments(F.size(q["xs"])),
                lambda j: _segments_cross(
                    _at(p["xs"], i - 1), _at(p["ys"], i - 1), _at(p["xs"], i), _at(p["ys"], i),
                    _at(q["xs"], j - 1), _at(q["ys"], j - 1), _at(q["xs"], j), _at(q["ys"], j),
                ),
            ),
        )

    def any_vertex_inside(outer: Column, inner: Column) -> Column:
        return F.exists(
            inner["parts"],
            lambda p: contains_point(outer, F.get(p["xs"], F.lit(0)), F.get(p["ys"], F.lit(0))),
        )

    crossing = F.exists(a["parts"], lambda p: F.exists(b["parts"], lambda q: parts_cross(p, q)))
    return crossing | any_vertex_inside(a, b) | any_vertex_inside(b, a)


# --- measures ---------------------------------------------------------------
_E2 = codes.WGS84_F * (2 - codes.WGS84_F)
_E = math.sqrt(_E2)


def _q_of(sin_lat):
    """Authalic q of a sine of latitude, for a Python float or a column."""
    if isinstance(sin_lat, float):
        es = _E * sin_lat
        return (1 - _E2) * (sin_lat / (1 - es * es) + math.atanh(es) / _E)
    es = _E * sin_lat
    return (1 - _E2) * (sin_lat / (1 - es * es) + F.atanh(es) / _E)


_Q_POLE = _q_of(1.0)
AREA_FACTOR = codes.AUTHALIC_RADIUS_M**2


def sin_authalic(lat: Column) -> Column:
    """Sine of the authalic latitude: areas on this sphere equal areas on the ellipsoid."""
    return _q_of(F.sin(F.radians(lat))) / _Q_POLE


def box_area_m2(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Ellipsoidal area of a lon/lat box, exact."""
    return AREA_FACTOR * F.radians(maxx - minx) * (sin_authalic(maxy) - sin_authalic(miny))


def _ring_area(p: Column) -> Column:
    xs, ys = p["xs"], p["ys"]
    total = F.aggregate(
        _segments(F.size(xs)),
        F.lit(0.0),
        lambda acc, i: acc
        + F.radians(_at(xs, i) - _at(xs, i - 1))
        * (sin_authalic(_at(ys, i - 1)) + sin_authalic(_at(ys, i))),
    )
    return F.abs(total) * AREA_FACTOR / 2.0


def area_m2(geom: Column) -> Column:
    """Geodesic area: rings summed on the authalic sphere, holes taken off; 0 for points, lines."""
    total = F.aggregate(
        geom["parts"],
        F.lit(0.0),
        lambda acc, p: acc + F.when(p["hole"], -_ring_area(p)).otherwise(_ring_area(p)),
    )
    return F.when(geom["kind"] == "POLYGON", total).otherwise(F.when(geom.isNotNull(), F.lit(0.0)))


def haversine_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance in metres."""
    half = F.pow(F.sin(F.radians(y2 - y1) / 2), F.lit(2.0)) + F.cos(F.radians(y1)) * F.cos(
        F.radians(y2)
    ) * F.pow(F.sin(F.radians(x2 - x1) / 2), F.lit(2.0))
    return 2.0 * codes.EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def length_m(geom: Column) -> Column:
    """Geodesic length of lines or of rings."""
    def one(p: Column) -> Column:
        xs, ys = p["xs"], p["ys"]
        return F.aggregate(
            _segments(F.size(xs)), F.lit(0.0),
            lambda acc, i: acc + haversine_m(_at(xs, i - 1), _at(ys, i - 1), _at(xs, i), _at(ys, i)),
        )

    return F.aggregate(geom["parts"], F.lit(0.0), lambda acc, p: acc + one(p))


def bbox_area_km2(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Quick box area from a fixed degree length and the middle latitude."""
    k = codes.KM_PER_DEGREE
    return (maxx - minx) * k * F.cos(F.radians((miny + maxy) / 2)) * (maxy - miny) * k


def bbox_area_ha(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return bbox_area_km2(minx, miny, maxx, maxy) * 100.0


def _foot_fraction(x, y, x1, y1, x2, y2):
    """Position 0..1 on a segment of the point nearest to (x, y), in a local frame."""
    k = F.cos(F.radians(y))
    dx, dy = (x2 - x1) * k, y2 - y1
    t = F.try_divide((x - x1) * k * dx + (y - y1) * dy, dx * dx + dy * dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def segment_distance_m(x, y, x1, y1, x2, y2) -> Column:
    t = _foot_fraction(x, y, x1, y1, x2, y2)
    return haversine_m(x, y, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def planar_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance in coordinate units from a point to a geometry, 0 inside a polygon."""
    def to_part(p: Column) -> Column:
        xs, ys = p["xs"], p["ys"]

        def to_segment(i: Column) -> Column:
            x1, y1, x2, y2 = _at(xs, i - 1), _at(ys, i - 1), _at(xs, i), _at(ys, i)
            dx, dy = x2 - x1, y2 - y1
            t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
            return F.hypot(x1 + t * dx - x, y1 + t * dy - y)

        alone = F.hypot(F.get(xs, F.lit(0)) - x, F.get(ys, F.lit(0)) - y)
        return F.when(F.size(xs) == 1, alone).otherwise(
            F.array_min(F.transform(_segments(F.size(xs)), to_segment))
        )

    edge = F.array_min(F.transform(geom["parts"], to_part))
    return F.when(contains_point(geom, x, y), F.lit(0.0)).otherwise(edge)


def point_distance_m(geom: Column, x: Column, y: Column) -> Column:
    """Geodesic distance from a point to a geometry, 0 inside a polygon."""
    def to_part(p: Column) -> Column:
        xs, ys = p["xs"], p["ys"]
        alone = haversine_m(x, y, F.get(xs, F.lit(0)), F.get(ys, F.lit(0)))
        nearest = F.array_min(
            F.transform(
                _segments(F.size(xs)),
                lambda i: segment_distance_m(x, y, _at(xs, i - 1), _at(ys, i - 1), _at(xs, i), _at(ys, i)),
            )
        )
        return F.when(F.size(xs) == 1, alone).otherwise(nearest)

    edge = F.array_min(F.transform(geom["parts"], to_part))
    return F.when(contains_point(geom, x, y), F.lit(0.0)).otherwise(edge)


def distance_m(a: Column, b: Column) -> Column:
    """Geodesic distance of two geometries, 0 when they intersect.

    Without an intersection the minimum is always reached at a vertex of one side.
    """
    def vertices_to(one: Column, other: Column) -> Column:
        per_part = F.transform(
            one["parts"],
            lambda p: F.array_min(
                F.transform(
                    F.arrays_zip(p["xs"].alias("xs"), p["ys"].alias("ys")),
                    lambda v: point_distance_m(other, v["xs"], v["ys"]),
                )
            ),
        )
        return F.array_min(per_part)

    apart = F.least(vertices_to(a, b), vertices_to(b, a))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(apart)


def centroid(geom: Column) -> Column:
    """Area centroid of the outer ring (vertex mean when the ring has no area)."""
    ring = F.struct(outer_xs(geom).alias("xs"), outer_ys(geom).alias("ys"))
    return once(ring, lambda r: once(_moments(r["xs"], r["ys"]), lambda s: _balance(r["xs"], r["ys"], s)))


def _moments(xs: Column, ys: Column) -> Column:
    """Twice the signed area of a ring and its first moments, about its first vertex."""
    x0, y0 = F.get(xs, F.lit(0)), F.get(ys, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        ax, ay = _at(xs, i - 1) - x0, _at(ys, i - 1) - y0
        bx, by = _at(xs, i) - x0, _at(ys, i) - y0
        w = ax * by - bx * ay
        return F.struct(
            (acc["a"] + w).alias("a"), (acc["x"] + (ax + bx) * w).alias("x"), (acc["y"] + (ay + by) * w).alias("y")
        )

    return F.aggregate(_segments(F.size(xs)), zero, add)


def _balance(xs: Column, ys: Column, s: Column) -> Column:
    """Centroid of a ring from its moments, the vertex mean where it has no area."""
    n = F.greatest(F.size(xs) - 1, F.lit(1))
    return F.struct(*[
        F.coalesce(F.get(v, F.lit(0)) + F.try_divide(s[c], 3.0 * s["a"]), _mean(F.slice(v, F.lit(1), n))).alias(c)
        for v, c in ((xs, "x"), (ys, "y"))])


def interior_point(geom: Column) -> Column:
    """A point on the surface: the centroid if inside, else the middle of the widest inside run
    of the middle-latitude scan line; lines and points give their first vertex."""
    first = F.struct(F.get(outer_xs(geom), F.lit(0)).alias("x"), F.get(outer_ys(geom), F.lit(0)).alias("y"))
    inside = once(centroid(geom), lambda c: F.when(contains_point(geom, c["x"], c["y"]), c))
    return F.when(geom["kind"] != "POLYGON", first).otherwise(F.coalesce(inside, _widest_run(geom), first))


def _widest_run(geom: Column) -> Column:
    """Middle of the widest inside run of the middle-latitude scan line, NULL without one."""
    middle = once(ys_of(geom), lambda v: (F.array_min(v) + F.array_max(v)) / 2)

    def hits(p: Column, y: Column) -> Column:
        xs, ys = p["xs"], p["ys"]
        crossing = F.filter(_segments(F.size(xs)), lambda i: (_at(ys, i - 1) > y) != (_at(ys, i) > y))
        return F.transform(
            crossing,
            lambda i: _at(xs, i - 1)
            + F.try_divide((y - _at(ys, i - 1)) * (_at(xs, i) - _at(xs, i - 1)), _at(ys, i) - _at(ys, i - 1)),
        )

    def widest(cuts: Column, y: Column) -> Column:
        last = F.size(cuts).bitwiseAND(-2)
        runs = F.transform(
            F.when(last >= 2, F.sequence(F.lit(0), last - 2, F.lit(2))).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct((_at(cuts, i + 1) - _at(cuts, i)).alias("w"),
                               ((_at(cuts, i) + _at(cuts, i + 1)) / 2).alias("x")),
        )
        return once(F.array_max(runs), lambda w: F.when(w.isNotNull(), F.struct(w["x"].alias("x"), y.alias("y"))))

    return once(middle, lambda y: once(F.array_sort(F.flatten(F.transform(geom["parts"], lambda p: hits(p, y)))), lambda cuts: widest(cuts, y)))


# --- coordinate systems -----------------------------------------------------
# fixed values: Lambert conformal conic (parallel 1, parallel 2, origin lat, origin lon)
LAMBERT = {"EPSG:32198": (60.0, 46.0, 44.0, -68.5), "EPSG:3978": (49.0, 77.0, 49.0, -95.0)}
GRS80_F = 1 / 298.257222101
KNOWN_CRS = ["EPSG:4326", "EPSG:3857", *LAMBERT]


def _lambert_constants(code: str):
    p1, p2, p0, lon0 = (math.radians(v) for v in LAMBERT[code])
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(p):
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p):
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return e, n, f, codes.WGS84_A * f * t(p0) ** n, lon0


def _to_degrees(x: Column, y: Column, code: str):
    a = codes.WGS84_A
    if code == "EPSG:4326":
        return x, y
    if code == "EPSG:3857":
        return F.degrees(x / a), F.degrees(2 * F.atan(F.exp(y / a)) - math.pi / 2)
    e, n, f, rho0, lon0 = _lambert_constants(code)
    sign = 1.0 if n > 0 else -1.0
    rho = sign * F.hypot(x, rho0 - y)
    t = F.pow(rho / (a * f), F.lit(1 / n))
    theta = F.atan2(sign * x, sign * (rho0 - y))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(4):  # the correction shrinks by e² ≈ 0.007 a round
        es = e * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(e / 2)))
    return F.degrees(theta / n + lon0), F.degrees(phi)


def _from_degrees(x: Column, y: Column, code: str):
    a = codes.WGS84_A
    if code == "EPSG:4326":
        return x, y
    if code == "EPSG:3857":
        return F.radians(x) * a, F.log(F.tan(math.pi / 4 + F.radians(y) / 2)) * a
    e, n, f, rho0, lon0 = _lambert_constants(code)
    es = e * F.sin(F.radians(y))
    t = F.tan(math.pi / 4 - F.radians(y) / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = a * f * F.pow(t, F.lit(n))
    theta = n * (F.radians(x) - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def reproject_xy(x: Column, y: Column, source: str, target: str):
    """Coordinate pair between two of the known systems (NAD83 taken as WGS84)."""
    for code in (source, target):
        if code not in KNOWN_CRS:
            raise ValueError(f"unknown or missing coordinate system: {code!r}")
    if source == target:
        return x, y
    return _from_degrees(*_to_degrees(x, y, source), target)


def reproject(geom: Column, source: str, target: str) -> Column:
    """Every vertex moved from ``source`` to ``target``; unchanged when they are equal."""
    if source == target and source in KNOWN_CRS:
        return geom
    reproject_xy(F.lit(0.0), F.lit(0.0), source, target)
    parts = F.transform(
        geom["parts"],
        lambda p: F.struct(
            p["part"].alias("part"), p["hole"].alias("hole"),
            F.zip_with(p["xs"], p["ys"], lambda x, y: reproject_xy(x, y, source, target)[0]).alias("xs"),
            F.zip_with(p["xs"], p["ys"], lambda x, y: reproject_xy(x, y, source, target)[1]).alias("ys"),
        ),
    )
    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), parts.alias("parts")))


def target_crs(name: Column, default: str) -> Column:
    """Target system of a raster: a keyword in its name overrides the default."""
    choice = None
    for keyword, code in codes.RASTER_TARGET_CRS.items():
        hit = F.lower(name).contains(keyword)
        choice = F.when(hit, F.lit(code)) if choice is None else choice.when(hit, F.lit(code))
    return choice.otherwise(F.lit(default))


# --- keys -------------------------------------------------------------------
def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cells(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    """Grid cells a box touches, as ``array<struct<cx, cy>>``."""
    columns = F.sequence(cell_of(minx, size), cell_of(maxx, size))
    rows = F.sequence(cell_of(miny, size), cell_of(maxy, size))
    return F.flatten(
        F.transform(
            columns,
            lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))),
        )
    )


def tile_xy(x: Column, y: Column, zoom: int):
    """Web-map tile column and row holding a lon/lat position."""
    n = 2**zoom
    lat = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), y)))
    ty = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n)
    tx = F.floor((x + 180.0) / 360.0 * n)

    def clamp(v):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")

    return clamp(tx), clamp(ty)


def tile_keys(minx: Column, miny: Column, maxx: Column, maxy: Column, zoom: int) -> Column:
    """Tiles a box touches at a zoom level, as ``array<struct<z, tx, ty>>``."""
    left, top = tile_xy(minx, maxy, zoom)
    right, bottom = tile_xy(maxx, miny, zoom)
    return F.flatten(
        F.transform(
            F.sequence(left, right),
            lambda tx: F.transform(
                F.sequence(top, bottom),
                lambda ty: F.struct(F.lit(zoom).alias("z"), tx.alias("tx"), ty.alias("ty")),
            ),
        )
    )


# --- validity ---------------------------------------------------------------
def _signed_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a ring, closed or not: positive when counter-clockwise."""
    n = F.size(xs)
    return F.aggregate(
        F.when(n >= 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda acc, i: acc + (_at(xs, i) * _at(ys, (i + 1) % n) - _at(xs, (i + 1) % n) * _at(ys, i)) / 2,
    )


def _closed(p: Column) -> Column:
    n = F.size(p["xs"])
    return (F.get(p["xs"], F.lit(0)) == F.get(p["xs"], n - 1)) & (F.get(p["ys"], F.lit(0)) == F.get(p["ys"], n - 1))


def invalid_reasons(geom: Column) -> Column:
    """Closed-form defects of a geometry as an array of texts, empty when there is none."""
    return once(geom, _defects)


def _defects(geom: Column) -> Column:
    polygon_parts = F.when(geom["kind"] == "POLYGON", geom["parts"]).otherwise(F.slice(geom["parts"], 1, 0))
    checks = [
        ("missing", geom.isNull()),
        ("empty", F.size(geom["parts"]) == 0),
        ("not_finite", F.exists(F.concat(xs_of(geom), ys_of(geom)),
                                lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))),
        ("unclosed_ring", F.exists(polygon_parts, lambda p: ~_closed(p))),
        ("duplicate_vertex", F.exists(polygon_parts, _has_repeat)),
        ("too_few_points", F.exists(polygon_parts, lambda p: F.size(p["xs"]) < 4)),
        ("zero_area", F.exists(polygon_parts, lambda p: _signed_area(p["xs"], p["ys"]) == 0)),
        ("wrong_orientation", F.exists(
            polygon_parts, lambda p: (_signed_area(p["xs"], p["ys"]) > 0) == p["hole"])),
    ]
    reasons = F.array(*[F.when(test, F.lit(name)) for name, test in checks])
    return F.array_compact(reasons)


def _has_repeat(p: Column) -> Column:
    return F.exists(
        _segments(F.size(p["xs"])),
        lambda i: (_at(p["xs"], i) == _at(p["xs"], i - 1)) & (_at(p["ys"], i) == _at(p["ys"], i - 1)),
    )


def repair(geom: Column) -> Column:
    """Repair what has a closed form: repeated vertices, unclosed rings, wrong orientation.

    Rings left with no area are dropped; a polygon with no outer ring becomes NULL.
    The kind never changes.
    """
    # each step is bound before the next one uses it several times
    def moved(p: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(p["xs"]) - 1),
            lambda i: (i == 0) | (_at(p["xs"], i) != _at(p["xs"], i - 1)) | (_at(p["ys"], i) != _at(p["ys"], i - 1)),
        )

    def closed(r: Column) -> Column:
        first, last = [F.get(r[c], F.lit(0)) for c in ("xs", "ys")], [F.get(r[c], F.size(r[c]) - 1) for c in ("xs", "ys")]
        open_ring = (first[0] != last[0]) | (first[1] != last[1])
        return F.struct(*[F.when(open_ring, F.concat(r[c], F.array(v))).otherwise(r[c]).alias(c) for c, v in zip(("xs", "ys"), first)])

    def fix(p: Column) -> Column:
        kept = once(moved(p), lambda keep: F.struct(
            F.transform(keep, lambda i: _at(p["xs"], i)).alias("xs"), F.transform(keep, lambda i: _at(p["ys"], i)).alias("ys")))
        return once(once(kept, closed), lambda r: once(_signed_area(r["xs"], r["ys"]), lambda area: F.struct(
            p["part"].alias("part"), p["hole"].alias("hole"), area.alias("area"),
            *[F.when((area > 0) == p["hole"], F.reverse(r[c])).otherwise(r[c]).alias(c) for c in ("xs", "ys")],
        )))

    def mended(g: Column) -> Column:
        # turning a ring changes the sign of its area only
        rings = F.filter(
            F.transform(F.filter(g["parts"], lambda p: F.size(p["xs"]) > 0), fix),
            lambda p: (F.size(p["xs"]) >= 4) & (p["area"] != 0),
        )
        return once(rings, lambda fixed: F.when(g["kind"] != "POLYGON", g).when(F.exists(fixed, lambda p: ~p["hole"]), F.struct(
            g["kind"].alias("kind"), F.transform(fixed, lambda p: F.struct(*[p[c].alias(c) for c in ("part", "hole", "xs", "ys")])).alias("parts"))))

    return once(geom, mended)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

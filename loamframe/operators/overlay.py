"""Polygon overlay: intersection areas and class shares, all in column expressions.

The general case needs no polygon construction: a polygon is the signed sum of the
triangles fanned from each ring's first vertex, so area(A ∩ B) is the signed sum of
the areas of B's rings clipped to those triangles.  Rectangles have a closed form.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from loamframe.functions import geometry as geo
from loamframe.functions.geometry import AREA_FACTOR
from loamframe.operators import skew, spatial
from loamframe.session import durable


def _vertices(p: Column) -> Column:
    """Open ring as an array of (x, y)."""
    n = F.size(p["xs"])
    return F.zip_with(
        F.slice(p["xs"], F.lit(1), n - 1), F.slice(p["ys"], F.lit(1), n - 1),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )


def _side(ax: Column, ay: Column, bx: Column, by: Column, p: Column) -> Column:
    return (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)


def _clip(ring: Column, edge: Column) -> Column:
    """Part of an open ring on the left of a directed edge (ax, ay) → (bx, by)."""
    n = F.size(ring)
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def piece(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        pair = F.struct(
            p.alias("p"), q.alias("q"),
            _side(edge["ax"], edge["ay"], edge["bx"], edge["by"], p).alias("sp"),
            _side(edge["ax"], edge["ay"], edge["bx"], edge["by"], q).alias("sq"),
        )

        def keep(s: Column) -> Column:
            t = F.try_divide(s["sp"], s["sp"] - s["sq"])
            cut = F.struct(
                (s["p"]["x"] + t * (s["q"]["x"] - s["p"]["x"])).alias("x"),
                (s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])).alias("y"),
            )
            crosses = ((s["sp"] > 0) & (s["sq"] < 0)) | ((s["sp"] < 0) & (s["sq"] > 0))
            return F.array_compact(F.array(F.when(s["sp"] >= 0, s["p"]), F.when(crosses, cut)))

        return F.flatten(F.transform(F.array(pair), keep))

    return F.flatten(F.transform(steps, piece))


def _open_area(ring: Column) -> Column:
    """Unsigned authalic area of an open ring."""
    n = F.size(ring)
    steps = F.when(n > 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps, F.lit(0.0),
        lambda acc, i: acc + F.radians(F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"]) * (
            geo.sin_authalic(F.get(ring, i)["y"]) + geo.sin_authalic(F.get(ring, (i + 1) % n)["y"])),
    )
    return F.abs(total) * AREA_FACTOR / 2.0


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def _triangles(ring: Column) -> Column:
    """Fan of an open ring: counter-clockwise triangles as edge lists, each with its sign."""
    n = F.size(ring)
    steps = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        a, b, c = F.get(ring, F.lit(0)), F.get(ring, i), F.get(ring, i + 1)
        turn = _side(a["x"], a["y"], b["x"], b["y"], c)
        left = F.array(_edge(a, b), _edge(b, c), _edge(c, a))
        right = F.array(_edge(a, c), _edge(c, b), _edge(b, a))
        return F.struct(F.signum(turn).alias("sign"), F.when(turn > 0, left).otherwise(right).alias("edges"))

    return F.filter(F.transform(steps, one), lambda t: t["sign"] != 0)


def _ring_turn(ring: Column) -> Column:
    n = F.size(ring)
    steps = F.when(n > 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.signum(F.aggregate(
        steps, F.lit(0.0),
        lambda acc, i: acc + F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"]
        - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"],
    ))


def intersection_area(a: Column, b: Column) -> Column:
    """Area in m² shared by two polygons with holes; exact up to edge curvature."""
    def weight(p: Column) -> Column:
        return F.when(p["hole"], F.lit(-1.0)).otherwise(F.lit(1.0))

    def rings_meet(p: Column, q: Column) -> Column:
        rings = F.struct(_vertices(p).alias("p"), _vertices(q).alias("q"))
        return weight(p) * weight(q) * geo.once(rings, lambda r: shared(r["p"], r["q"]))

    def shared(rp: Column, rq: Column) -> Column:
        # a fan triangle counts with its own turn relative to the ring's
        fans = F.transform(
            _triangles(rp),
            lambda t: t["sign"] * geo.once(F.aggregate(t["edges"], rq, lambda ring, e: _clip(ring, e)), _open_area),
        )
        total = F.aggregate(fans, F.lit(0.0), lambda acc, v: acc + v)
        return _ring_turn(rp) * total

    return F.aggregate(
        a["parts"], F.lit(0.0),
        lambda acc, p: F.aggregate(b["parts"], acc, lambda inner, q: inner + rings_meet(p, q)),
    )


is_rectangle = geo.is_rectangle


def overlap_area(a: Column, b: Column) -> Column:
    """Intersection area, by the closed form when both sides are rectangles."""
    ba, bb = geo.bounds(a), geo.bounds(b)
    x0, y0 = F.greatest(ba["minx"], bb["minx"]), F.greatest(ba["miny"], bb["miny"])
    x1, y1 = F.least(ba["maxx"], bb["maxx"]), F.least(ba["maxy"], bb["maxy"])
    boxes = F.when((x1 > x0) & (y1 > y0), geo.box_area_m2(x0, y0, x1, y1)).otherwise(F.lit(0.0))
    return F.when(is_rectangle(a) & is_rectangle(b), boxes).otherwise(intersection_area(a, b))


#: Shared areas up to this many square metres are rounding: neighbours that only touch.
TOUCHING_M2 = 0.01


@functools.cache
def _positive_area() -> Column:
    """Shared area of ``_ga`` and ``_gb`` as a one-element array, empty when they touch at most."""
    return F.filter(F.array(overlap_area(F.col("_ga"), F.col("_gb"))), lambda v: v > TOUCHING_M2)


def _sides(df: DataFrame, identity: str, keep: list[str], geom: str, side: str) -> DataFrame:
    """One side of the join, written out once: shape, area, and of rectangles west and east in degrees, south and north as sines of
    the authalic latitude.

    The expressions are long and every step of the join reads them, so they are worked out over all tasks and not in each of them.
    """
    rows = df.select(*dict.fromkeys([identity, *keep, *spatial.BOX]), F.col(geom).alias(f"_g{side}"))
    rows = skew.over_all_tasks(rows, identity).withColumn(f"_box{side}", F.coalesce(geo.is_rectangle(F.col(f"_g{side}")), F.lit(False)))
    x0, y0, x1, y1 = (F.when(F.col(f"_box{side}"), v) for v in geo.rectangle_bounds(F.col(f"_g{side}")))
    sized = rows.withColumns({f"_w{side}": x0, f"_e{side}": x1, f"_s{side}": geo.sin_authalic(y0), f"_n{side}": geo.sin_authalic(y1)})
    return durable(sized)


def overlap_join(parcels: DataFrame, classes: DataFrame, parcel_id: str, class_id: str, keep: list[str] = (),
                 geom: str = "geom", cell: float = spatial.FINEST_CELL) -> DataFrame:
    """Overlapping pairs with the shared area and its share of the parcel.

    Rectangles meet rectangles as four numbers each, all of it compiled; only pairs with another shape carry their geometries.
    """
    a, b = _sides(parcels, parcel_id, [], geom, "a"), _sides(classes, class_id, list(keep), geom, "b")
    columns = [parcel_id, class_id, *keep, "inter_area", F.try_divide("inter_area", "_area").alias("fraction")]
    flat = AREA_FACTOR * F.radians(F.col("_ea") - F.col("_wa")) * (F.col("_na") - F.col("_sa"))
    boxes = a.filter("_boxa").withColumn("_area", flat), b.filter("_boxb")
    pairs = spatial.bbox_join(*boxes, parcel_id, class_id, ["_area", "_wa", "_ea", "_sa", "_na"], ["_wb", "_eb", "_sb", "_nb", *keep], cell=cell)
    wide, high = F.least("_ea", "_eb") - F.greatest("_wa", "_wb"), F.least("_na", "_nb") - F.greatest("_sa", "_sb")
    # with no negative width the area is positive only if both are
    area = AREA_FACTOR * F.radians(F.greatest(wide, F.lit(0.0))) * high
    found = [pairs.filter(area > TOUCHING_M2).withColumn("inter_area", area).select(*columns)]
    # one generator computes and filters: as a plain filter the long expression would be
    # copied into the join condition and evaluated twice
    for left, right in ((a.filter("NOT _boxa"), b), (a.filter("_boxa"), b.filter("NOT _boxb"))):
        if left.isEmpty() or right.isEmpty():
            continue
        left = left.withColumn("_area", geo.area_m2(F.col("_ga")))
        others = spatial.bbox_join(left, right, parcel_id, class_id, ["_ga", "_area"], ["_gb", *keep], cell=cell)
        found.append(others.withColumn("inter_area", F.explode(_positive_area())).select(*columns))
    return functools.reduce(DataFrame.unionAll, found)


def part_shares(parcels: DataFrame, classes: DataFrame, parcel_id: str, class_id: str, parts: str, part: list[str], weight: str,
                geom: str = "geom", cell: float = spatial.FINEST_CELL, candidates: int = spatial.UNIT_CANDIDATES) -> DataFrame:
    """Sum of overlap fraction x ``weight`` by parcel and part, for polygons that carry an array ``parts`` of (part, weight).

    Pairs of parcels and polygons are never shuffled nor written: each task sums whole (parcel, part) groups of its own (``spatial.home_join``).
    ``part`` names the fields that make up a part.
    """
    a, b = _sides(parcels, parcel_id, [], geom, "a"), _sides(classes, class_id, [parts], geom, "b")
    every_box = a.filter("NOT _boxa").isEmpty() and b.filter("NOT _boxb").isEmpty()
    flat = AREA_FACTOR * F.radians(F.col("_ea") - F.col("_wa")) * (F.col("_na") - F.col("_sa"))
    wide, high = F.least("_ea", "_eb") - F.greatest("_wa", "_wb"), F.least("_na", "_nb") - F.greatest("_sa", "_sb")
    area = AREA_FACTOR * F.radians(F.greatest(wide, F.lit(0.0))) * F.greatest(high, F.lit(0.0))
    sides = [["_wa", "_ea", "_sa", "_na"], ["_wb", "_eb", "_sb", "_nb"]]
    if every_box:
        a = a.withColumn("_area", flat)
        # the bounds have done their work when cells are told
        pairs = spatial.home_join(a, b, parcel_id, parts, part, ["_area", *sides[0]], sides[1], cell, candidates, bounds=False)
        met = pairs.filter(area > TOUCHING_M2).withColumn("inter_area", area)
    else:
        a = a.withColumn("_area", F.when(F.col("_boxa"), flat).otherwise(geo.area_m2(F.col("_ga"))))
        pairs = spatial.home_join(a, b, parcel_id, parts, part, ["_area", "_ga"], ["_gb"], cell, candidates)
        met = pairs.withColumn("inter_area", F.explode(_positive_area()))
    share = F.try_divide("inter_area", "_area")
    rows = met.select(*spatial.UNIT, parcel_id, share.alias("_share"), F.explode(parts).alias("_part"))
    shares = rows.groupBy(*spatial.UNIT, parcel_id, *[F.col(f"_part.{c}").alias(c) for c in part]).agg(
        F.sum(F.col("_share") * F.col(f"_part.{weight}")).alias("share_pct")).drop(*spatial.UNIT)
    if a.groupBy(parcel_id).count().filter("count > 1").isEmpty():
        return shares
    # rows of one parcel may have different homes
    return shares.groupBy(parcel_id, *part).agg(F.sum("share_pct").alias("share_pct"))


def class_shares(overlaps: DataFrame, parcel_id: str, symbol: str, description: str | None = None) -> DataFrame:
    """Share of each parcel by class in percent."""
    classes = [symbol] + ([description] if description else [])
    return overlaps.groupBy(parcel_id, *classes).agg((F.sum("fraction") * 100).alias("share_pct"))


def rank_shares(shares: DataFrame, symbol: str, *lead: str) -> DataFrame:
    return shares.orderBy(*lead, F.desc("share_pct"), F.asc(symbol))


def describe_parcel(shares: DataFrame, parcel_id: str, symbol: str, description: str | None = None) -> DataFrame:
    """Per parcel: dominant class, number of classes, described percent, ordered class list.

    Classes per parcel are few (one row per symbol), so the list is bounded.
    """
    text = F.col(description) if description else F.lit(None).cast("string")
    # rank by the unrounded share, then by symbol
    entry = F.struct(
        (-F.col("share_pct")).alias("order"), F.col(symbol).alias("symbol"), text.alias("description"),
        F.round("share_pct", 1).alias("share_pct"),
    )
    packed = shares.groupBy(parcel_id).agg(
        F.array_sort(F.collect_list(entry)).alias("classes"), F.sum("share_pct").alias("_described"))
    first = F.get("classes", F.lit(0))
    return packed.select(
        parcel_id, first["symbol"].alias("symbol"), first["description"].alias("description"),
        F.size("classes").alias("count"), F.round("_described", 1).alias("described_pct"),
        F.transform("classes", lambda c: c.dropFields("order")).alias("classes"),
    )


def coverage_with_fallback(parcels: DataFrame, first: DataFrame, second: DataFrame, parcel_id: str, symbol: str,
                           min_pct: float, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Class shares from the first release; from the second where the first describes less than
    ``min_pct`` and the second has any class.  The two are never mixed.

    ``first`` / ``second``: shares (parcel_id, symbol, share_pct).
    """
    tagged = first.withColumn("source", F.lit(names[0])).unionByName(second.withColumn("source", F.lit(names[1])))
    totals = tagged.groupBy(parcel_id).agg(
        F.coalesce(F.sum(F.when(F.col("source") == names[0], F.col("share_pct"))), F.lit(0.0)).alias("_first"),
        F.count_if(F.col("source") == names[1]).alias("_second"),
        F.count_if(F.col("source") == names[0]).alias("_n_first"),
    )
    choice = F.when((F.col("_first") < min_pct) & (F.col("_second") > 0), F.lit(names[1])).when(
        F.col("_n_first") > 0, F.lit(names[0]))
    chosen = parcels.select(parcel_id).join(totals, parcel_id, "left").select(parcel_id, choice.alias("source"))
    return chosen.join(tagged, [parcel_id, "source"], "left")

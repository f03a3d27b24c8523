"""Spatial joins as grid-cell equi-joins.

Boxes go to cells as wide as themselves (powers of two), and a pair meets on the level of its
larger box.  It is kept only in the cell that holds the lower-left corner of the common box,
so no distinct is needed.  A side whose bytes were counted is broadcast; otherwise cells
crowded on either side are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.functions.values import finite
from loamframe.operators import keys, pyramid, skew
from loamframe.session import durable

BOX = ("minx", "miny", "maxx", "maxy")
DEGREE_M = math.radians(1.0) * codes.EARTH_RADIUS_M


#: Points and tiny boxes go to cells of this width in degrees, not to narrower ones.
FINEST_CELL = 2.0**-20


def _level(minx: Column, miny: Column, maxx: Column, maxy: Column, cell: float) -> Column:
    """Level of a box: the cells of level n are 2 ** n wide, and a box touches at most 2 x 2 cells of its level."""
    extent, finest = F.greatest(maxx - minx, maxy - miny), F.lit(math.ceil(math.log2(cell)))
    return F.greatest(finest, F.coalesce(F.ceil(F.log2(extent)).cast("int"), finest))


def _side(df: DataFrame, prefix: str, identity: str, keep: list[str], cell: float) -> DataFrame:
    """Id, bounds, kept columns and level; rows whose bounds are missing, not finite or the wrong way round are left out."""
    picked = df.select(
        F.col(identity).alias(identity),
        *[finite(F.col(c).cast("double")).alias(f"_{prefix}_{c}") for c in BOX], *[c for c in keep if c != identity],
    )
    x0, y0, x1, y1 = (F.col(f"_{prefix}_{c}") for c in BOX)
    return picked.filter((x0 <= x1) & (y0 <= y1)).withColumn("_level", _level(x0, y0, x1, y1, cell))


def _measure(a: DataFrame, b: DataFrame, held: tuple[list[str], list[str]]) -> tuple[list[dict[int, tuple[int, int]]], float]:
    """Per side: level -> (rows, bytes), and about how many pairs to expect.  One job; its result has a row for each level
    that occurs (some tens)."""
    parts = [df.select(F.lit(n).alias("side"), "_level", skew.row_bytes(df, columns).alias("bytes"), *[F.col(f"_{p}_{c}").alias(c) for c in BOX])
             for n, (df, columns, p) in enumerate(zip((a, b), held, "ab"))]
    found = parts[0].unionAll(parts[1]).groupBy("side", "_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)],
        F.sum(F.col("maxx") - F.col("minx")).alias("wide"), F.sum(F.col("maxy") - F.col("miny")).alias("high")).collect()
    sides: list[dict[int, tuple[int, int]]] = [{}, {}]
    for row in found:
        sides[row["side"]][row["_level"]] = (row["n"], row["bytes"])
    return sides, _expected([[row for row in found if row["side"] == side] for side in (0, 1)])


def _expected(sides: list[list]) -> float:
    """Pairs to expect of boxes that are spread evenly."""
    if not all(sides):
        return 0.0
    rows = [sum(r["n"] for r in side) for side in sides]
    share = 1.0
    for low, high, extent in (("minx", "maxx", "wide"), ("miny", "maxy", "high")):
        spans = [(min(r[low] for r in side), max(r[high] for r in side)) for side in sides]
        together = max(s[1] for s in spans) - min(s[0] for s in spans)
        mean = sum(sum(r[extent] for r in side) / n for side, n in zip(sides, rows))
        share *= min(1.0, mean / together) if together > 0 else 1.0
    return rows[0] * rows[1] * share


#: Entries of a side for each task of a join.
TASK_ROWS = 200_000
#: Pairs to expect of a task, and most tasks that these ask for.
TASK_PAIRS, MOST_TASKS = 1_000_000, 4_000


def _tasks(spark, rows: int, pairs: float = 0.0) -> int:
    """Tasks of a join: all cores, and more where there are many entries or pairs."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS),
               min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS)))


def _entries(df: DataFrame, prefix: str, meets: Column, role: str) -> DataFrame:
    """One row for each cell of each level in which rows of the other side are to be met."""
    box = [F.col(f"_{prefix}_{c}") for c in BOX]
    placed = df.withColumn("_at", F.explode(meets)).drop("_level").withColumn("_cell", F.explode(geo.cells(*box, F.col("_at.size"))))
    columns = [F.col("_at.grid").alias("_grid"), F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy")]
    size = [F.col("_at.size").alias("_size")] if role == "left" else []
    return placed.select("*", *columns, *size).drop("_at", "_cell")


def _levels(levels, tag: int) -> Column:
    """Levels as literals: (level, cell width, join key); widths are powers of two, so cells nest exactly."""
    return F.array(*[F.struct(F.lit(n).alias("level"), F.lit(2.0**n).alias("size"), F.lit(2 * n + tag).alias("grid")) for n in sorted(levels)])


def bbox_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keep_left: list[str] = (),
              keep_right: list[str] = (), hot_rows: int = skew.HOT_ROWS, broadcast_bytes: int = skew.BROADCAST_BYTES,
              cell: float = FINEST_CELL) -> DataFrame:
    """Pairs of rows with overlapping boxes (touching counts): ids plus the kept columns (names must differ).

    A pair meets on the level of its larger box: there the larger box touches at most 2 x 2 cells, and so does the
    smaller one.  A row thus goes to its own cells and to those of the larger levels that the other side really has,
    and its kept columns are never copied more often than that, whatever the extent of the layer.
    Rows whose bounds are missing, not finite or the wrong way round meet nothing.
    """
    a = _side(left, "a", left_id, list(keep_left), cell)
    b = _side(right, "b", right_id, list(keep_right), cell)
    (of_a, of_b), expected = _measure(a, b, ([left_id, *keep_left], [right_id, *keep_right]))
    la, lb = of_a or {0: (0, 0)}, of_b or {0: (0, 0)}
    own = F.col("_level")
    # grid 2n: rows of b on their own level n, met by rows of a of that level or below; grid 2n + 1: the other way, strictly below
    meets_a = F.concat(F.filter(_levels(lb, 0), lambda at: at["level"] >= own),
                       F.filter(_levels([n for n in la if n > min(lb)] or [min(la)], 1), lambda at: (at["level"] == own) & (own > min(lb))))
    meets_b = F.concat(F.filter(_levels(lb, 0), lambda at: (at["level"] == own) & (own >= min(la))),
                       F.filter(_levels(la, 1), lambda at: at["level"] > own))
    copies_a = {n: 4 * (sum(m >= n for m in lb) + (n > min(lb))) for n in la}
    copies_b = {n: 4 * ((n >= min(la)) + sum(m > n for m in la)) for n in lb}
    rows = [sum(side[n][0] * c[n] for n in side) for side, c in ((la, copies_a), (lb, copies_b))]
    size = [sum((side[n][1] + 64 * side[n][0]) * c[n] for n in side) for side, c in ((la, copies_a), (lb, copies_b))]
    on = ["_grid", "_cx", "_cy"]
    # bytes say little about the pairs that rows give: tasks are told by number, so that small files are not one task
    tasks = _tasks(left.sparkSession, max(rows), expected)
    small_b = size[1] <= broadcast_bytes and size[1] <= size[0] or size[0] > broadcast_bytes >= size[1]
    if small_b:
        a = a.repartition(tasks, left_id, *[f"_a_{c}" for c in BOX])
    elif size[0] <= broadcast_bytes:
        b = b.repartition(tasks, right_id, *[f"_b_{c}" for c in BOX])
    elif max(rows) > hot_rows:
        # a few small files may hold all rows: no task is to write the entries of all of them
        spread = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(max(rows) / TASK_ROWS))
        a, b = a.repartition(spread, left_id, *[f"_a_{c}" for c in BOX]), b.repartition(spread, right_id, *[f"_b_{c}" for c in BOX])
    a, b = _entries(a, "a", meets_a, "left"), _entries(b, "b", meets_b, "right")
    if small_b:
        pairs = a.join(F.broadcast(b), on)
    elif size[0] <= broadcast_bytes:
        pairs = F.broadcast(a).join(b, on)
    elif max(rows) <= hot_rows:  # no cell can be crowded
        pairs = a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on)
    else:
        pairs = skew.salted_join(a, b, on, F.col(left_id), hot_rows=hot_rows, spread_right=F.col(right_id), tasks=tasks)
    ax0, ay0, ax1, ay1 = (F.col(f"_a_{c}") for c in BOX)
    bx0, by0, bx1, by1 = (F.col(f"_b_{c}") for c in BOX)
    home = (geo.cell_of(F.greatest(ax0, bx0), F.col("_size")) == F.col("_cx")) & (
        geo.cell_of(F.greatest(ay0, by0), F.col("_size")) == F.col("_cy"))
    overlap = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    return pairs.filter(home & overlap).drop(*on, "_size", *[f"_{s}_{c}" for s in "ab" for c in BOX])


#: Cells that a row of the right side goes to on average, for each home level of the left side.
HOME_COPIES = 5.0
#: Candidates of a unit of ``home_join``: its left rows times the parts of its right rows.
UNIT_CANDIDATES = 1_000_000
#: Columns of a unit: a left row and a part meet in one unit only, and a unit is never divided between tasks.
UNIT = ["_grid", "_cx", "_cy", "_deal_l", "_deal_r"]


def _homes(levels: dict[int, tuple[float, float]], right) -> dict[int, tuple[float, float]]:
    """Home level -> widest and highest left row there.  Levels of small boxes are put together until rows of the right side
    go to few cells."""
    base = min(levels)
    while True:
        homes: dict[int, tuple[float, float]] = {}
        for level, (wide, high) in levels.items():
            w, h = homes.get(max(level, base), (0.0, 0.0))
            homes[max(level, base)] = max(w, wide), max(h, high)
        reach = [(w + 2.0**n, h + 2.0**n, 4.0**n) for n, (w, h) in homes.items()]
        entries = sum((right["n"] * w * h + w * right["high"] + h * right["wide"] + right["both"]) / area for w, h, area in reach)
        if entries <= HOME_COPIES * len(homes) * right["n"]:
            return homes
        base += 1


def home_join(left: DataFrame, right: DataFrame, left_id: str, parts: str, part: list[str], keep_left: list[str] = (), keep_right: list[str] = (),
              cell: float = FINEST_CELL, candidates: int = UNIT_CANDIDATES, bounds: bool = True) -> DataFrame:
    """Candidate pairs for sums by left row and part: the ids of left, kept columns, some entries of the array ``parts`` and ``UNIT``.

    A left row stays in one cell, that of its lower-left corner, and right rows go to all cells that such rows reach.  Crowded
    cells are dealt by the fields ``part`` (left rows are copied, parts are not) or, with more left rows than parts, by ``left_id``.  So all that
    concerns one left row and one part lies in one unit: a grouping by ``UNIT``, ``left_id`` and the part needs no shuffle of pairs.
    With ``bounds=False`` the caller tests the pairs: only their cells are known to agree.
    """
    spark = left.sparkSession
    a, b = _side(left, "a", left_id, list(keep_left), cell), _side(right, "b", parts, list(keep_right), cell)
    ax0, ay0, ax1, ay1 = (F.col(f"_a_{c}") for c in BOX)
    bx0, by0, bx1, by1 = (F.col(f"_b_{c}") for c in BOX)
    levels = {r["_level"]: (r["wide"], r["high"]) for r in a.groupBy("_level").agg(F.max(ax1 - ax0).alias("wide"), F.max(ay1 - ay0).alias("high")).collect()}
    wide, high = bx1 - bx0, by1 - by0
    sums = b.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(c) for c, v in (("wide", wide), ("high", high), ("both", wide * high))]).first()
    homes = _homes(levels or {0: (0.0, 0.0)}, sums)
    sizes = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(2.0**n).alias("size"), F.lit(w * (1 + 1e-9)).alias("wide"), F.lit(h * (1 + 1e-9)).alias("high"))
                      for n, (w, h) in sorted(homes.items())])
    at = F.get(F.filter(sizes, lambda s: s["level"] == F.greatest(F.col("_level"), F.lit(min(homes)))), F.lit(0))
    a = a.withColumn("_at", at).withColumns({"_grid": F.col("_at.level"), "_cx": geo.cell_of(ax0, F.col("_at.size")), "_cy": geo.cell_of(ay0, F.col("_at.size"))})
    a = a.drop("_at", "_level")
    b = b.withColumn("_at", F.explode(sizes)).withColumn("_grid", F.col("_at.level"))
    for name, low, top, extent in (("_cx", bx0, bx1, "wide"), ("_cy", by0, by1, "high")):
        # a little more against rounding
        first = low - F.col(f"_at.{extent}") - F.abs(low) * 1e-12
        b = b.withColumn(name, F.explode(F.sequence(geo.cell_of(first, F.col("_at.size")), geo.cell_of(top, F.col("_at.size")))))
    b = b.drop("_at", "_level")
    place = UNIT[:3]
    of_a = a.groupBy(*place).agg(F.count(F.lit(1)).alias("_nl"))
    of_b = b.groupBy(*place).agg(F.sum(F.size(parts)).alias("_nr"))
    crowd = durable(of_a.join(of_b, place).withColumn("_deals", F.ceil(F.col("_nl").cast("double") * F.col("_nr") / candidates)))
    counted = crowd.agg(F.sum("_deals").alias("units"), F.sum(F.col("_nl").cast("double") * F.col("_nr")).alias("pairs")).first()
    by_left = F.col("_nl") > F.col("_nr")
    hot = F.broadcast(crowd.filter("_deals > 1").select(
        *place, F.when(by_left, F.least("_deals", "_nl")).otherwise(1).cast("int").alias("_of_l"),
        F.when(by_left, 1).otherwise(F.least("_deals", "_nr")).cast("int").alias("_of_r")))
    of_l, of_r = F.coalesce("_of_l", F.lit(1)), F.coalesce("_of_r", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = a.join(hot, place, "left").withColumn("_deal_l", F.pmod(F.xxhash64(left_id), of_l).cast("int")).withColumn("_deal_r", every(of_r)).drop("_of_l", "_of_r")
    b = b.join(hot, place, "left").withColumn("_deal_l", every(of_l)).withColumn("_deal_r", every(of_r))
    own = F.filter(parts, lambda p: F.pmod(F.xxhash64(*[p[c] for c in part]), F.col("_of_r")) == F.col("_deal_r"))
    b = b.withColumn(parts, F.when(of_r > 1, own).otherwise(F.col(parts))).filter(F.size(parts) > 0).drop("_of_l", "_of_r")
    tasks = max(_tasks(spark, 0), min(MOST_TASKS, math.ceil((counted["pairs"] or 0.0) / (2 * candidates))))
    boxes = [f"_{s}_{c}" for s in "ab" for c in BOX]
    # a merge by name, here and below: Spark takes exploded entries for no larger than their table, and would broadcast them
    if not bounds:
        return a.drop(*boxes).repartition(tasks, *UNIT).join(b.drop(*boxes).repartition(tasks, *UNIT).hint("merge"), UNIT)
    pairs = a.repartition(tasks, *UNIT).join(b.repartition(tasks, *UNIT).hint("merge"), UNIT)
    return pairs.filter((ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)).drop(*boxes)


def as_boxes(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Bounds columns of points."""
    return points.withColumns({"minx": F.col(x), "miny": F.col(y), "maxx": F.col(x), "maxy": F.col(y)})


#: Polygons with more vertices are cut into bands of latitude with about half as many edges.
BAND_POINTS = 256


def polygon_bands(polygons: DataFrame, polygon_id: str, geom: str = "geom", band_points: int = BAND_POINTS) -> DataFrame:
    """Polygons as horizontal bands: (id, _shape, _band, bounds, _low, _step, _last, _edges).

    An edge belongs to each band that it touches, whole, so that a test against the edges of a point's band takes the
    same numbers as a test against all.  ``_shape`` tells different geometries of one id apart.
    """
    count = F.ceil(geo.num_points(F.col(geom)) / F.lit(band_points / 2.0)).cast("int")
    low, high = F.col("miny").cast("double"), F.col("maxy").cast("double")
    rings = polygons.select(
        F.col(polygon_id).alias("_owner"), F.xxhash64(geom).alias("_shape"), F.col("minx").alias("minx"), F.col("maxx").alias("maxx"),
        low.alias("_low"), F.try_divide(high - low, count).alias("_step"), (count - 1).alias("_last"), F.posexplode(F.col(f"{geom}.parts")).alias("_p", "_ring"))
    corners = rings.select("*", F.posexplode(F.arrays_zip(
        F.slice("_ring.xs", F.lit(1), F.size("_ring.xs") - 1).alias("x1"), F.slice("_ring.ys", F.lit(1), F.size("_ring.ys") - 1).alias("y1"),
        F.slice("_ring.xs", F.lit(2), F.size("_ring.xs") - 1).alias("x2"), F.slice("_ring.ys", F.lit(2), F.size("_ring.ys") - 1).alias("y2"),
    )).alias("_i", "_e")).drop("_ring")
    sloping = corners.filter(F.col("_e.y1") != F.col("_e.y2"))  # a level edge is never crossed
    reach = F.sequence(band_of(F.least("_e.y1", "_e.y2")), band_of(F.greatest("_e.y1", "_e.y2")))
    keyed = sloping.withColumn("_band", F.explode(reach))
    packed = keyed.groupBy("_owner", "_shape", "_band", "minx", "maxx", "_low", "_step", "_last").agg(
        F.collect_set(F.struct("_p", "_i", "_e.x1", "_e.y1", "_e.x2", "_e.y2")).alias("_edges"))  # a set: repeated rows are one polygon
    margin = F.col("_step") * 1e-6 + F.abs("_low") * 1e-12  # the band itself is decided by band_of
    return packed.withColumns({
        "miny": F.col("_low") + F.col("_band") * F.col("_step") - margin,
        "maxy": F.col("_low") + (F.col("_band") + 1) * F.col("_step") + margin}).withColumnRenamed("_owner", polygon_id)


def band_of(y: Column) -> Column:
    """Band of a latitude in a row with ``_low``, ``_step`` and ``_last``."""
    number = F.floor(F.try_divide(y - F.col("_low"), F.col("_step"))).cast("int")
    return F.greatest(F.lit(0), F.least(F.col("_last"), number))


#: Sides of a rectangle, NULL for other shapes, and the geometry of those.
SIDES = ("_x0", "_y0", "_x1", "_y1")


def with_box(df: DataFrame, geom: str, suffix: str = "") -> DataFrame:
    """Rectangles as four numbers, other shapes as ``_shape``: nothing of a rectangle's arrays is carried into a join."""
    box = geo.is_rectangle(F.col(geom))
    sides = {f"{c}{suffix}": F.when(box, v) for c, v in zip(SIDES, geo.rectangle_bounds(F.col(geom)))}
    return df.withColumns({**sides, f"_shape{suffix}": F.when(~box, F.col(geom))})


def _kinds(polygons: DataFrame, geom: str, large: Column) -> tuple[bool, bool]:
    """Are all shapes rectangles, and is any polygon large?  One pass."""
    box = geo.is_rectangle(F.col(geom))
    row = polygons.agg(F.bool_and(box).alias("boxes"), F.bool_or(large & (F.col(f"{geom}.kind") == "POLYGON")).alias("large")).first()
    return bool(row["boxes"]), bool(row["large"])


def _held(every_box: bool, suffix: str = "") -> list[str]:
    return [f"{c}{suffix}" for c in (SIDES if every_box else (*SIDES, "_shape"))]


def _inside(every_box: bool, x: Column, y: Column) -> Column:
    """Is the point in the polygon of ``with_box``?  The sides of a rectangle answer alone."""
    in_box = geo.box_contains(*[F.col(c) for c in SIDES], x, y)
    return in_box if every_box else F.when(F.col("_x0").isNotNull(), in_box).otherwise(geo.contains_point(F.col("_shape"), x, y))


def _whole(suffix: str) -> Column:
    """The geometry again, from the sides where it is a rectangle."""
    return F.when(F.col(f"_x0{suffix}").isNotNull(), geo.rectangle(*[F.col(f"{c}{suffix}") for c in SIDES])).otherwise(F.col(f"_shape{suffix}"))


def spatial_join(polygons: DataFrame, points: DataFrame, polygon_id: str, point_id: str, keep_polygon: list[str] = (),
                 keep_point: list[str] = (), x: str = "x", y: str = "y", geom: str = "geom", band_points: int = BAND_POINTS,
                 cell: float = FINEST_CELL) -> DataFrame:
    """Points in polygons, many to many.

    A point meets the whole of a small polygon, but of one with more than ``band_points`` vertices only the edges in its
    band of latitude, so a coast of a million vertices costs a point some hundred of them.
    """
    carried = list(dict.fromkeys([*keep_point, x, y]))
    boxed, large = as_boxes(points, x, y), geo.num_points(F.col(geom)) > band_points
    every_box, any_giant = _kinds(polygons, geom, large)
    columns = [point_id, polygon_id, *carried, *keep_polygon]
    small = with_box(polygons.filter(F.coalesce(~large, F.lit(True))), geom)
    pairs = bbox_join(boxed, small, point_id, polygon_id, carried, [*_held(every_box), *keep_polygon], cell=cell)
    hit = pairs.filter(_inside(every_box, F.col(x), F.col(y))).select(*columns)
    if not any_giant:
        return hit
    giants = polygons.filter(large & (F.col(f"{geom}.kind") == "POLYGON"))
    bands = durable(polygon_bands(giants, polygon_id, geom, band_points).withColumn("_key", F.struct(polygon_id, "_shape", "_band")).drop(polygon_id, "_shape"))
    near = bbox_join(boxed, bands, point_id, "_key", carried, ["_low", "_step", "_last", "_edges"], cell=cell)
    crossed = F.filter("_edges", lambda e: ((e["y1"] > F.col(y)) != (e["y2"] > F.col(y))) & (
        F.col(x) < e["x1"] + F.try_divide((F.col(y) - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])))
    inside = near.filter((F.col("_key._band") == band_of(F.col(y))) & (F.size(crossed) % 2 == 1))
    owners = giants.select(F.col(polygon_id).alias("_owner"), F.xxhash64(geom).alias("_shape"), *[c for c in keep_polygon if c != polygon_id])
    found = inside.select(point_id, *[c for c in carried if c != point_id], F.col(f"_key.{polygon_id}").alias("_owner"), F.col("_key._shape").alias("_shape"))
    return hit.unionByName(found.join(owners, ["_owner", "_shape"]).withColumnRenamed("_owner", polygon_id).select(*columns))


def first_match_label(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, label: str,
                      x: str = "x", y: str = "y", geom: str = "geom") -> DataFrame:
    """Every point with the label of its first polygon (by polygon id), NULL when none.  Points at one place are looked up once."""
    spots = durable(points.select(F.col(x).alias("_sx"), F.col(y).alias("_sy")).distinct()).withColumn("_spot", F.struct("_sx", "_sy"))
    if polygons.groupBy(polygon_id).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        # numbers are reduced in place, so hits are never sorted or held; labels follow by id
        hits = spatial_join(polygons, spots, polygon_id, "_spot", [], [], "_sx", "_sy", geom)
        lowest = hits.groupBy("_sx", "_sy").agg(F.min(polygon_id).alias("_first"))
        first = lowest.join(polygons.select(F.col(polygon_id).alias("_first"), label), "_first").select("_sx", "_sy", label)
    else:
        hits = spatial_join(polygons, spots, polygon_id, "_spot", [label], [], "_sx", "_sy", geom)
        first = hits.groupBy("_sx", "_sy").agg(F.min_by(label, polygon_id).alias(label))
    return points.join(first, (F.col(x) == F.col("_sx")) & (F.col(y) == F.col("_sy")), "left").drop("_sx", "_sy")


#: Layers with fewer entries meet themselves through ``bbox_join``, which broadcasts small sides.
SELF_ROWS = 200_000


def _self_join(df: DataFrame, identity: str, keep: list[str], hot_rows: int = skew.HOT_ROWS) -> DataFrame | None:
    """Pairs of rows of one table with overlapping boxes, each once (id_a < id_b, kept columns with a and b behind their names); None if the
    table is small or a cell crowded.

    Both sides are the same entries, so these are shuffled once: a row goes to its own cells and to those of all larger levels.
    """
    rows = _side(df, "e", identity, keep, FINEST_CELL)
    x0, y0, x1, y1 = (F.col(f"_e_{c}") for c in BOX)
    found = rows.groupBy("_level").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(name) for f, c, name in zip((F.min, F.min, F.max, F.max), (x0, y0, x1, y1), BOX)],
                                       F.sum(x1 - x0).alias("wide"), F.sum(y1 - y0).alias("high")).collect()
    entries_of = {r["_level"]: 4 * r["n"] * sum(s["_level"] >= r["_level"] for s in found) for r in found}
    entries = sum(entries_of.values())
    if entries <= SELF_ROWS:
        return None
    tasks = _tasks(df.sparkSession, entries, _expected([found, found]) / 2)
    # a few small files may hold all rows: no task is to write the entries of all of them
    spread = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(entries / TASK_ROWS))
    placed = rows.repartition(spread, identity, x0, y0, x1, y1)
    placed = placed.withColumn("_at", F.explode(F.filter(_levels(entries_of, 0), lambda at: at["level"] >= F.col("_level"))))
    placed = placed.withColumn("_cell", F.explode(geo.cells(x0, y0, x1, y1, F.col("_at.size"))))
    on = ["_grid", "_cx", "_cy"]
    placed = placed.select("*", F.col("_at.level").alias("_grid"), F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy"),
                           (F.col("_at.level") == F.col("_level")).alias("_own")).drop("_at", "_cell", "_level")
    if entries > hot_rows and not skew.hot_keys(placed.select(*on), on, hot_rows).isEmpty():
        return None
    placed = placed.repartition(tasks, *on)
    a, b = ([F.col(identity).alias(f"id_{c}"), F.col("_own").alias(f"_own{c}"), *[F.col(f"_e_{k}").alias(f"_{c}_{k}") for k in BOX], *[F.col(k).alias(f"{k}{c}") for k in keep]]
            for c in "ab")
    met = placed.select(*on, *a).join(placed.select(*on, *b).hint("merge"), on).filter((F.col("id_a") < F.col("id_b")) & (F.col("_owna") | F.col("_ownb")))
    ax0, ay0, ax1, ay1 = (F.col(f"_a_{c}") for c in BOX)
    bx0, by0, bx1, by1 = (F.col(f"_b_{c}") for c in BOX)
    size = F.pow(F.lit(2.0), F.col("_grid"))
    home = (geo.cell_of(F.greatest(ax0, bx0), size) == F.col("_cx")) & (geo.cell_of(F.greatest(ay0, by0), size) == F.col("_cy"))
    overlap = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    return met.filter(overlap & home).select("id_a", "id_b", *[f"{k}{c}" for c in "ab" for k in keep])


def overlapping_pairs(polygons: DataFrame, identity: str, geom: str = "geom") -> DataFrame:
    """All intersecting pairs of a layer, in both directions."""
    every_box, _ = _kinds(polygons, geom, F.lit(False))
    # boxes of rectangles meet as soon as their bounds do
    held = [] if every_box else [*SIDES, "_shape"]
    rows = with_box(polygons, geom)
    pairs = _self_join(rows, identity, held)
    if pairs is None:
        sides = [rows.withColumnsRenamed({identity: f"id_{c}"} | {k: f"{k}{c}" for k in (*SIDES, "_shape")}) for c in "ab"]
        pairs = bbox_join(*sides, "id_a", "id_b", *[[f"{k}{c}" for k in held] for c in "ab"])
    if not every_box:
        boxes = F.col("_x0a").isNotNull() & F.col("_x0b").isNotNull()
        pairs = pairs.filter(F.when(boxes, F.lit(True)).otherwise(geo.intersects(_whole("a"), _whole("b"))))
    once = pairs.filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    both = F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))))
    return once.select(both.alias("p")).select("p.*")


def pad_box(df: DataFrame, metres: float | Column) -> DataFrame:
    """Bounds grown by a distance in metres (the longitude side by the far latitude)."""
    grow = metres if isinstance(metres, Column) else F.lit(float(metres))
    lat = F.least(F.lit(89.0), F.greatest(F.abs("miny"), F.abs("maxy")) + grow / DEGREE_M)
    dy, dx = grow / DEGREE_M * 1.001, grow / (DEGREE_M * F.cos(F.radians(lat))) * 1.001
    return df.withColumns({
        "minx": F.col("minx") - dx, "miny": F.col("miny") - dy, "maxx": F.col("maxx") + dx, "maxy": F.col("maxy") + dy,
    })


def within_distance(parcels: DataFrame, fields: DataFrame, parcel_id: str, field_id: str, flag: str,
                    tolerance_m: float) -> DataFrame:
    """Fields within a tolerance of each parcel, flagged ones first, then by distance."""
    every_box, _ = _kinds(parcels, "geom", F.lit(False))
    point = F.coalesce(F.col("geom.kind") == "POINT", F.lit(False))
    every_point = bool(fields.agg(F.bool_and(point)).first()[0])
    if every_point:
        return _points_within(parcels, fields, every_box, parcel_id, field_id, flag, tolerance_m)
    a = with_box(pad_box(parcels, tolerance_m), "geom", "a")
    part = F.get("geom.parts", F.lit(0))
    b = fields.withColumns({"_px": F.when(point, F.get(part["xs"], F.lit(0))), "_py": F.when(point, F.get(part["ys"], F.lit(0))), "_gb": F.col("geom")})
    pairs = bbox_join(a, b, parcel_id, field_id, _held(every_box, "a"), ["_px", "_py", flag, "_gb"])
    shape = _whole("a") if not every_box else geo.rectangle(*[F.col(f"{c}a") for c in SIDES])
    distance = F.when(F.col("_x0a").isNotNull() & F.col("_px").isNotNull(), _box_distance()).otherwise(geo.distance_m(shape, F.col("_gb")))
    near = pairs.withColumn("_d", distance).filter(F.col("_d") <= tolerance_m)
    return near.select(parcel_id, field_id, flag, F.round("_d", 1).alias("dist_m"))


def _box_distance() -> Column:
    """Metres from (_px, _py) to the rectangle of ``with_box``, 0 inside: the foot is the point itself."""
    x, y, sides = F.col("_px"), F.col("_py"), [F.col(f"{c}a") for c in SIDES]
    return geo.haversine_m(x, y, F.greatest(sides[0], F.least(sides[2], x)), F.greatest(sides[1], F.least(sides[3], y)))


def _points_within(parcels: DataFrame, fields: DataFrame, every_box: bool, parcel_id: str, field_id: str, flag: str, tolerance_m: float) -> DataFrame:
    """``within_distance`` of points: a place is measured once, however many fields lie there."""
    part = F.get("geom.parts", F.lit(0))
    placed = fields.select(field_id, flag, F.get(part["xs"], F.lit(0)).alias("_px"), F.get(part["ys"], F.lit(0)).alias("_py"))
    spots = durable(placed.select("_px", "_py").distinct()).withColumn("_spot", F.struct("_px", "_py"))
    a = with_box(pad_box(parcels, tolerance_m), "geom", "a")
    pairs = bbox_join(a, as_boxes(spots, "_px", "_py"), parcel_id, "_spot", _held(every_box, "a"), ["_px", "_py"])
    distance = _box_distance()
    if not every_box:
        distance = F.when(F.col("_x0a").isNotNull(), distance).otherwise(geo.distance_m(_whole("a"), geo.point(F.col("_px"), F.col("_py"))))
    near = pairs.withColumn("_d", distance).filter(F.col("_d") <= tolerance_m).select(parcel_id, "_px", "_py", F.round("_d", 1).alias("dist_m"))
    near = durable(near)
    copies = placed.count() / max(1, spots.count())
    tasks = _tasks(parcels.sparkSession, 0, near.count() * copies)
    return skew.salted_join(near, placed, ["_px", "_py"], F.col(parcel_id), spread_right=F.col(field_id), tasks=tasks).select(
        parcel_id, field_id, flag, "dist_m")


def flag_then_distance(matches: DataFrame, flag: str, *lead: str) -> DataFrame:
    return matches.orderBy(*lead, F.desc(flag), F.asc("dist_m"))


def k_nearest(candidates: DataFrame, group: str, distance: str, tie: str, k: int) -> DataFrame:
    """k best candidates per group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(distance, tie))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(parcels: DataFrame, features: DataFrame, parcel_id: str, feature_id: str, x: str, y: str, k: int,
            max_degrees: Column, geom: str = "geom", keep: list[str] = ()) -> DataFrame:
    """k planar-nearest features per point: (parcel_id, _px, _py, feature_id, planar, rank, geometry, kept).

    At most ``max_degrees`` away (it may use ``_py``); 0 inside a polygon; ties go to the lower id.  The search goes down a pyramid
    of cells (``pyramid``), so a point meets about k features however dense the layer is around it.
    """
    points = parcels.select(F.col(parcel_id).alias("_who"), F.col(x).alias("_px"), F.col(y).alias("_py")).withColumn("_max", max_degrees.cast("double"))
    points = durable(points.filter("_px IS NOT NULL AND _py IS NOT NULL").withColumnsRenamed({"_px": "px", "_py": "py"}))
    spots = durable(points.select("px", "py", "_max").distinct())
    if 2 * spots.count() <= points.count():  # many points at few places: a place is searched once
        best = _best(spots.withColumn("_who", F.struct("px", "py", "_max")), features, feature_id, k, geom).select("_who.*", "_f", "planar", "rank")
        best = best.join(points, ["px", "py", "_max"])
    else:
        best = _best(points, features, feature_id, k, geom)
    named = best.select(F.col("_who").alias(parcel_id), F.col("px").alias("_px"), F.col("py").alias("_py"), "_f", "planar", "rank")
    return named.join(features.select(F.col(feature_id).alias("_f"), geom, *keep), "_f").withColumnRenamed("_f", feature_id)


def _best(points: DataFrame, features: DataFrame, feature_id: str, k: int, geom: str) -> DataFrame:
    """The k nearest features of each point (``_who``, px, py, ``_max``)."""
    layer = pyramid.Pyramid(features, feature_id, geom)
    found = pyramid.near_features(points, layer, k)
    polygons = features.filter(F.col(f"{geom}.kind") == "POLYGON")
    if not polygons.isEmpty():
        inside = spatial_join(polygons, points, feature_id, "_who", x="px", y="py", geom=geom).select("_who", F.col(feature_id).alias("_f"))
        found = found.unionByName(inside.withColumn("planar", F.lit(0.0)))
    found = found.groupBy("_who", "_f").agg(F.min("planar").alias("planar"))
    reach = found.join(points, "_who").filter(F.col("planar") <= F.col("_max"))
    # distances equal to nine decimals are a tie, whatever the order of arithmetic left in the last bits
    return k_nearest(reach.withColumn("_about", F.round("planar", 9)), "_who", "_about", "_f", k).select("_who", "px", "py", "_f", "planar", "rank")


def degrees_for(metres: float, y: Column) -> Column:
    """Planar radius in degrees that is sure to hold everything within a distance."""
    return F.lit(metres) / (DEGREE_M * F.cos(F.radians(F.least(F.lit(88.0), F.abs(y) + metres / DEGREE_M)))) * 1.01


def nearest_distance(parcels: DataFrame, features: DataFrame, parcel_id: str, feature_id: str, x: str, y: str,
                     max_m: float, k: int = 5, geom: str = "geom") -> DataFrame:
    """Distance in metres to the nearest feature, from k planar candidates; NULL beyond ``max_m``."""
    best = nearest(parcels, features, parcel_id, feature_id, x, y, k, degrees_for(max_m, F.col("_py")), geom)
    metres = geo.point_distance_m(F.col(geom), F.col("_px"), F.col("_py"))
    shortest = best.groupBy(parcel_id).agg(F.min(metres).alias("distance_m"))
    capped = shortest.withColumn("distance_m", F.when(F.col("distance_m") <= max_m, F.col("distance_m")))
    return parcels.select(parcel_id).join(capped, parcel_id, "left")


def nearest_with_data(parcels: DataFrame, observations: DataFrame, stations: DataFrame, parcel_id: str, station_id: str,
                      value: str) -> DataFrame:
    """Nearest station (planar) that has any value, with its sum and count; NULL where no station has one.

    Distance is no limit.

    Stations are reduced to one row each first, so the search never sees observations.
    """
    totals = observations.groupBy(station_id).agg(F.sum(finite(F.col(value))).alias("total"), F.count(finite(F.col(value))).alias("n_values"))
    usable = stations.join(totals.filter(F.col("n_values") > 0), station_id).withColumn(
        "geom", geo.point(F.col("lon"), F.col("lat")))
    boxed = as_boxes(usable, "lon", "lat")
    best = nearest(parcels, boxed, parcel_id, station_id, "x", "y", 1, F.lit(1000.0), keep=["total", "n_values"])
    return parcels.select(parcel_id).join(best.select(parcel_id, station_id, "total", "n_values"), parcel_id, "left")


def point_hit(clicks: DataFrame, features: DataFrame, click_id: str, feature_id: str, pad: float = 0.0002,
              geom: str = "geom") -> DataFrame:
    """First feature containing each clicked point, else the first candidate near it."""
    boxed = clicks.withColumns({
        "minx": F.col("x") - pad, "miny": F.col("y") - pad, "maxx": F.col("x") + pad, "maxy": F.col("y") + pad})
    every_box, _ = _kinds(features, geom, F.lit(False))
    pairs = bbox_join(boxed, with_box(features, geom), click_id, feature_id, ["x", "y"], _held(every_box))
    # two least ids instead of a least struct: numbers are reduced in place, pairs are never sorted
    ids = pairs.select(click_id, F.col(feature_id).alias("_near"), F.when(_inside(every_box, F.col("x"), F.col("y")), F.col(feature_id)).alias("_in"))
    return ids.groupBy(click_id).agg(F.min("_in").alias("_in"), F.min("_near").alias("_near")).select(
        click_id, F.coalesce("_in", "_near").alias(feature_id), F.col("_in").isNotNull().alias("contains"))


def field_sample_stats(fields: DataFrame, samples: DataFrame, soils: DataFrame, field_id: str = "gid",
                       sample_id: str = "pid", value: str = "som", soil: str = "symbol") -> DataFrame:
    """Per field: sample count, mean, population deviation and sorted soil classes of its samples;
    fields without any class are left out."""
    labelled = first_match_label(samples, soils.withColumnRenamed("geom", "_soil"), sample_id, "soil_id", soil,
                                 geom="_soil")
    # samples at one place meet fields once, as sums about the mean of all samples (which keeps the squares small)
    number = finite(F.col(value))
    centre = F.lit(float(samples.agg(F.avg(number)).first()[0] or 0.0))
    off = number - centre
    by_place = durable(labelled.groupBy("x", "y", soil).agg(F.count(number).alias("_n"), F.sum(off).alias("_o"), F.sum(off * off).alias("_q")))
    spots = by_place.withColumn("_spot", F.struct("x", "y", soil))
    met = spatial_join(fields, spots, field_id, "_spot", [], [soil, "_n", "_o", "_q"])
    sums = met.groupBy(field_id, soil).agg(F.sum("_n").alias("n"), F.sum("_o").alias("_o"), F.sum("_q").alias("_q"))
    mean = F.try_divide("_o", "n")
    by_class = sums.select(field_id, soil, "n", (F.col("_o") + centre * F.col("n")).alias("s"),
                           F.greatest(F.try_divide("_q", "n") - mean * mean, F.lit(0.0)).alias("v"))
    return _stats_of_classes(by_class, field_id, soil)


def sample_stats(joined: DataFrame, field_id: str, value: str, soil: str) -> DataFrame:
    number = finite(F.col(value))
    by_class = joined.groupBy(field_id, soil).agg(F.count(number).alias("n"), F.sum(number).alias("s"), F.var_pop(number).alias("v"))
    return _stats_of_classes(by_class, field_id, soil)


def _stats_of_classes(by_class: DataFrame, field_id: str, soil: str) -> DataFrame:
    # a field's list is as long as its classes are many; samples are never collected
    packed = by_class.groupBy(field_id).agg(
        F.sum("n").alias("n"), F.sum("s").alias("_sum"),
        F.array_sort(F.collect_list(F.struct(F.col(soil).alias("t"), "n", "s", "v"))).alias("_by"))
    mean = packed.withColumn("m", F.try_divide("_sum", "n"))
    gap = lambda b: b["s"] / b["n"] - F.col("m")
    squares = F.aggregate(F.filter("_by", lambda b: b["n"] > 0), F.lit(0.0), lambda acc, b: acc + b["n"] * (b["v"] + gap(b) * gap(b)))
    stats = mean.select(field_id, "n", "m", F.sqrt(F.try_divide(squares, F.col("n"))).alias("sd"),
                        F.array_compact(F.transform("_by", lambda b: b["t"])).alias("types"))
    return stats.filter(F.size("types") > 0)


def match_by_signature(a: DataFrame, b: DataFrame, a_id: str, b_id: str, exact: list[str], rounded: list[str],
                       digits: int = 6) -> DataFrame:
    """Pair records that agree on exact columns and on numbers rounded to ``digits``."""
    def signed(df: DataFrame, identity: str) -> DataFrame:
        return df.select(identity, *exact, *[F.round(c, digits).alias(c) for c in rounded])

    return signed(a, a_id).join(signed(b, b_id), [*exact, *rounded]).select(a_id, b_id)


def neighbour_offsets(ids: DataFrame, known: DataFrame, identity: str) -> DataFrame:
    """For each id the offset of the nearest lower and upper id with a known offset."""
    from loamframe.operators import ordered

    joined = ids.select(identity).distinct().join(known.select(identity, "offset"), identity, "full_outer")
    return ordered.neighbour_values(joined, [], [F.col(identity)], "offset", "lower_offset", "upper_offset").drop("offset")


def resolve_ambiguous(candidates: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """One-to-one pairs out of many-to-many candidates.

    Unique pairs first; then, round by round, a candidate whose offset equals a
    neighbour's, else the only one still free.  The loop ends when nothing changes;
    pairs that stay open are returned with a NULL partner.
    """
    counts = candidates.groupBy(a_id).agg(F.count(F.lit(1)).alias("_c"))
    counted = candidates.join(counts, a_id)
    solved = counted.filter(F.col("_c") == 1).select(a_id, b_id, F.lit("unique").alias("method"))
    offsets = solved.select(a_id, (F.col(a_id) - F.col(b_id)).alias("offset"))
    ambiguous = counted.filter(F.col("_c") > 1).drop("_c")
    near = neighbour_offsets(ambiguous, offsets, a_id)
    open_pairs = durable(ambiguous.join(near, a_id).select(
        a_id, b_id,
        ((F.col(a_id) - F.col(b_id)).eqNullSafe(F.col("lower_offset"))
         | (F.col(a_id) - F.col(b_id)).eqNullSafe(F.col("upper_offset"))).alias("_near"),
    ))
    solved = durable(solved)
    while True:  # each round settles an id at least, or ends
        free = open_pairs.join(solved.select(b_id), b_id, "left_anti").join(solved.select(a_id), a_id, "left_anti")
        state = free.groupBy(a_id).agg(
            F.count(F.lit(1)).alias("_free"), F.count_if("_near").alias("_hits"),
            F.max(F.when(F.col("_near"), F.col(b_id))).alias("_by_offset"), F.max(b_id).alias("_left"),
        )
        picks = state.filter((F.col("_hits") == 1) | (F.col("_free") == 1)).select(
            a_id,
            F.when(F.col("_hits") == 1, F.col("_by_offset")).otherwise(F.col("_left")).alias(b_id),
            F.when(F.col("_hits") == 1, F.lit("block_offset")).otherwise(F.lit("elimination")).alias("method"),
        )
        # two ids may want the same partner in one round: the lower id takes it
        once = keys.first_per_key(picks, [b_id], [F.col(a_id)]).select(a_id, b_id, "method")
        fresh = durable(once)
        if fresh.isEmpty():
            break
        solved = durable(solved.unionByName(fresh))
    left = candidates.select(a_id).distinct().join(solved.select(a_id), a_id, "left_anti").select(
        a_id, F.lit(None).cast(candidates.schema[b_id].dataType).alias(b_id), F.lit("unresolved").alias("method"))
    return solved.unionByName(left)

"""Feature queries: box filter, item by id, paging, counts, extents, profiles, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.operators import ordered

BOUNDS = ["minx", "miny", "maxx", "maxy"]


def check_box(box) -> tuple[float, float, float, float]:
    """Four numbers in range with min < max."""
    if len(box) != 4:
        raise ValueError("a box has four numbers")
    minx, miny, maxx, maxy = (float(v) for v in box)
    if not (-180 <= minx < maxx <= 180 and -90 <= miny < maxy <= 90):
        raise ValueError(f"not a valid box: {box}")
    return minx, miny, maxx, maxy


def bbox_filter(df: DataFrame, box, geom: str | None = None) -> DataFrame:
    """Features touching a box.  The bounds predicate reaches the scan; the exact geometry
    test runs only on what is left."""
    checked = check_box(box)
    near = df.filter(geo.bbox_overlaps(*[F.col(c) for c in BOUNDS], checked))
    return near.filter(geo.intersects_bbox(F.col(geom), checked)) if geom else near


def number_matched(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("number_matched"))


def extent(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Overall bounds (per group); NULL when no feature has a geometry."""
    aggregates = [
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    ]
    return df.groupBy(*group).agg(*aggregates) if group else df.agg(*aggregates)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """One page in a total order; ``order`` ends with a tie-break column.

    Spark keeps only ``limit + offset`` rows per task, so this is for shallow pages;
    ``page_by_key`` is for deep ones, ``page_after`` for walks.
    """
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1..10000 and offset not negative")
    keys = [F.desc(order[0]) if descending else F.asc(order[0]), *[F.asc(c) for c in order[1:]]]
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_after(df: DataFrame, order: list[str], last: tuple | None, limit: int) -> DataFrame:
    """Next page of a walk: rows after the last seen key; cost does not grow with depth."""
    if last is not None:
        # (a, b) > (x, y) written out so that the leading column prunes the scan
        later = F.lit(False)
        for i in range(len(order)):
            equal = F.lit(True)
            for j in range(i):
                equal = equal & (F.col(order[j]) == last[j])
            later = later | (equal & (F.col(order[i]) > last[i]))
        df = df.filter((F.col(order[0]) >= last[0]) & later)
    return df.orderBy(*order).limit(limit)


def page_by_key(df: DataFrame, order: list[str], limit: int, offset: int,
                hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Deep page: positions come from the key columns alone, full rows are fetched for the page only."""
    narrow = ordered.number_rows(df.select(*order), [], [F.col(c) for c in order], "_position", hot_rows=hot_rows)
    wanted = narrow.filter(F.col("_position").between(offset + 1, offset + limit))
    # the page has at most ``limit`` (10 000) rows
    return df.join(F.broadcast(wanted), order).orderBy("_position").drop("_position")


def page_within_budget(page_rows: DataFrame, order: list[str], size: str, budget: int, offset: int = 0) -> DataFrame:
    """Longest page prefix whose cumulative size fits, with the offset of the next page.

    The input is one page (at most 10 000 rows), so the running sum is one small window.
    """
    frame = Window.partitionBy(F.lit(0)).orderBy(*order)
    running = page_rows.withColumns({
        "running_size": F.sum(size).over(frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_position": F.row_number().over(frame),
    })
    checked = running.withColumn(
        "running_size",
        F.when((F.col("_position") == 1) & (F.col("running_size") > budget),
               F.raise_error(F.lit("the first feature alone exceeds the budget")).cast("bigint"))
        .otherwise(F.col("running_size")),
    )
    kept = checked.filter(F.col("running_size") <= budget)
    returned = F.max("_position").over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("next_offset", (returned + F.lit(offset)).cast("bigint")).drop("_position")


def item_by_id(df: DataFrame, item, id_column: str | None, order: list[str] | None = None) -> DataFrame:
    """One row by its id, else (no id column) by its 1-based number in ``order``."""
    if id_column:
        return df.filter(F.col(id_column) == item).limit(1)
    numbered = ordered.number_rows(df, [], [F.col(c) for c in order], "_number")
    return numbered.filter(F.col("_number") == int(item)).drop("_number")


def attribute_filter(df: DataFrame, text: str) -> DataFrame:
    """Predicate text (comparisons, AND/OR/NOT, IN, BETWEEN, LIKE, IS NULL) in Spark's own syntax."""
    return df.filter(F.expr(text))


# fixed values: JSON-schema name of a column type
JSON_TYPES = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
    "float": "number", "double": "number", "decimal": "number", "string": "string",
    "boolean": "boolean", "date": "string", "timestamp": "string", "timestamp_ntz": "string",
    "binary": "binary", "array": "array", "map": "object", "struct": "object",
}


def pick_role(columns: list[str], candidates: list[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def profile(df: DataFrame, name: str = "") -> DataFrame:
    """One row describing a collection; counts and bounds come from a single aggregate pass."""
    types = F.create_map(*[
        F.lit(x) for c, t in df.dtypes for x in (c, JSON_TYPES.get(t.split("(")[0].split("<")[0], "string"))
    ])
    binary = [c for c, t in df.dtypes if t == "binary"]
    has_bounds = set(BOUNDS) <= set(df.columns)
    bounds = [
        (f(c) if has_bounds else F.lit(None).cast("double")).alias(c)
        for c, f in zip(BOUNDS, (F.min, F.min, F.max, F.max))
    ]
    counted = df.agg(F.count(F.lit(1)).alias("feature_count"), *bounds)
    return counted.select(
        F.lit(name).alias("collection"),
        types.alias("property_types"),
        F.lit(pick_role(df.columns, codes.ID_COLUMNS)).cast("string").alias("id_column"),
        F.lit(pick_role(df.columns, codes.GEOMETRY_COLUMNS)).cast("string").alias("geometry_column"),
        "feature_count", *BOUNDS,
        F.array(*[F.lit(c) for c in binary]).cast("array<string>").alias("binary_columns"),
    )


def tile_limit(df: DataFrame, zoom: int, order: list[str], limit: int | None = None) -> DataFrame:
    """Features per map tile, at most 500 (10 000 from zoom 9) each, first in ``order``.

    Spark limits each group before the shuffle, so a crowded tile sends ``limit`` rows per task.
    """
    cap = limit or (10_000 if zoom >= 9 else 500)
    tiled = df.withColumn("_tile", F.explode(geo.tile_keys(*[F.col(c) for c in BOUNDS], zoom)))
    keyed = tiled.select("*", "_tile.z", "_tile.tx", "_tile.ty").drop("_tile")
    rank = F.row_number().over(Window.partitionBy("z", "tx", "ty").orderBy(*order))
    return keyed.withColumn("tile_rank", rank).filter(F.col("tile_rank") <= cap)

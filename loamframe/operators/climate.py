"""Gridded series: selecting cells, monthly and spatial means, agronomic indicators.

A grid is a long table (dataset, scenario, model, time, i, j, lat, lon, variable, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loamframe.functions import geometry as geo
from loamframe.functions.values import convert_units, finite
from loamframe.operators import ordered
from loamframe.session import durable


def time_slice(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Inclusive time range."""
    return df.filter(F.col(time).between(start, end))


def grid_subset(grid: DataFrame, box, check: bool = False) -> DataFrame:
    """Cells whose centre lies in the box; ``check`` raises when there is none."""
    minx, miny, maxx, maxy = box
    cells = grid.filter(F.col("lat").between(miny, maxy) & F.col("lon").between(minx, maxx))
    if check and cells.isEmpty():
        raise ValueError("no grid cell in the box")
    return cells


def grid_nearest(grid: DataFrame, x: float, y: float) -> DataFrame:
    """Cells on the nearest latitude and, independently, the nearest longitude."""
    pick = grid.agg(
        F.min_by("lat", F.struct(F.abs(F.col("lat") - y), "lat")).alias("lat"),
        F.min_by("lon", F.struct(F.abs(F.col("lon") - x), "lon")).alias("lon"),
    )
    return grid.join(F.broadcast(pick), ["lat", "lon"], "left_semi")  # one row


def grid_subset_rotated(grid: DataFrame, box) -> DataFrame:
    """Smallest index rectangle with an in-box cell; its cells outside the box stay."""
    span = grid_subset(grid, box).agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")
    )
    # one row: the rectangle is a range filter on the scan side of a broadcast join
    inside = F.col("i").between(F.col("i0"), F.col("i1")) & F.col("j").between(F.col("j0"), F.col("j1"))
    return grid.join(F.broadcast(span), inside, "inner").drop("i0", "i1", "j0", "j1")


def grid_clip(grid: DataFrame, polygon: Column) -> DataFrame:
    """Cells whose centre lies in one polygon; its bounds cut first."""
    box = geo.bounds(polygon)
    near = F.col("lon").between(box["minx"], box["maxx"]) & F.col("lat").between(box["miny"], box["maxy"])
    return grid.filter(near).filter(geo.contains_point(polygon, F.col("lon"), F.col("lat")))


def monthly_mean(series: DataFrame, keys: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean per calendar month and key, stamped with the month's last day.

    With a range, months without rows appear with NULL.  Partial sums combine
    map-side, so a long-running cell costs one row per month and task.
    """
    means = series.withColumn("time", F.last_day("time")).groupBy(*keys, "time").agg(
        F.avg(finite(F.col("value"))).alias("value"))
    if start is None:
        return means
    months = F.transform(
        F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month")),
        lambda d: F.last_day(d),
    )
    frame = series.select(*keys).distinct().withColumn("time", F.explode(months))
    return frame.join(means, [*keys, "time"], "left")


def spatial_mean(series: DataFrame, keys: list[str]) -> DataFrame:
    """NaN-skipping mean over cells, per time and key."""
    return series.groupBy(*keys, "time").agg(F.avg(finite(F.col("value"))).alias("value"))


def cells_of_requests(requests: DataFrame, grid_cells: DataFrame, grid_keys: list[str] = ()) -> DataFrame:
    """(request_id, grid keys, i, j) of the cells each request covers on its own grid.

    Requests with a polygon take cell centres inside it, box requests the cells in the
    box, points the nearest centre, on a rotated grid as on a regular one.  ``grid_cells`` (grid keys, i, j, lat, lon)
    is the grids' geometry, not their data, so nothing here grows with time.  Both sides carry
    ``grid_keys`` (a data set, a model); each grid has a band of longitudes of its own, so all are searched in one join.
    """
    from loamframe.operators import spatial

    keys = list(grid_keys)
    if keys:
        grids = grid_cells.select(*keys).distinct().withColumn("_grid", F.row_number().over(Window.orderBy(*keys)) - 1)  # a row per grid
        grid_cells, requests = grid_cells.join(grids, keys), requests.join(grids, keys)
    else:
        grid_cells, requests = grid_cells.withColumn("_grid", F.lit(0)), requests.withColumn("_grid", F.lit(0))
    band = F.col("_grid") * 1024.0
    who = F.struct("request_id", *keys).alias("_who")
    is_point = (F.col("minx") == F.col("maxx")) & (F.col("miny") == F.col("maxy"))
    centres = grid_cells.select(
        F.struct("lat", "lon", "i", "j", "_grid").alias("_cell_id"), "i", "j", "lat", "lon",
        (F.col("lon") + band).alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + band).alias("maxx"), F.col("lat").alias("maxy"))
    edge = 1e-6  # the band may shift a bound by less; the bounds themselves decide below
    boxes = requests.filter(~is_point).select(
        who, "polygon", *[F.col(c).alias(f"_own_{c}") for c in ("minx", "maxx")],  # flat: Spark may lose fields of a struct here
        (F.col("minx") + band - edge).alias("minx"), F.col("miny"), (F.col("maxx") + band + edge).alias("maxx"), F.col("maxy"))
    pairs = spatial.bbox_join(centres, boxes, "_cell_id", "_who", keep_left=["i", "j", "lat", "lon"], keep_right=["polygon", "_own_minx", "_own_maxx"])
    inside = F.col("lon").between(F.col("_own_minx"), F.col("_own_maxx")) & (
        F.col("polygon").isNull() | geo.contains_point(F.col("polygon"), F.col("lon"), F.col("lat")))
    covered = pairs.filter(inside).select("_who.*", "i", "j")
    points = requests.filter(is_point).select(who, (F.col("minx") + band).alias("x"), F.col("miny").alias("y"))
    anchors = centres.withColumn("geom", geo.point(F.col("minx"), F.col("miny")))
    # the levels grow until they cover a whole grid but not its neighbours
    best = spatial.nearest(points, anchors, "_who", "_cell_id", "x", "y", 1, F.lit(500.0), keep=["i", "j"])
    return covered.unionByName(best.select("_who.*", "i", "j"))


def grid_cells(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Geometry of the grids: (keys, i, j, lat, lon), one row per cell."""
    return grid.select(*keys, "i", "j", "lat", "lon").distinct()


def prune_grid(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a grid that any wanted cell may need, by literals that reach the scan.

    ``wanted`` (dataset, variable, i, j, start_date, end_date) names registered variables only, so what is
    collected has at most one row for each of the registry.  A ``year`` column, if there is one, is a partition.
    """
    number = lambda c: (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"))
    spans = wanted.groupBy("dataset", "variable").agg(
        F.min(F.col("start_date").cast("date")).alias("first"), F.max(F.col("end_date").cast("date")).alias("last"), *number("i"), *number("j")).collect()
    spans = [s for s in spans if s["first"] is not None and s["last"] is not None]
    if not spans:
        return grid.limit(0)
    least, most = min(s["first"] for s in spans), max(s["last"] for s in spans)
    # one plain conjunction for partitions and row groups, then the span of each variable
    rows = grid.filter(F.col("dataset").isin(sorted({s["dataset"] for s in spans})) & F.col("variable").isin(sorted({s["variable"] for s in spans})))
    if "year" in grid.columns:
        rows = rows.filter(F.col("year").between(least.year, most.year))
    after = F.date_add(F.lit(most), 1)
    rows = rows.filter((F.col("time") >= F.lit(least)) & (F.col("time") < after))
    for c in ("i", "j"):
        rows = rows.filter(F.col(c).between(min(s[f"least_{c}"] for s in spans), max(s[f"most_{c}"] for s in spans)))
    each = [(F.col("dataset") == s["dataset"]) & (F.col("variable") == s["variable"]) & F.col("time").between(F.lit(s["first"]), F.date_add(F.lit(s["last"]), 1))
            & F.col("i").between(s["least_i"], s["most_i"]) & F.col("j").between(s["least_j"], s["most_j"]) for s in spans]
    return rows.filter(geo.any_of(each)) if len(each) > 1 else rows


def timeseries(grid: DataFrame, requests: DataFrame, registry: DataFrame, aggregation: str = "daily", cells: DataFrame | None = None) -> DataFrame:
    """Long result (request_id, variable, time, value, units) for a batch of requests.

    ``requests``: request_id, dataset, variable, start_date, end_date, bounds, polygon and,
    for projections, scenario and model.  The join carries small request rows to the
    grid; the mean over cells combines map-side before its shuffle.  ``cells`` is the grids' geometry where it is
    stored (``landed.store_grid``); without it, it is gathered from the asked data sets, which reads their positions whole.
    """
    if aggregation not in ("daily", "monthly"):
        raise ValueError("aggregation must be daily or monthly")
    grid_keys = ["dataset"] + [c for c in ("model",) if c in grid.columns and c in requests.columns]
    asked = requests.join(F.broadcast(registry.select("dataset", "variable")), ["dataset", "variable"], "left_semi")  # the fixed registry
    locations = asked.dropDuplicates(["request_id", *grid_keys]).select("request_id", *grid_keys, "minx", "miny", "maxx", "maxy", "polygon")
    if cells is None:
        sets = sorted(r[0] for r in asked.select("dataset").distinct().collect())  # at most those of the registry
        cells = durable(grid_cells(grid.filter(F.col("dataset").isin(sets)), grid_keys))
    cell_list = cells_of_requests(locations, cells, grid_keys)
    keys = ["dataset", "variable"] + [c for c in ("scenario", "model") if c in grid.columns and c in requests.columns]
    # written out, so Spark knows its true size and broadcasts it only when it is small
    wanted = durable(asked.select("request_id", *keys, "start_date", "end_date").join(cell_list, ["request_id", *grid_keys]))
    # a cell's rows of one time are summed before they meet requests, so no row of the grid is copied to each request
    number = finite(F.col("value"))
    sums = durable(prune_grid(grid, wanted).groupBy(*keys, "i", "j", "time").agg(F.sum(number).alias("_s"), F.count(number).alias("_n")))
    met = sums.join(wanted, [*keys, "i", "j"]).filter(
        F.col("time").between(F.col("start_date").cast("date"), F.col("end_date").cast("date"))
    )
    series_keys = ["request_id", *keys]
    mean = F.try_divide(F.sum("_s"), F.sum("_n")).alias("value")
    if aggregation == "monthly":
        monthly = met.groupBy(*series_keys, "i", "j", F.last_day("time").alias("time")).agg(mean)
        means = spatial_mean(monthly, series_keys)
    else:
        means = met.groupBy(*series_keys, "time").agg(mean)
    named = means.join(F.broadcast(registry), ["dataset", "variable"])
    return named.select(
        "request_id", "dataset", "variable", "time",
        convert_units(F.col("value"), F.col("scale"), F.col("offset")).alias("value"), "units",
    )


def series_as_arrays(series: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Parallel ``time``/``value`` arrays per request and variable (in chunks when very long)."""
    return ordered.series_arrays(series, ["request_id", "variable"], [F.col("time")], ["time", "value"], chunk_rows)


# --- indicators: column expressions over daily values, skipping NULL and NaN ---
def gdd_daily(tasmax: Column, tasmin: Column, base: float | Column = 5.0) -> Column:
    """Growing degree days of one day; NULL when an input is missing."""
    mean = (finite(tasmax) + finite(tasmin)) / 2 - base
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), mean))


def gdd(tasmax: Column, tasmin: Column, base: float | Column = 5.0) -> Column:
    return F.round(F.coalesce(F.sum(gdd_daily(tasmax, tasmin, base)), F.lit(0.0)), 4)


def frost_days(tasmin: Column) -> Column:
    return F.count_if(finite(tasmin) < 0)


def heat_stress_days(tasmax: Column, threshold: float | Column = 30.0) -> Column:
    return F.count_if(finite(tasmax) > threshold)


def pr_total(pr: Column) -> Column:
    return F.round(F.coalesce(F.sum(finite(pr)), F.lit(0.0)), 4)


def pr_days(pr: Column, threshold: float | Column = 1.0) -> Column:
    return F.count_if(finite(pr) > threshold)


def daily_columns(series: DataFrame, key: list[str]) -> DataFrame:
    """Long daily series → one row per key and day with tasmin, tasmax and pr columns."""
    return series.groupBy(*key, "time").agg(*[
        F.max(F.when(F.col("variable") == v, finite(F.col("value")))).alias(v) for v in ("tasmin", "tasmax", "pr")
    ])


def indicators(daily: DataFrame, key: list[str], base: float = 5.0, heat: float = 30.0, wet: float = 1.0) -> DataFrame:
    """All five indicators per key in one aggregation."""
    tasmin, tasmax, pr = F.col("tasmin"), F.col("tasmax"), F.col("pr")
    return daily.groupBy(*key).agg(
        gdd(tasmax, tasmin, base).alias("gdd"), frost_days(tasmin).alias("frost_days"),
        heat_stress_days(tasmax, heat).alias("heat_stress_days"),
        pr_total(pr).alias("pr_total"), pr_days(pr, wet).alias("pr_days"),
    )

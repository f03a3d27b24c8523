"""Landed tables of external services: grids, stations, tiles, scenes, registries, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.operators import ordered
from loamframe.session import durable


def read_grid(grid: DataFrame, dataset: str, variables: list[str]) -> DataFrame:
    """Rows of one gridded dataset and some variables; error when one is missing.

    The equality filters prune the ``dataset/variable/year`` partitions of the long
    grid table; the check reads the variable column only and stops at the distinct names.
    """
    rows = grid.filter((F.col("dataset") == dataset) & F.col("variable").isin(variables))
    found = {r["variable"] for r in rows.select("variable").distinct().collect()}
    missing = sorted(set(variables) - found)
    if missing:
        raise ValueError(f"variables not in {dataset}: {missing}")
    return rows


def store_grid(grid: DataFrame, path: str, keys: list[str] = ("dataset",)) -> None:
    """A grid by data set, variable and year, its rows ordered by cell inside, beside a small table of its cells."""
    from loamframe.operators.climate import grid_cells

    dated = grid.withColumn("year", F.year("time"))
    # rebalanced: a year of one variable may be several files, small ones share a task
    dated.hint("rebalance", "dataset", "variable", "year").sortWithinPartitions("dataset", "variable", "year", "j", "i", "time").write.partitionBy(
        "dataset", "variable", "year").parquet(f"{path}/values")
    grid_cells(grid, list(keys)).write.parquet(f"{path}/cells")


def open_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(values, cells) of a stored grid."""
    return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/cells")


def read_station_items(items: DataFrame, box, start: str, end: str, time: str = "time",
                       station: str = "station_id", limit: int | None = None) -> DataFrame:
    """Station observations in a box and period: all of them, or the first ``limit`` in a stable order."""
    minx, miny, maxx, maxy = box
    hits = items.filter(
        F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy) & F.col(time).between(start, end)
    )
    return hits if limit is None else hits.orderBy(station, time).limit(limit)


def tile_index_lookup(tiles: DataFrame, requests: DataFrame, products: list[str]) -> DataFrame:
    """URLs per (request, product) of the tiles touching each request box; empty URLs dropped.

    ``tiles`` and ``requests`` carry bounds columns; long output, one row per URL.
    """
    from loamframe.operators import spatial

    pairs = spatial.bbox_join(
        requests.select("request_id", "minx", "miny", "maxx", "maxy"),
        tiles.select("tile_id", "minx", "miny", "maxx", "maxy", *products),
        "request_id", "tile_id", keep_right=products,
    )
    urls = pairs.unpivot(["request_id", "tile_id"], products, "product", "url")
    return urls.filter(F.col("url").isNotNull() & (F.col("url") != ""))


def tile_urls(urls: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """URL arrays per (request, product), in tile order, in chunks of bounded length."""
    return ordered.series_arrays(urls, ["request_id", "product"], [F.col("tile_id"), F.col("url")], ["url"], chunk_rows)


#: Most tiles of a cell that are held as one list, requests of a task, and requests that share one copy of a cell.
CELL_TILES, TASK_REQUESTS, CELL_REQUESTS = 100_000, 500, 256


def tile_url_lists(tiles: DataFrame, requests: DataFrame, products: list[str], chunk_rows: int = 10_000, cell_tiles: int = CELL_TILES) -> DataFrame:
    """``tile_urls`` of ``tile_index_lookup``: (request_id, product, chunk, url) with pairs neither shuffled nor sorted.

    A request goes to the cell of its lower-left corner, a tile to every cell from which a request may reach it.  The tiles of a
    cell are put in order once, and each request picks its own out of that list.  Requests whose cell holds more than
    ``cell_tiles`` tiles, and request ids that occur more than once, go through the pairs.
    """
    from loamframe.operators import skew, spatial

    box = [f"_a_{c}" for c in spatial.BOX]
    asked = spatial._side(requests, "a", "request_id", [], spatial.FINEST_CELL)
    levels = [r["_level"] for r in asked.select("_level").distinct().collect()]
    # dealt over all cores first: a small file would write all entries in one task
    of_tiles = spatial._side(tiles.repartition(tiles.sparkSession.sparkContext.defaultParallelism, "tile_id"), "b", "tile_id", products, spatial.FINEST_CELL)
    widest = of_tiles.agg(F.max("_level")).first()[0]
    if not levels or widest is None:
        return tile_urls(tile_index_lookup(tiles, requests, products), chunk_rows)
    # cells no narrower than the widest tile: a tile goes to a few cells of each level
    level = F.greatest("_level", F.lit(widest))
    size = F.pow(F.lit(2.0), level)
    cell = lambda value, width: F.floor(value / width).cast("long")
    placed = asked.withColumns({"_grid": level, "_cx": cell(F.col("_a_minx"), size), "_cy": cell(F.col("_a_miny"), size)}).drop("_level")
    urls = of_tiles.drop("_level").unpivot(["tile_id", *[f"_b_{c}" for c in spatial.BOX]], products, "product", "url")
    grids = F.array(*[F.lit(n) for n in sorted({max(n, widest) for n in levels})])
    urls = urls.filter(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("_grid", F.explode(grids))
    width = F.pow(F.lit(2.0), F.col("_grid"))
    reach = lambda low, high: F.explode(F.sequence(cell(F.col(low), width) - 1, cell(F.col(high), width)))
    entries = urls.withColumn("_cx", reach("_b_minx", "_b_maxx")).withColumn("_cy", reach("_b_miny", "_b_maxy"))
    on = ["_grid", "_cx", "_cy"]
    full = durable(entries.groupBy(*on, "product").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_tiles).select(*on).distinct())
    twice = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("request_id")
    marked = durable(placed.join(twice.withColumn("_twice", F.lit(True)), "request_id", "left").join(full.withColumn("_full", F.lit(True)), on, "left"))
    # a request of exactly a cell's width may be longer by rounding
    within = (cell(F.col("_a_maxx"), F.pow(F.lit(2.0), "_grid")) <= F.col("_cx") + 1) & (cell(F.col("_a_maxy"), F.pow(F.lit(2.0), "_grid")) <= F.col("_cy") + 1)
    plain = F.col("_twice").isNull() & F.col("_full").isNull() & within
    rest = marked.filter(~plain).select("request_id", *[F.col(a).alias(c) for a, c in zip(box, spatial.BOX)])

    tile = F.struct("tile_id", "url", *[f"_b_{c}" for c in spatial.BOX])
    lists = entries.join(full, on, "left_anti").groupBy(*on, "product").agg(F.array_sort(F.collect_list(tile)).alias("_tiles"))
    few = marked.filter(plain).select("request_id", *box, *on)
    tasks = max(tiles.sparkSession.sparkContext.defaultParallelism, min(spatial.MOST_TASKS, -(-few.count() // TASK_REQUESTS)))
    met = skew.salted_join(few, durable(lists), on, F.xxhash64("request_id"), hot_rows=CELL_REQUESTS, tasks=tasks)
    hit = F.filter("_tiles", lambda t: (t["_b_minx"] <= F.col("_a_maxx")) & (t["_b_maxx"] >= F.col("_a_minx"))
                   & (t["_b_miny"] <= F.col("_a_maxy")) & (t["_b_maxy"] >= F.col("_a_miny")))
    found = met.select("request_id", "product", F.explode(F.array(F.transform(hit, lambda t: t["url"]))).alias("_urls"))  # exploded: worked out once, not at each use
    chunks = F.sequence(F.lit(0), F.floor((F.size("_urls") - 1) / chunk_rows).cast("int"))
    listed = found.filter(F.size("_urls") > 0).withColumn("chunk", F.explode(chunks))
    listed = listed.select("request_id", "product", "chunk", F.slice("_urls", F.col("chunk") * chunk_rows + 1, chunk_rows).alias("url"))
    return listed if rest.isEmpty() else listed.unionByName(tile_urls(tile_index_lookup(tiles, rest, products), chunk_rows))


def load_scenes(pixels: DataFrame, scenes: DataFrame, box, start, end, bands: list[str],
                max_cloud: float | None = None) -> DataFrame:
    """Pixels of the scenes that pass the cloud and time filters, inside a box, some bands only."""
    minx, miny, maxx, maxy = box
    wanted = scenes.filter(F.col("t").between(start, end))
    if max_cloud is not None:
        wanted = wanted.filter(F.col("cloud_cover") <= max_cloud)
    inside = pixels.filter(
        F.col("t").between(start, end) & F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy)
    )
    keys = ["scene_id"]
    rest = [c for c in ("t", "row", "col", "x", "y") if c in pixels.columns]
    return inside.select(*keys, *rest, *bands).join(wanted.select(*keys), keys, "left_semi")


def grid_registry(spark: SparkSession) -> DataFrame:
    """Datasets and variables: native name, scale, offset, units (a fixed, small table)."""
    return spark.createDataFrame(
        codes.GRID_VARIABLES,
        "dataset string, variable string, native_name string, scale double, offset double, units string",
    )


def grid_requests(requests: DataFrame, registry: DataFrame, models: DataFrame | None = None):
    """Split requests into (accepted, rejected) against the registry.

    ``requests``: request_id, dataset, variables array, optional scenario and model.
    Accepted rows are one per (request, variable) in request order, duplicates removed;
    rejected rows name the reason and list what is available.
    """
    flat = requests.select(
        *[c for c in requests.columns if c != "variables"],
        F.posexplode(F.array_distinct("variables")).alias("variable_order", "variable"),
    )
    by_set = registry.groupBy("dataset").agg(F.array_sort(F.collect_set("variable")).alias("available"))
    joined = flat.join(F.broadcast(by_set), "dataset", "left").join(
        F.broadcast(registry), ["dataset", "variable"], "left")
    reason = F.when(F.col("available").isNull(), F.lit("unknown dataset")).when(
        F.col("native_name").isNull(), F.lit("unknown variable"))
    if models is not None:
        known = models.select("dataset", "model", F.col("scenarios").alias("_scenarios"))
        joined = joined.join(F.broadcast(known), ["dataset", "model"], "left")
        projected = F.col("model").isNotNull() | F.col("scenario").isNotNull()
        reason = (
            reason.when(projected & F.col("_scenarios").isNull(), F.lit("unknown model"))
            .when(projected & ~F.coalesce(F.array_contains("_scenarios", F.col("scenario")), F.lit(False)),
                  F.lit("scenario not available for model"))
        )
    judged = joined.withColumn("reason", reason)
    drop = ["available", "reason", "_scenarios"]
    accepted = judged.filter(F.col("reason").isNull()).drop(*drop)
    rejected = judged.filter(F.col("reason").isNotNull()).select("request_id", "dataset", "variable", "reason", "available")
    return accepted, rejected


def band_descriptions(xml: DataFrame, column: str = "xml", bands: str = "n_bands") -> DataFrame:
    """Band number and description out of auxiliary XML text, ``band_N`` where it has none."""
    listed = xml.withColumn(
        "_names", F.xpath(F.col(column), F.lit("//PAMRasterBand/Description/text()"))
    )
    numbers = F.sequence(F.lit(1), F.greatest(F.col(bands), F.size("_names"), F.lit(1)))
    rows = listed.withColumn("band", F.explode(numbers))
    name = F.get(F.col("_names"), F.col("band") - 1)
    fallback = F.concat(F.lit("band_"), F.col("band").cast("string"))
    return rows.withColumn("description", F.coalesce(F.nullif(F.trim(name), F.lit("")), fallback)).drop("_names", column)


def raster_catalog(meta: DataFrame):
    """Split raster metadata rows into (valid rows with a box polygon, skipped rows with a reason)."""
    reason = (
        F.when(F.col("crs").isNull() | (F.col("crs") == ""), F.lit("no coordinate system"))
        .when(F.coalesce(F.col("n_bands"), F.lit(0)) < 1, F.lit("no bands"))
    )
    judged = meta.withColumn("reason", reason)
    box = geo.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    valid = judged.filter(F.col("reason").isNull()).drop("reason").withColumn("geom", box)
    return valid, judged.filter(F.col("reason").isNotNull())

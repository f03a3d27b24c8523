"""Weather and climate jobs over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes
from loamframe.operators import climate, requests as rq, stations
from loamframe.functions.times import interval_bounds
from loamframe.session import durable
from loamframe.sources import landed


def _whole(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """A request with any rejected variable is rejected as a whole.

    The checked requests are written out once: every later step uses them several times.
    """
    return durable(accepted.join(rejected.select("request_id"), "request_id", "left_anti"))


def weather_timeseries(requests: DataFrame, grid: DataFrame, registry: DataFrame, farms: DataFrame,
                       datasets: DataFrame, today: Column, aggregation: str = "daily", cells: DataFrame | None = None) -> DataFrame:
    """Series per request and variable, long form.

    ``requests``: request_id, dataset, variables, start_date, end_date and the location
    columns.  Bad locations, ranges, datasets or variables drop out as rejected rows.
    """
    located, _ = rq.resolve_locations(requests, farms)
    ranged, _ = rq.effective_range(located, datasets, today)
    asked = _whole(*landed.grid_requests(ranged, registry))
    return climate.timeseries(grid, asked, registry, aggregation, cells)


def climate_timeseries(requests: DataFrame, grid: DataFrame, registry: DataFrame, models: DataFrame, farms: DataFrame,
                       aggregation: str = "daily", cells: DataFrame | None = None) -> DataFrame:
    """As above for projections: each request names a scenario and a model that supports it."""
    located, _ = rq.resolve_locations(requests, farms)
    asked = _whole(*landed.grid_requests(located, registry, models))
    return climate.timeseries(grid, asked, registry, aggregation, cells)


def climate_indicators(requests: DataFrame, grid: DataFrame, registry: DataFrame, farms: DataFrame,
                       models: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One indicator value per request: (request_id, indicator, value).

    ``requests`` adds indicator, base_temp and threshold, and for projections scenario, model.
    """
    valid, _ = rq.split_valid(rq.validate_requests(requests))
    needs = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x])
        for kv in codes.INDICATOR_VARIABLES.items() for x in kv
    ])
    ready = valid.withColumn("variables", F.element_at(needs, F.col("indicator")))
    located, _ = rq.resolve_locations(ready, farms)
    asked = _whole(*landed.grid_requests(located, registry, models))
    daily = climate.daily_columns(climate.timeseries(grid, asked, registry, cells=cells), ["request_id"])
    params = asked.select("request_id", "indicator", "base_temp", "threshold").dropDuplicates(["request_id"])
    rows = daily.join(params, "request_id")
    tasmin, tasmax, pr = F.col("tasmin"), F.col("tasmax"), F.col("pr")
    heat, wet = F.coalesce("threshold", F.lit(30.0)), F.coalesce("threshold", F.lit(1.0))
    value = (
        F.when(F.first("indicator") == "gdd", climate.gdd(tasmax, tasmin, F.coalesce("base_temp", F.lit(5.0))))
        .when(F.first("indicator") == "frost_days", climate.frost_days(tasmin).cast("double"))
        .when(F.first("indicator") == "heat_stress_days", climate.heat_stress_days(tasmax, heat).cast("double"))
        .when(F.first("indicator") == "pr_total", climate.pr_total(pr))
        .otherwise(climate.pr_days(pr, wet).cast("double"))
    )
    return rows.groupBy("request_id").agg(F.first("indicator").alias("indicator"), value.alias("value"))


def _asked_stations(requests: DataFrame, items: DataFrame, collections: DataFrame, farms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of the asked period, and the valid requests with their boxes and intervals, written out once."""
    valid, _ = rq.split_valid(rq.validate_station_requests(requests, collections))
    located, _ = rq.resolve_locations(valid, farms)
    grown = rq.min_bbox(located).withColumn("_i", interval_bounds(F.col("collection"), F.col("start_date"), F.col("end_date")))
    grown = durable(grown)
    span = grown.agg(F.min(F.col("_i.start").cast("date")), F.max(F.substring("_i.end", 1, 10).cast("date"))).first()
    if span[0] is not None and span[1] is not None:  # the asked period, as literals that reach the scan
        items = items.filter((F.col("time") >= F.lit(span[0])) & (F.col("time") < F.date_add(F.lit(span[1]), 1)))
    return items, grown


def _station_pairs(items: DataFrame, grown: DataFrame, keep: list[str]) -> DataFrame:
    """(station_id, request_id, kept columns) of the stations inside the box of each request."""
    from loamframe.operators import spatial

    sites = spatial.as_boxes(items.select("station_id", "lon", "lat").distinct(), "lon", "lat")
    return spatial.bbox_join(sites, grown, "station_id", "request_id", [], keep)


def station_observations(requests: DataFrame, items: DataFrame, collections: DataFrame, farms: DataFrame) -> DataFrame:
    """Long observations (request_id, station_id, time, variable, value) per station request.

    Boxes smaller than one degree are grown first; ``items``: collection, station_id,
    lon, lat, time, variable, value.
    """
    items, grown = _asked_stations(requests, items, collections, farms)
    pairs = _station_pairs(items, grown, ["collection", "variables", "_i"])
    asked = pairs.withColumn("variable", F.explode("variables")).select(
        "request_id", "station_id", "collection", "variable",
        F.col("_i.start").cast("date").alias("_from"), F.substring("_i.end", 1, 10).cast("date").alias("_to"))
    hits = items.join(asked, ["collection", "station_id", "variable"]).filter(
        F.to_date("time").between(F.col("_from"), F.col("_to")))
    return hits.select("request_id", "station_id", "collection", "time", "variable", F.round("value", 4).alias("value"))


def station_arrays(observations: DataFrame, variables: list[str], collection: str, limit: int | None = None) -> DataFrame:
    """Parallel arrays per request station, from the long observations of one collection."""
    wide = observations.filter(F.col("collection") == collection).groupBy("request_id", "station_id", "time").agg(*[
        F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])
    keyed = wide.withColumn("site", F.concat_ws(":", F.col("request_id").cast("string"), F.col("station_id").cast("string")))
    return stations.station_series(keyed, "site", "time", variables, collection, limit)


def station_request_arrays(requests: DataFrame, items: DataFrame, collections: DataFrame, farms: DataFrame, variables: list[str],
                           collection: str) -> DataFrame:
    """``station_arrays`` of ``station_observations``: a station's series is packed once for all requests that ask for the same
    variables and interval, so requests meet packed arrays and not every reading."""
    items, grown = _asked_stations(requests, items, collections, farms)
    grown = grown.filter(F.col("collection") == collection)
    if not grown.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        # the parts of one request have a series in common
        return station_arrays(station_observations(requests, items, collections, farms), variables, collection)
    asked = grown.withColumns({
        "_words": F.array_sort(F.array_distinct("variables")), "_from": F.col("_i.start").cast("date"), "_to": F.substring("_i.end", 1, 10).cast("date")})
    same = ["_words", "_from", "_to"]
    # a kind of request has the name of its first request
    kinds = durable(asked.groupBy(*same).agg(F.min("request_id").alias("_kind")))
    equal = [asked[c].eqNullSafe(kinds[c]) for c in same]
    placed = durable(asked.join(kinds, equal[0] & equal[1] & equal[2]).select("request_id", "minx", "miny", "maxx", "maxy", "_kind"))
    pairs = durable(_station_pairs(items, placed, ["_kind"]))
    wanted = pairs.select("station_id", "_kind").distinct().join(kinds, "_kind").withColumn("variable", F.explode("_words"))
    readings = items.filter(F.col("collection") == collection).join(wanted, ["station_id", "variable"]).filter(
        F.to_date("time").between(F.col("_from"), F.col("_to")))
    wide = readings.groupBy("station_id", "_kind", "time").agg(*[
        F.max(F.when(F.col("variable") == v, F.round("value", 4))).alias(v) for v in variables])
    packed = stations.station_series(wide.withColumn("_key", F.struct("station_id", "_kind")), "_key", "time", variables, collection)
    packed = durable(packed.select("_key.station_id", "_key._kind", *[c for c in packed.columns if c != "_key"]))
    site = F.concat_ws(":", F.col("request_id").cast("string"), F.col("station_id").cast("string")).alias("site")
    return pairs.join(packed, ["station_id", "_kind"]).select(site, "chunk", "time", *variables)

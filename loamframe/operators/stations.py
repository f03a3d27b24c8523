"""Station observations: nearest usable station, long and packed series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamframe.functions.times import station_time
from loamframe.operators import ordered


def first_stations(observations: DataFrame, station: str, limit: int) -> DataFrame:
    """The first ``limit`` stations in id order."""
    return observations.select(station).distinct().orderBy(station).limit(limit)


def station_metadata(observations: DataFrame, station: str, time: str, columns: list[str]) -> DataFrame:
    """Metadata of each station from its earliest item."""
    return observations.groupBy(station).agg(*[
        F.min_by(c, F.struct(F.col(time), F.col(c).cast("string"))).alias(c) for c in columns
    ])


def station_rows(observations: DataFrame, station: str, time: str, variables: list[str], collection: str) -> DataFrame:
    """Observation rows with a normalised time and values at four decimals."""
    return observations.filter(F.col(station).isNotNull() & (F.col(station).cast("string") != "")).select(
        station, station_time(F.col(time).cast("string"), F.lit(collection)).alias("time"),
        *[F.round(F.col(v).cast("double"), 4).alias(v) for v in variables],
    )


def station_series(observations: DataFrame, station: str, time: str, variables: list[str], collection: str = "climate-daily",
                   limit: int | None = None, metadata: list[str] = (), chunk_rows: int = 10_000) -> DataFrame:
    """Time-sorted parallel arrays per station for the first ``limit`` stations, with metadata.

    Long stations continue in further chunks, so one station never fills a task.
    """
    chosen = observations
    if limit is not None:
        # ``limit`` stations at most: the limit is the bound of this broadcast
        chosen = observations.join(F.broadcast(first_stations(observations, station, limit)), station, "left_semi")
    rows = station_rows(chosen, station, time, variables, collection)
    tie = [F.col(v) for v in variables]
    packed = ordered.series_arrays(rows, [station], [F.col("time"), *tie], ["time", *variables], chunk_rows)
    if not metadata:
        return packed
    return packed.join(station_metadata(chosen, station, time, list(metadata)), station)

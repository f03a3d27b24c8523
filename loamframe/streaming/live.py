"""Live observations and arriving layers as streams.  On a finished input each gives the batch answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from loamframe.operators import climate, keys
from loamframe.sources import buckets, writers


def stream_station_series(observations: DataFrame, station: str, time: str, value: str, window: str = "1 day",
                          watermark: str = "2 days", slide: str | None = None) -> DataFrame:
    """Count, sum, least and largest value per station and window.

    Repeated (station, time) readings count once; a late row inside the watermark updates
    its window, later ones are dropped.  Works on a stream and on a table alike.
    """
    stamped = observations.withColumn(time, F.col(time).cast("timestamp"))
    if observations.isStreaming:
        unique = stamped.withWatermark(time, watermark).dropDuplicatesWithinWatermark([station, time])
    else:
        unique = stamped.dropDuplicates([station, time])
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return unique.groupBy(frame.alias("window"), station).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max"),
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), station, "n", "total", "min", "max")


def stream_indicators(daily: DataFrame, station: str, time: str = "time", window: str = "30 days", watermark: str = "10 days") -> DataFrame:
    """Frost, heat and precipitation counts and degree days per station and window."""
    stamped = daily.withColumn(time, F.col(time).cast("timestamp"))
    source = stamped.withWatermark(time, watermark) if daily.isStreaming else stamped
    tasmin, tasmax, pr = F.col("tasmin"), F.col("tasmax"), F.col("pr")
    return source.groupBy(F.window(time, window).alias("window"), station).agg(
        climate.frost_days(tasmin).alias("frost_days"), climate.heat_stress_days(tasmax).alias("heat_stress_days"),
        climate.pr_days(pr).alias("pr_days"), climate.pr_total(pr).alias("pr_total"), climate.gdd(tasmax, tasmin).alias("gdd"),
    ).select(F.col("window.start").alias("start"), station, "frost_days", "heat_stress_days", "pr_days", "pr_total", "gdd")


def running_gdd(daily: DataFrame, station: str, base: float = 5.0) -> DataFrame:
    """Running degree-day total per station, kept as two numbers of state per station."""
    kind = dict(daily.dtypes)[station]

    class Running(StatefulProcessor):
        def init(self, handle) -> None:
            self.total = handle.getValueState("total", "gdd double, days long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            gdd, days = self.total.get() if self.total.exists() else (0.0, 0)
            for pdf in rows:
                heat = ((pdf["tasmax"] + pdf["tasmin"]) / 2 - base).clip(lower=0).dropna()
                gdd, days = gdd + float(heat.sum()), days + int(len(heat))
            self.total.update((gdd, days))
            yield pd.DataFrame({station: [key[0]], "gdd": [gdd], "days": [days]})

        def close(self) -> None:
            pass

    return daily.select(station, "tasmin", "tasmax").groupBy(station).transformWithStateInPandas(
        statefulProcessor=Running(), outputStructType=f"`{station}` {kind}, gdd double, days long", outputMode="Update", timeMode="None")


def stream_ingest_layers(arriving: DataFrame, target: str, key: list[str], prepare: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Harmonise each batch of new feature rows and upsert it into a Parquet table of versions.

    Every batch writes a new version folder and reads the one before, so a batch that is
    replayed after a failure gives the same version again.
    """
    spark = arriving.sparkSession

    def absorb(batch: DataFrame, number: int) -> None:
        clean = prepare(batch)
        merged = writers.upsert(spark.read.parquet(f"{target}/v{number - 1}"), clean, key) if number else writers.upsert(clean.limit(0), clean, key)
        merged.write.mode("overwrite").parquet(f"{target}/v{number}")

    return arriving.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert_table(arriving: DataFrame, store: buckets.BucketStore, table: str, key: list[str], prepare: Callable[[DataFrame], DataFrame],
                        checkpoint: str, version: str | None = None):
    """Harmonise each batch of new rows and upsert it into a table of the store, rewriting only the buckets it touches.

    The number of the batch is put in force with its rows, so a batch that is replayed after a failure changes nothing.
    Two versions are kept.
    """
    def absorb(batch: DataFrame, number: int) -> None:
        last = store.mark(f"stream:{table}")
        if last is not None and number <= last:
            return
        clean = prepare(batch)
        if table in store.tables():
            staged = store.stage_upsert(table, clean, version)
        else:
            staged = store.stage_table(table, keys.last_per_key(clean, key, version), key)
        store.commit(staged, marks={f"stream:{table}": number})
        store.vacuum(2)

    return arriving.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

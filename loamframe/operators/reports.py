"""Reports and sampling: metrics, trends, scene counts, differences, latency, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamframe import codes
from loamframe.functions.values import finite
from loamframe.operators import quantiles


# --- predictions ----------------------------------------------------------------
def field_predictions(predictions: DataFrame, keys: tuple[str, ...] = ("algo", "scenario", "FIELD_ID"), image: str = "Image_ID") -> DataFrame:
    """Image-level predictions → means per field and the number of images."""
    columns = ["y_true_log", "y_pred_log", "y_true_lin", "y_pred_lin"]
    missing = {*keys, image, *columns} - set(predictions.columns)
    if missing:
        raise ValueError(f"predictions lack {sorted(missing)}")
    return predictions.groupBy(*keys).agg(
        *[F.avg(finite(F.col(c))).alias(f"{c}_field") for c in columns], F.count_distinct(image).alias("n_images"))


def error_metrics(truth: Column, predicted: Column, suffix: str) -> list[Column]:
    """RMSE, MAE and R²; R² is undefined with fewer than two different truths."""
    error = truth - predicted
    spread = F.var_pop(truth) * F.count(truth)
    different = F.min(truth) < F.max(truth)
    return [
        F.sqrt(F.avg(error * error)).alias(f"RMSE_{suffix}"), F.avg(F.abs(error)).alias(f"MAE_{suffix}"),
        F.when(different, 1 - F.try_divide(F.sum(error * error), spread)).alias(f"R2_{suffix}"),
    ]


def regression_metrics(fields: DataFrame, group: list[str], identity: str = "FIELD_ID") -> DataFrame:
    """Field-level errors per group, on the log and the linear scale."""
    c = F.col
    return fields.groupBy(*group).agg(
        *error_metrics(c("y_true_log_field"), c("y_pred_log_field"), "log"),
        *error_metrics(c("y_true_lin_field"), c("y_pred_lin_field"), "lin"),
        F.count_distinct(identity).alias("n_fields"), F.avg("n_images").alias("avg_images_per_field"),
    )


def yearly_trend(predictions: DataFrame, scenario: str | None = None, factor: float = 1.0, max_images: DataFrame | None = None,
                 image: str = "Image_ID") -> DataFrame:
    """Mean, least and largest prediction and mean measurement per year; nothing at all when at
    most one image was used (``max_images``: one row with ``n_images``)."""
    rows = predictions.filter(F.col("scenario") == scenario) if scenario else predictions
    year = F.coalesce(F.nullif(F.split_part(F.col(image), F.lit("_"), F.lit(1)), F.lit("")), F.lit("unknown"))
    predicted = finite(F.col("y_pred_lin"))
    trend = rows.withColumn("year", year).groupBy("year").agg(
        (F.avg(predicted) * factor).alias("mean_pred"), (F.min(predicted) * factor).alias("min_pred"),
        (F.max(predicted) * factor).alias("max_pred"), (F.avg(finite(F.col("y_true_lin"))) * factor).alias("mean_meas"),
    )
    if max_images is None:
        return trend
    enough = max_images.agg(F.max("n_images").alias("_m")).filter(F.col("_m") > 1)
    return trend.withColumn("_k", F.lit(1)).join(F.broadcast(enough.select(F.lit(1).alias("_k"))), "_k", "left_semi").drop("_k")


def rank_images(scores: DataFrame, score: str = "CV_RMSE", image: str = "Image_ID") -> DataFrame:
    """Images by score (one row per image, so the single ordered window is small)."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(score, image)))


def drop_flag(steps: DataFrame, order: str, r2: str = "R2_val", threshold: float = 0.01, group: list[str] | None = None) -> DataFrame:
    """Mark a step whose R² falls more than ``threshold`` below the step before it."""
    frame = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)
    return steps.withColumn("dropped", F.coalesce(F.col(r2) < F.lag(r2).over(frame) - threshold, F.lit(False)))


def argmax_step(steps: DataFrame, step: str, r2: str = "R2_val", group: list[str] | None = None) -> DataFrame:
    """Step with the best R², the first one on ties."""
    good = steps.filter(F.col(r2).isNotNull() & ~F.isnan(F.col(r2).cast("double")))
    best = F.max_by(step, F.struct(F.col(r2), -F.col(step))).alias(step)
    both = [best, F.max(r2).alias(r2)]
    return good.groupBy(*group).agg(*both) if group else good.agg(*both)


# --- scenes ---------------------------------------------------------------------
def scene_counts(items: DataFrame, parcel: str, time: str, cloud: str, tile: str, max_cloud: float) -> DataFrame:
    """Per parcel: retained items, retained and all dates, median cloud of the retained, tile codes.

    Dates and tile codes are small sets; the median is counted, not collected.
    """
    kept = F.coalesce(F.col(cloud) <= max_cloud, F.lit(False))
    day = F.to_date(time)
    counts = items.groupBy(parcel).agg(
        F.count_if(kept).alias("retained_items"),
        F.count_distinct(F.when(kept, day)).alias("retained_dates"), F.count_distinct(day).alias("all_dates"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce(tile, F.lit("")))), " ").alias("tiles"),
    )
    medians = quantiles.exact_percentiles(items.filter(kept), [parcel], cloud, {"_m": 0.5})
    return counts.join(medians, parcel, "left").withColumn(
        "median_cloud_cover_retained", F.round("_m", 1)).drop("_m")


def paired_difference(rows: DataFrame, key: str, flag: str, value: str) -> DataFrame:
    """Difference with minus without the flag, for keys that have both (finite) values."""
    both = rows.groupBy(key).agg(
        F.max(F.when(F.col(flag), finite(F.col(value)))).alias("with_flag"),
        F.max(F.when(~F.col(flag), finite(F.col(value)))).alias("without_flag"),
    )
    return both.dropna().withColumn("difference", F.col("with_flag") - F.col("without_flag"))


def difference_summary(pairs: DataFrame, scenes: DataFrame | None = None, key: str = "parcel", few: int = 3,
                       dates: str = "retained_dates") -> DataFrame:
    """Summary of absolute differences: all parcels, and those with few or with more dates."""
    sized = pairs.withColumn("_abs", F.abs("difference")).withColumn("part", F.lit("all"))
    parts = sized
    if scenes is not None:
        dated = sized.join(scenes.select(key, dates), key)
        label = F.when(F.col(dates) <= few, F.lit(f"le{few}")).otherwise(F.lit(f"gt{few}"))
        parts = sized.withColumn(dates, F.lit(None).cast("bigint")).unionByName(
            dated.withColumn("part", label).withColumn(dates, F.col(dates).cast("bigint")))
    stats = parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_parcels"), F.avg("difference").alias("mean_diff"), F.avg("_abs").alias("mean_abs_diff"),
        F.max("_abs").alias("max_abs_diff"),
    )
    medians = quantiles.exact_percentiles(parts, ["part"], "_abs", {"median_abs_diff": 0.5})
    return stats.join(medians, "part")


def date_summary(pairs: DataFrame, scenes: DataFrame, key: str = "parcel", dates: str = "retained_dates") -> DataFrame:
    """Least, median and largest number of dates over the compared parcels."""
    counted = scenes.join(pairs.select(key), key, "left_semi")
    ends = counted.agg(F.min(dates).alias("dates_min"), F.max(dates).alias("dates_max")).withColumn("_k", F.lit(1))
    median = quantiles.exact_percentiles(counted, [], dates, {"dates_median": 0.5}).withColumn("_k", F.lit(1))
    return ends.join(F.broadcast(median), "_k").drop("_k")


# --- operations -----------------------------------------------------------------
def latency_summary(samples: DataFrame, label: str, milliseconds: str, success: Column) -> DataFrame:
    """Mean, median, deviation and 95 % interval of successful requests per label.

    The interval uses the normal quantile from 30 samples on, Student's below.
    """
    good = samples.filter(success)
    stats = good.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(milliseconds).alias("mean"),
        F.coalesce(F.stddev_samp(milliseconds), F.lit(0.0)).alias("sd"),
        F.min(milliseconds).alias("min"), F.max(milliseconds).alias("max"),
    )
    quantile = F.create_map(*[F.lit(x) for df_, t in codes.STUDENT_T_975.items() for x in (df_, t)])
    q = F.when(F.col("n") >= 30, F.lit(1.96)).when(F.col("n") > 1, F.try_element_at(quantile, (F.col("n") - 1).cast("int"))).otherwise(F.lit(0.0))
    half = q * F.col("sd") / F.sqrt("n")
    medians = quantiles.exact_percentiles(good, [label], milliseconds, {"median": 0.5})
    return stats.join(medians, label).withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def run_report(events: DataFrame, kind: str, status: str, statuses: list[str]) -> DataFrame:
    """Events per type and status, with a total row (type ``all``)."""
    counts = events.rollup(kind).agg(
        F.grouping(kind).alias("_total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])
    name = F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(kind))
    return counts.select(name.alias(kind), *statuses)


# --- sampling -------------------------------------------------------------------
def sample_per_cell(df: DataFrame, identity: str, x: str, y: str, n: int, seed: int, cell: float = 0.5,
                    size: str | None = None, least: float = 2.0, most: float = 30.0) -> DataFrame:
    """One hash-random row in each of n hash-random grid cells; the same seed draws the same rows."""
    rows = df.filter(F.col(size).between(least, most)) if size else df
    celled = rows.withColumns({
        "cx": F.floor(F.col(x) / cell).cast("long"), "cy": F.floor(F.col(y) / cell).cast("long")})
    rest = [c for c in celled.columns if c not in ("cx", "cy")]
    drawn = celled.groupBy("cx", "cy").agg(
        F.min_by(F.struct(*rest), F.struct(F.xxhash64(identity, F.lit(seed)), F.col(identity))).alias("_r"))
    return drawn.orderBy(F.xxhash64("cx", "cy", F.lit(seed)), "cx", "cy").limit(n).select("_r.*", "cx", "cy")

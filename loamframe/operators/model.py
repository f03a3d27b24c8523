"""Soil organic matter model: preparation, selection, forests, grouped validation, prediction.

Rows are keyed (FIELD_ID, Image_ID).  Splits and folds are always by field.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamframe import codes
from loamframe.functions.text import parse_soil_list
from loamframe.functions.values import finite
from loamframe.operators import encoding, forest, gram, harmonize, ordered, quantiles, reports, skew
from loamframe.session import durable

FIELD, IMAGE, TARGET = "FIELD_ID", "Image_ID", "mean_SOM"
FORMAT_VERSION = 1
MIN_IMAGE_ROWS, MIN_TRAIN_ROWS, CV_FOLDS = 10, 30, 5


# --- preparation ----------------------------------------------------------------
@dataclass
class Preparation:
    """What training fixed and prediction only applies."""

    classes: list[str]
    low: float
    high: float


def iqr_bounds(df: DataFrame, log_value: str, factor: float = 1.5) -> DataFrame:
    """One row (lo, hi): quartiles widened by ``factor`` interquartile ranges."""
    q = quantiles.exact_percentiles(df, [], log_value, {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * factor
    return q.select((F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def iqr_filter(df: DataFrame, value: str, bounds: tuple[float, float] | None = None):
    """(rows whose log10 value is inside the bounds, the bounds used)."""
    logged = df.withColumn("log_SOM", F.log10(value))
    if bounds is None:
        row = iqr_bounds(logged.select("log_SOM"), "log_SOM").first()
        if row is None:
            raise ValueError("no values to take quartiles of")
        bounds = (row["lo"], row["hi"])
    return logged.filter(F.col("log_SOM").between(*bounds)), bounds


def spectral_features() -> list[str]:
    return [f"{i}_{s}" for s in ("mean", "stdDev") for i in codes.SPECTRAL_INDICES]


def prepare_training(df: DataFrame):
    """(prepared rows, Preparation): target present, outliers out, log target, soil classes encoded."""
    missing = {FIELD, IMAGE, TARGET, "soilTypes", *spectral_features()} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    kept, (low, high) = iqr_filter(df.dropna(subset=[TARGET]), TARGET)
    listed = kept.withColumn("_soils", parse_soil_list(F.col("soilTypes")))
    classes = encoding.fit_classes(listed, "_soils")
    return encoding.multi_hot(listed, "_soils", classes, "soil_").drop("_soils"), Preparation(classes, low, high)


def prepare_predict(df: DataFrame, fitted: Preparation) -> DataFrame:
    """Same steps with the fitted classes and bounds; nothing is refitted."""
    kept, _ = iqr_filter(df.dropna(subset=[TARGET]), TARGET, (fitted.low, fitted.high))
    listed = kept.withColumn("_soils", parse_soil_list(F.col("soilTypes")))
    return encoding.multi_hot(listed, "_soils", fitted.classes, "soil_").drop("_soils")


def scenario_features(columns: list[str], classes: list[str]) -> dict[str, list[str]]:
    """Feature lists: spectral and soil, with terrain, with climate (those present)."""
    base = spectral_features() + [f"soil_{c}" for c in classes]
    terrain = [c for c in codes.TERRAIN_FEATURES if c in columns]
    climate = [c for c in codes.CLIMATE_FEATURES if c in columns]
    return {"S1_spec_soil": base, "S2_spec_soil_topo": base + terrain, "S3_spec_soil_topo_clim": base + terrain + climate}


# --- splits ---------------------------------------------------------------------
def group_split(df: DataFrame, group: str, ratio: float, seed: int, forced: list | None = None):
    """(train, test) by group.  The test side has ``ratio`` of the groups, at least one, in hash
    order; ``forced`` groups make up the test side instead."""
    groups = df.select(group).distinct()
    if forced:
        test = groups.filter(F.col(group).isin(forced))
        if test.isEmpty():
            raise ValueError(f"none of the groups {forced} has data")
    else:
        n_test = max(1, int(ratio * groups.count()))
        numbered = ordered.number_rows(groups, [], [F.xxhash64(group, F.lit(seed)), F.col(group)], "_n")
        test = numbered.filter(F.col("_n") <= n_test).select(group)
    flags = groups.join(test.withColumn("_test", F.lit(True)), group, "left")
    joined = skew.lookup_join(df, flags, [group])
    return joined.filter("_test is null").drop("_test"), joined.filter("_test").drop("_test")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): k folds with about equal row counts, groups never split.

    Groups are dealt in size order, back and forth, at every size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ordered.number_rows(sizes, [], [-F.col("_n"), F.col(group)], "_p", start=0)
    lap = F.pmod("_p", F.lit(2 * k))
    return numbered.select(group, F.when(lap < k, lap).otherwise(2 * k - 1 - lap).cast("int").alias("fold"))


# --- scaling --------------------------------------------------------------------
def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(finite(F.col(c))).alias(c) for c in columns])


def impute(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Missing features filled with the training means."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(float(m or 0.0))) for c, m in means.items()})


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one pass; a constant column gets deviation 1."""
    row = df.agg(*[f(c).alias(f"{p}{n}") for n, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{n}"] or 0.0, row[f"s{n}"] or 1.0) for n, c in enumerate(columns)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


# --- selection ------------------------------------------------------------------
def lasso_select(df: DataFrame, features: list[str], target: str = "log_SOM", folds: int = 5, fallback: int = 10):
    """(selected features, alpha) by five-fold lasso over hashed rows; when all coefficients are
    zero the ``fallback`` largest by absolute value."""
    folded = df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(c) for c in (FIELD, IMAGE) if c in df.columns] or [F.col(target)]), F.lit(folds)).cast("int"))
    # p² rows per fold, whatever the number of training rows
    sums = gram.gram_table(folded, ["fold"], features, target).toPandas()
    size = len(features) + 2
    matrices = [gram.as_matrix(part, size) for _, part in sums.groupby("fold")]
    alpha, weights = gram.cross_validated_alpha(matrices)
    chosen = [f for f, w in zip(features, weights) if w != 0]
    if not chosen:
        chosen = [f for f, _ in sorted(zip(features, abs(weights)), key=lambda t: -t[1])[:fallback]]
    return chosen, alpha


def score_images(df: DataFrame, features: list[str], alpha: float, target: str = "log_SOM", least_rows: int = MIN_IMAGE_ROWS) -> DataFrame:
    """(Image_ID, CV_RMSE, n) by grouped folds inside each image, for images with enough rows.

    Only sums of products leave the rows: an image that holds most rows costs the same
    p² numbers as a small one.
    """
    size = len(features) + 2
    sizes = df.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(FIELD).alias("_fields")).filter(F.col("n") >= least_rows)
    rows = skew.lookup_join(df.select(FIELD, IMAGE, target, *features), sizes.select(IMAGE, "_fields"), [IMAGE], "inner")
    # the fields of an image are dealt in size order, so no fold of two or more fields is empty
    fields = rows.groupBy(IMAGE, FIELD, "_fields").agg(F.count(F.lit(1)).alias("_n"))
    dealt = ordered.number_rows(fields, [IMAGE], [-F.col("_n"), F.col(FIELD)], "_p", start=0)
    k = F.greatest(F.lit(2), F.least(F.lit(3), F.col("_fields")))
    folds = dealt.select(IMAGE, FIELD, F.pmod("_p", k).cast("int").alias("fold"))
    folded = skew.lookup_join(rows.drop("_fields"), folds, [IMAGE, FIELD], "inner")
    sums = gram.gram_table(folded, [IMAGE, "fold"], features, target)
    kind = df.schema[IMAGE].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({IMAGE: [pdf[IMAGE].iloc[0]], "CV_RMSE": [gram.grouped_rmse(pdf, size, alpha)]})

    scored = sums.groupBy(IMAGE).applyInPandas(score, f"`{IMAGE}` {kind}, CV_RMSE double")
    return scored.join(sizes.select(IMAGE, "n"), IMAGE)


def rank_images(df: DataFrame, features: list[str], alpha: float) -> list[str]:
    """Images from best to worst; all of them in id order when none can be scored.

    Images of one field have rows enough but nothing to be scored against: they follow in id order.
    """
    scored = durable(score_images(df, features, alpha))
    known = F.col("CV_RMSE").isNotNull() & ~F.isnan("CV_RMSE")
    ranked = [r[IMAGE] for r in reports.rank_images(scored.filter(known)).orderBy("rank").collect()]
    if not ranked:
        return sorted(r[IMAGE] for r in df.select(IMAGE).distinct().collect())
    return ranked + sorted(r[IMAGE] for r in scored.filter(~known).select(IMAGE).collect())


# --- forests --------------------------------------------------------------------
def fit_forest(df: DataFrame, features: list[str], trees: int, target: str = "log_SOM", seed: int = 42, depth: int = 30) -> RandomForestRegressionModel | forest.Forest:
    """A forest over all features; of tables that fit in a task many times over, each task grows whole trees."""
    if forest.fits_whole(df.count(), len(features)):
        return forest.fit(df, features, target, trees, depth, seed)
    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, target))
    return RandomForestRegressor(
        featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed,
        cacheNodeIds=True,  # else every level sends all trees to the tasks and walks them again
    ).fit(assembled)


def forest_predict(model: RandomForestRegressionModel | forest.Forest, df: DataFrame, features: list[str], name: str = "y_pred_log") -> DataFrame:
    if isinstance(model, forest.Forest):
        return forest.predicted(model, df, features, name)
    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    return model.transform(assembled).withColumnRenamed("prediction", name).drop("_x")


#: Fits that run side by side.
FITS_AT_ONCE = 8


def side_by_side(spark: SparkSession, fits: list[Callable]) -> list:
    """Results of independent fits in their order.  The tasks of one fit on few rows leave most cores idle, as its levels wait for each other."""
    if len(fits) < 2:
        return [fit() for fit in fits]
    with ThreadPool(min(len(fits), FITS_AT_ONCE)) as pool:
        return pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(fit) for fit in fits], chunksize=1)


def r_squared(df: DataFrame, truth: str, predicted: str) -> float:
    value = df.agg(reports.error_metrics(F.col(truth), F.col(predicted), "v")[2]).first()[0]
    return float("nan") if value is None else value


def progressive_selection(train: DataFrame, validation: DataFrame, ranked: list[str], features: list[str], trees: int = 50, depth: int = 30) -> list[dict]:
    """Validation R² with the first 1, 2, … images; steps with too few rows are skipped."""
    counts = {r[IMAGE]: r["n"] for r in train.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("n")).collect()}

    def step(used: int) -> dict:
        chosen = ranked[:used]
        model = fit_forest(train.filter(F.col(IMAGE).isin(chosen)), features, trees, depth=depth)
        return {"Images_Used": used, "R2_val": r_squared(forest_predict(model, validation, features), "log_SOM", "y_pred_log"), IMAGE: chosen[-1]}

    large = [used for used in range(1, len(ranked) + 1) if sum(counts.get(i, 0) for i in ranked[:used]) >= MIN_TRAIN_ROWS]
    return side_by_side(train.sparkSession, [partial(step, used) for used in large])


def drop_bad_images(spark: SparkSession, ranked: list[str], steps: list[dict], threshold: float = 0.01) -> list[str]:
    """Ranked images without those whose step lowered the validation R²; all when none is left."""
    if not steps:
        return ranked
    flagged = reports.drop_flag(spark.createDataFrame(pd.DataFrame(steps)), "Images_Used", threshold=threshold)
    bad = {r[IMAGE] for r in flagged.filter("dropped").collect()}
    return [i for i in ranked if i not in bad] or ranked


def best_images(spark: SparkSession, ranked: list[str], steps: list[dict]) -> tuple[list[str], float]:
    """Images up to the best step, and its R²."""
    good = [s for s in steps if not math.isnan(s["R2_val"])]
    if not good:
        return ranked, float("nan")
    best = reports.argmax_step(spark.createDataFrame(pd.DataFrame(good)), "Images_Used").first()
    return ranked[: int(best["Images_Used"])], float(best["R2_val"])


def smearing_factor(df: DataFrame, truth: str = "log_SOM", predicted: str = "y_pred_log") -> float:
    """Duan's factor: mean of 10 to the residual."""
    return df.agg(F.avg(F.pow(F.lit(10.0), F.col(truth) - F.col(predicted)))).first()[0]


def with_linear(df: DataFrame, smearing: float) -> DataFrame:
    ten = F.lit(10.0)
    return df.withColumns({
        "y_true_log": F.col("log_SOM"), "y_true_lin": F.pow(ten, F.col("log_SOM")), "y_pred_lin": F.pow(ten, F.col("y_pred_log")) * smearing})


def metrics(df: DataFrame) -> dict:
    """RMSE, MAE, R² on both scales, row and field counts."""
    row = df.agg(
        *reports.error_metrics(F.col("y_true_log"), F.col("y_pred_log"), "log"), *reports.error_metrics(F.col("y_true_lin"), F.col("y_pred_lin"), "lin"),
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(FIELD).alias("n_fields")).first()
    return row.asDict()


def grouped_cv_predictions(production: DataFrame, labelled: DataFrame, features: list[str], trees: int = 200, depth: int = 30) -> DataFrame:
    """Every labelled row predicted by a forest that saw no image of its field: (keys, log_SOM,
    y_pred_log, fold).  Each fold's rows are written out once."""
    folds = group_folds(labelled, FIELD, CV_FOLDS)
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    if len(numbers) < 2:
        raise ValueError("grouped cross-validation needs at least two fields")
    marked = durable(skew.lookup_join(labelled, folds, [FIELD]))
    fit_rows = durable(skew.lookup_join(production, folds, [FIELD]))

    def held_out(fold: int) -> DataFrame:
        model = fit_forest(fit_rows.filter(F.col("fold") != fold), features, trees, depth=depth)
        return forest_predict(model, marked.filter(F.col("fold") == fold), features)

    parts = side_by_side(labelled.sparkSession, [partial(held_out, fold) for fold in numbers])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(FIELD, IMAGE, "log_SOM", "y_pred_log", "fold")


# --- scenarios ------------------------------------------------------------------
@dataclass
class Bundle:
    """A trained scenario: everything prediction needs."""

    scenario: str
    features: list[str]
    selected: list[str]
    means: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    preparation: Preparation
    smearing: float
    images: list[str]
    test_metrics: dict
    production_metrics: dict
    model: RandomForestRegressionModel | forest.Forest | None = None
    cv: DataFrame | None = field(default=None, repr=False)


def train_scenario(raw: DataFrame, scenario: str, seed: int = 42, test_ratio: float = 0.2, forced: list | None = None,
                   trees: int = 200, step_trees: int = 50, depth: int = 30) -> Bundle:
    """The whole training run of one scenario, without leakage from test or held-out fields."""
    spark = raw.sparkSession
    prepared, preparation = prepare_training(durable(raw))
    features = scenario_features(prepared.columns, preparation.classes)[scenario]
    base = durable(prepared.select(FIELD, IMAGE, "log_SOM", *[F.col(c).cast("double").alias(c) for c in features]))
    train, test = group_split(base, FIELD, test_ratio, seed, forced)
    means = column_means(train, features).first().asDict()
    train, test = impute(train, means), impute(test, means)
    inner, validation = train, train
    if train.select(FIELD).distinct().limit(3).count() >= 3:
        inner, validation = group_split(train, FIELD, 0.2, seed + 1)
    scaler = fit_scaler(inner, features)
    train, test, inner, validation = (durable(apply_scaler(d, scaler)) for d in (train, test, inner, validation))
    selected, alpha = lasso_select(inner, features)
    ranked = rank_images(inner, selected, alpha)
    steps = progressive_selection(inner, validation, ranked, selected, step_trees, depth)
    kept = drop_bad_images(spark, ranked, steps)
    if kept != ranked:
        steps = progressive_selection(inner, validation, kept, selected, step_trees, depth)
    images, val_r2 = best_images(spark, kept, steps)
    chosen = train.filter(F.col(IMAGE).isin(images))
    production_rows = durable(harmonize.concat_training(chosen, test))
    final, production, cv = side_by_side(spark, [
        lambda: fit_forest(chosen, selected, trees, seed=seed, depth=depth),
        lambda: fit_forest(production_rows, selected, trees, seed=seed, depth=depth),
        lambda: durable(grouped_cv_predictions(production_rows, harmonize.concat_training(train, test), selected, trees, depth))])
    smearing = smearing_factor(forest_predict(final, chosen, selected))
    test_metrics = metrics(with_linear(forest_predict(final, test, selected), smearing))
    if test_metrics["R2_log"] is None:
        test_metrics["R2_log"] = val_r2
    seen = cv.join(production_rows.select(FIELD, IMAGE), [FIELD, IMAGE], "left_semi")
    cv_smearing = smearing_factor(seen)
    production_metrics = {**metrics(with_linear(seen, cv_smearing)), "estimate": "grouped_cv", "val_r2": val_r2}
    return Bundle(scenario, features, selected, means, scaler, preparation, cv_smearing, images, test_metrics, production_metrics, production, cv)


def override_with(predictions: DataFrame, better: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replace a value where ``better`` has one for the key."""
    renamed = better.select(*keys, F.col(value).alias("_better"))
    return predictions.join(renamed, keys, "left").withColumn(value, F.coalesce("_better", value)).drop("_better")


def predict(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """Log and linear predictions of raw feature rows; labelled rows get their held-out value."""
    prepared = prepare_predict(rows, bundle.preparation)
    typed = prepared.select(FIELD, IMAGE, "log_SOM", *[F.col(c).cast("double").alias(c) for c in bundle.features])
    scaled = apply_scaler(impute(typed, bundle.means), bundle.scaler)
    predicted = forest_predict(bundle.model, scaled, bundle.selected).select(FIELD, IMAGE, "log_SOM", "y_pred_log")
    if bundle.cv is not None:
        predicted = override_with(predicted, bundle.cv, [FIELD, IMAGE], "y_pred_log")
    return with_linear(predicted, bundle.smearing).select(
        FIELD, IMAGE, "y_true_log", "y_pred_log", "y_true_lin", "y_pred_lin",
        F.lit("RandomForest").alias("algo"), F.lit(bundle.scenario).alias("scenario"))


def attach_geometry(predictions: DataFrame, id_map: DataFrame, fields: DataFrame) -> DataFrame:
    """Predictions with gid and polygon; ids without a field drop out."""
    return predictions.join(id_map, FIELD).join(fields, "gid")


# --- model store ----------------------------------------------------------------
def data_fingerprint(files: DataFrame) -> DataFrame:
    """One hash over (name, modification time, size) of the files, in name order.

    Files are hashed one by one and the hashes added up, so the listing is not collected.
    """
    each = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.col("modified").cast("string"), F.col("length").cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    total = files.agg(F.sum(each).alias("t"), F.count(F.lit(1)).alias("n"))
    return total.select(F.sha2(F.concat_ws("|", F.col("t").cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"))


def save_model(bundle: Bundle, path: str, fingerprint: str) -> None:
    import json

    whole = isinstance(bundle.model, forest.Forest)
    if whole:
        forest.stored(bundle.cv.sparkSession, bundle.model).write.mode("overwrite").parquet(f"{path}/trees")
    else:
        bundle.model.write().overwrite().save(f"{path}/forest")
    bundle.cv.write.mode("overwrite").parquet(f"{path}/cv")
    plain = {k: v for k, v in bundle.__dict__.items() if k not in ("model", "cv", "preparation")}
    plain |= {"preparation": asdict(bundle.preparation), "whole_trees": whole}
    row = [(FORMAT_VERSION, fingerprint, json.dumps(plain))]
    bundle.cv.sparkSession.createDataFrame(row, "format_version int, fingerprint string, bundle string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(spark: SparkSession, path: str, fingerprint: str) -> Bundle | None:
    """The saved bundle, or None when there is none or its data or format changed."""
    import json

    from pyspark.errors import AnalysisException

    try:
        about = spark.read.schema("format_version int, fingerprint string, bundle string").json(f"{path}/about").first()
    except AnalysisException:
        return None
    if about is None or about["format_version"] != FORMAT_VERSION or about["fingerprint"] != fingerprint:
        return None
    plain = json.loads(about["bundle"])
    plain["preparation"] = Preparation(**plain["preparation"])
    plain["scaler"] = {k: tuple(v) for k, v in plain["scaler"].items()}
    whole = plain.pop("whole_trees", False)
    model = forest.collected(spark.read.parquet(f"{path}/trees")) if whole else RandomForestRegressionModel.load(f"{path}/forest")
    return Bundle(**plain, model=model, cv=spark.read.parquet(f"{path}/cv"))


def get_or_train(raw: DataFrame, scenario: str, path: str, fingerprint: str, **settings) -> Bundle:
    """Reuse the saved scenario while fingerprint and format match, else train and save it."""
    found = load_model(raw.sparkSession, f"{path}/{scenario}", fingerprint)
    if found is not None:
        return found
    bundle = train_scenario(raw, scenario, **settings)
    save_model(bundle, f"{path}/{scenario}", fingerprint)
    return bundle



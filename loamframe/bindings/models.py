"""Model preparation, selection, forests and prediction reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe import codes
from loamframe.bindings.tables import PARCELS, PREDICTIONS, parcels, predictions, query, read
from loamframe.functions import values
from loamframe.operators import model, reports
from loamframe.session import durable


# --- reports ------------------------------------------------------------------------
_FIELDS = f"""{PREDICTIONS}, fields AS (SELECT algo, scenario, FIELD_ID, avg(y_true_log) AS y_true_log_field, avg(y_pred_log) AS y_pred_log_field, avg(y_true_lin) AS y_true_lin_field,
avg(y_pred_lin) AS y_pred_lin_field, count(DISTINCT Image_ID) AS n_images FROM predictions GROUP BY 1, 2, 3)"""
_COLS = ["y_true_log_field", "y_pred_log_field", "y_true_lin_field", "y_pred_lin_field"]


@query(f"WITH {_FIELDS} SELECT algo, scenario, FIELD_ID, {', '.join(f'round({c}, 8) AS {c}' for c in _COLS)}, n_images FROM fields")
def field_predictions(spark, sf_dir):
    return reports.field_predictions(predictions(spark, sf_dir)).withColumns({c: F.round(c, 8) for c in _COLS})


@query(f"""WITH {_FIELDS} SELECT scenario, round(sqrt(avg(power(y_true_log_field - y_pred_log_field, 2))), 8) AS "RMSE_log", round(avg(abs(y_true_log_field - y_pred_log_field)), 8) AS "MAE_log",
round(1 - sum(power(y_true_log_field - y_pred_log_field, 2)) / (var_pop(y_true_log_field) * count(*)), 6) AS "R2_log", round(sqrt(avg(power(y_true_lin_field - y_pred_lin_field, 2))), 8) AS "RMSE_lin",
round(1 - sum(power(y_true_lin_field - y_pred_lin_field, 2)) / (var_pop(y_true_lin_field) * count(*)), 6) AS "R2_lin", count(DISTINCT FIELD_ID) AS n_fields, round(avg(n_images), 6) AS avg_images_per_field FROM fields GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    m = reports.regression_metrics(reports.field_predictions(predictions(spark, sf_dir)), ["scenario"])
    rounded = {c: F.round(c, 6 if c.startswith("R2") else 8) for c in ("RMSE_log", "MAE_log", "R2_log", "RMSE_lin", "R2_lin")}
    return m.withColumns({**rounded, "avg_images_per_field": F.round("avg_images_per_field", 6)}).drop("MAE_lin")


@query(f"""WITH {PREDICTIONS} SELECT split_part(Image_ID, '_', 1) AS year, round(avg(y_pred_lin) * 10, 6) AS mean_pred, round(min(y_pred_lin) * 10, 6) AS min_pred, round(max(y_pred_lin) * 10, 6) AS max_pred,
round(avg(y_true_lin) * 10, 6) AS mean_meas FROM predictions WHERE scenario = 'S_N' GROUP BY 1""")
def yearly_trend(spark, sf_dir):
    p = predictions(spark, sf_dir)
    used = p.agg(F.count_distinct("Image_ID").alias("n_images"))
    out = reports.yearly_trend(p, "S_N", 10.0, used)
    return out.select("year", *[F.round(c, 6).alias(c) for c in ("mean_pred", "min_pred", "max_pred", "mean_meas")])


_STEPS = "steps AS (SELECT l_suppkey AS field, l_linenumber AS step, round(avg(l_discount), 4) * 10 AS r2 FROM lineitem GROUP BY 1, 2)"


def _steps(spark, sf_dir):
    # round() of the SQL rounds the scaled binary number; F.round goes by the decimal text, which differs beside a tie
    mean = F.round(F.avg("l_discount") * 10_000) / 10_000
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("field"), F.col("l_linenumber").alias("step")).agg((mean * 10).alias("r2"))


@query(f"WITH {_STEPS} SELECT field, step, coalesce(r2 < lag(r2) OVER (PARTITION BY field ORDER BY step) - 0.0105, FALSE) AS dropped FROM steps")
def drop_flag(spark, sf_dir):
    return reports.drop_flag(_steps(spark, sf_dir), "step", "r2", 0.0105, ["field"]).select("field", "step", "dropped")


@query(f"WITH {_STEPS} SELECT field, CAST(arg_max(step, (r2, -step)) AS INTEGER) AS step FROM steps GROUP BY 1")
def argmax_step(spark, sf_dir):
    return reports.argmax_step(_steps(spark, sf_dir), "step", "r2", ["field"]).select("field", "step")


@query("""WITH s AS (SELECT p_brand AS "Image_ID", round(stddev_pop(p_retailprice), 6) AS "CV_RMSE" FROM part GROUP BY 1) SELECT "Image_ID", "CV_RMSE", CAST(row_number() OVER (ORDER BY "CV_RMSE", "Image_ID") AS INTEGER) AS rank FROM s""")
def rank_images(spark, sf_dir):
    scores = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Image_ID")).agg(F.round(F.stddev_pop("p_retailprice"), 6).alias("CV_RMSE"))
    return reports.rank_images(scores)


# --- preparation --------------------------------------------------------------------
@query("""WITH q AS (SELECT quantile_cont(log10(l_extendedprice), 0.25) AS q1, quantile_cont(log10(l_extendedprice), 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, q WHERE log10(l_extendedprice) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def iqr_filter(spark, sf_dir):
    kept, _ = model.iqr_filter(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH q AS (SELECT quantile_cont(log10(l_extendedprice), 0.25) AS q1, quantile_cont(log10(l_extendedprice), 0.75) AS q3 FROM lineitem) SELECT round(q1 - 1.5 * (q3 - q1), 8) AS lo, round(q3 + 1.5 * (q3 - q1), 8) AS hi FROM q")
def iqr_bounds(spark, sf_dir):
    logged = read(spark, sf_dir, "lineitem").select(F.log10("l_extendedprice").alias("v"))
    return model.iqr_bounds(logged, "v").select(F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE l_orderkey % 5 > 0)
SELECT l_suppkey, round(avg((l_quantity - mq) / sq), 6) AS q, round(avg((l_tax - mt) / st), 6) AS t FROM lineitem, s GROUP BY 1""")
def standardize(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    scaled = model.apply_scaler(li, model.fit_scaler(li.filter("l_orderkey % 5 > 0"), ["l_quantity", "l_tax"]))
    return scaled.groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_tax"), 6).alias("t"))


@query("""WITH h AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem), m AS (SELECT avg(q) AS mq FROM h) SELECT l_suppkey, round(avg(coalesce(q, mq)), 6) AS q FROM h, m GROUP BY 1""")
def impute_means(spark, sf_dir):
    holes = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    filled = model.impute(holes, model.column_means(holes, ["q"]).first().asDict())
    return filled.groupBy("l_suppkey").agg(F.round(F.avg("q"), 6).alias("q"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(power(10.0::DOUBLE, log10(l_quantity)) * 1.05::DOUBLE), 6) AS total FROM lineitem GROUP BY 1")
def log_and_inverse(spark, sf_dir):
    back = values.inverse_log_som(values.log_som(F.col("l_quantity")), F.lit(1.05))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(back), 6).alias("total"))


@query("SELECT greatest(1, CAST(floor(0.2 * count(DISTINCT l_suppkey)) AS BIGINT)) AS test_groups, count(*) AS rows, 0::BIGINT AS groups_on_both_sides FROM lineitem")
def group_split(spark, sf_dir):
    train, test = model.group_split(read(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", 0.2, 42)
    sides = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    per_group = sides.groupBy("l_suppkey").agg(F.max("test").alias("hi"), F.min("test").alias("lo"), F.count(F.lit(1)).alias("n"))
    return per_group.agg(F.count_if(F.col("hi") == 1).alias("test_groups"), F.sum("n").alias("rows"), F.count_if(F.col("hi") != F.col("lo")).alias("groups_on_both_sides"))


@query("SELECT 5::BIGINT AS folds, count(DISTINCT l_suppkey) AS groups, TRUE AS balanced FROM lineitem")
def group_folds(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey")
    folds = model.group_folds(li, "l_suppkey", 5)
    sizes = li.join(F.broadcast(folds), "l_suppkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("g"))
    return sizes.agg(F.count(F.lit(1)).alias("folds"), F.sum("g").alias("groups"), (F.max("n") - F.min("n") < F.sum("n") / 20).alias("balanced"))


@query(f"""WITH {_FIELDS} SELECT FIELD_ID, scenario, round(CASE WHEN scenario = 'S_A' THEN y_true_log_field ELSE y_pred_log_field END, 8) AS y_pred_log_field FROM fields""")
def override_predictions(spark, sf_dir):
    f = reports.field_predictions(predictions(spark, sf_dir)).select("FIELD_ID", "scenario", "y_true_log_field", "y_pred_log_field")
    better = f.filter("scenario = 'S_A'").select("FIELD_ID", "scenario", F.col("y_true_log_field").alias("y_pred_log_field"))
    out = model.override_with(f, better, ["FIELD_ID", "scenario"], "y_pred_log_field")
    return out.select("FIELD_ID", "scenario", F.round("y_pred_log_field", 8).alias("y_pred_log_field"))


@query(f"WITH {_FIELDS}, {PARCELS} SELECT f.FIELD_ID, p.gid, f.scenario, round(f.y_pred_lin_field, 6) AS value, p.minx FROM fields f JOIN parcels p ON p.gid = f.FIELD_ID WHERE p.gid % 3 > 0")
def attach_geometry(spark, sf_dir):
    f = reports.field_predictions(predictions(spark, sf_dir)).select("FIELD_ID", "scenario", F.round("y_pred_lin_field", 6).alias("value"))
    ids = parcels(spark, sf_dir).filter("gid % 3 > 0").select(F.col("gid").alias("FIELD_ID"), "gid")
    return model.attach_geometry(f, ids, parcels(spark, sf_dir).select("gid", "minx", "geom")).drop("geom")


# --- training -----------------------------------------------------------------------
def training_rows(spark, sf_dir):
    """Feature rows per (supplier, line number), aggregated from all line items and parts."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    sources = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
    spectral = []
    for n, name in enumerate(codes.SPECTRAL_INDICES):
        c = F.col(sources[n % 6]) * F.when(F.pmod("l_partkey", F.lit(n + 2)) == 0, F.lit(1.0 + n)).otherwise(F.lit(1.0))
        spectral += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_stdDev")]
    rows = li.groupBy(F.col("l_suppkey").cast("double").alias("FIELD_ID"), F.concat(F.lit("2020_0"), F.col("l_linenumber").cast("string"), F.lit("15")).alias("Image_ID")).agg(
        *spectral, F.avg(F.col("p_size") / 10.0 + F.col("l_quantity") / 25.0).alias("noise"), F.max("p_type").alias("hi"), F.min("p_type").alias("lo"),
        F.avg("p_size").alias("elevation_mean"), F.avg("l_tax").alias("BIO1_mean"))
    return rows.withColumns({
        "mean_SOM": 2.0 + F.col("noise") + F.pmod("FIELD_ID", F.lit(5.0)) / 4, "soilTypes": F.concat(F.lit("["), "hi", F.lit(", "), "lo", F.lit("]"))}).drop("noise", "hi", "lo")


@query()
def lasso_selection(spark, sf_dir):
    prepared, prep = model.prepare_training(durable(training_rows(spark, sf_dir)))
    features = model.scenario_features(prepared.columns, prep.classes)["S1_spec_soil"]
    means = model.column_means(prepared, features).first().asDict()
    filled = model.impute(prepared, means)
    scaled = model.apply_scaler(filled, model.fit_scaler(filled, features))
    chosen, alpha = model.lasso_select(scaled, features)
    return model.score_images(scaled, chosen, alpha).withColumn("CV_RMSE", F.round("CV_RMSE", 6))


@query()
def som_scenario(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    bundle = model.train_scenario(rows, "S3_spec_soil_topo_clim")
    return reports.field_predictions(model.predict(bundle, rows)).withColumns({c: F.round(c, 4) for c in _COLS})

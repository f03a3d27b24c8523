import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamframe.operators import gram, model
from loamframe.plans import prediction


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(42)
    rows = []
    for f in range(20):
        som = rng.uniform(2, 12)
        for i in range(5):
            row = {"FIELD_ID": float(f), "Image_ID": f"2023_05{i + 10}", "mean_SOM": som, "soilTypes": "[A, B]" if f % 2 else "[C]"}
            for n, name in enumerate(model.spectral_features()):
                row[name] = som * (n % 3) * 0.1 + rng.normal()
            row["elevation_mean"] = None if f == 3 else float(f)
            rows.append(row)
    return spark.createDataFrame(pd.DataFrame(rows)).cache()


def test_gram_lasso_equals_direct_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = 3 * x[:, 0] - 2 * x[:, 2] + rng.normal(scale=0.1, size=300)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, g=0)
    sums = gram.gram_table(spark.createDataFrame(pdf), ["g"], list("abcd"), "y").toPandas()
    xtx, xty, mx, my, n = gram.centred(gram.as_matrix(sums, 6))
    w = gram.lasso_fit(xtx, xty, n, 0.1)
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / 300
    # optimality: gradient equals alpha on the active set, stays below it elsewhere
    assert np.allclose(slope[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-3) and (np.abs(slope[w == 0]) <= 0.1 + 1e-3).all()
    assert w[1] == 0 and w[3] == 0
    assert gram.squared_error(gram.as_matrix(sums, 6), w, my - mx @ w) == pytest.approx(((y - x @ w - (my - mx @ w)) ** 2).sum(), rel=1e-6)


def test_splits_never_share_a_field(pool):
    train, test = model.group_split(pool, "FIELD_ID", 0.2, 7)
    a, b = ({r["FIELD_ID"] for r in d.select("FIELD_ID").distinct().collect()} for d in (train, test))
    assert len(b) == 4 and not a & b and len(a | b) == 20
    _, forced = model.group_split(pool, "FIELD_ID", 0.2, 7, [1.0, 2.0])
    assert forced.count() == 10
    with pytest.raises(ValueError):
        model.group_split(pool, "FIELD_ID", 0.2, 7, [99.0])
    folds = model.group_folds(pool, "FIELD_ID", 5)
    assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [4] * 5


def test_preparation_is_fitted_once(pool):
    prepared, fitted = model.prepare_training(pool)
    assert fitted.classes == ["A", "B", "C"] and {"soil_A", "soil_C"} <= set(prepared.columns)
    later = model.prepare_predict(pool.limit(5).withColumn("soilTypes", F.lit("[B, unseen]")), fitted).first()
    assert later["soil_B"] == 1 and later["soil_A"] == 0 and "soil_unseen" not in later.asDict()
    with pytest.raises(ValueError):
        model.prepare_training(pool.drop("NDVI_mean"))


def test_train_store_and_predict(spark, pool, tmp_path):
    settings = {"trees": 5, "step_trees": 2, "depth": 3}
    first = model.get_or_train(pool, "S2_spec_soil_topo", str(tmp_path), "print-1", **settings)
    assert "elevation_mean" in first.features and first.production_metrics["n_fields"] >= 4
    assert {r["FIELD_ID"] for r in first.cv.collect()} == {float(f) for f in range(20)}
    again = model.load_model(spark, f"{tmp_path}/S2_spec_soil_topo", "print-1")
    assert again.selected == first.selected and model.load_model(spark, f"{tmp_path}/S2_spec_soil_topo", "print-2") is None
    fields = spark.range(100, 120).select(F.col("id").alias("gid"), F.lit("shape").alias("geom"))
    id_map = spark.range(20).select(F.col("id").cast("double").alias("FIELD_ID"), (F.col("id") + 100).alias("gid"))
    wanted = spark.createDataFrame([(100,), (105,), (500,)], "gid long")
    out, summary, without = prediction.predict_for_fields(wanted, id_map, fields, pool, ["S2_spec_soil_topo"], str(tmp_path), "print-1", **settings)
    assert {r["gid"] for r in out.collect()} == {100, 105} and [r["gid"] for r in without.collect()] == [500]
    held = {(r["FIELD_ID"], r["Image_ID"]): r["y_pred_log"] for r in first.cv.collect()}
    assert all(r["y_pred_log"] == pytest.approx(held[(r["FIELD_ID"], r["Image_ID"])]) for r in out.collect())
    assert summary.first()["n_fields"] == 2


def test_fingerprint_follows_the_files(spark, tmp_path):
    from loamframe.sources import files

    (tmp_path / "a.parquet").write_bytes(b"1")
    mark = lambda: model.data_fingerprint(files.discover_files(spark, str(tmp_path))).first()["fingerprint"]
    one = mark()
    assert one == mark()
    (tmp_path / "b.parquet").write_bytes(b"22")
    assert mark() != one

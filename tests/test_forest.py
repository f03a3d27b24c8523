"""Whole trees grown in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd

from loamframe.operators import forest, model


def _data(n, features=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, features)).round(1)
    return x, 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(scale=0.1, size=n)


def _order(x):
    return np.argsort(x, axis=0, kind="stable").T.copy()


def _plain(x, y, w, depth):
    """Prediction of each row by a tree grown one node after another."""
    mean = (w * y).sum() / w.sum()
    out = np.full(len(y), mean)
    best, left = (w * y).sum() ** 2 / w.sum() * (1 + 1e-12) + 1e-300, None
    for f in range(x.shape[1]) if depth and y[w > 0].min() < y[w > 0].max() else ():
        for cut in np.unique(x[w > 0, f])[:-1]:
            side = x[:, f] <= cut
            a, b = w * side, w * ~side
            score = (a * y).sum() ** 2 / a.sum() + (b * y).sum() ** 2 / b.sum()
            if score > best * (1 + 1e-9):
                best, left = score, side
    if left is not None:
        out[left], out[~left] = _plain(x[left], y[left], w[left], depth - 1), _plain(x[~left], y[~left], w[~left], depth - 1)
    return out


def test_a_tree_is_that_of_a_plain_search():
    x, y = _data(80)
    w = np.random.default_rng(1).poisson(1.0, 80).astype(float)
    got = forest.Forest([forest.grow(x, _order(x), y, w, 3)]).predict(x)
    assert np.allclose(got[w > 0], _plain(x, y, w, 3)[w > 0])
    equal = forest.grow(x, _order(x), np.ones(80), w, 30)
    assert equal["feature"].tolist() == [-1] and equal["number"].tolist() == [1.0]


def test_small_tables_take_no_job_for_each_level(spark):
    x, y = _data(400)
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(log_SOM=y)).repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("forest", "one forest")
    fitted = model.fit_forest(df, names, 20, depth=30)
    jobs = len(sc.statusTracker().getJobIdsForGroup("forest"))
    sc.setJobGroup("rest", "")
    assert len(fitted.trees) == 20 and jobs < 10
    again = model.fit_forest(df.repartition(5), names, 20, depth=30)  # the same however the rows are dealt
    assert all((a["number"] == b["number"]).all() for a, b in zip(fitted.trees, again.trees))
    rows = model.forest_predict(fitted, df, names).toPandas()
    assert np.allclose(rows["y_pred_log"], fitted.predict(rows[names].to_numpy())) and ((rows["y_pred_log"] - rows["log_SOM"]) ** 2).mean() < 0.1 * y.var()


def test_large_tables_are_left_to_the_distributed_trees(spark, monkeypatch):
    monkeypatch.setattr(forest, "WHOLE_ROWS", 50)
    x, y = _data(100)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(log_SOM=y))
    assert type(model.fit_forest(df, list("abcd"), 2, depth=2)).__name__ == "RandomForestRegressionModel"

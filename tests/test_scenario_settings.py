"""The registered scenario is trained with the operators' own settings."""

import inspect
import threading

from loamframe.bindings import models
from loamframe.operators import model


def test_som_scenario_uses_the_full_settings(spark, monkeypatch):
    seen, own = [], inspect.signature(model.train_scenario)

    def stop(*args, **settings):
        seen.append(own.bind(*args, **settings))
        raise StopIteration

    monkeypatch.setattr(model, "train_scenario", stop)
    monkeypatch.setattr(models, "training_rows", lambda *_: None)
    try:
        models.som_scenario(spark, "")
    except StopIteration:
        pass
    seen[0].apply_defaults()
    assert [seen[0].arguments[k] for k in ("trees", "step_trees", "depth")] == [200, 50, 30]


def test_steps_are_fitted_side_by_side(spark, monkeypatch):
    """All steps are under way at once, and their results keep the order of the images."""
    rows = [(f"i{n % 3}", float(n), float(n % 7)) for n in range(120)]
    train = spark.createDataFrame(rows, "Image_ID string, f double, log_SOM double")
    together = threading.Barrier(3)

    def fit(df, *_, **__):
        together.wait(60)
        return df.count()

    monkeypatch.setattr(model, "fit_forest", fit)
    monkeypatch.setattr(model, "forest_predict", lambda fitted, *_: fitted)
    monkeypatch.setattr(model, "r_squared", lambda fitted, *_: fitted)
    steps = model.progressive_selection(train, train, ["i2", "i0", "i1"], ["f"])
    assert [(s["Images_Used"], s["R2_val"], s["Image_ID"]) for s in steps] == [(1, 40, "i2"), (2, 80, "i0"), (3, 120, "i1")]

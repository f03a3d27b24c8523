"""Organic-matter prediction for fields."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamframe.operators import harmonize, model, reports


def predict_for_fields(wanted: DataFrame, id_map: DataFrame, fields: DataFrame, features: DataFrame, scenarios: list[str],
                       store: str, fingerprint: str, **settings):
    """(predictions with polygons, field summary, wanted gids without data).

    ``wanted``: gid (given, or taken from a field match); ``id_map``: FIELD_ID, gid;
    ``features``: raw feature rows of all fields, the training pool.
    """
    mapped, unmapped = harmonize.mapped_ids(wanted.select("gid").distinct(), id_map, ["gid"])
    rows = features.join(mapped.select(model.FIELD).distinct(), model.FIELD, "left_semi")
    out = None
    for scenario in scenarios:
        bundle = model.get_or_train(features, scenario, store, fingerprint, **settings)
        predicted = model.predict(bundle, rows)
        out = predicted if out is None else out.unionByName(predicted)
    summary = reports.regression_metrics(reports.field_predictions(out), ["algo", "scenario"])
    no_rows = harmonize.id_difference(mapped, features.join(id_map, model.FIELD), ["gid"])
    return model.attach_geometry(out, id_map, fields), summary, unmapped.unionByName(no_rows)

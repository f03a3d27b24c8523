"""Cutting giant polygons into pieces, so that no feature is too heavy to join or to serve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.operators import cutting, keys, skew
from loamframe.session import durable

#: Vertices of pieces handed over together: small polygons are not one batch each, giant ones do not pile up.
BATCH_VERTICES = 100_000

_TAKEN = {codes.SPLIT_SOURCE_COLUMN, codes.SPLIT_PART_COLUMN}


def polygons_of(shape: dict) -> list[list]:
    """Rings (xs, ys) of each polygon of a geometry, shell first."""
    out: dict[int, list] = {}
    for ring in shape["parts"]:
        out.setdefault(ring["part"], []).append((bool(ring["hole"]), (np.asarray(ring["xs"], float), np.asarray(ring["ys"], float))))
    return [[xy for _, xy in sorted(rings, key=lambda r: r[0])] for rings in out.values()]


def shape_of(polygons: list[list]) -> dict:
    parts = [{"part": n, "hole": k > 0, "xs": xs.tolist(), "ys": ys.tolist()} for n, rings in enumerate(polygons) for k, (xs, ys) in enumerate(rings)]
    return {"kind": "POLYGON", "parts": parts}


def pieces_of(shape: dict, most: int, depth: int) -> tuple[list[dict], str | None]:
    """(pieces, reason): a polygon gives one piece per polygon cut out of it, several polygons stay together in each piece.

    Rings that cross leave the feature whole; pieces above ``most`` after ``depth`` cuts are kept.  Either way ``reason`` says so.
    """
    polygons = polygons_of(shape)
    try:
        groups = cutting.halve(polygons, most, depth)
    except cutting.CrossingRings as problem:
        return [shape], str(problem)
    if len(polygons) == 1:
        groups = [[one] for group in groups for one in group]
    if not groups:
        return [shape], "no piece has an area"
    left = max(map(cutting.vertices, groups))
    return [shape_of(g) for g in groups], f"a piece keeps {left} vertices" if left > most else None


def _is_large(geom: str, most: int) -> Column:
    return F.coalesce((F.col(f"{geom}.kind") == "POLYGON") & (geo.num_points(F.col(geom)) > most), F.lit(False))


def cut_large(df: DataFrame, max_vertices: int = codes.SPLIT_MAX_VERTICES, gid: str = "gid", geom: str = "geom",
              max_depth: int = codes.SPLIT_MAX_DEPTH) -> DataFrame:
    """(gid, split_part, geom, reason) of the pieces of all polygons above ``max_vertices``, numbered from 1.

    Only those geometries go through Python, spread over all tasks as one of them may be heavy.
    """
    kind, part_column = dict(df.dtypes)[gid], codes.SPLIT_PART_COLUMN

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, held = [gid, part_column, geom, "reason"], [], 0
        for pdf in batches:
            for key, shape in zip(pdf[gid], pdf[geom]):
                pieces, reason = pieces_of(shape, max_vertices, max_depth)
                rows += [(key, n, piece, reason) for n, piece in enumerate(pieces, start=1)]
                held += sum(len(ring["xs"]) for piece in pieces for ring in piece["parts"])
                if held >= BATCH_VERTICES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    schema = f"`{gid}` {kind}, {part_column} int, `{geom}` {geo.GEOM_TYPE}, reason string"
    return skew.over_all_tasks(df.filter(_is_large(geom, max_vertices)).select(gid, geom), gid).mapInPandas(cut, schema)


def split_large(df: DataFrame, order: list[str], max_vertices: int = codes.SPLIT_MAX_VERTICES, gid: str = "gid",
                geom: str = "geom", max_depth: int = codes.SPLIT_MAX_DEPTH) -> DataFrame:
    """Split polygons above ``max_vertices``; attributes are copied, ids renumbered.

    Pieces cover the source exactly, keep all its vertices and leave its holes open; other rows, null geometries among them,
    are part 1 of themselves.  A layer without oversized rows, or one that already has the split columns, is returned unchanged.
    """
    large = _is_large(geom, max_vertices)
    if _TAKEN & set(df.columns) or df.filter(large).isEmpty():
        return df
    pieces = cut_large(df, max_vertices, gid, geom, max_depth).drop("reason")
    whole = df.filter(~large).withColumn(codes.SPLIT_PART_COLUMN, F.lit(1))
    joined = df.filter(large).drop(geom).join(pieces, gid).select(*whole.columns)
    marked = whole.unionByName(joined).withColumnRenamed(gid, codes.SPLIT_SOURCE_COLUMN)
    bounded = geo.with_bounds(marked, geom) if "minx" in df.columns else marked
    # numbering reads its rows several times: polygons are cut once
    return keys.assign_gid(durable(bounded), [*[c for c in order if c != gid], codes.SPLIT_SOURCE_COLUMN, codes.SPLIT_PART_COLUMN], gid)


def split_report(df: DataFrame, max_vertices: int = codes.SPLIT_MAX_VERTICES, gid: str = "gid", geom: str = "geom",
                 max_depth: int = codes.SPLIT_MAX_DEPTH) -> DataFrame:
    """(gid, event, vertices, parts, largest_piece, reason) of each polygon above ``max_vertices``.

    ``event`` is feature_split, feature_split_incomplete (a piece stays too large or the rings allow no cut) or
    feature_not_split (the layer has columns of the result's names).
    """
    sized = df.filter(_is_large(geom, max_vertices)).select(gid, geo.num_points(F.col(geom)).alias("vertices"))
    if _TAKEN & set(df.columns):
        return sized.select(gid, F.lit("feature_not_split").alias("event"), "vertices", F.lit(1).cast("long").alias("parts"),
                            F.col("vertices").alias("largest_piece"), F.lit("column_conflict").alias("reason"))
    cut = cut_large(df, max_vertices, gid, geom, max_depth).groupBy(gid).agg(
        F.count(F.lit(1)).alias("parts"), F.max(geo.num_points(F.col(geom))).alias("largest_piece"), F.max("reason").alias("reason"))
    event = F.when(F.col("reason").isNull(), F.lit("feature_split")).otherwise(F.lit("feature_split_incomplete"))
    return sized.join(cut, gid).select(gid, event.alias("event"), "vertices", "parts", "largest_piece", "reason")


# tasks get the helpers by value, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
cloudpickle.register_pickle_by_value(cutting)

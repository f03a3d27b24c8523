"""Ingest jobs: vector layers, rasters, water union, catalogue walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import catalog as cat, harmonize, keys, query as q, selfcross, skew, split
from loamframe.session import durable
from loamframe.sources import files, landed, writers


def harmonise_layer(layer: DataFrame, crs: str | None, target: str = "EPSG:4326", declared: dict[str, str] | None = None,
                    order: list[str] | None = None, max_vertices: int = 100_000):
    """(clean layer, rejected rows with reasons) — the one lazy chain behind vector ingest.

    The layer has a ``geom`` column; without one it is treated as a plain table.
    """
    typed = files.apply_declared_types(layer, declared or {})
    report = harmonize.validate_layer(typed, crs).first()
    if report["reasons"]:
        raise ValueError(f"layer rejected: {report['reasons']}")
    spatial = "geom" in typed.columns
    rows = typed.dropDuplicates()
    if spatial:
        rows = harmonize.drop_null_geometry(rows)
    named = harmonize.nullify(harmonize.normalize_columns(rows.withColumnRenamed("geom", "shape__") if spatial else rows))
    if not spatial:
        return keys.ensure_gid(named, order or named.columns), None
    named = named.withColumnRenamed("shape__", "geom").drop("minx", "miny", "maxx", "maxy")
    # repair, checks and bounds come out of generators, so that no later step writes them out again, and run in all tasks
    others = [c for c in named.columns if c != "geom"]
    mended = F.struct(geo.invalid_reasons(F.col("geom")).alias("_before"), geo.reproject(geo.repair(F.col("geom")), crs, target).alias("geom"))
    moved = skew.over_all_tasks(named, F.xxhash64("geom")).select(*others, F.inline(F.array(mended)))
    judged = moved.select("*", geo.invalid_reasons(F.col("geom")).alias("_reasons"), F.inline(F.array(geo.bounds(F.col("geom")))))
    plain = [c for c, t in moved.dtypes if not t.startswith(("struct", "array", "map")) and not c.startswith("_")]
    # numbering reads its rows several times, as do the self-crossing check and splitting after it: each written out once
    identified = durable(keys.ensure_gid(durable(judged), order or [*plain, *q.BOUNDS]))
    crossing = durable(selfcross.self_intersecting(identified.filter(F.size("_reasons") == 0), "gid")).withColumn("_crosses", F.lit(True))
    marked = identified.join(crossing, "gid", "left").withColumn(
        "_reasons", F.when(F.col("_crosses"), F.array(F.lit("self_intersection"))).otherwise(F.col("_reasons"))).drop("_crosses")
    rejected = marked.filter(F.size("_reasons") > 0).select("gid", F.concat("_reasons", "_before").alias("reasons"))
    clean = marked.filter(F.size("_reasons") == 0).drop("_reasons", "_before")
    return split.split_large(clean, ["gid"], max_vertices), rejected


def ingest_vector(spark: SparkSession, paths: dict[str, str], target_dir: str, crs: str = "EPSG:4326", overwrite: bool = True) -> DataFrame:
    """Ingest GeoJSON and CSV files (name → path); one bad layer never stops the others.

    Returns the run report, one row per layer.
    """
    events = []
    for name, path in paths.items():
        try:
            if path.lower().endswith(".csv"):
                raw = files.read_csv_any(spark, path)
                spatial = files.find_column(raw.columns, "longitude") and files.find_column(raw.columns, "latitude")
                layer = files.csv_points(raw, name) if spatial else raw
                source = layer.first()["crs"] if spatial else crs
                layer = layer.drop("crs")
            else:
                layer, source = files.read_geojson(spark, path), crs
            clean, _ = harmonise_layer(layer, source)
            writers.write_table(clean, f"{target_dir}/{name}", overwrite)
            events.append((name, "vector", "processed", None))
        except Exception as problem:  # isolation: the layer is reported, the run goes on
            events.append((name, "vector", "error", str(problem)))
    return spark.createDataFrame(events, "name string, type string, status string, error string")


def ingest_raster(meta: DataFrame, items: DataFrame, collections: DataFrame, template: dict[str, str] | None = None):
    """(items table, collections table, skipped rasters) after upserting new raster metadata.

    ``meta`` as for ``catalog.to_item_struct`` with collection, metadata, tags, datetime, description.
    """
    valid, skipped = landed.raster_catalog(meta)
    built = cat.to_item_struct(valid)
    properties = cat.item_properties(valid.select("id", "datetime", "metadata", "tags", "file_url", "description"), template)
    box = F.col("item.bbox")
    rows = built.join(properties, "id").join(valid.select("id", "collection"), "id").select(
        "collection", "id", "datetime", "properties", *[F.get(box, F.lit(n)).alias(c) for n, c in enumerate(("minx", "miny", "maxx", "maxy"))])
    merged = writers.upsert(items, rows, ["collection", "id"])
    documents = cat.collection_document(merged)
    return merged, writers.upsert(collections, documents, ["id"]), skipped


def water_union(layers: dict[str, DataFrame], include: str, exclude: str | None = None) -> DataFrame:
    """All matching water layers as one, numbered, with the layer's name."""
    union = harmonize.union_layers(layers, include, exclude)
    keep = [c for c in union.columns if c in ("source", "geom", "minx", "miny", "maxx", "maxy")]
    return keys.assign_gid(union.select(*keep), ["source", "minx", "miny", "maxx", "maxy"], "water_id")


def catalog_walk(collections: dict[str, DataFrame]) -> DataFrame:
    """Profile of every collection; a failing one becomes a row with its error."""
    out = None
    for name, df in collections.items():
        try:
            row = durable(q.profile(df, name).withColumn("error", F.lit(None).cast("string")))  # read now, so that a failure is caught
        except Exception as problem:
            spark = next(iter(collections.values())).sparkSession
            row = spark.createDataFrame([(name, str(problem))], "collection string, error string")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out

"""Sinks: Parquet tables, feature layers, upserts, GeoJSON/CSV text, spatial layout, models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import harmonize, keys


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _check(df: DataFrame, name: str) -> None:
    if not name or not re.fullmatch(r"[A-Za-z0-9_-]+", name.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")):
        raise ValueError(f"not a table name: {name!r}")
    if not df.columns or df.isEmpty():
        raise ValueError("nothing to write: the frame is empty")


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> str:
    """Parquet write; without ``overwrite`` an existing table is kept as it is."""
    _check(df, path)
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return path


def write_features(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Feature layer with canonical column names and bounds columns beside the geometry."""
    _check(df, path)
    canonical = harmonize.resolve_aliases(df)
    if "geometry" in canonical.columns and "geom" not in canonical.columns:
        canonical = canonical.withColumnRenamed("geometry", "geom")
    geo.with_bounds(canonical).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def merge_staged(spark: SparkSession, parts: list[str], path: str) -> DataFrame:
    """Staged parts with differing columns → one table; returns its overall bounds."""
    from loamframe.sources.files import read_union_by_name

    merged = read_union_by_name(spark, *parts)
    merged.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count(F.lit(1)).alias("rows"),
    )


def export_table(df: DataFrame, path: str, renames: dict[str, str] | None = None) -> str:
    """Export with alias → canonical names (or explicit renames)."""
    out = df.withColumnsRenamed(renames) if renames else harmonize.resolve_aliases(df)
    return write_table(out, path)


def load_table(df: DataFrame, table: str, mode: str, order: list[str] | None = None) -> None:
    """Load into a catalog table: ids assured first, checked before anything is written.

    Appended rows without ids go on after the stored ones; appended ids must not be stored already.
    """
    modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}")
    ready = keys.ensure_gid(df, order or df.columns)
    problems = keys.validate_key(ready, "gid").first()
    bad = {c: problems[c] for c in ("nulls", "duplicates", "non_integers", "negatives") if problems[c]}
    if bad:
        raise ValueError(f"gid is not a key: {bad}")
    if mode == "append" and df.sparkSession.catalog.tableExists(table):
        stored = df.sparkSession.table(table).select("gid")
        if "gid" not in df.columns:
            last = stored.agg(F.coalesce(F.max("gid"), F.lit(0))).first()[0]
            ready = ready.withColumn("gid", F.col("gid") + F.lit(last))
        elif not ready.join(stored, "gid", "left_semi").isEmpty():
            raise ValueError(f"some gid are in {table} already")
    ready.write.mode(modes[mode]).saveAsTable(table)


def upsert(target: DataFrame, updates: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Insert or update by key.  Where a key comes twice in ``updates`` the highest
    ``version`` wins (any full order when none is named); untouched target rows stay."""
    newest = keys.last_per_key(updates, key, version)
    return target.join(newest.select(*key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def append_results(results: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows still to append: those whose key is not yet done without error."""
    finished = done.filter(F.col("error").isNull() | (F.col("error") == "")).select(*key)
    return results.join(finished, key, "left_anti")


def to_feature_json(df: DataFrame, id_column: str, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature text per row; bounds, binary and geometry columns are no properties."""
    hidden = {geom, "minx", "miny", "maxx", "maxy"} | {c for c, t in df.dtypes if t == "binary"}
    properties = F.to_json(F.struct(*[c for c in df.columns if c not in hidden]), {"ignoreNullFields": "false"})
    # JSON text of the bare id: a one-element array without its brackets
    id_text = F.regexp_extract(F.to_json(F.array(id_column)), r"^\[(.*)\]$", 1)
    return df.select(
        F.col(id_column),
        F.concat(
            F.lit('{"type":"Feature","id":'), id_text,
            F.lit(',"geometry":'), F.coalesce(geo.as_geojson(F.col(geom)), F.lit("null")),
            F.lit(',"properties":'), properties, F.lit("}"),
        ).alias("feature"),
    )


def write_feature_text(df: DataFrame, path: str, id_column: str, fmt: str = "geojsonseq", geom: str = "geom") -> None:
    """Features as JSON lines, or attributes with WKT as CSV."""
    if fmt == "geojsonseq":
        to_feature_json(df, id_column, geom).select("feature").write.mode("overwrite").text(path)
    elif fmt == "csv":
        flat = df.withColumn("wkt", geo.wkt(F.col(geom))).drop(geom)
        flat.select(*[c for c, t in flat.dtypes if not t.startswith(("array", "struct", "map", "binary"))]).write.mode(
            "overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown text format: {fmt}")


def with_layout_key(df: DataFrame, cell: float = 0.5) -> DataFrame:
    return df.withColumns({"cx": geo.cell_of(F.col("minx"), cell), "cy": geo.cell_of(F.col("miny"), cell)})


def build_spatial_layout(df: DataFrame, path: str, cell: float = 0.5, partitions: int | None = None) -> None:
    """Copy of a layer ordered by grid cell, so file and row-group statistics prune box queries.

    The range key goes on below the cell, so a crowded cell is split over partitions.
    """
    keyed = with_layout_key(df, cell)
    order = ["cx", "cy", "minx", "miny"]
    spread = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def refresh_copy(base: DataFrame, additions: DataFrame, key: list[str], path: str) -> str:
    """Re-export a table after columns were added; the new version goes to its own folder."""
    return write_table(harmonize.lookup(base, additions, key), path)


def publish_catalog(items: DataFrame, new_items: DataFrame, collections: DataFrame, new_collections: DataFrame):
    """Upserted items table and collections table."""
    return (
        upsert(items, new_items, ["collection", "id"], "updated" if "updated" in new_items.columns else None),
        upsert(collections, new_collections, ["id"]),
    )

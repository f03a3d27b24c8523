"""File sources: discovery, CSV, GeoJSON, Parquet collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo, text

DELIMITERS = [",", ";", "\t", "|"]


def discover_files(spark: SparkSession, path: str, known_datasets: list[str] | None = None,
                   max_distance: int = 3) -> DataFrame:
    """Recursive listing ``(path, id, title, kind, is_spatial, length, modified)``.

    Only the listing columns of the binary source are read, never file contents.
    A CSV is spatial when its header has both coordinate aliases, or its stem is
    close to a known dataset name.  Internal and system layers are left out.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return classify_files(listing, csv_headers(spark, path), known_datasets, max_distance)


def classify_files(listing: DataFrame, headers: DataFrame | None = None,
                   known_datasets: list[str] | None = None, max_distance: int = 3) -> DataFrame:
    """Kind, id, title and spatial flag of listed paths; ``headers`` is ``(path, header)``."""
    extension, stem = text.file_extension(F.col("path")), text.file_stem(F.col("path"))
    kind = (
        F.when(extension.isin(codes.RASTER_EXTENSIONS), F.lit("raster"))
        .when(extension == ".csv", F.lit("csv"))
        .when(extension.isin(codes.VECTOR_EXTENSIONS), F.lit("vector"))
        .when(extension == ".parquet", F.lit("collection"))
    )
    files = listing.withColumns({"id": stem, "title": text.title(stem), "kind": kind}).filter(
        F.col("kind").isNotNull()
        & ~F.lower("id").isin(codes.INTERNAL_LAYERS)
        & ~F.col("id").rlike(codes.SYSTEM_LAYER_PATTERN)
    )
    names = known_datasets if known_datasets is not None else list(codes.CSV_SOURCE_CRS)
    near = F.lit(False)
    for name in names:
        near = near | (F.levenshtein(F.lower("id"), F.lit(name)) <= max_distance)
    has_xy = F.lit(False)
    if headers is not None:
        files = files.join(headers, "path", "left")
        fields = F.transform(
            F.split(F.lower(F.coalesce("header", F.lit(""))), r"[,;\t|]"),
            lambda h: F.btrim(h, F.lit(' "')),
        )

        def any_of(canonical: str) -> Column:
            wanted = [canonical, *codes.COLUMN_ALIASES[canonical]]
            return F.arrays_overlap(fields, F.array(*[F.lit(w) for w in wanted]))

        has_xy = any_of("longitude") & any_of("latitude")
    spatial = F.when(F.col("kind") == "csv", has_xy | near).otherwise(
        F.col("kind").isin("vector", "raster", "collection")
    )
    keep = [c for c in ("path", "length", "modified") if c in files.columns]
    return files.select(*keep, "id", "title", "kind", spatial.alias("is_spatial"))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of every CSV below ``path``."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
        .select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("at"),
                F.monotonically_increasing_id().alias("line"))
    )
    return lines.filter(F.col("at") == 0).groupBy("path").agg(F.min_by("value", "line").alias("header"))


def read_csv_any(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "latin1"),
                 schema: str | None = None) -> DataFrame:
    """CSV with the first encoding that decodes it and the separator its header uses."""
    lines = spark.read.text(path)
    broken = not lines.filter(~F.is_valid_utf8("value")).isEmpty()
    encoding = encodings[1] if broken and len(encodings) > 1 else encodings[0]
    encoding = {"latin1": "iso-8859-1"}.get(encoding.lower(), encoding)  # the reader's name for it
    head = lines.head()
    separator = max(DELIMITERS, key=(head["value"] if head else "").count)
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def find_column(columns: list[str], canonical: str) -> str | None:
    """Column with a canonical name or, failing that, its first alias (case-insensitive)."""
    by_lower = {c.lower(): c for c in columns}
    for name in [canonical, *codes.COLUMN_ALIASES[canonical]]:
        if name in by_lower:
            return by_lower[name]
    return None


def csv_points(df: DataFrame, dataset: str = "", x: str | None = None, y: str | None = None,
               crs: str | None = None, sidecar_crs: str | None = None) -> DataFrame:
    """Point geometry from coordinate columns found by alias; adds ``geom`` and ``crs``."""
    x = x or find_column(df.columns, "longitude")
    y = y or find_column(df.columns, "latitude")
    if x is None or y is None:
        raise ValueError("no coordinate columns found")
    code = crs or codes.CSV_SOURCE_CRS.get(dataset.lower()) or sidecar_crs or "EPSG:4326"
    at = geo.point(F.col(x).try_cast("double"), F.col(y).try_cast("double"))
    return df.withColumns({"geom": at, "crs": F.lit(code)})


_FEATURE = "id:string,geometry:string,properties:string"


def read_geojson(spark: SparkSession, path: str, properties_schema: str | None = None,
                 line_delimited: bool = False) -> DataFrame:
    """GeoJSON features as rows: property columns, ``geom`` and bounds.

    ``line_delimited`` reads one feature per line, which splits across tasks; a
    classic document is one record of the JSON source.
    """
    if line_delimited:
        features = spark.read.schema("id string, geometry string, properties string").json(path)
    else:
        docs = spark.read.option("multiLine", True).schema(
            f"features array<struct<{_FEATURE}>>").json(path)
        features = docs.select(F.explode("features").alias("f")).select("f.*")
    if properties_schema is None:
        found = features.select(
            F.schema_of_variant_agg(F.parse_json("properties")).alias("s")).first()["s"]
        properties_schema = found.replace("OBJECT<", "STRUCT<") if found else "STRUCT<>"
    parsed = features.withColumns({
        "p": F.from_json("properties", properties_schema), "geom": geo.from_geojson(F.col("geometry")),
    })
    return geo.with_bounds(parsed.select(F.col("id").alias("feature_id"), "p.*", "geom"))


def apply_declared_types(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Declared layer types win: integers → nullable long, floats → double; bad text → NULL."""
    targets = {"int": "bigint", "integer": "bigint", "int32": "bigint", "int64": "bigint", "short": "bigint",
               "float": "double", "float32": "double", "float64": "double", "real": "double", "double": "double"}
    casts = {}
    for name, kind in declared.items():
        base = re.split(r"[:(]", kind.lower())[0]
        if name in df.columns and base in targets:
            casts[name] = F.col(name).try_cast(targets[base])
    return df.withColumns(casts) if casts else df


def read_collection(spark: SparkSession, directory: str, collection: str) -> DataFrame:
    """One Parquet collection by id."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", collection):
        raise ValueError(f"not a collection id: {collection!r}")
    return spark.read.parquet(f"{directory}/{collection}.parquet")


def read_union_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with different columns, aligned by name.  Also serves files whose types differ
    in width (int and long): each file set is read alone, then united."""
    if len(paths) == 1:
        return spark.read.option("mergeSchema", True).parquet(paths[0])
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out

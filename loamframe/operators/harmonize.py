"""Harmonising and validating layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from loamframe import codes
from loamframe.functions.text import fold_identifier
from loamframe.operators import skew


def canonical_name(name: str) -> str:
    folded = fold_identifier(name)
    for canonical, aliases in codes.COLUMN_ALIASES.items():
        if folded == canonical or folded in aliases:
            return canonical
    return folded


def normalize_columns(df: DataFrame) -> DataFrame:
    """Fold column names and map aliases to canonical names; the first of a clash gets the name."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        name = canonical_name(column)
        if name in taken:
            name = fold_identifier(column)
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def alias_conflicts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: for each (alias, canonical) pair the number of differing rows, in one pass."""
    return df.agg(*[
        F.count_if(~F.col(a).eqNullSafe(F.col(c))).alias(f"{a}__{c}") for a, c in pairs
    ])


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Rename aliases; where alias and canonical both exist they must agree, then the alias goes."""
    by_lower = {c.lower(): c for c in df.columns}
    renames, both = {}, []
    for canonical, aliases in codes.COLUMN_ALIASES.items():
        if canonical == "geometry":
            continue
        present = [by_lower[a] for a in aliases if a in by_lower]
        if canonical in by_lower:
            both += [(a, by_lower[canonical]) for a in present]
        elif present:
            renames[present[0]] = canonical
    if both:
        counts = alias_conflicts(df, both).first().asDict()
        clashes = {k: v for k, v in counts.items() if v}
        if clashes:
            raise ValueError(f"alias and canonical column differ (rows): {clashes}")
    return df.drop(*[a for a, _ in both]).withColumnsRenamed(renames)


def nullify(df: DataFrame, spellings: list[str] | None = None) -> DataFrame:
    """Spellings of a missing value become NULL in every text column."""
    words = codes.NULL_SPELLINGS if spellings is None else spellings
    texts = {c: F.when(~F.col(c).isin(words), F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(texts) if texts else df


def drop_null_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.filter(F.col(geom).isNotNull())


def cast_expected(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the listed columns that exist; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def star_except(df: DataFrame, *served: str) -> DataFrame:
    """Everything but binary columns and the separately served geometry."""
    return df.drop(*served, *[c for c, t in df.dtypes if t == "binary"])


def validate_layer(df: DataFrame, crs: str | None, geom: str = "geom") -> DataFrame:
    """One row of layer checks: kind (layer or table), rows, null geometries, reasons."""
    spatial = geom in df.columns
    nulls = F.count_if(F.col(geom).isNull()) if spatial else F.lit(None).cast("bigint")
    counted = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_geometries"))
    coded = bool(crs) and crs.upper().startswith("EPSG:") and crs.split(":", 1)[1].isdigit()
    reasons = F.array_compact(F.array(
        F.when(F.col("rows") == 0, F.lit("empty layer")),
        F.lit("coordinate system missing" if spatial and not crs else None).cast("string"),
        F.lit("coordinate system has no code" if spatial and crs and not coded else None).cast("string"),
    ))
    return counted.select(
        F.lit("layer" if spatial else "table").alias("kind"), "rows", "null_geometries", reasons.alias("reasons")
    )


def union_layers(layers: dict[str, DataFrame], include: str, exclude: str | None = None,
                 geom: str | None = "geom") -> DataFrame:
    """Union of layers whose name is LIKE ``include`` and not LIKE ``exclude``, with a ``source``
    column; point features are left out when the layers have a geometry."""
    import fnmatch

    def like(name: str, pattern: str) -> bool:
        return fnmatch.fnmatchcase(name, pattern.replace("%", "*").replace("_", "?"))

    chosen = [
        df.withColumn("source", F.lit(name)) for name, df in sorted(layers.items())
        if like(name, include) and not (exclude and like(name, exclude))
    ]
    if not chosen:
        raise ValueError(f"no layer matches {include!r}")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)
    return union.filter(F.col(f"{geom}.kind") != "POINT") if geom and geom in union.columns else union


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed.  Copies collapse map-side, so a large group of copies never
    travels; map columns (not comparable) are compared as JSON text."""
    maps = [c for c, t in df.dtypes if t.startswith("map")]
    if not maps:
        return df.distinct()
    shadow = {f"_{c}_json": F.to_json(c) for c in maps}
    others = [c for c in df.columns if c not in maps]
    return df.withColumns(shadow).dropDuplicates([*others, *shadow]).drop(*shadow)


def concat_training(selected: DataFrame, extra: DataFrame) -> DataFrame:
    """Row-preserving union by name."""
    return selected.unionByName(extra, allowMissingColumns=True)


def lookup(df: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Left join of a lookup, broadcast only after its size was checked."""
    return skew.lookup_join(df, table, key, "left")


def stamp_flags(fields: DataFrame, mapping: DataFrame, key: list[str], value: str, flag: str) -> DataFrame:
    """Value column and has-value flag from a mapping; a missing key gives NULL and false."""
    joined = lookup(fields, mapping.select(*key, value), key)
    return joined.withColumn(flag, F.col(value).isNotNull())


def mapped_ids(data: DataFrame, mapping: DataFrame, key: list[str]):
    """(rows with their mapped id, keys with no mapping)."""
    table = F.broadcast(mapping) if skew.small(mapping) else mapping
    return data.join(table, key, "inner"), data.select(*key).distinct().join(table.select(*key), key, "left_anti")


def id_difference(requested: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Requested ids that have no data."""
    return requested.select(*key).distinct().join(present.select(*key), key, "left_anti")


def id_intersect(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), key, "left_semi")


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct whole-number ids of a feature table."""
    return df.select(F.col(column).try_cast("bigint").alias(column)).filter(F.col(column).isNotNull()).distinct()


def in_list(df: DataFrame, column: str, values: list | DataFrame, inline_limit: int = 1000) -> DataFrame:
    """Membership filter: a pushed-down IN for a short list, a semi join for a table of values."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column).distinct(), column, "left_semi")
    if len(values) <= inline_limit:
        return df.filter(F.col(column).isin(list(values)))
    kind = df.schema[column].dataType
    table = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(column, kind)]))
    return df.join(table.distinct(), column, "left_semi")


def infer_logical_type(df: DataFrame, column: str, share: float = 0.7) -> DataFrame:
    """Logical type of a text column from all its non-null values: json, timestamp or text."""
    head = df.select(column).filter(F.col(column).isNotNull())
    # a bare number is valid JSON too, but only objects and lists count as JSON here
    is_json = F.try_parse_json(column).isNotNull() & F.ltrim(column).rlike(r"^[\[{]")
    is_time = F.try_to_timestamp(column).isNotNull() & F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}")
    rates = head.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.coalesce(F.avg(is_json.cast("double")), F.lit(0.0)).alias("json_share"),
        F.coalesce(F.avg(is_time.cast("double")), F.lit(0.0)).alias("time_share"),
    )
    kind = F.when(F.col("json_share") >= share, F.lit("json")).when(
        F.col("time_share") >= share, F.lit("timestamp")).otherwise(F.lit("text"))
    return rates.select(F.lit(column).alias("column"), "sampled", kind.alias("logical_type"))

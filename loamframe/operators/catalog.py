"""Catalogue items and collections (items are nested structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamframe import codes
from loamframe.functions import geometry as geo
from loamframe.functions.text import bbox_key
from loamframe.functions.times import datetime_from_map, to_utc
from loamframe.functions.values import nodata_text
from loamframe.operators import keys
from loamframe.operators.requests import reasons, split_valid


def catalog_search(items: DataFrame, collections: list[str] | None = None, box=None, start=None, end=None,
                   expression: str | None = None, limit: int | None = None) -> DataFrame:
    """Items by collection, box, closed time interval and property predicate; newest first."""
    found = items
    if collections:
        found = found.filter(F.col("collection").isin(collections))
    if box is not None:
        found = found.filter(geo.bbox_overlaps(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")], box))
    if start is not None:
        found = found.filter(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("datetime") <= F.lit(end).cast("timestamp"))
    if expression:
        found = found.filter(F.expr(expression))
    return found.orderBy(F.desc("datetime"), "id").limit(limit) if limit else found


def cached_item(items: DataFrame, requests: DataFrame) -> DataFrame:
    """First reusable item per request: same rounded box, version, dates and mask flag, and it has
    the asset asked for.  ``items`` and ``requests`` carry bounds, version, start, end, masked."""
    same = ["box_key", "version", "start", "end", "masked"]
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    # one item for each asset of each key, so a request meets one row however many items share its box
    offered = items.withColumn("box_key", bbox_key(*box)).select("id", F.explode("assets").alias("asset"), *same)
    known = offered.groupBy("asset", *same).agg(F.min("id").alias("id"))
    asked = requests.withColumn("box_key", bbox_key(*box)).select("request_id", "asset", *same)
    return asked.join(known, ["asset", *same]).groupBy("request_id").agg(F.min("id").alias("id"))


def match_catalog(records: DataFrame, patterns: DataFrame, excludes: DataFrame):
    """(record, block) matches by API and id pattern, and the records nobody claims or excludes.

    Patterns are a registry written by hand; joined on the API first, so each record only
    meets the patterns of its own API.
    """
    def hits(table: DataFrame) -> DataFrame:
        pairs = records.join(F.broadcast(table), "api")
        return pairs.filter(F.regexp_like("id", F.col("pattern")))

    matched = hits(patterns).select("block", "api", "id").distinct()
    excluded = hits(excludes).select("api", "id").distinct()
    others = records.join(matched.select("api", "id").distinct(), ["api", "id"], "left_anti").join(
        excluded, ["api", "id"], "left_anti")
    return matched, others


def year_span(rows: DataFrame, group: str, identifier: str, start_year: str | None = None, end_year: str | None = None) -> DataFrame:
    """Years named in ids and temporal extents as ``min–max`` text (one year alone when equal)."""
    named = F.transform(F.regexp_extract_all(F.col(identifier), F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    extra = [F.col(c).cast("int") for c in (start_year, end_year) if c]
    years = F.concat(named, F.array(*extra)) if extra else named
    spans = rows.groupBy(group).agg(F.min(F.array_min(years)).alias("lo"), F.max(F.array_max(years)).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).when(
        F.col("lo").isNotNull(), F.concat_ws("–", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return spans.select(group, text.alias("years"))


def temporal_extent(items: DataFrame, group: list[str] | None = None, time: str = "datetime") -> DataFrame:
    aggregates = [F.min(time).alias("start"), F.max(time).alias("end")]
    return items.groupBy(*group).agg(*aggregates) if group else items.agg(*aggregates)


def spatial_extent(items: DataFrame, group: list[str]) -> DataFrame:
    return items.groupBy(*group).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def to_item_struct(meta: DataFrame) -> DataFrame:
    """Raster metadata rows → item struct.

    ``meta``: id, crs, minx … maxy in that system, width, height, bands (array of
    struct<name, dtype, nodata>), file_url.
    """
    corners = geo.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    wgs = F.when(F.col("crs") == "EPSG:4326", corners)
    for code in geo.KNOWN_CRS[1:]:
        wgs = wgs.when(F.col("crs") == code, geo.reproject(corners, code, "EPSG:4326"))
    placed = meta.withColumn("_geom", wgs)
    box = geo.bounds(F.col("_geom"))
    bands = F.transform(
        "bands",
        lambda b: F.struct(b["name"].alias("name"), b["dtype"].alias("data_type"), nodata_text(b["nodata"]).alias("nodata")),
    )
    item = F.struct(
        F.col("id"), F.lit("Feature").alias("type"), F.col("_geom").alias("geometry"),
        F.array(box["minx"], box["miny"], box["maxx"], box["maxy"]).alias("bbox"),
        F.struct(
            F.regexp_extract("crs", r"(\d+)$", 1).cast("int").alias("epsg"),
            F.array("height", "width").alias("shape"),
            F.array(
                F.try_divide(F.col("maxx") - F.col("minx"), F.col("width")), F.lit(0.0), F.col("minx"),
                F.lit(0.0), -F.try_divide(F.col("maxy") - F.col("miny"), F.col("height")), F.col("maxy"),
            ).alias("transform"),
        ).alias("proj"),
        F.create_map(F.lit("data"), F.struct(F.col("file_url").alias("href"), bands.alias("bands"))).alias("assets"),
    )
    return placed.select("id", item.alias("item"))


def item_properties(items: DataFrame, template: dict[str, str] | None = None) -> DataFrame:
    """Template, then metadata, then tags, later values winning; NULLs dropped; datetime settled.

    ``items``: id, datetime (text or NULL), metadata, tags (maps of text), file_url, description.
    """
    base = F.create_map(*[F.lit(x) for kv in (template or {}).items() for x in kv]) if template else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    moment = F.coalesce(to_utc(F.col("datetime")), datetime_from_map(
        F.coalesce("metadata", "tags", empty), F.col("file_url")))
    fixed = F.create_map(
        F.lit("datetime"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("title"), F.col("id"),
        F.lit("source"), F.lit("cog_processing"), F.lit("description"), F.col("description"),
    )
    layers = [base, F.coalesce("metadata", empty), F.coalesce("tags", empty), fixed]
    merged = layers[0]
    for layer in layers[1:]:
        # the earlier map without the later one's keys, then the later one
        merged = F.map_concat(_without(merged, layer), layer)
    return items.select("id", moment.alias("datetime"), F.map_filter(merged, lambda _, v: v.isNotNull()).alias("properties"))


def _without(earlier: Column, later: Column) -> Column:
    return F.map_filter(earlier, lambda k, _: ~F.array_contains(F.map_keys(later), k))


def collection_document(items: DataFrame, collection: str = "collection") -> DataFrame:
    """One document per collection: spatial and temporal extents, item count, title."""
    extents = items.groupBy(collection).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.count(F.lit(1)).alias("items"),
    )
    extent = F.struct(
        F.array("minx", "miny", "maxx", "maxy").alias("bbox"), F.array("start", "end").alias("interval"))
    return extents.select(
        F.col(collection).alias("id"), F.lit("Collection").alias("type"),
        F.initcap(F.translate(collection, "_", " ")).alias("title"), extent.alias("extent"), "items")


def normalize_meta(rows: DataFrame):
    """Ids to text, boxes to four doubles; (usable rows, rejected rows with reasons)."""
    typed = rows.withColumns({
        "gid": F.col("gid").cast("string"),
        "bbox": F.transform("bbox", lambda v: v.cast("string").try_cast("double")),
    })
    judged = typed.withColumn("reasons", reasons(
        ("gid missing", F.col("gid").isNull()),
        ("bbox missing", F.col("bbox").isNull()),
        ("bbox needs four values", F.col("bbox").isNotNull() & (F.size("bbox") != 4)),
        ("bbox value is no number", F.exists("bbox", lambda v: v.isNull())),
        ("file_url missing", F.col("file_url").isNull() | (F.col("file_url") == "")),
    ))
    return split_valid(judged)


def validate_items(items: DataFrame, source: str = "source"):
    """Structure check of items; ids default to ``source_index``; (good, rejected with reasons).

    ``items``: source, index, id, type, bbox, has_geometry, datetime, assets (map).
    """
    named = items.withColumn("id", F.coalesce("id", F.concat_ws("_", F.col(source), F.col("index").cast("string"))))
    judged = named.withColumn("reasons", reasons(
        ("type must be Feature", F.col("type").isNull() | (F.col("type") != "Feature")),
        ("geometry missing", ~F.coalesce("has_geometry", F.lit(False))),
        ("bbox needs four values", F.col("bbox").isNull() | (F.size("bbox") != 4)),
        ("datetime missing", F.col("datetime").isNull()),
        ("assets missing", F.col("assets").isNull() | (F.size("assets") == 0)),
    ))
    return split_valid(judged)


def first_items(items: DataFrame, collection: str = "collection", order: str = "id") -> DataFrame:
    """First row of every collection."""
    return keys.first_per_key(items, [collection], [F.col(order)])



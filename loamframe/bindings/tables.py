"""The given generic tables seen as domain tables, with the same view as SQL text.

Positions are derived from keys by fixed arithmetic.  Every view covers all rows of its table; a
pixel has the first five entries of its vector as bands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamframe.functions import geometry as geo
from loamframe.session import shared_folder
from loamframe.sources.buckets import BucketStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its SQL."""
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_store(spark: SparkSession) -> BucketStore:
    """An empty store in the shared folder."""
    return BucketStore(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


def spread(key: str | Column, step: int, span: int, start: float) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.lit(start) + (key * step % span) / F.lit(100.0)


def sql_spread(key: str, step: int, span: int, start: float) -> str:
    return f"({start}::DOUBLE + (({key} * {step}) % {span}) / 100.0::DOUBLE)"


# --- farms: one point per customer ------------------------------------------
def farms(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    out = c.select(
        F.col("c_custkey").alias("gid"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey",
        spread("c_custkey", 7919, 2375, -79.75).alias("x"), spread("c_custkey", 104729, 1750, 45.0).alias("y"),
    )
    return out.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})


FARMS = f"""farms AS (SELECT c_custkey AS gid, c_name, c_acctbal, c_mktsegment, c_nationkey,
  {sql_spread('c_custkey', 7919, 2375, -79.75)} AS x, {sql_spread('c_custkey', 104729, 1750, 45.0)} AS y
  FROM customer)"""


# --- parcels: one rectangle per supplier ------------------------------------
def _boxes(df: DataFrame, key: str, gid: str, sx, sy, w: Column, h: Column, *keep) -> DataFrame:
    placed = df.select(F.col(key).alias(gid), *keep, spread(key, *sx).alias("minx"), spread(key, *sy).alias("miny"),
                       w.alias("_w"), h.alias("_h"))
    sized = placed.withColumns({"maxx": F.col("minx") + F.col("_w"), "maxy": F.col("miny") + F.col("_h")}).drop("_w", "_h")
    return sized.withColumn("geom", geo.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))


def parcels(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return _boxes(read(spark, sf_dir, "supplier"), "s_suppkey", "gid", (613, 2300, -79.75), (347, 1700, 45.0),
                  (k % 7 + 3) / F.lit(10.0), (k % 5 + 3) / F.lit(10.0), "s_name", "s_acctbal", "s_nationkey")


PARCELS = f"""parcels AS (SELECT *, minx + w AS maxx, miny + h AS maxy FROM (SELECT s_suppkey AS gid, s_name, s_acctbal,
  s_nationkey, {sql_spread('s_suppkey', 613, 2300, -79.75)} AS minx, {sql_spread('s_suppkey', 347, 1700, 45.0)} AS miny,
  (s_suppkey % 7 + 3) / 10.0::DOUBLE AS w, (s_suppkey % 5 + 3) / 10.0::DOUBLE AS h FROM supplier))"""


# --- soil classes: one rectangle per part ------------------------------------
def soils(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return _boxes(read(spark, sf_dir, "part"), "p_partkey", "soil_id", (1009, 2350, -79.75), (769, 1730, 45.0),
                  (k % 3 + 2) / F.lit(10.0), (k % 4 + 2) / F.lit(10.0),
                  F.col("p_brand").alias("symbol"), F.col("p_type").alias("description"), "p_size")


SOILS = f"""soils AS (SELECT *, minx + w AS maxx, miny + h AS maxy FROM (SELECT p_partkey AS soil_id, p_brand AS symbol,
  p_type AS description, p_size, {sql_spread('p_partkey', 1009, 2350, -79.75)} AS minx,
  {sql_spread('p_partkey', 769, 1730, 45.0)} AS miny, (p_partkey % 3 + 2) / 10.0::DOUBLE AS w,
  (p_partkey % 4 + 2) / 10.0::DOUBLE AS h FROM part))"""


# --- observations: events of a user are the readings of a station -----------
def observations(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("station_id"), "event_id", F.col("ts").alias("time"), F.to_date("ts").alias("day"),
        F.col("event_type").alias("variable"), "value",
    )


OBSERVATIONS = """observations AS (SELECT user_id AS station_id, event_id, ts AS time, CAST(ts AS DATE) AS day,
  event_type AS variable, value FROM events)"""


def stations(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "events").select("user_id").distinct()
    return s.select(F.col("user_id").alias("station_id"), spread("user_id", 1597, 2375, -79.75).alias("lon"),
                    spread("user_id", 919, 1750, 45.0).alias("lat"))


STATIONS = f"""stations AS (SELECT DISTINCT user_id AS station_id, {sql_spread('user_id', 1597, 2375, -79.75)} AS lon,
  {sql_spread('user_id', 919, 1750, 45.0)} AS lat FROM events)"""


# --- daily weather: three variables per station and day ----------------------
def daily(spark, sf_dir) -> DataFrame:
    """tasmin, tasmax, pr per station and day; a variable without a reading is NULL."""
    o = observations(spark, sf_dir)
    pick = lambda kind, value: F.max(F.when(F.col("variable").isin(*kind), value))
    return o.groupBy("station_id", F.col("day").alias("time")).agg(
        pick(["click", "signup"], F.col("value") / 10.0 - 8.0).alias("tasmin"),
        pick(["view", "error"], F.col("value") / 5.0 + 2.0).alias("tasmax"),
        pick(["purchase"], F.col("value") / 20.0).alias("pr"),
    )


DAILY = OBSERVATIONS + """, daily AS (SELECT station_id, day AS time,
  max(CASE WHEN variable IN ('click', 'signup') THEN value/10.0::DOUBLE - 8.0::DOUBLE END) AS tasmin,
  max(CASE WHEN variable IN ('view', 'error') THEN value/5.0::DOUBLE + 2.0::DOUBLE END) AS tasmax,
  max(CASE WHEN variable='purchase' THEN value/20.0::DOUBLE END) AS pr FROM observations GROUP BY 1, 2)"""


# --- grid: cells i, j over the stations, native units ------------------------
def grid(spark, sf_dir) -> DataFrame:
    """Long grid table: one cell per (user_id % 15, user_id div 15), Kelvin and kg m-2 s-1."""
    o = observations(spark, sf_dir)
    i, j = (F.col("station_id") % 15).cast("int"), (F.col("station_id") / 15).cast("int")
    kinds = F.create_map(*[F.lit(v) for v in ("click", "tasmin", "signup", "tasmin", "view", "tasmax", "error", "tasmax", "purchase", "pr")])
    scaled = F.when(F.col("variable") == "purchase", F.col("value") / 86400.0).otherwise(F.col("value") / 47.0 + 270.0)
    return o.select(
        F.lit("era5_land").alias("dataset"), F.element_at(kinds, F.col("variable")).alias("variable"),
        F.col("day").alias("time"), i.alias("i"), j.alias("j"), (45.0 + i * 0.25).alias("lat"), (-72.0 + j * 0.25).alias("lon"),
        scaled.alias("value"),
    )


GRID = OBSERVATIONS + """, grid AS (SELECT 'era5_land' AS dataset,
  CASE WHEN variable IN ('click', 'signup') THEN 'tasmin' WHEN variable IN ('view', 'error') THEN 'tasmax' ELSE 'pr' END AS variable, day AS time,
  CAST(station_id % 15 AS INTEGER) AS i, CAST(station_id // 15 AS INTEGER) AS j,
  45.0::DOUBLE + (station_id % 15) * 0.25::DOUBLE AS lat, -72.0::DOUBLE + (station_id // 15) * 0.25::DOUBLE AS lon,
  CASE WHEN variable='purchase' THEN value/86400.0::DOUBLE ELSE value/47.0::DOUBLE + 270.0::DOUBLE END AS value
  FROM observations)"""


# --- pixels: one embedding is a pixel, its first entries are bands -----------
BANDS = ["b02", "b03", "b04", "b08", "b11"]


def pixels(spark, sf_dir) -> DataFrame:
    """Pixel rows with five reflectance bands in 0..1 and a class band; 25 columns wide."""
    e = read(spark, sf_dir, "embeddings")
    band = lambda n: F.abs(F.get("embedding", F.lit(n)).cast("double")) + 0.05
    return e.select(
        F.col("vec_id").alias("pixel_id"), F.col("label").alias("label"), (F.col("label") + 2).alias("scl"),
        (F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"),
        (F.lit(-79.75) + (F.col("vec_id") % 25 * 100 % 2375) / 100.0 + 0.003).alias("x"),
        (F.lit(45.0) + ((F.col("vec_id") / 25).cast("int") * 87 % 1750) / 100.0 + 0.003).alias("y"),
        *[band(n).alias(b) for n, b in enumerate(BANDS)],
    )


PIXELS = """pixels AS (SELECT vec_id AS pixel_id, label, label + 2 AS scl, CAST(vec_id // 25 AS INTEGER) AS row,
  CAST(vec_id % 25 AS INTEGER) AS col, -79.75::DOUBLE + ((vec_id % 25) * 100 % 2375) / 100.0::DOUBLE + 0.003::DOUBLE AS x,
  45.0::DOUBLE + ((vec_id // 25) * 87 % 1750) / 100.0::DOUBLE + 0.003::DOUBLE AS y, """ + ", ".join(
    f"abs(embedding[{n + 1}]::DOUBLE) + 0.05::DOUBLE AS {b}" for n, b in enumerate(BANDS)) + " FROM embeddings)"


# --- predictions: line items are image-level predictions of a field ----------
def predictions(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    truth, guess = F.col("l_quantity") / 10.0 + 1.0, F.col("l_extendedprice") / 9973.0 + 1.0
    return li.select(
        F.lit("RandomForest").alias("algo"), F.concat(F.lit("S_"), F.col("l_returnflag")).alias("scenario"),
        F.col("l_suppkey").alias("FIELD_ID"),
        F.concat(F.year("l_shipdate").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("Image_ID"),
        F.log10(truth).alias("y_true_log"), F.log10(guess).alias("y_pred_log"), truth.alias("y_true_lin"), guess.alias("y_pred_lin"),
    )


PREDICTIONS = """predictions AS (SELECT 'RandomForest' AS algo, 'S_' || l_returnflag AS scenario, l_suppkey AS FIELD_ID,
  CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS Image_ID,
  log10(l_quantity/10.0::DOUBLE + 1.0::DOUBLE) AS y_true_log, log10(l_extendedprice/9973.0::DOUBLE + 1.0::DOUBLE) AS y_pred_log,
  l_quantity/10.0::DOUBLE + 1.0::DOUBLE AS y_true_lin, l_extendedprice/9973.0::DOUBLE + 1.0::DOUBLE AS y_pred_lin FROM lineitem)"""


# --- catalogue items: pages, with box, moment, cloud cover -------------------
def items(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "pages"), F.col("page_id")
    out = p.select(
        F.concat(F.lit("item_"), k.cast("string")).alias("id"), F.col("page_id"), "url",
        F.concat(F.lit("set_"), (k % 6).cast("string")).alias("collection"),
        F.timestamp_add("DAY", (k * 37 % 2000).cast("int"), F.lit("2019-01-01").cast("timestamp_ntz")).alias("datetime"),
        (k * 13 % 100).cast("double").alias("cloud"), spread("page_id", 331, 2300, -79.75).alias("minx"),
        spread("page_id", 577, 1700, 45.0).alias("miny"),
    )
    return out.withColumns({"maxx": F.col("minx") + 1.1, "maxy": F.col("miny") + 1.1})


ITEMS = f"""items AS (SELECT *, minx + 1.1::DOUBLE AS maxx, miny + 1.1::DOUBLE AS maxy FROM (SELECT 'item_' || page_id AS id,
  page_id, url, 'set_' || (page_id % 6) AS collection, TIMESTAMP '2019-01-01' + to_days(CAST(page_id * 37 % 2000 AS INTEGER)) AS datetime,
  (page_id * 13 % 100)::DOUBLE AS cloud, {sql_spread('page_id', 331, 2300, -79.75)} AS minx,
  {sql_spread('page_id', 577, 1700, 45.0)} AS miny FROM pages))"""

"""Station and gridded series, indicators and request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.bindings.tables import (
    DAILY, FARMS, GRID, OBSERVATIONS, PARCELS, STATIONS, daily, farms, grid, observations, parcels, query, read, stations,
)
from loamframe.functions import geometry as geo, times, values
from loamframe.operators import climate, ordered, requests as rq, spatial, stations as st
from loamframe.plans import weather
from loamframe.sources import landed


def _day(name: str = "time"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- indicators ---------------------------------------------------------------------
_GDD = "greatest(0.0::DOUBLE, (tasmax + tasmin) / 2 - 5.0::DOUBLE)"


@query(f"WITH {DAILY} SELECT station_id, strftime(time, '%Y-%m-%d') AS time, round(CASE WHEN tasmax + tasmin IS NOT NULL THEN {_GDD} END, 4) AS gdd FROM daily")
def gdd_daily(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return rows.select("station_id", _day(), F.round(climate.gdd_daily(F.col("tasmax"), F.col("tasmin")), 4).alias("gdd"))


@query(f"""WITH {DAILY} SELECT station_id, round(coalesce(sum(CASE WHEN tasmax + tasmin IS NOT NULL THEN {_GDD} END), 0), 4) AS gdd,
count(*) FILTER (tasmin < 0) AS frost_days, count(*) FILTER (tasmax > 30) AS heat_stress_days,
round(coalesce(sum(pr), 0), 4) AS pr_total, count(*) FILTER (pr > 1) AS pr_days FROM daily GROUP BY 1""")
def station_indicators(spark, sf_dir):
    return climate.indicators(daily(spark, sf_dir), ["station_id"])


def _one(name: str, sql: str, function):
    @query(f"WITH {DAILY} SELECT station_id, {sql} AS {name} FROM daily GROUP BY 1", name=name)
    def run(spark, sf_dir):
        return daily(spark, sf_dir).groupBy("station_id").agg(function().alias(name))

    return run


_one("growing_degree_days", f"round(coalesce(sum(CASE WHEN tasmax + tasmin IS NOT NULL THEN {_GDD.replace('5.0', '10.0')} END), 0), 4)",
     lambda: climate.gdd(F.col("tasmax"), F.col("tasmin"), 10.0))
_one("frost_days", "count(*) FILTER (tasmin < 0)", lambda: climate.frost_days(F.col("tasmin")))
_one("heat_stress_days", "count(*) FILTER (tasmax > 50)", lambda: climate.heat_stress_days(F.col("tasmax"), 50.0))
_one("precipitation_total", "round(coalesce(sum(pr), 0), 4)", lambda: climate.pr_total(F.col("pr")))
_one("precipitation_days", "count(*) FILTER (pr > 5)", lambda: climate.pr_days(F.col("pr"), 5.0))


# --- grids --------------------------------------------------------------------------
@query(f"WITH {GRID} SELECT variable, count(*) AS n, round(sum(value), 4) AS total FROM grid WHERE variable IN ('tasmin', 'pr') GROUP BY 1")
def read_grid(spark, sf_dir):
    rows = landed.read_grid(grid(spark, sf_dir), "era5_land", ["tasmin", "pr"])
    return rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {GRID} SELECT i, j, variable, count(*) AS n FROM grid WHERE time BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY ALL")
def time_slice(spark, sf_dir):
    rows = climate.time_slice(grid(spark, sf_dir), F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))
    return rows.groupBy("i", "j", "variable").agg(F.count(F.lit(1)).alias("n"))


_BOX = (-72.0, 45.3, -70.8, 47.1)
_IN = "lon BETWEEN -72.0 AND -70.8 AND lat BETWEEN 45.3 AND 47.1"


@query(f"WITH {GRID} SELECT i, j, variable, count(*) AS n FROM grid WHERE {_IN} GROUP BY ALL")
def grid_subset(spark, sf_dir):
    return climate.grid_subset(grid(spark, sf_dir), _BOX).groupBy("i", "j", "variable").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRID}, p AS (SELECT arg_min(lat, abs(lat - 46.2)) AS plat, arg_min(lon, abs(lon + 71.1)) AS plon FROM grid)
SELECT lat, lon, variable, count(*) AS n, round(sum(value), 4) AS total FROM grid, p WHERE lat = plat AND lon = plon GROUP BY ALL""")
def grid_nearest(spark, sf_dir):
    return climate.grid_nearest(grid(spark, sf_dir), -71.1, 46.2).groupBy("lat", "lon", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {GRID}, g AS (SELECT *, lat + j * 0.05::DOUBLE AS rlat, lon + i * 0.03::DOUBLE AS rlon FROM grid),
r AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM g WHERE rlon BETWEEN -72.0 AND -70.8 AND rlat BETWEEN 45.3 AND 47.1)
SELECT i, j, count(*) AS n FROM g, r WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 GROUP BY ALL""")
def grid_subset_rotated(spark, sf_dir):
    tilted = grid(spark, sf_dir).withColumns({"lat": F.col("lat") + F.col("j") * 0.05, "lon": F.col("lon") + F.col("i") * 0.03})
    return climate.grid_subset_rotated(tilted, _BOX).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRID} SELECT i, j, count(*) AS n FROM grid WHERE lat >= 45.1 AND lat < 45.1 + (lon + 72.1) * 1.0 AND lon < -70.3 AND lon >= -72.1 GROUP BY ALL""")
def grid_clip(spark, sf_dir):
    # triangle (-72.1, 45.1) (-70.3, 45.1) (-70.3, 46.9)
    corner = lambda *v: F.array(*[F.lit(x) for x in v])
    triangle = geo.polygon(corner(-72.1, -70.3, -70.3, -72.1), corner(45.1, 45.1, 46.9, 45.1))
    return climate.grid_clip(grid(spark, sf_dir), triangle).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRID} SELECT variable, i, j, strftime(last_day(time), '%Y-%m-%d') AS time, round(avg(value), 6) AS value FROM grid GROUP BY ALL""")
def monthly_mean(spark, sf_dir):
    means = climate.monthly_mean(grid(spark, sf_dir), ["variable", "i", "j"])
    return means.select("variable", "i", "j", _day(), F.round("value", 6).alias("value"))


@query(f"""WITH {GRID}, m AS (SELECT last_day(CAST(d AS DATE)) AS time FROM generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH) t(d)),
k AS (SELECT DISTINCT variable, i, j FROM grid), a AS (SELECT variable, i, j, last_day(time) AS time, avg(value) AS value FROM grid GROUP BY ALL)
SELECT k.variable, k.i, k.j, strftime(m.time, '%Y-%m-%d') AS time, round(a.value, 6) AS value FROM k CROSS JOIN m LEFT JOIN a
ON a.variable = k.variable AND a.i = k.i AND a.j = k.j AND a.time = m.time""")
def monthly_mean_with_gaps(spark, sf_dir):
    means = climate.monthly_mean(grid(spark, sf_dir), ["variable", "i", "j"], "2023-11-15", "2024-03-10")
    return means.select("variable", "i", "j", _day(), F.round("value", 6).alias("value"))


@query(f"WITH {GRID} SELECT variable, strftime(time, '%Y-%m-%d') AS time, round(avg(value), 6) AS value FROM grid GROUP BY ALL")
def spatial_mean(spark, sf_dir):
    return climate.spatial_mean(grid(spark, sf_dir), ["variable"]).select("variable", _day(), F.round("value", 6).alias("value"))


@query(f"""WITH {GRID} SELECT variable, i, j, count(*) AS n, round(sum(round(CASE WHEN variable = 'pr' THEN value * 86400.0::DOUBLE + 0.0::DOUBLE
ELSE value * 1.0::DOUBLE + -273.15::DOUBLE END, 4)), 3) AS total FROM grid GROUP BY ALL""")
def convert_units(spark, sf_dir):
    named = grid(spark, sf_dir).join(F.broadcast(landed.grid_registry(spark)), ["dataset", "variable"])
    converted = named.withColumn("value", values.convert_units(F.col("value"), F.col("scale"), F.col("offset")))
    return converted.groupBy("variable", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


# --- requests -----------------------------------------------------------------------
def location_requests(spark, sf_dir):
    """One request per customer: point, box, polygon and farm ones in turn, some of them bad."""
    k = F.col("gid")
    kind = F.element_at(F.array(*[F.lit(v) for v in ("point", "bbox", "polygon", "farm_id", "circle")]), (k % 5 + 1).cast("int"))
    f = farms(spark, sf_dir)
    base = f.select(
        k.alias("request_id"), kind.alias("location_type"),
        F.when(k % 5 == 3, F.when(k % 10 == 3, (k % 150).cast("string")).otherwise(F.lit("-4"))).alias("farm_id"),
        F.when(k % 5 == 0, F.when(k % 20 == 0, F.col("x") - 150).otherwise(F.col("x"))).alias("lon"),
        F.when((k % 5 == 0) & (k % 30 != 0), F.col("y")).alias("lat"),
        F.when(k % 5 == 1, F.col("x")).alias("minx"), F.when(k % 5 == 1, F.col("y")).alias("miny"),
        F.when(k % 5 == 1, F.col("x") + F.when(k % 4 == 1, F.lit(-0.5)).otherwise(F.lit(0.5))).alias("maxx"),
        F.when(k % 5 == 1, F.col("y") + 0.5).alias("maxy"),
        F.when((k % 5 == 2) & (k % 2 == 0), geo.rectangle(F.col("x"), F.col("y"), F.col("x") + 0.4, F.col("y") + 0.4)).alias("polygon"),
    )
    return base


def _farm_shapes(spark, sf_dir):
    return parcels(spark, sf_dir).select(F.col("gid").alias("farm_id"), "geom")


_REASONS = f"""WITH {FARMS}, {PARCELS}, r AS (SELECT gid, x, y, gid % 5 AS k,
CASE WHEN gid % 5 = 4 THEN 'unknown location type' WHEN gid % 5 = 3 THEN CASE WHEN gid % 10 = 3 AND gid % 150 > 0 THEN '' ELSE 'farm_id not a positive number' END
WHEN gid % 5 = 2 THEN CASE WHEN gid % 2 = 0 THEN '' ELSE 'polygon missing' END WHEN gid % 5 = 1 THEN CASE WHEN gid % 4 = 1 THEN 'minx must be below maxx' ELSE '' END
ELSE concat_ws(';', CASE WHEN gid % 30 = 0 THEN 'point missing' END, CASE WHEN gid % 20 = 0 AND x - 150 < -180 THEN 'longitude out of range' END) END AS reasons FROM farms)"""


@query(f"{_REASONS} SELECT gid AS request_id, reasons FROM r")
def validate_coords(spark, sf_dir):
    return rq.validate_coords(location_requests(spark, sf_dir)).select("request_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"""{_REASONS}, v AS (SELECT r.*, p.minx AS pminx, p.miny AS pminy, p.maxx AS pmaxx, p.maxy AS pmaxy FROM r LEFT JOIN parcels p
ON r.k = 3 AND p.gid = r.gid % 150 WHERE reasons = '') SELECT gid AS request_id,
CASE k WHEN 0 THEN CASE WHEN gid % 20 = 0 THEN x - 150 ELSE x END WHEN 3 THEN pminx ELSE x END AS minx, CASE k WHEN 3 THEN pminy ELSE y END AS miny,
CASE k WHEN 0 THEN CASE WHEN gid % 20 = 0 THEN x - 150 ELSE x END WHEN 1 THEN x + 0.5::DOUBLE WHEN 2 THEN x + 0.4::DOUBLE ELSE pmaxx END AS maxx,
CASE k WHEN 0 THEN y WHEN 1 THEN y + 0.5::DOUBLE WHEN 2 THEN y + 0.4::DOUBLE ELSE pmaxy END AS maxy FROM v WHERE k <> 3 OR pminx IS NOT NULL""")
def resolve_locations(spark, sf_dir):
    resolved, _ = rq.resolve_locations(location_requests(spark, sf_dir), _farm_shapes(spark, sf_dir))
    return resolved.select("request_id", "minx", "miny", "maxx", "maxy")


@query(f"""WITH {PARCELS}, b AS (SELECT *, maxx - minx >= 0.7 AND maxy - miny >= 0.7 AS ok FROM parcels) SELECT gid,
round(CASE WHEN ok THEN minx ELSE (minx + maxx) / 2 - 0.35::DOUBLE END, 6) AS minx, round(CASE WHEN ok THEN maxy ELSE (miny + maxy) / 2 + 0.35::DOUBLE END, 6) AS maxy FROM b""")
def min_bbox(spark, sf_dir):
    return rq.min_bbox(parcels(spark, sf_dir), 0.7).select("gid", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


@query(f"""WITH {PARCELS}, a AS (SELECT gid, (maxx - minx) * 111.32::DOUBLE * cos(radians((miny + maxy) / 2)) * (maxy - miny) * 111.32::DOUBLE AS km2 FROM parcels)
SELECT gid, round(km2, 5) AS area_km2 FROM a WHERE km2 <= 2500""")
def area_guard(spark, sf_dir):
    return rq.area_guard(parcels(spark, sf_dir), 2500)[0].select("gid", F.round("area_km2", 5).alias("area_km2"))


@query("""SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 3 < 2 AND CAST(o_orderdate AS DATE) + 30 <= CASE WHEN o_orderkey % 3 = 0
THEN DATE '2001-01-01' - 90 ELSE DATE '1999-12-31' END AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'""")
def effective_range(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.element_at(F.array(F.lit("rolling"), F.lit("fixed"), F.lit("none")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    asked = o.select(F.col("o_orderkey").alias("request_id"), name.alias("dataset"), F.to_date("o_orderdate").alias("start_date"),
                     F.date_add(F.to_date("o_orderdate"), 30).alias("end_date"))
    datasets = spark.createDataFrame([("rolling", True, 90, None), ("fixed", False, None, "1999-12-31")],
                                     "dataset string, rolling boolean, lag_days int, end string").select(
        "dataset", "rolling", "lag_days", F.lit("1996-01-01").cast("date").alias("valid_start"), F.col("end").cast("date").alias("valid_end"))
    return rq.effective_range(asked, datasets, F.lit("2001-01-01").cast("date"))[0].select("request_id")


@query("""SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 6 = 0 THEN 'start_date is no ISO date' END,
CASE WHEN o_orderkey % 6 = 1 THEN 'start_date after end_date' END, CASE WHEN o_orderkey % 6 = 2 THEN 'unknown indicator' END,
CASE WHEN o_orderkey % 6 = 3 THEN 'scenario required' END, CASE WHEN o_orderkey % 6 = 3 THEN 'model required' END,
CASE WHEN o_orderkey % 6 = 4 THEN 'base_temp out of range' END, CASE WHEN o_orderkey % 60 = 5 THEN 'threshold out of range' END) AS reasons FROM orders""")
def validate_requests(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    r = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 6 == 0, F.lit("June")).when(k % 6 == 1, F.lit("2030-01-01")).otherwise(d).alias("start_date"),
        F.lit("2002-01-01").alias("end_date"), F.when(k % 6 == 2, F.lit("sunshine")).otherwise(F.lit("gdd")).alias("indicator"),
        F.when(k % 6 == 3, F.lit("cmip6_espo_g6_r2")).otherwise(F.lit("era5_land")).alias("dataset"), F.lit(None).cast("string").alias("scenario"),
        F.lit(None).cast("string").alias("model"), F.when(k % 6 == 4, F.lit(16.0)).otherwise(F.lit(5.0)).alias("base_temp"),
        F.when(k % 60 == 5, F.lit(51.0)).otherwise(F.lit(30.0)).alias("threshold"))
    return rq.validate_requests(r).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n, max(concat_ws(';', CASE WHEN l_extendedprice > 100000 THEN 'max_distance_m out of range' END,
CASE WHEN l_quantity * 15 > 500 THEN 'tolerance_m out of range' END, CASE WHEN l_discount > 1 THEN 'min_described_pct out of range' END)) AS reasons FROM lineitem GROUP BY 1, 2, 3""")
def validate_limits(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("max_distance_m"), (F.col("l_quantity") * 15).alias("tolerance_m"),
        (F.col("l_discount") * 100).alias("min_described_pct"))
    return rq.validate_limits(li).groupBy("l_orderkey", "l_linenumber", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_join("reasons", ";")).alias("reasons"))


@query("""SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 1 THEN 'unknown variable' WHEN 2 THEN 'unknown dataset' END AS reason,
CASE o_orderkey % 4 WHEN 1 THEN 'snow' WHEN 2 THEN 'tasmin' END AS variable FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def rejected_grid_requests(spark, sf_dir):
    return _grid_requests(spark, sf_dir)[1].select("request_id", "reason", "variable")


@query("""SELECT o_orderkey AS request_id, 'tasmin' AS variable, 0 AS variable_order, -273.15::DOUBLE AS offset_value FROM orders WHERE o_orderkey % 4 <> 2
UNION ALL SELECT o_orderkey, 'pr', 1, 0.0::DOUBLE FROM orders WHERE o_orderkey % 4 IN (0, 3)""")
def accepted_grid_requests(spark, sf_dir):
    return _grid_requests(spark, sf_dir)[0].select("request_id", "variable", "variable_order", F.col("offset").alias("offset_value"))


def _grid_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    words = lambda *v: F.array(*[F.lit(x) for x in v])
    asked = read(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.when(k % 4 == 2, F.lit("nowhere")).otherwise(F.lit("era5_land")).alias("dataset"),
        F.when(k % 4 == 1, words("tasmin", "snow")).when(k % 4 == 2, words("tasmin")).otherwise(words("tasmin", "pr", "tasmin")).alias("variables"))
    return landed.grid_requests(asked, landed.grid_registry(spark))


# --- stations -----------------------------------------------------------------------
@query(f"WITH {OBSERVATIONS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(day, '%Y-%m-%d') || ' 00' ELSE strftime(day, '%Y-%m-%d') END AS time FROM observations")
def station_time(spark, sf_dir):
    o = observations(spark, sf_dir)
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("swob-realtime")).otherwise(F.lit("climate-daily"))
    return o.select("event_id", times.station_time(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 00")), kind).alias("time"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T00:00:00Z' ELSE '' END AS "start",
strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T23:59:59Z' ELSE '' END AS "end" FROM orders""")
def interval_bounds(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.lit("swob-realtime")).otherwise(F.lit("climate-daily"))
    return read(spark, sf_dir, "orders").select("o_orderkey", times.interval_bounds(kind, d, d).alias("i")).select("o_orderkey", "i.*")


@query(f"""WITH {OBSERVATIONS}, {STATIONS} SELECT station_id, event_id FROM observations JOIN stations USING (station_id)
WHERE lon BETWEEN -75 AND -60 AND lat BETWEEN 46 AND 60 AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY station_id, time LIMIT 1500""")
def read_station_items(spark, sf_dir):
    located = observations(spark, sf_dir).join(stations(spark, sf_dir), "station_id")
    moment = lambda d: F.lit(d).cast("timestamp_ntz")
    hits = landed.read_station_items(located, (-75, 46, -60, 60), moment("2024-01-05"), moment("2024-01-25"), limit=1500)
    return hits.select("station_id", "event_id")


@query(f"""WITH {OBSERVATIONS}, s AS (SELECT DISTINCT station_id FROM observations ORDER BY 1 LIMIT 40), r AS (SELECT station_id,
CAST(floor((row_number() OVER (PARTITION BY station_id ORDER BY time, event_id) - 1) / 25) AS INTEGER) AS chunk,
row_number() OVER (PARTITION BY station_id ORDER BY time, event_id) - 1 AS p, round(value, 4) AS value FROM observations JOIN s USING (station_id))
SELECT station_id, chunk, CAST(count(*) AS INTEGER) AS n, round(sum(value * (p % 25)), 3) AS weighted, arg_min(value, p) AS first_value FROM r GROUP BY 1, 2""")
def station_series(spark, sf_dir):
    o = observations(spark, sf_dir).drop("variable")
    packed = st.station_series(o, "station_id", "time", ["value"], "swob-realtime", limit=40, chunk_rows=25)
    weighted = F.aggregate(F.transform("value", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return packed.select("station_id", "chunk", F.size("value").alias("n"), F.round(weighted, 3).alias("weighted"),
                         F.get("value", F.lit(0)).alias("first_value"))


@query(f"""WITH {OBSERVATIONS} SELECT station_id, event_id, row_number() OVER (PARTITION BY station_id ORDER BY time, event_id) AS position FROM observations""")
def ordered_series(spark, sf_dir):
    o = observations(spark, sf_dir).select("station_id", "event_id", "time")
    return ordered.number_rows(o, ["station_id"], [F.col("time"), F.col("event_id")]).select("station_id", "event_id", "position")


@query(f"""WITH {OBSERVATIONS} SELECT station_id, arg_min(variable, time) AS variable, arg_min(event_id, time) AS event_id FROM observations GROUP BY 1""")
def station_metadata(spark, sf_dir):
    return st.station_metadata(observations(spark, sf_dir), "station_id", "time", ["variable", "event_id"])


@query(f"""WITH {OBSERVATIONS}, {STATIONS}, {PARCELS}, t AS (SELECT station_id, sum(value) AS total, count(value) AS n_values FROM observations WHERE variable = 'purchase'
AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1), c AS (SELECT p.gid, s.station_id, total, n_values,
sqrt((lon - (minx + maxx) / 2) * (lon - (minx + maxx) / 2) + (lat - (miny + maxy) / 2) * (lat - (miny + maxy) / 2)) AS d FROM parcels p, stations s JOIN t USING (station_id))
SELECT parcels.gid, station_id, round(total, 4) AS total, n_values FROM parcels LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(d, 9), station_id) AS rn FROM c) b ON b.gid = parcels.gid AND rn = 1""")
def nearest_with_data(spark, sf_dir):
    o = observations(spark, sf_dir).filter(
        (F.col("variable") == "purchase") & F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")))
    at = parcels(spark, sf_dir).select("gid", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    best = spatial.nearest_with_data(at, o, stations(spark, sf_dir), "gid", "station_id", "value")
    return best.select("gid", "station_id", F.round("total", 4).alias("total"), "n_values")


# --- jobs ---------------------------------------------------------------------------
def _requests(spark, sf_dir):
    """Box, point and polygon requests over the grid, one per supplier."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(F.lit("bbox"), F.lit("point"), F.lit("polygon")), (k % 3 + 1).cast("int"))
    x, y = -72.0 + (k % 10) * 0.2, 45.0 + (k % 12) * 0.3
    words = lambda *v: F.array(*[F.lit(w) for w in v])
    return read(spark, sf_dir, "supplier").select(
        k.alias("request_id"), F.lit("era5_land").alias("dataset"), F.when(k % 2 == 0, words("tasmin", "pr")).otherwise(words("tasmax")).alias("variables"),
        kind.alias("location_type"), F.lit(None).cast("string").alias("farm_id"), x.alias("lon"), y.alias("lat"),
        F.when(k % 3 == 0, x).alias("minx"), F.when(k % 3 == 0, y).alias("miny"), F.when(k % 3 == 0, x + 0.6).alias("maxx"), F.when(k % 3 == 0, y + 0.6).alias("maxy"),
        F.when(k % 3 == 2, geo.rectangle(x, y, x + 0.6, y + 0.6)).alias("polygon"),
        F.lit("2024-01-03").alias("start_date"), F.lit("2024-01-20").alias("end_date"),
        F.element_at(words("gdd", "frost_days", "heat_stress_days", "pr_total", "pr_days"), (k % 5 + 1).cast("int")).alias("indicator"),
        F.lit(4.0).alias("base_temp"), F.lit(5.0).alias("threshold"), F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("model"),
    )


_CELLS = """cells AS (SELECT DISTINCT i, j, lat, lon FROM grid), req AS (SELECT s_suppkey AS request_id, s_suppkey % 3 AS kind, s_suppkey AS k,
-72.0::DOUBLE + (s_suppkey % 10) * 0.2::DOUBLE AS x, 45.0::DOUBLE + (s_suppkey % 12) * 0.3::DOUBLE AS y FROM supplier),
near AS (SELECT request_id, arg_min(lat, (abs(lat - y), lat)) AS lat, arg_min(lon, (abs(lon - x), lon)) AS lon FROM req, cells WHERE kind = 1 GROUP BY 1),
cover AS (SELECT request_id, i, j FROM req, cells WHERE (kind = 0 AND lon BETWEEN x AND x + 0.6::DOUBLE AND lat BETWEEN y AND y + 0.6::DOUBLE)
OR (kind = 2 AND lon >= x AND lon < x + 0.6::DOUBLE AND lat >= y AND lat < y + 0.6::DOUBLE)
UNION ALL SELECT request_id, i, j FROM near JOIN cells USING (lat, lon)),
conv AS (SELECT *, CASE WHEN variable = 'pr' THEN 86400.0::DOUBLE ELSE 1.0::DOUBLE END AS scale, CASE WHEN variable = 'pr' THEN 0.0::DOUBLE ELSE -273.15::DOUBLE END AS off FROM grid
WHERE time BETWEEN DATE '2024-01-03' AND DATE '2024-01-20')"""


def _datasets(spark):
    return spark.createDataFrame([("era5_land", True, 90)], "dataset string, rolling boolean, lag_days int").select(
        "*", F.lit("1950-01-01").cast("date").alias("valid_start"), F.lit(None).cast("date").alias("valid_end"))


_WANTED = "((k % 2 = 0 AND variable IN ('tasmin', 'pr')) OR (k % 2 = 1 AND variable = 'tasmax'))"


@query(f"""WITH {GRID}, {_CELLS} SELECT request_id, variable, strftime(time, '%Y-%m-%d') AS time, round(avg(value) * any_value(scale) + any_value(off), 4) AS value
FROM conv JOIN cover USING (i, j) JOIN req USING (request_id) WHERE {_WANTED} GROUP BY request_id, variable, conv.time""")
def weather_timeseries(spark, sf_dir):
    series = weather.weather_timeseries(_requests(spark, sf_dir), grid(spark, sf_dir), landed.grid_registry(spark),
                                        _farm_shapes(spark, sf_dir), _datasets(spark), F.lit("2025-06-01").cast("date"))
    return series.select("request_id", "variable", _day(), "value")


@query(f"""WITH {GRID}, {_CELLS}, m AS (SELECT request_id, variable, i, j, last_day(time) AS time, avg(value) AS value, any_value(scale) AS scale, any_value(off) AS off
FROM conv JOIN cover USING (i, j) JOIN req USING (request_id) WHERE {_WANTED} GROUP BY request_id, variable, i, j, last_day(time))
SELECT request_id, variable, strftime(time, '%Y-%m-%d') AS time, round(avg(value) * any_value(scale) + any_value(off), 4) AS value FROM m GROUP BY request_id, variable, m.time""")
def weather_monthly(spark, sf_dir):
    series = weather.weather_timeseries(_requests(spark, sf_dir), grid(spark, sf_dir), landed.grid_registry(spark),
                                        _farm_shapes(spark, sf_dir), _datasets(spark), F.lit("2025-06-01").cast("date"), "monthly")
    return series.select("request_id", "variable", _day(), "value")


def _projections(spark, sf_dir):
    scenarios = F.explode(F.array(F.lit("ssp245"), F.lit("ssp585")))
    shift = F.when(F.col("scenario") == "ssp585", F.lit(2.0)).otherwise(F.lit(1.0))
    g = grid(spark, sf_dir).withColumns({"dataset": F.lit("cmip6_espo_g6_r2"), "model": F.lit("TaiESM1")}).withColumn("scenario", scenarios)
    return g.withColumn("value", F.when(F.col("variable") == "pr", F.col("value")).otherwise(F.col("value") + shift))


def _models(spark):
    return spark.createDataFrame([("cmip6_espo_g6_r2", "TaiESM1", ["ssp245", "ssp370", "ssp585"]), ("cmip6_espo_g6_r2", "NESM3", ["ssp245", "ssp585"])],
                                 "dataset string, model string, scenarios array<string>")


@query(f"""WITH {GRID}, {_CELLS} SELECT request_id, variable, strftime(time, '%Y-%m-%d') AS time,
round((avg(value) + CASE WHEN variable = 'pr' THEN 0.0::DOUBLE WHEN k % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * any_value(scale) + any_value(off), 4) AS value
FROM conv JOIN cover USING (i, j) JOIN req USING (request_id) WHERE {_WANTED} AND k % 4 <> 3 GROUP BY request_id, k, variable, conv.time""")
def climate_timeseries(spark, sf_dir):
    k = F.col("request_id")
    asked = _requests(spark, sf_dir).withColumns({
        "dataset": F.lit("cmip6_espo_g6_r2"), "model": F.when(k % 4 == 3, F.lit("NESM3")).otherwise(F.lit("TaiESM1")),
        "scenario": F.when(k % 4 == 3, F.lit("ssp370")).when(k % 2 == 0, F.lit("ssp585")).otherwise(F.lit("ssp245"))})
    series = weather.climate_timeseries(asked, _projections(spark, sf_dir), landed.grid_registry(spark), _models(spark), _farm_shapes(spark, sf_dir))
    return series.select("request_id", "variable", _day(), "value")


@query(f"""WITH {GRID}, {_CELLS}, d AS (SELECT request_id, k, time, max(v) FILTER (variable = 'tasmin') AS tasmin, max(v) FILTER (variable = 'tasmax') AS tasmax,
max(v) FILTER (variable = 'pr') AS pr FROM (SELECT request_id, k, variable, time, round(avg(value) * any_value(scale) + any_value(off), 4) AS v FROM conv JOIN cover USING (i, j)
JOIN req USING (request_id) GROUP BY request_id, k, variable, conv.time) GROUP BY 1, 2, 3)
SELECT request_id, (['gdd','frost_days','heat_stress_days','pr_total','pr_days'])[1 + k % 5] AS indicator, round(CASE k % 5
WHEN 0 THEN coalesce(sum(CASE WHEN tasmax + tasmin IS NOT NULL THEN greatest(0.0::DOUBLE, (tasmax + tasmin) / 2 - 4.0::DOUBLE) END), 0)
WHEN 1 THEN count(*) FILTER (tasmin < 0) WHEN 2 THEN count(*) FILTER (tasmax > 5) WHEN 3 THEN coalesce(sum(pr), 0) ELSE count(*) FILTER (pr > 5) END, 1) AS value
FROM d WHERE CASE k % 5 WHEN 0 THEN tasmin IS NOT NULL OR tasmax IS NOT NULL WHEN 1 THEN tasmin IS NOT NULL WHEN 2 THEN tasmax IS NOT NULL ELSE pr IS NOT NULL END GROUP BY request_id, k""")
def climate_indicators(spark, sf_dir):
    found = weather.climate_indicators(_requests(spark, sf_dir), grid(spark, sf_dir), landed.grid_registry(spark), _farm_shapes(spark, sf_dir))
    # days are rounded means: a tie rounded either way moves a total in its second decimal
    return found.select("request_id", "indicator", F.round("value", 1).alias("value"))


def _station_requests(spark, sf_dir):
    k = F.col("gid")
    words = lambda *v: F.array(*[F.lit(w) for w in v])
    p = parcels(spark, sf_dir)
    return p.select(
        k.alias("request_id"), F.lit("bbox").alias("location_type"), F.lit(None).cast("string").alias("farm_id"), F.lit(None).cast("double").alias("lon"),
        F.lit(None).cast("double").alias("lat"), "minx", "miny", "maxx", "maxy", F.lit(None).cast(geo.GEOM_TYPE).alias("polygon"),
        F.when(k % 2 == 0, F.lit("swob-realtime")).otherwise(F.lit("climate-daily")).alias("collection"),
        F.when(k % 7 == 6, words("humidity")).otherwise(words("click", "view", "click")).alias("variables"),
        F.lit("2024-01-03").alias("start_date"), F.lit("2024-01-20").alias("end_date"))


def _station_tables(spark, sf_dir):
    """Requests, items, collections and farm shapes of the station queries."""
    items = observations(spark, sf_dir).join(stations(spark, sf_dir), "station_id").withColumn(
        "collection", F.explode(F.array(F.lit("swob-realtime"), F.lit("climate-daily"))))
    words = lambda *v: F.array(*[F.lit(w) for w in v])
    known = spark.range(1).select(F.explode(words("swob-realtime", "climate-daily")).alias("collection"), words("click", "view", "purchase").alias("variables"))
    return _station_requests(spark, sf_dir), items, known, _farm_shapes(spark, sf_dir)


def station_request_hits(spark, sf_dir):
    return weather.station_observations(*_station_tables(spark, sf_dir))


_HITS = f"""{OBSERVATIONS}, {STATIONS}, {PARCELS}, b AS (SELECT gid AS request_id, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM parcels WHERE gid % 7 <> 6),
hits AS (SELECT request_id, station_id, variable, time, round(value, 4) AS value, CASE WHEN request_id % 2 = 0 THEN 'swob-realtime' ELSE 'climate-daily' END AS collection
FROM b JOIN stations ON lon BETWEEN cx - 0.5 AND cx + 0.5 AND lat BETWEEN cy - 0.5 AND cy + 0.5 JOIN observations USING (station_id)
WHERE variable IN ('click', 'view') AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20')"""


@query(f"WITH {_HITS} SELECT request_id, station_id, collection, variable, count(*) AS n, round(sum(value), 3) AS total FROM hits GROUP BY ALL")
def station_observations(spark, sf_dir):
    return station_request_hits(spark, sf_dir).groupBy("request_id", "station_id", "collection", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {_HITS} SELECT request_id || ':' || station_id AS site, CAST(count(DISTINCT time) AS INTEGER) AS n FROM hits WHERE collection = 'swob-realtime' GROUP BY 1""")
def station_arrays(spark, sf_dir):
    packed = weather.station_request_arrays(*_station_tables(spark, sf_dir), ["click", "view"], "swob-realtime")
    return packed.select("site", F.size("time").alias("n"))

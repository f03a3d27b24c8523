"""Soil components, shares, horizons, crops, land use."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamframe.bindings.tables import PARCELS, SOILS, parcels, query, read, soils
from loamframe.operators import overlay, soil
from loamframe.plans import parcels as pp

# line items are the components of an order's soil polygon, parts their soils
_COMPONENTS = """components AS (SELECT CAST(l_orderkey AS VARCHAR) AS code_polygone, CAST(l_partkey AS VARCHAR) AS composante, l_quantity AS pourcentage FROM lineitem),
hydro AS (SELECT CAST(p_partkey AS VARCHAR) AS composante, 'S' || (p_partkey % 300) AS code_sol, (['A','B','C','NA','A/D'])[1 + p_size % 5] AS groupe_hydrologique FROM part)"""


def _components(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("code_polygone"), F.col("l_partkey").cast("string").alias("composante"), F.col("l_quantity").alias("pourcentage"))


def _hydro(spark, sf_dir):
    groups = F.array(*[F.lit(g) for g in ("A", "B", "C", "NA", "A/D")])
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("composante"), F.concat(F.lit("S"), (F.col("p_partkey") % 300).cast("string")).alias("code_sol"),
        F.element_at(groups, F.col("p_size") % 5 + 1).alias("groupe_hydrologique"))


@query(f"""WITH {_COMPONENTS} SELECT code_polygone, composante, pourcentage, code_sol, groupe_hydrologique, count(*) AS n FROM components LEFT JOIN hydro USING (composante)
WHERE code_polygone IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def components_with_hydro(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("code_polygone"))
    rows = soil.components_with_hydro(_components(spark, sf_dir), _hydro(spark, sf_dir), wanted)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


# each order covers a share of its customer's parcel
_FRACTIONS = "fractions AS (SELECT o_custkey AS gid, CAST(o_orderkey AS VARCHAR) AS code_polygone, (o_orderkey % 97) / 997.0::DOUBLE AS fraction FROM orders)"


def _fractions(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("gid"), F.col("o_orderkey").cast("string").alias("code_polygone"), ((F.col("o_orderkey") % 97) / F.lit(997.0)).alias("fraction"))


def _shares(spark, sf_dir):
    described = soil.components_with_hydro(_components(spark, sf_dir), _hydro(spark, sf_dir))
    return soil.component_shares(_fractions(spark, sf_dir), described, "gid", keep=["groupe_hydrologique"])


_SHARES = f"{_COMPONENTS}, {_FRACTIONS}, shares AS (SELECT gid, composante, sum(fraction * pourcentage) AS share_pct, min(groupe_hydrologique) AS groupe_hydrologique FROM fractions JOIN components USING (code_polygone) LEFT JOIN hydro USING (composante) GROUP BY 1, 2)"


@query(f"WITH {_SHARES} SELECT gid, composante, round(share_pct, 6) AS share_pct, groupe_hydrologique FROM shares")
def component_shares(spark, sf_dir):
    return _shares(spark, sf_dir).withColumn("share_pct", F.round("share_pct", 6))


@query(f"WITH {_SHARES} SELECT gid, round(sum(round(share_pct, 2)), 2) AS described_pct FROM (SELECT gid, round(share_pct, 9) AS share_pct FROM shares) GROUP BY 1")
def described_percent(spark, sf_dir):
    return soil.described_pct(_shares(spark, sf_dir).withColumn("share_pct", F.round("share_pct", 9)), "gid")


@query(f"""WITH {_SHARES}, t AS (SELECT gid, groupe_hydrologique AS g, round(sum(share_pct), 9) AS t FROM shares WHERE groupe_hydrologique <> 'NA' GROUP BY 1, 2)
SELECT gid, g AS dominant_group FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY t DESC, g) AS rn FROM t) WHERE rn = 1""")
def dominant_group(spark, sf_dir):
    return soil.dominant_group(_shares(spark, sf_dir), "gid")


# horizons: the distinct line items of an order, depth by line number
_HORIZONS = """p AS (SELECT DISTINCT l_orderkey AS code_sol, CAST(l_partkey AS VARCHAR) AS horizon, CASE WHEN l_linenumber < 7 THEN l_linenumber * 15.5::DOUBLE END AS depth_bottom_cm,
l_quantity / 10.0::DOUBLE AS g_cm3 FROM lineitem WHERE l_orderkey % 3 <> 0), f AS (SELECT DISTINCT l_orderkey AS code_sol, CAST(l_suppkey AS VARCHAR) AS horizon, l_quantity / 20.0::DOUBLE AS g_cm3 FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 = 0),
u AS (SELECT code_sol, horizon, depth_bottom_cm, g_cm3, 'eessaq' AS source FROM p UNION ALL SELECT code_sol, horizon, NULL, g_cm3, 'inventaire_1990' FROM f WHERE code_sol NOT IN (SELECT code_sol FROM p)),
o AS (SELECT *, lag(depth_bottom_cm) OVER w AS above, row_number() OVER w AS rn FROM u WINDOW w AS (PARTITION BY code_sol ORDER BY depth_bottom_cm NULLS LAST, horizon, g_cm3))"""


def _horizon_rows(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    first = li.filter("l_orderkey % 3 <> 0").select(
        F.col("l_orderkey").alias("code_sol"), F.col("l_partkey").cast("string").alias("horizon"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 15.5).alias("depth_bottom_cm"), (F.col("l_quantity") / 10.0).alias("g_cm3")).distinct()
    second = li.filter("l_orderkey % 2 = 0 OR l_orderkey % 3 = 0").select(
        F.col("l_orderkey").alias("code_sol"), F.col("l_suppkey").cast("string").alias("horizon"), (F.col("l_quantity") / 20.0).alias("g_cm3")).distinct()
    return soil.horizon_rows(first, second)


@query(f"""WITH {_HORIZONS} SELECT code_sol, source, horizon, round(CASE WHEN source = 'eessaq' THEN CASE WHEN rn = 1 THEN 0 ELSE above END END, 2) AS depth_top_cm,
round(depth_bottom_cm, 2) AS depth_bottom_cm, round(g_cm3, 3) AS g_cm3, count(*) AS n FROM o GROUP BY ALL""")
def horizon_rows(spark, sf_dir):
    rows = _horizon_rows(spark, sf_dir)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_HORIZONS} SELECT code_sol, source, 0 AS chunk, CAST(count(*) AS INTEGER) AS n, string_agg(horizon, ',' ORDER BY rn) AS horizons FROM o GROUP BY 1, 2""")
def horizon_profile(spark, sf_dir):
    return soil.horizon_profile(_horizon_rows(spark, sf_dir)).select(
        "code_sol", "source", "chunk", F.size("horizon").alias("n"), F.array_join("horizon", ",").alias("horizons"))


@query("SELECT p_partkey, CASE p_size + 120 WHEN 122 THEN 'FOI' WHEN 141 THEN 'FOI' WHEN 132 THEN 'MUL' WHEN 134 THEN 'MUL' WHEN 133 THEN 'ORG' WHEN 136 THEN 'AVO' WHEN 137 THEN 'SEI' WHEN 138 THEN 'BPA' "
       "WHEN 139 THEN 'BPA' WHEN 140 THEN 'BPA' WHEN 145 THEN 'BPA' WHEN 146 THEN 'BPA' WHEN 147 THEN 'MGR' WHEN 150 THEN 'CNL' WHEN 153 THEN 'CNL' WHEN 158 THEN 'SOY' WHEN 160 THEN 'PRT' WHEN 161 THEN 'PRT' "
       "WHEN 162 THEN 'PRT' WHEN 163 THEN 'PRT' WHEN 167 THEN 'LDT' WHEN 168 THEN 'PRT' ELSE 'AUT' END AS crop_group FROM part")
def code_lookup(spark, sf_dir):
    return soil.code_lookup(read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 120).alias("code")), "code").select("p_partkey", "crop_group")


_USE = "u AS (SELECT o_custkey AS parcel, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderpriority END AS land_use FROM orders WHERE o_orderkey % 5 <> 0)"


def _land_use(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("parcel"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("datetime"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("land_use"))
    return soil.land_use_rows(o, "parcel", "datetime", "land_use")


@query(f"WITH {_USE} SELECT parcel, year, land_use, count(*) AS n FROM u GROUP BY ALL")
def land_use_rows(spark, sf_dir):
    return _land_use(spark, sf_dir).groupBy("parcel", "year", "land_use").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_USE} SELECT parcel, 0 AS chunk, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year, land_use) AS years, string_agg(land_use, ',' ORDER BY year, land_use) AS uses FROM u GROUP BY 1")
def land_use_history(spark, sf_dir):
    return soil.land_use_history(_land_use(spark, sf_dir), "parcel").select(
        "parcel", "chunk", F.array_join(F.transform("year", lambda y: y.cast("string")), ",").alias("years"), F.array_join("land_use", ",").alias("uses"))


# --- shares by overlay -------------------------------------------------------------
# on the ellipsoid, as the operator does: sine of the authalic latitude of a degree value
def _sin_beta(lat: str) -> str:
    e2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
    e = e2**0.5
    import math

    qp = (1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)
    s = f"sin(radians({lat}))"
    es = f"({e!r}::DOUBLE * {s})"
    return f"({1 - e2!r}::DOUBLE * ({s} / (1 - {es} * {es}) + atanh({es}) / {e!r}::DOUBLE) / {qp!r}::DOUBLE)"


def _box_area(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"({6371007.180918**2!r}::DOUBLE * radians({x1} - {x0}) * ({_sin_beta(y1)} - {_sin_beta(y0)}))"


OVERLAPS = f"""{PARCELS}, {SOILS}, ov AS (SELECT gid, soil_id, symbol, description, inter_area, inter_area / {_box_area('pminx', 'pminy', 'pmaxx', 'pmaxy')} AS fraction FROM
(SELECT *, {_box_area('x0', 'y0', 'x1', 'y1')} AS inter_area FROM (SELECT p.gid, s.soil_id, s.symbol, s.description, p.minx AS pminx, p.miny AS pminy, p.maxx AS pmaxx, p.maxy AS pmaxy,
greatest(p.minx, s.minx) AS x0, greatest(p.miny, s.miny) AS y0, least(p.maxx, s.maxx) AS x1, least(p.maxy, s.maxy) AS y1 FROM parcels p JOIN soils s
ON p.minx < s.maxx AND p.maxx > s.minx AND p.miny < s.maxy AND p.maxy > s.miny)) WHERE inter_area > 0.01)"""


def _overlaps(spark, sf_dir):
    return overlay.overlap_join(parcels(spark, sf_dir), soils(spark, sf_dir), "gid", "soil_id", ["symbol", "description"])


@query(f"WITH {OVERLAPS} SELECT gid, soil_id, round(inter_area / 1e4, 2) AS hectares, round(fraction, 6) AS fraction FROM ov")
def overlap_join(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("gid", "soil_id", F.round(F.col("inter_area") / 1e4, 2).alias("hectares"), F.round("fraction", 6).alias("fraction"))


@query(f"WITH {OVERLAPS} SELECT gid, symbol, description, round(sum(fraction) * 100, 4) AS share_pct FROM ov GROUP BY ALL")
def class_shares(spark, sf_dir):
    shares = overlay.class_shares(_overlaps(spark, sf_dir), "gid", "symbol", "description")
    return shares.withColumn("share_pct", F.round("share_pct", 4))


@query(f"WITH {OVERLAPS} SELECT gid, symbol, round(sum(fraction) * 100, 3) AS share_pct FROM ov GROUP BY ALL ORDER BY gid, share_pct DESC, symbol")
def rank_shares(spark, sf_dir):
    shares = overlay.class_shares(_overlaps(spark, sf_dir), "gid", "symbol").withColumn("share_pct", F.round("share_pct", 3))
    return overlay.rank_shares(shares, "symbol", "gid")


@query(f"""WITH {OVERLAPS}, s AS (SELECT gid, symbol, sum(fraction) * 100 AS share_pct FROM ov GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(share_pct, 6) DESC, symbol) AS rn FROM s)
SELECT gid, max(symbol) FILTER (rn = 1) AS symbol, CAST(count(*) AS INTEGER) AS "count", round(sum(share_pct), 1) AS described_pct FROM r GROUP BY 1""")
def dominant_soil_class(spark, sf_dir):
    shares = overlay.class_shares(_overlaps(spark, sf_dir), "gid", "symbol")
    return overlay.describe_parcel(shares, "gid", "symbol").select("gid", "symbol", "count", "described_pct")


_COVERAGE = f"""WITH {OVERLAPS}, a AS (SELECT gid, symbol, NULL AS description, sum(fraction) * 100 AS share_pct FROM ov WHERE soil_id % 2 = 0 GROUP BY gid, symbol),
b AS (SELECT gid, symbol, description, sum(fraction) * 100 AS share_pct FROM ov WHERE soil_id % 2 = 1 GROUP BY gid, symbol, description),
c AS (SELECT gid, coalesce((SELECT sum(share_pct) FROM a WHERE a.gid = parcels.gid), 0) AS pa, (SELECT count(*) FROM b WHERE b.gid = parcels.gid) AS nb, (SELECT count(*) FROM a WHERE a.gid = parcels.gid) AS na FROM parcels),
d AS (SELECT gid, CASE WHEN pa < 40 AND nb > 0 THEN 'irda_2022' WHEN na > 0 THEN 'irda_2026' END AS source FROM c),
u AS (SELECT *, 'irda_2026' AS source FROM a UNION ALL SELECT *, 'irda_2022' FROM b)"""


def coverage(spark, sf_dir):
    s = soils(spark, sf_dir)
    return pp.pedo_coverage(parcels(spark, sf_dir), s.filter("soil_id % 2 = 0"), s.filter("soil_id % 2 = 1"), 40.0)


@query(f"{_COVERAGE} SELECT d.gid, d.source, u.symbol, u.description, round(u.share_pct, 4) AS share_pct FROM d LEFT JOIN u ON u.gid = d.gid AND u.source = d.source")
def pedo_coverage(spark, sf_dir):
    return coverage(spark, sf_dir).select("gid", "source", "symbol", "description", F.round("share_pct", 4).alias("share_pct"))


@query(f"{_COVERAGE} SELECT d.gid, any_value(d.source) AS source, round(coalesce(sum(u.share_pct), 0), 1) AS described_pct FROM d LEFT JOIN u ON u.gid = d.gid AND u.source = d.source GROUP BY 1")
def pedo_coverage_summary(spark, sf_dir):
    return pp.coverage_summary(coverage(spark, sf_dir)).select("gid", "source", "described_pct")


def pedo_tables(spark, sf_dir):
    """Soil polygons by code, with components, groups and horizons for the job queries."""
    polygons = soils(spark, sf_dir).withColumnRenamed("soil_id", "polygon_id").withColumn("code_polygone", F.col("polygon_id").cast("string"))
    horizons = read(spark, sf_dir, "part").select(F.concat(F.lit("S"), (F.col("p_partkey") % 300).cast("string")).alias("code_sol"),
                                                  F.col("p_name").alias("horizon"), F.col("p_size").cast("double").alias("depth_bottom_cm"), (F.col("p_retailprice") / 1000).alias("g_cm3"))
    return pp.pedo_properties(parcels(spark, sf_dir), polygons, _components(spark, sf_dir), _hydro(spark, sf_dir),
                              horizons.filter("depth_bottom_cm > 10"), horizons.drop("depth_bottom_cm"))


_PEDO = f"""WITH {OVERLAPS}, {_COMPONENTS}, f AS (SELECT gid, CAST(soil_id AS VARCHAR) AS code_polygone, fraction FROM ov),
s AS (SELECT gid, composante, sum(fraction * pourcentage) AS share_pct, min(code_sol) AS code_sol, min(CASE WHEN groupe_hydrologique <> 'NA' THEN groupe_hydrologique END) AS grp
FROM f JOIN components USING (code_polygone) LEFT JOIN hydro USING (composante) GROUP BY 1, 2)"""


@query(f"{_PEDO} SELECT gid, composante, code_sol, grp AS groupe_hydrologique, round(share_pct, 2) AS share_pct FROM s")
def pedo_components(spark, sf_dir):
    return pedo_tables(spark, sf_dir)[1]


@query(f"""{_PEDO}, t AS (SELECT gid, grp, round(sum(share_pct), 9) AS t FROM s WHERE grp IS NOT NULL GROUP BY 1, 2), d AS (SELECT gid, grp FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY t DESC, grp) AS rn FROM t) WHERE rn = 1),
p AS (SELECT gid, round(sum(round(share_pct, 2)), 2) AS pct FROM s GROUP BY 1) SELECT parcels.gid, coalesce(pct, 0) AS described_pct, grp AS dominant_group FROM parcels LEFT JOIN p USING (gid) LEFT JOIN d USING (gid)""")
def pedo_properties(spark, sf_dir):
    return pedo_tables(spark, sf_dir)[0]

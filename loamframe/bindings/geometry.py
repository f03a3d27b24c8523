"""Geometry functions and spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loamframe.bindings.soils import _box_area
from loamframe.bindings.tables import FARMS, PARCELS, SOILS, farms, parcels, query, read, soils
from loamframe.functions import geometry as geo, text
from loamframe.operators import ordered, reports, skew, spatial
from loamframe.plans import parcels as pp

_R = 6371008.8


def _hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return (f"(2.0::DOUBLE * {_R}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * "
            f"power(sin(radians({x2} - {x1}) / 2), 2)))))")


# --- functions ----------------------------------------------------------------------
@query(f"WITH {FARMS} SELECT gid, 'POINT' AS kind, x, y, 1 AS n FROM farms")
def point(spark, sf_dir):
    p = farms(spark, sf_dir).withColumn("g", geo.point(F.col("x"), F.col("y")))
    return p.select("gid", "g.kind", F.get(geo.xs_of(F.col("g")), F.lit(0)).alias("x"), F.get(geo.ys_of(F.col("g")), F.lit(0)).alias("y"), geo.num_points(F.col("g")).alias("n"))


@query(f"WITH {PARCELS} SELECT gid, minx, miny, maxx, maxy FROM parcels")
def bounds(spark, sf_dir):
    b = geo.bounds(F.col("geom"))
    return parcels(spark, sf_dir).select("gid", *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query(f"WITH {PARCELS} SELECT gid, CASE WHEN gid % 4 = 0 THEN 0 ELSE 5 END AS n FROM parcels")
def num_points(spark, sf_dir):
    g = F.when(F.col("gid") % 4 != 0, F.col("geom"))
    return parcels(spark, sf_dir).select("gid", geo.num_points(g).alias("n"))


@query(f"WITH {PARCELS} SELECT gid, '{{\"type\":\"Polygon\",\"coordinates\":[[[' || minx || ',' || miny || '],[' || maxx || ',' || miny || '],[' || maxx || ',' || maxy || '],[' || minx || ',' || maxy || '],[' || minx || ',' || miny || ']]]}}' AS geojson FROM parcels")
def as_geojson(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", geo.as_geojson(F.col("geom")).alias("geojson"))


@query(f"WITH {PARCELS} SELECT gid, 'POLYGON ((' || minx || ' ' || miny || ', ' || maxx || ' ' || miny || ', ' || maxx || ' ' || maxy || ', ' || minx || ' ' || maxy || ', ' || minx || ' ' || miny || '))' AS wkt FROM parcels")
def wkt(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", geo.wkt(F.col("geom")).alias("wkt"))


@query(f"""WITH {PARCELS} SELECT gid, -66.0 >= minx AND -66.0 < maxx AND 51.0 >= miny AND 51.0 < maxy AS holds, minx + (maxx - minx) / 3 >= minx AND TRUE AS inside FROM parcels""")
def contains_point(spark, sf_dir):
    g = F.col("geom")
    near = F.col("minx") + (F.col("maxx") - F.col("minx")) / 3
    return parcels(spark, sf_dir).select("gid", geo.contains_point(g, F.lit(-66.0), F.lit(51.0)).alias("holds"),
                                         geo.contains_point(g, near, F.col("miny") + 0.1).alias("inside"))


@query(f"WITH {PARCELS} SELECT gid, round({_box_area('minx', 'miny', 'maxx', 'maxy')} / 1e4, 3) AS hectares FROM parcels")
def area_of_parcels(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", F.round(geo.area_m2(F.col("geom")) / 1e4, 3).alias("hectares"))


@query(f"WITH {PARCELS} SELECT gid, round({_hav('minx', 'miny', 'maxx', 'miny')} + {_hav('maxx', 'miny', 'maxx', 'maxy')} + {_hav('maxx', 'maxy', 'minx', 'maxy')} + {_hav('minx', 'maxy', 'minx', 'miny')}, 3) AS metres FROM parcels")
def length_of_outlines(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", F.round(geo.length_m(F.col("geom")), 3).alias("metres"))


@query(f"WITH {FARMS} SELECT gid, round({_hav('x', 'y', '-72.0::DOUBLE', '46.0::DOUBLE')}, 2) AS metres FROM farms")
def point_distance(spark, sf_dir):
    return farms(spark, sf_dir).select("gid", F.round(geo.point_distance_m(geo.point(F.lit(-72.0), F.lit(46.0)), F.col("x"), F.col("y")), 2).alias("metres"))


@query(f"WITH {PARCELS} SELECT gid, round((minx + maxx) / 2, 6) AS x, round((miny + maxy) / 2, 6) AS y, round((minx + maxx) / 2, 6) AS ix, round((miny + maxy) / 2, 6) AS iy FROM parcels")
def centroid_and_interior_point(spark, sf_dir):
    c, i = geo.centroid_vertices(F.col("geom")), geo.interior_point(F.col("geom"))
    return parcels(spark, sf_dir).select("gid", *[F.round(v, 6).alias(n) for v, n in ((c["x"], "x"), (c["y"], "y"), (i["x"], "ix"), (i["y"], "iy"))])


@query(f"""WITH {FARMS} SELECT gid, 33 AS n, round(5.0::DOUBLE / ({math.radians(1.0) * _R!r}::DOUBLE), 9) AS half_height, round(5.0::DOUBLE / ({math.radians(1.0) * _R!r}::DOUBLE * cos(radians(y))), 9) AS half_width FROM farms""")
def buffer_point(spark, sf_dir):
    f = farms(spark, sf_dir).select("gid", "x", "y", geo.buffer_point(F.col("x"), F.col("y")).alias("disc"))
    b = geo.bounds(F.col("disc"))
    return f.select("gid", geo.num_points(F.col("disc")).alias("n"), F.round(b["maxy"] - F.col("y"), 9).alias("half_height"), F.round(b["maxx"] - F.col("x"), 9).alias("half_width"))


@query(f"WITH {PARCELS} SELECT gid, round((maxx - minx) * 111.32::DOUBLE * cos(radians((miny + maxy) / 2)) * (maxy - miny) * 111.32::DOUBLE * 100.0::DOUBLE, 4) AS hectares FROM parcels")
def bbox_area(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", F.round(geo.bbox_area_ha(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]), 4).alias("hectares"))


@query(f"WITH {FARMS} SELECT gid, round(radians(x) * 6378137.0::DOUBLE, 3) AS mx, round(ln(tan({math.pi / 4!r}::DOUBLE + radians(y) / 2)) * 6378137.0::DOUBLE, 3) AS my, round(x, 6) AS x, round(y, 6) AS y FROM farms")
def reproject_mercator(spark, sf_dir):
    mx, my = geo.reproject_xy(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    m = farms(spark, sf_dir).select("gid", mx.alias("mx"), my.alias("my"))
    x, y = geo.reproject_xy(F.col("mx"), F.col("my"), "EPSG:3857", "EPSG:4326")
    return m.select("gid", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _lambert_sql(x: str, y: str):
    e, n, f, rho0, lon0 = geo._lambert_constants("EPSG:32198")
    es = f"({e!r}::DOUBLE * sin(radians({y})))"
    t = f"(tan({math.pi / 4!r}::DOUBLE - radians({y}) / 2) / power((1 - {es}) / (1 + {es}), {e / 2!r}::DOUBLE))"
    rho, th = f"({6378137.0 * f!r}::DOUBLE * power({t}, {n!r}::DOUBLE))", f"({n!r}::DOUBLE * (radians({x}) - ({lon0!r}::DOUBLE)))"
    return f"round({rho} * sin({th}), 2)", f"round({rho0!r}::DOUBLE - {rho} * cos({th}), 2)"


_LX, _LY = _lambert_sql("x", "y")


@query(f"WITH {FARMS} SELECT gid, {_LX} AS lx, {_LY} AS ly, round(x, 6) AS x, round(y, 6) AS y FROM farms")
def reproject_lambert(spark, sf_dir):
    there = farms(spark, sf_dir).select("gid", geo.reproject(geo.point(F.col("x"), F.col("y")), "EPSG:4326", "EPSG:32198").alias("g"))
    back = there.withColumn("b", geo.reproject(F.col("g"), "EPSG:32198", "EPSG:4326"))
    at = lambda g, d: F.get(geo.xs_of(F.col(g)) if d == 0 else geo.ys_of(F.col(g)), F.lit(0))
    return back.select("gid", F.round(at("g", 0), 2).alias("lx"), F.round(at("g", 1), 2).alias("ly"), F.round(at("b", 0), 6).alias("x"), F.round(at("b", 1), 6).alias("y"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'EPSG:32198' ELSE 'EPSG:4326' END AS crs FROM part")
def target_crs(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("corg_SIIGSOL_"), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", geo.target_crs(name, "EPSG:4326").alias("crs"))


@query(f"WITH {PARCELS} SELECT gid, CAST(count(*) AS INTEGER) AS n FROM parcels, generate_series(0, 30) a(i), generate_series(0, 30) b(j) WHERE floor(minx / 0.1) + i <= floor(maxx / 0.1) AND floor(miny / 0.1) + j <= floor(maxy / 0.1) GROUP BY 1")
def cell_keys(spark, sf_dir):
    return parcels(spark, sf_dir).select("gid", F.size(geo.cells(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")], 0.1)).alias("n"))


def _tx(x: str, n: int) -> str:
    return f"CAST(floor(({x} + 180.0) / 360.0 * {n}) AS BIGINT)"


def _ty(y: str, n: int) -> str:
    return f"CAST(floor((1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / {math.pi!r}) / 2 * {n}) AS BIGINT)"


@query(f"WITH {PARCELS} SELECT gid, {_tx('minx', 512)} AS tx0, {_ty('maxy', 512)} AS ty0, CAST(({_tx('maxx', 512)} - {_tx('minx', 512)} + 1) * ({_ty('miny', 512)} - {_ty('maxy', 512)} + 1) AS INTEGER) AS n FROM parcels")
def tile_keys(spark, sf_dir):
    t = parcels(spark, sf_dir).select("gid", geo.tile_keys(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")], 9).alias("k"))
    first = F.get("k", F.lit(0))
    return t.select("gid", first["tx"].alias("tx0"), first["ty"].alias("ty0"), F.size("k").alias("n"))


@query(f"WITH {PARCELS} SELECT gid, format('{{:.4f}},{{:.4f}},{{:.4f}},{{:.4f}}', minx, miny, maxx, maxy) AS box_key, md5(format('{{:.4f}},{{:.4f}},{{:.4f}},{{:.4f}}', minx, miny, maxx, maxy))[1:8] || '_scl' AS item_id FROM parcels")
def bbox_key(spark, sf_dir):
    key = text.bbox_key(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    return parcels(spark, sf_dir).select("gid", key.alias("box_key"), text.geometry_id(key, masked=True).alias("item_id"))


@query(f"WITH {PARCELS} SELECT gid, CASE gid % 4 WHEN 1 THEN 'unclosed_ring' WHEN 2 THEN 'duplicate_vertex' WHEN 3 THEN 'wrong_orientation' ELSE '' END AS reasons, '' AS after_repair, 5 AS n FROM parcels")
def validity_and_repair(spark, sf_dir):
    k, x0, y0, x1, y1 = (F.col(c) for c in ("gid", "minx", "miny", "maxx", "maxy"))
    open_ring = geo.polygon(F.array(x0, x1, x1, x0), F.array(y0, y0, y1, y1))
    doubled = geo.polygon(F.array(x0, x1, x1, x1, x0, x0), F.array(y0, y0, y0, y1, y1, y0))
    clockwise = geo.polygon(F.array(x0, x0, x1, x1, x0), F.array(y0, y1, y1, y0, y0))
    g = F.when(k % 4 == 1, open_ring).when(k % 4 == 2, doubled).when(k % 4 == 3, clockwise).otherwise(F.col("geom"))
    shapes = skew.over_all_tasks(parcels(spark, sf_dir), "gid").select("gid", F.inline(F.array(F.struct(g.alias("g")))))
    judged = shapes.select("*", F.inline(F.array(F.struct(geo.repair(F.col("g")).alias("fixed")))))
    return judged.select("gid", F.array_join(geo.invalid_reasons(F.col("g")), ";").alias("reasons"), F.array_join(geo.invalid_reasons(F.col("fixed")), ";").alias("after_repair"),
                         geo.num_points(F.col("fixed")).alias("n"))


@query(f"WITH {PARCELS} SELECT gid, 2 AS n, 'xs,ys' AS fields FROM parcels")
def force_2d(spark, sf_dir):
    z = F.transform("geom.parts", lambda p: p.withField("zs", F.transform(p["xs"], lambda _: F.lit(1.0))))
    flat = parcels(spark, sf_dir).select("gid", geo.force_2d(z).alias("p"))
    names = [f.name for f in flat.schema["p"].dataType.elementType.fields if f.name in ("xs", "ys", "zs")]
    return flat.select("gid", F.lit(len(names)).alias("n"), F.lit(",".join(names)).alias("fields"))


# --- joins --------------------------------------------------------------------------
_HITS = f"{FARMS}, {PARCELS}, hits AS (SELECT f.gid AS farm, p.gid AS parcel, f.x, f.y, c_acctbal, c_mktsegment FROM farms f JOIN parcels p ON x >= minx AND x < maxx AND y >= miny AND y < maxy)"


def _pairs(spark, sf_dir):
    points = farms(spark, sf_dir).select(F.col("gid").alias("farm"), "x", "y", "c_acctbal", "c_mktsegment")
    return spatial.spatial_join(parcels(spark, sf_dir).withColumnRenamed("gid", "parcel"), points, "parcel", "farm", [], ["c_acctbal", "c_mktsegment"])


@query(f"WITH {_HITS} SELECT farm, parcel FROM hits")
def points_in_polygons(spark, sf_dir):
    return _pairs(spark, sf_dir).select("farm", "parcel")


@query(f"WITH {_HITS} SELECT f.gid AS farm, arg_min(s_name, p.gid) AS label FROM farms f LEFT JOIN parcels p ON x >= minx AND x < maxx AND y >= miny AND y < maxy GROUP BY 1")
def first_match_label(spark, sf_dir):
    points = farms(spark, sf_dir).select(F.col("gid").alias("farm"), "x", "y")
    zones = parcels(spark, sf_dir).select(F.col("gid").alias("parcel"), F.col("s_name").alias("label"), "geom", "minx", "miny", "maxx", "maxy")
    return spatial.first_match_label(points, zones, "farm", "parcel", "label").select("farm", "label")


@query(f"WITH {SOILS} SELECT a.soil_id AS id_a, b.soil_id AS id_b FROM soils a JOIN soils b ON a.soil_id <> b.soil_id AND a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny")
def overlapping_pairs(spark, sf_dir):
    return spatial.overlapping_pairs(soils(spark, sf_dir), "soil_id")


@query(f"""WITH {_HITS} SELECT parcel, count(*) AS n, round(avg(c_acctbal), 4) AS m, round(stddev_pop(c_acctbal), 4) AS sd, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS types FROM hits GROUP BY 1""")
def field_sample_stats(spark, sf_dir):
    stats = spatial.sample_stats(_pairs(spark, sf_dir), "parcel", "c_acctbal", "c_mktsegment")
    return stats.select("parcel", "n", F.round("m", 4).alias("m"), F.round("sd", 4).alias("sd"), F.array_join("types", "|").alias("types"))


_D = f"""{FARMS}, {PARCELS}, d AS (SELECT p.gid AS parcel, f.gid AS farm, f.gid % 3 = 0 AS flag, CASE WHEN x >= minx AND x < maxx AND y >= miny AND y < maxy THEN 0 ELSE
{_hav('x', 'y', 'greatest(minx, least(maxx, x))', 'greatest(miny, least(maxy, y))')} END AS d FROM farms f JOIN parcels p ON x BETWEEN minx - 0.01 AND maxx + 0.01 AND y BETWEEN miny - 0.01 AND maxy + 0.01)"""


@query(f"WITH {_D} SELECT parcel, farm, flag, round(d, 1) AS dist_m FROM d WHERE d <= 450")
def within_distance(spark, sf_dir):
    return _matches(spark, sf_dir)


def _matches(spark, sf_dir):
    points = farms(spark, sf_dir).select(F.col("gid").alias("farm"), (F.col("gid") % 3 == 0).alias("flag"), geo.point(F.col("x"), F.col("y")).alias("geom"), "minx", "miny", "maxx", "maxy")
    zones = parcels(spark, sf_dir).select(F.col("gid").alias("parcel"), "geom", "minx", "miny", "maxx", "maxy")
    return pp.som_field_match(zones, points, 450.0, "parcel", "farm", "flag")


@query(f"WITH {_D} SELECT parcel, farm, flag, round(d, 1) AS dist_m FROM d WHERE d <= 450 ORDER BY parcel, flag DESC, dist_m")
def flag_then_distance(spark, sf_dir):
    return spatial.flag_then_distance(_matches(spark, sf_dir), "flag", "parcel")


@query(f"""WITH {FARMS}, {PARCELS}, c AS (SELECT gid AS click, x + ((gid % 5) - 2) * 0.0004::DOUBLE AS cx, y AS cy FROM farms), h AS (SELECT click, p.gid AS parcel, cx >= minx AND cx < maxx AND cy >= miny AND cy < maxy AS inside
FROM c JOIN parcels p ON cx - 0.0002 <= maxx AND cx + 0.0002 >= minx AND cy - 0.0002 <= maxy AND cy + 0.0002 >= miny)
SELECT click, parcel, inside AS "contains" FROM (SELECT *, row_number() OVER (PARTITION BY click ORDER BY inside DESC, parcel) AS rn FROM h) WHERE rn = 1""")
def point_hit(spark, sf_dir):
    clicks = farms(spark, sf_dir).select(F.col("gid").alias("click"), (F.col("x") + ((F.col("gid") % 5) - 2) * F.lit(0.0004)).alias("x"), "y")
    return spatial.point_hit(clicks, parcels(spark, sf_dir).withColumnRenamed("gid", "parcel"), "click", "parcel")


_NEAR = f"""{FARMS}, {PARCELS}, c AS (SELECT p.gid, f.gid AS farm, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, {_hav('cx', 'cy', 'x', 'y')} AS m FROM
(SELECT gid, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM parcels) p CROSS JOIN farms f), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(d, 9), farm) AS rn FROM c)"""


def _water(spark, sf_dir):
    return farms(spark, sf_dir).select(F.col("gid").alias("farm"), geo.point(F.col("x"), F.col("y")).alias("geom"), "minx", "miny", "maxx", "maxy")


@query(f"WITH {_NEAR} SELECT parcels.gid, round(m, 2) AS distance_m FROM parcels LEFT JOIN (SELECT gid, min(m) AS m FROM r WHERE rn <= 5 GROUP BY 1) q ON q.gid = parcels.gid AND m <= 60000")
def water_distance(spark, sf_dir):
    found = pp.water_distance(parcels(spark, sf_dir), _water(spark, sf_dir), 60_000.0, "gid", "farm")
    return found.select("gid", F.round("distance_m", 2).alias("distance_m"))


@query(f"WITH {_NEAR} SELECT gid, farm, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 3")
def k_nearest(spark, sf_dir):
    at = parcels(spark, sf_dir).select("gid", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    best = spatial.nearest(at, _water(spark, sf_dir), "gid", "farm", "x", "y", 3, F.lit(1000.0))
    return best.select("gid", "farm", "rank")


@query("""WITH a AS (SELECT l_orderkey AS a_id, count(*) AS n, round(avg(l_extendedprice), 6) AS m FROM lineitem GROUP BY 1), b AS (SELECT -l_orderkey AS b_id, count(*) AS n, round(avg(l_extendedprice), 6) AS m FROM lineitem GROUP BY 1)
SELECT a_id, b_id FROM a JOIN b USING (n, m)""")
def match_by_signature(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    stats = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("m"))
    a = stats(li.withColumnRenamed("l_orderkey", "a_id"), "a_id")
    b = stats(li.withColumn("b_id", -F.col("l_orderkey")), "b_id")
    return spatial.match_by_signature(a, b, "a_id", "b_id", ["n"], ["m"])


@query("""SELECT p_partkey AS id, last_value(CASE WHEN p_partkey % 7 = 0 THEN p_size END IGNORE NULLS) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_offset,
first_value(CASE WHEN p_partkey % 7 = 0 THEN p_size END IGNORE NULLS) OVER (ORDER BY p_partkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS upper_offset FROM part""")
def neighbour_offsets(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    known = p.filter("id % 7 = 0").select("id", F.col("p_size").alias("offset"))
    return spatial.neighbour_offsets(p, known, "id")


@query("SELECT c_custkey AS a_id, c_custkey - 5 AS b_id, CASE WHEN c_custkey % 4 = 1 THEN 'block_offset' ELSE 'unique' END AS method FROM customer")
def resolve_ambiguous(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a_id"))
    options = F.when(F.col("a_id") % 4 == 1, F.array(F.col("a_id") - 5, F.col("a_id") - 4)).otherwise(F.array(F.col("a_id") - 5))
    return spatial.resolve_ambiguous(ids.withColumn("b_id", F.explode(options)), "a_id", "b_id")


@query(f"""WITH {SOILS} SELECT soil_id, row_number() OVER (PARTITION BY symbol ORDER BY soil_id) AS split_part FROM soils""")
def part_number(spark, sf_dir):
    pieces = soils(spark, sf_dir).select("soil_id", "symbol")
    return ordered.number_rows(pieces, ["symbol"], [F.col("soil_id")], "split_part").select("soil_id", "split_part")


def sample_per_cell(spark, sf_dir):
    drawn = reports.sample_per_cell(farms(spark, sf_dir).drop("minx", "miny", "maxx", "maxy"), "gid", "x", "y", 60, 42, cell=0.5)
    return drawn.select("gid", "cx", "cy")


query()(sample_per_cell)

_CELLSQL = f"WITH {FARMS} SELECT CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy, 1::BIGINT AS drawn FROM farms GROUP BY 1, 2"


@query(_CELLSQL)
def sample_every_cell(spark, sf_dir):
    """With n above the number of cells every cell gives exactly one row."""
    drawn = reports.sample_per_cell(farms(spark, sf_dir).drop("minx", "miny", "maxx", "maxy"), "gid", "x", "y", 2_000_000, 42)
    return drawn.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("drawn"))

"""Component rows of parcels: pairs are summed where they are found."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import overlay, soil
from loamframe.plans import parcels as pp


def _boxes(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name} long, x0 double, y0 double, x1 double, y1 double")
    return geo.with_bounds(df.select(name, geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("geom")))


def _tables(spark):
    # parcels of several sizes, one of them in two rows; polygons of which one is wide; a soil named twice and one without a name
    parcels = [(n % 40, n % 7 * 0.31, n % 5 * 0.23, n % 7 * 0.31 + 0.1 + n % 3 * 0.4, n % 5 * 0.23 + 0.2) for n in range(41)] + [(90, -3.0, -3.0, 6.0, 6.0)]
    polygons = [(n, n % 11 * 0.2, n % 4 * 0.3, n % 11 * 0.2 + 0.25, n % 4 * 0.3 + 0.3) for n in range(60)] + [(99, -5.0, -5.0, 9.0, 9.0)]
    components = spark.createDataFrame([(str(n % 50 + 40 * (n % 3)), f"c{n % 13}", float(n % 9 + 1)) for n in range(300)], "code_polygone string, composante string, pourcentage double")
    hydro = spark.createDataFrame([(f"c{n}", f"S{n % 5}", "NA" if n % 4 == 0 else "ABC"[n % 3]) for n in range(12)] + [("c3", "S0", "B")],
                                  "composante string, code_sol string, groupe_hydrologique string")
    soils = _boxes(spark, polygons, "polygon_id").withColumn("code_polygone", F.col("polygon_id").cast("string"))
    return _boxes(spark, parcels, "gid"), soils, components, hydro


def _plain(parcels, soils, components, hydro):
    """The same over pairs that are joined one by one."""
    per_code = overlay.overlap_join(parcels, soils, "gid", "polygon_id", ["code_polygone"]).select("gid", "code_polygone", "fraction")
    return soil.component_shares(per_code, soil.components_with_hydro(components, hydro), "gid", keep=["code_sol", "groupe_hydrologique"])


def _rows(shares):
    return sorted((r["gid"], r["composante"], round(r["share_pct"], 6), r["code_sol"] or "", r["groupe_hydrologique"] or "") for r in shares.collect())


@pytest.mark.parametrize(("shapes", "candidates", "packed"), [("boxes", 1_000_000, 5_000), ("boxes", 5, 2), ("triangles", 5, 5_000)])
def test_sums_are_those_of_single_pairs(spark, shapes, candidates, packed):
    parcels, soils, components, hydro = _tables(spark)
    if shapes == "triangles":
        x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
        soils = soils.withColumn("geom", F.when(F.col("polygon_id") % 2 == 0, geo.polygon(F.array(x0, x1, x1, x0), F.array(y0, y0, y1, y0))).otherwise(F.col("geom")))
    keep = ["code_sol", "groupe_hydrologique"]
    parts = soil.packed_components(components, hydro, soils.select("code_polygone").distinct(), keep=keep, packed=packed)
    got = overlay.part_shares(parcels, soils.join(parts, "code_polygone"), "gid", "polygon_id", "parts", ["composante", *keep], "pourcentage", candidates=candidates)
    assert _rows(got) == _rows(_plain(parcels, soils, components, hydro)) and len(_rows(got)) > 300


def test_no_shuffle_stands_above_the_pairs(spark):
    parcels, soils, components, hydro = _tables(spark)
    single = parcels.dropDuplicates(["gid"])
    plan = pp.pedo_components(single, soils, components, hydro)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")]


def test_summary_in_one_pass(spark):
    shares = _plain(*_tables(spark))
    want = {r["gid"]: r["described_pct"] for r in soil.described_pct(shares, "gid").collect()}
    groups = {r["gid"]: r["dominant_group"] for r in soil.dominant_group(shares, "gid").collect()}
    got = {r["gid"]: (r["described_pct"], r["dominant_group"]) for r in soil.parcel_summary(shares, "gid").collect()}
    assert got == {k: (v, groups.get(k)) for k, v in want.items()}

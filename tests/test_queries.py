"""Registered queries against their SQL at the smallest scale (``tools/check_queries.py`` runs them all)."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools import check_queries as check

SF = "/root/testdata/sf0.001"
NAMES = [
    "farms_in_box", "bbox_filter_exact", "deep_page", "page_within_budget", "tile_limit", "feature_json", "assign_gid", "repair_null_gid",
    "upsert_rows", "validate_key", "fk_orphans", "harmonize_name", "ascii_fold", "station_indicators", "monthly_mean_with_gaps",
    "grid_subset_rotated", "validate_coords", "station_series", "component_shares", "dominant_group", "horizon_rows", "overlap_join",
    "points_in_polygons", "within_distance", "neighbour_offsets", "spectral_indices", "zonal_stats", "terrain", "composite_median",
    "catalog_search", "item_properties", "run_report", "difference_summary", "field_predictions", "iqr_filter", "group_folds", "water_union", "split_concave",
    "split_report", "crossing_rings", "to_utc_written", "k_nearest",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    ours = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    assert ours == check.rows_of([d[0] for d in result.description], result.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150

"""URL lists picked out of cells are those of the pairs, and pairs are not made for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamframe.operators import spatial
from loamframe.sources import landed


@pytest.mark.parametrize("cell_tiles", [1000, 8])
def test_lists_by_cell_equal_lists_by_pairs(spark, monkeypatch, cell_tiles):
    """Short chunks, empty URLs, ids that repeat, boxes that touch cell edges, bad bounds; crowded cells go through the pairs."""
    tiles = [(n % 70, n % 9 / 2.0, n // 9 / 2.0, f"a{n}", None if n % 3 else f"b{n}") for n in range(80)] + [(99, 0.0, 0.0, "", ""), (98, float("nan"), 0.0, "x", "y")]
    tiles = spark.createDataFrame(tiles, "tile_id long, minx double, miny double, a string, b string").withColumns({"maxx": F.col("minx") + 0.5, "maxy": F.col("miny") + 0.25})
    asked = [(n, n % 5 * 0.75, n // 5 * 0.5, n % 4 * 0.5) for n in range(30)] + [(3, 2.0, 2.0, 1.0), (None, 1.0, 1.0, 1.0), (50, 90.0, 90.0, 1.0), (51, None, 1.0, 1.0), (52, -3.0, -3.0, 12.0)]
    asked = spark.createDataFrame(asked, "request_id long, minx double, miny double, w double").withColumns({"maxx": F.col("minx") + F.col("w"), "maxy": F.col("miny") + F.col("w")})
    listed = lambda df: sorted((tuple(map(str, r[:3])), list(r[3])) for r in df.select("request_id", "product", "chunk", "url").collect())
    want = listed(landed.tile_urls(landed.tile_index_lookup(tiles, asked, ["a", "b"]), 4))
    assert listed(landed.tile_url_lists(tiles, asked, ["a", "b"], 4, cell_tiles)) == want and len(want) > 60
    if cell_tiles == 1000:
        monkeypatch.setattr(spatial, "bbox_join", None)
        single = asked.filter("request_id <> 3")
        assert listed(landed.tile_url_lists(tiles, single, ["a", "b"], 4)) == [w for w in want if w[0][0] not in ("3", "None")]

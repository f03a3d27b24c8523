"""A station's series is packed once for all requests of one kind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loamframe.functions import geometry as geo
from loamframe.operators import stations
from loamframe.plans import weather

WORDS = ["click", "view"]


def _tables(spark, asked):
    schema = "request_id long, minx double, miny double, maxx double, maxy double, variables array<string>, start_date string, end_date string, collection string"
    requests = spark.createDataFrame(asked, schema).withColumns({
        "location_type": F.lit("bbox"), "farm_id": F.lit(None).cast("string"), "lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"),
        "polygon": F.lit(None).cast(geo.GEOM_TYPE)})
    rows = [(s, 10.0 + s, 50.0, dt.datetime(2024, 1, d, h), v, s + d / 7 + h)
            for s in range(3) for d in range(2, 7) for h in (0, 6) for v in ("click", "view", "purchase") if (s + d) % 3 or v == "click"]
    items = spark.createDataFrame(rows, "station_id long, lon double, lat double, time timestamp, variable string, value double")
    items = items.withColumn("collection", F.explode(F.array(F.lit("swob-realtime"), F.lit("climate-daily"))))
    known = spark.createDataFrame([(c, [*WORDS, "purchase"]) for c in ("swob-realtime", "climate-daily")], "collection string, variables array<string>")
    farms = spark.createDataFrame([], f"farm_id string, geom {geo.GEOM_TYPE}")
    return requests, items, known, farms


def _asked(twice=False):
    box, first, late = (9.0, 49.0, 13.0, 51.0), ("2024-01-03", "2024-01-05"), ("2024-01-05", "2024-01-06")
    rows = [(n, *box, ["view", "click", "click"] if n % 2 else ["click", "view"], *first, "swob-realtime") for n in range(1, 21)]
    rows += [(21, *box, ["click"], *first, "swob-realtime"), (22, *box, ["click", "purchase"], *late, "swob-realtime"), (23, *box, WORDS, *first, "climate-daily")]
    return rows + [(1, *box, WORDS, *late, "swob-realtime")] * twice


def _rows(df):
    return sorted((r.site, r.chunk, r.time, r.click, r.view) for r in df.collect())


def test_requests_of_one_kind_share_a_series(spark, monkeypatch):
    packed, own = [], stations.station_series
    monkeypatch.setattr(stations, "station_series", lambda rows, *a, **k: (packed.append(rows.count()), own(rows, *a, **k))[1])
    tables = _tables(spark, _asked())
    got = _rows(weather.station_request_arrays(*tables, WORDS, "swob-realtime"))
    assert packed[0] <= 3 * (6 + 6 + 4)  # three stations, three kinds, two times a day
    assert got == _rows(weather.station_arrays(weather.station_observations(*tables), WORDS, "swob-realtime"))
    assert len(got) == 22 * 3 and any(None in r[4] for r in got)


def test_rows_of_one_request_have_one_series(spark):
    tables = _tables(spark, _asked(twice=True))
    got = _rows(weather.station_request_arrays(*tables, WORDS, "swob-realtime"))
    assert got == _rows(weather.station_arrays(weather.station_observations(*tables), WORDS, "swob-realtime"))
    assert len({r[0] for r in got}) == len(got) == 22 * 3

"""Steps are rounded as their SQL rounds them."""

from __future__ import annotations

import duckdb

from loamframe.bindings import models
from loamframe.bindings.tables import SQL


def test_a_mean_beside_a_tie_rounds_as_in_the_sql(spark, tmp_path):
    # 0.0018499999999999999 reads as less than the tie, but times 10 000 it is 18.5
    rows = [(1, 1, 0.0018499999999999999), (1, 2, 0.0019), (2, 1, 0.0125), (2, 2, 0.0018), (3, 1, 0.00294999999), (3, 2, 0.0018499999999999999)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for query in (models.argmax_step, models.drop_flag):
        got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(SQL[query.__name__]).fetchall())
    assert sorted(map(tuple, models.argmax_step(spark, str(tmp_path)).collect()))[0] == (1, 1)

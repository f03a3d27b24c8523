import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamframe.operators import keys, ordered, quantiles, query, skew


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, with many ties."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": np.where(np.arange(3000) % 3 == 0, 0, rng.integers(1, 40, 3000)), "v": rng.integers(0, 300, 3000) / 4.0})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("hot", [10**9, 100])
def test_windows_are_the_same_with_and_without_slices(skewed, hot):
    pdf, df = skewed
    order = [F.col("v"), F.col("id")]
    s = pdf.sort_values(["g", "v", "id"])
    s["rn"], s["rs"], s["lag"] = s.groupby("g").cumcount() + 1, s.groupby("g").v.cumsum(), s.groupby("g").v.shift()
    s = s.set_index("id").sort_index()
    opts = {"hot_rows": hot, "slices": 16}
    got = ordered.number_rows(df, ["g"], order, "rn", **opts).toPandas().set_index("id").sort_index()
    assert (got.rn == s.rn).all()
    got = ordered.running_sum(df, ["g"], order, "v", "rs", **opts).toPandas().set_index("id").sort_index()
    assert np.allclose(got.rs, s.rs)
    got = ordered.previous_value(df, ["g"], order, "v", "lag", "first", **opts).toPandas().set_index("id").sort_index()
    assert np.allclose(got["lag"].fillna(-1), s["lag"].fillna(-1)) and (got["first"] == (s.rn == 1)).all()
    whole = ordered.number_rows(df, [], order, "rn", **opts).toPandas().sort_values("rn")
    assert whole.rn.tolist() == list(range(1, 3001)) and whole.v.is_monotonic_increasing


def test_series_chunks_hold_every_row_once(skewed):
    pdf, df = skewed
    packed = ordered.series_arrays(df, ["g"], [F.col("v"), F.col("id")], ["id"], chunk_rows=100, hot_rows=200)
    assert packed.agg(F.max(F.size("id"))).first()[0] <= 100
    assert sorted(i for r in packed.collect() for i in r["id"]) == list(range(3000))


@pytest.mark.parametrize("group", [["g"], []])
def test_percentiles_are_exact(skewed, group):
    pdf, df = skewed
    wanted = {"a": 0.25, "m": 0.5, "z": 0.99}
    got = quantiles.exact_percentiles(df, group, "v", wanted, hot_rows=50).toPandas()
    if group:
        expected = pdf.groupby("g").v.quantile(list(wanted.values())).unstack().sort_index()
        assert np.allclose(got.sort_values("g")[list(wanted)].to_numpy(), expected.to_numpy())
    else:
        assert np.allclose(got[list(wanted)].to_numpy()[0], pdf.v.quantile(list(wanted.values())))


def test_percentiles_beyond_the_sketch_accuracy(spark):
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_013).cast("double").alias("v"))
    got = quantiles.exact_percentiles(df, [], "v", {"a": 0.1, "m": 0.5}).first()
    expected = df.toPandas().v.quantile([0.1, 0.5]).tolist()
    assert [got["a"], got["m"]] == pytest.approx(expected)


def test_salted_join_keeps_all_pairs(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7))
    right = spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    assert skew.salted_join(left, right, ["k"], F.col("id"), hot_rows=50).count() == 1000
    assert skew.salted_join(left, right.filter("k > 0"), ["k"], F.col("id"), "left", 50).filter("t is null").count() == left.filter("k = 0").count()


def test_gid_repair_skips_used(spark):
    df = spark.createDataFrame([("5", 1), (None, 2), ("x", 3), ("2", 4)], "gid string, n int")
    assert {r["n"]: r["gid"] for r in keys.repair_null_gid(df, ["n"]).collect()} == {1: 5, 4: 2, 2: 6, 3: 7}


def test_key_report(spark):
    df = spark.createDataFrame([("1",), ("1",), ("-3",), ("2.5",), (None,)], "k string")
    row = keys.validate_key(df, "k").first()
    assert (row["rows"], row["nulls"], row["duplicates"], row["non_integers"], row["negatives"]) == (5, 1, 1, 1, 1) and row["examples"] == ["1"]


def test_duplicate_ids_never_repeat_over_pages(spark):
    df = spark.range(30).select((F.col("id") % 4).alias("gid"), F.col("id").alias("row_key"))
    walked = [r["row_key"] for o in range(0, 30, 7) for r in query.page(df, ["gid", "row_key"], 7, o).collect()]
    assert sorted(walked) == list(range(30))
    deep = [r["row_key"] for o in range(0, 30, 7) for r in query.page_by_key(df, ["gid", "row_key"], 7, o, hot_rows=10).collect()]
    assert deep == walked
    seen, last = [], None
    while True:
        rows = query.page_after(df, ["gid", "row_key"], last, 8).collect()
        if not rows:
            break
        seen += [r["row_key"] for r in rows]
        last = (rows[-1]["gid"], rows[-1]["row_key"])
    assert seen == walked


def test_vertex_budget(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 9), (4, 1), (5, 1)], "gid int, v int")
    rows = query.page_within_budget(df, ["gid"], "v", 10).collect()
    assert [r["gid"] for r in rows] == [1, 2] and {r["next_offset"] for r in rows} == {2}
    with pytest.raises(Exception, match="budget"):
        query.page_within_budget(df, ["gid"], "v", 3).collect()

"""Tables by key bucket: what a change rewrites, versions, conflicts, runs that end half way."""

import pytest
from pyspark.sql import functions as F

from loamframe.sources.buckets import BucketStore, Conflict, append_pending, bucket_of, publish_catalog, refresh_columns, upsert_table
from loamframe.streaming import live


@pytest.fixture()
def store(spark, tmp_path):
    return BucketStore(spark, str(tmp_path / "store"))


def table(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_writes_and_rewrites_touched_buckets_only(spark, store):
    base = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    assert upsert_table(store, "t", base, ["k"], buckets=16) == 1
    before = store._entry("t")[1]["folders"]
    changes = table(spark, [(3, "new"), (1000, "added"), (None, "no key")])
    assert upsert_table(store, "t", changes, ["k"]) == 2
    touched = {str(r[0]) for r in changes.select(bucket_of(["k"], 16)).collect()}
    after = store._entry("t")[1]["folders"]
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < 16
    wanted = [(i, "new" if i == 3 else f"v{i}") for i in range(200)] + [(1000, "added"), (None, "no key")]
    assert rows(store.read("t")) == sorted(wanted, key=repr)
    assert rows(store.read("t", 1)) == sorted([(i, f"v{i}") for i in range(200)], key=repr)
    upsert_table(store, "t", table(spark, [(None, "again")]), ["k"])
    assert [r["v"] for r in store.read("t").filter("k IS NULL").collect()] == ["again"]


def test_highest_version_wins_and_columns_are_added(spark, store):
    upsert_table(store, "t", table(spark, [(1, "a"), (2, "b")]), ["k"], buckets=4)
    more = table(spark, [(1, "old", 1), (1, "new", 2), (3, "c", 1)], "k int, v string, n int")
    upsert_table(store, "t", more, ["k"], version="n")
    assert store.read("t").dtypes == [("k", "bigint"), ("v", "string"), ("n", "int")]
    assert rows(store.read("t")) == [(1, "new", 2), (2, "b", None), (3, "c", 1)]


def test_a_run_that_ends_before_the_commit_changes_nothing(spark, store):
    upsert_table(store, "t", table(spark, [(1, "a")]), ["k"], buckets=4)
    store.stage_upsert("t", table(spark, [(1, "lost"), (2, "lost")]))  # the run ends here
    again = BucketStore(spark, store.path)
    assert rows(again.read("t")) == [(1, "a")] and again.versions() == [1]
    assert again.vacuum(1) == 1 and rows(again.read("t")) == [(1, "a")]


def test_the_slower_of_two_writers_is_told(spark, store):
    upsert_table(store, "t", table(spark, [(1, "a")]), ["k"], buckets=4)
    first, second = (store.stage_upsert("t", table(spark, [(1, v)])) for v in ("x", "y"))
    assert store.commit(first) == 2
    with pytest.raises(Conflict):
        store.commit(second)
    assert rows(store.read("t")) == [(1, "x")]


def test_two_tables_change_together(spark, store):
    items = table(spark, [("c", "i1", 5)], "collection string, id string, cloud int")
    publish_catalog(store, items, table(spark, [("c", "first")], "id string, title string"), buckets=4)
    staged = store.stage_upsert("items", items.withColumn("cloud", F.lit(9)))
    assert rows(store.read("items")) == [("c", "i1", 5)]
    store.commit(staged, store.stage_upsert("collections", table(spark, [("c", "second"), ("d", None)], "id string, title string")))
    assert store.versions() == [1, 2] and rows(store.read("items")) == [("c", "i1", 9)]
    assert rows(store.read("collections")) == [("c", "second"), ("d", None)] and rows(store.read("collections", 1)) == [("c", "first")]
    with pytest.raises(ValueError):
        store.commit(*[store.stage_upsert("items", items)] * 2)


def test_pending_results_are_appended_once(spark, store):
    done = table(spark, [(1, None), (2, "timeout"), (3, "")], "k long, error string")
    store.commit(store.stage_table("r", done, ["k"], 4))
    results = table(spark, [(1, None), (2, None), (4, None)], "k long, error string")
    append_pending(store, "r", results)
    wanted = sorted([(1, None), (2, None), (2, "timeout"), (3, ""), (4, None)], key=repr)
    assert rows(store.read("r")) == wanted
    append_pending(store, "r", results)
    assert rows(store.read("r")) == wanted
    with pytest.raises(ValueError):
        store.stage_append("r", table(spark, [(1, "x")]))


def test_refreshed_columns_replace_stored_ones(spark, store):
    upsert_table(store, "t", table(spark, [(1, "a"), (2, "b")]), ["k"], buckets=4)
    refresh_columns(store, "t", table(spark, [(1, 7), (9, 8)], "k long, n int"))
    refresh_columns(store, "t", table(spark, [(2, 5)], "k long, n int"))
    assert rows(store.read("t")) == [(1, "a", None), (2, "b", 5)] and rows(store.read("t", 2)) == [(1, "a", 7), (2, "b", None)]


def test_empty_tables_and_changes(spark, store):
    none = table(spark, [])
    upsert_table(store, "t", none, ["k"], buckets=4)
    assert rows(store.read("t")) == [] and store.read("t").columns == ["k", "v"]
    upsert_table(store, "t", none, ["k"])
    upsert_table(store, "t", table(spark, [(1, "a")]), ["k"])
    assert rows(store.read("t")) == [(1, "a")]
    for wrong in (lambda: store.read("other"), lambda: store.read("t", 99), lambda: store.stage_table("u", none, ["x"]), lambda: store.vacuum(0)):
        with pytest.raises(ValueError):
            wrong()


def test_vacuum_keeps_what_the_last_versions_name(spark, store):
    for n in range(5):
        upsert_table(store, "t", table(spark, [(n, "a"), (0, f"v{n}")]), ["k"], buckets=4)
    store.vacuum(2)
    assert store.versions() == [4, 5]
    assert rows(store.read("t")) == [(0, "v4")] + [(n, "a") for n in range(1, 5)]
    assert len(store.read("t", 4).collect()) == 4


def test_stream_rewrites_touched_buckets_and_skips_replayed_batches(spark, store, tmp_path):
    schema = "k long, v string"
    for n, batch in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        table(spark, batch).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    live.stream_upsert_table(stream, store, "live", ["k"], lambda df: df, f"{tmp_path}/cp").awaitTermination(120)
    wanted = [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.read("live")) == wanted and store.mark("stream:live") == 1 and store.versions() == [1, 2]
    # the same batches again, as after a lost checkpoint: they are in force already
    live.stream_upsert_table(stream, store, "live", ["k"], lambda df: df, f"{tmp_path}/cp2").awaitTermination(120)
    assert rows(store.read("live")) == wanted and store.versions() == [1, 2]

"""Tables by key bucket: a change rewrites only the buckets it touches, and readers see all of it or nothing.

A store is a folder in which ``data`` holds Parquet folders that are never changed, and ``versions`` one small JSON
file per version: for each table its key, schema and the folders of each bucket.  Changes are staged (written
beside the data) and take effect with the next version file, for several tables at once.  A run that ends before leaves the
version before it in force; what it wrote is dropped by ``vacuum``.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loamframe.operators import keys

FOLDER, BUCKET = "_folder", "_bucket"


class Conflict(RuntimeError):
    """Somebody else wrote a version since the change was staged."""


@dataclass(frozen=True)
class Staged:
    """A written change of one table that is not in force yet."""
    table: str
    based_on: int
    entry: dict


class BucketStore:
    """Versioned tables in one folder, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return 0, {"tables": {}, "marks": {}}
        if version not in known:
            raise ValueError(f"no version {version} in {self.path}")
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def commit(self, *staged: Staged, marks: dict[str, int] | None = None) -> int:
        """Put staged changes of one or more tables in force together; returns the new version.

        ``marks`` are numbers kept with the version (the last batch of a stream).  Raises ``Conflict`` when a version
        was written since a change was staged: stage it again then.
        """
        latest, manifest = self._manifest()
        if len({s.table for s in staged}) != len(staged):
            raise ValueError("one change per table and version")
        if any(s.based_on != latest for s in staged):
            raise Conflict(f"version {latest} was written meanwhile")
        manifest["tables"].update({s.table: s.entry for s in staged})
        manifest["marks"].update(marks or {})
        folder, number = f"{self.path}/versions", latest + 1
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{number:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        # a rename is one step; where the name is taken, somebody was faster
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {number} was written meanwhile")
        return number

    def mark(self, name: str) -> int | None:
        """A number kept by ``commit``."""
        return self._manifest()[1]["marks"].get(name)

    # --- reading ------------------------------------------------------------
    def _entry(self, table: str, version: int | None = None) -> tuple[int, dict]:
        number, manifest = self._manifest(version)
        if table not in manifest["tables"]:
            raise ValueError(f"no table {table!r} in version {number} of {self.path}")
        return number, manifest["tables"][table]

    def _rows(self, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        live: dict[str, list[int]] = {}
        for b, names in entry["folders"].items():
            if buckets is None or int(b) in buckets:
                for name in names:
                    live.setdefault(name, []).append(int(b))
        if not live:
            return self.spark.createDataFrame([], schema)
        # folder and bucket are partitions: a literal predicate on them opens the live buckets only
        stored = T.StructType([*schema, T.StructField(FOLDER, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        found = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{FOLDER}={name}" for name in live])
        wanted = [(F.col(FOLDER) == name) & F.col(BUCKET).isin(sorted(held)) for name, held in live.items()]
        return found.filter(functools.reduce(operator.or_, wanted)).drop(FOLDER, BUCKET)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table, of the latest or an earlier version."""
        return self._rows(self._entry(table, version)[1])

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(version)[1]["tables"])

    # --- changes ------------------------------------------------------------
    def _write(self, df: DataFrame, key: list[str], buckets: int) -> tuple[str, list[int]]:
        """Rows in a new folder by bucket; large buckets become several files, small ones share tasks."""
        name = uuid.uuid4().hex
        placed = df.withColumn(BUCKET, bucket_of(key, buckets))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{FOLDER}={name}")
        found = [status.getPath().getName() for status in self._fs.listStatus(self._path(f"{self.path}/data/{FOLDER}={name}"))]
        return name, [int(n.split("=")[1]) for n in found if n.startswith(f"{BUCKET}=")]

    def stage_table(self, table: str, df: DataFrame, key: list[str], buckets: int = 64) -> Staged:
        """A new table, or all rows of a known one anew."""
        if {FOLDER, BUCKET} & set(df.columns) or set(key) - set(df.columns) or not key:
            raise ValueError(f"a table needs its key columns and no column {FOLDER} or {BUCKET}")
        latest = self._manifest()[0]
        name, filled = self._write(df, key, buckets)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]).jsonValue()
        return Staged(table, latest, {"key": key, "buckets": buckets, "schema": schema, "folders": {str(b): [name] for b in filled}})

    def stage_upsert(self, table: str, updates: DataFrame, version: str | None = None) -> Staged:
        """Insert or update by key; of rows with one key the highest ``version`` column wins.

        Reads and writes only the buckets that hold a key of ``updates``.  New columns are added (NULL in other rows);
        columns that ``updates`` lacks are NULL in its rows; stored types stay.  NULL keys are equal to each other.
        """
        latest, entry = self._entry(table)
        stored = {f.name: f.dataType for f in T.StructType.fromJson(entry["schema"])}
        typed = updates.select(*[F.col(f"`{c}`").cast(stored[c]).alias(c) if c in stored else F.col(f"`{c}`") for c in updates.columns])
        newest = keys.last_per_key(typed, entry["key"], version)
        place = bucket_of(entry["key"], entry["buckets"])
        touched = {r[0] for r in newest.select(place.alias("b")).distinct().collect()}  # at most as many as buckets
        old, fresh = self._rows(entry, touched), newest.select(*[F.col(f"`{k}`").alias(f"_new_{k}") for k in entry["key"]])
        same = functools.reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_new_{k}`")) for k in entry["key"]])
        kept = old.join(fresh, same, "left_anti")
        merged = kept.unionByName(newest, allowMissingColumns=True)
        name, filled = self._write(merged, entry["key"], entry["buckets"])
        folders = {b: names for b, names in entry["folders"].items() if int(b) not in touched} | {str(b): [name] for b in filled}
        fields = {f.name: T.StructField(f.name, f.dataType, True) for f in merged.schema}
        schema = T.StructType([fields[n] for n in [*stored, *[n for n in fields if n not in stored]]])
        return Staged(table, latest, entry | {"folders": folders, "schema": schema.jsonValue()})

    def stage_append(self, table: str, rows: DataFrame) -> Staged:
        """More rows, nothing rewritten; the columns must be the table's."""
        latest, entry = self._entry(table)
        schema = T.StructType.fromJson(entry["schema"])
        if sorted(rows.columns) != sorted(schema.names):
            raise ValueError(f"columns of {table} are {schema.names}")
        ready = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        name, filled = self._write(ready, entry["key"], entry["buckets"])
        folders = {b: list(names) for b, names in entry["folders"].items()}
        for b in filled:
            folders.setdefault(str(b), []).append(name)
        return Staged(table, latest, entry | {"folders": folders})

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` versions and every folder that none of them names; returns the folders dropped.

        To be run while nobody stages a change: staged folders are not named yet.
        """
        if keep < 1:
            raise ValueError("keep at least one version")
        known = self.versions()
        named = {name for v in known[-keep:] for entry in self._manifest(v)[1]["tables"].values() for names in entry["folders"].values() for name in names}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{v:012d}.json"), False)
        data = self._path(f"{self.path}/data")
        stale = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName().removeprefix(f"{FOLDER}=") not in named] if self._fs.exists(data) else []
        for folder in stale:
            self._fs.delete(folder, True)
        return len(stale)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")


# --- sinks on a store ---------------------------------------------------------
def upsert_table(store: BucketStore, table: str, updates: DataFrame, key: list[str], version: str | None = None, buckets: int = 64) -> int:
    """Insert or update by key; the table is made where it is not there yet."""
    if table in store.tables():
        return store.commit(store.stage_upsert(table, updates, version))
    return store.commit(store.stage_table(table, keys.last_per_key(updates, key, version), key, buckets))


def append_pending(store: BucketStore, table: str, results: DataFrame, error: str = "error") -> int:
    """Append the results whose key is not stored without an error yet, so a repeated run adds nothing twice."""
    _, entry = store._entry(table)
    done = store.read(table).filter(F.col(error).isNull() | (F.col(error) == "")).select(*entry["key"])
    return store.commit(store.stage_append(table, results.join(done, entry["key"], "left_anti")))


def publish_catalog(store: BucketStore, items: DataFrame, collections: DataFrame, version: str | None = None, buckets: int = 64) -> int:
    """Items and collections of a catalogue, upserted and put in force in one step."""
    staged = []
    for table, df, key, by in (("items", items, ["collection", "id"], version), ("collections", collections, ["id"], None)):
        if table in store.tables():
            staged.append(store.stage_upsert(table, df, by))
        else:
            staged.append(store.stage_table(table, keys.last_per_key(df, key, by), key, buckets))
    return store.commit(*staged)


def refresh_columns(store: BucketStore, table: str, additions: DataFrame) -> int:
    """Columns looked up by the table's key and stored with it, in place of stored ones of the same name."""
    _, entry = store._entry(table)
    added = [c for c in additions.columns if c not in entry["key"]]
    rest = store.read(table).drop(*added)
    one = keys.last_per_key(additions, entry["key"], None)
    return store.commit(store.stage_table(table, rest.join(one, entry["key"], "left"), entry["key"], entry["buckets"]))

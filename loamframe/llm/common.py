"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamframe import session
from loamframe.session import shared_folder

__all__ = ["durable", "new_folder", "stage_folders", "small_batches", "worker_cache", "byte_slices", "passed_on", "word_list", "let", "WORD_SEPARATORS"]

#: ``[\x20\x09-\x0D]``: what separates words in every contract but the benchmark's.  ``bytes.split()`` cuts at the same bytes.
WORD_SEPARATORS = " \t\n\x0b\f\r"


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of a fresh folder in the shared store."""
    return f"{shared_folder(spark).rstrip('/')}/loamframe-{kind}-{uuid.uuid4().hex}"


#: Folders written inside the stage that ran last; a list that is being filled while a stage is open.
_FOLDERS: dict[str, list[str]] = {"done": [], "open": []}


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back (see ``session.durable``)."""
    out = session.durable(df)
    if _FOLDERS["open"]:
        _FOLDERS["open"].extend(out._jdf.inputFiles()[:1] or [])
    return out


@contextlib.contextmanager
def stage_folders(spark: SparkSession):
    """A stage of a pipeline: folders that the stage before it wrote for itself are deleted as this one begins.

    By then that stage's result is written (the stages' contract), so nothing reads them any more.
    """
    for file in _FOLDERS["done"]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _FOLDERS["done"], _FOLDERS["open"] = [], [""]
    try:
        yield
    finally:
        _FOLDERS["done"], _FOLDERS["open"] = [f for f in _FOLDERS["open"] if f], []


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes from here on, unless the session has less.

    Spark's defaults (10 000 rows, 64 MB) are held several times over by a task's JVM and Python sides.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def worker_cache(key: str) -> dict:
    """A dictionary that lives as long as the Python worker (tasks of one worker share it)."""
    import sys
    import types

    holder = sys.modules.setdefault("loamframe_worker_cache", types.ModuleType("loamframe_worker_cache"))
    return holder.__dict__.setdefault(key, {})


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start, n = np.cumsum(sizes, dtype=np.int64), 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop


def passed_on(columns: list[str], own: set[str]) -> list[str]:
    """Columns that an operator hands on: one with the name of a column of the operator's own gives way."""
    return [c for c in columns if c.lower() not in own]


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas Spark would compute it for every element."""
    return F.transform(F.array(value), body)[0]

"""Vectors as codes of codebook entries, in exact integer arithmetic (operator 11).

Parts of vectors and codebook entries are zero-padded to a power of two and go through an integer Walsh-Hadamard
transform, which multiplies squared distances by that power.  Squared differences are added up in sequency order (fewest sign
changes first); a partial sum is a lower bound, so an entry above the distance of a first guess is dropped early and ties survive.
Integers that 64 bits may not hold go the same way as Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamframe.llm.common import durable, passed_on, small_batches

#: Largest value of a long: errors above it are given as this.
MOST_LONG = (1 << 63) - 1
#: Parts compared at once, and coefficients added before entries are dropped.
AT_ONCE, LEAD = 1024, 3


def padded_width(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def sequency_order(n: int):
    """Rows of the natural transform of ``n`` (a power of two), fewest sign changes first."""
    import numpy as np

    bits = n.bit_length() - 1
    order = np.zeros(n, dtype=np.int64)
    for s in range(n):
        gray = s ^ (s >> 1)
        order[s] = int(format(gray, f"0{bits}b")[::-1], 2) if bits else 0
    return order


def transform(rows):
    """Integer Walsh-Hadamard transform of each row, zero-padded, in sequency order."""
    import numpy as np

    m, width = rows.shape
    n = padded_width(width)
    out = np.zeros((m, n), dtype=rows.dtype)
    out[:, :width] = rows
    step = 1
    while step < n:
        halves = out.reshape(m, -1, 2, step)
        out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(m, n)
        step *= 2
    return out[:, sequency_order(n)]


def safe_bits(width: int) -> int:
    """Integers below this power of two keep all sums of a part of ``width`` components within 62 bits."""
    return (60 - 3 * (padded_width(width).bit_length() - 1)) // 2


def to_integers(values, scale: int = 1024):
    """floor(scale * x) of doubles; Python integers where 64 bits could overflow (``scale`` is a power of two)."""
    import math

    import numpy as np

    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**53:
        return scaled.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def exact(rows, width: int):
    """The rows as 64-bit integers if all sums of them are sure to fit, else as Python integers."""
    import numpy as np

    most = max((abs(int(x)) for x in (rows.max(), rows.min())), default=0) if rows.size else 0
    return rows.astype(np.int64) if most < 1 << safe_bits(width) else rows.astype(object)


def nearest(parts, entries):
    """(index, squared distance) of the nearest entry of each part, ties to the lower index."""
    import numpy as np

    width = parts.shape[1]
    parts, entries = exact(parts, width), exact(entries, width)
    if parts.dtype != entries.dtype:
        parts, entries = parts.astype(object), entries.astype(object)
    own, book = transform(parts), transform(entries)
    n = own.shape[1]
    index, least = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=own.dtype)
    for at in range(0, len(own), AT_ONCE):
        some = own[at : at + AT_ONCE]
        partial = np.zeros((len(some), len(book)), dtype=own.dtype)
        for j in range(min(LEAD, n)):
            gap = some[:, j, None] - book[None, :, j]
            partial += gap * gap
        guess = book[partial.argmin(axis=1)]
        bound = ((some - guess) ** 2).sum(axis=1)
        rows, cols = np.nonzero(partial <= bound[:, None])
        sums = partial[rows, cols]
        for j in range(LEAD, n):
            gap = some[rows, j] - book[cols, j]
            sums = sums + gap * gap
            alive = (sums <= bound[rows]).astype(bool)
            if not alive.all():
                rows, cols, sums = rows[alive], cols[alive], sums[alive]
        # the guess is always among them, so every row has a candidate
        starts = np.searchsorted(rows, np.arange(len(some)))
        best = np.minimum.reduceat(sums, starts)
        ties = np.flatnonzero((sums == best[rows]).astype(bool))
        first = ties[np.searchsorted(rows[ties], np.arange(len(some)))]
        index[at : at + AT_ONCE], least[at : at + AT_ONCE] = cols[first], best // n
    return index, least


def cut(rows, parts: int):
    """Rows in ``parts`` equal consecutive parts; a width that does not divide is filled up with zeros at the end."""
    import numpy as np

    width = -(-rows.shape[1] // parts)
    out = np.zeros((len(rows), width * parts), dtype=rows.dtype)
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), parts, width)


def matrix(column: pa.Array, dimension: int):
    """A list column of lists of ``dimension`` numbers as integers."""
    import numpy as np
    import pyarrow as pa

    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return to_integers(np.asarray(flat).reshape(-1, dimension))


def assign(rows, codebooks, parts: int):
    """(indexes, squared distances) of every part of every row."""
    import numpy as np

    pieces = cut(rows, parts)
    found = [nearest(pieces[:, k], np.array(codebooks[k], dtype=object)) if pieces.shape[2] else
             (np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)) for k in range(parts)]
    return np.stack([f[0] for f in found], axis=1), [f[1] for f in found]


def usable(vector: Column) -> Column:
    """Is the vector there, with finite components only?"""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def train_codebooks(vectors: DataFrame, dimension: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[list[list[int]]]:
    """Integer entries by part, from rows (``_id``, ``_vector``): the first ``entries`` rows by id, then ``rounds`` of means.

    Only sums by part and entry reach the driver: parts x entries rows, whatever the table's size.
    """
    import numpy as np

    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).collect()
    pieces = cut(to_integers(np.array([r["_vector"] for r in first], dtype=np.float64).reshape(len(first), dimension)), parts)
    books = [[[int(x) for x in row] for row in pieces[:, k].tolist()] for k in range(parts)]
    width = pieces.shape[2]
    for _ in range(rounds if width else 0):

        def add_up(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow as pa

            size = len(books[0])
            sums, counts = np.zeros((parts, size, width), dtype=object), np.zeros((parts, size), dtype=np.int64)
            for batch in batches:
                rows = matrix(batch.column("_vector"), dimension)
                pieces, (found, _) = cut(rows, parts), assign(rows, books, parts)
                for k in range(parts):
                    part = exact(pieces[:, k], width)
                    own = np.zeros((size, width), dtype=part.dtype)
                    np.add.at(own, found[:, k], part)
                    sums[k] += own
                    counts[k] += np.bincount(found[:, k], minlength=size)
            used = np.argwhere(counts)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[used[:, 0], used[:, 1]], pa.int64()),
                     pa.array([[str(x) for x in sums[k, e]] for k, e in used], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            key, n, sums = None, 0, [0] * width
            for batch in batches:
                for part, entry, count, more in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "n", "sums"))):
                    key, n, sums = (part, entry), n + count, [a + int(b) for a, b in zip(sums, more)]
            if key:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()),
                                                  pa.array([[str(x) for x in sums]], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

        schema = "part int, entry int, n long, sums array<string>"
        books = [[list(row) for row in book] for book in books]
        for r in vectors.select("_vector").mapInArrow(add_up, schema).groupBy("part", "entry").applyInArrow(total, schema).collect():
            books[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
    return books


def codebook_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components as decimal text, by part, entry and position."""
    import hashlib

    return hashlib.sha256(",".join(str(x) for book in books for row in book for x in row).encode()).hexdigest()


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", keep: list[str] | None = None,
                     parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows, codebooks): ``keep`` (default: all columns), ``code``, ``error`` and ``label_error`` of each usable row.

    Null vectors and vectors with null or non-finite components are left out, and so are those whose length is not the most
    frequent one (of two, the greater), as no codebook fits them.  A length that ``parts`` does not divide is filled up with zeros;
    vectors of length 0 have error 0.  Codebooks start from the rows of the smallest ids (null ids last, equal ids by their vectors);
    with fewer rows they have fewer entries.  ``code`` has two hex digits a part (four above 256 entries), ``error`` is the sum
    of squared integer distances, ``label_error`` its sum over rows of the same label (nulls together); above the largest long they are
    that.  Repeated rows all count.  An empty table gives no rows and empty codebooks.  Columns with result names give way.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = {"code", "error", "label_error", "_id", "_vector", "_label", "_none", "_sum"}
    keep = passed_on(df.columns if keep is None else keep, own)
    source = F.col(f"`{vector}`").cast("array<double>")
    found = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias("_id"), source.alias("_vector"),
                      F.col(f"`{label}`").alias("_label")).where(usable(source))
    sizes = found.groupBy(F.size("_vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = sizes["d"] if sizes else 0
    rows = found.where(F.size("_vector") == dimension)
    books = train_codebooks(rows.select("_id", "_vector"), dimension, parts, entries, rounds)
    digits = 2 if entries <= 256 else 4

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            found, errors = assign(matrix(batch.column("_vector"), dimension) if dimension else _empty(batch.num_rows), books, parts)
            codes = ["".join(f"{x:0{digits}x}" for x in row) for row in found.tolist()]
            sums = [min(sum(int(x) for x in row), MOST_LONG) for row in zip(*errors)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "_label"]), pa.array(codes, pa.string()), pa.array(sums, pa.int64())],
                                             names=[*keep, "_label", "code", "error"])

    schema = rows.drop("_id", "_vector").schema.add("code", "string").add("error", "long")
    coded = durable(rows.drop("_id").mapInArrow(code, schema))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG)).cast("long")
    by_label = coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error"))
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of"))).select(*[F.col(f"`{c}`") for c in keep], "code", "error", "label_error")
    return out, books


def _empty(n: int):
    import numpy as np

    return np.zeros((n, 0), dtype=np.int64)

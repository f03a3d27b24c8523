"""Lines that many documents share, found with two Bloom filters (operator 13).

A task adds the hashes of its lines to a filter of hashes seen once and one of hashes seen twice; filters of tasks are
merged by segments, where a bit seen once on both sides counts as seen twice.  A line in two documents has all its bits in
the merged second filter, so only lines that hit it are shuffled, as themselves, to be counted exactly.  Documents that
lose nothing stay where they are: a filter of those that do picks the few to be joined with their verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, durable, passed_on, small_batches

#: Bits of a segment of a filter; filters have 16 bits a key between these bounds.
SEGMENT, LEAST_BITS, MOST_BITS = 1 << 16, 1 << 20, 1 << 28
#: Hashes that a task holds before it hands out its filters.
HELD = 1 << 20


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and their keys: white space of ASCII stripped at both ends, A-Z lower-cased."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def distinct_keys(keys: list[bytes], least: int) -> list[bytes]:
    """The keys of at least ``least`` code points, in order of first occurrence."""
    return [k for k in dict.fromkeys(keys) if long_enough(k, least)]


def positions(hashes, bits: int):
    """The two bits of each hash (bits are a power of two)."""
    import numpy as np

    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def segments(hashes, counts, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, bits of all hashes, bits of hashes counted twice), compressed; segments without a bit are left out."""
    import zlib

    import numpy as np

    wide = lambda h: np.unique(np.concatenate(positions(h, bits)))
    once, twice = wide(hashes), wide(hashes[counts > 1])
    cuts = np.arange(0, bits + 1, SEGMENT, dtype=np.uint64)
    at, at2 = np.searchsorted(once, cuts), np.searchsorted(twice, cuts)
    for k in np.flatnonzero(np.diff(at)):
        packed = []
        for found, ends in ((once, at), (twice, at2)):
            flags = np.zeros(SEGMENT, dtype=np.uint8)
            flags[(found[ends[k] : ends[k + 1]] - cuts[k]).astype(np.int64)] = 1
            packed.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1))
        yield int(k), packed[0], packed[1]


def merge_segments(pairs) -> tuple[bytes, bytes]:
    """Both filters of a segment from the (seen, seen twice) pairs of many tasks."""
    import zlib

    import numpy as np

    raw = lambda b: np.frombuffer(zlib.decompress(b), dtype=np.uint8)
    once = twice = np.zeros(SEGMENT // 8, dtype=np.uint8)
    for a, b in pairs:
        a, b = raw(a), raw(b)
        once, twice = once | a, twice | b | (once & a)
    return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def filter_bits(keys: int) -> int:
    """Size of a filter: 16 bits a key, a power of two within bounds.  A fuller filter only lets more keys be shuffled."""
    bits = LEAST_BITS
    while bits < min(16 * keys, MOST_BITS):
        bits *= 2
    return bits


def merged_filter(parts: DataFrame, bits: int, twice: bool) -> bytes:
    """One of the two filters as raw bytes (``bits`` / 8) from rows (segment, once, twice)."""
    import zlib

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        number, state = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                number, state = row[0], merge_segments([state, row[1:]] if state else [row[1:]])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([state[twice]], pa.binary())], names=["segment", "bits"])

    out = bytearray(bits // 8)
    for row in parts.groupBy("segment").applyInArrow(merge, "segment int, bits binary").collect():
        out[row["segment"] * SEGMENT // 8 : (row["segment"] + 1) * SEGMENT // 8] = zlib.decompress(row["bits"])
    return bytes(out)


def hit(filter_bytes: bytes, hashes, bits: int):
    """Which hashes have both bits set."""
    import numpy as np

    raw, out = np.frombuffer(filter_bytes, dtype=np.uint8), np.ones(len(hashes), dtype=bool)
    for p in positions(hashes, bits):
        out &= (raw[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def filters_of(rows: DataFrame, hashes_of, bits: int) -> DataFrame:
    """Rows (segment, once, twice) of the filters of all hashes that ``hashes_of(batch)`` gives, a list per row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def flushed(held):
            found, counts = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
            rows = list(segments(found, counts, bits))
            for k in range(0, len(rows), 256):
                number, once, twice = zip(*rows[k : k + 256])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                                                 names=["segment", "once", "twice"])

        held: list[int] = []
        for batch in batches:
            for hashes in hashes_of(batch):
                held += hashes
                if len(held) >= HELD:
                    yield from flushed(held)
                    held = []
        if held:
            yield from flushed(held)

    return rows.mapInArrow(build, "segment int, once binary, twice binary")


def drop_common_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, documents: int = 3,
                      least: int = 20) -> DataFrame:
    """``keep`` (default: all columns), ``n_lines``, ``n_dropped`` and ``kept_text`` of each row.

    Keys of at least ``least`` code points that at least ``documents`` rows hold lose all their lines except in the rows
    with the largest id among the holders; the other lines stay, joined by newlines.  Every row is a document: repeated rows
    count each, and share their verdict.  A null id is below all others; lines that only null ids hold stay.  A null or empty text
    is one empty line and is kept as an empty text.  Texts go through whole, however long.  An empty table gives no rows.
    Columns of ``df`` with result names give way.
    """
    from pyspark.errors import PySparkValueError

    if documents < 2:
        raise PySparkValueError("a common line is one of two documents at least")
    spark = df.sparkSession
    small_batches(spark)
    keep = passed_on(df.columns if keep is None else keep, {"n_lines", "n_dropped", "kept_text", "_id", "_text", "_k1", "_k2", "_lost"})
    body = F.col(f"`{text}`").cast("string")
    full = F.coalesce(body, F.lit(""))
    # 128 bits of hash stand for a text, so rows of equal id and text share a verdict and texts are not stored
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("long").alias("_id"), full.alias("_text"),
                     F.xxhash64(full).alias("_k1"), F.xxhash64(F.lit("second"), full).alias("_k2"))
    texts = base.select("_id", "_text", "_k1", "_k2")
    total = texts.agg(F.sum((F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1))).first()[0] or 0
    bits = filter_bits(total)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[list[int]]:
        from xxhash import xxh64_intdigest

        for t in batch.column("_text").to_pylist():
            yield [xxh64_intdigest(k) for k in distinct_keys(line_keys(t)[1], least)]

    shared = spark.sparkContext.broadcast(merged_filter(filters_of(texts.select("_text"), hashes_of, bits), bits, twice=True))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in byte_slices(batches, "_text"):
            found, rows = [], []
            for k, t in enumerate(batch.column("_text").to_pylist()):
                keys = distinct_keys(line_keys(t)[1], least)
                hashes = np.array([xxh64_intdigest(x) for x in keys], dtype=np.uint64)
                for i in np.flatnonzero(hit(shared.value, hashes, bits)):
                    rows.append(k)
                    found.append((int(i), keys[i].decode()))
            own = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("_id", "_k1", "_k2")), pa.array([f[0] for f in found], pa.int32()),
                                              pa.array([f[1] for f in found], pa.string())], names=["_id", "_k1", "_k2", "nth", "key"])

    suspects = durable(texts.mapInArrow(suspected, "_id long, _k1 long, _k2 long, nth int, key string"))
    common = durable(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("_id").alias("holder")).where(F.col("n") >= documents).drop("n"))
    lost = suspects.join(common, "key").where(~F.col("_id").eqNullSafe(F.col("holder")))
    lost = durable(lost.groupBy("_id", "_k1", "_k2").agg(F.collect_set("nth").alias("_lost")))

    own_bits = filter_bits(lost.count())
    keys_of = lambda batch: ([k & 0xFFFFFFFFFFFFFFFF] for k in batch.column("_k1").to_pylist())
    losers = spark.sparkContext.broadcast(merged_filter(filters_of(lost.select("_k1"), keys_of, own_bits), own_bits, twice=False))
    out_schema = base.drop("_id", "_text", "_k1", "_k2").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")

    def split(losing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                hashes = batch.column("_k1").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                part = batch.filter(pa.array(hit(losers.value, hashes, own_bits) == losing))
                if losing:
                    yield part
                elif part.num_rows:
                    lines = pa.array([t.count("\n") + 1 for t in part.column("_text").to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lines, pa.array([0] * part.num_rows, pa.int64()), part.column("_text")],
                                                     names=[*keep, "n_lines", "n_dropped", "kept_text"])

        return run

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in byte_slices(batches, "_text"):
            counted, dropped, kept = [], [], []
            for t, gone in zip(batch.column("_text").to_pylist(), batch.column("_lost").to_pylist()):
                lines, keys = line_keys(t)
                if gone:
                    named = distinct_keys(keys, least)
                    away = {named[i] for i in gone}
                    stay = [x for x, k in zip(lines, keys) if k not in away]
                else:
                    stay = lines
                counted.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counted, pa.int64()), pa.array(dropped, pa.int64()),
                                              pa.array(kept, pa.string())], names=[*keep, "n_lines", "n_dropped", "kept_text"])

    whole = base.mapInArrow(split(False), out_schema)
    asked = base.mapInArrow(split(True), base.schema).alias("d")
    lost = lost.alias("v")
    same = F.col("d._id").eqNullSafe(F.col("v._id")) & (F.col("d._k1") == F.col("v._k1")) & (F.col("d._k2") == F.col("v._k2"))
    cut = asked.join(lost, same, "left").select("d.*", "v._lost").mapInArrow(without, out_schema)
    return whole.unionByName(cut)


"""Repeated passages by recompression (operator 10).

The method shortens the word sequence in rounds: symbols fall into left and right ones by a hash of their name, and a
left symbol followed by a right one becomes one symbol named by the pair.  Names are 64-bit hashes of what they stand
for, so equal contents get equal names in every task without a table of names.  A round joins only symbols of at most
h words (``schedule``).  Whether two symbols join depends on these two alone, hence a round blurs at most h words at
either end of a repeated window; a window of W words keeps a boundary of the last round among its first S + 1
words, S being the sum of all h, S <= (W - 1) / 2, wherever the window stands.  Equal neighbours (runs) never
join: a name for a whole run would depend on words outside the window.

Round 1 over the corpus: the W - S words after each symbol's start form its key; keys found at two places or more are
the repeated symbols.  Round 2: the windows around a repeated symbol are compared by two 64-bit hashes of their W
words, made of two hashes of each word over different polynomials.  Both rounds exchange sorted arrays of hashes for each pair of a chunk of texts and a bucket of hash
values, and send back one bit for each entry.  Within a chunk equal hashes are one entry, so a passage in a third of
all documents reaches a bucket once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, durable, passed_on, small_batches, WORD_SEPARATORS
from loamframe.llm.hashing import SECOND_BASE, SEQUENCE_BASE, Words, mix, range_hashes, separator_table

ENTRIES = "chunk string, kind int, bucket int, entries binary, several binary"
FLAGS = "chunk string, kind int, bucket int, flags binary"
SYMBOLS, WINDOWS = 1, 2


def schedule(window: int) -> list[int]:
    """Largest symbol that joins in each round; the sum is at most (window - 1) / 2."""
    out, size = [], 1.0
    while sum(out) + round(size) <= (window - 1) // 2:
        out.append(round(size))
        size *= 1.45
    return out


def symbol_starts(hashes: np.ndarray, owner: np.ndarray, rounds: list[int]) -> np.ndarray:
    """First word of each symbol of the last round; symbols never join across texts."""
    names, length, at = mix(hashes), np.ones(len(hashes), dtype=np.int32), np.arange(len(hashes))
    for level, most in enumerate(rounds, start=1):
        side = (mix(names + np.uint64(level)) >> np.uint64(63)).astype(bool)
        small = length <= most
        joins = side[:-1] & ~side[1:] & small[:-1] & small[1:] & (owner[at[:-1]] == owner[at[1:]])
        left = np.flatnonzero(joins)
        names[left] = mix(names[left] * np.uint64(SEQUENCE_BASE) + (names[left + 1] ^ np.uint64(level)))
        length[left] += length[left + 1]
        kept = np.ones(len(names), dtype=bool)
        kept[left + 1] = False
        names, length, at = names[kept], length[kept], at[kept]
    return at


class Chunk:
    """Words of one chunk and its hashes of either kind, as sorted distinct entries."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.words = window, Words(texts, separator_table(WORD_SEPARATORS.encode()), twice=True)
        self.owner = self.words.text_of_word()
        self.last = self.words.first[1:][self.owner] if len(self.owner) else self.owner  # end of the word's text

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sorted distinct keys, entry of each start)."""
        rounds = schedule(self.window)
        size = self.window - sum(rounds)
        starts = symbol_starts(self.words.hashes, self.owner, rounds)
        starts = starts[starts + size <= self.last[starts]]
        keys = range_hashes(self.words.hashes, starts, starts + size, SEQUENCE_BASE)
        entries, place = np.unique(keys, return_inverse=True)
        return starts, entries, place

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the windows around repeated symbols, distinct two-part entries, entry of each start)."""
        reach, n = sum(schedule(self.window)), len(self.words)
        ahead = np.zeros(n + 1, dtype=np.int64)
        np.add.at(ahead, np.maximum(repeated - reach, self.words.first[self.owner[repeated]]), 1)
        np.add.at(ahead, repeated + 1, -1)
        starts = np.flatnonzero(np.cumsum(ahead[:n]) > 0)
        starts = starts[starts + self.window <= self.last[starts]]
        first = range_hashes(self.words.hashes, starts, starts + self.window, SEQUENCE_BASE)
        second = range_hashes(self.words.others, starts, starts + self.window, SECOND_BASE)
        both = np.rec.fromarrays([first, second], dtype=[("a", "<u8"), ("b", "<u8")])
        order = np.lexsort((second, first))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(fresh) - 1
        return starts, np.asarray(both)[order][fresh], place

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in a window that begins at one of ``starts``."""
        step = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _bucket_edges(first: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of hash values begins in sorted ``first``."""
    width = -(-(1 << 64) // buckets)
    return np.searchsorted(first, np.array([width * k for k in range(buckets)], dtype=np.uint64)).tolist() + [len(first)]


def _entry_rows(chunk: str, kind: int, entries: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    several = np.bincount(place, minlength=len(entries)) > 1
    edges = _bucket_edges(entries if kind == SYMBOLS else entries["a"], buckets)
    rows = [(b, entries[i:j].tobytes(), np.packbits(several[i:j]).tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
    n = len(rows)
    return pa.RecordBatch.from_arrays([
        pa.array([chunk] * n, pa.string()), pa.array([kind] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
        pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "kind", "bucket", "entries", "several"])


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: a bit for each entry of each chunk, set if it occurs at two places or more."""
    import numpy as np
    import pyarrow as pa

    kind = table.column("kind")[0].as_py()
    dtype = np.dtype("<u8") if kind == 1 else np.dtype([("a", "<u8"), ("b", "<u8")])
    parts = [np.frombuffer(x, dtype) for x in table.column("entries").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("several").to_pylist(), parts)]
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable") if kind == 1 else np.lexsort((values["b"], values["a"]))
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.concatenate(several)
    again = np.zeros(len(values), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    flags[order] |= again
    # an entry that is several in one chunk stands at two places itself; elsewhere it has an equal neighbour
    stops = np.cumsum([len(p) for p in parts]).tolist()
    bits = [np.packbits(flags[i:j]).tobytes() for i, j in zip([0, *stops], stops)]
    return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"),
                     "flags": pa.array(bits, pa.binary())})


def _flagged(entries: np.ndarray, kind: int, flags: dict[int, bytes], buckets: int) -> np.ndarray:
    edges, out = _bucket_edges(entries if kind == SYMBOLS else entries["a"], buckets), np.zeros(len(entries), dtype=bool)
    for b, bits in flags.items():
        i, j = edges[b], edges[b + 1]
        out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    return out


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def remove_repeats(df: DataFrame, text: str = "text", window: int = 35, chunk_bytes: int = 4 << 20) -> DataFrame:
    """All rows of ``df`` with ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if a window of ``window`` words of one text covers it whose words also start anywhere else (the same
    text included), judged on the input.  ``kept_text``: the kept words joined by one space; a null or empty text has
    none and gives "".  Repeated rows are texts of their own.  Columns of ``df`` with result names
    give way.  An empty table gives none.
    """
    df = df.select(*[F.col(f"`{c}`") for c in passed_on(df.columns, {"n_words", "n_removed", "kept_text"})])
    small_batches(df.sparkSession)
    spark = df.sparkSession
    column = df.columns.index(text)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow as pa

        named = (b.rename_columns([str(i) for i in range(b.num_columns)]) for b in batches)
        for batch in byte_slices(named, str(column), chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([_pack(batch)], pa.binary())], names=["chunk", "rows"])

    chunks = durable(df.mapInArrow(chunked, "chunk string, rows binary"))
    # a bucket holds the entries of about eight chunks, a chunk's own hashes being some 2 MB
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 8)

    def texts_of(batch: pa.RecordBatch) -> list[bytes]:
        return [(t or "").encode() for t in batch.column(column).to_pylist()]

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, entries, place = Chunk(texts_of(_unpack(blob.as_py())), window).symbols()
                yield _entry_rows(name, SYMBOLS, entries, place, buckets)

    def repeated_windows(chunk: Chunk, flags: dict) -> tuple:
        starts, entries, place = chunk.symbols()
        found = _flagged(entries, SYMBOLS, flags.get(SYMBOLS, {}), buckets)
        return chunk.windows(starts[found[place]])

    def with_flags(flags: DataFrame) -> DataFrame:
        each = flags.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "flags")).alias("flags"))  # a chunk's own bits
        return chunks.join(each, "chunk", "left")

    def of_row(value) -> dict:
        out: dict = {}
        for item in value or ():
            out.setdefault(item["kind"], {})[item["bucket"]] = item["flags"]
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob, flags in zip(batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("flags")):
                chunk = Chunk(texts_of(_unpack(blob.as_py())), window)
                _, entries, place = repeated_windows(chunk, of_row(flags.as_py()))
                yield _entry_rows(name, WINDOWS, entries, place, buckets)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for blob, flags in zip(batch.column("rows"), batch.column("flags")):
                rows, flags = _unpack(blob.as_py()), of_row(flags.as_py())
                texts = texts_of(rows)
                chunk = Chunk(texts, window)
                starts, entries, place = repeated_windows(chunk, flags)
                found = _flagged(entries, WINDOWS, flags.get(WINDOWS, {}), buckets)
                gone, first = chunk.covered(starts[found[place]]), chunk.words.first
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                out = []
                for k, t in enumerate(texts):
                    words = t.split()
                    if removed[k]:
                        words = [w for w, g in zip(words, gone[first[k] : first[k + 1]].tolist()) if not g]
                    out.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                    names=[*names, "n_words", "n_removed", "kept_text"])

    names = df.columns
    symbol_flags = durable(chunks.mapInArrow(symbols, ENTRIES).groupBy("bucket").applyInArrow(_repeats, FLAGS))
    window_flags = durable(with_flags(symbol_flags).mapInArrow(windows, ENTRIES).groupBy("bucket").applyInArrow(_repeats, FLAGS))
    schema = df.select("*").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return with_flags(symbol_flags.unionByName(window_flags)).mapInArrow(kept, schema)

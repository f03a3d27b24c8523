"""Token-id files (operator 2): independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a row of zstandard frames, then a skippable frame with an index in JSON, then the seek table of the public
seekable format (skippable frame 0x184D2A5E, magic 0x8F92EAB1, the low 32 bits of each frame's XXH64).  A frame holds
whole documents: their number, null flags, ids and lengths, then all token ids, little-endian.  A reader opens the
seek table and decompresses only the frames it needs.

Files are made under a name of their own and come into being by a rename, so a task that is run again leaves nothing
half written; the index table names the files that count.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loamframe.llm.common import byte_slices, durable, small_batches
from loamframe.llm.tokens import WordEncoder, load

SEEK_FRAME, SEEK_MAGIC, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
INDEX = "file string, part int, frame int, doc_id long, frame_row int, file_start long, n_tokens long"


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder or file that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


class FrameWriter:
    """Appends documents; a frame is closed when its ids reach ``frame_bytes``."""

    def __init__(self, sink, dtype: str, frame_bytes: int, level: int):
        import zstandard

        self.sink, self.dtype, self.frame_bytes = sink, dtype, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames, self.entries, self.start, self.docs, self.held = [], [], 0, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> tuple[int, int, int, int]:
        """(frame, row in it, tokens before it in the file, tokens)."""
        n = len(ids) // int(self.dtype[-1])
        place = (len(self.frames), len(self.docs), self.start, n)
        self.docs.append((doc_id, ids, n))
        self.start, self.held = self.start + n, self.held + len(ids)
        if self.held >= self.frame_bytes:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        import numpy as np
        import xxhash

        if not self.docs:
            return
        ids, counts = [d[0] for d in self.docs], [d[2] for d in self.docs]
        data = b"".join([
            struct.pack("<I", len(ids)), bytes(i is None for i in ids), np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array(counts, "<u8").tobytes(), *(d[1] for d in self.docs)])
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.frames.append({"documents": len(ids), "tokens": sum(counts), "first": ids[0], "last": ids[-1]})
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.close_frame()
        index = json.dumps({"dtype": self.dtype, "frames": self.frames}).encode()
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        entries = [*self.entries, (8 + len(index), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.sink.close()


class FrameReader:
    """Documents of one file, frame by frame or only those of given frames."""

    def __init__(self, uri: str):
        import zstandard

        store, path = filesystem(uri)
        self.source, self.zstd = store.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        table = self.source.read_at(12 * n, size - 9 - 12 * n)
        self.entries, self.offsets, at = list(struct.iter_unpack("<III", table)), [], 0
        for packed, _, _ in self.entries:
            self.offsets.append(at)
            at += packed
        self.index = json.loads(self.source.read_at(self.entries[-1][0] - 8, self.offsets[-1] + 8))

    def frame(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        """(document id, little-endian ids) of each document of frame ``k``; raises when its checksum is wrong."""
        import numpy as np
        import xxhash

        packed, size, checksum = self.entries[k]
        data = self.zstd.decompress(self.source.read_at(packed, self.offsets[k]), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: wrong checksum")
        n, width = struct.unpack_from("<I", data)[0], int(self.index["dtype"][-1])
        nulls, at = data[4 : 4 + n], 4 + n
        ids, counts = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n)
        at += 16 * n
        for null, doc_id, count in zip(nulls, ids.tolist(), counts.tolist()):
            yield None if null else doc_id, data[at : at + count * width]
            at += count * width

    def close(self) -> None:
        self.source.close()


def write_token_store(
    df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text", words_apart: bool = True,
    frame_bytes: int = 256 << 10, level: int = 3,
) -> DataFrame:
    """Encode every whole text and write the files; returns the index, one row per document in its file.

    Documents are ordered by ``id_col`` (nulls first), equal ids by the hash of their text; files follow in that order.
    A null or empty text is a document of ``end_id`` alone, repeated rows are written each, an empty table gives no
    file.  ``words_apart``: the vocabulary drops white space (``WordEncoder``); else whole texts go to the library.
    Other columns do not matter.  One range exchange of the texts; a task holds one batch of 4 MB and one frame.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        tokenizer = load(path)
        dtype = "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype).tobytes()
        encode = WordEncoder(path, dtype) if words_apart else None
        store, root = filesystem(folder)
        name = f"tokens-{part:06d}-{mark}.zst"
        writer = None
        for batch in byte_slices(batches, "text"):
            if writer is None:
                store.create_dir(root, recursive=True)
                writer = FrameWriter(store.open_output_stream(f"{root}/.{name}", compression=None), dtype, frame_bytes, level)
            texts = batch.column("text").to_pylist()
            if encode:
                encoded = encode(texts)
            else:
                found = tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
                encoded = [np.array(e.ids, dtype).tobytes() for e in found]
            ids = batch.column("doc_id").to_pylist()
            places = [writer.add(i, e + end) for i, e in zip(ids, encoded)]
            n = len(ids)
            frame, row, start, tokens = zip(*places)
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{folder.rstrip('/')}/{name}"] * n), pa.array([part] * n, pa.int32()), pa.array(frame, pa.int32()),
                pa.array(ids, pa.int64()), pa.array(row, pa.int32()), pa.array(start, pa.int64()), pa.array(tokens, pa.int64())],
                names=["file", "part", "frame", "doc_id", "frame_row", "file_start", "n_tokens"])
        if writer is not None:
            writer.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")

    return durable(ordered.mapInArrow(write, INDEX))


def files_of(index: DataFrame) -> DataFrame:
    """file, part, n_tokens and ``base``, the tokens of all files before; as many rows as files."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_store(index: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 (over unsigned 32-bit little-endian ids)."""
    files = durable(files_of(index))
    spread = files.repartition(max(1, files.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                reader = FrameReader(file)
                dtype = reader.index["dtype"]
                for k in range(len(reader.index["frames"])):
                    out = []
                    for doc_id, ids in reader.frame(k):
                        tokens = np.frombuffer(ids, dtype).astype("<u4")
                        out.append((doc_id, start, len(tokens), zlib.crc32(tokens.tobytes())))
                        start += len(tokens)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_documents(index: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array) of the wanted documents; only their frames are decompressed."""
    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    places = index.join(ids, "doc_id", "left_semi").select("file", "frame", "frame_row")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

        reader, opened, held, frame = None, None, None, []
        for batch in batches:
            rows = []
            for file, k, row in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "frame_row"))):
                if file != opened:
                    reader, opened, held = FrameReader(file), file, None
                if k != held:
                    held, frame = k, list(reader.frame(k))
                doc_id, ids = frame[row]
                rows.append((doc_id, np.frombuffer(ids, reader.index["dtype"]).tolist()))
            if rows:
                yield out(rows)

    near = places.repartition("file", "frame").sortWithinPartitions("file", "frame", "frame_row")
    return near.mapInArrow(read, "doc_id long, ids array<long>")

"""WARC archives through a chunked record table (operator 6).

``record_chunks`` turns payloads into rows (record_id, chunk_no, data): a payload above the chunk size is many rows,
so neither the writer nor the reader ever holds a whole record.  The writer streams these rows into gzip members of WARC/1.1
files, the reader streams them out again and carries a running SHA-256, so each chunk row has the digest of the
payload so far and the last one that of the whole; it is held against the record's header.

Files get their name by a rename, and the table the writer returns names those that count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import durable, small_batches
from loamframe.llm.token_store import filesystem

CHUNKS = ("record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "chunk_no int, n_chunks int, data binary")
READ = ("record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, "
        "is_last boolean, running_digest string, data binary")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def decide_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``pages`` (record_id, uri, payload binary) with payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads of at least ``least_bytes`` the smallest record_id is response (each row of it, if
    it repeats), others revisit it.  Records without id are response.  Columns with names of results give way.  The first ids are gathered per digest with
    partial sums, and a digest that many records share is one row on the right of the join.
    """
    pages = pages.drop("head", "tail", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sized = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    heads = (sized.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull()).groupBy("payload_digest")
             .agg(F.min("record_id").alias("head"), F.max("record_id").alias("tail")).where("head < tail").drop("tail"))
    revisit = F.col("head").isNotNull() & (F.col("record_id") != F.col("head"))
    return (sized.join(heads, "payload_digest", "left")
            .withColumns({"record_type": F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response"),
                          "refers_to": F.when(revisit, F.col("head"))}).drop("head"))


def record_chunks(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Chunk rows of records; a revisit and an empty payload have one row without data.  Other columns are left out."""
    records = records.select("record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk_bytes)).cast("int")
    cut = records.withColumn("body", body).drop("payload").withColumn("n_chunks", n)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    data = F.substring(F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select("record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "n_chunks", data.alias("data"))


def _urn(record_id: int | None) -> str:
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'loamframe record {record_id}')}>"


def _header(row: dict, date: str) -> bytes:
    response, n = row["record_type"] == "response", row["payload_bytes"]
    start = HTTP % n if response else b""
    uri = "".join(c for c in row["uri"] or "" if c > " " and c != "\x7f") or f"urn:record:{row['record_id']}"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["record_id"])), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(start) + n if response else 0)),
        ("X-Record-Number", "" if row["record_id"] is None else str(row["record_id"])), ("X-Payload-Length", str(n))]
    if not response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(row["refers_to"])), ("X-Refers-To-Number", str(row["refers_to"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + start


def write_warc(chunks: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 128 << 20, level: int = 4) -> DataFrame:
    """Write chunk rows as archives of about ``file_bytes``; returns (file, records).

    The rows of a record must follow each other in one partition, as ``record_chunks`` leaves them.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        import pyarrow as pa

        store, root = filesystem(folder)
        sink = name = member = None
        done, records = [], 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            plain = {c: v.to_pylist() for c, v in columns.items() if c != "data"}
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in plain.items()}
                if row["chunk_no"] == 0:
                    if sink is not None and sink.tell() >= file_bytes:
                        sink.close()
                        store.move(f"{root}/.{name}", f"{root}/{name}")
                        done.append((f"{folder.rstrip('/')}/{name}", records))
                        sink, records = None, 0
                    if sink is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(f"{root}/.{name}", compression=None)
                    member, records = zlib.compressobj(level, wbits=31), records + 1
                    sink.write(member.compress(_header(row, date)))
                sink.write(member.compress(columns["data"][i].as_buffer()))
                if row["chunk_no"] + 1 == row["n_chunks"]:
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
        if sink is not None:
            sink.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            done.append((f"{folder.rstrip('/')}/{name}", records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])

    small_batches(chunks.sparkSession)
    return durable(chunks.mapInArrow(write, "file string, records long"))


class MemberReader:
    """Bytes of a gzip file of many members, as a stream; a record is one member."""

    def __init__(self, source, step: int = 1 << 18):
        import zlib

        self.source, self.step, self.make = source, step, lambda: zlib.decompressobj(wbits=31)
        self.inflate, self.rest, self.held, self.over = self.make(), b"", bytearray(), False

    def fill(self, n: int) -> None:
        while len(self.held) < n and not self.over:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, self.make()
            data = self.rest or self.source.read(self.step)
            if not data:
                self.over = True
                break
            self.held += self.inflate.decompress(data, self.step)
            self.rest = self.inflate.unconsumed_tail

    def line(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0 and not self.over:
            self.fill(len(self.held) + 1)
        return self.take(at + 1 if at >= 0 else len(self.held))

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_warc(files: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives named in ``files``; raises where a payload's digest or length is not the header's.

    ``data`` is null with ``with_data`` off, for readers that want the digests only.  A revisit is one row.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
        names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "is_last", "running_digest", "data"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = filesystem(file)
                with store.open_input_stream(path, compression=None) as source:
                    stream = MemberReader(source)
                    while line := stream.line():
                        if line.strip() != b"WARC/1.1":
                            raise ValueError(f"{file}: no record where one should begin")
                        fields = {}
                        while (line := stream.line().strip()):
                            key, _, value = line.decode().partition(": ")
                            fields[key.rstrip(":")] = value
                        kind, left = fields["WARC-Type"], int(fields["Content-Length"])
                        if kind == "response":
                            while left and (line := stream.line()):
                                left -= len(line)
                                if line == b"\r\n":
                                    break
                        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        own = (int(fields["X-Record-Number"]) if fields["X-Record-Number"] else None, kind,
                               int(fields["X-Refers-To-Number"]) if kind == "revisit" else None, size, digest)
                        running, chunk, total = hashlib.sha256(), 0, left
                        while True:
                            data = stream.take(min(left, chunk_bytes))
                            if left and not data:
                                raise ValueError(f"{file}: cut off")
                            left -= len(data)
                            running.update(data)
                            so_far = digest if kind == "revisit" else running.hexdigest()
                            rows.append((*own, chunk, left == 0, so_far, data if with_data else None))
                            chunk, held = chunk + 1, held + len(data) * with_data
                            if held >= 8 << 20 or len(rows) >= 5_000:
                                yield out(rows)
                                rows, held = [], 0
                            if left == 0:
                                break
                        if kind == "response" and (running.hexdigest() != digest or total != size):
                            raise ValueError(f"{file}: record {own[0]} does not have its digest")
                        if stream.take(4) != b"\r\n\r\n":
                            raise ValueError(f"{file}: a record does not end where it should")
        if rows:
            yield out(rows)

    return files.repartition(max(1, files.count())).mapInArrow(read, READ)

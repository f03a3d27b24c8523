"""Benchmark passages in documents by winnowing (operator 4).

Of every ``w`` consecutive word ``k``-grams the least hash is kept, so two texts that share ``k + w - 1`` words share a
fingerprint at the same place of the shared span.  With ``k + w - 1`` equal to the length of an item's window, each
window has one fingerprint, and wherever its words occur a document has that fingerprint too.  Equal fingerprints are
joined and the hits extended to the whole window, word by word.  Items shorter than a window are one window of their
own length, and documents are winnowed for each length that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, durable, passed_on, small_batches
from loamframe.llm.hashing import SEQUENCE_BASE, Words, mix, range_hashes

#: Longs of the bit filter over item fingerprints: 1 MB, whatever the number of items.
FILTER_LONGS = 1 << 17
CANDIDATES = "array<struct<length:int,hash:long,at:int,words:string>>"


def letter_table() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; 0 separates."""
    table = np.zeros(256, dtype=np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(windows' first words, place of each window's fingerprint, its hash, k) for windows of ``length`` words."""
    k = max(1, length // 2)
    w = length - k + 1
    owner = words.text_of_word()
    grams = range_hashes(words.hashes, np.arange(max(0, len(words) - k + 1)), np.arange(k, len(words) + 1), SEQUENCE_BASE)
    grams = mix(grams + np.uint64(length))
    n = max(0, len(words) - length + 1)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, w):  # of equal hashes the last stands
        other = grams[j : j + n]
        lower = other <= least
        least[lower], place[lower] = other[lower], np.flatnonzero(lower) + j
    first = np.flatnonzero(owner[:n] == owner[length - 1 : length - 1 + n]) if n else np.zeros(0, np.int64)
    return first, place[first], least[first], k


def _item_windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        table = letter_table()
        lower = bytes(int(b) or 32 for b in table)
        for batch in byte_slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            words = Words(texts, table)
            count, rows = np.diff(words.first), []
            ids, owner = batch.column("item_id").to_pylist(), words.text_of_word()
            for length in sorted({min(window, int(c)) for c in count if c}):
                first, place, hashes, _ = fingerprints(words, length)
                own = np.minimum(count[owner[first]], window) == length
                for i, p, h in zip(first[own].tolist(), place[own].tolist(), hashes[own].astype(np.int64).tolist()):
                    text = b" ".join(words.data[words.starts[i] : words.ends[i + length - 1]].translate(lower).split())
                    rows.append((ids[owner[i]], length, h, p - i, text.decode()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "length", "hash", "offset", "words"])

    return cut


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the upper 23 bits of a hash; FILTER_LONGS rows at most come to the driver."""
    top = windows.select(F.shiftrightunsigned("hash", 41).alias("top"))
    longs = top.groupBy(F.expr("shiftright(top, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(top & 63 AS int)))").alias("bits"))
    out = np.zeros(FILTER_LONGS, dtype=np.int64)
    for row in longs.collect():
        out[row["at"]] = row["bits"]
    return out.view(np.uint64)


def mark_overlaps(
    docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """``keep`` (default: all but ``text``) of every document with n_words, n_hit, n_items, item_ids (sorted array) and contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window.  A document
    word inside any occurrence of a window is hit.  Null and empty texts have no words; null item ids count as "";
    equal ids are one item; repeated documents are rows of their own; empty tables give no rows or no hits.  Columns
    of ``docs`` with result names give way.
    """
    own = {"n_words", "n_hit", "n_items", "item_ids", "contaminated", "_text", "_row", "_found"}
    keep = passed_on([c for c in docs.columns if c != text] if keep is None else keep, own)
    small_batches(docs.sparkSession)
    source = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    cut = durable(source.mapInArrow(_item_windows(window), "item_id string, length int, hash long, offset int, words string"))
    windows = durable(cut.groupBy("length", "hash", "offset", "words").agg(F.count("*").alias("n")).withColumn("window", F.monotonically_increasing_id()))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # `window` values at most
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(windows))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        known, table = bits.value, letter_table()
        lower = bytes(int(b) or 32 for b in table)
        kind = pa.list_(pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))
        for batch in byte_slices(batches, "_text"):
            words = Words([(t or "").encode() for t in batch.column("_text").to_pylist()], table)
            owner, found = words.text_of_word(), [[] for _ in range(batch.num_rows)]
            for length in lengths:
                _, place, hashes, k = fingerprints(words, length)
                top = (hashes >> np.uint64(41)).astype(np.int64)
                hit = (known[top >> 6] >> (top & 63).astype(np.uint64)) & np.uint64(1) == 1
                place, at = np.unique(place[hit], return_index=True)
                for p, h in zip(place.tolist(), hashes[hit][at].astype(np.int64).tolist()):
                    text = owner[p]
                    a, b = max(words.first[text], p + k - length), min(words.first[text + 1], p + length)
                    near = b" ".join(words.data[words.starts[a] : words.ends[b - 1]].translate(lower).split())
                    # `at`: the fingerprint's word in the text; the words sent begin length - k before it, or with the text
                    found[text].append({"length": length, "hash": h, "at": int(p - words.first[text]), "words": near.decode()})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(words.first), pa.int64()), pa.array(found, kind)], names=[*keep, "n_words", "_found"])

    schema = rows.drop("_text").schema.add("n_words", "long")
    ddl = F.lit(None).cast(CANDIDATES)
    schema = schema.add("_found", rows.select(ddl.alias("x")).schema["x"].dataType)
    base = durable(rows.mapInArrow(search, schema).withColumn("_row", F.monotonically_increasing_id()))
    found = base.select("_row", F.explode("_found").alias("f")).select("_row", "f.*")
    ahead = F.least(F.col("at"), F.col("length") - F.greatest(F.lit(1), F.floor(F.col("length") / 2)).cast("int"))
    begin = ahead - F.col("offset")
    theirs = windows.select("length", "hash", "offset", F.col("words").alias("window_words"), "window")
    hits = (found.join(theirs, ["length", "hash"])
            .where((begin >= 0) & (F.array_join(F.slice(F.split("words", " "), F.greatest(begin, F.lit(0)) + 1, F.col("length")), " ") == F.col("window_words")))
            .select("_row", (F.col("at") - F.col("offset")).alias("start"), "length", "window"))
    # a document's own hits, as many as it has words for each length
    each = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set("window")).alias("found"))
    each = durable(each.select(
        "_row", "found", F.sha2(F.array_join(F.col("found").cast("array<string>"), ","), 256).alias("kind"),
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("n_hit")))
    # documents with the same windows have the same items: these are gathered once for each set of windows
    kinds = each.groupBy("kind").agg(F.first("found").alias("found"))
    item_of = cut.join(windows.select("length", "hash", "offset", "words", "window"), ["length", "hash", "offset", "words"]).select("window", "item_id").distinct()
    listed = (kinds.select("kind", F.explode("found").alias("window")).join(item_of, "window")
              .groupBy("kind").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    hit = each.select("_row", "n_hit", "kind").join(listed, "kind").drop("kind")
    out = base.drop("_found").join(hit, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.coalesce("item_ids", none)), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))

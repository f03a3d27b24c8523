"""Token counts (operator 9): Arrow batches balanced by bytes, long texts split at safe boundaries, lengths only.

A boundary between a visible character and ASCII white space is safe: byte-level pre-tokens take white space only at
their start, so no token crosses it and neither side changes how the other is cut.  Texts with white space outside
ASCII are cut only where a single space stands between two visible ASCII characters.  Equal pieces are encoded once
in a batch and remembered by the worker up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, passed_on, small_batches, worker_cache
from loamframe.llm.tokens import LETTERS_AND_MARKS, load

#: Characters that some engine counts as white space, besides ASCII's six.
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


def safe_blocks(text: str, limit: int) -> Iterator[str]:
    """``text`` in blocks of at least ``limit`` characters, each cut at the first safe boundary after that."""
    import re

    boundary, start = re.compile("(?<=[!-~])(?= [!-~])"), 0
    while len(text) - start > limit:
        found = boundary.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class PieceCounter:
    """Number of tokens of texts by a byte-level vocabulary."""

    def __init__(self, path: str, kept: int = 800_000, block: int = 1 << 20):
        import re

        import numpy as np

        self.tokenizer, self.kept, self.block = load(path), kept, block
        self.counts = worker_cache(f"counts {path}")
        self.piece, self.odd = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall, re.compile(ODD_SPACE).search
        self.plain = re.compile("(?<=[!-~])(?= [!-~])").split
        self.simple = re.compile("( ?" + LETTERS_AND_MARKS[1:]).fullmatch
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def _encode(self, pieces: list[str]) -> None:
        import numpy as np

        led, other = [], []
        for piece in pieces:
            found = self.simple(piece)
            (led if found and not found[2] and piece[0] == " " else other).append(piece)
        for i in range(0, len(led), 20_000):
            part = led[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
            first = np.flatnonzero(self.starts[ids])
            assert len(first) == len(part), "a piece is not one pre-token"
            self.counts.update(zip(part, np.diff(first, append=len(ids)).tolist()))
        for i in range(0, len(other), 5_000):
            part = other[i : i + 5_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.counts.update(zip(part, map(len, found)))

    def _learn(self, pieces: list[str]) -> None:
        halves, rest = {}, []
        for piece in pieces:
            found = self.simple(piece)
            if found and found[2]:
                halves[piece] = found.groups()
            else:
                rest.append(piece)
        known = self.counts
        self._encode([p for p in {*rest, *(h for pair in halves.values() for h in pair)} if p not in known])
        known.update((piece, known[a] + known[b]) for piece, (a, b) in halves.items())

    def __call__(self, texts: list[str | None]) -> list[int]:
        """Counts of a batch; the pieces of all its texts are encoded together, a long text block by block."""
        totals, open_texts, held = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for block in safe_blocks(text, self.block) if text else ():
                open_texts.append((i, self.plain(block) if self.odd(block) else self.piece(block)))
                held += len(block)
                if held > self.block:
                    self._settle(open_texts, totals)
                    open_texts, held = [], 0
        self._settle(open_texts, totals)
        return totals

    def _settle(self, blocks: list[tuple[int, list[str]]], totals: list[int]) -> None:
        needed = set().union(*(pieces for _, pieces in blocks))
        if len(self.counts) + len(needed) > self.kept:
            self.counts.clear()
        self._learn([p for p in needed if p not in self.counts])
        known = self.counts.__getitem__
        for i, pieces in blocks:
            totals[i] += sum(map(known, pieces))


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, batch_bytes: int = 2 << 20) -> DataFrame:
    """``keep`` (default: every other column) with ``n_bytes`` and ``n_tokens`` of ``text``.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives none.  No
    truncation, padding or added tokens.  Columns of ``df`` with these names give way.  No shuffle: a task reads its part of the scan, which Spark cuts by bytes.
    """
    keep = passed_on([c for c in df.columns if c != text] if keep is None else keep, {"n_bytes", "n_tokens", "_text"})
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    names = list(keep)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        count = PieceCounter(path)
        for batch in byte_slices(batches, "_text", batch_bytes):
            texts = batch.column("_text")
            n = count(texts.to_pylist())
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), sizes, pa.array(n, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    schema = rows.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(lengths, schema)

"""SentencePiece encoding and decoding (operator 5): unigram Viterbi over a double-array trie of pieces.

The pieces and the scores come from a SentencePiece file.  A file of the unigram kind has log scores; a file of merge
ranks gets the log scores of Zipf's law for its ranks, ln(1 / (rank H)), H making them probabilities.  A text is
encoded as the file's own rules say (identity normalisation, one space ahead, spaces as U+2581).  No piece in use
spans from another character to a marker or holds a line feed, so the best path of a text is that of its parts
between spaces and line feeds; each distinct part is solved once, thousands at a time in numpy.  A character without a
piece becomes its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, passed_on, small_batches, worker_cache

MARK = "▁".encode()
#: The library's own unknown penalty below the least score.
UNKNOWN_PENALTY = 10.0
#: Score below which a piece of several characters counts as not in use (files of merge ranks mark their runs of spaces so).
UNUSED = -1e8


@dataclass
class Pieces:
    """Double-array trie over UTF-8 bytes: state ``s`` goes by byte ``c`` to ``base[s] + c`` if ``check`` there is ``s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece that ends in the state, or -1
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    longest: int
    surface: list[bytes]  # what each piece stands for; the marker as a space
    skipped: set[int]  # control pieces, which decode to nothing


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over ``keys``; states take the first free places that fit."""
    ordered = sorted(keys)
    size = 1024
    base, check, value, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
    used[0] = 1
    todo = [(0, 0, len(ordered), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        if len(ordered[low]) == depth:
            value[state] = keys[ordered[low]]
            low += 1
        children, i = [], low
        while i < high:
            c, j = ordered[i][depth], i
            while j < high and ordered[j][depth] == c:
                j += 1
            children.append((c, i, j))
            i = j
        if not children:
            continue
        at = used.find(0, children[0][0] + 1)
        while True:
            if at < 0 or at + 256 >= size:
                at = at if at >= 0 else size
                grow = max(size, 512)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
                used += bytes(grow)
                size += grow
            start = at - children[0][0]
            if not any(used[start + c] for c, _, _ in children):
                break
            at = used.find(0, at + 1)
        base[state] = start
        for c, i, j in children:
            used[start + c], check[start + c] = 1, state
            todo.append((start + c, i, j, depth + 1))
    pad = [0] * 256  # so that any byte from any state stays inside
    return (np.array(base + pad, np.int64), np.array(check + [-1] * 256, np.int64), np.array(value + [-1] * 256, np.int64))


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.full(n, -np.inf)
    scores[plain] = [model.get_score(i) for i in plain]
    live = [i for i in plain if scores[i] > UNUSED]
    single = [i for i in plain if scores[i] <= UNUSED and len(model.id_to_piece(i)) == 1]  # a character stays in use, as the least
    scores[single] = min(scores[live]) - 1
    live += single
    if len(set(scores[live])) == len(live) and all(x == int(x) <= 0 for x in scores[live]):  # merge ranks, not log scores
        ranks = np.empty(len(live))
        ranks[np.argsort(-scores[live])] = np.arange(1, len(live) + 1)
        scores[live] = -np.log(ranks) - np.log(np.sum(1.0 / ranks))
    texts = {model.id_to_piece(i).encode(): i for i in live}
    if bad := [t for t in texts if MARK in t[1:] or b"\n" in t]:
        raise ValueError(f"pieces such as {bad[0]!r} reach over the end of a part")
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    surface = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode().replace(MARK, b" ") for i in range(n)]
    skipped = {i for i in range(n) if model.is_control(i)}
    base, check, value = double_array(texts)
    return Pieces(base, check, value, scores, byte_ids, float(scores[live].min()) - UNKNOWN_PENALTY, max(map(len, texts)), surface, skipped)


def _char_lengths() -> np.ndarray:
    out = np.ones(256, np.int64)
    out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 2, 3, 4
    return out


def best_paths(words: list[bytes], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all words in turn, number of each word's); of equal scores the longer last piece stands."""
    n, lengths = len(words), np.array([len(w) for w in words])
    wide, chars = int(lengths.max()), _char_lengths()
    text = np.zeros((n, wide + 4), np.uint8)
    text[np.arange(wide + 4) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    best, back, how = np.full((n, wide + 1), -np.inf), np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
    best[:, 0] = 0.0
    for s in range(wide):
        rows = np.flatnonzero((lengths > s) & ((text[:, s] & 0xC0) != 0x80))
        if not len(rows):
            continue
        so_far, char = best[rows, s], chars[text[rows, s]]
        whole = np.zeros(len(rows), bool)  # a piece that is just this character
        live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for end in range(s + 1, min(wide, s + p.longest) + 1):
            onward = p.base[state] + text[rows[live], end - 1]
            good = (p.check[onward] == state) & (lengths[rows[live]] >= end)
            live, state = live[good], onward[good]
            if not len(live):
                break
            piece = p.value[state]
            hit = piece >= 0
            at, piece = live[hit], piece[hit]
            whole[at[char[at] == end - s]] = True
            score = so_far[at] + p.scores[piece]
            more = score > best[rows[at], end]
            r = rows[at[more]]
            best[r, end], back[r, end], how[r, end] = score[more], s, piece[more]
        lone = ~whole
        r, end = rows[lone], s + char[lone]
        score = so_far[lone] + p.unknown
        more = score > best[r, end]
        r, end = r[more], end[more]
        best[r, end], back[r, end], how[r, end] = score[more], s, -1
    owner, start, piece = [], [], []
    rows, at = np.arange(n), lengths.copy()
    while len(rows := rows[at[rows] > 0]):
        now = at[rows]
        owner.append(rows)
        piece.append(how[rows, now])
        at[rows] = back[rows, now]
        start.append(at[rows])
    if not owner:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    owner, start, piece = np.concatenate(owner), np.concatenate(start), np.concatenate(piece).astype(np.int64)
    order = np.lexsort((start, owner))
    owner, start, piece = owner[order], start[order], piece[order]
    times = np.where(piece < 0, chars[text[owner, start]], 1)
    of = np.repeat(np.arange(len(piece)), times)
    step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    ids = np.where(piece[of] < 0, p.byte_ids[text[owner[of], start[of] + step]], piece[of])
    return ids, np.bincount(owner[of], minlength=n)


def long_path(word: bytes, p: Pieces) -> list[int]:
    """As ``best_paths``, for one long word: a few steps for each character."""
    base, check, value, scores, chars = p.base.tolist(), p.check.tolist(), p.value.tolist(), p.scores.tolist(), _char_lengths().tolist()
    n = len(word)
    best, back, how = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0], s = 0.0, 0
    while s < n:
        char, state, whole = chars[word[s]], 0, False
        for end in range(s + 1, min(n, s + p.longest) + 1):
            onward = base[state] + word[end - 1]
            if check[onward] != state:
                break
            state = onward
            if value[state] >= 0:
                whole |= end - s == char
                score = best[s] + scores[value[state]]
                if score > best[end]:
                    best[end], back[end], how[end] = score, s, value[state]
        if not whole and best[s] + p.unknown > best[s + char]:
            best[s + char], back[s + char], how[s + char] = best[s] + p.unknown, s, -1
        s += char
    out, end = [], n
    while end:
        s = back[end]
        out.append([how[end]] if how[end] >= 0 else p.byte_ids[list(word[s:end])].tolist())
        end = s
    return [i for part in reversed(out) for i in part]


class Encoder:
    """Ids of whole texts as bytes of ``dtype``; parts are remembered up to a bound."""

    def __init__(self, p: Pieces, key: str, kept: int = 200_000, cells: int = 1 << 19, long: int = 256):
        self.p, self.kept, self.cells, self.long = p, kept, cells, long
        self.dtype = "<u2" if len(p.scores) <= 1 << 16 else "<u4"
        self.known = worker_cache(f"parts {key}")
        self.feed = np.array([p.byte_ids[10]], self.dtype).tobytes()

    def _learn(self, parts: list[bytes]) -> None:
        parts, at = sorted(parts, key=len), 0
        while at < len(parts) and len(parts[at]) <= self.long:
            stop = at + 1
            while stop < len(parts) and len(parts[stop]) <= self.long and (stop - at) * len(parts[stop]) < self.cells:
                stop += 1
            block = parts[at:stop]
            ids, counts = best_paths(block, self.p)
            data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            ends = (np.cumsum(counts) * width).tolist()
            self.known.update((part, data[a:b]) for part, a, b in zip(block, [0, *ends], ends))
            at = stop
        for part in parts[at:]:
            self.known[part] = np.array(long_path(part, self.p), self.dtype).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Parts of a text: each line cut at its spaces, the marker ahead of every part that follows a space."""
        cut = []
        for text in texts:
            lines = (" " + text).encode().replace(b" ", b" " + MARK).split(b"\n") if text else []
            cut.append([line.split(b" ") for line in lines])
        needed = {part for lines in cut for line in lines for part in line}
        if len(self.known) > self.kept:
            self.known.clear()
        self._learn([part for part in needed if part not in self.known])
        known = self.known.__getitem__
        return [self.feed.join([b"".join(map(known, line)) for line in lines]) for lines in cut]


def decode(ids: np.ndarray, p: Pieces) -> str:
    """Text of ids: markers are spaces, the one ahead goes, bytes are joined; bytes that are no UTF-8 become U+FFFD."""
    held = p.surface
    data = b"".join([held[i] for i in ids.tolist() if i not in p.skipped] if p.skipped else map(held.__getitem__, ids.tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", errors="replace")


def encode_pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``keep`` (default: all but ``text``) with n_pieces, n_bytes_used (byte pieces), ids_crc32, decoded_crc32, round_trip and piece_ids.

    ids_crc32 is over unsigned 32-bit little-endian ids, decoded_crc32 over the UTF-8 bytes of the text that they decode
    to, ``round_trip`` whether that is the text (a text with U+2581 comes back with spaces).  Null and empty texts have
    no pieces and decode to "".  ``piece_ids`` only ``with_ids``.  Repeated rows are encoded each; an empty table gives none.  No
    shuffle; a task holds a batch of 4 MB.  Columns of ``df`` with result names give way.
    """
    own = {"n_pieces", "n_bytes_used", "ids_crc32", "decoded_crc32", "round_trip", "piece_ids", "_text"}
    keep = passed_on([c for c in df.columns if c != text] if keep is None else keep, own)
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    model = df.sparkSession.sparkContext.broadcast(load_pieces(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import pyarrow as pa

        p = model.value
        encode = Encoder(p, path)
        is_byte = np.zeros(len(p.scores), bool)
        is_byte[p.byte_ids] = True
        names = [*keep, "n_pieces", "n_bytes_used", "ids_crc32", "decoded_crc32", "round_trip", *["piece_ids"] * with_ids]
        for batch in byte_slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            ids = [np.frombuffer(b, encode.dtype) for b in encode(texts)]
            back = [decode(i, p) for i in ids]
            columns = [
                pa.array([len(i) for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                pa.array([a == (b or "") for a, b in zip(back, texts)], pa.bool_())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=names)

    schema = rows.drop("_text").schema.add("n_pieces", "long").add("n_bytes_used", "long").add("ids_crc32", "long").add("decoded_crc32", "long").add("round_trip", "boolean")
    if with_ids:
        from pyspark.sql.types import ArrayType, IntegerType

        schema = schema.add("piece_ids", ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema)

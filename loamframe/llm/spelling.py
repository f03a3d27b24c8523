"""Groups of spelling variants by finite-state composition (operator 12).

The vocabulary acceptor is composed with a one-edit transducer and with itself (``automata``).  It is worked on in parts, one
initial state of the composed machine each: words that share a prefix are read from the state that this prefix leads to, and the
edit lies behind it.  A prefix of more than ``most`` words is split: pairs whose edit lies within its next ``WINDOW`` code points
agree before and after that window and form small blocks; the others share a longer prefix.  Every pair is enumerated once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import durable, small_batches

#: Code points by which a crowded prefix grows; a window of them bounds the words of a block by the alphabet.
WINDOW = 3
#: Rows that a task composes at once (and at least one block).
AT_ONCE = 40_000
#: Different words that a task holds while it counts.
HELD = 300_000
RUN = "[A-Za-zÀ-ÿ]"


def word_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", run: str = RUN, least: int = 5, occurrences: int = 3,
                alter: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n): words of at least ``least`` code points found at least ``occurrences`` times in the whole texts.

    Words are maximal sequences of ``run`` (a character class), A-Z lower-cased.  ``alter(id, word)``, if given, says what a word
    of a document becomes before it is measured; it must not make it longer.  Null and empty texts have no words; null ids reach
    ``alter`` as None; repeated rows count each.  An empty table gives no words.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import pyarrow as pa

        find, held = re.compile(f"{run}{{{least},}}").findall, Counter()

        def flushed():
            words = list(held)
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, body in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                if not body:
                    continue
                found = Counter(find(body.encode().lower().decode()))
                if alter:
                    changed = Counter()
                    for w, n in found.items():
                        w = alter(key, w)
                        if len(w) >= least:
                            changed[w] += n
                    found = changed
                held.update(found)
                if len(held) > HELD:
                    yield from flushed()
                    held.clear()
        yield from flushed()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def blocks_of(words: DataFrame, most: int) -> DataFrame:
    """(key, window, word, n, short, follows): each word in every block where a pair of it can be accepted.

    ``words`` (word, n) is read several times: give a stored table.  ``short`` marks words that stand in a block only as the
    shorter one of a pair; ``follows`` is the code point after the window, if any.
    """
    size = F.char_length("word")
    whole = lambda df, j: df.where(size >= j).select(
        F.concat(F.lit(f"R|{j}|"), F.substring("word", 1, j)).alias("key"), F.substring("word", j + 1, 2147483647).alias("window"), "word", "n",
        F.lit(False).alias("short"), F.lit("").alias("follows"))
    if words.count() <= most:
        return whole(words, 0)

    def within(df: DataFrame, j: int, short: bool) -> DataFrame:
        length = size + 1 if short else size
        end = j + WINDOW - short  # the window of the shorter word lacks the deleted code point
        tail = F.substring("word", end + 1, 2147483647)
        return df.where(length > j).select(
            F.concat(length.cast("string"), F.lit(f"|{j}|"), F.substring("word", 1, j), tail).alias("key"), F.substring("word", j + 1, end - j).alias("window"),
            "word", "n", F.lit(short).alias("short"), F.substring("word", end + 1, 1).alias("follows"))

    out, crowded, j = None, words, 0
    while True:
        found = within(crowded, j, False).unionByName(within(crowded, j, True))
        out = found if out is None else out.unionByName(found)
        j += WINDOW
        prefix = F.substring("word", 1, j)
        hot = durable(crowded.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_m")).where(F.col("_m") > most).drop("_m"))
        if hot.isEmpty():
            return out.unionByName(whole(crowded, j))
        out = out.unionByName(whole(crowded.join(hot, prefix == F.col("_prefix"), "left_anti"), j))
        crowded = durable(crowded.join(hot, prefix == F.col("_prefix"), "left_semi"))


def near_counts(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, n_near, near, near_n): of each word with a near word their number and the most frequent one (ties: smallest).

    Near words differ by exactly one inserted, deleted or replaced code point.  ``words`` is a stored table of distinct words and n.
    """
    blocks = blocks_of(words, most)
    dealt = blocks.repartition("key").sortWithinPartitions("key", "window")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from loamframe.llm.automata import Acceptor, near_words

        def pairs_of(rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column("key").combine_chunks()
            block = np.zeros(len(keys), dtype=np.int64)
            block[1:] = np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
            windows = rows.column("window").to_pylist()
            labels = np.frombuffer("".join(windows).encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
            lengths = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows))
            first = np.flatnonzero(np.diff(block, prepend=-1))
            # the code point after the window is that of the longer words, which all share it; the shorter ones agree
            follows = np.array([ord(x) + 1 if x else 0 for x in rows.column("follows").take(pa.array(first)).to_pylist()], dtype=np.int64)
            u, v = near_words(Acceptor(block, labels, lengths), follows)
            short = rows.column("short").to_numpy()
            once = ~(short[u] & short[v])  # two shorter words meet in a block of their own length
            u, v = u[once], v[once]
            word, near = np.concatenate([u, v]), np.concatenate([v, u])
            n = rows.column("n").to_numpy()
            names = rows.column("word").to_numpy()
            one, rank = np.unique(names[near].astype(str), return_inverse=True) if len(near) else (near, near)
            order = np.lexsort((rank, -n[near], word))
            word, near = word[order], near[order]
            head = np.flatnonzero(np.diff(word, prepend=-1))
            counts = np.diff(np.append(head, len(word)))
            return pa.RecordBatch.from_arrays(
                [pa.array(names[word[head]], pa.string()), pa.array(counts, pa.int64()), pa.array(names[near[head]], pa.string()), pa.array(n[near[head]], pa.int64())],
                names=["word", "n_near", "near", "near_n"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key")
            last = keys[len(keys) - 1].as_py()
            cut = pc.index(keys, last).as_py()  # rows are sorted: the last block may go on
            if cut:
                yield pairs_of(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            yield pairs_of(pa.Table.from_batches(held))

    found = dealt.mapInArrow(compose, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.n")).alias("near_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to, by doubling the steps each round.

    Each form is at least twice as frequent as its word, so chains end; rounds grow with the logarithm of the longest.
    """
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = state.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = durable(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def variant_forms(words: DataFrame, most: int = 20_000, times: int = 2) -> DataFrame:
    """``word``, ``form``, ``root`` and ``n``, ``n_near``, ``form_n`` of each row of ``words`` (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` (two or more)
    the word's n, else null; ``root`` is where forms lead in the end, the word itself without a form.  Words are distinct and not
    null (rows of null words are dropped, of repeated ones n is added up); an empty table gives no rows; a word may be of any length.
    """
    if times < 2:
        raise ValueError("forms of equal frequency could lead in circles")
    words = durable(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_counts(words, most)
    frequent = F.col("near_n") >= times * F.col("n")
    base = durable(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("near")).alias("form"),
        F.when(frequent, F.col("near_n")).alias("form_n")))
    roots = follow(base.where("form IS NOT NULL"))
    return base.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slip(key: object, word: str) -> str:
    """The planted misspelling of operator 12's contract: of one occurrence in 97 a code point is missing."""
    import zlib

    h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]

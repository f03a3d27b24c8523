"""Licence scan (operator 1): normalised passages against licence templates by Dice coefficient over word bigrams.

Words are runs of letters and digits, A-Z lower-cased.  A passage is a run of words, or of whole lines; its bigrams, repeats
included, are compared with a template's: 2 x common / (passage + template).  A passage can reach a coefficient t
only if its size is within [t / (2 - t), (2 - t) / t] times the template's, and a text only if it has t / (2 - t)
of the template's bigrams: templates that fail these bounds are left out before any passage is compared.  Batches go
through in numpy; the template list is fixed and small, and travels with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamframe.llm.common import byte_slices, passed_on, small_batches
from loamframe.llm.decontaminate import letter_table
from loamframe.llm.hashing import SEQUENCE_BASE, Words, range_hashes
from loamframe.llm.licence_templates import TEMPLATES

FOUND = "licence string, form string, dice double, first_line int, last_line int"


def bigrams(words: Words) -> np.ndarray:
    """Hash of each word and the next; the last has none."""
    n = max(0, len(words) - 1)
    return range_hashes(words.hashes, np.arange(n), np.arange(n) + 2, SEQUENCE_BASE)


def best_passage(lines: list[tuple[int, int, int]], grams: list[int], template: dict[int, int], least: float) -> tuple | None:
    """(dice, first line, last line) of the best run of lines, or None below ``least``.

    ``lines``: (number, first word, word after the last) of the lines with words; ``grams[i]``: template bigram of words i and
    i + 1, or -1.  Of equal coefficients the earliest first line, then the shorter passage stands.  The ends of a best passage
    touch a common bigram, as without such a line the coefficient is higher.
    """
    size = sum(template.values())
    low, high = least / (2 - least) * size, (2 - least) / least * size
    best = None
    for i, (number, start, stop) in enumerate(lines):
        if not any(g >= 0 for g in grams[start:stop]):
            continue
        used: dict[int, int] = {}
        common, at = 0, start
        for last, _, end in lines[i:]:
            if end - 1 - start > high:
                break
            while at < end - 1:
                if (g := grams[at]) >= 0 and used.get(g, 0) < template[g]:
                    used[g] = used.get(g, 0) + 1
                    common += 1
                at += 1
            if end - 1 - start >= low and common:
                dice = 2 * common / (end - 1 - start + size)
                if dice >= least and (best is None or dice > best[0]):
                    best = (dice, number, last)
    return best


def best_window(grams: list[int], template: dict[int, int], least: float) -> tuple | None:
    """(dice, first word, last word) of the best run of words, or None below ``least``; arguments and ties as above.

    Both ends of a best run are common bigrams, as without another one there the coefficient is higher.
    """
    size = sum(template.values())
    high, enough = (2 - least) / least * size, least / (2 - least) * size
    places = [i for i, g in enumerate(grams) if g >= 0]
    best, stop = None, 0
    for i, start in enumerate(places):
        while stop < len(places) and places[stop] - start + 1 <= high:
            stop += 1
        if stop - i < enough:
            continue
        used: dict[int, int] = {}
        common = 0
        for at in places[i:stop]:
            g = grams[at]
            if used.get(g, 0) < template[g]:
                used[g] = used.get(g, 0) + 1
                common += 1
                dice = 2 * common / (at - start + 1 + size)
                if dice >= least and (best is None or dice > best[0]):
                    best = (dice, start, at + 1)
    return best


def scan_licences(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str, str]] = TEMPLATES, least: float = 0.8,
    whole_lines: bool = True,
) -> DataFrame:
    """``keep`` (default: all but ``text``) with licence, form, dice, first_line and last_line (from 0): a row for each template found.

    Of each template the best passage of a text with a coefficient of at least ``least`` is reported; texts without
    one, null and empty texts give no row, repeated rows give theirs each.  Passages of one word have no bigrams and match
    nothing.  Without ``whole_lines`` a passage begins and ends at any word; the lines reported are those of its ends.
    Columns of ``df`` with result names give way.  No shuffle.
    """
    keep = passed_on([c for c in df.columns if c != text] if keep is None else keep, {"licence", "form", "dice", "first_line", "last_line", "_text"})
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        table = letter_table()
        own = Words([t.encode() for _, _, t in templates], table)
        of, grams = own.text_of_word(), bigrams(own)
        inside = of[:-1] == of[1:]
        names, code = np.unique(grams[inside], return_inverse=True)
        counts = np.zeros((len(templates), len(names)), dtype=np.int64)
        np.add.at(counts, (of[:-1][inside], code), 1)
        sizes = counts.sum(axis=1)
        enough = least / (2 - least) * sizes
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        for batch in byte_slices(batches, "_text"):
            texts = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            words = Words(texts, table)
            owner, pairs = words.text_of_word(), bigrams(words)
            place = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
            known = (names[place] == pairs) & (owner[:-1] == owner[1:])
            hits = np.flatnonzero(known)
            # bigrams of each template in each text: an upper bound of what any passage shares with it
            shared = np.zeros((len(texts), len(templates)), dtype=np.int64)
            np.add.at(shared, owner[hits], (counts[:, place[hits]] > 0).T)
            rows_of, found = [], []
            feeds = np.flatnonzero(np.frombuffer(words.data, np.uint8) == 10)
            for k, t in zip(*(x.tolist() for x in np.nonzero((shared >= enough) & (shared > 0)))):
                a, b = int(words.first[k]), int(words.first[k + 1])
                line = np.searchsorted(feeds, words.starts[a:b]) - np.searchsorted(feeds, words.cuts[k])
                first = np.flatnonzero(np.diff(line, prepend=-1))
                spans = list(zip(line[first].tolist(), first.tolist(), [*first[1:].tolist(), b - a]))
                codes = np.where(known[a : b - 1] & (counts[t][place[a : b - 1]] > 0), place[a : b - 1], -1).tolist() + [-1]
                template = {int(c): int(counts[t][c]) for c in np.flatnonzero(counts[t])}
                if whole_lines:
                    best = best_passage(spans, codes, template, least)
                elif best := best_window(codes, template, least):
                    best = (best[0], *line[list(best[1:])].tolist())
                if best:
                    rows_of.append(k)
                    found.append((templates[t][0], templates[t][1], *best))
            if found:
                taken = batch.take(pa.array(rows_of, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in keep), *(pa.array(c, kind) for c, kind in zip(zip(*found), kinds))],
                    names=[*keep, "licence", "form", "dice", "first_line", "last_line"])

    schema = rows.drop("_text").schema
    for name, kind in (part.split() for part in FOUND.split(", ")):
        schema = schema.add(name, {"int": "integer"}.get(kind, kind))
    return rows.mapInArrow(scan, schema)

"""Encoding with the tokenizers library inside tasks: every distinct piece of text goes through the library once."""

from __future__ import annotations

from loamframe.llm.common import worker_cache

#: Latin letters, then ASCII punctuation without the apostrophe: each of the two is one pre-token of both vocabularies.
LETTERS_AND_MARKS = "([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)"


def load(path: str):
    """Tokenizer of ``path``, once for each worker; its own threads are off, as Spark's tasks fill the cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = worker_cache("tokenizer")
    if path not in held:
        held[path] = Tokenizer.from_file(path)
    return held[path]


class WordEncoder:
    """Ids of words for a vocabulary that lower-cases, drops white space and marks ends of words.

    White space never joins two tokens there, so a text's ids are the ids of its words in turn.  Words of Latin
    letters and closing marks are cut into these two pre-tokens first, which leaves fewer distinct pieces.  Both
    caches are emptied when full.
    """

    def __init__(self, path: str, dtype: str = "<u2", words: int = 800_000, pieces: int = 800_000):
        import re

        import numpy as np

        self.tokenizer, self.dtype, self.most_words, self.most_pieces = load(path), dtype, words, pieces
        self.words, self.pieces = worker_cache(f"words {path} {dtype}"), worker_cache(f"pieces {path} {dtype}")
        self.simple = re.compile(LETTERS_AND_MARKS).fullmatch
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _cut(self, ids, counts) -> list[bytes]:
        import numpy as np

        data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        stops = (np.cumsum(counts) * width).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, words: list[bytes]) -> None:
        import numpy as np

        plain, odd = {}, []
        for word in words:
            text = word.decode()
            if found := self.simple(text):
                plain[word] = (found[1].lower(), found[2])
            else:
                odd.append(text)
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        fresh = [p for p in {p for pair in plain.values() for p in pair} if p and p not in self.pieces]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            last = np.flatnonzero(self.ends[ids])
            assert len(last) == len(part), "a piece is not one pre-token"
            self.pieces.update(zip(part, self._cut(ids, np.diff(last, prepend=-1))))
        pieces = self.pieces
        for word, (letters, marks) in plain.items():
            self.words[word] = pieces[letters] + (pieces[marks] if marks else b"")
        for i in range(0, len(odd), 5_000):
            part = odd[i : i + 5_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(found.word_ids, dtype=np.int64)
            cut = self._cut(np.array(found.ids, dtype=np.int64), np.bincount(owner, minlength=len(part)))
            self.words.update(zip((t.encode() for t in part), cut))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: none)."""
        split = [t.encode().split() if t else [] for t in texts]
        needed = set().union(*split)
        if len(self.words) > self.most_words:
            self.words.clear()
        missing = needed.difference(self.words)
        if missing:
            self._learn(list(missing))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in split]

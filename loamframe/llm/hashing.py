"""Words and 64-bit hashes of whole batches of texts in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

from loamframe.llm.common import worker_cache

#: Multipliers of the polynomial hashes; any odd numbers do.
SEQUENCE_BASE, SECOND_BASE = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[starts[i]:ends[i]]`` for each i, equal for equal contents wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * _powers(base, n), out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(SECOND_BASE))


#: Modulus and bases of the hashes of words; the first two give one 64-bit hash, the others a second one.
PRIME = (1 << 31) - 1
BASES = (0x2545F491, 0x1B873593, 0x5BD1E995, 0x4CF5AD43)


def _prime_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo PRIME, ``size`` of each, by doubling; the worker keeps them."""
    known, out = worker_cache("powers"), []
    if (base, size) in known:
        return known[base, size]
    for b in (base, pow(base, -1, PRIME)):
        powers = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            powers[done : done + more] = powers[:more] * np.uint64(pow(b, done, PRIME)) % np.uint64(PRIME)
            done += more
        out.append(powers)
    if size <= 1 << 21:
        known[base, size] = (out[0], out[1])
    return out[0], out[1]


def byte_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, int]) -> np.ndarray:
    """64-bit hashes of the bytes ``values[starts[i]:ends[i]]``: two polynomials modulo a prime.

    Polynomials modulo a power of two agree on some words that differ regularly; these have no such words.
    """
    n, halves = len(values), []
    size = 1 << max(n, 1).bit_length()
    for base in bases:
        powers, back = _prime_powers(base, size)
        # bytes times powers stay below 2^39, so sums of up to 2^24 of them fit
        terms = values.astype(np.uint64) * powers[:n]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms if n <= 1 << 24 else terms % np.uint64(PRIME), out=sums[1:])
        halves.append((sums[ends] - sums[starts]) % np.uint64(PRIME) * back[starts] % np.uint64(PRIME))
    return mix((halves[0] << np.uint64(32) | halves[1]) + (ends - starts).astype(np.uint64) * np.uint64(SECOND_BASE))


class Words:
    """Words of a batch of texts: hash, first and last byte of each, and the first word of each text.

    With ``twice`` there is a second hash of each word, from other polynomials (``others``).

    ``table[b]`` is what byte ``b`` stands for (0: it separates words).  Texts go through in blocks of about ``block``
    bytes, so the working memory does not follow the batch.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray, block: int = (1 << 20) - (1 << 12), twice: bool = False):
        data = b"\n".join(texts)
        cuts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=cuts[1:])
        #: text k begins at byte cuts[k]
        self.data, self.cuts, at, n = data, cuts, 0, len(data)
        starts, ends, hashes, others = [], [], [], []
        raw = np.frombuffer(data, dtype=np.uint8)
        while at < n:
            stop = min(n, at + block)
            while stop < n and table[raw[stop]]:  # a block ends where a word does
                stop += 1
            mapped = table[raw[at:stop]]
            inside = np.zeros(len(mapped) + 2, dtype=np.int8)
            inside[1:-1] = mapped != 0
            edge = np.diff(inside)
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            starts.append(a + at)
            ends.append(b + at)
            hashes.append(byte_hashes(mapped, a, b, BASES[:2]))
            if twice:
                others.append(byte_hashes(mapped, a, b, BASES[2:]))
            at = stop
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.others = np.concatenate(others) if others else np.zeros(0, np.uint64)
        #: words first[k] .. first[k + 1] - 1 are those of text k
        self.first = np.searchsorted(self.starts, cuts)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def separator_table(separators: bytes) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0
    return table

"""Minimised acceptors of word sets, composed with a one-edit transducer, in numpy (inside tasks).

Many initial states share one acceptor: the words of each block are read from the block's own initial state, and equal right
languages are one state whichever block they lie in.  An arc carries the number of words before it, so a path adds up to the
position of its word (a minimal perfect hash) and pairs of words are enumerated as pairs of numbers.
"""

from __future__ import annotations

import numpy as np

#: Bits of a label (a code point plus one).
LABEL = 21


class Acceptor:
    """Minimal acceptor of sorted distinct words given as (block, word) with one initial state a block.

    ``labels`` are the words' code points plus one, joined; word k has ``lengths[k]`` of them.  Arcs are sorted by ``key``
    (state and label); ``node_*`` describe the trie: state, first word and block of every prefix.
    """

    def __init__(self, blocks: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        n = len(blocks)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = blocks[1:] != blocks[:-1]
        node = np.cumsum(fresh) - 1  # node of each word at this depth
        alive, count, depth = np.arange(n), int(node[-1]) + 1 if n else 0, 0
        first = [np.flatnonzero(fresh)]
        src, lab, final, arc_cuts = [], [], [], [0]
        while len(alive):
            ends = lengths[alive] == depth
            final.append(node[ends])
            alive, node = alive[~ends], node[~ends]
            if not len(alive):
                break
            step = labels[starts[alive] + depth]
            fresh = np.ones(len(alive), dtype=bool)
            fresh[1:] = (node[1:] != node[:-1]) | (step[1:] != step[:-1])
            src.append(node[fresh])
            lab.append(step[fresh])
            first.append(alive[fresh])
            node = count + np.cumsum(fresh) - 1
            count, depth = count + int(fresh.sum()), depth + 1
            arc_cuts.append(arc_cuts[-1] + int(fresh.sum()))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        src, lab, self.node_first = cat(src).astype(np.int64), cat(lab).astype(np.int64), cat(first).astype(np.int64)
        dst = count - len(src) + np.arange(len(src))  # nodes are numbered in the order of the arcs that lead to them
        is_final = np.zeros(count, dtype=bool)
        is_final[cat(final)] = True
        self.node_block = blocks[self.node_first]
        self._minimise(count, src, lab, dst, is_final, arc_cuts)

    def _minimise(self, count, src, lab, dst, is_final, arc_cuts) -> None:
        """States are named by height: two of equal height are one if they agree on acceptance and on all arcs.

        Arcs of depth d are those from ``arc_cuts[d]`` to ``arc_cuts[d + 1]``.
        """
        height = np.zeros(count, dtype=np.int64)
        for d in range(len(arc_cuts) - 2, -1, -1):
            at = slice(arc_cuts[d], arc_cuts[d + 1])
            np.maximum.at(height, src[at], height[dst[at]] + 1)
        degree = np.bincount(src, minlength=count)
        begin = np.cumsum(degree) - degree  # arcs are sorted by source
        state = np.zeros(count, dtype=np.int64)
        states, sizes, arcs = 0, [], []
        word_count = np.zeros(count, dtype=np.int64)
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(int(height.max()) + 2 if count else 1))
        for h in range(len(cuts) - 1):
            level = by_height[cuts[h] : cuts[h + 1]]
            for k in np.unique(degree[level]):
                some = level[degree[level] == k]
                at = begin[some][:, None] + np.arange(k)[None, :]
                rows = np.empty((len(some), k + 1), dtype=np.int64)
                rows[:, 0] = is_final[some]
                rows[:, 1:] = (state[dst[at]] << LABEL) | lab[at]
                one, back = _distinct_rows(rows)
                state[some] = states + back
                firsts = np.zeros(len(one), dtype=np.int64)
                firsts[back] = some
                inside = word_count[dst[begin[firsts][:, None] + np.arange(k)[None, :]]]
                before = one[:, :1] + np.cumsum(inside, axis=1) - inside
                totals = one[:, 0] + inside.sum(axis=1)
                word_count[some] = totals[back]
                arcs.append((np.repeat(states + np.arange(len(one)), k), one[:, 1:].ravel(), before.ravel()))
                sizes.append(one[:, 0])
                states += len(one)
        self.node_state, self.final = state, (np.concatenate(sizes) if sizes else np.zeros(0, np.int64)).astype(bool)
        src, packed, before = (np.concatenate(x) for x in zip(*arcs)) if arcs else (np.zeros(0, np.int64),) * 3
        label = packed & ((1 << LABEL) - 1)
        key = (src << LABEL) | label
        order = np.argsort(key, kind="stable")
        self.key, self.label, self.dst, self.before = key[order], label[order], (packed >> LABEL)[order], before[order]
        self.degree = np.bincount(src, minlength=states)
        self.begin = np.cumsum(self.degree) - self.degree

    def matches(self, p: np.ndarray, q: np.ndarray):
        """(row, arc of p, arc of q) of all arcs with equal labels of the pairs of states."""
        swap = self.degree[p] > self.degree[q]
        few, many = np.where(swap, q, p), np.where(swap, p, q)
        row, arc = _spread(self.begin[few], self.degree[few])
        wanted = (many[row] << LABEL) | self.label[arc]
        other = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        found = self.key[other] == wanted if len(self.key) else np.zeros(0, dtype=bool)
        row, arc, other = row[found], arc[found], other[found]
        turned = swap[row]
        return row, np.where(turned, other, arc), np.where(turned, arc, other)


def _distinct_rows(rows: np.ndarray):
    """Distinct rows and the number of each row's own."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] > 1 else np.argsort(rows[:, 0], kind="stable")
    ranked = rows[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    back = np.empty(len(rows), dtype=np.int64)
    back[order] = np.cumsum(fresh) - 1
    return ranked[fresh], back


def _spread(begin: np.ndarray, counts: np.ndarray):
    """(row, begin[row] + 0 .. counts[row] - 1) for all rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, begin[row] + inside


def edited_pairs(acceptor: Acceptor):
    """Pairs accepted by acceptor x one edit x acceptor whose edit is the first thing that happens in a state.

    Arrays (state, u, v, gone): word numbers relative to the state, and for pairs that end with the deletion of a label from
    ``u`` that label, else 0.  A replacement is given once (smaller label in ``u``); a label is deleted only where ``v`` does not
    go on with it, so each pair has one edit.
    """
    a = acceptor
    # edit arcs: replacements are pairs of arcs of a state, deletions are arcs that only the first word takes
    source = a.key >> LABEL
    later = a.begin[source] + a.degree[source] - np.arange(len(source)) - 1
    row, arc = _spread(np.arange(len(source)) + 1, later)
    origin = np.concatenate([source[row], source])
    p, q = np.concatenate([a.dst[row], a.dst]), np.concatenate([a.dst[arc], source])
    u, v = np.concatenate([a.before[row], a.before]), np.concatenate([a.before[arc], np.zeros(len(source), np.int64)])
    banned = np.concatenate([np.zeros(len(row), np.int64), a.label])

    # states of the composed machine after the edit, reached from the edit arcs; the first step of a deletion has a banned label
    first_row, first_p, first_q = a.matches(p, q)
    allowed = a.label[first_p] != banned[first_row]
    first_row, first_p, first_q = first_row[allowed], first_p[allowed], first_q[allowed]
    name = lambda x, y: (a.dst[x] << 32) | a.dst[y]
    new, known, moves = np.unique(name(first_p, first_q)), np.zeros(0, np.int64), []
    while len(new):
        known = np.union1d(known, new)
        row, x, y = a.matches(new >> 32, new & 0xFFFFFFFF)
        target = name(x, y)
        moves.append((new[row], target, a.before[x], a.before[y]))
        new = np.setdiff1d(target, known)
    src, dst, du, dv = (np.concatenate(x) for x in zip(*moves)) if moves else (np.zeros(0, np.int64),) * 4
    accepts = a.final[known >> 32] & a.final[known & 0xFFFFFFFF]
    src, dst = np.searchsorted(known, src), np.searchsorted(known, dst)
    # only states from which some pair is accepted are walked through
    useful, size = accepts.copy(), -1
    while size != useful.sum():
        size = useful.sum()
        useful[src[useful[dst]]] = True
    keep = useful[dst]
    order = np.argsort(src[keep], kind="stable")
    src, dst, du, dv = (x[keep][order] for x in (src, dst, du, dv))
    degree = np.bincount(src, minlength=len(known))
    begin = np.cumsum(degree) - degree

    ended = a.final[p] & a.final[q]
    out = [(origin[ended], u[ended], v[ended], banned[ended])]
    at = np.searchsorted(known, name(first_p, first_q))
    walk = useful[at] if len(known) else np.zeros(0, dtype=bool)
    at, first_row = at[walk], first_row[walk]
    from_state, u, v = origin[first_row], u[first_row] + a.before[first_p[walk]], v[first_row] + a.before[first_q[walk]]
    while len(at):
        done = accepts[at]
        out.append((from_state[done], u[done], v[done], np.zeros(int(done.sum()), np.int64)))
        row, move = _spread(begin[at], degree[at])
        from_state, u, v, at = from_state[row], u[row] + du[move], v[row] + dv[move], dst[move]
    return tuple(np.concatenate(x) for x in zip(*out))


def near_words(acceptor: Acceptor, follows: np.ndarray):
    """(u, v) of all words of the same block at one edit, u the longer or the one with the smaller label.

    ``follows`` is, for each block number, the label that comes after all its words (0: none).
    """
    state, u, v, gone = edited_pairs(acceptor)
    order = np.argsort(state, kind="stable")
    state, u, v, gone = state[order], u[order], v[order], gone[order]
    counts = np.bincount(state, minlength=len(acceptor.final))
    begin = np.cumsum(counts) - counts
    node, pair = _spread(begin[acceptor.node_state], counts[acceptor.node_state])
    right = (gone[pair] == 0) | (gone[pair] != follows[acceptor.node_block[node]])
    node, pair = node[right], pair[right]
    base = acceptor.node_first[node]
    return base + u[pair], base + v[pair]

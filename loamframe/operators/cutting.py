"""Polygons cut along a straight line, in numpy (inside tasks).

A polygon is a list of closed rings (xs, ys), shell first.  The part on one side of the line keeps the chains of
vertices strictly on that side.  The places where chains meet the line, sorted along it, bound the polygon's inside in pairs;
a chain goes on from the end of one pair at its other end, which closes every ring of the part.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np


class CrossingRings(ValueError):
    """The rings are not those of a valid polygon, so that no pairing exists."""


def signed_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Planar area of a closed ring, positive if counter-clockwise."""
    x, y = xs - xs[0], ys - ys[0]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2.0


def turned(ring, hole: bool):
    """The ring counter-clockwise, or clockwise for a hole."""
    return (ring[0][::-1], ring[1][::-1]) if (signed_area(*ring) < 0) != hole else ring


def inside_ring(ring, x: float, y: float) -> bool:
    """Even-odd test of a point against a closed ring."""
    xs, ys = ring
    spans = (ys[:-1] > y) != (ys[1:] > y)
    x1, y1, x2, y2 = xs[:-1][spans], ys[:-1][spans], xs[1:][spans], ys[1:][spans]
    return bool(np.count_nonzero(x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2)


def with_holes(shells: list, holes: list) -> list[list]:
    """Polygons of the shells, each hole in the smallest shell around it."""
    polygons = [[shell] for shell in shells]
    if len(shells) == 1:
        polygons[0] += holes
        return polygons
    areas = [abs(signed_area(*shell)) for shell in shells]
    boxes = [(s[0].min(), s[1].min(), s[0].max(), s[1].max()) for s in shells]
    for hole in holes:
        # a ring may touch another in points, so the middle of an edge is on neither's border
        x, y = (hole[0][0] + hole[0][1]) / 2, (hole[1][0] + hole[1][1]) / 2
        around = [k for k, b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3] and inside_ring(shells[k], x, y)]
        if not around:
            raise CrossingRings("a hole lies outside every shell")
        polygons[min(around, key=areas.__getitem__)].append(hole)
    return polygons


def _exact_order(ends: list, at: float, low: bool) -> list[int]:
    """Order along the line by rational numbers, for ends that rounding has mixed up."""
    def key(k: int):
        c1, o1, c2, o2 = (Fraction(float(v)) for v in ends[k])
        slope = (o2 - o1) / (c2 - c1)
        return o1 + (Fraction(at) - c1) * slope, -slope if low else slope

    return sorted(range(len(ends)), key=key)


def _partners(ends: np.ndarray, position: np.ndarray, entering: np.ndarray, at: float, low: bool, first: bool) -> np.ndarray:
    """For each meeting with the line the other end of its stretch of the polygon's inside.

    With the inside on the left of every ring, the lower end of a stretch enters the part (``first``) and the upper one
    leaves it, or the other way round.
    """
    def mixed(order) -> bool:
        return bool((entering[order[::2]] != first).any() or (entering[order[1::2]] == first).any())

    slope = (ends[:, 3] - ends[:, 1]) / (ends[:, 2] - ends[:, 0])
    order = np.lexsort((-slope if low else slope, position))
    if mixed(order):
        order = np.array(_exact_order(ends.tolist(), at, low))
        if mixed(order):
            raise CrossingRings("rings cross at the cut")
    partner = np.empty(len(order), dtype=np.int64)
    partner[order[::2]], partner[order[1::2]] = order[1::2], order[::2]
    return partner


def _loops(steps: list) -> list:
    """A closed walk of (place on the line, vertices that follow) cut where it comes to a place again."""
    stack, where, out = [], {}, []
    for place, chain in steps:
        if place in where:
            k = where[place]
            out.append(stack[k:])
            for gone, _ in stack[k:]:
                del where[gone]
            del stack[k:]
        where[place] = len(stack)
        stack.append((place, chain))
    return [*out, stack]


def half(rings: list, axis: int, at: float, low: bool) -> list[list]:
    """Polygons of the part with ``coordinate <= at`` (or ``>= at``) of one polygon; holes and shells as they come out."""
    whole, ends, entering, chains, on_line = [], [], [], [], []
    for number, ring in enumerate(rings):
        ring = turned(ring, number > 0)
        c, o = ring[axis][:-1], ring[1 - axis][:-1]
        inside = c < at if low else c > at
        if inside.all():
            whole.append((ring, number > 0))
            continue
        on_line.append(o[c == at])
        if not inside.any():
            continue
        after = np.roll(inside, -1)
        edges = np.flatnonzero(inside != after)
        nxt = (edges + 1) % len(c)
        ends.append(np.column_stack([c[edges], o[edges], c[nxt], o[nxt]]))
        entering.append(after[edges])
        base = len(chains)
        for k, e in enumerate(edges):
            begin, stop = (e + 1) % len(c), edges[(k + 1) % len(edges)] + 1
            taken = np.arange(begin, stop) if begin < stop else np.r_[begin : len(c), 0:stop]
            # what follows this meeting up to the next one of the ring, which ends it
            chains.append((o[taken], c[taken], base + (k + 1) % len(edges)) if after[e] else None)
    closed = []
    if ends:
        ends, entering = np.concatenate(ends), np.concatenate(entering)
        c1, o1, c2, o2 = ends.T
        position = np.where(c2 == at, o2, np.where(c1 == at, o1, o1 + (at - c1) / (c2 - c1) * (o2 - o1)))
        partner = _partners(ends, position, entering, at, low, (axis == 0) != low)
        marks = np.unique(np.concatenate(on_line))
        todo = set(np.flatnonzero(entering).tolist())
        while todo:
            steps, k = [], next(iter(todo))
            while k in todo:
                todo.remove(k)
                along, across, last = chains[k]
                steps.append((float(position[k]), (along, across)))
                k = int(partner[last])
                a, b = float(position[last]), float(position[k])
                between = marks[(marks > min(a, b)) & (marks < max(a, b))]
                steps += [(p, None) for p in [a, *(between if a < b else between[::-1]).tolist()]]
            closed += _loops(steps)
    shells, holes = [r for r, hole in whole if not hole], [r for r, hole in whole if hole]
    for loop in closed:
        along = np.concatenate([np.append([p], chain[0]) if chain else [p] for p, chain in loop])
        across = np.concatenate([np.append([at], chain[1]) if chain else [at] for p, chain in loop])
        ring = (np.append(across, across[0]), np.append(along, along[0]))
        ring = ring if axis == 0 else ring[::-1]
        area = signed_area(*ring)
        if area:
            (shells if area > 0 else holes).append(ring)
    if holes and not shells:
        raise CrossingRings("a hole without a shell")
    return with_holes(shells, holes)


def vertices(polygons: list) -> int:
    return sum(len(ring[0]) for polygon in polygons for ring in polygon)


def halve(polygons: list, most: int, depth: int) -> list[list]:
    """Groups of polygons of at most ``most`` vertices: halves over the longer side of the box, ``depth`` times at most."""
    done, todo = [], [(polygons, depth)]
    while todo:
        polygons, left = todo.pop()
        if left == 0 or vertices(polygons) <= most:
            done.append(polygons)
            continue
        low = np.min([[xs.min(), ys.min()] for (xs, ys), *_ in polygons], axis=0)
        high = np.max([[xs.max(), ys.max()] for (xs, ys), *_ in polygons], axis=0)
        axis = 0 if high[0] - low[0] >= high[1] - low[1] else 1
        at = float((low[axis] + high[axis]) / 2)
        for side in (False, True):  # the low half comes off the stack first
            part = [piece for rings in polygons for piece in half(rings, axis, at, side)]
            if part:
                todo.append((part, left - 1))
    return done

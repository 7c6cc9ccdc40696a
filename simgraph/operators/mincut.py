"""The exact densest subgraph of one edge list, on arrays: loads near their balance, then whole numbers moved to a minimum cut."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: Steps of the descent before the first cut, and before each of the later ones, which begin where the last one ended.
STEPS, AGAIN = 200, 50


class _Arcs:
    """Each edge as an arc from either end, sorted by the end that it leaves: arc's head, edge, and whether it leaves the edge's first end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        order = np.argsort(np.concatenate([a, b]), kind="stable").astype(np.int32)
        self.first = order < len(a)
        self.edge = np.where(self.first, order, order - len(a)).astype(np.int32)
        self.head = np.concatenate([b, a])[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))])

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs, their count for each node): the arcs that leave the nodes, node by node."""
        many = self.start[nodes + 1] - self.start[nodes]
        return np.arange(many.sum()) + np.repeat(self.start[nodes] - (np.cumsum(many) - many), many), many


def _spread(a: np.ndarray, b: np.ndarray, n: int, x: np.ndarray, steps: int) -> np.ndarray:
    """Shares of the edges that go to their first ends, moved towards equal loads: accelerated descent on the sum of squared loads."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    rate = 1 / (degree[a] + degree[b])
    y, t = x, 1.0
    for _ in range(steps):
        load = np.bincount(a, y, n) + np.bincount(b, 1 - y, n)
        new = y - (load[a] - load[b]) * rate
        np.clip(new, 0, 1, out=new)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (new - x) * ((t - 1) / after)
        x, t = new, after
    return x


def _best_prefix(a: np.ndarray, b: np.ndarray, load: np.ndarray) -> tuple[int, int]:
    """(edges, vertices) of the densest set of vertices of the largest loads."""
    rank = np.empty(len(load), np.int64)
    rank[np.argsort(-load, kind="stable")] = np.arange(len(load))
    inside = np.cumsum(np.bincount(np.maximum(rank[a], rank[b]), minlength=len(load)))
    k = int(np.argmax(inside / np.arange(1, len(load) + 1)))
    return int(inside[k]), k + 1


def _settle(arcs: _Arcs, over: np.ndarray, share: np.ndarray, whole: int) -> np.ndarray:
    """Move load from vertices over their limit to such under it until no way is left: each vertex's steps to one under its limit, -1 if there is no way.

    ``over`` and ``share`` are changed. Each round takes the excess along the
    shortest ways, farthest vertices first; distances never fall, so it ends.
    """
    while True:
        step = np.full(len(over), -1, np.int32)
        front = np.flatnonzero(over < 0)
        step[front] = 0
        excess = need = int(np.count_nonzero(over > 0))
        levels = [front]
        while len(front) and (need or not excess):
            at, _ = arcs.of(front)
            e, back = arcs.edge[at], arcs.head[at]
            # the reverse of an arc carries what its own tail holds of the edge
            open_ = np.where(arcs.first[at], whole - share[e], share[e]) > 0
            back = back[open_ & (step[back] < 0)]
            step[back] = len(levels)
            front = np.flatnonzero(step == len(levels)) if len(back) > len(over) // 16 else np.unique(back)
            levels.append(front)
            need -= int(np.count_nonzero(over[front] > 0))
        if need == excess:
            return step
        for k in range(len(levels) - 1, 0, -1):
            nodes = levels[k][over[levels[k]] > 0]
            if not len(nodes):
                continue
            at, many = arcs.of(nodes)
            tail = np.repeat(np.arange(len(nodes)), many)
            e = arcs.edge[at]
            room = np.where(arcs.first[at], share[e], whole - share[e])
            room[step[arcs.head[at]] != k - 1] = 0
            keep = room > 0
            at, tail, e, room = at[keep], tail[keep], e[keep], room[keep]
            if not len(at):
                continue
            upto = np.cumsum(room) - room
            first = np.concatenate([[True], tail[1:] != tail[:-1]])
            before = upto - upto[first][np.cumsum(first) - 1]
            push = np.clip(over[nodes][tail] - before, 0, room)
            share[e] += np.where(arcs.first[at], -push, push)
            np.subtract.at(over, nodes[tail], push)
            np.add.at(over, arcs.head[at], push)


def densest(u: np.ndarray, v: np.ndarray, floor: Fraction) -> tuple[Fraction, np.ndarray] | None:
    """(edges per vertex, members) of the largest of the densest subgraphs; None if none reaches ``floor``.

    Each edge gives whole parts of itself to its ends. If no load passes a
    density, nothing is denser; the parts that can't be moved from vertices over
    it to vertices under it mark a denser set, which is where the next cut
    begins. The descent only chooses where the first one does.
    """
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = (x.astype(np.int32) for x in np.split(ends, 2))
    x, steps, best = np.full(len(a), 0.5), min(STEPS, len(a) // 8), floor  # a small graph needs no descent
    while True:
        best = max(best, Fraction(len(a), len(ids)))
        x = _spread(a, b, len(ids), x, steps)
        m, n = _best_prefix(a, b, np.bincount(a, x, len(ids)) + np.bincount(b, 1 - x, len(ids)))
        best = max(best, Fraction(m, n))
        keep = np.ones(len(ids), bool)
        while True:  # a vertex of a densest subgraph has at least as many edges in it as the subgraph has for each vertex
            stay = keep[a] & keep[b]
            few = keep & (np.bincount(a[stay], minlength=len(ids)) + np.bincount(b[stay], minlength=len(ids)) < float(best))
            if not few.any():
                break
            keep &= ~few
        if not keep.any():
            return None
        ids, a, b, x = _within(keep, ids, a, b, x)
        limit, whole = best.numerator, best.denominator
        share = np.rint(x * whole).astype(np.int64)
        over = -np.full(len(ids), limit, np.int64)
        np.add.at(over, a, share)
        np.add.at(over, b, whole - share)
        step = _settle(_Arcs(a, b, len(ids)), over, share, whole)
        inside = step < 0  # no way leads from these to a vertex under the limit
        if not inside.any():
            return None
        ids, a, b, x = _within(inside, ids, a, b, share / whole)
        if Fraction(len(a), len(ids)) == best:
            return best, ids
        steps = min(AGAIN, len(a) // 8)


def _within(keep: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The graph among the vertices to keep, numbered anew."""
    place, stay = np.cumsum(keep, dtype=np.int32) - 1, keep[a] & keep[b]
    return ids[keep], place[a[stay]].astype(np.int32), place[b[stay]].astype(np.int32), x[stay]

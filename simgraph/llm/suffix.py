"""Suffix order of a block of text by a difference cover."""

from __future__ import annotations

import numpy as np

#: Modulus of the cover, and bytes that sample ranks look at if no more are asked for.
PERIOD, DEPTH = 16, 256


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` is one between two of them (greedy)."""
    cover = [0]
    missing = set(range(1, period))
    while missing:
        best = max(range(1, period), key=lambda c: (len(missing & {(c - d) % period for d in cover} | missing & {(d - c) % period for d in cover}), -c))
        missing -= {(best - d) % period for d in cover} | {(d - best) % period for d in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)
_IN = np.isin(np.arange(PERIOD), COVER)
#: SHIFT[r, s]: steps after which positions with residues r and s are both in the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(r + d) % PERIOD] and _IN[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by the keys, the first one foremost; equal rows share a rank."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """A text and the ranks of its cover sample, by which ties of up to ``depth`` bytes (a power of two) are resolved."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        self.size, self.depth = len(text), depth
        padded = np.concatenate([text, np.zeros(depth + 2 * PERIOD, np.uint8)]).astype(np.uint64)
        n = len(padded) - 7
        self.word = np.zeros(n, np.uint64)
        for k in range(8):
            self.word |= padded[k : k + n] << np.uint64(8 * (7 - k))
        sample = np.flatnonzero(_IN[np.arange(self.size + PERIOD) % PERIOD])
        rank = np.zeros(self.size + depth + 2 * PERIOD, np.int64)
        rank[sample] = _dense(self.word[sample], self.word[sample + 8]) + 1
        seen = PERIOD
        while seen < depth and int(rank.max(initial=0)) < len(sample):
            rank[sample] = _dense(rank[sample] << 32 | rank[sample + seen]) + 1
            seen *= 2
        self.rank = rank

    def order(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the suffixes ``at`` that share their group and first PERIOD bytes with another, sorted
        by group and suffix; and which of them tie with the one before.

        Ties of one residue compare by the rank of the next sample position;
        of two residues by the ranks SHIFT steps on, where both are in the sample.
        """
        tie = _dense(group, self.word[at], self.word[at + 8])
        many = np.bincount(tie)
        left = np.flatnonzero(many[tie] > 1)
        tie, pos = tie[left], at[left]
        residue = pos % PERIOD
        own = self.rank[pos + SHIFT[residue, residue]]
        by_class = np.lexsort((own, residue, tie))
        left, tie, pos, residue = left[by_class], tie[by_class], pos[by_class], residue[by_class]
        kind = tie * PERIOD + residue
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
        place = np.arange(len(kind)) - np.repeat(first, np.diff(np.append(first, len(kind))))
        mixed = np.zeros(len(many), bool)
        heads = tie[first]
        mixed[heads[1:][heads[1:] == heads[:-1]]] = True
        mixed = mixed[tie]
        if mixed.any():
            big = np.int64(self.size + self.depth + 2 * PERIOD)
            by_residue = [np.flatnonzero(mixed & (residue == r)) for r in range(PERIOD)]
            for r, mine in enumerate(by_residue):
                for s, other in enumerate(by_residue):
                    if r != s and len(mine) and len(other):
                        d = SHIFT[r, s]
                        there = tie[other] * big + self.rank[pos[other] + d]
                        here = tie[mine] * big + self.rank[pos[mine] + d]
                        base = np.searchsorted(there, tie[mine] * big)
                        place[mine] += np.searchsorted(there, here, "right" if s < r else "left") - base
        final = np.lexsort((place, tie))
        left, tie = left[final], tie[final]
        return left, np.concatenate([[False], tie[1:] == tie[:-1]]) if len(tie) else np.zeros(0, bool)

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether ``length`` bytes from a[i] and b[i] on are equal; the bytes decide."""
        alive = np.arange(len(a))
        for k in [*range(0, length - 7, 8), length - 8]:
            alive = alive[self.word[a[alive] + k] == self.word[b[alive] + k]]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return out


def repeated_windows(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``length`` bytes (8 or more) from ``at`` on equal another one of their group.

    Ranks reach past ``length``, so equal windows are neighbours in the order.
    """
    block = Block(text, max(DEPTH, 1 << (length + PERIOD - 1).bit_length()))
    order, tied = block.order(at, group)
    out = np.zeros(len(at), bool)
    later = np.flatnonzero(tied)
    hit = later[block.same(at[order[later]], at[order[later - 1]], length)]
    out[order[hit]] = True
    out[order[hit - 1]] = True
    return out

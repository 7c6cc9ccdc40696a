"""Exact clique search in one ego network, on integers as bit sets."""

from __future__ import annotations


def bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def greedy_clique(adj: list[int], within: int) -> int:
    """A maximal clique: always the vertex with most candidates left, the first of those."""
    clique = 0
    while within:
        v = max(bits(within), key=lambda i: ((adj[i] & within).bit_count(), -i))
        clique |= 1 << v
        within &= adj[v]
    return clique


def largest_clique(adj: list[int], within: int, above: int = 0) -> tuple[int, int]:
    """(members, nodes): a largest clique inside ``within`` if it has more than ``above`` vertices, else no members.

    Branch and bound: vertices are coloured greedily, and one is tried only if
    its colour number can still lift the size. The search runs to its end.
    """
    best, best_size, nodes = 0, above, 0
    start = greedy_clique(adj, within)
    if start.bit_count() > best_size:
        best, best_size = start, start.bit_count()

    def grow(chosen: int, size: int, left: int) -> None:
        nonlocal best, best_size, nodes
        nodes += 1
        order: list[tuple[int, int]] = []
        rest, colour = left, 0
        while rest:
            colour += 1
            free = rest
            while free:
                low = free & -free
                v = low.bit_length() - 1
                order.append((v, colour))
                rest ^= low
                free &= ~(adj[v] | low)
        for v, colour in reversed(order):
            if size + colour <= best_size:
                return
            more = left & adj[v]
            if more:
                grow(chosen | 1 << v, size + 1, more)
            elif size + 1 > best_size:
                best, best_size = chosen | 1 << v, size + 1
            left &= ~(1 << v)

    if within:
        grow(0, 0, within)
    return best, nodes


def maximal_cliques(adj: list[int], chosen: int, left: int, out: int, least: int):
    """All maximal cliques with ``least`` vertices or more that hold ``chosen``, may use ``left`` and can't be widened by ``out``."""
    if not left and not out:
        if chosen.bit_count() >= least:
            yield chosen
        return
    if chosen.bit_count() + left.bit_count() < least:
        return
    pivot = max(bits(left | out), key=lambda i: (adj[i] & left).bit_count())
    for v in bits(left & ~adj[pivot]):
        yield from maximal_cliques(adj, chosen | 1 << v, left & adj[v], out & adj[v], least)
        left &= ~(1 << v)
        out |= 1 << v


def all_of_size(adj: list[int], chosen: int, left: int, size: int):
    """All cliques of ``size`` vertices that hold ``chosen`` and else come from ``left``."""
    need = size - chosen.bit_count()
    if need == 0:
        yield chosen
    elif left.bit_count() >= need:
        for v in bits(left):
            left &= ~(1 << v)
            yield from all_of_size(adj, chosen | 1 << v, left & adj[v], size)

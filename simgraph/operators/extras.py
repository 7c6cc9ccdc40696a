"""Further analytics: twins, exact densest subgraph, k-plexes."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.functions.similarity import LEAST_COMMON, adjacency, degrees
from simgraph.operators.cliques import per_group
from simgraph.operators.components import components
from simgraph.operators.mincut import densest
from simgraph.operators.reduce import densest_by_peeling, k_core
from simgraph.runtime import cut, prepare

#: Edges of a component of the reduced core that a task of the exact densest subgraph takes at most: some 130 bytes each.
LOCAL_EDGES = 6_000_000


def false_twins(edges: DataFrame) -> DataFrame:
    """(nbrs, n): groups of two or more vertices with one neighbourhood of at least LEAST_COMMON; each group is a generalized clique at any threshold."""
    adj = adjacency(edges).where(F.size("nbrs") >= LEAST_COMMON)
    return adj.groupBy(F.array_join("nbrs", ",").alias("nbrs")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of each run of rows (root, u, v) with one root, as arrays."""
    key, held = None, []
    for batch in batches:
        root, u, v = (c.to_numpy() for c in batch.columns)
        turns = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
        for first, end in zip(turns, turns[1:], strict=False):
            if end > first:
                if held and root[first] != key:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held = []
                key = root[first]
                held.append((u[first:end].copy(), v[first:end].copy()))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def densest_exact(edges: DataFrame) -> tuple[Fraction, list[int]]:
    """(edges per vertex, members) of a densest subgraph, exact.

    Spark finds a dense subgraph by peeling; the answer lies in the core of at
    least its density, in one connected component of it. Each component is a
    group of its own, whose minimum cuts begin at that density and work on arrays;
    a component of more than LOCAL_EDGES edges is refused.
    """
    low, _ = densest_by_peeling(edges)
    core = k_core(edges, max(1, int(np.ceil(low))), 2 * LOCAL_EDGES).where("u < v")  # tasks take off the last rounds' vertices
    if core.isEmpty():
        return Fraction(0), []
    roots = components(core.select(F.col("v").alias("a"), F.col("u").alias("b")))
    rows = cut(core.join(roots.withColumnRenamed("node", "u"), "u").select("root", "u", "v"))
    if rows.groupBy("root").count().agg(F.max("count")).first()[0] > LOCAL_EDGES:
        raise ValueError("a component of the core is too large for an exact cut; use densest_by_peeling")
    floor = Fraction(low * (1 - 1e-9))  # a little below what peeling found, which a float rounds

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in _ends(batches):
            if (found := densest(u, v, floor)) is not None:
                density, members = found
                out = [[int(density * len(members))], [len(members)], [",".join(map(str, members.tolist()))]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["edges", "n", "members"])

    dealt = rows.repartition(F.xxhash64("root")).sortWithinPartitions("root")
    found = dealt.mapInArrow(find, "edges long, n long, members string")
    best = found.orderBy(F.desc(F.col("edges") / F.col("n")), F.split("members", ",")[0].cast("long")).first()
    return Fraction(best.edges, best.n), [int(x) for x in best.members.split(",")]


def k_plex(edges: DataFrame, k: int, seeds: int = 32) -> tuple[int, str]:
    """(size, members) of a vertex set in which each misses at most k - 1 others: the best of greedy starts from the ``seeds`` vertices of largest degree.

    A heuristic with fixed starts. A start's set stays within two steps of it:
    the edges among those vertices are a group of their own, so starts run in
    parallel and no task holds more than the surroundings of one.
    """
    prepare(edges.sparkSession)
    starts = cut(degrees(edges).orderBy(F.desc("deg"), "u").limit(seeds).select(F.col("u").alias("root")))
    if starts.isEmpty():
        return 0, ""
    beside = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    one = starts.join(beside.withColumnRenamed("a", "root"), "root").withColumnRenamed("b", "a")
    two = one.join(beside, "a").select("root", F.col("b").alias("a"))
    ball = cut(starts.select("root", F.col("root").alias("a")).unionByName(one.select("root", "a")).unionByName(two).distinct())
    inside = ball.join(beside, "a").join(ball.withColumnRenamed("a", "b"), ["root", "b"]).select("root", "a", "b")

    def find(root: int, a: list[int], b: list[int]) -> Iterator[tuple]:
        near: dict[int, set[int]] = {}
        for x, y in zip(a, b, strict=True):
            near.setdefault(x, set()).add(y)
        chosen = {root}
        cand = near.keys() - chosen
        while True:
            tight = [x for x in chosen if len(chosen) - len(near[x] & chosen) >= k]
            cand = {c for c in cand if len(chosen - near[c]) < k and all(x in near[c] for x in tight)}
            if not cand:
                break
            pick = max(cand, key=lambda c: (len(near[c] & chosen), len(near[c] & cand), -c))
            chosen.add(pick)
            cand.discard(pick)
        yield len(chosen), ",".join(map(str, sorted(chosen)))

    best = per_group(inside, find, "size long, members string").orderBy(F.desc("size"), "members").first()
    return best.size, best.members

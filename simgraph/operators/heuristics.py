"""Lower bounds for the largest clique: twins, greedy expansion, drop-one search. Member lists are small; the relation stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.functions.similarity import LEAST_COMMON, adjacency, both_ways
from simgraph.operators.cliques import greedy_bound
from simgraph.operators.reduce import forward, ranked
from simgraph.runtime import cut

#: Members of one twin group that are taken as a start at most; a part of a clique is a clique.
MOST_START = 4096


def links_into(pairs: DataFrame, members: list[int]) -> DataFrame:
    """(v, links, missing): vertices outside ``members`` adjacent to all but at most one of them; missing is that one, else null."""
    own = pairs.sparkSession.createDataFrame([(m,) for m in members], "u long")
    both = both_ways(pairs)
    near = both.join(F.broadcast(own), "u").join(F.broadcast(own.select(F.col("u").alias("v"))), "v", "left_anti")
    rows = near.groupBy("v").agg(F.count(F.lit(1)).alias("links"), F.collect_set("u").alias("has")).where(F.col("links") >= len(members) - 1)
    ids = F.array(*[F.lit(m) for m in members])
    return rows.select("v", "links", F.get(F.array_except(ids, "has"), F.lit(0)).alias("missing"))


def expand(pairs: DataFrame, members: list[int], rounds: int = 32) -> list[int]:
    """Members plus vertices adjacent to all so far, one a round: the one with most of the other candidates, then the smallest id."""
    members = sorted(members)
    cand = cut(links_into(pairs, members).where("missing is null").select("v"))
    for _ in range(rounds):
        if cand.isEmpty():
            break
        inner = both_ways(pairs).join(cand.select(F.col("v").alias("u")), "u", "left_semi").join(cand, "v", "left_semi")
        score = cand.join(inner.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", "left")
        best = score.orderBy(F.desc_nulls_last("n"), "v").first().v
        members = sorted([*members, best])
        cand = cut(inner.where(F.col("u") == best).select("v"))
    return members


def drop_one(pairs: DataFrame, members: list[int], rounds: int = 8) -> list[int]:
    """Replace one member by two adjacent vertices that miss only it, while that is possible."""
    for _ in range(rounds):
        near = cut(links_into(pairs, members).where("missing is not null").select("v", "missing"))
        a, b = near.select(F.col("v").alias("u"), "missing"), near.select("v", F.col("missing").alias("other"))
        swap = pairs.select("u", "v").join(a, "u").join(b, "v").where("missing = other").orderBy("missing", "u", "v").first()
        if swap is None:
            break
        members = sorted({*members, swap.u, swap.v} - {swap.missing})
    return members


def largest_twins(edges: DataFrame) -> list[int]:
    """A largest group of vertices with one neighbourhood of at least LEAST_COMMON: a generalized clique at any threshold."""
    groups = adjacency(edges).where(F.size("nbrs") >= LEAST_COMMON).groupBy("nbrs").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("first"))
    top = groups.orderBy(F.desc("n"), "first").first()
    if top is None:
        return []
    same = adjacency(edges).where(F.col("nbrs") == F.array(*[F.lit(x) for x in top.nbrs]))
    return sorted(r.u for r in same.select("u").orderBy("u").limit(MOST_START).collect())


def quick_bound(edges: DataFrame, pairs: DataFrame) -> list[int]:
    """The better of the twins and the greedy ego cliques, expanded and improved."""
    pairs = cut(pairs.select("u", "v"))
    if pairs.isEmpty():
        return []
    best = greedy_bound(cut(forward(pairs, ranked(both_ways(pairs))))).orderBy(F.desc("size"), "members").first()
    start = max(largest_twins(edges), [int(x) for x in best.members.split(",")], key=len)
    return drop_one(pairs, expand(pairs, start))

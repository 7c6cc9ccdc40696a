"""Queries for one vertex: its closed generalized neighbourhood and the largest clique through it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.functions.similarity import LEAST_COMMON, could_be_similar, degrees, generalized_edges, jaccard
from simgraph.operators.cliques import matrix, per_group
from simgraph.operators.search import largest_clique
from simgraph.runtime import cut


def two_hop_region(edges: DataFrame, q: int) -> DataFrame:
    """(u): q, its neighbours and theirs."""
    near = edges.where(F.col("u") == q).select(F.col("v").alias("u"))
    far = near.join(edges, "u").select(F.col("v").alias("u"))
    own = edges.where(F.col("u") == q).select("u")
    return own.unionByName(near).unionByName(far).distinct()


def closed_neighbourhoods(edges: DataFrame, eps: float, queries: DataFrame) -> DataFrame:
    """(q, u): for every q of ``queries`` itself and its generalized neighbours, all queries in one plan.

    The queries are joined first, so only their wedges are made.
    """
    queries = queries.select("q").distinct()
    deg = degrees(edges)
    own = queries.join(edges.withColumnRenamed("u", "q"), "q")
    adjacent = own.select("q", F.col("v").alias("u"))
    sided = own.join(deg.select(F.col("u").alias("q"), F.col("deg").alias("dq")), "q").where(F.col("dq") >= LEAST_COMMON)
    ends = edges.join(deg, "u").select(F.col("v").alias("w"), "u", F.col("deg").alias("du"))
    wedges = sided.select("q", "dq", F.col("v").alias("w")).join(ends, "w").where((F.col("q") != F.col("u")) & could_be_similar(F.col("dq"), F.col("du"), eps))
    pairs = wedges.groupBy("q", "u", "dq", "du").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= LEAST_COMMON)
    similar = pairs.where(jaccard(F.col("common"), F.col("dq"), F.col("du")) >= eps).select("q", "u").join(adjacent, ["q", "u"], "left_anti")
    return queries.select("q", F.col("q").alias("u")).unionByName(adjacent).unionByName(similar)


def largest_through(edges: DataFrame, eps: float, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(q, size, members): the largest generalized clique through each q.

    It is q with a largest clique among its generalized neighbours. ``pairs``
    (the relation, u < v) is made for the union of the regions if not given. A
    q without neighbours has size 1; so has one that isn't in the graph.
    """
    region = cut(closed_neighbourhoods(edges, eps, queries))
    ends = cut(region.select("u").distinct())
    pairs = generalized_edges(edges, eps, ends).select("u", "v") if pairs is None else pairs.select("u", "v")
    mine = region.where("q <> u")
    left, right = mine.select("q", F.col("u").alias("a")), mine.select("q", F.col("u").alias("b"))
    inner = left.join(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")), "a").join(right, ["q", "b"]).select("q", "a", "b")
    rows = region.select("q", F.col("u").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(inner)

    def find(q: int, a: list[int], b: list[int | None]) -> Iterator[tuple]:
        ids, adj = matrix(a, b)
        others = sum(1 << i for i, v in enumerate(ids) if v != q)
        found, _ = largest_clique(adj, others)
        members = sorted([q, *(v for i, v in enumerate(ids) if found >> i & 1)])
        yield q, len(members), ",".join(map(str, members))

    return per_group(rows, find, "q long, size long, members string")

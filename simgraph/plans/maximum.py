"""Whole queries: the largest generalized clique of a graph, by four routes that agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.functions.similarity import both_ways, generalized_edges
from simgraph.operators.cliques import maximum_clique
from simgraph.operators.index import Settings, build_index, degree_bounds, restore
from simgraph.operators.reduce import k_core
from simgraph.runtime import cut


def _answer(df: DataFrame, found: tuple[int, str, int], least: int) -> DataFrame:
    size, members, nodes = found
    return df.sparkSession.createDataFrame([(size, members, nodes, size >= least)], "size long, members string, nodes long, meets_threshold boolean")


def materialized(edges: DataFrame, eps: float, least: int = 1) -> DataFrame:
    """(size, members, nodes, meets_threshold): the relation is made as a whole, reduced, and searched."""
    if not 0 <= eps <= 1:
        raise ValueError("eps lies between 0 and 1")
    edges = cut(edges)
    pairs = cut(generalized_edges(edges, eps))
    return _answer(edges, maximum_clique(pairs, 0 if edges.isEmpty() else 1), least)


def progressive(edges: DataFrame, eps: float, least: int = 1) -> DataFrame:
    """The same by growing bounds: a clique of the graph itself bounds the size, then vertices whose generalized degree can't reach it go before the search."""
    edges = cut(edges)
    first = maximum_clique(edges.where("u < v"), 1)[0]
    pairs = cut(generalized_edges(edges, eps))
    core = k_core(both_ways(pairs), max(1, first - 1)).where("u < v")
    return _answer(edges, maximum_clique(core, 0 if edges.isEmpty() else 1), least)


def indexed(edges: DataFrame, eps: float, least: int = 1, kind: str = "db", settings: Settings = Settings(), index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The same through an index (built here if not given): degree bounds from its tables thin the graph, then the similar pairs are restored exactly."""
    edges = cut(edges)
    index = build_index(edges, settings, kind) if index is None else index
    first = maximum_clique(edges.where("u < v"), 1)[0]
    strong = cut(degree_bounds(index, edges, eps).where(F.col("bound") >= first - 1).select("u"))
    pairs = edges.where("u < v").select("u", "v").unionByName(restore(index, edges, eps))
    pairs = pairs.join(strong, "u", "left_semi").join(strong.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    return _answer(edges, maximum_clique(cut(pairs), 0 if edges.isEmpty() else 1), least)

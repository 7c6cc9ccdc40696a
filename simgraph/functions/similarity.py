"""Common neighbours, Jaccard similarity of neighbourhoods, and the generalized relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common neighbours that a similar pair needs at least (a fixed value).
LEAST_COMMON = 3


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, nbrs): sorted neighbours of each vertex."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("nbrs"))


def jaccard(common: Column, du: Column, dv: Column) -> Column:
    return common.cast("double") / (du + dv - common).cast("double")


def could_be_similar(du: Column, dv: Column, eps: float) -> Column:
    """Degrees that allow similarity: both at least LEAST_COMMON and their ratio at least ``eps``."""
    return (F.least(du, dv) >= LEAST_COMMON) & (F.least(du, dv).cast("double") / F.greatest(du, dv).cast("double") >= eps)


def common_neighbours(edges: DataFrame, eps: float = 0.0, ends: DataFrame | None = None) -> DataFrame:
    """(u, v, du, dv, common) for u < v with at least LEAST_COMMON common neighbours, adjacent or not.

    A self-join over the middle vertex. Degrees ride on the edges, so pairs
    whose degrees rule out ``eps`` never reach the count; each pair is made in
    one direction; the count is partial before its shuffle, and hubs are split
    by the adaptive skew join. ``ends`` (column u) restricts both end points;
    degrees and common neighbours stay those of the whole graph.
    """
    sided = edges.join(degrees(edges).where(F.col("deg") >= LEAST_COMMON), "u").select("u", "v", "deg")
    if ends is not None:
        sided = sided.join(ends.select("u"), "u", "left_semi")
    a = sided.select("u", F.col("deg").alias("du"), F.col("v").alias("w"))
    b = sided.select(F.col("u").alias("v"), F.col("deg").alias("dv"), F.col("v").alias("w"))
    wedges = a.join(b, "w").where((F.col("u") < F.col("v")) & could_be_similar(F.col("du"), F.col("dv"), eps))
    return wedges.groupBy("u", "v", "du", "dv").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= LEAST_COMMON)


def similar_pairs(edges: DataFrame, eps: float, ends: DataFrame | None = None) -> DataFrame:
    """(u, v, common, score) of non-adjacent pairs u < v with LEAST_COMMON common neighbours and Jaccard similarity >= eps."""
    pairs = common_neighbours(edges, eps, ends).withColumn("score", jaccard(F.col("common"), F.col("du"), F.col("dv")))
    return pairs.where(F.col("score") >= eps).join(edges, ["u", "v"], "left_anti").select("u", "v", "common", "score")


def generalized_edges(edges: DataFrame, eps: float, ends: DataFrame | None = None) -> DataFrame:
    """(u, v, kind) for u < v: 'o' adjacent, 's' similar. The two kinds are disjoint."""
    own = edges.where("u < v")
    if ends is not None:
        own = own.join(ends.select("u"), "u", "left_semi").join(ends.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    return own.select("u", "v", F.lit("o").alias("kind")).unionByName(similar_pairs(edges, eps, ends).select("u", "v", F.lit("s").alias("kind")))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(u, v) in both directions of pairs u < v."""
    return pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def pair_similarity(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, common, score) of given pairs, by their neighbour lists."""
    a = adj.select("u", F.col("nbrs").alias("nu"))
    b = adj.select(F.col("u").alias("v"), F.col("nbrs").alias("nv"))
    joined = pairs.select("u", "v").join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("nu", "nv")).cast("long")
    return joined.select("u", "v", common.alias("common"), jaccard(common, F.size("nu"), F.size("nv")).alias("score"))


def top_similar(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, common, rank): each vertex's k most similar non-adjacent vertices by score, then id."""
    pairs = similar_pairs(edges, 0.0)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "common", "score"))
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("u", "v", "common", "rank")

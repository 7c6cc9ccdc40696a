"""Reductions: k-cores, core numbers, orders, densest subgraphs by batch peeling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simgraph.functions.similarity import degrees
from simgraph.runtime import cut


def k_core(edges: DataFrame, k: int, enough: int = 0) -> DataFrame:
    """The edges (both directions) among the vertices of the k-core, by rounds until none falls below.

    With no more than ``enough`` rows left, a round that drops less than a tenth
    is the last: the result then holds the core, and vertices besides it.
    """
    edges = cut(edges.select("u", "v"))
    size = edges.count()
    while size:
        keep = degrees(edges).where(F.col("deg") >= k).select("u")
        edges = cut(edges.join(keep, "u", "left_semi").join(keep.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v"))
        left = edges.count()
        if left == size or 0.9 * size < left <= enough:
            break
        size = left
    return edges


def core_numbers(edges: DataFrame) -> DataFrame:
    """(u, core). Each vertex's number falls to the h-index of its neighbours' numbers until nothing changes.

    Neighbours are counted by number (capped at the vertex's own) before the
    window, so a hub's window holds no more rows than its number.
    """
    edges = cut(edges.select("u", "v"))
    core = cut(degrees(edges).withColumnRenamed("deg", "core"))
    while True:
        seen = edges.join(core.select(F.col("u").alias("v"), F.col("core").alias("theirs")), "v").join(core, "u")
        counts = seen.groupBy("u", "core", F.least("core", "theirs").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("level")))
        new = counts.withColumn("h", F.least("level", above)).groupBy("u").agg(F.max("h").alias("core"), F.first("core").alias("old"))
        new = cut(new)
        changed = not new.where("core <> old").isEmpty()
        core = new.select("u", "core")
        if not changed:
            return core


def ranked(edges: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """(u, core, deg, rank): an order by core number, degree and id, from 1.

    The rank is the place among vertices of equal core number, put behind all
    smaller ones, so that no window holds the whole graph.
    """
    core = core_numbers(edges) if core is None else core
    rows = cut(core.join(degrees(edges), "u"))
    sizes = rows.groupBy("core", "deg").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("core", "deg").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("core", "deg").orderBy("u"))
    return rows.withColumn("place", place).join(F.broadcast(before), ["core", "deg"]).select("u", "core", "deg", (F.coalesce("base", F.lit(0)) + F.col("place")).alias("rank"))


def forward(pairs: DataFrame, rank: DataFrame) -> DataFrame:
    """(u, v) for each pair u < v of the input, turned so that v is the later in rank."""
    a, b = rank.select("u", F.col("rank").alias("ru")), rank.select(F.col("u").alias("v"), F.col("rank").alias("rv"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    early = F.col("ru") < F.col("rv")
    return both.select(F.when(early, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(early, F.col("v")).otherwise(F.col("u")).alias("v"))


def densest_by_peeling(edges: DataFrame, slack: float = 0.1) -> tuple[float, DataFrame]:
    """(density, members(u)) of a subgraph whose edges per vertex are within 2 (1 + slack) of the most.

    Each round drops all vertices of degree up to 2 (1 + slack) times the
    density, so the rounds grow with the logarithm of the vertices.
    """
    edges = cut(edges.select("u", "v"))
    best, kept = 0.0, edges.select("u").distinct()
    while True:
        deg = cut(degrees(edges))
        n, m = deg.agg(F.count(F.lit(1)), F.sum("deg")).first()
        if not n:
            return best, kept
        density = m / 2 / n
        if density > best:
            best, kept = density, deg.select("u")
        stay = deg.where(F.col("deg") > 2 * (1 + slack) * density).select("u")
        edges = cut(edges.join(stay, "u", "left_semi").join(stay.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v"))


def max_core(edges: DataFrame) -> DataFrame:
    """(u, core) of the vertices with the largest core number."""
    core = cut(core_numbers(edges))
    return core.join(F.broadcast(core.agg(F.max("core").alias("core"))), "core", "left_semi").select("u", "core")

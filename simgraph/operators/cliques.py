"""Clique operators: every clique is found once, in the ego network of its lowest-ranked vertex."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.functions.similarity import both_ways
from simgraph.operators.reduce import forward, k_core, ranked
from simgraph.operators.search import all_of_size, bits, greedy_clique, largest_clique, maximal_cliques
from simgraph.runtime import cut, prepare


def ego_edges(fwd: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, a, b): for each root (of ``roots``, column u) the edges among its later neighbours, by a join on triangles.

    Rows with b null name the later neighbours themselves.
    """
    own = fwd if roots is None else fwd.join(roots, "u", "left_semi")
    first = own.select(F.col("u").alias("root"), F.col("v").alias("a"))
    second = own.select(F.col("u").alias("root"), F.col("v").alias("b"))
    triangles = first.join(fwd.select(F.col("u").alias("a"), F.col("v").alias("b")), "a").join(second, ["root", "b"])
    return first.withColumn("b", F.lit(None).cast("long")).unionByName(triangles.select("root", "a", "b"))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(key, the other columns' values) of each run of rows with one value in the first column."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        turns = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for first, end in zip(turns, turns[1:], strict=False):
            part = [c[first:end] for c in columns]
            if held is not None and keys[first] == key:
                for old, new in zip(held, part, strict=True):
                    old += new
            else:
                if held is not None:
                    yield int(key), held
                key, held = keys[first], part
    if held is not None:
        yield int(key), held


def matrix(a: list[int], b: list[int | None]) -> tuple[list[int], list[int]]:
    """Vertex ids and adjacency bit sets of an ego network."""
    ids = sorted(set(a))
    place = {v: i for i, v in enumerate(ids)}
    adj = [0] * len(ids)
    for x, y in zip(a, b, strict=True):
        if y is not None:
            adj[place[x]] |= 1 << place[y]
            adj[place[y]] |= 1 << place[x]
    return ids, adj


def _csv(members: list[int]) -> str:
    return ",".join(map(str, sorted(members)))


def per_group(rows: DataFrame, find: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows ``find`` gives for every value of the first column and the lists of the other columns' values.

    Groups are dealt by that column and streamed through Arrow in sorted order,
    so small groups cost no call of their own.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, columns in grouped(batches):
            out += find(key, *columns)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    key = rows.columns[0]
    prepare(rows.sparkSession)
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def _per_root(egos: DataFrame, find: Callable[[int, list[int], list[int]], Iterator[tuple]], schema: str) -> DataFrame:
    return per_group(egos, lambda root, a, b: find(root, *matrix(a, b)), schema)


def greedy_bound(fwd: DataFrame) -> DataFrame:
    """(root, size, members): a clique in every root's ego network, found greedily; the largest bounds the answer from below."""

    def find(root: int, ids: list[int], adj: list[int]) -> Iterator[tuple]:
        chosen = greedy_clique(adj, (1 << len(ids)) - 1)
        yield root, chosen.bit_count() + 1, _csv([root, *(ids[i] for i in bits(chosen))])

    return _per_root(ego_edges(fwd), find, "root long, size long, members string")


def best_cliques(fwd: DataFrame, above: int = 0, roots: DataFrame | None = None) -> DataFrame:
    """(root, size, members, nodes): of each root a largest clique of more than ``above`` vertices; size 0 if it has none."""

    def find(root: int, ids: list[int], adj: list[int]) -> Iterator[tuple]:
        found, nodes = largest_clique(adj, (1 << len(ids)) - 1, max(0, above - 1))
        size = found.bit_count() + 1 if found else 0
        yield root, size, _csv([root, *(ids[i] for i in bits(found))]) if size else "", nodes

    return _per_root(ego_edges(fwd, roots), find, "root long, size long, members string, nodes long")


def maximum_clique(pairs: DataFrame, vertices: int, batches: int = 3) -> tuple[int, str, int]:
    """(size, members, search nodes) of a largest clique of the pairs u < v; ``vertices`` tells an empty graph from one without edges.

    A greedy bound, a reduction to its core, the order, and searches from the
    roots in batches of falling upper bound: min(later neighbours, core) + 1.
    Each batch takes the best size so far; roots that can't beat it are left
    out before their ego networks are built. A bound equal to the largest core
    number plus one is the answer without a search.
    """
    pairs = cut(pairs.select("u", "v"))
    if pairs.isEmpty():
        return (1, "", 0) if vertices else (0, "", 0)
    both = cut(both_ways(pairs))
    rank = cut(ranked(both))
    fwd = cut(forward(pairs, rank))
    reach = cut(fwd.groupBy("u").agg(F.count(F.lit(1)).alias("later")).join(rank.select("u", "core"), "u").withColumn("bound", F.least("later", "core") + 1))
    top = reach.agg(F.max("bound"), F.max("core")).first()
    strong = fwd.join(reach.where(F.col("bound") >= max(2, top[0] - 1)).select("u"), "u", "left_semi")
    best = greedy_bound(strong).orderBy(F.desc("size"), "members").first()
    size, members, nodes = best.size, best.members, 0
    if size == top[1] + 1:
        return size, members, nodes
    core = cut(k_core(both, size))
    fwd = cut(fwd.join(core, ["u", "v"], "left_semi"))
    for step in range(batches):
        low = size + 1 + (top[0] - size) * (batches - 1 - step) // batches
        roots = reach.where((F.col("bound") >= low) & (F.col("bound") > size)).select("u")
        reach = reach.where(F.col("bound") < low)
        row = best_cliques(fwd, size, roots).agg(F.max(F.struct("size", "members")).alias("best"), F.sum("nodes").alias("nodes")).first()
        nodes += row.nodes or 0
        if row.best is not None and row.best.size > size:
            size, members = row.best.size, row.best.members
    return size, members, nodes


def cliques_of_size(pairs: DataFrame, size: int) -> DataFrame:
    """(members): every clique of ``size`` >= 2 vertices of the pairs u < v, in rising ids."""
    fwd = pairs.select("u", "v")
    if size == 2:
        return fwd.select(F.concat_ws(",", "u", "v").alias("members"))

    def find(root: int, ids: list[int], adj: list[int]) -> Iterator[tuple]:
        for c in all_of_size(adj, 0, (1 << len(ids)) - 1, size - 1):
            yield (_csv([root, *(ids[i] for i in bits(c))]),)

    return _per_root(ego_edges(fwd), find, "members string")


def clique_counts(pairs: DataFrame) -> DataFrame:
    """(sz, n): how many cliques of each size from 2 on; level by level, by joins and array intersections alone."""
    fwd = cut(pairs.select("u", "v"))
    later = cut(fwd.groupBy("u").agg(F.collect_set("v").alias("later")))
    level = cut(later.select(F.col("later").alias("cand")))
    out, size = [], 2
    while True:
        n = level.agg(F.sum(F.size("cand"))).first()[0]
        if not n:
            break
        out.append((size, int(n)))
        step = level.select("cand", F.explode("cand").alias("u")).join(later, "u")
        level = cut(step.select(F.array_intersect("cand", "later").alias("cand")).where(F.size("cand") > 0))
        size += 1
    return pairs.sparkSession.createDataFrame(out, "sz long, n long")


def maximal(pairs: DataFrame, least: int) -> DataFrame:
    """(size, members) of every maximal clique of at least ``least`` (2 or more) vertices of the pairs u < v."""
    fwd = pairs.select("u", "v")
    near = fwd.select(F.col("u").alias("root"), F.col("v").alias("x"), F.lit(True).alias("later")).unionByName(fwd.select(F.col("v").alias("root"), F.col("u").alias("x"), F.lit(False).alias("later")))
    alone = near.select("root", F.col("x").alias("a"), F.lit(None).cast("long").alias("b"), "later")
    a, b = near.select("root", F.col("x").alias("a"), "later"), near.select("root", F.col("x").alias("b"))
    closed = a.join(fwd.select(F.col("u").alias("a"), F.col("v").alias("b")), "a").join(b, ["root", "b"]).select("root", "a", "b", "later")

    def find(root: int, a: list[int], b: list[int | None], later: list[bool]) -> Iterator[tuple]:
        ids, adj = matrix(a, b)
        free = {x for x, y, z in zip(a, b, later, strict=True) if y is None and z}
        left = sum(1 << i for i, v in enumerate(ids) if v in free)
        for c in maximal_cliques(adj, 0, left, (1 << len(ids)) - 1 & ~left, least - 1):
            yield c.bit_count() + 1, _csv([root, *(ids[i] for i in bits(c))])

    return per_group(alone.unionByName(closed), find, "size long, members string")


def invalid_pairs(cliques: DataFrame, pairs: DataFrame) -> DataFrame:
    """(members, u, v): pairs of a clique's members that aren't among the pairs u < v; no rows for valid cliques."""
    ids = F.transform(F.split("members", ","), lambda x: x.cast("long"))
    each = cliques.select("members", F.posexplode(ids).alias("i", "u"), ids.alias("ids"))
    both = each.select("members", "u", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("v"))
    return both.select("members", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(pairs.select("u", "v"), ["u", "v"], "left_anti")


def similar_share(cliques: DataFrame, kinds: DataFrame) -> DataFrame:
    """(cliques, with_similar, least_pct, most_pct): how far cliques (members) rest on similar pairs; percents rounded down."""
    ids = F.transform(F.split("members", ","), lambda x: x.cast("long"))
    each = cliques.select("members", F.posexplode(ids).alias("i", "u"), ids.alias("ids"))
    both = each.select("members", "u", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("v"))
    turned = both.select("members", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(kinds, ["u", "v"])
    similar = F.sum(F.when(F.col("kind") == "s", 1).otherwise(0))
    per = turned.groupBy("members").agg(F.floor(100 * similar / F.count(F.lit(1))).cast("long").alias("pct"), similar.alias("s"))
    return per.agg(F.count(F.lit(1)).alias("cliques"), F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).cast("long").alias("with_similar"), F.min("pct").alias("least_pct"), F.max("pct").alias("most_pct"))

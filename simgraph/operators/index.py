"""Similarity indexes: dense blocks (MinHash, LSH) or bicliques, and a residual list; one block or list holds each logical pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simgraph.functions.similarity import adjacency, pair_similarity, similar_pairs
from simgraph.operators.cliques import per_group
from simgraph.runtime import cut


#: Signatures of a band in a chunk.
CHUNK = 1024


@dataclass(frozen=True)
class Settings:
    """tau: least degree in the compressed part; k hashes in ``bands``; threshold: signature similarity of a cluster's
    members to its centre; rho: least support of a right vertex; sizes and gain of a block; stops of the rounds."""

    tau: int = 2
    rounds: int = 3
    k: int = 16
    bands: int = 8
    threshold: float = 0.3
    rho: float = 0.6
    least_cluster: int = 2
    least_gain: int = 1
    least_progress: float = 0.002
    anchors: int = 128

    def __post_init__(self) -> None:
        if self.k % self.bands:
            raise ValueError("k isn't a multiple of bands")
        if not (0 <= self.threshold <= 1 and 0 <= self.rho <= 1):
            raise ValueError("threshold and rho lie between 0 and 1")


def bigraph(sim: DataFrame) -> DataFrame:
    """(l, r, common, score): every similar pair in both directions."""
    return sim.select(F.col("u").alias("l"), F.col("v").alias("r"), "common", "score").unionByName(sim.select(F.col("v").alias("l"), F.col("u").alias("r"), "common", "score"))


def peel(bi: DataFrame, tau: int, cascade: bool = True) -> DataFrame:
    """What stays of the bigraph when vertices with fewer than ``tau`` links go: both sides until stable, or the left side once."""
    bi = cut(bi)
    size = bi.count()
    while size:
        bi = bi.join(bi.groupBy("l").count().where(F.col("count") >= tau).select("l"), "l", "left_semi")
        if cascade:
            bi = cut(bi)
            bi = bi.join(bi.groupBy("r").count().where(F.col("count") >= tau).select("r"), "r", "left_semi")
        bi = cut(bi.select("l", "r", "common", "score"))
        left = bi.count()
        if not cascade or left == size:
            break
        size = left
    return bi


def signatures(bi: DataFrame, k: int) -> DataFrame:
    """(l, sig): k MinHash values of each left vertex's right side, in one aggregation."""
    mins = bi.groupBy("l").agg(*[F.min(F.xxhash64(F.col("r"), F.lit(i))).alias(f"h{i}") for i in range(k)])
    return mins.select("l", F.array(*[F.col(f"h{i}") for i in range(k)]).alias("sig"))


def band_keys(sig: DataFrame, k: int, bands: int) -> DataFrame:
    """(l, sig, band, key): one row for each band of a signature."""
    rows = k // bands
    keys = F.array(*[F.xxhash64(F.slice("sig", b * rows + 1, rows)) for b in range(bands)])
    return sig.select("l", "sig", F.posexplode(keys).alias("band", "key"))


def candidates(sig: DataFrame, k: int, bands: int) -> DataFrame:
    """(centre, l, est): pairs centre < l that share a band, and how much of their signatures agrees.

    The smallest id of each signature stands for it: vertices with equal
    signatures meet that one only (est 1), and of those that stand for one,
    every two that share a band meet (est below 1). A band with more than
    CHUNK of them is cut into chunks by hash, every two of which meet in a
    bucket of their own.
    """
    sig = cut(sig)
    reps = cut(sig.groupBy("sig").agg(F.min("l").alias("l")).select("l", "sig"))
    alike = sig.join(reps.select("sig", F.col("l").alias("centre")), "sig").where("centre < l").select("centre", "l", F.lit(1.0).alias("est"))
    keys = cut(band_keys(reps, k, bands).select("l", "band", "key"))
    chunks = keys.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keys.join(chunks.drop("n"), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("l"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "l")
    a, b = dealt.withColumnsRenamed({"l": "centre", "own": "of_centre"}), dealt
    met = a.join(b, ["band", "key", "x", "y"]).where("centre < l and (x = y or of_centre <> own)").select("centre", "l").distinct()
    pairs = met.join(reps.select("l", F.col("sig").alias("s")), "l").join(reps.select(F.col("l").alias("centre"), F.col("sig").alias("c")), "centre")
    same = F.size(F.filter(F.zip_with("s", "c", lambda a, b: a == b), lambda x: x))
    return alike.unionByName(pairs.select("centre", "l", (same / F.lit(float(k))).alias("est")))


def lsh_clusters(bi: DataFrame, s: Settings) -> DataFrame:
    """(cid, l): disjoint clusters. The smallest free vertex is a centre and takes what qualifies, until none is free; the taken join the most similar of their smaller centres.

    In each round every vertex without a smaller free partner becomes a centre,
    which chooses the same centres as going through the ids one by one.
    """
    found = cut(candidates(signatures(bi, s.k), s.k, s.bands).where(F.col("est") >= s.threshold))
    alike, close = found.where("est = 1"), found.where("est < 1")
    free, taken = cut(close.select("centre", "l")), close.select("l").limit(0)
    while not free.isEmpty():
        heads = free.select("centre").distinct().join(free.select(F.col("l").alias("centre")).distinct(), "centre", "left_anti")
        hit = cut(free.join(heads, "centre", "left_semi").select("l").distinct())
        taken = cut(taken.unionByName(hit))
        free = cut(free.join(hit, "l", "left_anti").join(hit.select(F.col("l").alias("centre")), "centre", "left_anti"))
    near = close.join(taken.select(F.col("l").alias("centre")), "centre", "left_anti")
    best = cut(near.groupBy("l").agg(F.min(F.struct((-F.col("est")).alias("e"), F.col("centre").alias("cid"))).alias("best")).select(F.col("best.cid").alias("cid"), "l"))
    equal = alike.join(best.select(F.col("l").alias("centre"), "cid"), "centre", "left").select(F.coalesce("cid", "centre").alias("cid"), "l")
    joined = best.unionByName(equal)
    return joined.unionByName(joined.select("cid", F.col("cid").alias("l")).distinct())


def prefix_clusters(sig: DataFrame, prefix: int, least: int = 2) -> DataFrame:
    """(cid, l): vertices whose first ``prefix`` MinHash values agree, by the smallest id; a shorter rule than bands, without a threshold."""
    rows = sig.select("l", F.slice("sig", 1, prefix).alias("head"))
    heads = rows.groupBy("head").agg(F.min("l").alias("cid"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(heads, "head").select("cid", "l")


def block_stats(index: dict[str, DataFrame]) -> DataFrame:
    """(blocks, lefts, rights, residual): how much of the relation the blocks of an index hold."""
    member, right = index["member"], index["block_right"]
    sizes = member.agg(F.countDistinct("z").alias("blocks"), F.count(F.lit(1)).alias("lefts"))
    return sizes.crossJoin(right.agg(F.count(F.lit(1)).alias("rights"))).crossJoin(index["residual"].agg(F.count(F.lit(1)).alias("residual")))


def bicluster_support(bi: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cid, r, count, size): links of each right vertex into each cluster."""
    sizes = clusters.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    return bi.join(clusters, "l").groupBy("cid", "r").agg(F.count(F.lit(1)).alias("count")).join(sizes, "cid")


def biclusters(bi: DataFrame, clusters: DataFrame, s: Settings, held: DataFrame | None = None) -> DataFrame:
    """(cid, r): each right vertex in the cluster that supports it most (share, then count, then id), if by rho; clusters with enough gain.

    ``held`` (l, r): links in blocks of earlier rounds. A cluster with such a
    link to a right vertex can't take it, or two blocks would span the link.
    """
    share = bicluster_support(bi, clusters).withColumn("support", F.col("count") / F.col("size"))
    if held is not None:
        share = share.join(held.join(clusters, "l").select("cid", "r").distinct(), ["cid", "r"], "left_anti")
    order = Window.partitionBy("r").orderBy(F.desc("support"), F.desc("count"), "cid")
    own = share.where((F.col("support") >= s.rho) & (F.col("size") >= s.least_cluster)).withColumn("k", F.row_number().over(order)).where("k = 1")
    gain = own.groupBy("cid").agg((F.sum("count") - F.max("size") - F.count(F.lit(1))).alias("gain"), F.count(F.lit(1)).alias("rights"))
    good = gain.where((F.col("gain") >= s.least_gain) & (F.col("rights") >= s.least_cluster)).select("cid")
    return own.join(good, "cid", "left_semi").select("cid", "r")


def _bicliques(bi: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cid, l) and (cid, r) of disjoint complete blocks: grown from each seed greedily, conflicts won by gain, then id.

    A seed's candidates are at most ``anchors`` left vertices by shared links;
    what no block covers stays in the residual lists, so nothing is lost.
    """
    degree = bi.groupBy("r").agg(F.count(F.lit(1)).alias("d"))
    a = bi.select(F.col("l").alias("seed"), "r").join(degree, "r")
    order = Window.partitionBy("seed").orderBy("d", "r")
    rare = a.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2).select("seed", "r")
    near = rare.join(bi.select("l", "r"), "r").select("seed", "l").distinct()
    shared = near.join(bi.select("l", "r"), "l").join(a.select("seed", "r"), ["seed", "r"])
    count = shared.groupBy("seed", "l").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("seed").orderBy(F.desc("n"), "l")
    near = count.withColumn("k", F.row_number().over(top)).where(F.col("k") <= s.anchors).select("seed", "l")
    rows = near.join(shared, ["seed", "l"]).select("seed", "l", "r")

    def grow(seed: int, lefts: list[int], rights: list[int]) -> Iterator[tuple]:
        of: dict[int, set[int]] = {}
        for x, y in zip(lefts, rights, strict=True):
            of.setdefault(x, set()).add(y)
        left, right = [seed], of.get(seed, set())
        rest = sorted(of.keys() - {seed})
        best = (0, list(left), right)
        while rest:
            nxt = max(rest, key=lambda x: (len(of[x] & right), -x))
            both = of[nxt] & right
            if len(both) < s.least_cluster:
                break
            left, right = [*left, nxt], both
            rest.remove(nxt)
            gain = len(left) * len(right) - len(left) - len(right)
            if gain > best[0]:
                best = (gain, list(left), right)
        if best[0] >= s.least_gain and len(best[1]) >= s.least_cluster:
            for x in best[1]:
                for y in best[2]:
                    yield seed, best[0], x, y

    claims = cut(per_group(rows, grow, "seed long, gain long, l long, r long"))
    win = Window.partitionBy("l", "r").orderBy(F.desc("gain"), "seed")
    lost = claims.withColumn("k", F.row_number().over(win)).where("k > 1").select("seed").distinct()
    won = claims.join(lost, "seed", "left_anti")
    return won.select(F.col("seed").alias("cid"), "l").distinct(), won.select(F.col("seed").alias("cid"), "r").distinct()


def build_index(edges: DataFrame, s: Settings = Settings(), kind: str = "db") -> dict[str, DataFrame]:
    """residual(u, v, common, score), member(u, z), block_right(z, v, ub_score): every pair with LEAST_COMMON common neighbours.

    ``kind``: "db" dense blocks, "batch" the same with one left-side peel a
    round, "bc" bicliques. Scores are kept whole. Rounds stop when a round
    moves less than ``least_progress`` of the links, or after ``rounds``.
    """
    bi = cut(bigraph(similar_pairs(edges, 0.0)))
    total, alive = bi.count(), peel(bi, s.tau, kind != "batch")
    members, rights, held, base = [], [], None, 0
    residual = bi
    for step in range(s.rounds):
        if alive.isEmpty():
            break
        if kind == "bc":
            left, right = _bicliques(alive, s)
        else:
            left = cut(lsh_clusters(alive, s))
            right = cut(biclusters(alive, left, s, held))
            left = left.join(right.select("cid").distinct(), "cid", "left_semi")
        left, right = cut(left.withColumn("z", F.col("cid") * s.rounds + step)), cut(right.withColumn("z", F.col("cid") * s.rounds + step))
        inside = cut(alive.join(left.select("z", "l"), "l").join(right.select("z", "r"), ["z", "r"]).select("z", "l", "r", "score"))
        moved = inside.count()
        if not moved:
            break
        members.append(left.select(F.col("l").alias("u"), "z"))
        rights.append(inside.groupBy("z", F.col("r").alias("v")).agg(F.max("score").alias("ub_score")))
        held = inside.select("l", "r") if held is None else held.unionByName(inside.select("l", "r"))
        residual = cut(residual.join(inside.select("l", "r"), ["l", "r"], "left_anti"))
        alive = peel(alive.join(inside.select("l", "r"), ["l", "r"], "left_anti"), s.tau, kind != "batch")
        base += moved
        if moved < s.least_progress * total:
            break
    spark = edges.sparkSession
    member, right = spark.createDataFrame([], "u long, z long"), spark.createDataFrame([], "z long, v long, ub_score double")
    for m, r in zip(members, rights, strict=True):
        member, right = member.unionByName(m), right.unionByName(r)
    return {"residual": cut(residual.select(F.col("l").alias("u"), F.col("r").alias("v"), "common", "score")), "member": cut(member), "block_right": cut(right)}


def restore(index: dict[str, DataFrame], edges: DataFrame, eps: float, queries: DataFrame | None = None) -> DataFrame:
    """(u, v) for u < v: the similar pairs at ``eps``, from an index. ``queries`` (q): only pairs of those vertices.

    Residual entries are exact. A block's candidates pass if their bound
    reaches ``eps`` and are then verified by their neighbour lists, since a dense
    block also spans pairs that it doesn't hold.
    """
    listed, member = index["residual"].where(F.col("score") >= eps).select("u", "v"), index["member"]
    if queries is not None:
        own = queries.select(F.col("q").alias("u")).distinct()
        listed, member = listed.join(own, "u", "left_semi"), member.join(own, "u", "left_semi")
    spanned = member.join(index["block_right"].where(F.col("ub_score") >= eps), "z").where("u <> v").select("u", "v")
    turned = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    held = cut(turned(listed))
    open_ = turned(spanned).join(held, ["u", "v"], "left_anti").join(edges, ["u", "v"], "left_anti")
    exact = pair_similarity(adjacency(edges), open_).where((F.col("common") >= 3) & (F.col("score") >= eps))
    return held.unionByName(exact.select("u", "v"))


def degree_bounds(index: dict[str, DataFrame], edges: DataFrame, eps: float) -> DataFrame:
    """(u, bound): at least as many as the generalized neighbours of u: adjacent, listed, or spanned by a block whose bound passes."""
    spanned = index["member"].join(index["block_right"].where(F.col("ub_score") >= eps), "z").where("u <> v").select("u", "v")
    near = edges.select("u", "v").unionByName(index["residual"].where(F.col("score") >= eps).select("u", "v")).unionByName(spanned)
    return near.distinct().groupBy("u").agg(F.count(F.lit(1)).alias("bound"))

"""The library's own queries over graphs derived from the driver's tables, and their SQL for DuckDB.

G_sc joins customers and suppliers (sources.graph.customer_supplier), G_cp
parts bought together (copurchase). Queries keep to integers and strings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simgraph.functions import similarity
from simgraph.operators import cliques, extras, heuristics, index, reduce, vertex
from simgraph.plans import maximum
from simgraph.runtime import cut, prepare
from simgraph.sources import graph

EPS = 0.2
Q = 0
QUERY_IDS = 40
CORE = 6
#: The stated query vertices of a search.
_STATED = "u % 20 = 0"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SC = """e AS (SELECT DISTINCT o_custkey c, l_suppkey s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 45),
g AS (SELECT 2 * c AS u, 2 * s + 1 AS v FROM e UNION ALL SELECT 2 * s + 1, 2 * c FROM e)"""
_CP = """g AS (SELECT DISTINCT a.l_partkey u, b.l_partkey v FROM lineitem a JOIN lineitem b USING (l_orderkey)
WHERE a.l_partkey <> b.l_partkey AND a.l_quantity >= 40 AND b.l_quantity >= 40)"""
_DEG = "deg AS (SELECT u, count(*) d FROM g GROUP BY u)"
_CN = "cn AS (SELECT a.u u, b.u v, count(*) c FROM g a JOIN g b ON a.v = b.v AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= 3)"


def _sim(eps: float) -> str:
    return f"""{_DEG}, {_CN},
sim AS (SELECT cn.u, cn.v, c AS common, p.d + q.d - c AS joined FROM cn JOIN deg p ON p.u = cn.u JOIN deg q ON q.u = cn.v
ANTI JOIN g ON g.u = cn.u AND g.v = cn.v WHERE c / (p.d + q.d - c)::DOUBLE >= {eps})"""


def _ge(eps: float) -> str:
    return f"""{_sim(eps)}, ge AS (SELECT u, v, 'o' AS kind FROM g WHERE u < v UNION ALL SELECT u, v, 's' FROM sim),
gg AS (SELECT u, v FROM ge UNION ALL SELECT v, u FROM ge)"""


_CLIQUES = """k(sz, last, mem) AS (
SELECT 2, v, [u, v] FROM ge UNION ALL
SELECT k.sz + 1, x.v, list_append(k.mem, x.v) FROM k JOIN ge x ON x.u = k.last
WHERE (SELECT count(*) FROM ge y WHERE y.v = x.v AND list_contains(k.mem, y.u)) = k.sz)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.customer_supplier(spark, sf_dir)


def _one(spark: SparkSession, schema: str, *values: object) -> DataFrame:
    return spark.createDataFrame([values], schema)


@_query(_with(_SC, _DEG) + "SELECT count(*) AS n, sum(d)::BIGINT AS m, max(d) AS max_degree FROM deg")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.degrees(_sc(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.sum("deg").alias("m"), F.max("deg").alias("max_degree"))


@_query(_with(_SC) + "SELECT u, count(*) AS deg FROM g GROUP BY u")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.degrees(_sc(spark, sf_dir))


@_query(_with(_SC) + "SELECT u, string_agg(v::VARCHAR, ',' ORDER BY v) AS nbrs FROM g GROUP BY u")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.adjacency(_sc(spark, sf_dir)).select("u", F.array_join("nbrs", ",").alias("nbrs"))


@_query(_with(_SC, _CN) + "SELECT u, v, c AS common FROM cn")
def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.common_neighbours(_sc(spark, sf_dir)).select("u", "v", "common")


def _similar(pct: int) -> None:
    @_query(_with(_SC, _sim(pct / 100)) + "SELECT u, v, common FROM sim")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.similar_pairs(_sc(spark, sf_dir), pct / 100).select("u", "v", "common")

    QUERIES[f"similar_pairs_eps{pct}"], ORACLES[f"similar_pairs_eps{pct}"] = QUERIES.pop("query"), ORACLES.pop("query")


for _pct in (20, 30, 50):
    _similar(_pct)


@_query(_with(_SC, _sim(0)) + "SELECT u, v, (100 * common) // joined AS pct FROM sim")
def similar_pairs_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.common_neighbours(_sc(spark, sf_dir))
    return pairs.join(_sc(spark, sf_dir), ["u", "v"], "left_anti").select("u", "v", F.floor(100 * F.col("common") / (F.col("du") + F.col("dv") - F.col("common"))).cast("long").alias("pct"))


#: Query vertices and partners of one degree that meet as a block.
_BLOCK, _CHUNK = 256, 8192
#: Partners that meet a block of query vertices at a time.
_PART = 512
#: Tasks for each core that make rows of the blocks.
_DEALT = 8


def _blocks(deg: DataFrame, size: int, degree: str, block: str, ids: str) -> DataFrame:
    """(degree, block, ids): the vertices of each degree in blocks of rising ids."""
    place = F.row_number().over(Window.partitionBy("deg").orderBy("u")) - 1
    dealt = deg.select(F.col("deg").alias(degree), F.floor(place / size).alias(block), "u")
    return dealt.groupBy(degree, block).agg(F.array_sort(F.collect_list("u")).alias(ids))


def _degree_partners(spark: SparkSession, sf_dir: str, smaller: bool) -> DataFrame:
    """(u, v): each query vertex and all vertices of larger ids that its degree allows to be similar; ``smaller``: such of smaller ids too.

    The rows grow with the square of the vertices, so blocks of both sides
    meet, and rows are made of them last. Within a block a run of rows shares
    its v and the u repeat, which files and shuffles pack well. Pairs of blocks
    are few bytes for the rows that they become, which adaptive execution can't
    know: they are dealt to a fixed count of tasks, so that all cores make rows.
    """
    deg = cut(similarity.degrees(_sc(spark, sf_dir)).where(F.col("deg") >= similarity.LEAST_COMMON))
    a, b = _blocks(deg.where(_STATED), _BLOCK, "du", "x", "us"), cut(_blocks(deg, _CHUNK, "dv", "y", "vs"))
    near = a.join(b.select("dv", "y"), similarity.could_be_similar(F.col("du"), F.col("dv"), EPS))
    tasks = max(_DEALT * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = near.join(b, ["dv", "y"]).repartition(tasks, "du", "x", "dv", "y")
    parts = F.transform(F.sequence(F.lit(1), F.size("vs"), F.lit(_PART)), lambda at: F.slice("vs", at, _PART))  # so that a batch of 10,000 rows stays some 60 MB

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for us, vs in zip(*batch.columns, strict=True):
                us, vs = us.values.to_numpy(), vs.values.to_numpy()
                u, v = np.tile(us, len(vs)), np.repeat(vs, len(us))
                keep = (u < v) | (u > v) & (v % 20 != 0) if smaller else u < v
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return pairs.select("us", F.explode(parts).alias("vs")).mapInArrow(make, "u long, v long")


@_query(_with(_SC, _DEG) + f"SELECT a.u, b.u AS v FROM deg a JOIN deg b ON a.u < b.u AND a.u % 20 = 0 AND least(a.d, b.d) >= 3 AND least(a.d, b.d) / greatest(a.d, b.d)::DOUBLE >= {EPS}")
def degree_ratio_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that degrees allow to be similar, for the stated query vertices (ids divisible by 20) against all."""
    return _degree_partners(spark, sf_dir, False)


@_query()
def degree_ratio_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``degree_ratio_candidates``, with partners of smaller ids too: every partner of each query vertex; a pair of two of them once, u < v."""
    return _degree_partners(spark, sf_dir, True)


@_query(_with(_SC, _sim(0)) + """, both_ AS (SELECT u, v, common, joined FROM sim UNION ALL SELECT v, u, common, joined FROM sim)
SELECT u, v, common, rank FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY common / joined::DOUBLE DESC, v) AS rank FROM both_) WHERE rank <= 3""")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.top_similar(_sc(spark, sf_dir), 3).withColumn("rank", F.col("rank").cast("long"))


@_query(_with(_SC, _ge(EPS)) + "SELECT u, v, kind FROM ge")
def generalized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.generalized_edges(_sc(spark, sf_dir), EPS)


@_query(_with(_SC, _ge(EPS)) + "SELECT u, count(*) AS deg FROM gg GROUP BY u")
def generalized_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.degrees(similarity.both_ways(similarity.generalized_edges(_sc(spark, sf_dir), EPS)))


@_query("SELECT 0::BIGINT AS too_small")
def degree_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vertices have a degree bound from the index below their generalized degree: none."""
    edges = cut(_sc(spark, sf_dir))
    bound = index.degree_bounds(index.build_index(edges), edges, EPS)
    true = similarity.degrees(similarity.both_ways(similarity.generalized_edges(edges, EPS)))
    return true.join(bound, "u", "left").where("bound is null or bound < deg").agg(F.count(F.lit(1)).alias("too_small"))


@_query(_with(_SC, "a AS (SELECT u, string_agg(v::VARCHAR, ',' ORDER BY v) AS nbrs FROM g GROUP BY u HAVING count(*) >= 3)") + "SELECT nbrs, count(*) AS n FROM a GROUP BY nbrs HAVING count(*) > 1")
def false_twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.false_twins(_sc(spark, sf_dir))


@_query(_with(_CP) + "SELECT a.u, count(*) AS n FROM g a JOIN g b ON a.v = b.u AND a.u < a.v AND b.u < b.v JOIN g c ON c.u = a.u AND c.v = b.v GROUP BY a.u")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles by their smallest vertex."""
    fwd = graph.copurchase(spark, sf_dir).where("u < v")
    return cliques.ego_edges(fwd).where("b is not null").groupBy(F.col("root").alias("u")).agg(F.count(F.lit(1)).alias("n"))


@_query(_with(_SC, _ge(EPS)) + f", r AS (SELECT v AS u FROM gg WHERE u = {Q}) SELECT ge.u AS a, ge.v AS b FROM ge SEMI JOIN r x ON x.u = ge.u SEMI JOIN r y ON y.u = ge.v")
def ego_edges_of_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_sc(spark, sf_dir))
    near = cut(vertex.closed_neighbourhoods(edges, EPS, _one(spark, "q long", Q)).where("q <> u").select("u"))
    return similarity.generalized_edges(edges, EPS, near).select(F.col("u").alias("a"), F.col("v").alias("b"))


@_query(_with(_SC, _ge(EPS)) + f"SELECT v AS u FROM gg WHERE u = {Q} UNION ALL SELECT {Q}::BIGINT")
def closed_neighborhood_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex.closed_neighbourhoods(_sc(spark, sf_dir), EPS, _one(spark, "q long", Q)).select("u")


@_query(_with(_SC) + f"SELECT {Q}::BIGINT AS u UNION SELECT v FROM g WHERE u = {Q} UNION SELECT b.v FROM g a JOIN g b ON a.v = b.u WHERE a.u = {Q}")
def two_hop_region_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex.two_hop_region(_sc(spark, sf_dir), Q)


def _core_sql(pairs: str, k: int) -> str:
    return f"""peel(i, alive) AS (SELECT 0, (SELECT list(DISTINCT u) FROM {pairs}) UNION ALL
SELECT i + 1, nxt FROM (SELECT i, alive, (SELECT coalesce(list(u), []) FROM (SELECT u FROM {pairs} WHERE list_contains(alive, u) AND list_contains(alive, v) GROUP BY u HAVING count(*) >= {k})) AS nxt FROM peel)
WHERE len(nxt) < len(alive)) SELECT unnest(alive) AS u FROM (SELECT alive FROM peel ORDER BY i DESC LIMIT 1)"""


@_query(_with(_SC, _core_sql("g", CORE)))
def kcore_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.k_core(_sc(spark, sf_dir), CORE).select("u").distinct()


@_query(_with(_SC, _ge(EPS), _core_sql("gg", CORE + 2)))
def generalized_kcore_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.generalized_edges(_sc(spark, sf_dir), EPS)
    return reduce.k_core(similarity.both_ways(pairs), CORE + 2).select("u").distinct()


@_query(_with(_SC, """peel(i, k, stable, alive) AS (SELECT 0, 1, false, (SELECT list(DISTINCT u) FROM g) UNION ALL
SELECT i + 1, CASE WHEN len(nxt) = len(alive) THEN k + 1 ELSE k END, len(nxt) = len(alive), nxt FROM (
SELECT i, k, alive, (SELECT coalesce(list(u), []) FROM (SELECT u FROM g WHERE list_contains(alive, u) AND list_contains(alive, v) GROUP BY u HAVING count(*) >= k)) AS nxt FROM peel)
WHERE len(alive) > 0)""") + "SELECT u, max(k - 1)::BIGINT AS core FROM (SELECT k, unnest(alive) AS u FROM peel WHERE stable) GROUP BY u")
def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.core_numbers(_sc(spark, sf_dir))


@_query(ORACLES["core_numbers"].replace("SELECT u, max(k - 1)::BIGINT AS core FROM", "SELECT u, core, row_number() OVER (ORDER BY core, d, u) AS rank FROM (SELECT c.u, core, d FROM (SELECT u, max(k - 1)::BIGINT AS core FROM") + ") c JOIN (SELECT u, count(*) d FROM g GROUP BY u) USING (u))")
def degeneracy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.ranked(_sc(spark, sf_dir)).select("u", "core", "rank")


@_query(ORACLES["core_numbers"].replace("SELECT u, max(k - 1)::BIGINT AS core FROM", "SELECT u, core FROM (SELECT *, max(core) OVER () AS top FROM (SELECT u, max(k - 1)::BIGINT AS core FROM") + ")) WHERE core = top")
def max_core_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.max_core(_sc(spark, sf_dir))


@_query(_with(_SC, _ge(EPS), _CLIQUES) + "SELECT sz::BIGINT AS sz, count(*) AS n FROM k GROUP BY sz")
def clique_count_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.clique_counts(similarity.generalized_edges(_sc(spark, sf_dir), EPS))


_SIZE = _with(_SC, _ge(EPS), _CLIQUES) + "SELECT max(sz)::BIGINT AS size FROM k"


@_query(_SIZE)
def mgc_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximum.materialized(_sc(spark, sf_dir), EPS).select("size")


@_query(_SIZE)
def mgc_size_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximum.progressive(_sc(spark, sf_dir), EPS).select("size")


@_query(_SIZE)
def mgc_size_db_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximum.indexed(_sc(spark, sf_dir), EPS).select("size")


@_query(_SIZE)
def mgc_size_bc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximum.indexed(_sc(spark, sf_dir), EPS, kind="bc").select("size")


@_query(_with(_CP, "ge AS (SELECT u, v FROM g WHERE u < v)", _CLIQUES) + "SELECT max(sz)::BIGINT AS size FROM k")
def structural_max_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.copurchase(spark, sf_dir).where("u < v")
    return _one(spark, "size long", cliques.maximum_clique(pairs, 1)[0])


_CSV = "array_to_string(list_sort(mem), ',') AS members"


@_query(_with(_SC, _ge(EPS), _CLIQUES, "sub AS (SELECT DISTINCT array_to_string(list_sort(list_filter(mem, lambda x: x <> y)), ',') AS members FROM (SELECT mem, unnest(mem) AS y FROM k))") + f"SELECT sz::BIGINT AS size, members FROM (SELECT sz, {_CSV} FROM k WHERE sz >= 3) ANTI JOIN sub USING (members)")
def maximal_cliques_ge_sz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.maximal(cut(similarity.generalized_edges(_sc(spark, sf_dir), EPS)), 3)


@_query(_with(_SC, _ge(EPS), _CLIQUES) + f"SELECT {_CSV} FROM k WHERE sz = (SELECT max(sz) FROM k)")
def max_cliques_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cut(similarity.generalized_edges(_sc(spark, sf_dir), EPS))
    return cliques.cliques_of_size(pairs, cliques.maximum_clique(pairs, 1)[0])


@_query(_with(_SC, _ge(EPS), _CLIQUES, f"top AS (SELECT {_CSV}, mem FROM k WHERE sz = (SELECT max(sz) FROM k))", "prs AS (SELECT members, a, b FROM (SELECT members, mem, unnest(mem) AS a FROM top) t, unnest(t.mem) AS x(b) WHERE a < b)", "per AS (SELECT members, (100 * count(*) FILTER (WHERE kind = 's')) // count(*) AS pct, count(*) FILTER (WHERE kind = 's') AS s FROM prs JOIN ge ON ge.u = a AND ge.v = b GROUP BY members)") + "SELECT count(*) AS cliques, count(*) FILTER (WHERE s > 0) AS with_similar, min(pct) AS least_pct, max(pct) AS most_pct FROM per")
def clique_similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cut(similarity.generalized_edges(_sc(spark, sf_dir), EPS))
    return cliques.similar_share(cliques.cliques_of_size(pairs, cliques.maximum_clique(pairs, 1)[0]), pairs)


@_query("SELECT 0::BIGINT AS invalid")
def clique_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of members of the cliques found that aren't generalized neighbours: none."""
    pairs = cut(similarity.generalized_edges(_sc(spark, sf_dir), EPS))
    return cliques.invalid_pairs(cliques.maximal(pairs, 3), pairs).agg(F.count(F.lit(1)).alias("invalid"))


_THROUGH = _with(_SC, _ge(EPS), _CLIQUES) + "SELECT q, max(sz)::BIGINT AS size FROM (SELECT sz, unnest(mem) AS q FROM k) WHERE {} GROUP BY q"


@_query(_THROUGH.format(f"q = {Q}"))
def vertex_gc_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex.largest_through(cut(_sc(spark, sf_dir)), EPS, _one(spark, "q long", Q)).select("q", "size")


@_query(_THROUGH.format(f"q < {QUERY_IDS}"))
def vertex_gc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_sc(spark, sf_dir))
    return vertex.largest_through(edges, EPS, edges.where(F.col("u") < QUERY_IDS).select(F.col("u").alias("q"))).select("q", "size")


@_query(_THROUGH.format(f"q < {QUERY_IDS}"))
def vertex_gc_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_sc(spark, sf_dir))
    pairs = cut(edges.where("u < v").unionByName(index.restore(index.build_index(edges), edges, EPS)))
    return vertex.largest_through(edges, EPS, edges.where(F.col("u") < QUERY_IDS).select(F.col("u").alias("q")), pairs).select("q", "size")


@_query(ORACLES["vertex_gc_batch"].replace("SELECT q, max(sz)::BIGINT AS size FROM", "SELECT count(*) AS queries, min(size) AS least, max(size) AS most, sum(size)::BIGINT AS total FROM (SELECT q, max(sz)::BIGINT AS size FROM") + ")")
def vertex_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_gc_batch(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total"))


def _stated(edges: DataFrame) -> DataFrame:
    return edges.where(_STATED).select(F.col("u").alias("q"))


@_query()
def vertex_gc_batch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vertex_gc_batch``, through every vertex whose id 20 divides, so that the work grows with the graph."""
    edges = cut(_sc(spark, sf_dir))
    return vertex.largest_through(edges, EPS, _stated(edges)).select("q", "size")


@_query()
def vertex_gc_indexed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_sc(spark, sf_dir))
    pairs = cut(edges.where("u < v").unionByName(index.restore(index.build_index(edges), edges, EPS)))
    return vertex.largest_through(edges, EPS, _stated(edges), pairs).select("q", "size")


@_query()
def vertex_batch_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_gc_batch_all(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total"))


@_query()
def greedy_clique_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cut(similarity.generalized_edges(_sc(spark, sf_dir), EPS).select("u", "v"))
    return cliques.greedy_bound(cut(reduce.forward(pairs, reduce.ranked(similarity.both_ways(pairs))))).select("root", "size")


@_query("SELECT 0::BIGINT AS invalid, 0::BIGINT AS too_large")
def quick_bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick lower bound is a clique, and no larger than the largest."""
    edges = cut(_sc(spark, sf_dir))
    pairs = cut(similarity.generalized_edges(edges, EPS).select("u", "v"))
    found = heuristics.quick_bound(edges, pairs)
    bad = cliques.invalid_pairs(_one(spark, "members string", ",".join(map(str, found))), pairs).count()
    return _one(spark, "invalid long, too_large long", bad, max(0, len(found) - cliques.maximum_clique(pairs, 1)[0]))


@_query(_with(_SC, _sim(0)) + "SELECT count(*) AS n FROM sim")
def similar_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(_sc(spark, sf_dir), 0.0).agg(F.count(F.lit(1)).alias("n"))


@_query()
def prefix_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bi = index.bigraph(similarity.similar_pairs(_sc(spark, sf_dir), 0.0))
    return index.prefix_clusters(cut(index.signatures(bi, 8)), 1)


@_query()
def index_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.block_stats(index.build_index(cut(_sc(spark, sf_dir))))


@_query(_with(_SC, _CN, "r AS (SELECT u, v, c FROM cn UNION ALL SELECT v, u, c FROM cn)", "x AS (SELECT u, count(*) AS n FROM r GROUP BY u HAVING count(*) >= 2)") + "SELECT u AS l, n FROM x")
def bigraph_left_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left vertices with at least two links in the bigraph of all pairs with enough common neighbours (one pass, left side only)."""
    pairs = similarity.common_neighbours(_sc(spark, sf_dir)).select("u", "v", "common", F.lit(0.0).alias("score"))
    return index.peel(index.bigraph(pairs), 2, cascade=False).groupBy("l").agg(F.count(F.lit(1)).alias("n"))


@_query()
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    bi = index.bigraph(similarity.similar_pairs(_sc(spark, sf_dir), 0.0))
    return index.signatures(bi, 8).select("l", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


@_query()
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bi = index.bigraph(similarity.similar_pairs(_sc(spark, sf_dir), 0.0))
    found = index.candidates(cut(index.signatures(bi, 16)), 16, 8)
    return found.select("centre", "l", F.round(16 * F.col("est")).cast("long").alias("agree"))


@_query(_with(_SC) + "SELECT c_nationkey::BIGINT AS cid, v AS r, count(*) AS count, any_value(z.n) AS size FROM g JOIN customer ON u = 2 * c_custkey JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) z ON z.k = c_nationkey GROUP BY 1, 2")
def bicluster_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of suppliers by the clusters that customers' nations are."""
    bi = _sc(spark, sf_dir).where("u % 2 = 0").select(F.col("u").alias("l"), F.col("v").alias("r"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return index.bicluster_support(bi, customers.select(F.col("c_nationkey").cast("long").alias("cid"), (2 * F.col("c_custkey")).alias("l"))).select("cid", "r", "count", "size")


def _restored(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = cut(_sc(spark, sf_dir))
        made = index.build_index(edges, kind=kind)
        path, name = f"{_folder(spark)}/{uuid.uuid4().hex}", graph.config_name(kind, tau=2, rounds=3, k=16)
        graph.write_index(made, path, name)
        made = graph.read_index(spark, path, name)
        off = None
        for eps in (0.2, 0.255, 0.29, 0.3, 0.5):
            direct, found = similarity.similar_pairs(edges, eps).select("u", "v"), index.restore(made, edges, eps)
            part = direct.exceptAll(found).unionByName(found.exceptAll(direct))
            off = part if off is None else off.unionByName(part)
        return off.agg(F.count(F.lit(1)).alias("differences"))

    return query


def _folder(spark: SparkSession) -> str:
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


for _kind in ("db", "batch", "bc"):
    QUERIES[f"index_restore_{_kind}"] = _restored(_kind)
    ORACLES[f"index_restore_{_kind}"] = "SELECT 0::BIGINT AS differences"


@_query("SELECT 0::BIGINT AS repeated")
def index_is_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical pairs that are both in a residual list and inside a block, or in two blocks: none."""
    edges = cut(_sc(spark, sf_dir))
    made = index.build_index(edges)
    sim = index.bigraph(similarity.similar_pairs(edges, 0.0)).select(F.col("l").alias("u"), F.col("r").alias("v"))
    spanned = made["member"].join(made["block_right"], "z").select("u", "v").join(sim, ["u", "v"], "left_semi")
    held = made["residual"].select("u", "v").unionByName(spanned)
    return held.groupBy("u", "v").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))


@_query(_with(_SC) + "SELECT count(*) AS m, count(DISTINCT u) AS n, sum(hash_)::BIGINT AS mark FROM (SELECT u, u * 31 + v AS hash_ FROM g)")
def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_sc written as binary CSR and read again. The files are the driver's own, so this is a query for one machine."""
    path = tempfile.mkdtemp(prefix="csr")
    graph.write_binary(_sc(spark, sf_dir), path)
    _, edges = graph.read_binary(spark, f"file://{path}")
    return edges.agg(F.count(F.lit(1)).alias("m"), F.countDistinct("u").alias("n"), F.sum(F.col("u") * 31 + F.col("v")).alias("mark"))


@_query()
def densest_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    density, members = reduce.densest_by_peeling(graph.copurchase(spark, sf_dir))
    return _one(spark, "density double, n long", density, members.count())


@_query()
def densest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    density, members = extras.densest_exact(graph.copurchase(spark, sf_dir))
    return _one(spark, "edges long, n long", int(density * len(members)), len(members))


@_query()
def kplex_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(graph.copurchase(spark, sf_dir))
    return _one(spark, "size long, members string", *extras.k_plex(edges, 2))

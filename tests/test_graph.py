"""Golden graphs and random graphs against brute force."""

import os
import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgraph import catalog
from simgraph.functions.similarity import both_ways, generalized_edges, pair_similarity, adjacency, similar_pairs
from simgraph.operators import cliques, extras, index, mincut, reduce, vertex
from simgraph.operators.search import largest_clique, maximal_cliques
from simgraph.plans import maximum
from simgraph.sources import graph
from simgraph.streaming.edges import ingest


def frame(spark, pairs):
    return graph.symmetric(spark.createDataFrame(list(pairs), "a long, b long"))


def relation(pairs, eps):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for u, v in combinations(sorted(near), 2):
        c = len(near[u] & near[v])
        if v in near[u] or c >= 3 and c / (len(near[u]) + len(near[v]) - c) >= eps:
            out.add((u, v))
    return near, out


def brute(vertices, pairs):
    ids = sorted(vertices)
    adj = [sum(1 << j for j, w in enumerate(ids) if (min(v, w), max(v, w)) in pairs and v != w) for v in ids]
    best = max((c.bit_count() for c in maximal_cliques(adj, 0, (1 << len(ids)) - 1, 0, 1)), default=0)
    return best


def rows(df):
    return {tuple(r) for r in df.collect()}


F1 = [(a, b) for a in range(5) for b in (5, 6, 7)]
F2 = [(a, b) for a in range(5) for b in (5, 6)]
F3 = [(h, x) for h in (0, 1) for x in range(2, 31)] + [(0, x) for x in range(31, 66)] + [(1, x) for x in range(66, 102)]
F4 = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (3, 5)]


@pytest.mark.parametrize(("pairs", "eps", "similar", "size"), [(F1, 1.0, 13, 8), (F2, 0.5, 1, 3), (F3, 0.29, 1, 3), (F3, 0.30, 0, 2), (F4, 0.5, 0, 3)])
def test_golden(spark, pairs, eps, similar, size):
    edges = frame(spark, pairs)
    assert similar_pairs(edges, eps).count() == similar
    found = maximum.materialized(edges, eps, least=4).first()
    assert (found["size"], found.meets_threshold) == (size, size >= 4)


def test_search_runs_to_its_end():
    """The largest of a graph on which stopping after one improvement for each root returns 5."""
    text = """0-1 0-4 0-5 0-7 0-8 0-9 0-10 0-11 1-2 1-3 1-5 1-7 1-9 1-10 1-11 2-3 2-4 2-5 2-6 2-7 2-8 2-9 2-11
    3-4 3-5 3-6 3-7 3-9 3-10 4-6 4-7 4-8 4-9 4-10 4-11 5-6 5-7 5-10 6-8 6-9 6-10 7-8 7-9 7-10 7-11 8-9 8-10 9-10"""
    adj = [0] * 12
    for a, b in (map(int, x.split("-")) for x in text.split()):
        adj[a] |= 1 << b
        adj[b] |= 1 << a
    assert largest_clique(adj, (1 << 12) - 1)[0].bit_count() == 6


@pytest.mark.parametrize("eps", [0, 0.255, 0.57])
def test_random_graph(spark, eps):
    rng = random.Random(int(eps * 1000))
    pairs = [(a, b) for a, b in combinations(range(18), 2) if rng.random() < 0.4]
    near, want = relation(pairs, eps)
    edges = frame(spark, pairs)
    found = generalized_edges(edges, eps)
    assert rows(found.select("u", "v")) == want
    size, members, _ = cliques.maximum_clique(found, 1)
    assert size == brute(near, want) == len(members.split(","))
    assert all(p in want for p in combinations(sorted(map(int, members.split(","))), 2))
    got = {r.q: r["size"] for r in vertex.largest_through(edges, eps, spark.createDataFrame([(0,), (5,), (99,)], "q long")).collect()}
    for q in (0, 5):
        ring = {v for v in near if (min(q, v), max(q, v)) in want}
        assert got[q] == brute(ring, want) + 1
    assert got[99] == 1


@pytest.mark.parametrize("kind", ["db", "batch", "bc"])
def test_index_keeps_the_relation(spark, kind, tmp_path):
    rng = random.Random(3)
    pairs = F1 + [(a + 20, b + 20) for a, b in combinations(range(16), 2) if rng.random() < 0.5]
    edges = frame(spark, pairs)
    made = index.build_index(edges, kind=kind)
    graph.write_index(made, str(tmp_path), "c")
    made = graph.read_index(spark, str(tmp_path), "c")
    for eps in (0.2, 0.29, 0.58, 1.0):
        assert rows(index.restore(made, edges, eps)) == rows(similar_pairs(edges, eps).select("u", "v"))


def test_reductions(spark):
    edges = frame(spark, F4 + [(5, 6)])
    assert rows(reduce.k_core(edges, 2).select("u").distinct()) == {(i,) for i in range(6)}
    assert rows(reduce.core_numbers(edges)) == {(i, 2) for i in range(6)} | {(6, 1)}
    assert sorted(r["rank"] for r in reduce.ranked(edges).collect()) == list(range(1, 8))
    density, members = extras.densest_exact(edges)
    assert density * 6 == 7 and members == list(range(6))
    assert extras.k_plex(edges, 1)[0] == 3
    assert rows(extras.false_twins(frame(spark, F1))) == {("5,6,7", 5), ("0,1,2,3,4", 3)}


def test_cliques_listed(spark):
    pairs = frame(spark, F4).where("u < v")
    assert rows(cliques.clique_counts(pairs)) == {(2, 7), (3, 2)}
    assert rows(cliques.maximal(pairs, 2)) == {(3, "0,1,2"), (3, "3,4,5"), (2, "2,3")}
    assert rows(cliques.cliques_of_size(pairs, 3)) == {("0,1,2",), ("3,4,5",)}
    assert cliques.invalid_pairs(cliques.maximal(pairs, 2), pairs).isEmpty()
    exact = pair_similarity(adjacency(both_ways(pairs)), spark.createDataFrame([(0, 3)], "u long, v long")).first()
    assert (exact.common, exact.score) == (1, 0.25)


def test_empty_and_binary(spark, tmp_path):
    empty = spark.createDataFrame([], "u long, v long")
    assert maximum.materialized(empty, 0.5).first()["size"] == 0
    assert cliques.maximum_clique(empty, 1)[0] == 1
    with pytest.raises(ValueError):
        maximum.materialized(empty, 1.5)
    graph.write_binary(frame(spark, F4), str(tmp_path))
    vertices, edges = graph.read_binary(spark, f"file://{tmp_path}")
    assert rows(edges) == rows(frame(spark, F4)) and vertices.count() == 6


def test_binary_is_written_without_collecting_the_graph(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(type(spark.range(0)), "toPandas")
    monkeypatch.setattr(graph, "ROWS", 3)
    want = frame(spark, [*F1, (2, 9), (9, 11)])
    graph.write_binary(want, str(tmp_path))
    vertices, edges = graph.read_binary(spark, f"file://{tmp_path}")
    assert rows(edges) == rows(want) and edges.count() == want.count()
    assert {(v, d) for v, d in rows(vertices) if d} == rows(want.groupBy("u").count()) and vertices.count() == 12


def test_densest_goes_by_component(spark, monkeypatch):
    """Two components of 10 edges at most, 18 in all; the second is denser."""
    monkeypatch.setattr(extras, "LOCAL_EDGES", 12)
    ring = [(a, (a + 1) % 5) for a in range(5)] + [(0, 2), (1, 3), (2, 4)]
    five = [(a + 10, b + 10) for a, b in combinations(range(5), 2)]
    density, members = extras.densest_exact(frame(spark, ring + five + [(14, 15)]))
    assert density == 2 and members == [10, 11, 12, 13, 14]
    assert extras.densest_exact(frame(spark, [])) == (0, [])
    monkeypatch.setattr(extras, "LOCAL_EDGES", 9)
    with pytest.raises(ValueError):
        extras.densest_exact(frame(spark, five))


def test_core_may_end_before_its_last_rounds(spark):
    """A path of 60 on a clique loses two ends a round; with enough rows allowed the core comes with what such rounds would take."""
    six = list(combinations(range(6), 2))
    edges = frame(spark, six + [(a, a + 1) for a in range(5, 65)])
    early = rows(reduce.k_core(edges, 2, 1000))
    assert rows(frame(spark, six)) < early < rows(edges)
    density, members = extras.densest_exact(edges)
    assert density == Fraction(15, 6) and members == list(range(6))


def test_densest_takes_one_large_component(spark, monkeypatch):
    """A component of some 2,500 edges, cut on arrays in a task; in graphs small enough the members are those of brute force."""
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(800), 2))) for _ in range(2500)})
    density, members = extras.densest_exact(frame(spark, pairs))
    inside = sum(a in set(members) and b in set(members) for a, b in pairs)
    assert density == Fraction(inside, len(members)) and density >= Fraction(len(pairs), 800)
    for steps in (0, 3, 200):
        monkeypatch.setattr(mincut, "STEPS", steps)
        found = mincut.densest(*map(np.array, zip(*pairs, strict=True)), Fraction(0))
        assert (found[0], found[1].tolist()) == (density, members)
        for _ in range(10):
            small = [p for p in combinations(range(8), 2) if rng.random() < 0.5] or [(0, 1)]
            sets = [set(s) for k in range(2, 9) for s in combinations(range(8), k)]
            best = max((Fraction(sum(a in s and b in s for a, b in small), len(s)), len(s), sorted(s)) for s in sets)
            found = mincut.densest(*map(np.array, zip(*small, strict=True)), Fraction(0))
            assert (found[0], found[1].tolist()) == (best[0], best[2])
            assert mincut.densest(*map(np.array, zip(*small, strict=True)), best[0] + Fraction(1, 1000)) is None


@pytest.mark.parametrize("k", [1, 2, 3])
def test_k_plex_sees_the_surroundings_of_its_starts(spark, monkeypatch, k):
    """As greedy starts on the whole graph, without a limit on its edges."""
    monkeypatch.setattr(extras, "LOCAL_EDGES", 5)
    rng = random.Random(k)
    pairs = [(a, b) for a, b in combinations(range(40), 2) if rng.random() < 0.12]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []
    for start in sorted(near, key=lambda v: (-len(near[v]), v))[:6]:
        chosen = {start}
        while True:
            fits = [c for c in set().union(near[start], *(near[x] for x in near[start])) - chosen if all(len(chosen | {c}) - len(near[x] & (chosen | {c})) <= k for x in chosen | {c})]
            if not fits:
                break
            chosen.add(max(fits, key=lambda c: (len(near[c] & chosen), len(near[c] & set(fits)), -c)))
        found.append((-len(chosen), ",".join(map(str, sorted(chosen)))))
    size, members = min(found)
    assert extras.k_plex(frame(spark, pairs), k, 6) == (-size, members)


def test_stream_of_edges(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, 1), (1, 2)], "u long, v long").write.mode("append").parquet(source)
    ingest(spark, source, target, str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(1, 0), (2, 3)], "u long, v long").write.mode("append").parquet(source)
    ingest(spark, source, target, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_searches_take_all_stated_vertices(spark):
    edges = rows(graph.customer_supplier(spark, SF))
    near, pairs = relation([e for e in edges if e[0] < e[1]], catalog.EPS)
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    want = {(q, 1 + brute(beside[q], pairs)) for q in near if q % 20 == 0}
    assert max(q for q, _ in want) > catalog.QUERY_IDS
    assert rows(catalog.QUERIES["vertex_gc_batch_all"](spark, SF)) == want
    assert rows(catalog.QUERIES["vertex_gc_indexed_all"](spark, SF)) == want
    sizes = [size for _, size in want]
    assert rows(catalog.QUERIES["vertex_batch_summary_all"](spark, SF)) == {(len(want), min(sizes), max(sizes), sum(sizes))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_degree_ratio_takes_partners_on_both_sides(spark):
    deg = {r.u: r["count"] for r in graph.customer_supplier(spark, SF).groupBy("u").count().collect()}
    want = set()
    for u, v in combinations(sorted(deg), 2):
        low, high = sorted((deg[u], deg[v]))
        if low >= 3 and low / high >= catalog.EPS and (u % 20 == 0 or v % 20 == 0):
            want.add((u, v))
    got = [tuple(r) for r in catalog.QUERIES["degree_ratio_partners"](spark, SF).collect()]
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    assert any(u > v for u, v in got) and all(u % 20 == 0 for u, _ in got)


@pytest.mark.parametrize("name", ["degree_ratio_candidates", "degree_ratio_partners"])
def test_degree_ratio_rows_come_in_runs(spark, monkeypatch, name):
    """Blocks of 8 queries and 64 partners: runs of rows share their v, which keeps files small, and no row is lost."""
    ring = frame(spark, [(2 * c, 2 * ((c + k) % 200) + 1) for c in range(200) for k in range(3)])
    monkeypatch.setattr(catalog, "_sc", lambda spark, sf_dir: ring)
    monkeypatch.setattr(catalog, "_BLOCK", 8, raising=False)
    monkeypatch.setattr(catalog, "_CHUNK", 64, raising=False)
    got = [tuple(r) for r in catalog.QUERIES[name](spark, "").collect()]
    both = name.endswith("partners")
    want = {(u, v) for u in range(0, 400, 20) for v in range(400) if u < v or both and u > v and v % 20}
    assert set(got) == want and len(got) == len(want)
    assert sum(a[1] != b[1] for a, b in zip(got, got[1:], strict=False)) < len(got) / 3


@pytest.mark.parametrize("name", ["degree_ratio_candidates", "degree_ratio_partners"])
def test_degree_ratio_rows_are_made_by_all_cores(spark, monkeypatch, name):
    """Blocks are few bytes, yet their rows aren't made in the few tasks that such bytes would get."""
    ring = frame(spark, [(2 * c, 2 * ((c + k) % 200) + 1) for c in range(200) for k in range(3)])
    monkeypatch.setattr(catalog, "_sc", lambda spark, sf_dir: ring)
    monkeypatch.setattr(catalog, "_BLOCK", 2)
    monkeypatch.setattr(catalog, "_CHUNK", 8)
    made = catalog.QUERIES[name](spark, "").groupBy(F.spark_partition_id().alias("p")).count()
    assert made.count() > 2 * spark.sparkContext.defaultParallelism


def test_degree_ratio_parts_leave_no_partner_out(spark, monkeypatch):
    """Chunks of 8 partners in parts of 3 make all rows, each once."""
    ring = frame(spark, [(2 * c, 2 * ((c + k) % 50) + 1) for c in range(50) for k in range(3)])
    monkeypatch.setattr(catalog, "_sc", lambda spark, sf_dir: ring)
    monkeypatch.setattr(catalog, "_CHUNK", 8)
    monkeypatch.setattr(catalog, "_PART", 3)
    made = catalog.QUERIES["degree_ratio_partners"](spark, "")
    want = {(u, v) for u in range(0, 100, 20) for v in range(100) if u < v or u > v and v % 20}
    assert rows(made) == want and made.count() == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_later_blocks_do_not_span_links_of_earlier_ones(spark):
    assert rows(catalog.QUERIES["index_is_disjoint"](spark, SF)) == {(0,)}


def test_biclusters_leave_out_held_links(spark):
    """Right vertex 10 has a link into cluster 0 that another block holds: it goes to cluster 5, or to none."""
    clusters = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (5, 5), (5, 6), (5, 7)], "cid long, l long")
    bi = spark.createDataFrame([(a, r, 3, 0.5) for a in (1, 2, 5, 6) for r in (10, 11, 12, 13, 14)], "l long, r long, common long, score double")
    held = spark.createDataFrame([(0, 10), (0, 11), (5, 11)], "l long, r long")
    s = index.Settings(least_cluster=1, least_gain=-9)
    assert rows(index.biclusters(bi, clusters, s)) == {(0, r) for r in (10, 11, 12, 13, 14)}
    assert rows(index.biclusters(bi, clusters, s, held)) == {(5, 10), (0, 12), (0, 13), (0, 14)}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_lsh_recall_and_clusters_match_brute_force(spark, monkeypatch, chunk):
    """Every pair that shares a band is found (through its signatures), and centres are chosen as one by one."""
    monkeypatch.setattr(index, "CHUNK", chunk)
    rng = random.Random(3)
    links = {(u, r) for u in range(40) for r in ([x for x in range(8) if rng.random() < 0.6] or [0])} | {(u, r) for u in (50, 51) for r in range(8)}
    bi = spark.createDataFrame([(a, r, 3, 0.5) for a, r in sorted(links)], "l long, r long, common long, score double")
    s = index.Settings()
    sig = {r.l: tuple(r.sig) for r in index.signatures(bi, s.k).collect()}
    wide = s.k // s.bands
    banded = {(a, b) for a, b in combinations(sorted(sig), 2) if any(sig[a][i : i + wide] == sig[b][i : i + wide] for i in range(0, s.k, wide))}
    agree = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / s.k
    least = {}
    for v in sorted(sig):
        least.setdefault(sig[v], v)
    found = [tuple(r) for r in index.candidates(index.signatures(bi, s.k), s.k, s.bands).collect()]
    assert len(found) == len(set(found)) and all(e == agree(a, b) for a, b, e in found)
    pairs = {(a, b) for a, b, _ in found}
    stand = lambda a, b: tuple(sorted((least[sig[a]], least[sig[b]])))
    assert pairs == {(least[sig[b]], b) if sig[a] == sig[b] else stand(a, b) for a, b in banded}
    assert any(a != min(x for x, y in banded if y == b) for a, b in pairs)
    centres = []
    for v in sorted(sig):
        if not any((c, v) in banded and agree(c, v) >= s.threshold for c in centres):
            centres.append(v)
    got = rows(index.lsh_clusters(bi, s))
    assert len({v for _, v in got}) == len(got)
    assert {v for c, v in got if c != v} == set(sig) - set(centres)
    assert {c for c, _ in got} <= set(centres)
    assert all(c == v or (c, v) in banded and agree(c, v) >= s.threshold for c, v in got)

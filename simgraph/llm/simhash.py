"""SimHash fingerprints, and BK-trees that find all pairs within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import steps
from simgraph.llm.components import components
from simgraph.llm.state import cut, prepare

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints of one key that a shard tree takes; larger keys are cut into such chunks.
CHUNK = 2048
#: Pairs of query and tree node that a step of a search may visit.
VISITS = 2_000_000
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(width + 1) - 1
    runs = [line[a:b] for a, b in zip((ends - width)[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits that are set in over half of them; zero for none.

    Eight shifts put eight bits each into the bytes of a word, so that words
    add up without unpacking; runs of at most 255 keep the bytes from overflow.
    """
    count = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    n = count[full]
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = (np.cumsum(n) - n)[owner] + 255 * nth
    first = np.cumsum(parts) - parts
    for shift in range(8):
        sums = np.add.reduceat((flat >> np.uint64(shift)) & _BYTES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > n).astype(np.uint64) << np.uint64(shift + 8 * byte)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """``keys`` and fp (the fingerprint's 64 bits as a long) of every row.

    Null or empty text: zero. Other columns are left out.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text"):
            fp = majority([shingle_hashes((x or "").encode(), size) for x in part.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], names=[*keys, "fp"])

    return rows.mapInArrow(run, f"{schema}, fp long")


class BKForest:
    """BK-trees over 64-bit words, one for each group, as flat arrays.

    The first word of a group is its root; every other goes down the child
    whose edge is its distance from the node. All trees grow level by level.
    """

    def __init__(self, words: np.ndarray, groups: np.ndarray):
        """``groups``: sorted group number of each word; no word twice in a group."""
        self.words = words
        fresh = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
        self.root = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(groups) else np.zeros(0, np.int64)
        rest = np.flatnonzero(~fresh)
        parent = self.root[rest]
        keys, nodes = [], []
        while len(rest):
            slot = parent * 65 + np.bitwise_count(words[rest] ^ words[parent])
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            fresh = np.concatenate([[True], slot[1:] != slot[:-1]])
            heads = rest[fresh]
            keys.append(slot[fresh])
            nodes.append(heads)
            parent = heads[np.cumsum(fresh) - 1][~fresh]
            rest = rest[~fresh]
        self.slot = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(self.slot)
        self.slot, self.child = self.slot[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]

    def within(self, queries: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the query, node) of all pairs within the radius, from the nodes ``at`` downwards.

        Only edges from d - radius to d + radius are followed.
        """
        found_q, found_n = [], []
        asks, nodes = np.arange(len(queries)), at
        while len(asks):
            far = np.bitwise_count(queries[asks] ^ self.words[nodes]).astype(np.int64)
            near = far <= radius
            found_q.append(asks[near])
            found_n.append(nodes[near])
            low = np.searchsorted(self.slot, nodes * 65 + np.maximum(far - radius, 1))
            high = np.searchsorted(self.slot, nodes * 65 + np.minimum(far + radius, 64), "right")
            width = high - low
            asks = np.repeat(asks, width)
            nodes = self.child[np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_n or [np.zeros(0, np.int64)])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a[i] and b[i]; the smaller label stays."""
    x, y = label[a], label[b]
    pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1)[x != y], axis=0)
    if not len(pairs):
        return label
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while (u := up.get(k, k)) != k:
            up[k] = k = up.get(u, u)
        return k

    for p, q in pairs.tolist():
        p, q = top(p), top(q)
        up[max(p, q)] = min(p, q)
    ids, back = np.unique(label, return_inverse=True)
    return np.array([top(k) for k in ids.tolist()], np.int64)[back]


def spanning_links(words: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each group, exactly what chains of near pairs connect: at most one for each word."""
    forest = BKForest(words, groups)
    label = np.arange(len(words))
    fresh = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(fresh), len(groups)))[np.cumsum(fresh) - 1]
    load, at = np.cumsum(size), 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + VISITS, "right")))
        asked, node = forest.within(words[at:end], forest.root[at:end], radius)
        label = _merge(label, asked + at, node)
        at = end
    linked = np.flatnonzero(label != np.arange(len(words)))
    return words[linked], words[label[linked]]


def _blocks(radius: int, shared: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + shared blocks of the 64 bits: near pairs agree on ``shared`` of them at least."""
    n = radius + shared
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shared_blocks(n: int, radius: int) -> int:
    """How many blocks a key takes (2 to 5) so that a key of random words holds no more than a quarter CHUNK of ``n``."""
    return next((s for s in range(2, 5) if 4 * n <= CHUNK << 64 * s // (radius + s)), 5)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) of near fingerprints of the distinct longs ``fp``; chains of them connect all that is near.

    Fingerprints within the radius agree on s whole blocks out of radius + s;
    s grows with the number of fingerprints (shared_blocks), so that keys stay
    small. Every s blocks are a key; BK-trees over the words of each key in a
    partition (a shard) are searched along the edges within the radius. A key
    with more than CHUNK words is cut into chunks by hash, and every two chunks
    meet in a tree of their own: no key grows a task, no pair is lost.
    """
    shared = shared_blocks(fps.count(), radius)
    blocks = _blocks(radius, shared)
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks]
    keys = []
    for c, chosen in enumerate(combinations(range(len(blocks)), shared)):
        key = F.lit(c)
        for i in chosen:
            key = key * F.lit(1 << blocks[i][1]) + part[i]
        keys.append(key.cast("long"))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = cut(hot.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("c")))
    if hot.isEmpty():
        rows = rows.select(F.xxhash64("key").alias("g"), "key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int")
        rows = rows.join(hot, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1)))
        rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
        rows = rows.select(F.xxhash64("key", "x", "y").alias("g"), "key", "x", "y", "fp")
    dealt = rows.repartition("g").select("key", "x", "y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
        if got:
            key, x, y, fp = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((fp, y, x, key))
            key, x, y, fp = key[order], x[order], y[order], fp[order]
            turn = np.concatenate([[False], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            a, b = spanning_links(fp.view(np.uint64), np.cumsum(turn), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: its id, fp (long) and component_id.

    component_id is the smallest id that links of at most ``radius`` differing
    bits reach, the row itself included (null where no row reached has an id).
    Null, empty and blank texts have the fingerprint zero. Equal fingerprints
    are searched once; rows with the same id are kept apart by fingerprint.
    """
    spark = docs.sparkSession
    prepare(spark)
    fps = cut(fingerprints(docs, text, (id_col,), size))
    least = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = cut(components(links(least.select("fp"), radius)))
    linked = cut(roots.select(F.col("node").alias("fp"), "root").join(least, "fp"))
    named = cut(linked.groupBy("root").agg(F.min("least").alias("named")))
    of_fp = cut(linked.select("fp", "root").join(named, "root").select("fp", "named"))
    whole = cut(least.join(of_fp, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id")))
    return fps.join(whole, "fp").select(id_col, "fp", "component_id")


def near_roots(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``keys``, fp and root (a fingerprint of its component, one for all of it) of every row; ids play no part."""
    prepare(docs.sparkSession)
    fps = cut(fingerprints(docs, text, keys, size))
    roots = cut(components(links(cut(fps.select("fp").distinct()), radius)))
    return fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(*keys, "fp", F.coalesce("root", "fp").alias("root"))

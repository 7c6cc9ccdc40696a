"""URL filter lists in cascades of Bloom filters that know the corpus's keys exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgraph.llm.state import cut, prepare

#: Bits of one level at most (16 MB); a longer list is refused, not cut.
MOST_BITS = 1 << 27
#: False positives of the first level, and of the others.
FIRST_RATE, NEXT_RATE = 1e-3, 0.5


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of each key at a level: one row of ``hashes`` for each."""
    step = (h2 | np.uint64(1)) * np.uint64(2 * level + 1)
    at = h1[:, None] + step[:, None] * np.arange(1, hashes + 1, dtype=np.uint64)[None, :]
    return (at ^ (at >> np.uint64(32))) % np.uint64(bits)


@dataclass
class Cascade:
    """Levels (bits, hashes, words): even ones hold listed keys, odd ones keys that the level before takes wrongly."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes, words = self.levels[level]
        at = _positions(h1, h2, level, bits, hashes)
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=1)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed: the first level that denies it decides, else the last."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        left = np.arange(len(h1))
        for level in range(len(self.levels)):
            ok = self.passes(level, h1[left], h2[left])
            out[left[~ok]] = level % 2 == 1
            left = left[ok]
        return out


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))


def _level(keys: DataFrame, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    """A Bloom filter of the distinct ``keys``; its words are summed by bit_or before and after the shuffle."""
    n = keys.count()
    bits = max(64, -(-int(-n * np.log(rate) / np.log(2) ** 2) // 64) * 64)
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need {bits} bits; a level holds {MOST_BITS} at most")
    hashes = min(16, max(1, round(bits / max(n, 1) * np.log(2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2"))
            at = _positions(h1, h2, level, bits, hashes).ravel()
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    words = np.zeros(bits // 64, np.uint64)
    for r in _hashed(keys).select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).collect():
        words[r.word] = np.uint64(r.value & 0xFFFFFFFFFFFFFFFF)
    return bits, hashes, words


def _taken(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """Those of ``keys`` (key) that a level lets pass."""
    shared = keys.sparkSession.sparkContext.broadcast(cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2"))
            yield b.filter(pa.array(shared.value.passes(level, h1, h2))).select(["key"])

    return _hashed(keys).mapInArrow(run, "key string")


def build_cascade(universe: DataFrame, listed: DataFrame, most_levels: int = 64) -> Cascade:
    """A cascade that tells for every ``key`` of ``universe`` (repeats allowed) whether it is in ``listed``.

    Only keys that the level before takes wrongly are made distinct and kept,
    so the universe itself is scanned once and never shuffled.
    """
    inside, cascade = cut(listed.where("key is not null").distinct()), Cascade()
    level, rate = 0, FIRST_RATE
    sides = [inside, universe.where("key is not null")]
    while True:
        if not level or not sides[0].isEmpty():
            cascade.levels.append(_level(sides[0], level, rate))
        else:
            return cascade
        wrong = _taken(sides[1], cascade, level).distinct()
        if not level:
            wrong = wrong.join(inside, "key", "left_anti")
        sides, level, rate = [cut(wrong), sides[0]], level + 1, NEXT_RATE
        if level > most_levels:
            raise RuntimeError("the cascade did not end: two keys share all hashes")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    lowered = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def _keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Rule keys that could fit: the last 1 to ``labels`` labels of the host, with path prefixes of the rules' lengths."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, h))))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule (host + path of the longest that fits, else null) and verdict of every row.

    A rule (action, host, path) fits its host and all subdomains whose path
    starts with the rule's. One cascade for each action holds the rules' keys;
    every key of a page is looked up in them, and the longest member decides.
    Pages without one aren't listed: ``default``. Null urls have no host.
    """
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    actions = sorted({a for a, _, _ in rules})
    if len({h + p for _, h, p in rules}) < len({*rules}):
        raise ValueError("one key has two actions")
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = max(h.count(".") + 1 for _, h, _ in rules), sorted({len(p) for _, _, p in rules})
    rows = rows.withColumn("keys", _keys(F.col("host"), F.col("path"), labels, lengths))
    universe = rows.select(F.explode("keys").alias("key"))
    listed = spark.createDataFrame([(a, h + p) for a, h, p in rules], "action string, key string")
    cascades = [build_cascade(universe, listed.where(F.col("action") == a).select("key")) for a in actions]
    shared = spark.sparkContext.broadcast(cascades)
    rows = rows.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(F.lit("2"), k)))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            keys = b.column("keys")
            h1, h2 = (b.column(k).flatten().to_numpy().view(np.uint64) for k in ("h1", "h2"))
            owner = np.repeat(np.arange(n), pc.list_value_length(keys).to_numpy())
            flat = keys.flatten()
            width = pc.utf8_length(flat).to_numpy()
            rule, verdict, best = [None] * n, [default] * n, np.full(n, -1, np.int64)
            for action, cascade in zip(actions, shared.value, strict=True):
                for k in np.flatnonzero(cascade.member(h1, h2)).tolist():
                    if width[k] > best[owner[k]]:
                        best[owner[k]] = width[k]
                        rule[owner[k]], verdict[owner[k]] = flat[k].as_py(), action
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")

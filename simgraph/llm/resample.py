"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import between, mix, prefix, steps, text_bytes, words
from simgraph.llm.state import cut, prepare

#: Buckets of each kind of n-gram; labelled rows that the target model is fitted on, at most.
BUCKETS, LABELLED = 1 << 16, 20_000
#: Counts by which a bucket's ratio is drawn towards one.
SMOOTH = 5.0
#: A text's weight is taken for SCALE n-grams, of its own and PRIOR neutral ones, so that long texts and
#: a small drift of the target (say, of its languages) don't decide.
SCALE, PRIOR = 100.0, 20.0
#: Bins of a step of the search for the k-th score; scores that may be fetched to end it.
BINS, FETCHED = 2048, 4096
_KINDS = 3


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram: words, pairs of words, and the last three bytes of words.

    A word followed by itself is one feature, whatever the word.
    """
    starts, ends, count = words(data, off)
    owner = np.repeat(np.arange(len(count)), count)
    sums = prefix(data)
    word = between(sums, starts, ends)
    tail = between(sums, np.maximum(starts, ends - 3), ends)
    both = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix(word[both] * np.uint64(0xD6E8FEB86659FD93) + word[both + 1])
    pair[word[both] == word[both + 1]] = 0
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    bucket = [(x >> shift).astype(np.int64) + k * BUCKETS for k, x in enumerate((word, pair, tail))]
    return np.concatenate([owner, owner[both], owner]), np.concatenate(bucket)


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``docs``; tasks add up their own before the shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_KINDS * BUCKETS, np.int64)
        for part in steps(batches, "_text"):
            total += np.bincount(grams(*text_bytes(part.column("_text")))[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(_KINDS * BUCKETS, np.int64)
    for r in docs.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each bucket. The raw share gives the expected count; few counts say little."""
    out = np.zeros(_KINDS * BUCKETS)
    for k in range(_KINDS):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        t, r = target[part].astype(float), raw[part].astype(float)
        if t.sum() and r.sum():
            out[part] = np.log((t + SMOOTH) / (r * (t.sum() / r.sum()) + SMOOTH))
    return out


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_grams, log_weight and _h (a hash of the text) of every row; null and blank texts weigh zero."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text"):
            owner, bucket = grams(*text_bytes(part.column("_text")))
            weight = np.bincount(owner, shared.value[bucket], minlength=part.num_rows).astype(np.float64)  # numpy counts in integers where nothing is
            many = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(many), pa.array(weight)], names=[id_col, "_h", "n_grams", "log_weight"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, _h long, n_grams long, log_weight double")


def gumbel(*keys: Column) -> Column:
    """Standard Gumbel noise that depends on the keys alone, so that a lost task makes the same again."""
    unit = (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms that close in on it; few values reach the driver."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    while True:
        inside = scores.where((F.col(column) >= low) & (F.col(column) <= high))
        if low == high or k <= 0:
            return high
        width = (high - low) / BINS
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("slot") if width else F.lit(0).alias("slot")
        bins = inside.groupBy(slot).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(bins, key=lambda r: -r.slot):
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
        if r.n <= FETCHED:
            values = sorted((x[0] for x in scores.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return values[k - 1]


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", k: int | None = None, share: float = 1.0, seed: int = 11, hashed: bool = False) -> DataFrame:
    """``id_col``, n_grams, log_weight (the whole text's), score (for SCALE n-grams, with Gumbel noise) and kept of every row.

    ``hashed``: _h, the text's hash, too; rows with one id and text have one verdict.

    The target model counts the rows labelled 1 (LABELLED labelled rows at
    most, those with the least hashes of their ids), the raw model all rows.
    Gumbel top-k: the k rows with the largest sums of weight and noise are
    kept, which is a draw without replacement in proportion to the exponential
    of the weights; rows that tie with the k-th stay too. Without ``k`` it is
    ``share`` times the part of the labelled rows that is labelled 1, of all
    rows. Without labelled rows all weigh zero and all are kept.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_label"))
    marked = marked.orderBy(F.xxhash64(id_col), id_col).limit(LABELLED)
    target = bucket_counts(docs.join(F.broadcast(marked.where("_label = 1").select(id_col)), id_col, "left_semi"), text)
    ratio = log_ratio(target, bucket_counts(docs, text))
    rate = F.col("log_weight") * SCALE / (F.col("n_grams") + PRIOR)
    scores = weigh(docs, ratio, text, id_col).withColumn("score", rate + gumbel(F.lit(seed), F.col(id_col), F.col("_h")))
    scores = cut(scores if hashed else scores.drop("_h"))
    if k is None:
        good, known = marked.agg(F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
        k = round(scores.count() * (share * good / known if good else 1.0))
    kept = F.col("score") >= F.lit(kth_largest(scores, "score", k)) if k > 0 and not scores.isEmpty() else F.lit(False)
    return scores.withColumn("kept", kept)

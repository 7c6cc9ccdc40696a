"""Quality rules: base counts, and a calibrated hashed n-gram logistic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import STEP_BYTES, between, mix, prefix, steps, text_bytes, words
from simgraph.llm.state import prepare

#: Labelled rows that the model is fitted on, at most, and bytes of their texts: those with the least hashes of their ids.
LABELLED, LABELLED_BYTES = 4000, 1 << 25
#: Buckets of hashed n-grams, bytes of a character n-gram, words of a repeated window.
BUCKETS = 1 << 17
CHARS = 4
WINDOW = 8
#: Fixed thresholds: least words, most percent of repeated words, least calibrated probability of good quality.
LEAST_WORDS, MOST_REPEATED, LEAST_QUALITY = 20, 30, 0.5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` (one for each byte) over each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _again(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which values are found twice or more, which of those aren't the first, and each of the latter with the one before it."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    twice, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later, order[1:][same], order[:-1][same]


def _differ(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which of the ranges [a, a_end) hold other bytes than [b, b_end); a step looks at about STEP_BYTES of them."""
    out = a_end - a != b_end - b
    open_ = np.flatnonzero(~out & (a_end > a))
    size = np.cumsum((a_end - a)[open_])
    at = 0
    while at < len(open_):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP_BYTES, "right")))
        part = open_[at:end]
        many = (a_end - a)[part]
        first = np.cumsum(many) - many
        along = np.arange(many.sum()) - np.repeat(first, many)
        wrong = data[np.repeat(a[part], many) + along] != data[np.repeat(b[part], many) + along]
        out[part] = np.logical_or.reduceat(wrong, first)
        at = end
    return out


def _plainly(raw: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text by its bytes, for texts in which two hashes have met by chance."""
    filled = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    parts = [x for x in re.split(rb"[\x20\x09-\x0d]+", raw) if x]
    runs = [tuple(parts[i : i + WINDOW]) for i in range(len(parts) - WINDOW + 1)]
    many = Counter(runs)
    covered = {j for i, r in enumerate(runs) if many[r] > 1 for j in range(i, i + WINDOW)}
    return len(filled) - len(set(filled)), len(covered)


def _runs(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside one text, and where each begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(out[at]), at


@dataclass
class Counts:
    """Base counts of each text, and its hashed n-grams as (owner, bucket) pairs for words and for characters."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


def measure(data: np.ndarray, off: np.ndarray) -> Counts:
    """All counts of a batch of texts, without a loop over them.

    Hashes propose equal lines and windows; every two that they make neighbours
    are compared byte by byte, and texts in which two differ are counted anew.
    """
    n = len(off) - 1
    starts, ends, count = words(data, off)
    owner = np.repeat(np.arange(n), count)
    sums = prefix(data)
    word = between(sums, starts, ends)
    ink = (data != 32) & ((data < 9) | (data > 13))
    heads = (data & 0xC0) != 0x80
    line_starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)] if len(data) else line_starts[:0]
    line_owner = np.searchsorted(off, line_starts, "right") - 1
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    line_ends = np.minimum(breaks[np.searchsorted(breaks, line_starts)], off[line_owner + 1])
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[filled], line_ends[filled], line_owner[filled]
    _, later, x, y = _again(mix(between(sums, line_starts, line_ends) + line_owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB)))
    odd = line_owner[x[_differ(data, line_starts[x], line_ends[x], line_starts[y], line_ends[y])]]
    run, at = _runs(word, owner, WINDOW)
    twice, _, x, y = _again(mix(run + owner[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)))
    if len(x):
        met = np.unique((at[x][:, None] + np.arange(WINDOW)) << 32 | (at[y][:, None] + np.arange(WINDOW)))
        x, y = met >> 32, met & 0xFFFFFFFF
        odd = np.concatenate([odd, owner[x[_differ(data, starts[x], ends[x], starts[y], ends[y])]]])
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    n_dup_lines, n_repeat_words = np.bincount(line_owner[later], minlength=n), np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)
    for i in np.unique(odd).tolist():
        n_dup_lines[i], n_repeat_words[i] = _plainly(data[off[i] : off[i + 1]].tobytes())
    pair, pair_at = _runs(word, owner, 2)
    pair[word[pair_at] == word[pair_at + 1]] = 0  # a word said twice is one feature, whatever the word
    chars = np.arange(max(0, len(data) - CHARS + 1))
    char_owner = np.repeat(np.arange(n), np.diff(off))
    chars = chars[char_owner[: len(chars)] == char_owner[CHARS - 1 :]] if len(chars) else chars
    packed = np.zeros(max(0, len(data) - CHARS + 1), np.uint64)
    for k in range(CHARS):
        packed |= data[k : k + len(packed)].astype(np.uint64) << np.uint64(8 * k)
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    odd = np.uint64(0xD6E8FEB86659FD93)
    return Counts(
        count, _per_text(ink & heads, off), _per_text(_SYMBOLS[data], off),
        n_dup_lines, n_repeat_words,
        [(owner, (word >> top).astype(np.int64)), (owner[pair_at], (pair >> top).astype(np.int64)), (char_owner[chars], (packed[chars] * odd >> top).astype(np.int64))],
    )


def _means(counts: Counts, weights: np.ndarray, n: int) -> np.ndarray:
    """Sum over the kinds of n-gram of the mean weight of a text's n-grams."""
    out = np.zeros(n)
    for kind, (owner, bucket) in enumerate(counts.grams):
        total = np.bincount(owner, weights[kind][bucket], minlength=n)
        out += total / np.maximum(np.bincount(owner, minlength=n), 1)
    return out


@dataclass
class Model:
    """Weights by kind of n-gram and bucket; bias; Platt's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, counts: Counts, n: int) -> np.ndarray:
        z = self.slope * (_means(counts, self.weights, n) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def _newton(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps on smoothed targets."""
    hit = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - hit) * z).sum() + 1e-3 * (a - 1), (p - hit).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(texts: list[str | None], good: list[int], epochs: int = 8, rate: float = 4.0) -> Model:
    """Logistic regression by AdaGrad over batches of texts; a fifth of the rows calibrates it.

    Labels of one kind only (or none): a model that gives their share to every text.
    """
    y = np.array(good, float)
    n = len(y)
    model = Model(np.zeros((3, BUCKETS)), 0.0, 1.0, float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    if n < 10 or not 0 < y.sum() < n:
        return model
    rng = np.random.default_rng(7)
    order = rng.permutation(n)
    held, train = order[: n // 5], order[n // 5 :]
    blocks = [train[k : k + 64] for k in range(0, len(train), 64)]
    known = [measure(*_texts([texts[i] for i in b])) for b in blocks]
    seen, bias_seen = np.full((3, BUCKETS), 1e-8), 1e-8
    share = np.array([n / (2 * (n - y.sum())), n / (2 * y.sum())])
    for _ in range(epochs):
        for k in rng.permutation(len(blocks)):
            b, c = blocks[k], known[k]
            z = _means(c, model.weights, len(b)) + model.bias
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[b]) * share[y[b].astype(int)] / len(b)
            bias_seen += g.sum() ** 2
            model.bias -= 0.5 * g.sum() / np.sqrt(bias_seen)
            for kind, (owner, bucket) in enumerate(c.grams):
                each = g / np.maximum(np.bincount(owner, minlength=len(b)), 1)
                ids, back = np.unique(bucket, return_inverse=True)
                d = np.bincount(back, each[owner], minlength=len(ids))
                seen[kind][ids] += d * d
                model.weights[kind][ids] -= rate * 0.1 * d / np.sqrt(seen[kind][ids])
    c = measure(*_texts([texts[i] for i in held]))
    model.slope, model.shift = _newton(_means(c, model.weights, len(held)) + model.bias, y[held])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int, text: str = "text", id_col: str = "doc_id", most_bytes: int = LABELLED_BYTES) -> list:
    """(id, text, label) of at most ``limit`` labelled rows with ``most_bytes`` of text in all: those with the least hashes of their ids.

    Rows without a label or an id are left out; of several labels of an id the
    least counts, of several rows the text with the least hash. Only sizes are
    fetched before the choice, so the driver never holds more text than that.
    """
    ids = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(column).alias("_label"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = rows.join(F.broadcast(ids), id_col).select(id_col, "_label", F.octet_length("_text").alias("n"), F.xxhash64("_text").alias("h"))
    sizes = found.groupBy(id_col, "_label").agg(F.min(F.struct("h", "n")).alias("one")).orderBy(F.xxhash64(id_col), id_col).collect()
    held, chosen = 0, []
    for r in sizes:
        held += r.one.n
        if held > most_bytes:
            break
        chosen.append((r[0], r.one.h, int(r._label)))
    if not chosen:
        return []
    kind = rows.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"`{id_col}` {kind}, h long, _label int")
    kept = rows.withColumn("h", F.xxhash64("_text")).join(F.broadcast(wanted), [id_col, "h"])
    return sorted((r[0], r[1], r[2]) for r in kept.groupBy(id_col, "_label").agg(F.min("_text").alias("t")).select(id_col, "t", "_label").collect())


def judge(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the base counts, base_failed, quality (calibrated probability) and kept of every row.

    Null, empty and blank texts have no words and fail the base rules.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_text"))
    shared = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text"):
            c = measure(*text_bytes(part.column("_text")))
            failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > MOST_REPEATED * c.n_words)
            quality = shared.value.probability(c, part.num_rows)
            kept = ~failed & (quality >= LEAST_QUALITY)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(getattr(c, k).astype(np.int64)) for k in counts), *map(pa.array, (failed, quality, kept))], names=[id_col, *counts, "base_failed", "quality", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, quality double, kept boolean")

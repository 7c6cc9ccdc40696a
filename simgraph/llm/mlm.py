"""Masked pseudo-likelihood of texts: a bidirectional window network trained in numpy, and the corpus's own two-sided contexts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import between, mix, prefix, steps, text_bytes, words
from simgraph.llm.state import cut, prepare

#: Word classes: the network predicts a class's high digit, then its low one. HEADS words have a class of their own, the others share one by their last three bytes.
SIDE, DIM, REACH = 32, 16, 3
VOCAB = SIDE * SIDE
HEADS = VOCAB // 2
#: Words whose own share of their class is known, at most; the other words of a class share the rest evenly.
LISTED = 1 << 19
#: Predicted tokens of a training step, and its rate.
BATCH, RATE = 4096, 0.15
#: Passes over the corpus. Each masks every ROUNDS-th place, so that all places are predicted once; weights are averaged after each.
ROUNDS = 4
#: Tokens of a shard, which trains in sequence.
SHARD = 1 << 22
#: Bytes of text whose contexts are counted together before they are sent; distinct contexts of a range; bits of the word in a key.
CHUNK_BYTES, RANGE, WORD_BITS = 1 << 22, 1 << 21, 12
#: Bytes of text that are hashed at once.
HASH_BYTES = 1 << 15
#: Tokens' worth of belief in the network against the contexts' counts, and steps of a nat in which its verdicts travel.
TRUST, NATS = 2.0, 8
_SHAPES = {"left": (VOCAB, DIM), "right": (VOCAB, DIM), "high": (DIM, SIDE), "high_bias": (SIDE,), "of_high": (SIDE, DIM), "low": (DIM, SIDE), "low_bias": (SIDE, SIDE)}
_SIZES = [int(np.prod(s)) for s in _SHAPES.values()]

Net = dict[str, np.ndarray]


def unflatten(flat: np.ndarray) -> Net:
    parts = np.split(flat, np.cumsum(_SIZES)[:-1])
    return {k: p.reshape(s) for (k, s), p in zip(_SHAPES.items(), parts, strict=True)}


@dataclass
class Model:
    """``flat``: the network. ``heads``: hashes of the words with classes of their own, sorted, and ``head_class``;
    ``tail_class``: the class of each ending; ``listed``: sorted hashes of words, and the log of their share of their
    class; ``rare``: the same for each of a class's other words; ``shares``: of each class; ``tokens``: of the corpus."""

    flat: np.ndarray
    heads: np.ndarray
    head_class: np.ndarray
    tail_class: np.ndarray
    listed: np.ndarray
    log_share: np.ndarray
    rare: np.ndarray
    shares: np.ndarray
    tokens: int

    def classes(self, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = self.tail_class[tail]
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, word), len(self.heads) - 1)
            out = np.where(self.heads[at] == word, self.head_class[at], out)
        return out

    def in_class(self, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log P(word | its class)."""
        out = self.rare[cls]
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, word), len(self.listed) - 1)
            out = np.where(self.listed[at] == word, self.log_share[at], out)
        return out


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending (a number below VOCAB - HEADS) and text of every word. Words are hashed in blocks of HASH_BYTES, whose sums stay in the cache."""
    starts, ends, count = words(data, off)
    word, tail = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for a, b in pairwise([*np.searchsorted(starts, np.arange(0, len(data), HASH_BYTES)).tolist(), len(starts)]):
        if a < b:
            low = starts[a]
            sums = prefix(data[low : ends[b - 1]])
            x, y = starts[a:b] - low, ends[a:b] - low
            word[a:b], tail[a:b] = between(sums, x, y), between(sums, np.maximum(x, y - 3), y)
    tail >>= np.uint64(64 - (VOCAB - HEADS).bit_length() + 1)
    return word, tail.astype(np.int64), np.repeat(np.arange(len(count)), count)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts ``x`` (equal values in any order), the places in it where a new value begins, and how often each stands there."""
    order = np.argsort(x)
    sorted_ = x[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(x) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(x)))


def vocabulary(docs: DataFrame, text: str = "text") -> Model:
    """The word classes and shares of ``docs``, with the network that gives each class its share whatever the context.

    All words of all texts are counted; tasks add up their own before the
    shuffle. The driver sees the HEADS most frequent words, one row for each
    class, and at most LISTED words, those of the largest counts.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            rows = np.concatenate(held)
            order, first, _ = _groups(np.ascontiguousarray(rows[:, 0]))
            out = rows[order[first]]
            out[:, 2] = np.add.reduceat(rows[order, 2], first)
            return out

        def batch(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["w", "tail", "n"])

        for part in steps(batches, "_text"):
            word, tail, _ = _hashed(*text_bytes(part.column("_text")))
            if len(word):
                order, first, n = _groups(word)
                at = order[first]
                held.append(np.stack([word[at].view(np.int64), tail[at], n], 1))
            if sum(map(len, held)) > 1 << 20:
                held = [merged()]
                if len(held[0]) > 1 << 19:
                    yield batch(held.pop())
        if held:
            yield batch(merged())

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(run, "w long, tail long, n long")
    counts = cut(rows.groupBy("w").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))
    heads = counts.orderBy(F.desc("n"), "w").limit(HEADS).select("w").collect()
    order = {r.w: k for k, r in enumerate(heads)}
    named = docs.sparkSession.createDataFrame(list(order.items()), "w long, head long")
    counts = counts.join(F.broadcast(named), "w", "left").select("w", "n", F.coalesce("head", F.col("tail") + HEADS).alias("cls"))
    tiers = counts.groupBy(F.floor(F.log2("n")).alias("tier")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("tier")).collect()
    least, room = 1 << 62, LISTED
    for r in tiers:
        room -= r.words
        if room < 0 or r.tier < 1:
            break
        least = 1 << r.tier
    listed = counts.where(F.col("n") >= least).toPandas().sort_values("w", key=lambda w: w.to_numpy().view(np.uint64))
    is_rare = F.col("n") < least
    sums = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.sum(F.when(is_rare, F.col("n")).otherwise(0)).alias("rare"), F.sum(F.when(is_rare, 1).otherwise(0)).alias("rares")).collect()
    total, rare, rares = (np.zeros(VOCAB) for _ in range(3))
    for r in sums:
        total[r.cls], rare[r.cls], rares[r.cls] = r.n, r.rare, r.rares
    place = np.empty(VOCAB, np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(VOCAB)  # classes by falling share, so that high digits part the frequent from the rare
    back = np.argsort(place)
    total, rare, rares = total[back], rare[back], rares[back]
    hashes = np.array(list(order), np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    cls = place[listed["cls"].to_numpy(np.int64)]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.log(listed["n"].to_numpy(float) / total[cls])
        alone = np.where(rares > 0, np.log(rare / np.maximum(rares, 1) / np.maximum(total, 1)), np.log(1 / (total + 1)))
    shares = (total + 0.5) / (total.sum() + 0.5 * VOCAB)
    rng = np.random.default_rng(5)
    net = {k: rng.standard_normal(s) * 0.1 for k, s in _SHAPES.items()}
    high = shares.reshape(SIDE, SIDE).sum(axis=1)
    net["high_bias"], net["low_bias"] = np.log(high), np.log(shares.reshape(SIDE, SIDE) / high[:, None])
    net["high"], net["of_high"], net["low"] = net["high"] * 0, net["of_high"] * 0, net["low"]
    flat = np.concatenate([net[k].ravel() for k in _SHAPES]).astype(np.float32)
    return Model(
        flat, hashes[by_hash], place[np.arange(len(order))][by_hash], place[HEADS:], listed["w"].to_numpy(np.int64).view(np.uint64),
        share.astype(np.float32), alone.astype(np.float32), shares, int(total.sum()),
    )


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each column (in the place of ``x``), and the logarithm of its target's."""
    x -= x.max(axis=0)
    chosen = x.ravel().take(target)
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return x, chosen - np.log(total)


class Pass:
    """The network at the places ``at`` of a stretch of tokens: each is predicted from REACH words on either side, never from itself.

    Scores of digits stand in columns, one for each place, so that sums over
    them run along memory. ``given`` has the hidden units and the indicators of
    the high digit: one product gives the low digit's scores.
    """

    def __init__(self, net: Net, ids: np.ndarray, owner: np.ndarray, at: np.ndarray):
        self.net = net
        kind, n = net["left"].dtype, len(at)
        # texts with REACH blanks before, between and after them; a blank's vector is zero
        turn = np.zeros(len(ids), np.int64)
        np.cumsum(owner[1:] != owner[:-1], out=turn[1:])
        place = np.arange(REACH, len(ids) + REACH) + REACH * turn
        spread = np.full(len(ids) + REACH * (int(turn[-1]) + 2), VOCAB, np.uint16)
        spread[place] = ids
        here = place[at]
        tables = {side: np.concatenate([net[side], np.zeros((1, DIM), kind)]) for side in ("left", "right")}
        self.near: dict[str, list[np.ndarray]] = {"left": [], "right": []}
        total = np.zeros((n, DIM), kind)
        for k in range(1, REACH + 1):
            for side, there in (("left", here - k), ("right", here + k)):
                self.near[side].append(spread.take(there))
                total += tables[side].take(self.near[side][-1], axis=0)
        high_of, low_of = np.divmod(ids[at], SIDE)
        self.given = np.empty((DIM + SIDE, n), kind)
        self.hidden = np.tanh(total.T, out=self.given[:DIM])
        self.given[DIM:] = np.arange(SIDE, dtype=np.uint8)[:, None] == high_of.astype(np.uint8)
        rows = np.arange(n)
        self.high_at, self.low_at = high_of * n + rows, low_of * n + rows
        self.high, high = _softmax(net["high"].T @ self.hidden + net["high_bias"][:, None], self.high_at)
        bias = net["of_high"] @ net["low"] + net["low_bias"]
        self.low, low = _softmax(np.concatenate([net["low"], bias]).T @ self.given, self.low_at)
        self.log_prob = high + low

    def gradients(self) -> dict[str, tuple[np.ndarray | None, np.ndarray]]:
        """Of the mean loss: (rows or None for all, values) of each group of weights. Use once."""
        net, n = self.net, self.hidden.shape[1]
        d_high, d_low = self.high, self.low
        d_high -= self.given[DIM:]
        d_low.ravel()[self.low_at] -= 1
        d_high /= n
        d_low /= n
        both = self.given @ d_low.T
        low, low_bias = both[:DIM], both[DIM:]
        d_total = (d_high.T @ net["high"].T + d_low.T @ net["low"].T) * (1 - self.hidden**2).T
        out: dict[str, tuple[np.ndarray | None, np.ndarray]] = {"high": (None, self.hidden @ d_high.T), "high_bias": (None, d_high.sum(axis=1)), "low": (None, low + net["of_high"].T @ low_bias)}
        out["of_high"], out["low_bias"] = (None, low_bias @ net["low"].T), (None, low_bias)
        rows = np.tile(np.arange(n), REACH)
        for side, near in self.near.items():
            out[side] = _summed(np.concatenate(near), d_total, rows)
        return out


def _summed(keys: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below VOCAB, and the sums of their ``values[rows]``."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    sorted_ = sorted_[: np.searchsorted(sorted_, VOCAB)]
    if not len(sorted_):
        return np.zeros(0, np.int64), values[:0]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first].astype(np.int64), np.add.reduceat(values.take(rows[order[: len(sorted_)]], axis=0), first, axis=0)


class Trainer:
    """AdaGrad over the stretches that it is given; their places come in rising order."""

    def __init__(self, flat: np.ndarray, seen: np.ndarray):
        self.flat, self.seen = flat.copy(), seen.copy()
        self.net, self.sums = unflatten(self.flat), unflatten(self.seen)

    def feed(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        for k in range(0, len(at), BATCH):
            own = at[k : k + BATCH]
            low, top = max(0, int(own[0]) - REACH), int(own[-1]) + REACH + 1
            for name, (rows, g) in Pass(self.net, ids[low:top], owner[low:top], own - low).gradients().items():
                where = slice(None) if rows is None else rows
                self.sums[name][where] += g * g
                self.net[name][where] -= RATE * g / np.sqrt(self.sums[name][where])


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return _zstd()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all words of all ``docs``: classes and shares by counting, and the network in ROUNDS passes.

    Texts, as class numbers, are dealt to shards by their hash; there is a
    shard for each SHARD tokens, so what a shard sees, and the result, don't
    depend on tasks or on how the table is split. In a pass every shard starts
    from the mean of all, and predicts the masked places of its texts in the
    order of their hashes. The driver holds one network. No words: the start.
    """
    model = vocabulary(docs, text)
    spark = docs.sparkSession
    if not model.tokens:
        return model
    shards = max(1, model.tokens // SHARD)
    rows = docs.select(F.xxhash64(text).alias("uid"), F.col(text).alias("_text"))
    given = spark.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text"):
            word, tail, owner = _hashed(*text_bytes(part.column("_text")))
            ids = given.value.classes(word, tail).astype(np.uint16)
            ends = np.cumsum(np.bincount(owner, minlength=part.num_rows))
            cut_ = [_pack(ids[a:b]) if b > a else None for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(cut_, pa.binary())], names=["uid", "ids"])

    corpus = rows.mapInArrow(coded, "uid long, ids binary").where("ids is not null").withColumn("shard", F.pmod("uid", F.lit(shards)))
    corpus = cut(corpus.repartition("shard").sortWithinPartitions("shard", "uid"))
    state = np.stack([model.flat, np.full_like(model.flat, 1e-4)])
    for turn in range(ROUNDS):
        state = _round(corpus, state, turn)
    model.flat = state[0]
    return model


def _round(corpus: DataFrame, state: np.ndarray, turn: int) -> np.ndarray:
    """The mean of all shards' networks, by their tokens, after the places that ``turn`` masks; and of their sums of squares."""
    shared = corpus.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(state.shape), 0
        own, mine, todo, held = None, 0, [], 0
        np.empty(1 << 24, np.uint8)  # once a block of this size was freed, glibc keeps the memory of a step for the next one instead of returning it

        def flush() -> None:
            nonlocal todo, held, mine
            size = [len(x) for x in todo]
            at = np.concatenate([np.arange(turn, n, ROUNDS) + s for n, s in zip(size, np.cumsum([0, *size[:-1]]).tolist(), strict=True)])
            trainer.feed(np.concatenate(todo).astype(np.int64), np.repeat(np.arange(len(todo)), size), at)
            mine, todo, held = mine + held, [], 0

        def end() -> None:
            nonlocal total, count, mine
            if todo:
                flush()
            if mine:
                total += np.stack([trainer.flat, trainer.seen]).astype(np.float64) * mine
                count, mine = count + mine, 0

        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if shard != own:
                    end()
                    own, trainer = shard, Trainer(*shared.value)
                todo.append(_unpack(raw, np.uint16))
                held += len(todo[-1])
                if held >= ROUNDS * BATCH:
                    flush()
        end()
        if count:
            at = np.arange(state.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(len(at), count))], names=["at", "w", "s", "n"])

    sums = corpus.select("shard", "ids").mapInArrow(run, "at int, w double, s double, n long").groupBy("at")
    found = sums.agg((F.sum("w") / F.sum("n")).alias("w"), (F.sum("s") / F.sum("n")).alias("s")).toPandas()
    out = state.copy()
    out[:, found["at"].to_numpy()] = found[["w", "s"]].to_numpy().T
    return out


def net_log_probs(net: Net, model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(word | words on both sides) by the network alone, hash and text of every word."""
    word, tail, owner = _hashed(data, off)
    order, first, count = _groups(word)
    own = word[order[first]]
    cls = model.classes(own, tail[order[first]])
    ids, inside = np.empty(len(word), np.int64), np.empty(len(word), np.float32)
    ids[order], inside[order] = np.repeat(cls, count), np.repeat(model.in_class(own, cls), count)
    each = np.zeros(len(ids))
    for a in range(0, len(ids), BATCH):
        b = min(len(ids), a + BATCH)
        low, top = max(0, a - REACH), min(len(ids), b + REACH)
        each[a:b] = Pass(net, ids[low:top], owner[low:top], np.arange(a - low, b - low)).log_prob
    return each + inside, word, owner


def contexts(word: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits: a hash of the words before and after each word (none beyond its text), then WORD_BITS of the word itself."""
    around = np.zeros((2, len(word)), np.uint64)
    if len(word) > 1:
        same = owner[1:] == owner[:-1]
        around[0, 1:] = word[:-1] * same
        around[1, :-1] = word[1:] * same
    key = mix(around[0] * np.uint64(0xD6E8FEB86659FD93) + mix(around[1] + np.uint64(0x94D049BB133111EB)))
    return key >> np.uint64(64 - bits + WORD_BITS) << np.uint64(WORD_BITS) | word >> np.uint64(64 - WORD_BITS)


def key_bits(tokens: int) -> tuple[int, int]:
    """Bits of a key, which keep chance meetings of contexts below one in a thousand, and those of them that name its range."""
    own = max(1, int(tokens).bit_length())
    return min(64, own + 10 + WORD_BITS), min(20, max(4, own - RANGE.bit_length() + 1))


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_tokens, log_prob, mean_log_prob and net_log_prob of every row.

    log_prob sums log P(word | words on both sides) over all words of the whole
    text: P = (m + TRUST * P_net) / (n + TRUST), where n is how often the same
    two neighbours stand around a word at any other place of ``docs``, and m
    how often around this very word; the place itself is left out.
    net_log_prob is the sum by the network alone. Null, empty and blank texts:
    no tokens, 0, mean null.

    Chunks of texts count their contexts and send each once to its range, where
    all chunks' counts are added and sent back; so a context that fills the
    corpus is one entry from each chunk. What is sent grows with the corpus; no
    task holds more than a chunk or a range, and the driver none of it.
    """
    spark = docs.sparkSession
    prepare(spark)
    bits, top = key_bits(model.tokens)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    schema = f"to long, chunk long, part int, blobs array<binary>, ids array<{kind}>"

    def line(to: int, chunk: int, part: int, blobs: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to]), pa.array([chunk]), pa.array([part], pa.int32()), pa.array([blobs], pa.list_(pa.binary())), ids], names=["to", "chunk", "part", "blobs", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, nth = unflatten(shared.value.flat), 0
        for part in steps(batches, "_text", CHUNK_BYTES):
            names = pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type))
            each, word, owner = net_log_probs(net, shared.value, *text_bytes(part.column("_text")))
            key = contexts(word, owner, bits)
            order, first, count = _groups(key)
            count = count.astype(np.uint32)
            chunk = TaskContext.get().partitionId() << 32 | nth
            nth += 1
            nets = np.bincount(owner, each, minlength=part.num_rows).astype(np.float64)
            own = [np.minimum(np.round(-NATS * each[order]), 255).astype(np.uint8), owner[order].astype(np.uint32), count]
            texts = np.stack([np.bincount(owner, minlength=part.num_rows).astype(np.float64), nets]).tobytes()
            yield line(-1 - chunk, chunk, -1, [texts, *(map(_pack, own) if len(key) else [])], names)
            distinct = key[order[first]]
            ranges = (distinct >> np.uint64(bits - top)).astype(np.int64)
            turns = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else np.zeros(0, np.int64)
            none = pa.array([None], names.type)
            for x, y in pairwise([*turns.tolist(), len(ranges)]):
                gaps = np.diff(distinct[x:y], prepend=np.uint64(0))
                yield line(int(ranges[x]), chunk, int(ranges[x]), [_pack(gaps), _pack(count[x:y])], none)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        own, empty = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, count = np.concatenate([k for _, k, _ in held]), np.concatenate([c for _, _, c in held]).astype(np.int64)
            order = np.argsort(keys)
            back = [np.empty(len(keys), np.uint32) for _ in range(2)]
            for out, x in zip(back, (keys[order], keys[order] >> np.uint64(WORD_BITS)), strict=True):
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                total = np.minimum(np.add.reduceat(count[order], first), 0xFFFFFFFF).astype(np.uint32)
                out[order] = np.repeat(total, np.diff(np.append(first, len(x))))
            at = 0
            for chunk, k, _ in held:
                yield line(chunk, chunk, own, [_pack(x[at : at + len(k)]) for x in back], empty)
                at += len(k)

        for b in batches:
            empty = pa.array([None], b.column("ids").type)
            for i in range(b.num_rows):
                chunk, part = b.column("chunk")[i].as_py(), b.column("part")[i].as_py()
                if part < 0:
                    yield b.slice(i, 1)
                    continue
                if own != part:
                    if held:
                        yield from flush()
                    own, held = part, []
                gaps, count = b.column("blobs")[i].as_py()
                held.append((chunk, np.cumsum(_unpack(gaps, np.uint64), dtype=np.uint64), _unpack(count, np.uint32)))
        if held:
            yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, names, blobs, both = None, None, [], []

        def flush() -> pa.RecordBatch:
            n, nets = np.frombuffer(blobs[0], np.float64).reshape(2, -1)
            sums = nets.copy()
            if both:
                verdict, owner, count = (_unpack(x, t) for x, t in zip(blobs[1:], (np.uint8, np.uint32, np.uint32), strict=True))
                m, around = (np.repeat(np.concatenate(x).astype(np.float64), count) - 1 for x in zip(*both, strict=True))
                p = np.exp(verdict.astype(np.float64) / -NATS)
                sums += np.bincount(owner, np.log((m / p + TRUST) / (around + TRUST)), minlength=len(n))
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([names, pa.array(n.astype(np.int64)), pa.array(sums), mean, pa.array(nets)], names=[id_col, "n_tokens", "log_prob", "mean_log_prob", "net_log_prob"])

        for b in batches:
            for i in range(b.num_rows):
                now, got = b.column("chunk")[i].as_py(), b.column("blobs")[i].as_py()
                if now != chunk:
                    if chunk is not None:
                        yield flush()
                    chunk, both = now, []
                if b.column("part")[i].as_py() < 0:
                    names, blobs = b.column("ids").slice(i, 1).flatten(), got
                else:
                    both.append(tuple(_unpack(x, np.uint32) for x in got))
        if chunk is not None:
            yield flush()

    asked = rows.mapInArrow(ask, schema).repartition("to").sortWithinPartitions("part")
    answered = asked.mapInArrow(answer, schema).repartition("chunk").sortWithinPartitions("chunk", "part")
    return answered.mapInArrow(total, f"`{id_col}` {kind}, n_tokens long, log_prob double, mean_log_prob double, net_log_prob double")

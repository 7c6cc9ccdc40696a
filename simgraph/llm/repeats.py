"""Exact removal of repeated byte strings: suffix buckets dealt by anchors, sorted one block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import between, prefix, steps, text_bytes
from simgraph.llm.state import cut, prepare
from simgraph.llm.suffix import repeated_windows

#: Bytes of the strings whose hashes are anchors.
GRAM = 48
#: Places of one anchor from which it counts as hot; distinct segments of a hot anchor in a chunk.
HOT, CHUNK = 2048, 1024
#: The same in bytes of segments.
HOT_BYTES, CHUNK_BYTES = 1 << 22, 1 << 21
#: Bytes of segments that are sorted at a time.
BLOCK_BYTES = 1 << 20


def anchored_runs(data: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start in the text, windows, places of the anchor) of every maximal run of windows of ``length`` bytes with one anchor.

    A window's anchor is the least hash of its ``gram``-byte strings, so it
    depends on the window's bytes alone. Windows never cross texts.
    """
    size = np.diff(off)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    sums = prefix(data)
    at = np.arange(len(data) - gram + 1)
    each = least = between(sums, at, at + gram)
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    many = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    anchor = least[off[:-1][text] + start]
    if not len(anchor):
        return none.astype(np.uint64), none, none, none, none
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] == 0)]))
    run, count = anchor[fresh], np.diff(np.append(fresh, len(anchor)))
    reach = count + wide - 1
    ends = np.cumsum(reach)
    places = np.arange(ends[-1]) + np.repeat(off[:-1][text[fresh]] + start[fresh] - (ends - reach), reach)
    return run, text[fresh], start[fresh], count, np.add.reduceat((each[places] == np.repeat(run, reach)).astype(np.int64), ends - reach)


def unpack(z: bytes | None) -> bytes:
    return zstandard.decompress(z) if z else b""


def _named(id_col: str, text: str) -> list[Column]:
    """uid and check: 128 bits of a hash of a row's id and text, by which rows are told apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(id_col), F.xxhash64(body)).alias("uid"), F.xxhash64(F.lit(1), F.col(id_col), F.xxhash64(F.lit(2), body)).alias("check")]


def _packed(docs: DataFrame, text: str, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, uid and check, the text packed by zstd, which shrinks the shuffles by half, and the columns ``keep``."""
    rows = docs.select(F.col(id_col).alias("_id"), *_named(id_col, text), F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep)
    kind = rows.schema["_id"].dataType.simpleString()
    kept = _fields(rows, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in steps(batches, "_text"):
            z = [pack(x.encode()) for x in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(z, pa.binary()), *map(part.column, keep)], names=["_id", "uid", "check", "z", *keep])

    return rows.mapInArrow(run, f"_id {kind}, uid long, check long, z binary{kept}").where("uid is not null")  # as inner joins ask; so all joins shuffle alike


def _fields(rows: DataFrame, names: tuple[str, ...]) -> str:
    """The end of a schema: the columns ``names`` of ``rows``."""
    return "".join(f", `{x}` {rows.schema[x].dataType.simpleString()}" for x in names)


def _runs(docs: DataFrame, text: str, id_col: str, length: int) -> DataFrame:
    """uid, check, anchor, start, windows and places of the anchor (2 for more) of every run of every text."""
    rows = docs.select(*_named(id_col, text), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text", 1 << 19):
            anchor, owner, start, many, places = anchored_runs(*text_bytes(part.column("_text")), length)
            uid, check = (part.column(x).to_numpy()[owner] for x in ("uid", "check"))
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(check), pa.array(anchor.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(np.minimum(places, 2).astype(np.int32))], names=["uid", "check", "h", "start", "n", "places"])

    return rows.mapInArrow(run, "uid long, check long, h long, start int, n int, places int")


def _flagged(segments: list[bytes], many: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the offsets of its windows (the first ``many``) that equal another window of its group."""
    text = bytearray()
    base = []
    for s in segments:
        base.append(len(text))
        text += s
    at = np.repeat(np.array(base, np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hit = repeated_windows(np.frombuffer(bytes(text), np.uint8), at, np.repeat(group, many), length)
    ends = np.cumsum(many)
    return [np.flatnonzero(hit[a:b]) for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True)]


def _intervals(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows from ``offsets`` (sorted) on cover."""
    if not len(offsets):
        return []
    turn = np.flatnonzero(np.diff(offsets) > length)
    first = offsets[np.concatenate([[0], turn + 1])]
    last = offsets[np.concatenate([turn, [len(offsets) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _sorted_blocks(segments: dict[tuple, dict[bytes, int]], length: int) -> Iterator[tuple[tuple, bytes, list[tuple[int, int]]]]:
    """(key, segment, covered ranges) for groups of distinct segments with their counts, one block of suffixes at a time."""
    todo: list[tuple[tuple, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[tuple, bytes, list[tuple[int, int]]]]:
        many = np.array([len(s) - length + 1 for _, s in todo], np.int64)
        keys = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in todo))}
        found = _flagged([s for _, s in todo], many, np.array([keys[k] for k, _ in todo], np.int64), length)
        for (key, s), off in zip(todo, found, strict=True):
            if len(off) and segments[key][s] < 2:
                yield key, s, _intervals(off, length)

    for key, group in segments.items():
        open_ = [s for s, c in group.items() if c < 2]
        for s, c in group.items():
            if c > 1:
                yield key, s, [(0, len(s))]
        if not open_ or len(group) < 2 and len(open_[0]) == length:
            continue
        todo += [(key, s) for s in group]
        held += sum(map(len, group))
        if held > BLOCK_BYTES:
            yield from flush()
            todo, held = [], 0
    if todo:
        yield from flush()


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of a partition sorted by ``keys``, in lists of whole groups of about BLOCK_BYTES of segments."""
    rows: list[dict] = []
    last, held = None, 0
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[x] for x in keys)
            if k != last and held > BLOCK_BYTES:
                yield rows
                rows, held = [], 0
            rows.append(r)
            held, last = held + len(r["seg"]), k
    if rows:
        yield rows


def _sort_plain(segments: DataFrame, length: int) -> DataFrame:
    """Covered ranges (uid, check, a, b) of segments whose anchors aren't hot: one bucket of suffixes for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, ["h"]):
            groups: dict[tuple, dict[bytes, int]] = {}
            for r in rows:
                g = groups.setdefault((r["h"],), {})
                g[r["seg"]] = g.get(r["seg"], 0) + 1
            covered = {(k, s): c for k, s, c in _sorted_blocks(groups, length)}
            out = [(r["uid"], r["check"], r["start"] + a, r["start"] + b) for r in rows for a, b in covered.get(((r["h"],), r["seg"]), ())]
            if out:
                u, v, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["uid", "check", "a", "b"])

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, "uid long, check long, a int, b int")


def _sort_hot(segments: DataFrame, length: int) -> DataFrame:
    """Covered ranges (uid, check, a, b) of segments with hot anchors.

    Equal segments are counted before they are dealt; a bucket with more than
    CHUNK distinct ones, or CHUNK_BYTES of them, is cut into chunks by hash,
    and every two chunks meet in a bucket of their own.
    """
    segments = segments.withColumn("k", F.md5("seg"))
    distinct = segments.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"))
    size = distinct.groupBy("h").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum(F.octet_length("seg")) / CHUNK_BYTES)).cast("int").alias("m"))
    rows = distinct.join(size, "h").withColumn("own", F.pmod(F.xxhash64("seg"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "seg", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_group(batches, ["h", "x", "y"]):
            groups: dict[tuple, dict[bytes, int]] = {}
            for r in part:
                groups.setdefault((r["h"], r["x"], r["y"]), {})[r["seg"]] = r["c"]
            out = [(k[0], s, a, b) for k, s, c in _sorted_blocks(groups, length) for a, b in c]
            if out:
                h, s, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["h", "seg", "a", "b"])

    dealt = rows.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    found = dealt.mapInArrow(run, "h long, seg binary, a int, b int").select(F.md5("seg").alias("k"), "h", "a", "b").distinct()
    hits = segments.select("h", "k", "uid", "check", "start").join(found, ["h", "k"])
    return hits.select("uid", "check", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def repeated_spans(docs: DataFrame, length: int = 200, text: str = "text", id_col: str = "doc_id", packed: DataFrame | None = None) -> DataFrame:
    """uid and spans (structs of ``check`` and a byte range [a, b); ranges may overlap) of the rows that hold repeated strings.

    A string of ``length`` bytes is repeated if it also starts elsewhere, in
    the same text or another. Equal windows share an anchor, so only runs whose
    anchor is found twice are gathered; each anchor's suffixes are a bucket
    that is sorted by itself, and long ties are resolved by the ranks of a
    difference-cover sample (suffix.Block). Bytes, not hashes, decide. The
    plan shuffles ``packed`` (the same texts) by uid; whoever joins it by uid
    again in one plan reuses that shuffle. A periodic text is one run as long
    as itself: one segment, which a single task holds as it holds the text.
    """
    prepare(docs.sparkSession)
    runs = _runs(docs, text, id_col, length)
    many = runs.select("h", "places", (F.col("n") + (length - 1)).alias("size")).groupBy("h").agg(F.sum("places").alias("c"), F.sum("size").alias("size"))
    anchors = cut(many.where("c > 1").select("h", ((F.col("c") > HOT) | (F.col("size") > HOT_BYTES)).alias("hot")))
    wanted = runs.join(anchors, "h").groupBy("uid").agg(F.collect_set(F.struct("check", "start", "n", "h", "hot")).alias("runs"))
    packed = _packed(docs, text, id_col) if packed is None else packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "check", "start", "h", "hot", "seg"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        out: list[tuple] = []
        held = 0
        for b in batches:
            for r in b.to_pylist():
                raw = unpack(r["z"])
                new = [(r["uid"], r["check"], x["start"], x["h"], x["hot"], raw[x["start"] : x["start"] + x["n"] + length - 1]) for x in r["runs"] if x["check"] == r["check"]]
                held += sum(len(x[5]) for x in new)
                out += new
                if len(out) > 20_000 or held > 4 * BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    segments = packed.select("uid", "check", "z").join(wanted, "uid").mapInArrow(run, "uid long, check long, start int, h long, hot boolean, seg binary")
    plain = _sort_plain(segments.where("not hot"), length)
    if not anchors.where("hot").isEmpty():
        plain = plain.unionByName(_sort_hot(segments.where("hot"), length))
    return plain.groupBy("uid").agg(F.collect_set(F.struct("check", "a", "b")).alias("spans"))


def _maximal(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _widened(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The byte range [a, b), widened to borders of code points."""
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (the remaining bytes) and the columns ``keep`` of every row.

    ``whole``: code points that lose a byte go whole, so that kept is valid UTF-8.

    Every byte that a repeated string of ``length`` bytes covers goes, in all
    its places, judged on the input. Null and shorter texts lose nothing unless
    they can hold such a string; equal rows repeat each other. Rows are told
    apart by 128 bits of a hash of id and text. Ids may have any type.
    """
    prepare(docs.sparkSession)
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes or more are looked for")
    packed = _packed(docs, text, id_col, keep)
    spans = repeated_spans(docs, length, text, id_col, packed)
    kind = packed.schema["_id"].dataType.simpleString()
    rows = packed.join(spans, "uid", "left").select("_id", "check", "z", "spans", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out = b.slice(at, 500), []
                for r in part.to_pylist():
                    raw, cuts = unpack(r["z"]), _maximal([x for x in r["spans"] or [] if x["check"] == r["check"]])
                    if whole:
                        cuts = [_widened(raw, *c) for c in cuts]
                    kept = b"".join(raw[x:y] for x, y in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(raw)], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(cuts), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)), *map(part.column, keep)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", *keep])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary{_fields(rows, keep)}")

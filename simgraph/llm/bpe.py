"""Byte-level BPE by a rank file: a segment tree finds each next merge."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgraph.llm.arrowtext import steps
from simgraph.llm.state import prepare

#: Pieces whose ids a task remembers; it forgets all of them when there are more.
REMEMBERED = 250_000
_NONE = 1 << 62


class Ranks:
    """A vocabulary of byte strings by rank, as tiktoken's files hold it."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.token = dict(zip(self.ranks.values(), self.ranks, strict=True))

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one piece: itself if it is a token, else the merges of lowest rank first, leftmost first.

        Leaf i of the tree holds (rank, i) of the pair of symbols that begins at
        byte i, or nothing; a node holds the least below it, so the root names
        the leftmost pair of minimum rank. A merge changes three leaves.
        """
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if not n:
            return []
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(leaf: int, value: int) -> None:
            k = leaf + size
            tree[k] = value
            while k > 1:
                least = min(tree[k], tree[k ^ 1])
                k >>= 1
                if tree[k] == least:
                    break
                tree[k] = least

        def rank_at(i: int) -> int:
            j = after[i]
            rank = ranks.get(piece[i : after[j]]) if j < n else None
            return _NONE if rank is None else rank << 32 | i

        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            gone = after[i]
            after[i] = after[gone]
            before[after[i]] = i
            if gone < n - 1:
                put(gone, _NONE)
            if i < n - 1:
                put(i, rank_at(i))
            if (left := before[i]) >= 0:
                put(left, rank_at(left))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


class Forest:
    """The same segment tree for many short pieces at once: row w of each array belongs to piece w."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks.ranks
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()] + [_NONE], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two symbols make, _NONE if there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        at[self.pair[np.minimum(at, len(self.pair) - 1)] != key] = len(self.pair)
        return self.merged[at]

    def ids(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``size`` bytes (a power of two)."""
        count = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.zeros((count, size), np.uint8)
        place = np.arange(size)
        inside = place < n[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.byte[raw]
        after = np.tile(np.arange(1, size + 1), (count, 1))
        before = np.tile(np.arange(-1, size), (count, 1))
        tree = np.full((count, 2 * size), _NONE, np.int64)
        paired = place[:-1] + 1 < n[:, None]
        rank = self.rank(sym[:, :-1][paired], sym[:, 1:][paired])
        leaf = np.full((count, size - 1), _NONE, np.int64)
        leaf[paired] = np.where(rank == _NONE, _NONE, rank << 8 | np.nonzero(paired)[1])
        tree[:, size:-1] = leaf
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            top = tree[row, 1]
            i, made = top & 0xFF, top >> 8
            gone = after[row, i]
            then = after[row, gone]
            sym[row, i], after[row, i], before[row, then] = made, then, i
            inside[row, gone] = False
            tree[row, size + gone] = _NONE
            tree[row, size + i] = _NONE
            on = then < n[row]
            rank = self.rank(made[on], sym[row[on], then[on]])
            tree[row[on], size + i[on]] = np.where(rank == _NONE, _NONE, rank << 8 | i[on])
            left = before[row, i]
            on = left >= 0
            rank = self.rank(sym[row[on], left[on]], made[on])
            tree[row[on], size + left[on]] = np.where(rank == _NONE, _NONE, rank << 8 | left[on])
            for r, k in ((row, size + gone), (row, size + i), (row[on], size + left[on])):
                while k.size and k[0] > 1:
                    k = k >> 1
                    tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
            row = row[tree[row, 1] != _NONE]
        packed = sym[inside].astype("<u4").tobytes()
        ends = 4 * np.cumsum(inside.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Memo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, for ids seen of late."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.forest = ranks, Forest(ranks)

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all of ``pieces`` are here: short ones by the forest, long ones by one tree each."""
        missing = [p for p in pieces if p not in self]
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            missing = list(pieces)
        short: dict[int, list[tuple[str, bytes]]] = {}
        for p in missing:
            raw = p.encode()
            if (rank := self.ranks.ranks.get(raw)) is not None:
                self[p] = rank.to_bytes(4, "little")
            elif len(raw) <= 64:
                short.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
            else:
                self[p] = np.array(self.ranks.ids(raw), "<u4").tobytes()
        for size, found in short.items():
            for at in range(0, len(found), 8192):
                part = found[at : at + 8192]
                self.update(zip([p for p, _ in part], self.forest.ids([raw for _, raw in part], size), strict=True))


_RANKS: dict[str, Ranks] = {}
_MEMOS: dict[str, Memo] = {}


def _ranks(path: str) -> Ranks:
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


def _memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(_ranks(path))
    return _MEMOS[path]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """``keep`` and ``ids``: the ids of each row's whole text as little-endian unsigned 32-bit integers (binary).

    ``decoded``: a column of the bytes that ``decode`` makes of the ids, in the
    same pass, so that a task needs one Python worker instead of two.

    Each match of ``pattern`` is encoded by itself; text between matches gives
    nothing. Null and empty texts: no ids. No special tokens. The rank file
    must be at ``path`` on every executor.
    """
    prepare(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    made = [decoded] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, memo, token = regex.compile(pattern).findall, _memo(path), _ranks(path).token
        for part in steps(batches, "_text"):
            split = [pieces(x) if x else [] for x in part.column("_text").to_pylist()]
            memo.learn(set().union(*split))
            got = [b"".join(map(memo.__getitem__, x)) for x in split]
            back = [pa.array([_bytes(token, x) for x in got], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary()), *back], names=[*keep, ids, *made])
        memo.clear()  # workers outlive tasks; what they hold between them shouldn't

    return rows.mapInArrow(run, ", ".join([f"{schema}`{ids}` binary", *(f"`{x}` binary" for x in made)]))


def _bytes(token: dict[int, bytes], ids: bytes | None) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` and ``out``: the bytes (binary) of each row's ids; null and empty: no bytes. An id that isn't a rank raises KeyError."""
    prepare(df.sparkSession)
    rows = df.select(*keep, F.col(ids).alias("_ids"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _ranks(path).token
        for part in steps(batches, "_ids"):
            got = [_bytes(token, x) for x in part.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*keep, ids, out])

    return rows.mapInArrow(run, f"{schema}`{ids}` binary, `{out}` binary")

"""Graphs as symmetric edge lists (u, v): from relational tables, from two-file binary CSR, and back."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgraph.runtime import prepare

#: Edges of a batch that are read from a binary file.
ROWS = 1 << 16


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of the pairs in the first two columns, without loops, repeats and nulls."""
    a, b = pairs.columns[:2]
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    both = pairs.select(F.explode(F.array(F.struct(u.alias("u"), v.alias("v")), F.struct(v.alias("u"), u.alias("v")))).alias("e"))
    return both.select("e.u", "e.v").where("u <> v").distinct()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_supplier(spark: SparkSession, sf_dir: str, quantity: float = 45) -> DataFrame:
    """Customer c is 2c and supplier s is 2s + 1, joined where c bought at least ``quantity`` of a part from s."""
    lines = _table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= quantity).select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return symmetric(pairs.select(2 * F.col("o_custkey"), 2 * F.col("l_suppkey") + 1))


def copurchase(spark: SparkSession, sf_dir: str, quantity: float = 40) -> DataFrame:
    """Parts joined where one order has at least ``quantity`` of both."""
    lines = _table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= quantity).select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("other"))
    return symmetric(lines.join(other, "l_orderkey").where("l_partkey < other").select("l_partkey", "other"))


def write_binary(edges: DataFrame, path: str) -> None:
    """Write a graph with ids 0 to n - 1 as the two files of unsigned 32-bit integers that ``read_binary`` reads.

    Tasks pack the sorted edges; the driver takes one partition of packed rows
    at a time, and holds the degrees.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, many = np.unique(b.column(0).to_numpy(), return_counts=True)
            parts = [x.astype("<u4").tobytes() for x in (ids, many, b.column(1).to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["ids", "many", "ends"])

    prepare(edges.sparkSession)
    degree, m = np.zeros(0, np.int64), 0
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/b_adj.bin", "wb") as f:
        for r in edges.select("u", "v").orderBy("u", "v").mapInArrow(pack, "ids binary, many binary, ends binary").toLocalIterator():
            ids = np.frombuffer(r.ids, "<u4")
            if len(ids):
                if ids[-1] >= len(degree):
                    degree = np.concatenate([degree, np.zeros(max(int(ids[-1]) + 1 - len(degree), len(degree)), np.int64)])
                degree[ids] += np.frombuffer(r.many, "<u4")
                m += len(r.ends) // 4
                f.write(r.ends)
    degree = np.trim_zeros(degree, "b")
    with open(f"{path}/b_degree.bin", "wb") as f:
        f.write(struct.pack("<III", 4, len(degree), m) + degree.astype("<u4").tobytes())


def read_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(v, deg), edges(u, v)) from ``b_degree.bin`` (size 4, n, m, degrees) and ``b_adj.bin`` (the sorted lists end to end).

    Isolated vertices are vertices of degree 0. Another integer size raises ValueError.
    """
    prepare(spark)
    head = spark.read.format("binaryFile").load(f"{path}/b_degree.bin").select("content")
    body = spark.read.format("binaryFile").load(f"{path}/b_adj.bin").select(F.col("content").alias("adj"))

    def vertices(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                if struct.unpack_from("<I", raw)[0] != 4:
                    raise ValueError("the graph isn't stored in 4-byte integers")
                degree = np.frombuffer(raw, "<u4", offset=12).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(degree))), pa.array(degree)], names=["v", "deg"])

    def edges(batches):
        for b in batches:
            for raw, adj in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends = np.frombuffer(adj, "<u4")
                upto = np.cumsum(np.frombuffer(raw, "<u4", offset=12), dtype=np.int64)
                for at in range(0, len(ends), ROWS):
                    part = ends[at : at + ROWS].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(upto, np.arange(at, at + len(part)), "right")), pa.array(part)], names=["u", "v"])

    return head.mapInArrow(vertices, "v long, deg long"), head.crossJoin(body).mapInArrow(edges, "u long, v long")


def write_index(index: dict[str, DataFrame], path: str, config: str) -> None:
    """The tables of a similarity index, sorted by falling score so that scans with a threshold skip row groups."""
    for name, df in index.items():
        key = "score" if "score" in df.columns else "ub_score" if "ub_score" in df.columns else None
        (df.sortWithinPartitions(F.desc(key)) if key else df).write.mode("overwrite").parquet(f"{path}/{config}/{name}")


def read_index(spark: SparkSession, path: str, config: str) -> dict[str, DataFrame]:
    """What ``write_index`` wrote under a configuration's name."""
    return {name: spark.read.parquet(f"{path}/{config}/{name}") for name in ("residual", "member", "block_right")}


def config_name(kind: str, **values: float) -> str:
    """A folder name from an index's kind and settings: doubles with at most six digits, ``p`` for the point."""
    return "_".join([kind, *(f"{float(v):.6f}".rstrip("0").rstrip(".").replace(".", "p") for v in values.values())])


def write_result(result: DataFrame, path: str) -> None:
    """Members (or any result) as Parquet, and its summary as text."""
    result.write.mode("overwrite").parquet(f"{path}/detail")
    result.agg(F.concat_ws(" ", F.lit("rows"), F.count(F.lit(1))).alias("value")).write.mode("overwrite").text(f"{path}/abstract")

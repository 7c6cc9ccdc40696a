"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgraph.llm import bpe, decontam, repeats, resample, simhash
from simgraph.llm.state import checkpoint_path, cut

#: Bytes of the repeated strings that stage 3 removes.
REPEATED = 200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(*columns: str) -> Column:
    """A hash of the columns of a row; nulls count by their place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that it rejects go, each row by its own id and text."""
    judged = resample.resample(docs, _table(spark, sf_dir, "labels"), hashed=True)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone"), "_h").distinct()
    return docs.join(gone, (F.xxhash64("text") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash through BK-trees: of each group of linked fingerprints one row stays, that with the smallest id.

    Null ids come last; a hash of the row decides between equal ids, and of
    rows that are equal throughout one stays. Documents without words all have
    the fingerprint zero: one of them stays.
    """
    rows = docs.withColumn("_row", _row(*docs.columns))
    alike = simhash.near_roots(rows, keys=("doc_id", "_row")).groupBy("root", "doc_id", "_row").agg(F.count(F.lit(1)).alias("n"))
    best = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"), "n")).alias("best"))
    best = cut(best.select("best.*"))

    def among(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, (F.col("_row") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    if best.where("n > 1").isEmpty():
        return among(best).drop("_row")
    return among(best.where("n = 1")).unionByName(among(best.where("n > 1")).dropDuplicates(["_row"])).drop("_row")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix buckets: every byte that a repeated string covers goes; code points that lose a byte go whole.

    The other columns ride along with each text, so no row needs an id of its own.
    """
    texts = docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("text").isNull().alias("_none"))
    left = repeats.remove_repeats(texts, REPEATED, keep=("lang", "source", "n_chars", "_none"), whole=True)
    cut_ = F.col("n_removed") > 0
    left = left.withColumn("text", F.when(~F.col("_none"), F.col("kept").cast("string")))
    return left.select("doc_id", "text", "lang", "source", F.when(cut_, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Template windows: documents that hold a benchmark item go, each row by its own text."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each text (little-endian unsigned 32-bit), their number, and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "text", "lang", "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha"))
    back = bpe.encode(rows, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "sha"), decoded="decoded")
    return back.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: Fingerprints, n-gram models and ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written in the shared checkpoint folder."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{checkpoint_path(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

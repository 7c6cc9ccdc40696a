"""Edges that arrive as files: a stream keeps the distinct symmetric edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, target: str, state: str) -> StreamingQuery:
    """Append new edges of the Parquet files (u, v) in ``source`` to ``target``, both directions, until all present files are read.

    Edges that ``target`` already holds are left out, so a file that comes
    twice, or a batch that is tried again after a failure, changes nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = batch.select("u", "v").unionByName(batch.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        try:
            held = spark.read.schema("u long, v long").parquet(target)
            new = new.join(held, ["u", "v"], "left_anti")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema("u long, v long").parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()

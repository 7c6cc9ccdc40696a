"""Reliable checkpoints, and the import path of local Python workers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; a temporary one only where it is unset in a local session, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # else Spark 4.1 may drop a repartition after a union that isn't dealt by its key
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def checkpoint_path(spark: SparkSession) -> str:
    """The shared folder of this application's checkpoints."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in files that survive lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)

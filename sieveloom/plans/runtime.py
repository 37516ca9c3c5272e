"""Partition counts, worker paths and lineage cuts that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    On a cluster without a shared file system the package goes along with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if PACKAGE_ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, known)])
    return spark


def cores(spark: SparkSession) -> int:
    """Task slots of the application, as far as they are known now."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's setting, but no fewer than its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give CPU-heavy Python work enough tasks.

    A small file is one input split and would keep one core busy. Inputs that already have a task or
    more for every core stay as they are, so large inputs never pay for this exchange.
    """
    spark = df.sparkSession
    wanted = cores(spark)
    if df.rdd.getNumPartitions() >= 2 * wanted:
        return df
    return df.repartition(per_core * wanted)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.gettempdir()
    return os.path.join(named, f"sieveloom-{uuid.uuid4().hex}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)

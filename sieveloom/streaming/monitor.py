"""Trace events and metrics as streams; every transformation also runs on a batch of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sieveloom.plans.runtime import shared_folder
from sieveloom.sources.tables import table

TRACE = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("event", T.StringType()), T.StructField("payload", T.StringType())])


def read_traces(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The JSON lines that are appended to a folder as a stream; malformed lines have no event and are dropped."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").json(folder).where("event is not null")


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table (a file or a folder of part files) as a stream."""
    schema = table(spark, directory, name).schema
    reader = spark.readStream.schema(schema)
    files = f"{directory}/{name}.parquet"
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory) if _is_file(spark, files) else reader.parquet(files)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result.

    Only for results of bounded size, such as counts by kind: the sink keeps them in the driver.
    """
    spark = stream.sparkSession
    name = f"sieveloom_{uuid.uuid4().hex}"
    folder = shared_folder(spark)
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def event_counts(events: DataFrame, kind: str = "event_type", time: str = "ts") -> DataFrame:
    """Events and the latest time by kind; as a stream in complete mode this is the monitor's state."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("latest"))


def stage_latency(events: DataFrame, window: str, late: str | None = None) -> DataFrame:
    """Count, mean and maximum of value by kind in tumbling windows; a stream needs ``late``, its watermark."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "events", "mean_value", "max_value")


def once_per_key(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream without redelivered rows, within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert(old: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key; rows of ``changes`` with deleted = true take their key away."""
    both = old.withColumn("deleted", F.lit(False)).unionByName(changes)
    newest = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("deleted"))))
    return newest.where("_n = 1 and not deleted").drop("_n", "deleted")


def maintain(changes: DataFrame, store, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep a bucketed table (see ``sources.store``) up to date with a stream of changes, a version per micro-batch.

    A micro-batch rewrites the buckets of its keys only. One that is delivered again after a failure starts from the
    version before it and replaces what it wrote.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(batch, f"batch-{number:012d}", lambda old, new: upsert(old, new, key, order))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

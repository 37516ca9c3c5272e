"""Versioned Parquet tables whose versions become visible at once, deterministic ids and guards."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Folder:
    """Small files and listings of a folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if self._fs.exists(self._path("")) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def put(self, name: str, text: str) -> None:
        """Write a whole small file; an object store shows it when it is closed, never in part."""
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def get(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class VersionedTable:
    """Versions are written to fresh folders; a numbered marker file that names the folder publishes one, the last marker counts.

    Data that readers may see is never touched: writing a version again writes another folder. Publishing creates one
    file, which needs no rename. A failed write leaves no marker and thus the old version in place. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by
        self._folder = _Folder(spark, root)

    def _published(self) -> list[tuple[str, str]]:
        """(version, folder) in the order of publishing."""
        return [tuple(name.split("=", 1)[1].split("@")) for name in self._folder.names() if name.startswith("published-")]

    def versions(self) -> list[str]:
        """Published versions, oldest first by name."""
        return sorted({version for version, _ in self._published()})

    def current(self) -> str | None:
        found = self._published()
        return found[-1][0] if found else None

    def write(self, df: DataFrame, version: str) -> None:
        """Write a version to a folder of its own, then let readers see it."""
        attempt = uuid.uuid4().hex[:12]
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.root}/{version}@{attempt}")
        self._publish(version, attempt)

    def _publish(self, version: str, attempt: str) -> None:
        self._folder.put(f"published-{len(self._published()):012d}={version}@{attempt}", "")

    def point_to(self, version: str) -> None:
        """Publish the last folder of an earlier version again."""
        attempts = [attempt for v, attempt in self._published() if v == version]
        if not attempts:
            raise FileNotFoundError(f"{self.root} has no version {version}")
        self._publish(version, attempts[-1])

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        found = self._published()
        if not found:
            if schema is None:
                raise FileNotFoundError(f"{self.root} has no version yet")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{'@'.join(found[-1])}")


class BucketedTable:
    """A table of one row per key in a fixed number of buckets by the key's hash; a change rewrites the buckets it touches only.

    A manifest per version names the folder of every bucket; untouched buckets keep theirs. Readers take the last
    manifest by name. A version that is written again starts from the version before it and goes to new folders.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._folder = _Folder(spark, root)

    def _manifest(self, before: str | None = None) -> dict[str, str]:
        names = [n for n in self._folder.names() if n.startswith("manifest-") and (before is None or n < f"manifest-{before}")]
        return json.loads(self._folder.get(names[-1])) if names else {}

    def _rows(self, folders: dict[str, str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/{folder}/_bucket={bucket}" for bucket, folder in folders.items() if self._folder.exists(f"{folder}/_bucket={bucket}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema: T.StructType) -> DataFrame:
        return self._rows(self._manifest(), schema)

    def apply(self, changes: DataFrame, version: str, merge) -> list[int]:
        """Make ``merge(old rows, changes)`` of every touched bucket a new version; the touched buckets (at most all) are returned."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r["_bucket"] for r in changes.select(bucket.alias("_bucket")).distinct().collect())
        manifest = self._manifest(version)
        schema = T.StructType([f for f in changes.schema if f.name != "deleted"])
        old = self._rows({b: folder for b, folder in manifest.items() if int(b) in touched}, schema)
        folder = f"{version}@{uuid.uuid4().hex[:12]}"
        merge(old, changes).withColumn("_bucket", bucket).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        self._folder.put(f"manifest-{version}", json.dumps(manifest | {str(b): folder for b in touched}))
        return touched


def same_dimension(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """The rows, or an error at run time where a vector has another dimension."""
    checked = F.when(F.size(column) == dimensions, F.col(column)).otherwise(F.raise_error(F.lit(f"{column} must have {dimensions} dimensions")))
    return vectors.withColumn(column, checked)


def append_vectors(old: DataFrame, new: DataFrame, key: str, column: str, dimensions: int) -> DataFrame:
    """Old rows but for those whose key is in ``new``, and all new ones; dimensions are checked."""
    return old.join(new.select(key), key, "left_anti").unionByName(same_dimension(new, column, dimensions))


def write_metrics(rows: DataFrame, path: str) -> None:
    """Append metric rows, partitioned by suite, sorted for scans by run and metric."""
    rows.sortWithinPartitions("run_id", "metric_name", "event_time").write.mode("append").partitionBy("suite").parquet(path)

"""The N best items of every group, exactly, however large a group is.

One range-partitioned sort on (group, order, identifier) lays every group out as a contiguous run that may cross
partitions. A streaming pass numbers the rows within each (partition, group) run and keeps the first N of them, so
at most N rows per run remain. The number of remaining rows of the same group in earlier partitions, a prefix sum
over the partition numbers, turns local into global positions. A group with a third of all rows is just a run over
many partitions; no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.plans.runtime import shuffle_partitions


def group_hashes(*group: str | Column) -> list[Column]:
    """128 bits that stand for a group in the sort, so that long group texts are not shuffled twice."""
    return [F.xxhash64(F.lit(1), *group), F.xxhash64(F.lit(2), *group)]


def _local_positions(n: int, hidden: tuple[str, str, str]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        last_group: tuple[int, int] | None = None
        last_key: object = None
        seen = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first, second, keys = (batch.column(batch.schema.get_field_index(c)) for c in hidden)
            a, b = first.to_numpy(), second.to_numpy()
            k = keys.to_numpy(zero_copy_only=False)
            new_group = np.empty(len(a), dtype=bool)
            new_group[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new_group[0] = last_group != (a[0], b[0])
            repeated = np.empty(len(a), dtype=bool)
            repeated[1:] = ~new_group[1:] & (k[1:] == k[:-1])
            repeated[0] = not new_group[0] and k[0] == last_key
            fresh = np.cumsum(~repeated)
            starts = np.flatnonzero(new_group)
            run = np.cumsum(new_group)  # 0: still the run of the batch before
            before = np.concatenate([[-seen], fresh[starts] - 1])
            position = fresh - before[run]
            last_group, last_key, seen = (a[-1], b[-1]), k[-1], int(position[-1])
            keep = (position <= n) & ~repeated
            if keep.any():
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.full(kept.num_rows, partition), pa.int32()), pa.array(position[keep].astype(np.int64))],
                    names=[*kept.schema.names, "_partition", "_local"],
                )

    return number


def top_n(items: DataFrame, group: list[str], order: list[Column], key: str, n: int, position: str = "position") -> DataFrame:
    """Rows of ``items`` whose exact position within ``group`` under ``order``, then ``key``, is at most ``n``.

    ``order`` must be expressions over columns of ``items``; ``key`` names a column that is not null and identifies
    a row. Rows of one group with the same key and order values are one row delivered again and count once.
    The result has the columns of ``items`` and ``position`` (bigint, from 1). Null group values form a group of
    their own; null order values sort as Spark sorts them; an empty input gives an empty result. ``position`` may
    not be a column of ``items``; the helper columns are prefixed with an underscore.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if position in items.columns:
        raise ValueError(f"items already has a column {position}")
    keyed = items.select("*", *(h.alias(f"_group{i}") for i, h in enumerate(group_hashes(*group), 1)), F.col(key).alias("_key"))
    by = [F.col("_group1"), F.col("_group2"), *order, F.col("_key")]
    ranged = keyed.repartitionByRange(shuffle_partitions(items.sparkSession), *by).sortWithinPartitions(*by)
    schema = T.StructType([*keyed.schema.fields, T.StructField("_partition", T.IntegerType()), T.StructField("_local", T.LongType())])
    local = ranged.mapInArrow(_local_positions(n, ("_group1", "_group2", "_key")), schema)
    earlier = Window.partitionBy("_group1", "_group2").orderBy("_partition").rangeBetween(Window.unboundedPreceding, -1)
    placed = local.withColumn(position, F.col("_local") + F.count(F.lit(1)).over(earlier))
    return placed.where(F.col(position) <= n).select(*items.columns, position)


def best_hits(requests: DataFrame, hits: DataFrame, n: int = 10, with_query: bool = True) -> DataFrame:
    """The ``n`` best hits of every distinct query text over all its requests.

    ``requests`` has request_id and query, ``hits`` has hit_id, request_id, path and score. Requests without a query,
    hits without a usable score (null, NaN) and hits of unknown requests take no part; rows delivered again count
    once. Order: score descending, path ascending by bytes (null first), hit_id ascending. Other columns are ignored,
    whatever their names. Result: query, position, hit_id, path, score; without ``with_query`` the 128-bit hashes
    query_a and query_b stand for the query text, which then never leaves the requests.
    """
    group = ["query"] if with_query else ["query_a", "query_b"]
    asked = requests.where("query is not null and request_id is not null")
    if not with_query:
        a, b = group_hashes("query")
        asked = asked.select("request_id", a.alias("query_a"), b.alias("query_b"))
    asked = asked.select("request_id", *group).distinct()
    usable = hits.where("score is not null and not isnan(score) and hit_id is not null").select("hit_id", "request_id", "path", (F.col("score") + F.lit(0).cast("float")).alias("score"))
    joined = usable.join(asked, "request_id").select(*group, "hit_id", "path", "score")
    return top_n(joined, group, [F.col("score").desc(), F.col("path").asc_nulls_first()], "hit_id", n).select(*group, "position", "hit_id", "path", "score")

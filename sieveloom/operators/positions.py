"""Exact positions in an order, over all rows or within groups of any size.

A range-partitioned sort makes every group a run that may cross partitions. Partition numbers and row numbers come
from one generated id; the counts of the runs, at most one row per group and partition, are summed up in order and
joined back. No task holds a group, and there is no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.plans.runtime import checkpoint, shuffle_partitions


def numbered(df: DataFrame, group: list[str], order: list[Column], position: str = "position", total: str = "group_size") -> DataFrame:
    """``df`` with the position of every row (from 1) and the size of its group; null group values are a group.

    The sorted rows are checkpointed, as counting and numbering must see the same partitions.
    """
    by = [*(F.col(g) for g in group), *order]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    kept = checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    runs = kept.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_count").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "_part", "_first", before.alias("_before"), F.sum("_count").over(own).alias(total))
    same = F.col("k._part") == F.col("r._part")
    for g in group:
        same = same & F.col(f"k.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = kept.alias("k").join(runs.alias("r"), same)
    return joined.select(*(F.col(f"k.{c}").alias(c) for c in df.columns), (F.col("_before") + F.col("k._id") - F.col("_first") + 1).alias(position), F.col(total))


def nearest_percentiles(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """The values at index round((n - 1) q) of the sorted values of every group, halves to even, q in ``at``; nulls aside."""
    places = numbered(df.where(F.col(value).isNotNull()).select(*group, value), group, [F.col(value)])
    wanted = places.withColumn("p", F.explode(F.array(*(F.lit(float(q)) for q in at))))
    hit = wanted.where(F.col("position") == F.bround((F.col("group_size") - 1) * F.col("p")).cast("long") + 1)
    return hit.select(*group, "p", F.col(value).alias("value"))


def with_mean_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, equal values at the mean of their first and last position."""
    places = numbered(df, group, [F.col(value)], "_position", "_size")
    ranks = places.groupBy(*group, value).agg(((F.min("_position") + F.max("_position")) / 2).alias(name))
    return _joined(places.select(*df.columns), ranks, [*group, value], name)


def linear_percentiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A column for each name in ``at`` with that share's percentile in every group, between two values in proportion; null without values."""
    places = numbered(df.where(F.col(value).isNotNull()).select(*group, value), group, [F.col(value)])
    ends, between = [], []
    for name, q in at.items():
        place = (F.col("group_size") - 1) * F.lit(float(q)) + 1
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        share = F.col(f"_share_{name}")
        ends += [
            F.max(F.when(F.col("position") == F.floor(place), F.col(value))).alias(f"_low_{name}"),
            F.max(F.when(F.col("position") == F.ceil(place), F.col(value))).alias(f"_high_{name}"),
            F.max(place - F.floor(place)).alias(f"_share_{name}"),
        ]
        between.append(F.when(low == high, low.cast("double")).otherwise(low * (1 - share) + high * share).alias(name))
    found = places.groupBy(*group).agg(*ends).select(*group, *between)
    return _joined(df.select(*group).distinct(), found, group, *at)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], *names: str) -> DataFrame:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), same, "left").select("l.*", *(F.col(f"r.{n}") for n in names))

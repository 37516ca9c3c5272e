"""Fusing signals and ranked lists, and keeping lists diverse. Candidates are rows (query_id, item_id, path, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.text import directory, merge_key
from sieveloom.operators.lexical import ranked


def minmax(value: Column, per: list[str], constant: float = 1.0) -> Column:
    """A signal scaled to 0..1 within a query; where it does not vary, ``constant``."""
    w = Window.partitionBy(*per)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(constant))


def weighted_sum(weights: dict[str, float], factor: Column | float = 1.0) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return total * factor


def best_per_item(candidates: DataFrame, signals: list[str]) -> DataFrame:
    """Candidates of several sources as one row per query and item with the largest of every signal."""
    return candidates.groupBy("query_id", "item_id").agg(F.min("path").alias("path"), *(F.max(s).alias(s) for s in signals))


def rrf(candidates: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of signals: weight / (k + rank) over those above 0; ties of a signal by path, then item, descending."""
    long = candidates.select("query_id", "item_id", "path", *weights).unpivot(["query_id", "item_id", "path"], list(weights), "signal", "value").where("value > 0")
    numbered = ranked(long, ["query_id", "signal"], [F.col("value").desc(), F.col("path").desc(), F.col("item_id").desc()])
    weight = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))])[F.col("signal")]
    return numbered.groupBy("query_id", "item_id", "path").agg(F.sum(weight / (k + F.col("rank"))).alias("score"))


def file_votes(candidates: DataFrame, base: str, best: int = 4) -> DataFrame:
    """Files by their best candidates: the sum of the four largest values, each counting half of the one before, scaled to 0..1."""
    top = ranked(candidates, ["query_id", "path"], [F.col(base).desc(), F.col("item_id")], best)
    votes = top.groupBy("query_id", "path").agg(F.sum(F.col(base) * F.pow(F.lit(0.5), F.col("rank") - 1)).alias("vote"))
    return votes.withColumn("file_vote", minmax(F.col("vote"), ["query_id"]))


def family_penalty(candidates: DataFrame, signal: str, least: int = 3, strength: float = 1.0) -> DataFrame:
    """Dampen values that many candidates of a query share: times (least / size) ** strength from ``least`` on."""
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id", signal))
    damped = F.when((F.col(signal) > 0) & (size >= least), F.col(signal) * F.pow(F.lit(float(least)) / size, F.lit(strength))).otherwise(F.col(signal))
    return candidates.withColumn(f"{signal}_damped", damped)


def cap_per_path(ranking: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` candidates of a path; ranks close up."""
    kept = ranked(ranking, ["query_id", "path"], [F.col("rank")], cap, "_within").withColumnRenamed("rank", "_old")
    return ranked(kept, ["query_id"], [F.col("_old")]).drop("_within", "_old")


def directory_cap(ranking: DataFrame, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` files of a directory, then the skipped ones in order until ``limit`` is reached."""
    in_dir = ranked(ranking.withColumn("_dir", directory(F.col("path"))), ["query_id", "_dir"], [F.col("rank")], None, "_n")
    order = [(F.col("_n") > cap).cast("int"), F.col("_old")]
    return ranked(in_dir.withColumnRenamed("rank", "_old"), ["query_id"], order, limit).drop("_dir", "_n", "_old")


def round_robin(ranking: DataFrame, limit: int) -> DataFrame:
    """One file of every directory in order of rank, then a second of each, and so on."""
    in_dir = ranked(ranking.withColumn("_dir", directory(F.col("path"))), ["query_id", "_dir"], [F.col("rank")], None, "_n")
    first = in_dir.withColumn("_first", F.min("rank").over(Window.partitionBy("query_id", "_dir"))).withColumnRenamed("rank", "_old")
    return ranked(first, ["query_id"], [F.col("_n"), F.col("_first")], limit).drop("_dir", "_n", "_first", "_old")


def preserve_top(ranking: DataFrame, signal: str, margin: float) -> DataFrame:
    """Put the item that leads by ``signal`` first if it leads by the margin at least."""
    w = Window.partitionBy("query_id").orderBy(F.col(signal).desc(), F.col("item_id"))
    led = ranking.withColumn("_place", F.row_number().over(w)).withColumn("_second", F.lead(signal).over(w))
    leads = (F.col("_place") == 1) & (F.col("_second").isNull() | (F.col(signal) - F.col("_second") >= margin))
    moved = led.withColumn("_key", F.when(leads, 0).otherwise(F.col("rank"))).drop("rank")
    return ranked(moved, ["query_id"], [F.col("_key")]).drop("_place", "_second", "_key")


def preserve_kind_tops(ranking: DataFrame, signal: str, per_kind: int, limit: int) -> DataFrame:
    """Every kind's best items by ``signal`` stay in the first ``limit``: they displace the last unpreserved ones, at the end."""
    kinds = ranked(ranking, ["query_id", "kind"], [F.col(signal).desc(), F.col("item_id")], None, "_in_kind")
    marked = kinds.withColumn("_kept", F.col("_in_kind") <= per_kind)
    w = Window.partitionBy("query_id")
    inside = F.col("rank") <= limit
    missing = F.count_if(F.col("_kept") & ~inside).over(w)
    size = F.count_if(inside).over(w)
    overflow = F.greatest(F.lit(0), size + missing - limit)
    from_end = F.when(inside & ~F.col("_kept"), F.count_if(inside & ~F.col("_kept")).over(w.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    chosen = marked.withColumn("_stays", F.when(inside, F.col("_kept") | (from_end > overflow)).otherwise(F.col("_kept")))
    order = [(~inside).cast("int"), F.when(inside, F.col("rank")), F.col(signal).desc(), F.col("item_id")]
    numbered = chosen.where("_stays").withColumn("_new", F.row_number().over(w.orderBy(*order))).where(F.col("_new") <= limit)
    return numbered.drop("_in_kind", "_kept", "_stays", "rank").withColumnRenamed("_new", "rank")


def path_ranks(results: DataFrame, per: list[str]) -> DataFrame:
    """Results reduced to the first of every path, numbered anew."""
    first = ranked(results, [*per, "path"], [F.col("rank"), F.col("item_id")], 1, "_first").drop("_first").withColumnRenamed("rank", "_old")
    return ranked(first, per, [F.col("_old"), F.col("item_id")]).drop("_old")


def multi_query_rrf(results: DataFrame, k: int = 60, original_weight: float = 1.0, limit: int = 10) -> DataFrame:
    """Fuse the lists of a query's variants (variant 0 is the original) over paths."""
    weight = F.when(F.col("variant") == 0, original_weight).otherwise(1.0)
    scored = path_ranks(results, ["query_id", "variant"]).groupBy("query_id", "path").agg(F.sum(weight / (k + F.col("rank"))).alias("score"))
    return ranked(scored, ["query_id"], [F.round("score", 9).desc(), F.col("path").desc()], limit)


def dual(primary: DataFrame, secondary: DataFrame, mode: str, limit: int, k: int = 60) -> DataFrame:
    """Two collections as one list over paths: rrf, max (best score), or union (primary first, then new paths)."""
    a, b = path_ranks(primary, ["query_id"]), path_ranks(secondary, ["query_id"])
    if mode == "union":
        fresh = b.join(a.select("query_id", "path"), ["query_id", "path"], "left_anti")
        rows = a.select("query_id", "path", "score", F.lit(0).alias("_side"), "rank").unionByName(fresh.select("query_id", "path", "score", F.lit(1).alias("_side"), "rank"))
        return ranked(rows.withColumnRenamed("rank", "_old"), ["query_id"], [F.col("_side"), F.col("_old")], limit).drop("_side", "_old")
    both = a.select("query_id", "path", "score", "rank").unionByName(b.select("query_id", "path", "score", "rank"))
    value = F.sum(1 / (k + F.col("rank"))) if mode == "rrf" else F.max("score")
    return ranked(both.groupBy("query_id", "path").agg(value.alias("score")), ["query_id"], [F.round("score", 9).desc(), F.col("path")], limit)


def probe_merge(results: DataFrame, limit: int) -> DataFrame:
    """Lists of several probes as one: score + 1 / rank + 0.05 / (probe + 1), the best row of every path."""
    merged = F.col("score") + 1 / F.col("rank") + F.lit(0.05) / (F.col("probe") + 1)
    rows = results.withColumn("merged", merged).withColumn("_key", merge_key(F.col("path")))
    best = ranked(rows, ["query_id", "_key"], [F.round("merged", 9).desc(), F.col("probe"), F.col("rank"), F.col("item_id")], 1, "_first")
    return ranked(best.withColumnRenamed("rank", "_old"), ["query_id"], [F.round("merged", 9).desc(), F.col("_key")], limit).drop("_first", "_old")


def quota_mix(ranking: DataFrame, group: str, quotas: dict[str, int], limit: int) -> DataFrame:
    """The first of every group up to its quota, filled up with the others in order."""
    numbered = ranked(ranking, ["query_id", group], [F.col("rank")], None, "_n")
    quota = F.coalesce(F.create_map(*[x for name, n in quotas.items() for x in (F.lit(name), F.lit(n))])[F.col(group)], F.lit(0))
    order = [(F.col("_n") > quota).cast("int"), F.col("_old")]
    return ranked(numbered.withColumnRenamed("rank", "_old"), ["query_id"], order, limit).drop("_n", "_old")


def tie_bands(ranking: DataFrame, score: str, fused: str, width: float) -> DataFrame:
    """Neighbours whose scores differ by at most ``width`` chain into a band and are ordered by ``fused`` within it."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("item_id"))
    gap = F.lag(score).over(w) - F.col(score)
    banded = ranking.withColumn("_break", F.when(gap > width, 1).otherwise(0)).withColumn("band", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked(banded.drop("_break", "rank"), ["query_id"], [F.col("band"), F.col(fused).desc(), F.col("item_id")])

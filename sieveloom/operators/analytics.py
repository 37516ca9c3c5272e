"""Analysis of evaluation runs: recall over cases and entries, missing metrics, rubrics, ranks, routes, texts, versions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.operators.lexical import ranked
from sieveloom.operators.positions import linear_percentiles

#: Criteria of the rubric with their weights, and the best score of a criterion (fixed values).
RUBRIC = {"answer_correctness": 0.30, "evidence_grounding": 0.20, "coverage": 0.15, "citation_quality": 0.15, "specificity": 0.10, "hallucination_control": 0.10}
BEST = 4.0
MISS = 11


def recall_summary(cases: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per group: cases with expected entries, mean recall of a case, recall over all entries, and the share of cases complete within the first ``k``.

    ``cases`` has expected and retrieved (arrays); entries are compared as they are. Cases that expect nothing take no part.
    """
    nothing = F.array().cast("array<string>")
    wanted = cases.select(*by, F.array_distinct(F.coalesce("expected", nothing)).alias("_e"), F.coalesce("retrieved", nothing).alias("_r")).where(F.size("_e") > 0)
    counted = wanted.select(*by, F.size("_e").alias("_n"), F.size(F.array_intersect("_e", "_r")).alias("_found"), F.size(F.array_intersect("_e", F.slice("_r", 1, k))).alias("_early"))
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("_found") / F.col("_n")).alias("macro_recall"), (F.sum("_found") / F.sum("_n")).alias("micro_recall"), F.avg((F.col("_early") == F.col("_n")).cast("int")).alias(f"complete_{k}"))


def metric_means(long: DataFrame, cases: DataFrame, case: str, present_only: list[str]) -> DataFrame:
    """metric_name, values that count and their mean over all cases; a case without a metric counts as 0, but not for ``present_only``.

    ``long`` has the case, metric_name and metric_value; a missing row and a null value are the same.
    """
    total = cases.select(case).distinct().agg(F.count(F.lit(1)).alias("_cases"))
    sums = long.where("metric_value is not null").groupBy("metric_name").agg(F.sum("metric_value").alias("_sum"), F.countDistinct(case).alias("_present"))
    n = F.when(F.col("metric_name").isin(present_only), F.col("_present")).otherwise(F.col("_cases"))
    return sums.crossJoin(F.broadcast(total)).select("metric_name", n.alias("counted"), (F.col("_sum") / n).alias("mean"))


def rubric(abstained: Column) -> Column:
    """The weighted score of the rubric's criteria columns, 0 to 5; each within 0 to 4, null as 0, all 0 where the answer abstains."""
    total = F.lit(0.0)
    for name, weight in RUBRIC.items():
        total = total + F.least(F.lit(BEST), F.greatest(F.lit(0.0), F.coalesce(F.col(name).cast("double"), F.lit(0.0)))) / BEST * weight
    return F.when(F.coalesce(abstained, F.lit(False)), 0.0).otherwise(total / sum(RUBRIC.values()) * 5)


def correlations(scores: DataFrame, names: list[str]) -> DataFrame:
    """a, b and the correlation of every pair of columns over rows that have both; null without variance. One pass for all pairs."""
    pairs = list(combinations(names, 2))

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = scores.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("correlation")) for a, b in pairs)).alias("p"))
    return one.select(F.inline("p"))


def unjudgeable(error: Column, answer: Column) -> Column:
    """Why an answer cannot be judged: generation_error, empty_prediction, or null where it can."""
    return F.when(F.length(error) > 0, "generation_error").when(F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", "")) == 0, "empty_prediction")


def rank_distribution(ranks: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Per group: cases, precision at 1, 3, 5 and 10, misses, and the mean rank with a miss (null or beyond 10) as 11."""
    r = F.when(F.col(rank) <= MISS - 1, F.col(rank)).otherwise(MISS)
    within = [F.avg((r <= k).cast("int")).alias(f"within_{k}") for k in (1, 3, 5, 10)]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *within, F.count_if(r == MISS).alias("misses"), F.avg(r).alias("mean_rank"))


def ensemble_ranks(results: DataFrame, arm: str, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several arms' rankings (query_id, arm, path, rank); ties by the best rank, then path."""
    fused = results.groupBy("query_id", "path").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.count_distinct(arm).alias("arms"))
    return ranked(fused, ["query_id"], [F.round("score", 9).desc(), F.col("best_rank"), F.col("path")], limit)


def route_margins(margins: DataFrame, route: str, margin: str) -> DataFrame:
    """Per route: queries, their share, and the mean, median and 90th percentile of the margin of the first over the second result."""
    counted = margins.groupBy(route).agg(F.count(F.lit(1)).alias("queries"), F.avg(margin).alias("mean_margin"))
    total = margins.agg(F.count(F.lit(1)).alias("_n"))
    shares = counted.crossJoin(F.broadcast(total)).withColumn("share", F.col("queries") / F.col("_n")).drop("_n")
    return shares.join(linear_percentiles(margins, [route], margin, {"p50": 0.5, "p90": 0.9}), route)


def text_statistics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Words, distinct words and their share, mean length of a word, sentences and words per sentence; null texts count as empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    ends = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    sized = texts.select(key, words.alias("_w"), F.size(ends).alias("sentences")).withColumn("words", F.size("_w"))
    characters = F.length(F.array_join("_w", ""))
    return sized.select(
        key, "words", F.size(F.array_distinct("_w")).alias("distinct_words"), F.try_divide(F.size(F.array_distinct("_w")), F.col("words")).alias("distinct_share"), F.try_divide(characters, F.col("words")).alias("word_length"), "sentences", F.try_divide(F.col("words"), F.col("sentences")).alias("words_per_sentence")
    )


def version_comparison(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: items of both versions, of one only, for every field how many agree (nulls agree), and how many items differ at all."""
    a, b = (df.select(F.col(key), F.lit(True).alias("_in"), *(F.xxhash64(F.struct(f)).alias(f) for f in fields)) for df in (old, new))
    both = a.alias("a").join(b.alias("b"), key, "full")
    present = F.col("a._in").isNotNull() & F.col("b._in").isNotNull()
    same = {f: F.col(f"a.{f}") == F.col(f"b.{f}") for f in fields}
    differs = F.lit(False)
    for s in same.values():
        differs = differs | ~s
    return both.agg(
        F.count_if(present).alias("both"), F.count_if(F.col("b._in").isNull()).alias("old_only"), F.count_if(F.col("a._in").isNull()).alias("new_only"), *(F.count_if(present & s).alias(f"same_{f}") for f, s in same.items()), F.count_if(present & differs).alias("changed")
    )

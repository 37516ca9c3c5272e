"""Retrieval metrics per case and over runs, intervals, paired tests and agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import path_matches
from sieveloom.operators.positions import with_mean_rank

Z = 1.96


def _any_match(path: Column, expected: Column) -> Column:
    return F.exists(expected, lambda e: path_matches(path, e))


def case_metrics(cases: DataFrame, limit: int = 10) -> DataFrame:
    """Metrics of every case (case_id, expected, retrieved; the arrays in order, null as empty).

    Adds hit, reciprocal_rank, precision, recall over results; hit_1/3/5; and over the distinct files of the first
    ``limit`` results file_hit, file_rr, file_precision_at_r, file_recall, ndcg and average_precision. The last two
    give every expected entry to one file at most, the first that it matches.
    """
    nothing = F.array().cast("array<string>")
    base = cases.withColumn("expected", F.coalesce("expected", nothing)).withColumn("retrieved", F.coalesce("retrieved", nothing))
    base = base.withColumn("_matched", F.transform("retrieved", lambda p: _any_match(p, F.col("expected"))))
    base = base.withColumn("_files", F.array_distinct(F.slice("retrieved", 1, limit)))
    # For every file the numbers of the expected entries that it matches.
    base = base.withColumn("_entries", F.transform("_files", lambda p: F.filter(F.transform("expected", lambda e, i: F.when(path_matches(p, e), i)), lambda i: i.isNotNull())))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("dcg"), F.lit(0.0).alias("ap"))

    def step(s: Column, entries: Column) -> Column:
        free = F.array_except(entries, s["used"])
        won = F.size(free) > 0
        rank, hits = s["rank"] + 1, s["hits"] + won.cast("int")
        return F.struct(
            F.when(won, F.concat(s["used"], F.slice(free, 1, 1))).otherwise(s["used"]).alias("used"),
            rank.alias("rank"),
            hits.alias("hits"),
            (s["dcg"] + F.when(won, 1 / F.log2(rank + 1)).otherwise(0.0)).alias("dcg"),
            (s["ap"] + F.when(won, hits / rank).otherwise(0.0)).alias("ap"),
        )

    base = base.withColumn("_walk", F.aggregate("_entries", start, step))
    first = F.array_position("_matched", F.lit(True))
    file_first = F.array_position(F.transform("_entries", lambda e: F.size(e) > 0), F.lit(True))
    n_expected = F.greatest(F.size("expected"), F.lit(1))
    r = F.least(n_expected, F.lit(limit))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n_expected, F.lit(limit))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    matches = F.size(F.filter("_matched", lambda m: m))
    covered = F.size(F.array_distinct(F.flatten("_entries")))
    hit_at = lambda k: F.exists(F.slice("_matched", 1, k), lambda m: m)
    return base.select(
        *cases.columns,
        (first > 0).alias("hit"),
        F.when(first > 0, 1 / first).otherwise(0.0).alias("reciprocal_rank"),
        (matches / F.greatest(F.size("retrieved"), F.lit(1))).alias("precision"),
        F.least(matches / n_expected, F.lit(1.0)).alias("recall"),
        hit_at(1).alias("hit_1"),
        hit_at(3).alias("hit_3"),
        hit_at(5).alias("hit_5"),
        F.size("_files").alias("n_files"),
        (file_first > 0).alias("file_hit"),
        F.when(file_first > 0, 1 / file_first).otherwise(0.0).alias("file_rr"),
        (F.size(F.filter(F.slice("_entries", F.lit(1), r), lambda e: F.size(e) > 0)) / r).alias("file_precision_at_r"),
        F.least(covered / n_expected, F.lit(1.0)).alias("file_recall"),
        F.when(F.size("expected") > 0, F.col("_walk.dcg") / ideal).otherwise(0.0).alias("ndcg"),
        (F.col("_walk.ap") / n_expected).alias("average_precision"),
    )


def interval(name: str, value: Column, binary: bool, unit: bool = True) -> list[Column]:
    """Mean, standard error and 95 % interval of a metric: Wilson for yes/no, else normal, clamped to 0..1 if a rate."""
    n, mean = F.count(value), F.avg(value.cast("double"))
    error = F.sqrt(F.coalesce(F.var_samp(value.cast("double")), F.lit(0.0)) / n)
    if binary:
        center = (mean + Z * Z / (2 * n)) / (1 + Z * Z / n)
        radius = Z * F.sqrt((mean * (1 - mean) + Z * Z / (4 * n)) / n) / (1 + Z * Z / n)
        low, high = F.greatest(F.lit(0.0), center - radius), F.least(F.lit(1.0), center + radius)
    else:
        low, high = mean - Z * error, mean + Z * error
        if unit:
            low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return [mean.alias(name), error.alias(f"{name}_stderr"), low.alias(f"{name}_low"), high.alias(f"{name}_high")]


def run_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means and intervals of case metrics for every run, bucket or other group."""
    columns = [*interval("hit_rate", F.col("hit").cast("int"), True), *interval("hit_rate_1", F.col("hit_1").cast("int"), True)]
    for name in ("reciprocal_rank", "precision", "recall", "file_recall", "ndcg", "average_precision"):
        columns += interval(name, F.col(name), False)
    bundle = [F.avg((condition).cast("int")).alias(name) for name, condition in (("complete", F.col("file_recall") >= 1), ("partial", (F.col("file_recall") > 0) & (F.col("file_recall") < 1)), ("nothing", F.col("file_recall") <= 0))]
    headroom = (F.avg(F.col("hit_5").cast("int")) - F.avg(F.col("hit_1").cast("int"))).alias("headroom_5")
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *columns, *bundle, headroom)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact probability that a fair coin is at least as uneven; 1 without decided pairs."""
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))
    walked = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")),
        start,
        lambda s, i: F.struct((s["term"] + F.log((n - i + 1) / i)).alias("term"), (s["total"] + F.exp(s["term"] + F.log((n - i + 1) / i))).alias("total")),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * walked["total"]))


def paired(left: DataFrame, right: DataFrame, key: str, metric: str) -> DataFrame:
    """Two runs over the same cases: pairs, cases of one run only, wins, losses, ties, mean difference, its interval, sign test."""
    both = left.select(key, F.col(metric).cast("double").alias("a")).join(right.select(key, F.col(metric).cast("double").alias("b")), key, "full")
    both = both.withColumn("d", F.col("b") - F.col("a"))
    counts = both.agg(
        F.count("d").alias("pairs"),
        F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
        F.count_if(F.col("d") == 0).alias("ties"),
        F.avg("d").alias("mean_difference"),
        (Z * F.sqrt(F.coalesce(F.var_samp("d"), F.lit(0.0)) / F.count("d"))).alias("_radius"),
    )
    return counts.select(
        "pairs", "left_only", "right_only", "wins", "losses", "ties", "mean_difference", (F.col("mean_difference") - F.col("_radius")).alias("low"), (F.col("mean_difference") + F.col("_radius")).alias("high"), sign_test(F.col("wins"), F.col("losses")).alias("p_value")
    )


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson, Spearman (ties share their mean rank), mean absolute difference, bias, exact and within-one agreement.

    The correlations are null below three pairs and without variance.
    """
    whole = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    ranks = with_mean_rank(with_mean_rank(whole, by, a, "_ra"), by, b, "_rb")
    d = F.col(a) - F.col(b)
    corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    enough = F.count(F.lit(1)) >= 3
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, corr(a, b)).alias("pearson"),
        F.when(enough, corr("_ra", "_rb")).alias("spearman"),
        F.avg(F.abs(d)).alias("mad"),
        F.avg(d).alias("bias"),
        F.avg((d == 0).cast("int")).alias("exact"),
        F.avg((F.abs(d) <= 1).cast("int")).alias("within_one"),
    )


def ngrams(tokens: Column, size: int) -> Column:
    n = F.size(tokens) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(F.array().cast("array<string>"))


def overlap(df: DataFrame, key: str, predicted: Column, reference: Column) -> DataFrame:
    """Precision, recall and F1 of two bags of tokens per row, by joined counts; 0 where one is empty."""
    bags = df.select(key, predicted.alias("_p"), reference.alias("_r")).select(key, "_p", "_r", F.size("_p").alias("n_predicted"), F.size("_r").alias("n_reference"))
    count = lambda c, name: bags.select(key, F.explode(c).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias(name))
    shared = count("_p", "a").join(count("_r", "b"), [key, "token"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))
    joined = bags.select(key, "n_predicted", "n_reference").join(shared, key, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    precision, recall = F.col("shared") / F.greatest("n_predicted", F.lit(1)), F.col("shared") / F.greatest("n_reference", F.lit(1))
    return joined.select(key, "n_predicted", "n_reference", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def pivot_counts(df: DataFrame, rows: str, columns: str, values: list[str], other: str = "other") -> DataFrame:
    """A confusion matrix with the given column values; ``other`` counts null and all further values, so no row is lost."""
    known = F.coalesce(F.col(columns).isin(values), F.lit(False))
    return df.groupBy(rows).agg(*(F.count_if(F.col(columns) == v).alias(v) for v in values), F.count_if(~known).alias(other))


def funnel(df: DataFrame, stages: list[str]) -> DataFrame:
    """How many cases reach each stage and are lost after it; ``stages`` are boolean columns in order."""
    alive = [reduce(lambda a, b: a & b, (F.coalesce(F.col(s), F.lit(False)) for s in stages[: i + 1])) for i in range(len(stages))]
    one = df.agg(F.count(F.lit(1)).alias("cases"), *(F.count_if(a).alias(s) for a, s in zip(alive, stages, strict=True)))
    return one.unpivot(["cases"], stages, "stage", "reached").withColumn("share", F.col("reached") / F.greatest("cases", F.lit(1)))

"""Collections over time and choices over cases: differences, composition, lint, sampling, gates, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.operators.lexical import ranked
from sieveloom.operators.positions import numbered


def difference(old: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """``key`` and status (added, deleted, changed, same) of two versions of a collection."""
    a = old.select(key, F.xxhash64(content).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(key, F.xxhash64(content).alias("_b"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def composition(files: DataFrame, kind: str) -> DataFrame:
    """Items, distinct paths and bytes by kind, and over all (kind null, is_total true)."""
    rolled = files.rollup(kind).agg(F.grouping(kind).alias("_g"), F.count(F.lit(1)).alias("items"), F.countDistinct("path").alias("paths"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return rolled.select(kind, (F.col("_g") == 1).alias("is_total"), "items", "paths", "bytes")


def lint(cases: DataFrame) -> DataFrame:
    """record_id and fault of evaluation records: no id, no query, no expected entry, an id or a query used by several."""
    faults = F.array(
        F.when(F.col("id").isNull() | (F.col("id") == ""), "no id"),
        F.when(F.col("query").isNull() | (F.trim("query") == ""), "no query"),
        F.when(F.size("expected") < 1, "nothing expected"),
    )
    found = cases.select("record_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))
    for c in ("id", "query"):
        repeated = cases.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        found = found.unionByName(cases.where(F.col(c).isNotNull()).join(repeated, c, "left_semi").select("record_id", F.lit(f"{c} used again").alias("fault")))
    return found


def expected_of_repeats(cases: DataFrame) -> DataFrame:
    """record_id and all distinct entries that records with the same query (case and space aside) expect, sorted."""
    keyed = cases.withColumn("_key", F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))))
    united = keyed.where("_key is not null").select("_key", F.explode("expected").alias("entry")).distinct().groupBy("_key").agg(F.sort_array(F.collect_set("entry")).alias("all_expected"))
    return keyed.join(united, "_key").select("record_id", "all_expected")


def stratified(df: DataFrame, key: str, score: str, flag: Column, per_stratum: int, seed: str) -> DataFrame:
    """A sample of ``per_stratum`` rows from every tercile of score crossed with a flag, drawn by a hash of seed and key."""
    placed = numbered(df.where(F.col(score).isNotNull()), [], [F.col(score), F.col(key)])
    strata = placed.withColumn("tercile", F.floor((F.col("position") - 1) * 3 / F.col("group_size")).cast("int")).withColumn("flag", flag)
    draw = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)
    return ranked(strata.withColumn("_draw", draw), ["tercile", "flag"], [F.col("_draw"), F.col(key)], per_stratum, "drawn").drop("_draw", "position", "group_size")


def gate_sweep(cases: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """For every gate: how often it takes the second ranking, and the mean reciprocal rank and hit rate of its choices.

    ``cases`` has base_rr and other_rr (reciprocal ranks of two rankings); a gate is a condition on other columns.
    All gates are computed in one pass.
    """
    sums = []
    for name, gate in gates.items():
        taken = F.coalesce(gate, F.lit(False))
        value = F.when(taken, F.col("other_rr")).otherwise(F.col("base_rr"))
        sums.append(F.struct(F.lit(name).alias("gate"), F.avg(taken.cast("int")).alias("taken"), F.avg(value).alias("mrr"), F.avg((value >= 1).cast("int")).alias("hit_1")))
    oracle = F.greatest("base_rr", "other_rr")
    sums.append(F.struct(F.lit("oracle").alias("gate"), F.avg((F.col("other_rr") > F.col("base_rr")).cast("int")).alias("taken"), F.avg(oracle).alias("mrr"), F.avg((oracle >= 1).cast("int")).alias("hit_1")))
    return cases.agg(F.array(*sums).alias("g")).select(F.inline("g"))


def quota_budget(ranking: DataFrame, channels: dict[str, int], budget: int) -> DataFrame:
    """The best of every channel in turn that no earlier channel took, then others by rank, ``budget`` in all, by rank.

    A channel is a signal column; only values above 0 are eligible.
    """
    if sum(channels.values()) > budget:
        raise ValueError("quotas exceed the budget")
    marked = ranking.withColumn("_taken", F.lit(False))
    for channel, quota in channels.items():
        eligible = (F.col(channel) > 0) & ~F.col("_taken")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(eligible.desc(), F.col(channel).desc(), F.col("rank")))
        marked = marked.withColumn("_place", place).withColumn("_taken", F.col("_taken") | (eligible & (F.col("_place") <= quota))).drop("_place")
    chosen = ranked(marked.withColumnRenamed("rank", "_old"), ["query_id"], [F.col("_taken").desc(), F.col("_old")], budget, "_n")
    return ranked(chosen, ["query_id"], [F.col("_old")]).drop("_taken", "_n", "_old")


def gained_and_lost(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only the second or only the first run has."""
    gained = b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("gained"))
    lost = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("lost"))
    return gained.unionByName(lost)


def known_path_tokens(probes: DataFrame, files: DataFrame) -> DataFrame:
    """Probe texts without the tokens that look like paths but name neither a file nor a directory."""
    split = probes.select("query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("position", "token"))
    parts = files.select(F.split("path", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("token")).distinct()
    known = split.join(parts.withColumn("_known", F.lit(True)), "token", "left")
    kept = known.where(F.col("_known").isNotNull() | ~F.contains("token", F.lit("/")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x["token"]), " ").alias("query"))


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Whether a wanted range of lines overlaps one of the first ``limit`` ranges found: greatest start up to least end."""
    within = b.where(F.col("rank") <= limit).select(*keys, F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    overlap = (F.greatest("start_line", "_s") <= F.least("end_line", "_e")).cast("int")
    return a.join(within, keys, "left").groupBy(*keys, "start_line", "end_line").agg((F.coalesce(F.max(overlap), F.lit(0)) > 0).alias("found"))


def long_metrics(metrics: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row per metric: the ids, metric_name, metric_value; missing values are left out."""
    return metrics.select(*ids, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(ids, names, "metric_name", "metric_value").where("metric_value is not null")


def retained(df: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the latest one."""
    latest = df.agg(F.max(time).alias("_latest"))
    return df.crossJoin(F.broadcast(latest)).where(F.col(time) > F.col("_latest") - F.make_dt_interval(F.lit(days))).drop("_latest")

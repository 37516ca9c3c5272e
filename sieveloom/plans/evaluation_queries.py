"""Queries on retrieval metrics, intervals, paired tests and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import evaluate, positions
from sieveloom.plans.registry import register, rounded
from sieveloom.plans.runtime import spread
from sieveloom.sources.tables import table


def cases(spark: SparkSession, d: str) -> DataFrame:
    """One case per outcome: what its case expects and what was retrieved."""
    outcomes = table(spark, d, "answer_outcomes").select(F.col("outcome_id").alias("case_id"), F.col("case_id").alias("id"), F.col("retrieved_files").alias("retrieved"), "generation_model", "generation_duration_ms", "confidence")
    expected = table(spark, d, "answer_cases").select("id", "expected", "repository")
    return spread(outcomes).join(expected, "id").select("case_id", "id", "expected", "retrieved", "repository", "generation_model", "generation_duration_ms", "confidence")


# A glob as a regular expression, and whether a path is an expected entry.
GLOB = r"'(?s)^' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(trim(e), 6), '([.+^$(){{}}|\\])', '\\\1', 'g'), '\[!', '[^', 'g'), '\*', '.*', 'g'), '\?', '.', 'g') || '$'"
MATCH = "(case when trim(e) like 'glob:%' then regexp_matches(p, " + GLOB.replace("{{", "{").replace("}}", "}") + ") else p = trim(e) or starts_with(p, rtrim(trim(e), '/') || '/') end)"
CASES = f"""
    with recursive c as (
        select outcome_id as case_id, o.case_id as id, coalesce(expected, []) as expected, coalesce(retrieved_files, []) as retrieved, repository, generation_model, generation_duration_ms
        from answer_outcomes o join answer_cases a on o.case_id = a.id),
    n as (select case_id, greatest(len(expected), 1) as n, len(expected) as given, len(retrieved) as got from c),
    r as (select case_id, unnest(retrieved) as p, generate_subscripts(retrieved, 1) as rank from c),
    x as (select case_id, unnest(expected) as e, generate_subscripts(expected, 1) as i from c),
    m as (select r.case_id, rank, bool_or({MATCH}) as hit from r join x on r.case_id = x.case_id group by all),
    item as (select case_id, min(rank) filter (hit) as first, count(*) filter (hit) as matches, coalesce(bool_or(hit) filter (rank <= 1), false) as h1, coalesce(bool_or(hit) filter (rank <= 3), false) as h3,
        coalesce(bool_or(hit) filter (rank <= 5), false) as h5 from m group by all),
    f as (select case_id, p, row_number() over (partition by case_id order by min(rank)) as rank from r where rank <= 10 group by case_id, p),
    g as (select f.case_id, rank, list(i order by i) filter ({MATCH}) as entries from f join x on f.case_id = x.case_id group by all),
    file as (select case_id, min(rank) filter (entries is not null) as first, count(*) filter (entries is not null and rank <= least(n, 10)) as at_r from g join n using (case_id) group by all),
    cov as (select case_id, count(distinct e) as covered from (select case_id, unnest(entries) as e from g) group by all),
    walk as (
        select case_id, 0::bigint as rank, []::bigint[] as used, 0 as hits, 0.0::double as dcg, 0.0::double as ap from c
        union all
        select w.case_id, g.rank, case when len(free) > 0 then list_append(used, free[1]) else used end, hits + (len(free) > 0)::int, dcg + case when len(free) > 0 then 1 / log2(g.rank + 1) else 0 end,
            ap + case when len(free) > 0 then (hits + 1) / g.rank else 0 end
        from walk w join (select case_id, rank, coalesce(entries, []) as entries from g) g on g.case_id = w.case_id and g.rank = w.rank + 1,
            lateral (select list_filter(g.entries, lambda z: not list_contains(w.used, z)) as free)),
    ended as (select case_id, max_by(dcg, rank) as dcg, max_by(ap, rank) as ap from walk group by all),
    metrics as (
        select c.case_id, c.id, c.repository, c.generation_model, c.generation_duration_ms, coalesce(item.first, 0) > 0 as hit, coalesce(1 / item.first, 0) as reciprocal_rank, coalesce(matches, 0) / greatest(got, 1) as precision,
            least(coalesce(matches, 0) / n.n, 1.0) as recall, coalesce(h1, false) as hit_1, coalesce(h3, false) as hit_3, coalesce(h5, false) as hit_5, coalesce(file.first, 0) > 0 as file_hit, coalesce(1 / file.first, 0) as file_rr,
            coalesce(at_r, 0) / least(n.n, 10) as file_precision_at_r, least(coalesce(covered, 0) / n.n, 1.0) as file_recall,
            case when given > 0 then dcg / (select sum(1 / log2(k + 1)) from range(1, 1 + least(n.n, 10)) q(k)) else 0 end as ndcg, ap / n.n as average_precision
        from c join n using (case_id) left join item using (case_id) left join file using (case_id) left join cov using (case_id) left join ended using (case_id))
"""
METRICS = ["reciprocal_rank", "precision", "recall", "file_rr", "file_precision_at_r", "file_recall", "ndcg", "average_precision"]
FLAGS = ["hit", "hit_1", "hit_3", "hit_5", "file_hit"]


@register("case_metrics", CASES + f"select case_id, {', '.join(FLAGS)}, {', '.join(f'round({m}, 6) as {m}' for m in METRICS)} from metrics")
def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.case_metrics(cases(spark, d)).select("case_id", *FLAGS, *METRICS))


def _interval_sql(name: str, value: str, binary: bool) -> str:
    mean, n = f"avg({value})", f"count({value})"
    error = f"sqrt(coalesce(var_samp({value}), 0) / {n})"
    if binary:
        center = f"(({mean} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))"
        radius = f"(1.96 * sqrt(({mean} * (1 - {mean}) + 3.8416 / (4 * {n})) / {n}) / (1 + 3.8416 / {n}))"
        low, high = f"greatest(0.0, {center} - {radius})", f"least(1.0, {center} + {radius})"
    else:
        low, high = f"greatest(0.0, {mean} - 1.96 * {error})", f"least(1.0, {mean} + 1.96 * {error})"
    return f"round({mean}, 6) as {name}, round({error}, 6) as {name}_stderr, round({low}, 6) as {name}_low, round({high}, 6) as {name}_high"


SUMMARY = ", ".join(
    [_interval_sql("hit_rate", "hit::int", True), _interval_sql("hit_rate_1", "hit_1::int", True)]
    + [_interval_sql(m, m, False) for m in ("reciprocal_rank", "precision", "recall", "file_recall", "ndcg", "average_precision")]
    + ["round(avg((file_recall >= 1)::int), 6) as complete, round(avg((file_recall > 0 and file_recall < 1)::int), 6) as partial, round(avg((file_recall <= 0)::int), 6) as nothing, round(avg(hit_5::int) - avg(hit_1::int), 6) as headroom_5"]
)


@register("run_summary", CASES + f"select generation_model, count(*) as cases, {SUMMARY} from metrics group by generation_model")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.run_summary(evaluate.case_metrics(cases(spark, d)), ["generation_model"]))


@register("bucket_summary", CASES + f"select repository, count(*) as cases, {SUMMARY} from metrics group by repository")
def bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.run_summary(evaluate.case_metrics(cases(spark, d)), ["repository"]))


ARMS = "(select id, avg({0}) as v from metrics where generation_model = (select {1}(generation_model) from answer_outcomes) group by id)"


@register(
    "paired_compare",
    CASES
    + f"""
    , j as (select a.v as a, b.v as b, b.v - a.v as d from {ARMS.format("reciprocal_rank", "min")} a full join {ARMS.format("reciprocal_rank", "max")} b using (id)),
    s as (select count(d) as pairs, count(*) filter (b is null) as left_only, count(*) filter (a is null) as right_only, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses,
        count(*) filter (d = 0) as ties, avg(d) as m, 1.96 * sqrt(coalesce(var_samp(d), 0) / count(d)) as radius from j)
    select pairs, left_only, right_only, wins, losses, ties, round(m, 6) as mean_difference, round(m - radius, 6) as low, round(m + radius, 6) as high,
        round(case when wins + losses = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2.0))) from range(0, 1 + least(wins, losses)) q(k))) end, 6) as p_value
    from s""",
)
def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two models over the same cases by mean reciprocal rank."""
    per_case = evaluate.case_metrics(cases(spark, d)).groupBy("id", "generation_model").agg(F.avg("reciprocal_rank").alias("v"))
    ends = table(spark, d, "answer_outcomes").agg(F.min("generation_model").alias("low"), F.max("generation_model").alias("high"))
    arm = lambda side: per_case.join(F.broadcast(ends), F.col("generation_model") == F.col(side)).select("id", "v")
    return rounded(evaluate.paired(arm("low"), arm("high"), "id", "v"))


@register(
    "percentile_nearest",
    "with s as (select generation_model, list_sort(list(generation_duration_ms)) as v from answer_outcomes where generation_duration_ms is not null group by all) "
    "select generation_model, p::double as p, v[(round_even((len(v) - 1) * p, 0))::int + 1] as value from s, (values (0.5), (0.95)) q(p)",
)
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return positions.nearest_percentiles(table(spark, d, "answer_outcomes"), ["generation_model"], "generation_duration_ms", [0.5, 0.95])


@register(
    "percentile_linear",
    "select generation_model, round(quantile_cont(generation_duration_ms, 0.9), 6) as p90, round(quantile_cont(generation_duration_ms, 0.5), 6) as p50 from answer_outcomes group by all",
)
def percentile_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(positions.linear_percentiles(table(spark, d, "answer_outcomes"), ["generation_model"], "generation_duration_ms", {"p90": 0.9, "p50": 0.5}))


AGREEMENT = """
    with v as (select generation_model, round(confidence * 5) as a, round(5 * generation_duration_ms / 60000) % 5 as b from answer_outcomes where confidence is not null and generation_duration_ms is not null),
    r as (select *, rank() over (partition by generation_model order by a) + (count(*) over (partition by generation_model, a) - 1) / 2 as ra,
        rank() over (partition by generation_model order by b) + (count(*) over (partition by generation_model, b) - 1) / 2 as rb from v)
    select generation_model, count(*) as n, case when count(*) >= 3 and var_pop(a) > 0 and var_pop(b) > 0 then round(corr(a, b), 6) end as pearson, case when count(*) >= 3 and var_pop(a) > 0 and var_pop(b) > 0 then round(corr(ra, rb), 6) end as spearman, round(avg(abs(a - b)), 6) as mad,
        round(avg(a - b), 6) as bias, round(avg((a = b)::int), 6) as exact, round(avg((abs(a - b) <= 1)::int), 6) as within_one from r group by all
"""


@register("judge_agreement", AGREEMENT)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two ratings of the same answers: correlations, differences and agreement by model."""
    rated = table(spark, d, "answer_outcomes").where("confidence is not null and generation_duration_ms is not null")
    rated = rated.select("generation_model", F.round(F.col("confidence") * 5).alias("a"), (F.round(5 * F.col("generation_duration_ms") / 60000) % 5).alias("b"))
    return rounded(evaluate.agreement(rated, "a", "b", ["generation_model"]))


STEMS = "list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z_][a-z0-9_]*|[0-9]+'), lambda w: case when length(w) > 4 and w like '%ies' then w[:-4] || 'y' when length(w) > 4 and w like '%es' then w[:-3] when length(w) > 3 and w like '%s' then w[:-2] else w end)"


def _overlap_sql(size: int) -> str:
    bag = "{0}" if size == 1 else "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    p, r = STEMS.format("o.answer"), STEMS.format("a.answer")
    return f"""
    with t as (select outcome_id, {p} as p0, {r} as r0 from answer_outcomes o join answer_cases a on o.case_id = a.id),
    b as (select outcome_id, {bag.format("p0")} as p, {bag.format("r0")} as r from t),
    pc as (select outcome_id, token, count(*) as a from (select outcome_id, unnest(p) as token from b) group by all),
    rc as (select outcome_id, token, count(*) as b from (select outcome_id, unnest(r) as token from b) group by all),
    s as (select outcome_id, sum(least(a, b)) as shared from pc join rc using (outcome_id, token) group by all),
    v as (select outcome_id, len(p) as n_predicted, len(r) as n_reference, coalesce(shared, 0) / greatest(len(p), 1) as precision, coalesce(shared, 0) / greatest(len(r), 1) as recall from b left join s using (outcome_id))
    select outcome_id, n_predicted, n_reference, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from v"""


def _overlap(spark: SparkSession, d: str, size: int) -> DataFrame:
    outcomes = table(spark, d, "answer_outcomes").select("outcome_id", F.col("case_id").alias("id"), F.col("answer").alias("predicted"))
    pairs = spread(outcomes.join(table(spark, d, "answer_cases").select("id", "answer"), "id"))
    tokens = pairs.select("outcome_id", t.stem_tokens(F.coalesce("predicted", F.lit(""))).alias("p"), t.stem_tokens(F.coalesce("answer", F.lit(""))).alias("r"))
    bag = (lambda c: F.col(c)) if size == 1 else (lambda c: evaluate.ngrams(F.col(c), size))
    return rounded(evaluate.overlap(tokens, "outcome_id", bag("p"), bag("r")))


@register("token_overlap", _overlap_sql(1))
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, 1)


@register("bigram_overlap", _overlap_sql(2))
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, 2)


@register(
    "confusion_matrix",
    "select split, count(*) filter (source = 'handwritten') as handwritten, count(*) filter (source = 'issue_mined') as issue_mined, count(*) filter (source = 'log_mined') as log_mined, "
    "count(*) filter (source = 'synthetic_where') as synthetic_where, count(*) filter (source = 'translated') as translated, "
    "count(*) filter (source is null or source not in ('handwritten', 'issue_mined', 'log_mined', 'synthetic_where', 'translated')) as other from eval_cases group by split",
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cases by split and source."""
    return evaluate.pivot_counts(table(spark, d, "eval_cases"), "split", "source", ["handwritten", "issue_mined", "log_mined", "synthetic_where", "translated"])


@register(
    "stage_funnel",
    CASES
    + """
    , k as (select count(*) as cases, count(*) filter (true) as retrieved, count(*) filter (hit) as hit, count(*) filter (hit and hit_5) as hit_5, count(*) filter (hit and hit_5 and hit_1) as hit_1 from metrics)
    select cases, stage, reached, round(reached / greatest(cases, 1), 6) as share from k unpivot (reached for stage in (hit, hit_5, hit_1)) u
    """.replace("count(*) filter (true) as retrieved, ", ""),
)
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Where relevant files get lost between retrieval and the top of the list."""
    return rounded(evaluate.funnel(evaluate.case_metrics(cases(spark, d)), ["hit", "hit_5", "hit_1"]))

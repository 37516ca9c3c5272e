"""Queries that analyse evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.operators import analytics as ops
from sieveloom.operators import evaluate, routing
from sieveloom.operators.fusion import path_ranks
from sieveloom.plans.evaluation_queries import CASES, cases
from sieveloom.plans.hybrid_queries import _PROSE
from sieveloom.plans.lexical_queries import ASKED, items
from sieveloom.plans.ranking_queries import CANDIDATES, PATHS, RUNS, ranking, runs
from sieveloom.plans.registry import register, rounded
from sieveloom.sources.tables import table


@register(
    "recall_summary",
    """
    with c as (select generation_model, list_distinct(coalesce(expected, [])) as e, coalesce(retrieved_files, []) as r from answer_outcomes o join answer_cases a on o.case_id = a.id),
    n as (select generation_model, len(e) as n, len(list_intersect(e, r)) as found, len(list_intersect(e, r[1:5])) as early from c where len(e) > 0)
    select generation_model, count(*) as cases, round(avg(found / n), 6) as macro_recall, round(sum(found) / sum(n), 6) as micro_recall, round(avg((early = n)::int), 6) as complete_5 from n group by generation_model""",
)
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.recall_summary(cases(spark, d), ["generation_model"], 5))


@register(
    "metric_means",
    CASES
    + """, mx as (select case_id, 'recall' as metric_name, recall as v from metrics where hit union all select metrics.case_id, 'judge_confidence', confidence from metrics join answer_outcomes on outcome_id = metrics.case_id where confidence is not null union all select case_id, 'ndcg', ndcg from metrics where file_hit)
    select metric_name, case when metric_name = 'judge_confidence' then count(distinct case_id) else (select count(*) from metrics) end as counted, round(sum(v) / case when metric_name = 'judge_confidence' then count(distinct case_id) else (select count(*) from metrics) end, 6) as mean from mx group by metric_name""",
)
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Recall and nDCG, which cases without a hit lack, as 0 there; the confidence over those that have one."""
    metrics = evaluate.case_metrics(cases(spark, d))
    present = metrics.select("case_id", F.when(F.col("hit"), F.col("recall")).alias("recall"), F.when(F.col("file_hit"), F.col("ndcg")).alias("ndcg"), F.col("confidence").alias("judge_confidence"))
    long = present.unpivot(["case_id"], ["recall", "ndcg", "judge_confidence"], "metric_name", "metric_value")
    return rounded(ops.metric_means(long, metrics, "case_id", ["judge_confidence"]))


#: What the metrics of a case give for the criteria of the rubric.
_CRITERIA = {"answer_correctness": "reciprocal_rank", "evidence_grounding": "precision", "coverage": "file_recall", "citation_quality": "file_precision_at_r", "specificity": "ndcg", "hallucination_control": "average_precision"}


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    metrics = evaluate.case_metrics(cases(spark, d))
    scored = metrics.select("case_id", *((F.col(m) * ops.BEST).alias(c) for c, m in _CRITERIA.items()))
    answers = table(spark, d, "answer_outcomes").select(F.col("outcome_id").alias("case_id"), "answer", "parse_error")
    return scored.join(answers, "case_id")


@register(
    "rubric_scores",
    CASES + f"select case_id, round(case when answer is null then 0 else 5 * ({' + '.join(f'{w} * {_CRITERIA[c]}' for c, w in ops.RUBRIC.items())}) end + 1e-10, 6)::double as overall from (select metrics.*, o.answer from metrics join answer_outcomes o on o.outcome_id = metrics.case_id)",
)
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rubric over criteria measured on what a case retrieved; answers that are null abstain."""
    return rounded(_criteria(spark, d).select("case_id", (ops.rubric(F.col("answer").isNull()) + 1e-10).alias("overall")))


@register(
    "criteria_correlations",
    CASES + " " + " union all ".join(f"select '{a}' as a, '{b}' as b, (select round(corr({_CRITERIA[a]}, {_CRITERIA[b]}), 6) from metrics) as correlation" for i, a in enumerate(_CRITERIA) for b in list(_CRITERIA)[i + 1 :]),
)
def criteria_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.correlations(_criteria(spark, d), list(_CRITERIA)))


@register(
    "unjudgeable_rows",
    r"select generation_model, case when length(parse_error) > 0 then 'generation_error' when regexp_replace(coalesce(answer, ''), '\s+', '', 'g') = '' then 'empty_prediction' end as reason, count(*) as rows from answer_outcomes group by all",
)
def unjudgeable_rows(spark: SparkSession, d: str) -> DataFrame:
    reason = ops.unjudgeable(F.col("parse_error"), F.col("answer")).alias("reason")
    return table(spark, d, "answer_outcomes").groupBy("generation_model", reason).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "rank_distribution",
    CASES
    + ", rr as (select generation_model, case when reciprocal_rank > 0 and round(1 / reciprocal_rank) <= 10 then round(1 / reciprocal_rank) else 11 end as r from metrics) select generation_model, count(*) as cases, "
    + ", ".join(f"round(avg((r <= {k})::int), 6) as within_{k}" for k in (1, 3, 5, 10))
    + ", count(*) filter (r = 11) as misses, round(avg(r), 6) as mean_rank from rr group by generation_model",
)
def rank_distribution(spark: SparkSession, d: str) -> DataFrame:
    metrics = evaluate.case_metrics(cases(spark, d))
    return rounded(ops.rank_distribution(metrics.withColumn("r", F.when(F.col("reciprocal_rank") > 0, F.round(1 / F.col("reciprocal_rank")))), ["generation_model"], "r"))


@register(
    "ensemble_rrf",
    RUNS
    + PATHS
    + ", s as (select query_id, path, sum(1 / (60 + rank)) as score, min(rank) as best_rank, count(distinct variant) as arms from p group by all), r as (select query_id, path, round(score, 6) as score, best_rank, arms, row_number() over (partition by query_id order by round(score, 9) desc, best_rank, path) as rank from s) select * from r where rank <= 10",
)
def ensemble_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The requests of a query text as arms of an ensemble."""
    return rounded(ops.ensemble_ranks(path_ranks(runs(spark, d), ["query_id", "variant"]), "variant", 10))


@register(
    "route_margins",
    "with " + ASKED.strip() + _PROSE.strip().removeprefix(",") + ", " + CANDIDATES.strip().removeprefix("with")
    + """, m as (select query_id, max(vector) filter (rank = 1) - max(vector) filter (rank = 2) as margin from ranking group by query_id having count(*) > 1),
    x as (select route, margin from m join (select distinct request_id, query from search_requests) r on r.request_id = m.query_id join asked using (query) join routes on routes.query_id = asked.query_id)
    select route, count(*) as queries, round(count(*) / sum(count(*)) over (), 6) as share, round(avg(margin), 6) as mean_margin, round(quantile_cont(margin, 0.5), 6) as p50, round(quantile_cont(margin, 0.9), 6) as p90 from x group by route""",
)
def route_margins(spark: SparkSession, d: str) -> DataFrame:
    """How far the first hit of a request leads, by the route of its query."""
    firsts = ranking(spark, d).where("rank <= 2").groupBy("query_id").agg((F.max("vector") - F.min("vector")).alias("margin"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    asked = table(spark, d, "search_requests").where("query is not null").select(F.col("request_id").alias("query_id"), routing.route(F.col("query")).alias("route")).distinct()
    return rounded(ops.route_margins(firsts.join(asked, "query_id").select("route", "margin"), "route", "margin"))


@register(
    "text_statistics",
    r"""
    with t as (select outcome_id, list_filter(string_split_regex(lower(coalesce(answer, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, len(list_filter(string_split_regex(coalesce(answer, ''), '[.!?]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) as sentences from answer_outcomes)
    select outcome_id, len(w) as words, len(list_distinct(w)) as distinct_words, round(len(list_distinct(w)) / nullif(len(w), 0), 6) as distinct_share, round(length(array_to_string(w, '')) / nullif(len(w), 0), 6) as word_length, sentences, round(len(w) / nullif(sentences, 0), 6) as words_per_sentence from t""",
)
def text_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.text_statistics(table(spark, d, "answer_outcomes"), "outcome_id", "answer"))


@register(
    "catalog_compare",
    """
    with a as (select * from code_items where item_id % 7 <> 0), b as (select * replace (case when item_id % 5 = 0 then coalesce(content, '') || ' ' else content end as content, case when item_id % 3 = 0 then upper(title) else title end as title) from code_items where item_id % 11 <> 0),
    j as (select a.item_id as x, b.item_id as y, a.title is not distinct from b.title as t, a.content is not distinct from b.content as c, a.path is not distinct from b.path as p from a full join b on a.item_id = b.item_id)
    select count(*) filter (x is not null and y is not null) as both, count(*) filter (y is null) as old_only, count(*) filter (x is null) as new_only, count(*) filter (x is not null and y is not null and p) as same_path, count(*) filter (x is not null and y is not null and t) as same_title,
        count(*) filter (x is not null and y is not null and c) as same_content, count(*) filter (x is not null and y is not null and not (p and t and c)) as changed from j""",
)
def catalog_compare(spark: SparkSession, d: str) -> DataFrame:
    """The files against a later version of themselves, field by field."""
    files = items(spark, d)
    later = files.where("item_id % 11 != 0").withColumn("content", F.when(F.col("item_id") % 5 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" "))).otherwise(F.col("content")))
    later = later.withColumn("title", F.when(F.col("item_id") % 3 == 0, F.upper("title")).otherwise(F.col("title")))
    return ops.version_comparison(files.where("item_id % 7 != 0"), later, "item_id", ["path", "title", "content"])

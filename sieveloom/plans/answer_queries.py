"""Queries on answers, documentation, admission, grids and learned ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import answers, evaluate, lexical, vectors
from sieveloom.operators.lexical import ranked
from sieveloom.plans.evaluation_queries import cases
from sieveloom.plans.lexical_queries import ASKED, TOKENS_B, items, requests
from sieveloom.plans.ranking_queries import CANDIDATES, RUNS, candidates, ranking, runs
from sieveloom.plans.registry import register, rounded
from sieveloom.sources.tables import table


@register(
    "answer_grounding",
    r"""
    with b as (select o.*, a.expected, trim(regexp_replace(trim(raw_prediction), '^```\w*\s*|\s*```$', '', 'g')) as body from answer_outcomes o left join answer_cases a on o.case_id = a.id),
    k as (select *, case when json_valid(body) then body else regexp_replace(body, '\s*\}$', '') end as object from b),
    c as (select generation_model, retrieved_files, expected, case when object like '{%' and json_valid(object) then list_distinct(list_filter(coalesce(json_extract_string(object, '$.citations[*].path'), []), lambda p: p is not null)) end as cited from k)
    select generation_model, count(*) as answers, count(cited) as parsed, coalesce(sum(len(cited)), 0) as citations, round(sum(len(list_intersect(cited, coalesce(retrieved_files, [])))) / sum(len(cited)), 6) as retrieved_share,
        round(sum(len(list_intersect(cited, coalesce(expected, [])))) / sum(len(cited)), 6) as expected_share from c group by all""",
)
def answer_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How many citations name retrieved and expected files, by model."""
    outcomes = table(spark, d, "answer_outcomes").join(table(spark, d, "answer_cases").select(F.col("id").alias("case_id"), "expected"), "case_id", "left")
    return rounded(answers.grounding(outcomes, "generation_model"))


@register(
    "pairwise_models",
    """
    with m as (select case_id, generation_model as arm, round(avg(confidence), 9) as v from answer_outcomes where confidence is not null and case_id is not null and generation_model is not null group by all)
    select a.arm as a, b.arm as b, count(*) filter (a.v > b.v) as a_wins, count(*) filter (a.v < b.v) as b_wins, count(*) filter (a.v = b.v) as ties,
        round(count(*) filter (a.v > b.v) / nullif(count(*) filter (a.v <> b.v), 0), 6) as a_win_rate from m a join m b on a.case_id = b.case_id and a.arm < b.arm group by all""",
)
def pairwise_models(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "answer_outcomes").where("case_id is not null and generation_model is not null")
    return rounded(answers.pairwise(outcomes, "case_id", "generation_model", "confidence"))


@register(
    "rounds_merged",
    RUNS
    + ", s as (select query_id, item_id, sum(score * pow(0.85, variant)) as score from runs group by all), r as (select query_id, item_id, round(score + 1e-10, 6) as score, row_number() over (partition by query_id order by round(score + 1e-10, 8) desc, item_id) as rank from s) select * from r where rank <= 10",
)
def rounds_merged(spark: SparkSession, d: str) -> DataFrame:
    """The lists of all requests of a query text."""
    merged = answers.rounds_merged(runs(spark, d).withColumn("round", F.col("variant")))
    # Sums that end in exactly half a unit must not be rounded by the order of adding up.
    return rounded(merged.withColumn("score", F.col("score") + 1e-10))


@register(
    "weight_grid",
    CANDIDATES
    + """, g as (select i / 4.0 as w_vector, j / 4.0 as w_lexical, (4 - i - j) / 4.0 as w_symbol from range(0, 5) a(i), range(0, 5) b(j) where i + j <= 4),
    s as (select *, row_number() over (partition by query_id, w_vector, w_lexical, w_symbol order by round(vector * w_vector + lexical * w_lexical + symbol * w_symbol, 9) desc, item_id) as n from c, g)
    select w_vector::double as w_vector, w_lexical::double as w_lexical, w_symbol::double as w_symbol, round(avg(vector), 6) as mean_target from s where n = 1 group by all""",
)
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of the first hit under every weighting of three signals."""
    return rounded(answers.weight_grid(candidates(spark, d), ["vector", "lexical", "symbol"], 4, "vector"))


@register("embedding_texts", "select item_id, 'title: ' || coalesce(title, path) || ' | path: ' || path || ' | text: ' || coalesce(content, '') as text from code_items")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item_id", answers.embedding_text(F.col("title"), F.col("path"), F.col("content")).alias("text"))


@register("breadcrumbs", "select item_id, concat_ws(' > ', replace(path, '/', ' > '), title) || chr(10) || coalesce(content, '') as text from code_items")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("item_id", answers.breadcrumb(F.col("path"), F.col("title"), F.col("content")).alias("text"))


@register(
    "document_outlines",
    r"""
    with b as (select doc_id, text, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?s)```.*?(?:```|\z)', '', 'g') as body from documents where text is not null)
    select doc_id, regexp_extract_all(body, '(?m)^#{1,6} +([^\n]+)', 1)[1] as title, len(regexp_extract_all(body, '(?m)^#{1,6} +([^\n]+)', 1)) as headings, len(regexp_extract_all(body, '(?m)^(?:[-*]|\d+\.) +([^\n]+)', 1)) as list_items,
        len(string_split(text, '```')) - 1 as fences, len(list_distinct(regexp_extract_all(body, '((?:\w+/)+\w+\.\w+)', 1))) as paths from b""",
)
def document_outlines(spark: SparkSession, d: str) -> DataFrame:
    return answers.document_outline(table(spark, d, "documents"), "doc_id", "text")


@register("scope_preference", CANDIDATES + "select query_id, item_id, row_number() over (partition by query_id order by (kind = 'core')::int desc, rank) as rank from ranking")
def scope_preference(spark: SparkSession, d: str) -> DataFrame:
    return answers.prefer_scope(ranking(spark, d), F.col("kind") == "core").select("query_id", "item_id", "rank")


@register(
    "lexical_admission",
    f"""
    with {ASKED}
    posted as (select item_id, path, term, count(*) as tf, any_value(dl) as dl from (select item_id, path, len({TOKENS_B.format("content")}) as dl, unnest({TOKENS_B.format("content")}) as term from code_items) group by all),
    stats as (select count(*) as n, greatest(avg(coalesce(len({TOKENS_B.format("content")}), 0)), 1) as avgdl from code_items), df as (select term, count(*) as df from posted group by term),
    s as (select query_id, path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from terms join posted using (term) join df using (term), stats group by all),
    present as (select distinct asked.query_id, path from search_requests r join search_items i using (request_id) join asked using (query)),
    r as (select s.query_id, s.path, round(score, 6) as score, row_number() over (partition by s.query_id order by round(score, 6) desc, s.path) as rank from s where not exists (select 1 from present p where p.query_id = s.query_id and p.path = s.path))
    select * from r where rank <= 5""",
)
def lexical_admission(spark: SparkSession, d: str) -> DataFrame:
    """The best files by BM25 that no request of a query has found."""
    asked = requests(spark, d)
    files = items(spark, d)
    named = table(spark, d, "search_requests").where("query is not null").select("request_id", "query").distinct().join(asked.select("query", "query_id"), "query")
    present = table(spark, d, "search_items").select("request_id", "path").join(named, "request_id").select("query_id", "path").distinct()
    # However many of a query's best files are present, as many more are looked at.
    wanted = asked.join(present.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left").select("query_id", "terms", (F.coalesce("_n", F.lit(0)) + 5).alias("k"))
    scored = lexical.bm25_top(files, "item_id", t.word_tokens(F.col("content")), wanted, 60, by="path")
    return rounded(answers.admitted(scored.select("query_id", "path", "score"), present, 5))


@register("kind_rates", CANDIDATES + ", f as (select kind, count(*) as queries from ranking where rank = 1 group by kind) select kind, queries, round(queries / sum(queries) over (), 6) as rate from f")
def kind_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(answers.kind_rates(ranking(spark, d), "kind"))


@register(
    "lane_path_dedup",
    CANDIDATES
    + """, f as (select *, row_number() over (partition by query_id, kind, path order by vector desc, item_id) as o from c), l as (select query_id, item_id, kind, row_number() over (partition by query_id, kind order by vector desc, item_id) as lane_rank from f where o = 1)
    select query_id, item_id, kind, lane_rank from l where lane_rank <= case kind when 'src' then 4 when 'lib' then 2 else 1 end""",
)
def lane_path_dedup(spark: SparkSession, d: str) -> DataFrame:
    scored = candidates(spark, d).withColumnRenamed("vector", "score")
    return vectors.lanes(scored, {"src": 4, "lib": 2}, default=1, per_path=True).select("query_id", "item_id", "kind", "lane_rank")


@register(
    "model_usage",
    "select generation_model, count(*) as answers, round(sum(length(coalesce(raw_prediction, '')) / 4.0), 2) as tokens, round(sum(length(coalesce(raw_prediction, '')) / 4.0) * 0.002 / 1000, 6) as cost from answer_outcomes group by all",
)
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens (four characters each) and their cost by model."""
    tokens = F.sum(F.length(F.coalesce("raw_prediction", F.lit(""))) / 4.0)
    return table(spark, d, "answer_outcomes").groupBy("generation_model").agg(F.count(F.lit(1)).alias("answers"), F.round(tokens, 2).alias("tokens"), F.round(tokens * 0.002 / 1000, 6).alias("cost"))


@register("learned_ranking")
def learned_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees that predict a case's reciprocal rank, judged on held-out cases against their mean."""
    metrics = evaluate.case_metrics(cases(spark, d)).select("case_id", "reciprocal_rank", "n_files", "generation_duration_ms", "confidence", F.size("expected").alias("n_expected"))
    _, held_out = answers.boosted_trees(metrics, "case_id", ["n_files", "generation_duration_ms", "confidence", "n_expected"], "reciprocal_rank")
    mean = F.avg("_label")
    return held_out.agg(F.count(F.lit(1)).alias("cases"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("_label"), 2))).alias("rmse"), F.sqrt(F.var_pop("_label")).alias("rmse_of_mean"), mean.alias("mean"))


@register(
    "query_embedding_reuse",
    "with r as (select distinct request_id, query from search_requests where query is not null) select count(*) as requests, count(distinct query) as texts from r",
)
def query_embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """How many query texts have to be embedded for all requests: equal texts once."""
    asked = table(spark, d, "search_requests").where("query is not null").select("request_id", "query").distinct()
    return ranked(asked, ["query"], [F.col("request_id")], None, "n").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("n") == 1).alias("texts"))

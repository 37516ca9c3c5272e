"""Queries on items made of files, looking into files, collections over time, choices over cases, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import collections, evaluate
from sieveloom.operators import items as ops
from sieveloom.plans.evaluation_queries import CASES, cases
from sieveloom.plans.lexical_queries import items
from sieveloom.plans.ranking_queries import CANDIDATES, ranking
from sieveloom.plans.registry import register, rounded
from sieveloom.sources.tables import table
from sieveloom.streaming import monitor

LINES = r"string_split(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10))"
READ = "f as (select path, title, content, code_language, " + LINES + " as l from code_items where regexp_matches(content, '\\S') and strlen(content) <= 1000000 and not contains(content, chr(0)))"


@register(
    "line_chunks",
    f"""
    with {READ}, c as (select path, l, unnest(range(0, len(l), 20)) as s from f),
    k as (select path, len(l) as n, s + 1 as start_line, least(s + 20, len(l)) as end_line, array_to_string(l[s + 1:s + 20], chr(10)) as content from c)
    select path || '#' || substr(sha1(path || ':' || start_line || ':' || end_line), 1, 12) as id, path, case when n <= 20 then path else path || ':' || start_line || '-' || end_line end as title, content, start_line, end_line
    from k where regexp_matches(content, '\\S')""",
)
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunks(items(spark, d), 20)


@register("grep_lines", f"with {READ}, n as (select path, unnest(l) as text, generate_subscripts(l, 1) as line from f) select path, line, text from n where regexp_matches(text, 'return|raise')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return ops.grep(items(spark, d), "return|raise")


@register(
    "grep_candidates",
    f"with {READ}, n as (select path, unnest(l) as text, generate_subscripts(l, 1) as line from f) select path, min(line) as first_line, max(line) as last_line, count(*) as matches, arg_min(text, line) as first_text, round(least(0.95, 0.45 + 0.08 * count(*)), 6)::double as confidence from n where contains(text, 'cursor') group by path order by matches desc, path limit 20",
)
def grep_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.grep_files(ops.grep(items(spark, d), "cursor", fixed=True)))


@register("read_excerpt", f"with {READ} select path, array_to_string(l[5:14], chr(10)) as excerpt, len(l) > 14 as truncated from f where len(l) >= 5")
def read_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return ops.excerpt(items(spark, d), 5, 10)


@register(
    "tree_listing",
    "with p as (select path, string_split(path, '/') as p from code_items), n as (select path, p, unnest(range(1, least(len(p), 3) + 1)) as depth from p) select array_to_string(p[1:depth], '/') as node, depth, depth < len(p) as is_directory, count(*) as files from n group by all",
)
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    return ops.tree(items(spark, d), 3)


_SYMBOLS = "case code_language " + " ".join(f"when '{k}' then regexp_extract_all(content, '{p}', 1)" for k, p in ops.DECLARATIONS.items()) + " end"


@register("file_symbols", f"with s as (select path, code_language, {_SYMBOLS} as s from code_items) select path, code_language, unnest(s) as symbol, generate_subscripts(s, 1) - 1 as position from s where s is not null")
def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return ops.symbols(items(spark, d))


@register(
    "file_outline",
    f"""with {READ}, n as (select path, unnest(l) as text from f), s as (select path, len({_SYMBOLS}) as symbols from code_items)
    select path, count(*) as lines, count(*) filter (regexp_matches(text, '^\\s*(import|from|use|#include|package)\\b')) as imports, coalesce(any_value(symbols), 0) as symbols from n left join s using (path) group by path""",
)
def file_outline(spark: SparkSession, d: str) -> DataFrame:
    return ops.outline(items(spark, d))


_CAMEL = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
_STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


@register(
    "file_summaries",
    f"""
    with {READ},
    s as (select path, array_to_string(list_sort(list_distinct({_SYMBOLS}))[1:20], ', ') as symbols from code_items where len({_SYMBOLS}) > 0),
    c as (select path, term, count(*) as n from (select path, unnest({_CAMEL.format("content")}) as term from f) where length(term) >= 4 and term not in ({_STOPS}) group by all),
    r as (select *, row_number() over (partition by path order by n desc, term) as rank from c), b as (select path, string_agg(term, ' ' order by rank) as terms from r where rank <= 12 group by path)
    select path, concat_ws(chr(10), 'file: ' || split_part(path, '/', -1), 'language: ' || code_language, 'symbols: ' || symbols, 'terms: ' || terms) as summary from f left join s using (path) left join b using (path)""",
)
def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    return ops.summaries(items(spark, d))


@register(
    "generated_cases",
    f"""
    with w as (select path, array_to_string({_CAMEL.format("regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '')")}, ' ') as s, array_to_string({_CAMEL.format("case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end")}, ' ') as p from code_items),
    q as (select path, list_filter(['find the file named ' || split_part(path, '/', -1), case when s <> '' then 'where is ' || s || ' implemented?' end, case when p <> '' and p <> s then 'where is ' || s || ' in ' || p || '?' end], lambda x: x is not null) as q from w),
    u as (select path, unnest(q) as query, generate_subscripts(q, 1) - 1 as "offset" from q),
    f as (select *, row_number() over (partition by lower(query) order by "offset", path) as n from u)
    select 'local-' || substr(sha1(path || ':' || query), 1, 12) as id, query, path, "offset" from f where n = 1""",
)
def generated_cases(spark: SparkSession, d: str) -> DataFrame:
    return ops.generated_cases(items(spark, d))


@register(
    "catalog_diff",
    """
    with a as (select item_id, content from code_items where item_id % 7 <> 0), b as (select item_id, case when item_id % 5 = 0 then coalesce(content, '') || ' ' else content end as content from code_items where item_id % 11 <> 0)
    select coalesce(a.item_id, b.item_id) as item_id, case when a.item_id is null then 'added' when b.item_id is null then 'deleted' when a.content is not distinct from b.content then 'same' else 'changed' end as status from a full join b on a.item_id = b.item_id""",
)
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    """The whole table against a later version of itself in which files came, went and changed."""
    files = items(spark, d)
    later = files.where("item_id % 11 != 0").withColumn("content", F.when(F.col("item_id") % 5 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" "))).otherwise(F.col("content")))
    return collections.difference(files.where("item_id % 7 != 0"), later, "item_id", F.struct("content"))


@register(
    "index_composition",
    "select code_language, grouping(code_language) = 1 as is_total, count(*) as items, count(distinct path) as paths, coalesce(sum(strlen(content)), 0) as bytes from code_items group by rollup (code_language)",
)
def index_composition(spark: SparkSession, d: str) -> DataFrame:
    return collections.composition(items(spark, d), "code_language")


@register(
    "dataset_lint",
    """
    with f as (
        select record_id, 'no id' as fault from eval_cases where id is null or id = '' union all select record_id, 'no query' from eval_cases where query is null or trim(query) = ''
        union all select record_id, 'nothing expected' from eval_cases where len(expected) < 1
        union all select record_id, 'id used again' from (select record_id, id, count(id) over (partition by id) as n from eval_cases) where id is not null and n > 1
        union all select record_id, 'query used again' from (select record_id, query, count(query) over (partition by query) as n from eval_cases) where query is not null and n > 1)
    select record_id, fault from f""",
)
def dataset_lint(spark: SparkSession, d: str) -> DataFrame:
    return collections.lint(table(spark, d, "eval_cases"))


@register(
    "expected_of_repeats",
    r"""
    with k as (select record_id, expected, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) as key from eval_cases where query is not null),
    u as (select key, list_sort(list(distinct e)) as all_expected from (select key, unnest(expected) as e from k) group by key) select record_id, all_expected from k join u using (key)""",
)
def expected_of_repeats(spark: SparkSession, d: str) -> DataFrame:
    return collections.expected_of_repeats(table(spark, d, "eval_cases"))


@register(
    "stratified_sample",
    """
    with p as (select outcome_id, confidence, row_number() over (order by confidence, outcome_id) - 1 as pos, count(*) over () as n, parse_error is null as flag from answer_outcomes where confidence is not null),
    s as (select outcome_id, floor(pos * 3 / n)::int as tercile, flag from p), r as (select *, row_number() over (partition by tercile, flag order by sha256('anchor:' || outcome_id), outcome_id) as drawn from s)
    select outcome_id, tercile, flag, drawn from r where drawn <= 20""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "answer_outcomes").select("outcome_id", "confidence", "parse_error")
    return collections.stratified(outcomes, "outcome_id", "confidence", F.col("parse_error").isNull(), 20, "anchor").select("outcome_id", "tercile", "flag", "drawn")


_GATES = {"never": "false", "always": "true", "unsure": "confidence < 0.5", "slow": "generation_duration_ms > 5000", "unsure_and_slow": "confidence < 0.5 and generation_duration_ms > 5000"}


@register(
    "gate_policy_sweep",
    CASES
    + "  , judged as (select metrics.*, o.confidence from metrics join answer_outcomes o on o.outcome_id = metrics.case_id), "
    + ", ".join(f"g{i} as (select '{g}' as gate, avg(coalesce({c}, false)::int) as taken, avg(case when coalesce({c}, false) then file_rr else reciprocal_rank end) as mrr, avg((case when coalesce({c}, false) then file_rr else reciprocal_rank end >= 1)::int) as hit_1 from judged)" for i, (g, c) in enumerate(_GATES.items()))
    + " select gate, round(taken, 6) as taken, round(mrr, 6) as mrr, round(hit_1, 6) as hit_1 from ("
    + " union all ".join(f"select * from g{i}" for i in range(len(_GATES)))
    + " union all select 'oracle', avg((file_rr > reciprocal_rank)::int), avg(greatest(file_rr, reciprocal_rank)), avg((greatest(file_rr, reciprocal_rank) >= 1)::int) from judged)",
)
def gate_policy_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Policies that choose between the ranking over results and the one over files, case by case."""
    metrics = evaluate.case_metrics(cases(spark, d)).withColumnsRenamed({"reciprocal_rank": "base_rr", "file_rr": "other_rr"})
    return rounded(collections.gate_sweep(metrics, {name: F.expr(condition) for name, condition in _GATES.items()}))


@register(
    "quota_budget_select",
    CANDIDATES
    + """, a as (select *, row_number() over (partition by query_id order by (lexical > 0) desc, lexical desc, rank) <= 2 and lexical > 0 as t1 from ranking),
    b as (select *, t1 or (symbol > 0 and row_number() over (partition by query_id order by (symbol > 0 and not t1) desc, symbol desc, rank) <= 2 and not t1) as t2 from a),
    o as (select *, row_number() over (partition by query_id order by t2 desc, rank) as n from b) select query_id, item_id, row_number() over (partition by query_id order by rank) as rank from o where n <= 8""",
)
def quota_budget_select(spark: SparkSession, d: str) -> DataFrame:
    return collections.quota_budget(ranking(spark, d), {"lexical": 2, "symbol": 2}, 8).select("query_id", "item_id", "rank")


@register(
    "arm_gain_loss",
    """
    with p as (select distinct case_id, unnest(retrieved_files) as path, generation_model = (select min(generation_model) from answer_outcomes) as a, generation_model = (select max(generation_model) from answer_outcomes) as b from answer_outcomes where case_id is not null),
    x as (select distinct case_id, path from p where a), y as (select distinct case_id, path from p where b)
    select case_id, path, 'gained' as change from (select * from y except select * from x) union all select case_id, path, 'lost' from (select * from x except select * from y)""",
)
def arm_gain_loss(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "answer_outcomes").where("case_id is not null")
    ends = outcomes.agg(F.min("generation_model").alias("low"), F.max("generation_model").alias("high"))
    found = outcomes.select("case_id", "generation_model", F.explode("retrieved_files").alias("path"))
    arm = lambda side: found.join(F.broadcast(ends), F.col("generation_model") == F.col(side)).select("case_id", "path")
    return collections.gained_and_lost(arm("low"), arm("high"), ["case_id", "path"])


@register(
    "probe_path_filter",
    r"""
    with s as (select request_id as query_id, string_split_regex(trim(query || ' ' || 'src/unknown/never.py'), '\s+') as w from (select distinct request_id, query from search_requests where query is not null)),
    t as (select query_id, unnest(w) as token, generate_subscripts(w, 1) as position from s), p as (select distinct array_to_string(p[1:i], '/') as token from (select string_split(path, '/') as p, unnest(range(1, len(string_split(path, '/')) + 1)) as i from code_items))
    select query_id, string_agg(token, ' ' order by position) as query from t where not contains(token, '/') or token in (select token from p) group by query_id""",
)
def probe_path_filter(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "search_requests").where("query is not null").select("request_id", "query").distinct()
    return collections.known_path_tokens(probes.select(F.col("request_id").alias("query_id"), F.concat("query", F.lit(" src/unknown/never.py")).alias("query")), items(spark, d))


@register(
    "needle_overlap",
    """
    with r as (select distinct hit_id, request_id, path, start_line, end_line, row_number() over (partition by request_id, path order by score desc nulls last, hit_id) as rank from (select distinct * from search_items) where path is not null),
    n as (select request_id, path, max(start_line) as start_line, max(end_line) as end_line from search_items where path is not null group by all)
    select n.request_id, n.path, n.start_line, n.end_line, coalesce(bool_or(greatest(n.start_line, r.start_line) <= least(n.end_line, r.end_line)) filter (rank <= 1), false) as found from n left join r on n.request_id = r.request_id and n.path = r.path group by all""",
)
def needle_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best hit of a file overlaps the last range of that file among all hits of the request."""
    hits = table(spark, d, "search_items").where("path is not null").distinct()
    wanted = hits.groupBy("request_id", "path").agg(F.max("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    from sieveloom.operators.lexical import ranked

    found = ranked(hits, ["request_id", "path"], [F.col("score").desc_nulls_last(), F.col("hit_id")])
    return collections.interval_overlap(wanted, found, ["request_id", "path"], 1)


@register(
    "metrics_long",
    CASES + "select case_id, metric_name, round(metric_value, 6) as metric_value from (select case_id, reciprocal_rank, precision, recall, ndcg from metrics) unpivot (metric_value for metric_name in (reciprocal_rank, precision, recall, ndcg))",
)
def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(collections.long_metrics(evaluate.case_metrics(cases(spark, d)), ["case_id"], ["reciprocal_rank", "precision", "recall", "ndcg"]))


@register("retention_ttl", "select count(*) as kept, count(distinct run_id) as runs from metric_rows where event_time > (select max(event_time) from metric_rows) - interval 10 day")
def retention_ttl(spark: SparkSession, d: str) -> DataFrame:
    kept = collections.retained(table(spark, d, "metric_rows"), "event_time", 10)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("run_id").alias("runs"))


@register("trace_counts", "select event_type, count(*) as events, max(ts) as latest from events group by all")
def trace_counts(spark: SparkSession, d: str) -> DataFrame:
    """The state of the trace monitor after all events; the batch twin of the stream."""
    return monitor.event_counts(table(spark, d, "events"))


@register("stream_event_counts", "select event_type, count(*) as events, max(ts) as latest from events group by all")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same state kept by a stream over the files, until it has read all that is there."""
    return monitor.run_to_table(monitor.event_counts(monitor.read_table(spark, d, "events")), "complete")


@register(
    "stage_latency",
    "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as events, round(avg(value), 6) as mean_value, round(max(value), 6) as max_value from events group by all",
)
def stage_latency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monitor.stage_latency(table(spark, d, "events"), "1 hour"))


@register(
    "late_metrics",
    "select suite, count(*) as metrics, count(*) filter (ingested_at > event_time + interval 1 day) as late, max(date_diff('second', event_time, ingested_at)) // 86400 as days_late from metric_rows group by suite",
)
def late_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How late metrics arrive, which sets the watermark of the stream."""
    rows = table(spark, d, "metric_rows")
    seconds = F.timestamp_diff("SECOND", F.col("event_time"), F.col("ingested_at"))
    return rows.groupBy("suite").agg(F.count(F.lit(1)).alias("metrics"), F.count_if(F.col("ingested_at") > F.col("event_time") + F.expr("interval 1 day")).alias("late"), F.expr("max(timestampdiff(SECOND, event_time, ingested_at)) div 86400").alias("days_late"))

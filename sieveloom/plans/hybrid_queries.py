"""The whole hybrid search over all query texts, by weighted sum and by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import fusion, graph, hybrid, lexical, routing
from sieveloom.operators.lexical import ranked
from sieveloom.plans.lexical_queries import ASKED, TOKENS_A, TOKENS_B, items, requests
from sieveloom.plans.ranking_queries import EDGES_SQL, edges
from sieveloom.plans.registry import register, rounded
from sieveloom.plans.runtime import checkpoint
from sieveloom.sources.tables import table

#: Candidates of each lexical source and of the graph, and those that the lexical cut leaves.
SOURCE_LIMIT, CUT = 60, 100
DOCUMENTATION = r"(?i)\.(md|rst|txt)$|(^|/)(docs|readme[^/]*)(/|$)"
KIND_SQL = f"(case when regexp_matches(path, '{DOCUMENTATION}') then 1.08::double else 1.0::double end)"


def kind_weight() -> Column:
    """Documentation counts somewhat more than code."""
    return F.when(F.col("path").rlike(DOCUMENTATION), 1.08).otherwise(1.0)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits of all requests of a query text with a positive score, each once, on files that there are."""
    asked = table(spark, d, "search_requests").where("query is not null").select("request_id", "query").distinct()
    first = asked.groupBy("query").agg(F.min("request_id").alias("query_id"))
    hits = table(spark, d, "search_items").where("score > 0 and not isnan(score) and path is not null").select("hit_id", "request_id", "path", F.round(F.col("score").cast("double"), 6).alias("vector")).distinct()
    found = hits.join(asked.join(first, "query").select("request_id", "query_id"), "request_id")
    files = table(spark, d, "code_items").select("item_id", "path")
    return found.join(files, "path").select("query_id", "item_id", "path", "vector", "hit_id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of a query with its seven signals."""
    files, asked = items(spark, d), checkpoint(requests(spark, d))
    paths = files.select("item_id", "path")
    hits = checkpoint(_hits(spark, d))
    by_vector = hits.groupBy("query_id", "item_id", "path").agg(F.max("vector").alias("vector"))
    votes = fusion.file_votes(hits.withColumn("item_id", F.col("hit_id")), "vector").select("query_id", "path", "file_vote").join(paths, "path")

    scored = lexical.bm25_top(files, "item_id", t.word_tokens(F.col("content")), asked, SOURCE_LIMIT)
    top = ranked(scored, ["query_id"], [F.round("score", 6).desc(), F.col("item_id")], SOURCE_LIMIT)
    by_bm25 = hybrid.scaled_by_best(top, "score", "lexical").join(paths, "item_id")

    fields = {c: t.identifier_tokens(F.col(c)) for c in ("content", "title", "path")}
    shares = lexical.coverage_top(files, "item_id", fields, asked, SOURCE_LIMIT)
    shares = shares.select("query_id", "item_id", lexical.lexical_score(F.col("content"), F.col("title")).alias("lexical"), F.col("path").alias("path_score"), F.col("title").alias("symbol"))
    best = ranked(shares, ["query_id"], [F.round("lexical", 6).desc(), F.round("path_score", 6).desc(), F.col("item_id")], SOURCE_LIMIT)
    by_coverage = best.join(paths, "item_id")

    seeds = by_vector.select("query_id", "path", F.col("vector").alias("score"))
    reached = graph.propagate(checkpoint(graph.adjacency(edges(spark, d))), seeds)
    near = ranked(reached, ["query_id"], [F.round("score", 9).desc(), F.col("path")], SOURCE_LIMIT)
    by_graph = near.select("query_id", "path", F.col("score").alias("graph")).join(paths, "path")

    # Files with a matching symbol alone have nothing that the cut looks at: it drops them, so only those it leaves are compared.
    lexically = hybrid.lexical_cut(hybrid.merged(by_bm25, by_coverage), CUT).drop("symbol_match")
    symbols = files.select("item_id", F.array_distinct(t.identifier_tokens(F.col("title"))).alias("symbol_terms"))
    matched = lexically.join(symbols, "item_id").join(asked.select("query_id", "terms"), "query_id").withColumn("symbol_match", lexical.symbol_match(F.col("symbol_terms"), F.col("terms")))
    lexically = matched.withColumn("symbol_match", F.when(F.round("symbol_match", 6) >= 0.25, F.col("symbol_match")).otherwise(0.0))
    return hybrid.merged(by_vector, votes, lexically, by_graph)


HYBRID_SQL = (
    EDGES_SQL
    + f"""
    , {ASKED}
    asked_all as (select distinct request_id, query_id from search_requests join asked using (query)),
    hits as (select query_id, item_id, path, vector, hit_id from (select distinct hit_id, request_id, path, round(score::double, 6) as vector from search_items where score > 0 and not isnan(score) and path is not null) h join asked_all using (request_id) join code_items using (path)),
    by_vector as (select query_id, item_id, path, max(vector) as vector from hits group by all),
    vn as (select *, row_number() over (partition by query_id, path order by vector desc, hit_id) as rn from hits), vv as (select query_id, item_id, path, sum(vector * pow(0.5, rn - 1)) as vote from vn where rn <= 4 group by all),
    votes as (select query_id, item_id, path, case when max(vote) over w > min(vote) over w then (vote - min(vote) over w) / (max(vote) over w - min(vote) over w) else 1.0 end as file_vote from vv window w as (partition by query_id)),
    sized as (select item_id, {TOKENS_B.format("content")} as tokens, coalesce(len({TOKENS_B.format("content")}), 0) as dl from code_items), stats as (select count(*) as n, greatest(avg(dl), 1) as avgdl from sized),
    posted as (select item_id, dl, term, count(*) as tf from (select item_id, dl, unnest(tokens) as term from sized) group by all), df as (select term, count(*) as df from posted group by term),
    b0 as (select query_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from terms join posted using (term) join df using (term), stats group by all),
    b1 as (select *, row_number() over (partition by query_id order by round(score, 6) desc, item_id) as rank, max(score) over (partition by query_id) as best from b0),
    by_bm25 as (select query_id, item_id, score / best as lexical from b1 where rank <= {SOURCE_LIMIT}),
    sizes as (select query_id, count(*) as size from terms group by all),
    p as (select distinct item_id, 'content' as field, unnest({TOKENS_A.format("content")}) as term from code_items union all select distinct item_id, 'title', unnest({TOKENS_A.format("title")}) from code_items union all select distinct item_id, 'path', unnest({TOKENS_A.format("path")}) from code_items),
    cc as (select query_id, item_id, count(*) filter (field = 'content') / any_value(size) as content, count(*) filter (field = 'title') / any_value(size) as title, count(*) filter (field = 'path') / any_value(size) as path_score from terms join p using (term) join sizes using (query_id) group by all),
    cs as (select query_id, item_id, least(1.0, content * 0.75 + title * 0.25) as lexical, path_score, title as symbol from cc),
    by_coverage as (select * from (select *, row_number() over (partition by query_id order by round(lexical, 6) desc, round(path_score, 6) desc, item_id) as rank from cs) where rank <= {SOURCE_LIMIT}),
    st as (select distinct item_id, unnest({TOKENS_A.format("title")}) as term from code_items where title is not null), ss as (select item_id, count(*) as own from st group by all),
    by_symbol as (select query_id, item_id, least(1.0, count(*) / greatest(least(any_value(own), any_value(size)), 1)) as symbol_match from terms join st using (term) join sizes using (query_id) join ss using (item_id) group by all having round(symbol_match, 6) >= 0.25),
    s120 as (select query_id, path, score from (select query_id, path, vector as score, row_number() over (partition by query_id order by round(vector, 9) desc, path) as n from by_vector) where n <= 120),
    near as (select src, dst, weight from (select *, row_number() over (partition by src order by round(weight, 9) desc, dst) as n from adj) where n <= 40),
    h1 as (select query_id, dst as path, max(score * weight * 0.65) as score from s120 join near on path = src group by all), f1 as (select query_id, path, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, path) as n from h1) where n <= 40),
    h2 as (select query_id, dst as path, max(score * weight * 0.65 * 0.65) as score from f1 join near on path = src group by all), hh as (select query_id, path, max(score) as score from (select * from h1 union all select * from h2) group by all),
    by_graph as (select query_id, item_id, score as graph from (select *, row_number() over (partition by query_id order by round(score, 9) desc, path) as n from hh) join code_items using (path) where n <= {SOURCE_LIMIT}),
    lm as (select query_id, item_id, max(lexical) as lexical, max(path_score) as path_score, max(symbol) as symbol, max(symbol_match) as symbol_match from (
        select query_id, item_id, lexical, 0 as path_score, 0 as symbol, 0 as symbol_match from by_bm25 union all select query_id, item_id, lexical, path_score, symbol, 0 from by_coverage union all select query_id, item_id, 0, 0, 0, symbol_match from by_symbol) group by all),
    lc as (select * from (select lm.*, row_number() over (partition by query_id order by round(lexical + path_score + symbol, 9) desc, path desc, item_id) as n from lm join code_items using (item_id)) where n <= {CUT} and (lexical > 0 or path_score > 0 or symbol > 0)),
    merged as (select query_id, item_id, max(vector) as vector, max(lexical) as lexical, max(path_score) as path_score, max(symbol) as symbol, max(symbol_match) as symbol_match, max(graph) as graph, max(file_vote) as file_vote from (
        select query_id, item_id, vector, 0.0::double as lexical, 0.0::double as path_score, 0.0::double as symbol, 0.0::double as symbol_match, 0.0::double as graph, 0.0::double as file_vote from by_vector
        union all select query_id, item_id, 0, 0, 0, 0, 0, 0, file_vote from votes union all select query_id, item_id, 0, lexical, path_score, symbol, symbol_match, 0, 0 from lc union all select query_id, item_id, 0, 0, 0, 0, 0, graph, 0 from by_graph) group by all),
    found_items as (select merged.*, path from merged join code_items using (item_id))
"""
)
_words = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"
_NAMED = f"(regexp_matches(query, '[/\\\\]|(?:^|\\s)[A-Za-z0-9_-]+\\.({'|'.join(routing.FILE_SUFFIXES)})\\b') or regexp_matches(query, '\\b[A-Za-z_][A-Za-z0-9_]*[A-Z_][A-Za-z0-9_]*\\b'))"
_PROSE = f"""
    , rw as (select query_id, bool_or(term in {_words(routing.PATH_WORDS + routing.SYMBOL_WORDS)}) as named, bool_or(term in {_words(routing.PROSE_VERBS)}) as verb, bool_or(term in {_words(routing.RAW_WORKFLOW_WORDS)}) as flow from (select query_id, unnest({TOKENS_A.format("query")}) as term from asked) group by all),
    tw as (select query_id, bool_or(term in {_words(routing.WORKFLOW_WORDS)}) as flow, bool_or(term in {_words(routing.PATH_WORDS + routing.SYMBOL_WORDS)}) as named from terms group by all),
    routes as (select asked.query_id, case when coalesce(tw.flow, false) or coalesce(rw.flow, false) then 'workflow' when coalesce(tw.named, false) or {_NAMED} then 'path_symbol' else 'semantic' end as route,
        not ({_NAMED} or coalesce(rw.named, false)) and (coalesce(rw.verb, false) or (len(regexp_extract_all(query, '[A-Za-z]+')) >= 3 and not regexp_matches(query, '(?:^|[^A-Za-z])[A-Z]'))) as prose
        from asked left join rw using (query_id) left join tw using (query_id))
"""


def _weight_sql(signal: str) -> str:
    own = lambda name: "(case route " + "".join(f"when '{r}' then {w[name]}::double " for r, w in hybrid.ROUTE_WEIGHTS.items() if name in w) + f"else {hybrid.WEIGHTS[name]}::double end)" if any(name in w for w in hybrid.ROUTE_WEIGHTS.values()) else f"{hybrid.WEIGHTS[name]}::double"
    surplus = f"(greatest(0, {own('path_score')} - {hybrid.PROSE_PATH}) + greatest(0, {own('symbol')} - {hybrid.PROSE_SYMBOL})) / 2"
    prose = {"path_score": f"least({own('path_score')}, {hybrid.PROSE_PATH})", "symbol": f"least({own('symbol')}, {hybrid.PROSE_SYMBOL})", "vector": f"{own('vector')} + {surplus}", "lexical": f"{own('lexical')} + {surplus}"}
    return f"(case when prose then {prose[signal]} else {own(signal)} end)" if signal in prose else own(signal)


def routes(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("query_id", routing.route(F.col("query")).alias("route"), routing.prose(F.col("query")).alias("prose"))


@register("query_prose", "with " + ASKED.strip() + _PROSE.strip().removeprefix(",") + " select query_id, route, prose from routes")
def query_prose(spark: SparkSession, d: str) -> DataFrame:
    """Route of every query text, and whether it is prose, which decide on the weights."""
    return routes(spark, d)


@register("hybrid_candidates", HYBRID_SQL + f"select query_id, item_id, path, {', '.join(f'round({s}, 6)::double as {s}' for s in hybrid.SIGNALS)} from found_items")
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(candidates(spark, d))


@register(
    "hybrid_search",
    HYBRID_SQL
    + _PROSE
    + f""", w as (select f.*, ({" + ".join(f"{s} * {_weight_sql(s)}" for s in hybrid.SIGNALS)}) * {KIND_SQL} + 1e-10 as total from found_items f join routes using (query_id)),
    ranked as (select query_id, item_id, path, total, row_number() over (partition by query_id order by round(total, 9) desc, round(graph, 9) desc, path desc) as rank from w) select query_id, item_id, rank, round(total, 6) as total from ranked where rank <= 10""",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best files of every query text by all signals under the weights of its route."""
    scored = hybrid.routed_total(candidates(spark, d), routes(spark, d), kind_weight())
    # Exact halves must not be rounded by the order of adding up.
    scored = scored.withColumn("total", F.col("total") + 1e-10)
    return rounded(hybrid.file_ranking(scored, 10).select("query_id", "item_id", "rank", "total"))


@register(
    "hybrid_rrf",
    HYBRID_SQL
    + ", u as ("
    + " union all ".join(f"select query_id, item_id, path, '{s}' as signal, round({s}, 9)::double as v, {w}::double as w from found_items" for s, w in hybrid.WEIGHTS.items() if w > 0)
    + f"""), n as (select *, row_number() over (partition by query_id, signal order by v desc, path desc, item_id desc) as rank from u where v > 0), t as (select query_id, item_id, path, sum(w / (60 + rank)) * any_value({KIND_SQL}) as score from n group by query_id, item_id, path),
    r as (select query_id, item_id, row_number() over (partition by query_id order by round(score, 9) desc, path desc, item_id) as rank, round(score, 6) as score from t) select * from r where rank <= 10""",
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    found = candidates(spark, d)
    # Signals are compared as they are shown, so that sums in another order don't change ranks.
    even = found.select("query_id", "item_id", "path", *(F.round(s, 9).alias(s) for s in hybrid.SIGNALS))
    return rounded(hybrid.rrf_ranking(even, kind_weight(), 10).select("query_id", "item_id", "rank", "score"))

"""Queries on tokenizers, the inverted index, BM25, coverage and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import lexical
from sieveloom.plans.registry import register, rounded
from sieveloom.plans.runtime import spread
from sieveloom.sources.tables import table


def items(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "code_items").select("item_id", "path", "title", "content", "code_language"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Distinct query texts with their terms; query_id is the smallest request of a text."""
    asked = table(spark, d, "search_requests").where("query is not null").groupBy("query").agg(F.min("request_id").alias("query_id"))
    return asked.select("query_id", "query", t.query_terms(F.col("query")).alias("terms"))


# Tokenizer A in SQL: identifiers with their parts; DuckDB has no look-around, so boundaries become spaces first.
TOKENS_A = r"""
    flatten(list_transform(regexp_extract_all(replace({0}, '-', '_'), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]'),
        lambda x: list_concat([lower(x)], case when regexp_matches(x, '[A-Za-z]') then
            list_filter(string_split_regex(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_+'), lambda y: y <> '') else [] end)))"""
TOKENS_B = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
ALIAS_KEYS = ", ".join(f"'{w}'" for w in t.ALIASES)
TERMS = (
    "list_filter(" + TOKENS_A.format("query") + rf", lambda x: (length(x) >= 3 or x in ({ALIAS_KEYS})) and x not in ({STOP}) and regexp_matches(x, '[\p{{L}}\p{{N}}]'))"
)
ASKED = f"""
    asked as (select min(request_id) as query_id, query from search_requests where query is not null group by query),
    terms as (select distinct query_id, unnest({TERMS}) as term from asked),
"""


def _counts(tokens: str) -> str:
    return f"with x as (select item_id, unnest({tokens.format('content')}) as term from code_items where content is not null) select item_id, term, count(*) as n from x group by all"


@register("tokens_identifier", _counts(TOKENS_A))
def tokens_identifier(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(items(spark, d), "item_id", t.identifier_tokens(F.col("content"))).withColumnRenamed("tf", "n")


@register("tokens_word", _counts(TOKENS_B))
def tokens_word(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(items(spark, d), "item_id", t.word_tokens(F.col("content"))).withColumnRenamed("tf", "n")


@register(
    "tokens_camel",
    _counts(r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)"),
)
def tokens_camel(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(items(spark, d), "item_id", t.camel_tokens(F.col("content"))).withColumnRenamed("tf", "n")


@register(
    "tokens_stem",
    _counts(
        "list_transform(regexp_extract_all(lower({0}), '[a-z_][a-z0-9_]*|[0-9]+'), lambda w: case when length(w) > 4 and w like '%ies' then w[:-4] || 'y' "
        "when length(w) > 4 and w like '%es' then w[:-3] when length(w) > 3 and w like '%s' then w[:-2] else w end)"
    ),
)
def tokens_stem(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(items(spark, d), "item_id", t.stem_tokens(F.col("content"))).withColumnRenamed("tf", "n")


WEIGHTED = f"""
    fields as (
        select item_id, unnest({TOKENS_A.format("coalesce(content, '')")}) as term, 1 as w from code_items
        union all select item_id, unnest({TOKENS_A.format("coalesce(title, '')")}), 2 from code_items
        union all select item_id, unnest({TOKENS_A.format("coalesce(path, '')")}), 2 from code_items
        union all select item_id, unnest({TOKENS_A.format("coalesce(code_language, '')")}), 2 from code_items),
    weighted as (select item_id, term, sum(w) as tf from fields group by all)
"""
FIELD_WEIGHTS = {"content": 1, "title": 2, "path": 2, "code_language": 2}


@register("inverted_index", f"with {WEIGHTED} select item_id, term, tf from weighted")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return lexical.weighted_postings(items(spark, d), "item_id", FIELD_WEIGHTS)


@register(
    "inverted_index_stats",
    f"with {WEIGHTED}, l as (select item_id, sum(tf) as dl from weighted group by all) select count(*) as items, sum(dl) as tokens, round(avg(dl), 6) as avgdl, (select count(distinct term) from weighted) as terms from l",
)
def inverted_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lexical.index_stats(inverted_index(spark, d), "item_id"))


@register("document_frequency", f"with {WEIGHTED} select term, count(*) as df from weighted group by term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(inverted_index(spark, d))


def _bm25_sql(k1: float, b: float, distinct: bool, floor: float) -> str:
    asked = ASKED if distinct else ASKED.replace("select distinct query_id", "select query_id")
    return f"""
    with {asked}
    asked_terms as (select query_id, term, count(*) as qtf from terms group by all),
    sized as (select item_id, {TOKENS_B.format("content")} as tokens, coalesce(len({TOKENS_B.format("content")}), 0) as dl from code_items),
    stats as (select count(*) as n, greatest(avg(dl), {floor}) as avgdl from sized),
    posted as (select item_id, dl, term, count(*) as tf from (select item_id, dl, unnest(tokens) as term from sized) group by all),
    df as (select term, count(*) as df from posted group by term),
    scored as (
        select query_id, item_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) as score
        from asked_terms join posted using (term) join df using (term), stats group by all),
    ranked as (select *, row_number() over (partition by query_id order by round(score, 6) desc, item_id) as rank from scored)
    select query_id, item_id, rank, round(score, 6) as score from ranked where rank <= 10"""


def _top(scored: DataFrame) -> DataFrame:
    return rounded(lexical.ranked(scored, ["query_id"], [F.round("score", 6).desc(), F.col("item_id")], 10)).select("query_id", "item_id", "rank", "score")


@register("bm25_topk", _bm25_sql(1.2, 0.75, True, 1))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best items of every distinct query."""
    return _top(lexical.bm25_top(items(spark, d), "item_id", t.word_tokens(F.col("content")), requests(spark, d)))


@register("bm25_repeated_terms", _bm25_sql(1.2, 0.75, False, 0))
def bm25_repeated_terms(spark: SparkSession, d: str) -> DataFrame:
    """The variant where a term counts as often as the query has it and short collections are not padded."""
    asked = table(spark, d, "search_requests").where("query is not null").groupBy("query").agg(F.min("request_id").alias("query_id"))
    terms = F.filter(t.identifier_tokens(F.col("query")), lambda x: ((F.length(x) >= 3) | x.isin(*t.ALIASES)) & ~x.isin(t.STOP_WORDS) & x.rlike(r"[\p{L}\p{N}]"))
    return _top(lexical.bm25_top(items(spark, d), "item_id", t.word_tokens(F.col("content")), asked.select("query_id", terms.alias("terms")), distinct_terms=False, least_avgdl=0.0))


@register("bm25_alias_locator", _bm25_sql(1.2, 0.35, True, 1))
def bm25_alias_locator(spark: SparkSession, d: str) -> DataFrame:
    """The locator's weaker length normalisation."""
    return _top(lexical.bm25_top(items(spark, d), "item_id", t.word_tokens(F.col("content")), requests(spark, d), b=0.35))


@register("query_terms", f"with {ASKED} x as (select 1) select query_id, term from terms")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("query_id", F.explode("terms").alias("term")).distinct()


ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, values in t.ALIASES.items() for v in values)


@register(
    "query_expansion",
    f"with {ASKED} a(key, alias) as (values {ALIAS_ROWS}) select query_id, term from terms union select query_id, alias from terms join a on key = term",
)
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("query_id", F.explode(t.expand_terms(F.col("terms"))).alias("term"))


@register(
    "boolean_or_candidates",
    f"with {ASKED} p as (select distinct item_id, unnest({TOKENS_A.format('title')}) as term from code_items) select query_id, count(distinct item_id) as items from terms join p using (term) group by query_id",
)
def boolean_or_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.any_term(items(spark, d), "item_id", t.identifier_tokens(F.col("title")), requests(spark, d))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"))


COVERAGE = f"""
    with {ASKED}
    sizes as (select query_id, count(*) as size from terms group by all),
    p as (select distinct item_id, 'content' as field, unnest({TOKENS_A.format("content")}) as term from code_items
        union all select distinct item_id, 'title', unnest({TOKENS_A.format("title")}) from code_items
        union all select distinct item_id, 'path', unnest({TOKENS_A.format("path")}) from code_items),
    c as (select query_id, item_id, count(*) filter (field = 'content') / any_value(size) as content, count(*) filter (field = 'title') / any_value(size) as title,
            count(*) filter (field = 'path') / any_value(size) as path from terms join p using (term) join sizes using (query_id) group by all),
    s as (select query_id, item_id, least(1.0, content * 0.75 + title * 0.25) as lexical, path from c),
    r as (select *, row_number() over (partition by query_id order by round(lexical, 6) desc, round(path, 6) desc, item_id) as rank from s)
    select query_id, item_id, rank, round(lexical, 6) as lexical, round(path, 6) as path from r where rank <= 20
"""


@register("coverage_seeds", COVERAGE)
def coverage_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The best files of every query by the share of its terms in content, title and path."""
    fields = {c: t.identifier_tokens(F.col(c)) for c in ("content", "title", "path")}
    shares = lexical.coverage_top(items(spark, d), "item_id", fields, requests(spark, d), 20)
    scored = shares.select("query_id", "item_id", lexical.lexical_score(F.col("content"), F.col("title")).alias("lexical"), "path")
    top = lexical.ranked(scored, ["query_id"], [F.round("lexical", 6).desc(), F.round("path", 6).desc(), F.col("item_id")], 20)
    return rounded(top.select("query_id", "item_id", "rank", "lexical", "path"))


@register(
    "symbol_match",
    f"""
    with {ASKED}
    q as (select query_id, count(*) as size from terms group by all),
    p as (select distinct item_id, unnest({TOKENS_A.format("title")}) as term from code_items where title is not null),
    ps as (select item_id, count(*) as size from p group by all)
    select query_id, item_id, round(least(1.0, count(*) / greatest(least(any_value(ps.size), any_value(q.size)), 1)), 6) as score
    from terms join p using (term) join q using (query_id) join ps using (item_id) group by all having score >= 0.25""",
)
def symbol_match(spark: SparkSession, d: str) -> DataFrame:
    """Files whose symbol shares most of its or the query's terms; pairs are counted where they are written, without an exchange."""
    symbols = items(spark, d).select("item_id", F.array_distinct(t.identifier_tokens(F.col("title"))).alias("symbol_terms"))
    return lexical.symbol_matches(symbols, "item_id", F.col("symbol_terms"), requests(spark, d)).withColumnRenamed("part", "score")


@register(
    "tfidf_keywords",
    f"""
    with i as (select item_id, term, count(*) as tf from (select item_id, unnest({TOKENS_B.format("content")}) as term from code_items) group by all),
    s as (select *, sum(tf) over (partition by item_id) as length, count(*) over (partition by term) as df from i),
    w as (select item_id, term, ln(1 + tf / length) * (ln(((select count(*) from code_items) + 1) / (df + 1)) + 1) as weight from s),
    r as (select *, row_number() over (partition by item_id order by round(weight, 9) desc, term) as rank from w)
    select item_id, term, rank, round(weight, 6) as weight from r where rank <= 10""",
)
def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lexical.keywords(items(spark, d), "item_id", t.word_tokens(F.col("content")), 10)).select("item_id", "term", "rank", "weight")


@register("point_ids")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids; the tests compare them with the standard library, as SQL has no version 5 UUID."""
    return items(spark, d).select("item_id", t.point_id(F.col("path")).alias("point_id"))


@register(
    "hash_split",
    "select path, (('0x' || substr(sha256(path), 1, 16))::ubigint::double / 18446744073709551616.0) < 0.8 as train from code_items",
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("path", (t.hash_share(F.col("path")) < 0.8).alias("train"))

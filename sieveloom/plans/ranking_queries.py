"""Queries on vectors, fusion, graphs, reranking and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import fusion, graph, lexical, rerank, routing, vectors
from sieveloom.operators.lexical import ranked
from sieveloom.plans.lexical_queries import ASKED, TERMS, TOKENS_A, items
from sieveloom.plans.registry import register, rounded
from sieveloom.plans.runtime import checkpoint
from sieveloom.sources.tables import table

# Vectors: every row whose id is divisible by 20 is a query against all rows.

COSINE = """
    with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
    n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as l from v),
    s as (select q.vec_id as query_id, n.vec_id as item_id, n.label, round(case when q.l * n.l > 0 then list_dot_product(q.e, n.e) / (q.l * n.l) else 0 end, 6) as score from n, n as q where q.vec_id % 20 = 0)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "embeddings")
    return own.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@register("cosine_topk", COSINE + ", r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) select query_id, item_id, rank, score from r where rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.cosine_top(*_vectors(spark, d), k=12)
    return ranked(rounded(found).drop("rank"), ["query_id"], [F.col("score").desc(), F.col("item_id")], 10).select("query_id", "item_id", "rank", "score")


@register("l2_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def l2_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "embeddings").select("vec_id", vectors.norm(F.col("embedding")).alias("norm")))


@register("self_cosine", "select vec_id, 1.0::double as cosine from embeddings")
def self_cosine(spark: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalized(F.col("embedding"))
    return rounded(table(spark, d, "embeddings").select("vec_id", vectors.dot(unit, unit).alias("cosine")))


@register(
    "cosine_lanes",
    COSINE
    + """, r as (select *, row_number() over (partition by query_id, label order by score desc, item_id) as lane_rank from s)
    select query_id, item_id, label, lane_rank, score from r where lane_rank <= case label when 0 then 5 when 1 then 3 else 1 end""",
)
def cosine_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The best items of every query within each kind of vector."""
    own = table(spark, d, "embeddings")
    kinds = own.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("kind"))
    found = vectors.cosine_lanes(kinds, _vectors(spark, d)[1], {"0": 5, "1": 3}, default=1, spare=3)
    scored = rounded(found).withColumn("path", F.lit(""))
    return vectors.lanes(scored, {"0": 5, "1": 3}, default=1).select("query_id", "item_id", F.col("kind").cast("int").alias("label"), "lane_rank", "score")


@register(
    "hashed_features",
    f"""
    with t as (select item_id, md5(unnest({TOKENS_A.format("title")})) as h from code_items),
    s as (select item_id, (('0x' || substr(h, 1, 8))::bigint % 256)::int as bucket, sum(case when ('0x' || substr(h, 9, 1))::int % 2 = 0 then 1 else -1 end) as s from t group by all)
    select item_id, bucket, round(s / sqrt(sum(s * s) over (partition by item_id)), 6) as value from s where s <> 0""",
)
def hashed_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.hashed_features(items(spark, d), "item_id", F.col("title")))


@register("hashed_embedding")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """BLAKE2b embeddings of the titles; the tests compare them with the definition."""
    return items(spark, d).select("item_id", vectors.blake_embedding(t.identifier_tokens(F.coalesce("title", F.lit("")))).alias("embedding"))


# Candidates: the hits of every request with their score, what the path covers of the query's terms, and how the title
# matches them; and their ranking by score.

CANDIDATES = f"""
    with cq as (select distinct request_id, list_distinct({TERMS}) as terms from search_requests where query is not null),
    ch as (select distinct request_id, hit_id, path, title, score from search_items where path is not null),
    ct as (select *, list_distinct({TOKENS_A.format("path")}) as path_terms, list_distinct({TOKENS_A.format("title")}) as title_terms from ch left join cq using (request_id)),
    c as (
        select request_id as query_id, hit_id as item_id, path, coalesce(split_part(path, '/', 1), '') as kind, case when score is null or isnan(score) then 0 else round(score::double, 6) end as vector,
            round(coalesce(len(list_intersect(terms, path_terms)) / nullif(len(terms), 0), 0), 6)::double as lexical,
            round(coalesce(case when terms is not null and len(title_terms) > 0 then least(1.0, len(list_intersect(terms, title_terms)) / greatest(least(len(title_terms), len(terms)), 1)) end, 0), 6)::double as symbol
        from ct),
    ranking as (select *, row_number() over (partition by query_id order by vector desc, item_id) as rank from c)
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("score").cast("double")
    hits = table(spark, d, "search_items").where("path is not null").select("request_id", "hit_id", "path", "title", "score").distinct()
    asked = table(spark, d, "search_requests").where("query is not null").select("request_id", t.query_terms(F.col("query")).alias("terms")).distinct()
    joined = hits.join(asked, "request_id", "left")
    covered = F.try_divide(F.size(F.array_intersect("terms", t.identifier_tokens(F.col("path")))), F.size("terms"))
    return joined.select(
        F.col("request_id").alias("query_id"),
        F.col("hit_id").alias("item_id"),
        "path",
        F.substring_index("path", "/", 1).alias("kind"),
        F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.round(score, 6)).alias("vector"),
        F.round(F.coalesce(F.when(F.col("terms").isNotNull(), covered), F.lit(0.0)), 6).alias("lexical"),
        F.round(F.coalesce(F.when(F.col("terms").isNotNull(), lexical.symbol_match(t.identifier_tokens(F.col("title")), F.col("terms"))), F.lit(0.0)), 6).alias("symbol"),
    )


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranked(candidates(spark, d), ["query_id"], [F.col("vector").desc(), F.col("item_id")])


@register(
    "minmax_norm",
    CANDIDATES
    + "select query_id, item_id, round(case when max(vector) over w > min(vector) over w then (vector - min(vector) over w) / (max(vector) over w - min(vector) over w) else 1 end, 6) as scaled from c window w as (partition by query_id)",
)
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(candidates(spark, d).select("query_id", "item_id", fusion.minmax(F.col("vector"), ["query_id"]).alias("scaled")))


@register(
    "weighted_fusion",
    CANDIDATES
    + """, f as (select query_id, item_id, round(vector * 0.5625::double + lexical * 0.1875::double + symbol * 0.25::double + 1e-10, 6) as total, vector, path from c),
    r as (select *, row_number() over (partition by query_id order by total desc, vector desc, path desc, item_id) as rank from f) select query_id, item_id, rank, total from r where rank <= 10""",
)
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = candidates(spark, d).withColumn("total", F.round(fusion.weighted_sum({"vector": 0.5625, "lexical": 0.1875, "symbol": 0.25}) + 1e-10, 6))  # halves are rounded up
    return ranked(fused, ["query_id"], [F.col("total").desc(), F.col("vector").desc(), F.col("path").desc(), F.col("item_id")], 10).select("query_id", "item_id", "rank", "total")


RRF = CANDIDATES + """,
    u as (select query_id, item_id, path, 'vector' as signal, vector as v, 0.6 as w from c union all select query_id, item_id, path, 'lexical', lexical, 0.3 from c union all select query_id, item_id, path, 'symbol', symbol, 0.1 from c),
    r as (select *, row_number() over (partition by query_id, signal order by v desc, path desc, item_id desc) as rank from u where v > 0)
    select query_id, item_id, round(sum(w / (60 + rank)), 6) as score from r group by all
"""


@register("rrf_fusion", RRF)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.rrf(candidates(spark, d), {"vector": 0.6, "lexical": 0.3, "symbol": 0.1}).select("query_id", "item_id", "score"))


@register(
    "file_vote",
    CANDIDATES
    + """, n as (select *, row_number() over (partition by query_id, path order by vector desc, item_id) as rn from c), v as (select query_id, path, sum(vector * pow(0.5, rn - 1)) as vote from n where rn <= 4 group by all)
    select query_id, path, round(case when max(vote) over w > min(vote) over w then (vote - min(vote) over w) / (max(vote) over w - min(vote) over w) else 1 end, 6) as file_vote from v window w as (partition by query_id)""",
)
def file_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.file_votes(candidates(spark, d), "vector").select("query_id", "path", "file_vote"))


@register(
    "family_penalty",
    CANDIDATES
    + "select query_id, item_id, round(case when symbol > 0 and count(*) over (partition by query_id, symbol) >= 3 then symbol * 3 / count(*) over (partition by query_id, symbol) else symbol end, 6) as symbol_damped from c",
)
def family_penalty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.family_penalty(candidates(spark, d), "symbol").select("query_id", "item_id", "symbol_damped"))


@register(
    "per_path_cap",
    CANDIDATES + ", k as (select *, row_number() over (partition by query_id, path order by rank) as rn from ranking) select query_id, item_id, row_number() over (partition by query_id order by rank) as rank from k where rn <= 1",
)
def per_path_cap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cap_per_path(ranking(spark, d), 1).select("query_id", "item_id", "rank")


DIRS = CANDIDATES + ", k as (select *, regexp_replace(path, '/[^/]*$', '') as dir, row_number() over (partition by query_id, regexp_replace(path, '/[^/]*$', '') order by rank) as n, min(rank) over (partition by query_id, regexp_replace(path, '/[^/]*$', '')) as f from ranking)"


@register("directory_cap", DIRS + ", r as (select query_id, item_id, row_number() over (partition by query_id order by (n > 2)::int, rank) as rank from k) select * from r where rank <= 10")
def directory_cap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.directory_cap(ranking(spark, d), 2, 10).select("query_id", "item_id", "rank")


@register("round_robin_directories", DIRS + ", r as (select query_id, item_id, row_number() over (partition by query_id order by n, f) as rank from k) select * from r where rank <= 10")
def round_robin_directories(spark: SparkSession, d: str) -> DataFrame:
    return fusion.round_robin(ranking(spark, d), 10).select("query_id", "item_id", "rank")


@register(
    "preserve_top",
    CANDIDATES
    + """, l as (select *, row_number() over w as place, lead(lexical) over w as second from ranking window w as (partition by query_id order by lexical desc, item_id)),
    k as (select *, case when place = 1 and (second is null or lexical - second >= 0.03) then 0 else rank end as key from l)
    select query_id, item_id, row_number() over (partition by query_id order by key) as rank from k""",
)
def preserve_top(spark: SparkSession, d: str) -> DataFrame:
    return fusion.preserve_top(ranking(spark, d), "lexical", 0.03).select("query_id", "item_id", "rank")


@register(
    "preserve_kind_tops",
    CANDIDATES
    + """, k as (select *, row_number() over (partition by query_id, kind order by lexical desc, item_id) <= 1 as kept, rank <= 10 as inside from ranking),
    m as (select *, count(*) filter (kept and not inside) over w as missing, count(*) filter (inside) over w as size, count(*) filter (inside and not kept) over (partition by query_id order by rank desc) as from_end from k window w as (partition by query_id)),
    s as (select * from m where case when inside then kept or from_end > greatest(0, size + missing - 10) else kept end),
    r as (select query_id, item_id, row_number() over (partition by query_id order by (not inside)::int, case when inside then rank end, lexical desc, item_id) as rank from s)
    select * from r where rank <= 10""",
)
def preserve_kind_tops(spark: SparkSession, d: str) -> DataFrame:
    return fusion.preserve_kind_tops(ranking(spark, d), "lexical", 1, 10).select("query_id", "item_id", "rank")


TIES = CANDIDATES + """,
    g as (select *, case when lag(vector) over w - vector > 0.03 then 1 else 0 end as b from c window w as (partition by query_id order by vector desc, item_id)),
    s as (select *, sum(b) over (partition by query_id order by vector desc, item_id rows unbounded preceding) as band from g)
    select query_id, item_id, band, row_number() over (partition by query_id order by band, lexical desc, item_id) as rank from s
"""


@register("tie_bands", TIES)
def tie_bands(spark: SparkSession, d: str) -> DataFrame:
    return fusion.tie_bands(ranking(spark, d), "vector", "lexical", 0.03).select("query_id", "item_id", F.col("band").cast("long").alias("band"), "rank")


@register(
    "quota_mix",
    CANDIDATES
    + ", k as (select *, row_number() over (partition by query_id, kind order by rank) as n from ranking), r as (select query_id, item_id, row_number() over (partition by query_id order by (n > case kind when 'src' then 3 when 'lib' then 2 when 'core' then 2 else 0 end)::int, rank) as rank from k) select * from r where rank <= 10",
)
def quota_mix(spark: SparkSession, d: str) -> DataFrame:
    return fusion.quota_mix(ranking(spark, d), "kind", {"src": 3, "lib": 2, "core": 2}, 10).select("query_id", "item_id", "rank")


# Lists of one query text from several requests: variants, probes and two collections.

RUNS = CANDIDATES + """,
    q as (select distinct request_id, query, strategy from search_requests where query is not null),
    v as (select query, min(request_id) over (partition by query) as qid, request_id, dense_rank() over (partition by query order by request_id) - 1 as variant from (select distinct request_id, query from q)),
    runs as (select v.qid as query_id, variant, item_id, path, vector as score, rank from ranking join v on v.request_id = ranking.query_id)
"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """The lists of every query text: variant 0 is that of its first request."""
    asked = table(spark, d, "search_requests").where("query is not null").select("request_id", "query").distinct()
    # Requests of one text are few beside its hits; they are numbered by a ranking over the text.
    numbered = ranked(asked, ["query"], [F.col("request_id")], None, "n")
    first = asked.groupBy("query").agg(F.min("request_id").alias("qid"))
    lists = numbered.join(first, "query").select("request_id", "qid", (F.col("n") - 1).alias("variant"))
    return ranking(spark, d).join(lists, F.col("query_id") == F.col("request_id")).select(F.col("qid").alias("query_id"), "variant", "item_id", "path", F.col("vector").alias("score"), "rank")


PATHS = ", f as (select *, row_number() over (partition by query_id, variant, path order by rank, item_id) as o from runs), p as (select query_id, variant, path, score, row_number() over (partition by query_id, variant order by rank, item_id) as rank from f where o = 1)"


@register(
    "multi_query_rrf",
    RUNS
    + PATHS
    + """, s as (select query_id, path, sum((case when variant = 0 then 1.5 else 1.0 end) / (60 + rank)) as score from p group by all),
    r as (select query_id, path, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, path desc) as rank from s) select * from r where rank <= 10""",
)
def multi_query_rrf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.multi_query_rrf(runs(spark, d), original_weight=1.5))


@register(
    "probe_merge",
    RUNS
    + """, m as (select *, score + 1 / rank + 0.05 / (variant + 1) as merged, regexp_replace(trim(path), '^[./]+', '') as key from runs),
    b as (select *, row_number() over (partition by query_id, key order by round(merged, 9) desc, variant, rank, item_id) as o from m),
    r as (select query_id, item_id, round(merged, 6) as merged, row_number() over (partition by query_id order by round(merged, 9) desc, key) as rank from b where o = 1) select * from r where rank <= 10""",
)
def probe_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.probe_merge(runs(spark, d).withColumnRenamed("variant", "probe"), 10).select("query_id", "item_id", "merged", "rank"))


def _dual_sql(mode: str) -> str:
    if mode == "union":
        body = "x as (select query_id, path, score, 0 as side, rank from p where variant = 0 union all select query_id, path, score, 1, rank from p b where variant = 1 and not exists (select 1 from p a where a.variant = 0 and a.query_id = b.query_id and a.path = b.path)), r as (select query_id, path, score, row_number() over (partition by query_id order by side, rank) as rank from x)"
    else:
        value = "sum(1 / (60 + rank))" if mode == "rrf" else "max(score)"
        body = f"x as (select query_id, path, {value} as score from p where variant <= 1 group by all), r as (select query_id, path, score, row_number() over (partition by query_id order by round(score, 9) desc, path) as rank from x)"
    return RUNS + PATHS + f", {body} select query_id, path, round(score, 6) as score, rank from r where rank <= 10"


def _dual(spark: SparkSession, d: str, mode: str) -> DataFrame:
    lists = runs(spark, d)
    return rounded(fusion.dual(lists.where("variant = 0"), lists.where("variant = 1"), mode, 10).select("query_id", "path", "score", "rank"))


for _mode in ("rrf", "max", "union"):
    register(f"dual_{_mode}", _dual_sql(_mode))(lambda spark, d, mode=_mode: _dual(spark, d, mode))


# Graphs over the files.

_FAMILY = " ".join(f"when regexp_matches(path, '[.]({'|'.join(v)})$') then '{k}'" for k, v in graph.FAMILIES.items())
_IMPORT_LINES = " union all ".join(
    f"select path as src, family, parts, '{how}' as how, unnest(list_distinct(regexp_extract_all(content, '" + p.replace("'", "''").replace('\\"', '"') + f"', 1))) as name from known where family = '{how.removesuffix('_relative')}'" for how, p in graph.IMPORTS.items()
)
EDGES_SQL = r"""
    with recursive known as (
        select path, content, case FAMILY end as family, regexp_replace(path, '\.[^./]*$', '') as stem, case when contains(path, '/') then string_split(regexp_replace(path, '/[^/]*$', ''), '/') else [] end as parts from code_items where contains(path, '.')),
    lines as (PATTERNS),
    wanted as (
        select distinct src, family, unnest(case family when 'python' then [stem, stem || '/__init__'] when 'script' then [stem, stem || '/index'] else [stem] end) as stem from (
            select src, family, case how
                when 'python_relative' then concat_ws('/', nullif(array_to_string(parts[1:greatest(len(parts) - (length(name) - length(ltrim(name, '.')) - 1), 0)], '/'), ''), nullif(replace(ltrim(name, '.'), '.', '/'), ''))
                when 'python' then replace(name, '.', '/')
                when 'script' then concat_ws('/', nullif(array_to_string(parts[1:greatest(len(parts) - len(regexp_extract_all(name, '\.\./')), 0)], '/'), ''), nullif(regexp_replace(name, '^(?:\.{1,2}/)+', ''), ''))
                else concat_ws('/', nullif(array_to_string(parts, '/'), ''), regexp_replace(name, '\.[^./]*$', '')) end as stem
            from lines where how <> 'jvm')),
    tried as (select src, name, i as pos, array_to_string(p[1:i], '/') as tail from (select src, name, string_split(name, '.') as p, unnest(range(1, len(string_split(name, '.')) + 1)) as i from lines where how = 'jvm') where regexp_matches(p[i], '^[A-Z]')),
    met as (select tried.*, path as dst, max(pos) over (partition by src, name) as furthest from tried join known on family = 'jvm' and (stem = tail or ends_with(stem, '/' || tail))),
    e as (select *, row_number() over (partition by src order by dst) as rn from (
        select src, path as dst from wanted join known using (family, stem) where src <> path union select src, dst from met where pos = furthest and src <> dst)),
    named as (select distinct path as src, unnest(regexp_extract_all(content, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)) as title from code_items),
    y as (select *, row_number() over (partition by src order by dst) as rn from (select distinct src, path as dst from named join code_items using (title) where src <> path)),
    imports as (select src, dst, 'imports' as kind, 0.8::double as weight from e where rn <= 64),
    declared as (select distinct path as dst, unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)', 1)) as name from code_items where code_language = 'python'),
    called as (select * from (select distinct path as src, unnest(regexp_extract_all(content, '\b([A-Za-z_]\w*)\(', 1)) as name from code_items where code_language = 'python') c where not exists (select 1 from declared d where d.dst = c.src and d.name = c.name)),
    near_calls as (select c.src, c.name, min(d.dst) as dst from called c join imports i on i.src = c.src join declared d on d.dst = i.dst and d.name = c.name group by all),
    chosen as (select distinct c.src, coalesce(n.dst, f.dst) as dst from called c join (select name, min(dst) as dst from declared group by name) f using (name) left join near_calls n on n.src = c.src and n.name = c.name),
    calls as (select src, dst, 'calls' as kind, 0.9::double as weight from (select *, row_number() over (partition by src order by dst) as rn from chosen where src <> dst) where rn <= 20),
    edges as (select * from imports union all select src, dst, 'references' as kind, 0.7::double as weight from y where rn <= 24 union all select * from calls),
    adj as (select src, dst, max(w) as weight from (select src, dst, weight as w from edges union all select dst, src, weight * 0.7::double from edges) group by all)
""".replace("FAMILY", _FAMILY).replace("PATTERNS", _IMPORT_LINES)


def edges(spark: SparkSession, d: str) -> DataFrame:
    files = items(spark, d)
    imports = graph.import_edges(files)
    return graph.all_edges(imports, graph.symbol_edges(files), graph.call_edges(files, imports))


@register("call_edges", EDGES_SQL + "select src, dst, kind, weight from calls")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    files = items(spark, d)
    return graph.call_edges(files, graph.import_edges(files))


@register("import_edges", EDGES_SQL + "select src, dst, kind, weight from imports")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(items(spark, d))


@register("file_edges", EDGES_SQL + "select src, dst, kind, weight from edges")
def file_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@register(
    "reference_edges",
    r"""
    with n as (select distinct path as src, unnest(regexp_extract_all(content, '((?:[\w-]+/)+[\w-]+\.[a-z]{1,4})', 1)) as suffix from code_items),
    m as (select src, suffix, path as dst, row_number() over (partition by src, suffix order by length(path), path) as b from n join code_items on path = suffix or ends_with(path, '/' || suffix)),
    e as (select *, row_number() over (partition by src order by dst) as rn from (select distinct src, dst from m where b = 1 and src <> dst))
    select src, dst, 'references' as kind, 0.85 as weight from e where rn <= 24""",
)
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.reference_edges(items(spark, d))


@register("graph_adjacency", EDGES_SQL + "select src, dst, round(weight, 6) as weight from adj")
def graph_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.adjacency(edges(spark, d)))


@register("fan_in", EDGES_SQL + "select dst, count(distinct src) as fan_in from edges group by dst")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.fan_in(edges(spark, d))


SEEDS = """
    , seeds as (select request_id as query_id, path, max(score::double) as score from search_items where score is not null and not isnan(score) and score > 0 and path is not null group by all)
"""


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """All files that a query found with a positive score."""
    hits = table(spark, d, "search_items").where("score > 0 and not isnan(score) and path is not null")
    return hits.groupBy(F.col("request_id").alias("query_id"), "path").agg(F.max(F.col("score").cast("double")).alias("score"))


@register(
    "propagate_hops",
    EDGES_SQL
    + SEEDS
    + """, near as (select src, dst, weight from (select *, row_number() over (partition by src order by round(weight, 9) desc, dst) as n from adj) where n <= 40),
    s120 as (select query_id, path, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, path) as n from seeds) where n <= 120),
    h1 as (select query_id, dst as path, max(score * weight * 0.65) as score from s120 join near on path = src group by all),
    f1 as (select query_id, path, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, path) as n from h1) where n <= 40),
    h2 as (select query_id, dst as path, max(score * weight * 0.65 * 0.65) as score from f1 join near on path = src group by all)
    select query_id, path, round(max(score), 6) as score from (select * from h1 union all select * from h2) group by all""",
)
def propagate_hops(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.propagate(graph.adjacency(edges(spark, d)), seeds(spark, d)))


@register(
    "expand_hops",
    EDGES_SQL
    + SEEDS
    + """, h1 as (select query_id, dst as path, max(score * weight) as score from seeds join adj on path = src group by all),
    b1 as (select h1.* from h1 left join seeds s using (query_id, path) where s.score is null or round(h1.score, 9) > round(s.score, 9)),
    f1 as (select query_id, path, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, path) as n from b1) where n <= 40),
    h2 as (select query_id, dst as path, max(score * weight * 0.72) as score from f1 join adj on path = src group by all)
    select query_id, path, round(max(score), 6) as score from (select * from h1 union all select * from h2) group by all""",
)
def expand_hops(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.expand(checkpoint(graph.adjacency(edges(spark, d))), seeds(spark, d)))


@register(
    "typed_neighbors",
    EDGES_SQL
    + SEEDS
    + """, b as (select path, neighbour, max(w) as weight from (select src as path, dst as neighbour, weight * case kind when 'imports' then 1.0::double else 0.9::double end as w from edges union all select dst, src, weight * case kind when 'imports' then 0.5::double else 0.4::double end from edges) group by all),
    r as (select query_id, path, neighbour, weight, row_number() over (partition by query_id, path order by round(weight, 9) desc, neighbour) as rank from seeds join b using (path))
    select query_id, path, neighbour, round(weight, 6) as weight, rank from r where rank <= 3""",
)
def typed_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.typed_neighbours(edges(spark, d), seeds(spark, d), {"imports": 1.0, "references": 0.9, "calls": 0.9}, {"imports": 0.5, "references": 0.4, "calls": 0.4}, 3))


SPANS = "s as (select distinct hit_id, path, start_line, end_line from search_items where path is not null and start_line is not null and end_line is not null)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """All distinct spans with a path and lines."""
    found = table(spark, d, "search_items").where("path is not null and start_line is not null and end_line is not null")
    return found.select("hit_id", "path", "start_line", "end_line").distinct()


@register("next_in_file", f"with {SPANS}, n as (select hit_id as src, lead(hit_id) over (partition by path order by start_line, end_line, hit_id) as dst from s) select src, dst from n where dst is not null")
def next_in_file(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_in_file(_spans(spark, d), "hit_id")


@register(
    "containment_range",
    f"with {SPANS} select a.hit_id as src, b.hit_id as dst from s a join s b on a.path = b.path and a.hit_id <> b.hit_id and a.start_line <= b.start_line and b.end_line <= a.end_line and a.end_line - a.start_line > b.end_line - b.start_line",
)
def containment_range(spark: SparkSession, d: str) -> DataFrame:
    return graph.contains(_spans(spark, d), "hit_id")


@register(
    "summary_edges",
    f"with {SPANS}, r as (select *, row_number() over (partition by path order by start_line, hit_id) as rank from s) select path as src, hit_id as dst, 'summarizes' as kind, 0.7::double as weight from r where rank <= 80",
)
def summary_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary_edges(_spans(spark, d), "hit_id")


# Reranking and routing.

NAMES = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(split_part(path, '/', -1), '\.[^.]*$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[_.\s-]+'), lambda x: x <> '')"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
ROLE = f"""
    (case when list_contains({_list(rerank.OTHER_SUFFIXES)}, lower('.' || split_part(split_part(path, '/', -1), '.', -1))) then -1.0
    when len(list_intersect(string_split(lower(case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end), '/'), {_list(rerank.TEST_DIRECTORIES)})) > 0 then -0.75
    when list_contains({_list(rerank.HUB_NAMES)}, {NAMES}[-1]) then 1.0 when list_contains({_list(rerank.EDGE_NAMES)}, {NAMES}[-1]) then -0.5
    when len(list_intersect({NAMES}, {_list(rerank.EDGE_NAMES)})) > 0 then -0.5 when len(list_intersect({NAMES}, {_list(rerank.HUB_NAMES)})) > 0 then 1.0 else 0.0 end)"""


@register("hub_role_prior", f"select path, {ROLE}::double as role from code_items")
def hub_role_prior(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("path", rerank.role_prior(F.col("path")).alias("role"))


@register(
    "hub_prior",
    EDGES_SQL
    + f""", fi as (select dst as path, count(distinct src) as fan_in from edges group by all), c as (select distinct request_id as query_id, path from search_items where path is not null),
    j as (select query_id, path, coalesce(fan_in, 0) as fan_in from c left join fi using (path))
    select query_id, path, round(0.1 * {ROLE} + 0.05 * case when max(fan_in) over (partition by query_id) > 0 then ln(1 + fan_in) / ln(1 + max(fan_in) over (partition by query_id)) else 0 end, 6) as prior from j""",
)
def hub_prior(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "search_items").where("path is not null").select(F.col("request_id").alias("query_id"), "path").distinct()
    joined = pairs.join(graph.fan_in(edges(spark, d)).withColumnRenamed("dst", "path"), "path", "left")
    return rounded(rerank.hub_prior(joined, 0.1, 0.05).select("query_id", "path", "prior"))


@register("logit_clamp", CANDIDATES + "select query_id, item_id, round(ln(greatest(1e-7, least(1 - 1e-7, vector)) / (1 - greatest(1e-7, least(1 - 1e-7, vector)))), 6) as logit from c")
def logit_clamp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(candidates(spark, d).select("query_id", "item_id", rerank.logit(F.col("vector")).alias("logit")))


@register("second_pass_merge", CANDIDATES + "select query_id, item_id, round(case when vector < 0.3 and rank <= 24 then greatest(vector, lexical) else vector end, 6) as final from ranking")
def second_pass_merge(spark: SparkSession, d: str) -> DataFrame:
    first = ranking(spark, d).withColumnRenamed("vector", "score")
    again = candidates(spark, d).where("vector < 0.3").withColumnRenamed("lexical", "score")
    return rounded(rerank.second_pass(first, again, 0.3, 24).select("query_id", "item_id", "final"))


@register(
    "score_margin",
    CANDIDATES + "select query_id, round(max(vector) filter (rank = 1), 6) as top, round(max(vector) filter (rank = 1) - max(vector) filter (rank = 5), 6) as margin from ranking group by query_id",
)
def score_margin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rerank.margin(ranking(spark, d), "vector", 5))


@register(
    "list_features",
    CANDIDATES
    + """, s as (select *, sum(vector) filter (rank <= 10 and vector > 0) over w as total from ranking window w as (partition by query_id)),
    p as (select *, case when rank <= 10 and vector > 0 and total > 0 then vector / total end as share from s)
    select query_id, item_id, rank, round(max(vector) over w - vector, 6) as gap, round(1 / rank, 6) as reciprocal_rank, round(avg(vector) filter (rank <= 10) over w, 6) as top_mean,
        round(coalesce(stddev_pop(vector) filter (rank <= 10) over w, 0), 4) as top_deviation, round(coalesce(-sum(share * ln(share)) over w, 0), 6) as top_entropy from p window w as (partition by query_id)""",
)
def list_features(spark: SparkSession, d: str) -> DataFrame:
    features = rerank.list_features(ranking(spark, d), "vector")
    return rounded(features.withColumn("top_deviation", F.round("top_deviation", 4)))


@register(
    "path_features",
    "select path, (length(path) - length(replace(path, '/', ''))) as depth, length(split_part(path, '/', -1)) as name_length, contains(lower(path), 'test')::int as is_test, (lower(split_part(path, '.', -1)) = 'java')::int as is_java, "
    "(lower(split_part(path, '.', -1)) in ('kt', 'kts'))::int as is_kotlin, (lower(split_part(path, '.', -1)) = 'xml')::int as is_xml, (lower(split_part(path, '.', -1)) in ('md', 'markdown'))::int as is_markdown from code_items",
)
def path_features(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("path", *rerank.path_features(F.col("path")))


MODEL = """feature_names=vector lexical symbol
Tree=0
split_feature=0 1
threshold=0.4 0.05
left_child=1 -2
right_child=-1 -3
leaf_value=0.5 -0.2 0.1
Tree=1
split_feature=2
threshold=0.08
left_child=-1
right_child=-2
leaf_value=0.05 -0.05
"""


@register("tree_ensemble", CANDIDATES + "select query_id, item_id, round(case when vector <= 0.4 then case when lexical <= 0.05 then -0.2 else 0.1 end else 0.5 end + case when symbol <= 0.08 then 0.05 else -0.05 end, 6) as score from c")
def tree_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(candidates(spark, d).select("query_id", "item_id", rerank.tree_model(MODEL).alias("score")))


_words = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"
ROUTES = f"""
    with {ASKED}
    raw as (select distinct query_id, unnest({TOKENS_A.format("query")}) as term from asked),
    f as (select query_id, bool_or(term in {_words(routing.WORKFLOW_WORDS)}) as tw, bool_or(term in {_words(routing.PATH_WORDS + routing.SYMBOL_WORDS)}) as tp from terms group by all),
    w as (select query_id, bool_or(term in {_words(routing.RAW_WORKFLOW_WORDS)}) as rw from raw group by all)
    select query_id, case when coalesce(tw, false) or coalesce(rw, false) then 'workflow'
        when coalesce(tp, false) or regexp_matches(query, '[/\\\\]|(?:^|\\s)[A-Za-z0-9_-]+\\.({'|'.join(routing.FILE_SUFFIXES)})\\b') or regexp_matches(query, '\\b[A-Za-z_][A-Za-z0-9_]*[A-Z_][A-Za-z0-9_]*\\b') then 'path_symbol' else 'semantic' end as route
    from asked left join f using (query_id) left join w using (query_id)
"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_requests").where("query is not null").groupBy("query").agg(F.min("request_id").alias("query_id"))


@register("query_routes", ROUTES)
def query_routes(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", routing.route(F.col("query")).alias("route"))


@register("query_variants")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.posexplode(routing.variants(F.col("query"))).alias("variant", "text"))


_SCOPE = "|".join(routing.SCOPES)
_WORDS = lambda words: "|".join(words)
_BARE = r"regexp_replace(regexp_replace(trim(query), '[?\s]+$', ''), '\s+', ' ', 'g')"
_OPENED = f"regexp_replace({_BARE}, '(?i)^(?:{_WORDS(routing.QUESTION_WORDS)}) (?:(?:{_WORDS(routing.QUESTION_VERBS)})(?: |$))?(?:i find(?: |$))?(?:(?:{_WORDS(routing.ARTICLES)})(?: |$))?', '')"
STATEMENT = f"regexp_replace({_OPENED}, '(?i)(.) in the (?:{_SCOPE})$', '\\1')"


@register("query_statements", f"select min(request_id) as query_id, {STATEMENT} as statement from search_requests where query is not null group by query")
def query_statements(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", routing.statement(F.col("query")).alias("statement"))

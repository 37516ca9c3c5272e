"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.llm import defects, encode, format_copies, garbled, handwritten, overlap, packing, percentiles, top_items
from sieveloom.plans.runtime import checkpoint
from sieveloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


# 1: the same records across splits


def _all_cases(spark: SparkSession, d: str) -> DataFrame:
    return overlap.records(table(spark, d, "eval_cases"), "query").unionByName(overlap.records(table(spark, d, "answer_cases"), "question"))


@register("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(_all_cases(spark, d))
    return pairs.select(F.least("held_out_id", "train_id").alias("record_a"), F.greatest("held_out_id", "train_id").alias("record_b"))


@register("p1_by_split_and_source")
def p1_by_split_and_source(spark: SparkSession, d: str) -> DataFrame:
    return overlap.by_split_and_source(_all_cases(spark, d))


# 2: percentiles of large numeric columns

METRIC_GROUP = ["strategy", "suite", "metric_name"]
PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@register("p2_percentiles")
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """By day, and over all days (day is null) from the sketches of the days."""
    rows = table(spark, d, "metric_rows").withColumn("day", F.to_date("event_time"))
    daily = checkpoint(percentiles.sketch(rows, ["day", *METRIC_GROUP], "metric_value"))
    days = percentiles.percentiles(daily.where("day is not null"), ["day", *METRIC_GROUP], PERCENTILES)
    whole = percentiles.percentiles(percentiles.combine(daily, METRIC_GROUP), METRIC_GROUP, PERCENTILES)
    return days.unionByName(whole, allowMissingColumns=True)


@register("p2_overall")
def p2_overall(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows at once."""
    sketches = percentiles.sketch(table(spark, d, "metric_rows"), METRIC_GROUP, "metric_value")
    return percentiles.percentiles(sketches, METRIC_GROUP, PERCENTILES)


@register(
    "p2_within_bound",
    """
    with g as (
        select strategy, suite, metric_name, count(*) filter (metric_value is not null and not isnan(metric_value)) as n,
            count(*) filter (metric_value is null) as n_null, count(*) filter (isnan(metric_value)) as n_nan
        from metric_rows group by all)
    select strategy, suite, metric_name, n, n_null, n_nan, p, true as within
    from g, (values (0.01), (0.05), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) t(p)
    """,
)
def p2_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact rank of every reported percentile keeps to its stated error, counted over all rows."""
    rows = table(spark, d, "metric_rows")
    found = percentiles.percentiles(percentiles.sketch(rows, METRIC_GROUP, "metric_value", size=512), METRIC_GROUP, PERCENTILES)
    ranked = rows.where("metric_value is not null and not isnan(metric_value)").select(*METRIC_GROUP, "metric_value")
    same = F.lit(True)
    for c in METRIC_GROUP:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}"))
    counted = (
        found.alias("f")
        .join(ranked.alias("r"), same, "left")
        .groupBy(*(F.col(f"f.{c}").alias(c) for c in METRIC_GROUP), "f.n", "f.n_null", "f.n_nan", "f.p", "f.value", "f.max_rank_error")
        .agg(F.count_if(F.col("metric_value") < F.col("value")).alias("below"), F.count_if(F.col("metric_value") <= F.col("value")).alias("upto"))
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n")))
    within = (F.col("n") == 0) | ((F.col("below") + 1 - F.col("max_rank_error") <= wanted) & (wanted <= F.col("upto") + F.col("max_rank_error")))
    return counted.select(*METRIC_GROUP, "n", "n_null", "n_nan", "p", within.alias("within"))


# 3: broken prompt and response pairs


@register("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "answer_outcomes"), table(spark, d, "documents").select("text", "lang"))


# 4: top N items within every group

TOP_HITS = """
    with asked as (select distinct request_id, query from search_requests where query is not null),
    hits as (select distinct hit_id, request_id, path, score from search_items where score is not null and not isnan(score)),
    ranked as (
        select query, row_number() over (partition by query order by score desc, path nulls first, hit_id) as position, hit_id, path, score
        from hits join asked using (request_id))
"""


@register("p4_found", TOP_HITS + "select hit_id from ranked where position <= 10")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items.best_hits(table(spark, d, "search_requests"), table(spark, d, "search_items"), with_query=False).select("hit_id")


@register("p4_best_hits", TOP_HITS + "select query, position, hit_id, path, score from ranked where position <= 10")
def p4_best_hits(spark: SparkSession, d: str) -> DataFrame:
    return top_items.best_hits(table(spark, d, "search_requests"), table(spark, d, "search_items"))


# 5: files that nobody wrote by hand


@register("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "code_items"), table(spark, d, "library_files")).select("item_id")


@register("p5_own_source")
def p5_own_source(spark: SparkSession, d: str) -> DataFrame:
    """What remains as a project's own source, by language."""
    files = table(spark, d, "code_items")
    others = handwritten.not_handwritten(files, table(spark, d, "library_files"))
    marked = files.join(others, "item_id", "left")
    return marked.groupBy("code_language", F.coalesce("kind", F.lit("own")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("characters"))


# 6: duplicates hidden by formatting

CANONICAL_CASES = r"""
    with canonical as (
        select record_id,
            regexp_replace(replace(lower(coalesce(id, '')), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') as i,
            regexp_replace(replace(lower(coalesce(query, '')), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') as q,
            list_sort(coalesce(expected, [])) as e,
            list_sort(list_transform(json_keys(metadata_json), lambda k: k || ':' || json_extract_string(metadata_json, '$."' || k || '"'))) as m
        from eval_cases),
    grouped as (select record_id, min(record_id) over (partition by i, q, e, m) as kept_id from canonical)
"""


@register("p6_found", CANONICAL_CASES + "select kept_id, record_id from grouped where kept_id < record_id")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select("record_id", "id", "query", "expected", "metadata_json")
    return format_copies.copies(cases, format_copies.canonical_case(cases))


@register("p6_collapsed", CANONICAL_CASES + "select kept_id as record_id, count(*) as copies from grouped group by kept_id")
def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select("record_id", "id", "query", "expected", "metadata_json")
    return format_copies.collapsed(cases, format_copies.canonical_case(cases))


# 7: the corpus as ids of a public vocabulary


@register("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


@register("p7_round_trip", "select doc_id, text is null as absent, true as same from documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of every text give the text back."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    decoded = encode.encode(documents).select("doc_id", encode.decode(F.col("ids")).alias("decoded"))
    joined = documents.join(decoded, "doc_id")
    return joined.select("doc_id", F.col("text").isNull().alias("absent"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


# 8: fixed-capacity containers

CAPACITY, TIERS = 2048, (256, 1024)


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, d, "documents")), CAPACITY, tiers=TIERS)


@register("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _containers(spark, d)


@register("p8_step_groups")
def p8_step_groups(spark: SparkSession, d: str) -> DataFrame:
    """Containers, use of their room and cost by step group."""
    packed = _containers(spark, d).where("container is not null")
    return packed.groupBy("step_group").agg(
        F.countDistinct("container").alias("containers"), (F.sum("length") / (F.countDistinct("container") * CAPACITY)).alias("used"), F.sum(F.col("length") * F.col("length")).alias("cost")
    )


@register(
    "p8_whole",
    "select doc_id, true as whole, true as within, true as cut_only_above from documents",
)
def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """By document: whether its pieces add up to its tokens, lie in containers that are not overfull, and are more than one only above the capacity."""
    sizes = encode.token_counts(table(spark, d, "documents"))
    packed = checkpoint(packing.pack(sizes, CAPACITY, tiers=TIERS))
    full = packed.where("container is not null").groupBy("container").agg(F.sum("length").alias("held"), F.max(F.col("offset") + F.col("length")).alias("end"))
    placed = packed.join(full, "container", "left")
    fits = F.coalesce((F.col("held") <= CAPACITY) & (F.col("end") == F.col("held")), F.col("length") == 0)
    own = placed.groupBy("doc_id").agg(F.sum("length").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.bool_and(fits).alias("within"))
    n = F.coalesce("n_tokens", F.lit(0))
    return sizes.join(own, "doc_id").select("doc_id", (F.col("placed") == n).alias("whole"), "within", (F.col("pieces") == F.greatest(F.lit(1), F.ceil(n / CAPACITY))).alias("cut_only_above"))


# 9: garbled text


@register("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents")).select("doc_id")


@register("p9_restored")
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"))

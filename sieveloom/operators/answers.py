"""Answers and documentation: grounding of citations, pairwise comparison, rounds, texts for embedding, document outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import hash_share
from sieveloom.operators.lexical import ranked

CITATIONS = "struct<answer:string,citations:array<struct<path:string>>,confidence:double>"


def cited_paths(raw: Column) -> Column:
    """The distinct cited paths of a raw JSON prediction, in a fence or not; null where it is no JSON object.

    What stands behind the object is ignored.
    """
    body = F.trim(F.regexp_replace(F.trim(raw), r"^```\w*\s*|\s*```$", ""))
    parsed = F.from_json(F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), body), CITATIONS)
    return F.array_distinct(F.filter(F.transform(parsed["citations"], lambda c: c["path"]), lambda p: p.isNotNull()))


def grounding(outcomes: DataFrame, by: str) -> DataFrame:
    """Per group: answers, those that parse, cited paths, and the shares of citations that were retrieved and expected.

    ``outcomes`` has raw_prediction, retrieved_files and expected.
    """
    cited = outcomes.withColumn("_cited", cited_paths(F.col("raw_prediction")))
    inside = lambda other: F.size(F.array_intersect("_cited", F.coalesce(other, F.array().cast("array<string>"))))
    n = F.sum(F.coalesce(F.when(F.col("_cited").isNotNull(), F.size("_cited")), F.lit(0)))
    return cited.groupBy(by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count("_cited").alias("parsed"),
        n.alias("citations"),
        F.try_divide(F.sum(F.when(F.col("_cited").isNotNull(), inside("retrieved_files"))), n).alias("retrieved_share"),
        F.try_divide(F.sum(F.when(F.col("_cited").isNotNull(), inside("expected"))), n).alias("expected_share"),
    )


def pairwise(outcomes: DataFrame, case: str, arm: str, value: str) -> DataFrame:
    """Every pair of arms over their common cases by mean value: wins of each, ties, share of decided cases the first wins."""
    means = outcomes.where(F.col(value).isNotNull()).groupBy(case, arm).agg(F.round(F.avg(value), 9).alias("v"))
    a, b = means.select(case, F.col(arm).alias("a"), F.col("v").alias("va")), means.select(case, F.col(arm).alias("b"), F.col("v").alias("vb"))
    both = a.join(b, case).where("a < b")  # arms are a handful; a case meets itself once per pair of arms
    counted = both.groupBy("a", "b").agg(F.count_if(F.col("va") > F.col("vb")).alias("a_wins"), F.count_if(F.col("va") < F.col("vb")).alias("b_wins"), F.count_if(F.col("va") == F.col("vb")).alias("ties"))
    return counted.withColumn("a_win_rate", F.try_divide(F.col("a_wins"), F.col("a_wins") + F.col("b_wins")))


def rounds_merged(results: DataFrame, decay: float = 0.85, limit: int = 10) -> DataFrame:
    """Results of several rounds added up per item, a later round at ``decay`` ** round."""
    merged = results.groupBy("query_id", "item_id").agg(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("round"))).alias("score"))
    return ranked(merged, ["query_id"], [F.round(F.col("score") + 1e-10, 8).desc(), F.col("item_id")], limit)


def weight_grid(candidates: DataFrame, signals: list[str], steps: int, target: str) -> DataFrame:
    """For every combination of signal weights in ``steps`` steps that add up to one: the mean target of each query's best item.

    The grid is a small table made of the arguments; the candidates are read once per combination within one plan.
    """
    grid = [[i / steps, (steps - i) / steps] for i in range(steps + 1)] if len(signals) == 2 else [[i / steps, j / steps, (steps - i - j) / steps] for i in range(steps + 1) for j in range(steps + 1 - i)]
    weights = F.array(*(F.struct(*(F.lit(float(w)).alias(f"w_{s}") for s, w in zip(signals, row, strict=True))) for row in grid))
    names = [f"w_{s}" for s in signals]
    scored = candidates.select("query_id", "item_id", target, *signals, F.inline(weights))
    total = sum((F.col(s) * F.col(f"w_{s}") for s in signals[1:]), F.col(signals[0]) * F.col(f"w_{signals[0]}"))
    best = scored.groupBy("query_id", *names).agg(F.max_by(F.col(target), F.struct(F.round(total, 9), -F.col("item_id"))).alias("_t"))
    return best.groupBy(*names).agg(F.avg("_t").alias("mean_target"))


def embedding_text(title: Column, path: Column, content: Column) -> Column:
    """The text that stands for an item before embedding, whole; what a model can take is the model's to cut."""
    return F.concat(F.lit("title: "), F.coalesce(title, path), F.lit(" | path: "), path, F.lit(" | text: "), F.coalesce(content, F.lit("")))


def breadcrumb(path: Column, symbol: Column, content: Column) -> Column:
    """Content below a line with its directories and symbol."""
    trail = F.concat_ws(" > ", F.array_join(F.split(path, "/"), " > "), symbol)
    return F.concat(trail, F.lit("\n"), F.coalesce(content, F.lit("")))


def document_outline(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Title, headings, list items, code blocks and paths of documents with text; fences are taken out before headings are read."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?s)```.*?(?:```|\z)", "")
    heads = F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6} +([^\n]+)"), 1)
    return documents.where(F.col(text).isNotNull()).select(
        key,
        F.try_element_at(heads, F.lit(1)).alias("title"),
        F.size(heads).alias("headings"),
        F.size(F.regexp_extract_all(body, F.lit(r"(?m)^(?:[-*]|\d+\.) +([^\n]+)"), 1)).alias("list_items"),
        (F.size(F.split(F.col(text), "```")) - 1).alias("fences"),
        F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"((?:\w+/)+\w+\.\w+)"), 1))).alias("paths"),
    )


def prefer_scope(ranking: DataFrame, scope: Column) -> DataFrame:
    """Candidates within a scope first, both parts in their order."""
    marked = ranking.withColumn("_in", F.coalesce(scope, F.lit(False)).cast("int")).withColumnRenamed("rank", "_old")
    return ranked(marked, ["query_id"], [F.col("_in").desc(), F.col("_old")]).drop("_in", "_old")


def admitted(lexical: DataFrame, present: DataFrame, limit: int) -> DataFrame:
    """The best lexical candidates that a ranking doesn't have yet, up to ``limit`` per query."""
    return ranked(lexical.join(present.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti"), ["query_id"], [F.round("score", 6).desc(), F.col("path")], limit)


def kind_rates(results: DataFrame, kind: str) -> DataFrame:
    """Share of queries whose first result is of a kind, by kind."""
    first = results.where("rank = 1")
    counted = first.groupBy(kind).agg(F.count(F.lit(1)).alias("queries"))
    total = first.agg(F.count(F.lit(1)).alias("_n"))
    return counted.crossJoin(F.broadcast(total)).select(kind, "queries", (F.col("queries") / F.col("_n")).alias("rate"))


def boosted_trees(rows: DataFrame, key: str, features: list[str], label: str, train_share: float = 0.8, trees: int = 20, depth: int = 4):
    """Fit boosted regression trees on a split by hash of the key; the model and the held-out rows with ``prediction``.

    Rows with a null feature or label take no part.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    usable = rows.dropna(subset=[*features, label]).withColumn("_train", hash_share(F.col(key).cast("string")) < train_share)
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(usable.select(key, *features, F.col(label).cast("double").alias("_label"), "_train"))
    model = GBTRegressor(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, seed=7).fit(assembled.where("_train"))
    return model, model.transform(assembled.where("not _train"))

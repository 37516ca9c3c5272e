"""Reordering features and rules: hub prior, logits, second pass, feature rows, tree models as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.text import directory, file_name, role_tokens, stem

#: Names of files that others depend on, and of those at the edge (fixed values).
HUB_NAMES = ["manager", "processor", "service", "impl", "engine", "queue", "area", "evaluator", "registry", "coordinator"]
EDGE_NAMES = ["action", "dialog", "handler", "delegate", "provider", "strategy", "util", "utils", "test", "tests", "bundle", "inspection", "reporter", "logger", "mock", "command"]
TEST_DIRECTORIES = ["test", "tests", "testsrc", "testdata"]
OTHER_SUFFIXES = [".xml", ".md", ".json", ".properties", ".txt", ".yaml", ".yml", ".html"]


def role_prior(path: Column) -> Column:
    """1 for a hub, -0.5 for the edge, -0.75 in test directories, -1 for files that are no source, else 0; the last name part decides first."""
    names = role_tokens(stem(path))
    last = F.try_element_at(names, F.lit(-1))
    has = lambda words: F.exists(names, lambda w: w.isin(words))
    return (
        F.when(F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1)).isin(OTHER_SUFFIXES), -1.0)
        .when(F.exists(F.split(F.lower(directory(path)), "/"), lambda s: s.isin(TEST_DIRECTORIES)), -0.75)
        .when(last.isin(HUB_NAMES), 1.0)
        .when(last.isin(EDGE_NAMES), -0.5)
        .when(has(EDGE_NAMES), -0.5)
        .when(has(HUB_NAMES), 1.0)
        .otherwise(0.0)
    )


def hub_prior(candidates: DataFrame, role_weight: float, fan_in_weight: float) -> DataFrame:
    """Add ``prior``: the weighted role and log fan-in (column fan_in, null as 0) against the busiest candidate of the query."""
    busiest = F.max(F.coalesce("fan_in", F.lit(0))).over(Window.partitionBy("query_id"))
    share = F.when(busiest > 0, F.log1p(F.coalesce("fan_in", F.lit(0))) / F.log1p(busiest)).otherwise(0.0)
    return candidates.withColumn("prior", role_weight * role_prior(F.col("path")) + fan_in_weight * share)


def logit(p: Column, clamp: float = 1e-7) -> Column:
    bounded = F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), p))
    return F.log(bounded / (1 - bounded))


def second_pass(first: DataFrame, second: DataFrame, floor: float, cap: int) -> DataFrame:
    """The larger of both scores for candidates below the floor among the first ``cap`` of the base ranking; others keep theirs."""
    joined = first.join(second.select("query_id", "item_id", F.col("score").alias("_second")), ["query_id", "item_id"], "left")
    again = (F.col("score") < floor) & (F.col("rank") <= cap)
    return joined.withColumn("final", F.when(again, F.greatest("score", F.coalesce("_second", F.col("score")))).otherwise(F.col("score"))).drop("_second")


def margin(ranking: DataFrame, score: str, k: int) -> DataFrame:
    """query_id, top, and the distance of the first score to the k-th (null with fewer)."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col(score)))
    return ranking.where(F.col("rank").isin(1, k)).groupBy("query_id").agg(at(1).alias("top"), (at(1) - at(k)).alias("margin"))


def list_features(ranking: DataFrame, score: str) -> DataFrame:
    """Per candidate: gap to the best, reciprocal rank, and the list's top-10 mean, deviation and entropy of scores as shares."""
    w = Window.partitionBy("query_id")
    top = F.col("rank") <= 10
    total = F.sum(F.when(top & (F.col(score) > 0), F.col(score))).over(w)
    share = F.when(top & (F.col(score) > 0) & (total > 0), F.col(score) / total)
    shared = ranking.withColumn("_share", share)
    return shared.select(
        "query_id",
        "item_id",
        "rank",
        (F.max(score).over(w) - F.col(score)).alias("gap"),
        (1 / F.col("rank")).alias("reciprocal_rank"),
        F.avg(F.when(top, F.col(score))).over(w).alias("top_mean"),
        F.coalesce(F.stddev_pop(F.when(top, F.col(score))).over(w), F.lit(0.0)).alias("top_deviation"),
        F.coalesce(-F.sum(F.col("_share") * F.log("_share")).over(w), F.lit(0.0)).alias("top_entropy"),
    )


def path_features(path: Column) -> list[Column]:
    """Depth, length of the file name, tests, and language flags of a path."""
    suffix = F.lower(F.substring_index(path, ".", -1))
    return [
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"),
        F.length(file_name(path)).alias("name_length"),
        F.lower(path).rlike("test").cast("int").alias("is_test"),
        (suffix == "java").cast("int").alias("is_java"),
        suffix.isin("kt", "kts").cast("int").alias("is_kotlin"),
        (suffix == "xml").cast("int").alias("is_xml"),
        suffix.isin("md", "markdown").cast("int").alias("is_markdown"),
    ]


def parse_trees(text: str) -> tuple[list[str], list[dict[str, list[float]]]]:
    """Feature names and trees of a boosted model in LightGBM's text format (numeric splits only)."""
    names: list[str] = []
    trees: list[dict[str, list[float]]] = []
    for line in text.splitlines():
        key, _, value = line.partition("=")
        if key == "feature_names":
            names = value.split()
        elif key == "Tree":
            trees.append({})
        elif trees and key in ("split_feature", "threshold", "left_child", "right_child", "leaf_value", "decision_type"):
            trees[-1][key] = [float(v) for v in value.split()]
    if any(int(d) & 1 for tree in trees for d in tree.get("decision_type", [])):
        raise ValueError("categorical splits are not supported")
    return names, trees


def tree_model(text: str, columns: dict[str, Column] | None = None) -> Column:
    """A boosted tree model as one expression: nested conditions per tree, values up to a threshold go left, leaves add up.

    Missing values go right as they fail every comparison. ``columns`` gives expressions for feature names.
    """
    names, trees = parse_trees(text)
    total = F.lit(0.0)
    for tree in trees:

        def node(i: int, tree: dict[str, list[float]] = tree) -> Column:
            if i < 0:
                return F.lit(tree["leaf_value"][~i])
            name = names[int(tree["split_feature"][i])]
            value = (columns or {}).get(name, F.col(name))
            return F.when(value <= tree["threshold"][i], node(int(tree["left_child"][i]))).otherwise(node(int(tree["right_child"][i])))

        total = total + (node(0) if tree.get("split_feature") else F.lit(tree["leaf_value"][0]))
    return total

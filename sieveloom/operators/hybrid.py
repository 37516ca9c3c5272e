"""Hybrid retrieval: candidates of vector, lexical, symbol and graph search merged per query, weighted by route, ranked as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.operators.fusion import best_per_item, rrf
from sieveloom.operators.lexical import ranked

SIGNALS = ["vector", "lexical", "path_score", "symbol", "symbol_match", "graph", "file_vote"]
#: Weights of the signals, and what a route sets instead (fixed values).
WEIGHTS = {"vector": 0.5625, "lexical": 0.1875, "path_score": 0.0833333333, "symbol": 0.0416666667, "symbol_match": 0.0416666667, "graph": 0.0833333333, "file_vote": 0.0}
ROUTE_WEIGHTS = {
    "workflow": {"vector": 0.52, "lexical": 0.15, "path_score": 0.1, "symbol": 0.05, "graph": 0.1},
    "path_symbol": {"vector": 0.45, "lexical": 0.2675, "path_score": 0.2, "symbol": 0.08, "graph": 0.02},
    "semantic": {"graph": 0.01},
}
#: The most that path and symbol weigh in a query in prose (fixed values).
PROSE_PATH, PROSE_SYMBOL = 0.08, 0.05


def merged(*sources: DataFrame) -> DataFrame:
    """Candidates of several sources (query_id, item_id, path and any of the signals) with the largest of every signal, absent ones as 0."""
    filled = [s.select("query_id", "item_id", "path", *((F.coalesce(c, F.lit(0.0)) if c in s.columns else F.lit(0.0)).alias(c) for c in SIGNALS)) for s in sources]
    return best_per_item(reduce(DataFrame.unionByName, filled), SIGNALS)


def scaled_by_best(scored: DataFrame, score: str, name: str) -> DataFrame:
    """A positive score as a share of the query's best one."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return scored.withColumn(name, F.when(best > 0, F.col(score) / best).otherwise(0.0))


def lexical_cut(candidates: DataFrame, limit: int) -> DataFrame:
    """The best lexical candidates of every query by lexical, path and symbol score together, ties by path backwards; those without any are dropped."""
    together = F.col("lexical") + F.col("path_score") + F.col("symbol")
    best = ranked(candidates, ["query_id"], [F.round(together, 9).desc(), F.col("path").desc(), F.col("item_id")], limit, "_n").drop("_n")
    return best.where("lexical > 0 or path_score > 0 or symbol > 0")


def route_weight(signal: str, route: Column, prose: Column) -> Column:
    """The weight of a signal for a query of a route; in prose the surplus of path and symbol goes to vector and lexical in halves."""

    def own(name: str) -> Column:
        chosen = F.lit(WEIGHTS[name])
        for r, weights in ROUTE_WEIGHTS.items():
            if name in weights:
                chosen = F.when(route == r, F.lit(weights[name])).otherwise(chosen)
        return chosen

    surplus = F.greatest(F.lit(0.0), own("path_score") - PROSE_PATH) + F.greatest(F.lit(0.0), own("symbol") - PROSE_SYMBOL)
    in_prose = {"path_score": F.least(own("path_score"), F.lit(PROSE_PATH)), "symbol": F.least(own("symbol"), F.lit(PROSE_SYMBOL)), "vector": own("vector") + surplus / 2, "lexical": own("lexical") + surplus / 2}
    return F.when(prose, in_prose[signal]).otherwise(own(signal)) if signal in in_prose else own(signal)


def routed_total(candidates: DataFrame, routes: DataFrame, kind_weight: Column) -> DataFrame:
    """``candidates`` with total: the signals weighted by the query's route (query_id, route, prose) times the weight of the item's kind."""
    joined = candidates.join(routes, "query_id")
    total = reduce(lambda a, b: a + b, (F.col(s) * route_weight(s, F.col("route"), F.col("prose")) for s in SIGNALS))
    return joined.withColumn("total", total * kind_weight)


def file_ranking(scored: DataFrame, limit: int) -> DataFrame:
    """Files by total, then graph score, then path, all descending; of a file's items the best one stands for it."""
    first = ranked(scored, ["query_id", "path"], [F.round("total", 9).desc(), F.round("graph", 9).desc(), F.col("item_id")], 1, "_n").drop("_n")
    return ranked(first, ["query_id"], [F.round("total", 9).desc(), F.round("graph", 9).desc(), F.col("path").desc()], limit)


def rrf_ranking(candidates: DataFrame, kind_weight: Column, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of all signals, times the weight of the item's kind; ties by path backwards."""
    fused = rrf(candidates, {s: w for s, w in WEIGHTS.items() if w > 0}, k).withColumn("score", F.col("score") * kind_weight)
    return ranked(fused, ["query_id"], [F.round("score", 9).desc(), F.col("path").desc(), F.col("item_id")], limit)



from __future__ import annotations

import random

from pyspark.sql import functions as F

from sieveloom.llm.top_items import best_hits, top_n


def test_matches_sorting_with_a_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), float(rng.randrange(6)), i) for i in range(3000)]
    found = top_n(spark.createDataFrame(rows, "g string, s double, k bigint").repartition(7), ["g"], [F.col("s").desc()], "k", 9)
    groups: dict = {}
    for g, s, k in rows:
        groups.setdefault(g, []).append((-s, k))
    wanted = {(g, i + 1, k) for g, own in groups.items() for i, (_, k) in enumerate(sorted(own)[:9])}
    assert {(r.g, r.position, r.k) for r in found.collect()} == wanted


def test_repeated_rows_count_once_and_empty_input_is_empty(spark):
    rows = [("q", 1.0, 5), ("q", 1.0, 5), ("q", 0.5, 7), ("q", 0.5, 7), ("q", 0.1, 9)]
    df = spark.createDataFrame(rows, "g string, s double, k bigint")
    assert [(r.k, r.position) for r in top_n(df, ["g"], [F.col("s").desc()], "k", 3).orderBy("position").collect()] == [(5, 1), (7, 2), (9, 3)]
    assert top_n(df.limit(0), ["g"], [F.col("s").desc()], "k", 3).count() == 0


def test_best_hits_ignores_unusable_rows_and_extra_columns(spark):
    requests = spark.createDataFrame([(1, "x", "r"), (1, "x", "r"), (2, "x", "r"), (3, None, "r"), (4, "", "r")], "request_id bigint, query string, path string")
    hits = spark.createDataFrame(
        [(10, 1, "b", 1.0, "q"), (11, 2, "a", 1.0, "q"), (11, 2, "a", 1.0, "q"), (12, 1, None, 1.0, "q"), (13, 1, "z", float("nan"), "q"), (14, 1, "z", None, "q"), (15, 9, "z", 2.0, "q"), (16, 3, "z", 3.0, "q"), (17, 4, "e", -1.0, "q"), (18, 1, "c", -0.0, "q"), (19, 1, "c", 0.0, "q")],
        "hit_id bigint, request_id bigint, path string, score float, query string",
    )
    found = [(r.query, r.position, r.hit_id) for r in best_hits(requests, hits, 5).orderBy("query", "position").collect()]
    assert found == [("", 1, 17), ("x", 1, 12), ("x", 2, 11), ("x", 3, 10), ("x", 4, 18), ("x", 5, 19)]
    assert best_hits(requests, hits.limit(0), with_query=False).count() == 0

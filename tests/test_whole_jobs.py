"""Queries that once worked on a part of their rows, on small tables where that part is not the whole."""

from __future__ import annotations

import random
from statistics import correlation

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveloom.operators import collections, evaluate, positions

HITS = "hit_id bigint, request_id bigint, path string, start_line int, end_line int, score float"


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        (df.withColumn("title", F.lit(None).cast("string")) if schema == HITS else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ran(spark, name, folder):
    return entry.queries()[name](spark, folder).collect()


def test_spans_of_all_requests(spark, tmp_path):
    rng = random.Random(5)
    lines = [(rng.randint(1, 400), rng.choice([0, 1, 5, 70, 300, -3])) for _ in range(300)]
    hits = [(i, i % 37, f"p{i % 3}", start, start + n, 1.0) for i, (start, n) in enumerate(lines)]
    folder = written(spark, tmp_path, search_items=([*hits, *hits[:20]], HITS))
    inside = {(a[0], b[0]) for a in hits for b in hits if a[0] != b[0] and a[2] == b[2] and a[3] <= b[3] and b[4] <= a[4] and a[4] - a[3] > b[4] - b[3]}
    found = [(r.src, r.dst) for r in ran(spark, "containment_range", folder)]
    assert len(found) == len(inside) and set(found) == inside
    order = sorted(hits, key=lambda h: (h[2], h[3], h[4], h[0]))
    after = {(a[0], b[0]) for a, b in zip(order, order[1:]) if a[2] == b[2]}
    assert {(r.src, r.dst) for r in ran(spark, "next_in_file", folder)} == after


def test_graph_operators_take_all_seeds(spark, tmp_path):
    n = 130
    hits = [(i, 1, f"s{i:03}.py", 1, 2, float(n - i)) for i in range(n)]
    sources = [(i, f"s{i:03}.py", "", f"from .t{i:03} import x", "python") for i in range(n)]
    folder = written(
        spark,
        tmp_path,
        search_items=(hits, HITS),
        code_items=(sources + [(n + i, f"t{i:03}.py", "", "", "python") for i in range(n)], "item_id bigint, path string, title string, content string, code_language string"),
    )
    reached = lambda name: {r.path for r in ran(spark, name, folder) if r.path.startswith("t")}
    assert reached("propagate_hops") == {f"t{i:03}.py" for i in range(120)}
    assert reached("expand_hops") == {f"t{i:03}.py" for i in range(n)}
    assert {(r.path, r.neighbour) for r in ran(spark, "typed_neighbors", folder)} == {(f"s{i:03}.py", f"t{i:03}.py") for i in range(n)}


def test_rounds_merged_takes_all_requests(spark, tmp_path):
    scores = {1: [0.4], 2: [0.3], 3: [0.2], 4: [0.9, 0.1], 5: [1.0]}
    hits = [(10 * r + i, r, f"p{i}", 1, 2, s) for r, own in scores.items() for i, s in enumerate(own)]
    folder = written(spark, tmp_path, search_items=(hits, HITS), search_requests=([(r, "q", "s") for r in scores], "request_id bigint, query string, strategy string"))
    merged = [(10 * r + i, s * 0.85 ** (r - 1)) for r, own in scores.items() for i, s in enumerate(own)]
    expected = sorted(merged, key=lambda x: -x[1])
    found = sorted(ran(spark, "rounds_merged", folder), key=lambda r: r.rank)
    assert [r.item_id for r in found] == [i for i, _ in expected]
    assert [r.score for r in found] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_confusion_matrix_counts_every_row(spark, tmp_path):
    sources = ["handwritten", "translated", "translated", "brand_new", None]
    folder = written(spark, tmp_path, eval_cases=([(i, "dev" if i else None, s) for i, s in enumerate(sources)], "record_id bigint, split string, source string"))
    rows = {r.split: r.asDict() for r in ran(spark, "confusion_matrix", folder)}
    assert rows["dev"] == {"split": "dev", "handwritten": 0, "issue_mined": 0, "log_mined": 0, "synthetic_where": 0, "translated": 2, "other": 2}
    assert sum(v for r in rows.values() for k, v in r.items() if k != "split") == len(sources)


def test_cosine_lanes_search_every_label(spark, tmp_path):
    vectors = [(i, label, [1.0, i / 10]) for i, label in enumerate([0, 1, 2, 57, 57, -4, None, None])]
    folder = written(spark, tmp_path, embeddings=(vectors, "vec_id bigint, label int, embedding array<float>"))
    found = [(r.label, r.item_id) for r in ran(spark, "cosine_lanes", folder)]
    assert set(found) == {(0, 0), (1, 1), (2, 2), (57, 3), (-4, 5), (None, 6)} and len(found) == 6


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_task_holds_a_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", None]), float(rng.randint(0, 6)), rng.random()) for _ in range(200)] + [("none", None, None), ("one", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    found = positions.linear_percentiles(df, ["g"], "b", {"p90": 0.9, "p50": 0.5})
    exact = df.groupBy("g").agg(F.percentile("b", 0.9).alias("p90"), F.percentile("b", 0.5).alias("p50"))
    assert {r.g: (r.p90, r.p50) for r in found.collect()} == {r.g: pytest.approx((r.p90, r.p50)) if r.p90 is not None else (None, None) for r in exact.collect()}
    assert "percentile(" not in plan(found)
    agreed = evaluate.agreement(df, "a", "b", ["g"])
    rank = lambda values, v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
    for r in agreed.collect():
        a, b = zip(*((x, y) for g, x, y in rows if g == r.g and x is not None))
        assert r.n == len(a)
        assert r.spearman is None if len(a) < 3 else r.spearman == pytest.approx(correlation([rank(a, x) for x in a], [rank(b, y) for y in b]))
    assert "rank(" not in plan(agreed)
    cases = spark.createDataFrame([(1, "i", "q", ["e"]), (2, "i", None, []), (3, None, "q", ["e"]), (4, None, " ", ["e"]), (5, "", "r", ["e"])], "record_id bigint, id string, query string, expected array<string>")
    faults = collections.lint(cases)
    assert sorted(map(tuple, faults.collect())) == [(1, "id used again"), (1, "query used again"), (2, "id used again"), (2, "no query"), (2, "nothing expected"), (3, "no id"), (3, "query used again"), (4, "no id"), (4, "no query"), (5, "no id")]
    assert "Window" not in plan(faults)


def test_embedding_texts_are_whole(spark, tmp_path):
    folder = written(spark, tmp_path, code_items=([(1, "a/b.py", "B", "x" * 5000 + " end", "python")], "item_id bigint, path string, title string, content string, code_language string"))
    assert [r.text for r in ran(spark, "embedding_texts", folder)] == ["title: B | path: a/b.py | text: " + "x" * 5000 + " end"]

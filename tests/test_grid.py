"""Searches that once made a row of every pair of a query and an item."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveloom.operators import grid, lexical

WORDS = ["index", "cache", "parse", "token", "merge", "branch", "retry"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("grid")
    text = lambda n: " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=n))
    files = [(i, f"{rng.choice(WORDS)}/f{i:03}.py", rng.choice([None, "TokenIndex", "MergeCacheRetry"]), (text(rng.randrange(12)) + rng.choice(["", "", " TokenIndex"])) or None, "python") for i in range(90)]
    asked = [(i, text(rng.randint(1, 4)), "s") for i in range(40)] + [(40, "", "s"), (41, "nowhere", "s"), (42, None, "s")]
    hits = [(i, rng.randrange(43), f[1], 1, 2, rng.random(), None) for i, f in enumerate(rng.choices(files, k=200))]
    spark.createDataFrame(files, "item_id bigint, path string, title string, content string, code_language string").write.parquet(f"{folder}/code_items.parquet")
    spark.createDataFrame(asked, "request_id bigint, query string, strategy string").write.parquet(f"{folder}/search_requests.parquet")
    spark.createDataFrame(hits, "hit_id bigint, request_id bigint, path string, start_line int, end_line int, score double, title string").write.parquet(f"{folder}/search_items.parquet")
    return str(folder)


def sql_rows(folder, name, columns):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in ("code_items", "search_requests", "search_items"):
        c.execute(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    return c.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()


@pytest.mark.parametrize("name", ["bm25_alias_locator", "bm25_topk", "bm25_repeated_terms", "coverage_seeds", "lexical_admission", "symbol_match", "expand_hops"])
def test_no_pair_is_a_row(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    column = "path" if name == "expand_hops" else "item_id"
    assert not re.search(rf"Aggregate \[query_id#\w+, {column}#", found._jdf.queryExecution().optimizedPlan().toString())
    rows = sorted(map(tuple, found.collect()))
    assert rows and rows == sorted(sql_rows(folder, name, found.columns))


@pytest.mark.parametrize("name", ["hybrid_candidates", "hybrid_rrf", "hybrid_search"])
def test_symbols_are_compared_after_the_cut(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    assert not re.search(r"Aggregate .*count\(1\).* AS symbol_match", found._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(tuple, found.collect())) == sorted(sql_rows(folder, name, found.columns))


def test_items_of_equal_path_add_up(spark):
    docs = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x"]), (3, "b", ["x", "y"])], "item_id bigint, path string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["x", "y"])], "query_id bigint, terms array<string>")
    each = {r.item_id: r.score for r in lexical.bm25(docs, "item_id", F.col("tokens"), asked).collect()}
    found = {r.path: r.score for r in lexical.bm25_top(docs, "item_id", F.col("tokens"), asked, by="path").collect()}
    assert found == {"a": pytest.approx(each[1] + each[2]), "b": pytest.approx(each[3])}


@pytest.mark.parametrize("shape", [(1, 1), (3, 2)])
def test_whole_numbers_tie_by_key(spark, shape):
    postings = spark.createDataFrame([(i, w, (1 + i % 3) << grid.LOW_BITS | i % 7) for i in range(300) for w in ("x", "y")[: 1 + i % 2]], "item_id bigint, term string, part bigint")
    asked = spark.createDataFrame([(q, ["x", "y", "z"], [1.0] * 3, k) for q, k in enumerate([0, 1, 40, 400])], "query_id bigint, terms array<string>, weights array<double>, _k int")
    found = lexical.ranked(grid.best(postings, "item_id", asked, *shape), ["query_id"], [F.shiftright("part", grid.LOW_BITS).desc(), F.col("item_id")])
    found = {(r.query_id, r.item_id, r.part) for r in found.collect() if r["rank"] <= [0, 1, 40, 400][r.query_id]}
    sums = {i: ((1 + i % 3) << grid.LOW_BITS | i % 7) * (1 + i % 2) for i in range(300)}
    best = sorted(sums, key=lambda i: (-(sums[i] >> grid.LOW_BITS), i))
    assert found == {(q, i, sums[i]) for q, k in enumerate([0, 1, 40, 400]) for i in best[:k]}

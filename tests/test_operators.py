from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import collections, evaluate, fusion, graph, items, lexical, positions, rerank, routing, vectors


def test_bm25_closed_form(spark):
    docs = spark.createDataFrame([("a", "search search x"), ("b", "x y"), ("c", ""), ("d", None)], "id string, body string")
    asked = spark.createDataFrame([(1, ["search", "search", "nothing"])], "query_id bigint, terms array<string>")
    found = lexical.bm25(docs, "id", t.word_tokens(F.col("body")), asked).collect()
    idf, avgdl = math.log(1 + (4 - 1 + 0.5) / 1.5), 5 / 4
    assert [(r.query_id, r.id) for r in found] == [(1, "a")]
    assert found[0].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avgdl)))
    assert lexical.bm25(docs.limit(0), "id", t.word_tokens(F.col("body")), asked).count() == 0


def test_case_metrics_give_each_entry_to_one_file(spark):
    rows = [(1, ["a", "a/b.py"], ["a/b.py", "a/b.py", "a/c.py", "z"]), (2, [], ["a"]), (3, ["x"], None), (4, ["glob:*.go", "q"], ["k", "m.go"])]
    df = spark.createDataFrame(rows, "case_id bigint, expected array<string>, retrieved array<string>")
    found = {r.case_id: r for r in evaluate.case_metrics(df).collect()}
    one = found[1]
    assert (one.hit, one.reciprocal_rank, one.precision, one.recall, one.n_files) == (True, 1.0, 0.75, 1.0, 3)
    assert one.ndcg == pytest.approx(1 / (1 + 1 / math.log2(3))) and one.average_precision == 0.5 and one.file_recall == 1.0
    assert (found[2].hit, found[2].ndcg, found[3].precision) == (False, 0.0, 0.0)
    four = found[4]
    assert four.reciprocal_rank == 0.5 and four.file_recall == 0.5 and four.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


@pytest.mark.parametrize(("wins", "losses"), [(0, 0), (1, 0), (5, 5), (9, 1), (40, 20), (300, 200)])
def test_sign_test(spark, wins, losses):
    n = wins + losses
    exact = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n)
    found = spark.createDataFrame([(wins, losses)], "w int, l int").select(evaluate.sign_test(F.col("w"), F.col("l")).alias("p")).first().p
    assert found == pytest.approx(exact, abs=1e-9)


def test_positions_within_groups_of_any_size(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, k bigint").repartition(5)
    groups: dict = {}
    for g, v, k in rows:
        groups.setdefault(g, []).append((v, k))
    wanted = {(g, i, k, len(own)) for g, own in groups.items() for i, (_, k) in enumerate(sorted(own), 1)}
    assert {(r.g, r.position, r.k, r.group_size) for r in positions.numbered(df, ["g"], [F.col("v"), F.col("k")]).collect()} == wanted
    median = {r.g: r.value for r in positions.nearest_percentiles(df, ["g"], "v", [0.5]).collect()}
    assert median == {g: sorted(v for v, _ in own)[round((len(own) - 1) * 0.5)] for g, own in groups.items()}
    assert positions.numbered(df.limit(0), [], [F.col("v")]).count() == 0


def test_cosine_blocks_equal_brute_force(spark):
    rng = random.Random(6)
    data = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(700)} | {900: [0.0] * 8}
    df = spark.createDataFrame([(k, v) for k, v in data.items()] + [(901, None)], "item_id bigint, vector array<double>").repartition(3)
    asked = df.where("item_id % 100 = 0 or item_id = 901").toDF("query_id", "vector")
    unit = {k: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for k, v in data.items()}
    wanted = set()
    for q in [k for k in data if k % 100 == 0]:
        ranked = sorted(data, key=lambda k: (-round(sum(a * b for a, b in zip(unit[q], unit[k], strict=True)), 9), k))
        wanted |= {(q, i, k) for i, k in enumerate(ranked[:5], 1)}
    assert {(r.query_id, r.rank, r.item_id) for r in vectors.cosine_top(df, asked, 5).collect()} == wanted


def test_blake_embedding(spark):
    tokens = ["a", "b", "a", "zeta"]
    v = [0.0] * 256
    for w in tokens:
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "big") % 256] += 1 if h[4] % 2 == 0 else -1
    length = math.sqrt(sum(x * x for x in v))
    found = spark.createDataFrame([(tokens,), ([],), (None,)], "w array<string>").select(vectors.blake_embedding("w").alias("e")).collect()
    assert found[0].e == pytest.approx([x / length for x in v])
    assert set(found[1].e) == set(found[2].e) == {0.0}


def test_fusion_keeps_ranks_dense(spark):
    rows = [(1, i, f"d{i % 3}/f{i % 5}.py", ["x", "y"][i % 2], 1.0 - i / 20, i / 20, i + 1) for i in range(12)]
    ranking = spark.createDataFrame(rows, "query_id bigint, item_id bigint, path string, kind string, vector double, lexical double, rank int")
    for out in (fusion.cap_per_path(ranking, 1), fusion.directory_cap(ranking, 1, 6), fusion.round_robin(ranking, 6), fusion.preserve_top(ranking, "lexical", 0.01), fusion.preserve_kind_tops(ranking, "lexical", 1, 4), fusion.quota_mix(ranking, "kind", {"x": 1}, 5), fusion.tie_bands(ranking, "vector", "lexical", 0.06)):
        ranks = sorted(r["rank"] for r in out.collect())
        assert ranks == list(range(1, len(ranks) + 1))
    assert fusion.preserve_top(ranking, "lexical", 0.01).orderBy("rank").first().item_id == 11
    tops = {r.item_id for r in fusion.preserve_kind_tops(ranking, "lexical", 1, 4).collect()}
    assert {10, 11} <= tops and len(tops) == 4
    scaled = ranking.select(fusion.minmax(F.col("vector"), ["query_id"]).alias("s"), fusion.minmax(F.lit(2.0), ["query_id"]).alias("c")).collect()
    assert min(r.s for r in scaled) == 0 and max(r.s for r in scaled) == 1 and {r.c for r in scaled} == {1.0}


def test_graph_propagation(spark):
    edges = spark.createDataFrame([("a", "b", "imports", 0.8), ("b", "c", "imports", 0.8), ("a", "a", "imports", 1.0), (None, "c", "imports", 1.0)], "src string, dst string, kind string, weight double")
    near = graph.adjacency(edges)
    assert {(r.src, r.dst): round(r.weight, 6) for r in near.collect()} == {("a", "b"): 0.8, ("b", "a"): 0.56, ("b", "c"): 0.8, ("c", "b"): 0.56}
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id bigint, path string, score double")
    spread = {r.path: r.score for r in graph.propagate(near, seeds, depth=2, decay=0.5).collect()}
    assert spread == pytest.approx({"b": 0.4, "a": 0.4 * 0.56 * 0.25, "c": 0.4 * 0.8 * 0.25})
    expanded = {r.path: r.score for r in graph.expand(near, seeds, depth=2, decay=0.5).collect()}
    assert expanded == pytest.approx({"b": 0.8, "a": 0.8 * 0.56 * 0.5, "c": 0.8 * 0.8 * 0.5})
    files = spark.createDataFrame([("x/a_reader.py", "from .b_writer import B\nsee x/b_writer.py"), ("x/b_writer.py", None), ("y/Breader.go", 'import { A } from "./a_reader"')], "path string, content string")
    assert {(r.src, r.dst) for r in graph.import_edges(files).collect()} == {("x/a_reader.py", "x/b_writer.py")}  # "./" is the importing file's directory
    assert {(r.src, r.dst) for r in graph.reference_edges(files).collect()} == {("x/a_reader.py", "x/b_writer.py")}


def test_roles_and_trees(spark):
    paths = {"a/RenameProcessor.java": 1.0, "a/RenameHandler.java": -0.5, "tests/RenameProcessor.java": -0.75, "a/x.md": -1.0, "a/plain.py": 0.0, "a/HandlerThing.py": -0.5, "a/ServiceThing.py": 1.0}
    found = {r.p: r.x for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", rerank.role_prior(F.col("p")).alias("x")).collect()}
    assert found == paths
    model = "feature_names=f g\nTree=0\nsplit_feature=0 1\nthreshold=1 2\nleft_child=1 -2\nright_child=-1 -3\nleaf_value=10 20 30\nTree=1\nleaf_value=0.5\n"
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 0.0), (None, 0.0)], "f double, g double")
    assert [r.x for r in df.select(rerank.tree_model(model).alias("x")).collect()] == [20.5, 30.5, 10.5, 10.5]
    with pytest.raises(ValueError, match="categorical"):
        rerank.parse_trees("Tree=0\ndecision_type=1\n")


def test_routing(spark):
    texts = {"where is the handler registered": "workflow", "find src/a.py": "path_symbol", "getUser flow": "path_symbol", "how do tags age": "semantic"}
    found = {r.q: r.x for r in spark.createDataFrame([(q,) for q in texts], "q string").select("q", routing.route(F.col("q")).alias("x")).collect()}
    assert found == texts
    variants = spark.createDataFrame([("Where is rename refactoring handled in the code?",)], "q string").select(routing.variants(F.col("q")).alias("v")).first().v
    assert variants[0] == "Where is rename refactoring handled in the code?" and variants[1] == "rename refactoring handled" and len(variants) == 4 and variants[3] == "RenameRefactoring"


def test_chunks_and_lines(spark):
    files = spark.createDataFrame([("a.py", "x\r\n" * 5), ("b.py", " \n"), ("c.py", None), ("d.py", "one"), ("e.py", "a\0b")], "path string, content string")
    found = {(r.path, r.start_line, r.end_line): r.title for r in items.chunks(files, 2).collect()}
    assert found == {("a.py", 1, 2): "a.py:1-2", ("a.py", 3, 4): "a.py:3-4", ("a.py", 5, 5): "a.py:5-5", ("d.py", 1, 1): "d.py"}
    assert items.grep(files, "x", fixed=True).count() == 5
    assert {r.path: r.truncated for r in items.excerpt(files, 1, 3).collect()} == {"a.py": True, "d.py": False}


def test_collections(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k bigint, c string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k bigint, c string")
    status = {r.k: r.status for r in collections.difference(old, new, "k", F.struct("c")).collect()}
    assert status == {1: "deleted", 2: "changed", 3: "same", 4: "added"}
    sample = collections.stratified(spark.range(900).selectExpr("id as k", "cast(id as double) as s"), "k", "s", F.col("k") % 2 == 0, 5, "x").collect()
    assert Counter((r.tercile, r.flag) for r in sample) == {(i, f): 5 for i in range(3) for f in (True, False)}
    overlap = evaluate.overlap(spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], ["a"])], "k bigint, p array<string>, r array<string>"), "k", F.col("p"), F.col("r"))
    assert {r.k: (r.precision, r.recall) for r in overlap.collect()} == {1: (pytest.approx(1 / 3), 0.5), 2: (0.0, 0.0)}

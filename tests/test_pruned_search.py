from __future__ import annotations

import random

from pyspark.sql import functions as F

from sieveloom.operators import lexical


def test_pruned_bm25_keeps_the_best(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(0, 30))) for i in range(400)] + [(400, None)]
    queries = [(q, rng.sample(words, 6), rng.choice([1, 5, 300])) for q in range(20)] + [(20, [], 3), (21, ["unknown"], 3)]
    docs = spark.createDataFrame(items, "item_id bigint, tokens array<string>")
    asked = spark.createDataFrame(queries, "query_id bigint, terms array<string>, k int")
    ranked = lambda df: lexical.ranked(df, ["query_id"], [F.round("score", 6).desc(), F.col("item_id")])
    k = {q: k for q, _, k in queries}
    best = lambda df: {(r.query_id, r.item_id, round(r.score, 6)) for r in ranked(df).collect() if r["rank"] <= k[r.query_id]}
    assert best(lexical.bm25_top(docs, "item_id", F.col("tokens"), asked)) == best(lexical.bm25(docs, "item_id", F.col("tokens"), asked))
    assert lexical.bm25_top(docs.limit(0), "item_id", F.col("tokens"), asked).count() == 0

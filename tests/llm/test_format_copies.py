from __future__ import annotations

from pyspark.sql import functions as F

from sieveloom.llm.format_copies import canonical_case, collapsed, copies, possible_repeats

SCHEMA = "record_id bigint, id string, query string, expected array<string>, metadata_json string, _slice int, copies string"
ROWS = [
    (1, "Case-1", "Where is Straße?", ["b", "a"], '{"x": 1, "y": {"b": 2, "a": [1, 2]}}', 1, "z"),
    (4, "case_1", "  WHERE IS\tSTRASSE ", ["a", "b"], '{"y":{"a":[1,2],"b":2},"x":1}', 2, None),
    (3, "case 1", "where-is straße", ["a", "b"], '{"y":{"a":[2,1],"b":2},"x":1}', 3, None),
    (5, None, "q", None, None, None, None),
    (6, "", "Q!", [], None, None, None),
    (7, None, "q", [], "", None, None),
    (8, None, None, None, "not json", None, None),
    (9, None, "", None, "not json", None, None),
    (10, None, "?", None, "Not json", None, None),
    (11, None, "x" * 100_000, [None, "a"], "null", None, None),
    (12, None, "X " * 100_000, ["a", None], " null ", None, None),
]


def test_copies_and_singletons(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    found = sorted((r.kept_id, r.record_id) for r in copies(df, canonical_case(df)).collect())
    assert found == [(1, 4), (5, 6), (8, 9), (11, 12)]
    kept = {r.record_id: r.copies for r in collapsed(df, canonical_case(df)).collect()}
    assert kept == {1: 2, 3: 1, 5: 2, 7: 1, 8: 2, 10: 1, 11: 2}


def test_a_partitioned_filter_gives_the_same(spark):
    rows = [(i, f"id{i % 700}", "q", ["a"], None, 0, "") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for broadcast_bytes in (0, 1 << 25):
        found = {(r.kept_id, r.record_id) for r in copies(df, canonical_case(df), broadcast_bytes=broadcast_bytes).collect()}
        assert found == {(i % 700, i) for i in range(700, 2000)}


def test_few_singletons_pass_however_many_rows(spark):
    for n in (2_000, 200_000):
        df = spark.range(n).select(F.col("id").alias("record_id"))
        for broadcast_bytes in (0, 1 << 25):
            passed = possible_repeats(df, F.col("record_id").cast("string"), "record_id", broadcast_bytes, slice_bits=1 << 12).where("_repeat").count()
            assert passed < 0.05 * n


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copies(df, canonical_case(df)).count() == 0
    assert collapsed(df, canonical_case(df)).count() == 0

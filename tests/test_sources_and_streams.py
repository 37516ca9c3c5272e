from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sieveloom.sources import readers, store
from sieveloom.streaming import monitor


def test_source_files(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"x", "vendor/c.py": b"y", "src/d.py": b"a\0b", "src/e.py": b" \n", "src/f.go": b"caf\xe9\n", "big.py": b"x" * 1_000_001}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: r.content for r in readers.source_files(spark, str(tmp_path), exclude=["vendor/**"]).collect()}
    assert set(found) == {"src/a.py", "src/f.go"} and found["src/a.py"] == "x = 1\n" and found["src/f.go"].startswith("caf")


def test_evaluation_cases(spark, tmp_path):
    lines = [{"id": "a", "query": "q", "expected": ["x", "y"]}, {"query": "r", "relevant": "z"}, {"id": "c", "question": "s", "expected": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    found = {r.query: (r.id, r.expected) for r in readers.evaluation_cases(spark, str(tmp_path / "c.jsonl")).collect()}
    for name, document in (("list", lines), ("object", {"cases": lines})):
        for indent in (None, 2):
            (tmp_path / f"{name}{indent}.json").write_text(json.dumps(document, indent=indent))
            again = {r.query: (r.id, r.expected) for r in readers.evaluation_cases(spark, str(tmp_path / f"{name}{indent}.json")).collect()}
            assert again == found
    for empty in ("", "\n", "[]"):
        (tmp_path / "none.json").write_text(empty)
        with pytest.raises(ValueError, match="no cases"):
            readers.evaluation_cases(spark, str(tmp_path / "none.json"))
    assert found["q"] == ("a", ["x", "y"]) and found["r"][1] == ["z"] and found["r"][0].startswith("case-") and found["s"] == ("c", [])


def test_versioned_table(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(3).toDF("k"), "v1")
    table.write(spark.range(5).toDF("k"), "v2")
    assert (table.current(), table.versions(), table.read().count()) == ("v2", ["v1", "v2"], 5)
    table.point_to("v1")
    assert table.read().count() == 3
    seen = table.read()
    table.write(spark.range(7).toDF("k"), "v1")
    assert (seen.count(), table.read().count(), table.versions()) == (3, 7, ["v1", "v2"])
    (tmp_path / "t/v9@x").mkdir()  # a write that failed
    assert table.current() == "v1"


def test_vectors_with_a_wrong_dimension_are_refused(spark):
    old = spark.createDataFrame([(1, [1.0, 2.0])], "k bigint, v array<double>")
    assert {r.k: r.v for r in store.append_vectors(old, spark.createDataFrame([(1, [3.0, 4.0]), (2, [5.0, 6.0])], old.schema), "k", "v", 2).collect()} == {1: [3.0, 4.0], 2: [5.0, 6.0]}
    with pytest.raises(Exception, match="2 dimensions"):
        store.append_vectors(old, spark.createDataFrame([(2, [5.0])], old.schema), "k", "v", 2).collect()


def test_trace_stream_and_batch_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "event": "x", "payload": "1"}\nnot json\n{"timestamp": "2024-01-01T00:01:00Z", "event": "x"}\n')
    (tmp_path / "in/b.json").write_text('{"timestamp": "2024-01-02T00:00:00Z", "event": "y"}\n')
    stream = monitor.event_counts(monitor.read_traces(spark, str(tmp_path / "in"), 1), "event", "timestamp")
    assert {r.event: r.events for r in monitor.run_to_table(stream, "complete").collect()} == {"x": 2, "y": 1}


def test_incremental_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k bigint, v string, at int, deleted boolean"
    spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([(2, "B", 2, False), (1, None, 2, True), (3, "c", 2, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    table = store.BucketedTable(spark, str(tmp_path / "t"), "k", 8)
    plain = spark.createDataFrame([], "k bigint, v string, at int").schema
    merge = lambda old, new: monitor.upsert(old, new, "k", "at")
    assert table.read(plain).count() == 0
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    monitor.maintain(changes, table, "k", "at", str(tmp_path / "c")).awaitTermination()
    assert {r.k: r.v for r in table.read(plain).collect()} == {2: "B", 3: "c"}
    # The second batch once more, and a change that touches one bucket only.
    table.apply(spark.read.schema(schema).parquet(str(tmp_path / "in/2")), "batch-000000000001", merge)
    assert {r.k: r.v for r in table.read(plain).collect()} == {2: "B", 3: "c"}
    assert len(table.apply(spark.createDataFrame([(9, "z", 3, False)], schema), "batch-000000000002", merge)) == 1
    assert {r.k: r.v for r in table.read(plain).collect()} == {2: "B", 3: "c", 9: "z"}


def test_metrics_and_once_per_key(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", "m", 1.0, "2024-01-01"), ("r", "s", "m", 1.0, "2024-01-01"), ("q", "t", "m", 2.0, "2024-01-02")], "run_id string, suite string, metric_name string, metric_value double, t string").withColumn("event_time", F.to_timestamp("t"))
    store.write_metrics(rows, str(tmp_path / "m"))
    stream = monitor.once_per_key(spark.readStream.schema(spark.read.parquet(str(tmp_path / "m")).schema).parquet(str(tmp_path / "m")), ["run_id", "metric_name"], "event_time", "1 day")
    assert monitor.run_to_table(stream, "append").count() == 2


def test_windows_with_watermark(spark):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 00:01:10", "a", 5.0)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert {r.events: r.mean_value for r in monitor.stage_latency(events, "1 minute").collect()} == {2: 2.0, 1: 5.0}


def test_generated_source(spark):
    class Lines(readers.GeneratedSource):
        fields = "path string, content string"
        parts = 2

        @classmethod
        def name(cls):
            return "lines"

        @staticmethod
        def factory(part):
            yield f"p{part}", "x"

    spark.dataSource.register(Lines)
    assert {r.path for r in spark.read.format("lines").load().collect()} == {"p0", "p1"}

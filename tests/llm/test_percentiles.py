from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pytest

from sieveloom.llm.percentiles import Sketch, combine, percentiles, sketch

INF = float("inf")


def _off(values: list[float], estimate: float, p: float) -> int:
    wanted = max(1, math.ceil(p * len(values)))
    low, high = bisect.bisect_left(values, estimate) + 1, bisect.bisect_right(values, estimate)
    return 0 if low <= wanted <= high else min(abs(low - wanted), abs(high - wanted))


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled", "few"])
def test_ranks_keep_to_the_stated_error(spark, order):
    rng = random.Random(3)
    values = [float(i) for i in range(20_000)] if order != "few" else [float(rng.randrange(4)) for _ in range(20_000)]
    if order == "reversed":
        values.reverse()
    elif order == "shuffled":
        rng.shuffle(values)
    rows = [("a" if i % 3 else "b", v) for i, v in enumerate(values)]
    found = percentiles(sketch(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", size=64), ["g"], [0, 0.01, 0.5, 0.9, 1]).collect()
    for row in found:
        own = sorted(v for g, v in rows if g == row.g)
        assert row.n == len(own)
        assert _off(own, row.value, row.p) <= row.max_rank_error < 0.2 * len(own)


def test_days_summarised_apart_agree_with_the_whole(spark):
    rng = random.Random(5)
    rows = [(f"d{i % 7}", None if i % 11 == 0 else "g", rng.lognormvariate(0, 3)) for i in range(9000)]
    df = spark.createDataFrame(rows, "day string, g string, v double")
    united = combine(sketch(df, ["day", "g"], "v", size=32), ["g"], size=32)
    for row in percentiles(united, ["g"], [0.25, 0.5, 0.99]).collect():
        own = sorted(v for _, g, v in rows if g == row.g)
        assert row.n == len(own) and _off(own, row.value, row.p) <= row.max_rank_error


def test_null_nan_infinite_and_empty(spark):
    rows = [("a", None), ("a", float("nan")), ("a", INF), ("a", -INF), ("a", 1.0), ("b", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in percentiles(sketch(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert (found["a"].n, found["a"].n_null, found["a"].n_nan, found["a"].value, found["a"].max_rank_error) == (3, 1, 1, 1.0, 0)
    assert (found["b"].n, found["b"].n_null, found["b"].value) == (0, 1, None)
    assert found[None].value == 2.0
    assert percentiles(sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_a_clashing_column_and_wrong_arguments(spark):
    df = spark.createDataFrame([("a", 1.0, 9, "x")], "g string, v double, level int, buffer string")
    assert percentiles(sketch(df, ["g"], "v"), ["g"], [0.5]).first().value == 1.0
    with pytest.raises(ValueError, match="percentiles"):
        percentiles(sketch(df, ["g"], "v"), ["g"], [1.5])
    with pytest.raises(TypeError, match="exact"):
        sketch(df, ["v"], "v")


def test_collapse_keeps_weights():
    s = Sketch(8)
    for start in range(0, 800, 8):
        s.add(np.arange(start, start + 8, dtype=float))
    assert sum(len(b) << level for level, b, *_ in s.rows()) == 800

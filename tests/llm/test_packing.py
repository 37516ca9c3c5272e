from __future__ import annotations

import random

import pytest

from sieveloom.llm.packing import Plan, pack


@pytest.mark.parametrize("seed", range(4))
def test_every_item_is_packed_once_and_whole(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 40), rng.randrange(1, 130), 100, 100, 350]) for _ in range(1500)] + [0, None, 1000]
    rows = list(enumerate(sizes)) + [(7, 55)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").repartition(6)
    packed = pack(df, 100, tiers=(20, 50), group_size=8).toPandas()
    assert packed.groupby("doc_id").length.sum().sum() == sum(s or 0 for _, s in rows)
    used = packed.dropna(subset=["container"])
    assert set(used.window) <= {20, 50, 100} and (used.length <= used.window).all()
    assert used.groupby("container").length.sum().max() <= 100
    assert sorted(used.container.unique()) == list(range(used.container.nunique()))
    ordered = used.sort_values(["container", "offset"])
    assert (ordered.groupby("container").length.cumsum() - ordered.length == ordered.offset).all()
    assert used.length.sum() / (100 * used.container.nunique()) > 0.99
    cut = set(packed[packed.piece > 0].doc_id)
    assert cut == {i for i, s in rows if (s or 0) > 100}
    assert set(packed[packed.container.isna()].doc_id) == {i for i, s in rows if not s}
    per_group = used.drop_duplicates("container").groupby("step_group").size()
    assert per_group.max() <= 8 and per_group.max() - per_group.min() <= 1


def test_plan_grows_with_the_lengths_and_not_with_the_items():
    few = Plan(dict.fromkeys(range(1, 101), 3), 100, (25, 50))
    many = Plan(dict.fromkeys(range(1, 101), 3_000_000), 100, (25, 50))
    assert len(many.slots()) < 6000 and few.containers >= 3 * 5050 // 100
    assert many.containers <= 1.01 * 3_000_000 * 5050 / 100


def test_empty_table_and_bad_capacity(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, 10).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(df, 0)

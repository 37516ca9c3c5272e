from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "item_id", "rank", "score"] and df.count() > 0

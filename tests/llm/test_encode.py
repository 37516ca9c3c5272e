from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.llm import encode
from sieveloom.llm.byte_pairs import Transducer, encoder, merge_pairs

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(encode.BYTE_BPE_50K):
    pytest.skip("no vocabulary files here", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "Hello world's  end\n\n\tx", "a" * 5000, "<|endoftext|> <|x|>", "naïve €12 日本語テキスト 👩‍💻🇫🇷", "\x00\x01\u200b\u2028\ufeff", "снова и снова", "don't can't 'LL 123456 ---___---", "\r\n\r\n x\r", "é" * 3000, "𝒳𝒳𝒳", " " * 999]


def test_same_ids_as_the_public_library(spark, reference):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    found = encode.encode(df)
    got = {r.doc_id: list(r.ids) for r in found.collect()}
    assert found.count() == len(rows)
    assert got[99] == []
    for i, text in enumerate(TEXTS):
        assert got[i] == reference.encode(text, add_special_tokens=False).ids
    back = {r.doc_id: r.t for r in found.select("doc_id", encode.decode(F.col("ids")).alias("t")).collect()}
    assert all(back[i] == text for i, text in enumerate(TEXTS))
    assert encode.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df).distinct().collect()} == {k: len(v) for k, v in got.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    own = encoder(encode.BYTE_BPE_50K)
    clean = text.encode("utf-8", "replace").decode()
    ids = own.encode(clean)
    assert ids == t.encode(clean, add_special_tokens=False).ids
    assert "".join(own.decode(ids)) == clean


@given(st.lists(st.sampled_from("abc"), max_size=40).map("".join))
def test_transducer_equals_merging_by_definition(text):
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6, b"aab": 7, b"cab": 8, b"aaaa": 9, b"bcbc": 10}
    reachable = {t: r for t, r in ranks.items() if merge_pairs(t, ranks) == [r]}
    assert Transducer(reachable).run(text.encode()) == (merge_pairs(text.encode(), reachable) if text else [])

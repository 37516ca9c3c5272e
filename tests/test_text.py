from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sieveloom.functions import text as t


def _one(spark, expression, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expression.alias("x")).first().x


def _identifier(text):
    out = []
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]", text.replace("-", "_")):
        out.append(token.lower())
        if re.search("[A-Za-z]", token):
            out += [p for p in re.sub("([a-z0-9])([A-Z])", r"\1_\2", token).lower().split("_") if p]
    return out


@pytest.mark.parametrize("text", ["", "getHTTPResponse2Code x-y_z 42 (a+b)", "foo Foo FOO", "ünïcode wörd", "__init__ a__b"])
def test_identifier_tokens(spark, text):
    assert _one(spark, t.identifier_tokens(F.col("c0")), text) == _identifier(text)


def test_other_tokenizers(spark):
    assert _one(spark, t.camel_tokens(F.col("c0")), "parseHTTPHeader x2Y a") == ["parse", "http", "header", "x2"]
    assert _one(spark, t.stem_tokens(F.col("c0")), "Queries boxes tags is bus") == ["query", "box", "tag", "is", "bus"]
    assert _one(spark, t.word_tokens(F.col("c0")), "Größe_x 12-a") == ["größe", "x", "12", "a"]
    assert _one(spark, t.role_tokens(F.col("c0")), "RenameHTTPHandler.test_x") == ["rename", "http", "handler", "test", "x"]
    assert _one(spark, t.word_tokens(F.col("c0")), None) is None


def test_query_terms_and_expansion(spark):
    assert _one(spark, t.query_terms(F.col("c0")), "where is the db handler used, the handler?") == ["the", "db", "handler"]
    assert _one(spark, t.query_terms(F.col("c0"), expand=True), "db x")[:2] == ["db", "database"]


@pytest.mark.parametrize("path", ["src/a.py", "src/b/c.go", "a.py", "x/(y).ts"])
@pytest.mark.parametrize("pattern", ["*.py", "src/*", "src/?.py", "*/(y).*", "[sa]*", "[!s]*"])
def test_globs(spark, path, pattern):
    assert _one(spark, t.path_matches(F.col("c0"), F.col("c1")), path, f"glob:{pattern}") == fnmatch.fnmatchcase(path, pattern)


def test_paths_and_ids(spark):
    assert _one(spark, t.path_matches(F.col("c0"), F.col("c1")), "a/b/c.py", " a/b/ ")
    assert not _one(spark, t.path_matches(F.col("c0"), F.col("c1")), "a/bc.py", "a/b")
    assert _one(spark, t.stem(F.col("c0")), "a/b.test.py") == "b.test"
    assert _one(spark, t.stem(F.col("c0")), "a/.env") == ".env"
    assert _one(spark, t.directory(F.col("c0")), "a.py") == ""
    assert _one(spark, t.merge_key(F.col("c0")), " ./../a/b ") == "a/b"
    assert _one(spark, t.point_id(F.col("c0")), "a/b.py#1") == uuid.uuid5(uuid.NAMESPACE_URL, "a/b.py#1").hex
    share = int(hashlib.sha256(b"k").hexdigest()[:16], 16) / 2**64
    assert abs(_one(spark, t.hash_share(F.col("c0")), "k") - share) < 1e-12

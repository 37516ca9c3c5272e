"""Vector search over tables of queries and items."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.functions import text as t
from sieveloom.operators.lexical import ranked
from sieveloom.plans.runtime import shuffle_partitions

ITEM_BLOCK, QUERY_BLOCK = 4096, 512


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """The dot product; vectors of different lengths are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in length")))


def _blocks(rows: int, with_kind: bool = False):
    """Pack (id, vector) or (id, vector, kind) rows into blocks of normalised doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            m = np.asarray([h[1] for h in held], dtype=np.float64)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(length == 0, 1, length)
            columns = {"ids": pa.array([[h[0] for h in held]], pa.list_(pa.int64())), "matrix": pa.array([m.tobytes()], pa.binary())}
            if with_kind:
                columns["kinds"] = pa.array([[h[2] for h in held]], pa.list_(pa.string()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == rows:
                    yield out()
                    held = []
        if held:
            yield out()

    return pack


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of every row; ties at the k-th place by id."""
    keep = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep, None]
    rows, columns = np.nonzero(scores >= least)
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    inside = np.arange(len(rows)) - first[rows] < keep
    return rows[inside], columns[inside]


def _block_top(limit):
    """The best of each pair of blocks; ``limit`` gives the number for a kind (null without kinds)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_bytes, ids, matrix, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, m = np.frombuffer(q_bytes).reshape(len(q_ids), -1), np.frombuffer(matrix).reshape(len(ids), -1)
                if q.shape[1] != m.shape[1]:
                    raise ValueError("vectors differ in length")
                scores, q_ids, ids = q @ m.T, np.asarray(q_ids), np.asarray(ids)
                lanes: dict = {}
                for i, kind in enumerate(kinds or [None] * len(ids)):
                    lanes.setdefault(kind, []).append(i)
                for kind, own in lanes.items():
                    rows, columns = _best(np.round(scores[:, own], 9), ids[own], limit(kind))  # sums in another order tie
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[rows], pa.int64()), pa.array(ids[own][columns], pa.int64()), pa.array(scores[:, own][rows, columns]), pa.array([kind] * len(rows), pa.string())],
                        names=["query_id", "item_id", "score", "kind"],
                    )

    return multiply


def _grid(items: DataFrame, queries: DataFrame, limit, with_kind: bool) -> DataFrame:
    """query_id, item_id, score, kind: the best of every pair of blocks, which meet in the cells of a grid.

    Every block of items goes to one row of the grid and every block of queries to one column; copies are made for the
    cells of that row or column. Rows and columns are chosen by the counted sizes so that few copies are needed, and
    neither side is broadcast.
    """
    own = items.where("vector is not null").select("item_id", "vector", *(["kind"] if with_kind else []))
    asked = queries.where("vector is not null").select("query_id", "vector")
    cells = shuffle_partitions(items.sparkSession)
    columns = max(1, min(cells, round(math.sqrt(cells * (asked.count() + 1) / (own.count() + 1)))))
    rows = -(-cells // columns)
    schema = "ids array<bigint>, matrix binary"
    blocks = own.mapInArrow(_blocks(ITEM_BLOCK, with_kind), schema + (", kinds array<string>" if with_kind else ""))
    if not with_kind:
        blocks = blocks.withColumn("kinds", F.lit(None).cast("array<string>"))
    q_blocks = asked.mapInArrow(_blocks(QUERY_BLOCK), schema).toDF("q_ids", "q_matrix")
    spread_items = blocks.withColumn("_row", F.pmod(F.xxhash64("ids"), F.lit(rows))).withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    spread_queries = q_blocks.withColumn("_column", F.pmod(F.xxhash64("q_ids"), F.lit(columns)).cast("int")).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    met = spread_items.join(spread_queries.hint("merge"), ["_row", "_column"]).select("q_ids", "q_matrix", "ids", "matrix", "kinds")
    return met.mapInArrow(_block_top(limit), "query_id bigint, item_id bigint, score double, kind string")


def cosine_top(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, item_id, score and rank of the k nearest items of every query by cosine; ties by item_id.

    ``items`` has item_id and vector, ``queries`` query_id and vector; null vectors take no part, a zero vector has
    cosine 0 with all. The set of queries meets all items block by block: a pair of blocks is one matrix product
    that leaves k rows per query, so neither side is collected and no pair of rows is ever a row of its own.
    """
    near = _grid(items, queries, lambda kind: k, False).drop("kind")
    return ranked(near, ["query_id"], [F.round("score", 9).desc(), F.col("item_id")], k)


def cosine_lanes(items: DataFrame, queries: DataFrame, limits: dict[str, int], default: int, spare: int = 0) -> DataFrame:
    """query_id, item_id, kind, score: the best items of every query within each kind (a string, null too), all kinds in one pass.

    ``spare`` more than the limit are kept of each kind, for a later order by rounded scores.
    """
    return _grid(items, queries, lambda kind: limits.get(kind, default) + spare, True)


def lanes(scored: DataFrame, limits: dict[str, int], default: int = 0, per_path: bool = False) -> DataFrame:
    """The best items of every query within each kind, up to that kind's limit; optionally one item per path and kind.

    ``scored`` has query_id, item_id, kind, path and score.
    """
    rows = scored
    if per_path:
        rows = ranked(rows, ["query_id", "kind", "path"], [F.col("score").desc(), F.col("item_id")], 1, "_best").drop("_best")
    limit = F.coalesce(F.create_map(*[x for kind, n in limits.items() for x in (F.lit(kind), F.lit(n))])[F.col("kind")], F.lit(default))
    return ranked(rows, ["query_id", "kind"], [F.col("score").desc(), F.col("item_id")], None, "lane_rank").where(F.col("lane_rank") <= limit)


def hashed_features(items: DataFrame, key: str, text: Column, dimensions: int = 256) -> DataFrame:
    """``key``, bucket, value: signed feature hashing of the identifier tokens by MD5, at length 1 per item.

    A token adds +1 or -1, by the ninth hex digit of its hash, to the bucket that the first eight name.
    """
    digests = items.select(key, F.explode(t.identifier_tokens(text)).alias("_token")).select(key, F.md5(F.col("_token").cast("binary")).alias("_h"))
    bucket = (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    sign = F.when(F.conv(F.substring("_h", 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = digests.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).alias("_s")).where("_s != 0")
    length = F.sqrt(F.sum(F.col("_s") * F.col("_s")).over(Window.partitionBy(key)))
    return sums.select(key, "bucket", (F.col("_s") / length).alias("value"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def blake_embedding(token_lists: pd.Series) -> pd.Series:
    """Signed feature hashing of token arrays by BLAKE2b of eight bytes: bucket from the first four, sign from the fifth; 256 dimensions, length 1."""

    def embed(tokens: np.ndarray | None) -> list[float]:
        v = np.zeros(256)
        for token in tokens if tokens is not None else ():
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(digest[:4], "big") % 256] += 1.0 if digest[4] % 2 == 0 else -1.0
        length = np.linalg.norm(v)
        return list(v / length if length else v)

    return token_lists.map(embed)

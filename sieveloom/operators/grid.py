"""The best items of every query by sums over shared terms: a sparse product in the cells of a grid, where no pair is a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.plans.runtime import cores

#: What scores may differ by and yet tie when rounded; the low bits of a whole number that don't count in its order.
TIE, LOW_BITS = 2e-6, 20
#: Most items and queries of a cell, postings of an item as a rule (only for the shape of the grid), parts that an item's scores are looked up in.
ITEMS, QUERIES, POSTINGS, PARTS = 65_536, 65_536, 40, 64
#: Pairs that a cell may leave (about 50 MB); the least share of terms.
PAIRS, LEAST_SHARED = 2_000_000, 0.25


def _ordered(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The distinct values in order (null first), and the place of every value among them."""
    encoded = pa.concat_arrays(values.chunks).dictionary_encode("encode") if values.num_chunks else pa.array([], values.type).dictionary_encode("encode")
    order = pc.sort_indices(encoded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.intp)
    place[order.to_numpy()] = np.arange(len(order))
    return place[encoded.indices.to_numpy(zero_copy_only=False)], encoded.dictionary.take(order)


def _least(sums: np.ndarray, k: int) -> float:
    """At most the k-th largest sum: the k-th largest among the best of groups of items."""
    groups = sums.reshape(PARTS, -1).max(axis=0)
    if 2 * k <= len(groups):
        return np.partition(groups, len(groups) - k)[len(groups) - k]
    return np.partition(sums, len(sums) - k)[len(sums) - k] if k < len(sums) else 0


def _first(sums: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive sums as they are ordered: scores by six digits, whole numbers without their low bits, ties by place."""
    least = _least(sums, k)
    if sums.dtype == np.float64:
        found = np.flatnonzero((sums >= least - TIE) & (sums > 0) if least <= TIE else sums >= least - TIE)
        if len(found) <= k:
            return found
        order = np.floor(sums[found] * 1e6 + 0.5)
    else:
        found = np.flatnonzero(sums >= max(1, least >> LOW_BITS << LOW_BITS))
        if len(found) <= k:
            return found
        order = sums[found] >> LOW_BITS
    kth = np.partition(order, len(order) - k)[len(order) - k]
    above = order > kth
    above[np.flatnonzero(order == kth)[: k - np.count_nonzero(above)]] = True
    return found[above]


def _best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    found = _first(sums, k)
    return found, sums[found]


def _shared(sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Items that share enough of their terms with the ``size`` terms of a query; a sum has the shared ones in its low half, in its high half as often the item's own."""
    found = np.flatnonzero(sums)
    number = sums[found] & 0xFFFFFFFF
    own = (sums[found] >> 32) // np.maximum(number, 1)
    score = np.floor(np.minimum(1.0, number / np.maximum(np.minimum(own, size), 1)) * 1e6 + 0.5) / 1e6
    enough = score >= LEAST_SHARED
    return found[enough], score[enough]


def _above(sums: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.flatnonzero(sums > 0)
    return found, sums[found]


#: What a cell leaves of a query's items.
PICKS = {"best": _best, "shared": _shared, "above": _above}


def _cell(key_type: pa.DataType, part_type: pa.DataType, pick: str):
    schema = pa.schema([("query_id", pa.int64()), ("_key", key_type), ("part", part_type)])
    largest, picked = pick == "above", PICKS[pick]

    def multiply(postings: pa.Table, queries: pa.Table) -> pa.Table:
        if not postings.num_rows or not queries.num_rows:
            return schema.empty_table()
        item, keys = _ordered(postings["_key"])
        term, names = _ordered(postings["term"])
        order = np.argsort(term, kind="stable")
        item, parts = item[order], postings["part"].to_numpy()[order]
        starts = np.searchsorted(term[order], np.arange(len(names) + 1))
        size = -(-len(keys) // PARTS) * PARTS

        lists = pa.concat_arrays(queries["terms"].chunks)
        asked = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        weights = pa.concat_arrays(queries["weights"].chunks).flatten().to_numpy(zero_copy_only=False)
        limits = queries["_k"].to_numpy()
        whole = parts.dtype != np.float64

        ready: dict[tuple[int, float], tuple[np.ndarray | None, np.ndarray]] = {}  # equal terms have few weights

        def column(t: int, weight: float) -> tuple[np.ndarray | None, np.ndarray]:
            """Items and parts of a term; parts of all items where most have it."""
            own, part = item[starts[t] : starts[t + 1]], parts[starts[t] : starts[t + 1]]
            part = part if whole else part * weight
            if 8 * len(own) < size:
                return own, part
            full = np.zeros(size, parts.dtype)
            full[own] = part
            return None, full

        sums = np.zeros(size, parts.dtype)
        places, values, counts = [], [], []
        for q in range(len(limits)):
            sums[:] = 0
            met = False
            for j in range(ends[q], ends[q + 1]):
                if (t := asked[j]) < 0:
                    continue
                if largest:
                    own = item[starts[t] : starts[t + 1]]
                    sums[own] = np.maximum(sums[own], parts[starts[t] : starts[t + 1]] * weights[j])
                    met = True
                    continue
                if (column_of := ready.get((t, weights[j]))) is None:
                    column_of = ready[t, weights[j]] = column(t, weights[j])
                own, part = column_of
                if own is None:
                    np.add(sums, part, out=sums)
                else:
                    sums[own] += part
                met = True
            found, value = picked(sums, int(limits[q])) if met and limits[q] > 0 else (np.empty(0, np.intp), np.empty(0))
            places.append(found)
            values.append(value)
            counts.append(len(found))
        ids = queries["query_id"].to_numpy()
        return pa.Table.from_arrays([pa.array(np.repeat(ids, counts), pa.int64()), keys.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(values).astype(part_type.to_pandas_dtype(), copy=False))], schema=schema)

    return multiply


def shape(spark: SparkSession, items: int, queries: int, k: int, pairs: int = 0) -> tuple[int, int]:
    """Rows (of items) and columns (of queries) of the grid: some cells for every core, and for so many ``pairs`` found, with few copies of either side."""
    cells = max(4 * cores(spark), -(-pairs // PAIRS))
    rows = round(math.sqrt(cells * POSTINGS * (items + 1) / ((queries + 1) * (k + 15))))
    rows = max(1, min(cells, rows), -(-items // ITEMS))
    return rows, max(1, -(-cells // rows), -(-queries // QUERIES))


def best(postings: DataFrame, key: str, queries: DataFrame, rows: int, columns: int) -> DataFrame:
    """query_id, ``key`` and part: of each row of the grid the items with the largest sums, ties by ``key``.

    ``postings`` has ``key``, term (both once) and part, a double or a whole number; ``queries`` has query_id, terms and
    weights (arrays) and _k, the number wanted. Items go to a row of the grid, queries to a column, and every cell adds up
    all parts of its items for its queries. Scores are compared by six digits, whole numbers without their low bits.
    """
    return _grid(postings, key, queries, rows, columns, "best", dict(postings.dtypes)["part"])


def shared(postings: DataFrame, key: str, queries: DataFrame, rows: int, columns: int) -> DataFrame:
    """query_id, ``key`` and part: the shared terms over the smaller of both sets, by six digits, of all pairs where it is ``LEAST_SHARED`` or more.

    As ``best``; part of ``postings`` is the number of the item's terms, _k that of the query's.
    """
    packed = postings.withColumn("part", F.shiftleft(F.col("part").cast("bigint"), 32) + 1)
    return _grid(packed, key, queries, rows, columns, "shared", "double")


def largest(postings: DataFrame, key: str, queries: DataFrame, rows: int, columns: int) -> DataFrame:
    """query_id, ``key`` and part: the largest product of a part and a weight, of all pairs where it is above 0. As ``best``."""
    return _grid(postings, key, queries.withColumn("_k", F.lit(1)), rows, columns, "above", "double")


def _grid(postings: DataFrame, key: str, queries: DataFrame, rows: int, columns: int, pick: str, kind: str) -> DataFrame:
    key_kind = dict(postings.dtypes)[key]
    own = postings.select(F.col(key).alias("_key"), "term", "part", F.pmod(F.xxhash64(key), F.lit(rows)).cast("int").alias("_row"))
    own = own.withColumn("_cell", F.explode(F.sequence(F.col("_row") * columns, F.col("_row") * columns + columns - 1))).drop("_row")
    asked = queries.select(F.col("query_id").cast("bigint"), "terms", "weights", F.col("_k").cast("int"), F.pmod(F.xxhash64("query_id"), F.lit(columns)).cast("int").alias("_column"))
    asked = asked.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + F.col("_column")))).drop("_column")
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    met = own.repartition(rows * columns, "_cell").groupBy("_cell").cogroup(asked.repartition(rows * columns, "_cell").groupBy("_cell"))
    found = met.applyInArrow(_cell(arrow[key_kind], arrow[kind], pick), f"query_id bigint, _key {key_kind}, part {kind}")
    return found.withColumnRenamed("_key", key)

"""Percentiles of very large numeric columns from mergeable, deterministic buffer sketches.

A sketch of a group is a set of sorted buffers. A buffer of level l holds ``size`` values of weight 2**l each; the
one buffer of level 0 may be shorter and holds single values. Two full buffers of one level collapse: their values
are merged in order and every second one is kept, with twice the weight. A collapse at level l moves the rank of any
value by at most 2**l, so the sum of these, kept with the sketch as ``slack``, bounds the error of every rank the
sketch gives. Equal levels collapse as in a binary counter, hence the bound is about
n / (2 * size) * log2(n / size) for n values, whatever the order of the input and of the merges.

Sketches are rows of an ordinary table (one per buffer), so those of separate files or days can be stored, united
and collapsed later. Merging many partial sketches runs as a tree over salted groups: a task holds at most
``FAN_IN`` partial sketches of one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values per buffer: at a million values of a group the error is at most 0.13 % of the ranks, at 10**12 0.36 %.
BUFFER_SIZE = 4096
#: Partial sketches of one group that a merging task reads.
FAN_IN = 64
#: Values that a scanning task holds over all groups before it emits what it has.
HELD_VALUES = 4_000_000
#: Rows that a scanning task groups at a time.
FOLDED_ROWS = 1 << 18
BUFFER_FIELDS = [
    T.StructField("level", T.IntegerType()),
    T.StructField("buffer", T.ArrayType(T.DoubleType(), False)),
    T.StructField("slack", T.LongType()),
    T.StructField("n_null", T.LongType()),
    T.StructField("n_nan", T.LongType()),
]


class Sketch:
    """The buffers of one group while a task works on it."""

    __slots__ = ("full", "loose", "n_loose", "n_nan", "n_null", "size", "slack")

    def __init__(self, size: int):
        self.size, self.full, self.loose, self.n_loose = size, {}, [], 0
        self.slack = self.n_null = self.n_nan = 0

    def add(self, values: np.ndarray) -> None:
        """Single values without nulls and NaN, in any order."""
        if len(values):
            self.loose.append(values)
            self.n_loose += len(values)
        if self.n_loose >= 4 * self.size:
            self._settle()

    def _settle(self) -> None:
        """Cut full buffers off the loose values."""
        values = np.concatenate(self.loose) if self.loose else np.empty(0)
        whole = len(values) // self.size * self.size
        for start in range(0, whole, self.size):
            self.push(0, np.sort(values[start : start + self.size]))
        self.loose, self.n_loose = ([values[whole:]] if whole < len(values) else []), len(values) - whole

    def push(self, level: int, buffer: np.ndarray) -> None:
        """A full sorted buffer; equal levels collapse upwards."""
        while (other := self.full.pop(level, None)) is not None:
            # Alternate between the odd and the even positions by level, which lets errors of neighbouring levels cancel.
            buffer = np.sort(np.concatenate([other, buffer]), kind="stable")[level % 2 :: 2]
            self.slack += 1 << level
            level += 1
        self.full[level] = buffer

    def absorb(self, level: int, buffer: np.ndarray) -> None:
        if level == 0 and len(buffer) < self.size:
            self.add(buffer)
        else:
            self.push(level, buffer)

    def held(self) -> int:
        return self.n_loose + len(self.full) * self.size

    def rows(self) -> list[tuple[int, np.ndarray, int, int, int]]:
        """A row per buffer; the counts of the group stand in the first."""
        if self.n_loose >= self.size:
            self._settle()
        found = sorted(self.full.items())
        if self.n_loose or not found:
            found.insert(0, (0, np.sort(np.concatenate(self.loose)) if self.loose else np.empty(0)))
        return [(level, buffer, *((self.slack, self.n_null, self.n_nan) if i == 0 else (0, 0, 0))) for i, (level, buffer) in enumerate(found)]


class _Rows:
    """Buffers on their way out of a task, column by column."""

    def __init__(self, key_fields: list[pa.Field]):
        self.key_fields, self.keys, self.rows = key_fields, [], []

    def add(self, key: tuple, sketch: Sketch) -> None:
        for row in sketch.rows():
            self.keys.append(key)
            self.rows.append(row)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.keys, strict=True)) or [()] * len(self.key_fields)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, self.key_fields, strict=True)]
        buffers = [row[1] for row in self.rows]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in buffers])]).astype(np.int32)
        flat = np.concatenate(buffers) if buffers else np.empty(0)
        arrays += [pa.array([row[0] for row in self.rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))]
        arrays += [pa.array([row[i] for row in self.rows], pa.int64()) for i in (2, 3, 4)]
        names = [*(f.name for f in self.key_fields), *(f.name for f in BUFFER_FIELDS)]
        self.keys, self.rows = [], []
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _group_codes(table: pa.Table, names: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number from 0 for every row's group, and the groups by number."""
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        encoded = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        own = encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (len(encoded.dictionary) + 1) + own, return_inverse=True)[1]
    first = np.unique(codes, return_index=True)[1]
    heads = table.select(names).take(pa.array(first))
    return codes, list(zip(*(heads.column(name).to_pylist() for name in names), strict=True))


def _scan(key_fields: list[T.StructField], size: int, held_values: int):
    names = [f.name for f in key_fields]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        sketches: dict[tuple, Sketch] = {}
        out: _Rows | None = None
        waiting: list[pa.RecordBatch] = []

        def fold() -> None:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            codes, heads = _group_codes(table, names)
            column = table.column("_value").combine_chunks()
            null = column.is_null().to_numpy(zero_copy_only=False)
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            nan = np.isnan(values) & ~null
            nulls, nans = np.bincount(codes[null], minlength=len(heads)), np.bincount(codes[nan], minlength=len(heads))
            ranked = ~(null | nan)
            codes, values = codes[ranked], values[ranked]
            order = np.argsort(codes, kind="stable")
            parts = np.split(values[order], np.cumsum(np.bincount(codes, minlength=len(heads)))[:-1])
            for head, part, n_null, n_nan in zip(heads, parts, nulls.tolist(), nans.tolist(), strict=True):
                sketch = sketches.get(head)
                if sketch is None:
                    sketch = sketches[head] = Sketch(size)
                sketch.n_null += n_null
                sketch.n_nan += n_nan
                sketch.add(part)

        def emit() -> pa.RecordBatch:
            for key, sketch in sketches.items():
                out.add((*key, salt), sketch)
            sketches.clear()
            return out.take()

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _Rows([*(batch.schema.field(n) for n in names), pa.field("_salt", pa.int64())])
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= FOLDED_ROWS:
                fold()
                rows = 0
                if len(sketches) * 64 + sum(s.held() for s in sketches.values()) >= held_values:
                    yield emit()
        if waiting:
            fold()
        if sketches:
            yield emit()

    return build


def _merge(names: list[str], size: int):
    """Collapse runs of equal group and salt in input sorted by them; holds one group at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [*names, "_salt"]
        key: tuple | None = None
        sketch = Sketch(size)
        out: _Rows | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if out is None:
                out = _Rows([batch.schema.field(n) for n in by])
            heads = zip(*(column[c].to_pylist() for c in by), strict=True)
            counts = zip(*(column[c].to_pylist() for c in ("level", "slack", "n_null", "n_nan")), strict=True)
            flat, ends = column["buffer"].flatten().to_numpy(zero_copy_only=False), np.cumsum(column["buffer"].value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for head, (level, slack, n_null, n_nan), end in zip(heads, counts, ends.tolist(), strict=True):
                if head != key:
                    if key is not None:
                        out.add(key, sketch)
                    key, sketch = head, Sketch(size)
                sketch.slack += slack
                sketch.n_null += n_null
                sketch.n_nan += n_nan
                sketch.absorb(level, flat[start:end])
                start = end
            if len(out.rows) >= 256:
                yield out.take()
        if key is not None:
            out.add(key, sketch)
            yield out.take()

    return merge


def _key_fields(df: DataFrame, group: list[str]) -> list[T.StructField]:
    fields = [df.schema[c] for c in group]
    if wrong := [f.name for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType))]:
        raise TypeError(f"group columns must have exact, simple types; cast these: {wrong}")
    return [T.StructField(f.name, f.dataType) for f in fields]


def sketch(df: DataFrame, group: list[str], value: str, size: int = BUFFER_SIZE) -> DataFrame:
    """Partial sketches of ``value`` by ``group``: the group columns and one row per buffer.

    Every task sketches what it reads; nothing but buffers is shuffled. Nulls and NaN are counted, not ranked;
    infinities are values. A null in a group column is a group value like any other. An empty input gives no rows.
    """
    keys = _key_fields(df, group)
    read = df.select(*group, F.col(value).cast("double").alias("_value"))
    schema = T.StructType([*keys, T.StructField("_salt", T.LongType()), *BUFFER_FIELDS])
    partial = read.mapInArrow(_scan(keys, size, HELD_VALUES), schema)
    return _collapse(partial, group, size, read.rdd.getNumPartitions())


def _collapse(partial: DataFrame, group: list[str], size: int, salts: int) -> DataFrame:
    """Merge rounds until a group has one sketch: salts shrink by FAN_IN a round."""
    keys = [T.StructField(f.name, f.dataType) for f in partial.schema.fields if f.name in group]
    keys.sort(key=lambda f: group.index(f.name))
    while True:
        salts = math.ceil(salts / FAN_IN)
        salted = partial.withColumn("_salt", F.floor(F.col("_salt") / FAN_IN).cast("long"))
        by = [*group, "_salt"]
        schema = T.StructType([*keys, T.StructField("_salt", T.LongType()), *BUFFER_FIELDS])
        names = schema.fieldNames()
        partial = salted.select(*names).repartition(*by).sortWithinPartitions(*by, "level").mapInArrow(_merge(group, size), schema)
        if salts <= 1:
            return partial.drop("_salt")


def combine(sketches: DataFrame, group: list[str], size: int = BUFFER_SIZE) -> DataFrame:
    """One sketch per ``group`` from united sketches, for example of several days; other key columns fall away.

    Any number of sketches of a group is spread over salts by their content and merged as a tree.
    """
    parts = max(1, sketches.rdd.getNumPartitions())
    salted = sketches.select(*group, *(f.name for f in BUFFER_FIELDS)).withColumn("_salt", F.pmod(F.xxhash64("level", "buffer", "slack"), F.lit(parts * FAN_IN)))
    return _collapse(salted, group, size, parts * FAN_IN)


def percentiles(sketches: DataFrame, group: list[str], at: list[float]) -> DataFrame:
    """The values at the ranks ceil(p * n) of every sketched group, p in ``at``.

    Result: the group columns, n (ranked values), n_null, n_nan, p, value and max_rank_error. The true rank of value
    differs from ceil(p * n) by at most max_rank_error, which is 0 for groups that fit in a buffer. Groups without
    ranked values give null values. p outside 0..1 is refused.
    """
    if any(not 0 <= p <= 1 for p in at):
        raise ValueError("percentiles lie in 0..1")
    weight = F.expr("shiftleft(1L, level)")
    totals = sketches.groupBy(*group).agg(
        F.sum(F.size("buffer") * weight).alias("n"), F.sum("n_null").alias("n_null"), F.sum("n_nan").alias("n_nan"), F.sum("slack").alias("_slack"), F.max(weight).alias("_widest")
    )
    values = sketches.select(*group, F.explode("buffer").alias("value"), weight.alias("_weight"))
    # A group has at most one buffer per level here, so its window partition is bounded by the buffer size.
    reach = values.withColumn("_reach", F.sum("_weight").over(Window.partitionBy(*group).orderBy("value", "_weight").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = totals.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in at)))).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    inside = (F.col("r._reach") >= F.col("w._rank")) & (F.col("r._reach") - F.col("r._weight") < F.col("w._rank"))
    condition = inside
    for s in same:
        condition = condition & s
    joined = wanted.alias("w").join(reach.alias("r"), condition, "left")
    return joined.select(
        *(F.col(f"w.{c}").alias(c) for c in group),
        "w.n",
        "w.n_null",
        "w.n_nan",
        "w.p",
        F.col("r.value").alias("value"),
        F.when(F.col("w._widest") == 1, F.lit(0).cast("long")).otherwise(F.col("w._slack") + F.col("w._widest")).alias("max_rank_error"),
    )

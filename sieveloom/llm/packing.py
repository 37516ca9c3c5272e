"""Items of varying length packed into containers of fixed capacity, through windows of several context sizes.

Every item is routed to the tier of the shortest window that takes it, and tiers are packed from long to short. Items of
a tier first fill the gaps that longer windows have left, best fit first; the others open windows of their own tier.
In the end the windows, each as long as what it holds, are gathered into containers of the capacity, long ones first.

The packing needs only how many pieces there are of each length, a table of at most ``capacity`` rows whatever the
number of items. From it windows and containers are planned as patterns (so many with the same contents), a few rows
per length. The items are never collected or sorted: tasks number their pieces of each length locally, prefix sums over
the tasks make the numbers global, and a number falls into exactly one slot of the plan. Containers of like cost are
dealt to step groups in alternating direction, so that every group has nearly the same cost.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.plans.runtime import checkpoint

#: Numbers of pieces of one length, and lengths, that fit a slot's search key.
_NUMBER_BITS = 42
MAX_CAPACITY = 1 << 20


@dataclass
class Pattern:
    """``count`` windows or containers of one ``size`` with the same contents.

    content has (key, length, times, first): they hold what is known by that key, of that length and numbered from
    ``first`` on, ``times`` in each, in turn.
    """

    count: int
    content: list[tuple[int, int, int, int]]
    gap: int
    size: int

    def split(self, count: int) -> Pattern:
        """Take the first ``count`` off."""
        taken = Pattern(count, list(self.content), self.gap, self.size)
        self.content = [(key, length, times, first + times * count) for key, length, times, first in self.content]
        self.count -= count
        return taken


class BestFit:
    """Patterns that grow by placing many pieces of one length at a time into the smallest gap that takes them."""

    def __init__(self):
        self._open: dict[int, list[Pattern]] = {}
        self._gaps: list[int] = []

    def _keep(self, pattern: Pattern) -> None:
        if pattern.count:
            if pattern.gap not in self._open:
                insort(self._gaps, pattern.gap)
                self._open[pattern.gap] = []
            self._open[pattern.gap].append(pattern)

    def _take(self, gap: int) -> Pattern:
        pattern = self._open[gap].pop()
        if not self._open[gap]:
            del self._open[gap], self._gaps[bisect_left(self._gaps, gap)]
        return pattern

    def place(self, key: int, length: int, count: int, size: int) -> None:
        """Place ``count`` pieces; where no gap takes one, in new patterns of ``size``."""
        placed = 0
        while placed < count:
            left = count - placed
            at = bisect_left(self._gaps, length)
            fresh = at == len(self._gaps)
            pattern = Pattern(left, [], size, size) if fresh else self._take(self._gaps[at])
            times = min(pattern.gap // length, left)
            wanted = min(pattern.count, left // times)
            taken = pattern.split(wanted)
            if not fresh:
                self._keep(pattern)
            taken.content.append((key, length, times, placed))
            taken.gap -= times * length
            placed += times * wanted
            self._keep(taken)

    def patterns(self) -> list[Pattern]:
        return [p for own in self._open.values() for p in own]


class Plan:
    """Windows and containers for the given numbers of pieces by length, at most a few patterns per length."""

    def __init__(self, counts: dict[int, int], capacity: int, tiers: tuple[int, ...]):
        packed, gathered = BestFit(), BestFit()
        bounds = [0, *sorted({t for t in tiers if 0 < t < capacity}), capacity]
        for low, high in reversed([*zip(bounds, bounds[1:], strict=False)]):
            for length in sorted((n for n in counts if low < n <= high), reverse=True):
                packed.place(length, length, counts[length], high)
        self.windows = packed.patterns()
        for i, w in sorted(enumerate(self.windows), key=lambda x: (x[1].gap - x[1].size, x[0])):
            gathered.place(i, w.size - w.gap, w.count, capacity)
        self.patterns = sorted(gathered.patterns(), key=lambda p: (-self.cost(p), p.content))
        self.containers = sum(p.count for p in self.patterns)

    def cost(self, container: Pattern) -> int:
        """Work of a step on one container, where every piece attends to itself."""
        return sum(times * sum(n * length * length for _, length, n, _ in self.windows[i].content) for i, _, times, _ in container.content)

    def slots(self) -> list[tuple[int, ...]]:
        """For every length in every window of every container, by length and first number: (length, first number, times in
        a window, windows in a container, first container, offset, length of the window's contents, size of the window).
        Containers are in descending order of cost.
        """
        found, base = [], 0
        for pattern in self.patterns:
            offset = 0
            for i, used, windows, first_window in sorted(pattern.content, key=lambda c: (-c[1], c[3])):
                inner = offset
                for _, length, times, first in sorted(self.windows[i].content, key=lambda c: (-c[1], c[3])):
                    found.append((length, first + first_window * times, times, windows, base, inner, used, self.windows[i].size))
                    inner += times * length
                offset += windows * used
            base += pattern.count
        return sorted(found)


def _pieces(capacity: int):
    """Cut items above the capacity, and number the pieces of each length within the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            order = np.argsort(length, kind="stable")
            own, where, counts = np.unique(length[order], return_index=True, return_counts=True)
            number = np.empty(len(row), dtype=np.int64)
            number[order] = np.arange(len(row)) - np.repeat(where, counts) + np.repeat(seen[own], counts)
            seen[own] += counts
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (piece, start, length, number)), pa.array(np.full(len(row), task), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "piece", "start", "length", "_number", "_task"])

    return cut


def _assign(slots: list[tuple[int, ...]], containers: int, group_size: int):
    keys = np.array([(s[0] << _NUMBER_BITS) + s[1] for s in slots], dtype=np.int64)
    table = np.array(slots, dtype=np.int64).reshape(-1, 8)
    groups = max(1, -(-containers // group_size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            empty = length == 0
            if len(keys):
                slot = table[np.maximum(0, np.searchsorted(keys, (length << _NUMBER_BITS) + number, side="right") - 1)]
            else:
                slot = np.ones((len(length), 8), dtype=np.int64)
            _, first, times, windows, base, offset, used, size = slot.T
            turn = number - first
            window = turn // times
            container = base + window // windows
            place_in = offset + window % windows * used + turn % times * length
            row, place = container // groups, container % groups
            group = np.where(row % 2 == 0, place, groups - 1 - place)
            extra = [pa.array(np.ascontiguousarray(x), pa.int64(), mask=empty) for x in (container, place_in, group, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *extra], names=[*batch.schema.names[:4], "container", "offset", "step_group", "window"])

    return assign


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", tiers: tuple[int, ...] = (), group_size: int = 64) -> DataFrame:
    """Every item of ``items`` in containers of ``capacity``; only items above it are cut.

    ``tiers`` are the sizes of the shorter windows. Result: ``key``, piece (from 0), start (within the item), length,
    container (from 0), offset (within the container), step_group, window (the size of the window it is in). Items without a size (0, null) take no
    room and get no container. Containers are numbered by descending cost; a step group has at most ``group_size``.
    The order of equal lengths is that of the input. Repeated rows are items of their own. Sizes are computed once:
    they are checkpointed, as the counts and the assignment must see the same tasks.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie in 1..{MAX_CAPACITY}")
    schema = T.StructType([T.StructField(key, items.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "_number")), T.StructField("_task", T.IntegerType())])
    pieces = checkpoint(items.select(key, F.col(size).cast("long").alias("_size")).mapInArrow(_pieces(capacity), schema))
    by_task = pieces.where("length > 0").groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_count"))
    # At most `capacity` rows come to the driver: one per length.
    counts = {row["length"]: row["n"] for row in by_task.groupBy("length").agg(F.sum("_count").alias("n")).collect()}
    plan = Plan(counts, capacity, tiers)
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "_task", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    numbered = pieces.join(before, ["length", "_task"], "left").select(key, "piece", "start", "length", (F.col("_number") + F.coalesce("_before", F.lit(0))).alias("_number"))
    out = T.StructType([*schema.fields[:4], *(T.StructField(c, T.LongType()) for c in ("container", "offset", "step_group", "window"))])
    return numbered.mapInArrow(_assign(plan.slots(), plan.containers, group_size), out)

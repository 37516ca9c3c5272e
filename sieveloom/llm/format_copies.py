"""Records that differ only in formatting, collapsed to one each with the number of their copies.

Most records of a large collection occur once. Two passes keep them out of the exchange: the first sets bits for the
canonical hash of every record in a filter pair, "seen" and "seen again", built per input partition and merged slice
by slice like saturating counters; the second lets only records whose bits are all in "seen again" through to an
exact grouping by SHA-256 of the canonical form. All others are singletons and leave without a shuffle. A false
positive of the filter only costs a row in the exchange.

The filter has 16 bits for every record, however many there are. Up to ``broadcast_bytes`` it is broadcast; a larger one
stays partitioned by slice, and what then moves of a record is its key, its hash and its bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.plans.runtime import checkpoint

#: Bits of a slice of the filter, of which there are up to MOST_SLICES before they grow; a record's bits lie in one slice.
SLICE_BITS, MOST_SLICES = 1 << 16, 4096
BITS_PER_RECORD = 16
#: A filter up to this size is broadcast (for 16 million records); a larger one stays partitioned.
BROADCAST_BYTES = 32 << 20
#: A group with more rows is joined by broadcast; there are at most (rows / HOT_ROWS) of them.
HOT_ROWS = 50_000


def letters_and_digits(text: Column) -> Column:
    """The letters and digits of a text without regard to case; null counts as empty."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))  # upper case writes ß as SS
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")


def canonical_json(text: Column) -> Column:
    """A JSON value with sorted fields and no optional space; null stays null, other text stays as it is.

    Objects are sorted at every depth. Text that is not JSON, or names a field twice, only equals itself.
    """
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNull(), F.concat(F.lit("text:"), text)).otherwise(F.concat(F.lit("json:"), F.to_json(parsed)))


def canonical_case(df: DataFrame) -> Column:
    """The canonical form of an evaluation record as one string: id, query, expected entries, metadata.

    id and query: letters and digits without case, null as empty. expected: the entries in any order, null as none.
    """
    entries = F.array_sort(F.coalesce(F.col("expected"), F.array().cast("array<string>")))
    return F.to_json(F.struct(letters_and_digits(F.col("id")).alias("i"), letters_and_digits(F.col("query")).alias("q"), entries.alias("e"), canonical_json(F.col("metadata_json")).alias("m")))


def _local_filters(slice_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The filter pair of what one task reads, sorted by slice, as one compressed row per touched slice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(slice_bits, np.uint8)
        done: list[tuple[int, bytes]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([d for _, d in done], pa.binary())], names=["slice", "filters"])

        def packed() -> bytes:
            return zlib.compress(np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes(), 1)

        for batch in batches:
            number, first, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for rows in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(rows):
                    continue
                if number[rows[0]] != current:
                    if current is not None:
                        done.append((current, packed()))
                    current, counts = int(number[rows[0]]), np.zeros(slice_bits, np.uint8)
                # A record sets two bits, or one where both fall together; the second sight of a bit is remembered.
                positions = np.concatenate([first[rows], second[rows][second[rows] != first[rows]]])
                spots, times = np.unique(positions, return_counts=True)
                counts[spots] = np.minimum(2, counts[spots] + np.minimum(2, times))
            if len(done) >= 64:
                yield out()
                done = []
        if current is not None:
            done.append((current, packed()))
        yield out()

    return build


def _merge_filters(slice_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One "seen again" bitmap per slice from rows sorted by slice, as 64-bit words; slices without any bit fall away."""
    half = slice_bits // 8

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: int | None = None
        seen, again = np.zeros(half, np.uint8), np.zeros(half, np.uint8)
        done: list[tuple[int, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([w for _, w in done], pa.list_(pa.int64()))], names=["slice", "words"])

        def close() -> None:
            if number is not None and again.any():
                done.append((number, np.packbits(np.unpackbits(again), bitorder="little").view("<i8")))

        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != number:
                    close()
                    number, seen, again = n, np.zeros(half, np.uint8), np.zeros(half, np.uint8)
                both = np.frombuffer(zlib.decompress(data), np.uint8)
                again |= both[half:] | (seen & both[:half])
                seen |= both[:half]
                if len(done) * half >= 1 << 19:
                    yield out()
                    done = []
        close()
        yield out()

    return merge


def possible_repeats(records: DataFrame, canonical: Column, key: str, broadcast_bytes: int = BROADCAST_BYTES, slice_bits: int | None = None) -> DataFrame:
    """``key``, _exact (SHA-256 of the canonical form) and _repeat of ``records``; _repeat is false for those that surely occur once.

    The canonical forms are computed once and kept as hashes. Where the filter stays partitioned, AQE splits the slice
    of a hot group.
    """
    hashed = checkpoint(records.select(key, F.unhex(F.sha2(canonical, 256)).alias("_exact")))
    bits = max(SLICE_BITS, hashed.count() * BITS_PER_RECORD)
    slice_bits = slice_bits or SLICE_BITS << max(0, (bits // (SLICE_BITS * MOST_SLICES)).bit_length())
    slices = -(-bits // slice_bits)
    spot = F.xxhash64("_exact", F.lit(1))
    placed = hashed.select(
        "*",
        F.pmod(F.xxhash64("_exact"), F.lit(slices)).cast("int").alias("_slice"),
        spot.bitwiseAND(slice_bits - 1).cast("int").alias("_bit1"),
        F.shiftright(spot, 32).bitwiseAND(slice_bits - 1).cast("int").alias("_bit2"),
    )
    local = placed.select("_slice", "_bit1", "_bit2").sortWithinPartitions("_slice").mapInArrow(_local_filters(slice_bits), "slice int, filters binary")
    merged = local.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge_filters(slice_bits), "_slice int, words array<bigint>")

    def bit(position: str) -> Column:
        return F.expr(f"(shiftrightunsigned(words[shiftright({position}, 6)], {position} & 63) & 1L) = 1L")

    tested = placed.join(F.broadcast(merged) if slices * slice_bits // 8 <= broadcast_bytes else merged.hint("merge"), "_slice", "left")
    return tested.select(key, "_exact", F.coalesce(bit("_bit1") & bit("_bit2"), F.lit(False)).alias("_repeat"))


def _groups(candidates: DataFrame, key: str) -> DataFrame:
    return candidates.groupBy("_exact").agg(F.min(key).alias("kept_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def copies(records: DataFrame, canonical: Column, key: str = "record_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """kept_id and ``key`` for every record that is a copy of one with a smaller ``key``.

    ``key`` identifies a record and is not null; rows with the same key are one record. An empty input gives an empty
    result. Other columns don't matter.
    """
    candidates = checkpoint(possible_repeats(records, canonical, key, broadcast_bytes).where("_repeat").select(key, "_exact").distinct())
    groups = _groups(candidates, key)
    hot = F.broadcast(groups.where(F.col("copies") > HOT_ROWS).select("_exact", F.col("kept_id").alias("_hot_id")))
    rest = groups.where(F.col("copies") <= HOT_ROWS).select("_exact", "kept_id")
    split = candidates.join(hot, "_exact", "left")
    found = split.where("_hot_id is not null").select(F.col("_hot_id").alias("kept_id"), key).unionByName(split.where("_hot_id is null").join(rest, "_exact").select("kept_id", key))
    return found.where(F.col("kept_id") < F.col(key))


def collapsed(records: DataFrame, canonical: Column, key: str = "record_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per record, the one with the smallest ``key`` of its copies, with the number of copies."""
    marked = possible_repeats(records, canonical, key, broadcast_bytes)
    single = marked.where("not _repeat").select(F.col(key), F.lit(1).cast("long").alias("copies"))
    grouped = marked.where("_repeat").select(key, "_exact").distinct().groupBy("_exact").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    return single.unionByName(grouped.select(key, "copies"))

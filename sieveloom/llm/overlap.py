"""Evaluation records whose text also stands, exactly or nearly, in the training split.

Texts are compared as word sequences without case, punctuation and space. Every evaluation text is cut into k + 1
segments, k being the edits allowed for its length: whatever k edits do, one segment stays whole (the order of its one
or two words does not matter, so that swapped neighbours keep it). Training texts offer all word substrings of these
lengths; a segment meets the same substring of a training text with a common expected entry if their positions and
lengths allow it. Substrings that are no segment of any evaluation text are dropped by a bitmap of the segments before
the exchange. A 64-bit word signature refuses most chance meetings within the join. What remains is verified with
banded dynamic programming over words. Equal texts are compared once, and pairs of records are expanded at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.plans.runtime import checkpoint, spread

#: Shares of words: edits that segments and positions allow for, words of the shorter text that may be missing in the
#: longer, words of the longer text that may be added, and edits (a moved word is two) at all.
EDITS, MISSING, ADDED, AT_ALL = 0.45, 0.26, 0.45, 0.6
#: Words of the longest segment: n / (k + 1) words, rounded up.
LONGEST = math.ceil(1 / EDITS)
#: Bits per segment of the bitmap, and the segments up to which it is broadcast (four a word of some 32 bytes: 64 MB).
KEY_BITS, FILTER_KEYS = 16, 8_000_000
#: A key of more segments is split by rare words; such keys are broadcast up to this number.
HOT_ROWS, BROADCAST_KEYS = 1_000, 1_000_000


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of word sequences within a band of ``most`` around the diagonal; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, word in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word != b[j - 1]), far)
        row = new
        if min(row) > most:
            return far
    return row[-1]


def near(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences are the same text but for about a third of the words."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return False
    left, right = Counter(short), Counter(long)
    if (left - right).total() > MISSING * len(short) or (right - left).total() > ADDED * len(long):
        return False
    most = int(AT_ALL * len(long))
    return word_distance(short, long, most) <= most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [near(a.split(), b.split()) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _words(text: Column) -> Column:
    """The words of a text, letters and digits without case, with a space between."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def _signature(words: Column) -> Column:
    """64 bits, each set by the words whose hash falls on it."""
    bit = lambda word: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda seen, word: seen.bitwiseOR(bit(word)))


def records(cases: DataFrame, text: str) -> DataFrame:
    """record_id, text, expected, split and source of a table of cases."""
    return cases.select("record_id", F.col(text).alias("text"), "expected", "split", "source")


def _prepared(cases: DataFrame) -> DataFrame:
    """Rows by entry: record_id, held_out, entry, text (words joined), id of the text."""
    usable = cases.where("split in ('train', 'dev', 'test', 'holdout') and size(expected) > 0").where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    words = usable.select("record_id", (F.col("split") != "train").alias("held_out"), _words(F.col("text")).alias("text"), F.explode(F.array_distinct("expected")).alias("entry"))
    words = words.where("entry is not null").select("record_id", "held_out", "text", F.xxhash64("entry", F.lit(1)).alias("entry"), F.xxhash64("text").alias("text_id"))
    return spread(words)


def _grams(texts: DataFrame) -> DataFrame:
    """Texts with a hash per word (62 bits, so that three of them add up without overflow), their number and signature."""
    split = texts.select("entry", "text_id", F.split("text", " ").alias("w"))
    return split.select("entry", "text_id", F.transform("w", lambda w: F.shiftright(F.xxhash64(w), 2)).alias("h"), F.size("w").alias("n"), _signature(F.col("w")).alias("signature"))


def _key(start: Column, length: Column) -> Column:
    """The hash of an entry and the ``length`` words from ``start`` (from 0), in any order; array access stays in generated code."""
    total = F.get("h", start)
    for i in range(1, LONGEST):
        total = total + F.when(length > i, F.get("h", start + i)).otherwise(0)
    return F.xxhash64(F.col("entry"), length, total)


def _segment_count() -> Column:
    """k + 1 for a text of n words."""
    return F.least(F.greatest(F.lit(1), F.floor(F.col("n") * EDITS)).cast("int") + 1, F.col("n"))


def segments(texts: DataFrame) -> DataFrame:
    """The k + 1 segments of every evaluation text, with the position of each."""
    number = _segment_count()
    bound = lambda j: F.floor(j * F.col("n") / number).cast("int")
    each = _grams(texts).select("*", F.explode(F.sequence(F.lit(0), number - 1)).alias("j")).withColumn("position", bound(F.col("j")))
    return each.select(_key(F.col("position"), bound(F.col("j") + 1) - F.col("position")).alias("key"), "text_id", "n", "signature", "position")


def substrings(texts: DataFrame) -> DataFrame:
    """All word substrings of a segment's possible lengths of every training text, with their positions."""
    starts = F.sequence(F.lit(0), F.col("n") - 1)
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.col("n") - F.col("position")))
    whole = _grams(texts).select("*", F.explode(starts).alias("position")).select("*", F.explode(lengths).alias("length"))
    return whole.select(_key(F.col("position"), F.col("length")).alias("key"), "text_id", "n", "signature", "position")


def _spot(count: int) -> Column:
    return F.pmod("key", F.lit(max(1, count) * KEY_BITS))


def key_filter(keys: DataFrame, count: int) -> DataFrame:
    """word and bits: a bitmap of 16 bits per key as 64-bit words."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _spot(count).bitwiseAND(63).cast("int"))
    return keys.groupBy(F.shiftright(_spot(count), 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def among(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The ``rows`` whose key may be one of ``keys`` (``count`` of them), by the broadcast bitmap; all rows where it were too large."""
    if count > FILTER_KEYS:
        return rows
    placed = rows.withColumn("word", F.shiftright(_spot(count), 6)).join(F.broadcast(key_filter(keys, count)), "word")
    set_there = F.call_function("shiftrightunsigned", F.col("bits"), _spot(count).bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return placed.where(set_there).select(*rows.columns)


def _once_per_text(rows: DataFrame) -> DataFrame:
    """One row per key and text with the first and last of its positions, partitioned by key for the join.

    A long text that repeats itself would else meet another one once for every two of its places.
    """
    return rows.repartition("key").groupBy("key", "text_id", "n", "signature").agg(F.min("position").alias("first"), F.max("position").alias("last"))


def _plausible() -> Column:
    """Positions, lengths and signatures that near texts may have."""
    e, t = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"t.{c}"))
    shift = F.greatest(e("first") - t("last"), t("first") - e("last")) <= F.greatest(e("n"), t("n")) * EDITS + 1
    lengths = F.least(e("n"), t("n")) >= F.greatest(e("n"), t("n")) * (1 - ADDED) - 1
    missing = F.when(e("n") <= t("n"), F.bit_count(e("signature").bitwiseAND(F.bitwise_not(t("signature"))))).otherwise(F.bit_count(t("signature").bitwiseAND(F.bitwise_not(e("signature")))))
    return shift & lengths & (missing <= F.least(e("n"), t("n")) * MISSING)


def _rare_words(texts: DataFrame) -> DataFrame:
    """text_id and the hashes of the rarest words of every text, one more than near texts may lack.

    A word that stands twice is two words. If the rarest words of a text are all missing in another one, more than the
    shares ADDED and MISSING are: near texts therefore have one of these words of both in common.
    """
    split = texts.select("text_id", F.split("text", " ").alias("w"))
    words = split.select("text_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    counted = words.groupBy("text_id", "n", "word").agg(F.count(F.lit(1)).alias("times"))
    frequency = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    each = counted.join(frequency.hint("merge"), "word").select("text_id", "n", "df", "word", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    order = Window.partitionBy("text_id").orderBy("df", "word", "time")  # a group is the words of one text
    return each.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.floor(F.col("n") * ADDED) + 1).select("text_id", F.xxhash64("word", "time").alias("rare"))


def _candidates(rows: DataFrame, hot_rows: int) -> DataFrame:
    """held_out_text and train_text that share a segment at allowed positions, an entry, and enough of their signatures.

    Keys that more than ``hot_rows`` texts have (a frequent segment of a frequent entry) meet on a rare word as well, which
    loses no near pair and splits the key.
    """
    held_out = rows.where("held_out").select("entry", "text_id", "text").distinct()
    train = rows.where("not held_out").select("entry", "text_id", "text").distinct()
    count = held_out.select(F.size(F.split("text", " ")).alias("n")).agg(F.sum(_segment_count()).alias("s")).first()["s"] or 0
    cut = _once_per_text(segments(held_out))
    found = _once_per_text(among(substrings(train), segments(held_out), count))
    hot = cut.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select("key")
    n_hot = hot.count()
    pair = [F.col("e.text_id").alias("held_out_text"), F.col("t.text_id").alias("train_text")]
    # Counted sizes, no estimates: both sides grow by a generator, which the optimizer does not foresee.
    if n_hot == 0:
        return cut.alias("e").join(found.hint("merge").alias("t"), (F.col("e.key") == F.col("t.key")) & _plausible()).select(*pair).distinct()
    hot = checkpoint(hot)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot.hint("merge")
    plain = cut.join(hot, "key", "left_anti").alias("e").join(found.join(hot, "key", "left_anti").hint("merge").alias("t"), (F.col("e.key") == F.col("t.key")) & _plausible()).select(*pair)
    rare = checkpoint(_rare_words(rows.select("text_id", "text").dropDuplicates(["text_id"])))
    narrowed = lambda df: df.join(hot, "key", "left_semi").join(rare.hint("merge"), "text_id")
    split = narrowed(cut).alias("e").join(narrowed(found).hint("merge").alias("t"), (F.col("e.key") == F.col("t.key")) & (F.col("e.rare") == F.col("t.rare")) & _plausible()).select(*pair)
    return plain.unionByName(split).distinct()


def overlaps(cases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """held_out_id and train_id of records with near texts and a common expected entry, one in train, one held out.

    ``cases`` has record_id, text, expected, split and source, see ``records``. Splits other than train, dev, test
    and holdout (null too), null texts, texts without letters or digits, and records without expected entries take no
    part. Rows with the same record_id are one record. Every pair is a row, within larger groups as well.
    """
    rows = checkpoint(_prepared(cases))
    candidates = _candidates(rows, hot_rows)
    texts = rows.select("text_id", "text").dropDuplicates(["text_id"])
    pairs = (
        candidates.join(texts.select(F.col("text_id").alias("held_out_text"), F.col("text").alias("a")).hint("merge"), "held_out_text")
        .join(texts.select(F.col("text_id").alias("train_text"), F.col("text").alias("b")).hint("merge"), "train_text")
        .select("held_out_text", "train_text", "a", "b")
        .mapInArrow(_verify, "held_out_text bigint, train_text bigint")
    )
    own = rows.where("held_out").select(F.col("text_id").alias("held_out_text"), "entry", F.col("record_id").alias("held_out_id"))
    other = rows.where("not held_out").select(F.col("text_id").alias("train_text"), "entry", F.col("record_id").alias("train_id"))
    return pairs.join(own.hint("merge"), "held_out_text").join(other.hint("merge"), ["train_text", "entry"]).select("held_out_id", "train_id").distinct()


def by_split_and_source(cases: DataFrame) -> DataFrame:
    """Held-out records by split and source, those with an overlap, and their pairs; groups without any count 0."""
    found = overlaps(cases).groupBy("held_out_id").agg(F.count(F.lit(1)).alias("own_pairs"))
    held_out = cases.where("split in ('dev', 'test', 'holdout')").dropDuplicates(["record_id"])
    return (
        held_out.join(found.withColumnRenamed("held_out_id", "record_id"), "record_id", "left")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("own_pairs").alias("overlapping"), F.coalesce(F.sum("own_pairs"), F.lit(0)).alias("pairs"))
    )

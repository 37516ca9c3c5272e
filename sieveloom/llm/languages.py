"""The language of short texts by a naive Bayes model over character n-grams, fitted on labelled texts.

A word counts by its character triples with the word's edges, and as a whole. The model is fitted on a sample of
``per_language`` labelled texts of every language (the first by a hash of the text), and keeps the ``most`` most
frequent features of each, so its size is bounded; it judges any language that the labels name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.answer_text import prose_words
from sieveloom.operators.lexical import ranked

PER_LANGUAGE, MOST = 500, 6000
#: Log odds a word: languages this near to the best are possible, and a text in another language is this far.
UNSURE, CLEAR = 2.0, 5.0
#: Words whose scores a worker keeps.
KEPT_WORDS = 200_000


def features(word: str) -> list[str]:
    edged = f"_{word}_"
    return [edged, *(edged[i : i + 3] for i in range(len(edged) - 2) if len(edged) > 3)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for word in prose_words(text):
                for feature in features(word):
                    counts[lang, feature] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "feature", "n"])


class Model:
    """Log probabilities of features by language."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for lang, feature, n in rows:
            counts[lang][feature] = n
        self.languages = sorted(counts)
        known = {f for c in counts.values() for f in c}
        sums = [sum(counts[lang].values()) + 0.5 * len(known) for lang in self.languages]
        self.scores = {f: tuple(math.log((counts[lang].get(f, 0) + 0.5) / total) for lang, total in zip(self.languages, sums, strict=True)) for f in known}
        self._words: dict[str, tuple[float, ...] | None] = {}

    def word(self, word: str) -> tuple[float, ...] | None:
        """The scores of a word; null where nothing of it is known."""
        if word not in self._words:
            if len(self._words) >= KEPT_WORDS:
                self._words.clear()
            found = [self.scores[f] for f in features(word) if f in self.scores]
            self._words[word] = tuple(map(sum, zip(*found, strict=True))) if found else None
        return self._words[word]

    def total(self, words: list[str]) -> dict[str, float]:
        """The mean score of the known words by language; empty below three known words."""
        found = [s for s in map(self.word, words) if s is not None]
        return {lang: sum(column) / len(found) for lang, column in zip(self.languages, zip(*found, strict=True), strict=True)} if len(found) >= 3 else {}


def other_language(asked: dict[str, float], said: dict[str, float]) -> bool:
    """Whether a text (scores by language) is in another language than any that the question may be in; false where either is unknown."""
    if not asked or not said:
        return False
    possible = [lang for lang, score in asked.items() if score >= max(asked.values()) - UNSURE]
    return max(said.values()) - max(said[lang] for lang in possible) >= CLEAR


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """The model of a table with text and lang; rows without either take no part."""
    rows = labelled.where("text is not null and lang is not null and trim(text) != ''").select("lang", "text")
    sample = ranked(rows, ["lang"], [F.xxhash64("text"), F.col("text")], per_language).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, feature string, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    kept = ranked(counted, ["lang"], [F.col("n").desc(), F.col("feature")], most)
    return Model([(r.lang, r.feature, r.n) for r in kept.select("lang", "feature", "n").collect()])

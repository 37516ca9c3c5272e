"""Broken question and answer pairs, each with its kind of defect.

Whether an answer was cut short is judged against all answers. Whole responses are sorted by text, and a response
that is the beginning of its neighbour and stops within a sentence is a shortened version of it. The same comparison
of neighbours' common prefixes runs over word triples: the last words of an answer without an end mark are looked up
among the triples of all ended sentences, where they either end a sentence, or go on (as the beginning of a longer
word, too). Lengths at which unfinished answers pile up are limits. Emptiness, refusal, echo and language are rules
on the text of one pair.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm import answer_text as rules
from sieveloom.llm.languages import Model, fit, other_language
from sieveloom.plans.runtime import checkpoint, shuffle_partitions, spread

#: A length is a limit if unfinished answers have it so many times as often as the lengths around it, and by so many
#: standard deviations of a count like theirs.
SPIKE_TIMES, SPIKE_DEVIATIONS, SPIKE_AROUND = 8, 8, 10
#: A word never ends a sentence if it does so in this share of its places at most, of five at least.
RARE_END = 0.01


def _raw_state(raw: str | None, answer: str) -> str:
    """whole: valid JSON; cut: breaks off where the answer does; other."""
    if not raw or not raw.strip():
        return "other"
    body = re.sub(r"^```\w*\s*|\s*```$", "", raw.strip())
    try:
        json.loads(body)
        return "whole"
    except ValueError:
        pass
    tail = answer.rstrip()[-20:]
    return "cut" if tail and any(raw.rstrip().endswith(json.dumps(tail, ensure_ascii=a)[1:-1]) for a in (True, False)) else "other"


def _rules(model: Model):
    """Judge every pair by itself; what its end shows is kept for the lookups among all answers."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = lru_cache(50_000)(lambda question: model.total(rules.plain_words(question)))
        for batch in batches:
            ids, questions, answers, raws = (c.to_pylist() for c in batch.columns)
            out: dict[str, list] = {k: [] for k in ("defect", "cut", "raw", "first", "second", "last", "length")}
            for question, answer, raw in zip(questions, answers, raws, strict=True):
                defect, cut, state, tail = None, False, "other", None
                if rules.empty(answer):
                    defect = "empty"
                elif rules.refusal(answer):
                    defect = "refusal"
                elif rules.echo(question, answer):
                    defect = "echo"
                elif other_language(asked(question or ""), model.total(rules.prose_words(answer))):
                    defect = "wrong_language"
                else:
                    cut, state, tail = rules.visibly_cut(answer), _raw_state(raw, answer), rules.ends_openly(answer)
                first, second, last = tail or (None, None, None)
                for key, value in zip(out, (defect, cut, state, first, second, last, len(answer or "")), strict=True):
                    out[key].append(value)
            types = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["outcome_id", *out])

    return judge


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word triples of ended sentences with how often a sentence ends or goes on there, summed within a batch."""
    for batch in batches:
        ends: Counter = Counter()
        goes_on: Counter = Counter()
        for answer in batch.column(0).to_pylist():
            for sentence, ended in rules.sentences(answer):
                if ended:
                    for a, b, c, end in rules.windows(sentence):
                        (ends if end else goes_on)[a, b, c] += 1
        keys = [*(ends | goes_on)]
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([x[k] for k in keys], pa.int64()) for x in (ends, goes_on)]
        yield pa.RecordBatch.from_arrays(columns, names=["first", "second", "word", "ends", "goes_on"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in sorted order that begin the next different text; the last text of a task is emitted as its edge."""
    task = TaskContext.get().partitionId()
    previous: str | None = None
    first = True
    found: list[tuple] = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if first:
                found.append((task, "head", text))
                first = False
            if previous is not None and text != previous and text.startswith(previous):
                found.append((task, "short", previous))
            previous = text
    if previous is not None:
        found.append((task, "tail", previous))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], names=["task", "kind", "text"])


def shortened_versions(texts: DataFrame) -> DataFrame:
    """The distinct values of the one column of ``texts`` that are a proper beginning of another value.

    Sorted by text, a beginning stands directly before a longer version, whatever lies on which partition. The first
    and the last text of every partition are compared apart: two rows per partition.
    """
    name = texts.columns[0]
    distinct = texts.where(F.col(name).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(shuffle_partitions(texts.sparkSession), name).sortWithinPartitions(name)
    found = ranged.mapInArrow(_shortened, "task int, kind string, text string")
    edges = found.where("kind != 'short'").withColumn("after", F.lead("text").over(Window.orderBy("task", F.when(F.col("kind") == "head", 0).otherwise(1))))
    across = edges.where("kind = 'tail' and after is not null and startswith(after, text) and after != text")
    return found.where("kind = 'short'").select("text").unionByName(across.select("text"))


def defects(outcomes: DataFrame, labelled: DataFrame) -> DataFrame:
    """outcome_id and defect (empty, truncated, refusal, echo, wrong_language) of the defective rows of ``outcomes``.

    ``labelled`` has texts with their language (text, lang), to which the language model is fitted.

    ``outcomes`` has outcome_id, question, answer and raw_prediction. A row has one defect at most, the first of the
    order empty, refusal, echo, wrong_language, truncated. A null question leaves echo and wrong_language out; a null
    raw_prediction only takes away evidence. Repeated rows give repeated results; other columns are ignored.
    """
    id_type = outcomes.schema["outcome_id"].dataType.simpleString()
    read = spread(outcomes.select("outcome_id", "question", "answer", "raw_prediction"))
    judged = checkpoint(read.mapInArrow(_rules(fit(labelled)), f"outcome_id {id_type}, defect string, cut boolean, raw string, first string, second string, last string, length bigint"))
    plain = judged.where("defect is not null").select("outcome_id", "defect")
    open_ends = judged.where("defect is null and not cut and last is not null")

    answers = spread(outcomes.where("answer is not null").select("answer"))
    triples = answers.mapInArrow(_triples, "first string, second string, word string, ends bigint, goes_on bigint")
    triples = checkpoint(triples.groupBy("first", "second", "word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")))
    tails = open_ends.select("first", "second", "last").distinct()
    same, longer = F.col("word") == F.col("last"), (F.col("word") != F.col("last")) & F.col("word").startswith(F.col("last"))
    looked_up = (
        tails.join(triples, ["first", "second"], "left")
        .groupBy("first", "second", "last")
        .agg(
            F.coalesce(F.sum(F.when(same, F.col("ends"))), F.lit(0)).alias("n_ends"),
            F.coalesce(F.sum(F.when(same, F.col("goes_on"))), F.lit(0)).alias("n_goes_on"),
            F.coalesce(F.sum(F.when(longer, F.col("ends") + F.col("goes_on"))), F.lit(0)).alias("n_longer"),
            F.coalesce(F.sum("ends"), F.lit(0)).alias("any_ends"),
            F.coalesce(F.sum("goes_on"), F.lit(0)).alias("any_goes_on"),
        )
    )
    words = triples.groupBy("word").agg(F.sum("ends").alias("w_ends"), F.sum("goes_on").alias("w_goes_on")).where((F.col("w_goes_on") >= 5) & (F.col("w_ends") <= RARE_END * (F.col("w_ends") + F.col("w_goes_on"))))
    looked_up = looked_up.join(words.select(F.col("word").alias("last"), F.lit(True).alias("inner_word")), "last", "left")
    # Words that no ended sentence has and that begin another word were cut within.
    vocabulary = triples.select("word").distinct()
    unknown = tails.select(F.col("last").alias("word")).distinct().join(vocabulary, "word", "left_anti")
    cut_words = shortened_versions(vocabulary.unionByName(unknown)).withColumnRenamed("text", "word").join(unknown, "word", "left_semi")
    looked_up = looked_up.join(cut_words.select(F.col("word").alias("last"), F.lit(True).alias("cut_word")), "last", "left")
    lengths = open_ends.groupBy("length").agg(F.count(F.lit(1)).alias("rows"))
    near = Window.orderBy("length").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    usual = (F.sum("rows").over(near) - F.col("rows")) / (2 * SPIKE_AROUND)
    spikes = lengths.withColumn("usual", usual).where((F.col("rows") >= SPIKE_TIMES * F.col("usual")) & (F.col("rows") - F.col("usual") >= SPIKE_DEVIATIONS * F.sqrt(F.col("usual") + 1)))
    short = shortened_versions(outcomes.select("answer"))
    short_ids = outcomes.select("outcome_id", "answer").join(short.withColumnRenamed("text", "answer"), "answer", "left_semi").select("outcome_id").distinct().withColumn("short", F.lit(True))

    known = F.col("n_ends") + F.col("n_goes_on")
    # The lookup decides where it has seen the words; else a raw prediction that breaks off at the same place does.
    goes_on = (
        F.when(F.col("n_ends") > 0, F.col("n_goes_on") + F.col("n_longer") > 4 * F.col("n_ends"))
        .when((known + F.col("n_longer") > 0) | F.coalesce("inner_word", F.lit(False)) | F.coalesce("cut_word", F.lit(False)) | F.col("last").isin(sorted(rules.INNER_WORDS)), True)
        .when(F.col("any_ends") + F.col("any_goes_on") >= 5, F.col("any_goes_on") > 3 * F.col("any_ends"))
        .otherwise(F.col("raw") == "cut")
    )
    unfinished = (
        open_ends.join(looked_up, ["first", "second", "last"], "left")
        .join(spikes.select("length", F.lit(True).alias("spike")), "length", "left")
        .join(short_ids, "outcome_id", "left")
        .where(goes_on | F.coalesce("spike", F.lit(False)) | (F.coalesce("short", F.lit(False)) & (F.col("n_ends") == 0)))
    )
    cut = judged.where("defect is null and cut").select("outcome_id").unionByName(unfinished.select("outcome_id"))
    return plain.unionByName(cut.withColumn("defect", F.lit("truncated")))

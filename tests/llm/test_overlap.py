from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from sieveloom.llm.overlap import among, by_split_and_source, near, overlaps, word_distance

WORDS = "where does the reader convert fonts into tags for proxy how are shards restored after disk fills up and writer restarts which file defines many".split()


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9), st.integers(0, 9))
def test_band(a, b, most):
    assert word_distance(a, b, most) == min(_plain(a, b), most + 1)


def _change(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.choice("cadm")
        if kind == "c":
            words[i] = rng.choice(["frob", "quux"])
        elif kind == "a":
            words.insert(i, rng.choice(["please", "exactly"]))
        elif kind == "d" and len(words) > 4:
            words.pop(i)
        else:
            words.insert(rng.randrange(len(words)), words.pop(i))
    return words


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        base = rng.sample(WORDS, rng.randrange(4, 14)) if i % 3 == 0 or not rows else rows[-1][1].lower().replace("?", "").split()
        text = " ".join(_change(rng, base, rng.randrange(0, 3)))
        rows.append((i, rng.choice([text, text.upper() + "?", "  " + text]), [rng.choice("ab"), "hot"], rng.choice(["train", "dev", "test", None]), "s"))
    df = spark.createDataFrame(rows, "record_id bigint, text string, expected array<string>, split string, source string")
    wanted = set()
    for a in rows:
        for b in rows:
            if a[3] in ("dev", "test") and b[3] == "train" and near(a[1].lower().replace("?", "").split(), b[1].lower().replace("?", "").split()):
                wanted.add((a[0], b[0]))
    found = {(r.held_out_id, r.train_id) for r in overlaps(df).collect()}
    assert found <= wanted
    assert len(found) >= 0.99 * len(wanted)
    # Every key as a hot one: splitting it by rare words loses and adds nothing.
    assert {(r.held_out_id, r.train_id) for r in overlaps(df, hot_rows=0).collect()} == found


def test_the_segment_filter_keeps_every_segment(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    rows = spark.range(50_000).selectExpr("xxhash64(id) as key", "id")
    kept = {r.id for r in among(rows, keys, 5000).collect()}
    assert kept >= set(range(5000)) and len(kept) < 10_000
    assert among(rows, keys.limit(0), 0).count() == 0


def test_edges_of_the_input(spark):
    rows = [
        (1, "Same text here", ["x"], "train", "s"),
        (2, "same  TEXT, here!", ["y", "x"], "dev", "s"),
        (3, "same text here", ["z"], "dev", "s"),
        (4, "same text here", ["x"], None, "s"),
        (5, None, ["x"], "test", "s"),
        (6, "", ["x"], "test", None),
        (7, "same text here", [], "test", "t"),
        (8, "same text here", None, "test", "t"),
        (2, "same  TEXT, here!", ["y", "x"], "dev", "s"),
        (9, "word " * 3000, ["x", None], "train", "s"),
        (10, "word " * 3000, ["x"], "holdout", "s"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, text string, expected array<string>, split string, source string")
    assert {(r.held_out_id, r.train_id) for r in overlaps(df).collect()} == {(2, 1), (10, 9)}
    report = {(r.split, r.source): (r.records, r.overlapping, r.pairs) for r in by_split_and_source(df).collect()}
    assert report == {("dev", "s"): (2, 1, 1), ("test", "s"): (1, 0, 0), ("test", None): (1, 0, 0), ("test", "t"): (2, 0, 0), ("holdout", "s"): (1, 1, 1)}
    assert overlaps(df.limit(0)).count() == 0

from __future__ import annotations

import pytest

from sieveloom.llm.garbled import garbled, repair

GERMAN = "Für größere Projekte lädt der Dienst zunächst Änderungen und räumt danach auf."
RUSSIAN = "Обычно настройки обрабатываются за 2 миллисекунды, когда ключ повторяется."
JAPANESE = "このモジュールは古いトークンを削除し、新しいものを保存します。"


def _seen(text: str, encoding: str) -> str:
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("text", [GERMAN, RUSSIAN, JAPANESE, "It’s the planner — not “large” tags…", "À la fin, l'éditeur sera prêt."])
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1251"])
def test_round_trip(text, encoding):
    restored, kind = repair(_seen(text, encoding))
    assert restored == text and kind.startswith("utf-8 as")
    assert repair(text) == (None, "")


def test_twice_and_in_part():
    assert repair(_seen(_seen(GERMAN, "cp1252"), "cp1252"))[0] == GERMAN
    assert repair(GERMAN + "\n" + _seen(GERMAN, "cp1252"))[0] == GERMAN + "\n" + GERMAN


@pytest.mark.parametrize(("meant", "seen"), [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_single_byte_cyrillic(meant, seen):
    restored, kind = repair(RUSSIAN.encode(meant).decode(seen))
    assert restored == RUSSIAN and kind


@pytest.mark.parametrize("text", ["Typing â€œ into the box must not crash.", "| é | Ã© | seen by the gateway |", 'assert repair("Ã¼") == "ü"', "U+FFFD is shown as � by the viewer.", "├── a\n│   └── b √2 ±3 ÂME É… Ãgora", "", "plain", "é" * 900])
def test_examples_and_sound_texts(text):
    assert repair(text) == (None, "")


def test_table(spark):
    rows = [(1, _seen(GERMAN, "cp1252")), (2, GERMAN), (3, None), (4, ""), (5, "el tama�o m�ximo"), (5, "el tama�o m�ximo"), (6, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' as kind", "1 as restored")
    found = sorted((r.doc_id, r.restored, r.kind) for r in garbled(df).collect() if r.doc_id != 5)
    assert found == [(1, GERMAN, "utf-8 as cp1252")]
    assert [(r.restored, r.kind) for r in garbled(df).where("doc_id = 5").collect()] == [(None, "lost characters")] * 2
    assert garbled(df.limit(0)).count() == 0

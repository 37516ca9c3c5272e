from __future__ import annotations

import json

import pytest

from sieveloom.llm import answer_text as rules
from sieveloom.llm.defects import defects, shortened_versions
from sieveloom.llm.languages import fit, other_language

WHOLE = ["The reader logs a warning, drops the cold tags and carries on.", "Each writer owns its shards; the review module only borrows them.", "The default is 9, but large fonts may raise it to 7 without asking the proxy."]


@pytest.mark.parametrize("text", [None, "", " ", "\u200b\n", "N/A", "null", "**Answer:**", "```\n```", "<answer></answer>", "[]", "—", "(no answer)"])
def test_empty(text):
    assert rules.empty(text)


@pytest.mark.parametrize("text", ["No.", "7", "Нет.", "src/a.py", "`x`"])
def test_short_answers_are_answers(text):
    assert not rules.empty(text) and not rules.refusal(text) and rules.ends_openly(text) in (None, ("", "", "<number>"))


@pytest.mark.parametrize(
    ("text", "refused"),
    [
        ("I'm sorry, but I can't help with that. Let me know if you have another question.", True),
        ("Leider kann ich diese Frage nicht beantworten, weil die Auszüge fehlen.", True),
        ("Lo siento, pero no me es posible ayudar con eso.", True),
        ("Désolé, il m'est impossible de répondre.", True),
        ("Извините, но я не могу ответить на этот вопрос.", True),
        ('It says "I\'m sorry, I can\'t help with that" — a constant in a/b.py.', False),
        ("Sorry about the naming: Reader is the router, and it evicts tags in a/b.py.", False),
        ("YinaBuilder cannot answer requests while the disk is full; it returns an error.", False),
    ],
)
def test_refusal(text, refused):
    assert rules.refusal(text) is refused


def test_echo():
    q = "Where does the reader convert fonts into tags for the proxy?"
    assert rules.echo(q, "Question: where does the reader convert fonts into tags for the proxy?")
    assert rules.echo(q, f"{q}\n\n{q}")
    assert not rules.echo(q, "The reader converts fonts when the proxy restarts, see the journal of the module.")


LABELLED = {
    "en": "The reader logs a warning when the cold tags are dropped and carries on. What happens to the writer after the restart? Each module owns its shards, and the default is set by the review. Where does it convert fonts for the proxy?",
    "de": "Die Prüfung schlägt fehl, sobald der Speicher nicht genügt und die Datei fehlt. Wenn ein Schlüssel fehlt, müssen die Kürzel neu geschrieben werden. Was geschieht mit den Daten nach dem Neustart?",
    "ru": "Если версия устарела, то ключи приходится читать заново. Проверка завершается ошибкой, когда память заканчивается. Что происходит с данными после запуска?",
}


def _labelled(spark):
    return spark.createDataFrame([(lang, text, i) for lang, text in LABELLED.items() for i in range(3)] + [(None, "x", 0), ("en", None, 0)], "lang string, text string, n int")


def test_languages(spark):
    model = fit(_labelled(spark))
    assert model.languages == ["de", "en", "ru"]
    scores = {lang: model.total(rules.prose_words(text)) for lang, text in {"ru": "Ключи устарели, память читать заново.", "de": "Wenn der Speicher fehlt, schlägt die Prüfung fehl.", "en": "When the writer drops the tags it logs a warning."}.items()}
    for lang, found in scores.items():
        assert max(found, key=found.get) == lang
    assert other_language(scores["en"], scores["de"]) and not other_language(scores["de"], scores["de"])
    code = model.total(rules.prose_words("```python\nreturn 1\n```"))
    assert code == {} and not other_language(scores["en"], code) and not other_language({}, scores["en"])
    assert fit(_labelled(spark).limit(0)).total(["the", "reader", "logs"]) == {}


def _rows():
    q = "What happens to the tags when the reader restarts?"
    rows = [(i, q, WHOLE[i % 3], None) for i in range(30)]
    rows += [
        (100, q, WHOLE[0][:-1], None),
        (101, q, "The reader logs a warning, drops the cold tags and carr", None),
        (102, q, "Each writer owns its shards; the review module", None),
        (103, q, "See it.\n2.", None),
        (104, q, "```python\nx = f(1", None),
        (105, q, None, None),
        (106, q, "I cannot answer this question.", None),
        (107, q, q, None),
        (108, q, "Die Prüfung schlägt fehl, sobald der Speicher nicht genügt und die Datei fehlt.", None),
        (109, None, "Die Prüfung schlägt fehl, sobald der Speicher nicht genügt.", None),
        (110, q, WHOLE[1], '{"answer": "Each wri'),
        (111, q, "a/b/c.py:12", json.dumps({"answer": "a/b/c.py:12"})),
        (112, q, "x " * 50_000 + "end.", None),
        (105, q, None, None),
    ]
    return rows


def test_table(spark):
    df = spark.createDataFrame(_rows(), "outcome_id bigint, question string, answer string, raw_prediction string").selectExpr("*", "1 as defect", "2 as length")
    found = sorted((r.outcome_id, r.defect) for r in defects(df, _labelled(spark)).collect())
    assert found == [(101, "truncated"), (102, "truncated"), (103, "truncated"), (104, "truncated"), (105, "empty"), (105, "empty"), (106, "refusal"), (107, "echo"), (108, "wrong_language")]
    assert defects(df.limit(0), _labelled(spark)).count() == 0


def test_shortened_versions(spark):
    texts = [f"text {i} goes on" for i in range(200)] + ["text 7 go", "text 1", "text 7 goes on", None, "zz"]
    found = {r.text for r in shortened_versions(spark.createDataFrame([(t,) for t in texts], "t string")).collect()}
    assert found == {"text 7 go", "text 1"}

"""Rules on the text of one answer: emptiness, refusal, echo, language, and how it ends."""

from __future__ import annotations

import re
from collections import Counter

#: What stands for no answer (fixed values), compared without case and marks around.
PLACEHOLDERS = {"", "null", "none", "nil", "undefined", "n/a", "na", "n.a.", "nan", "tbd", "todo", "tba", "no answer", "empty", "answer", "response", "final answer", "antwort", "réponse", "respuesta", "ответ", "unknown answer", "placeholder", "not available", "..."}

#: Words that no sentence ends with (fixed values).
INNER_WORDS = set(
    "the a an and or but because since although though unless whereas than of with without into onto from by at for if while when whenever that which who whose such every its their our my these those as nor via per "
    "der die das den dem des ein eine einen einem einer und oder aber weil dass damit obwohl sondern denn mit ohne für von bei aus durch wenn sobald welche welcher deren dessen als zum zur im am "
    "le la les du des un une et ou mais car parce puisque quoique que qui dont avec sans pour par dans sur sous chez si lorsque leur leurs ses au aux de "
    "el los las del una y o pero porque aunque mientras que cuyo cuya con sin para por en si cuando sus al según desde hasta "
    "и или но а потому чтобы поскольку хотя если когда который которая которые что с без для из от при по в на об про через между".split()
)

#: Words that open a clause which needs another one after a comma (fixed values).
OPENING_WORDS = set("if when whenever unless although because while wenn sobald falls obwohl während lorsque quand dès puisque si cuando aunque mientras если когда хотя поскольку пока se quando embora enquanto".split())

#: Ways to decline (fixed values), as patterns over lower-case text without quotations.
REFUSALS = re.compile(
    r"\b(?:i|we)(?: am|'m|’m)? (?:really |honestly |currently |also )?(?:not able|unable|not in a position|not allowed|not permitted)\b"
    r"|\b(?:i|we) (?:can ?not|can't|can’t|could not|couldn't|won't|won’t|will not|am not going to|must decline|have to decline|decline|refuse|do not know|don't know|don’t know|would rather not|'d rather not)\b"
    r"|\bi(?:'d|’d) rather not\b|\bno idea\b|\bnot possible for me\b|\bimpossible for me\b|\b(?:falls|lies|is) outside (?:of )?what i\b|\b(?:do not|don't|don’t) have (?:enough|sufficient|access|the)\b"
    r"|\bhave no (?:access|information|way|means|idea)\b|\blook (?:this|that|it) up yourself\b|\bspeculation on my part\b|\bas an ai\b|\blanguage model\b|\bnothing in (?:these|the) (?:files|excerpts|snippets) tells me\b"
    r"|\bcan't (?:help|assist|answer) (?:you )?with (?:that|this)\b|\bbeyond what i (?:can|may)\b|\bagainst my guidelines\b"
    r"|\bkann ich (?:\w+ ){0,4}nicht\b|\bich kann (?:\w+ ){0,6}nicht\b|\bich (?:darf|möchte|will) (?:\w+ ){0,6}nicht\b|\b(?:nicht|un)möglich, (?:\w+ ){0,3}(?:zu )?(?:antworten|beantworten)|\bmir (?:eine |keine )?(?:antwort )?(?:leider )?nicht möglich\b|\bist mir (?:\w+ ){0,4}(?:nicht|un)möglich\b"
    r"|\bich (?:weiß|weiss) (?:\w+ ){0,3}nicht\b|\bich habe (?:\w+ ){0,3}(?:keinen zugriff|keine angaben|nicht genug|nicht genügend)|\bdazu (?:kann|darf) ich\b|\bbin ich nicht in der lage\b|\bich bin nicht in der lage\b|\bbedaure\b.*\bnicht\b|\breicht (?:\w+ ){0,4}nicht(?: aus)?\b|\bnicht (?:genug|genügend|ausreichend) (?:kontext|angaben|informationen)\b"
    r"|\bje ne (?:peux|puis|suis pas en mesure|sais|dispose|suis pas autorisé|saurais|connais)\b|\bm['’]est (?:pas |malheureusement )?(?:im)?possible\b|\bil m['’]est (?:impossible|pas possible)\b|\bje n['’]ai (?:pas|aucun)\b|\bje préfère ne pas\b|\bimpossible de répondre\b"
    r"|\bno (?:me es posible|puedo|podría|sé|tengo (?:suficiente|acceso|información)|estoy en condiciones|dispongo|soy capaz)\b|\bme es imposible\b|\bno puedo\b|\bno me corresponde\b|\bprefiero no\b"
    r"|\bя не (?:могу|смогу|в состоянии|знаю|имею|вправе|располагаю)\b|\bне могу (?:\w+ ){0,3}(?:ответить|помочь|сказать|определить|предоставить)|\bу меня (?:нет|недостаточно)\b|\b(?:мне )?не удалось (?:найти ответ|ответить)\b|\bответить (?:на этот вопрос )?(?:невозможно|не получится|не могу)\b|\bзатрудняюсь ответить\b|\bневозможно ответить\b"
)
#: Sentences around a refusal that say nothing about the question (fixed values).
POLITE = re.compile(
    r"^(?:(?:i'm |i am )?(?:so |very )?sorry|unfortunately|regrettably|to be honest|thank you|thanks|i apologi[sz]e|my apologies|let me know|is there anything|please (?:share|provide|send|try|rephrase|give)|perhaps you|try asking|you (?:could|may|might) (?:try|ask|want)|based on the|as an (?:ai|assistant)"
    r"|this (?:concerns|is about)|the question is about|you (?:want to know|asked|are asking) about|it (?:is|'s) about"
    r"|es tut mir|tut mir|leider|entschuldigung|bedaure|bitte|vielen dank|danke|die frage betrifft|es geht um|désolé|malheureusement|je regrette|merci|veuillez|pardon|la question porte|il s'agit|lo siento|disculpa|perdona|lamentablemente|gracias|intenta|por favor|la pregunta|se trata"
    r"|к сожалению|извините|простите|увы|спасибо|попробуйте|пожалуйста|уточните|вопрос касается|речь идёт|речь идет|вы спрашиваете)\b"
)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|‘[^’\n]*’")
_PATH = re.compile(r"\S*[/\\]\S+|\b\w+\.(?:py|js|ts|go|rs|java|c|h|cpp|css|md|json|yaml|yml|toml)\b(?::\d+)?")
_NAME = re.compile(r"\b\w*[a-zа-я]\w*[A-ZА-Я]\w*\b|\b\w+_\w+\b|\b\w+(?:\.\w+)+(?:\(\))?")
_WHOLE_ITEM = re.compile(r"[`\"'(]?(?:[\w.@+-]+[/\\])*(?:[\w@+-]+\.)+[A-Za-z]{1,5}(?::\d+(?:-\d+)?)?[`\"')]?|[`\"']?[A-Za-z]\w*(?:(?:\.|::|->)\w+)+(?:\(\))?[`\"']?|[`\"']\w+[`\"']|[-+]?\d[\d.,]*%?")
_INLINE_SIGNS = re.compile(r"[_`\"'“”«»„*>#\[\](){}]")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+", re.U)
_ENDED = re.compile(r"(?<=[.!?。])[\"'”»)\]*_]*\s+|\n+")
_LABEL = {"question", "q", "a", "answer", "frage", "antwort", "réponse", "pregunta", "respuesta", "вопрос", "ответ", "you", "asked", "your", "was", "user", "query", "prompt", "restated", "repeat", "re"}


def prose(text: str) -> str:
    """The text without code, quotations, paths and names."""
    for pattern in (_FENCE, _INLINE, _QUOTE, _PATH, _NAME):
        text = pattern.sub(" ", text)
    return text


def plain_words(question: str) -> list[str]:
    """The words of a question, which may be quoted as a whole or have underscores for spaces."""
    return [w.lower() for w in _WORD.findall(_NAME.sub(" ", _INLINE_SIGNS.sub(" ", question)))]


def prose_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(prose(text))]


def empty(answer: str | None) -> bool:
    """Null, blank, a placeholder, or markup with nothing in it."""
    if answer is None:
        return True
    bare = re.sub(r"</?[A-Za-z][^<>]*>|&nbsp;|```\w*", "", answer)
    bare = re.sub(r"[\s​‌‍⁠﻿]+", " ", bare)
    if not re.search(r"\w", bare):
        return True
    return re.sub(r"^[\W_]+|[\W_]+$", "", bare).lower() in PLACEHOLDERS


def refusal(answer: str) -> bool:
    """Declines outside of quotations and says nothing else."""
    text = _QUOTE.sub(" ", _FENCE.sub(" ", answer)).replace("’", "'")
    sentences = [s.strip(" \t*_>-#") for s in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", s)]
    declined = other = 0
    for sentence in sentences:
        lower = sentence.lower()
        if REFUSALS.search(lower):
            declined += 1
        elif not POLITE.match(lower):
            other += 1
    return declined > 0 and other == 0


def echo(question: str | None, answer: str) -> bool:
    """Has the words of the question, whatever their order and number, and hardly another."""
    asked = Counter(w.lower().replace("ß", "ss") for w in _TOKEN.findall((question or "").replace("_", " ")))
    said = [w.lower().replace("ß", "ss") for w in _TOKEN.findall(answer.replace("_", " "))]
    if len(asked) < 3 or len(said) < 3:
        return False
    fresh = [w for w in said if w not in asked and w not in _LABEL]
    joined = "".join(asked)
    fresh = [w for w in fresh if not (len(w) > 5 and any(w == a + b for a, b in zip(asked, [*asked][1:], strict=False)))] if joined else fresh
    given = set(said)
    covered = sum(1 for w in asked if w in given)
    return len(fresh) <= max(1, 0.2 * len(said)) and covered >= 0.6 * len(asked)


def mask(word: str) -> str:
    """A word for comparing sentences: names, paths and numbers as one sign each, else lower case."""
    core = word.strip("\"'“”«»„()[]*_,;:—–-")
    if not core:
        return word
    if "/" in core or "\\" in core:
        return "<path>"
    if "`" in core or re.search(r"[a-zа-яё][A-ZА-ЯЁ]", core) or re.search(r"\w[_.]\w", core) and not re.fullmatch(r"[\d.,]+", core):
        return "<name>"
    if core[0].isdigit():
        return "<number>"
    return core.lower()


def sentences(text: str) -> list[tuple[str, bool]]:
    """The sentences of the prose of an answer, and whether each has ended by a mark, a line break or a later one."""
    plain = _FENCE.sub("\n", text)
    parts = [p for p in _ENDED.split(plain) if p.strip()]
    return [(p.strip(), i < len(parts) - 1 or p.rstrip(" \t\n\"'”»)]*_").endswith((".", "!", "?", "。"))) for i, p in enumerate(parts)]


def windows(sentence: str) -> list[tuple[str, str, str, bool]]:
    """Every word with the two before it, and whether the sentence ends there."""
    words = [mask(w) for w in re.sub(r"[.!?。]+[\"'”»)\]*_]*$", "", sentence).split()]
    padded = ["", "", *words]
    return [(padded[i], padded[i + 1], padded[i + 2], i == len(words) - 1) for i in range(len(words))]


def visibly_cut(answer: str) -> bool:
    """Ends in a way no whole text does: open code or bracket, a list number, a colon, a comma, an ellipsis, a cut path."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    tail = _FENCE.sub("", text).rstrip()
    if text.endswith("```"):
        return False
    last = tail.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d+[.)]|[-*•+])", last) or re.search(r"\s(?:\d+[.)])$", last) and re.match(r"\d+[.)]", last):
        return True
    if re.search(r"(?:[:,;(\[{=/\\–—&+]|…|\.\.\.|\(\.|-)$", last):
        return True
    sentence = re.sub(r"^(?:\d+[.)]|[-*•+])\s+", "", sentences(text)[-1][0] if tail else "")
    if sentence.split()[:1] and sentence.split()[0].lower() in OPENING_WORDS and "," not in sentence and not re.search(r"[.!?。][\"'”»)\]*_]*$", sentence):
        return True
    if last.count("`") % 2 or last.count("(") > last.count(")") or last.count("“") > last.count("”") or last.count("«") > last.count("»") or last.count('"') % 2:
        return True
    return False


def ends_openly(answer: str) -> tuple[str, str, str] | None:
    """The last three words (masked) of an answer whose last sentence has no end mark; null for any other.

    A path, a name or a number on a line of its own needs no mark.
    """
    text = answer.rstrip()
    if text.endswith("```"):
        return None
    found = sentences(text)
    if not found or found[-1][1]:
        return None
    last = re.sub(r"^(?:\d+[.)]|[-*•+])\s+", "", found[-1][0])
    if _WHOLE_ITEM.fullmatch(last):
        return None
    seen = windows(last)
    return seen[-1][:3] if seen else None

"""Texts that were decoded with the wrong character encoding, and what they were meant to be.

UTF-8 read as a legacy encoding: the characters are mapped back to the legacy bytes, an automaton over the byte
classes of UTF-8 (a compiled regular expression) finds the maximal well-formed multibyte spans, and only those spans
are decoded. Spans count as evidence where the decoded characters fit: letters grown together with other letters,
runs of Cyrillic or East Asian letters, signs that stand alone by nature. One garbled letter or quotation mark that
stands alone is a cited example. Rounds repeat for texts that went wrong more than once.

One single-byte Cyrillic encoding read as another has no multibyte structure; there the letter frequencies of
Russian decide, sentence by sentence. Letters lost to U+FFFD within words are reported without a restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.plans.runtime import spread

#: Legacy encodings as which UTF-8 is often read. cp1252 here has the bytes it leaves out, and all of Latin-1, as control characters.
SEEN_AS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1250", "iso8859-15", "cp1254")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
ROUNDS = 4

#: Letters of Russian per thousand, rounded (fixed values from general knowledge of the language).
RUSSIAN = {
    "о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 44, "к": 35, "м": 32, "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19,
    "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 1, "ё": 2,
}

# The automaton: well-formed UTF-8 beyond ASCII, over characters that stand for bytes.
_TAIL = "[\x80-\xbf]"
_SEQUENCE = f"(?:[\xc2-\xdf]{_TAIL}|\xe0[\xa0-\xbf]{_TAIL}|[\xe1-\xec\xee\xef]{_TAIL}{{2}}|\xed[\x80-\x9f]{_TAIL}|\xf0[\x90-\xbf]{_TAIL}{{2}}|[\xf1-\xf3]{_TAIL}{{3}}|\xf4[\x80-\x8f]{_TAIL}{{2}})"
_SPAN = re.compile(f"{_SEQUENCE}+")
_RUN = re.compile("[^\x00-\x7f]+")
_LOST = re.compile("[^\\W\\d_]�|�[^\\W\\d_]")
_SENTENCE = re.compile(r"[^\n.!?。]+")
_CYRILLIC_WORDS = re.compile("[Ѐ-ӿ]{2,}")
_LATIN_WORDS = re.compile("[\x80-\xff‘-”†-…‰‹›€™ŒœŠšŽžŸƒˆ˜]{3,}")


def _to_bytes(encoding: str) -> dict[int, int]:
    """From a character to the character that stands for its byte; all others beyond ASCII to U+FFFF."""
    table: dict[int, int] = {}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(encoding))] = byte
        except UnicodeDecodeError:
            table[byte] = byte
    if encoding == "cp1252":
        for byte in range(0x80, 0x100):
            table.setdefault(byte, byte)
    return table


class _Map(dict):
    def __missing__(self, char: int) -> int:
        return char if char < 0x80 else 0xFFFF


def _seen_span(encoding: str) -> re.Pattern:
    """Where a span may begin in the text as it was seen: a lead byte's character before that of a tail byte."""
    table = _to_bytes(encoding)
    leads = "".join(re.escape(chr(c)) for c, b in table.items() if 0xC2 <= b <= 0xF4 and (encoding != "cp866" or b in (0xD0, 0xD1)))
    tails = "".join(re.escape(chr(c)) for c, b in table.items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{leads}][{tails}]")


_SEEN_SPAN = {encoding: _seen_span(encoding) for encoding in SEEN_AS}
_TABLES = {encoding: _Map(_to_bytes(encoding)) for encoding in {*SEEN_AS, *CYRILLIC}}
_LOG = {**{c: math.log(n / 1000) for c, n in RUSSIAN.items()}, **{c.upper(): math.log(n / 1000 / 30) for c, n in RUSSIAN.items()}}
_UNLIKELY = math.log(1e-6)


def _kind(char: str) -> str:
    """latin, cyrillic, asian, sign (stands alone by nature), mark (quotation marks and the like) or '' (not expected)."""
    code = ord(char)
    if 0xC0 <= code <= 0xFF and code not in (0xD7, 0xF7) or char in "œŒŸšŠžŽªºß":
        return "latin"
    if 0x410 <= code <= 0x44F or char in "ЁёІіЇїЄєҐґ":
        return "cyrillic"
    if 0x3000 <= code <= 0x30FF or 0x4E00 <= code <= 0x9FFF or 0xFF01 <= code <= 0xFF9F or 0xAC00 <= code <= 0xD7A3:
        return "asian"
    if char in "–—…•·×÷±€£¥°©®™§¶½¼¾²³µ≤≥≈≠√←→↑↓\xa0¿¡├─│└┌┐┘┬┴┼✅⚠🚀🐛🧪":
        return "sign"
    if char in "‘’“”„‚«»‹›´¨¸":
        return "mark"
    return ""


def _decoded(span: str) -> str:
    return span.encode("latin-1").decode("utf-8")


def _evidence(text: str, start: int, end: int, meant: str) -> int:
    """How many garbled characters a span proves; 0 for what may be there by chance or as an example."""
    kinds = [_kind(c) for c in meant]
    known = sum(map(bool, kinds))
    if 4 * known < 3 * len(kinds) or not known or kinds == ["asian"]:
        return 0
    before, after = text[start - 1 : start], text[end : end + 1]
    attached = before.isalnum() or after.isalnum()
    if attached or len(meant) > 1:
        return known
    return known if kinds[0] == "sign" else 0


def _within_latin(text: str, start: int, end: int, meant: str) -> bool:
    """Whether a span stands for Western letters or signs beside an ASCII letter, where no Cyrillic belongs."""
    return all(_kind(c) in ("latin", "mark", "sign") for c in meant) and any(c.isascii() and c.isalpha() for c in (text[start - 1 : start], text[end : end + 1]))


def _repair_utf8(text: str) -> tuple[str, int, str]:
    """The text with the spans of the best legacy encoding decoded, the garbled characters found, the encoding."""
    best: tuple[int, str, list] = (0, "", [])
    for encoding in SEEN_AS:
        if not _SEEN_SPAN[encoding].search(text):
            continue
        found, proven, covered, touched = [], 0, 0, 0
        for run in _RUN.finditer(text):
            if len(run.group()) < 2:
                continue
            spans = [*_SPAN.finditer(run.group().translate(_TABLES[encoding]))]
            for m in spans:
                start, end, meant = run.start() + m.start(), run.start() + m.end(), _decoded(m.group())
                found.append((start, end, meant))
                proven += _evidence(text, start, end, meant)
                covered += end - start
            touched += len(run.group()) if spans else 0
        # In a garbled text whole runs are made of spans; by chance spans lie scattered in runs of other letters.
        if 2 * covered < touched:
            continue
        # Cyrillic letters are lead bytes and continuation bytes of each other: chance spans are short and few.
        if encoding in ("cp1251", "koi8-r", "cp866") and not (proven >= 3 and any(len(x[2]) >= 3 for x in found)) and 2 * sum(_within_latin(text, *x) for x in found) < len(found):
            continue
        if encoding in ("mac_roman", "cp437", "cp850") and any(_kind(c) == "cyrillic" for x in found for c in x[2]) and not any(len(x[2]) >= 3 for x in found):
            continue
        if proven > best[0]:
            best = (proven, encoding, found)
    proven, encoding, found = best
    if not proven:
        return text, 0, ""
    out, last = [], 0
    for start, end, meant in found:
        if not any(map(_kind, meant)):
            continue
        out += [text[last:start], meant]
        last = end
    return "".join(out) + text[last:], proven, encoding


def _likely(text: str) -> float:
    """Log likelihood per letter as Russian."""
    letters = [c for c in text if c.isalpha()]
    return sum(_LOG.get(c, _UNLIKELY) for c in letters) / len(letters) if letters else _UNLIKELY


def _recode(text: str, seen: str, meant: str) -> str | None:
    mapped = text.translate(_TABLES[seen])
    if "￿" in mapped:
        return None
    try:
        return mapped.encode("latin-1").decode(meant)
    except UnicodeDecodeError:
        return None


def _repair_single_byte(text: str) -> tuple[str, int, str]:
    """One single-byte Cyrillic encoding read as another, or as a Western one, sentence by sentence."""
    out, last, changed, how = [], 0, 0, ""
    for m in _SENTENCE.finditer(text):
        sentence = m.group()
        own = [*_CYRILLIC_WORDS.finditer(sentence)] or [*_LATIN_WORDS.finditer(sentence)]
        joined = "".join(w.group() for w in own)
        if len(joined) < 8 or len(set(joined.lower())) < 5:
            continue
        now = _likely(joined)
        if now > -3.3:
            continue
        options = []
        for seen in ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic"):
            for meant in CYRILLIC:
                if seen != meant and (other := _recode(joined, seen, meant)) is not None and other.isalpha():
                    options.append((_likely(other), seen, meant))
        if options and (top := max(options))[0] > max(now + 0.6, -3.6):
            _, seen, meant = top
            whole = re.sub("[^\x00-\x7f]+", lambda w: _recode(w.group(), seen, meant) or w.group(), sentence)
            out += [text[last : m.start()], whole]
            last, changed, how = m.end(), changed + len(joined), f"{meant} as {seen}"
    return "".join(out) + text[last:], changed, how


def repair(text: str) -> tuple[str | None, str]:
    """The text as it was meant, as far as it can be restored, and what went wrong ('' for a sound text)."""
    steps: list[str] = []
    current = text
    for _ in range(ROUNDS):
        current, found, how = _repair_utf8(current)
        if not found:
            break
        steps.append(f"utf-8 as {how}")
    current, found, how = _repair_single_byte(current)
    if found:
        steps.append(how)
    if _LOST.search(text):
        steps.append("lost characters")
    return (current if steps and current != text else None), "; ".join(steps)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, restored, kinds = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            meant, kind = repair(text)
            if kind:
                keep.append(i)
                restored.append(meant)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(restored, pa.string()), pa.array(kinds, pa.string())], names=["doc_id", "restored", "kind"])


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id, restored and kind of the garbled texts of ``documents`` (doc_id, text).

    kind names the encodings of each round, ``utf-8 as cp1252`` for instance, or ``lost characters``; restored is null
    where nothing could be brought back. Null, empty and pure ASCII texts are sound and never reach Python. Repeated
    rows give repeated results. Other columns are ignored.
    """
    suspect = documents.select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7F]"))
    return spread(suspect).mapInArrow(_repairs, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, restored string, kind string")

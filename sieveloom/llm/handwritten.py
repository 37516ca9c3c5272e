"""Source files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Notices of generators are looked up with one multi-pattern automaton over the comment lines of a file (banners in
string literals are code that produces such files). Path rules know directories of third-party copies, lockfiles and
the suffixes of generators and minifiers. The shape of the content tells the rest: numbered series of lines that only
a program writes, text without line breaks and spaces, and files that consist of literals. Copies of library files,
renamed or slightly changed, share at least 80 % of their five-word shingles with the original.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.plans.runtime import spread

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Library shingles up to this number are broadcast (16 MB of hashes); beyond it the join shuffles.
BROADCAST_SHINGLES = 1_000_000

#: What notices say (fixed values): one of these in a comment line is enough.
NOTICES = [
    "do not edit", "do not modify", "don't edit", "do not change this file", "autogenerated", "auto-generated", "auto generated", "@generated", "code generated by", "file generated by",
    "generated automatically", "automatically generated", "generated by the", "generated from", "generated source", "generated code", "generated file", "machine-written", "machine generated",
    "machine-generated", "changes will be overwritten", "changes will be lost", "edits will be lost", "edits are lost", "edits will be overwritten", "any local change will be lost",
    "this file was produced by", "this file is produced by", "this file was generated", "this file is generated", "automatisch erzeugt", "automatisch generiert", "nicht von hand bearbeiten",
    "nicht bearbeiten", "généré automatiquement", "générée automatiquement", "ne pas modifier", "ne pas éditer", "generado automáticamente", "no editar", "no modificar", "gerado automaticamente",
    "não edite", "não editar", "создан автоматически", "сгенерирован", "не редактировать", "не изменять вручную",
]
#: What a comment says that denies it (fixed values).
DENIALS = ["not generated", "not auto", "no longer generated", "not a generated", "edit freely", "is gone", "hand-written", "handwritten", "written by hand", "instead of generat"]
#: Directories that hold copies of other projects (fixed values).
VENDOR_DIRS = "vendor|vendors|vendored|third[-_]?party|3rd[-_]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|external|externals|extern|deps|pods|carthage|godeps"
VENDORED = re.compile(rf"(?i)(?:^|/)(?:{VENDOR_DIRS})/")
GENERATED_PATH = re.compile(
    r"(?i)(?:^|/)(?:build|target|out)/gen(?:erated)?/|(?:^|/)(?:generated|__generated__|gen-src|generated-sources)/|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|go\.sum|gemfile\.lock|composer\.lock|pipfile\.lock)$"
    r"|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h)$|_pb\.(?:js|d\.ts)$|\.g(?:enerated|en)?\.[a-z]+$|[._]generated\.[a-z]+$|outerclass\.java$|_bindings\.rs$|\.(?:tab|yy)\.[ch]$|\.designer\.cs$|_string\.go$|\.g\.dart$"
)
MINIFIED_PATH = re.compile(r"(?i)[.-]min\.(?:js|css|mjs)$|[.-](?:bundle|chunk|packed)\.(?:js|css|mjs)$|\.[0-9a-f]{8,20}\.(?:js|css|mjs)$")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|pragma)|/\*|\*|--|<!--|;|\"\"\"|''')")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*\b")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_DIGITS = re.compile(r"\d+")


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in NOTICES:
        machine.add_word(phrase, 1)
    for phrase in DENIALS:
        machine.add_word(phrase, -1)
    machine.make_automaton()
    return machine


_MACHINE = _automaton()


def notice(content: str) -> bool:
    """Whether a comment line says that the file is generated and none of its words denies it."""
    lower = content.lower()
    if next(_MACHINE.iter(lower), None) is None:
        return False
    for line in lower.splitlines():
        if _COMMENT.match(line):
            marks = [mark for _, mark in _MACHINE.iter(line)]
            if marks and min(marks) > 0:
                return True
    return False


def numbered_series(lines: list[str]) -> bool:
    """Whether lines of one shape that count up one by one, or tables of bare numbers, make a good part of a file."""
    shapes: dict[str, list[int]] = defaultdict(list)
    tables = 0
    for line in lines:
        numbers = _DIGITS.findall(line)
        if not numbers:
            continue
        if not _WORD.search(_NUMBER.sub("", line)):
            tables += 1
            continue
        shapes[_WORD.sub("w", _DIGITS.sub("", line)).strip()].append(int(numbers[0][:9]))
    serial = 0
    for firsts in shapes.values():
        steps = sum(b - a == 1 for a, b in zip(firsts, firsts[1:], strict=False))
        if len(firsts) >= 4 and steps >= 0.8 * (len(firsts) - 1):
            serial += len(firsts)
    return serial >= 6 and serial >= 0.15 * len(lines) or tables >= 8 and serial + tables >= 0.6 * len(lines)


def minified(content: str, lines: list[str]) -> bool:
    """Whether code is squeezed: long lines, hardly a space, words of a letter or two."""
    code = [line for line in lines if len(line) > 200]
    size = sum(map(len, code))
    if size < 0.6 * len(content) or size < 300:
        return False
    spaces = sum(line.count(" ") for line in code) / size
    names = [w for line in code for w in _WORD.findall(_STRING.sub('""', line))]
    return spaces < 0.07 and len(names) > 30


def mainly_data(content: str) -> bool:
    """Whether literals make nearly all of a file of some size."""
    size = len(content) - content.count(" ") - content.count("\n") - content.count("\t")
    if size < 300:
        return False
    code = "\n".join(line for line in content.splitlines() if not _COMMENT.match(line) or line.lstrip()[:1] == '"')
    rest = _NUMBER.sub("", _STRING.sub("", code))
    return sum(map(len, _WORD.findall(rest))) < 0.1 * size


def kind_of(path: str | None, content: str | None) -> str | None:
    """generated, minified, vendored or data; null for what may be written by hand and for files without content."""
    if content is None or not content.strip():
        return None
    path = path or ""
    lines = [line for line in content.splitlines() if line.strip()]
    if VENDORED.search(path):
        return "vendored"
    if MINIFIED_PATH.search(path) or minified(content, lines):
        return "data" if mainly_data(content) and not MINIFIED_PATH.search(path) else "minified"
    if GENERATED_PATH.search(path) or notice(content):
        return "generated"
    if mainly_data(content):
        return "data"
    return "generated" if numbered_series(lines) else None


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kind_of(p, c) for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        keep = pa.array([i for i, k in enumerate(found) if k is not None], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([k for k in found if k is not None], pa.string())], names=["item_id", "kind"])


def _shingles(files: DataFrame, key: str, size: str) -> DataFrame:
    """``key``, ``size`` and a row for each distinct hash of five consecutive words of content.

    A shorter text is one shingle; a text without words has none.
    """

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (SHINGLE_WORDS - 1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE_WORDS))))

    # One-element arrays bind a value to a name: an expression named in a lambda function is else computed for every element.
    hashed = F.transform(F.array(F.regexp_extract_all("content", F.lit(r"(\w+)"), 1)), of)
    sized = F.transform(hashed, lambda all_: F.transform(all_, lambda h: F.struct(F.size(all_).alias(size), h.alias("_shingle"))))
    return files.where("content rlike '\\\\w'").select(key, F.inline(sized[0]))


def library_copies(files: DataFrame, library: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """item_id of files that share at least ``similarity`` (Jaccard) of their five-word shingles with a library file."""
    reference = _shingles(library, "library_file_id", "_lib")
    if reference.count() <= BROADCAST_SHINGLES:
        reference = F.broadcast(reference)
    own = _shingles(spread(files.select("item_id", "content")), "item_id", "_own")
    shared = own.join(reference, "_shingle").groupBy("item_id", "library_file_id", "_own", "_lib").agg(F.count(F.lit(1)).alias("_both"))
    return shared.where(F.col("_both") >= similarity * (F.col("_own") + F.col("_lib") - F.col("_both"))).select("item_id").distinct()


def not_handwritten(files: DataFrame, library: DataFrame) -> DataFrame:
    """item_id and kind (generated, minified, vendored, data) of the files of ``files`` that nobody wrote by hand.

    ``files`` has item_id, path and content, ``library`` has library_file_id and content. Null and blank contents are
    no cases; a null path has no path rules. Repeated rows with one item_id count once. Other columns are ignored.
    """
    read = files.select("item_id", "path", "content")
    by_file = spread(read).mapInArrow(_kinds, f"item_id {files.schema['item_id'].dataType.simpleString()}, kind string")
    copies = library_copies(read, library).withColumn("kind", F.lit("vendored"))
    return by_file.unionByName(copies).groupBy("item_id").agg(F.max("kind").alias("kind"))

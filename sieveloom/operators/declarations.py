"""Declarations of source files and the items made of them: symbols, structural chunks, manifests, purposes, lanes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.functions import text as t
from sieveloom.operators.items import DECLARATIONS, line_array, readable
from sieveloom.operators.lexical import ranked

#: Lines that a block may have, and symbols that a file has at least (fixed values).
LONGEST_BLOCK, LEAST_SYMBOLS = 500, 96
DOCUMENT_SUFFIXES = ["md", "markdown", "rst", "txt", "adoc"]
#: Names of methods that only read or set (fixed values).
ACCESSORS = ["get", "set", "is", "has"]
_MARKS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[{}]", re.S)


def declarations(files: DataFrame) -> DataFrame:
    """path, code_language, n_lines, line, indent, symbol and signature of every line that declares something, in the order of lines.

    A file has as many symbols as a quarter of its lines, but 96 at least. Files of other languages and unreadable ones
    have none.
    """
    lined = readable(files).select("path", "code_language", line_array(F.col("content")).alias("_lines"))
    lines = lined.select("path", "code_language", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("line", "text"))
    name = None
    for language, pattern in DECLARATIONS.items():
        found = F.regexp_extract("text", pattern, 1)
        name = F.when(F.col("code_language") == language, found) if name is None else name.when(F.col("code_language") == language, found)
    indent = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))
    declared = lines.select("path", "code_language", "n_lines", (F.col("line") + 1).alias("line"), indent.alias("indent"), name.alias("symbol"), F.trim("text").alias("signature")).where("symbol != ''")
    place = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return declared.withColumn("_n", place).where(F.col("_n") <= F.greatest(F.lit(LEAST_SYMBOLS), F.floor(F.col("n_lines") / 4))).drop("_n")


def qualified(declared: DataFrame) -> DataFrame:
    """Python declarations with methods as ``Class.name``: an indented one belongs to the last class before it."""
    is_class = F.col("signature").startswith("class ")
    before = F.last(F.when(is_class & (F.col("indent") == 0), F.col("symbol")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    python = declared.where("code_language = 'python'").withColumn("_class", before)
    return python.withColumn("symbol", F.when((F.col("indent") > 0) & F.col("_class").isNotNull(), F.concat_ws(".", "_class", "symbol")).otherwise(F.col("symbol"))).drop("_class")


def block_end(lines: list[str], start: int, python: bool) -> int:
    """The last line (from 1) of the block that begins on line ``start``, within 500 lines; the line itself without a block.

    In Python it goes on while lines are blank or indented deeper; else to the brace that closes the first one, braces
    in comments and strings aside.
    """
    window = lines[start - 1 : start - 1 + LONGEST_BLOCK]
    if python:
        own, end = len(window[0]) - len(window[0].lstrip()), start
        for i, text in enumerate(window[1:], start + 1):
            if text.strip():
                if len(text) - len(text.lstrip()) <= own and not re.match(r"\s*[)\]}]", text):
                    break
                end = i
        return end
    text, depth, opened = "\n".join(window), 0, False
    for found in _MARKS.finditer(text):
        if found[0] == "{":
            depth, opened = depth + 1, True
        elif found[0] == "}" and opened:
            depth -= 1
            if depth <= 0:
                return start + text.count("\n", 0, found.start())
    return start


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _block_ends(lines: pd.Series, starts: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([[block_end(list(ls), int(s), lang == "python") for s in ss] for ls, ss, lang in zip(lines, starts, language, strict=True)])


def symbol_items(files: DataFrame) -> DataFrame:
    """path, code_language, symbol, signature, indent, start_line, end_line, body and n_lines of every declaration, with its block."""
    grouped = declarations(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "symbol", "signature", "indent"))).alias("_declared"))
    lined = readable(files).select("path", "code_language", line_array(F.col("content")).alias("_lines")).join(grouped, "path")
    ended = lined.withColumn("_ends", _block_ends("_lines", F.transform("_declared", lambda s: s["line"]), "code_language"))
    each = ended.select("path", "code_language", "_lines", F.explode(F.arrays_zip(F.col("_declared").alias("d"), F.col("_ends").alias("end_line"))).alias("s"))
    length = F.col("s.end_line") - F.col("s.d.line") + 1
    return each.select(
        "path", "code_language", F.col("s.d.symbol").alias("symbol"), F.col("s.d.signature").alias("signature"), F.col("s.d.indent").alias("indent"), F.col("s.d.line").alias("start_line"), F.col("s.end_line").alias("end_line"), F.array_join(F.slice("_lines", F.col("s.d.line"), length), "\n").alias("body"), F.size("_lines").alias("n_lines")
    )


def symbol_chunks(items: DataFrame, least_file: int = 200, least_lines: int = 4, most: int = 20, characters: int = 500) -> DataFrame:
    """The first ``most`` telling symbols of long files: blocks of some lines, without private names and accessors; the text cut as an index needs it."""
    accessor = F.col("symbol").rlike("^(" + "|".join(ACCESSORS) + ")[A-Z_]")
    telling = items.where((F.col("n_lines") >= least_file) & (F.col("end_line") - F.col("start_line") + 1 >= least_lines) & ~F.col("symbol").startswith("_") & ~accessor)
    return ranked(telling, ["path"], [F.col("start_line"), F.col("symbol")], most, "position").withColumn("body", F.left("body", F.lit(characters)))


def structural_chunks(files: DataFrame, most_lines: int = 220) -> DataFrame:
    """id, path, title, kind, start_line, end_line and content: what stands before the first top-level declaration, then each of these; long ones in parts.

    Files without declarations have no structural chunks; ``items.chunks`` cuts them by lines. Parts without any
    visible character are left out.
    """
    top = symbol_items(files).where("indent = 0").select("path", F.col("symbol").alias("span"), F.lit("declaration").alias("kind"), "start_line", "end_line")
    first = top.groupBy("path").agg(F.min("start_line").alias("_first")).where("_first > 1")
    spans = top.unionByName(first.select("path", F.lit("file preamble").alias("span"), F.lit("preamble").alias("kind"), F.lit(1).alias("start_line"), (F.col("_first") - 1).alias("end_line")))
    cut = spans.withColumn("_from", F.explode(F.sequence("start_line", "end_line", F.lit(most_lines)))).withColumn("_to", F.least(F.col("_from") + most_lines - 1, F.col("end_line")))
    lined = readable(files).select("path", line_array(F.col("content")).alias("_lines"))
    body = F.array_join(F.slice("_lines", F.col("_from"), F.col("_to") - F.col("_from") + 1), "\n")
    title = F.concat(F.col("path"), F.lit("::"), F.col("span"), F.when((F.col("_from") > F.col("start_line")) | (F.col("_to") < F.col("end_line")), F.concat(F.lit(":"), F.col("_from").cast("string"), F.lit("-"), F.col("_to").cast("string"))).otherwise(""))
    digest = F.substring(F.sha1(F.concat_ws(":", "path", "span", F.col("_from").cast("string"), F.col("_to").cast("string"))), 1, 12)
    filled = cut.join(lined, "path").withColumn("content", body).where(F.col("content").rlike(r"\S"))
    return filled.select(F.concat("path", F.lit("::structural#"), digest).alias("id"), "path", title.alias("title"), "kind", F.col("_from").alias("start_line"), F.col("_to").alias("end_line"), "content")


def matches_symbol(symbol: Column, signature: Column, query: str) -> Column:
    """Whether a symbol has all words of a query in its name or signature, or the whole query when spaces and marks are taken out."""
    haystack = F.lower(F.concat_ws(" ", symbol, signature))
    compact = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    words = [w for w in re.split(r"\s+", query.lower()) if w]
    every = F.lit(bool(words))
    for w in words:
        every = every & F.contains(haystack, F.lit(w))
    return every | F.contains(compact(haystack), F.lit(re.sub("[^a-z0-9]", "", query.lower())))


def symbol_files(declared: DataFrame) -> DataFrame:
    """Files of matching symbols with their lines and a confidence that grows with their number."""
    found = declared.groupBy("path").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("symbols"))
    return found.withColumn("confidence", F.least(F.lit(0.95), 0.55 + 0.05 * F.col("symbols")))


def lane(path: Column) -> Column:
    """doc for documentation by suffix, README or a docs directory, else code."""
    lower = F.lower(path)
    is_doc = F.substring_index(lower, ".", -1).isin(DOCUMENT_SUFFIXES) | t.file_name(lower).startswith("readme") | F.concat(F.lit("/"), lower).contains("/docs/")
    return F.when(is_doc, "doc").otherwise("code")


def purposes(files: DataFrame, lines: int = 30, characters: int = 500) -> DataFrame:
    """path and purpose: the first documentation comment of the first lines as one line; files without one have no row."""
    head = readable(files).select("path", F.array_join(F.slice(line_array(F.col("content")), 1, lines), "\n").alias("head"))
    comment = F.regexp_extract("head", r"(?s)/\*\*(.*?)\*/", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(comment, r"(?m)^\s*\*", " "), r"\s+", " "))
    return head.select("path", F.left(plain, F.lit(characters)).alias("purpose")).where("purpose != ''")


def manifests(files: DataFrame, most: int = 40) -> DataFrame:
    """One text per file for its index entry: words of the path, package, imports, symbols, configuration keys, a line each."""
    body, rest = F.col("content"), readable(files)
    listed = lambda words: F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, most), ", "))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), 1))
    package = F.nullif(F.regexp_extract(body, r"(?m)^\s*package\s+([\w.]+)", 1), F.lit(""))
    imports = found(r"(?m)^\s*(?:import|from|use|#include)\s+[\"'<{(]?\s*([\w./:]+)")
    keys = F.when(F.substring_index("path", ".", -1).isin("yaml", "yml", "toml", "properties"), found(r"(?m)^([\w.-]+)\s*[:=]"))
    named = declarations(files).groupBy("path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("symbol")), 1, most), ", ").alias("symbols"))
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    text = F.concat_ws("\n", part("path", F.array_join(F.array_distinct(t.camel_tokens(F.col("path"))), " ")), part("package", package), part("imports", listed(imports)), part("symbols", F.col("symbols")), part("keys", listed(keys)))
    return rest.join(named, "path", "left").select("path", text.alias("manifest"))

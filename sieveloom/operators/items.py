"""Files to items, and looking into files: chunks, summaries, symbols, grep, excerpts, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators.lexical import ranked

#: Declarations by language family, one pattern with the name as its group (fixed values).
DECLARATIONS = {
    "python": r"(?m)^\s*(?:class|def|async def)\s+(\w+)",
    "javascript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|function|interface|enum)\s+(\w+)",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|interface|enum|type)\s+(\w+)",
    "go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)",
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|fn|mod)\s+(\w+)",
    "java": r"(?m)^\s*(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?(?:abstract\s+)?(?:class|interface|enum|record)\s+(\w+)",
    "c": r"(?m)^(?:static\s+)?(?:\w+\s+\*?)+(\w+)\([^;]*\)\s*$",
}


def line_array(content: Column) -> Column:
    """The lines of a text whatever its line ends; a last line end begins no line."""
    return F.split(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n\z", ""), "\n")


def readable(files: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """Files that a scan reads: not blank, not too large, without NUL."""
    return files.where(F.col("content").rlike(r"\S") & (F.octet_length("content") <= max_bytes) & ~F.contains("content", F.lit("\0")))


def chunks(files: DataFrame, size: int = 220) -> DataFrame:
    """Windows of ``size`` lines of every file: id, path, title, content, start_line, end_line (from 1, inclusive)."""
    lined = readable(files).select("path", line_array(F.col("content")).alias("_lines"))
    n = F.size("_lines")
    cut = lined.select("path", n.alias("_n"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.struct((i * size + 1).alias("start_line"), F.least((i + 1) * size, n).alias("end_line"), F.array_join(F.slice("_lines", i * size + 1, F.lit(size)), "\n").alias("content")))).alias("c"))
    title = F.when(F.col("_n") <= size, F.col("path")).otherwise(F.concat("path", F.lit(":"), F.col("c.start_line").cast("string"), F.lit("-"), F.col("c.end_line").cast("string")))
    return cut.where(F.col("c.content").rlike(r"\S")).select(t.chunk_id(F.col("path"), F.col("c.start_line"), F.col("c.end_line")).alias("id"), "path", title.alias("title"), "c.content", "c.start_line", "c.end_line")


def symbols(files: DataFrame) -> DataFrame:
    """path, symbol and position of the declarations of every file, by the patterns of its language."""
    pattern = None
    for language, p in DECLARATIONS.items():
        found = F.regexp_extract_all("content", F.lit(p), 1)
        pattern = F.when(F.col("code_language") == language, found) if pattern is None else pattern.when(F.col("code_language") == language, found)
    return files.select("path", "code_language", F.posexplode(pattern).alias("position", "symbol"))


def summaries(files: DataFrame, terms: int = 12) -> DataFrame:
    """One text per file: its name, suffix, symbols, imports and frequent terms, a line each."""
    rest = readable(files)
    named = symbols(files).groupBy("path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("symbol")), 1, 20), ", ").alias("symbols"))
    counted = rest.select("path", F.explode(t.camel_tokens(F.col("content"))).alias("term")).where((F.length("term") >= 4) & ~F.col("term").isin(t.STOP_WORDS)).groupBy("path", "term").agg(F.count(F.lit(1)).alias("n"))
    best = ranked(counted, ["path"], [F.col("n").desc(), F.col("term")], terms).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("terms"))
    joined = rest.select("path", "code_language").join(named, "path", "left").join(best, "path", "left")
    text = F.concat_ws("\n", F.concat(F.lit("file: "), t.file_name(F.col("path"))), F.concat(F.lit("language: "), F.col("code_language")), F.concat(F.lit("symbols: "), F.col("symbols")), F.concat(F.lit("terms: "), F.col("terms")))
    return joined.select("path", text.alias("summary"))


def numbered_lines(files: DataFrame) -> DataFrame:
    return readable(files).select("path", F.posexplode(line_array(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(files: DataFrame, pattern: str, fixed: bool = False) -> DataFrame:
    """path, line and text of the lines that contain or match a pattern."""
    hit = F.contains("text", F.lit(pattern)) if fixed else F.col("text").rlike(pattern)
    return numbered_lines(files).where(hit)


def grep_files(matches: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` files with most matches: first and last line, matches, a confidence that grows with them, and the first line's text."""
    found = matches.groupBy("path").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("matches"), F.min_by("text", "line").alias("first_text"))
    return found.withColumn("confidence", F.least(F.lit(0.95), 0.45 + 0.08 * F.col("matches"))).orderBy(F.col("matches").desc(), "path").limit(limit)


def excerpt(files: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` lines of every file from line ``start`` and whether more follow; 400 at most."""
    count = min(count, 400)
    lined = readable(files).select("path", line_array(F.col("content")).alias("_lines")).where(F.size("_lines") >= start)
    return lined.select("path", F.array_join(F.slice("_lines", start, count), "\n").alias("excerpt"), (F.size("_lines") > start - 1 + count).alias("truncated"))


def tree(files: DataFrame, depth: int) -> DataFrame:
    """Directories and files down to a depth, each with the files below it."""
    parts = files.select("path", F.split("path", "/").alias("p"))
    nodes = parts.select("path", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("depth"), "p")
    named = nodes.select("path", "depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("node"), (F.col("depth") < F.size("p")).alias("is_directory"))
    return named.groupBy("node", "depth", "is_directory").agg(F.count(F.lit(1)).alias("files"))


def outline(files: DataFrame) -> DataFrame:
    """Lines, import lines and declarations per file."""
    declared = symbols(files).groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    lines = numbered_lines(files).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text").rlike(r"^\s*(import|from|use|#include|package)\b")).alias("imports"))
    return lines.join(declared, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def generated_cases(files: DataFrame) -> DataFrame:
    """Evaluation cases made of file names: up to three questions per file; of equal questions the first file's stays."""
    words = lambda c: F.array_join(t.camel_tokens(c), " ")
    stem_words, directory_words = words(t.stem(F.col("path"))), words(t.directory(F.col("path")))
    rows = files.select(
        "path",
        F.posexplode(
            F.filter(
                F.array(
                    F.concat(F.lit("find the file named "), t.file_name(F.col("path"))),
                    F.when(stem_words != "", F.concat(F.lit("where is "), stem_words, F.lit(" implemented?"))),
                    F.when((directory_words != "") & (directory_words != stem_words), F.concat(F.lit("where is "), stem_words, F.lit(" in "), directory_words, F.lit("?"))),
                ),
                lambda q: q.isNotNull(),
            )
        ).alias("offset", "query"),
    )
    first = ranked(rows.withColumn("_key", F.lower("query")), ["_key"], [F.col("offset"), F.col("path")], 1, "_n")
    return first.select(F.concat(F.lit("local-"), F.substring(F.sha1(F.concat_ws(":", F.col("path"), F.col("query"))), 1, 12)).alias("id"), "query", "path", "offset")

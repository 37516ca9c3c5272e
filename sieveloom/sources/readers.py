"""Source files and evaluation data sets as DataFrames, and a data source for row generators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveloom.functions.text import glob_regex

#: Suffixes of text that a scan reads (fixed values).
SUFFIXES = ["c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "html", "java", "js", "json", "jsx", "kt", "kts", "md", "php", "properties", "proto", "py", "rb", "rs", "scala", "sh", "sql", "swift", "toml", "ts", "tsx", "txt", "xml", "yaml", "yml"]
MAX_BYTES = 1_000_000
#: How a document with a list of cases begins.
_CASES = re.compile(r'\{\s*"cases"\s*:')


def source_files(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES, exclude: list[str] = ()) -> DataFrame:
    """path (below ``root``) and content of the text files of a tree.

    Files that are larger than a million bytes, hold a NUL byte or nothing but space are left out, as are paths that
    match an exclude pattern; a pattern that ends in ``/**`` excludes a directory at any depth. Malformed UTF-8 is
    replaced.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    below = F.element_at(F.split(F.regexp_replace("path", "^file:/+", "/"), base.replace("[", r"\\["), 2), -1)
    files = read.where(F.col("length") <= MAX_BYTES).select(below.alias("path"), F.col("content").alias("_bytes"))
    files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(suffixes) & (F.instr("path", ".") > 0))
    for pattern in exclude:
        if pattern.endswith("/**"):
            # A run of whole segments, each a pattern of its own, at any depth.
            run = "/".join(re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in pattern[:-3].split("/"))
            files = files.where(~F.col("path").rlike(f"(^|/){run}/"))
        else:
            files = files.where(~F.rlike(F.col("path"), glob_regex(F.lit(pattern))))
    text = F.make_valid_utf8(F.col("_bytes").cast("string"))
    return files.select("path", text.alias("content")).where(~F.contains("content", F.lit("\0")) & F.col("content").rlike(r"\S"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, query, expected (array), metadata_json of a data set: JSON lines, a JSON list, or an object with the list ``cases``.

    ``expected`` or ``relevant`` is a list or one entry; a missing id becomes ``case-`` and a hash of the query. A
    single-document file is one value of one task; large sets are JSON lines. An empty data set is an error.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no cases")
    head = first["value"].lstrip()
    if head.startswith("[") or _CASES.match(head) or head.rstrip() == "{":
        whole = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.get_json_object("value", "$.cases"), F.col("value"))
        raw = whole.select(F.explode(F.from_json(listed, "array<string>")).alias("value"))
        if raw.isEmpty():
            raise ValueError(f"{path} has no cases")
    else:
        raw = lines
    entry = F.coalesce(F.get_json_object("value", "$.expected"), F.get_json_object("value", "$.relevant"))
    expected = F.when(F.startswith(F.trim(entry), F.lit("[")), F.from_json(entry, "array<string>")).otherwise(F.array(entry))
    query = F.coalesce(F.get_json_object("value", "$.query"), F.get_json_object("value", "$.question"))
    case_id = F.coalesce(F.get_json_object("value", "$.id"), F.concat(F.lit("case-"), F.substring(F.sha1(query), 1, 12)))
    return raw.select(case_id.alias("id"), query.alias("query"), expected.alias("expected"), F.get_json_object("value", "$.metadata").alias("metadata_json"))


class GeneratedSource(DataSource):
    """Rows of a Python generator as a data source, one partition per part.

    ``factory`` takes the part's number and yields tuples; subclass with ``name``, ``fields`` and ``parts``.
    """

    fields = "path string, content string"
    parts = 1
    factory: Callable[[int], Iterator[tuple]]

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return self.fields

    def reader(self, schema) -> DataSourceReader:
        outer = self

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(i) for i in range(outer.parts)]

            def read(self, partition):
                yield from type(outer).factory(partition.value)

        return Reader()

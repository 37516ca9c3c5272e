"""File graphs: edges from the text of files, adjacency, fan-in, expansion and propagation over tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.text import directory
from sieveloom.operators import grid
from sieveloom.operators.lexical import ranked
from sieveloom.plans.runtime import checkpoint

#: Weights of edges by kind (fixed values).
EDGE_WEIGHTS = {"same_file_next": 0.6, "summarizes": 0.7, "references": 0.85, "imports": 0.8, "contains": 0.75, "calls": 0.9}
REVERSE = 0.7
#: Import lines by how their target is named (fixed values): dots and module, module, relative path, header, dotted class.
IMPORTS = {
    "python_relative": r"(?m)^[ \t]*from[ \t]+(\.+[\w.]*)[ \t]+import",
    "python": r"(?m)^[ \t]*(?:from|import)[ \t]+(\w[\w.]*)",
    "script": r"(?m)^[ \t]*(?:import|export)[^;\n]*?from[ \t]+[\"'](\.[./\w-]*)[\"']",
    "c": r"(?m)^[ \t]*#include[ \t]+\"([\w./-]+)\"",
    "jvm": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?((?:\w+\.)+\w+)",
}
#: Suffixes of the files of a language family (fixed values).
FAMILIES = {"python": ["py", "pyi"], "script": ["ts", "tsx", "js", "jsx", "mjs"], "c": ["c", "h", "cc", "cpp", "hpp"], "jvm": ["java", "kt", "kts", "scala", "groovy"]}
#: What stands for a directory as a module (fixed values).
INDEX_FILES = {"python": "__init__", "script": "index"}


def _below(parts: Column, up: Column, rest: Column) -> Column:
    """The path ``rest`` below the directory ``parts`` after going ``up`` directories."""
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
    return F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit("")))


def import_edges(files: DataFrame, most: int = 64) -> DataFrame:
    """src, dst, kind, weight from import lines to the files they name, at most ``most`` per file, the first by path.

    Python modules and relative script and header paths are paths without suffix, or the index file of a directory; a
    relative one counts from the file's own directory. A dotted JVM name is the end of a path: its parts with a capital
    are tried as the class from right to left, and the first that any file matches counts. A file doesn't import itself.
    """
    suffix = F.substring_index("path", ".", -1)
    family = None
    for name, suffixes in FAMILIES.items():
        family = F.when(suffix.isin(suffixes), name) if family is None else family.when(suffix.isin(suffixes), name)
    own_dir = directory(F.col("path"))
    parts = F.filter(F.split(own_dir, "/"), lambda p: p != "")
    known = files.where(F.contains("path", F.lit("."))).select("path", "content", family.alias("family"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), parts.alias("parts")).where("family is not null")

    def named(how: str, by: str) -> DataFrame:
        return known.where(F.col("family") == by).select(F.col("path").alias("src"), "family", "parts", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORTS[how]), 1))).alias("name"))

    module = F.regexp_replace("name", r"^\.+", "")
    dots = F.length("name") - F.length(module)
    up = F.size(F.regexp_extract_all("name", F.lit(r"(\.\./)"), 1))
    wanted = [
        named("python_relative", "python").withColumn("stem", _below(F.col("parts"), dots - 1, F.replace(module, F.lit("."), F.lit("/")))),
        named("python", "python").withColumn("stem", F.replace("name", F.lit("."), F.lit("/"))),
        named("script", "script").withColumn("stem", _below(F.col("parts"), up, F.regexp_replace("name", r"^(?:\.{1,2}/)+", ""))),
        named("c", "c").withColumn("stem", _below(F.col("parts"), F.lit(0), F.regexp_replace("name", r"\.[^./]*$", ""))),
    ]
    paths = wanted[0]
    for other in wanted[1:]:
        paths = paths.unionByName(other)
    index = F.when(F.col("family") == "python", F.array("stem", F.concat("stem", F.lit("/" + INDEX_FILES["python"])))).when(F.col("family") == "script", F.array("stem", F.concat("stem", F.lit("/" + INDEX_FILES["script"])))).otherwise(F.array("stem"))
    targets = known.select(F.col("path").alias("dst"), "family", "stem")
    first = ranked(targets, ["family", "stem"], [F.col("dst")], most + 1, "_n").drop("_n")
    by_path = paths.select("src", "family", F.explode(index).alias("stem")).distinct().join(first, ["family", "stem"]).select("src", "dst")

    segments = named("jvm", "jvm").withColumn("p", F.split("name", r"\."))
    tried = segments.select("src", "name", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("at")).where(F.get("p", F.col("at") - 1).rlike("^[A-Z]")).select("src", "name", "at", F.array_join(F.slice("p", F.lit(1), F.col("at")), "/").alias("tail"))
    ends = known.where("family = 'jvm'").select(F.col("path").alias("dst"), F.split("stem", "/").alias("p")).select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("tail"))
    met = tried.join(ranked(ends, ["tail"], [F.col("dst")], most + 1, "_n").drop("_n"), "tail")
    furthest = met.groupBy("src", "name").agg(F.max("at").alias("at"))
    by_class = met.join(furthest, ["src", "name", "at"]).select("src", "dst")

    found = by_path.unionByName(by_class).where("src != dst").distinct()
    return ranked(found, ["src"], [F.col("dst")], most).select("src", "dst", F.lit("imports").alias("kind"), F.lit(EDGE_WEIGHTS["imports"]).alias("weight"))


def reference_edges(files: DataFrame, most: int = 24) -> DataFrame:
    """src, dst, kind, weight from paths named in the text, whole or without leading directories.

    Suffixes of all paths are exploded once, which turns the suffix test into an equality join; an ambiguous suffix
    goes to the shortest path, then the first by name.
    """
    named = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"((?:[\w-]+/)+[\w-]+\.[a-z]{1,4})"), 1))).alias("suffix"))
    parts = files.select(F.col("path").alias("dst"), F.split("path", "/").alias("p"))
    suffixes = parts.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("suffix"))
    met = ranked(named.join(suffixes, "suffix"), ["src", "suffix"], [F.length("dst"), F.col("dst")], 1, "_best").where("src != dst").select("src", "dst").distinct()
    return ranked(met, ["src"], [F.col("dst")], most).select("src", "dst", F.lit("references").alias("kind"), F.lit(EDGE_WEIGHTS["references"]).alias("weight"))


def symbol_edges(files: DataFrame, most: int = 24) -> DataFrame:
    """src, dst, kind, weight from camel-case names in the text to the files that have the name as title."""
    named = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), 1))).alias("title"))
    titled = ranked(files.where("title is not null").select(F.col("path").alias("dst"), "title"), ["title"], [F.col("dst")], most + 1, "_n").drop("_n")
    found = named.join(titled, "title").where("src != dst").select("src", "dst").distinct()
    return ranked(found, ["src"], [F.col("dst")], most).select("src", "dst", F.lit("references").alias("kind"), F.lit(0.7).alias("weight"))


def call_edges(files: DataFrame, imports: DataFrame, most: int = 20) -> DataFrame:
    """src, dst, kind, weight from Python files to those that declare a function they call, at most ``most`` per file.

    A name that the file declares itself is its own. Of several files that declare a name an imported one goes first,
    then the first by path. A common name is one row before the join, however many files declare it.
    """
    python = files.where("code_language = 'python'")
    names = lambda pattern, column: python.select(F.col("path").alias(column), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).alias("name"))
    declared = names(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", "dst")
    called = names(r"\b([A-Za-z_]\w*)\(", "src").join(declared.withColumnRenamed("dst", "src"), ["src", "name"], "left_anti")
    first = declared.groupBy("name").agg(F.min("dst").alias("_first"))
    imported = called.join(imports.select("src", "dst"), "src").join(declared, ["dst", "name"]).groupBy("src", "name").agg(F.min("dst").alias("_imported"))
    chosen = called.join(first, "name").join(imported, ["src", "name"], "left").select("src", F.coalesce("_imported", "_first").alias("dst")).where("src != dst").distinct()
    return ranked(chosen, ["src"], [F.col("dst")], most).select("src", "dst", F.lit("calls").alias("kind"), F.lit(EDGE_WEIGHTS["calls"]).alias("weight"))


def summary_edges(spans: DataFrame, key: str, most: int = 80) -> DataFrame:
    """src, dst, kind, weight from every file, as the item that summarizes it, to its first ``most`` items by start line and key."""
    first = ranked(spans, ["path"], [F.col("start_line").asc_nulls_last(), F.col(key)], most)
    return first.select(F.col("path").alias("src"), F.col(key).alias("dst"), F.lit("summarizes").alias("kind"), F.lit(EDGE_WEIGHTS["summarizes"]).alias("weight"))


def symbol_parents(symbols: DataFrame) -> DataFrame:
    """src, dst, kind, weight from the symbol ``A`` of a file to its ``A.b``; of equal symbols the last by line counts.

    ``symbols`` has path, symbol and line.
    """
    last = symbols.groupBy("path", "symbol").agg(F.max("line").alias("line"))
    child = last.where(F.contains("symbol", F.lit("."))).select("path", F.regexp_replace("symbol", r"\.[^.]*$", "").alias("parent"), "symbol")
    found = child.join(last.select("path", F.col("symbol").alias("parent")), ["path", "parent"])
    return found.select("path", F.col("parent").alias("src"), F.col("symbol").alias("dst"), F.lit("contains").alias("kind"), F.lit(0.85).alias("weight"))


def all_edges(*kinds: DataFrame) -> DataFrame:
    """The edges of several builders; one of each source, target and kind."""
    united = kinds[0]
    for other in kinds[1:]:
        united = united.unionByName(other)
    return united.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, backwards at 0.7, the largest weight of each; no loops."""
    forward = edges.where("src is not null and dst is not null and src != dst")
    both = forward.select("src", "dst", "weight").unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * REVERSE).alias("weight")))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def fan_in(edges: DataFrame) -> DataFrame:
    """dst and the number of distinct files that point to it."""
    return edges.where("src != dst").groupBy("dst").agg(F.countDistinct("src").alias("fan_in"))


def neighbours(graph: DataFrame, most: int) -> DataFrame:
    """The heaviest neighbours of every node; ties by name."""
    return ranked(graph, ["src"], [F.round("weight", 9).desc(), F.col("dst")], most, "_n").drop("_n")


def propagate(graph: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.65, seed_limit: int = 120, neighbour_limit: int = 40, frontier_limit: int = 40) -> DataFrame:
    """query_id, path, score that seeds (query_id, path, score) pass on, the best of all ways.

    Step s (from 0) multiplies with the edge's weight and decay ** (s + 1); a node passes on to its heaviest
    neighbours, and only the best nodes of a step pass on further. The few steps are unrolled in the plan.
    """
    near = neighbours(graph, neighbour_limit)
    frontier = ranked(seeds, ["query_id"], [F.round("score", 9).desc(), F.col("path")], seed_limit, "_n").drop("_n")
    steps: DataFrame | None = None
    for s in range(depth):
        passed = frontier.join(near.withColumnRenamed("src", "path"), "path").select("query_id", F.col("dst").alias("path"), (F.col("score") * F.col("weight") * decay ** (s + 1)).alias("score"))
        best = passed.where("score > 0").groupBy("query_id", "path").agg(F.max("score").alias("score"))
        steps = best if steps is None else steps.unionByName(best)
        frontier = ranked(best, ["query_id"], [F.round("score", 9).desc(), F.col("path")], frontier_limit, "_n").drop("_n")
    return steps.groupBy("query_id", "path").agg(F.max("score").alias("score"))


def expand(graph: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.72, frontier_limit: int = 40, least: float = 0.0) -> DataFrame:
    """As ``propagate``, with decay ** s at step s, over all neighbours, and only nodes that improved pass on.

    The last step reaches what the largest nodes have around them: its ways meet in the cells of a grid and are no rows.
    """
    seen = seeds.select("query_id", "path", "score")
    frontier, reached = seen, None
    for s in range(depth - 1):
        passed = frontier.join(graph.withColumnRenamed("src", "path"), "path").select("query_id", F.col("dst").alias("path"), (F.col("score") * F.col("weight") * decay**s).alias("score"))
        best = passed.where(F.col("score") > least).groupBy("query_id", "path").agg(F.max("score").alias("score"))
        reached = best if reached is None else reached.unionByName(best)
        better = best.join(seen.withColumnRenamed("score", "_seen"), ["query_id", "path"], "left").where(F.col("_seen").isNull() | (F.round("score", 9) > F.round("_seen", 9))).drop("_seen")
        seen = seen.unionByName(best).groupBy("query_id", "path").agg(F.max("score").alias("score"))
        frontier = ranked(better, ["query_id"], [F.round("score", 9).desc(), F.col("path")], frontier_limit, "_n").drop("_n")
    # What a query has reached before meets the node itself, so that the largest of all steps is found at once.
    ways = graph.select(F.concat(F.lit(">"), "src").alias("term"), F.col("dst").alias("path"), F.col("weight").alias("part"))
    given = frontier.select("query_id", F.concat(F.lit(">"), "path").alias("term"), (F.col("score") * decay ** (depth - 1)).alias("weight"))
    if reached is not None:
        ways = ways.unionByName(graph.select(F.concat(F.lit("="), "dst").alias("term"), F.col("dst").alias("path"), F.lit(1.0).alias("part")).distinct())
        given = given.unionByName(reached.select("query_id", F.concat(F.lit("="), "path").alias("term"), F.col("score").alias("weight")))
    given, around = checkpoint(given), ways.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    pairs = given.groupBy("term").agg(F.count(F.lit(1)).alias("_asked")).join(around, "term").agg(F.sum(F.col("_n") * F.col("_asked"))).first()[0] or 0
    nodes, queries = graph.select("dst").distinct().count(), given.select("query_id").distinct().count()
    listed = given.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    found = grid.largest(ways, "path", listed, *grid.shape(graph.sparkSession, nodes, queries, 0, pairs))
    return found.where(F.col("part") > least).withColumnRenamed("part", "score")


def typed_neighbours(edges: DataFrame, seeds: DataFrame, forward: dict[str, float], backward: dict[str, float], limit: int) -> DataFrame:
    """query_id, path, neighbour, weight: edges of the seeds weighted by kind and direction, the best ``limit`` per seed."""
    table = lambda kinds: F.coalesce(F.create_map(*[x for k, w in kinds.items() for x in (F.lit(k), F.lit(float(w)))])[F.col("kind")], F.lit(0.0))
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("neighbour"), (F.col("weight") * table(forward)).alias("weight"))
    back = edges.select(F.col("dst").alias("path"), F.col("src").alias("neighbour"), (F.col("weight") * table(backward)).alias("weight"))
    both = out.unionByName(back).where("weight > 0").groupBy("path", "neighbour").agg(F.max("weight").alias("weight"))
    return ranked(seeds.select("query_id", "path").join(both, "path"), ["query_id", "path"], [F.round("weight", 9).desc(), F.col("neighbour")], limit)


def next_in_file(spans: DataFrame, key: str) -> DataFrame:
    """src and dst of spans that follow one another in a file, by start, end and key."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line", key)
    return spans.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst is not null")


def contains(spans: DataFrame, key: str, lines: int = 64) -> DataFrame:
    """src and dst where one span lies within a larger one of the same file.

    A span meets those that cover the bucket of ``lines`` lines in which it starts, so a file with many spans is not
    one key. Spans that end before they start have no such bucket and are joined by file alone.
    """
    a = spans.select("path", F.col(key).alias("src"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    b = spans.select("path", F.col(key).alias("dst"), "start_line", "end_line")
    bucket = lambda line: F.floor(F.col(line) / lines)
    covering = a.where("s <= e").withColumn("_bucket", F.explode(F.sequence(bucket("s"), bucket("e"))))
    met = covering.join(b.where("start_line <= end_line").withColumn("_bucket", bucket("start_line")), ["path", "_bucket"]).drop("_bucket")
    met = met.unionByName(a.join(b.where("start_line > end_line"), "path"))
    return met.where("src != dst and s <= start_line and end_line <= e and (e - s) > (end_line - start_line)").select("src", "dst")

"""Queries on declarations and the items made of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.operators import declarations as ops
from sieveloom.operators import graph
from sieveloom.operators.items import DECLARATIONS
from sieveloom.plans.collection_queries import _CAMEL, READ
from sieveloom.plans.lexical_queries import items
from sieveloom.plans.registry import register, rounded

_NAME = "case code_language " + " ".join(f"when '{k}' then regexp_extract(text, '{p}', 1)" for k, p in DECLARATIONS.items()) + " end"
DECLARED = f"""
    with {READ}, n as (select path, code_language, len(l) as n_lines, unnest(l) as text, generate_subscripts(l, 1) as line from f),
    d0 as (select path, code_language, n_lines, line, length(text) - length(regexp_replace(text, '^\\s+', '')) as indent, {_NAME} as symbol, trim(text, ' ') as signature from n),
    d1 as (select *, row_number() over (partition by path order by line) as rn from d0 where symbol <> ''), d as (select * exclude (rn) from d1 where rn <= greatest(96, n_lines // 4)),
    q as (select * replace (case when indent > 0 and c is not null then c || '.' || symbol else symbol end as symbol) from (
        select *, last_value(case when indent = 0 and starts_with(signature, 'class ') then symbol end ignore nulls) over (partition by path order by line rows unbounded preceding) as c from d where code_language = 'python'))
"""


@register("declarations", DECLARED + "select path, line, indent, symbol, signature from d")
def declarations(spark: SparkSession, d: str) -> DataFrame:
    return ops.declarations(items(spark, d)).select("path", "line", "indent", "symbol", "signature")


@register(
    "symbol_parents",
    DECLARED + ", last as (select path, symbol from q group by all) select a.path, b.symbol as src, a.symbol as dst, 'contains' as kind, 0.85::double as weight from last a join last b on a.path = b.path and b.symbol = regexp_replace(a.symbol, '\\.[^.]*$', '') where contains(a.symbol, '.')",
)
def symbol_parents(spark: SparkSession, d: str) -> DataFrame:
    """Classes and their methods in Python files."""
    return graph.symbol_parents(ops.qualified(ops.declarations(items(spark, d))))


SOUGHT = "class filter"
_HAY = "lower(symbol || ' ' || signature)"


@register("symbol_lookup", DECLARED + f"select path, line, symbol from d where (contains({_HAY}, 'class') and contains({_HAY}, 'filter')) or contains(regexp_replace({_HAY}, '[^a-z0-9]', '', 'g'), 'classfilter')")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ops.declarations(items(spark, d)).where(ops.matches_symbol(F.col("symbol"), F.col("signature"), SOUGHT)).select("path", "line", "symbol")


@register("symbol_files", DECLARED + f"select path, min(line) as first_line, max(line) as last_line, count(*) as symbols, round(least(0.95, 0.55 + 0.05 * count(*)), 6)::double as confidence from d where contains({_HAY}, 'load') or contains(regexp_replace({_HAY}, '[^a-z0-9]', '', 'g'), 'load') group by path")
def symbol_files(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.symbol_files(ops.declarations(items(spark, d)).where(ops.matches_symbol(F.col("symbol"), F.col("signature"), "load"))))


@register("file_lanes", "select path, case when regexp_matches(lower(path), '[.](md|markdown|rst|txt|adoc)$') or starts_with(lower(split_part(path, '/', -1)), 'readme') or contains('/' || lower(path), '/docs/') then 'doc' else 'code' end as lane from code_items")
def file_lanes(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("path", ops.lane(F.col("path")).alias("lane"))


@register(
    "file_purposes",
    f"with {READ}, h as (select path, regexp_extract(array_to_string(l[1:30], chr(10)), '(?s)/\\*\\*(.*?)\\*/', 1) as c from f), p as (select path, substr(trim(regexp_replace(regexp_replace(c, '(?m)^\\s*\\*', ' ', 'g'), '\\s+', ' ', 'g')), 1, 500) as purpose from h) select path, purpose from p where purpose <> ''",
)
def file_purposes(spark: SparkSession, d: str) -> DataFrame:
    return ops.purposes(items(spark, d))




def _distinct_sql(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


_IMPORTED = _distinct_sql(r"regexp_extract_all(content, '(?m)^\s*(?:import|from|use|#include)\s+[\"''<{(]?\s*([\w./:]+)', 1)")
_KEYS = _distinct_sql(r"regexp_extract_all(content, '(?m)^([\w.-]+)\s*[:=]', 1)")


@register(
    "file_manifests",
    DECLARED
    + f""", s as (select path, array_to_string(list_sort(list(distinct symbol))[1:40], ', ') as symbols from d group by path),
    m as (select path, array_to_string({_distinct_sql(_CAMEL.format("path"))}, ' ') as words, nullif(regexp_extract(content, '(?m)^\\s*package\\s+([\\w.]+)', 1), '') as package, {_IMPORTED} as imports,
        case when regexp_matches(path, '[.](yaml|yml|toml|properties)$') then {_KEYS} end as keys from f)
    select path, concat_ws(chr(10), 'path: ' || words, 'package: ' || package, 'imports: ' || nullif(array_to_string(imports[1:40], ', '), ''), 'symbols: ' || symbols, 'keys: ' || nullif(array_to_string(keys[1:40], ', '), '')) as manifest from m left join s using (path)""",
)
def file_manifests(spark: SparkSession, d: str) -> DataFrame:
    return ops.manifests(items(spark, d))


@register("symbol_items")
def symbol_items(spark: SparkSession, d: str) -> DataFrame:
    """Declarations with their blocks, whose ends a scan over braces or indentation finds; the tests compare it with Python's own parser."""
    return ops.symbol_items(items(spark, d))


@register("symbol_chunks")
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.symbol_chunks(ops.symbol_items(items(spark, d)), least_file=40)


@register("structural_chunks")
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.structural_chunks(items(spark, d), 40)

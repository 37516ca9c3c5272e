"""Lexical retrieval for tables of queries: inverted index, BM25, coverage, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions import text as t
from sieveloom.operators import grid
from sieveloom.plans.runtime import shuffle_partitions

K1, B = 1.2, 0.75
#: Query terms up to this number are broadcast (about 40 MB); beyond it the joins shuffle by term.
BROADCAST_TERMS = 1_000_000


def ranked(df: DataFrame, per: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 1 within ``per``; with a limit Spark prunes before the exchange (WindowGroupLimit)."""
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return numbered if limit is None else numbered.where(F.col(name) <= limit)


def postings(items: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key``, term, tf of every distinct term of an item."""
    return items.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def weighted_postings(items: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """``key``, term, tf where the tokens of each text column count as often as its weight says."""

    def weighted(column: str, weight: int) -> Column:
        tokens = F.coalesce(t.identifier_tokens(F.col(column)), F.array().cast("array<string>"))
        return F.transform(tokens, lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))

    per_field = [weighted(c, weight) for c, weight in fields.items()]
    return items.select(key, F.inline(F.concat(*per_field))).groupBy(key, "term").agg(F.sum("weight").alias("tf"))


def index_stats(index: DataFrame, key: str) -> DataFrame:
    """One row: items, terms, tokens and the mean length of an inverted index."""
    lengths = index.groupBy(key).agg(F.sum("tf").alias("dl"))
    terms = index.select("term").distinct().agg(F.count(F.lit(1)).alias("terms"))
    return lengths.agg(F.count(F.lit(1)).alias("items"), F.sum("dl").alias("tokens"), F.avg("dl").alias("avgdl")).crossJoin(terms)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _asked(queries: DataFrame, distinct_terms: bool = True) -> DataFrame:
    """query_id, term and how often the query has it."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms") if distinct_terms else F.col("terms")).alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _bm25_parts(items: DataFrame, key: str, tokens: Column, asked: DataFrame, small: bool, k1: float, b: float, least_avgdl: float) -> tuple[DataFrame, DataFrame]:
    """What a term adds to an item's score but for the query's weight (``key``, term, part, by item); items and mean length."""
    sized = items.select(key, tokens.alias("_tokens")).select(key, "_tokens", F.greatest(F.lit(0), F.size("_tokens")).alias("dl"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(least_avgdl)).alias("avgdl"))
    found = sized.select(key, "dl", F.explode("_tokens").alias("term")).join(_sized(asked.select("term").distinct(), small), "term", "left_semi")
    # By item alone: counting, scoring and adding up then need no further exchange.
    counted = found.repartition(shuffle_partitions(items.sparkSession), key).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return counted.crossJoin(F.broadcast(stats)).select(key, "term", part.alias("part")), stats


def _idf(n: str, df: str) -> Column:
    return F.log(1 + (F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def bm25(items: DataFrame, key: str, tokens: Column, queries: DataFrame, k1: float = K1, b: float = B, distinct_terms: bool = True, least_avgdl: float = 1.0) -> DataFrame:
    """query_id, ``key`` and score of every item that shares a term with a query. For the best items only, see ``bm25_top``.

    ``queries`` has query_id and terms (array). Items are tokenised once; only postings of query terms are kept, so
    the exchange grows with what the queries ask for. Empty items have no postings but count in the collection.
    """
    asked = _asked(queries, distinct_terms)
    small = asked.count() <= BROADCAST_TERMS
    parts, stats = _bm25_parts(items, key, tokens, asked, small, k1, b, least_avgdl)
    weights = asked.join(document_frequency(parts), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (_idf("n", "df") * F.col("qtf")).alias("weight"))
    return parts.join(_sized(weights, small), "term").groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def bm25_top(items: DataFrame, key: str, tokens: Column, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, distinct_terms: bool = True, least_avgdl: float = 1.0, by: str | None = None) -> DataFrame:
    """query_id, ``key`` and score of every item that may be among the ``k`` best of a query; a column k of ``queries`` goes first.

    The scores are whole and no item of the best ``k`` by six digits and ``key`` is missing. All items are scored, in a grid
    where pairs are sums in an array, not rows. With ``by``, a column of ``items``, items with the same value add up and
    it stands for ``key``.
    """
    asked = _asked(queries, distinct_terms)
    small, rows, columns = _shape(items, asked, k)
    if by is not None:
        items = items.withColumn("_item", F.struct(key, by))
    parts, stats = _bm25_parts(items, key if by is None else "_item", tokens, asked, small, k1, b, least_avgdl)
    weights = asked.join(document_frequency(parts), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (_idf("n", "df") * F.col("qtf")).alias("weight"))
    if by is not None:
        parts = parts.groupBy(F.col(f"_item.{by}").alias(by), "term").agg(F.sum("part").alias("part"))
    wanted = queries.select("query_id", (F.col("k") if "k" in queries.columns else F.lit(k)).alias("_k"))
    return grid.best(parts, by or key, _listed(weights).join(wanted, "query_id"), rows, columns).withColumnRenamed("part", "score")


def _shape(items: DataFrame, asked: DataFrame, k: int, pairs: int = 0) -> tuple[bool, int, int]:
    """Whether the query terms can be broadcast; rows and columns of the grid."""
    terms, queries = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    return terms <= BROADCAST_TERMS, *grid.shape(items.sparkSession, items.count(), queries, k, pairs)


def _listed(weights: DataFrame) -> DataFrame:
    """The terms of a query (query_id, term, weight) as one row, by weight, the most common terms first."""
    listed = weights.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("weight", "term"))).alias("_each"))
    return listed.select("query_id", F.col("_each.term").alias("terms"), F.col("_each.weight").alias("weights"))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def any_term(items: DataFrame, key: str, tokens: Column, queries: DataFrame) -> DataFrame:
    """query_id and ``key`` of items with any term of a query."""
    own = items.select(key, F.explode(F.array_distinct(tokens)).alias("term"))
    return own.join(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")), "term").select("query_id", key).distinct()


def coverage_top(items: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame, k: int) -> DataFrame:
    """query_id, ``key`` and the shares of a query's terms in the fields content, title and path, for all that may be among its ``k`` best.

    The order is by ``lexical_score``, then the share in path, then ``key``, all shares by the number of terms. Fields are
    arrays of terms. Items are counted in a grid where pairs are no rows: one whole number holds three times the terms in
    content plus those in title, those in path, and below what the order looks at those in title.
    """
    flags = {name: 1 << i for i, name in enumerate(("content", "title", "path"))}

    def flagged(terms: Column, flag: int) -> Column:
        return F.transform(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))), lambda w: F.struct(w.alias("term"), F.lit(flag).alias("_flag")))

    each = [flagged(fields[name], flag) for name, flag in flags.items()]
    asked = _asked(queries)
    small, rows, columns = _shape(items, asked, k)
    # One row per item and term, whatever fields have it.
    own = items.select(key, F.inline(F.concat(*each))).join(_sized(asked.select("term").distinct(), small), "term", "left_semi")
    found = own.repartition(shuffle_partitions(items.sparkSession), key).groupBy(key, "term").agg(F.bit_or("_flag").alias("_flags"))
    has = {name: (F.col("_flags").bitwiseAND(flag) > 0).cast("bigint") for name, flag in flags.items()}
    bits = grid.LOW_BITS
    part = F.shiftleft(has["content"] * 3 + has["title"], 2 * bits) + F.shiftleft(has["path"], bits) + has["title"]
    top = grid.best(found.select(key, "term", part.alias("part")), key, _listed(asked.withColumn("weight", F.lit(1.0))).withColumn("_k", F.lit(k)), rows, columns)
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_size"))
    title = F.col("part").bitwiseAND((1 << bits) - 1)
    path = F.shiftright("part", bits).bitwiseAND((1 << bits) - 1)
    content = (F.shiftright("part", 2 * bits) - title) / 3
    return top.join(sizes, "query_id").select("query_id", key, (content / F.col("_size")).alias("content"), (title / F.col("_size")).alias("title"), (path / F.col("_size")).alias("path"))


def lexical_score(content: Column, title: Column) -> Column:
    return F.least(F.lit(1.0), content * 0.75 + title * 0.25)


def symbol_match(symbol_terms: Column, terms: Column) -> Column:
    """Shared terms over the smaller of both sets; 0 without a symbol."""
    shared = F.size(F.array_intersect(symbol_terms, terms))
    smaller = F.least(F.size(F.array_distinct(symbol_terms)), F.size(F.array_distinct(terms)))
    return F.when(F.size(symbol_terms) > 0, F.least(F.lit(1.0), shared / F.greatest(smaller, F.lit(1)))).otherwise(0.0)


def symbol_matches(items: DataFrame, key: str, symbol_terms: Column, queries: DataFrame) -> DataFrame:
    """query_id, ``key`` and part: ``symbol_match`` by six digits of all pairs where it is a quarter or more.

    ``symbol_terms`` are distinct. Terms of one query are met in one cell of a grid with as many cells as there are pairs for.
    """
    asked = _asked(queries)
    own = items.select(key, F.size(symbol_terms).alias("part"), F.explode(symbol_terms).alias("term"))
    met = own.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).join(asked.groupBy("term").agg(F.count(F.lit(1)).alias("_asked")), "term")
    pairs = met.agg(F.sum(F.col("_n") * F.col("_asked"))).first()[0] or 0
    small, rows, columns = _shape(items, asked, 0, pairs)
    found = own.join(_sized(asked.select("term").distinct(), small), "term", "left_semi")
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k"))
    listed = _listed(asked.withColumn("weight", F.lit(1.0))).join(sizes, "query_id")
    return grid.shared(found, key, listed, rows, columns)


def keywords(items: DataFrame, key: str, tokens: Column, limit: int = 30) -> DataFrame:
    """The best terms of every item by ln(1 + share) * (ln((n + 1) / (df + 1)) + 1)."""
    index = postings(items, key, tokens)
    sized = index.withColumn("_length", F.sum("tf").over(Window.partitionBy(key)))
    n = items.agg(F.count(F.lit(1)).alias("_n"))
    scored = sized.join(document_frequency(index), "term").crossJoin(F.broadcast(n))
    weight = F.log1p(F.col("tf") / F.col("_length")) * (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1)
    return ranked(scored.select(key, "term", weight.alias("weight")), [key], [F.round("weight", 9).desc(), F.col("term")], limit)

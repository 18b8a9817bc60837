"""Terms, lengths and the gain of BM25 over tables; :mod:`.index` ranks with them.

Ranking works on ids, terms and counts alone; texts join afterwards, if at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens

K1, B = 1.4, 0.75
#: Rows up to which a table of query terms is broadcast; above, Spark joins by shuffling.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, which are counted."""
    return maybe_broadcast(df, df.limit(BROADCAST_ROWS + 1).count())


def maybe_broadcast(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have few rows."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term), one row a token."""
    return docs.select(key, F.explode(index_tokens(text)).alias("term"))


def term_frequencies(tokens: DataFrame, key: str) -> DataFrame:
    """(key, term, tf)."""
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, dl) tokens of each document, 0 included; no shuffle."""
    return docs.select(key, F.size(index_tokens(text)).cast("bigint").alias("dl"))


def query_terms(queries: DataFrame, key: str, text: Column) -> DataFrame:
    """(query_id, term, qtf); repeated terms of a query count repeatedly."""
    return term_frequencies(terms(queries, key, text), key).select(F.col(key).alias("query_id"), "term", F.col("tf").alias("qtf"))


def _gain(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def top_k(scored: DataFrame, k: int, order: list[Column], per: str = "query_id") -> DataFrame:
    """Rows of rank 1 to k in their query, with ``rank``; Spark prunes each task's rows to k before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= k)

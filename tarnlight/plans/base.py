"""Registry of queries over the standard tables, and SQL pieces their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import INDEX_STOP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tok(text: str) -> str:
    """DuckDB's index tokens of a text."""
    stop = ", ".join(f"'{w}'" for w in INDEX_STOP)
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9가-힣]+'), lambda x: length(x) > 1 AND x NOT IN ({stop}))"


FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({}, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)"

#: Document tokens, postings and query terms as CTEs.
TOKENS = f"""dtok AS (SELECT doc_id, source, unnest({tok('text')}) AS term FROM documents),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, term, count(*) AS tf FROM dtok GROUP BY ALL),
len AS (SELECT doc_id, source, len({tok('text')}) AS dl FROM documents)"""

BM25 = f"""{TOKENS},
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT q.query_id, p.doc_id, sum(q.qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM qt q JOIN post p USING (term) JOIN df USING (term) JOIN len l USING (doc_id), stats GROUP BY ALL
), lex AS (
  SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored
)"""

#: Hashed vectors of documents and queries, and their cosine, as CTEs.
VECTORS = f"""dvec0 AS (SELECT doc_id, {FNV.format('term')} % 256 AS bucket, count(*) AS n FROM dtok GROUP BY ALL),
dvec AS (SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS w FROM dvec0),
qvec0 AS (SELECT query_id, {FNV.format('term')} % 256 AS bucket, sum(qtf) AS n FROM qt GROUP BY ALL),
qvec AS (SELECT query_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)), 6) AS w FROM qvec0),
cos AS (SELECT query_id, doc_id, floor(sum(round(d.w * 1e6)::BIGINT * round(q.w * 1e6)::BIGINT)::BIGINT / 1000000) / 1e6 AS score FROM dvec d JOIN qvec q USING (bucket) GROUP BY ALL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cos WHERE score >= 0.03)"""

#: Fusion of the first forty of both lists.
FUSED = f"""{BM25}, {VECTORS},
both_lists AS (
  SELECT query_id, doc_id, 1.0 / (60 + rank) AS part, rank AS lr, NULL AS vr FROM lex WHERE rank <= 40
  UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), NULL, rank FROM vec WHERE rank <= 40
), fused AS (
  SELECT query_id, doc_id, round(sum(part), 9) AS rrf, min(lr) AS lexical_rank, min(vr) AS vector_rank FROM both_lists GROUP BY ALL
)"""
FUSED_ORDER = "rrf DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST"

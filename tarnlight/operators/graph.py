"""Document relations: edges, backlinks, adjacency, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of relations.
KINDS = ("related", "supports", "depends-on", "implements", "supersedes", "contrasts")


def relation_edges(docs: DataFrame, key: str, relations: str) -> DataFrame:
    """(src, pos, raw, kind, dst) of ``kind:target`` values; malformed ones have a null kind and target."""
    rows = docs.select(F.col(key).alias("src"), F.posexplode(relations).alias("pos", "raw"))
    kind = F.trim(F.regexp_extract("raw", r"(?s)^([^:]*):(.*)$", 1))
    dst = F.trim(F.regexp_extract("raw", r"(?s)^([^:]*):(.*)$", 2))
    ok = F.coalesce(kind.isin(*KINDS) & (dst != ""), F.lit(False))
    return rows.select("src", "pos", "raw", F.when(ok, kind).alias("kind"), F.when(ok, dst).alias("dst"))


def audit_edges(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """(src, pos, problem) of edges; the first rule that fails names it. slugs: (slug, public)."""
    seen = F.row_number().over(Window.partitionBy("src", "kind", "dst").orderBy("pos"))
    known = slugs.select(F.col("slug").alias("dst"), F.col("public"))
    rows = edges.withColumn("_n", seen).join(known, "dst", "left")
    problem = (
        F.when(F.col("kind").isNull(), "malformed")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.col("dst") == F.col("src"), "self")
        .when(F.col("public").isNull(), "missing_target")
        .when(~F.col("public"), "not_public")
    )
    return rows.select("src", "pos", problem.alias("problem")).where("problem IS NOT NULL")


def backlinks(edges: DataFrame) -> DataFrame:
    """(dst, n_links, n_sources)."""
    return edges.groupBy("dst").agg(F.count("*").alias("n_links"), F.countDistinct("src").alias("n_sources"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, n_out, targets): targets in the order of their positions, joined by commas."""
    near = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"])
    return edges.groupBy("src").agg(F.count("*").alias("n_out"), F.array_join(near, ",").alias("targets"))


def resolved(edges: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Edges whose target is a document, with its columns; dangling ones are left out."""
    return edges.join(docs.withColumnRenamed(key, "dst"), "dst")


def reciprocal(docs: DataFrame, key: str, replaced_by: str, replaces: str) -> DataFrame:
    """(slug, by, reciprocal): whether the document that replaces one also names it."""
    a = docs.where(F.col(replaced_by).isNotNull()).select(F.col(key).alias("slug"), F.col(replaced_by).alias("by"))
    b = docs.select(F.col(key).alias("by"), F.col(replaces).alias("_names"))
    return a.join(b, "by", "left").select("slug", "by", F.coalesce(F.array_contains("_names", F.col("slug")), F.lit(False)).alias("reciprocal"))


def html_links(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(src, pos, dst) of the href values of pages."""
    return pages.select(F.col(key).alias("src"), F.posexplode(F.regexp_extract_all(html, F.lit("href=\"([^\"]*)\""), 1)).alias("pos", "dst"))

"""Tables and files the engine writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str) -> None:
    """Versioned chunk index, a folder a chunk schema version."""
    chunks.write.mode("overwrite").partitionBy("chunk_schema_version").parquet(path)


def publish(chunks: DataFrame, path: str, view: str, allow: bool) -> bool:
    """Write a new version and point the operational view at it, if allowed."""
    if not allow:
        return False
    chunks.write.mode("errorifexists").parquet(path)
    chunks.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return True


def append_run(df: DataFrame, run_id: str, path: str) -> None:
    """Metrics, per-query rows, failures or latency of one run, in its own folder."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def append_leaderboard(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", True).csv(path)


def snapshot(row: DataFrame, path: str) -> None:
    """Best or baseline metrics, one row, replaced."""
    row.coalesce(1).write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """Report table of a small aggregate; ``limit`` bounds what reaches the driver."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def note_links(body: Column) -> Column:
    """``[x](Y.md)`` to ``[[Y]]``."""
    return F.regexp_replace(body, r"\[[^\]]+\]\((?:\./)?([^)/#]+)\.md(?:#[^)]*)?\)", "[[$1]]")


def export_notes(docs: DataFrame, path: str, by_category: bool = True) -> None:
    """Notes with rewritten links and a footer, one text row a document, a folder a category."""
    footer = F.concat(F.lit("\n\n---\nSource: "), F.col("source_path"))
    notes = docs.select("category", F.concat(note_links(F.col("body")), footer).alias("value"))
    writer = notes.write.mode("overwrite")
    (writer.partitionBy("category") if by_category else notes.select("value").write.mode("overwrite")).text(path)


def write_search_index(docs: DataFrame, path: str) -> None:
    """The search index in document order, as Parquet to read back and as JSON lines to serve."""
    ordered = docs.orderBy("order", "displayTitle")
    ordered.write.mode("overwrite").parquet(f"{path}/parquet")
    ordered.write.mode("overwrite").json(f"{path}/json")


def update_index(chunks: DataFrame, path: str, version: str, hash_col: str = "chunk_hash", text_col: str = "text", payload: str = "embedding", document: str = "document_id", order: str = "pos") -> DataFrame:
    """Write a new version of the chunk index below ``path``: what the last version has of unchanged chunks is taken
    over. Its manifest, one row (version, documents, chunks, mean characters, reused, rebuilt), is written beside it
    and returned. The last version is the greatest one that has a manifest, so a job that fails leaves none."""
    from ..operators.quality import manifest, merge_incremental
    from .corpus import read_index

    spark = chunks.sparkSession
    known = read_index(spark, f"{path}/manifests", "json")
    last = known.agg(F.max("version")).first()[0] if known is not None else None
    if last is None:
        merged = chunks.withColumn("reused", F.lit(False))
        merged = merged if payload in chunks.columns else merged.withColumn(payload, F.lit(None).cast("string"))
    else:
        merged = merge_incremental(spark.read.parquet(f"{path}/versions/{last}"), chunks, hash_col, text_col, payload, order)
    merged.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    stored = spark.read.parquet(f"{path}/versions/{version}")
    counts = stored.agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("rebuilt"))
    row = manifest(stored, document, F.col(text_col)).crossJoin(counts).withColumn("version", F.lit(version))
    row.coalesce(1).write.mode("append").json(f"{path}/manifests")
    return row


def write_run(path: str, run_id: str, **tables: DataFrame) -> None:
    """The tables of a run (metrics, per query, failures, latency, comparison), each below its name and the run."""
    for name, df in tables.items():
        append_run(df, run_id, f"{path}/{name}")


def write_taxonomy(counts: DataFrame, path: str) -> None:
    """Failure counts as CSV, all codes in their fixed order. ``counts``: (code_pos, code, n), zeros included."""
    counts.orderBy("code_pos").select("code", "n").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report of small aggregates and texts, in the order given."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def contents(docs: DataFrame) -> DataFrame:
    """(category, value): a map of contents for each category, links in document order."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("]] "), F.col("displayTitle"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("order", "displayTitle", line.alias("v")))), lambda x: x["v"])
    return docs.groupBy("category").agg(F.concat(F.lit("# "), F.first("category"), F.lit("\n\n"), F.array_join(rows, "\n")).alias("value"))


def summary_row(docs: DataFrame, built: str) -> DataFrame:
    """One row for a page's head: documents, categories, last update, time of building."""
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("category").alias("categories"), F.max("updatedAt").alias("updated"), F.lit(built).alias("built"))


def golden_queries(docs: DataFrame, form: str = "What does {title} say?") -> DataFrame:
    """(query_id, question, category, expected): a question for each document by its title, ids in the order of slugs."""
    before, _, after = form.partition("{title}")
    question = F.concat(F.lit(before), F.col("displayTitle"), F.lit(after))
    return docs.select(F.concat(F.lit("q-"), F.col("slug")).alias("query_id"), question.alias("question"), "category", F.array("slug").alias("expected"))

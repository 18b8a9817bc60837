"""Metadata audits and index lifecycle: manifest, incremental merge, freshness, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The closed sets of the metadata contract.
TYPES = ("architecture", "baseline", "contract", "daily-log", "decision", "evidence", "experiment", "incident", "meta", "overview", "plan", "reference", "runbook")
STATUSES = ("archived", "partial", "planned", "superseded", "verified")
EVIDENCE = ("code-only", "unit-test", "offline-benchmark", "live-canary", "production")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z)?$"
KEBAB = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def violations(rows: dict[str, Column]) -> Column:
    """Names of the fields of a record that break the contract. Keys: type, status, evidenceLevel, verifiedAt, canonicalFor, supersededBy."""
    outside = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    found = [
        F.when(outside(rows["type"], TYPES), "type"),
        F.when(outside(rows["status"], STATUSES), "status"),
        F.when(outside(rows["evidenceLevel"], EVIDENCE), "evidenceLevel"),
        F.when((rows["status"] == "verified") & ~F.coalesce(rows["verifiedAt"].rlike(ISO_DATE), F.lit(False)), "verifiedAt"),
        F.when(rows["canonicalFor"].isNotNull() & ~rows["canonicalFor"].rlike(KEBAB), "canonicalFor"),
        F.when((rows["status"] == "superseded") & rows["supersededBy"].isNull(), "supersededBy"),
    ]
    return F.array_compact(F.array(*found))


def manifest(chunks: DataFrame, document: str, text: Column) -> DataFrame:
    """One row: documents, chunks, mean characters, and the share of documents with several chunks."""
    per = chunks.groupBy(document).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    return per.agg(
        F.count("*").alias("document_count"),
        F.sum("n").alias("chunk_count"),
        F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chunk_chars"),
        F.round(F.count_if(F.col("n") > 1) / F.count("*"), 6).alias("duplicate_doc_ratio"),
    )


def merge_incremental(previous: DataFrame, new: DataFrame, hash_col: str = "chunk_hash", text_col: str = "text", payload: str = "embedding", order: str = "pos") -> DataFrame:
    """``new`` with the previous payload and ``reused`` where hash and text are unchanged. Of previous rows of one hash the last counts."""
    last = F.row_number().over(Window.partitionBy(hash_col).orderBy(F.desc(order)))
    old = previous.withColumn("_n", last).where("_n = 1").select(hash_col, F.col(text_col).alias("_text"), F.col(payload).alias("_payload"))
    both = new.join(old, hash_col, "left")
    same = F.coalesce((F.col("_text") == F.col(text_col)) & F.col("_payload").isNotNull(), F.lit(False))
    out = both.withColumn("reused", same)
    value = F.col(payload) if payload in new.columns else F.lit(None)
    return out.withColumn(payload, F.when(same, F.col("_payload")).otherwise(value)).drop("_text", "_payload")


def missing_from_index(expected: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return expected.join(index.select(key).distinct(), key, "left_anti").select(key)


def stale_reasons(row: dict[str, Column]) -> Column:
    """Why an index is stale. Keys: exists, n_chunks, n_documents, n_expected, n_missing, hash, expected_hash."""
    return F.array_compact(
        F.array(
            F.when(~row["exists"], "index_missing"),
            F.when(row["n_chunks"] == 0, "no_chunks"),
            F.when(row["n_documents"] < row["n_expected"], "document_count_below_expected"),
            F.when(row["n_missing"] > 0, "missing_documents"),
            F.when(row["hash"] != row["expected_hash"], "corpus_hash_mismatch"),
        )
    )


def corpus_digest(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """One row: a digest that changes with any document, key or content, in whatever order they come. Digests of the
    documents are added up, so nothing is gathered."""
    one = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.sha2(F.coalesce(content, F.lit("")), 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = docs.select(one.alias("h")).agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.coalesce(f"s{i}", F.lit("0")) for i in range(4)]), 256).alias("corpus_hash"))


def audit_corpus(parsed: DataFrame, public: Column) -> DataFrame:
    """(slug, field, problem) of a corpus, in a stable order: documents that cannot be parsed, and of public ones the
    fields and relations that break the contract. ``parsed`` is what the corpus reader gives."""
    from ..sources.workspace import cut
    from .graph import audit_edges, relation_edges

    # Parsed once: the parts below, and filters moved into them, would each parse all files again.
    names = ("type", "status", "evidenceLevel", "verifiedAt", "canonicalFor", "supersededBy")
    parsed = cut(parsed.select("slug", "parse_error", "relations", public.alias("_public"), violations({c: F.col(c) for c in names}).alias("_broken")))
    unread = parsed.where("parse_error IS NOT NULL").select("slug", F.lit("frontmatter").alias("field"), F.col("parse_error").alias("problem"))
    read = parsed.where("parse_error IS NULL")
    shown = read.where("_public")
    broken = shown.select("slug", F.explode("_broken").alias("field"))
    edges = audit_edges(relation_edges(shown, "slug", "relations"), read.select("slug", F.col("_public").alias("public")))
    rows = unread.unionAll(broken.select("slug", "field", F.lit("not allowed").alias("problem")))
    rows = rows.unionAll(edges.select(F.col("src").alias("slug"), F.lit("relations").alias("field"), "problem"))
    return rows.orderBy("slug", "field", "problem")


def closed_world(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a dimension that must match both ways; a key that one side lacks fails the job and is named."""
    left, right = rows.withColumn("_l", F.lit(True)), dimension.withColumn("_r", F.lit(True))
    both = left.join(right, key, "full_outer")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    checked = F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not on both sides: "), name)).cast("boolean"))
    return both.where(checked).drop("_l", "_r")


def unlike_excerpts(docs: DataFrame, key: str, excerpt: Column, least: int = 1) -> DataFrame:
    """Documents whose excerpt is missing, blank or still holds marks."""
    said = F.trim(F.coalesce(excerpt, F.lit("")))
    problem = F.when(F.length(said) < least, "empty").when(said.rlike(r"```|^#+\s|\*\*"), "marks")
    return docs.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def graph_of(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a drawn graph, a line a row: ``A --> B``, ``A -->|label| B``, ``A[Name]``."""
    node = r"([A-Za-z0-9_.-]+)(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})?"
    pattern = rf"^\s*{node}\s*(?:-->|---|-\.->|==>)\s*(?:\|([^|]*)\|\s*)?{node}"
    edges = lines.where(F.col(column).rlike(pattern)).select(*[F.regexp_extract(column, pattern, i).alias(n) for i, n in ((1, "src"), (2, "label"), (3, "dst"))])
    named = lines.where(F.col(column).rlike(r"^\s*[A-Za-z0-9_.-]+[\[({]")).select(F.regexp_extract(column, r"^\s*([A-Za-z0-9_.-]+)", 1).alias("node"))
    return named.unionAll(edges.select(F.explode(F.array("src", "dst")))).distinct(), edges

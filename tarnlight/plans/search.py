"""Queries of the public search, its evaluation, answers, Markdown and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, is_excerpt_again, newest_dated, searchable
from ..operators import answer as an
from ..operators import chunking as ch
from ..operators import evaluation as ev
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import markdown as md
from ..operators import quality as ql
from ..operators import search as se
from ..sources import corpus as co
from .base import BM25, VECTORS, query, read
from .corpus import LINES
from .retrieval import METRICS_SQL, OVERLAP, TAX, TRUTH, coded, index_of, lexical_list, metrics_of, truth_of

#: Settings of the queries over modes; the fusion takes thirty of each list.
MODES = {
    "lexical-only": se.configured("lexical-only"),
    "vector-only": se.configured("vector-only"),
    "hybrid-raw": se.configured("hybrid-raw", pure=True),
    "hybrid-max1": se.configured("hybrid", most=1, pure=True),
}
BLENDED = f"""{OVERLAP}, mixed AS (
  SELECT query_id, doc_id, c.score AS vector_score, coalesce(round(overlap, 6), 0) AS overlap FROM cos c LEFT JOIN ovl USING (query_id, doc_id)
), bl AS (SELECT *, round(0.75 * vector_score + 0.25 * overlap, 8) AS score FROM mixed),
blist AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bl WHERE CASE WHEN overlap > 0 THEN score >= 0.03 ELSE vector_score >= 0.55 AND score >= 0.03 END)"""
ORDER = "rrf DESC, lr NULLS LAST, vr NULLS LAST"


def _fused_sql(vec: str, top: int) -> str:
    return f"""parts AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part, rank AS lr, NULL AS vr FROM lex WHERE rank <= {top} UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), NULL, rank FROM {vec} WHERE rank <= {top}),
fz AS (SELECT query_id, doc_id, source, round(sum(part), 9) AS rrf, min(lr) AS lr, min(vr) AS vr FROM parts JOIN documents USING (doc_id) GROUP BY ALL)"""


def chunks_of(spark, d) -> DataFrame:
    """Documents as chunks; their source is the document they belong to."""
    return read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("document"), F.col("source").alias("title"), F.col("source").alias("slug"))


def questions_of(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def searched(spark, d, config) -> DataFrame:
    return se.search(index_of(spark, d), chunks_of(spark, d), questions_of(spark, d), config)


MODES_SQL = f"""WITH {BM25}, {VECTORS}, {_fused_sql('vec', 30)},
raw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fz),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY {ORDER}) AS k FROM fz),
m1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM one WHERE k <= 1),
modes AS (SELECT 'lexical-only' AS config, query_id, rank, doc_id FROM lex WHERE rank <= 6 UNION ALL SELECT 'vector-only', query_id, rank, doc_id FROM vec WHERE rank <= 6
 UNION ALL SELECT 'hybrid-raw', query_id, rank, doc_id FROM raw WHERE rank <= 6 UNION ALL SELECT 'hybrid-max1', query_id, rank, doc_id FROM m1 WHERE rank <= 6)"""


@query(MODES_SQL + " SELECT config, query_id, rank::BIGINT AS rank, doc_id FROM modes")
def search_modes(spark, d):
    """The public search in four modes over all passages."""
    out = None
    for name, config in MODES.items():
        rows = searched(spark, d, config).select(F.lit(name).alias("config"), "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(f"""WITH {BM25}, {VECTORS}, {BLENDED}, {_fused_sql('blist', 40)},
two AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY {ORDER}) AS k FROM fz),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM two WHERE k <= 2)
SELECT query_id, rank::BIGINT AS rank, doc_id, source AS document, round(rrf, 4) AS score FROM r WHERE rank <= 6""")
def search_production(spark, d):
    """The search without settings: blended vectors, forty of each list, two of a document."""
    return searched(spark, d, se.PRODUCTION).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "document", "score")


EXPECTED = f"{TRUTH}, want AS (SELECT DISTINCT query_id, source FROM truth JOIN documents USING (doc_id))"


def expected_sources(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("document"))
    return truth_of(spark, d).join(docs, "doc_id").select("query_id", "document").distinct()


@query(MODES_SQL + f""", {EXPECTED}, f AS (SELECT config, query_id, source, min(rank) AS r FROM modes JOIN documents USING (doc_id) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY r) AS doc_rank FROM f),
c AS (SELECT DISTINCT config FROM modes), q AS (SELECT query_id, count(*) AS n_expected FROM want GROUP BY 1),
b AS (SELECT c.config, q.query_id, any_value(n_expected) AS n_expected, min(doc_rank) AS best, count(doc_rank) FILTER (doc_rank <= 5) AS found FROM c CROSS JOIN q JOIN want USING (query_id) LEFT JOIN o ON o.config = c.config AND o.query_id = q.query_id AND o.source = want.source GROUP BY 1, 2)
SELECT config, query_id, coalesce((best <= 1)::INT, 0) AS hit_at_1, coalesce((best <= 5)::INT, 0) AS hit_at_5, round(found / n_expected, 6) AS recall_at_5, round(CASE WHEN best <= 5 THEN 1 / best ELSE 0 END, 6) AS mrr_at_5 FROM b""")
def experiment_metrics(spark, d):
    """Metrics by document of each passage under each mode: baseline against candidates."""
    out = ev.experiment(index_of(spark, d), chunks_of(spark, d), questions_of(spark, d), expected_sources(spark, d), MODES, "document")
    return out.select("config", "query_id", "hit_at_1", "hit_at_5", "recall_at_5", "mrr_at_5")


@query(f"""WITH {BM25}, {TRUTH}, q AS (SELECT DISTINCT query_id FROM truth), h AS (SELECT DISTINCT l.query_id FROM lex l JOIN truth t ON t.query_id = l.query_id AND t.doc_id = l.doc_id WHERE rank <= 5)
SELECT q.query_id, h.query_id IS NOT NULL AS ok FROM q LEFT JOIN h USING (query_id)""")
def spot_check(spark, d):
    ranked = lexical_list(spark, d, 5).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    return ev.spot_check(ranked, truth_of(spark, d), "doc_id")


GROUPS = "CASE query_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"


@query(METRICS_SQL + f" SELECT {GROUPS} AS grp, count(*)::BIGINT AS n, count(*) FILTER (hit_at_5 = 1)::BIGINT AS passed, round(count(*) FILTER (hit_at_5 = 1) / count(*), 6) AS share FROM m GROUP BY 1")
def group_pass_counts(spark, d):
    return ev.passed(metrics_of(spark, d).withColumn("grp", F.expr(GROUPS)), "grp", F.col("hit_at_5") == 1)


@query(METRICS_SQL + """ SELECT round(avg(CASE WHEN query_id % 2 = 0 THEN hit_at_5 END), 6) AS exact_hit_at_5, round(avg(CASE WHEN query_id % 2 = 1 THEN recall_at_5 END), 6) AS semantic_recall_at_5, round(avg(coalesce(ndcg_at_5, 0)), 6) AS mean_ndcg FROM m""")
def category_subsets(spark, d):
    """Means over subsets of the questions; unknown values count as 0."""
    exact = F.col("query_id") % 2 == 0
    mean = lambda c, inside=None: ev.mean_of(F.col(c).cast("double"), inside)
    return metrics_of(spark, d).agg(mean("hit_at_5", exact).alias("exact_hit_at_5"), mean("recall_at_5", ~exact).alias("semantic_recall_at_5"), mean("ndcg_at_5").alias("mean_ndcg"))


@query(f"""WITH {BM25}, {TRUTH}, q AS (SELECT DISTINCT query_id FROM truth), b AS (SELECT q.query_id, min(rank) AS rank FROM q LEFT JOIN truth t USING (query_id) LEFT JOIN lex l ON l.query_id = t.query_id AND l.doc_id = t.doc_id AND rank <= 10 GROUP BY 1)
SELECT round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM b""")
def mrr_of_ten(spark, d):
    ranked = lexical_list(spark, d, 10).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    best = ev.judged(ranked, truth_of(spark, d), "doc_id").groupBy("query_id").agg(F.min("doc_rank").alias("rank"))
    return best.agg(ev.reciprocal_mean(F.col("rank")).alias("mrr"))


@query(MODES_SQL + f""", {TRUTH}, h AS (SELECT t.query_id, coalesce(bool_or(m.rank <= 5) FILTER (m.config = 'vector-only'), false) AS before, coalesce(bool_or(m.rank <= 5) FILTER (m.config = 'lexical-only'), false) AS now FROM truth t LEFT JOIN modes m ON m.query_id = t.query_id AND m.doc_id = t.doc_id GROUP BY 1)
SELECT query_id, CASE WHEN now AND NOT before THEN 'improved' WHEN before AND NOT now THEN 'regressed' WHEN now THEN 'kept' ELSE 'missed' END AS outcome FROM h""")
def outcome_labels(spark, d):
    """What became of each passage from the vector search to the lexical one."""
    truth = truth_of(spark, d)
    hit = lambda mode: ev.spot_check(searched(spark, d, MODES[mode]).select("query_id", "doc_id", F.col("rank").alias("doc_rank")), truth, "doc_id")
    both = hit("vector-only").withColumnRenamed("ok", "before").join(hit("lexical-only"), "query_id")
    return both.select("query_id", ev.outcome(F.col("before"), F.col("ok")).alias("outcome"))


@query(f"""WITH {BM25} SELECT query_id, bool_and(source = 'src' || (query_id % 20)) AS filter_ok FROM lex JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1""")
def filter_accuracy(spark, d):
    """Whether all first hits have the category a query asks for."""
    top = lexical_list(spark, d, 5).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    ok = fl.filter_met(F.col("source"), F.array().cast("array<string>"), F.concat(F.lit("src"), F.col("query_id") % 20), F.lit(None).cast("string"))
    return top.groupBy("query_id").agg(F.bool_and(ok).alias("filter_ok"))


@query(TAX + ", e AS (SELECT query_id, unnest(string_split(failures, ',')) AS code FROM f) SELECT code, count(*)::BIGINT AS n, min(query_id) AS sample FROM e WHERE code <> '' GROUP BY 1")
def failure_samples(spark, d):
    """How often each failure code comes, and its first query."""
    return ev.samples(coded(spark, d), "query_id")


@query("SELECT event_type, count(*)::BIGINT AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_summary(spark, d):
    return ev.spread(read(spark, d, "events"), "value", ("event_type",))


DELTAS = "SELECT event_type AS run, round(avg(value), 6) AS mean_value, count(*)::DOUBLE AS n FROM events GROUP BY 1"


@query(f"""WITH r AS ({DELTAS}), l AS (SELECT run, unnest(['mean_value', 'n']) AS metric, unnest([mean_value, n]) AS value FROM r), b AS (SELECT metric, value AS base FROM l WHERE run = 'click')
SELECT run, metric, value, base, round(value - base, 4) AS absolute, round((value - base) / nullif(base, 0), 4) AS relative FROM l JOIN b USING (metric)""")
def experiment_deltas(spark, d):
    r = read(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").cast("double").alias("n"))
    base = r.select("run").crossJoin(r.where("run = 'click'").drop("run"))
    return ev.deltas(r, base, ("mean_value", "n"), ["run"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def closed_world_join(spark, d):
    """Nations with their region; a region without a nation, or the other way round, would fail the query."""
    regions = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return ql.closed_world(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), regions, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'undated-' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey END AS slug FROM orders)
SELECT o_custkey, arg_max(slug, (left(slug, 10), -length(slug), slug)) FILTER (regexp_matches(slug, '^[0-9]{4}-')) IS NOT NULL AS dated, max(left(slug, 10)) FILTER (regexp_matches(slug, '^[0-9]{4}-')) AS newest FROM s GROUP BY 1""")
def newest_slug(spark, d):
    """The latest of each customer's dated names."""
    o = read(spark, d, "orders")
    slug = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("undated-"), F.col("o_orderkey"))).otherwise(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey"))
    rows = o.select("o_custkey", slug.alias("slug")).groupBy("o_custkey").agg(newest_dated(F.array_sort(F.collect_list("slug"))).alias("s"))
    return rows.select("o_custkey", F.col("s").isNotNull().alias("dated"), F.substring("s", 1, 10).alias("newest"))


@query("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_totalprice / 1000 AS top FROM orders),
b AS (SELECT *, max((top > 96)::INT) OVER (PARTITION BY o_custkey ORDER BY pos) AS below FROM h)
SELECT o_custkey, coalesce(arg_max(o_orderkey, pos) FILTER (below = 0), arg_min(o_orderkey, pos)) AS heading FROM b GROUP BY 1""")
def active_heading(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("heading"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") / 1000).alias("top"))
    return md.active_heading(o, "o_custkey")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o, o_orderpriority) AS place FROM f) WHERE place <= 10""")
def first_unique_ten(spark, d):
    return ev.first_unique(read(spark, d, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey")).withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT n_nationkey, s_suppkey, score, rank::BIGINT AS rank FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, floor(s_acctbal / 1000)::BIGINT AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_name) AS rank FROM supplier) WHERE rank <= 5""")
def collated_ties(spark, d):
    """Best suppliers of each nation by thousands; ties in the order of their names."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name", F.floor(F.col("s_acctbal") / 1000).alias("score"))
    return se.collated(s, 5, "s_name", "n_nationkey", locale="ko").select("n_nationkey", "s_suppkey", "score", F.col("rank").cast("bigint").alias("rank"))


FIELDS_SQL = "concat_ws(' ', source, 'doc-' || doc_id, lang"
SYMBOLS_SQL = "'" + "(" + "|".join(se.EXACT_SYMBOLS) + ")" + "'"


@query(f"""WITH e AS (SELECT doc_id, text, source, lang, concat_ws(' ', 'doc-' || doc_id, nullif(source, ''), nullif(array_to_string(regexp_extract_all(coalesce(text, ''), {SYMBOLS_SQL}, 1), ' '), '')) AS exact FROM documents)
SELECT doc_id, md5(exact) AS exact_terms, md5(concat_ws(' ', exact, exact, exact, nullif(source, ''), 'doc-' || doc_id, nullif(lang, ''), nullif(text, ''))) AS lexical_text FROM e""")
def chunk_projections(spark, d):
    """What a chunk is searched by: names, tags and symbols, and the lexical document."""
    c = read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.col("lang").alias("category"), "text")
    return c.select("doc_id", F.md5(se.exact_terms(c)).alias("exact_terms"), F.md5(se.lexical_text(c)).alias("lexical_text"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[#>*`|\\[\\]()]', ' ', 'g'), '\\s+', ' ', 'g'))) AS searchable FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```')""")
def searchable_text(spark, d):
    docs = read(spark, d, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("```")))
    return docs.select("doc_id", F.md5(searchable(F.col("text"))).alias("searchable"))


@query("""WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^#+\\s+', '', 'gm'), '\\s+', '', 'g') AS body, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN substr(text, 3, 60) ELSE left(text, 60) END, '\\s+', '', 'g') AS said FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT regexp_matches(text, '(^|\\n)#'))
SELECT doc_id, least(30, length(body), length(said)) > 0 AND left(body, least(30, length(body), length(said))) = left(said, least(30, length(body), length(said))) AS again FROM e""")
def excerpt_duplicates(spark, d):
    docs = read(spark, d, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("```")) & ~F.col("text").rlike(r"(^|\n)#"))
    said = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 60)).otherwise(F.substring("text", 1, 60))
    return docs.select("doc_id", is_excerpt_again(F.col("text"), said).alias("again"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT (doc_id, text))::BIGINT AS n_hashes FROM documents")
def document_hashes(spark, d):
    """As many different hashes as there are different documents."""
    return read(spark, d, "documents").select(content_hash(F.col("doc_id"), F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_hashes"))


@query("""SELECT n_nationkey, '#/' || replace(n_name, ' ', '%20') || CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_regionkey ELSE '' END AS route, 'doc' AS view, n_name AS slug, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS section FROM nation""")
def wiki_routes(spark, d):
    """Routes of documents and their sections, and what they are parsed back to."""
    n = read(spark, d, "nation").withColumn("route", md.route(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string"))))
    p = n.withColumn("p", md.parse_route(F.col("route")))
    return p.select("n_nationkey", "route", "p.view", "p.slug", "p.section")


#: Lines of the documents as Markdown: headings, items, quotes and paragraphs in turn.
MARKED = "CASE pos % 7 WHEN 0 THEN '## ' || line WHEN 1 THEN '- ' || line WHEN 2 THEN '* ' || line WHEN 3 THEN '> ' || line ELSE line END"


def marked(spark, d) -> DataFrame:
    rows = ch.lines(read(spark, d, "documents"), "doc_id", F.col("text")).withColumn("line", F.regexp_replace("line", r"[#>*`|\-]", "")).withColumn("line", F.expr(MARKED))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("body"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, pos, regexp_replace(line, '[#>*`|\\-]', '', 'g') AS line FROM l), m AS (SELECT doc_id, pos, {MARKED} AS line FROM c),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,3}}\\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^[-*]\\s+') THEN 'list' WHEN regexp_matches(line, '^>') THEN 'quote' ELSE 'paragraph' END AS kind FROM m),
n AS (SELECT *, (kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS new FROM k),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM n)
SELECT doc_id, kind, count(DISTINCT block)::BIGINT AS n FROM b WHERE kind <> 'blank' GROUP BY 1, 2""")
def markdown_blocks(spark, d):
    """Blocks of each kind in the documents' lines as Markdown."""
    return md.blocks(marked(spark, d), "doc_id", F.col("body")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query()
def markdown_units(spark, d):
    """Units of prose, tables and code with their paths (rows only: windows over lines; unit tests pin them)."""
    rows = ch.units(marked(spark, d), "doc_id", F.col("body"))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max(F.length("heading_path")).alias("longest_path"))


@query()
def markdown_headings(spark, d):
    """Headings with anchors that do not repeat in a document (rows only: the allocation is sequential)."""
    return ch.headings(marked(spark, d), "doc_id", F.col("body")).select("doc_id", "n", "level", "base_id", "heading_id")


@query()
def structured_chunks(spark, d):
    """Chunks of units, short ones merged and long ones cut (rows only: packing is sequential)."""
    rows = ch.structured_chunks(marked(spark, d), "doc_id", contextual=True)
    return rows.select("doc_id", "chunk_order", "chunk_type", "chunk_hash", F.length("text").alias("chars"))


@query()
def legacy_chunks(spark, d):
    """Chunks of the legacy schema (rows only: packing is sequential)."""
    return ch.legacy_chunks(marked(spark, d), "doc_id", F.col("body")).select("doc_id", "chunk_order", "section", F.length("text").alias("chars"))


# Files as the corpus reader gives them, made of customers; every eleventh lacks its frontmatter.
def files_of(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    if c.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        c = c.repartition(spark.sparkContext.defaultParallelism)  # one file is one split, and parsing is what costs
    k = F.col("c_custkey")
    status = F.when(k % 7 == 0, "archived").when(k % 5 == 0, "superseded").when(k % 3 == 0, "verified").otherwise("partial")
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), "c_name", F.lit('"')),
        F.concat(F.lit("category: "), F.when(k % 4 == 0, "Backend").otherwise("Project")),
        F.lit("updatedAt: 2026-01-01"),
        F.lit("type: decision"),
        F.concat(F.lit("status: "), status),
        F.lit("evidenceLevel: unit-test"),
        F.when(k % 2 == 0, "verifiedAt: 2026-01-01"),
        F.concat(F.lit("relations: [related:c-"), (k + 1).cast("string"), F.lit(", supports:c-"), F.when(k % 6 == 0, k).otherwise(k + 2).cast("string"), F.lit("]")),
        F.lit("---"),
        F.lit("## Notes"),
        F.col("c_mktsegment") if "c_mktsegment" in c.columns else F.lit("text"),
    )
    return c.select(F.concat(F.lit("c-"), k).alias("slug"), F.lit("").alias("source_path"), F.when(k % 11 == 0, "no head").otherwise(head).alias("raw"))


@query("""WITH c AS (SELECT c_custkey AS k, k % 11 = 0 AS unread, k % 7 <> 0 AS pub, CASE WHEN k % 7 = 0 THEN 'archived' WHEN k % 5 = 0 THEN 'superseded' WHEN k % 3 = 0 THEN 'verified' ELSE 'partial' END AS status FROM customer),
e AS (SELECT k, 0 AS pos, k + 1 AS dst FROM c WHERE NOT unread AND pub UNION ALL SELECT k, 1, CASE WHEN k % 6 = 0 THEN k ELSE k + 2 END FROM c WHERE NOT unread AND pub),
p AS (SELECT e.k, CASE WHEN e.dst = e.k THEN 'self' WHEN t.k IS NULL OR t.unread THEN 'missing_target' WHEN NOT t.pub THEN 'not_public' END AS problem FROM e LEFT JOIN c t ON t.k = e.dst)
SELECT 'c-' || k AS slug, 'frontmatter' AS field, 'missing frontmatter' AS problem FROM c WHERE unread
UNION ALL SELECT 'c-' || k, 'verifiedAt', 'not allowed' FROM c WHERE NOT unread AND pub AND status = 'verified' AND k % 2 <> 0
UNION ALL SELECT 'c-' || k, 'supersededBy', 'not allowed' FROM c WHERE NOT unread AND pub AND status = 'superseded'
UNION ALL SELECT 'c-' || k, 'relations', problem FROM p WHERE problem IS NOT NULL""")
def corpus_audit(spark, d):
    """What is wrong in a corpus of Markdown files: unreadable heads, fields and relations."""
    parsed = co.parse(files_of(spark, d))
    public = ~co.is_excluded(F.col("status"), F.coalesce("wikiVisibility", "visibility"))
    return ql.audit_corpus(parsed, public)


@query("SELECT 'c-' || c_custkey AS slug FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0")
def indexable_slugs(spark, d):
    return co.indexable(co.typed(co.parse(files_of(spark, d))))


@query()
def answers_of_turns(spark, d):
    """Answers to what users ask, or why there is none (rows only: the gates need look-around)."""
    turns = read(spark, d, "conversations").where("role = 'user'")
    q = turns.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))
    out = an.answer_questions(index_of(spark, d), chunks_of(spark, d), q, slug="slug", document="document")
    return out.select("query_id", "status", "reason", "answer_mode", F.md5("answer").alias("answer"), F.size("sources").alias("n_sources"))


@query("SELECT e.src AS src, count(*)::BIGINT AS n FROM (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages) e JOIN pages p ON p.url = e.dst GROUP BY 1")
def resolved_links(spark, d):
    """Links of each page that lead to a page."""
    pages = read(spark, d, "pages")
    edges = gr.html_links(pages, "page_id", F.col("html"))
    return gr.resolved(edges, pages.select("url"), "url").groupBy("src").agg(F.count("*").alias("n"))

"""Retrieval queries: documents are the chunks, benchmark passages the queries, sources the documents they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, fnv1a, index_tokens
from ..operators import evaluation as ev
from ..operators import fusion as fu
from ..operators import index as ix
from ..operators import lexical as lx
from ..operators import vectors as vx
from ..sources.workspace import cut, kept
from .base import BM25, FNV, FUSED, FUSED_ORDER, TOKENS, VECTORS, query, read, tok

TOP_N = 40


def docs_of(spark, d) -> DataFrame:
    """Documents, dealt out before tokenizing: one file is one split, and tokenizing is what costs."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return docs.repartition(spark.sparkContext.defaultParallelism) if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs


def index_of(spark, d) -> ix.Index:
    """The index of the documents, built at a session's first query and kept until the table changes."""
    at = f"{d.rstrip('/')}/documents.parquet"
    return ix.build(docs_of(spark, d), "doc_id", F.col("text"), lambda name, make: kept(spark, f"documents-{name}", at, make), carry=("source", "lang"))


def asked_of(spark, d) -> DataFrame:
    return ix.asked_terms(read(spark, d, "benchmark"), "item_id", F.col("text"))


def lexical_list(spark, d, n: int = TOP_N) -> DataFrame:
    """The first ``n`` of each query, computed once: what joins with them reads a few rows."""
    scored = ix.lexical(index_of(spark, d), asked_of(spark, d), most=n).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return lx.small(cut(lx.top_k(scored, n, [F.desc("score"), F.col("doc_id")])))


def vector_list(spark, d, n: int = TOP_N) -> DataFrame:
    return lx.small(cut(lx.top_k(ix.cosine(index_of(spark, d), asked_of(spark, d), n, 0.03), n, [F.desc("score"), F.col("doc_id")])))


def fused_list(spark, d, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    out = fu.rrf(lexical_list(spark, d), vector_list(spark, d), "doc_id", lexical_weight=lexical_weight, vector_weight=vector_weight)
    return out.withColumn("rrf", F.round("rrf", 9))


@query(f"SELECT source, count(*)::BIGINT AS docs, sum(len({tok('text')}))::BIGINT AS tokens FROM documents GROUP BY source")
def tokenize_counts(spark, d):
    rows = docs_of(spark, d).select("source", F.size(index_tokens(F.col("text"))).alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("tokens"))


@query(f"WITH {TOKENS} SELECT doc_id, term, tf::BIGINT AS tf FROM post")
def term_frequency(spark, d):
    return index_of(spark, d).postings.select("doc_id", "term", "tf")


@query(f"WITH {TOKENS} SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term")
def document_frequency(spark, d):
    return index_of(spark, d).terms


@query(f"WITH {TOKENS} SELECT count(*)::BIGINT AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avgdl, max(dl)::BIGINT AS longest FROM len")
def corpus_stats(spark, d):
    dl = lx.lengths(read(spark, d, "documents"), "doc_id", F.col("text"))
    return dl.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


@query(f"WITH {TOKENS} SELECT DISTINCT term, {FNV.format('term')}::BIGINT AS hash FROM qt")
def fnv_hash_terms(spark, d):
    terms = lx.terms(read(spark, d, "benchmark"), "item_id", F.col("text")).select("term").distinct()
    return terms.select("term", fnv1a(F.col("term")).alias("hash"))


@query(f"WITH {TOKENS}, {VECTORS} SELECT doc_id, bucket::BIGINT AS bucket, w FROM dvec")
def hash_embedding_sparse(spark, d):
    cells = index_of(spark, d).vectors.select("doc_id", F.explode(F.arrays_zip("buckets", "weights")).alias("c"))
    return cells.select("doc_id", F.col("c.buckets").cast("bigint").alias("bucket"), F.round(F.col("c.weights") / 1e6, 6).alias("w"))


@query(f"WITH {TOKENS}, {VECTORS} SELECT doc_id, round(sqrt(sum(n * n)), 6) AS norm, count(*)::BIGINT AS filled FROM dvec0 GROUP BY doc_id")
def hash_embedding_norm(spark, d):
    b = vx.buckets(docs_of(spark, d), "doc_id", F.col("text"))
    return b.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("norm"), F.count("*").alias("filled"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM lex WHERE rank <= 10")
def bm25_topk(spark, d):
    return lexical_list(spark, d, 10).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


FILTERED = f"""WITH {TOKENS},
cand AS (SELECT item_id AS query_id, doc_id, dl FROM benchmark JOIN len ON source = 'src' || (item_id % 20)),
qs AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM cand GROUP BY 1),
met AS (SELECT c.query_id, c.doc_id, p.term, tf, dl, qtf FROM cand c JOIN post p USING (doc_id) JOIN qt q ON q.query_id = c.query_id AND q.term = p.term),
df AS (SELECT query_id, term, count(*) AS df FROM met GROUP BY 1, 2)
SELECT m.query_id, m.doc_id, round(1.24 * sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM met m JOIN df USING (query_id, term) JOIN qs USING (query_id) GROUP BY ALL"""


@query(FILTERED)
def bm25_filtered_stats(spark, d):
    """Statistics over each query's own candidates (an explicit category filter), with the boost of category, summary and date."""
    wanted = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    docs = read(spark, d, "documents").select("doc_id", "source")
    cand = docs.join(lx.small(wanted), "source").select("query_id", "doc_id", F.lit(1.0 + 0.18 + 0.04 + 0.02).alias("boost"))
    return ix.lexical(index_of(spark, d), asked_of(spark, d), cand).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, boosted AS (
  SELECT query_id, doc_id, round(s.score * (1 + CASE WHEN lang = 'en' THEN 0.16 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.18 ELSE 0 END), 6) AS score FROM scored s JOIN documents USING (doc_id)
) SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM boosted) WHERE rank <= 10""")
def bm25_boosted(spark, d):
    from ..operators.filters import boost

    lift = boost(F.col("source") == "src1", F.col("lang") == "en", F.lit(False), F.lit(False))
    scored = ix.lexical(index_of(spark, d), asked_of(spark, d), most=10, boost=lift)
    ranked = lx.top_k(scored.select("query_id", "doc_id", F.round("score", 6).alias("score")), 10, [F.desc("score"), F.col("doc_id")])
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
KNN = f"""SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"""


def knn(spark, d, k: int = 10):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vx.nearest(e.select("vec_id", "embedding"), q, "vec_id", "embedding", k)


@query(KNN)
def cosine_knn(spark, d):
    """Every twentieth vector is a query against all vectors."""
    return knn(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH k AS ({KNN}) SELECT query_id, sum((a.label = b.label)::INT)::BIGINT AS same, round(avg((a.label = b.label)::INT), 6) AS agreement FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = k.vec_id GROUP BY 1")
def cosine_label_agreement(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    rows = knn(spark, d).join(e, "vec_id").join(own, "query_id")
    same = (F.col("label") == F.col("own")).cast("int")
    return rows.groupBy("query_id").agg(F.sum(same).alias("same"), F.round(F.avg(same), 6).alias("agreement"))


@query(f"SELECT a.vec_id AS query_id, count(*)::BIGINT AS n, round(max({COS}), 6) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND round({COS}, 6) >= 0.3 GROUP BY 1")
def cosine_threshold(spark, d):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vx.matches(e.select("vec_id", "embedding"), q, "vec_id", "embedding", 0.3)


OVERLAP = f"""qset AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY 1),
ovl AS (SELECT q.query_id, p.doc_id, count(*) / any_value(nq) AS overlap FROM qt q JOIN post p USING (term) JOIN qset USING (query_id) GROUP BY 1, 2)"""


@query(f"WITH {TOKENS}, {OVERLAP} SELECT query_id, doc_id, round(overlap, 6) AS overlap FROM ovl WHERE overlap >= 0.2")
def keyword_overlap(spark, d):
    return ix.overlap(index_of(spark, d), asked_of(spark, d), 0.2).select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {TOKENS}, {VECTORS}, {OVERLAP}, mixed AS (
  SELECT query_id, doc_id, c.score AS vector_score, coalesce(round(overlap, 6), 0) AS overlap FROM cos c LEFT JOIN ovl USING (query_id, doc_id)
), s AS (SELECT *, round(0.75 * vector_score + 0.25 * overlap, 8) AS score FROM mixed)
SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s
  WHERE CASE WHEN overlap > 0 THEN score >= 0.03 ELSE vector_score >= 0.55 AND score >= 0.03 END) WHERE rank <= 10""")
def blended_vector_score(spark, d):
    from ..operators.filters import floor_blended

    both = ix.blended(index_of(spark, d), asked_of(spark, d), 10)
    both = both.withColumn("score", F.round(0.75 * F.col("vector_score") + 0.25 * F.col("overlap"), 8))
    kept = both.where(floor_blended(F.col("overlap"), F.col("vector_score"), F.col("score")))
    ranked = lx.top_k(kept, 10, [F.desc("score"), F.col("doc_id")])
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {FUSED} SELECT query_id, doc_id, rrf, lexical_rank::BIGINT AS lexical_rank, vector_rank::BIGINT AS vector_rank FROM fused")
def rrf_fusion(spark, d):
    return fused_list(spark, d).select("query_id", "doc_id", "rrf", "lexical_rank", "vector_rank")


@query(f"""WITH {BM25}, {VECTORS}, parts AS (
  SELECT query_id, doc_id, 2.0 / (60 + rank) AS part FROM lex WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM vec WHERE rank <= 40)
SELECT query_id, doc_id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL""")
def rrf_weighted(spark, d):
    return fused_list(spark, d, 2.0, 0.5).select("query_id", "doc_id", "rrf")


def diversified_sql(most: int) -> str:
    return f"""WITH {FUSED}, own AS (
  SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY {FUSED_ORDER}) AS k FROM fused f JOIN documents USING (doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {FUSED_ORDER}) AS rank FROM own WHERE k <= {most})
SELECT query_id, rank::BIGINT AS rank, doc_id, source, rrf FROM ranked WHERE rank <= 6"""


def diversified(spark, d, most: int, limit: int = 6) -> DataFrame:
    rows = fused_list(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return fu.diversify(rows, "source", fu.fused_order(), most, limit)


@query(diversified_sql(1))
def hybrid_diversified_max1(spark, d):
    return diversified(spark, d, 1).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "source", "rrf")


@query(diversified_sql(2))
def hybrid_diversified_max2(spark, d):
    """Production order: forty of each list, fused, at most two of a document, six in all."""
    return diversified(spark, d, 2).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "source", "rrf")


@query(f"""WITH {FUSED} SELECT query_id, count(lexical_rank)::BIGINT AS n_lexical, count(vector_rank)::BIGINT AS n_vector,
  count(*) FILTER (lexical_rank IS NOT NULL AND vector_rank IS NOT NULL)::BIGINT AS n_both,
  round(2 * count(*) FILTER (lexical_rank IS NOT NULL AND vector_rank IS NOT NULL) / (count(lexical_rank) + count(vector_rank)), 6) AS dice FROM fused GROUP BY 1""")
def retriever_overlap_dice(spark, d):
    return fu.overlap(lexical_list(spark, d), vector_list(spark, d), "doc_id")


GRID = ((20, 1.0, 1.0), (60, 1.0, 1.0), (60, 2.0, 1.0), (60, 1.0, 2.0))


@query(f"""WITH {BM25}, {VECTORS}, grid(k, lw, vw) AS (VALUES {', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE)' for k, a, b in GRID)}),
parts AS (SELECT k, lw, vw, query_id, doc_id, lw / (k + rank) AS part FROM lex, grid WHERE rank <= 40 UNION ALL SELECT k, lw, vw, query_id, doc_id, vw / (k + rank) FROM vec, grid WHERE rank <= 40),
f AS (SELECT k, lw, vw, query_id, doc_id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL)
SELECT k::INT AS k, lw AS lexical_weight, vw AS vector_weight, query_id, doc_id, rrf FROM (SELECT *, row_number() OVER (PARTITION BY k, lw, vw, query_id ORDER BY rrf DESC, doc_id) AS r FROM f) WHERE r = 1""")
def rrf_grid_sweep(spark, d):
    """Best document of each query under each setting of a real grid."""
    from pyspark.sql import Window

    grid = F.broadcast(spark.createDataFrame(GRID, "k int, lexical_weight double, vector_weight double"))
    by = ("k", "lexical_weight", "vector_weight", "query_id")
    out = fu.rrf(lexical_list(spark, d).crossJoin(grid), vector_list(spark, d).crossJoin(grid), "doc_id", F.col("k"), F.col("lexical_weight"), F.col("vector_weight"), by)
    out = out.withColumn("rrf", F.round("rrf", 9))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rrf"), "doc_id"))
    return out.withColumn("r", best).where("r = 1").select(*by, "doc_id", "rrf")


@query(f"WITH {BM25}, f AS (SELECT query_id, source, min(rank) AS r FROM lex JOIN documents USING (doc_id) WHERE rank <= 40 GROUP BY 1, 2) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY r)::BIGINT AS doc_rank FROM f")
def first_doc_order(spark, d):
    ranked = lexical_list(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return fu.first_documents(ranked, "source").withColumn("doc_rank", F.col("doc_rank").cast("bigint"))


@query(f"WITH {BM25} SELECT query_id, source, doc_id, rank::BIGINT AS rank FROM (SELECT query_id, source, doc_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM lex JOIN documents USING (doc_id) WHERE rank <= 40) WHERE k = 1")
def source_dedupe(spark, d):
    ranked = lexical_list(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return fu.dedupe_sources(ranked, "source").select("query_id", "source", "doc_id", F.col("rank").cast("bigint").alias("rank"))


TRUTH = "truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def truth_of(spark, d) -> DataFrame:
    """(query_id, doc_id) of documents that hold a passage whole; candidates come from the index."""
    passages = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return ix.holding(index_of(spark, d), read(spark, d, "documents").select("doc_id", "text"), passages)


METRICS_SQL = f"""WITH {BM25}, {TRUTH}, n AS (SELECT query_id, count(*) AS n_expected FROM truth GROUP BY 1),
r AS (SELECT n.query_id, n_expected, rank FROM n LEFT JOIN (SELECT t.query_id, rank FROM truth t JOIN lex l ON l.query_id = t.query_id AND l.doc_id = t.doc_id WHERE rank <= 40) m ON m.query_id = n.query_id),
g AS (SELECT query_id, any_value(n_expected) AS n_expected, min(rank) AS best, count(*) FILTER (rank <= 5) AS found, coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM r GROUP BY 1),
m AS (SELECT query_id, n_expected::BIGINT AS n_expected, coalesce((best <= 1)::INT, 0) AS hit_at_1, coalesce((best <= 3)::INT, 0) AS hit_at_3, coalesce((best <= 5)::INT, 0) AS hit_at_5,
  round(found / n_expected, 6) AS recall_at_5, round(CASE WHEN best <= 5 THEN 1 / best ELSE 0 END, 6) AS mrr_at_5,
  round(dcg / list_sum(list_transform(range(1, least(n_expected, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_5 FROM g)"""


def metrics_of(spark, d) -> DataFrame:
    ranked = lexical_list(spark, d).select("query_id", "doc_id", F.col("rank").alias("doc_rank"))
    return ev.retrieval_metrics(ranked, truth_of(spark, d), "doc_id")


@query(METRICS_SQL + " SELECT * FROM m")
def retrieval_metrics(spark, d):
    """hit@k, recall@k, MRR and nDCG of BM25 against the documents that hold the passage."""
    return metrics_of(spark, d)


@query(METRICS_SQL + " SELECT count(*)::BIGINT AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr_at_5), 6) AS mrr_at_5, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM m")
def metrics_summary(spark, d):
    m = metrics_of(spark, d)
    return m.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_at_1", "hit_at_5", "recall_at_5", "mrr_at_5", "ndcg_at_5")])


@query(f"""WITH {BM25}, {TRUTH} SELECT l.query_id, round(count(t.doc_id) / 5.0, 6) AS precision_at_5 FROM lex l LEFT JOIN truth t ON t.query_id = l.query_id AND t.doc_id = l.doc_id WHERE rank <= 5 GROUP BY 1""")
def context_precision(spark, d):
    top = lexical_list(spark, d, 5).select("query_id", "doc_id")
    hit = truth_of(spark, d).withColumn("hit", F.lit(1))
    return top.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / 5.0, 6).alias("precision_at_5"))


TAX = f"""WITH {BM25}, {TRUTH},
n AS (SELECT item_id AS query_id, any_value(b.text) AS question, count(doc_id) AS n_expected, max(doc_id) AS newest FROM benchmark b LEFT JOIN truth ON query_id = item_id GROUP BY 1),
h AS (SELECT l.query_id, count(*) AS n_results, max(score) AS max_score, count(t.doc_id) AS found, coalesce(bool_or(t.doc_id IS NOT NULL) FILTER (rank = 1), false) AS top1, coalesce(bool_or(t.doc_id IS NOT NULL) FILTER (rank <= 5), false) AS top5,
  count(*) - count(DISTINCT source) AS dup, bool_and(lang = 'en') AS english, max(lower(d.text)) FILTER (rank = 1) AS first_text, coalesce(bool_or(l.doc_id = newest) FILTER (rank <= 5), false) AS newest5
  FROM lex l JOIN documents d USING (doc_id) JOIN n ON n.query_id = l.query_id LEFT JOIN truth t ON t.query_id = l.query_id AND t.doc_id = l.doc_id WHERE rank <= 6 GROUP BY 1),
c AS (SELECT n.query_id, n_expected > 0 AS answerable, coalesce(n_results, 0) AS n_results, n_expected, coalesce(found, 0) > 0 AS anyx, coalesce(top1, false) AS top1, coalesce(top5, false) AS top5, coalesce(max_score, 0) AS max_score, coalesce(dup, 0) AS dup,
  n.query_id % 4 <> 0 OR coalesce(english, true) AS filter_ok, n_expected > 1 AND coalesce(top1, false) AND NOT coalesce(newest5, false) AS stale, list_slice({tok('question')}, 1, 3) AS words, coalesce(first_text, '') AS first_text FROM n LEFT JOIN h USING (query_id)),
f AS (SELECT query_id, array_to_string(list_filter(CASE WHEN NOT answerable THEN [CASE WHEN n_results > 0 AND max_score >= 0.08 THEN 'NO_ANSWER_FAILURE' END]
  WHEN n_results = 0 THEN ['EXPECTED_DOC_NOT_RETRIEVED']
  ELSE [CASE WHEN NOT anyx THEN 'EXPECTED_DOC_NOT_RETRIEVED' END, CASE WHEN NOT top1 AND top5 THEN 'WRONG_TOP1' END, CASE WHEN anyx AND max_score < 0.12 THEN 'LOW_SIMILARITY' END,
        CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: contains(first_text, w))) / len(words) < 0.34 THEN 'KEYWORD_MISS' END,
        CASE WHEN NOT anyx AND max_score >= 0.12 THEN 'SEMANTIC_MISS' END, CASE WHEN NOT filter_ok THEN 'FILTER_FAILURE' END, CASE WHEN dup > 0 THEN 'DUPLICATE_RESULT' END, CASE WHEN stale THEN 'STALE_DOCUMENT_SELECTED' END] END, lambda x: x IS NOT NULL), ',') AS failures FROM c)"""


def coded(spark, d) -> DataFrame:
    """Failure codes of each passage. A passage names its first three terms as keywords, every fourth one asks for
    English documents, and of several documents that hold it the one of the greatest id is the newest."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "text")
    truth = truth_of(spark, d).withColumn("hit", F.lit(1))
    bench = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(index_tokens(F.col("text")), 1, 3).alias("words"))
    n = bench.join(truth, "query_id", "left").groupBy("query_id").agg(F.first("words").alias("words"), F.count("hit").alias("n_expected"), F.max("doc_id").alias("newest"))
    top = lexical_list(spark, d, 6).join(docs, "doc_id").join(truth, ["query_id", "doc_id"], "left").join(n.select("query_id", "newest"), "query_id")
    at = lambda k, ok: F.coalesce(F.max(F.when(F.col("rank") <= k, ok)), F.lit(False))
    found = F.col("hit").isNotNull()
    h = top.groupBy("query_id").agg(
        F.count("*").alias("n_results"), F.max("score").alias("max_score"), F.count("hit").alias("found"), at(1, found).alias("top1"), at(5, found).alias("top5"),
        (F.count("*") - F.countDistinct("source")).alias("dup"), F.bool_and(F.col("lang") == "en").alias("english"), F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("first_text"), at(5, F.col("doc_id") == F.col("newest")).alias("newest5"),
    )
    c = n.join(h, "query_id", "left").fillna({"n_results": 0, "max_score": 0.0, "found": 0, "dup": 0, "top1": False, "top5": False, "english": True, "newest5": False})
    row = {
        "answerable": F.col("n_expected") > 0, "n_results": F.col("n_results"), "n_expected": F.col("n_expected"), "any_expected": F.col("found") > 0,
        "top1_expected": F.col("top1"), "top5_expected": F.col("top5"), "max_score": F.col("max_score"), "keyword_rate": ev.keyword_rate(F.col("first_text"), F.col("words")),
        "filter_ok": (F.col("query_id") % 4 != 0) | F.col("english"), "duplicates": F.col("dup"), "stale": (F.col("n_expected") > 1) & F.col("top1") & ~F.col("newest5"),
    }
    return c.select("query_id", ev.failures(row).alias("failures"))


@query(TAX + " SELECT * FROM f")
def failure_taxonomy(spark, d):
    return coded(spark, d).select("query_id", F.array_join("failures", ",").alias("failures"))


@query(TAX + f", e AS (SELECT unnest(string_split(failures, ',')) AS code FROM f), codes(code_pos, code) AS (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(ev.CODES))}) SELECT code_pos::INT AS code_pos, codes.code, count(e.code)::BIGINT AS n FROM codes LEFT JOIN e USING (code) GROUP BY 1, 2")
def failure_counts_zero_filled(spark, d):
    return ev.count_failures(spark, coded(spark, d))


@query(METRICS_SQL + ", c AS (SELECT m.*, 'g' || (query_id % 3) AS category FROM m) SELECT category, count(*)::BIGINT AS n, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(mrr_at_5), 6) AS mrr_at_5 FROM c GROUP BY 1")
def metrics_by_category(spark, d):
    m = metrics_of(spark, d).withColumn("category", F.concat(F.lit("g"), F.col("query_id") % 3))
    return m.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_5"), 6).alias("hit_at_5"), F.round(F.avg("mrr_at_5"), 6).alias("mrr_at_5"))


@query(METRICS_SQL + " SELECT count(*) FILTER (hit_at_5 = 1 AND hit_at_1 = 0)::BIGINT AS wrong_top1, count(*)::BIGINT AS n FROM m")
def wrong_top1(spark, d):
    return metrics_of(spark, d).agg(F.count_if((F.col("hit_at_5") == 1) & (F.col("hit_at_1") == 0)).alias("wrong_top1"), F.count("*").alias("n"))


@query(f"WITH {BM25} SELECT query_id, (count(*) - count(DISTINCT source))::BIGINT AS duplicates FROM lex JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY 1")
def duplicate_results(spark, d):
    top = lexical_list(spark, d, 6).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return top.groupBy("query_id").agg((F.count("*") - F.countDistinct("source")).alias("duplicates"))


@query(f"""WITH {BM25} SELECT query_id, round(max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), max(score) FILTER (rank = 1)), 6) AS margin FROM lex GROUP BY 1""")
def score_margin(spark, d):
    top = lexical_list(spark, d, 2)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return top.groupBy("query_id").agg(F.round(at(1) - F.coalesce(at(2), at(1)), 6).alias("margin"))


@query(f"""WITH {BM25}, k AS (SELECT query_id, source, count(*) AS n FROM lex JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id, round(max(n) / sum(n), 6) AS concentration FROM k GROUP BY 1""")
def document_concentration(spark, d):
    top = lexical_list(spark, d, 5).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = top.groupBy("query_id", "source").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("concentration"))


@query(f"""WITH {BM25}, p AS (SELECT query_id, rank, doc_id, length(text) AS chars, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM lex JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT query_id, rank::BIGINT AS rank, doc_id, chars::BIGINT AS chars, used::BIGINT AS used FROM p WHERE used <= 4800""")
def context_pack_chars(spark, d):
    """Context of at most 4,800 characters: stops at the first document that does not fit."""
    from ..operators.answer import pack

    top = lexical_list(spark, d, 10).join(docs_of(spark, d).select("doc_id", F.length("text").cast("bigint").alias("chars")), "doc_id")
    out = pack(top, F.col("chars"), [F.col("rank")])
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "chars", F.col("used").cast("bigint").alias("used"))


@query()
def relevance_gate(spark, d):
    """Signals of hybrid hits and the relevance decision of each benchmark passage. Rows only: the gate's regular
    expressions need look-around, which the SQL engine of the comparison lacks; unit tests pin its reasons."""
    from ..operators import gate

    docs = read(spark, d, "documents")
    hits = diversified(spark, d, 2).join(docs.select("doc_id", "text"), "doc_id")
    hits = hits.select("query_id", "rank", F.round("rrf", 4).alias("score"), F.lit(None).cast("double").alias("vector_score"), F.split("matched_by", ",").alias("matched_by"), "source", "text")
    found = cut(gate.hit_signals(cut(hits), F.col("text"), F.col("source"), "source"))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    s = cut(gate.signals(q, found, F.col("text"), F.col("text")))
    yes, why = gate.relevance("hybrid")
    return s.select("query_id", yes.alias("relevant"), why.alias("reason"), F.round("content_coverage", 6).alias("content_coverage"), "content_hits")


@query()
def token_coverage(spark, d):
    """Coverage of each passage's content tokens by its best five documents (rows only, see relevance_gate)."""
    from ..operators import gate

    docs = read(spark, d, "documents")
    top = lexical_list(spark, d, 5).join(docs.select("doc_id", "text"), "doc_id")
    ev5 = top.groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("evidence"))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), content_tokens(F.col("text")).alias("content")).join(ev5, "query_id")
    return q.select("query_id", F.size("content").alias("n_tokens"), F.round(gate.coverage(F.col("content"), F.col("evidence")), 6).alias("coverage"))

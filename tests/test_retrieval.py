"""Ranking, fusion and evaluation on literal inputs and against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnlight.operators import evaluation as ev
from tarnlight.operators import filters as fl
from tarnlight.operators import fusion as fu
from tarnlight.operators import index as ix
from tarnlight.operators import vectors as vx

DOCS = [(1, "alpha beta beta gamma"), (2, "alpha delta"), (3, "omega"), (4, ""), (5, None)]


def brute_bm25(docs, terms):
    tokens = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, tokens.values())) / len(tokens) or 1
    out = {}
    for i, words in tokens.items():
        tf, score = Counter(words), 0.0
        for t, q in Counter(terms).items():
            df = sum(t in w for w in tokens.values())
            if tf[t]:
                score += q * math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf[t] * 2.4 / (tf[t] + 1.4 * (0.25 + 0.75 * len(words) / avg))
        if score:
            out[i] = score
    return out


def asked_of(spark, text):
    return ix.asked_terms(spark.createDataFrame([(7, text)], "q int, text string"), "q", F.col("text"))


def test_bm25(spark):
    index = ix.build(spark.createDataFrame(DOCS, "doc_id int, text string"), "doc_id", F.col("text"))
    asked = asked_of(spark, "alpha beta beta")
    rows = {r.doc_id: r for r in ix.lexical(index, asked).collect()}
    want = brute_bm25(DOCS, ["alpha", "beta", "beta"])
    assert rows.keys() == want.keys() and all(math.isclose(rows[k].score, want[k]) for k in want)
    assert {k: r.overlap for k, r in rows.items()} == {1: 1.0, 2: 0.5}
    some = spark.createDataFrame([(7, 1, 2.0), (7, 2, 2.0)], "query_id int, doc_id int, boost double")
    got = {r.doc_id: r.score for r in ix.lexical(index, asked, some).collect()}
    want = brute_bm25(DOCS[:2], ["alpha", "beta", "beta"])
    assert all(math.isclose(got[k], 2 * want[k]) for k in want) and got.keys() == want.keys()


def test_index_of_nothing(spark):
    index = ix.build(spark.createDataFrame([], "doc_id int, text string"), "doc_id", F.col("text"))
    asked = asked_of(spark, "alpha")
    assert ix.lexical(index, asked).count() == 0 and ix.cosine(index, asked).count() == 0
    full = ix.build(spark.createDataFrame(DOCS, "doc_id int, text string"), "doc_id", F.col("text"))
    assert ix.cosine(full, asked.where("false")).count() == 0


@pytest.mark.parametrize("block", [256 * 8, 1 << 25])
def test_cosine(spark, monkeypatch, block):
    """The packed product against plain Python, in one block of queries and in several."""
    monkeypatch.setattr(ix, "BLOCK_BYTES", block)
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 2 + i % 5))) for i in range(40)]
    index = ix.build(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", F.col("text"))
    questions = spark.createDataFrame([(i, f"w{i} w{i + 1} w3") for i in range(3)], "q int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in ix.cosine(index, ix.asked_terms(questions, "q", F.col("text"))).collect()}

    def packed(text):
        cells = Counter()
        for w in text.split():
            h = 2166136261
            for c in w:
                h = (h ^ ord(c)) * 16777619 % 2**32
            cells[h % 256] += 1
        norm = math.sqrt(sum(n * n for n in cells.values()))
        return {b: round(round(n / norm, 6) * 1e6) for b, n in cells.items()}

    for q in range(3):
        own = packed(f"w{q} w{q + 1} w3")
        for i, text in texts:
            s = sum(w * own.get(b, 0) for b, w in packed(text).items()) // 1_000_000 / 1e6
            assert got.get((q, i), 0.0) == s
    top = ix.cosine(index, ix.asked_terms(questions, "q", F.col("text")), 2, 0.03).collect()
    for q in range(3):
        best = sorted(((-s, i) for (a, i), s in got.items() if a == q))[:2]
        assert {i for _, i in best} <= {r.doc_id for r in top if r.query_id == q}


def test_vector_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5, 9.0]), (3, None), (4, [None, 1.0]), (5, [])], "k int, e array<double>")
    q = v.select(F.col("k").alias("query_id"), "e").where("k in (1, 3)")
    got = {(r.query_id, r.k): r.score for r in vx.scores(v, q, "k", "e").collect()}
    assert got == {(1, 2): 0.5, (1, 4): 0.0, (1, 5): 0.0}
    assert [r.k for r in vx.nearest(v, q, "k", "e", 1).collect()] == [2]


def test_passages(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xone two threes"), (3, "two"), (4, None)], "doc_id int, text string")
    index = ix.build(docs, "doc_id", F.col("text"))
    p = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "absent words here"), (4, "One two three")], "query_id int, passage string")
    got = sorted(tuple(r) for r in ix.holding(index, docs, p).select("query_id", "doc_id").collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_embedding_has_unit_length(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "doc_id int, text string")
    dense = vx.dense_embedding(vx.sparse_embedding(docs, "doc_id", F.col("text")), "doc_id").collect()
    assert len(dense) == 1 and len(dense[0].embedding) == 256
    assert math.isclose(sum(x * x for x in dense[0].embedding), 1, abs_tol=1e-5)


def test_rrf_and_diversify(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc string, rank int")
    vec = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "query_id int, doc string, rank int")
    rows = {r.doc: r for r in fu.rrf(lex, vec, "doc").collect()}
    assert math.isclose(rows["a"].rrf, 1 / 61 + 1 / 62) and rows["a"].matched_by == "bm25,vector,rrf" and rows["c"].matched_by == "vector,rrf"
    full = fu.rrf(lex, vec, "doc").withColumn("source", F.lit("s"))
    assert [r.doc for r in fu.diversify(full, "source", fu.fused_order(), 2, 6).orderBy("rank").collect()] == ["a", "c"]
    o = fu.overlap(lex, vec, "doc").first()
    assert (o.n_lexical, o.n_vector, o.n_both, o.dice) == (2, 2, 1, 0.5)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("ABCDE")], "query_id int, doc string, doc_rank int")
    expected = spark.createDataFrame([(1, "C"), (1, "Z")], "query_id int, doc string")
    m = ev.retrieval_metrics(ranked, expected, "doc").first()
    assert (m.hit_at_1, m.hit_at_3, m.recall_at_5) == (0, 1, 0.5)
    assert math.isclose(m.mrr_at_5, 1 / 3, abs_tol=1e-6) and math.isclose(m.ndcg_at_5, 0.5 / (1 + 1 / math.log2(3)), abs_tol=1e-6)


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((True, 2, 1, False, False, False, 0.5, None, True, 0, False), ["EXPECTED_DOC_NOT_RETRIEVED", "SEMANTIC_MISS"]),
        ((True, 2, 1, True, False, True, 0.1, 0.2, False, 1, True), ["WRONG_TOP1", "LOW_SIMILARITY", "KEYWORD_MISS", "FILTER_FAILURE", "DUPLICATE_RESULT", "STALE_DOCUMENT_SELECTED"]),
        ((False, 1, 0, False, False, False, 0.09, None, True, 0, False), ["NO_ANSWER_FAILURE"]),
        ((False, 0, 0, False, False, False, 0.0, None, True, 0, False), []),
        ((True, 0, 1, False, False, False, 0.0, None, True, 0, False), ["EXPECTED_DOC_NOT_RETRIEVED"]),
    ],
)
def test_failures(spark, row, want):
    names = ("answerable", "n_results", "n_expected", "any_expected", "top1_expected", "top5_expected", "max_score", "keyword_rate", "filter_ok", "duplicates", "stale")
    df = spark.createDataFrame([row], "answerable boolean, n_results int, n_expected int, any_expected boolean, top1_expected boolean, top5_expected boolean, max_score double, keyword_rate double, filter_ok boolean, duplicates int, stale boolean")
    assert df.select(ev.failures({n: F.col(n) for n in names}).alias("f")).first().f == want


def test_promotion(spark):
    kind = "recall_at_5 double, mrr_at_5 double, wrong_top1 int"
    best = spark.createDataFrame([(0.5, 0.5, 11)], kind)
    good = spark.createDataFrame([(0.6, 0.5, 11)], kind)
    bad = spark.createDataFrame([(0.6, 0.5, 12)], kind)
    assert ev.promotion(good, best).first().promote
    assert ev.promotion(bad, best).first().regressions == ["wrong_top1_increased"]
    assert ev.promotion(best, best).first().regressions == ["no_quality_gain"]
    assert ev.promotion(good, best.where("false")).first().promote


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 12)], "g string, v double")
    assert df.agg(ev.nearest_rank("v", 0.95).alias("p")).first().p == 11.0
    assert ev.floor_rank(df, "g", "v", 0.95, "p").first().p == 10.0
    many = spark.createDataFrame([(g, float((i * 7919) % 1009 // 3)) for g in "ab" for i in range(1009)], "g string, v double")
    for p in (0.0, 0.005, 0.5, 0.95, 0.999, 1.0):
        want = sorted((i * 7919) % 1009 // 3 for i in range(1009))[int(p * 1008)]
        assert {r.p for r in ev.floor_rank(many, "g", "v", p, "p").collect()} == {float(want)}


def test_filters(spark):
    cats, tags = fl.infer(F.array(F.lit("overlay")), F.array(F.lit("Docs")), F.array().cast("array<string>"))
    row = spark.range(1).select(cats.alias("c"), tags.alias("t")).first()
    assert row.c == ["Docs", "Bugs", "Architecture", "AI Pipeline", "Frontend", "Project"] and "overlay" in row.t
    pairs = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B")], "query_id int, cat string")
    got = fl.candidates(pairs, F.lit(False), F.lit(False), (F.col("query_id") == 1) & (F.col("cat") == "A"), F.lit(True)).collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (2, "A"), (2, "B")]
    assert fl.candidates(pairs, F.lit(True), F.lit(False), F.lit(True), F.lit(True)).count() == 0
    b = spark.range(1).select(fl.boost(F.lit(True), F.lit(True), F.lit(True), F.lit(None).cast("boolean")).alias("b")).first().b
    assert math.isclose(b, 1.38)

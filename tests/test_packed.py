"""The packed index: tokens, vectors and first rows against the plain expressions and plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlight.functions.text import fnv1a, index_tokens
from tarnlight.operators import index as ix
from tarnlight.operators import packed as pk
from tarnlight.operators import vectors as vx


def asked_of(spark, texts):
    return ix.asked_terms(spark.createDataFrame(list(enumerate(texts)), "q int, text string"), "q", F.col("text"))


def texts_of(n):
    return [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 2 + i % 7))) for i in range(n)]


def test_tokens(spark):
    """Every letter of the first plane, between others, and odd texts: as the expression cuts them."""
    texts = [f"ab{chr(c)}cd The{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [None, "", " x ", "어떻게 한글을 AB1 ab1", "t" * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", index_tokens(F.col("t")).alias("w")).collect()
    want = {r.i: r.w for r in rows}
    row, flat = pk.tokenized(pa.array(texts, pa.string()))
    got = {i: [] for i in range(len(texts))}
    for i, w in zip(row.tolist(), flat.to_pylist()):
        got[i].append(w)
    assert got == want
    words = ["ab", "한글", "a" * 63, "b" * 64, "c" * 65, "z" * 3000]
    own = spark.createDataFrame(list(enumerate(words)), "i int, t string").select("i", fnv1a(F.col("t")).alias("h")).orderBy("i").collect()
    assert pk.fnv(pa.array(words)).tolist() == [r.h for r in own]


def test_rounding(spark):
    """Halves of the decimal form go up, as Spark rounds."""
    x = [1 / 128, 1 / 64, 0.1234565, 0.0000005, 0.9999995, 2 / 3, 1.0, 0.0, 123456.7890125, *np.random.default_rng(1).random(2000).round(7).tolist()]
    want = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("r")).collect()]
    assert (pk.half_up(np.array(x), 6) / 1e6).tolist() == want


def test_rows_of_one_key(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "beta"), (None, "alpha"), (None, "alpha")], "doc_id int, text string")
    index = ix.build(docs, "doc_id", F.col("text"))
    assert sorted((r.doc_id or 0, r.term, r.tf) for r in index.postings.collect()) == [(0, "alpha", 2), (1, "alpha", 1), (1, "beta", 2), (1, "gamma", 1), (2, "beta", 1)]
    assert {r.term: r.df for r in index.terms.collect()} == {"alpha": 2, "beta": 2, "gamma": 1}
    assert index.vectors.count() == 3 and tuple(index.stats.first()) == (5, 1.4)


@pytest.mark.parametrize("rows", [5, 4096])
def test_first_rows(spark, monkeypatch, rows):
    """Only a few rows a query leave a task, ties to the smaller key, and they hold the first ones of all."""
    monkeypatch.setattr(pk, "TILE_ROWS", rows)
    monkeypatch.setattr(pk, "CELLS", 2 * rows)
    docs = spark.createDataFrame([*texts_of(80), *[(200 + i, "w1 w2 w3") for i in range(40)]], "doc_id int, text string").coalesce(2)
    index = ix.build(docs, "doc_id", F.col("text"))
    asked = asked_of(spark, ["w1 w2 w3", "w5 w5 w9", "none", "w11"])
    first = lambda rows, k: {q: sorted((-round(s, 6), i) for p, i, s in rows if p == q)[:k] for q in range(4)}
    of = lambda df: [(r.query_id, r.doc_id, r.score) for r in df.collect()]
    every, some = of(ix.lexical(index, asked)), of(ix.lexical(index, asked, most=3))
    assert first(every, 3) == first(some, 3) and len(some) <= 3 * 4 * 2 < len(every)
    every, some = of(ix.cosine(index, asked)), of(ix.cosine(index, asked, 3))
    assert first(every, 3) == first(some, 3) and len(some) <= 3 * 4 * 2 < len(every)
    cos = {(q, i): s for q, i, s in every}
    shares = {(r.query_id, r.doc_id): r.overlap for r in ix.overlap(index, asked, 0.0001).collect()}
    mixed = [(q, i, 0.75 * s + 0.25 * round(shares.get((q, i), 0), 6)) for (q, i), s in cos.items() if (q, i) in shares or s >= 0.55]
    some = [(r.query_id, r.doc_id, 0.75 * r.vector_score + 0.25 * r.overlap) for r in ix.blended(index, asked, 3).collect()]
    assert first(mixed, 3) == first(some, 3) and len(some) <= 3 * 4 * 2


def test_carried_boost(spark):
    docs = spark.createDataFrame([(i, t, "a" if i % 3 else "b") for i, t in texts_of(40)], "doc_id int, text string, source string")
    index = ix.build(docs, "doc_id", F.col("text"), carry=("source",))
    asked = asked_of(spark, ["w1 w4"])
    plain = {r.doc_id: r.score for r in ix.lexical(index, asked).collect()}
    lifted = {r.doc_id: r.score for r in ix.lexical(index, asked, boost=F.when(F.col("source") == "b", 2.0).otherwise(1.0)).collect()}
    assert lifted == {i: s * (1 if i % 3 else 2) for i, s in plain.items()}


@pytest.mark.parametrize("cells", [7, 1 << 21])
def test_vectors_in_tiles(spark, monkeypatch, cells):
    """Products of a bounded number of pairs at once; many equal vectors do not leave a task."""
    monkeypatch.setattr(vx, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)]
    v = spark.createDataFrame(rows, "k int, e array<double>").coalesce(2)
    q = v.where("k % 20 = 0").select(F.col("k").alias("query_id"), "e")
    want = {(a, b): float(np.round(np.dot(x, y), 6)) for a, x in rows if a % 20 == 0 for b, y in rows if a != b}
    few = vx.scores(v, q, "k", "e", 4).collect()
    assert len(few) <= 5 * 4 * spark.sparkContext.defaultParallelism
    for a in {a for a, _ in want}:
        assert sorted((-r.score, r.k) for r in few if r.query_id == a)[:4] == sorted((-s, b) for (p, b), s in want.items() if p == a)[:4]
    got = {r.query_id: (r.n, r.best) for r in vx.matches(v, q, "k", "e", 0.5).collect()}
    high = {a: [s for (p, _), s in want.items() if p == a and s >= 0.5] for a in {a for a, _ in want}}
    assert got == {a: (len(s), max(s)) for a, s in high.items() if s}

"""Ingest, chunking, gate, search, graph, quality and streaming."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnlight.operators import answer as an
from tarnlight.operators import chunking as ch
from tarnlight.operators import docsearch as ds
from tarnlight.operators import gate
from tarnlight.operators import graph as gr
from tarnlight.operators import quality as ql
from tarnlight.plans.corpus import chunk_ids, legacy_chunk_ids
from tarnlight.sources import corpus, sinks
from tarnlight.streaming import ingest

NOTE = """﻿
---
title: "'Runtime'"
category: Architecture
tags: [a, 'b']
relations:
  - related:Other
  - bad
status: verified
supersededBy: null
---
# Top
intro

## Part | one
text **bold** [x](y.md)

```python
## not a heading
```
| a | b |
| - | - |
## Part | one
short
"""


def test_ingest(spark, tmp_path):
    (tmp_path / "Runtime.md").write_text(NOTE, encoding="utf-8")
    (tmp_path / "Old.md").write_text("---\ntitle: Old\nstatus: Archived\n---\nbody", encoding="utf-8")
    (tmp_path / "Broken.md").write_text("no frontmatter", encoding="utf-8")
    docs = {r.slug: r for r in corpus.parse(corpus.scan(spark, str(tmp_path))).collect()}
    assert docs["Broken"].parse_error and docs["Runtime"].title == "Runtime" and docs["Runtime"].tags == ["a", "b"]
    assert docs["Runtime"].relations == ["related:Other", "bad"] and docs["Runtime"].supersededBy is None and docs["Runtime"].order == 3
    assert [r.slug for r in corpus.load(spark, str(tmp_path)).collect()] == ["Runtime"]


def body_frame(spark):
    return spark.createDataFrame([("n", NOTE.split("---\n", 2)[2])], "slug string, body string")


def test_units_and_headings(spark):
    rows = ch.units(body_frame(spark), "slug", F.col("body")).orderBy("unit").collect()
    assert [(r.kind, r.heading_path) for r in rows] == [("prose", "Top"), ("prose", "Top > Part | one"), ("code", "Top > Part | one"), ("table", "Top > Part | one"), ("prose", "Top > Part | one")]
    assert [r.section for r in rows] == [None, 1, 1, 1, 2]
    assert rows[2].text == "## not a heading"
    heads = ch.headings(spark.createDataFrame([("n", "## A\n## A\n## A-2\n### A")], "slug string, body string"), "slug", F.col("body")).orderBy("n").collect()
    assert [h.heading_id for h in heads] == ["a", "a-2", "a-2-2", "a-3"]


def test_structured_chunks(spark):
    rows = ch.structured_chunks(body_frame(spark), "slug", contextual=True).orderBy("chunk_order").collect()
    assert [r.chunk_order for r in rows] == list(range(len(rows)))
    assert {r.chunk_type for r in rows} >= {"code", "table"}
    assert all(r.text.startswith("문서: n\n분류: Unknown\n섹션: ") for r in rows) and len({r.chunk_id for r in rows}) == len(rows)


def test_legacy_chunks(spark):
    text = "intro words\n# One\n" + "word " * 400 + "\n| a | b |\nafter\n```json\n{\"k\": 1}\n```\n"
    rows = ch.legacy_chunks(spark.createDataFrame([("d", text)], "slug string, body string"), "slug", F.col("body")).orderBy("chunk_order").collect()
    assert rows[0].section == ch.OVERVIEW and all(len(r.text) <= 1100 for r in rows)
    assert any(r.text == "| a | b |" for r in rows) and "JSON Payload Keys: k" in rows[-1].text


def test_chunk_ids_cover_every_line(spark, tmp_path):
    docs = {1: "one\ntwo\r\n\nvier Wörter", 2: "", 3: "가나다"}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in docs.items():
        for pos, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            h = 2166136261
            for c in f"s:{line}":
                h = (h ^ ord(c)) * 16777619 % 2**32
            want.append((doc, pos, hashlib.sha1(line.encode()).hexdigest()[:16], f"{doc}#{h:x}"))
    assert sorted((r.doc_id, r.pos, r.content_hash) for r in chunk_ids(spark, str(tmp_path)).collect()) == [w[:3] for w in want]
    assert sorted(tuple(r) for r in legacy_chunk_ids(spark, str(tmp_path)).collect()) == [(w[0], w[1], w[3]) for w in want]


def test_fence_summary():
    assert ch.fence_summary('{"a": 1, "b": 2}', "json") == "[JSON Payload Keys: a, b]"
    assert ch.fence_summary('"a": 1, "a": 2', "json") == "[JSON Payload Keys: a]"
    assert ch.fence_summary("npm test\nnpm run dev", "bash") == "[Commands: npm test, npm run dev]"
    assert ch.fence_summary("abc long_name x", "py") == "[Code Keywords: long_name]"


@pytest.mark.parametrize("text", ["", "short", "word " * 700, "x" * 3000])
def test_cut_text(text):
    parts = ch.cut_text(text, 1400, 560)
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(len(p) <= 1400 for p in parts)


def gate_row(spark, question, evidence):
    df = spark.createDataFrame([(question, evidence)], "q string, e string")
    yes, why = gate.support(F.col("q"), F.lower("e"), F.col("e") == "")
    return tuple(df.select(yes, why).first())


@pytest.mark.parametrize(
    ("question", "evidence", "want"),
    [
        ("전력 사용량은 몇 와트인가요", "", (False, "no_chunks")),
        ("회사 보험 조건은", "시스템 설명", (False, "high_stakes_token_missing")),
        ("정확도는 몇 퍼센트", "모델 설명", (False, "metric_family_missing:accuracy_pct")),
        ("정확도는 몇 퍼센트", "정확도 데이터는 없음", (False, "metric_denied_in_chunks")),
        ("정확도는 몇 퍼센트", "정확도를 설명한다", (False, "numeric_no_number_near_family")),
        ("정확도는 몇 퍼센트", "정확도는 91.2 퍼센트", (True, "metric_evidence_present")),
        ("실제 적용됐나요", "검증 완료", (True, "status_evidence_present")),
        ("overlay frame buffer", "unrelated text", (False, "key_tokens_missing_from_chunks")),
        ("overlay", "anything", (True, "non_status_with_context")),
    ],
)
def test_support(spark, question, evidence, want):
    assert gate_row(spark, question, evidence) == want


def relevance_of(spark, question, hits, expanded=None):
    h = spark.createDataFrame([(1, i + 1, *x) for i, x in enumerate(hits)], "query_id int, rank int, score double, vector_score double, matched_by array<string>, slug string, text string")
    q = spark.createDataFrame([(1, question, expanded or question)], "query_id int, q string, x string")
    s = gate.signals(q, gate.hit_signals(h, F.col("text"), F.col("slug"), "slug"), F.col("q"), F.col("x"))
    return tuple(s.select(*gate.relevance()).first())


def test_relevance(spark):
    both = ["bm25", "vector", "rrf"]
    assert relevance_of(spark, "overlay buffer delay", []) == (False, "empty")
    assert relevance_of(spark, "frameId", [(0.03, 0.1, both, "s", "uses frameId here")]) == (True, "exact_symbol")
    assert relevance_of(spark, "overlay buffer delay", [(0.03, 0.1, both, "s", "the overlay buffer")]) == (True, "lexical_content_tokens")
    assert relevance_of(spark, "banana", [(0.03, 0.1, both, "s", "mqtt topic")], "banana MQTT topic") == (False, "expansion_only_no_original")
    assert relevance_of(spark, "banana", [(0.03, 0.1, both, "s", "nothing")]) == (False, "lexical_generic_only")
    assert relevance_of(spark, "banana", [(0.2, 0.5, ["vector"], "s", "nothing")]) == (False, "strong_vector_zero_original")


def test_expand_and_mode(spark):
    df = spark.createDataFrame([("tensorrt 결과",), ("hello",)], "q string").select(an.expand(F.col("q")).alias("x"), an.mode(F.col("q")).alias("m"))
    first, second = df.collect()
    assert first.x.startswith("tensorrt 결과 TensorRT engine") and first.m == "evidence_template"
    assert (second.x, second.m) == ("hello", "general")


def test_context_and_pack(spark):
    hits = spark.createDataFrame([(1, i, "ab"[i % 3 == 0], 2000) for i in range(1, 8)], "query_id int, rank int, doc string, chars int")
    assert an.context(hits, "doc", 6).count() == 4
    assert [r.rank for r in an.pack(hits, F.col("chars"), [F.col("rank")]).orderBy("rank").collect()] == [1, 2]


def test_docsearch(spark):
    docs = spark.createDataFrame([("a", "Overlay sync", "frameId buffer"), ("b", "Other", "overlay once"), ("c", "None", "zzz")], "slug string, title string, text string")
    fields = ds.search_fields(docs, title=F.col("title"), display=F.col("title"), slug=F.col("slug"), body=F.col("text"))
    q = ds.parsed_queries(spark.createDataFrame([(1, "overlay sync"), (2, "")], "query_id int, q string"), F.col("q"))
    hits = ds.search(fields, q, "slug", [F.desc("score"), F.col("slug")], include_weak=True).orderBy("rank").collect()
    assert [h.slug for h in hits] == ["a", "b"] and not hits[0].weak and hits[1].weak and "제목 일치" in hits[0].reasons
    # equal phrase 120, compact title 90, all in title 55, two tokens 18 each, full cover 35
    assert hits[0].score == 120 + 90 + 55 + 36 + 35


def test_snippet(spark):
    text = "x" * 100 + " needle " + "y" * 300
    got = spark.createDataFrame([(text,)], "t string").select(ds.snippet(F.col("t"), F.array(F.lit("needle")), F.lit("p"), F.col("t")).alias("s")).first().s
    assert got.startswith("…") and got.endswith("…") and "needle" in got


def test_graph(spark):
    docs = spark.createDataFrame([("a", ["related:b", "related:b", "supports:a", "oops", "implements:z", "related:p"])], "slug string, relations array<string>")
    edges = gr.relation_edges(docs, "slug", "relations")
    slugs = spark.createDataFrame([("a", True), ("b", True), ("p", False)], "slug string, public boolean")
    assert {r.pos: r.problem for r in gr.audit_edges(edges, slugs).collect()} == {1: "duplicate", 2: "self", 3: "malformed", 4: "missing_target", 5: "not_public"}
    assert {r.dst: r.n_links for r in gr.backlinks(edges.where("dst IS NOT NULL")).collect()}["b"] == 2


def test_quality(spark):
    df = spark.createDataFrame([("plan", "verified", "production", None, "Bad Name", None), ("plan", "superseded", "production", None, None, None)], "type string, status string, evidenceLevel string, verifiedAt string, canonicalFor string, supersededBy string")
    rows = df.select(ql.violations({c: F.col(c) for c in df.columns}).alias("v")).collect()
    assert [r.v for r in rows] == [["verifiedAt", "canonicalFor"], ["supersededBy"]]
    old = spark.createDataFrame([("h", "t", 1, 0), ("h", "t", 2, 1)], "chunk_hash string, text string, embedding int, pos int")
    new = spark.createDataFrame([("h", "t"), ("h", "u"), ("k", "t")], "chunk_hash string, text string")
    got = {(r.chunk_hash, r.text): (r.reused, r.embedding) for r in ql.merge_incremental(old, new).collect()}
    assert got == {("h", "t"): (True, 2), ("h", "u"): (False, None), ("k", "t"): (False, None)}
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string")
    digest = lambda d: ql.corpus_digest(d, "k", F.col("v")).first()[0]
    assert digest(a) == digest(a.orderBy(F.desc("k"))) != digest(a.withColumn("v", F.lit("1")))


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d")], "doc_id bigint, text string").write.parquet(src)
    for turn in range(2):
        stream = ingest.chunk_rows(ingest.read_stream(spark, src, "doc_id bigint, text string"))
        ingest.ingest(stream, out, str(tmp_path / f"ck{turn}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "see [x](./Y.md)")], "chunk_schema_version string, n int, body string")
    sinks.write_index(df, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 1
    assert df.select(sinks.note_links(F.col("body")).alias("b")).first().b == "see [[Y]]"
    assert not sinks.publish(df, str(tmp_path / "op"), "v", False) and sinks.publish(df, str(tmp_path / "op"), "v", True)
    assert sinks.markdown_table(df.select("n")) == "| n |\n| --- |\n| 1 |"
    assert isinstance(df.toPandas(), pd.DataFrame)

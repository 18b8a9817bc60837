"""The public search, answers, Markdown, audits, and what is written."""

import json

import pytest
from pyspark.sql import functions as F

from tarnlight.functions.text import content_hash, is_excerpt_again, newest_dated, searchable
from tarnlight.operators import answer as an
from tarnlight.operators import evaluation as ev
from tarnlight.operators import filters as fl
from tarnlight.operators import index as ix
from tarnlight.operators import markdown as md
from tarnlight.operators import quality as ql
from tarnlight.operators import search as se
from tarnlight.sources import corpus, sinks, workspace

CHUNKS = [
    ("c1", "d1", "Overlay", "overlay frame buffer sync", "Bugs", ["overlay"]),
    ("c2", "d1", "Overlay", "overlay frame buffer again", "Bugs", []),
    ("c3", "d1", "Overlay", "overlay frame buffer third", "Bugs", []),
    ("c4", "d2", "Broker", "mqtt topic payload for the overlay", "Backend", ["mqtt"]),
    ("c5", "d3", "Other", "nothing to see", "Project", []),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, doc string, title string, text string, category string, tags array<string>").cache()


@pytest.fixture(scope="module")
def index(chunks):
    return ix.build(chunks, "id", F.col("text"))


def found(index, chunks, question, config=se.PRODUCTION, allowed=None):
    q = chunks.sparkSession.createDataFrame([(1, question)], "query_id int, question string")
    return se.search(index, chunks, q, config, "doc", allowed).orderBy("rank").collect()


def test_modes(spark, index, chunks):
    assert se.configured() == se.PRODUCTION and se.configured("hybrid", most=1).lexical_top == 30
    assert se.configured("hybrid-raw").most is None and se.configured("hybrid-raw").mode == "hybrid"
    rows = found(index, chunks, "overlay frame buffer")
    assert [r.rank for r in rows] == [1, 2, 3] and [r.document for r in rows].count("d1") == 2 and rows[-1].document == "d2"
    assert rows[0].matched_by == ["bm25", "vector", "rrf"] and rows[0].reason == "bm25:rank=1; vector:rank=1"
    assert len(found(index, chunks, "overlay frame buffer", se.configured("hybrid-raw"))) == 4
    lexical = found(index, chunks, "overlay frame buffer", se.configured("lexical"))
    assert {r.id for r in lexical} == {"c1", "c2", "c3", "c4"} and lexical[0].matched_by == ["bm25"] and lexical[0].vector_score == 0
    vector = found(index, chunks, "overlay", se.configured("baseline", limit=2))
    assert len(vector) == 2 and vector[0].lexical_score == 0 and all(r.score >= 0.03 for r in vector)
    assert found(index, chunks, "zebra") == []
    with pytest.raises(ValueError, match="no such mode"):
        found(index, chunks, "x", se.SearchConfig(mode="none"))


def test_candidates(spark, index, chunks):
    q = spark.createDataFrame([(1, ["mqtt"]), (2, ["zebra"])], "query_id int, tokens array<string>")
    got = se.candidates(chunks, q, "id", F.col("tokens")).collect()
    one = {r.id: round(r.boost, 2) for r in got if r.query_id == 1}
    assert one == {"c1": 1.18, "c2": 1.18, "c3": 1.18, "c4": 1.34} and {r.id for r in got if r.query_id == 2} == {c[0] for c in CHUNKS}
    allowed = spark.createDataFrame([(1, "c4", 1.5)], "query_id int, id string, boost double")
    assert [r.id for r in found(index, chunks, "overlay", se.PRODUCTION, allowed)] == ["c4"]


def test_projections(spark):
    df = spark.createDataFrame([("s", "Title", ["a", ""], "uses RTSP and run.py --fast", "")], "slug string, title string, tags array<string>, text string, summary string")
    row = df.select(se.search_text(df).alias("s"), se.exact_terms(df).alias("e"), se.lexical_text(df).alias("l")).first()
    assert row.s == "Title s a uses RTSP and run.py --fast" and row.e == "s Title a RTSP run.py --fast" and row.l == " ".join([row.e] * 3 + [row.s])


def test_collated_and_previews(spark, index, chunks):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "가", 1.0), (1, "z", 2.0)], "query_id int, title string, score double")
    assert [r.title for r in se.collated(df, 3, "title", locale="ko").orderBy("rank").collect()] == ["z", "가", "b"]
    q = spark.createDataFrame([(1, "overlay")], "query_id int, question string")
    assert se.previews(se.search(index, chunks, q, document="doc"), chunks, "id", ["title"], 1).collect()[0].title == "Overlay"


def test_answers(spark, index, chunks):
    said = [(1, "overlay frame buffer"), (2, " "), (3, "banana zebra"), (4, "overlay 정확도는 몇 퍼센트 frame"), (5, None)]
    q = spark.createDataFrame(said, "query_id int, question string")
    rows = {r.query_id: r for r in an.answer_questions(index, chunks, q, document="doc", slug="doc").collect()}
    assert rows[1].status == "answered" and rows[1].sources[0] == "d1" and "### 참고 문서" in rows[1].answer and rows[1].fallback
    assert (rows[2].status, rows[2].reason, rows[2].answer) == ("insufficient_context", "empty_question", an.NO_QUESTION) and rows[5].reason == "empty_question"
    assert not rows[3].relevant and rows[3].sources == [] and rows[3].answer == an.NOT_FOUND
    assert rows[4].relevant and not rows[4].supported and rows[4].answer == an.NOT_SUPPORTED and rows[4].sources
    provider = lambda a: an.mock_provider(a).withColumn("answer", F.when(F.col("query_id") == 1, F.col("answer")).otherwise(" "))
    q = spark.createDataFrame([(1, "overlay frame buffer"), (6, "mqtt topic payload")], "query_id int, question string")
    given = {r.query_id: r for r in an.answer_questions(index, chunks, q, document="doc", slug="doc", provider=provider).collect()}
    assert given[1].answer.startswith('[Mock answer to "overlay frame buffer"] Overlay') and not given[1].fallback and given[6].fallback
    wanted = spark.createDataFrame([(1, "A", True), (2, "A", True), (3, "B", False)], "query_id int, group string, answerable boolean")
    answers = spark.createDataFrame([(1, "answered"), (3, "insufficient_context")], "query_id int, status string")
    assert {r.group: (r.n, r.passed) for r in ev.gate_report(answers, wanted).collect()} == {"A": (2, 1), "B": (1, 1)}


@pytest.mark.parametrize("mode", [*an.TEMPLATES, None, "unknown"])
def test_templates(spark, mode):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    said = "시스템의 동작을 설명하는 문장입니다. BUILD SUCCESSFUL 로그 문장입니다. short. file:///x/y <br/> 두번째 설명하는 긴 문장입니다."
    df = spark.createDataFrame([(1, 1, "T", "Formal", "s", said), (1, 2, "T", "T", "s", "before\n" + table), (1, 3, "T", "Formal", "s", "")], "query_id int, pick int, title string, formal string, slug string, text string")
    out = an.template_answer(df, F.col("text"), F.col("title"), F.col("slug"), F.lit(mode), F.col("formal")).first().answer
    assert "시스템의 동작을 설명하는 문장입니다." in out and "BUILD" not in out and "file:" not in out and "before" not in out
    if mode != "troubleshooting_mode":
        assert out.count("- [T](./s.md) · 정식 제목: Formal") == 1 and "- [T](./s.md)\n" in out + "\n"
    assert (table in out) == (mode not in ("portfolio_mode", "troubleshooting_mode"))
    none = an.template_answer(df.where("pick = 3"), F.col("text"), F.col("title"), F.col("slug"), F.lit(mode)).first().answer
    assert an.NOTHING_SAID in none and ("standard pipeline" in none) == (mode == "flow_mode")


def test_context_text(spark):
    df = spark.createDataFrame([(1, 1, "d1", "T", "x" * 30, 2), (1, 2, "d2", "U", "y" * 30, 1), (1, 3, "d1", "V", "z", 2), (1, 4, "d1", "W", "w", 2)], "query_id int, rank int, doc string, title string, text string, place int")
    picked = an.context(df, "doc", 6, 2, [F.col("place")])
    assert [r.title for r in picked.orderBy("pick").collect()] == ["U", "T", "V"]
    assert an.context_text(picked, budget=60).first().context == "Title: U\n\n" + "y" * 30
    assert an.context_text(picked).first().context.count("\n\n---\n\n") == 2


BODY = """# Head
one
two  
three\\
four
- a
* b
> q
>r
```py
# no heading
| no | table |
```
| x | y\\|z |
|:---|---:|
| 1 | 2 |
| broken |
text
```
open"""


def test_blocks(spark):
    rows = md.blocks(spark.createDataFrame([(1, BODY), (2, None), (3, "| a |\n| :---: |\n| b |")], "k int, t string"), "k", F.col("t")).orderBy("k", "block").collect()
    one = [(r.kind, r.level, r.language, r.text, r["items"]) for r in rows if r.k == 1]
    assert one[0] == ("heading", 1, None, "Head", None) and one[1] == ("paragraph", None, None, "one two\nthree\nfour", None)
    assert one[2][4] == ["a", "b"] and one[3][4] == ["q", "r"] and one[4][:4] == ("code", None, "py", "# no heading\n| no | table |")
    assert one[5][0] == "code" and one[5][2] == "text" and one[5][3].endswith("| broken |") and one[6][3] == "text" and one[7][3] == "open"
    table = next(r for r in rows if r.k == 3)
    assert (table.kind, table.rows, table.alignments) == ("table", [["a"], ["b"]], ["center"])
    cells = spark.createDataFrame([("| x | y\\|z |",), ("| a \\|",), ("no",)], "l string").select(md.table_row(F.col("l")).alias("c")).collect()
    assert [r.c for r in cells] == [["x", "y|z"], None, None]


def test_links(spark):
    hrefs = {"A.md": "#/A", "./A b.md": None, "A.md#s (1)": None, "./한글.md#절": "#/%ED%95%9C%EA%B8%80/%EC%A0%88", "../A.md": None, "http://x/A.md": None, "A.txt": None, "a(b)!.md": "#/a(b)!"}
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", md.resolve_href(F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in got} == hrefs
    routes = {"#/__search__": ("search", "", None), "#/__rag": ("rag", "", None), "#/A%20b/c%2Fd": ("doc", "A b", "c/d"), "": ("doc", "", None), "#/A/": ("doc", "A", None), "#/%zz": ("doc", "%zz", None)}
    got = spark.createDataFrame([(h,) for h in routes], "h string").select("h", md.parse_route(F.col("h")).alias("r")).collect()
    assert {r.h: tuple(r.r) for r in got} == routes
    tokens = spark.createDataFrame([("a `b` **c** [d](E.md#f) [g](http://h) i",)], "t string").select(md.inline_tokens(F.col("t")).alias("x")).first().x
    assert [tuple(t) for t in tokens] == [("text", "a ", None), ("code", "b", None), ("text", " ", None), ("strong", "c", None), ("text", " ", None), ("wiki-link", "d", "#/E/f"), ("text", " [g](http://h) i", None)]
    row = spark.range(1).select(md.is_title_again(F.lit("“The  Title”!"), F.lit("x"), F.lit("the title")).alias("a"), md.is_title_again(F.lit("!"), F.lit("!")).alias("b")).first()
    assert row.a and not row.b


def test_text_helpers(spark):
    row = spark.range(1).select(
        searchable(F.lit("# A\n```py\nx = 1\n```\n> b | c")).alias("s"),
        is_excerpt_again(F.lit("# Head\nSome text here"), F.lit("Head Some te…")).alias("again"),
        is_excerpt_again(F.lit("Some text"), F.lit("Other")).alias("other"),
        is_excerpt_again(F.lit("Some text"), F.lit("")).alias("none"),
        newest_dated(F.array(F.lit("2026-01-02-a"), F.lit("b"), F.lit("2026-03-01-c"), F.lit("2026-03-01-d"))).alias("new"),
        newest_dated(F.array(F.lit("b"))).alias("undated"),
        (content_hash(F.lit(None).cast("string")) == content_hash(F.lit(""))).alias("same"),
    ).first()
    assert (row.s, row.again, row.other, row.none, row.new, row.undated, row.same) == ("A py x = 1 b c", True, False, False, "2026-03-01-c", None, False)


def test_evaluation_helpers(spark):
    rows = spark.createDataFrame([("A", True, 1, 0.5), ("A", None, 20, None), ("B", False, 2, 1.0)], "g string, ok boolean, rank int, v double")
    assert {r.g: (r.n, r.passed, r.share) for r in ev.passed(rows, "g", F.col("ok")).collect()} == {"A": (2, 1, 0.5), "B": (1, 0, 0.0)}
    one = rows.agg(ev.mean_of(F.col("v")).alias("m"), ev.mean_of(F.col("v"), F.col("g") == "A").alias("a"), ev.reciprocal_mean(F.col("rank")).alias("r")).first()
    assert tuple(one) == (0.5, 0.25, 0.5)
    assert [ev_row.x for ev_row in spark.createDataFrame([(False, True), (True, False), (True, True), (False, False)], "a boolean, b boolean").select(ev.outcome(F.col("a"), F.col("b")).alias("x")).collect()] == ["improved", "regressed", "kept", "missed"]
    base = spark.createDataFrame([("r", 2.0, 0.0)], "run string, a double, b double")
    got = {r.metric: (r.absolute, r.relative) for r in ev.deltas(spark.createDataFrame([("r", 3.0, 1.0)], "run string, a double, b double"), base, ("a", "b"), ["run"]).collect()}
    assert got == {"a": (1.0, 0.5), "b": (1.0, None)}
    best = ev.best_covered(spark.createDataFrame([(1, "x", 0.5, 1), (1, "y", 0.9, 2), (1, "z", 0.9, 3)], "q int, id string, c double, o int"), "q", F.col("c"), F.col("o"), "id").first()
    assert (best.id, best.coverage) == ("y", 0.9)
    assert ev.spread(rows, "v").first().asDict() == {"n": 2, "min": 0.5, "max": 1.0, "mean": 0.75, "p50": 0.5, "p95": 1.0}
    met = spark.createDataFrame([("Bugs", ["a"], "Bugs", "a"), ("Bugs", ["a"], "Infra", None), ("Bugs", None, None, "a"), (None, None, None, None)], "c string, t array<string>, wc string, wt string")
    assert [r.m for r in met.select(fl.filter_met(F.col("c"), F.col("t"), F.col("wc"), F.col("wt")).alias("m")).collect()] == [True, False, False, True]


def test_closed_world(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, w string")
    assert ql.closed_world(a, b.where("k = 1"), "k").collect()[0].w == "y"
    with pytest.raises(Exception, match="not on both sides: 2"):
        ql.closed_world(a, b, "k").collect()


def test_graph_and_excerpts(spark):
    lines = spark.createDataFrame([("graph TD",), ("A[One] --> B",), ("B -->|uses| C(Two)",), ("D{x}",)], "value string")
    nodes, edges = ql.graph_of(lines)
    assert {r.node for r in nodes.collect()} == set("ABCD") and {(r.src, r.label, r.dst) for r in edges.collect()} == {("A", "", "B"), ("B", "uses", "C")}
    docs = spark.createDataFrame([(1, "fine"), (2, " "), (3, "**bold**"), (4, None)], "k int, e string")
    assert {r.k: r.problem for r in ql.unlike_excerpts(docs, "k", F.col("e")).collect()} == {2: "empty", 3: "marks", 4: "empty"}


def test_typed(spark):
    raw = [
        ("a", "---\ntitle: A\ncategory: Backend\nupdatedAt: 2026-01-01\nstatus: odd\ntype: plan\nintro: hello\n---\nbody"),
        ("b", "---\ntitle: B\ncategory: Nowhere\nupdatedAt: x\n---\nbody"),
        ("c", "---\ntitle: C\n---\nbody"),
        ("d", "---\ntitle: D\ncategory: ADR\nupdatedAt: x\nstatus: archived\n---\n# Head\nthe body"),
    ]
    docs = corpus.typed(corpus.parse(spark.createDataFrame([(s, "", r) for s, r in raw], "slug string, source_path string, raw string")))
    rows = {r.slug: r for r in docs.collect()}
    assert (rows["a"].parse_error, rows["a"].status, rows["a"].type, rows["a"].excerpt) == (None, None, "plan", "hello")
    assert "Nowhere" in rows["b"].parse_error and "required" in rows["c"].parse_error and rows["d"].excerpt == "Head the body"
    assert [r.slug for r in corpus.indexable(docs).collect()] == ["a"]


def test_settings():
    text = "top: 3\nlist: [a, 'b', 1.5]\nnest:\n  deep:\n    x: true\n  y: null\nitems:\n  - one\n  - 2\n# note\nlast: \"q\" # note"
    assert corpus.parse_settings(text) == {"top": 3, "list": ["a", "b", 1.5], "nest": {"deep": {"x": True}, "y": None}, "items": ["one", 2], "last": "q"}
    assert corpus.parse_settings("") == {} and len(corpus.run_stamp()) == 16


def test_written(spark, tmp_path):
    path = str(tmp_path / "index")
    assert corpus.read_index(spark, path) is None
    first = spark.createDataFrame([("h1", "t1", "d", 0, "e1"), ("h2", "t2", "d", 1, "e2")], "chunk_hash string, text string, document_id string, pos int, embedding string")
    row = sinks.update_index(first, path, "v1").first()
    assert (row.chunk_count, row.reused, row.rebuilt) == (2, 0, 2)
    second = spark.createDataFrame([("h1", "t1", "d", 0), ("h3", "t3", "e", 1)], "chunk_hash string, text string, document_id string, pos int")
    row = sinks.update_index(second, path, "v2").first()
    assert (row.reused, row.rebuilt, row.version) == (1, 1, "v2")
    assert {r.chunk_hash: r.embedding for r in corpus.read_index(spark, f"{path}/versions/v2").collect()} == {"h1": "e1", "h3": None}
    docs = spark.createDataFrame([("b", "B", "ADR", 2, "2026"), ("a", "A", "ADR", 1, "2025")], "slug string, displayTitle string, category string, `order` int, updatedAt string")
    sinks.write_search_index(docs, str(tmp_path / "search"))
    lines = [json.loads(x) for f in sorted((tmp_path / "search/json").glob("part*")) for x in f.read_text().splitlines()]
    assert [x["slug"] for x in lines] == ["a", "b"]
    assert sinks.contents(docs).first().value == "# ADR\n\n- [[a]] A\n- [[b]] B"
    assert sinks.summary_row(docs, "now").first().asDict() == {"documents": 2, "categories": 1, "updated": "2026", "built": "now"}
    assert {r.query_id: r.question for r in sinks.golden_queries(docs).collect()}["q-a"] == "What does A say?"
    sinks.write_taxonomy(ev.count_failures(spark, spark.createDataFrame([(["WRONG_TOP1"],)], "failures array<string>")), str(tmp_path / "tax"))
    assert [r.n for r in corpus.read_leaderboard(spark, str(tmp_path / "tax")).collect()] == ["0", "1", *["0"] * 7]
    sinks.write_run(str(tmp_path / "runs"), "r1", metrics=docs.select("slug"), latency=docs.select("order"))
    assert corpus.latest_run(spark.read.parquet(str(tmp_path / "runs/metrics"))).count() == 2
    assert sinks.report("R", {"Text": "said", "Table": docs.select("slug").orderBy("slug")}).startswith("# R\n\n## Text\n\nsaid\n\n## Table\n\n| slug |")


def test_kept_tables_follow_their_source(spark, tmp_path):
    src = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(src)
    make = lambda: spark.read.parquet(src).selectExpr("id * 2 AS id")
    one, again = workspace.kept(spark, "double", src, make), workspace.kept(spark, "double", src, make)
    assert one.inputFiles() == again.inputFiles() and one.count() == 3
    spark.range(5).write.mode("overwrite").parquet(src)
    assert workspace.kept(spark, "double", src, make).count() == 5

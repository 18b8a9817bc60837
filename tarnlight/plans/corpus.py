"""Queries on filters, search, chunking, index lifecycle, graph and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import code_symbols, exact_symbols, fnv1a, heading_id, index_tokens, numeric_intent, referenced_files
from ..operators import answer as an
from ..operators import chunking as ch
from ..operators import docsearch as ds
from ..operators import evaluation as ev
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import quality as ql
from ..operators.lexical import small
from .base import FNV, query, read, tok

# Hint rules on words of the documents, in the form of the built-in ones: (tokens, sources, languages).
HINTS = (
    (("stupid", "idiot", "moron"), ("src1", "src2"), ("en",)),
    (("license", "licensed", "mit"), ("src3", "src4"), ("fr", "de")),
    (("email", "com", "password"), ("src5",), ("es",)),
)


def _hints_sql(which: int) -> str:
    parts = [f"CASE WHEN list_has_any(toks, [{', '.join(repr(t) for t in rule[0])}]) THEN [{', '.join(repr(v) for v in rule[which])}] ELSE [] END" for rule in HINTS]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


HINTED = f"hinted AS (SELECT doc_id AS query_id, {_hints_sql(1)} AS cats, {_hints_sql(2)} AS tags FROM (SELECT doc_id, {tok('text')} AS toks FROM documents))"


def hinted(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), index_tokens(F.col("text")).alias("t"))
    sort = lambda which: F.array_sort(fl.hint_values(F.col("t"), which, HINTS))
    return docs.select("query_id", sort(1).alias("cats"), sort(2).alias("tags"))


@query(f"WITH {HINTED} SELECT query_id, array_to_string(cats, ',') AS categories, array_to_string(tags, ',') AS tags FROM hinted")
def hint_inference(spark, d):
    return hinted(spark, d).select("query_id", F.array_join("cats", ",").alias("categories"), F.array_join("tags", ",").alias("tags"))



@query(f"""WITH b AS (SELECT item_id AS query_id, {_hints_sql(1)} AS cats, {_hints_sql(2)} AS tags FROM (SELECT item_id, {tok('text')} AS toks FROM benchmark)),
m AS (SELECT query_id, source, lang, len(cats) + len(tags) = 0 OR list_contains(cats, source) OR list_contains(tags, lang) AS ok FROM b, (SELECT DISTINCT source, lang FROM documents)),
f AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM m)
SELECT query_id, source, lang FROM f WHERE ok OR NOT any_ok""")
def metadata_filter_inferred_fallback(spark, d):
    """Categories and tags that a query's inferred hints admit; all of them if the hints would admit none."""
    bench = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), index_tokens(F.col("text")).alias("t"))
    q = bench.select("query_id", fl.hint_values(F.col("t"), 1, HINTS).alias("cats"), fl.hint_values(F.col("t"), 2, HINTS).alias("tags"))
    kinds = read(spark, d, "documents").select("source", "lang").distinct()
    pairs = kinds.crossJoin(small(q))
    spec, row = {"category": F.col("cats"), "tag": F.col("tags")}, {"category": F.col("source"), "tag": F.array("lang")}
    has = (F.size("cats") + F.size("tags")) > 0
    return fl.candidates(pairs, F.lit(False), F.lit(False), fl.matches_inferred(spec, row), has).select("query_id", "source", "lang")


@query("SELECT item_id AS query_id, count(*)::BIGINT AS n FROM benchmark JOIN documents ON source IN ('src' || (item_id % 20), 'src' || (item_id % 7)) AND lang IN ('en', 'de') GROUP BY 1")
def metadata_filter_explicit(spark, d):
    bench = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(*[F.concat(F.lit("src"), F.col("item_id") % m) for m in (20, 7)]).alias("cats"))
    kinds = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"))
    pairs = kinds.crossJoin(small(bench))
    spec = {"category": F.col("cats"), "tag": F.array(F.lit("EN"), F.lit("de"))}
    kept = pairs.where(fl.matches_explicit(spec, {"category": F.col("source"), "tag": F.array("lang")}))
    return kept.groupBy("query_id").agg(F.sum("c").alias("n"))


# Document search over parts as documents: name, brand and type are title, category and tags.
TERMS = ("part#1", "Brand#12 steel", "promo steel", "economy", "anodized brass", "part-77")
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[_/\\\\.+]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def searched(spark, d, limit: int = ds.LIMIT):
    parts = read(spark, d, "part")
    docs = ds.search_fields(parts.select("p_partkey", "p_name", "p_brand", "p_type"), title=F.col("p_name"), display=F.col("p_name"), slug=F.col("p_partkey").cast("string"), category=F.col("p_brand"), tags=F.col("p_type"), body=F.concat_ws(" ", "p_name", "p_type"))
    q = ds.parsed_queries(spark.createDataFrame([(i, t) for i, t in enumerate(TERMS)], "query_id int, query string"), F.col("query"))
    return ds.search(docs, q, "p_partkey", [F.desc("score"), F.col("p_partkey")], limit)


@query()
def docsearch_topk(spark, d):
    """Best hits of each search (rows only; unit tests pin every rule of the score)."""
    return searched(spark, d).select("query_id", "rank", "p_partkey", "score", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH d AS (SELECT item_id, text, lower(text) AS low FROM benchmark), p AS (SELECT *, list_min(list_filter([instr(low, 'the'), instr(low, 'and')], lambda x: x > 0)) - 1 AS p0 FROM d)
SELECT item_id, CASE WHEN p0 IS NULL THEN left(text, 160) ELSE CASE WHEN greatest(0, p0 - 40) > 0 THEN '…' ELSE '' END
 || trim(regexp_replace(substr(text, greatest(0, p0 - 40) + 1, least(length(text), p0 + 120) - greatest(0, p0 - 40)), '\\s+', ' ', 'g')) || CASE WHEN least(length(text), p0 + 120) < length(text) THEN '…' ELSE '' END END AS snippet FROM p""")
def docsearch_snippets(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", ds.snippet(F.col("text"), F.array(F.lit("the"), F.lit("and")), F.lit("the and"), F.col("text")).alias("snippet"))


LINES = "l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS x FROM documents))"


@query(f"""WITH {LINES}, k AS (SELECT *, CASE WHEN length(line) < 200 THEN 'short' ELSE 'long' END AS kind FROM l),
c AS (SELECT *, coalesce((kind <> lag(kind) OVER w)::INT, 1) AS ch FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c)
SELECT doc_id, island::BIGINT AS island, kind, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS chars FROM i GROUP BY ALL""")
def chunk_lines_islands(spark, d):
    """Runs of short and long lines of each document."""
    rows = ch.lines(read(spark, d, "documents"), "doc_id", F.col("text")).withColumn("kind", F.when(F.length("line") < 200, "short").otherwise("long"))
    out = ch.islands(rows, "doc_id", "kind").groupBy("doc_id", "island", "kind")
    return out.agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


@query("""SELECT doc_id, part::INT AS part, substr(text, part * 1400 + 1, 1400) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 1400.0)::INT))) AS part FROM documents WHERE length(text) > 0)""")
def chunk_long_text_fixed(spark, d):
    return ch.fixed_parts(read(spark, d, "documents"), "doc_id", F.col("text"), 1400)


@query()
def chunk_long_text(spark, d):
    """Prose cut behind the last blank of every 1,400 characters (sequential; checked against a plain loop in the tests)."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(ch.split_long(F.coalesce("text", F.lit("")), F.lit(1400))).alias("part", "text")).select("doc_id", "part", F.length("text").alias("chars"), F.md5("text").alias("md5"))


@query(f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_order FROM l WHERE trim(line) <> ''")
def chunk_order(spark, d):
    rows = ch.lines(read(spark, d, "documents"), "doc_id", F.col("text")).where(F.trim("line") != "").withColumnRenamed("line", "content")
    rows = rows.withColumns({"heading_path": F.lit(ch.OVERVIEW), "chunk_type": F.lit("prose"), "unit": F.col("pos"), "part": F.lit(0)})
    return ch.hashed(rows, "doc_id", False).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("chunk_order").cast("bigint").alias("chunk_order"))


@query(f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, left(sha1(line), 16) AS content_hash, left(sha1(doc_id || '|' || '{ch.OVERVIEW}' || '|prose|' || left(sha1(line), 16) || '|ctx0|{ch.SCHEMAS[1]}'), 16) AS chunk_hash FROM l")
def chunk_ids(spark, d):
    """Content and chunk hashes of every line of every document."""
    rows = ch.lines(read(spark, d, "documents"), "doc_id", F.col("text")).withColumnRenamed("line", "content")
    rows = rows.withColumns({"heading_path": F.lit(ch.OVERVIEW), "chunk_type": F.lit("prose"), "unit": F.col("pos"), "part": F.lit(0)})
    return ch.hashed(rows, "doc_id", False).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "content_hash", "chunk_hash")


@query()
def legacy_chunk_ids(spark, d):
    """Legacy ids of every line of every document (rows only: the fold over the characters of all lines is too slow in
    SQL; a unit test holds it against a plain loop)."""
    rows = ch.lines(read(spark, d, "documents"), "doc_id", F.col("text"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), ch.legacy_chunk_id(F.col("doc_id"), F.lit("s"), F.col("line")).alias("legacy_id"))


@query("""SELECT page_id, n::BIGINT AS n, h AS text, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(h)), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS base_id
FROM (SELECT page_id, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS h FROM (SELECT page_id, regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1) AS x FROM pages))""")
def heading_extract(spark, d):
    """Headings of pages and their anchors."""
    found = F.regexp_extract_all(F.col("html"), F.lit("<h[1-3][^>]*>([^<]*)</h[1-3]>"), 1)
    rows = read(spark, d, "pages").select("page_id", F.posexplode(found).alias("n", "text"))
    return rows.select("page_id", F.col("n").cast("bigint").alias("n"), "text", heading_id(F.col("text")).alias("base_id"))


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'decision|판단|결정|\\badr\\b') THEN 'decision' WHEN regexp_matches(lower(text), 'metric|지표|latency|hit@|recall|mrr|ndcg|benchmark') THEN 'metric'
 WHEN regexp_matches(lower(text), 'bug|장애|오류|fix|rollback') THEN 'bug' WHEN regexp_matches(lower(text), 'architecture|아키텍처|pipeline|흐름|data-flow') THEN 'architecture' ELSE 'prose' END AS chunk_type, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def classify_chunk_type(spark, d):
    from ..functions.text import chunk_type

    docs = read(spark, d, "documents").select(chunk_type(F.lit(""), F.col("text"), F.lit("prose")).alias("chunk_type"))
    return docs.groupBy("chunk_type").agg(F.count("*").alias("n"))


@query()
def code_symbols_of_pages(spark, d):
    """Identifiers of pages (rows only: the pattern needs look-around)."""
    return read(spark, d, "pages").select("page_id", F.array_join(code_symbols(F.col("html")), ",").alias("symbols"))


@query("SELECT page_id, array_to_string(list_slice(list_distinct_ordered, 1, 20), ',') AS files FROM (SELECT page_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(html, '([A-Za-z0-9_./-]+\\.(?:py|ts|tsx|js|mjs|java|yml|yaml|md|json|sh|bat))\\b', 1) AS x FROM pages))")
def referenced_files_of_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(referenced_files(F.col("html")), ",").alias("files"))


@query()
def exact_symbols_of_turns(spark, d):
    """Symbols users write (rows only: the patterns need look-around)."""
    rows = read(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.size(exact_symbols(F.coalesce("text", F.lit("")))).alias("n_symbols"))


@query("""WITH s AS (SELECT source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1) SELECT count(*)::BIGINT AS document_count, sum(n)::BIGINT AS chunk_count, round(sum(chars) / sum(n), 6) AS mean_chunk_chars, round(count(*) FILTER (n > 1) / count(*), 6) AS duplicate_doc_ratio FROM s""")
def index_manifest(spark, d):
    return ql.manifest(read(spark, d, "documents"), "source", F.col("text"))


@query("""WITH old AS (SELECT doc_id % 7 = 0 AS changed, doc_id, text FROM documents WHERE doc_id % 5 <> 0),
h AS (SELECT left(sha1(text || CASE WHEN changed THEN '!' ELSE '' END), 16) AS chunk_hash, text || CASE WHEN changed THEN '!' ELSE '' END AS t, doc_id FROM old),
l AS (SELECT chunk_hash, arg_max(t, doc_id) AS t FROM h GROUP BY 1)
SELECT coalesce(l.t = text, false) AS reused, count(*)::BIGINT AS n FROM documents LEFT JOIN l ON chunk_hash = left(sha1(text), 16) GROUP BY 1""")
def incremental_merge(spark, d):
    """How many chunks an earlier index, with some documents absent and some changed, lets us keep."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    was = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    hashed = lambda x: x.withColumn("chunk_hash", F.substring(F.sha1("text"), 1, 16)).withColumn("embedding", F.length("text"))
    out = ql.merge_incremental(hashed(was).withColumnRenamed("doc_id", "pos"), hashed(docs))
    return out.groupBy("reused").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def freshness_missing(spark, d):
    """Customers the orders index does not know."""
    index = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ql.missing_from_index(read(spark, d, "customer").select("c_custkey"), index, "c_custkey")


@query("""WITH s AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, bool_or(doc_id % 97 = 0) AS bad FROM documents GROUP BY 1)
SELECT source, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_chunks' END, CASE WHEN langs < 4 THEN 'document_count_below_expected' END, CASE WHEN bad THEN 'corpus_hash_mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def stale_reasons(spark, d):
    s = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.bool_or(F.col("doc_id") % 97 == 0).alias("bad"))
    row = {"exists": F.lit(True), "n_chunks": F.col("n"), "n_documents": F.col("langs"), "n_expected": F.lit(4), "n_missing": F.lit(0), "hash": F.col("bad").cast("string"), "expected_hash": F.lit("false")}
    return s.select("source", F.array_join(ql.stale_reasons(row), ",").alias("reasons"))


@query("""WITH h AS (SELECT sha256(doc_id || ':' || sha256(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b, sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS e FROM h)
SELECT sha256(n || ':' || a || ':' || b || ':' || c || ':' || e) AS corpus_hash FROM s""")
def corpus_digest(spark, d):
    """One digest of all documents."""
    return ql.corpus_digest(read(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '흐름|동작|구조|아키텍처|pipeline|파이프라인') THEN 'flow_mode' WHEN regexp_matches(lower(text), '검증|결과|테스트|pass|fail|합격|실패|근거') THEN 'evidence_template' WHEN regexp_matches(lower(text), '포트폴리오|이력서|면접|자소서|요약') THEN 'portfolio_mode' WHEN regexp_matches(lower(text), '오류|문제|해결|안 됨|원인|버그|에러') THEN 'troubleshooting_mode' ELSE 'general' END AS mode FROM conversations")
def answer_mode(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", an.mode(F.col("text")).alias("mode"))


@query()
def query_expansion(spark, d):
    """Questions with their topic terms (rows only: some topics need look-ahead)."""
    rows = read(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", (F.length(an.expand(F.col("text"))) - F.length("text")).alias("added"))


@query()
def numeric_intent_of_turns(spark, d):
    """Which turns ask for numbers (rows only, patterns are pinned by unit tests)."""
    return read(spark, d, "conversations").groupBy(numeric_intent(F.col("text")).alias("numeric")).agg(F.count("*").alias("n"))


EDGES = "e AS (SELECT page_id AS src, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS dst FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS x FROM pages))"


def edges(spark, d):
    return gr.html_links(read(spark, d, "pages"), "page_id", F.col("html"))


@query(f"WITH {EDGES} SELECT src, pos::BIGINT AS pos, dst FROM e")
def link_edges(spark, d):
    return edges(spark, d).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {EDGES} SELECT dst, count(*)::BIGINT AS n_links, count(DISTINCT src)::BIGINT AS n_sources FROM e GROUP BY 1")
def backlinks(spark, d):
    return gr.backlinks(edges(spark, d))


@query(f"WITH {EDGES} SELECT src, pos::BIGINT AS pos, dst FROM e WHERE dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def dangling_links(spark, d):
    known = read(spark, d, "pages").select(F.col("url").alias("dst")).distinct()
    return edges(spark, d).withColumn("pos", F.col("pos").cast("bigint")).join(known, "dst", "left_anti").select("src", "pos", "dst")


@query(f"WITH {EDGES}, n AS (SELECT e.*, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS k, url FROM e JOIN pages ON page_id = src) SELECT src, pos::BIGINT AS pos, CASE WHEN k > 1 THEN 'duplicate' ELSE 'self' END AS problem FROM n WHERE k > 1 OR dst = url")
def self_and_duplicate_edges(spark, d):
    own = read(spark, d, "pages").select(F.col("page_id").alias("src"), "url")
    k = F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))
    rows = edges(spark, d).withColumn("k", k).join(own, "src").where("k > 1 OR dst = url")
    return rows.select("src", F.col("pos").cast("bigint").alias("pos"), F.when(F.col("k") > 1, "duplicate").otherwise("self").alias("problem"))


@query(f"WITH {EDGES} SELECT src, count(*)::BIGINT AS n_out, string_agg(dst, ',' ORDER BY pos) AS targets FROM e GROUP BY 1")
def adjacency_lists(spark, d):
    return gr.adjacency(edges(spark, d))


AUDITED = """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'overview' WHEN 'F' THEN 'incident' ELSE o_orderstatus END AS type,
 CASE WHEN o_totalprice < 50000 THEN 'verified' WHEN o_totalprice < 100000 THEN 'superseded' ELSE 'partial' END AS status,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'production' WHEN o_orderpriority LIKE '5%' THEN 'guessed' ELSE 'unit-test' END AS level,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS verified,
 CASE WHEN o_orderkey % 5 = 0 THEN 'Not Kebab' WHEN o_orderkey % 5 = 1 THEN 'kebab-case-1' END AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN 'other' END AS replaced FROM orders"""


@query(f"""WITH r AS ({AUDITED}), v AS (SELECT o_orderkey, list_filter([CASE WHEN type NOT IN {ql.TYPES} THEN 'type' END, CASE WHEN status NOT IN {ql.STATUSES} THEN 'status' END, CASE WHEN level NOT IN {ql.EVIDENCE} THEN 'evidenceLevel' END,
 CASE WHEN status = 'verified' AND NOT coalesce(regexp_matches(verified, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'), false) THEN 'verifiedAt' END, CASE WHEN canonical IS NOT NULL AND NOT regexp_matches(canonical, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'canonicalFor' END,
 CASE WHEN status = 'superseded' AND replaced IS NULL THEN 'supersededBy' END], lambda x: x IS NOT NULL) AS found FROM r)
SELECT o_orderkey, array_to_string(found, ',') AS violations FROM v WHERE len(found) > 0""")
def metadata_audit(spark, d):
    """Records that break the metadata contract: closed sets, dates, names and what a status demands."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    record = {
        "type": F.when(F.col("o_orderstatus") == "O", "overview").when(F.col("o_orderstatus") == "F", "incident").otherwise(F.col("o_orderstatus")),
        "status": F.when(price < 50000, "verified").when(price < 100000, "superseded").otherwise("partial"),
        "evidenceLevel": F.when(priority.startswith("1"), "production").when(priority.startswith("5"), "guessed").otherwise("unit-test"),
        "verifiedAt": F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 2, F.date_format("o_orderdate", "dd.MM.yyyy")),
        "canonicalFor": F.when(k % 5 == 0, "Not Kebab").when(k % 5 == 1, "kebab-case-1"),
        "supersededBy": F.when(k % 2 == 0, "other"),
    }
    return o.select("o_orderkey", F.array_join(ql.violations(record), ",").alias("violations")).where("violations <> ''")


@query("SELECT a.c_custkey AS slug, a.c_custkey + 1 AS by, coalesce(b.c_nationkey = a.c_nationkey, false) AS reciprocal FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def supersession_reciprocity(spark, d):
    """Whether what replaces a record names it too; a neighbour of the same nation stands for the list of names."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    prev = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_nationkey").alias("was"))
    docs = c.join(prev, "c_custkey", "left").select("c_custkey", (F.col("c_custkey") + 1).alias("by"), F.when(F.col("was") == F.col("c_nationkey"), F.array(F.col("c_custkey") - 1)).otherwise(F.array().cast("array<bigint>")).alias("names"))
    return gr.reciprocal(docs, "c_custkey", "by", "names")


@query("""SELECT event_type, count(*)::BIGINT AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def latency_percentiles_nearest_rank(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), ev.nearest_rank("value", 0.5).alias("p50"), ev.nearest_rank("value", 0.95).alias("p95"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS p95 FROM r WHERE i = floor(0.95 * (n - 1))")
def latency_percentiles_floor(spark, d):
    return ev.floor_rank(read(spark, d, "events"), "event_type", "value", 0.95, "p95")


@query("SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM events GROUP BY 1")
def score_distribution(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))


RUNS = "SELECT event_type AS run, count(*) AS n, round(avg((value > 20)::INT), 6) AS recall_at_5, round(avg((value > 40)::INT), 6) AS mrr_at_5, quantile_disc(value, 0.95) AS p95_latency_ms FROM events GROUP BY 1"


def runs(spark, d):
    e = read(spark, d, "events")
    hit = lambda x: F.round(F.avg((F.col("value") > x).cast("int")), 6)
    return e.groupBy(F.col("event_type").alias("run")).agg(hit(20).alias("recall_at_5"), hit(40).alias("mrr_at_5"), ev.nearest_rank("value", 0.95).alias("p95_latency_ms"))


@query(f"""WITH r AS ({RUNS}), b AS (SELECT * FROM r WHERE run = 'click'),
g AS (SELECT r.run, round(r.recall_at_5 - b.recall_at_5, 9) AS dr, round(r.mrr_at_5 - b.mrr_at_5, 9) AS dm, r.p95_latency_ms AS p, b.p95_latency_ms AS bp FROM r, b)
SELECT run, array_to_string(list_filter([CASE WHEN NOT (dr >= 0.01 OR dm >= 0.01) THEN 'no_quality_gain' END, CASE WHEN -dr > 0.02 THEN 'recall_at_5_regressed' END, CASE WHEN -dm > 0.02 THEN 'mrr_at_5_regressed' END,
 CASE WHEN bp > 0 AND bp >= 20 AND (p - bp) / bp > 0.3 THEN 'p95_latency_increased' END], lambda x: x IS NOT NULL), ',') AS regressions FROM g""")
def promotion_decision(spark, d):
    r = runs(spark, d)
    out = ev.promotion(r, r.where("run = 'click'").drop("run"))
    return out.select("run", F.array_join("regressions", ",").alias("regressions"))


@query(f"WITH r AS ({RUNS}) SELECT run, row_number() OVER (ORDER BY recall_at_5 DESC, mrr_at_5 DESC, p95_latency_ms, run)::BIGINT AS place FROM r")
def candidate_selection(spark, d):
    """Candidates best first: recall, then MRR, then latency."""
    order = Window.orderBy(F.desc("recall_at_5"), F.desc("mrr_at_5"), "p95_latency_ms", "run")
    return runs(spark, d).select("run", F.row_number().over(order).cast("bigint").alias("place"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark, d):
    """Extension: tumbling hours; the same plan runs on a stream."""
    from ..streaming.ingest import windowed

    out = windowed(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, len(list_distinct(x))::BIGINT AS n_distinct, len(x)::BIGINT AS n FROM (SELECT doc_id, " + tok("text") + " AS x FROM documents)")
def distinct_tokens(spark, d):
    t = index_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.size(t).cast("bigint").alias("n"))


@query("SELECT n_name AS slug, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) AS anchor, " + FNV.format("n_name") + "::BIGINT AS hash FROM nation")
def dimension_anchors(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("slug"), heading_id(F.col("n_name")).alias("anchor"), fnv1a(F.col("n_name")).alias("hash"))

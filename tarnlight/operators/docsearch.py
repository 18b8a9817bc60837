"""Field-weighted document search: one wide projection over query and document pairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SEARCH_STOP, capped_count, search_text, strings, strip_particle
from .lexical import small

FLOOR, WEAK_FLOOR, LIMIT = 18, 1, 24
# Words too general to tell documents apart.
GENERIC_TERMS = ("알고리즘", "구조", "방식", "문제", "오류", "검색", "처리", "언제", "어디서", "누가", "맞지", "않음")

# Aliases of query words.
ALIASES = {
    "텐서알티": ("tensorrt", "tensor rt", "tensor_rt"),
    "텐서rt": ("tensorrt",),
    "프레임아이디": ("frameid", "frame_id", "frame id"),
    "develop기준선": ("develop", "baseline", "27093423", "faint", "cooldown", "develop-code-baseline"),
    "기준선": ("develop-code-baseline", "develop", "baseline"),
    "오버레이": ("overlay",),
    "낙상": ("fall", "faint", "lifecycle"),
    "넘어졌는지": ("쓰러진", "넘어짐", "낙상", "faint"),
}


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Spark has no NFKC; only texts beyond ASCII and Hangul syllables need it."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal(text: Column) -> Column:
    """Normal form of any text: NFKC, lower case, separators to blanks, signs dropped."""
    plain = F.coalesce(text, F.lit("")).rlike(r"^[\x00-\x7F가-힣]*$")
    return search_text(F.when(plain, text).otherwise(nfkc(text)))


def variants(token: Column) -> Column:
    """Forms under which a query word may be found, in normal form."""
    bare = F.when(strip_particle(token) != "", strip_particle(token)).otherwise(token)
    alias = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), strings(v))])
    forms = [F.array(token, bare, search_text(token), search_text(bare), F.replace(bare, F.lit("-"), F.lit(" ")), F.replace(bare, F.lit("_"), F.lit(" ")))]
    forms.append(F.coalesce(alias[bare], alias[search_text(bare)], alias[token], strings(())))
    for test, more in (
        (bare.rlike(r"tensor\s*rt"), ("tensorrt", "tensor rt", "tensor_rt")),
        (bare.isin("frameid", "frame_id", "frame id"), ("frameid", "frame_id", "frame id")),
        (bare.contains("cameralogin") | (bare == "camera_login_id"), ("cameraloginid", "camera_login_id", "camera login id")),
    ):
        forms.append(F.when(test, strings(more)).otherwise(strings(())))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*forms)), search_text), lambda x: x != ""))


def split_camel(token: Column) -> Column:
    """camelCase and PascalCase to words in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def _useful(t: Column) -> Column:
    return (F.length(t) > 1) & ~t.isin(*SEARCH_STOP)


def parsed_queries(queries: DataFrame, query: Column) -> DataFrame:
    """``queries`` with phrase, compact, raw, tokens (stop words out, unless nothing would be left) and groups."""
    q = queries.withColumn("phrase", normal(query)).where("phrase <> ''")
    q = q.withColumn("compact", F.replace("phrase", F.lit(" "), F.lit(""))).withColumn("raw", F.split("phrase", " "))
    # Words in mixed case are looked for in their parts too.
    mixed = F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda t: split_camel(t) != F.lower(t))
    parts = F.filter(F.transform(mixed, lambda t: search_text(split_camel(t))), lambda t: t != "")
    q = q.withColumn("_all", F.array_distinct(F.concat(F.flatten(F.transform("raw", variants)), parts)))
    q = q.withColumn("_kept", F.filter("_all", _useful))
    q = q.withColumn("tokens", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_all"))).drop("_all", "_kept")
    group = lambda t: F.struct(strip_particle(t).alias("original"), F.filter(variants(F.when(strip_particle(t) != "", strip_particle(t)).otherwise(t)), _useful).alias("variants"))
    return q.withColumn("groups", F.filter(F.transform("raw", group), lambda g: F.size(g["variants"]) > 0))


FIELDS = ("title", "nav", "short", "display", "slug", "summary", "tags", "files", "category", "body")


def search_fields(docs: DataFrame, **fields: Column) -> DataFrame:
    """``docs`` with the normal form of each field as ``n_<field>``; fields not given are empty."""
    return docs.withColumns({f"n_{f}": normal(fields[f]) if f in fields else F.lit("") for f in FIELDS})


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, t: s + value(t))


def scored(pairs: DataFrame, headings: Column | None = None) -> DataFrame:
    """``pairs`` of parsed queries and normalised documents, with ``score`` and ``reasons``.

    headings: normal forms of the document's headings.
    """
    f = {x: F.col(f"n_{x}") for x in FIELDS}
    phrase, compact, tokens = F.col("phrase"), F.col("compact"), F.col("tokens")
    has = lambda field, t: F.contains(f[field], t)
    points = lambda c, x: F.when(c, F.lit(float(x))).otherwise(0.0)
    any_of = lambda names, t: F.greatest(*[has(n, t).cast("int") for n in names]) == 1

    same = (f["title"] == phrase) | (f["nav"] == phrase) | (f["display"] == phrase) | (f["short"] == phrase)
    inside = has("title", phrase) | has("nav", phrase) | has("display", phrase)
    title = F.when(same, 120.0).when(inside, 70.0).otherwise(0.0)
    tight = lambda *names: F.replace(F.concat(*[f[n] for n in names]), F.lit(" "), F.lit(""))
    code = F.when(F.length(compact) < 6, 0.0).when(F.contains(tight("files"), compact) | F.contains(tight("title", "nav", "short", "slug"), compact), 90.0).when(F.contains(tight("body"), compact), 55.0).otherwise(0.0)
    in_body = points((F.length(phrase) >= 4) & has("body", phrase), 28)
    every = lambda name: (F.size(tokens) > 0) & F.forall(tokens, lambda t: has(name, t))
    all_title = points(every("title") | every("nav") | every("display"), 55)

    file_hit = lambda t: has("files", t) | F.contains(f["files"], F.replace(t, F.lit(" "), F.lit("_"))) | F.contains(f["files"], F.replace(t, F.lit(" "), F.lit("/")))
    names = ("title", "nav", "short", "display")
    per_token = _sum(
        tokens,
        lambda t: points(file_hit(t), 40) + points(has("slug", t), 22) + points(any_of(names, t), 18) + points(has("tags", t), 12) + points(has("summary", t), 10) + points(has("category", t), 6) + 1.5 * capped_count(f["body"], t, 2),
    )
    covered = F.size(F.filter(tokens, lambda t: any_of(("title", "nav", "short", "summary", "tags", "files", "body"), t)))
    coverage = F.when(F.size(tokens) < 2, 0.0).when(covered == F.size(tokens), 35.0).otherwise(covered * 4.0)
    heads = F.filter(headings, lambda h: h != "") if headings is not None else strings(())
    head = _sum(heads, lambda h: F.when(F.contains(h, phrase), 24.0).when(F.exists(tokens, lambda t: F.contains(h, t)), 12.0).otherwise(0.0))

    strong_title = (title > 0) | (all_title > 0) | F.exists(tokens, lambda t: has("slug", t) | any_of(names, t))
    strong_code = (code > 0) | F.exists(tokens, file_hit)
    strong_tag = F.exists(tokens, lambda t: has("tags", t))
    strong = strong_title | strong_code | strong_tag
    field = F.concat_ws(" ", f["title"], f["nav"], f["summary"], f["body"], f["files"])
    groups = F.col("groups")
    hit = F.filter(groups, lambda g: F.exists(g["variants"], lambda v: F.contains(field, v)))
    long_hit = F.exists(hit, lambda g: F.exists(g["variants"], lambda v: F.length(v) >= 3))
    share = F.when(F.size(groups) > 0, F.size(hit) / F.size(groups)).otherwise(0.0)
    concrete = lambda a: F.filter(a, lambda g: ~g["original"].isin(*GENERIC_TERMS))
    concrete_share = F.when(F.size(concrete(groups)) > 0, F.size(concrete(hit)) / F.size(concrete(groups))).otherwise(1.0)
    total = title + code + in_body + all_title + per_token + coverage + head
    weak = (~strong & (~long_hit | (share < 0.6))) | (strong & (F.size(groups) >= 2) & (concrete_share < 0.6))
    reason = lambda c, name: F.when(c, name)
    body_hit = (in_body > 0) | (head > 0) | F.exists(tokens, lambda t: has("body", t))
    reasons = F.array_compact(F.array(reason(strong_title, "제목 일치"), reason(strong_code, "코드 심볼 일치"), reason(body_hit, "본문 일치"), reason(strong_tag, "태그 일치"), reason(F.exists(tokens, lambda t: has("summary", t)), "요약 일치")))
    return pairs.withColumn("_total", total).withColumn("score", F.when(weak, F.least("_total", F.lit(FLOOR - 1.0))).otherwise(F.col("_total"))).withColumn("reasons", reasons).drop("_total")


def snippet(text: Column, tokens: Column, phrase: Column, fallback: Column, before: int = 40, after: int = 120) -> Column:
    """Text around the earliest token (else the phrase), with ellipses where it is cut; else the head of the fallback."""
    low = F.lower(text)
    found = F.array_min(F.filter(F.transform(tokens, lambda t: F.position(t, low)), lambda p: p > 0))
    at = F.coalesce(found, F.when(F.position(phrase, low) > 0, F.position(phrase, low))) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(text), at + after)
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)\s+", " "))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at.isNotNull(), cut).otherwise(F.substring(F.coalesce(fallback, text), 1, 160))


def best_heading(headings: Column, tokens: Column, phrase: Column) -> Column:
    """Id of the heading that fits best, the first of equals; null if none fits. headings: structs of id, level, norm."""
    def points(h: Column) -> Column:
        whole = F.when(h["norm"] == phrase, 100).when(F.contains(h["norm"], phrase), 40).otherwise(0)
        part = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.when(h["norm"] == t, 30).when(F.contains(h["norm"], t), 12).otherwise(0))
        return whole + part + F.when(h["level"] == 2, 1).otherwise(0)

    ranked = F.transform(F.filter(headings, lambda h: h["norm"] != ""), lambda h: F.struct(points(h).alias("s"), h["id"].alias("id")))
    top = F.array_max(F.transform(ranked, lambda r: r["s"]))
    return F.when(top > 0, F.filter(ranked, lambda r: r["s"] == top)[0]["id"])


def search(docs: DataFrame, queries: DataFrame, key: str, order: list[Column], limit: int = LIMIT, include_weak: bool = False, headings: Column | None = None) -> DataFrame:
    """Hits of parsed queries over normalised documents: score, reasons, weak and rank, one a document key.

    Any substring of a field may score, so a stated set of queries is compared with
    all documents: it is broadcast if it is small, which is checked, and else dealt
    out in blocks that each meet all documents.
    """
    pairs = scored(docs.crossJoin(small(queries)), headings)
    hits = pairs.where(F.col("score") >= (WEAK_FLOOR if include_weak else FLOOR)).withColumn("weak", F.col("score") < FLOOR)
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))
    hits = hits.withColumn("_first", first).where("_first = 1").drop("_first")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)

"""License scans by an exact set-similarity join. DataFrame functions only.

Blocks (lines, and sentences inside lines) and license templates are sets of
words. A block meets a template when it holds at least ``threshold`` of the
template's words. Tokens are ordered by how many documents hold them, rare ones
first, ties by code point; of a template only its prefix, the first
|T| - need + 1 tokens, is looked up. A block that meets the template holds one of
those, so a join on prefix tokens loses nothing. A length filter (the block has
enough of the templates' words) and a positional filter (enough tokens stand
behind the shared one in both) come before the exact intersection.

Texts are wrapped at any word and sentences hold full stops ("v. 2.0"), so the
same join also runs on windows of words that cross line ends and full stops but
no blank line. A window has REACH times the template's words; every window that
holds a prefix token is looked at, and as many words as the threshold needs must
stand in the template's order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

#: Characters that part words once A-Z are lower-cased; and the same before lower-casing.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words stand consecutively, by label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license version 2 1"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8
BLOCKS = r"\n|(?<=[.!?])[\x20\x09-\x0D]+"
PARAGRAPHS = r"\n[\x20\x09-\x0D]*\n"
REACH = 3


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of words; null has none."""
    return (F.size(F.split(F.concat(F.lit("."), F.coalesce(text, F.lit("")), F.lit(".")), APART)) - 2).cast("bigint")


def spaced(text: Column) -> Column:
    """The words in lower case with one blank before and after each."""
    return ascii_lower(F.regexp_replace(F.concat(F.lit("."), text, F.lit(".")), APART, " "))


def words_in(s: Column) -> Column:
    """Words of a string in the form of :func:`spaced`."""
    return F.greatest(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("bigint")


def _any_case(words: Sequence[str]) -> str:
    """Pattern of the words in ASCII letters of either case."""
    return "(?i)(?<![a-z0-9\\x{80}-\\x{10FFFF}])(" + "|".join(sorted(set(words))) + ")(?![a-z0-9\\x{80}-\\x{10FFFF}])"


def phrase_places(text: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """struct(n, first, last, labels) of the places where a phrase's words stand consecutively."""
    s = spaced(text)
    found = []
    for phrase, label in phrases:
        parts = F.split(s, f"(?<= ){phrase}(?= )")
        n = (F.size(parts) - 1).cast("bigint")
        first = F.when(n > 0, words_in(F.element_at(parts, 1)))
        last = F.when(n > 0, words_in(s) - len(phrase.split()) - words_in(F.element_at(parts, -1)))
        found.append((n, first, last, F.when(n > 0, F.lit(label))))
    lowest = F.array_min(F.array(*[x[1] for x in found]))
    highest = F.array_max(F.array(*[x[2] for x in found]))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[x[3] for x in found]))))
    return F.struct(sum((x[0] for x in found[1:]), found[0][0]).alias("n"), lowest.alias("first"), highest.alias("last"), labels.alias("labels"))


def token_counts(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many documents hold each token of the templates, over all documents."""
    words = F.split(spaced(F.col(text_col)), " ")
    known = F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(known).alias("t")).groupBy("t").count().collect()  # as many rows as the templates have tokens
    return {r["t"]: r["count"] for r in rows}


def _looked_up(templates: Sequence[tuple[str, str]], threshold: float, counts: dict[str, int]) -> tuple[list[tuple], dict[str, int], list[str]]:
    """Postings (r, pos, template, label, ranks, need) of the prefix tokens, rank of each token, and the prefix tokens."""
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = _vocabulary(templates)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    postings = []
    for t, (label, s) in enumerate(sets):
        ranks = sorted(rank[w] for w in s)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        postings += [(r, pos, t, label, ranks, need) for pos, r in enumerate(ranks[: len(ranks) - need + 1])]
    by_rank = sorted(rank, key=rank.get)
    return postings, rank, sorted({by_rank[p[0]] for p in postings})


def _vocabulary(templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def containment_join(docs: DataFrame, key_cols: Sequence[str], text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, counts: dict[str, int] | None = None) -> DataFrame:
    """(keys, block, template, label, overlap, containment) of every block that meets a template.

    Blocks are numbered from 0. Null and blank texts have no block that meets
    one. The template list is given by the caller on the driver, so its tables
    are as small as that list. counts: of :func:`token_counts`, if known.
    """
    spark = prepare(docs.sparkSession)
    counts = token_counts(docs, text_col, _vocabulary(templates)) if counts is None else counts
    postings, rank, heads = _looked_up(templates, threshold, counts)
    found = spark.createDataFrame(postings, "r int, pos int, template int, label string, ranks array<int>, need int")
    by_rank = sorted(rank, key=rank.get)
    order = F.create_map(*[F.lit(x) for w in by_rank for x in (w, rank[w])])

    near = docs.where(F.col(text_col).rlike(_any_case(heads))).select(*key_cols, F.posexplode(F.split(F.col(text_col), BLOCKS)).alias("block", "_text"))
    near = near.where(F.col("_text").rlike(_any_case(heads)))
    known = F.array_intersect(F.split(spaced(F.col("_text")), " "), F.array(*[F.lit(w) for w in by_rank]))
    blocks = near.select(*key_cols, "block", F.array_sort(F.transform(known, lambda w: order[w])).alias("own"))
    blocks = blocks.where(F.size("own") >= min(p[5] for p in postings))
    pairs = blocks.select("*", F.posexplode("own").alias("at", "r")).join(F.broadcast(found), "r")
    pairs = pairs.where("size(own) >= need AND 1 + least(size(ranks) - pos, size(own) - at) - 1 >= need")
    met = pairs.withColumn("overlap", F.size(F.array_intersect("own", "ranks"))).where("overlap >= need")
    # A pair meets at each shared prefix token; keep it at the first one.
    met = met.where("r = array_min(array_intersect(own, ranks))")
    return met.select(*key_cols, "block", "template", "label", "overlap", (F.col("overlap") / F.size("ranks")).alias("containment"))


def window_join(docs: DataFrame, key_cols: Sequence[str], text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, counts: dict[str, int] | None = None) -> DataFrame:
    """(keys, template, label, overlap, containment) of the windows that meet a template, one row for each prefix
    token in one: the best of all windows of REACH times the template's words in the paragraph that hold the token."""
    spark = prepare(docs.sparkSession)
    counts = token_counts(docs, text_col, _vocabulary(templates)) if counts is None else counts
    postings, rank, heads = _looked_up(templates, threshold, counts)
    by_rank = sorted(rank, key=rank.get)
    widths = [REACH * len(text.split()) for _, text in templates]
    found = spark.createDataFrame([(by_rank[r], t, label, [by_rank[x] for x in ranks], templates[t][1].split(), need, widths[t]) for r, _, t, label, ranks, need in postings], "word string, template int, label string, words array<string>, said array<string>, need int, width int")
    widest = max(widths)

    near = docs.where(F.col(text_col).rlike(_any_case(heads))).select(*key_cols, F.explode(F.split(F.col(text_col), PARAGRAPHS)).alias("_text"))
    near = near.where(F.col("_text").rlike(_any_case(heads))).select(*key_cols, F.split(F.trim(spaced(F.col("_text"))), " ").alias("_words"))

    def around(w: Column, i: Column) -> Column:
        start = F.greatest(i - (widest - 1), F.lit(0))
        return F.when(w.isin(heads), F.struct(w.alias("word"), (i - start).alias("at"), F.slice("_words", start + 1, F.lit(2 * widest - 1)).alias("near")))

    hits = near.select(*key_cols, F.explode(F.array_compact(F.transform("_words", around))).alias("_hit")).select(*key_cols, "_hit.*")
    pairs = hits.join(F.broadcast(found), "word")
    before = F.least(F.col("at"), F.col("width") - 1)
    pairs = pairs.withColumn("near", F.slice("near", F.col("at") - before + 1, before + F.col("width"))).withColumn("at", before)
    pairs = pairs.where("size(array_intersect(near, words)) >= need")

    def in_order(window: Column) -> Column:
        """Length of the longest common subsequence with the template, by the longest that ends at each of its words."""
        step = lambda ends, w: F.transform("said", lambda t, j: F.when(t == w, F.greatest(ends[j], 1 + F.coalesce(F.array_max(F.slice(ends, 1, j)), F.lit(0)))).otherwise(ends[j]))
        return F.array_max(F.aggregate(window, F.array_repeat(F.lit(0), F.size("said")), step))

    def shared(i: Column) -> Column:
        window = F.slice("near", i + 1, F.col("width"))
        n = F.size(F.array_intersect(window, F.col("words")))
        return F.when((n >= F.col("need")) & (in_order(window) >= F.col("need")), n).otherwise(0)

    best = F.array_max(F.transform(F.sequence(F.lit(0), "at"), shared))
    met = pairs.withColumn("overlap", best).where("overlap >= need")
    return met.select(*key_cols, "template", "label", "overlap", (F.col("overlap") / F.size("words")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 with a base label, else the best containment of a template
    that a block or a window meets, else 0. Null texts are empty. Rows repeated with the same
    id and text get the same result each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mark = F.xxhash64("text").alias("mark")
    last_words = [p.split()[-1] for p, _ in phrases]
    place = F.when(F.col("text").rlike(_any_case(last_words)), phrase_places(F.col("text"), phrases))
    base = rows.select("id", mark, count_words(F.col("text")).alias("n_words"), place.alias("p"))
    given = (rows.select("id", mark, "text"), ["id", "mark"], "text", templates, threshold, token_counts(rows, "text", _vocabulary(templates)))
    met = containment_join(*given).drop("block").unionAll(window_join(*given))
    met = met.groupBy("id", "mark").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    met = met.select(F.col("id").alias("i"), F.col("mark").alias("m"), "more", "best")
    none = F.array().cast("array<string>")
    base_labels, more = F.coalesce("p.labels", none), F.coalesce("more", none)
    return base.join(met, F.col("id").eqNullSafe(F.col("i")) & F.col("mark").eqNullSafe(F.col("m")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("p.n", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("p.first").alias("first_word"),
        F.col("p.last").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_license_join(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows by brute force: every block against every template."""
    split = r"string_split_regex(translate(coalesce({}, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    tidy = lambda x: f"list_filter({split.format(x)}, lambda w: w <> '')"
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS i, '{label}' AS label FROM w, range(1, len(words) - {len(p.split()) - 2}) t(i) WHERE " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES
    )
    templates = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, {tidy("text")} AS words FROM d),
p AS ({places}),
b AS (SELECT rid, count(*) AS n, min(i) AS f, max(i) AS l, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY rid),
blocks AS (SELECT rid, unnest(string_split_regex(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', E'\\1\n', 'g'), '\n')) AS block FROM d),
sets AS (SELECT rid, list_distinct({tidy("block")}) AS own FROM blocks),
t(label, words) AS (VALUES {templates}),
met AS (
  SELECT rid, label, len(list_intersect(own, t.words)) / len(t.words) AS c FROM sets, t
  WHERE len(list_intersect(own, t.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9)
),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS best FROM met GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word, b.l::BIGINT AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END::DOUBLE AS score
FROM d JOIN w USING (rid) LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""


SQL_OP8 = _sql()

"""Retrieval quality, failure taxonomy, promotion policy and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Failure codes, in reporting order.
CODES = ("EXPECTED_DOC_NOT_RETRIEVED", "WRONG_TOP1", "LOW_SIMILARITY", "KEYWORD_MISS", "SEMANTIC_MISS", "FILTER_FAILURE", "DUPLICATE_RESULT", "NO_ANSWER_FAILURE", "STALE_DOCUMENT_SELECTED")


def judged(ranked: DataFrame, expected: DataFrame, document: str) -> DataFrame:
    """(query_id, n_expected, rank of each expected document found): ranked holds query_id, document, doc_rank; expected
    query_id, document. Queries without expected documents have no row."""
    n = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    met = expected.join(ranked.select("query_id", document, "doc_rank"), ["query_id", document])
    return n.join(met, "query_id", "left").select("query_id", "n_expected", "doc_rank")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, document: str, k: int = 5) -> DataFrame:
    """One row a query with expected documents: hit@1, hit@3, hit@k, recall@k, mrr@k, ndcg@k (binary, by document)."""
    rows = judged(ranked, expected, document)
    best = F.min("doc_rank")
    inside = F.col("doc_rank") <= k
    gain = F.sum(F.when(inside, 1 / F.log2(F.col("doc_rank") + 1)).otherwise(0.0))
    n = F.first("n_expected")
    out = rows.groupBy("query_id").agg(n.alias("n_expected"), best.alias("best"), F.count(F.when(inside, 1)).alias("found"), gain.alias("dcg"))
    hit = lambda at: F.coalesce((F.col("best") <= at).cast("int"), F.lit(0))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n_expected"), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return out.select(
        "query_id",
        "n_expected",
        hit(1).alias("hit_at_1"),
        hit(3).alias("hit_at_3"),
        hit(k).alias("hit_at_5"),
        F.round(F.col("found") / F.col("n_expected"), 6).alias("recall_at_5"),
        F.round(F.when(F.col("best") <= k, 1 / F.col("best")).otherwise(0.0), 6).alias("mrr_at_5"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg_at_5"),
    )


def keyword_rate(text: Column, keywords: Column) -> Column:
    """Share of the keywords a text contains in any case; null without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(keywords, lambda w: F.contains(low, F.lower(w)))
    return F.when(F.size(keywords) > 0, F.size(hits) / F.size(keywords))


def failures(row: dict[str, Column]) -> Column:
    """Failure codes of one query, in order. Keys: answerable, n_results, n_expected, any_expected, top1_expected,
    top5_expected, max_score, keyword_rate, filter_ok, duplicates, stale (all booleans or numbers)."""
    empty = row["n_results"] == 0
    has = row["n_expected"] > 0
    code = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    answerable = F.array_compact(
        F.array(
            code(CODES[0], has & ~row["any_expected"]),
            code(CODES[1], has & ~row["top1_expected"] & row["top5_expected"]),
            code(CODES[2], has & row["any_expected"] & (row["max_score"] < 0.12)),
            code(CODES[3], row["keyword_rate"] < 0.34),
            code(CODES[4], has & ~row["any_expected"] & (row["max_score"] >= 0.12)),
            code(CODES[5], ~row["filter_ok"]),
            code(CODES[6], row["duplicates"] > 0),
            code(CODES[8], row["stale"]),
        )
    )
    refused = F.array_compact(F.array(code(CODES[7], ~empty & (row["max_score"] >= 0.08))))
    return F.when(~row["answerable"], refused).when(empty, F.array(F.lit(CODES[0]))).otherwise(answerable)


def count_failures(spark, coded: DataFrame, column: str = "failures") -> DataFrame:
    """(code_pos, code, n), zeros included."""
    codes = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "code_pos int, code string")
    n = coded.select(F.explode(column).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(n, "code", "left").select("code_pos", "code", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


QUALITY = ("hit_at_1", "hit_at_3", "hit_at_5", "recall_at_5", "mrr_at_5", "ndcg_at_5", "filter_accuracy")


def promotion(candidate: DataFrame, best: DataFrame, on: list[str] | None = None, min_gain: float = 0.01, max_drop: float = 0.02, max_no_result_drop: float = 0.02, max_latency_rise: float = 0.3, latency_floor: float = 20.0) -> DataFrame:
    """Candidate rows with ``promote`` and ``regressions``, against the best so far (no row: promoted).

    Metrics are columns; absent or null ones are not compared. Null gains count as 0.
    """
    b = best.select([F.col(c).alias(c if on and c in on else f"best_{c}") for c in best.columns]).withColumn("_best", F.lit(True))
    both = candidate.join(b, on, "left") if on else candidate.join(F.broadcast(b), F.lit(True), "left")
    has = lambda c: c in candidate.columns and c in best.columns
    old = lambda c: F.col(f"best_{c}")
    gain = lambda c: F.coalesce(F.col(c), F.lit(0.0)) - F.coalesce(old(c), F.lit(0.0)) if has(c) else F.lit(0.0)
    better = (F.round(gain("recall_at_5"), 9) >= min_gain) | (F.round(gain("mrr_at_5"), 9) >= min_gain)
    bad = [F.when(~better, "no_quality_gain")]
    for c in QUALITY:
        if has(c):
            bad.append(F.when(F.round(old(c) - F.col(c), 9) > max_drop, f"{c}_regressed"))
    if has("no_result_accuracy"):
        bad.append(F.when(F.round(old("no_result_accuracy") - F.col("no_result_accuracy"), 9) > max_no_result_drop, "no_result_accuracy_regressed"))
    if has("p95_latency_ms"):
        was = old("p95_latency_ms")
        bad.append(F.when((was > 0) & (was >= latency_floor) & (F.try_divide(F.col("p95_latency_ms") - was, was) > max_latency_rise), "p95_latency_increased"))
    for c in ("duplicates", "wrong_top1"):
        if has(c):
            bad.append(F.when(F.col(c) > old(c), f"{c}_increased"))
    return (
        both.withColumn("regressions", F.when(F.col("_best"), F.array_compact(F.array(*bad))).otherwise(F.array().cast("array<string>")))
        .withColumn("promote", F.size("regressions") == 0)
        .select(*candidate.columns, "promote", "regressions")
    )


def nearest_rank(column: str, p: float) -> Column:
    """Percentile by nearest rank, ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def floor_rank(df: DataFrame, by: str, column: str, p: float, name: str, width: float = 0.01) -> DataFrame:
    """(by, name): the value at index floor(p (n - 1)). Approximate percentiles a little below and above bracket it;
    what is below is counted, and only the values inside the bracket are ordered."""
    rows = df.where(F.col(column).isNotNull()).select(by, column)
    around = F.percentile_approx(column, F.array(F.lit(max(0.0, p - width)), F.lit(min(1.0, p + width))), F.lit(1000))
    ends = rows.groupBy(by).agg(F.count("*").alias("_n"), around.alias("_e"), F.min(column).alias("_min"), F.max(column).alias("_max"))
    # The approximation is off by a thousandth of the rows at most; at the ends, and for few rows, the
    # bracket is open.
    few = F.col("_n") < 10 / width
    lo, hi = F.when(few | F.lit(p <= width), F.col("_min")).otherwise(F.col("_e")[0]), F.when(few | F.lit(p >= 1 - width), F.col("_max")).otherwise(F.col("_e")[1])
    ends = ends.select(F.col(by).alias("_by"), "_n", lo.alias("_lo"), hi.alias("_hi"))
    from .lexical import small

    marked = rows.join(small(ends), F.col(by).eqNullSafe(F.col("_by")))
    below = marked.groupBy("_by").agg(F.count_if(F.col(column) < F.col("_lo")).alias("_below"))
    inside = marked.where(F.col(column).between(F.col("_lo"), F.col("_hi"))).groupBy("_by", "_n", column).agg(F.count("*").alias("_c"))
    along = Window.partitionBy("_by").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_upto", F.sum("_c").over(along)).join(small(below.withColumnRenamed("_by", "_b2")), F.col("_by").eqNullSafe(F.col("_b2")))
    index = F.floor(F.lit(p) * (F.col("_n") - 1))
    first, upto = F.col("_below") + F.col("_upto") - F.col("_c"), F.col("_below") + F.col("_upto")
    return placed.where((first <= index) & (index < upto)).select(F.col("_by").alias(by), F.col(column).alias(name))


def spread(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, min, max, mean, p50, p95) of a column, percentiles by nearest rank; nulls left out."""
    agg = [F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"), nearest_rank(column, 0.5).alias("p50"), nearest_rank(column, 0.95).alias("p95")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def passed(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    """(by, n, passed, share) of each group of questions, or mode of search; an unknown outcome has not passed."""
    good = F.count_if(F.coalesce(ok, F.lit(False)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), good.alias("passed"), F.round(good / F.count("*"), 6).alias("share"))


def mean_of(column: Column, inside: Column | None = None) -> Column:
    """Mean of a metric over all rows, or over those inside; nulls count as 0, no rows give null."""
    value = F.coalesce(column, F.lit(0.0))
    return F.round(F.avg(value if inside is None else F.when(inside, value)), 6)


def reciprocal_mean(rank: Column, most: int = 10) -> Column:
    """Mean reciprocal rank within the first ``most``; not found counts as 0."""
    return F.round(F.avg(F.when(rank <= most, 1 / rank).otherwise(0.0)), 6)


def outcome(hit_before: Column, hit_now: Column) -> Column:
    """What became of a question from one system to the other."""
    return F.when(hit_now & ~hit_before, "improved").when(hit_before & ~hit_now, "regressed").when(hit_now, "kept").otherwise("missed")


def deltas(candidate: DataFrame, base: DataFrame, metrics: tuple[str, ...], on: list[str]) -> DataFrame:
    """(on, metric, value, base, absolute, relative): differences to a base run; relative is null where the base is 0."""
    long = lambda df, name: df.select(*on, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(*on, "x.metric", F.col("x.v").alias(name))
    both = long(candidate, "value").join(long(base, "base"), [*on, "metric"])
    gap = F.col("value") - F.col("base")
    return both.select(*on, "metric", "value", "base", F.round(gap, 4).alias("absolute"), F.round(F.try_divide(gap, F.col("base")), 4).alias("relative"))


def samples(coded: DataFrame, key: str, column: str = "failures") -> DataFrame:
    """(code, n, sample): how often each failure code comes, and the smallest key that has it."""
    return coded.select(key, F.explode(column).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.min(key).alias("sample"))


def spot_check(ranked: DataFrame, expected: DataFrame, document: str, k: int = 5) -> DataFrame:
    """(query_id, ok): whether any expected document is among the first ``k``; queries without a hit are not."""
    hit = ranked.where(F.col("doc_rank") <= k).join(expected, ["query_id", document], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(True))
    return expected.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("ok"))


def best_covered(rows: DataFrame, by: str, coverage: Column, order: Column, value: str) -> DataFrame:
    """(by, value, coverage) of the row with the highest coverage; of equal ones the first."""
    best = F.max_by(F.struct(F.col(value).alias("v"), coverage.alias("c")), F.struct(coverage, -order))
    return rows.groupBy(by).agg(best.alias("_b")).select(by, F.col("_b.v").alias(value), F.col("_b.c").alias("coverage"))


def first_unique(rows: DataFrame, by: str, value: str, order: Column, most: int = 10) -> DataFrame:
    """(by, value, place): the first ``most`` different values of each group, in the order they first come."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("_o"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_o", value))
    return first.withColumn("place", place).where(F.col("place") <= most).select(by, value, "place")


def experiment(index, chunks: DataFrame, queries: DataFrame, expected: DataFrame, configs: dict, document: str, k: int = 5) -> DataFrame:
    """Metrics of each query under each named search setting, with ``config``: baseline against hybrid, weights and
    bounds, or modes side by side. One search a setting over the same stored index."""
    from .fusion import first_documents
    from .search import search

    out = None
    for name, config in configs.items():
        found = search(index, chunks, queries, config, document)
        docs = first_documents(found, "document").withColumnRenamed("document", document)
        rows = retrieval_metrics(docs, expected, document, k).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def gate_report(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(group, n, passed, share): answers (query_id, status) against what should come of each question (query_id,
    group, answerable); a question without an answer row has been refused."""
    both = expected.join(answers.select("query_id", "status"), "query_id", "left")
    return passed(both, "group", F.col("answerable") == (F.coalesce("status", F.lit("")) == "answered"))

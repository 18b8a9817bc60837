"""Hashed term vectors and exact cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a, index_tokens
from .packed import CELLS, Best

SIZE = 256


def buckets(docs: DataFrame, key: str, text: Column, size: int = SIZE) -> DataFrame:
    """(key, bucket, n) how many tokens of a text hash to each bucket."""
    terms = docs.select(key, F.explode(index_tokens(text)).alias("term"))
    return terms.select(key, (fnv1a(F.col("term")) % size).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))


def sparse_embedding(docs: DataFrame, key: str, text: Column, size: int = SIZE) -> DataFrame:
    """(key, bucket, w) of unit length before rounding to six places; texts without tokens have no rows."""
    counts = buckets(docs, key, text, size)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", F.round(F.col("n") / norm, 6).alias("w"))


def dense_embedding(sparse: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """(key, embedding) with zeros filled in."""
    cells = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i.cast("bigint")], F.lit(0.0))).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; missing components count as 0."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


#: Bytes of a block of query vectors sent to the tasks; more queries take more blocks.
BLOCK_BYTES = 32 << 20
#: Rows of one Arrow batch sent to Python.
BATCH_ROWS = 512


def arrow_rows(spark) -> None:
    """From now on Arrow batches have at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scores(vectors: DataFrame, queries: DataFrame, key: str, vec: str, most: int | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, key, score): dot product, to six places, of each query with each vector but its own.

    Components beyond the shorter length and nulls count as 0. With ``most``, only
    rows that can be among a query's first ``most`` (ties to the smaller key) leave a
    task; with ``floor``, only scores from it on. The queries go to the tasks in blocks
    of bounded size, and are multiplied with a bounded number of vectors at once.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    return _by_block(vectors, queries, key, vec, kinds, lambda sent: _products(sent, key, most, floor), most is not None)


def matches(vectors: DataFrame, queries: DataFrame, key: str, vec: str, floor: float) -> DataFrame:
    """(query_id, n, best): how many vectors but its own score ``floor`` or more with each query, and the best score, as
    in :func:`scores`; queries without any have no row."""
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = _by_block(vectors, queries, key, vec, f"query_id {kind}, n bigint, best double", lambda sent: _counts(sent, floor), True)
    return rows.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def _by_block(vectors: DataFrame, queries: DataFrame, key: str, vec: str, kinds: str, made, few: bool) -> DataFrame:
    spark = vectors.sparkSession
    arrow_rows(spark)
    sized = queries.select("query_id", F.col(vec).alias("q")).where("q IS NOT NULL")
    n, width = sized.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, width) * 8 // BLOCK_BYTES))
    rows = None
    for block in range(blocks if n else 0):
        part = sized.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            sent = spark.sparkContext.broadcast((part.column(0).combine_chunks(), filled(part.column(1).combine_chunks())))
            table = vectors.select(key, vec).where(F.col(vec).isNotNull())
            more = (table.coalesce(spark.sparkContext.defaultParallelism) if few else table).mapInArrow(made(sent), kinds)
            rows = more if rows is None else rows.unionAll(more)
    return spark.createDataFrame([], kinds) if rows is None else rows


def filled(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a matrix from lists of numbers; zeros for what is missing, cut at ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max([0, *lengths]) if width is None else width))
    row, place = np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
    values = np.nan_to_num(column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan)
    inside = place < out.shape[1]
    out[row[inside], place[inside]] = values[inside]
    return out


def _tiles(batches, sent):
    """(first query, keys, scores, NaN above all; which pairs count) of some queries with some vectors at once."""
    ids, q = sent.value
    known = ids.dictionary_encode(null_encoding="encode")
    code = known.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(known.dictionary) + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = filled(batch.column(1), q.shape[1])
        own = pc.fill_null(pc.index_in(batch.column(0), known.dictionary), -1).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // batch.num_rows)
        for lo in range(0, len(ids), step):
            s = np.round(q[lo : lo + step] @ x.T, 6)
            ok = np.ones(s.shape, bool)
            for at in np.flatnonzero(own >= 0):
                same = order[start[own[at]] : start[own[at] + 1]]
                ok[same[(same >= lo) & (same < lo + step)] - lo, at] = False
            yield lo, batch.column(0), s, ok


def _above(s: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(s), np.inf, s)


def _products(sent, key: str, most: int | None, floor: float | None):
    def run(batches):
        ids = sent.value[0]
        best = Best(len(ids), most) if most is not None else None
        for lo, keys, s, ok in _tiles(batches, sent):
            r = _above(s)
            if floor is not None:
                ok &= r >= floor
            if best is not None:
                best.narrow(lo, r, ok)
            a, b = np.nonzero(ok)
            if best is not None:
                best.add(lo + a, r[a, b], keys.take(pa.array(b)), [s[a, b]])
            elif len(a):
                yield pa.record_batch([ids.take(pa.array(lo + a)), keys.take(pa.array(b)), pa.array(s[a, b])], names=["query_id", key, "score"])
        if best is not None:
            for x in best.rows_of(ids):
                yield x.rename_columns(["query_id", key, "score"])

    return run


def _counts(sent, floor: float):
    def run(batches):
        ids = sent.value[0]
        n, best = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        for lo, _, s, ok in _tiles(batches, sent):
            r = _above(s)
            ok &= r >= floor
            n[lo : lo + len(s)] += ok.sum(axis=1)
            best[lo : lo + len(s)] = np.maximum(best[lo : lo + len(s)], np.where(ok, r, -np.inf).max(axis=1))
        some = np.flatnonzero(n)
        top = best[some]
        yield pa.record_batch([ids.take(pa.array(some)), pa.array(n[some]), pa.array(np.where(np.isposinf(top), np.nan, top))], names=["query_id", "n", "best"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(query_id, key, score, rank) by exact search: the stated queries against all vectors, in blocks."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores(vectors, queries, key, vec, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

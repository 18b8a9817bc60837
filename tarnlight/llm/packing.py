"""Packing into optimal length buckets.

The global histogram of all lengths is gathered (a row a different length, so its
size is bounded by the longest document); dynamic programming over it chooses the
bucket bounds with the least padding. Inside each bucket, documents in a seeded order
form batches whose rows, padded to the bound, fit the token budget.

Places in a bucket are gapless without sorting it in one task: the seeded order is
cut into cells of about ``CELL_ROWS`` rows, cells are counted, and each row is
numbered inside its cell behind the rows of the cells before. Rows equal in id and
text are numbered as one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, small, table
from .mixing import row_key, uniform, word_count

CELL_ROWS = 1024


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the sum of (bound - length).

    ``lengths`` ascending and distinct. best[j] is the least padded size of the
    first j lengths; a bucket over i+1..j costs lengths[j] for each of its rows.
    The cheapest i never falls as j grows, so each layer is solved by halving: the
    middle j first, then both sides within its i. Ties take the smallest i, fewer
    buckets win ties.
    """
    m = len(lengths)
    if not m:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back: list[np.ndarray] = []
    totals: list[float] = []
    for layer in range(min(buckets, m)):
        new, origin = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(layer + 1, m, layer, m - 1)]  # j from, to; i from, to
        while todo:
            j0, j1, i0, i1 = todo.pop()
            if j0 > j1:
                continue
            j = (j0 + j1) // 2
            last = min(i1, j - 1)
            cost = best[i0 : last + 1] + lengths[j - 1] * (upto[j] - upto[i0 : last + 1])
            i = i0 + int(np.argmin(cost))
            new[j], origin[j] = cost[i - i0], i
            todo += [(j0, j - 1, i0, i), (j + 1, j1, i, i1)]
        back.append(origin)
        totals.append(float(new[m]))
        best = new
    k, j, bounds = int(np.argmin(totals)), m, []
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j, k = int(back[k][j]), k - 1
    return bounds[::-1]


def pack_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 8, budget: int = 65_536, seed: str = "pack") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, bucket, bound, batch, place, padding.

    ``length`` defaults to the words of the text (null: 0). A batch holds at most
    max(1, budget // bound) rows; a document longer than the budget is a batch of
    its own. Rows are ordered by a hash of id and text, so reruns agree; rows equal
    in both tie, and their places are theirs in any order. Null ids count as an id.
    Empty texts have length 0 and share the first bucket; very long texts count
    whole. An empty table gives an empty result; other columns are ignored.
    """
    n = F.coalesce(word_count(F.col(text_col)) if length is None else length, F.lit(0)).cast("bigint")
    base = cut(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), uniform(row_key(id_col, text_col), seed).alias("u")))
    hist = base.groupBy("n_tokens").agg(F.count("*").alias("c")).orderBy("n_tokens").toArrow()
    lengths, counts = (hist.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    bounds = optimal_bounds(lengths, counts, buckets) or [0]
    inside = np.searchsorted(np.array(bounds), lengths)
    cells = [max(1, -(-int(counts[inside == b].sum()) // CELL_ROWS)) for b in range(len(bounds))]

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)

    bucket = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[b], b).otherwise(bucket)
    rows = base.withColumn("bucket", bucket).withColumn("cell", F.floor(F.col("u") * by_bucket(cells)))
    sizes = rows.groupBy("bucket", "cell").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("bucket", "cell", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start")))
    alike = rows.groupBy("bucket", "cell", "u", "id", "n_tokens").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket", "cell").orderBy("u", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed = numbered(alike.join(small(starts, sum(cells)), ["bucket", "cell"]), "rows", "again").withColumn("slot", F.col("start") + F.col("before") + F.col("again"))
    per_batch = by_bucket([max(1, budget // max(1, b)) for b in bounds])
    return placed.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        by_bucket(bounds).cast("bigint").alias("bound"),
        F.floor(F.col("slot") / per_batch).alias("batch"),
        (F.col("slot") % per_batch).alias("place"),
        (by_bucket(bounds) - F.col("n_tokens")).cast("bigint").alias("padding"),
    )


def op3_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_buckets(table(spark, sf_dir, "documents"))

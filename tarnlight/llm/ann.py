"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits at the median of a random projection (one direction a level, a
threshold a node), fitted on a bounded sample. A query walks all trees with one
priority queue, ordered by the squared distance to the splits crossed, and takes
leaves from it until it has visited as many as the forest needs. The rows of those
leaves are scored exactly.

How many leaves that is depends on the vectors, so it is measured: the exact
neighbours of about ``PROBES`` queries, found among all rows, are looked for in the
queue, and visits go as deep as holds ``RECALL`` of them. Clustered vectors take few
visits; isotropic ones have no structure to exploit and take a large share.

All rows are indexed. Equal vectors are one entry that keeps its smallest ids, so
a vector with many copies neither fills a leaf nor hides others. Leaves and the
queries that visit them meet in tiles of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, cut, grouped, lists, map_batches, prepare, small, table
from .vectors import cosines, matrix, unit, usable

TREES = 4
#: Rows a leaf is aimed at: a LEAVES-th of the rows, between these bounds.
LEAVES, LEAST_ROWS, LEAF_ROWS = 64, 32, 512
MAX_DEPTH = 20
#: Bound of the sample that the thresholds are fitted on, in vectors (expected; picked by a hash of the id).
SAMPLE = 20_000
#: Queries whose exact neighbours set the visits (expected; likewise), and the share of neighbours to be met.
PROBES, RECALL = 100, 0.96
BLOCK = 4096


@dataclass
class Forest:
    directions: list[np.ndarray]  # [depth, dims] of each tree
    thresholds: list[list[np.ndarray]]  # of each tree and level

    @property
    def depth(self) -> int:
        return len(self.thresholds[0])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[rows, trees] leaf numbers of unit vectors."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t, (d, thresholds) in enumerate(zip(self.directions, self.thresholds)):
            side = x @ d.T
            for level, th in enumerate(thresholds):
                out[:, t] = out[:, t] * 2 + (side[:, level] > th[out[:, t]])
        return out

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        sides = [d @ x for d in self.directions]
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        while queue:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                gap = sides[t][level] - self.thresholds[t][level][node]
                near = int(gap > 0)
                heapq.heappush(queue, (cost + gap * gap, t, level + 1, node * 2 + 1 - near))
                node, level = node * 2 + near, level + 1
            yield t, node

    def places(self, x: np.ndarray, near: np.ndarray) -> list[int]:
        """For each of the vectors ``near`` how many leaves the query x visits until it meets it."""
        wanted: dict[tuple[int, int], set[int]] = {}
        for i, own in enumerate(self.leaves(near).tolist()):
            for spot in enumerate(own):
                wanted.setdefault(spot, set()).add(i)
        met: dict[int, int] = {}
        for n, spot in enumerate(self.walk(x), 1):
            for i in wanted.get(spot, ()):
                met.setdefault(i, n)
            if len(met) == len(near):
                break
        return list(met.values())


def plant(sample: np.ndarray, n: int, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Fit on unit vectors; the depth aims at ``leaf_rows`` of n rows a leaf. Nodes of which the sample holds too
    little split at the median of the whole sample."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows)))))
    rng = np.random.default_rng(seed)
    directions, thresholds = [], []
    for _ in range(trees):
        d = rng.normal(size=(depth, sample.shape[1]))
        d /= np.sqrt((d * d).sum(1, keepdims=True)) if depth else 1
        side, node, levels = sample @ d.T, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            th = np.full(1 << level, np.median(side[:, level]))
            order = np.argsort(node, kind="stable")
            own, starts, sizes = np.unique(node[order], return_index=True, return_counts=True)
            for k, start, size in zip(own, starts, sizes):
                if size >= 4:
                    th[k] = np.median(side[order[start : start + size], level])
            node = node * 2 + (side[:, level] > th[node])
            levels.append(th)
        directions.append(d)
        thresholds.append(levels)
    return Forest(directions, thresholds)


def _placed(forest) -> Callable:
    def run(batches):
        trees_of = forest.value
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                places = trees_of.leaves(unit(x))
                trees = np.arange(places.shape[1]) * (1 << trees_of.depth)
                yield pa.record_batch([*batch.columns, lists(list((places + trees).astype(np.int64)))], names=[*batch.schema.names, "leaves"])

    return run


def _visits(forest, most: int) -> Callable:
    def run(batches):
        trees_of = forest.value
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                own = [[t * (1 << trees_of.depth) + leaf for t, leaf in islice(trees_of.walk(v), most)] for v in unit(x)]
                yield pa.record_batch([*batch.columns, lists([np.array(x, np.int64) for x in own])], names=[*batch.schema.names, "leaves"])

    return run


def _nearest_probes(probes, k: int) -> Callable:
    """Of the rows (rep, vec) of a task, each probe's k nearest but itself."""

    def run(batches):
        reps, x = probes.value
        best: list[pa.RecordBatch] = []
        for batch in batches:
            rep, y = batch.column(0).to_numpy(), matrix(batch.column(1))
            if not len(y):
                continue
            scores = unit(x) @ unit(y).T
            scores[reps[:, None] == rep[None, :]] = -np.inf
            n = min(k, len(y))
            at = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(y) else np.tile(np.arange(n), (len(x), 1))
            q, c = np.repeat(np.arange(len(x)), n), at.ravel()
            s = scores[q, c]
            own = np.flatnonzero(s > -np.inf)
            best.append(pa.record_batch([pa.array(q[own]), pa.array(rep[c[own]]), batch.column(1).take(pa.array(c[own])), pa.array(s[own])], names=["probe", "rep", "vec", "score"]))
            if len(best) > 16:
                best = _best(best, k)
        yield from _best(best, k)

    return run


def _best(held: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k rows of the highest score of each probe."""
    if not held:
        return []
    every = pa.Table.from_batches(held)
    probe, score = every.column("probe").to_numpy(), every.column("score").to_numpy()
    order = np.lexsort((-score, probe))
    place = np.arange(len(order)) - np.searchsorted(probe[order], probe[order])
    return every.take(pa.array(order[place < k])).combine_chunks().to_batches()


def visits_needed(entries: DataFrame, asked: DataFrame, forest: Forest, k: int, recall: float, probes: int, seed: int) -> int:
    """Leaves a query has to visit to meet ``recall`` of its k nearest entries, by the exact neighbours of about
    ``probes`` queries among all entries."""
    spark = entries.sparkSession
    own = asked.select("rep", "vec").dropDuplicates(["rep"])
    share = max(1, min(1_000_000, probes * 1_000_000 // max(1, own.count())))
    some = own.where(F.pmod(F.xxhash64("rep", F.lit(seed + 1)), F.lit(1_000_000)) < share).toArrow().sort_by("rep")
    if not some.num_rows:
        some = own.orderBy("rep").limit(1).toArrow()
    if not some.num_rows:
        return 1
    x = matrix(some.column("vec"))
    sent = spark.sparkContext.broadcast((some.column("rep").to_numpy(), x))
    kind = entries.schema["vec"].dataType.simpleString()
    near = map_batches(entries.select("rep", "vec"), _nearest_probes(sent, k), f"probe bigint, rep bigint, vec {kind}, score double")
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "rep")
    near = near.withColumn("r", F.row_number().over(best)).where(f"r <= {k}").select("probe", "vec").toArrow()
    probe, y = near.column("probe").to_numpy(), matrix(near.column("vec"))
    found = [n for i in np.unique(probe) for n in forest.places(unit(x)[i], unit(y[probe == i]))]
    return int(np.quantile(found, recall, method="higher")) if found else 1


def _search_tiles(k: int) -> Callable:
    def run(batches):
        for tile in grouped(batches, "tile"):
            where = np.stack([tile.column(c).to_numpy() for c in ("leaf", "row_block", "query_block")], 1)
            query, rep, x = tile.column("query").to_numpy().astype(bool), tile.column("rep").to_numpy(), matrix(tile.column("vec"))
            for spot in np.unique(where, axis=0):  # different tiles may share a hash
                here = (where == spot).all(1)
                q, c = np.flatnonzero(here & query), np.flatnonzero(here & ~query)
                if not len(q) or not len(c):
                    continue
                scores = unit(x[q]) @ unit(x[c]).T
                n = min(len(c), k + 8)
                # Rounding may swap near-equal scores: take a few more, then the exact measure decides.
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(q), 1))
                worst = np.take_along_axis(scores, best, 1).min(1)
                ties = [np.union1d(b, np.flatnonzero(s >= w - 1e-12)) for b, s, w in zip(best, scores, worst)]
                qi = np.repeat(np.arange(len(q)), [len(t) for t in ties])
                ci = np.concatenate(ties)
                exact = cosines(x[q[qi]], x[c[ci]])
                order = np.lexsort((rep[c[ci]], -exact, qi))
                place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
                keep = order[place < k]
                yield pa.record_batch([pa.array(rep[q[qi[keep]]]), pa.array(rep[c[ci[keep]]]), pa.array(exact[keep])], names=["q", "c", "score"])

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, recall: float = RECALL, leaf_rows: int | None = None, sample: int = SAMPLE, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` nearest rows by cosine, itself left out.

    Vectors that are null, zero, hold null or non-finite components, or have
    another length than most, take no part, as queries or candidates; nor do rows
    whose id is null. Rows repeated with one id are one candidate a different
    vector. Fewer candidates than k: all that were found. Ties go to the smaller
    id. An empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(rows.sparkSession)
    src = usable(rows.where(F.col(id_col).isNotNull()), vec_col).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    # Equal vectors: the k + 1 smallest ids say all that a query can be given.
    first = src.select("id", "vec").withColumn("r", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(f"r <= {k + 1}")
    entries = cut(first.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vec", "ids"))
    asked = src.where("query").select("id", "vec").join(entries.select("vec", "rep"), "vec").select("id", "rep", "vec")
    asked = cut(asked)
    n = entries.count()
    if not n:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000))
    fitted = entries.where(place < max(1, min(1_000_000, sample * 1_000_000 // n + 1))).select("rep", "vec").toArrow().sort_by("rep")
    if not fitted.num_rows:
        fitted = entries.select("rep", "vec").limit(1).toArrow()
    forest = plant(unit(matrix(fitted.column("vec"))), n, trees, leaf_rows or min(LEAF_ROWS, max(LEAST_ROWS, n // LEAVES)), seed)
    most = visits_needed(entries, asked, forest, k, recall, probes, seed)
    sent = Shared(spark, forest)

    kind = entries.schema["vec"].dataType.simpleString()
    schema = f"rep bigint, vec {kind}, leaves array<bigint>"
    placed = map_batches(entries.select("rep", "vec"), _placed(sent), schema).select("rep", "vec", F.explode("leaves").alias("leaf"), F.lit(False).alias("query"))
    visits = map_batches(asked.select("rep", "vec").dropDuplicates(["rep"]), _visits(sent, most), schema).select("rep", "vec", F.explode("leaves").alias("leaf"), F.lit(True).alias("query"))
    visits = cut(visits)
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nr")).join(visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), "leaf")
    counts = small(cut(counts))
    spot = lambda m: F.pmod(F.xxhash64("rep"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    cols = ["leaf", "rep", "vec", "query"]
    both = placed.join(counts, "leaf").select(*cols, spot("nr").alias("row_block"), every("nq").alias("query_block"))
    both = both.unionAll(visits.join(counts, "leaf").select(*cols, every("nr").alias("row_block"), spot("nq").alias("query_block")))
    tiles = both.withColumn("tile", F.xxhash64("leaf", "row_block", "query_block")).repartition(F.col("tile")).sortWithinPartitions("tile")
    hits = map_batches(tiles.select("tile", "leaf", "row_block", "query_block", "query", "rep", "vec"), _search_tiles(k + 1), "q bigint, c bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    hits = hits.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}")
    named = hits.join(entries.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias(id_col))
    again = Window.partitionBy("q").orderBy(F.desc("score"), id_col)
    named = named.withColumn("r", F.row_number().over(again)).where(f"r <= {k + 1}")
    own = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    found = own.join(named, "q").where(F.col("query_id") != F.col(id_col))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select("query_id", "rank", id_col, "score")


def op2_rp_forest(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 50 == 0)

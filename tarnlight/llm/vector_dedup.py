"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points, in order. Reference points
(pivots) are a bounded sample of the vectors. Inverted lists hold, for each group
and each pair of pivots among a vector's first ``KEYED``, the vectors that have
that pair; two vectors of a list that share at least ``SHARED`` of their first
``LISTED`` pivots are candidates, and the cosine in double precision decides.

There are more pivots for more vectors (twice the square root, up to
``MOST_PIVOTS``), so lists, of which there are as many as pairs of pivots, stay short.

Equal vectors of a group are one entry with a count. Lists meet in tiles of
bounded size, worked through in slices. A link is counted in the first list its
two vectors share, so no pair is sent anywhere: a tile gives the links of each
vector and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, lists, map_batches, prepare, stars, table
from .vectors import cosines, matrix, unit, usable

#: Bounds of the pivots; about four times as many vectors are sampled for them.
PIVOTS, MOST_PIVOTS = 256, 4096
LISTED, KEYED, SHARED = 8, 4, 3
#: Cosine above which two sampled points do not both become pivots.
APART = 0.8
BLOCK = 2048
#: Rows of a tile compared with the others at a time, and numbers of vectors held for the exact measure.
SLICE, NUMBERS = 128, 1 << 22


def spread_out(points: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` points that are no near copies of one taken before. Copies among the pivots would be told
    apart by noise alone, and so would the vectors around them."""
    kept = np.zeros((0, points.shape[1]))
    for p in points:
        if len(kept) >= most:
            break
        if not (kept @ p > APART).any():
            kept = np.vstack([kept, p])
    return kept


def _described(pivots) -> Callable:
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            own = pivots.value
            near = np.argsort(-(unit(x) @ own.T), axis=1, kind="stable")[:, :LISTED]
            first = np.sort(near[:, :KEYED], axis=1)
            m = first.shape[1]
            pairs = [(i, j) for i in range(m) for j in range(i + 1, m)] or [(0, 0)]
            keys = np.sort(np.stack([first[:, i] * len(own) + first[:, j] for i, j in pairs], 1), axis=1)
            yield pa.record_batch([*batch.columns, lists(list(near.astype(np.int32))), lists(list(keys.astype(np.int32)))], names=[*batch.schema.names, "near", "keys"])

    return run


def _marks(near: np.ndarray) -> np.ndarray:
    """A bit for each pivot a vector lists, 64 a word."""
    out = np.zeros((len(near), int(near.max(initial=0)) // 64 + 1), np.uint64)
    for column in near.astype(np.int64).T:
        out[np.arange(len(near)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def _links(x, near, keys, p: np.ndarray, q: np.ndarray, key: int, least: float, above: np.ndarray | None):
    """Linked pairs of rows p and q whose first common list is ``key``; above: of one block with itself, only pairs in order."""
    bits = _marks(near)
    for i in range(0, len(p), SLICE):
        own = p[i : i + SLICE]
        shared = np.zeros((len(own), len(q)), np.uint8)
        for w in range(bits.shape[1]):
            shared += np.bitwise_count(bits[own, w][:, None] & bits[q, w][None, :])
        ok = shared >= min(SHARED, near.shape[1])
        if above is not None:
            ok &= above[own][:, None] < above[q][None, :]
        a, b = (v[k] for v, k in zip((own, q), np.nonzero(ok)))
        step = max(1, NUMBERS // x.shape[1])
        for j in range(0, len(a), step):
            c, d = a[j : j + step], b[j : j + step]
            first = np.full(len(c), np.iinfo(np.int64).max)
            for column in keys.T:  # the first list that both are in counts the pair
                both = (keys[d] == column[c][:, None]).any(1)
                first = np.where(both, np.minimum(first, column[c].astype(np.int64)), first)
            c, d = c[first == key], d[first == key]
            linked = cosines(x[c], x[d]) >= least
            if linked.any():
                yield c[linked], d[linked]


def _link_tiles(least: float) -> Callable:
    def run(batches):
        for tile in grouped(batches, "tile"):
            where = np.stack([tile.column(c).to_numpy() for c in ("group", "key", "i", "j")], 1)
            block, node, copies = (tile.column(c).to_numpy() for c in ("block", "node", "copies"))
            x, near, keys = (matrix(tile.column(c)) for c in ("vec", "near", "keys"))
            for spot in np.unique(where, axis=0):  # different tiles may share a hash
                here = np.flatnonzero((where == spot).all(1))
                same = spot[2] == spot[3]
                p, q = here[block[here] == spot[2]], here[block[here] == spot[3]]
                if not len(p) or not len(q) or same and len(p) < 2:
                    continue
                links, forest = np.zeros(len(node), np.int64), []
                for a, b in _links(x, near, keys, p, q, int(spot[1]), least, node if same else None):
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    forest.append(np.stack([node[a], node[b]]))
                    if len(forest) > 8:
                        forest = [_ends(forest)]
                if forest:
                    some, ends = np.flatnonzero(links), _ends(forest)
                    yield pa.record_batch([pa.array(node[some], pa.int64()), pa.array([None] * len(some), pa.int64()), pa.array(links[some], pa.int64())], names=["a", "b", "links"])
                    yield pa.record_batch([pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()), pa.array(np.zeros(ends.shape[1], np.int64))], names=["a", "b", "links"])

    return run


def _ends(forest: list[np.ndarray]) -> np.ndarray:
    made = stars(forest)
    return np.stack([made.column(i).to_numpy() for i in (0, 1)])


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", pivots: int | None = None, seed: int = 13) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept (id = component_id).

    Vectors link inside their group at a cosine of ``least`` or more. Rows whose
    group is null, and vectors that are null, zero, hold null or non-finite
    components, or have another length than most, link with nothing. Equal
    vectors of a group link with each other. Rows with a null id give a row with
    null component and kept false unless a smaller id is linked; rows repeated
    with one id get a row each. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = prepare(rows.sparkSession)
    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.col(group_col).alias("g"))
    good = usable(src.where(F.col("g").isNotNull()), "vec")
    entries = good.groupBy("g", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # Equal vectors may stand in two groups under one id: the node is the hash of both.
    entries = cut(entries.withColumn("node", F.xxhash64("g", "vec")).withColumn("group", F.xxhash64("g")))
    n = entries.count()
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, 2 * int(n**0.5)))
    sample = entries.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(10_000_000)) < max(1, 4 * pivots * 10_000_000 // max(1, n))).select("node", "vec").toArrow().sort_by("node") if n else None
    if sample is None or not sample.num_rows:
        sample = entries.select("node", "vec").limit(pivots).toArrow().sort_by("node") if n else None
    roots = None
    counted = None
    if sample is not None and sample.num_rows:
        points = unit(matrix(sample.column("vec")))
        points = spread_out(points[np.random.default_rng(seed).permutation(len(points))], pivots)
        sent = spark.sparkContext.broadcast(points)
        kind = entries.schema["vec"].dataType.simpleString()
        told = map_batches(entries.select("node", "group", "vec", "copies"), _described(sent), f"node bigint, group bigint, vec {kind}, copies bigint, near array<int>, keys array<int>")
        told = cut(told.select("*", F.explode(F.array_distinct("keys")).alias("key")))
        lists = told.groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("group"), F.col("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
        own = told.join(lists, ["group", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("tile", F.xxhash64("group", "key", "i", "j"))
        tiles = own.select("tile", "group", "key", "i", "j", "block", "node", "copies", "vec", "near", "keys").repartition(F.col("tile")).sortWithinPartitions("tile")
        found = cut(map_batches(tiles, _link_tiles(least), "a bigint, b bigint, links bigint"))
        counted = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        roots = components(found.where("b IS NOT NULL").select("a", "b"))
    else:
        counted = spark.createDataFrame([], "node bigint, links bigint")
        roots = spark.createDataFrame([], "node bigint, root bigint")
    at = entries.select("node", "id", "copies").join(roots, "node", "left").join(counted, "node", "left")
    at = cut(at.select("node", F.coalesce("root", "node").alias("root"), "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_id = at.groupBy("root").agg(F.min("id").alias("component_id"))
    named = at.join(least_id, "root").select("node", "n_links", "component_id")
    marked = src.withColumn("node", F.when(F.col("g").isNotNull() & F.col("vec").isNotNull(), F.xxhash64("g", "vec")))
    out = marked.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def op7_pivot_permutation(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Shared plumbing of the training-data operators: lineage cuts, bounded Arrow
batches, word hashing, and connected components of an edge table."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; bounds worker memory with very long texts.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that a checkpoint folder is set.

    The folder comes from ``spark.checkpoint.dir``. Only a local master, where all
    tasks share the machine, may do without: it gets a temporary one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def long_batches(spark: SparkSession, rows: int = 1 << 16):
    """While it lasts, Arrow batches have up to ``rows`` rows: for tables of a few numbers a row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = prepare(spark).conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and checkpoints that no table holds any more. It does so when the driver
    collects garbage, which many small rounds over large tables do not bring about."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_bytes(df: DataFrame, rows: int) -> int:
    """Bytes of ``rows`` rows in a broadcast hash table, strings taken at 40."""
    return rows * (32 + sum(48 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, which should be materialised and of flat columns, with a broadcast hint if it takes at most
    BROADCAST_BYTES; beyond that, joins with it shuffle and give the same rows."""
    return F.broadcast(df) if broadcast_bytes(df, df.count() if rows is None else rows) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new among the columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


class Shared:
    """A broadcast object of a class of this package, which executors need no copy of."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self.sent.value)


class WordHashes:
    """64-bit hashes of the words of texts, whole texts at a time.

    A word is a run of bytes marked in ``inside``. Its hash is a polynomial in an
    odd base over random byte values, modulo 2^64, taken from prefix sums of the
    whole text, then mixed.
    """

    def __init__(self, inside: np.ndarray) -> None:
        self.inside = inside
        self.values = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def of(self, data: bytes) -> np.ndarray:
        n = len(data)
        if n >= len(self.powers):
            for name, base in (("powers", 0x9E3779B97F4A7C15), ("inverse", pow(0x9E3779B97F4A7C15, -1, 2**64))):
                row = np.full(2 * n + 2, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        b = np.frombuffer(data, np.uint8)
        mark = np.zeros(n + 2, np.int8)
        mark[1:-1] = self.inside[b]
        edge = np.diff(mark)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[b] * self.powers[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


#: Bytes of words between ASCII white space; and of words of ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.array([i != 32 and not 9 <= i <= 13 for i in range(256)], np.int8)
LETTERS = np.array([i >= 128 or chr(i).isalnum() for i in range(256)], np.int8)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list column of one array a row, without going through its items."""
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` from batches sorted by it; runs may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


#: Edges (16 bytes each) that a task holds at a time when it thins out its share of a graph.
HELD_EDGES = 1 << 20


def stars(held: list[np.ndarray]) -> pa.RecordBatch:
    """Edges from each node to the smallest of its component among the held edges, by hooking and pointer jumping."""
    ends = np.concatenate(held, axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.record_batch([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def _thinned(batches):
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(np.stack([b.column(i).to_numpy() for i in (0, 1)]))
            n += b.num_rows
        if n >= HELD_EDGES:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


#: Edges dealt to a task in the second thinning.
TASK_EDGES = 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node reachable.

    Each task first replaces its share of the edges by stars that say the same; what
    is left, at most one edge a node and task, is dealt to tasks of about TASK_EDGES
    edges and thinned again. Alternating large-star and small-star steps do the
    rest: each is an aggregation with a map-side combine and an equi-join on the
    node, so a hub's neighbours are never gathered into one row, and nothing but
    the end is told to the driver.
    """
    every = edges.where("a <> b").select("a", "b")
    with long_batches(edges.sparkSession):
        pairs = cut(map_batches(every, _thinned, "u bigint, v bigint").distinct())
        tasks = max(1, -(-pairs.count() // TASK_EDGES))
        pairs = cut(map_batches(pairs.coalesce(tasks), _thinned, "u bigint, v bigint"))
    one = pairs.rdd.getNumPartitions() == 1  # what one task has thinned is done
    while not one:
        # A forest of stars: no end points on, and none has two roots.
        on = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").select("v")
        if on.unionAll(pairs.groupBy("u").count().where("count > 1").select("u")).isEmpty():
            break
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            large.join(down, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs = cut(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def numbered(df: DataFrame, count: str, index: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``index``; in steps, so that no long array is made."""
    step = 1 << 16
    n, block = F.col(count).cast("bigint"), fresh(df, "block")
    rows = df.where(n > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / step))))
    last = F.least(F.lit(step - 1).cast("bigint"), n - 1 - F.col(block) * step)
    return rows.withColumn(index, F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(index, F.col(index) + F.col(block) * step).drop(block)


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared checkpoint folder, and what removes the table."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{os.urandom(8).hex()}"

    def remove() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    try:
        df.write.parquet(path)
    except BaseException:
        remove()
        raise
    return spark.read.schema(df.schema).parquet(path), remove

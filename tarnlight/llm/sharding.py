"""Sharding by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets with seeded hashes: the shard
by rendezvous hashing of the id, the bucket inside the shard by a second hash, of id
and text, so that different records of one id do not pile up in one bucket.
Pass two shuffles each bucket in memory (Fisher-Yates) and lays the buckets of a
shard behind one another. A bucket's permutation comes from its seed and its
records alone, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, prepare, table

BUCKET_BYTES = 32 << 20


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 and 16 for the rest of the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is smallest; one more shard only takes rows into itself."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    pairs = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_min(F.array(*pairs))["s"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)) if n > 1 else ()):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with shard, grown_shard (with one shard more) and slot (gapless from 0 in its shard).

    A null id hashes as the empty string. Rows of one id share a shard, by the law,
    but lie in buckets by their text; rows equal in both tie, so their slots are
    theirs in any order, and they are the only ones that share a bucket for sure. A
    null text counts as empty; a very long one makes its bucket as long. Columns
    of those names in ``df`` are replaced, all others kept. An empty table gives an
    empty result.
    """
    spark = prepare(df.sparkSession)
    df = df.drop("shard", "grown_shard", "slot")
    at, cell = fresh(df, "at"), fresh(df, "bucket")
    total = df.agg(F.sum(record_size(F.col(text_col)))).first()[0] or 0
    buckets = max(1, -(-int(total) // (shards * bucket_bytes)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = (
        df.withColumn(at, F.xxhash64(key, F.lit(seed + 1)))
        .withColumn("shard", shard_of(F.col(id_col), shards, seed))
        .withColumn("grown_shard", shard_of(F.col(id_col), shards + 1, seed))
        .withColumn(cell, F.pmod(F.xxhash64(key, F.col(text_col), F.lit(seed + 2)), F.lit(buckets)).cast("int"))
    )
    ahead = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", cell).agg(F.count("*").alias("n"))
    starts = counts.select("shard", cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint").alias("start"))
    names = [c for c in rows.columns if c not in (at, cell)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, bucket, start = (right.column(c)[0].as_py() for c in ("shard", cell, "start"))
        tie = pa.array([hash_bytes(x) for x in left.column(text_col).to_pylist()], pa.int64())
        keys = pa.table({"a": left.column(at), "b": tie, "c": pc.cast(pc.is_null(left.column(text_col)), pa.int8())})
        order = pc.sort_indices(keys, [(c, "ascending") for c in "abc"])
        drawn = np.asarray(order)[fisher_yates(left.num_rows, np.random.default_rng([seed, shard, bucket]))]
        out = left.take(pa.array(drawn)).select(names)
        return out.append_column("slot", pa.array(np.arange(start, start + left.num_rows), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", slot bigint"
    return rows.groupBy("shard", cell).cogroup(starts.groupBy("shard", cell)).applyInArrow(run, schema)


def hash_bytes(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write what :func:`external_shuffle` gave, a folder a shard, rows in slot order within its files."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_external_shuffle(spark, sf_dir: str) -> DataFrame:
    done = external_shuffle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )

"""Tables an engine keeps for a session: written once, below the folder all executors share, and read by every query."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without and gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = (spark.sparkContext.applicationId, "folder")
    if key not in _KEPT:
        _KEPT[key] = tempfile.mkdtemp(prefix="tables")
    return _KEPT[key]


def version(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: changes when it does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at)
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def kept(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made of the table at ``of``: written at the first call of a session, read at later ones, made
    anew when the files at ``of`` have changed."""
    key = (spark.sparkContext.applicationId, name, of, version(spark, of))
    if key not in _KEPT:
        path = f"{folder(spark)}/{name}-{os.urandom(8).hex()}"
        make().write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut with a reliable checkpoint in the shared folder. For small tables between
    long expressions, which else are computed once for every column that reads them."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)

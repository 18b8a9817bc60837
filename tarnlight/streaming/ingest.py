"""Extensions beyond the batch engine: continuous ingest of chunks and event-time summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import index_tokens


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """Parquet files as they arrive, at most ``max_files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def chunk_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ready for the index: hash and token count."""
    return docs.select(key, F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, 16).alias("chunk_hash"), F.size(index_tokens(F.col(text))).alias("n_tokens"))


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "chunk_hash") -> StreamingQuery:
    """Append chunks whose hash the table at ``path`` does not hold yet; a batch that runs again writes nothing twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts and sums by event type and tumbling window; works on streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

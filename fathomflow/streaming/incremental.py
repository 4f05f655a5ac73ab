"""Structured Streaming forms of what is incremental in batch: indexing of new chunks, archives by month, call rates.

The windowed counts over event time are beyond the batch operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def index_new(stream: DataFrame, index_path: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Appends rows whose keys the index lacks; each batch is one anti join and one append, and reruns of a batch add nothing."""

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = batch.sparkSession.read.parquet(index_path).select(key)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            # The batch's range of keys is pushed down, so files and row groups of other keys are not read.
            low, high = fresh.agg(F.min(key), F.max(key)).first()
            fresh = fresh.join(known.where(F.col(key).between(low, high)), key, "left_anti")
        fresh.write.mode("append").parquet(index_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive_by_month(stream: DataFrame, at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of records to folders by month."""
    return stream.withColumn("month", F.date_format(at, "yyyy-MM")).writeStream.partitionBy("month").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")


def windowed_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): counts by tumbling windows of event time; rows later than the watermark are left out."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def over_rate(stream: DataFrame, at: str, key: str, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """(start, key, n): sliding windows, a tenth of their length apart, in which a key calls more often than allowed."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    slide = max(1, seconds // 10)
    counts = timed.groupBy(F.window("_at", f"{seconds} seconds", f"{slide} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(F.col("w.start").alias("start"), key, "n")

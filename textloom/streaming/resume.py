"""Incremental processing with Structured Streaming: file sources, watermarked windows, resumable exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def process_available(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str]) -> None:
    """Runs ``step`` on all input not processed yet and appends its rows to the Parquet folder ``out``.

    Offsets are in ``checkpoint``; each micro-batch is written to its own folder batch=N in overwrite mode, so a batch that is repeated
    after a failure replaces itself. Rows of keys from other batches are left out by one join with the keys of all folders but its
    own; the plan is the same for every batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        from ..sources.readers import path_exists

        spark = batch.sparkSession
        new = step(batch).dropDuplicates(keys)
        if path_exists(spark, out):
            earlier = spark.read.schema(T.StructType([*new.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
            new = new.join(earlier.filter(F.col("batch") != number).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, length: str, delay: str, *keys: str, slide: str | None = None, value: Column | None = None) -> DataFrame:
    """Counts (and sums) per time window and keys; rows later than ``delay`` behind the watermark are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    return stream.withWatermark(time, delay).groupBy(window, *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    """Counts per session and keys; a row ``gap`` or more after the one before opens a session. Spark joins rows that are exactly the gap
    apart, so it is given the gap less a microsecond, the step of timestamps."""
    counts = stream.withWatermark(time, delay).groupBy(F.session_window(time, f"{gap} -1 microsecond"), *keys).agg(F.count("*").alias("n"))
    window = F.col("session_window")
    return counts.withColumn("session_window", F.struct(window["start"].alias("start"), (window["end"] + F.expr("INTERVAL 1 MICROSECOND")).alias("end")))

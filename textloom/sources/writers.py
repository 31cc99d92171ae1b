"""Sinks: JSON lines, Parquet rankings with fixed schema, resumable shards, CSV results, spreadsheets where available."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKING = {"question_id": "long", "index_id": "string", "doc_id": "long", "rank": "int", "score": "double", "is_gold": "boolean"}


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_ids(df: DataFrame, path: str) -> None:
    """Appends ids to a checkpoint folder of text files; a Spark commit is all or nothing."""
    df.select(F.col("person_id").cast("string")).write.mode("append").text(path)


def write_ranking(df: DataFrame, path: str) -> DataFrame:
    """Ranked rows of fixed types, zstd, partitioned by retriever and search space, sorted by rank so that a filter on rank skips
    row groups. Returns (and writes beside them) what was written: (retriever, search_space, n_rows, n_questions, state)."""
    spark = df.sparkSession
    fixed = df.select("retriever", "search_space", *[F.col(c).cast(t).alias(c) for c, t in RANKING.items()])
    fixed.repartition("retriever", "search_space").sortWithinPartitions("rank", "question_id").write.mode("overwrite").option("compression", "zstd").partitionBy("retriever", "search_space").parquet(path)
    facts = spark.read.parquet(path).groupBy("retriever", "search_space").agg(F.count("*").alias("n_rows"), F.countDistinct("question_id").alias("n_questions"), F.bit_xor(F.xxhash64("question_id", "doc_id", "rank")).alias("state"))
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/_facts")  # a row for each pair; readers of the ranking skip the folder
    return spark.read.schema(facts.schema).json(f"{path}/_facts")


def write_missing(df: DataFrame, path: str, keys: list[str], partitions: list[str] | None = None) -> DataFrame:
    """Appends the rows whose keys the Parquet folder does not hold yet, and returns them: a rerun resumes."""
    from .readers import path_exists

    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if path_exists(spark, path) else df
    writer = new.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return new


def shard_state(df: DataFrame, keys: list[str]) -> DataFrame:
    """(shard, n, state): how many rows each shard holds and a checksum of their keys that does not depend on their order."""
    return df.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys)).alias("state"))


def write_shards(df: DataFrame, path: str, keys: list[str], shards: int) -> list[int]:
    """Parquet folders shard=0, 1 .. by a hash of the keys. Shards that are there whole (readable, with the right keys) stay; missing,
    incomplete and corrupt ones are written anew. Returns the numbers of those written."""
    from .readers import path_exists

    spark = df.sparkSession
    dealt = df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    wanted = shard_state(dealt, keys)
    if path_exists(spark, path):
        there = spark.read.schema(dealt.schema).option("ignoreCorruptFiles", "true").parquet(path)
        wanted = wanted.join(shard_state(there, keys), ["shard", "n", "state"], "left_anti")
    bad = sorted(r["shard"] for r in wanted.select("shard").collect())  # at most the number of shards
    if bad:
        dealt.filter(F.col("shard").isin(bad)).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return bad


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV files with headers; ``files`` limits their number (1 for a table that is read as one file)."""
    rows = df.coalesce(files) if files else df
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(blocks: DataFrame, path: str, order: str, column: str = "block") -> None:
    """One text file of ordered blocks (for single-person exports); no block raises."""
    if blocks.isEmpty():
        raise ValueError("nothing to export")
    blocks.repartition(1).sortWithinPartitions(order).select(column).write.mode("overwrite").text(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which a cluster shares; where that is unset, in the warehouse."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{conf}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a fresh shared path and reads it back, for tables that a plan reads more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_metadata(spark: SparkSession, **facts: str) -> DataFrame:
    """One row of run facts, the engine version and the UTC time."""
    row = {**facts, "engine_version": spark.version, "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a path if it exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def prepare_output(spark: SparkSession, folder: str, outputs: list[str], checkpoint: str, overwrite: bool = False, reset_checkpoint: bool = False) -> None:
    """Before a run: removes its outputs, or its checkpoint, where asked to; else the run appends."""
    if overwrite:
        for name in outputs:
            delete(spark, f"{folder}/{name}")
    if reset_checkpoint:
        delete(spark, f"{folder}/{checkpoint}")

"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as quality
from .decontamination import contamination
from .near_dedup import one_of_each_class
from .pii import mask_pii
from .piece_sampling import add_pieces
from .tables import discard_scratch, drop_finished_shuffles, scratch, scratch_mark, table, written

#: Up to so many ids of contaminated documents are sent to all executors; beyond, documents are shuffled.
BROADCAST_IDS = 500_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    ratio = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ratio, keep_columns=True).filter("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a window that matches a benchmark item (rows of one doc_id go together)."""
    found = written(contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__leaked")), "left_anti")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts (n_chars follows the new text)."""
    out = mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds sampled SentencePiece ids, their number and whether they decode to the text."""
    return add_pieces(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", remove_personal_data),
    ("SentencePiece sampling", sample_pieces),
]


def apply_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and reread; what a stage has left in the shared folder goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path, mark = scratch(spark, "stage"), scratch_mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            drop_finished_shuffles(spark)
            discard_scratch(spark, mark)
    return docs

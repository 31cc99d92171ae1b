"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, personal data, SentencePiece sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.stages import STAGES, apply_stages

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: No SQL: the stages run fitted models, hashing and tokenizers. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet and reread as the next one's input."""
    return apply_stages(spark, sf_dir)

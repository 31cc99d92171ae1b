"""Model interfaces: generators, encoders, readers, tokenizers, scorers, judges.

A model is a factory that builds a callable once per worker; rows reach it in Arrow batches through ``mapInPandas``. Deterministic
stand-ins (hashed vectors, overlap reader, recorded responses) make every query run without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(rows: DataFrame, factory: Callable[[], Batch], schema: str) -> DataFrame:
    """Runs ``factory()``'s callable over all rows; it is built once per task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or factory()
            yield model(batch)

    return rows.mapInPandas(run, schema)


def recorded_responses(prompts: DataFrame, records: DataFrame) -> DataFrame:
    """A generator that replays recorded JSON by (person_id, chunk_id); a prompt without a record gets null."""
    return prompts.join(records.select("person_id", "chunk_id", "response"), ["person_id", "chunk_id"], "left")


def hashed_encoder(rows: DataFrame, tokens, size: int = 64) -> DataFrame:
    """A native stand-in encoder: token counts hashed to ``size`` dimensions. Adds vector array<double>."""
    at = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size).cast("int"))
    return rows.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")))


def overlap_logits(rows: DataFrame, question_tokens, context_tokens) -> DataFrame:
    """A native stand-in reader: (key, window, pos, start_logit, end_logit, in_context) with 1 for tokens of the question, 0 else."""
    pos = rows.select("key", F.lit(0).alias("window"), question_tokens.alias("q"), F.posexplode(context_tokens).alias("pos", "t"))
    hit = F.array_contains("q", F.col("t")).cast("double")
    return pos.select("key", "window", "pos", hit.alias("start_logit"), hit.alias("end_logit"), F.lit(True).alias("in_context"))

"""Extractive reading: sliding windows, best spans, reach. Readers themselves are interfaces (``plans.models``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(sequences: DataFrame, capacity: Column, overlap: int) -> DataFrame:
    """(key, window, start, end) token windows of sequences (key, n_tokens): each of ``capacity``, neighbours share ``overlap``
    tokens, the last one ends the sequence."""
    step = capacity - overlap
    last = F.greatest(F.ceil((F.col("n_tokens") - capacity) / step), F.lit(0)).cast("long")
    rows = sequences.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("key", "window", (F.col("window") * step).alias("start"), F.least(F.col("window") * step + capacity, F.col("n_tokens")).alias("end"))


def best_spans(positions: DataFrame, max_length: int = 64) -> DataFrame:
    """(key, window, i, j, score): the best span of each window of positions (key, window, pos, start_logit, end_logit, in_context).

    Greatest start + end with i <= j < i + max_length inside the context; ties: the shortest, then the first. The band of j is
    reached by windows over the ordered positions, not by a join of all pairs: for each i the best end among the next
    ``max_length`` positions.
    """
    rows = positions.filter("in_context")
    ahead = Window.partitionBy("key", "window").orderBy("pos").rangeBetween(0, max_length - 1)
    best_end = F.min(F.struct((-F.col("end_logit")).alias("low"), F.col("pos").alias("j"))).over(ahead)
    spans = rows.withColumn("e", best_end).select("key", "window", F.col("pos").alias("i"), F.col("e.j").alias("j"), (F.col("start_logit") - F.col("e.low")).alias("score"))
    order = F.struct((-F.col("score")).alias("low"), (F.col("j") - F.col("i")).alias("length"), "i", "j", "score")
    return spans.groupBy("key", "window").agg(F.min(order).alias("b")).select("key", "window", "b.i", "b.j", "b.score")


def best_window(spans: DataFrame) -> DataFrame:
    """The best window of each key; the earliest on ties."""
    order = F.struct((-F.col("score")).alias("low"), "window", "i", "j", "score")
    return spans.groupBy("key").agg(F.min(order).alias("b")).select("key", "b.window", "b.i", "b.j", "b.score")


def visits_reached(spans: Column, windows: Column) -> Column:
    """Ids of the visit spans (visit_index, start, end) that overlap a window (start, end) of the same row."""
    hit = F.filter(spans, lambda s: F.exists(windows, lambda w: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    return F.transform(hit, lambda s: s["visit_index"])


def precheck(scores: DataFrame, least_f1: float = 40.0) -> DataFrame:
    """One row: mean over examples of the best em and f1 over their gold answers, in percent, and whether f1 exceeds the bound."""
    best = scores.groupBy("example_id").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    return best.agg((100 * F.avg("em")).alias("em"), (100 * F.avg("f1")).alias("f1")).withColumn("passed", F.col("f1") > least_f1)

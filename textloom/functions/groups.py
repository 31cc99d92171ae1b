"""Group labels of visit counts, candidates and gold counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reporting_group(n: Column) -> Column:
    return F.when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1000, "101-1000").otherwise(">1000")


def sampling_group(n: Column) -> Column:
    """Null outside 2..1000: such timelines are not sampled."""
    return F.when(n.between(2, 10), "2-10").when(n.between(11, 100), "11-100").when(n.between(101, 1000), "101-1000")


def candidate_bin(n: Column) -> Column:
    return F.when(n <= 10, "<=10").when(n <= 30, "11-30").when(n <= 100, "31-100").when(n <= 300, "101-300").otherwise(">300")


def gold_stratum(g: Column) -> Column:
    return F.when(g == 1, "1").when(g == 2, "2").otherwise(">=3")


def condition_id(retriever: Column, space: Column) -> Column:
    return F.concat_ws("@", retriever, space)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")

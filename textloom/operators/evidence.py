"""Alignment of quoted evidence with the record it is taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_evidence, snippet_segments, unquoted


def snippet_match(snippet: Column, original: Column, ratio: float = 1.0) -> Column:
    """struct(matched, detail): containment of the whole normalised snippet, else of its segments between ellipses."""
    s = unquoted(for_evidence(snippet))
    return prepared_match(s, snippet_segments(s), for_evidence(original), ratio)


def prepared_match(s: Column, parts: Column, o: Column, ratio: float = 1.0) -> Column:
    """``snippet_match`` of a normalised snippet, its segments and a normalised original."""
    n, hits = F.size(parts), F.size(F.filter(parts, lambda p: F.contains(o, p)))
    state = F.when(s == "", -3).when(F.contains(o, s), -2).when(n == 0, -1).otherwise(hits)
    counted = lambda k: F.concat(k.cast("string"), F.lit("_of_"), n.cast("string"))
    matched = F.when(state == -2, True).when(state < 0, False).otherwise(F.try_divide(state, n) >= ratio)
    detail = (
        F.when(state == -3, "empty_snippet").when(state == -2, "exact_match").when(state == -1, "empty_or_too_short_after_split")
        .when(matched, F.concat(F.lit("ellipsis_segment_match_"), counted(state))).otherwise(F.concat(F.lit("partial_segment_match_"), counted(state))))
    return F.struct(matched.alias("matched"), detail.alias("detail"))


def align_evidence(evidence: DataFrame, visits: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Adds matched, match_type, matched_visit_index and n_candidates to evidence rows.

    ``evidence``: evidence_id (unique), person_id, visit_datetime, original_visit_index (may be null), evidence_snippet and more;
    ``visits``: person_id, visit_datetime, visit_index, text. Candidates share person and time (an equi-join); the one of equal
    index is preferred, then the first by index whose text matches. The failure of the indexed candidate is what is reported if
    no candidate matches.
    """
    sides = visits.select("person_id", "visit_datetime", F.col("visit_index").alias("c_index"), for_evidence(F.col("text")).alias("c_text"))
    asked = evidence.select("evidence_id", "person_id", "visit_datetime", "original_visit_index", unquoted(for_evidence(F.col("evidence_snippet"))).alias("s"))
    asked = asked.withColumn("parts", snippet_segments(F.col("s")))
    pairs = asked.join(sides, ["person_id", "visit_datetime"]).withColumn("m", prepared_match(F.col("s"), F.col("parts"), F.col("c_text"), ratio))
    own = F.col("c_index") == F.col("original_visit_index")
    best = pairs.groupBy("evidence_id").agg(
        F.count("*").alias("n"), F.min(F.when(own, F.struct("c_index", "m"))).alias("own"), F.min(F.when(F.col("m.matched"), F.struct("c_index", "m"))).alias("first"))
    joined = evidence.join(best, "evidence_id", "left")
    own_ok, own_there, any_ok = F.coalesce(F.col("own.m.matched"), F.lit(False)), F.col("own").isNotNull(), F.col("first").isNotNull()
    kind = (
        F.when(F.col("n").isNull(), "no_original_visit_with_same_datetime")
        .when(own_ok, F.concat(F.lit("matched_by_datetime_and_original_visit_index__"), F.col("own.m.detail")))
        .when(any_ok, F.concat(F.lit("matched_by_datetime_only__"), F.col("first.m.detail")))
        .when(own_there, F.concat(F.lit("datetime_and_index_found_but_snippet_not_found__"), F.col("own.m.detail")))
        .otherwise("datetime_found_but_snippet_not_found"))
    index = F.when(own_ok, F.col("own.c_index")).when(any_ok, F.col("first.c_index")).when(own_there, F.col("own.c_index"))
    return joined.select(*evidence.columns, (own_ok | any_ok).alias("matched"), kind.alias("match_type"), index.alias("matched_visit_index"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def flag_questions(questions: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds evidence_match: whether all evidence of (person_id, qa_index) matched; false without evidence rows."""
    summary = checks.groupBy("person_id", "qa_index").agg(F.bool_and("matched").alias("m"))
    return questions.join(summary, ["person_id", "qa_index"], "left").withColumn("evidence_match", F.coalesce("m", F.lit(False))).drop("m")


def aligned_only(questions: DataFrame) -> DataFrame:
    return questions.filter(F.coalesce(F.col("evidence_match"), F.lit(False)))


def gold_visits(evidence: DataFrame, visits: DataFrame) -> DataFrame:
    """(person_id, qa_index, gold_ids): sorted distinct original indices.

    An index outside the timeline, a time that differs from the visit's, or a missing index raises: there is no fallback to the
    chunk-relative index.
    """
    own = visits.select("person_id", F.col("visit_index").alias("original_visit_index"), F.col("visit_datetime").alias("own_time"))
    joined = evidence.join(own, ["person_id", "original_visit_index"], "left")
    problem = (
        F.when(F.col("original_visit_index").isNull(), "missing original_visit_index")
        .when(F.col("own_time").isNull(), "visit index outside the timeline")
        .when(~F.col("own_time").eqNullSafe(F.col("visit_datetime")), "visit time differs"))
    where = F.format_string(" (person %s, question %s)", F.col("person_id").cast("string"), F.col("qa_index").cast("string"))
    checked = joined.withColumn("original_visit_index", F.when(problem.isNull(), F.col("original_visit_index")).otherwise(F.raise_error(F.concat(problem, where)).cast("int")))
    return checked.groupBy("person_id", "qa_index").agg(F.array_sort(F.collect_set("original_visit_index")).alias("gold_ids"))

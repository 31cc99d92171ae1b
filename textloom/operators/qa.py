"""Question/answer candidates: parsing, normalisation, deterministic filters, duplicates, roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any, duplicate_key, strip, words

# Reasoning types and the words that signal change or over-inference.
REASONING_TYPES = ("before_after", "progression", "first_last_occurrence", "recurrence_count", "trend", "comparison_across_visits", "treatment_response", "other")
MULTI_VISIT_TYPES = ("before_after", "progression", "recurrence_count", "trend", "comparison_across_visits", "treatment_response")
CHANGE_WORDS = (
    "change", "changed", "improve", "improved", "improvement", "worsen", "worsened", "progress", "progressed", "trend", "over time", "later", "earlier",
    "first", "last", "subsequent", "after", "before", "compare", "comparison", "evolve", "evolution", "ultimately", "response", "recurrence",
)
INFERENCE_WORDS = ("suggests", "implies", "likely", "overall", "probably", "supports", "does not support", "consistent with", "indicates")

EVIDENCE = T.StructType([T.StructField("visit_index", T.IntegerType()), T.StructField("evidence_snippet", T.StringType())])
CANDIDATE = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("reasoning_type", T.StringType()),
    T.StructField("difficulty", T.StringType()), T.StructField("evidence", T.ArrayType(EVIDENCE)), T.StructField("is_temporal", T.BooleanType()), T.StructField("temporal_signal", T.StringType()),
])
RESPONSE = T.StructType([T.StructField("qas", T.ArrayType(CANDIDATE))])


@dataclass(frozen=True)
class FilterConfig:
    min_question_words: int = 4
    strict_temporal: bool = False
    multi_visit_for_temporal: bool = True


def parse_responses(responses: DataFrame) -> DataFrame:
    """Rows (person_id, chunk_id, position, question, ...) of generator responses (person_id, chunk_id, qa_cap, response JSON).

    More items than the cap, fields that the schema does not have, or text that is no such JSON, is a failed chunk (``chunk_failures``) and gives no rows.
    """
    ok = _parsed(responses).filter("failure is null")
    return ok.select("person_id", "chunk_id", F.posexplode("r.qas").alias("position", "q")).select("person_id", "chunk_id", "position", "q.*")


def chunk_failures(responses: DataFrame) -> DataFrame:
    return _parsed(responses).filter("failure is not null").select("person_id", "chunk_id", F.concat(F.lit("chunk_generation_failed: "), "failure").alias("reason"))


def _parsed(responses: DataFrame) -> DataFrame:
    r = F.from_json("response", RESPONSE)
    fields = F.array(*[F.lit(f.name) for f in CANDIDATE])
    items = F.from_json(F.get_json_object("response", "$.qas"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    unknown = F.exists(items, lambda m: F.size(F.array_except(F.map_keys(m), fields)) > 0) | (F.size(F.array_except(F.json_object_keys("response"), F.array(F.lit("qas")))) > 0)
    failure = F.when(F.col("r.qas").isNull(), "invalid response").when(F.coalesce(unknown, F.lit(False)), "unknown fields").when(F.size("r.qas") > F.col("qa_cap"), "too many items")
    return responses.withColumn("r", r).withColumn("failure", failure)


def normalise_candidates(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Trimmed fields, defaults, and evidence with the original index and time of its window visit.

    Evidence needs an index inside the window and a non-empty snippet; repeats of (index, snippet) stay once, in order. Items
    without question, answer or evidence are dropped. ``windows``: person_id, chunk_id, visit_index, original_visit_index, visit_ts.
    """
    visit = F.struct("visit_index", "original_visit_index", "visit_ts")
    lookup = windows.groupBy("person_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("visit_index", visit))).alias("at"))
    joined = candidates.join(lookup, ["person_id", "chunk_id"])
    plain = F.array_distinct(F.transform("evidence", lambda e: F.struct(e["visit_index"].alias("visit_index"), strip(F.coalesce(e["evidence_snippet"], F.lit(""))).alias("evidence_snippet"))))
    valid = F.filter(plain, lambda e: e["visit_index"].isNotNull() & F.map_contains_key(F.col("at"), F.coalesce(e["visit_index"], F.lit(-1))) & (e["evidence_snippet"] != ""))
    full = F.transform(valid, lambda e: F.struct(
        e["visit_index"].alias("visit_index"), F.try_element_at("at", e["visit_index"])["original_visit_index"].alias("original_visit_index"),
        F.date_format(F.try_element_at("at", e["visit_index"])["visit_ts"], "yyyy-MM-dd HH:mm:ss").alias("visit_datetime"), e["evidence_snippet"].alias("evidence_snippet")))
    out = joined.select(
        "person_id", "chunk_id", "position", strip(F.coalesce("question", F.lit(""))).alias("question"), strip(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.coalesce("reasoning_type", F.lit("other")).alias("reasoning_type"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        full.alias("evidence"), F.coalesce("is_temporal", F.lit(False)).alias("is_temporal"), F.coalesce("temporal_signal", F.lit("")).alias("temporal_signal"))
    return out.filter("question != '' and answer != '' and size(evidence) > 0")


def in_time_order(times: Column) -> Column:
    """Whether the non-null times of an array are listed in order."""
    known = F.filter(times, lambda t: t.isNotNull())
    return known == F.array_sort(known)


def rejection_reasons(config: FilterConfig = FilterConfig()) -> Column:
    """Array of reasons, in fixed order, over question, answer, reasoning_type, is_temporal and evidence (array of structs with
    evidence_snippet and visit_datetime). Without evidence the later checks are not made."""
    question, answer, kind = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit(""))), F.col("reasoning_type")
    temporal, evidence = F.coalesce("is_temporal", F.lit(False)), F.col("evidence")
    n = F.when(evidence.isNull(), 0).otherwise(F.size(evidence))
    quoted = F.array_join(F.transform(evidence, lambda e: F.coalesce(e["evidence_snippet"], F.lit(""))), " ")
    several = temporal & contains_any(F.concat_ws(" ", question, answer), CHANGE_WORDS)
    if config.multi_visit_for_temporal:
        several = several | kind.isin(*MULTI_VISIT_TYPES)
    some = n > 0
    rules = [
        (F.size(words(question)) < config.min_question_words, "question_too_short"),
        (answer == "", "answer_empty"),
        (~some, "no_evidence"),
        (some & ~temporal & F.lit(config.strict_temporal), "non_temporal_removed"),
        (some & temporal & ~kind.isin(*REASONING_TYPES), "temporal_reasoning_type_unexpected"),
        (some & several & (n < 2), "insufficient_evidence_for_temporal_reasoning"),
        (some & ~in_time_order(F.transform(evidence, lambda e: F.try_to_timestamp(e["visit_datetime"]))), "evidence_not_in_time_order"),
        (some & contains_any(answer, INFERENCE_WORDS) & ~contains_any(quoted, INFERENCE_WORDS), "possible_over_inference"),
    ]
    return F.filter(F.array(*[F.when(c, r) for c, r in rules]), lambda r: r.isNotNull())


def filter_candidates(candidates: DataFrame, config: FilterConfig = FilterConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reasons)."""
    judged = candidates.withColumn("reasons", rejection_reasons(config))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def drop_duplicate_questions(candidates: DataFrame) -> DataFrame:
    """The first of each (normalised question, first 120 characters of the normalised answer) per person, by chunk and position."""
    order = Window.partitionBy("person_id", "k").orderBy("chunk_id", "position")
    keyed = candidates.withColumn("k", duplicate_key(F.col("question"), F.col("answer")))
    return keyed.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "k")


def numbered(candidates: DataFrame) -> DataFrame:
    """Adds qa_index, after duplicates are gone."""
    return candidates.withColumn("qa_index", F.row_number().over(Window.partitionBy("person_id").orderBy("chunk_id", "position")) - 1)


def person_records(candidates: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records: person_id, num_total_visits, num_chunks, strategies, qas; errors: persons without a question).

    ``candidates`` carry strategy; ``persons``: person_id, n_visits, n_chunks.
    """
    fields = [c for c in candidates.columns if c not in ("person_id", "qa_index")]
    grouped = candidates.groupBy("person_id").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"), F.array_sort(F.collect_list(F.struct("qa_index", *fields))).alias("qas"))
    joined = persons.join(grouped, "person_id", "left")
    records = joined.filter("qas is not null").select("person_id", F.col("n_visits").alias("num_total_visits"), F.col("n_chunks").alias("num_chunks"), "strategies", "qas")
    return records, joined.filter("qas is null").select("person_id", F.lit("no valid question").alias("error"))


def flattened(records: DataFrame) -> DataFrame:
    """One row per question; evidence as JSON text."""
    rows = records.select("person_id", "num_total_visits", "num_chunks", F.posexplode("qas").alias("qa_index", "q"))
    return rows.select("person_id", "qa_index", "num_total_visits", "num_chunks", F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), F.col("q.reasoning_type").alias("reasoning_type"), F.col("q.difficulty").alias("difficulty"), F.to_json("q.evidence").alias("evidence"))


def run_statistics(records: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: n_succeeded, n_failed, n_total, n_questions."""
    ok = records.agg(F.count("*").alias("n_succeeded"), F.coalesce(F.sum(F.size("qas")), F.lit(0)).alias("n_questions"))
    return ok.crossJoin(errors.agg(F.count("*").alias("n_failed"))).withColumn("n_total", F.col("n_succeeded") + F.col("n_failed"))  # two one-row tables

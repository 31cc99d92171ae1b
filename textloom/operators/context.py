"""Token-budgeted contexts and what of the gold survives trimming.

Tokenizers are interfaces: ``char`` and ``word`` are native expressions; any other one is a pandas function (see ``plans.models``)
that supplies token counts and prefixes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

SEPARATOR = "\n\n"


@dataclass(frozen=True)
class Tokenizer:
    """``count`` gives the number of tokens of a text, ``head`` its first k tokens as text."""

    name: str
    count: Callable[[Column], Column]
    head: Callable[[Column, Column], Column]


CHAR = Tokenizer("char", lambda t: F.length(t).cast("long"), lambda t, k: F.substring(t, F.lit(1), k.cast("int")))
WORD = Tokenizer("word", lambda t: F.size(words(t)).cast("long"), lambda t, k: F.array_join(F.slice(words(t), F.lit(1), k.cast("int")), " "))


def header(index: Column, time: Column) -> Column:
    return F.concat(F.lit("[Visit "), index.cast("string"), F.lit(" | "), time, F.lit("]"))


def assembled(blocks: Column, text: str) -> Column:
    """Blocks (structs with header and a text field) as header, line break, text; joined by an empty line."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["header"], F.lit("\n"), b[text])), SEPARATOR)


def _total(blocks: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(blocks, lambda b: value(b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def build_contexts(selection: DataFrame, visits: DataFrame, budget: int, tokenizer: Tokenizer = CHAR, headers_alone: bool = False) -> DataFrame:
    """One row per selection key with the context and its metadata.

    ``selection``: key, person_id, visit_index (a row per selected visit), ``visits``: person_id, visit_index, visit_datetime, text.
    Blocks are chronological. Above the budget each text keeps floor(tokens * available / total) tokens from its start, where
    available is the budget less headers and separators; headers stay whole. Duplicate or unknown visits raise, and so do headers beyond
    the budget, unless ``headers_alone``: then such a context is its headers with empty texts, over the budget.
    """
    t = tokenizer
    rows = selection.join(visits.select("person_id", "visit_index", "visit_datetime", "text"), ["person_id", "visit_index"], "left")
    text = F.when(F.col("visit_datetime").isNull(), F.raise_error(F.lit("visit outside the timeline"))).otherwise(F.coalesce("text", F.lit("")))
    block = F.struct("visit_index", header(F.col("visit_index"), F.col("visit_datetime")).alias("header"), text.cast("string").alias("text"), t.count(F.coalesce("text", F.lit(""))).alias("before"))
    out = rows.groupBy("key", "person_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    ids = F.transform("b", lambda x: x["visit_index"])
    out = out.withColumn("ids", F.when(F.size(F.array_distinct(ids)) == F.size(ids), ids).otherwise(F.raise_error(F.lit("duplicate visits in a selection")).cast("array<int>")))
    out = out.withColumn("full", assembled(F.col("b"), "text")).withColumn("total_before", t.count(F.col("full")))
    out = out.withColumn("fixed", _total(F.col("b"), lambda x: t.count(F.concat(x["header"], F.lit("\n")))) + (F.size("b") - 1) * t.count(F.lit(SEPARATOR)))
    out = out.withColumn("truncated", F.col("total_before") > budget).withColumn("sum_before", _total(F.col("b"), lambda x: x["before"]))
    beyond = F.lit(0).cast("long") if headers_alone else F.raise_error(F.lit("headers and separators exceed the budget")).cast("long")
    room = F.when(F.lit(budget) >= F.col("fixed"), F.lit(budget) - F.col("fixed")).otherwise(beyond)
    out = out.withColumn("available", F.when(F.col("truncated"), room))
    keep = lambda x: F.when(F.col("sum_before") > 0, F.floor(x["before"] * F.col("available") / F.nullif(F.col("sum_before"), F.lit(0)))).otherwise(F.lit(0))

    def trimmed(x: Column) -> Column:
        cut = F.when(F.col("truncated") & (keep(x) < x["before"]), t.head(x["text"], keep(x))).otherwise(x["text"])
        return F.struct(x["visit_index"].alias("visit_index"), x["header"].alias("header"), x["before"].alias("before"), cut.alias("kept"))

    out = out.withColumn("k", F.transform("b", trimmed))
    out = out.withColumn("context", F.when(F.col("truncated"), assembled(F.col("k"), "kept")).otherwise(F.col("full")))
    out = out.withColumn("after", F.transform("k", lambda x: F.when(F.col("truncated"), t.count(x["kept"])).otherwise(x["before"])))
    reach = F.filter(F.transform(F.arrays_zip("ids", "after"), lambda z: F.when(z["after"] >= 1, z["ids"])), lambda i: i.isNotNull())
    return out.select(
        "key", "person_id", F.col("ids").alias("selected_ids"), reach.alias("reaching_ids"), F.col("total_before").alias("tokens_before"), t.count(F.col("context")).alias("tokens_after"),
        F.transform("b", lambda x: x["before"]).alias("visit_tokens_before"), F.col("after").alias("visit_tokens_after"), F.col("fixed").alias("header_tokens"), "truncated",
        F.lit(budget).cast("long").alias("budget"), F.lit(t.name).alias("tokenizer"), "context", F.sha2("context", 256).alias("context_sha256"))


def survival(contexts: DataFrame, gold: DataFrame, reaching: str = "reaching_ids") -> DataFrame:
    """Adds n_gold, n_gold_surviving, fully_survived (selected and untrimmed, and reaching), and gold tokens before and after.

    ``gold``: key, gold_ids. With another ``reaching`` column (a reader's own reach) the same rules hold for that reader.
    """
    joined = contexts.join(gold.select("key", "gold_ids"), "key", "left")
    place = F.map_from_entries(F.transform(F.arrays_zip("selected_ids", "visit_tokens_before", "visit_tokens_after"), lambda z: F.struct(z["selected_ids"].alias("k"), F.struct(z["visit_tokens_before"].alias("b"), z["visit_tokens_after"].alias("a")).alias("v"))))
    joined = joined.withColumn("place", place)
    at = lambda g: F.try_element_at("place", g)
    whole = F.forall("gold_ids", lambda g: F.coalesce(at(g)["a"] == at(g)["b"], F.lit(False)) & ((at(g)["b"] == 0) | F.array_contains(reaching, g)))
    total = lambda f: F.aggregate(F.transform("gold_ids", lambda g: F.coalesce(at(g)[f], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select(
        *contexts.columns, "gold_ids", F.size("gold_ids").cast("long").alias("n_gold"), F.size(F.array_intersect("gold_ids", reaching)).cast("long").alias("n_gold_surviving"),
        whole.alias("fully_survived"), total("b").alias("gold_tokens_before"), total("a").alias("gold_tokens_after"))


def visit_spans(contexts: DataFrame) -> DataFrame:
    """(key, visit_index, start, end): character span of each kept text, by prefix sums of header and text lengths (char tokens).
    The header of a visit is what lies between the end of the one before and its own text: its length is the visit's share of
    header_tokens, found from the context itself by the header pattern."""
    rows = contexts.select("key", "context", F.arrays_zip("selected_ids", "visit_tokens_after").alias("z"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<visit_index:int,start:int,end:int>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        head = F.length(F.regexp_extract(F.substring(F.col("context"), a["at"] + 1, F.lit(200)), r"^(?:\n\n)?\[Visit [^\n]*\]\n", 0))
        begin = a["at"] + head
        end = (begin + z["visit_tokens_after"]).cast("int")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(z["selected_ids"].cast("int").alias("visit_index"), begin.alias("start"), end.alias("end")))).alias("out"))

    return rows.select("key", F.explode(F.aggregate("z", start, step)["out"]).alias("s")).select("key", "s.*")


def context_checks(contexts: DataFrame, budget: int) -> DataFrame:
    """(check, n_bad): budget kept, truncated exactly if over it, tokens never grow, digest right."""
    bad = {
        "over_budget": F.col("tokens_after") > budget,
        "truncated_flag": F.col("truncated") != (F.col("tokens_before") > budget),
        "tokens_grow": F.exists(F.arrays_zip("visit_tokens_before", "visit_tokens_after"), lambda z: z["visit_tokens_after"] > z["visit_tokens_before"]),
        "digest": F.col("context_sha256") != F.sha2("context", 256),
    }
    counts = contexts.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in bad])).alias("c")).select("c.*")


def context_rates(contexts: DataFrame) -> DataFrame:
    """One row: share truncated, of gold fully survived, with any gold, mean and most tokens."""
    share = lambda c: F.avg(c.cast("double"))
    return contexts.agg(F.count("*").alias("n"), share(F.col("truncated")).alias("truncated"), share(F.col("fully_survived")).alias("fully_survived"), share(F.col("n_gold_surviving") > 0).alias("any_gold"), F.avg("tokens_after").alias("mean_tokens"), F.max("tokens_after").alias("max_tokens"))


def leakage(contexts: DataFrame, answers: DataFrame, normal) -> DataFrame:
    """Counts of questions whose normalised answer is in the context or in the question (key, question, answer)."""
    joined = contexts.join(answers, "key")
    inside = lambda c: F.count_if(F.contains(normal(F.col(c)), normal(F.col("answer"))) & (normal(F.col("answer")) != "")).alias(f"answer_in_{c}")
    return joined.agg(F.count("*").alias("n"), inside("context"), inside("question"))

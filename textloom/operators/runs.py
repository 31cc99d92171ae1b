"""Several runs (reader x condition) over one set of keys: assembly, checks, agreement with intervals, and the tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .checks import covariate_join, require_unique, require_valid
from .inference import interval, joined_weights, spearman
from .metrics import suppressed


def assembled_runs(predictions: DataFrame, contexts: DataFrame, dataset: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions (reader, condition, keys, prediction, fully_survived) with the dataset's columns and empty_prediction.

    Each prediction must have its context (condition, keys, fully_survived) with an equal flag, and its question; a repeated key of a
    run raises.
    """
    require_unique(predictions, ["reader", "condition", *keys])
    flags = contexts.select("condition", *keys, F.col("fully_survived").alias("__context_flag"))
    rows = covariate_join(predictions, flags, ["condition", *keys])
    require_valid(rows, F.col("__context_flag").eqNullSafe(F.col("fully_survived")), "predictions that disagree with their context")
    rows = covariate_join(rows.drop("__context_flag"), dataset, keys)
    return rows.withColumn("empty_prediction", strip(F.col("prediction")) == "")


def run_gate(predictions: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run: rows, distinct keys, keys that the dataset lacks or the run lacks, null, empty and blank predictions, and
    whether the run may be scored."""
    run = ["reader", "condition"]
    known = wanted.select(*keys).distinct().withColumn("__known", F.lit(1))
    marked = predictions.join(known, keys, "left")
    per = marked.groupBy(*run).agg(
        F.count("*").alias("n_rows"), F.countDistinct(*keys).alias("n_keys"), F.count_if(F.col("__known").isNull()).alias("n_unknown"),
        F.count_if(F.col("prediction").isNull()).alias("n_null"), F.count_if(F.col("prediction") == "").alias("n_empty"), F.count_if(strip(F.col("prediction")) == "").alias("n_blank"))
    total = known.count()
    lacking = F.lit(total) - (F.col("n_keys") - F.col("n_unknown"))
    good = (F.col("n_rows") == F.col("n_keys")) & (F.col("n_keys") == total) & (F.col("n_unknown") == 0) & (F.col("n_null") == 0)
    return per.withColumn("n_lacking", lacking.cast("long")).withColumn("passed", good)


def _weighted_agreement(cells: DataFrame, labels: int, threshold: int, *keys: str) -> DataFrame:
    """Per key: qwk, rho, binary kappa and accuracy of the label pairs (i, j) with weights o; labels are 1 .. ``labels``.

    All of it follows from the table of pairs: average ranks are what lies below a label plus half of its own count.
    """
    by = Window.partitionBy(*keys)
    rows = cells.withColumn("n", F.sum("o").over(by))
    for side in "ij":
        one = Window.partitionBy(*keys, side)
        below = by.orderBy(side).rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"m{side}", F.sum("o").over(one)).withColumn(f"b{side}", F.coalesce(F.sum("o").over(below), F.lit(0)))
        rows = rows.withColumn(f"r{side}", F.col(f"b{side}") + (F.col(f"m{side}") + 1) / 2)
    apart = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    hi, hj = (F.col("i") >= threshold).cast("int"), (F.col("j") >= threshold).cast("int")
    o, n, ri, rj = F.col("o"), F.max("n"), F.col("ri"), F.col("rj")
    squares = lambda c: F.sum(o * c * c)
    sums = rows.groupBy(*keys).agg(
        n.alias("n"), F.sum(apart * o).alias("seen"), F.sum(o * F.col("i")).alias("si"), F.sum(o * F.col("j")).alias("sj"), squares(F.col("i")).alias("qi"), squares(F.col("j")).alias("qj"),
        F.sum(o * ri).alias("ari"), F.sum(o * rj).alias("arj"), squares(ri).alias("qri"), squares(rj).alias("qrj"), F.sum(o * ri * rj).alias("x"),
        F.sum(o * hi).alias("ai"), F.sum(o * hj).alias("aj"), F.sum(F.when(hi == hj, o).otherwise(0)).alias("same"))
    c = F.col
    # The expected squared distance of independent labels, times n: E[i^2] + E[j^2] - 2 E[i] E[j].
    expected = c("qi") + c("qj") - 2 * c("si") * c("sj") / c("n")
    chance = (c("ai") * c("aj") + (c("n") - c("ai")) * (c("n") - c("aj"))) / c("n")
    spread = (c("qri") - c("ari") * c("ari") / c("n")) * (c("qrj") - c("arj") * c("arj") / c("n"))
    return sums.select(
        *keys, c("n").cast("long").alias("n"), (1 - F.try_divide(c("seen"), F.nullif(expected, F.lit(0.0)))).alias("qwk"),
        F.try_divide(c("x") - c("ari") * c("arj") / c("n"), F.when(spread > 1e-9, F.sqrt(spread))).alias("rho"),
        F.when(F.abs(c("n") - chance) > 1e-9, (c("same") - chance) / (c("n") - chance)).alias("binary_kappa"), (c("same") / c("n")).alias("binary_accuracy"))


def agreement_intervals(rows: DataFrame, a: str, b: str, labels: int, threshold: int, weights: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(statistic, estimate, low, high, n_resamples) of two raters' labels 1 .. ``labels`` (rows: key_pos, a, b); undefined resamples
    are left out. Weights are (b, key_pos, w) as for all resamples; they are never sent to the driver, whatever Spark takes their
    size to be. Up to ``broadcast_rows`` label pairs are sent to all executors; beyond, the join shuffles."""
    pairs = rows.select("key_pos", F.col(a).cast("long").alias("i"), F.col(b).cast("long").alias("j"))
    names = ["qwk", "rho", "binary_kappa", "binary_accuracy"]
    stacked = lambda df: df.select(*[c for c in df.columns if c == "b"], F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("estimate")) for n in names])).alias("s")).select("s.*")
    point = stacked(_weighted_agreement(pairs.groupBy("i", "j").agg(F.count("*").alias("o")).withColumn("b", F.lit(0)), labels, threshold, "b"))
    resampled = joined_weights(weights, pairs, broadcast_rows).groupBy("b", "i", "j").agg(F.sum("w").alias("o"))
    each = stacked(_weighted_agreement(resampled, labels, threshold, "b"))
    spans = each.filter("estimate is not null").groupBy("statistic").agg(*interval(), F.count("*").alias("n_resamples"))
    return point.join(spans, "statistic", "left")


def length_bias(rows: DataFrame, *run: str) -> DataFrame:
    """Per run: n, rho of score and n_words, the same without empty predictions, mean and median words."""
    every = spearman(rows, "score", "n_words", *run).select(*run, F.col("rho"))
    some = spearman(rows.filter("not empty_prediction"), "score", "n_words", *run).select(*run, F.col("rho").alias("rho_not_empty"))
    words = rows.groupBy(*run).agg(F.count("*").alias("n"), F.avg("n_words").alias("mean_words"), F.median("n_words").alias("median_words"))
    return words.join(every, list(run), "left").join(some, list(run), "left")


def judge_sensitivity(grades: DataFrame, *run: str) -> DataFrame:
    """Per run: mean grade, shares of 4 and more, 3 and more, and 5, with and without grades that stayed invalid."""
    score, kept = F.col("score"), ~F.col("invalid_final")
    share = lambda hit: F.avg(hit.cast("double"))
    return grades.groupBy(*run).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), share(score >= 4).alias("at_least_4"), share(score >= 3).alias("at_least_3"), share(score == 5).alias("exactly_5"),
        F.count_if(kept).alias("n_valid"), F.avg(F.when(kept, score)).alias("mean_valid"))


def subset_means(values: DataFrame, members: DataFrame, oracle: str, least: int = 0) -> DataFrame:
    """(subset, run, n, mean, oracle_gap): means of each run over the keys of each subset (members: subset, key_pos), the oracle's mean
    less the run's, and null figures where a subset has under ``least`` keys."""
    rows = values.join(members, "key_pos").groupBy("subset", "run").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    best = rows.filter(F.col("run") == oracle).select("subset", F.col("mean").alias("__oracle"))
    joined = rows.join(best, "subset", "left").withColumn("oracle_gap", F.col("__oracle") - F.col("mean"))
    return joined.select("subset", "run", "n", *[suppressed(F.col(c), F.col("n"), least)[0].alias(c) for c in ("mean", "oracle_gap")])


def fairness_subsets(gold: DataFrame, cap: int = 5) -> DataFrame:
    """(subset, key_pos): keys whose gold visits (and whose gold visits that reach the reader) fit a retriever's ``cap``, those above,
    and all (gold: key_pos, n_gold, n_reaching)."""
    named = {"all_keys": F.lit(True), f"gold_le{cap}": F.col("n_gold") <= cap, f"gold_gt{cap}": F.col("n_gold") > cap, f"reaching_le{cap}": F.col("n_reaching") <= cap, f"reaching_gt{cap}": F.col("n_reaching") > cap}
    each = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())
    return gold.select(F.explode(each).alias("subset"), "key_pos")


def pairwise_survivors(rows: DataFrame, oracle: str) -> DataFrame:
    """(subset, key_pos): for each other condition the keys whose gold survives in it and in the oracle's context (rows: condition,
    key_pos, survived); the subset is named by the condition."""
    alive = rows.filter("survived").select("condition", "key_pos")
    of_oracle = alive.filter(F.col("condition") == oracle).select("key_pos")
    return alive.filter(F.col("condition") != oracle).join(of_oracle, "key_pos", "left_semi").select(F.col("condition").alias("subset"), "key_pos")


def oracle_selection(gold: DataFrame) -> DataFrame:
    """The oracle condition: all gold visits of a question, however many, as a selection for ``build_contexts`` (gold: key, person_id,
    gold_ids)."""
    return gold.select("key", "person_id", F.explode("gold_ids").alias("visit_index"))


def prompt_ids(rows: DataFrame, template: str, fields: list[str], encode: Column | None = None) -> DataFrame:
    """Adds prompt (the template with %s places filled) and prompt_ids. Without a tokenizer's expression the ids are code points."""
    filled = rows.withColumn("prompt", F.format_string(template, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    points = F.transform(F.filter(F.split("prompt", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return filled.withColumn("prompt_ids", points if encode is None else encode)


def stacked_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_bad): the number of rows of each named table of violations."""
    return reduce(DataFrame.unionByName, [bad.agg(F.lit(name).alias("check"), F.count("*").alias("n_bad")) for name, bad in checks.items()])

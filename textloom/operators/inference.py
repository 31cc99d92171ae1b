"""Paired bootstrap, corrections, agreement and attribution.

Values are long rows (run, key_pos, metric, value, mask). Resamples are a sparse table (b, key_pos, w): w of key_pos in resample b.
The same resamples serve all runs, so differences are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 42


def _numpy_states(spark: SparkSession, n: int, resamples: int, seed: int) -> DataFrame:
    """(b, state): numpy's default generator before each row of a resamples x n matrix. The sequence is drawn once, by one task that
    keeps a row at a time; how far a row moves the generator depends on what is drawn. Rows are dealt to tasks that draw them again."""
    import json

    import numpy as np
    import pandas as pd

    def draw(batches):
        for pdf in batches:
            rng = np.random.default_rng(seed)
            for b in range(int(pdf["id"].sum())):  # one row: how many resamples
                state = json.dumps(rng.bit_generator.state)
                yield pd.DataFrame({"b": [b], "state": [state]})
                rng.integers(0, n, n)

    one = spark.range(resamples, resamples + 1, numPartitions=1)
    return one.mapInPandas(draw, "b long, state string").repartition(4 * spark.sparkContext.defaultParallelism, "b")


def _numpy_row(state: str, n: int):
    import json

    import numpy as np

    bits = np.random.PCG64()
    bits.state = json.loads(state)
    return np.random.Generator(bits).integers(0, n, n)  # row by row equals the matrix draw


def numpy_resamples(spark: SparkSession, n: int, resamples: int = 1000, seed: int = SEED) -> DataFrame:
    """Resamples of numpy's default generator: one draw of a resamples x n matrix, counted row by row. A table of about 0.63 n rows for
    each resample; ``numpy_ratio_estimates`` sums without it."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        for pdf in batches:
            for b, state in zip(pdf["b"], pdf["state"]):
                at, w = np.unique(_numpy_row(state, n), return_counts=True)
                yield pd.DataFrame({"b": b, "key_pos": at, "w": w})

    return _numpy_states(spark, n, resamples, seed).mapInPandas(draw, "b long, key_pos long, w long")


def numpy_ratio_estimates(values: DataFrame, n: int, *keys: str, resamples: int = 1000, seed: int = SEED, block: int = 1 << 18, rows: int = 250) -> DataFrame:
    """``ratio_estimates`` with ``numpy_resamples``, for large n: (keys, b, estimate).

    A resample is cut into blocks of ``block`` key positions, each one row of packed counts; a task gets the values of one block and its
    counts in ``rows`` resamples, so what is shuffled is about a byte for each draw, and memory does not grow with n beyond the one row
    that is drawn.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def count(batches):
        for pdf in batches:
            for b, state in zip(pdf["b"], pdf["state"]):
                w = np.bincount(_numpy_row(state, n), minlength=n)
                w = w.astype(np.uint8 if w.max(initial=0) < 256 else np.uint32)
                for k in range(0, n, block):
                    yield pd.DataFrame({"block": [k // block], "part": [b // rows], "b": [b], "width": [w.itemsize], "w": [w[k : k + block].tobytes()]})

    def sums(values: pa.Table, counts: pa.Table) -> pa.Table:
        out = {"g": [], "b": [], "mx": [], "m": []}
        if values.num_rows and counts.num_rows:
            coded = values.column("g").combine_chunks().dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            place = code * np.int64(block) + values.column("key_pos").to_numpy() % block
            m, mx = values.column("m").to_numpy().astype(float), values.column("mx").to_numpy()
            odd = np.flatnonzero(~np.isfinite(mx))  # these count only where they are drawn
            table = np.stack([np.bincount(place, x, len(names) * block).reshape(-1, block) for x in (np.where(np.isfinite(mx), mx, 0.0), m)])
            for b, width, w in zip(counts.column("b").to_pylist(), counts.column("width").to_pylist(), counts.column("w")):
                drawn = np.frombuffer(w.as_buffer(), dtype=np.uint8 if width == 1 else np.uint32).astype(float)
                x, weight = table[:, :, : len(drawn)] @ drawn
                for k in odd:
                    if (times := drawn[place[k] % block]) > 0:
                        x[code[k]] += times * mx[k]
                out["g"] += names
                out["b"] += [b] * len(names)
                out["mx"] += x.tolist()
                out["m"] += weight.tolist()
        return pa.table(out, pa.schema([("g", pa.string()), ("b", pa.int64()), ("mx", pa.float64()), ("m", pa.float64())]))

    m = F.coalesce(F.col("mask"), F.lit(1)) if "mask" in values.columns else F.lit(1)
    named = values.withColumn("g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    slim = named.filter(F.col("key_pos").between(0, n - 1)).select("g", F.col("key_pos").cast("long").alias("key_pos"), m.cast("double").alias("m"), (m * F.coalesce("value", F.lit(0.0))).cast("double").alias("mx"))
    parts = F.sequence(F.lit(0).cast("long"), F.lit((resamples - 1) // rows).cast("long"))
    left = slim.withColumn("block", F.floor(F.col("key_pos") / block).cast("long")).withColumn("part", F.explode(parts))
    states = _numpy_states(values.sparkSession, n, resamples, seed)
    counts = states.mapInPandas(count, "block long, part long, b long, width long, w binary")
    found = left.groupBy("block", "part").cogroup(counts.groupBy("block", "part")).applyInArrow(sums, "g string, b long, mx double, m double")
    ratios = found.groupBy("g", "b").agg(F.try_divide(F.sum("mx"), F.sum("m")).alias("estimate"))
    return ratios.join(F.broadcast(named.select(*keys, "g").distinct()), "g").select(*keys, "b", "estimate")  # a row for each run


def arithmetic_index(b: Column, j: Column, n: Column | int, seed: int = SEED) -> Column:
    """A reproducible index below n from integer arithmetic alone, the same in any SQL engine."""
    x = (b * 7919 + j * 104729 + seed) % 2147483647
    return ((x * 48271) % 2147483647 * 16807) % 2147483647 % n


def arithmetic_draws(keys: DataFrame, resamples: int, seed: int = SEED) -> DataFrame:
    """(b, key_pos, w = 1): the draws of resamples by ``arithmetic_index`` over key positions 0..n-1 (a column key_pos of all keys)."""
    n = keys.count()
    draws = keys.select(F.col("key_pos").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b"))
    return draws.select("b", arithmetic_index(F.col("b"), F.col("j"), F.lit(n), seed).alias("key_pos"), F.lit(1).cast("long").alias("w"))


def arithmetic_resamples(keys: DataFrame, resamples: int, seed: int = SEED) -> DataFrame:
    """The draws counted: one row for each key of a resample."""
    return arithmetic_draws(keys, resamples, seed).groupBy("b", "key_pos").agg(F.sum("w").alias("w"))


def joined_weights(weights: DataFrame, values: DataFrame, broadcast_rows: int) -> DataFrame:
    """Resamples with the values of their keys. Spark takes the weights to be as small as what they are drawn from and might send all of
    them to the driver, so the join is fixed: the values are broadcast up to ``broadcast_rows`` rows, else both sides are shuffled."""
    small = values.limit(broadcast_rows + 1).count() <= broadcast_rows
    return weights.join(F.broadcast(values) if small else values.hint("merge"), "key_pos")


def ratio_estimates(values: DataFrame, weights: DataFrame, *keys: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(keys, b, estimate): sum(w m x) / sum(w m) of each resample; null where nothing is left. Weights of one key may come in parts
    (draws), which add up. Up to ``broadcast_rows`` values are sent to all executors, so that resamples are summed where they
    are drawn."""
    m = F.coalesce(F.col("mask"), F.lit(1)) if "mask" in values.columns else F.lit(1)
    slim = values.select(*keys, "key_pos", m.alias("m"), (m * F.coalesce("value", F.lit(0.0))).alias("mx"))
    joined = joined_weights(weights, slim, broadcast_rows)
    return joined.groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("mx")), F.sum(F.col("w") * F.col("m")).cast("double")).alias("estimate"))


def point_estimates(values: DataFrame, *keys: str) -> DataFrame:
    m = F.coalesce(F.col("mask"), F.lit(1)) if "mask" in values.columns else F.lit(1)
    return values.groupBy(*keys).agg(F.try_divide(F.sum(m * F.coalesce("value", F.lit(0.0))), F.sum(m).cast("double")).alias("estimate"), F.sum(m).cast("long").alias("n"))


def interval(column: str = "estimate") -> list[Column]:
    """2.5 and 97.5 percentiles with linear interpolation, nulls left out."""
    return [F.percentile(column, F.lit(0.025)).alias("low"), F.percentile(column, F.lit(0.975)).alias("high")]


def bootstrap_intervals(values: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    return estimate_intervals(values, ratio_estimates(values, weights, *keys), *keys)


def estimate_intervals(values: DataFrame, estimates: DataFrame, *keys: str) -> DataFrame:
    """Point estimates of the values with the intervals of their resampled ones (keys, b, estimate)."""
    ci = estimates.groupBy(*keys).agg(*interval())
    return point_estimates(values, *keys).join(ci, list(keys))


def paired_differences(estimates: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """(run_a, run_b, keys, b, estimate): differences of the same resample for the pairs (run_a, run_b)."""
    a = estimates.select(F.col("run").alias("run_a"), *keys, "b", F.col("estimate").alias("ea"))
    b = estimates.select(F.col("run").alias("run_b"), *keys, "b", F.col("estimate").alias("eb"))
    return pairs.join(a, "run_a").join(b, ["run_b", *keys, "b"]).select("run_a", "run_b", *keys, "b", (F.col("ea") - F.col("eb")).alias("estimate"))


def difference_summary(differences: DataFrame, *keys: str) -> DataFrame:
    """low, high, ci_excludes_0 and the two-sided bootstrap p of each difference."""
    total = F.count("estimate")
    tail = lambda c: (F.count_if(c) + 1) / (total + 1)
    p = F.least(F.lit(1.0), 2 * F.least(tail(F.col("estimate") <= 0), tail(F.col("estimate") >= 0)))
    out = differences.groupBy(*keys).agg(*interval(), p.alias("p"))
    return out.withColumn("ci_excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def holm(tests: DataFrame, family: list[str], ties: list[str], p: str = "p") -> DataFrame:
    """Adds p_holm within each family: step-down with a running maximum, at most 1."""
    order = Window.partitionBy(*family).orderBy(p, *ties)
    m = F.count("*").over(Window.partitionBy(*family))
    raw = tests.withColumn("raw", (m - F.row_number().over(order) + 1) * F.col(p))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("raw")


def run_pairs(runs: DataFrame, order: str = "ord") -> DataFrame:
    """(run_a, run_b) of each unordered pair of runs within a group, first by order; ``runs``: run, group, ord (few rows)."""
    a, b = runs.select(F.col("run").alias("run_a"), "group", F.col(order).alias("oa")), runs.select(F.col("run").alias("run_b"), "group", F.col(order).alias("ob"))
    return a.join(b, "group").filter("oa < ob").select("group", "run_a", "run_b")


def average_ranks(df: DataFrame, value: str, *keys: str) -> Column:
    """Rank with ties averaged (window expression)."""
    part = Window.partitionBy(*keys)
    return F.rank().over(part.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Spearman's rho per key over rows with both values; null for constant sides."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    keys = keys or ("__all",)
    both = both if keys != ("__all",) else both.withColumn("__all", F.lit(0))
    rank = both.withColumn("rx", average_ranks(both, x, *keys)).withColumn("ry", average_ranks(both, y, *keys))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    out = rank.groupBy(*keys).agg(F.count("*").alias("n"), rho.alias("rho"))
    return out.drop("__all")


def contingency(df: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    """(i, j, o): counts of label pairs over the full grid; i and j are label positions."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(labels) for j, y in enumerate(labels)], ["i", "j", "x", "y"])
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("xs"), F.col(b).cast("string").alias("ys")).agg(F.count("*").alias("c"))
    joined = grid.join(F.broadcast(counts), (F.col("x").cast("string") == F.col("xs")) & (F.col("y").cast("string") == F.col("ys")), "left")  # labels squared
    return joined.select("i", "j", F.coalesce("c", F.lit(0)).alias("o"))


def kappa(matrix: DataFrame, n_labels: int, quadratic: bool = False) -> DataFrame:
    """One row (kappa, n): Cohen's kappa of a contingency table, or with quadratic weights; null if undefined."""
    everything = Window.partitionBy(F.lit(0))  # labels squared rows
    rows = matrix.withColumn("n", F.sum("o").over(everything)).withColumn("ri", F.sum("o").over(Window.partitionBy("i"))).withColumn("cj", F.sum("o").over(Window.partitionBy("j")))
    w = ((F.col("i") - F.col("j")) * (F.col("i") - F.col("j")) / float((n_labels - 1) ** 2)) if quadratic else (F.col("i") != F.col("j")).cast("double")
    seen, expected = F.sum(w * F.col("o")), F.sum(w * F.try_divide(F.col("ri") * F.col("cj"), F.col("n")))
    return rows.agg((1 - F.try_divide(seen, expected)).alias("kappa"), F.max("n").alias("n"))


def agreement(df: DataFrame, a: str, b: str, labels: list, threshold: int) -> DataFrame:
    """One row: quadratic kappa, rho, binary kappa and accuracy at ``threshold``."""
    binary = df.withColumn("ba", (F.col(a) >= threshold).cast("int")).withColumn("bb", (F.col(b) >= threshold).cast("int"))
    one = lambda d, *c: d.select(*c)
    parts = [
        one(kappa(contingency(df, a, b, labels), len(labels), True), F.col("kappa").alias("qwk")),
        one(spearman(df, a, b), F.col("rho"), "n"),
        one(kappa(contingency(binary, "ba", "bb", [0, 1]), 2), F.col("kappa").alias("binary_kappa")),
        binary.agg(F.avg((F.col("ba") == F.col("bb")).cast("double")).alias("binary_accuracy")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one-row tables
    return out


def gap_attribution(rows: DataFrame) -> DataFrame:
    """One row from (d, survived): gap = share_s * gap_s + share_n * gap_n, and the part that comes from rows not survived."""
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("d"))), F.lit(0.0))
    s, ns = F.col("survived"), ~F.col("survived")
    out = rows.agg(n.alias("n"), F.avg("d").alias("gap"), share(s).alias("share_s"), mean(s).alias("gap_s"), share(ns).alias("share_n"), mean(ns).alias("gap_n"))
    return out.withColumn("fraction_not_survived", F.try_divide(F.col("share_n") * F.col("gap_n"), F.col("gap")))


def common_survivors(rows: DataFrame, key: str, flag: str, n_conditions: int) -> DataFrame:
    """Keys whose flag holds in all of ``n_conditions`` conditions."""
    return rows.groupBy(key).agg(F.bool_and(flag).alias("all"), F.count("*").alias("n")).filter((F.col("all")) & (F.col("n") == n_conditions)).select(key)

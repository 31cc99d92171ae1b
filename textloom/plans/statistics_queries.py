"""Queries over bootstrap resamples, corrections, agreement, strata and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inference, metrics, sampling, scoring
from . import standins as s
from .registration import query

RESAMPLES = 1000
_DRAWS = f"""keys AS (SELECT DISTINCT key_pos FROM runs), n AS (SELECT count(*) AS n FROM keys),
w AS (SELECT b, (((b * 7919 + key_pos * 104729 + 42) % 2147483647 * 48271) % 2147483647 * 16807) % 2147483647 % n AS key_pos, count(*) AS w FROM keys, n, range(0, {RESAMPLES}) r(b) GROUP BY ALL)"""
_EST = """est AS (SELECT run, b, sum(w * mask * value) / nullif(sum(w * mask), 0)::DOUBLE AS estimate FROM runs JOIN w USING (key_pos) GROUP BY ALL)"""
_CI = "round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high"


def _draws(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = s.run_values(spark, sf)
    return v, inference.arithmetic_draws(v.select("key_pos").distinct(), RESAMPLES)


@query("bootstrap_counts", f"WITH {s.RUN_VALUES}, {_DRAWS} SELECT b, key_pos, w FROM w")
def bootstrap_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inference.arithmetic_resamples(s.run_values(spark, sf).select("key_pos").distinct(), RESAMPLES)


@query("bootstrap_intervals", f"WITH {s.RUN_VALUES}, {_DRAWS}, {_EST}, p AS (SELECT run, sum(mask * value) / sum(mask)::DOUBLE AS point, CAST(sum(mask) AS BIGINT) AS n FROM runs GROUP BY 1) SELECT run, round(any_value(point), 9) AS estimate, any_value(n) AS n, {_CI} FROM est JOIN p USING (run) GROUP BY run")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    v, w = _draws(spark, sf)
    out = inference.bootstrap_intervals(v, w, "run")
    return out.select("run", F.round("estimate", 9).alias("estimate"), "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_DIFF = f"""{_EST}, d AS (SELECT a.run AS run_a, z.run AS run_b, a.b, a.estimate - z.estimate AS estimate FROM est a JOIN est z ON a.b = z.b AND a.run < z.run),
tests AS (SELECT run_a, run_b, {_CI}, least(1.0, 2 * least((count(*) FILTER (WHERE estimate <= 0) + 1) / (count(estimate) + 1)::DOUBLE, (count(*) FILTER (WHERE estimate >= 0) + 1) / (count(estimate) + 1)::DOUBLE)) AS p FROM d GROUP BY ALL)"""


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    v, w = _draws(spark, sf)
    est = inference.ratio_estimates(v, w, "run")
    runs = v.select("run").distinct().withColumn("group", F.lit(0)).withColumn("ord", F.col("run"))
    return inference.difference_summary(inference.paired_differences(est, inference.run_pairs(runs), ), "run_a", "run_b")


@query("paired_diff", f"WITH {s.RUN_VALUES}, {_DRAWS}, {_DIFF} SELECT run_a, run_b, low, high, round(p, 9) AS p, low > 0 OR high < 0 AS ci_excludes_0 FROM tests")
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _tests(spark, sf).select("run_a", "run_b", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.round("p", 9).alias("p"), "ci_excludes_0")


@query("paired_diff_holm", f"WITH {s.RUN_VALUES}, {_DRAWS}, {_DIFF}, h AS (SELECT *, row_number() OVER (ORDER BY p, run_a, run_b) AS r, count(*) OVER () AS m FROM tests) SELECT run_a, run_b, round(p, 9) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 9) AS p_holm FROM h")
def paired_diff_holm(spark: SparkSession, sf: str) -> DataFrame:
    t = _tests(spark, sf).withColumn("family", F.lit("all"))
    return inference.holm(t, ["family"], ["run_a", "run_b"]).select("run_a", "run_b", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query("comparison_families", "SELECT a.n_name AS run_a, b.n_name AS run_b, a.n_regionkey::BIGINT AS \"group\" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def comparison_families(spark: SparkSession, sf: str) -> DataFrame:
    n = s.table(spark, sf, "nation").select(F.col("n_name").alias("run"), F.col("n_regionkey").cast("long").alias("group"), F.col("n_nationkey").alias("ord"))
    return inference.run_pairs(n)


_RATERS = "r AS (SELECT doc_id, 1 + (quality * 3 + doc_id % 3) % 5 AS a, 1 + (quality * 3 + toxic + (doc_id // 3) % 3) % 5 AS b, quality, toxic FROM labels)"


def _raters(spark: SparkSession, sf: str) -> DataFrame:
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    return s.table(spark, sf, "labels").select("doc_id", (1 + (q * 3 + d % 3) % 5).alias("a"), (1 + (q * 3 + t + F.floor(d / 3) % 3) % 5).alias("b"), "quality", "toxic")


def _kappa_sql(a: str, b: str, n: int, low: int, quadratic: bool) -> str:
    w = f"(i - j) * (i - j) / {float((n - 1) ** 2)}" if quadratic else "CAST(i <> j AS DOUBLE)"
    return f"""g AS (SELECT i, j, (SELECT count(*) FROM r WHERE {a} = i AND {b} = j) AS o FROM range({low}, {low + n}) x(i), range({low}, {low + n}) y(j)),
h AS (SELECT *, sum(o) OVER () AS n, sum(o) OVER (PARTITION BY i) AS ri, sum(o) OVER (PARTITION BY j) AS cj FROM g) SELECT round(1 - sum({w} * o) / sum({w} * ri * cj / n::DOUBLE), 9) AS kappa, CAST(max(n) AS BIGINT) AS n FROM h"""


@query("contingency", "SELECT i, j, (SELECT count(*) FROM labels WHERE quality = i AND toxic = j) AS o FROM range(0, 2) a(i), range(0, 2) b(j)")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return inference.contingency(s.table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("kappa", f"WITH {_RATERS}, {_kappa_sql('quality', 'toxic', 2, 0, False)}")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return inference.kappa(inference.contingency(_raters(spark, sf), "quality", "toxic", [0, 1]), 2).select(F.round("kappa", 9).alias("kappa"), "n")


@query("qwk", f"WITH {_RATERS}, {_kappa_sql('a', 'b', 5, 1, True)}")
def qwk(spark: SparkSession, sf: str) -> DataFrame:
    return inference.kappa(inference.contingency(_raters(spark, sf), "a", "b", [1, 2, 3, 4, 5]), 5, quadratic=True).select(F.round("kappa", 9).alias("kappa"), "n")


@query("spearman", "WITH k AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2.0 AS x, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) SELECT event_type, count(*) AS n, round(corr(x, y), 8) AS rho FROM k GROUP BY 1")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").withColumn("v", F.round("value"))
    return inference.spearman(e, "v", "user_id", "event_type").select("event_type", "n", F.round("rho", 8).alias("rho"))


@query("agreement", f"""WITH {_RATERS}, k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM r), z AS (SELECT CAST(a >= 4 AS INT) AS ba, CAST(b >= 4 AS INT) AS bb FROM r),
q AS (WITH {_kappa_sql('a', 'b', 5, 1, True)}), bk AS (WITH r AS (SELECT * FROM z), {_kappa_sql('ba', 'bb', 2, 0, False)})
SELECT (SELECT kappa FROM q) AS qwk, (SELECT round(corr(x, y), 8) FROM k) AS rho, (SELECT count(*) FROM r) AS n, (SELECT kappa FROM bk) AS binary_kappa, (SELECT round(avg(CAST(ba = bb AS INT)), 9) FROM z) AS binary_accuracy""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    a = inference.agreement(_raters(spark, sf), "a", "b", [1, 2, 3, 4, 5], 4)
    return a.select(F.round("qwk", 9).alias("qwk"), F.round("rho", 8).alias("rho"), "n", F.round("binary_kappa", 9).alias("binary_kappa"), F.round("binary_accuracy", 9).alias("binary_accuracy"))


@query("gap_attribution", "WITH d AS (SELECT value - 5 AS d, event_id % 3 = 0 AS s FROM events WHERE value IS NOT NULL) SELECT count(*) AS n, round(avg(d), 8) AS gap, round(count(*) FILTER (WHERE s) / count(*)::DOUBLE, 8) AS share_s, round(avg(d) FILTER (WHERE s), 8) AS gap_s, round(count(*) FILTER (WHERE NOT s) / count(*)::DOUBLE, 8) AS share_n, round(avg(d) FILTER (WHERE NOT s), 8) AS gap_n, round(count(*) FILTER (WHERE NOT s) / count(*)::DOUBLE * avg(d) FILTER (WHERE NOT s) / avg(d), 7) AS fraction_not_survived FROM d")
def gap_attribution(spark: SparkSession, sf: str) -> DataFrame:
    d = s.table(spark, sf, "events").filter("value is not null").select((F.col("value") - 5).alias("d"), (F.col("event_id") % 3 == 0).alias("survived"))
    g = inference.gap_attribution(d)
    return g.select("n", *[F.round(c, 8).alias(c) for c in ("gap", "share_s", "gap_s", "share_n", "gap_n")], F.round("fraction_not_survived", 7).alias("fraction_not_survived"))


@query("common_survivors", "SELECT user_id AS key FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AND bool_and(event_id % 97 <> 0)")
def common_survivors(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").filter("event_type is not null")
    per = e.groupBy(F.col("user_id").alias("key"), "event_type").agg(F.bool_and(F.col("event_id") % 97 != 0).alias("flag"))
    return inference.common_survivors(per, "key", "flag", e.select("event_type").distinct().count())


_CELL = "CASE WHEN value > 10 THEN 'high' ELSE 'low' END"


@query("strata_grouping_sets", f"""WITH e AS (SELECT event_type AS kind, {_CELL} AS band, value FROM events WHERE event_type IS NOT NULL) SELECT CASE WHEN grouping(kind) = 0 AND grouping(band) = 0 THEN 'kind,band' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(band) = 0 THEN 'band' ELSE 'overall' END AS level, kind, band, count(*) AS n, round(avg(value), 8) AS mean FROM e GROUP BY GROUPING SETS ((), (kind), (band), (kind, band))""")
def strata_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").filter("event_type is not null").select(F.col("event_type").alias("kind"), F.when(F.col("value") > 10, "high").otherwise("low").alias("band"), "value")
    return metrics.grouping_sets(e, [(), ("kind",), ("band",), ("kind", "band")], F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean")).select("level", "kind", "band", "n", "mean")


@query("empty_cells", "WITH c AS (SELECT lang, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 20000 THEN 'long' ELSE 'middle' END AS size, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, size, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) l(lang), (VALUES ('short'), ('middle'), ('long')) z(size)) LEFT JOIN c USING (lang, size)")
def empty_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = s.table(spark, sf, "documents").withColumn("size", F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") > 20000, "long").otherwise("middle"))
    cells = metrics.grouping_sets(d, [("lang", "size")], F.count("*").alias("n"))
    return metrics.with_empty_cells(cells, {"lang": ["en", "fr", "de", "es", "xx"], "size": ["short", "middle", "long"]}, "lang,size").select("lang", "size", "n")


@query("small_n_suppression", "WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT user_id, CASE WHEN n >= 65 THEN round(m, 8) END AS value, CASE WHEN n < 65 THEN 'n<65' ELSE '' END AS flag FROM u")
def small_n_suppression(spark: SparkSession, sf: str) -> DataFrame:
    u = s.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    value, flag = metrics.suppressed(F.round("m", 8), F.col("n"), 65)
    return u.select("user_id", value.alias("value"), flag.alias("flag"))


@query("interval_cells", f"WITH {s.RUN_VALUES}, {_DRAWS}, {_EST} SELECT run, printf('%.2f [%.2f, %.2f]', round(avg(estimate), 6), round(quantile_cont(estimate, 0.025), 6), round(quantile_cont(estimate, 0.975), 6)) AS cell FROM est GROUP BY 1")
def interval_cells(spark: SparkSession, sf: str) -> DataFrame:
    v, w = _draws(spark, sf)
    e = inference.ratio_estimates(v, w, "run").groupBy("run").agg(F.avg("estimate").alias("m"), *inference.interval())
    return e.select("run", scoring.interval_text(F.round("m", 6), F.round("low", 6), F.round("high", 6), 2).alias("cell"))


_CELLS = "cells AS (SELECT lang, CAST(n_chars > 1000 AS INT) AS big, count(*) AS n FROM documents GROUP BY ALL)"


@query("largest_remainder", f"""WITH {_CELLS}, q AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS quota FROM cells), f AS (SELECT *, greatest(floor(quota), 1)::BIGINT AS a, quota - greatest(floor(quota), 1) AS rest FROM q),
r AS (SELECT *, 100 - sum(a) OVER () AS short, row_number() OVER (ORDER BY rest DESC, lang, big) AS up FROM f) SELECT lang, big::BIGINT AS big, n, least(a + CASE WHEN up <= short THEN 1 ELSE 0 END, n) AS alloc FROM r""")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return _allocation(spark, sf)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "documents").groupBy("lang", (F.col("n_chars") > 1000).cast("long").alias("big")).agg(F.count("*").alias("n"))


def _allocation(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.proportional_allocation(_cells(spark, sf), 100, ["lang", "big"])


@query("stratified_sample", f"""WITH {_CELLS}, q AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS quota FROM cells), f AS (SELECT *, greatest(floor(quota), 1)::BIGINT AS a, quota - greatest(floor(quota), 1) AS rest FROM q),
r AS (SELECT *, 100 - sum(a) OVER () AS short, row_number() OVER (ORDER BY rest DESC, lang, big) AS up FROM f), alloc AS (SELECT lang, big, least(a + CASE WHEN up <= short THEN 1 ELSE 0 END, n) AS k FROM r),
d AS (SELECT doc_id, lang, CAST(n_chars > 1000 AS INT) AS big, row_number() OVER (PARTITION BY lang, n_chars > 1000 ORDER BY md5('42|' || doc_id), doc_id) AS p FROM documents) SELECT doc_id, lang, big::BIGINT AS big FROM d JOIN alloc USING (lang, big) WHERE p <= k""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("long").alias("big"))
    return sampling.stratified_sample(rows, _allocation(spark, sf), ["lang", "big"], "doc_id")


@query("uniform_sample", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_sample(s.table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("pilot_allocation", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, 50.0::DOUBLE * n / sum(n) OVER () AS quota FROM c), f AS (SELECT *, floor(quota)::BIGINT AS a FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY quota - a DESC, lang) AS r, 50 - sum(a) OVER () AS left_ FROM f) SELECT lang, n, greatest(a + CASE WHEN r <= left_ THEN 1 ELSE 0 END, 1) AS alloc FROM r""")
def pilot_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pilot_allocation(s.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), 50, "lang")


@query("quota_sample", """WITH d AS (SELECT doc_id, lang, md5('42|' || doc_id) AS p FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) AS r FROM d), own AS (SELECT * FROM k WHERE r <= CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 10 WHEN 'de' THEN 5 ELSE 0 END),
rest AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS q FROM k WHERE doc_id NOT IN (SELECT doc_id FROM own)) SELECT doc_id, lang FROM own UNION ALL SELECT doc_id, lang FROM rest WHERE q <= 28 - (SELECT count(*) FROM own)""")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota_sample(s.table(spark, sf, "documents").select("doc_id", "lang"), "lang", {"en": 10, "fr": 10, "de": 5, "xx": 3}, "doc_id")


@query("disjoint_strata", """WITH d AS (SELECT doc_id, n_chars FROM documents), a AS (SELECT doc_id FROM d WHERE n_chars < 1500 ORDER BY md5('42|' || doc_id), doc_id LIMIT 20), b AS (SELECT doc_id FROM d WHERE n_chars < 3000 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5('43|' || doc_id), doc_id LIMIT 20)
SELECT doc_id, 'short' AS sample_stratum FROM a UNION ALL SELECT doc_id, 'middle' FROM b""")
def disjoint_strata(spark: SparkSession, sf: str) -> DataFrame:
    d = s.table(spark, sf, "documents").select("doc_id", "n_chars")
    return sampling.disjoint_strata(d, {"short": F.col("n_chars") < 1500, "middle": F.col("n_chars") < 3000}, 20, "doc_id").select("doc_id", "sample_stratum")


@query("donor_pairs", """WITH o AS (SELECT n_nationkey AS item, n_regionkey AS person, row_number() OVER (ORDER BY md5('42|' || n_nationkey), n_nationkey) AS k, count(*) OVER () AS n FROM nation),
p AS (SELECT a.item, a.person, b.item AS donor, row_number() OVER (PARTITION BY a.item ORDER BY (b.k - a.k + a.n) % a.n) AS r FROM o a JOIN o b ON a.person <> b.person) SELECT item::BIGINT AS item, person::BIGINT AS person, donor::BIGINT AS donor FROM p WHERE r = 1""")
def donor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = s.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("item"), F.col("n_regionkey").cast("long").alias("person"))
    return sampling.donors(n, "item", "person")


@query("fixed_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents")
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.fixed_chunks(s.table(spark, sf, "documents").select("doc_id"), 64, "doc_id").select("doc_id", F.col("chunk").cast("long").alias("chunk"))


@query("semi_resume", "SELECT event_id FROM events WHERE event_type IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 4 = 0 AND user_id IS NOT NULL)")
def semi_resume(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events")
    done = e.filter("event_type = 'purchase' and user_id % 4 = 0").select("user_id").distinct()
    return e.filter("event_type is not null").join(done, "user_id", "left_anti").select("event_id")


@query("balanced_shards", """WITH RECURSIVE w AS (SELECT source AS id, sum(n_chars) AS w FROM documents GROUP BY 1), o AS (SELECT id, w, row_number() OVER (ORDER BY w DESC, id) AS k FROM w),
g(k, id, a, b, c, d, shard) AS (SELECT 0, NULL::VARCHAR, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, NULL::BIGINT UNION ALL
SELECT o.k, o.id, CASE t WHEN 0 THEN a + w ELSE a END, CASE t WHEN 1 THEN b + w ELSE b END, CASE t WHEN 2 THEN c + w ELSE c END, CASE t WHEN 3 THEN d + w ELSE d END, t
FROM (SELECT *, CASE WHEN a <= least(b, c, d) THEN 0 WHEN b <= least(c, d) THEN 1 WHEN c <= d THEN 2 ELSE 3 END::BIGINT AS t FROM g) x JOIN o ON o.k = x.k + 1) SELECT id, shard FROM g WHERE k > 0""")
def balanced_shards(spark: SparkSession, sf: str) -> DataFrame:
    w = s.table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.sum("n_chars").alias("weight"))
    return sampling.balanced_shards(w, 4)


@query("numpy_bootstrap")
def numpy_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    v = s.run_values(spark, sf)
    estimates = inference.numpy_ratio_estimates(v, v.select("key_pos").distinct().count(), "run", resamples=RESAMPLES)
    return inference.estimate_intervals(v, estimates, "run").select("run", F.round("estimate", 9).alias("estimate"), "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))

"""Queries over rankings, metrics, contexts and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import groups, text
from ..operators import checks, context, metrics, readers, retrieval
from . import models
from . import standins as s
from .registration import query

_BM25 = f"""tok AS (SELECT index_id, doc_id, {s.sql_tokens('text')} AS t FROM docs),
len_ AS (SELECT index_id, doc_id, CAST(len(t) AS BIGINT) AS dl FROM tok),
terms AS (SELECT index_id, doc_id, term, count(*) AS tf FROM (SELECT index_id, doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
size_ AS (SELECT index_id, count(*) AS n, avg(dl) AS avgdl FROM len_ GROUP BY 1),
raw AS (SELECT index_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, avgdl FROM terms JOIN size_ USING (index_id) GROUP BY index_id, term, n, avgdl),
idf AS (SELECT index_id, term, avgdl, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * avg(raw) OVER (PARTITION BY index_id) END AS idf FROM raw),
qt AS (SELECT question_id, index_id, term, count(*) AS qf FROM (SELECT question_id, index_id, unnest({s.sql_tokens('text')}) AS term FROM questions) GROUP BY ALL),
hit AS (SELECT question_id, index_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (index_id, term) JOIN terms USING (index_id, term) JOIN len_ USING (index_id, doc_id) GROUP BY ALL),
scored AS (SELECT question_id, index_id, doc_id, coalesce(score, 0) AS score FROM (SELECT question_id, index_id, doc_id FROM questions JOIN len_ USING (index_id)) LEFT JOIN hit USING (question_id, index_id, doc_id)),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY question_id, index_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM scored)"""
_RANKED = "SELECT question_id, index_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM"


def _ranked_output(r: DataFrame) -> DataFrame:
    return r.select("question_id", "index_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ranked(retrieval.bm25_scores(s.questions(spark, sf), s.ranked_documents(spark, sf)), 8)


def _bm25_window(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ranked(retrieval.bm25_scores(s.questions(spark, sf), s.windowed_documents(spark, sf)), 8)


def _bm25_top(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return retrieval.bm25_top(s.questions(spark, sf), s.ranked_documents(spark, sf), k, 8)


@query("bm25_full", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25} {_RANKED} bm25")
def bm25_full(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_output(_bm25(spark, sf))


@query("bm25_window", f"WITH {s.WINDOW_DOCS}, {s.QUESTIONS}, {_BM25} {_RANKED} bm25")
def bm25_window(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_output(_bm25_window(spark, sf))


@query("bm25_topk", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25} {_RANKED} bm25 WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_output(_bm25_top(spark, sf, 5))


@query("topk_chronological", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25} SELECT question_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM bm25 WHERE rank <= 5 GROUP BY 1")
def topk_chronological(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.selected_documents(_bm25_top(spark, sf, 5), 5).select("question_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    q, d, _ = s.dense_inputs(spark, sf)
    return retrieval.ranked(retrieval.dense_scores(q, d), 6)


@query("dense_dot", f"WITH {s.DENSE} SELECT question_id, index_id, doc_id, rank, round(score, 6) AS score FROM dense")
def dense_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_output(_dense(spark, sf))


@query("dense_cosine", f"WITH {s.DENSE} SELECT question_id, index_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(cosine, 6) DESC, doc_id) AS rank, round(cosine, 6) AS score FROM scores")
def dense_cosine(spark: SparkSession, sf: str) -> DataFrame:
    q, d, _ = s.dense_inputs(spark, sf)
    return _ranked_output(retrieval.ranked(retrieval.dense_scores(q, d, cosine=True), 6))


@query("dense_window", f"WITH {s.DENSE} SELECT question_id, index_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank, round(score, 6) AS score FROM scores WHERE doc_id % 3 = 0")
def dense_window(spark: SparkSession, sf: str) -> DataFrame:
    q, d, _ = s.dense_inputs(spark, sf)
    full = retrieval.dense_scores(q, d)
    window = q.select("question_id", "index_id").join(d.filter("doc_id % 3 = 0").select("index_id", "doc_id"), "index_id")
    return _ranked_output(retrieval.ranked(retrieval.restricted(full, window), 6))


_LENGTH_RANK = """by_length AS (SELECT question_id, index_id, doc_id, row_number() OVER (PARTITION BY question_id, index_id ORDER BY abs(length(q.text) - length(d.text)), doc_id) AS rank FROM questions q JOIN docs d USING (index_id))"""
_RRF = f"""{_LENGTH_RANK}, fused AS (SELECT question_id, index_id, doc_id, 1.0::DOUBLE / (60 + a.rank) + 1.0::DOUBLE / (60 + b.rank) AS score, least(a.rank, b.rank) AS m FROM bm25 a JOIN by_length b USING (question_id, index_id, doc_id)),
rrf AS (SELECT *, row_number() OVER (PARTITION BY question_id, index_id ORDER BY score DESC, m, doc_id) AS rank FROM fused)"""


def _rrf(spark: SparkSession, sf: str) -> DataFrame:
    q, d = s.questions(spark, sf), s.ranked_documents(spark, sf)
    near = q.withColumnRenamed("text", "qt").join(d, "index_id").select("question_id", "index_id", "doc_id", (-F.abs(F.length("qt") - F.length("text"))).cast("double").alias("score"))
    return retrieval.reciprocal_rank_fusion([_bm25(spark, sf), retrieval.ranked(near)])


@query("rrf_fuse", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_RRF} SELECT question_id, index_id, doc_id, rank, round(score, 9) AS score FROM rrf")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _rrf(spark, sf).select("question_id", "index_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("ranking_invariants", """SELECT * FROM (VALUES ('duplicate_key', 0::BIGINT), ('rank_gap', 0::BIGINT), ('missing_candidate', 0::BIGINT), ('extra_candidate', 0::BIGINT), ('not_finite', 0::BIGINT), ('score_rises', 0::BIGINT), ('tie_order', 0::BIGINT), ('gold_outside', 0::BIGINT)) t("check", n_bad)""")
def ranking_invariants(spark: SparkSession, sf: str) -> DataFrame:
    q, d, gold = s.dense_inputs(spark, sf)
    scores = retrieval.dense_scores(q, d).withColumn("score", F.round("score", 6))
    candidates = q.select("question_id", "index_id").join(d.select("index_id", "doc_id"), "index_id")
    return retrieval.ranking_checks(retrieval.ranked(scores), candidates, gold)


@query("ranking_invariants_broken", f"""WITH {s.DENSE} SELECT * FROM (
SELECT 'duplicate_key' AS "check", 0::BIGINT AS n_bad UNION ALL SELECT 'rank_gap', count(DISTINCT question_id) FROM scores WHERE doc_id % 10 = 3 UNION ALL SELECT 'missing_candidate', count(*) FROM scores WHERE doc_id % 10 = 3
UNION ALL SELECT 'extra_candidate', 0 UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'score_rises', 0 UNION ALL SELECT 'tie_order', 0)
WHERE "check" <> 'rank_gap' UNION ALL SELECT 'rank_gap', count(*) FROM (SELECT question_id FROM dense GROUP BY 1 HAVING bool_or(doc_id % 10 = 3 AND rank < (SELECT max(rank) FROM dense d2 WHERE d2.question_id = dense.question_id AND d2.doc_id % 10 <> 3)))""")
def ranking_invariants_broken(spark: SparkSession, sf: str) -> DataFrame:
    q, d, _ = s.dense_inputs(spark, sf)
    scores = retrieval.dense_scores(q, d).withColumn("score", F.round("score", 6))
    candidates = q.select("question_id", "index_id").join(d.select("index_id", "doc_id"), "index_id")
    return retrieval.ranking_checks(retrieval.ranked(scores).filter("doc_id % 10 != 3"), candidates)


@query("window_order", f"""WITH {s.DENSE}, win AS (SELECT question_id, index_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS w FROM scores WHERE doc_id % 3 = 0),
moved AS (SELECT question_id, index_id, doc_id, CASE WHEN w % 50 = 7 THEN w + 1 WHEN w % 50 = 8 THEN w - 1 ELSE w END AS w FROM win)
SELECT question_id, index_id, doc_id FROM (SELECT m.*, d.rank AS f, lag(d.rank) OVER (PARTITION BY m.question_id ORDER BY m.w) AS before FROM moved m JOIN dense d USING (question_id, doc_id)) WHERE before > f""")
def window_order(spark: SparkSession, sf: str) -> DataFrame:
    """A window ranking with two neighbours in fifty exchanged, against the full ranking."""
    q, d, _ = s.dense_inputs(spark, sf)
    full = retrieval.dense_scores(q, d).withColumn("score", F.round("score", 6))
    window = retrieval.ranked(full.filter("doc_id % 3 = 0"))
    r = F.col("rank")
    moved = window.withColumn("rank", F.when(r % 50 == 7, r + 1).when(r % 50 == 8, r - 1).otherwise(r))
    return retrieval.window_order_checks(moved, retrieval.ranked(full)).select("question_id", "index_id", "doc_id")


@query("ranking_header", f"""WITH {s.DENSE}, g AS (SELECT question_id, count(DISTINCT doc_id) AS n_gold FROM gold GROUP BY 1)
SELECT s.question_id, s.index_id, count(*) AS n_candidates, count(gold.doc_id) AS n_gold_in, max(n_gold) AS n_gold, md5(string_agg(CAST(s.doc_id AS VARCHAR), ',' ORDER BY s.doc_id)) AS candidates_md5 FROM scores s LEFT JOIN gold USING (question_id, doc_id) LEFT JOIN g ON g.question_id = s.question_id GROUP BY 1, 2""")
def ranking_header(spark: SparkSession, sf: str) -> DataFrame:
    _, _, gold = s.dense_inputs(spark, sf)
    h = retrieval.ranking_header(_dense(spark, sf), gold)
    return h.select("question_id", "index_id", "n_candidates", "n_gold_in", F.col("n_gold").cast("long").alias("n_gold"), F.md5(F.array_join(F.transform("candidate_ids", lambda x: x.cast("string")), ",")).alias("candidates_md5"))


_AT = ", ".join(f"CAST(count(*) FILTER (WHERE rank <= {k}) > 0 AS DOUBLE) AS hit_{k}, count(*) FILTER (WHERE rank <= {k}) / count(*)::DOUBLE AS recall_{k}, CAST(count(*) FILTER (WHERE rank <= {k}) = count(*) AS DOUBLE) AS coverage_{k}" for k in metrics.CUTOFFS)
_METRICS = f"""window_ AS (SELECT question_id, index_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores WHERE doc_id % 7 <> 6),
sizes AS (SELECT question_id, count(*) AS N FROM window_ GROUP BY 1),
per AS (SELECT question_id, g.index_id, any_value(N) AS N, count(*) AS G, count(rank) AS G_in, {_AT}, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr, CAST(min(rank) AS DOUBLE) AS first_gold_rank,
 CASE WHEN count(rank) = count(*) THEN CAST(max(rank) AS DOUBLE) END AS last_gold_rank, min(rank) / any_value(N)::DOUBLE AS first_gold_pct FROM gold g LEFT JOIN window_ w USING (question_id, doc_id) JOIN sizes USING (question_id) GROUP BY 1, 2)"""
_NAMES = [f"{m}_{k}" for k in metrics.CUTOFFS for m in ("hit", "recall", "coverage")] + ["mrr", "last_gold_rank", "first_gold_pct"]


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    q, d, gold = s.dense_inputs(spark, sf)
    ranking = retrieval.ranked(retrieval.dense_scores(q, d).filter("doc_id % 7 != 6"), 6)
    return metrics.question_metrics(ranking, gold)


@query("metrics_per_question", f"WITH {s.DENSE}, {_METRICS} SELECT question_id, index_id, N, G, G_in, {', '.join(f'round({n}, 9) AS {n}' for n in [*_NAMES, 'first_gold_rank'])} FROM per")
def metrics_per_question(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("question_id", "index_id", "N", "G", "G_in", *[F.round(n, 9).alias(n) for n in [*_NAMES, "first_gold_rank"]])


_STACKED = " UNION ALL ".join(f"SELECT *, '{n}' AS metric, {n} AS v FROM per" for n in _NAMES)
_STRATUM = "SELECT {by} AS stratum, metric, count(*) AS n, count(v) AS n_valid, round(avg(v), 9) AS mean, round(median(v), 9) AS median FROM (" + _STACKED + ") GROUP BY ALL"


def _stratified(df: DataFrame, by) -> DataFrame:
    return metrics.stratified(df, by, _NAMES).withColumn("mean", F.round("mean", 9)).withColumn("median", F.round("median", 9))


@query("metrics_mean", f"WITH {s.DENSE}, {_METRICS} " + _STRATUM.format(by="'all'"))
def metrics_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _stratified(_metrics(spark, sf), F.lit("all"))


@query("metrics_by_n", f"WITH {s.DENSE}, {_METRICS} " + _STRATUM.format(by="CASE WHEN N <= 10 THEN '<=10' WHEN N <= 30 THEN '11-30' WHEN N <= 100 THEN '31-100' WHEN N <= 300 THEN '101-300' ELSE '>300' END"))
def metrics_by_n(spark: SparkSession, sf: str) -> DataFrame:
    return _stratified(_metrics(spark, sf), groups.candidate_bin(F.col("N")))


@query("metrics_by_g", f"WITH {s.DENSE}, {_METRICS} " + _STRATUM.format(by="CASE WHEN G = 1 THEN '1' WHEN G = 2 THEN '2' ELSE '>=3' END"))
def metrics_by_g(spark: SparkSession, sf: str) -> DataFrame:
    return _stratified(_metrics(spark, sf), groups.gold_stratum(F.col("G")))


def _baseline_sql() -> str:
    """Closed forms by products over ranges, as lists."""
    at = []
    for k in metrics.CUTOFFS:
        ke = f"least({k}, N)"
        miss = f"list_product([greatest(N - G_in - i, 0) / (N - i)::DOUBLE for i in range({ke})])"
        cover = f"list_product([greatest({ke} - i, 0) / (N - i)::DOUBLE for i in range(G_in)])"
        at += [f"CASE WHEN G_in > 0 THEN round(1 - {miss}, 9) ELSE 0 END AS hit_{k}", f"CASE WHEN G_in > 0 THEN round({ke} / N::DOUBLE * G_in / G, 9) ELSE 0 END AS recall_{k}", f"CASE WHEN G_in > 0 AND G_in = G AND {ke} >= G_in THEN round({cover}, 9) ELSE 0 END AS coverage_{k}"]
    mrr = "list_sum([coalesce(list_product([(N - G_in - j) / (N - j)::DOUBLE for j in range(r - 1)]), 1) * G_in / (N - r + 1)::DOUBLE / r for r in range(1, N - G_in + 2)])"
    return f"SELECT N, G_in, G, {', '.join(at)}, CASE WHEN G_in > 0 THEN round({mrr}, 9) ELSE 0 END AS mrr, CASE WHEN G_in > 0 AND G_in = G THEN round(G_in * (N + 1) / (G_in + 1)::DOUBLE, 9) END AS last_gold_rank, CASE WHEN G_in > 0 THEN round((N + 1) / ((G_in + 1) * N)::DOUBLE, 9) END AS first_gold_pct FROM cells"


_CELLS = "cells AS (SELECT N::BIGINT AS N, G_in::BIGINT AS G_in, G::BIGINT AS G FROM (VALUES (1,1,1),(3,1,1),(5,2,2),(7,3,3),(8,8,8),(12,2,2),(25,4,4),(10,1,2),(40,0,3)) t(N, G_in, G) UNION SELECT DISTINCT N, G_in, G FROM per)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (5, 2, 2), (7, 3, 3), (8, 8, 8), (12, 2, 2), (25, 4, 4), (10, 1, 2), (40, 0, 3)], "N long, G_in long, G long")
    return fixed.union(_metrics(spark, sf).select("N", "G_in", "G")).distinct()


@query("random_baseline", f"WITH {s.DENSE}, {_METRICS}, {_CELLS} {_baseline_sql()}")
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    b = metrics.random_baseline(_cells(spark, sf))
    return b.select("N", "G_in", "G", *[F.round(n, 9).alias(n) for n in _NAMES])


@query("lift", f"WITH {s.DENSE}, {_METRICS}, {_CELLS}, base AS ({_baseline_sql()}) SELECT round(avg(p.recall_5), 7) AS recall_5, round(avg(b.recall_5), 7) AS random_recall_5, round(avg(p.recall_5) - avg(b.recall_5), 7) AS difference, round(avg(p.recall_5) / avg(b.recall_5), 6) AS ratio FROM per p JOIN base b USING (N, G_in, G)")
def lift(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    joined = metrics.with_lift(m, metrics.random_baseline(m), ["recall_5"])
    a, b = F.avg("recall_5"), F.avg("random_recall_5")
    return joined.agg(F.round(a, 7).alias("recall_5"), F.round(b, 7).alias("random_recall_5"), F.round(a - b, 7).alias("difference"), F.round(F.try_divide(a, b), 6).alias("ratio"))


# Contexts: the five best documents of each question within a budget.

def _timeline_documents(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("index_id").orderBy("doc_id")
    return s.ranked_documents(spark, sf).select(F.col("index_id").alias("person_id"), (F.row_number().over(by) - 1).alias("visit_index"), F.concat(F.lit("day "), "doc_id").alias("visit_datetime"), "text", "doc_id")


def _contexts(spark: SparkSession, sf: str, budget: int, tokenizer: context.Tokenizer = context.CHAR) -> DataFrame:
    v = _timeline_documents(spark, sf)
    top = _bm25_top(spark, sf, 5).select(F.col("question_id").alias("key"), F.col("index_id").alias("person_id"), "doc_id")
    selection = top.join(v.select("person_id", "doc_id", "visit_index"), ["person_id", "doc_id"]).drop("doc_id")
    return context.build_contexts(selection, v.drop("doc_id"), budget, tokenizer)


_CONTEXT = f"""visits AS (SELECT index_id, doc_id, row_number() OVER (PARTITION BY index_id ORDER BY doc_id) - 1 AS i, text FROM docs),
sel AS (SELECT question_id AS key, i, '[Visit ' || i || ' | day ' || doc_id || ']' AS h, text AS t, length(text) AS b FROM bm25 JOIN visits USING (index_id, doc_id) WHERE rank <= 5),
tot AS (SELECT key, length(string_agg(h || chr(10) || t, chr(10) || chr(10) ORDER BY i)) AS total, sum(length(h) + 1) + 2 * (count(*) - 1) AS fixed, sum(b) AS sb FROM sel GROUP BY 1),
kept AS (SELECT key, i, h, t, b, total, fixed, CASE WHEN total > 3500 THEN least(b, floor(b * (3500 - fixed) / sb::DOUBLE)::BIGINT) ELSE b END AS a FROM sel JOIN tot USING (key)),
ctx AS (SELECT key, any_value(total) AS tokens_before, any_value(fixed) AS header_tokens, any_value(total) > 3500 AS truncated, string_agg(h || chr(10) || substr(t, 1, a), chr(10) || chr(10) ORDER BY i) AS context,
 string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS selected_ids, string_agg(CAST(a AS VARCHAR), ',' ORDER BY i) AS after FROM kept GROUP BY 1)"""


@query("context_budget_char", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_CONTEXT} SELECT key, CAST(tokens_before AS BIGINT) AS tokens_before, length(context) AS tokens_after, CAST(header_tokens AS BIGINT) AS header_tokens, truncated, selected_ids, after, sha256(context) AS context_sha256 FROM ctx")
def context_budget_char(spark: SparkSession, sf: str) -> DataFrame:
    c = _contexts(spark, sf, 3500)
    ids = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",")
    return c.select("key", "tokens_before", "tokens_after", "header_tokens", "truncated", ids("selected_ids").alias("selected_ids"), ids("visit_tokens_after").alias("after"), "context_sha256")


_GOLD = "g AS (SELECT key, i FROM (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY i) AS r FROM sel) WHERE r <= 2 UNION SELECT key, 49 FROM sel)"


def _survival(spark: SparkSession, sf: str) -> DataFrame:
    c = _contexts(spark, sf, 3500)
    gold = c.select("key", F.array_distinct(F.concat(F.slice("selected_ids", 1, 2), F.array(F.lit(49)))).alias("gold_ids"))
    return context.survival(c, gold)


@query("context_survival", f"""WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_CONTEXT}, {_GOLD}
SELECT g.key, count(*) AS n_gold, count(*) FILTER (WHERE a >= 1) AS n_gold_surviving, bool_and(coalesce(a = b, false)) AS fully_survived, CAST(coalesce(sum(b), 0) AS BIGINT) AS gold_tokens_before, CAST(coalesce(sum(a), 0) AS BIGINT) AS gold_tokens_after FROM g LEFT JOIN kept k ON g.key = k.key AND g.i = k.i GROUP BY 1""")
def context_survival(spark: SparkSession, sf: str) -> DataFrame:
    return _survival(spark, sf).select("key", "n_gold", "n_gold_surviving", "fully_survived", "gold_tokens_before", "gold_tokens_after")


@query("context_rates", f"""WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_CONTEXT}, {_GOLD}, sv AS (SELECT g.key, bool_and(coalesce(a = b, false)) AS f, count(*) FILTER (WHERE a >= 1) AS n FROM g LEFT JOIN kept k ON g.key = k.key AND g.i = k.i GROUP BY 1)
SELECT count(*) AS n, avg(truncated::INT) AS truncated, avg(f::INT) AS fully_survived, avg((n > 0)::INT) AS any_gold, avg(length(context)) AS mean_tokens, max(length(context)) AS max_tokens FROM ctx JOIN sv USING (key)""")
def context_rates(spark: SparkSession, sf: str) -> DataFrame:
    return context.context_rates(_survival(spark, sf))


@query("context_invariants", """SELECT * FROM (VALUES ('over_budget', 0::BIGINT), ('truncated_flag', 0::BIGINT), ('tokens_grow', 0::BIGINT), ('digest', 0::BIGINT)) t("check", n_bad)""")
def context_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return context.context_checks(_contexts(spark, sf, 3500), 3500)


@query("visit_spans", f"WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_CONTEXT} SELECT key, i AS visit_index, CAST(sum(length(h) + 1 + a + 2) OVER (PARTITION BY key ORDER BY i) - 2 - a AS BIGINT) AS \"start\", CAST(sum(length(h) + 1 + a + 2) OVER (PARTITION BY key ORDER BY i) - 2 AS BIGINT) AS \"end\" FROM kept")
def visit_spans(spark: SparkSession, sf: str) -> DataFrame:
    return context.visit_spans(_contexts(spark, sf, 3500)).select("key", *[F.col(c).cast("long").alias(c) for c in ("visit_index", "start", "end")])


@query("window_overlap_reach", f"""WITH {s.DOCS}, {s.QUESTIONS}, {_BM25}, {_CONTEXT}, sp AS (SELECT key, i, sum(length(h) + 1 + a + 2) OVER (PARTITION BY key ORDER BY i) - 2 - a AS s, sum(length(h) + 1 + a + 2) OVER (PARTITION BY key ORDER BY i) - 2 AS e FROM kept)
SELECT key, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE (0 < e AND s < 900) OR (2000 < e AND s < 2400)), '') AS reached FROM sp GROUP BY 1""")
def window_overlap_reach(spark: SparkSession, sf: str) -> DataFrame:
    spans = context.visit_spans(_contexts(spark, sf, 3500)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("visit_index", "start", "end"))).alias("s"))
    windows = F.array(F.struct(F.lit(0).alias("start"), F.lit(900).alias("end")), F.struct(F.lit(2000).alias("start"), F.lit(2400).alias("end")))
    return spans.select("key", F.array_join(F.transform(readers.visits_reached(F.col("s"), windows), lambda x: x.cast("string")), ",").alias("reached"))


@query("sliding_windows", """WITH d AS (SELECT doc_id AS key, n_chars AS n FROM documents) SELECT key, k AS "window", k * 256 AS "start", least(k * 256 + 384, n) AS "end" FROM d, range(0, 2000) r(k) WHERE k <= greatest(CAST(ceil((n - 384) / 256.0) AS BIGINT), 0)""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = s.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("n_tokens"))
    return readers.sliding_windows(d, F.lit(384), 128).select("key", "window", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_POSITIONS = """pos AS (SELECT user_id AS key, CAST(event_id % 2 AS BIGINT) AS w, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS pos, floor(value) AS a, floor(value * 7) % 11 AS b, event_id % 13 <> 0 AS ok FROM events WHERE value IS NOT NULL)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").filter("value is not null")
    by = Window.partitionBy("user_id", F.col("event_id") % 2).orderBy("event_id")
    p = e.select(F.col("user_id").alias("key"), (F.col("event_id") % 2).alias("window"), (F.row_number().over(by) - 1).cast("long").alias("pos"), F.floor("value").cast("double").alias("start_logit"), (F.floor(F.col("value") * 7) % 11).cast("double").alias("end_logit"), (F.col("event_id") % 13 != 0).alias("in_context"))
    return readers.best_spans(p, 8)


_BEST = f"""{_POSITIONS}, sp AS (SELECT x.key, x.w, x.pos AS i, y.pos AS j, x.a + y.b AS score FROM pos x JOIN pos y ON x.key = y.key AND x.w = y.w AND y.pos BETWEEN x.pos AND x.pos + 7 WHERE x.ok AND y.ok),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY score DESC, j - i, i) AS r FROM sp) WHERE r = 1)"""


@query("best_span", f"""WITH {_BEST} SELECT key, w AS "window", i, j, CAST(score AS DOUBLE) AS score FROM best""")
def best_span(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf)


@query("best_window", f"""WITH {_BEST} SELECT key, w AS "window", i, j, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, w) AS q FROM best) WHERE q = 1""")
def best_window(spark: SparkSession, sf: str) -> DataFrame:
    return readers.best_window(_spans(spark, sf))


@query("overlap_reader", f"""WITH {s.PAIRS}, t AS (SELECT conv_id, turn, {s.sql_tokens('question')} AS q, {s.sql_tokens('answer')} AS a FROM pairs) SELECT conv_id, turn, len(list_filter(a, lambda x: list_contains(q, x))) AS n_hits FROM t WHERE len(a) > 0""")
def overlap_reader(spark: SparkSession, sf: str) -> DataFrame:
    p = s.answer_pairs(spark, sf).withColumn("key", F.struct("conv_id", "turn"))
    logits = models.overlap_logits(p, text.retrieval_tokens(F.col("question")), text.retrieval_tokens(F.col("answer")))
    return logits.groupBy("key.conv_id", "key.turn").agg(F.sum("start_logit").cast("long").alias("n_hits"))


@query("answer_leakage", f"""WITH {s.PAIRS}, n AS (SELECT {s.sql_clean('answer')} AS a, {s.sql_clean('question')} AS q, {s.sql_clean('question || chr(32) || substr(answer, 1, 60)')} AS c FROM pairs) SELECT count(*) AS n, count(*) FILTER (WHERE a <> '' AND contains(c, a)) AS answer_in_context, count(*) FILTER (WHERE a <> '' AND contains(q, a)) AS answer_in_question FROM n""")
def answer_leakage(spark: SparkSession, sf: str) -> DataFrame:
    p = s.answer_pairs(spark, sf).withColumn("key", F.struct("conv_id", "turn"))
    c = p.select("key", F.concat("question", F.lit(" "), F.substring("answer", 1, 60)).alias("context"))
    return context.leakage(c, p.select("key", "question", "answer"), text.clean_text)


@query("strict_join_orders", "SELECT c_custkey, count(*) AS n_orders, any_value(c_mktsegment) AS segment FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def strict_join_orders(spark: SparkSession, sf: str) -> DataFrame:
    per = s.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    customers = s.table(spark, sf, "customer").join(per.select("c_custkey"), "c_custkey", "left_semi")
    return checks.strict_join(per, customers, ["c_custkey"]).select("c_custkey", "n_orders", F.col("c_mktsegment").alias("segment"))


@query("covariates", "SELECT e.event_id, u.first_type FROM events e JOIN (SELECT user_id, min_by(event_type, event_id) AS first_type FROM events GROUP BY 1) u USING (user_id)")
def covariates(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events")
    users = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))
    return checks.covariate_join(e, users, ["user_id"]).select("event_id", "first_type")


@query("set_difference", "SELECT DISTINCT user_id AS id, 'left' AS side FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION SELECT DISTINCT c_custkey, 'right' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a = s.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    b = s.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return checks.set_difference(a, b, ["id"])


@query("reproduction", "SELECT 'value' AS \"column\", count(*) AS n, 0.0::DOUBLE AS max_abs_diff, true AS passed FROM events WHERE event_id IS NOT NULL")
def reproduction(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").select("event_id", "value")
    return checks.reproduction(e, e, ["event_id"], ["value"])

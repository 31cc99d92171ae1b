"""Queries over answers: text scores, grades, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import scoring
from . import standins as s
from .registration import query

_TOK = f"t AS (SELECT *, {s.sql_answer('prediction')} AS p, {s.sql_answer('answer')} AS g, len({s.sql_words('prediction')}) AS nw, {s.sql_strip('prediction')} = '' AS e FROM pairs)"
_F1 = """f AS (SELECT *, list_sum(list_transform(list_intersect(p, g), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x)))))::DOUBLE AS same FROM t)"""
_SCORE = "CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END"


@query("squad_normalize", f"WITH {s.PAIRS}, {_TOK} SELECT conv_id, turn, md5(array_to_string(g, ' ')) AS answer_md5 FROM t")
def squad_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return s.answer_pairs(spark, sf).select("conv_id", "turn", F.md5(text.answer_text(F.col("answer"))).alias("answer_md5"))


@query("em_f1", f"WITH {s.PAIRS}, {_TOK}, {_F1} SELECT conv_id, turn, CASE WHEN e THEN 0 ELSE CAST(array_to_string(p, ' ') = array_to_string(g, ' ') AS DOUBLE) END AS em, CASE WHEN e THEN 0 ELSE round({_SCORE}, 9) END AS f1, nw AS n_words_pred, e AS empty_prediction FROM f")
def em_f1(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.answer_scores(s.answer_pairs(spark, sf)).select("conv_id", "turn", "em", F.round("f1", 9).alias("f1"), "n_words_pred", "empty_prediction")


_SIGNED = f"signed AS (SELECT conv_id, turn, '“The ' || coalesce(answer, '') || '” rose—a’s an… ' || 'the_a' AS answer, 'THE “a”—' || prediction || ' the' AS prediction FROM pairs)"


@query("em_f1_signs", f"WITH {s.PAIRS}, {_SIGNED}, {_TOK.replace('FROM pairs', 'FROM signed')}, {_F1} SELECT conv_id, turn, md5(array_to_string(g, ' ')) AS answer_md5, CAST(array_to_string(p, ' ') = array_to_string(g, ' ') AS DOUBLE) AS em, round({_SCORE}, 9) AS f1 FROM f")
def em_f1_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers between typographic quotes and dashes, where articles are no white-space words."""
    p = s.answer_pairs(spark, sf)
    p = p.withColumn("answer", F.concat(F.lit("“The "), "answer", F.lit("” rose—a’s an… the_a"))).withColumn("prediction", F.concat(F.lit("THE “a”—"), "prediction", F.lit(" the")))
    scored = scoring.answer_scores(p)
    return scored.select("conv_id", "turn", F.md5(text.answer_text(F.col("answer"))).alias("answer_md5"), "em", F.round("f1", 9).alias("f1"))


@query("em_f1_step3", f"WITH {s.PAIRS}, {_TOK}, {_F1} SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE round({_SCORE}, 9) END AS f1 FROM f")
def em_f1_step3(spark: SparkSession, sf: str) -> DataFrame:
    return s.answer_pairs(spark, sf).select("conv_id", "turn", F.round(text.token_f1(F.col("prediction"), F.col("answer"), empty_equal=True), 9).alias("f1"))


#: What a judge wrote, by conv_id mod 10; {} is a number.
_WRITTEN = [
    "Feedback [RESULT] {}", "[RESULT] 2 [RESULT] {}", "no result {}", "[RESULT] 3.5 {}", "[RESULT] +{}", "[RESULT] -{}", "[RESULT]", "[RESULT] .{}", "[RESULT] Score.{}", "so [RESULT] ...{}.",
]


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    c = s.table(spark, sf, "conversations")
    form = F.element_at(F.array(*map(F.lit, _WRITTEN)), (F.col("conv_id") % 10 + 1).cast("int"))
    first = F.replace(form, F.lit("{}"), (F.length("text") % 7).cast("string"))
    return c.select("conv_id", "turn", "role", first.alias("first_text"), F.concat(F.lit("again [RESULT] "), (F.length("text") % 9).cast("string")).alias("retry_text"))


_OUT = f"""o AS (SELECT conv_id, turn, role, replace(list_extract({_WRITTEN}, conv_id % 10 + 1), '{{}}', (length(text) % 7)::VARCHAR) AS a, 'again [RESULT] ' || (length(text) % 9) AS b FROM conversations),
x AS (SELECT *, CASE WHEN contains(a, '[RESULT]') THEN regexp_extract_all(string_split(a, '[RESULT]')[-1], '[+-]?[0-9]+(?:[.][0-9]+)?')[1] END AS na, regexp_extract_all(string_split(b, '[RESULT]')[-1], '[+-]?[0-9]+(?:[.][0-9]+)?')[1] AS nb FROM o),
y AS (SELECT *, CASE WHEN NOT contains(na, '.') AND TRY_CAST(na AS BIGINT) BETWEEN 1 AND 5 THEN CAST(na AS INT) END AS ga, CASE WHEN NOT contains(nb, '.') AND TRY_CAST(nb AS BIGINT) BETWEEN 1 AND 5 THEN CAST(nb AS INT) END AS gb FROM x),
graded AS (SELECT *, coalesce(ga, gb, 1) AS score, ga IS NULL AS invalid_first, ga IS NULL AND gb IS NULL AS invalid_final FROM y)"""


@query("judge_parse", f"WITH {_OUT} SELECT conv_id, turn, CAST(score AS BIGINT) AS score, invalid_first, invalid_final FROM graded")
def judge_parse(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.graded(_outputs(spark, sf)).select("conv_id", "turn", F.col("score").cast("long").alias("score"), "invalid_first", "invalid_final")


@query("judge_distribution", f"WITH {_OUT} SELECT role, {', '.join(f'count(*) FILTER (WHERE score = {g}) AS n{g}' for g in range(1, 6))}, count(*) AS n FROM graded GROUP BY 1")
def judge_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.grade_distribution(scoring.graded(_outputs(spark, sf)), "role")


@query("judge_assembly", f"WITH {s.PAIRS}, {_TOK} SELECT conv_id || '|' || turn AS item_id, CAST(CASE WHEN e THEN 1 ELSE 1 + conv_id % 5 END AS BIGINT) AS score, NOT e AS judge_called FROM t")
def judge_assembly(spark: SparkSession, sf: str) -> DataFrame:
    p = scoring.answer_scores(s.answer_pairs(spark, sf)).withColumn("item_id", text.joined_key(F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    called = p.filter("not empty_prediction").select("item_id", (1 + F.col("conv_id") % 5).alias("score"))
    return scoring.assembled_grades(called, p).select("item_id", F.col("score").cast("long").alias("score"), "judge_called")


@query("empty_rollup", f"WITH {s.PAIRS}, {_TOK} SELECT coalesce(CAST(conv_id % 3 AS VARCHAR), 'ALL') AS reader, coalesce(CAST(turn AS VARCHAR), 'ALL') AS condition, count(*) AS n, count(*) FILTER (WHERE e) AS n_empty, count(*) FILTER (WHERE e) / count(*)::DOUBLE AS rate FROM t GROUP BY ROLLUP (conv_id % 3, turn)")
def empty_rollup(spark: SparkSession, sf: str) -> DataFrame:
    p = scoring.answer_scores(s.answer_pairs(spark, sf)).withColumn("reader", F.col("conv_id") % 3).withColumn("condition", F.col("turn"))
    return scoring.empty_log(p, "reader", "condition")


@query("pivot_matrix", "SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in ("click", "error", "view")) + " FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL) GROUP BY 1")
def pivot_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return scoring.pivoted(e, ["user_id"], "event_type", ["click", "error", "view"], "value")


@query("probe_texts", f"""WITH {s.PAIRS}, w AS (SELECT conv_id, turn, {s.sql_words('answer')} AS w FROM pairs) SELECT conv_id, turn, array_to_string(w[1:greatest(1, len(w) // 3)], ' ') AS probe FROM w""")
def probe_texts(spark: SparkSession, sf: str) -> DataFrame:
    return s.answer_pairs(spark, sf).select("conv_id", "turn", text.first_third(F.col("answer")).alias("probe"))


@query("vector_match", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT vec_id // 6 AS k, vec_id, v FROM e WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 6 AS k, vec_id, v FROM e WHERE vec_id % 2 = 1),
c AS (SELECT k, a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM a JOIN b USING (k)),
p AS (SELECT k, avg(m) AS p FROM (SELECT k, x, max(s) AS m FROM c GROUP BY 1, 2) GROUP BY 1), r AS (SELECT k, avg(m) AS r FROM (SELECT k, y, max(s) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT k, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 5) AS f FROM p JOIN r USING (k)""")
def vector_match(spark: SparkSession, sf: str) -> DataFrame:
    """Six consecutive vectors are the tokens of two texts: the even ids of one, the odd ids of the other."""
    e = s.table(spark, sf, "embeddings").withColumn("k", F.floor(F.col("vec_id") / 6))
    a, b = (e.filter(F.col("vec_id") % 2 == odd).groupBy("k").agg(F.collect_list("embedding").alias(name)) for odd, name in ((0, "a"), (1, "b")))
    m = a.join(b, "k").withColumn("m", scoring.vector_match(F.col("a"), F.col("b")))
    return m.select("k", F.round("m.p", 6).alias("p"), F.round("m.r", 6).alias("r"), F.round("m.f", 5).alias("f"))

"""Queries over several runs: assembly, gates, agreement with intervals, subsets, prompts, generation, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import groups, text
from ..operators import checks, context, evidence, inference, qa, readers, runs, sampling, scoring
from . import models
from . import standins as s
from .registration import query
from .retrieval_queries import _timeline_documents
from .statistics_queries import _DRAWS, _RATERS, _raters
from .timeline_queries import _QUOTED, _aligned

KEYS = ["conv_id", "turn"]


def _predictions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, contexts, dataset): two readers under two conditions answer each turn."""
    pairs = s.answer_pairs(spark, sf)
    conditions = pairs.withColumn("condition", F.explode(F.array(F.lit("oracle"), F.lit("near"))))
    survived = (F.col("condition") == "oracle") | ((F.col("conv_id") + F.col("turn")) % 3 != 0)
    contexts = conditions.select(*KEYS, "condition", survived.alias("fully_survived"), F.sha2(F.concat("condition", F.lit("|"), "question"), 256).alias("context_sha256"), F.least(F.length("question"), F.lit(3500)).alias("tokens_after"))
    given = F.when((F.col("reader") == "b") & (F.col("conv_id") % 4 == 1), F.lit(" ")).when((F.col("reader") == "a") & (F.col("condition") == "oracle"), F.col("answer")).otherwise(F.col("prediction"))
    asked = conditions.withColumn("reader", F.explode(F.array(F.lit("a"), F.lit("b")))).select("reader", "condition", *KEYS, given.alias("prediction"))
    return asked.join(contexts, ["condition", *KEYS]), contexts, pairs.select(*KEYS, "question", "answer", "n_question")


_RUNS = f"""{s.PAIRS}, conds AS (SELECT * FROM (VALUES ('oracle'), ('near')) c(condition)), rds AS (SELECT * FROM (VALUES ('a'), ('b')) r(reader)),
preds AS (SELECT reader, condition, conv_id, turn, CASE WHEN reader = 'b' AND conv_id % 4 = 1 THEN ' ' WHEN reader = 'a' AND condition = 'oracle' THEN answer ELSE prediction END AS prediction,
 condition = 'oracle' OR (conv_id + turn) % 3 <> 0 AS fully_survived, sha256(condition || '|' || question) AS context_sha256, least(length(question), 3500) AS tokens_after, question, answer FROM pairs, conds, rds)"""


@query("run_assembly", f"WITH {_RUNS} SELECT reader, condition, conv_id, turn, fully_survived, md5(answer) AS answer_md5, regexp_matches(prediction, '^{s.SPACE}*$') AS empty_prediction FROM preds")
def run_assembly(spark: SparkSession, sf: str) -> DataFrame:
    predictions, contexts, dataset = _predictions(spark, sf)
    rows = runs.assembled_runs(predictions, contexts, dataset, KEYS)
    return rows.select("reader", "condition", *KEYS, "fully_survived", F.md5("answer").alias("answer_md5"), "empty_prediction")


_BROKEN = """given AS (SELECT * FROM preds WHERE NOT (reader = 'b' AND condition = 'near') AND NOT (reader = 'a' AND condition = 'near' AND conv_id % 10 = 3)
 UNION ALL SELECT * REPLACE ('x' AS context_sha256, 9999 AS tokens_after, NULL AS prediction) FROM preds WHERE reader = 'a' AND condition = 'oracle' AND conv_id % 10 = 4)"""


def _broken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    predictions, _, dataset = _predictions(spark, sf)
    given = predictions.filter("not (reader = 'b' and condition = 'near') and not (reader = 'a' and condition = 'near' and conv_id % 10 = 3)")
    again = predictions.filter("reader = 'a' and condition = 'oracle' and conv_id % 10 = 4").withColumns({"context_sha256": F.lit("x"), "tokens_after": F.lit(9999), "prediction": F.lit(None).cast("string")})
    return given.unionByName(again), dataset


@query("run_checks", f"""WITH {_RUNS}, {_BROKEN}, k AS (SELECT count(*) AS n FROM pairs), per AS (SELECT reader, condition, count(*) AS n, count(DISTINCT (conv_id, turn)) AS d FROM given GROUP BY ALL)
SELECT 'missing_run' AS "check", (SELECT count(*) FROM conds, rds) - (SELECT count(*) FROM per) AS n_bad UNION ALL SELECT 'extra_run', 0 UNION ALL SELECT 'repeated_key', count(*) FROM per WHERE n > d
UNION ALL SELECT 'incomplete_keys', count(*) FROM per, k WHERE d < k.n UNION ALL SELECT 'unknown_key', 0
UNION ALL SELECT 'contexts_differ', count(*) FROM (SELECT condition, conv_id, turn FROM given GROUP BY ALL HAVING min(context_sha256) <> max(context_sha256))
UNION ALL SELECT 'over_budget', count(*) FROM given WHERE tokens_after > 3500 UNION ALL SELECT 'null_prediction', count(*) FROM given WHERE prediction IS NULL""")
def run_checks(spark: SparkSession, sf: str) -> DataFrame:
    given, dataset = _broken(spark, sf)
    given = given.withColumn("key", F.concat_ws("|", *KEYS))
    expected = spark.createDataFrame([(r, c) for r in "ab" for c in ("oracle", "near")], "reader string, condition string")
    return checks.run_checks(given, expected, dataset.select(F.concat_ws("|", *KEYS).alias("key")), ["reader", "condition"], "key", 3500)


@query("score_gate", f"""WITH {_RUNS}, {_BROKEN}, k AS (SELECT count(*) AS n FROM pairs) SELECT reader, condition, count(*) AS n_rows, count(DISTINCT (conv_id, turn)) AS n_keys, 0::BIGINT AS n_unknown, count(*) FILTER (WHERE prediction IS NULL) AS n_null,
count(*) FILTER (WHERE prediction = '') AS n_empty, count(*) FILTER (WHERE regexp_matches(prediction, '^{s.SPACE}*$')) AS n_blank, any_value(k.n) - count(DISTINCT (conv_id, turn)) AS n_lacking,
count(*) = any_value(k.n) AND count(DISTINCT (conv_id, turn)) = any_value(k.n) AND bool_and(prediction IS NOT NULL) AS passed FROM given, k GROUP BY ALL""")
def score_gate(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_gate(*_broken(spark, sf), KEYS)


@query("context_agreement", f"WITH {_RUNS} SELECT condition, conv_id, turn, count(DISTINCT context_sha256) AS n_contexts, count(*) AS n_readers FROM preds GROUP BY ALL")
def context_agreement(spark: SparkSession, sf: str) -> DataFrame:
    predictions, _, _ = _predictions(spark, sf)
    return predictions.groupBy("condition", *KEYS).agg(F.countDistinct("context_sha256").alias("n_contexts"), F.count("*").alias("n_readers"))


_POS = "rp AS (SELECT a, b, row_number() OVER (ORDER BY doc_id, a, b) - 1 AS key_pos FROM r)"
_RATED = f"{_RATERS}, {_POS}, runs AS (SELECT key_pos FROM rp)"
_AGREED = """cells AS (SELECT b, x.a AS i, x.b AS j, sum(w) AS o FROM rp x JOIN w USING (key_pos) GROUP BY ALL UNION ALL SELECT -1, a, b, count(*) FROM rp GROUP BY ALL)""".replace("SELECT b, x.a", "SELECT w.b, x.a")
_AGREED_STATS = """tot AS (SELECT b, sum(o)::DOUBLE AS n FROM cells GROUP BY 1), mi AS (SELECT b, i, sum(o)::DOUBLE AS m FROM cells GROUP BY ALL), mj AS (SELECT b, j, sum(o)::DOUBLE AS m FROM cells GROUP BY ALL),
ki AS (SELECT x.b, x.i, any_value(x.m) AS m, coalesce(sum(y.m) FILTER (WHERE y.i < x.i), 0) + (any_value(x.m) + 1) / 2 AS r FROM mi x JOIN mi y USING (b) GROUP BY ALL),
kj AS (SELECT x.b, x.j, any_value(x.m) AS m, coalesce(sum(y.m) FILTER (WHERE y.j < x.j), 0) + (any_value(x.m) + 1) / 2 AS r FROM mj x JOIN mj y USING (b) GROUP BY ALL),
se AS (SELECT b, sum(o * (i - j) * (i - j))::DOUBLE AS s FROM cells GROUP BY 1), ex AS (SELECT b, sum(mi.m * mj.m * (i - j) * (i - j)) / any_value(n) AS e FROM mi JOIN mj USING (b) JOIN tot USING (b) GROUP BY 1),
rr AS (SELECT b, sum(o * (ki.r - (n + 1) / 2) * (kj.r - (n + 1) / 2)) AS xy FROM cells JOIN ki USING (b, i) JOIN kj USING (b, j) JOIN tot USING (b) GROUP BY 1),
vi AS (SELECT b, sum(m * (r - (n + 1) / 2) * (r - (n + 1) / 2)) AS v FROM ki JOIN tot USING (b) GROUP BY 1), vj AS (SELECT b, sum(m * (r - (n + 1) / 2) * (r - (n + 1) / 2)) AS v FROM kj JOIN tot USING (b) GROUP BY 1),
bi AS (SELECT b, sum(o) FILTER (WHERE (i >= 4) = (j >= 4)) / any_value(n) AS acc, coalesce(sum(o) FILTER (WHERE i >= 4), 0) / any_value(n) AS p, coalesce(sum(o) FILTER (WHERE j >= 4), 0) / any_value(n) AS q FROM cells JOIN tot USING (b) GROUP BY 1),
st AS (SELECT b, 1 - s / nullif(e, 0) AS qwk, xy / nullif(sqrt(vi.v * vj.v), 0) AS rho, CASE WHEN abs(1 - (p * q + (1 - p) * (1 - q))) > 1e-12 THEN (acc - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) END AS binary_kappa, acc AS binary_accuracy
 FROM se JOIN ex USING (b) JOIN rr USING (b) JOIN vi USING (b) JOIN vj USING (b) JOIN bi USING (b)),
un AS (UNPIVOT st ON qwk, rho, binary_kappa, binary_accuracy INTO NAME statistic VALUE v)"""


@query("agreement_intervals", f"""WITH {_RATED}, {_DRAWS}, {_AGREED}, {_AGREED_STATS}
SELECT statistic, round(max(v) FILTER (WHERE b = -1), 8) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE b >= 0), 8) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE b >= 0), 8) AS high, count(v) FILTER (WHERE b >= 0) AS n_resamples FROM un GROUP BY 1""")
def agreement_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rated = _raters(spark, sf).withColumn("key_pos", F.row_number().over(Window.orderBy("doc_id", "a", "b")) - 1).select("key_pos", "a", "b")  # a rated sample
    draws = inference.arithmetic_draws(rated.select(F.col("key_pos").cast("long").alias("key_pos")), 1000)
    out = runs.agreement_intervals(rated, "a", "b", 5, 4, draws)
    return out.select("statistic", *[F.round(c, 8).alias(c) for c in ("estimate", "low", "high")], "n_resamples")


_MEMBERS = f"sv AS (SELECT run AS condition, key_pos, value > 0 OR key_pos % 3 = 0 AS survived FROM runs)"


def _survived(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = s.run_values(spark, sf)
    return v, v.select(F.col("run").alias("condition"), "key_pos", ((F.col("value") > 0) | (F.col("key_pos") % 3 == 0)).alias("survived"))


@query("pairwise_survivors", f"""WITH {s.RUN_VALUES}, {_MEMBERS}, m AS (SELECT a.condition AS subset, a.key_pos FROM sv a JOIN sv o ON a.key_pos = o.key_pos AND o.condition = 'click' AND o.survived WHERE a.survived AND a.condition <> 'click'),
x AS (SELECT subset, run, count(*) AS n, avg(value) AS mean FROM runs JOIN m USING (key_pos) GROUP BY ALL) SELECT x.subset, x.run, x.n, CASE WHEN x.n >= 100 THEN round(x.mean, 9) END AS mean, CASE WHEN x.n >= 100 THEN round(o.mean - x.mean, 9) END AS oracle_gap FROM x LEFT JOIN x o ON o.subset = x.subset AND o.run = 'click'""")
def pairwise_survivors(spark: SparkSession, sf: str) -> DataFrame:
    v, alive = _survived(spark, sf)
    out = runs.subset_means(v, runs.pairwise_survivors(alive, "click"), "click", 100)
    return out.select("subset", "run", "n", F.round("mean", 9).alias("mean"), F.round("oracle_gap", 9).alias("oracle_gap"))


@query("oracle_fairness", f"""WITH {s.RUN_VALUES}, g AS (SELECT DISTINCT key_pos, 1 + key_pos % 8 AS n_gold, least(1 + key_pos % 8, 3 + key_pos % 4) AS n_reaching FROM runs),
m AS (SELECT 'all_keys' AS subset, key_pos FROM g UNION ALL SELECT 'gold_le5', key_pos FROM g WHERE n_gold <= 5 UNION ALL SELECT 'gold_gt5', key_pos FROM g WHERE n_gold > 5 UNION ALL SELECT 'reaching_le5', key_pos FROM g WHERE n_reaching <= 5 UNION ALL SELECT 'reaching_gt5', key_pos FROM g WHERE n_reaching > 5),
x AS (SELECT subset, run, count(*) AS n, avg(value) AS mean FROM runs JOIN m USING (key_pos) GROUP BY ALL) SELECT x.subset, x.run, x.n, round(x.mean, 9) AS mean, round(o.mean - x.mean, 9) AS oracle_gap FROM x LEFT JOIN x o ON o.subset = x.subset AND o.run = 'view'""")
def oracle_fairness(spark: SparkSession, sf: str) -> DataFrame:
    v = s.run_values(spark, sf)
    k = F.col("key_pos")
    gold = v.select("key_pos").distinct().select("key_pos", (1 + k % 8).alias("n_gold"), F.least(1 + k % 8, 3 + k % 4).alias("n_reaching"))
    out = runs.subset_means(v, runs.fairness_subsets(gold), "view")
    return out.select("subset", "run", "n", F.round("mean", 9).alias("mean"), F.round("oracle_gap", 9).alias("oracle_gap"))


_GRADED = "g AS (SELECT event_type AS run, CAST(1 + event_id % 5 AS BIGINT) AS score, event_id % 11 = 0 AS invalid_final, event_id % 7 = 0 AS empty_prediction, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value) END AS BIGINT) AS n_words FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)"


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    e, k = s.table(spark, sf, "events").filter("value is not null and event_type is not null"), F.col("event_id")
    return e.select(F.col("event_type").alias("run"), (1 + k % 5).cast("long").alias("score"), (k % 11 == 0).alias("invalid_final"), (k % 7 == 0).alias("empty_prediction"), F.when(k % 7 == 0, 0).otherwise(F.floor("value")).cast("long").alias("n_words"))


@query("judge_sensitivity", f"WITH {_GRADED} SELECT run, count(*) AS n, round(avg(score), 9) AS mean, round(avg((score >= 4)::INT), 9) AS at_least_4, round(avg((score >= 3)::INT), 9) AS at_least_3, round(avg((score = 5)::INT), 9) AS exactly_5, count(*) FILTER (WHERE NOT invalid_final) AS n_valid, round(avg(score) FILTER (WHERE NOT invalid_final), 9) AS mean_valid FROM g GROUP BY 1")
def judge_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.judge_sensitivity(_graded(spark, sf), "run")
    return out.select("run", "n", *[F.round(c, 9).alias(c) for c in ("mean", "at_least_4", "at_least_3", "exactly_5")], "n_valid", F.round("mean_valid", 9).alias("mean_valid"))


def _rho_sql(where: str) -> str:
    k = f"SELECT run, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY run ORDER BY n_words) + (count(*) OVER (PARTITION BY run, n_words) - 1) / 2.0 AS y FROM g WHERE {where}"
    return f"SELECT run, corr(x, y) AS rho FROM ({k}) GROUP BY 1"


@query("length_bias", f"WITH {_GRADED}, a AS ({_rho_sql('true')}), e AS ({_rho_sql('NOT empty_prediction')}), w AS (SELECT run, count(*) AS n, avg(n_words) AS m, median(n_words) AS d FROM g GROUP BY 1) SELECT run, n, round(m, 9) AS mean_words, d AS median_words, round(a.rho, 8) AS rho, round(e.rho, 8) AS rho_not_empty FROM w JOIN a USING (run) JOIN e USING (run)")
def length_bias(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.length_bias(_graded(spark, sf), "run")
    return out.select("run", "n", F.round("mean_words", 9).alias("mean_words"), "median_words", F.round("rho", 8).alias("rho"), F.round("rho_not_empty", 8).alias("rho_not_empty"))


# The oracle condition: question k of source k mod 20 has as gold the source's visits whose document ids equal k modulo 97.
_ORACLE = f"""{s.DOCS}, {s.QUESTIONS}, visits AS (SELECT index_id, doc_id, row_number() OVER (PARTITION BY index_id ORDER BY doc_id) - 1 AS i, text FROM docs),
sel AS (SELECT question_id AS key, i, '[Visit ' || i || ' | day ' || doc_id || ']' AS h, coalesce(v.text, '') AS t, length(coalesce(v.text, '')) AS b FROM questions q JOIN visits v USING (index_id) WHERE doc_id % 97 = question_id % 97),
tot AS (SELECT key, length(string_agg(h || chr(10) || t, chr(10) || chr(10) ORDER BY i)) AS total, sum(length(h) + 1) + 2 * (count(*) - 1) AS fixed, sum(b) AS sb FROM sel GROUP BY 1),
kept AS (SELECT key, i, h, t, b, total, CASE WHEN total > 3500 THEN least(b, floor(b * (3500 - fixed) / sb::DOUBLE)::BIGINT) ELSE b END AS a FROM sel JOIN tot USING (key))"""


@query("oracle_contexts", f"WITH {_ORACLE} SELECT key, count(*) AS n_gold, bool_and(a = b) AS fully_survived, count(*) FILTER (WHERE a >= 1) AS n_gold_surviving, any_value(total) > 3500 AS truncated, md5(string_agg(h || chr(10) || substr(t, 1, a), chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM kept GROUP BY 1")
def oracle_contexts(spark: SparkSession, sf: str) -> DataFrame:
    visits = _timeline_documents(spark, sf)
    asked = s.questions(spark, sf).select(F.col("question_id").alias("key"), F.col("index_id").alias("person_id"))
    gold = asked.join(visits, "person_id").filter(F.col("doc_id") % 97 == F.col("key") % 97).groupBy("key", "person_id").agg(F.array_sort(F.collect_set("visit_index")).alias("gold_ids"))
    contexts = context.build_contexts(runs.oracle_selection(gold), visits.drop("doc_id"), 3500, headers_alone=True)  # gold however long
    out = context.survival(contexts, gold.select("key", "gold_ids"))
    return out.select("key", "n_gold", "fully_survived", "n_gold_surviving", "truncated", F.md5("context").alias("context_md5"))


_TEMPLATE = "Context: %s\nQuestion: %s\nAnswer:"


@query("reader_prompts", f"WITH {s.PAIRS}, p AS (SELECT conv_id, turn, 'Context: ' || answer || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS t FROM pairs) SELECT conv_id, turn, md5(t) AS prompt_md5, length(t) AS n_ids, CAST(list_sum(list_transform(string_split(t, ''), lambda x: ascii(x))) AS BIGINT) AS id_sum FROM p")
def reader_prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = runs.prompt_ids(s.answer_pairs(spark, sf), _TEMPLATE, ["answer", "question"])
    total = F.aggregate("prompt_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.size("prompt_ids").cast("long").alias("n_ids"), total.alias("id_sum"))


@query("judge_prompts", f"WITH {s.PAIRS} SELECT conv_id, turn, md5('### Task' || chr(10) || question || chr(10) || '### Response' || chr(10) || prediction || chr(10) || '### Reference' || chr(10) || answer) AS prompt_md5 FROM pairs")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = scoring.judge_prompt("### Task\n%s\n### Response\n%s\n### Reference\n%s", "question", "prediction", "answer")
    return s.answer_pairs(spark, sf).select("conv_id", "turn", F.md5(p).alias("prompt_md5"))


@query("condition_labels", "SELECT n_nationkey, n_name || '@' || (n_regionkey % 2) AS condition, CAST(floor((n_nationkey + n_regionkey) / 2.0 + 0.5) AS BIGINT) AS label FROM nation")
def condition_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = s.table(spark, sf, "nation")
    return n.select("n_nationkey", groups.condition_id(F.col("n_name"), (F.col("n_regionkey") % 2).cast("string")).alias("condition"), groups.half_up((F.col("n_nationkey") + F.col("n_regionkey")) / 2).cast("long").alias("label"))


@query("aligned_questions", f"WITH {_QUOTED} SELECT person_id, qa_index FROM checked GROUP BY ALL HAVING bool_and(matched)")
def aligned_questions(spark: SparkSession, sf: str) -> DataFrame:
    c = _aligned(spark, sf)
    return evidence.aligned_only(evidence.flag_questions(c.select("person_id", "qa_index").distinct(), c)).select("person_id", "qa_index")


@query("key_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 = 0)")
def key_rows(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.table(spark, sf, "lineitem").filter("l_linenumber = 1 and l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = s.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return checks.rows_for_keys(o, wanted.join(o, "o_orderkey", "left_semi"), ["o_orderkey"])


@query("precheck", f"WITH e AS (SELECT user_id AS k, event_id % 2 AS em, value / 100 AS f1 FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), b AS (SELECT k, max(em) AS em, max(f1) AS f1 FROM e GROUP BY 1) SELECT round(100 * avg(em), 8) AS em, round(100 * avg(f1), 8) AS f1, 100 * avg(f1) > 40 AS passed FROM b")
def precheck(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").filter("value is not null and user_id is not null").select(F.col("user_id").alias("example_id"), (F.col("event_id") % 2).alias("em"), (F.col("value") / 100).alias("f1"))
    return readers.precheck(e).select(F.round("em", 8).alias("em"), F.round("f1", 8).alias("f1"), "passed")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded responses: one or two items, unknown fields, too many items, or no JSON, by conv_id; some prompts have none."""
    c = s.table(spark, sf, "conversations").filter("turn = 0").select((F.col("conv_id") % 10).alias("person_id"), F.col("conv_id").alias("chunk_id"), F.lit(2).alias("qa_cap"))
    item = '{{"question": "q{n}", "answer": "a", "evidence": [{{"visit_index": 0, "evidence_snippet": "s"}}]{more}}}'
    one, two, odd = item.format(n=1, more=""), item.format(n=2, more=""), item.format(n=3, more=', "mood": "x"')
    k = F.col("chunk_id") % 6
    reply = F.when(k == 0, f'{{"qas": [{one}]}}').when(k == 1, f'{{"qas": [{one}, {two}]}}').when(k == 2, f'{{"qas": [{odd}]}}').when(k == 3, f'{{"qas": [{one}, {two}, {one}]}}').when(k == 4, "not JSON")
    records = c.select("person_id", "chunk_id", reply.alias("response")).filter("response is not null")
    return models.recorded_responses(c, records)


@query("recorded_generation", """SELECT conv_id % 10 AS person_id, conv_id AS chunk_id, CAST(CASE conv_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n_items,
CASE conv_id % 6 WHEN 2 THEN 'chunk_generation_failed: unknown fields' WHEN 3 THEN 'chunk_generation_failed: too many items' WHEN 4 THEN 'chunk_generation_failed: invalid response' WHEN 5 THEN 'chunk_generation_failed: invalid response' END AS reason FROM conversations WHERE turn = 0""")
def recorded_generation(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf)
    items = qa.parse_responses(r).groupBy("person_id", "chunk_id").agg(F.count("*").alias("n_items"))
    out = r.select("person_id", "chunk_id").join(items, ["person_id", "chunk_id"], "left").join(qa.chunk_failures(r), ["person_id", "chunk_id"], "left")
    return out.select("person_id", "chunk_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "reason")


@query("encoded_vectors", f"WITH {s.PAIRS}, t AS (SELECT conv_id, turn, unnest({s.sql_tokens('question')}) AS t FROM pairs), b AS (SELECT conv_id, turn, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS place FROM t) SELECT conv_id, turn, place, count(*)::DOUBLE AS value FROM b GROUP BY ALL")
def encoded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = models.hashed_encoder(s.answer_pairs(spark, sf), text.retrieval_tokens(F.col("question")))
    return v.select("conv_id", "turn", F.posexplode("vector").alias("place", "value")).filter("value > 0").select("conv_id", "turn", F.col("place").cast("long").alias("place"), "value")


@query("token_batches", """WITH RECURSIVE d AS (SELECT doc_id % 16 AS shard, doc_id, least(n_chars, 5000) AS n FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n DESC, doc_id) AS k FROM d),
g AS (SELECT shard, doc_id, k, n AS longest, 1 AS size, 0::BIGINT AS batch FROM o WHERE k = 1 UNION ALL
SELECT o.shard, o.doc_id, o.k, CASE WHEN (size + 1) * longest > 20000 OR size >= 8 THEN n ELSE longest END, CASE WHEN (size + 1) * longest > 20000 OR size >= 8 THEN 1 ELSE size + 1 END, CASE WHEN (size + 1) * longest > 20000 OR size >= 8 THEN batch + 1 ELSE batch END FROM g JOIN o ON o.shard = g.shard AND o.k = g.k + 1)
SELECT shard, doc_id AS id, batch FROM g""")
def token_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = s.table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("shard"), F.col("doc_id").alias("id"), F.least("n_chars", F.lit(5000)).alias("n_tokens"))
    return sampling.dealt_batches(d, 20_000, 8)


@query("binary_grades", f"WITH {_GRADED}, x AS (SELECT run, 'ge4' AS threshold, (score >= 4)::INT AS hit FROM g UNION ALL SELECT run, 'ge3', (score >= 3)::INT FROM g UNION ALL SELECT run, 'eq5', (score = 5)::INT FROM g) SELECT run, threshold, sum(hit)::BIGINT AS n_hit, count(*) AS n FROM x GROUP BY ALL")
def binary_grades(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.binary_grades(_graded(spark, sf), "run")


@query("reasoning_strata", f"""WITH {s.RUN_VALUES}, m AS (SELECT key_pos, ['trend', 'other', 'rare'][CASE WHEN key_pos % 40 = 0 THEN 3 ELSE 1 + key_pos % 2 END] AS kind FROM (SELECT DISTINCT key_pos FROM runs)),
x AS (SELECT kind AS subset, run, count(*) AS n, avg(value) AS mean FROM runs JOIN m USING (key_pos) GROUP BY ALL) SELECT x.subset, x.run, x.n, CASE WHEN x.n >= 100 THEN round(x.mean, 9) END AS mean, CASE WHEN x.n >= 100 THEN round(o.mean - x.mean, 9) END AS oracle_gap FROM x LEFT JOIN x o ON o.subset = x.subset AND o.run = 'click'""")
def reasoning_strata(spark: SparkSession, sf: str) -> DataFrame:
    v, k = s.run_values(spark, sf), F.col("key_pos")
    kinds = v.select("key_pos").distinct().select(F.when(k % 40 == 0, "rare").when(k % 2 == 0, "trend").otherwise("other").alias("subset"), "key_pos")
    out = runs.subset_means(v, kinds, "click", 100)
    return out.select("subset", "run", "n", F.round("mean", 9).alias("mean"), F.round("oracle_gap", 9).alias("oracle_gap"))

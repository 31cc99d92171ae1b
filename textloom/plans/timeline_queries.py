"""Queries over notes, visits, timelines, windows, generated questions and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import groups, text
from ..operators import checks, evidence, qa, timeline
from . import standins as s
from .registration import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def _visit_output(visits: DataFrame) -> DataFrame:
    return visits.select("person_id", F.date_format("visit_ts", STAMP).alias("visit"), F.md5("text").alias("text_md5"), F.col("n_docs").cast("long").alias("n_docs"), F.col("visit_index").cast("long").alias("visit_index"), F.col("n_visits").cast("long").alias("n_visits"))


_VISIT_SQL = "SELECT person_id, strftime(visit_ts, '%Y-%m-%d %H:%M:%S') AS visit, md5(text) AS text_md5, CAST(n_docs AS BIGINT) AS n_docs, visit_index, n_visits FROM visits"


@query("visit_build_documents", f"WITH {s.VISITS} {_VISIT_SQL}")
def visit_build_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _visit_output(s.note_visits(spark, sf))


@query("visit_build_orders", f"WITH {s.ORDER_VISITS} {_VISIT_SQL}")
def visit_build_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _visit_output(s.order_visits(spark, sf))


@query("visit_build_events_hour", f"WITH {s.sql_event_visits('hour')} {_VISIT_SQL}")
def visit_build_events_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _visit_output(s.event_visits(spark, sf, "hour"))


@query("visit_build_lineitem", f"WITH {s.SUPPLIER_VISITS} {_VISIT_SQL}")
def visit_build_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _visit_output(s.supplier_visits(spark, sf))


@query("visit_doc_ids", f"WITH {s.VISITS} SELECT person_id, visit_index, doc_ids FROM visits")
def visit_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return s.note_visits(spark, sf).select("person_id", F.col("visit_index").cast("long").alias("visit_index"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query("visit_build_exploration", f"""WITH {s.NOTES}, cleaned AS (SELECT person_id, visit_ts, ord, {s.sql_clean('CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END')} AS text FROM notes)
SELECT person_id, strftime(visit_ts, '%Y-%m-%d') AS day, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5, count(*) AS n_docs FROM cleaned GROUP BY person_id, visit_ts""")
def visit_build_exploration(spark: SparkSession, sf: str) -> DataFrame:
    n = s.notes(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    return timeline.build_visits(n, keep_empty=True).select("person_id", F.date_format("visit_ts", "yyyy-MM-dd").alias("day"), F.md5("text").alias("text_md5"), F.col("n_docs").cast("long").alias("n_docs"))


@query("timelines", f"""WITH {s.VISITS} SELECT person_id, count(*) AS n_visits, md5(string_agg(strftime(visit_ts, '%Y-%m-%d %H:%M:%S') || '=' || text, '|' ORDER BY visit_ts)) AS record_md5 FROM visits GROUP BY person_id""")
def timelines(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline.timelines(s.note_visits(spark, sf))
    joined = F.array_join(F.transform("visits", lambda v: F.concat(v["visit_datetime"], F.lit("="), v["text"])), "|")
    return t.select("person_id", F.size("visits").cast("long").alias("n_visits"), F.md5(joined).alias("record_md5"))


@query("visit_groups_report", f"""WITH {s.SUPPLIER_VISITS}, people AS (SELECT person_id, count(*) AS n FROM visits GROUP BY 1 UNION ALL SELECT -1 - o_custkey, count(DISTINCT o_orderdate) FROM orders GROUP BY 1)
SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 100 THEN '11-100' WHEN n <= 1000 THEN '101-1000' ELSE '>1000' END AS visit_group, count(*) AS n FROM people GROUP BY 1""")
def visit_groups_report(spark: SparkSession, sf: str) -> DataFrame:
    a = s.supplier_visits(spark, sf).groupBy("person_id").agg(F.count("*").alias("n"))
    b = s.order_visits(spark, sf).groupBy((-1 - F.col("person_id")).alias("person_id")).agg(F.count("*").alias("n"))
    return a.union(b).groupBy(groups.reporting_group(F.col("n")).alias("visit_group")).agg(F.count("*").alias("n"))


@query("visit_groups_eligible", f"""WITH {s.ORDER_VISITS} SELECT CASE WHEN n_visits BETWEEN 2 AND 10 THEN '2-10' WHEN n_visits BETWEEN 11 AND 100 THEN '11-100' ELSE '101-1000' END AS visit_group, count(DISTINCT person_id) AS n_persons, count(*) AS n_visits
FROM visits WHERE n_visits BETWEEN 2 AND 1000 GROUP BY 1""")
def visit_groups_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.eligible(s.order_visits(spark, sf)).groupBy("visit_group").agg(F.countDistinct("person_id").alias("n_persons"), F.count("*").alias("n_visits"))


def _stats(name: str, c: str) -> str:
    return f"avg({c}) AS {name}_mean, median({c}) AS {name}_median, CAST(min({c}) AS BIGINT) AS {name}_min, CAST(max({c}) AS BIGINT) AS {name}_max"


_NOTE_WORDS = f"CAST(len({s.sql_words(chr(116))}) AS BIGINT)"


@query("corpus_statistics", f"""WITH {s.NOTES}, cleaned AS (SELECT person_id, visit_ts, ord, {s.sql_clean('text')} AS text FROM notes),
v AS (SELECT person_id, visit_ts, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_docs FROM cleaned GROUP BY ALL),
w AS (SELECT *, CAST(len({s.sql_words('text')}) AS BIGINT) AS words FROM v), p AS (SELECT person_id, count(*) AS v, sum(n_docs) AS d FROM w GROUP BY 1),
nw AS (SELECT *, CAST(len({s.sql_words("coalesce(text, '')")}) AS BIGINT) AS w FROM notes)
SELECT * FROM (SELECT count(*) AS n_notes, count(DISTINCT person_id) AS n_persons, count(*) FILTER (WHERE text IS NULL) AS n_null_texts, {_stats('note_words', 'w')} FROM nw),
(SELECT count(*) AS n_visits, {_stats('visit_words', 'words')}, {_stats('notes_per_visit', 'n_docs')} FROM w), (SELECT {_stats('visits_per_person', 'v')}, {_stats('notes_per_person', 'd')} FROM p)""")
def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.corpus_statistics(s.notes(spark, sf))


@query("duplicate_rows", "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.duplicate_rows(s.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("unique_key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate key' AS reason FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.key_violations(s.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("notes_by_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1")
def notes_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("length_histogram", """WITH e AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents),
b AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, lo, hi FROM documents, e)
SELECT bin, round(lo + bin * (hi - lo) / 50, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS upper, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.histogram(s.table(spark, sf, "documents"), "n_chars", 50).withColumn("lower", F.round("lower", 6)).withColumn("upper", F.round("upper", 6))


_EXPLORED = s.sql_strip(f"regexp_replace({s.sql_collapse(chr(108) + 'ower(coalesce(text, ' + chr(39) * 2 + '))')}, '[^a-zA-Z0-9 ]', '', 'g')")


@query("top_tokens", f"""SELECT token, count(*) AS n FROM (SELECT unnest({s.sql_words(_EXPLORED)}) AS token FROM documents) WHERE token NOT IN ('the', 'of', 'and', 'to', 'in', 'de', 'la') GROUP BY 1 ORDER BY n DESC, token LIMIT 25""")
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.top_tokens(s.table(spark, sf, "documents"), text.words(text.clean_for_exploration(F.col("text"))), 25, ("the", "of", "and", "to", "in", "de", "la"))


_WINDOW_OUT = "person_id, chunk_id, strategy, qa_cap, visit_group, original_visit_index, visit_index"


def _window_output(visits: DataFrame) -> DataFrame:
    w = timeline.sampled_windows(visits)
    return w.select("person_id", F.col("chunk_id").cast("long").alias("chunk_id"), "strategy", F.col("qa_cap").cast("long").alias("qa_cap"), "visit_group", F.col("original_visit_index").cast("long").alias("original_visit_index"), F.col("visit_index").cast("long").alias("visit_index"))


_WINDOW_CTES = """named AS (SELECT *, CASE WHEN n_visits BETWEEN 2 AND 10 THEN '2-10' WHEN n_visits BETWEEN 11 AND 100 THEN '11-100' WHEN n_visits BETWEEN 101 AND 1000 THEN '101-1000' END AS visit_group FROM visits),
picked AS (
SELECT *, 0 AS chunk_id, 'full_timeline_2_10' AS strategy, 10 AS qa_cap FROM named WHERE n_visits BETWEEN 2 AND 10
UNION ALL SELECT *, 0, 'full_timeline_11_100', 10 FROM named WHERE n_visits BETWEEN 11 AND 30
UNION ALL SELECT *, 0, 'u_shape_first_12_last_18', 10 FROM named WHERE n_visits BETWEEN 31 AND 100 AND (visit_index < 12 OR visit_index >= n_visits - 18)
UNION ALL SELECT *, 0, 'global_u_shape_first_15_last_15', 5 FROM named WHERE n_visits BETWEEN 101 AND 1000 AND (visit_index < 15 OR visit_index >= n_visits - 15)
UNION ALL SELECT n.*, k + 1, 'local_chunk_' || (25 * k) || '_' || least(25 * k + 30, n_visits) || '_size_30_overlap_5', 5 FROM named n, range(0, 40) r(k)
 WHERE n_visits BETWEEN 101 AND 1000 AND k <= CAST(ceil((n_visits - 30) / 25.0) AS BIGINT) AND visit_index >= 25 * k AND visit_index < least(25 * k + 30, n_visits)),
windows AS (SELECT person_id, CAST(chunk_id AS BIGINT) AS chunk_id, strategy, CAST(qa_cap AS BIGINT) AS qa_cap, visit_group, visit_index AS original_visit_index, row_number() OVER (PARTITION BY person_id, chunk_id ORDER BY visit_index) - 1 AS visit_index, visit_ts, text, n_visits FROM picked WHERE text <> '')"""


@query("window_full", f"WITH {s.ORDER_VISITS}, {_WINDOW_CTES} SELECT {_WINDOW_OUT} FROM windows")
def window_full(spark: SparkSession, sf: str) -> DataFrame:
    return _window_output(s.order_visits(spark, sf))


@query("window_u_shape", f"WITH {s.sql_event_visits('hour')}, {_WINDOW_CTES} SELECT {_WINDOW_OUT} FROM windows")
def window_u_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _window_output(s.event_visits(spark, sf, "hour"))


@query("window_global_local_chunks", f"WITH {s.SUPPLIER_VISITS}, {_WINDOW_CTES} SELECT {_WINDOW_OUT} FROM windows")
def window_global_local_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _window_output(s.supplier_visits(spark, sf))


@query("chunk_counts", f"WITH {s.SUPPLIER_VISITS}, {_WINDOW_CTES} SELECT person_id, count(DISTINCT chunk_id) AS n_chunks, max(n_visits) AS n_visits FROM windows GROUP BY 1")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = s.supplier_visits(spark, sf)
    n = v.groupBy("person_id").agg(F.count("*").alias("n_visits"))
    return timeline.sampled_windows(v).groupBy("person_id").agg(F.countDistinct("chunk_id").alias("n_chunks")).join(n, "person_id").select("person_id", "n_chunks", "n_visits")


@query("window_from_strategy", f"WITH {s.SUPPLIER_VISITS}, {_WINDOW_CTES} SELECT person_id, strategy, original_visit_index FROM windows")
def window_from_strategy(spark: SparkSession, sf: str) -> DataFrame:
    v = s.supplier_visits(spark, sf)
    w = timeline.sampled_windows(v).select("person_id", "strategy").distinct().join(v.groupBy("person_id").agg(F.count("*").alias("n")), "person_id")
    return w.select("person_id", "strategy", F.explode(timeline.window_indices(F.col("strategy"), F.col("n"))).alias("i")).select("person_id", "strategy", F.col("i").cast("long").alias("original_visit_index"))


@query("prompt_format", f"""WITH {s.sql_event_visits('day')}, {_WINDOW_CTES}
SELECT person_id, chunk_id, md5('Person: ' || person_id || chr(10) || 'Visit group: ' || visit_group || chr(10) || 'Maximum questions: ' || qa_cap || chr(10) || chr(10) ||
string_agg('[Visit ' || visit_index || '] [Time: ' || strftime(visit_ts, '%Y-%m-%d %H:%M:%S') || ']' || chr(10) || text || chr(10), chr(10) ORDER BY visit_index)) AS prompt_md5 FROM windows GROUP BY person_id, chunk_id, visit_group, qa_cap""")
def prompt_format(spark: SparkSession, sf: str) -> DataFrame:
    p = timeline.prompts(timeline.sampled_windows(s.event_visits(spark, sf, "day")))
    return p.select("person_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("prompt").alias("prompt_md5"))


@query("shortened_texts", f"""SELECT doc_id, md5(CASE WHEN length(c) > 250 THEN substr(c, 1, 250) || ' ...' ELSE c END) AS short_md5 FROM (SELECT doc_id, {s.sql_clean('text')} AS c FROM documents)""")
def shortened_texts(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "documents").select("doc_id", F.md5(text.shortened(F.col("text"), 250)).alias("short_md5"))


@query("person_export", f"""WITH {s.VISITS} SELECT visit_index, md5('--- Visit ' || (visit_index + 1) || ' | ' || strftime(visit_ts, '%Y-%m-%d %H:%M:%S') || ' ---' || chr(10) || text || chr(10)) AS block_md5 FROM visits WHERE person_id = 3""")
def person_export(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.exported_text(s.note_visits(spark, sf), 3).select(F.col("visit_index").cast("long").alias("visit_index"), F.md5("block").alias("block_md5"))


@query("anti_batch", """SELECT user_id AS person_id FROM (SELECT user_id, min(event_id) AS ord FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND event_id % 3 = 0) ORDER BY ord LIMIT 20""")
def anti_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events")
    persons = e.groupBy(F.col("user_id").alias("person_id")).agg(F.min("event_id").alias("ord"))
    done = e.filter("event_type = 'error' and event_id % 3 = 0").select(F.col("user_id").alias("person_id"))
    return timeline.next_batch(persons, done, 20).select("person_id")


# Evidence: quotations of the documents, cut in fixed ways.

def _quoted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, visits): documents are visits of 25 persons, two successive ones of a person share a time. Each document gives one
    quotation: a part of it, two parts with an ellipsis, a quoted part, half of it foreign, at a time without visits, or all foreign."""
    d = s.table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    key = [(F.col("doc_id") % 25).alias("person_id"), F.floor(F.col("doc_id") / 50).cast("string").alias("visit_datetime")]
    visits = d.select(*key, F.floor(F.col("doc_id") / 25).alias("visit_index"), "text")
    n, k, t, own = F.length("text"), F.col("doc_id") % 6, F.col("text"), F.floor(F.col("doc_id") / 25)
    part = lambda at, size: F.substring(t, (F.floor(at) + 1).cast("int"), F.lit(size))
    snippet = (
        F.when(k.isin(0, 4), part(n / 3, 80)).when(k == 1, F.concat(part(F.lit(0), 60), F.lit(" ... "), part(n / 2, 60)))
        .when(k == 2, F.concat(F.lit('"'), part(n / 4, 50), F.lit('"'))).when(k == 3, F.concat(part(F.lit(0), 40), F.lit(" … not in any text at all"))).otherwise("not in any text at all"))
    index = F.when(k == 1, F.lit(None)).when(k == 2, own.bitwiseXOR(F.lit(1).cast("long"))).otherwise(own)
    evidence_ = d.select(F.col("doc_id").alias("evidence_id"), key[0], F.floor(F.col("doc_id") / 100).alias("qa_index"), F.when(k == 4, "none").otherwise(key[1]).alias("visit_datetime"), index.alias("original_visit_index"), snippet.alias("evidence_snippet"))
    return evidence_, visits


_SEGMENTS = f"list_filter(list_transform(regexp_split_to_array(sn, '{text.SNIPPET_GAP}'), lambda p: regexp_replace({s.sql_evidence('p')}, '^\"+|\"+$', '', 'g')), lambda p: length(p) >= 6)"
_QUOTED = f"""t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 6 AS k, length(coalesce(text, '')) AS n, doc_id // 25 AS own FROM documents),
v AS (SELECT doc_id % 25 AS person_id, CAST(doc_id // 50 AS VARCHAR) AS visit_datetime, own AS visit_index, {s.sql_evidence('text')} AS o FROM t),
i AS (SELECT *, CASE WHEN k IN (0, 4) THEN substr(text, n // 3 + 1, 80) WHEN k = 1 THEN substr(text, 1, 60) || ' ... ' || substr(text, n // 2 + 1, 60) WHEN k = 2 THEN '"' || substr(text, n // 4 + 1, 50) || '"'
 WHEN k = 3 THEN substr(text, 1, 40) || ' … not in any text at all' ELSE 'not in any text at all' END AS evidence_snippet FROM t),
e AS (SELECT doc_id AS evidence_id, doc_id % 25 AS person_id, doc_id // 100 AS qa_index, CASE WHEN k = 4 THEN 'none' ELSE CAST(doc_id // 50 AS VARCHAR) END AS visit_datetime,
 CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN xor(own, 1) ELSE own END AS original_visit_index, evidence_snippet, regexp_replace({s.sql_evidence('evidence_snippet')}, '^"+|"+$', '', 'g') AS sn FROM i),
parts AS (SELECT *, {_SEGMENTS} AS parts FROM e),
m AS (SELECT p.*, v.visit_index AS c, v.o, sn <> '' AND contains(o, sn) AS exact, len(parts) AS n, len(list_filter(parts, lambda x: contains(o, x))) AS h FROM parts p JOIN v USING (person_id, visit_datetime)),
d AS (SELECT *, exact OR (n > 0 AND h = n) AS ok, CASE WHEN sn = '' THEN 'empty_snippet' WHEN exact THEN 'exact_match' WHEN n = 0 THEN 'empty_or_too_short_after_split' WHEN h = n THEN 'ellipsis_segment_match_' || h || '_of_' || n ELSE 'partial_segment_match_' || h || '_of_' || n END AS detail FROM m),
b AS (SELECT evidence_id, count(*) AS n_candidates, min(c) FILTER (WHERE ok) AS first_ok, min_by(detail, c) FILTER (WHERE ok) AS first_detail, min(c) FILTER (WHERE c = original_visit_index) AS own, bool_or(ok) FILTER (WHERE c = original_visit_index) AS own_ok, min(detail) FILTER (WHERE c = original_visit_index) AS own_detail FROM d GROUP BY 1),
checked AS (SELECT e.evidence_id, e.person_id, e.qa_index, coalesce(own_ok, false) OR first_ok IS NOT NULL AS matched,
 CASE WHEN n_candidates IS NULL THEN 'no_original_visit_with_same_datetime' WHEN own_ok THEN 'matched_by_datetime_and_original_visit_index__' || own_detail WHEN first_ok IS NOT NULL THEN 'matched_by_datetime_only__' || first_detail
  WHEN own IS NOT NULL THEN 'datetime_and_index_found_but_snippet_not_found__' || own_detail ELSE 'datetime_found_but_snippet_not_found' END AS match_type,
 CASE WHEN own_ok THEN own WHEN first_ok IS NOT NULL THEN first_ok ELSE own END AS matched_visit_index, coalesce(n_candidates, 0) AS n_candidates FROM e LEFT JOIN b USING (evidence_id))"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.align_evidence(*_quoted(spark, sf)).select("evidence_id", "person_id", "qa_index", "matched", "match_type", "matched_visit_index", "n_candidates")


@query("evidence_alignment", f"WITH {_QUOTED} SELECT * FROM checked")
def evidence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)


@query("evidence_match_types", f"WITH {_QUOTED} SELECT match_type, matched, count(*) AS n FROM checked GROUP BY ALL")
def evidence_match_types(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).groupBy("match_type", "matched").agg(F.count("*").alias("n"))


@query("evidence_flag", f"WITH {_QUOTED}, f AS (SELECT person_id, qa_index, bool_and(matched) AS m FROM checked WHERE evidence_id % 100 < 75 GROUP BY ALL) SELECT person_id, qa_index, coalesce(m, false) AS evidence_match FROM (SELECT DISTINCT person_id, qa_index FROM checked) LEFT JOIN f USING (person_id, qa_index)")
def evidence_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's questions; the last quotation of each is not checked, so that some questions have none."""
    c = _aligned(spark, sf)
    return evidence.flag_questions(c.select("person_id", "qa_index").distinct(), c.filter("evidence_id % 100 < 75"))


@query("gold_visits", """SELECT o_custkey AS person_id, qa_index, string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY CAST(i AS VARCHAR)) AS gold_ids FROM (
SELECT o_custkey, o_orderkey % 3 AS qa_index, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS i FROM orders) GROUP BY 1, 2""")
def gold_visits(spark: SparkSession, sf: str) -> DataFrame:
    o = s.table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("string"))
    dates = o.select(F.col("o_custkey").alias("person_id"), F.col("t").alias("visit_datetime")).distinct()
    v = dates.withColumn("visit_index", F.row_number().over(Window.partitionBy("person_id").orderBy("visit_datetime")) - 1)
    ev = o.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 3).alias("qa_index"), F.col("t").alias("visit_datetime")).join(v, ["person_id", "visit_datetime"]).withColumnRenamed("visit_index", "original_visit_index")
    g = evidence.gold_visits(ev, v)
    return g.select("person_id", "qa_index", F.array_join(F.array_sort(F.transform("gold_ids", lambda x: x.cast("string"))), ",").alias("gold_ids"))


# Generated questions: turns of conversations with their next turn.

def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = s.answer_pairs(spark, sf)
    kinds = F.array(*[F.lit(x) for x in ("before_after", "trend", "other", "unlisted", "first_last_occurrence")])
    snippet = F.substring("answer", 1, 30)
    ev = F.when(F.col("turn") == 0, F.array(F.struct(snippet.alias("evidence_snippet"), F.lit("2020-01-02 00:00:00").alias("visit_datetime")))).when(
        F.col("turn") == 1, F.array(F.struct(snippet.alias("evidence_snippet"), F.lit("2020-01-02 00:00:00").alias("visit_datetime")), F.struct(F.lit("overall").alias("evidence_snippet"), F.lit("2020-01-01 00:00:00").alias("visit_datetime")))).otherwise(
        F.array(F.struct(snippet.alias("evidence_snippet"), F.lit("x").alias("visit_datetime")), F.struct(F.lit("b").alias("evidence_snippet"), F.lit("2020-01-03 00:00:00").alias("visit_datetime"))))
    ev = F.when(F.col("conv_id") % 9 == 0, F.filter(ev, lambda x: F.lit(False))).otherwise(ev)
    answer = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("this suggests "), "answer")).when(F.col("conv_id") % 10 == 7, "  ").otherwise(F.col("answer"))
    return p.select((F.col("conv_id") % 10).alias("person_id"), F.col("conv_id").alias("chunk_id"), F.col("turn").alias("position"), "question", answer.alias("answer"), F.element_at(kinds, (F.col("conv_id") % 5 + 1).cast("int")).alias("reasoning_type"), (F.col("conv_id") % 2 == 0).alias("is_temporal"), ev.alias("evidence"))


_HAS = "list_has_any([contains({x}, k) for k in [{words}]], [true])"


def _any_sql(x: str, words: tuple[str, ...]) -> str:
    return _HAS.format(x=x, words=", ".join(f"'{w}'" for w in words))


_CANDIDATES = f"""{s.PAIRS}, c AS (SELECT conv_id % 10 AS person_id, conv_id AS chunk_id, turn AS position, question, CASE WHEN conv_id % 4 = 0 THEN 'this suggests ' || answer WHEN conv_id % 10 = 7 THEN '  ' ELSE answer END AS answer,
 ['before_after', 'trend', 'other', 'unlisted', 'first_last_occurrence'][conv_id % 5 + 1] AS kind, conv_id % 2 = 0 AS temporal, CASE WHEN conv_id % 9 = 0 THEN 0 WHEN turn = 0 THEN 1 ELSE 2 END AS n_ev, turn = 1 AND conv_id % 9 <> 0 AS disordered,
 substr(answer, 1, 30) || CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN ' overall' ELSE ' b' END AS quoted FROM pairs),
r AS (SELECT *, list_filter([
 CASE WHEN len({s.sql_words(s.sql_strip('question'))}) < 4 THEN 'question_too_short' END, CASE WHEN {s.sql_strip('answer')} = '' THEN 'answer_empty' END, CASE WHEN n_ev = 0 THEN 'no_evidence' END,
 CASE WHEN n_ev > 0 AND temporal AND kind NOT IN ({", ".join(f"'{t}'" for t in qa.REASONING_TYPES)}) THEN 'temporal_reasoning_type_unexpected' END,
 CASE WHEN n_ev = 1 AND (kind IN ({", ".join(f"'{t}'" for t in qa.MULTI_VISIT_TYPES)}) OR (temporal AND {_any_sql("lower(" + s.sql_strip('question') + " || ' ' || " + s.sql_strip('answer') + ")", qa.CHANGE_WORDS)})) THEN 'insufficient_evidence_for_temporal_reasoning' END,
 CASE WHEN disordered THEN 'evidence_not_in_time_order' END,
 CASE WHEN n_ev > 0 AND {_any_sql("lower(" + s.sql_strip('answer') + ")", qa.INFERENCE_WORDS)} AND NOT {_any_sql("lower(quoted)", qa.INFERENCE_WORDS)} THEN 'possible_over_inference' END], lambda x: x IS NOT NULL) AS reasons FROM c)"""


@query("qa_filter_reasons", f"WITH {_CANDIDATES} SELECT chunk_id, position, array_to_string(reasons, ',') AS reasons FROM r")
def qa_filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("chunk_id", "position", F.array_join(qa.rejection_reasons(), ",").alias("reasons"))


@query("qa_rejection_counts", f"WITH {_CANDIDATES} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1")
def qa_rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = qa.filter_candidates(_candidates(spark, sf))
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_DEDUPED = f"""{_CANDIDATES}, k AS (SELECT *, row_number() OVER (PARTITION BY person_id, {s.sql_duplicates('question')}, substr({s.sql_duplicates('answer')}, 1, 120) ORDER BY chunk_id, position) AS n FROM r WHERE len(reasons) = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY chunk_id, position) - 1 AS qa_index FROM k WHERE n = 1)"""


@query("qa_dedupe", f"WITH {_DEDUPED} SELECT person_id, qa_index, chunk_id, position FROM u")
def qa_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = qa.filter_candidates(_candidates(spark, sf))
    return qa.numbered(qa.drop_duplicate_questions(kept)).select("person_id", F.col("qa_index").cast("long").alias("qa_index"), "chunk_id", "position")


@query("qa_flatten", f"WITH {_DEDUPED} SELECT person_id, qa_index, md5(question || '|' || answer) AS qa_md5, kind AS reasoning_type, CAST(n_ev AS BIGINT) AS n_evidence FROM u")
def qa_flatten(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    kept, _ = qa.filter_candidates(c)
    unique = qa.numbered(qa.drop_duplicate_questions(kept)).withColumn("strategy", F.lit("full_timeline_2_10")).withColumn("difficulty", F.lit("medium"))
    persons = c.groupBy("person_id").agg(F.countDistinct("chunk_id").alias("n_chunks")).withColumn("n_visits", F.lit(2))
    flat = qa.flattened(qa.person_records(unique, persons)[0])
    n = F.size(F.from_json("evidence", "array<struct<evidence_snippet:string>>")).cast("long")
    return flat.select("person_id", F.col("qa_index").cast("long").alias("qa_index"), F.md5(F.concat_ws("|", "question", "answer")).alias("qa_md5"), "reasoning_type", n.alias("n_evidence"))


@query("qa_run_statistics", f"""WITH {_DEDUPED}, p AS (SELECT DISTINCT person_id FROM c) SELECT count(DISTINCT u.person_id) AS n_succeeded, count(u.qa_index) AS n_questions, count(DISTINCT p.person_id) - count(DISTINCT u.person_id) AS n_failed, count(DISTINCT p.person_id) AS n_total FROM p LEFT JOIN u USING (person_id)""")
def qa_run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    unique = qa.numbered(qa.drop_duplicate_questions(qa.filter_candidates(c)[0])).withColumn("strategy", F.lit("s")).withColumn("difficulty", F.lit("medium"))
    persons = c.groupBy("person_id").agg(F.countDistinct("chunk_id").alias("n_chunks")).withColumn("n_visits", F.lit(2))
    return qa.run_statistics(*qa.person_records(unique, persons))


@query("qa_normalize", """WITH e AS (SELECT user_id AS person_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, ts FROM events), q AS (SELECT * FROM e)
SELECT person_id, event_id AS position, 'q' || event_id AS question, 'other' AS reasoning_type, 'medium' AS difficulty, CAST(2 AS BIGINT) AS n_evidence, CAST(i + 10 AS BIGINT) AS first_original FROM q""")
def qa_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    chunk, place = F.floor(F.col("i") / 3).cast("int"), (F.col("i") % 3).cast("int")
    windows = e.select(F.col("user_id").alias("person_id"), chunk.alias("chunk_id"), place.alias("visit_index"), (F.col("i") + 10).alias("original_visit_index"), F.col("ts").cast("timestamp").alias("visit_ts"))
    pick = lambda i, t: F.struct(i.cast("int").alias("visit_index"), F.lit(t).alias("evidence_snippet"))
    ev = F.array(pick(place, " a "), pick(place, "a"), pick(place, "b"), pick(F.lit(99), "c"), pick(F.lit(-1), "d"), pick(place, "  "))
    raw = e.select(F.col("user_id").alias("person_id"), chunk.alias("chunk_id"), F.col("event_id").alias("position"), F.concat(F.lit(" q"), "event_id", F.lit(" ")).alias("question"), F.lit("a").alias("answer"), F.lit(None).cast("string").alias("reasoning_type"), F.lit(None).cast("string").alias("difficulty"), ev.alias("evidence"), F.lit(None).cast("boolean").alias("is_temporal"), F.lit(None).cast("string").alias("temporal_signal"))
    out = qa.normalise_candidates(raw, windows)
    return out.select("person_id", "position", "question", "reasoning_type", "difficulty", F.size("evidence").cast("long").alias("n_evidence"), F.element_at("evidence", 1)["original_visit_index"].cast("long").alias("first_original"))

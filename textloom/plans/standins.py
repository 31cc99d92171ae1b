"""The driver's tables in the roles of notes, visits, questions, rankings and runs; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NEITHER, PUNCTUATION, SPACE
from ..operators import timeline

#: SQL forms of the text kernels.
SQL_SPACE = SPACE


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def sql_clean(x: str) -> str:
    return sql_strip(sql_collapse(f"coalesce({x}, '')"))


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return sql_words(f"regexp_replace(lower(coalesce({x}, '')), '{NEITHER}', ' ', 'g')")


def sql_duplicates(x: str) -> str:
    collapsed = sql_collapse(f"lower(coalesce({x}, ''))")
    return sql_strip(f"regexp_replace({collapsed}, '{NEITHER}', '', 'g')")


def sql_evidence(x: str) -> str:
    plain = sql_strip(sql_collapse(f"translate(coalesce({x}, ''), '“”‘’', '\"\"''''')"))
    return f"lower({plain})"


def sql_answer(x: str) -> str:
    """Runs of letters and digits and runs of other signs take turns; a run that is an article becomes a space."""
    plain = f"regexp_replace(lower(coalesce({x}, '')), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '', 'g')"
    runs = f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
    return sql_words(f"array_to_string(list_transform({runs}, lambda r: CASE WHEN r IN ('a', 'an', 'the') THEN ' ' ELSE r END), '')")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes: a source is a person, forty consecutive ids share a day."""
    d = table(spark, sf, "documents")
    return d.select(F.substring("source", 4, 9).cast("long").alias("person_id"), F.timestamp_seconds(1577836800 + F.floor(F.col("doc_id") / 40) * 86400).alias("visit_ts"), F.col("doc_id").alias("ord"), "doc_id", "text")


NOTES = "notes AS (SELECT CAST(substr(source, 4, 9) AS BIGINT) AS person_id, TIMESTAMP '2020-01-01' + to_days(CAST(doc_id // 40 AS INTEGER)) AS visit_ts, doc_id AS ord, doc_id, text FROM documents)"


def note_visits(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.indexed_visits(timeline.build_visits(notes(spark, sf)))


VISITS = f"""{NOTES},
cleaned AS (SELECT person_id, visit_ts, ord, doc_id, {sql_clean('text')} AS text FROM notes WHERE person_id IS NOT NULL),
joined AS (SELECT person_id, visit_ts, string_agg(text, ' ' ORDER BY ord) AS text, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY ord) AS doc_ids, count(*) AS n_docs FROM cleaned WHERE text <> '' GROUP BY ALL),
visits AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_ts) - 1 AS visit_index, count(*) OVER (PARTITION BY person_id) AS n_visits FROM joined)"""


def event_visits(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """Events as notes of users, in visits of an hour or a day."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("person_id"), F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("visit_ts"), F.col("event_id").alias("ord"), F.col("event_id").alias("doc_id"), F.col("event_type").alias("text"))
    return timeline.indexed_visits(timeline.build_visits(e))


def sql_event_visits(unit: str) -> str:
    return f"""joined AS (SELECT user_id AS person_id, date_trunc('{unit}', ts) AS visit_ts, string_agg(event_type, ' ' ORDER BY event_id) AS text, count(*) AS n_docs FROM events WHERE event_type <> '' GROUP BY ALL),
visits AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_ts) - 1 AS visit_index, count(*) OVER (PARTITION BY person_id) AS n_visits FROM joined)"""


def supplier_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as notes of suppliers, a visit per ship date: long timelines."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("n_docs"), F.min("l_orderkey").alias("low"))
    visits = rows.select(F.col("l_suppkey").alias("person_id"), F.col("l_shipdate").cast("timestamp").alias("visit_ts"), F.concat(F.lit("order "), "low").alias("text"), "n_docs")
    return timeline.indexed_visits(visits)


SUPPLIER_VISITS = """joined AS (SELECT l_suppkey AS person_id, l_shipdate AS visit_ts, 'order ' || min(l_orderkey) AS text, count(*) AS n_docs FROM lineitem GROUP BY ALL),
visits AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_ts) - 1 AS visit_index, count(*) OVER (PARTITION BY person_id) AS n_visits FROM joined)"""


def order_visits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("timestamp").alias("visit_ts"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    return timeline.indexed_visits(timeline.build_visits(rows))


ORDER_VISITS = f"""cleaned AS (SELECT o_custkey AS person_id, o_orderdate AS visit_ts, o_orderkey AS ord, {sql_clean('o_orderpriority')} AS text FROM orders),
joined AS (SELECT person_id, visit_ts, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_docs FROM cleaned WHERE text <> '' GROUP BY ALL),
visits AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_ts) - 1 AS visit_index, count(*) OVER (PARTITION BY person_id) AS n_visits FROM joined)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions; item k asks the source (person) k mod 20."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("index_id"), "text")


QUESTIONS = "questions AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS index_id, text FROM benchmark)"


def ranked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("index_id"), "doc_id", "text")


def windowed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The first 12 and last 18 documents of each source."""
    from pyspark.sql import Window

    by = Window.partitionBy("index_id")
    rows = ranked_documents(spark, sf).withColumn("i", F.row_number().over(by.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(by))
    return rows.filter("i < 12 or i >= n - 18").drop("i", "n")


DOCS = "docs AS (SELECT source AS index_id, doc_id, text FROM documents)"
WINDOW_DOCS = """docs AS (SELECT index_id, doc_id, text FROM (SELECT source AS index_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i < 12 OR i >= n - 18)"""


def dense_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, documents, gold) of the embeddings: one index of all; every vector whose id is divisible by 100 asks; gold has
    the question's label and is another vector."""
    e = table(spark, sf, "embeddings").select(F.lit("all").alias("index_id"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    q = e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), "index_id", "vector", "label")
    gold = q.select("question_id", "index_id", "label").join(e.select("index_id", "doc_id", "label"), ["index_id", "label"]).filter("question_id != doc_id").select("question_id", "index_id", "doc_id")
    return q.drop("label"), e.drop("label"), gold


DENSE = """vectors AS (SELECT 'all' AS index_id, vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
q AS (SELECT doc_id AS question_id, index_id, v, label FROM vectors WHERE doc_id % 100 = 0),
gold AS (SELECT q.question_id, q.index_id, d.doc_id FROM q JOIN vectors d USING (index_id, label) WHERE q.question_id <> d.doc_id),
scores AS (SELECT q.question_id, q.index_id, d.doc_id, list_dot_product(q.v, d.v) AS score, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)) AS cosine FROM q JOIN vectors d USING (index_id)),
dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores)"""


def answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as questions with the next turn as answer, and the one after as another reader's prediction."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    rows = c.withColumn("answer", F.lead("text").over(by)).withColumn("prediction", F.coalesce(F.lead("text", 2).over(by), F.lit("")))
    return rows.filter("answer is not null").select("conv_id", "turn", F.col("text").alias("question"), "answer", "prediction", F.length("text").alias("n_question"))


PAIRS = """pairs AS (SELECT conv_id, turn, text AS question, answer, coalesce(prediction, '') AS prediction, length(text) AS n_question FROM (
SELECT *, lead(text) OVER w AS answer, lead(text, 2) OVER w AS prediction FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE answer IS NOT NULL)"""


def run_values(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as 0/1 scores of four runs (event types) at key positions; paired by position."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").filter(F.col("event_type").isNotNull())
    ranked = e.withColumn("key_pos", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1)
    return ranked.select(F.col("event_type").alias("run"), F.col("key_pos").cast("long").alias("key_pos"), (F.col("value") > 10).cast("double").alias("value"), (F.col("event_id") % 5 != 0).cast("int").alias("mask"))


RUN_VALUES = """runs AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS key_pos, CAST(value > 10 AS DOUBLE) AS value, CAST(event_id % 5 <> 0 AS INTEGER) AS mask FROM events WHERE event_type IS NOT NULL)"""

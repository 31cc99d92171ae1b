"""Licence scan by canonical digest lookup.

A text is brought to a canonical form line by line: lower case, copyright lines dropped (a line that begins, after comment
signs, with "copyright", "(c)" or the sign, and goes on with a year or "(c)"; or "all rights reserved" alone), punctuation and
white space to single spaces, equivalent spellings to one. The SHA-256 digest of the entire canonical text is hash-joined with
the digests of known licences. Each line's digest is looked up likewise among known one-line notices.

The known side is made by the same expressions from ``known_licences`` (texts of short licences, digests of long ones), to which a
caller may add a table of texts. It is broadcast up to ``BROADCAST_ROWS`` digests; beyond that the join shuffles. Two licences
of one canonical text are both reported (comma-joined).

Defined results: null and empty texts have the digest of the empty string and no licence. Repeated rows are reported each. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .known_licences import DIGESTS, EQUIVALENT_SPELLINGS, NOTICES, TEXTS
from .tables import table, with_text

COPYRIGHT_LINE = r"(?m)^[\s#*/;%-]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved\.?[^\S\n]*$)[^\n]*"
OTHER_SIGNS = r"[^\p{L}\p{N}\n]+"
LINE_ENDS = r" ?\n ?"


def _variants() -> str:
    return r"\b(?:" + "|".join(a for a, _ in EQUIVALENT_SPELLINGS) + r")\b"


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line breaks."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, OTHER_SIGNS, " "), LINE_ENDS, "\n"))
    spelled = bare
    for variant, standard in EQUIVALENT_SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{variant}\b", standard)
    return F.when(bare.rlike(_variants()), spelled).otherwise(bare)


def canonical(lines: Column) -> Column:
    """The entire canonical text on one line."""
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


#: Up to so many known digests (of 64 signs each) are sent to all executors.
BROADCAST_ROWS = 100_000


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, licence) of the known texts, and of those of ``more`` (licence, text; null texts count as empty and are left out)."""
    texts = spark.createDataFrame(TEXTS, "licence string, text string")
    if more is not None:
        texts = texts.union(more.select("licence", F.col("text").cast("string")))
    canon = texts.select("licence", canonical(canonical_lines(F.coalesce("text", F.lit("")))).alias("text")).filter("text != ''")
    every = canon.select(F.sha2("text", 256).alias("digest"), "licence").union(spark.createDataFrame([(d, n) for n, d in DIGESTS], "digest string, licence string"))
    return every.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licence"))


def known_notices(spark: SparkSession) -> dict[str, str]:
    notices = spark.createDataFrame(NOTICES, "licence string, text string")
    rows = notices.select(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"), "licence").collect()  # a module constant
    return {r["digest"]: r["licence"] for r in rows}


def licence_scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence (null if the entire text is none), notices (comma-joined ids), n_notice_lines."""
    spark = docs.sparkSession
    lines = with_text(docs, "doc_id").select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    notices = known_notices(spark)
    by_digest = F.create_map(*[F.lit(x) for pair in notices.items() for x in pair])
    # A notice line has its length among the known ones; others need no digest.
    lengths = spark.createDataFrame(NOTICES, "licence string, text string").select(F.length(canonical(canonical_lines(F.col("text")))).alias("n")).distinct().collect()
    fitting = F.filter(F.split("lines", "\n"), lambda x: F.length(F.trim(x)).isin([r["n"] for r in lengths]))
    found = F.filter(F.transform(fitting, lambda x: F.try_element_at(by_digest, F.sha2(F.trim(x), 256))), lambda x: x.isNotNull())
    scanned = lines.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), found.alias("found"))
    known = known_digests(spark, more)
    if more is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return scanned.join(known, "digest", "left").select("doc_id", "digest", "licence", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notice_lines"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    bare = rf"trim(regexp_replace(regexp_replace({bare}, '{OTHER_SIGNS}', ' ', 'g'), '{LINE_ENDS}', chr(10), 'g'), ' ')"
    for variant, standard in EQUIVALENT_SPELLINGS:
        bare = rf"regexp_replace({bare}, '\b{variant}\b', '{standard}', 'g')"
    return bare


def _sql_values(rows: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in rows) + ") AS t(licence, text)"


_WHOLE = r"sha256(trim(regexp_replace({}, '\s+', ' ', 'g'), ' '))"

ORACLE_SQL = f"""
WITH known AS (SELECT DISTINCT {_WHOLE.format(_sql_lines("text"))} AS digest, licence FROM {_sql_values(TEXTS)} UNION SELECT text AS digest, licence FROM {_sql_values(DIGESTS)}),
notices AS (SELECT {_WHOLE.format(_sql_lines("text"))} AS digest, licence FROM {_sql_values(NOTICES)}),
lined AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
split AS (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))), ' ')) AS digest FROM lined),
hits AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM split JOIN (SELECT DISTINCT * FROM notices) USING (digest) GROUP BY r)
SELECT d.doc_id, d.digest, known.licence, coalesce(hits.notices, '') AS notices, coalesce(hits.n, 0)::BIGINT AS n_notice_lines
FROM (SELECT r, doc_id, {_WHOLE.format("lines")} AS digest FROM lined) d LEFT JOIN known USING (digest) LEFT JOIN hits ON hits.r = d.r
"""

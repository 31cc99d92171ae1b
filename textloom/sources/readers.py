"""Sources with explicit schemas; nothing is inferred and malformed input raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_for_exploration, word_count
from ..operators.checks import IntegrityError, require_columns, require_unique, require_valid

VISIT = T.StructType([T.StructField("visit_datetime", T.StringType()), T.StructField("text", T.StringType())])
TIMELINE = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("visits", T.ArrayType(VISIT))])
EVIDENCE = T.ArrayType(T.StructType([T.StructField("visit_index", T.IntegerType()), T.StructField("original_visit_index", T.IntegerType()), T.StructField("visit_datetime", T.StringType()), T.StructField("evidence_snippet", T.StringType())]))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with header as strings; a missing file or column raises."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")
    return require_columns(df, required or [])


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes (person_id, visit_ts, ord, doc_id, text) of a CSV with person_id, Visit_DateTime (epoch milliseconds), doc_text and
    maybe doc_id. Times that are no number raise with their count. ``ord`` is the place in the file's reading order."""
    raw = read_csv(spark, path, ["person_id", "Visit_DateTime", "doc_text"])
    ms = F.col("Visit_DateTime").try_cast("double").cast("long")
    require_valid(raw, ms.isNotNull(), "invalid Visit_DateTime")
    doc = F.col("doc_id").try_cast("double").cast("long") if "doc_id" in raw.columns else F.lit(None).cast("long")
    return raw.select(F.col("person_id").try_cast("long").alias("person_id"), F.timestamp_millis(ms).alias("visit_ts"), F.monotonically_increasing_id().alias("ord"), doc.alias("doc_id"), F.col("doc_text").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, invalid ones raise, a missing file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a checkpoint text file, one number per line; other lines raise, a missing file has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "person_id long")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.trim("value").cast("long").alias("person_id")).distinct()  # ANSI cast raises on a bad line


def exploded_timelines(timelines: DataFrame) -> DataFrame:
    """(person_id, visit_index, visit_datetime, text, n_visits); a repeated person raises."""
    require_unique(timelines, ["person_id"])
    rows = timelines.select("person_id", F.size("visits").alias("n_visits"), F.posexplode("visits").alias("visit_index", "v"))
    return rows.select("person_id", "visit_index", "v.visit_datetime", "v.text", "n_visits")


def require_file(spark: SparkSession, path: str, sha256: str | None = None, size: int | None = None) -> str:
    """Raises unless the one file at ``path`` has the given digest and length."""
    found = file_digests(spark, path).collect()
    if len(found) != 1 or (size is not None and found[0]["length"] != size) or (sha256 is not None and found[0]["sha256"] != sha256):
        raise IntegrityError(f"{path}: {[(r['length'], r['sha256']) for r in found]}; expected {size} bytes, sha256 {sha256}")
    return path


def require_counts(df: DataFrame, expected: dict[str, int | None], **counts: Column) -> DataFrame:
    """Raises unless the aggregates have the expected values; those without one are not looked at."""
    wanted = {k: v for k, v in expected.items() if v is not None}
    if wanted:
        found = df.agg(*[counts[k].alias(k) for k in wanted]).first().asDict()
        if found != wanted:
            raise IntegrityError(f"found {found}; expected {wanted}")
    return df


def read_corpus(spark: SparkSession, path: str, persons: int | None = None, visits: int | None = None, sha256: str | None = None, size: int | None = None) -> DataFrame:
    """Exploded timelines of a JSON-lines file, with optional checks of its digest, length and counts."""
    if sha256 or size is not None:
        require_file(spark, path, sha256, size)
    corpus = exploded_timelines(read_json_lines(spark, path, TIMELINE))
    return require_counts(corpus, {"persons": persons, "visits": visits}, persons=F.countDistinct("person_id"), visits=F.count("*"))


def parsed_evidence(df: DataFrame, column: str = "evidence") -> DataFrame:
    """Evidence text (JSON, or a list in single quotes) as an array; null is empty, anything else raises."""
    text = F.col(column)
    strict = F.from_json(text, EVIDENCE, {"mode": "PERMISSIVE"})
    loose = F.from_json(text, EVIDENCE, {"mode": "PERMISSIVE", "allowSingleQuotes": "true"})
    parsed = F.when(text.isNull(), F.array().cast(EVIDENCE)).otherwise(F.coalesce(strict, loose, F.raise_error(F.concat(F.lit("evidence is no list: "), text)).cast(EVIDENCE)))
    return df.withColumn(column, parsed)


def read_dataset(spark: SparkSession, path: str, rows: int | None = None, persons: int | None = None, evidence_items: int | None = None, sha256: str | None = None) -> DataFrame:
    """Flat questions with parsed evidence; (person_id, qa_index) must be unique, digest and counts as stated."""
    if sha256:
        require_file(spark, path, sha256)
    df = read_csv(spark, path, ["person_id", "qa_index", "question", "answer", "evidence"])
    df = parsed_evidence(df.withColumn("person_id", F.col("person_id").cast("long")).withColumn("qa_index", F.col("qa_index").cast("long")))
    require_unique(df, ["person_id", "qa_index"])
    return require_counts(df, {"rows": rows, "persons": persons, "evidence_items": evidence_items}, rows=F.count("*"), persons=F.countDistinct("person_id"), evidence_items=F.sum(F.size("evidence")))


def read_notes_for_exploration(spark: SparkSession, path: str) -> DataFrame:
    """Notes with empty texts kept, and with clean_text, doc_length (its words) and year."""
    notes = read_notes(spark, path).withColumn("clean_text", clean_for_exploration(F.col("text")))
    return notes.withColumns({"doc_length": word_count(F.col("clean_text")), "year": F.year("visit_ts").cast("long")})


def read_parts(spark: SparkSession, *patterns: str) -> DataFrame:
    """All Parquet parts that match glob patterns, as one scan; no part raises."""
    return spark.read.parquet(*patterns)


def read_vectors(spark: SparkSession, path: str, dimension: int, key: str = "row") -> DataFrame:
    """Vector shards (``key``, vector): keys must run from 0 without gaps, vectors have ``dimension`` numbers."""
    df = spark.read.parquet(path)
    require_valid(df, F.size("vector") == dimension, f"vectors without {dimension} numbers")
    found = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if found["n"] and (found["d"] != found["n"] or found["low"] != 0 or found["high"] != found["n"] - 1):
        raise IntegrityError(f"{key} is not contiguous: {found.asDict()}")
    return df


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, expected, found) where the digest of a manifest (name, sha256) is missing or differs."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    joined = manifest.select("name", F.col("sha256").alias("expected")).join(own, "name", "left")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("found")))

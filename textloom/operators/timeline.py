"""Notes -> visits -> timelines -> sampled windows.

Order is always explicit: notes carry ``ord``; ties keep it. Visits are long rows (person_id, visit_ts, visit_index, ...), so no
operator depends on one person's record fitting a row, except ``timelines``, whose output is that record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import sampling_group
from ..functions.text import clean_text, shortened, word_count


@dataclass(frozen=True)
class SamplingConfig:
    full_up_to: int = 30
    medium_first: int = 12
    medium_last: int = 18
    chunk_size: int = 30
    chunk_overlap: int = 5
    global_first: int = 15
    global_last: int = 15
    small_cap: int = 10
    medium_cap: int = 10
    chunk_cap: int = 5
    global_cap: int = 5
    chars_per_visit: int = 2500

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk overlap must be at least 0 and below the chunk size")
        if min(self.full_up_to, self.small_cap, self.medium_cap, self.chunk_cap, self.global_cap, self.chars_per_visit) <= 0:
            raise ValueError("caps and sizes must be positive")

    @property
    def step(self) -> int:
        return self.chunk_size - self.chunk_overlap


def build_visits(notes: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Groups notes (person_id, visit_ts, ord, doc_id, text) of equal person and time. Empty clean texts are dropped unless
    ``keep_empty``; null persons or times are dropped; doc_ids lists the non-null ids in note order."""
    text = clean_text(F.col("text"))
    rows = notes.filter(F.col("person_id").isNotNull() & F.col("visit_ts").isNotNull()).withColumn("text", text)
    if not keep_empty:
        rows = rows.filter("text != ''")
    lists = rows.groupBy("person_id", "visit_ts").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "doc_id"))).alias("n"))
    ids = F.filter(F.transform("n", lambda x: x["doc_id"]), lambda x: x.isNotNull())
    return lists.select("person_id", "visit_ts", F.array_join(F.transform("n", lambda x: x["text"]), " ").alias("text"), ids.alias("doc_ids"), F.size("n").alias("n_docs"))


def indexed_visits(visits: DataFrame, *ties: str) -> DataFrame:
    """Adds visit_index (0-based place in the full timeline) and n_visits."""
    person = Window.partitionBy("person_id")
    return visits.withColumn("visit_index", F.row_number().over(person.orderBy("visit_ts", *ties)) - 1).withColumn("n_visits", F.count("*").over(person))


def timelines(visits: DataFrame) -> DataFrame:
    """One row per person with the visits in order of time."""
    visit = F.struct(F.col("visit_ts"), F.date_format("visit_ts", "yyyy-MM-dd HH:mm:ss").alias("visit_datetime"), "text")
    listed = F.transform(F.array_sort(F.collect_list(visit)), lambda v: F.struct(v["visit_datetime"].alias("visit_datetime"), v["text"].alias("text")))
    return visits.groupBy("person_id").agg(listed.alias("visits"))


def corpus_statistics(notes: DataFrame) -> DataFrame:
    """One row of counts and of mean, median, least and most of visits per person, notes per visit and person, words per note
    and visit. Notes: person_id, visit_ts, ord, doc_id, text (empty texts stay)."""
    def summary(name: str, c: str) -> list[Column]:
        return [F.avg(c).alias(f"{name}_mean"), F.median(c).alias(f"{name}_median"), F.min(c).cast("long").alias(f"{name}_min"), F.max(c).cast("long").alias(f"{name}_max")]

    visits = build_visits(notes, keep_empty=True).withColumn("words", word_count(F.col("text")))
    by_note = notes.withColumn("w", word_count(F.col("text"))).agg(
        F.count("*").alias("n_notes"), F.countDistinct("person_id").alias("n_persons"), F.count_if(F.col("text").isNull()).alias("n_null_texts"), *summary("note_words", "w"))
    by_visit = visits.agg(F.count("*").alias("n_visits"), *summary("visit_words", "words"), *summary("notes_per_visit", "n_docs"))
    per_person = visits.groupBy("person_id").agg(F.count("*").alias("v"), F.sum("n_docs").alias("d")).agg(*summary("visits_per_person", "v"), *summary("notes_per_person", "d"))
    return by_note.crossJoin(by_visit).crossJoin(per_person)  # three one-row tables


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that equal an earlier row in all columns (nulls equal)."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n) of equal-width bins from least to most; the most is in the last bin. Bins without rows are left out."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    joined = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    return joined.withColumn("bin", k.cast("long")).groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("upper"), "n")


def eligible(visits: DataFrame, group: str | None = None) -> DataFrame:
    """Visits (with n_visits) of persons whose group is sampled, or is the given one."""
    grouped = visits.withColumn("visit_group", sampling_group(F.col("n_visits"))).filter(F.col("visit_group").isNotNull())
    return grouped if group is None else grouped.filter(F.col("visit_group") == group)


def next_batch(persons: DataFrame, processed: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """The first ``size`` persons in order that are not processed."""
    return persons.join(processed.select("person_id").distinct(), "person_id", "left_anti").orderBy(order).limit(size)


def sampled_windows(visits: DataFrame, config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """Rows (person_id, chunk_id, strategy, qa_cap, visit_group, original_visit_index, visit_index, visit_ts, text) of every window.

    Up to ``full_up_to`` visits: all; up to 100: first and last ones; above: a global first-and-last window (chunk 0) and local
    overlapping chunks (1..m). Empty texts are left out and shift the chunk-relative visit_index.
    """
    c, n, i = config, F.col("n_visits"), F.col("visit_index")
    rows = eligible(visits)
    def windows(strategy: Column, cap: int, chunk: Column = F.lit(0)) -> Column:
        return F.array(F.struct(chunk.cast("int").alias("chunk_id"), strategy.alias("strategy"), F.lit(cap).alias("qa_cap")))

    last_chunk = F.greatest(F.ceil((n - c.chunk_size) / c.step), F.lit(0)).cast("long")
    first_of, last_of = F.greatest(F.ceil((i - c.chunk_size + 1) / c.step), F.lit(0)).cast("long"), F.least(F.floor(i / c.step), last_chunk).cast("long")
    local = F.transform(F.when(first_of <= last_of, F.sequence(first_of, last_of)).otherwise(F.array().cast("array<bigint>")), lambda k: F.struct(
        (k + 1).cast("int").alias("chunk_id"),
        F.concat(F.lit("local_chunk_"), k * c.step, F.lit("_"), F.least(k * c.step + c.chunk_size, n), F.lit(f"_size_{c.chunk_size}_overlap_{c.chunk_overlap}")).alias("strategy"),
        F.lit(c.chunk_cap).alias("qa_cap")))
    none = F.array().cast("array<struct<chunk_id:int,strategy:string,qa_cap:int>>")
    ends = lambda a, b: (i < a) | (i >= n - b)
    glob = F.when(ends(c.global_first, c.global_last), windows(F.lit(f"global_u_shape_first_{c.global_first}_last_{c.global_last}"), c.global_cap)).otherwise(none)
    chosen = (
        F.when(n <= 10, windows(F.lit("full_timeline_2_10"), c.small_cap))
        .when(n <= c.full_up_to, windows(F.lit("full_timeline_11_100"), c.medium_cap))
        .when((n <= 100) & ends(c.medium_first, c.medium_last), windows(F.lit(f"u_shape_first_{c.medium_first}_last_{c.medium_last}"), c.medium_cap))
        .when(n <= 100, none)
        .otherwise(F.concat(glob, local)))
    kept = rows.withColumn("text", shortened(F.col("text"), c.chars_per_visit)).filter("text != ''").withColumn("w", F.explode(chosen))
    place = Window.partitionBy("person_id", "w.chunk_id").orderBy("visit_index")
    return kept.select("person_id", "w.chunk_id", "w.strategy", "w.qa_cap", "visit_group", F.col("visit_index").alias("original_visit_index"), (F.row_number().over(place) - 1).alias("visit_index"), "visit_ts", "text")


def window_indices(strategy: Column, n: Column) -> Column:
    """Original indices of a strategy's window of an n-visit timeline; an unknown strategy raises."""
    def upto(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))

    size = n.cast("int")
    number = lambda pattern, k: F.regexp_extract(strategy, pattern, k).try_cast("int")
    ends, local = r"u_shape_first_(\d+)_last_(\d+)$", r"^local_chunk_(\d+)_(\d+)_size_\d+_overlap_\d+$"
    head = F.least(number(ends, 1), size)
    return (
        F.when(strategy.rlike("^full_timeline_"), upto(F.lit(0), size))
        .when(strategy.rlike(f"^(global_)?{ends}"), F.concat(upto(F.lit(0), head), upto(F.greatest(head, size - number(ends, 2)), size)))
        .when(strategy.rlike(local), upto(number(local, 1), F.least(number(local, 2), size)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown sampling strategy: "), strategy)).cast("array<int>")))


def prompts(windows: DataFrame) -> DataFrame:
    """(person_id, chunk_id, prompt): header with person, group and cap, then each visit as index, time and text."""
    block = F.format_string("[Visit %d] [Time: %s]\n%s\n", F.col("visit_index"), F.date_format("visit_ts", "yyyy-MM-dd HH:mm:ss"), F.col("text"))
    lists = windows.groupBy("person_id", "chunk_id", "visit_group", "qa_cap").agg(F.array_sort(F.collect_list(F.struct("visit_index", block.alias("b")))).alias("v"))
    header = F.format_string("Person: %s\nVisit group: %s\nMaximum questions: %d\n\n", F.col("person_id").cast("string"), "visit_group", "qa_cap")
    return lists.select("person_id", "chunk_id", F.concat(header, F.array_join(F.transform("v", lambda x: x["b"]), "\n")).alias("prompt"))


def exported_text(visits: DataFrame, person_id) -> DataFrame:
    """(visit_index, block) of one person, for a text export."""
    block = F.concat(F.lit("--- Visit "), F.col("visit_index") + 1, F.lit(" | "), F.date_format("visit_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ---\n"), F.col("text"), F.lit("\n"))
    return visits.filter(F.col("person_id") == person_id).select("visit_index", block.alias("block"))


def top_tokens(notes: DataFrame, tokens: Column, n: int, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` most frequent tokens; ties by token. Stop words are left out, repeats count."""
    kept = F.filter(tokens, lambda w: ~w.isin(*stopwords)) if stopwords else tokens
    return notes.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)

"""Ranking of documents per question: BM25, dense vectors, reciprocal-rank fusion, and ranking checks.

Documents belong to an index (a person's timeline or one sampled window); a question is ranked against all documents of its own
index, to full depth. Ranked rows: question_id, index_id, doc_id, rank (1..N), score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens
from ..sources.writers import written


def postings(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms: index_id, doc_id, term, tf; lengths: index_id, doc_id, dl) of documents (index_id, doc_id, text)."""
    tokens = documents.select("index_id", "doc_id", retrieval_tokens(F.col("text")).alias("t"))
    lengths = tokens.select("index_id", "doc_id", F.size("t").cast("long").alias("dl"))
    terms = tokens.select("index_id", "doc_id", F.explode("t").alias("term")).groupBy("index_id", "doc_id", "term").agg(F.count("*").alias("tf"))
    return terms, lengths


def bm25_hits(questions: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """((question_id, index_id, doc_id, score) of documents that share a term with the question, (index_id, doc_id) of all).

    Okapi BM25; a negative idf becomes epsilon times the index's mean idf. Query repeats count, unknown terms add nothing.
    """
    terms, lengths = postings(documents)
    df = terms.groupBy("index_id", "term").agg(F.count("*").alias("df"))
    size = lengths.groupBy("index_id").agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    idf_of = F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = df.join(size, "index_id").withColumn("raw", idf_of)
    # Terms of equal df have equal idf; so few values are summed, in order, and the mean depends on no partitioning.
    equal = df.groupBy("index_id", "df").agg(F.count("*").alias("terms")).join(size, "index_id").groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("df", "terms", idf_of.alias("raw")))).alias("v"))
    mean = equal.select("index_id", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x["terms"] * x["raw"]) / F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["terms"])).alias("mean_idf"))
    idf = raw.join(mean, "index_id").select("index_id", "term", "avgdl", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(epsilon * F.col("mean_idf")).alias("idf"))
    query = questions.select("question_id", "index_id", F.explode(retrieval_tokens(F.col("text"))).alias("term")).groupBy("question_id", "index_id", "term").agg(F.count("*").alias("qf"))
    hits = query.join(idf, ["index_id", "term"]).join(terms, ["index_id", "term"]).join(lengths, ["index_id", "doc_id"])
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # At most one gain for each term of the question; summed in order, so documents with the same gains tie in every partitioning.
    gains = hits.groupBy("question_id", "index_id", "doc_id").agg(F.array_sort(F.collect_list(gain)).alias("gains"))
    score = F.aggregate("gains", F.lit(0.0), lambda s, x: s + x).alias("score")
    return gains.select("question_id", "index_id", "doc_id", score), lengths.select("index_id", "doc_id")


def _with_zeros(questions: DataFrame, hits: DataFrame, documents: DataFrame) -> DataFrame:
    every = questions.select("question_id", "index_id").join(documents, "index_id")
    return every.join(hits, ["question_id", "index_id", "doc_id"], "left").select("question_id", "index_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_scores(questions: DataFrame, documents: DataFrame, **parameters: float) -> DataFrame:
    """(question_id, index_id, doc_id, score) for every document of each question's index; an index without any token scores 0."""
    hits, every = bm25_hits(questions, documents, **parameters)
    return _with_zeros(questions, hits, every)


def bm25_top(questions: DataFrame, documents: DataFrame, k: int, digits: int | None = None, **parameters: float) -> DataFrame:
    """The first k ranks of ``bm25_scores``: of the hits alone where k of them have a score above 0, else of all documents. The hits
    are read twice, so they are written to the shared folder first."""
    hits, every = bm25_hits(questions, documents, **parameters)
    hits = written(hits, "hits")
    first = top_k(ranked(hits.filter((F.col("score") if digits is None else F.round("score", digits)) > 0), digits), k)
    counted = first.withColumn("n", F.count("*").over(Window.partitionBy("question_id", "index_id")))
    full = counted.filter(F.col("n") == k).drop("n")
    short = questions.join(full.select("question_id", "index_id").distinct(), ["question_id", "index_id"], "left_anti")
    keys = short.select("question_id", "index_id")
    rest = top_k(ranked(_with_zeros(keys, hits.join(keys, ["question_id", "index_id"], "left_semi"), every), digits), k)
    return full.unionByName(rest)


def ranked(scores: DataFrame, digits: int | None = None, *ties: str) -> DataFrame:
    """Ranks 1..N by score (optionally rounded to ``digits``) descending, then ties, then doc_id."""
    by = F.col("score") if digits is None else F.round("score", digits)
    window = Window.partitionBy("question_id", "index_id").orderBy(by.desc(), *ties, "doc_id")
    return scores.withColumn("rank", F.row_number().over(window))


def top_k(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= k)


def selected_documents(ranking: DataFrame, k: int) -> DataFrame:
    """(question_id, index_id, doc_ids): the top k in ascending (chronological) order."""
    return top_k(ranking, k).groupBy("question_id", "index_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def dense_scores(questions: DataFrame, documents: DataFrame, cosine: bool = False, broadcast_questions: int = 20_000, spread: int = 64) -> DataFrame:
    """Dot products (or cosines) of the questions' vectors (question_id, index_id, vector) with those of their index.

    Up to ``broadcast_questions`` questions are sent to all executors and the documents stay where they are; beyond, the questions
    are copied to ``spread`` keys of each index, over which its documents are dealt.
    """
    if cosine:
        questions, documents = (x.withColumn("vector", normalised(F.col("vector"))) for x in (questions, documents))
    q, d, keys = questions.withColumnRenamed("vector", "q"), documents.withColumnRenamed("vector", "d"), ["index_id"]
    if questions.limit(broadcast_questions + 1).count() <= broadcast_questions:
        q = F.broadcast(q)
    else:
        keys = ["index_id", "part"]
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        d = d.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    return d.join(q, keys).select("question_id", "index_id", "doc_id", dot(F.col("q"), F.col("d")).alias("score"))


def restricted(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """The full scores of a window's candidates (question_id, index_id, doc_id) only; rank them anew."""
    return scores.join(candidates, ["question_id", "index_id", "doc_id"], "left_semi")


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank); ties by least rank, then doc_id. Rankings must hold the same candidates."""
    keys = ["question_id", "index_id", "doc_id"]
    sides = [r.select(*keys, F.col("rank").alias(f"r{n}")) for n, r in enumerate(rankings)]
    joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), sides)
    names = [f"r{n}" for n in range(len(rankings))]
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    checked = joined.withColumn("ok", F.when(complete, True).otherwise(F.raise_error(F.lit("rankings hold different candidates")).cast("boolean"))).filter("ok")
    score = reduce(lambda a, b: a + b, [1.0 / (k + F.col(n)) for n in names])
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    return ranked(checked.select(*keys, score.alias("score"), least.alias("min_rank")), None, "min_rank").drop("min_rank")


def ranking_header(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, index_id, n_candidates, candidate_ids, gold_ids, n_gold, n_gold_in)."""
    by = ranking.join(gold.select("question_id", "doc_id", F.lit(True).alias("is_gold")), ["question_id", "doc_id"], "left")
    listed = by.groupBy("question_id", "index_id").agg(F.count("*").alias("n_candidates"), F.array_sort(F.collect_list("doc_id")).alias("candidate_ids"), F.count("is_gold").alias("n_gold_in"))
    golds = gold.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold_ids")).withColumn("n_gold", F.size("gold_ids"))
    return listed.join(golds, "question_id", "left")


def ranking_checks(ranking: DataFrame, candidates: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(check, n_bad): unique candidates, contiguous ranks, candidate sets, finite and falling scores, order of ties, gold inside."""
    keys = ["question_id", "index_id", "doc_id"]
    window = Window.partitionBy("question_id", "index_id").orderBy("rank")
    step = ranking.withColumn("above", F.lag("score").over(window)).withColumn("above_id", F.lag("doc_id").over(window))
    per_question = ranking.groupBy("question_id", "index_id").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"))

    def check(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.lit(name).alias("check"), F.count("*").alias("n_bad"))

    found = [
        check("duplicate_key", ranking.groupBy(*keys).count().filter("count > 1")),
        check("rank_gap", per_question.filter("lo != 1 or hi != n or d != n")),
        check("missing_candidate", candidates.join(ranking, keys, "left_anti")),
        check("extra_candidate", ranking.join(candidates, keys, "left_anti")),
        check("not_finite", ranking.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))),
        check("score_rises", step.filter("score > above")),
        check("tie_order", step.filter("score = above and doc_id < above_id")),
    ]
    if gold is not None:
        found.append(check("gold_outside", gold.join(candidates, ["question_id", "doc_id"], "left_anti")))
    return reduce(DataFrame.unionByName, found)


def window_order_checks(window: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of a window ranking whose order contradicts the full ranking."""
    keys = ["question_id", "index_id", "doc_id"]
    both = window.select(*keys, F.col("rank").alias("w")).join(full.select(*keys, F.col("rank").alias("f")), keys)
    order = Window.partitionBy("question_id", "index_id").orderBy("w")
    return both.withColumn("before", F.lag("f").over(order)).filter("before > f").drop("before")

"""Value fixtures of single operators and their edge cases."""

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import groups, text
from textloom.operators import checks, context, evidence, inference, metrics, qa, readers, retrieval, sampling, scoring, timeline


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_retrieval_tokens(spark):
    assert one(spark, text.retrieval_tokens(F.lit("BP 120/80, HR-72; Pt OK."))) == "bp 120 80 hr 72 pt ok".split()
    assert one(spark, text.retrieval_tokens(F.lit(None).cast("string"))) == []


def test_cleaning_keeps_its_order(spark):
    assert one(spark, text.clean_text(F.lit("  A\n\tb c  "))) == "A b c"
    assert one(spark, text.clean_for_exploration(F.lit("A - b"))) == "a  b"
    assert one(spark, text.for_duplicates(F.lit("Is - It?"))) == "is  it"
    assert one(spark, text.word_count(F.lit(""))) == 0
    assert one(spark, text.shortened(F.lit("abcdef"), 3)) == "abc ..."


@pytest.mark.parametrize("p,g,em,f1", [("The fictional dose was increased.", "fictional dose was increased", 1.0, 1.0), ("dose increased", "the dose was increased", 0.0, 0.8), ("", "x", 0.0, 0.0), ("the", "a", 1.0, 0.0), ("“The dose” rose", "“ dose” rose", 1.0, 1.0), ("a—b", "—b", 1.0, 1.0), ("the’s an… x", "’s … x", 1.0, 1.0), ("thé_a", "théa", 1.0, 1.0)])
def test_exact_match_and_f1(spark, p, g, em, f1):
    assert one(spark, text.exact_match(F.lit(p), F.lit(g))) == em
    assert one(spark, text.token_f1(F.lit(p), F.lit(g))) == pytest.approx(f1)


def test_f1_variant_on_two_empty_sides(spark):
    assert one(spark, text.token_f1(F.lit(""), F.lit("the"), empty_equal=True)) == 1.0
    assert one(spark, text.token_f1(F.lit(""), F.lit("x"), empty_equal=True)) == 0.0


@pytest.mark.parametrize("t,g", [("Feedback ... [RESULT] 4", 4), ("[RESULT] 2 [RESULT] 5", 5), ("[RESULT] 7", None), ("no result", None), ("[RESULT] 3.5", None), ("[RESULT] +3", 3), ("[RESULT] .5", 5), ("[RESULT] Score.4", 4), ("[RESULT] ...3", 3), ("[RESULT] 4.", 4), ("[RESULT] -2", None), ("[RESULT] 004 of 5", 4), ("[RESULT] 10000000000000000000004", None), ("[RESULT] 3.", 3), (None, None)])
def test_parsed_grade(spark, t, g):
    assert one(spark, text.parsed_grade(F.lit(t).cast("string"))) == g


def test_graded_retries_once_then_one(spark):
    rows = spark.createDataFrame([("[RESULT] 4", "x"), ("x", "[RESULT] 2"), ("x", "y")], "first_text string, retry_text string")
    assert [(r["score"], r["invalid_final"]) for r in scoring.graded(rows).collect()] == [(4, False), (2, False), (1, True)]


def test_snippet_states(spark):
    m = lambda s, o: one(spark, evidence.snippet_match(F.lit(s), F.lit(o)))
    assert tuple(m("", "abc")) == (False, "empty_snippet")
    assert tuple(m("“B  c”", "a b C d")) == (True, "exact_match")
    assert tuple(m("abc ... d", "x")) == (False, "empty_or_too_short_after_split")
    assert tuple(m("first part ... second part", "the first part and the second part")) == (True, "ellipsis_segment_match_2_of_2")
    assert tuple(m("first part … other part", "the first part")) == (False, "partial_segment_match_1_of_2")


def test_group_labels(spark):
    assert [one(spark, groups.sampling_group(F.lit(n))) for n in (1, 2, 11, 101, 1001)] == [None, "2-10", "11-100", "101-1000", None]
    assert [one(spark, groups.reporting_group(F.lit(n))) for n in (1, 11, 1000, 1001)] == ["1-10", "11-100", "101-1000", ">1000"]
    assert one(spark, groups.half_up(F.lit(2.5))) == 3


def test_windows_and_unknown_strategy(spark):
    w = lambda s, n: one(spark, timeline.window_indices(F.lit(s), F.lit(n)))
    assert w("u_shape_first_12_last_18", 40) == [*range(12), *range(22, 40)]
    assert w("local_chunk_25_40_size_30_overlap_5", 40) == list(range(25, 40))
    assert w("full_timeline_2_10", 3) == [0, 1, 2]
    with pytest.raises(Exception, match="unknown sampling strategy"):
        w("other", 3)


def test_empty_visits_shift_window_positions(spark):
    rows = spark.createDataFrame([(1, k, "" if k == 1 else f"t{k}", 3) for k in range(3)], "person_id long, visit_index int, text string, n_visits int").withColumn("visit_ts", F.timestamp_seconds(F.col("visit_index")))
    assert [(r["original_visit_index"], r["visit_index"]) for r in timeline.sampled_windows(rows).orderBy("visit_index").collect()] == [(0, 0), (2, 1)]


def test_visits_drop_null_keys_and_empty_texts(spark):
    notes = spark.createDataFrame([(1, 10, 1, 7, "a"), (1, 10, 2, None, "b"), (1, 10, 3, 9, "  "), (None, 10, 4, 1, "c"), (1, None, 5, 1, "d")], "person_id long, t long, ord long, doc_id long, text string").withColumn("visit_ts", F.timestamp_seconds("t"))
    got = timeline.build_visits(notes).collect()
    assert [(r["text"], r["doc_ids"], r["n_docs"]) for r in got] == [("a b", [7], 2)]
    assert timeline.build_visits(notes, keep_empty=True).first()["text"] == "a b "


def test_sampling_config_is_checked():
    with pytest.raises(ValueError):
        timeline.SamplingConfig(chunk_overlap=30)


@pytest.mark.parametrize("N,G", [(1, 1), (3, 1), (5, 2), (7, 3), (8, 8), (12, 2)])
def test_random_baseline_equals_enumeration(spark, N, G):
    b = metrics.random_baseline(spark.createDataFrame([(N, G, G)], "N long, G_in long, G long")).first()
    sets = list(itertools.combinations(range(1, N + 1), G))
    mean = lambda f: sum(map(f, sets)) / len(sets)
    assert b["mrr"] == pytest.approx(mean(lambda c: 1 / c[0]), abs=1e-12)
    assert b["last_gold_rank"] == pytest.approx(mean(lambda c: c[-1]), abs=1e-12)
    assert b["hit_5"] == pytest.approx(mean(lambda c: c[0] <= 5), abs=1e-12)
    assert b["recall_5"] == pytest.approx(mean(lambda c: sum(x <= 5 for x in c) / G), abs=1e-12)
    assert b["coverage_5"] == pytest.approx(mean(lambda c: c[-1] <= 5), abs=1e-12)


def test_random_baseline_with_gold_outside(spark):
    b = metrics.random_baseline(spark.createDataFrame([(10, 1, 2), (10, 0, 2)], "N long, G_in long, G long")).orderBy("G_in").collect()
    assert (b[1]["coverage_5"], b[1]["recall_5"]) == (0, 0.25)
    assert (b[0]["hit_5"], b[0]["mrr"], b[0]["first_gold_pct"]) == (0, 0, None)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("i", 1, "a b"), ("i", 2, "b c c"), ("i", 3, "d"), ("j", 4, "")], "index_id string, doc_id long, text string")
    q = spark.createDataFrame([(1, "i", "a a zz"), (2, "j", "a")], "question_id long, index_id string, text string")
    got = {(r["question_id"], r["doc_id"]): (r["rank"], r["score"]) for r in retrieval.ranked(retrieval.bm25_scores(q, docs)).collect()}
    idf = math.log(2.5) - math.log(1.5)
    assert got[1, 1] == (1, pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2))))
    assert got[1, 2] == (2, 0) and got[1, 3] == (3, 0) and got[2, 4] == (1, 0)


def test_fusion_needs_equal_candidates(spark):
    a = spark.createDataFrame([(1, "i", 1, 1), (1, "i", 2, 2)], "question_id long, index_id string, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.reciprocal_rank_fusion([a, a]).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(Exception, match="different candidates"):
        retrieval.reciprocal_rank_fusion([a, a.filter("doc_id = 1")]).collect()


def _visits(spark):
    return spark.createDataFrame([(102, k, f"day {k}", "x" * (10 + k)) for k in range(40)], "person_id long, visit_index int, visit_datetime string, text string")


def _selection(spark, ids):
    return spark.createDataFrame([("k", 102, i) for i in ids], "key string, person_id long, visit_index int")


def test_context_order_and_survival(spark):
    c = context.build_contexts(_selection(spark, [30, 3, 27]), _visits(spark), 10_000)
    gold = spark.createDataFrame([("k", [27, 30])], "key string, gold_ids array<int>")
    r = context.survival(c, gold).first()
    assert r["selected_ids"] == [3, 27, 30] and not r["truncated"] and r["fully_survived"] and r["n_gold_surviving"] == 2


def test_context_is_trimmed_in_proportion(spark):
    full = context.build_contexts(_selection(spark, [3, 27, 30]), _visits(spark), 10_000).first()
    budget = full["header_tokens"] + 60
    r = context.build_contexts(_selection(spark, [3, 27, 30]), _visits(spark), budget).first()
    sizes = [13, 37, 40]
    assert r["visit_tokens_after"] == [math.floor(n * 60 / sum(sizes)) for n in sizes]
    assert r["tokens_after"] <= budget and r["context"].count("[Visit") == 3


def test_context_errors(spark):
    for ids, budget, match in (([3, 3], 100, "duplicate"), ([99], 100, "outside"), ([3, 4], 5, "exceed")):
        with pytest.raises(Exception, match=match):
            context.build_contexts(_selection(spark, ids), _visits(spark), budget).collect()


def test_headers_beyond_the_budget_may_stand_alone(spark):
    out = context.build_contexts(_selection(spark, [3, 4]), _visits(spark), 5, headers_alone=True)
    r = context.survival(out, spark.createDataFrame([(out.first()["key"], [3, 4])], f"key {out.schema['key'].dataType.simpleString()}, gold_ids array<int>")).first()
    assert r["truncated"] and not r["fully_survived"] and r["n_gold_surviving"] == 0 and r["visit_tokens_after"] == [0, 0]
    assert r["context"].count("[Visit") == 2 and r["tokens_after"] == r["header_tokens"]


def test_gold_visits_raise_and_never_fall_back(spark):
    v = spark.createDataFrame([(101, k, f"d{k}") for k in range(6)], "person_id long, visit_index int, visit_datetime string")
    ev = lambda *rows: spark.createDataFrame([(101, 0, *r) for r in rows], "person_id long, qa_index long, original_visit_index int, visit_datetime string")
    assert evidence.gold_visits(ev((4, "d4"), (1, "d1"), (1, "d1")), v).first()["gold_ids"] == [1, 4]
    for bad in ((-1, "d1"), (6, "d6"), (1, "d2"), (None, "d1")):
        with pytest.raises(Exception):
            evidence.gold_visits(ev(bad), v).collect()


def test_strict_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert checks.strict_join(a, a, ["k"]).columns == ["k", "v", "v_r"]
    with pytest.raises(checks.IntegrityError):
        checks.strict_join(a, a.filter("k = 1"), ["k"])
    with pytest.raises(checks.IntegrityError):
        checks.strict_join(a.union(a), a, ["k"])
    with pytest.raises(checks.IntegrityError):
        checks.require_columns(a, ["k", "nope"])
    assert checks.strict_join(a, a.filter("k = 1"), ["k"], complete=False).count() == 1


def test_holm(spark):
    t = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "family string, id int, p double")
    assert [r["p_holm"] for r in inference.holm(t, ["family"], ["id"]).orderBy("id").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_numpy_resamples_are_the_generator_s_matrix(spark):
    import numpy as np

    got = {(r["b"], r["key_pos"]): r["w"] for r in inference.numpy_resamples(spark, 7, 20).collect()}
    matrix = np.random.default_rng(42).integers(0, 7, (20, 7))
    assert got == {(b, int(k)): int((row == k).sum()) for b, row in enumerate(matrix) for k in set(row)}


def test_numpy_estimates_without_the_table_of_draws(spark):
    """Blocks smaller than n, masks, nulls, several values of a key and infinite ones: the same as by the long table."""
    rows = [(r, k, v, mask) for r in ("a", "b", None) for k in range(23) for v, mask in ((float(k % 3), k % 4), (None if k % 5 else 0.5, None))]
    df = spark.createDataFrame([*rows, ("inf", 4, float("inf"), 1), ("inf", 5, 2.0, 1)], "run string, key_pos long, value double, mask int")
    long = inference.ratio_estimates(df, inference.numpy_resamples(spark, 23, 40), "run")
    own = inference.numpy_ratio_estimates(df, 23, "run", resamples=40, block=5, rows=7)
    plain = lambda d: {(r["run"], r["b"]): r["estimate"] for r in d.collect() if r["estimate"] is not None}
    assert plain(own) == pytest.approx(plain(long), rel=1e-12)


def test_spearman_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert inference.spearman(rows, "a", "b").first()["rho"] is None


def test_kappa_perfect_and_undefined(spark):
    m = lambda rows: inference.contingency(spark.createDataFrame(rows, "a int, b int"), "a", "b", [0, 1])
    assert inference.kappa(m([(0, 0), (1, 1)]), 2).first()["kappa"] == 1
    assert inference.kappa(m([(0, 0), (0, 0)]), 2).first()["kappa"] is None


def _allocation(counts, total):
    """The sequential rule."""
    quota = {k: total * n / sum(counts.values()) for k, n in counts.items()}
    alloc = {k: max(math.floor(q), 1) for k, q in quota.items()}
    order = sorted(counts, key=lambda k: (-(quota[k] - alloc[k]), k))
    i = 0
    while sum(alloc.values()) < total:
        alloc[order[i % len(order)]] += 1
        i += 1
    while sum(alloc.values()) > total:
        for k in order[::-1]:
            if alloc[k] > 1 and sum(alloc.values()) > total:
                alloc[k] -= 1
    return {k: min(a, counts[k]) for k, a in alloc.items()}


@pytest.mark.parametrize("counts,total", [({"a": 50, "b": 30, "c": 20}, 10), ({"a": 1000, "b": 1, "c": 1, "d": 1}, 10), ({"a": 96, "b": 1, "c": 1, "d": 1, "e": 1}, 6), ({"a": 3, "b": 3, "c": 3}, 4), ({"a": 40, "b": 30, "c": 1, "d": 1, "e": 1, "f": 1}, 7)])
def test_proportional_allocation(spark, counts, total):
    cells = spark.createDataFrame(list(counts.items()), "k string, n long")
    assert {r["k"]: r["alloc"] for r in sampling.proportional_allocation(cells, total, ["k"]).collect()} == _allocation(counts, total)


def test_pilot_allocation_takes_from_the_largest(spark):
    cells = spark.createDataFrame([("a", 970), ("b", 10), ("c", 10), ("d", 10)], "k string, n long")
    assert {r["k"]: r["alloc"] for r in sampling.pilot_allocation(cells, 5, "k").collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_token_batches():
    assert list(sampling.token_batches([5, 1, 3, 2], 6, 10)) == [[0], [2, 3], [1]]


def test_spans_reached(spark):
    spans = F.array(*[F.struct(F.lit(i).alias("visit_index"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, a, b in ((0, 0, 5), (1, 5, 9), (2, 12, 20))])
    windows = F.array(F.struct(F.lit(5).alias("start"), F.lit(12).alias("end")))
    assert one(spark, readers.visits_reached(spans, windows)) == [1]


def test_evidence_monotone_and_reasons(spark):
    ev = "array<struct<evidence_snippet:string,visit_datetime:string>>"
    rows = spark.createDataFrame([("only three words", "x", "other", False, [("s", "2020-01-02 00:00:00")]), ("a question with words", "", "trend", True, []), ("a question with words", "it worsened likely", "trend", True, [("s", "2020-01-02 00:00:00"), ("t", "2020-01-01 00:00:00")])], f"question string, answer string, reasoning_type string, is_temporal boolean, evidence {ev}")
    assert [r["x"] for r in rows.select(qa.rejection_reasons().alias("x")).collect()] == [["question_too_short"], ["answer_empty", "no_evidence"], ["evidence_not_in_time_order", "possible_over_inference"]]


def test_failed_responses(spark):
    good = '{"qas": [{"question": "q", "answer": "a", "evidence": [{"visit_index": 0, "evidence_snippet": "s"}]}]}'
    rows = spark.createDataFrame([(1, 0, 1, good), (1, 1, 0, good), (1, 2, 1, "no json")], "person_id long, chunk_id int, qa_cap int, response string")
    assert qa.parse_responses(rows).count() == 1
    assert sorted(r["reason"] for r in qa.chunk_failures(rows).collect()) == ["chunk_generation_failed: invalid response", "chunk_generation_failed: too many items"]


def test_empty_tables_do_not_fail(spark):
    none = spark.createDataFrame([], "person_id long, visit_ts timestamp, ord long, doc_id long, text string")
    v = timeline.indexed_visits(timeline.build_visits(none))
    assert timeline.sampled_windows(v).count() == 0 and timeline.timelines(v).count() == 0
    assert timeline.corpus_statistics(none).first()["n_notes"] == 0
    r = spark.createDataFrame([], "question_id long, index_id string, doc_id long, rank int, score double")
    assert retrieval.ranking_checks(r, r).filter("n_bad > 0").count() == 0


def test_resamples_are_never_broadcast(spark):
    """What a resample draws looks small to the planner; only the values may be sent, and beyond a bound neither side."""
    from textloom.operators import runs

    rows = spark.range(300).selectExpr("id AS key_pos", "1 + id % 5 AS a", "1 + (id div 3) % 5 AS b", "'r' AS run", "CAST(id % 2 AS DOUBLE) AS value")
    joins = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "key_pos" in line]
    found = []
    for bound in (1000, 10):
        draws = inference.arithmetic_draws(rows.select("key_pos"), 20)
        made = [runs.agreement_intervals(rows, "a", "b", 5, 4, draws, broadcast_rows=bound), inference.ratio_estimates(rows.select("run", "key_pos", "value"), draws, "run", broadcast_rows=bound)]
        kind = "BroadcastHashJoin" if bound == 1000 else "SortMergeJoin"
        assert all(joins(df) and all(kind in line and "BuildLeft" not in line for line in joins(df)) for df in made)
        found.append([sorted(map(str, df.collect())) for df in made])
    assert found[0] == found[1]


def test_chunks_of_wide_rows_are_numbered_once(spark):
    """Adaptive execution joins more partitions of the narrow rows that are counted than of the wide rows that are numbered."""
    rows = spark.range(4000).selectExpr("(id * 7919) % 4000 AS id", "transform(sequence(1, 40), x -> sha2(concat(id, '-', x), 256)) AS wide")
    name, was = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "100k")
    try:
        found = {r["id"]: r["chunk"] for r in sampling.fixed_chunks(rows, 10, "id").collect()}
    finally:
        spark.conf.set(name, was)
    assert found == {k: k // 10 for k in range(4000)}


def test_bm25_mean_idf_depends_on_no_order_of_summation(spark):
    """The common term's idf is a quarter of the mean over 30,000 terms; each partitioning gives the same bits, those of the exact sum."""
    texts = [(k, "common " + " ".join(f"w{j}" for j in range(30_000) if j % (k + 2) == 0 or j % 200 == k)) for k in range(200)]
    df, n = Counter(w for _, t in texts for w in set(t.split())), len(texts)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    sizes = {k: len(t.split()) for k, t in texts}
    average = sum(sizes.values()) / n
    idf = 0.25 * math.fsum(raw.values()) / len(raw)
    questions = spark.createDataFrame([(1, "i", "common")], "question_id long, index_id string, text string")
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame([("i", *x) for x in texts], "index_id string, doc_id long, text string").repartition(parts, "doc_id")
        found.append({r.doc_id: r.score for r in retrieval.bm25_scores(questions, docs).collect()})
    assert found[0] == found[1]
    for k, size in sizes.items():
        exact = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / average))
        assert abs(found[0][k] - exact) <= 4e-15 * exact


def test_bm25_score_depends_on_no_order_of_summation(spark):
    """Forty texts of the same words, each in another order among texts that differ, have the same bits in every partitioning."""
    words = [f"w{j}" for j in range(23)]
    texts = [(k, " ".join((words[k % 23 :] + words[: k % 23]) * 3)) for k in range(40)] + [(100 + k, " ".join(w for j, w in enumerate(words) if k % (j + 2) == 0) + " z" * k) for k in range(60)]
    questions = spark.createDataFrame([(1, "i", " ".join(words))], "question_id long, index_id string, text string")
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame([("i", *x) for x in texts], "index_id string, doc_id long, text string").repartition(parts, "doc_id")
        found.append({r.doc_id: r.score for r in retrieval.bm25_scores(questions, docs).collect()})
    assert len({found[0][k] for k in range(40)}) == 1
    assert found[0] == found[1]

"""Operators over the whole corpus against brute force: near duplicates, passages, decontamination, language model, pipeline."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import components, decontamination, katz_model, near_dedup, repeated_passages, stages

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WORD, text or "")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def some_text(rnd, n):
    return " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 60)) for _ in range(n))


@pytest.mark.parametrize("strip", [1, 2, 5, 2048])
def test_banded_distance(monkeypatch, strip):
    monkeypatch.setattr(near_dedup, "STRIP", strip)
    rnd = random.Random(strip)
    for _ in range(800):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 12))]
        b = a[:] if rnd.random() < 0.6 else [rnd.randint(0, 3) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 3)):
            b.insert(rnd.randint(0, len(b)), rnd.randint(0, 3))
        limit, d = rnd.randint(0, 9), levenshtein(a, b)
        assert near_dedup.edit_distance_within(np.array(a), np.array(b), limit) == (d if d <= limit else None)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    for bound in (0, 1000):
        got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), bound).collect()}
        assert got == {x: find(x) for x in parent}


def _edited(rnd, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = "new" + str(rnd.randint(0, 10**6))
    return " ".join(w)


def test_near_duplicate_classes(spark):
    rnd = random.Random(3)
    passage = some_text(rnd, 40)
    docs, expected = [], {}
    for g in range(12):
        base = some_text(rnd, rnd.randint(60, 200)) + (" " + passage if g % 2 else "")
        first = len(docs)
        for k in range(rnd.randint(1, 5)):
            docs.append(_edited(rnd, base, 2) if k else base)
            expected[len(docs) - 1] = first
    for t, same in ((None, 0), ("", 0), ("one two", 1), ("One  TWO", 1), ("one three", 2)):
        expected[len(docs)] = ("short", same)
        docs.append(t)
    docs += [docs[0]] * 3
    expected |= {k: expected[0] for k in range(len(docs) - 3, len(docs))}
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, node string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(df).collect()}
    least = {}
    for k in sorted(expected):
        least.setdefault(expected[k], k)
    assert got == {k: least[c] for k, c in expected.items()}
    kept = near_dedup.one_of_each_class(df)
    assert kept.columns == ["doc_id", "text", "node"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_near_duplicates_with_one_large_group(spark):
    rnd = random.Random(8)
    base = some_text(rnd, 80)
    docs = [(k, _edited(rnd, base, 1)) for k in range(400)] + [(1000 + k, some_text(rnd, 80)) for k in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] == (0 if k < 400 else k) for k, _ in docs)


def _families(seed, families, own, shared, rate):
    """(doc_id, text): pairs of texts with one common passage, each other word of the second one changed with probability ``rate``."""
    rnd = random.Random(seed)
    passage = ["t" + str(rnd.randint(0, 10**6)) for _ in range(shared)]
    docs = []
    for _ in range(families):
        base = ["w" + str(rnd.randint(0, 10**6)) for _ in range(own)]
        other = [f"n{rnd.randint(0, 10**6)}" if rnd.random() < rate else w for w in base]
        docs += [passage + base, passage + other]
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def _accepted_pairs(words, least=0.8):
    """All pairs that the alignment accepts; the number of common words bounds it from above and spares most alignments."""
    ids = {}
    coded = [np.array([ids.setdefault(int(x), len(ids)) for x in w]) for w in words]
    has = np.zeros((len(words), len(ids)), dtype=np.float32)
    for k, w in enumerate(coded):
        has[k, w] = 1
    size, distinct = np.array([len(w) for w in words]), has.sum(1)
    bound = has @ has.T + np.minimum.outer(size - distinct, size - distinct)
    near = np.triu(bound >= least * np.maximum.outer(size, size) - 1e-6, 1)
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if near_dedup.aligned_similarity(words[a], words[b], least) is not None]


def _recall(spark, docs):
    """Share of the pairs that brute force accepts which are in one class, and their number; no class may hold other pairs."""
    pairs = _accepted_pairs(near_dedup.word_hashes(pa.array([t for _, t in docs])))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    low = {k: k for k, _ in docs}
    for a, b in pairs:
        low[b] = min(low[a], low[b])
    assert sum(got[k] != k for k in got) <= sum(low[k] != k for k in low)
    return sum(got[a] == got[b] for a, b in pairs) / len(pairs), len(pairs)


@pytest.mark.parametrize("similarity,least", [(0.8, 0.98), (0.85, 0.99), (0.9, 0.99)])
def test_pairs_at_the_accepted_similarity_meet(similarity, least):
    rnd = random.Random(3)
    texts = []
    for _ in range(300):
        base = ["w" + str(rnd.randint(0, 10**6)) for _ in range(200)]
        other = base[:]
        for at in rnd.sample(range(200), round((1 - similarity) * 200)):
            other[at] = "n" + str(rnd.randint(0, 10**6))
        texts += [" ".join(base), " ".join(other)]
    config = near_dedup.NearDedupConfig()
    found = np.concatenate([near_dedup.sketch(part, config) for part in near_dedup.slices(pa.array(texts), table=near_dedup.LOWER_ASCII)])
    assert (found[::2] == found[1::2]).any(axis=1).mean() >= least


@pytest.mark.parametrize("families,own,shared,rate,least", [(1000, 60, 60, 0.2, 1.0), (300, 40, 80, 0.5, 0.98)])
def test_all_links_among_texts_with_one_opening(spark, families, own, shared, rate, least):
    recall, pairs = _recall(spark, _families(11, families, own, shared, rate))
    assert pairs > 0.8 * families and recall >= least


def test_alignment_of_long_texts():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 10**6, 20_000)
    near, halves = a.copy(), np.concatenate([a[10_000:], a[:10_000]])
    near[::7] = -1
    began = time.perf_counter()
    assert near_dedup.aligned_similarity(a, near, 0.8) == pytest.approx(1 - 2858 / 20_000) and near_dedup.aligned_similarity(a, halves, 0.8) is None
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_long_odd_and_repeated_texts(spark, broadcast):
    rnd = random.Random(14)
    long = [some_text(rnd, 20_000) for _ in range(2)]
    docs = [(1, long[0]), (2, _edited(rnd, long[0], 900)), (3, long[1]), (4, None), (5, ""), (6, " \n"), (None, long[1]), (7, "x"), (7, "x"), (8, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("bucket", F.lit("b"))
    config = near_dedup.NearDedupConfig(broadcast_nodes=broadcast)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(df, config).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4), (None, 3), (7, 7), (7, 7), (8, 8)], key=str)
    assert Counter(r["doc_id"] for r in near_dedup.one_of_each_class(df, config).collect()) == Counter([1, 3, 4, 7, 8])


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z q r s"), (2, "x y z q r s")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][0]) for r in near_dedup.one_of_each_class(df).collect()) == [(1, "a"), (2, "x")]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0
    assert repeated_passages.repeated_passages(df.limit(0)).count() == 0
    assert katz_model.katz_scores(df.limit(0)).count() == 0


def _passages(docs, length):
    w = {i: words_of(t) for i, t in docs}
    seen = Counter(tuple(x[k : k + length]) for x in w.values() for k in range(len(x) - length + 1))
    out = set()
    for i, x in w.items():
        cover = [False] * (len(x) + 1)
        for k in range(len(x) - length + 1):
            if seen[tuple(x[k : k + length])] > 1:
                cover[k : k + length] = [True] * length
        begin = None
        for k, c in enumerate(cover):
            if c and begin is None:
                begin = k
            if not c and begin is not None:
                out.add((i, begin, k))
                begin = None
    return out


@pytest.mark.parametrize("length,k", [(20, 4), (12, 3)])
def test_repeated_passages(spark, length, k):
    rnd = random.Random(9)
    pool = [some_text(rnd, 40).split() for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 20)
            w += p[a : rnd.randint(a + 3, 40)] + some_text(rnd, rnd.randint(0, 3)).split()
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("position", F.lit("x"))
    got = {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages.repeated_passages(df, repeated_passages.PassageConfig(length, k)).collect()}
    assert got == _passages(docs, length)
    small = repeated_passages.PassageConfig(length, k, broadcast_rows=0)
    assert {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages.repeated_passages(df, small).collect()} == got


def test_repeated_passages_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = Counter(map(tuple, repeated_passages.op5_repeated_passages(spark, SF).select("doc_id", "start", "end", "n_words").collect()))
    assert mine == Counter(duckdb.sql(repeated_passages.ORACLE_SQL).fetchall())


def _leaks(docs, items, least=0.8):
    norm = lambda t: re.sub(r"[^\w\s]+|_", "", (t or "").lower()).split()
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    out = {}
    for i, t in items:
        x = norm(t)
        if not x:
            continue
        a = grams(x)
        for d, u in docs:
            y = norm(u)
            for s in range(max(len(y) - len(x), 0) + 1 if y else 0):
                b = grams(y[s : s + len(x)])
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= least:
                    out[d, i] = max(out.get((d, i), 0), j)
    return out


@pytest.mark.parametrize("literal", [20_000, 0])
def test_decontamination(spark, literal):
    rnd = random.Random(4)
    items = [(k, some_text(rnd, rnd.randint(15, 70))) for k in range(25)] + [(30, "Two words"), (31, "a a a a a a a a a a a a"), (32, ""), (33, None), (34, "!!")]
    docs = []
    for d in range(80):
        t = items[d % 25][1]
        w = t.split()
        if d % 4 == 1:
            w[rnd.randrange(len(w))] = "changed"
        if d % 4 == 2:
            w.insert(len(w) // 2, "inserted")
        if d % 4 == 3:
            w = [x.upper() + "," for x in w[:-1]]
        docs.append((d, some_text(rnd, rnd.randint(0, 30)) + " " + " ".join(w) + " " + some_text(rnd, rnd.randint(0, 30))))
    docs += [(90, None), (91, "..."), (92, "x two   WORDS y"), (93, "a " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x"))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x"))
    config = decontamination.DecontaminationConfig(literal_anchors=literal)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contamination(df, it, config).collect()}
    want = _leaks(docs, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert 30 in {i for _, i in want} and len(want) > 40
    assert decontamination.contamination(df.limit(0), it).count() == 0 and decontamination.contamination(df, it.limit(0)).count() == 0
    with pytest.raises(ValueError):
        decontamination.DecontaminationConfig(similarity=0.5)


def test_decontamination_at_the_edges_of_a_document(spark):
    rnd = random.Random(12)
    items = [(k, some_text(rnd, n)) for k, n in enumerate((15, 40, 40, 58, 70))]
    docs = []
    for _, t in items:
        w = t.split()
        for cut in range(1, len(w) // 9 + 2):
            docs += [" ".join(w[cut:]) + " " + some_text(rnd, 30), some_text(rnd, 30) + " " + " ".join(w[:-cut])]
    docs = list(enumerate(docs))
    df, it = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string").coalesce(2)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contamination(df, it).collect()}
    want = _leaks(docs, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(want) > 20


def test_decontamination_of_reordered_items(spark):
    rnd = random.Random(21)
    items = [(k, some_text(rnd, n)) for k, n in enumerate((30, 59, 80, 120, 200, 200))]
    docs = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        n = len(w)
        orders = [w[n // 2 :] + w[: n // 2], w[-n // 3 :] + w[: -n // 3], w[n // 4 : n // 2] + w[: n // 4] + w[n // 2 :], w[: n - 2]]
        docs += [" ".join(some_text(rnd, k * 7 % 40).split() + o + some_text(rnd, k * 5 % 30).split()) for o in orders] + [" ".join(orders[3])]
    docs = list(enumerate(docs))
    df, it = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string").coalesce(2)
    want = _leaks(docs, items)
    for every in (False, True):
        rows = decontamination.contamination(df, it, decontamination.DecontaminationConfig(every_window=every)).collect()
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(want) >= 20


def test_blocks_cover_the_radius():
    rnd = random.Random(22)
    for _ in range(2000):
        flips = rnd.sample(range(64), rnd.randint(0, 23))
        assert min(sum(b // 16 == k for b in flips) for k in range(4)) <= 23 // 4


def test_decontamination_has_no_python(spark):
    found = decontamination.op1_decontamination(spark, SF)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def _katz(docs, scored):
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + [None]
    rows = [(i, tokens(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in docs]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, w, held in rows:
        if not held:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
            ctx.update(["<s>", *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz_model.discounts(Counter(c.values()), 5) for c in (uni, bi))
    mass = lambda c, d: c * d[c - 1] if c <= 5 else c
    p1 = {w: mass(c, d1) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    stored = defaultdict(dict)
    for (a, b), c in bi.items():
        stored[a][b] = mass(c, d2)
    back, scale = {}, {}
    for a, s in stored.items():
        rest = max(1 - sum(s.values()) / ctx[a], 1 / (ctx[a] + 1))
        back[a], scale[a] = rest / (1 - sum(p1[b] for b in s)), (1 - rest) / sum(s.values())
    p = lambda b, a: stored[a][b] * scale[a] if b in stored.get(a, ()) else back.get(a, 1) * p1.get(b, unknown)
    for a in [*list(stored)[:25], "never seen"]:
        assert sum(p(b, a) for b in [*uni, "<unknown>"]) == pytest.approx(1, abs=1e-9)
    return [(i, held, len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(b, a)) for a, b in zip(["<s>", *w[:-1]], w))) for i, w, held in rows]


@pytest.mark.parametrize("bucket,block,rounds", [(200, 50, 3), (4_000_000, 800_000, 2)])
def test_katz_scores(spark, bucket, block, rounds):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("abcdefghijKLmnop") * rnd.choice([1, 1, 1, 2, 3]) for _ in range(rnd.randint(0, 30)))) for i in range(200)]
    docs += [(300, None), (301, ""), (None, "a b"), (7, "x y z"), docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("x"))
    config = katz_model.KatzConfig(tokens_per_bucket=bucket, block_tokens=block, rounds=rounds, page_rounds=rounds)
    got = sorted((tuple(r) for r in katz_model.katz_scores(df, config).collect()), key=str)
    want = sorted(_katz(docs, df), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want]) and [g[6] for g in got] == pytest.approx([w[6] for w in want])


def test_katz_without_training_text(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz_model.katz_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_stages_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicate removal", "benchmark decontamination", "personal data", "SentencePiece sampling"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rnd = random.Random(6)
    text = " ".join(r["text"] for r in docs.filter("lang = 'en'").limit(3).collect()).replace("\n", " ")
    fresh = " ".join(rnd.sample(sorted(set(text.split())), 120))
    planted = [(9001, fresh), (9002, fresh + " tail"), (9003, " ".join(rnd.sample(fresh.split(), 110)) + " " + item), (9004, "%%% $$$ " * 60)]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in planted], docs.schema)
    all_ = docs.unionByName(more)
    out, rows = all_, {}
    for k, (name, stage) in enumerate(stages.STAGES):
        out = stage(spark, out, SF)
        if k + 1 < len(stages.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert {9001, 9002, 9003} <= rows["quality rules"] and 9004 not in rows["quality rules"]
    assert 9001 in rows["near-duplicate removal"] and 9002 not in rows["near-duplicate removal"]
    assert 9003 not in rows["benchmark decontamination"] and 9001 in rows["SentencePiece sampling"]
    assert out.filter("not lossless").count() == 0 and out.filter("text rlike '[a-z]+[.]?[0-9]*@'").count() == 0


@pytest.mark.parametrize("rows", [0, 1, 12])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    rnd = random.Random(31)
    good = [some_text(rnd, 80) for _ in range(4)]
    texts = [None, "", "ab", " \n", good[0], good[0], good[1] + " tail", good[1], good[2] + " x@y.example.com", "word " * 300, good[3].upper(), good[3]]
    docs = [(None if k == 10 else k, t, "en", "s", 0, "clash") for k, t in enumerate(texts)][:rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, bucket string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0)][:rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, good[2]), (2, None)][:rows], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == ([4, 6, 11] if rows == 12 else []) and all(r["lossless"] for r in out)


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from textloom.llm import tables

    mark = tables.scratch_mark()
    df = tables.written(spark.range(3).toDF("x"), "some")
    assert df.count() == 3 and Path(tables._PATHS[-1]).exists()
    gone = tables._PATHS[-1]
    tables.discard_scratch(spark, mark)
    assert not Path(gone).exists() and tables.scratch_mark() == mark


def test_near_dedup_finds_all_pairs_of_short_texts(spark):
    """Classes of texts of 4 to 14 words equal those of all pairs by plain edit distance; a changed word leaves few common shingles."""
    from textloom.llm.near_dedup import near_dedup

    rng = random.Random(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(6000)}" for _ in range(rng.randint(4, 14))]
        texts.append(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice((0, 1, 1))] = rng.choice(([], [f"v{rng.randrange(9)}"], [f"v{rng.randrange(9)}"]))
                t = t or ["x"]
            texts.append(t)
    texts = [t for t in texts if len(t) <= 14]
    low = list(range(len(texts)))
    alike = [(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    for _ in texts:
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup(docs).collect()} == dict(enumerate(low))


def test_katz_sends_bounded_batches_and_joins_no_list_of_contexts(spark):
    """Python batches have a bound in bytes; the parts of frequent contexts come from their counts, without a join."""
    from textloom.llm.tables import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    df = spark.range(400).select("id", F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    with small_batches(spark, "256k"):
        assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) <= 30
    config = katz_model.KatzConfig(tokens_per_bucket=40)
    model = katz_model.fit(spark.createDataFrame([(k, f"a b a c{k} a b") for k in range(60)], "doc_id long, text string"), config)
    buckets = katz_model._bucketed_contexts(model, config)
    assert "Join" not in buckets._jdf.queryExecution().optimizedPlan().toString()
    words = {int(w): int(p) for w, p in zip(model.hot["word"], model.hot["parts"])}
    assert max(words.values()) > 1
    assert {int(np.int64(r["context"]).view(np.uint64)): r["count"] for r in buckets.groupBy("context").count().filter("count > 1").collect()} == {w: p for w, p in words.items() if p > 1}

"""Language-model scores by Katz backoff.

Tokens are words with A-Z in lower case and one end token per text. The model is a bigram model over the training fold that keeps
every bigram, those seen once too:

* P(w | h) = s(h) d(r) r / c(h) for a bigram of count r, else a(h) P(w);
* P(w) = d(c) c / N for a known word, else the whole mass left over by discounting, for one unknown-word type.

d is the Good-Turing discount in Katz's form for counts up to ``katz_limit`` (1 above), from counts of counts over the whole
training fold; where those give no discount between 0 and 1 (tiny or odd corpora) absolute discounting takes its place.
a(h) = (1 - sum of the bigrams' P) / (1 - sum of their P(w)) is exact, so for every context the probabilities of all V words and the
unknown type add up to 1. s(h) is 1 but where a context's bigrams would leave no mass; then 1 / (c(h) + 1) is set aside.

Tables and scale. Unigrams (word, count), bigrams (packed by bucket of contexts: contexts, run lengths, words, counts) and contexts
(count, scale, backoff) are Parquet tables. Neither tokens nor counts meet on one machine: texts are sent as packed pages, one row
per block of texts and bucket, that hold each distinct bigram of the block once. A frequent context is split by its next word over
several buckets (at most ``4 * buckets`` contexts are that frequent, which bounds their list). A bucket's pages are scored
against that bucket's part of the tables: per token the bigram is looked up; else the backoff weight is taken and the word goes on
to the bucket of its unigram. Exchanges have as many partitions as there are buckets, so a task's share does not grow with the
corpus; the passes over contexts and over pages go in ``rounds`` and ``page_rounds``, each over a part of the buckets, which bounds
the disk that is in use at a time.
Partial sums per text travel packed and are added by key. Words are 64-bit hashes.

Defined results: null and empty texts are one end token. A null doc_id counts as empty text for the fold. Repeated rows are each
scored, and counted each in training. With no training text the counts are 0, every token is unknown and the score is 0.0.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discard_scratch, drop_finished_shuffles, scratch_mark, small_batches, table, with_text, written
from .textarrays import LOWER_ASCII, TextSlice, lean, lean_group, mix, return_freed_arrays, slices


@dataclass(frozen=True)
class KatzConfig:
    folds: int = 7
    held_out: int = 2
    katz_limit: int = 5
    tokens_per_bucket: int = 2_000_000
    block_tokens: int = 450_000
    rounds: int = 3
    page_rounds: int = 3
    batch_bytes: str = "6m"


_STEP = np.uint64(0x9E3779B97F4A7C15)
END, BEGIN = np.uint64(0x1D0C5A3F9B7E2461), np.uint64(0x2E8F6B1C7D4A9053)


def signed(x: np.uint64) -> int:
    return int(np.uint64(x).view(np.int64))


def fold_column(config: KatzConfig) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(config.folds)) == config.held_out


def token_pairs(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row) of every token, the end tokens included."""
    start, end, row = part.words()
    word = part.hash_spans(start, end)
    n_words = np.bincount(row, minlength=part.n)
    stop = np.cumsum(n_words + 1)
    token, context = np.empty(len(word) + part.n, dtype=np.uint64), np.empty(len(word) + part.n, dtype=np.uint64)
    at = np.arange(len(word)) + row
    token[at], token[stop - 1] = word, END
    context[at + 1], context[stop - 1 - n_words] = word, BEGIN
    return context, token, np.repeat(np.arange(part.n), n_words + 1)


def blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(context, token, row, first row) of successive rows of a batch with some ``limit`` tokens (one slice of text more at most)."""
    return_freed_arrays()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = size = 0
    for part in slices(batch.column("text"), table=LOWER_ASCII):
        context, token, row = token_pairs(part)
        held.append((context, token, row + (part.first - first)))
        size += len(token)
        if size >= limit:
            block = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            yield *block, first
            first, size = part.first + part.n, 0
    if held:
        yield *(np.concatenate(x) for x in zip(*held)), first


def discounts(n: dict[int, int], limit: int) -> list[float]:
    """d(1) .. d(limit) from counts of counts."""
    one, two = n.get(1, 0), n.get(2, 0)
    absolute = one / (one + 2 * two) if one and two else 0.5
    common = (limit + 1) * n.get(limit + 1, 0) / one if one else 1.0
    out = []
    for r in range(1, limit + 1):
        raw = (r + 1) * n.get(r + 1, 0) / (r * n[r]) if n.get(r, 0) else 0.0
        d = (raw - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return out


def discounted(count: Column, d: list[float]) -> Column:
    """d(count) * count."""
    out = count.cast("double")
    for r, x in enumerate(d, 1):
        out = F.when(count == r, F.lit(r * x)).otherwise(out)
    return out


def split_buckets(context: np.ndarray, token: np.ndarray, hot: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    """Bucket of each pair; frequent contexts are split by the token."""
    base = context >> np.uint64(16)
    if len(hot["word"]):
        at = np.minimum(np.searchsorted(hot["word"], context), len(hot["word"]) - 1)
        parts = np.where(hot["word"][at] == context, hot["parts"][at], 1).astype(np.uint64)
        base = base + (token >> np.uint64(16)) % parts
    return (base % np.uint64(buckets)).astype(np.int32)


def _pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _STEP + mix(token))


def _grouped_pairs(context: np.ndarray, token: np.ndarray, hot: dict, buckets: int):
    """(order, first, bucket, context, token): tokens in groups of equal pairs, by bucket and then mostly by context; ``first`` is where
    a group begins. One sort of 64 bits: 16 of the bucket and 24 each of the two hashes. Where these agree by chance a pair may come in
    two groups and a context in two runs, which merging and scoring allow."""
    bucket = split_buckets(context, token, hot, buckets)
    key = ((bucket.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)) | ((context >> np.uint64(40)) << np.uint64(24)) | (token >> np.uint64(40))
    order = np.argsort(key)
    if buckets > 1 << 16:
        order = order[np.argsort(bucket[order], kind="stable")]
    b, c, t = bucket[order], context[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1])])) if len(c) else np.zeros(0, dtype=np.int64)
    return order, first, b[first], c[first], t[first]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.diff(np.append(first, len(values))).astype(np.uint32)


def flat(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all values of a binary column, without copies where the column is one chunk."""
    parts = []
    for chunk in rows.column(name).chunks:
        if len(chunk):
            chunk = chunk.cast(pa.large_binary())
            offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]])
    data = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    return (data if data.ctypes.data % 8 == 0 else data.copy()).view(kind)


def unigram_counts(docs: DataFrame, config: KatzConfig) -> DataFrame:
    """(word, count) over the training fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, token, _, _ in blocks(batch, config.block_tokens):
                word, count = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "count"])

    train = with_text(docs.filter(~fold_column(config)))
    return train.mapInArrow(lean(run), "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def bigram_counts(docs: DataFrame, hot: dict, buckets: int, config: KatzConfig) -> DataFrame:
    """Up to eight rows for each bucket: contexts, the number of next words of each, next words and counts as packed numbers, and how
    many of the bigrams have counts 1, 2 .. ``katz_limit`` + 1 (columns n1, n2 ..)."""
    counts_of_counts = [f"n{r}" for r in range(1, config.katz_limit + 2)]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, token, _, _ in blocks(batch, config.block_tokens):
                _, first, bucket, c, t = _grouped_pairs(context, token, hot, buckets)
                count = np.diff(np.append(first, len(token))).astype(np.uint32)
                full, size = _runs(bucket)
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                rows = []
                for a, b in zip(cut[:-1], cut[1:]):
                    own, length = _runs(c[a:b])
                    rows.append((own.tobytes(), length.tobytes(), t[a:b].tobytes(), count[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(x, pa.binary()) for x in zip(*rows)]] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 4], ["bucket", "contexts", "runs", "tokens", "counts"])

    def merge(pages_: pa.Table) -> pa.Table:
        """A row for each eighth of the range of contexts, which is sorted at a time."""
        return_freed_arrays()
        context = np.repeat(flat(pages_, "contexts", np.uint64), flat(pages_, "runs", np.uint32))
        token, counts = flat(pages_, "tokens", np.uint64), flat(pages_, "counts", np.uint32)
        bucket, rows = pages_.column("bucket")[0].as_py(), []
        for part in range(8):
            at = np.flatnonzero((context >> np.uint64(61)) == part)
            at = at[np.lexsort((token[at], context[at]))]
            c, t = context[at], token[at]
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])) if len(at) else at
            if len(first):
                count = np.add.reduceat(counts[at].astype(np.int64), first)
                n = np.bincount(np.minimum(count, config.katz_limit + 2), minlength=config.katz_limit + 3)[1 : config.katz_limit + 2]
                own, runs = _runs(c[first])
                packed = (own, runs, t[first], np.minimum(count, 0xFFFFFFFF).astype(np.uint32))
                rows.append([bucket, *(x.tobytes() for x in packed), *map(int, n)])
        kinds = [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * len(counts_of_counts)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "contexts", "runs", "tokens", "counts", *counts_of_counts])

    train = with_text(docs.filter(~fold_column(config)))
    paged = train.mapInArrow(lean(pages), "bucket int, contexts binary, runs binary, tokens binary, counts binary").repartition(buckets, "bucket")
    return paged.groupBy("bucket").applyInArrow(lean_group(merge), "bucket int, contexts binary, runs binary, tokens binary, counts binary, " + ", ".join(f"{c} long" for c in counts_of_counts))


def bigram_rows(bigrams: DataFrame, number: int, rounds: int) -> DataFrame:
    """(context, word, count) of the packed bigrams whose contexts fall to round ``number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, runs, token, count = (np.frombuffer(batch.column(c)[k].as_py(), dtype=t) for c, t in (("contexts", np.uint64), ("runs", np.uint32), ("tokens", np.uint64), ("counts", np.uint32)))
                context = np.repeat(own, runs)
                here = np.flatnonzero((context >> np.uint64(8)) % np.uint64(rounds) == number)
                for at in range(0, len(here), 100_000):
                    i = here[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(context[i].view(np.int64)), pa.array(token[i].view(np.int64)), pa.array(count[i].astype(np.int64))], ["context", "word", "count"])

    return bigrams.select("contexts", "runs", "tokens", "counts").mapInArrow(lean(run), "context long, word long, count long")


@dataclass(frozen=True)
class KatzModel:
    """Tables and constants of a fitted model."""

    unigrams: DataFrame  # word, count, log_p
    bigrams: DataFrame  # bucket and packed contexts, runs, tokens, counts
    contexts: DataFrame  # context, count, log_p (null: begin), log_scale (log10 of s(h) / c(h)), log_backoff
    discounts: list[float]  # of bigrams of counts 1, 2 ..
    train_tokens: int
    vocabulary: int
    log_unknown: float
    end_count: int
    log_end: float
    hot: dict
    buckets: int


def _frequent(config: KatzConfig) -> int:
    """Contexts of more tokens than this are split."""
    return max(config.tokens_per_bucket // 4, 1)


def fit(docs: DataFrame, config: KatzConfig = KatzConfig()) -> KatzModel:
    spark = docs.sparkSession
    counted = written(unigram_counts(docs, config), "unigrams")
    k = config.katz_limit
    few = {r["count"]: r["n"] for r in counted.filter(F.col("count") <= k + 1).groupBy("count").agg(F.count("*").alias("n")).collect()}  # at most k + 1 rows
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    N, V = total["n"], total["v"]
    end_count = next((r["count"] for r in counted.filter(F.col("word") == signed(END)).collect()), 0)
    d1 = discounts(few, k)
    left = sum(few.get(r, 0) * r * (1 - d) for r, d in enumerate(d1, 1))
    if N and left <= 0:  # every word is frequent: take half a count of each
        d_all, left = 0.5, 0.5 * V
    else:
        d_all = 0.0
    log_unknown = math.log10(left / N) if N else 0.0

    def log_p(count: Column) -> Column:
        return F.log10((discounted(count, d1) - d_all) / float(max(N, 1)))

    unigrams = counted.select("word", "count", log_p(F.col("count")).alias("log_p"))
    # Frequent contexts, to be split; at most 4 * buckets of them since each has over a quarter of a bucket's tokens.
    buckets = max(1, math.ceil(N / config.tokens_per_bucket))
    least = _frequent(config)
    frequent = counted.filter((F.col("count") > least) & (F.col("word") != signed(END))).collect()
    rows = [(np.int64(r["word"]).astype(np.uint64), math.ceil(r["count"] / least)) for r in frequent]
    if end_count > least:
        rows.append((BEGIN, math.ceil(end_count / least)))
    rows.sort()
    hot = {"word": np.array([r[0] for r in rows], dtype=np.uint64), "parts": np.array([min(r[1], buckets) for r in rows], dtype=np.int64)}

    drop_finished_shuffles(spark)
    bigrams = written(bigram_counts(docs, hot, buckets, config), "bigrams")
    drop_finished_shuffles(spark)
    n2 = bigrams.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, k + 2)]).first()
    d2 = discounts({r: n for r, n in enumerate(n2, 1) if n}, k)
    sums, mark = [], scratch_mark()
    for number in range(config.rounds):
        rows = bigram_rows(bigrams, number, config.rounds).select("context", "word", discounted(F.col("count"), d2).alias("mass"))
        joined = rows.join(unigrams.select("word", F.pow(F.lit(10.0), F.col("log_p")).alias("p")), "word")
        sums.append(written(joined.groupBy("context").agg(F.sum("mass").alias("mass"), F.sum("p").alias("lower")), "sums"))
        drop_finished_shuffles(spark)
    sums = reduce(DataFrame.union, sums)
    begin = spark.createDataFrame([(signed(BEGIN), end_count, None)], "context long, count long, log_p double")
    every = unigrams.filter(F.col("word") != signed(END)).select(F.col("word").alias("context"), "count", "log_p").union(begin.filter("count > 0"))
    share = F.coalesce("mass", F.lit(0.0)) / F.col("count")
    rest = F.greatest(1 - share, 1 / (F.col("count") + 1.0))
    told = F.when(F.col("mass").isNull(), 0.0).otherwise(F.log10((1 - rest) / F.col("mass")))
    contexts = every.join(sums, "context", "left").select(
        "context", "count", "log_p", told.alias("log_scale"), F.when(F.col("mass").isNull(), 0.0).otherwise(F.log10(rest / (1 - F.col("lower")))).alias("log_backoff"))
    end = scratch_mark()
    contexts = written(contexts, "contexts")
    drop_finished_shuffles(spark)
    discard_scratch(spark, mark, end)
    log_end = math.log10((end_count * (d1[end_count - 1] if 0 < end_count <= k else 1.0) - d_all) / N) if end_count else log_unknown
    return KatzModel(unigrams, bigrams, contexts, d2, N, V, log_unknown, end_count, log_end, hot, buckets)


def _bucketed_contexts(model: KatzModel, config: KatzConfig) -> DataFrame:
    """(bucket, context, count, log_p, scale, backoff): the contexts in each bucket that their pairs go to. The parts of a frequent one
    follow from its count, as in ``fit``."""
    B, least = F.lit(model.buckets), _frequent(config)
    parts = F.when(F.col("count") > least, F.least(F.ceil(F.col("count") / least), B.cast("long"))).otherwise(F.lit(1).cast("long"))
    spread = model.contexts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return spread.select(F.pmod(F.shiftrightunsigned("context", 16) + F.col("part"), B).cast("int").alias("bucket"), "context", "count", "log_p", F.col("log_scale").alias("scale"), F.col("log_backoff").alias("backoff"))


_SUMS = ("keys", "n", "known", "base", "log")


def score(docs: DataFrame, model: KatzModel, config: KatzConfig = KatzConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row."""
    hot, buckets, N, V, k = model.hot, model.buckets, model.train_tokens, model.vocabulary, config.katz_limit
    log_unknown, log_end, log_total = model.log_unknown, model.log_end, math.log10(N + V + 1)
    masses = np.array([r * d for r, d in enumerate(model.discounts, 1)])

    def pages_of(number: int):
        def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["bucket", "contexts", "runs", "tokens", "uses", "rows", "keys"]
            for batch in batches:
                keys = batch.column("key").to_numpy()
                for context, token, row, at_row in blocks(batch, config.block_tokens):
                    here = np.flatnonzero(split_buckets(context, token, hot, buckets) % config.page_rounds == number)
                    order, first, bucket, c, t = _grouped_pairs(context[here], token[here], hot, buckets)
                    token_cut = np.append(first, len(here))
                    uses, row, seen = np.diff(token_cut).astype(np.uint32), row[here[order]], np.zeros(int(row[-1]) + 1, dtype=bool)
                    full, size = _runs(bucket)
                    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                    out = []
                    for a, b in zip(cut[:-1], cut[1:]):
                        own, length = _runs(c[a:b])
                        mine = row[token_cut[a] : token_cut[b]]
                        seen[:] = False
                        seen[mine] = True
                        met = np.flatnonzero(seen)
                        local = (np.cumsum(seen) - 1)[mine]
                        local = local.astype(np.uint16) if len(met) < 65536 else local.astype(np.uint32)
                        out.append((own.tobytes(), length.tobytes(), t[a:b].tobytes(), uses[a:b].tobytes(), local.tobytes(), keys[at_row + met].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([o[x] for o in out], pa.binary()) for x in range(6)]], names)

        return pages

    def lookup(rows: pa.Table) -> Callable:
        """A function of (words, column, other) that finds the values of contexts, ``other`` where there is none."""
        there = rows.filter(rows.column("context").is_valid())
        word = there.column("context").to_numpy().view(np.uint64)
        order = np.argsort(word)
        word = word[order]
        columns = {c: np.nan_to_num(there.column(c).to_numpy(zero_copy_only=False).astype(np.float64))[order] for c in ("count", "log_p", "scale", "backoff")}

        def find(wanted: np.ndarray) -> Callable:
            if not len(word):
                return lambda name, other: np.full(len(wanted), other)
            at = np.minimum(np.searchsorted(word, wanted), len(word) - 1)
            found = word[at] == wanted
            return lambda name, other: np.where(found, columns[name][at], other)

        return find

    def add_up(pages_: pa.Table, rows: pa.Table) -> pa.Table:
        return_freed_arrays()
        find = lookup(rows)
        stored_rows = rows.filter(rows.column("context").is_null())
        key = _pair_hash(np.repeat(flat(stored_rows, "contexts", np.uint64), flat(stored_rows, "runs", np.uint32)), flat(stored_rows, "tokens", np.uint64))
        ranked = np.argsort(key)
        key, count = key[ranked], flat(stored_rows, "counts", np.uint32)[ranked]
        del ranked
        mass = np.log10(np.where(count <= k, masses[np.minimum(count, k) - 1], count)).astype(np.float64)
        del count
        found: list[list[np.ndarray]] = [[] for _ in _SUMS]
        words, texts = [], []
        for page in (row for chunk in pages_.to_batches(max_chunksize=16) for row in chunk.to_pylist()):
            own, token = np.frombuffer(page["contexts"], dtype=np.uint64), np.frombuffer(page["tokens"], dtype=np.uint64)
            runs, uses = np.frombuffer(page["runs"], dtype=np.uint32), np.frombuffer(page["uses"], dtype=np.uint32)
            docs_ = np.frombuffer(page["keys"], dtype=np.int64)
            local = np.frombuffer(page["rows"], dtype=np.uint16 if len(docs_) < 65536 else np.uint32)
            # What each context says as a token of its own, and what it lends to its next words.
            of, is_begin = find(own), own == BEGIN
            total = of("count", 0.0)
            base = np.where(is_begin, 0.0, np.log10(total + 1) - log_total)
            knows = ((total > 0) & ~is_begin).astype(np.float64)
            context_of = np.repeat(np.arange(len(own)), runs)
            wanted = _pair_hash(own[context_of], token)
            spot = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            stored = key[spot] == wanted if len(key) else np.zeros(len(wanted), dtype=bool)
            value = np.where(stored, (mass[spot] if len(key) else 0.0) + of("scale", 0.0)[context_of], of("backoff", 0.0)[context_of] + np.where(token == END, log_end, 0.0))
            for out, x in zip(found[1:], (None, knows[context_of], base[context_of], value)):
                out.append(np.bincount(local, weights=None if x is None else np.repeat(x, uses), minlength=len(docs_)))
            found[0].append(docs_)
            on = np.repeat(~stored & (token != END), uses)  # these go on to their unigrams
            words.append(np.repeat(token, uses)[on])
            texts.append(docs_[local[on]])
        sums = packed([np.concatenate(x) if x else np.zeros(0) for x in found])
        return pa.concat_tables([sums, unseen(np.concatenate(words), np.concatenate(texts))]) if words else sums

    def unseen(words: np.ndarray, texts: np.ndarray) -> pa.Table:
        """One row for each bucket of unigrams that is asked: words and the keys of their texts."""
        bucket = split_buckets(words, texts.view(np.uint64), hot, buckets)
        order = np.argsort(bucket, kind="stable")
        met, size = _runs(bucket[order])
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        spans = list(zip(cut[:-1], cut[1:]))
        nothing = pa.nulls(len(met), pa.binary())
        return pa.Table.from_arrays([pa.array(met, pa.int32()), pa.array([texts[order[a:b]].tobytes() for a, b in spans], pa.binary()), nothing, nothing, nothing, nothing, pa.array([words[order[a:b]].tobytes() for a, b in spans], pa.binary())], ["part", *_SUMS, "words"])

    def unigram_level(asked: pa.Table, rows: pa.Table) -> pa.Table:
        return_freed_arrays()
        keys = flat(asked, "keys", np.int64)
        value = lookup(rows)(flat(asked, "words", np.uint64))("log_p", log_unknown)
        distinct, which = np.unique(keys, return_inverse=True)
        nothing = np.zeros(len(distinct))
        return packed([distinct, nothing, nothing, nothing, np.bincount(which, value, len(distinct))])

    def packed(sums: list[np.ndarray]) -> pa.Table:
        """One row for each part of the texts that occurs, its sums as arrays."""
        keys, values = sums[0].astype(np.int64), [x.astype(t) for x, t in zip(sums[1:], (np.uint32, np.uint32, np.float64, np.float64))]
        part = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        met, size = _runs(part[order])
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        rows = [[keys[order[a:b]].tobytes(), *(v[order[a:b]].tobytes() for v in values)] for a, b in zip(cut[:-1], cut[1:])]
        columns = [pa.array([r[c] for r in rows], pa.binary()) for c in range(5)]
        return pa.Table.from_arrays([pa.array(met, pa.int32()), *columns, pa.nulls(len(rows), pa.binary())], ["part", *_SUMS, "words"])

    def text_sums(rows: pa.Table) -> pa.Table:
        keys = flat(rows, "keys", np.int64)
        distinct, which = np.unique(keys, return_inverse=True)
        out = [pa.array(distinct)]
        for name, kind in (("n", np.uint32), ("known", np.uint32), ("base", np.float64), ("log", np.float64)):
            total = np.bincount(which, flat(rows, name, kind), len(distinct))
            out.append(pa.array(total if kind is np.float64 else np.rint(total).astype(np.int64)))
        return pa.Table.from_arrays(out, ["key", "n", "known", "base", "log"])

    # The key stands for all rows of equal id and text; their sums add up and are divided by their number below.
    keyed = with_text(docs, "doc_id").withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    schema = "part int, " + ", ".join(f"{c} binary" for c in (*_SUMS, "words"))
    contexts = _bucketed_contexts(model, config)
    none = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    arrays = ["contexts", "runs", "tokens", "counts"]
    numbers = [("context", "long"), ("count", "long"), ("log_p", "double"), ("scale", "double"), ("backoff", "double")]
    tables = contexts.select("bucket", *[c for c, _ in numbers], *none(*[(c, "binary") for c in arrays])).union(model.bigrams.select("bucket", *none(*numbers), *arrays))
    sum_schema, of_texts, asked = "key long, n long, known long, base double, log double", [], []

    def added(rows: DataFrame) -> DataFrame:
        return rows.select("part", *_SUMS).repartition(buckets, "part").groupBy("part").applyInArrow(lean_group(text_sums), sum_schema)

    for number in range(config.page_rounds):
        mine = tables.filter(F.col("bucket") % config.page_rounds == number).repartition(buckets, "bucket")
        paged = keyed.select("key", "text").mapInArrow(lean(pages_of(number)), "bucket int, contexts binary, runs binary, tokens binary, uses binary, rows binary, keys binary").repartition(buckets, "bucket")
        mark = scratch_mark()
        parts = written(paged.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(lean_group(add_up), schema), "scored")
        drop_finished_shuffles(docs.sparkSession)
        end = scratch_mark()
        of_texts.append(written(added(parts.filter("words is null")), "sums"))
        asked.append(written(parts.filter("words is not null").select(F.col("part").alias("bucket"), "keys", "words"), "asked"))
        drop_finished_shuffles(docs.sparkSession)
        discard_scratch(docs.sparkSession, mark, end)
    asked = reduce(DataFrame.union, asked).repartition(buckets, "bucket")
    rest = asked.groupBy("bucket").cogroup(contexts.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(lean_group(unigram_level), schema)
    of_texts = reduce(DataFrame.union, [*of_texts, added(rest)])
    sums = of_texts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "log")])
    rows = keyed.select("doc_id", "key", fold_column(config).alias("held_out"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    done = sums.join(copies, "key")
    end_known, end_base = int(model.end_count > 0), math.log10(model.end_count + 1) - log_total
    each = done.select(
        "key", F.floor(F.col("n") / F.col("copies")).alias("n_tokens"), (F.floor(F.col("known") / F.col("copies")) + end_known).alias("n_known"),
        (F.col("base") / F.col("copies") + end_base).alias("base_score"), (F.col("log") / F.col("copies")).alias("score"))
    return rows.join(each, "key").select("doc_id", "held_out", F.col("n_tokens").cast("long"), F.col("n_known").cast("long"), F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")


def katz_scores(docs: DataFrame, config: KatzConfig = KatzConfig()) -> DataFrame:
    with small_batches(docs.sparkSession, config.batch_bytes):
        return score(docs, fit(docs, config), config)


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))

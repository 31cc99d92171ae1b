"""Passages that repeat across (or inside) documents, by sparse suffix arrays.

A word suffix is retained where its first ``k`` words form a minimiser: the least ``k``-word hash among the
``passage - k + 1`` ones of some ``passage``-word window. The choice depends on content alone, so every passage of ``passage``
words contains a retained position, and all its copies retain the same ones.

Suffixes whose first k words occur once are dropped by a count. The rest get their context (``passage`` words to the left, as many
to the right) and are sorted twice, by right context and by reversed left context. In sorted order the longest common extension of a
suffix with *any* other is the one with a neighbour, so adjacent comparisons give the greatest right extension R, the greatest left
extension L, and for each neighbour the match extended both ways. Matches of ``passage`` words or more are reported. A suffix whose
best match reaches both L and R is settled, as is one with L + R below the length; for the few others (three partly overlapping
partners are needed) all windows around the suffix are compared exactly by hash with those of its group. The union of a document's
matches is exactly the set of words in ``passage``-word windows that occur twice or more.

Scale. Exact copies are one node; a text with a copy is repeated as a whole. Suffix sorts are range partitions over the whole
context, so equal suffixes of one hot passage spread over tasks; neighbours at task borders are compared in a second step that has
two rows per task. Contexts hold 32-bit word hashes (an extension by a wrong word has a chance of 2e-10 per comparison).

Defined results: null, empty and shorter texts have no passages. Repeated rows are copies of each other. Ties in the sort are equal
contexts, so their order does not matter. Extra columns are ignored. Positions count words (case is kept) from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table, with_text, written
from .textarrays import lean, mix, same_row_windows, slices


@dataclass(frozen=True)
class PassageConfig:
    """``broadcast_rows``: the digests of up to so many texts with repeated suffixes are sent to all executors, so that only
    those texts are shuffled; beyond, all are."""

    passage: int = 50
    k: int = 8
    broadcast_rows: int = 500_000


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = (out + word[at + j]) * _STEP
    return mix(out)


def minimiser_positions(gram: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Indexes of grams that are the leftmost least of some run of ``width`` grams of one row."""
    windows = same_row_windows(row, width)
    if not len(windows):
        return windows
    # Sliding minimum by doubling: least[i] covers grams i .. i + span - 1.
    order = np.empty(len(gram), dtype=np.int64)
    order[np.argsort(gram, kind="stable")] = np.arange(len(gram))  # distinct ranks, leftmost first among equals
    least, span = order, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    low = np.minimum(least[windows], least[windows + width - span])
    by_rank = np.empty(len(gram), dtype=np.int64)
    by_rank[order] = np.arange(len(gram))
    return np.unique(by_rank[low])


def suffixes(docs: DataFrame, config: PassageConfig) -> DataFrame:
    """(doc_id, node, n_words, hashes, positions): the retained suffixes of each row; node is the digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hashes, positions, counts = [], [], [], []
            for part in slices(batch.column("text")):
                start, end, row = part.words()
                word = part.hash_spans(start, end)
                at = same_row_windows(row, config.k)
                gram = gram_hashes(word, at, config.k)
                picked = minimiser_positions(gram, row[at], config.passage - config.k + 1)
                first = np.searchsorted(row, np.arange(part.n))
                n_words.append(np.bincount(row, minlength=part.n))
                hashes.append(gram[picked].view(np.int64))
                positions.append((at[picked] - first[row[at[picked]]]).astype(np.int32))
                counts.append(np.bincount(row[at[picked]], minlength=part.n))
            if not n_words:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (hashes, positions)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(np.concatenate(n_words)), *lists], ["doc_id", "node", "n_words", "hashes", "positions"])

    source = with_text(docs, "doc_id").select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, node binary, n_words long, hashes array<long>, positions array<int>")


def contexts(docs: DataFrame, wanted: DataFrame, config: PassageConfig) -> DataFrame:
    """(node, position, gram, left, right) of the wanted positions: reversed left and right word hashes, 4 bytes each."""
    reach = config.passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                start, end, row = part.words()
                word = (part.hash_spans(start, end) >> np.uint64(32)).astype(">u4").tobytes()
                cut = 4 * np.searchsorted(row, np.arange(part.n + 1))
                nodes, places, grams, lefts, rights = [], [], [], [], []
                for r in range(part.n):
                    own = word[cut[r] : cut[r + 1]]
                    back = np.frombuffer(own, dtype=">u4")[::-1].tobytes()
                    node = batch.column("node")[part.first + r].as_py()
                    for gram, at in zip(batch.column("hashes")[part.first + r].as_py(), batch.column("positions")[part.first + r].as_py()):
                        nodes.append(node)
                        places.append(at)
                        grams.append(gram)
                        rights.append(own[4 * at : 4 * (at + reach)])
                        lefts.append(back[len(own) - 4 * at : len(own) - 4 * at + 4 * reach])
                arrays = [pa.array(nodes, pa.binary()), pa.array(places, pa.int32()), pa.array(grams, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "position", "gram", "left", "right"])

    keyed = with_text(docs, "doc_id").withColumn("node", F.unhex(F.md5("text")))
    same = (F.col("d.node") == F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.rep"))
    ids = wanted.select("node", "rep")
    if wanted.count() <= config.broadcast_rows:
        keyed = keyed.alias("d").join(F.broadcast(ids).alias("w"), same, "left_semi")
    met = keyed.alias("d").join(wanted.hint("merge").alias("w"), same)
    return met.select("d.node", "w.hashes", "w.positions", "d.text").mapInArrow(lean(run), "node binary, position int, gram long, left binary, right binary")


def common_words(a: bytes, b: bytes) -> int:
    """Words in the common prefix of two packed contexts."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, dtype="<u4", count=n), np.frombuffer(b, dtype="<u4", count=n)
    return int(np.argmax(x != y))


_ROW = ["node", "position", "gram", "left", "right"]
_MATCH = "node binary, position int, gram long, left_words int, right_words int"


def neighbour_matches(rows: DataFrame, by: str) -> DataFrame:
    """Suffixes sorted by a context: both directions of the match of each adjacent pair of equal grams."""
    keys = ["gram", by, "left" if by == "right" else "right", "node", "position"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def pair(a: tuple, b: tuple) -> list[tuple]:
        if a[2] != b[2]:
            return []
        m = (common_words(a[3], b[3]), common_words(a[4], b[4]))
        return [(*a[:3], *m), (*b[:3], *m)]

    def columns(rows: list[tuple], edges: list[tuple], number: int) -> pa.RecordBatch:
        """Matches, and with a number >= 0 the border rows of partition ``number``."""
        all_ = [(*r, None, None, -1) for r in rows] + [(*e[:3], 0, 0, e[3], e[4], number) for e in edges]
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in all_], kind) for c, kind in enumerate(kinds)], ["node", "position", "gram", "left_words", "right_words", "left", "right", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in _ROW)):
                if last is None:
                    first = row
                else:
                    found += pair(last, row)
                last = row
            yield columns(found, [], -1)
        if first is not None:
            yield columns([], [first] if last is first else [first, last], number)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All border rows in partition order, in one task: at most two rows per partition."""
        last, last_number, found = None, None, []
        for batch in batches:
            for *row, number in zip(*(batch.column(c).to_pylist() for c in [*_ROW, "number"])):
                if last is not None and number != last_number:
                    found += pair(last, tuple(row))
                last, last_number = tuple(row), number
        yield columns(found, [], -1)

    schema = f"{_MATCH}, left binary, right binary, number int"
    done = written(ordered.mapInArrow(lean(run), schema), "matches")
    edge = done.filter("number >= 0").select(*_ROW, "number").coalesce(1).sortWithinPartitions("number", *keys)
    return done.filter("number < 0").select("node", "position", "gram", "left_words", "right_words").union(edge.mapInArrow(lean(borders), schema).select("node", "position", "gram", "left_words", "right_words"))


def window_matches(rows: DataFrame, open_grams: DataFrame, config: PassageConfig) -> DataFrame:
    """Exact route: (node, start) of each passage window around suffixes of the open grams that occurs twice or more."""
    length = config.passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, starts, windows = [], [], []
            for node, at, _, left, right in zip(*(batch.column(c).to_pylist() for c in _ROW)):
                before = np.frombuffer(left, dtype=">u4")[::-1].tobytes()
                around, n_before = before + right, len(left) // 4
                for s in range(max(0, n_before + config.k - length), n_before + 1):
                    if 4 * (s + length) <= len(around):
                        nodes.append(node)
                        starts.append(at - n_before + s)
                        windows.append(around[4 * s : 4 * (s + length)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(starts, pa.int32()), pa.array(windows, pa.binary())], ["node", "start", "window"])

    every = rows.join(open_grams, "gram", "left_semi").select(*_ROW).mapInArrow(lean(run), "node binary, start int, window binary")
    every = written(every.select("node", "start", F.md5("window").alias("window")).distinct(), "windows")
    twice = every.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window").repartition("window")
    return every.join(twice, "window", "left_semi").select("node", "start")


def merged(spans: DataFrame) -> DataFrame:
    """Union of (node, start, end) spans as maximal spans: a span that begins beyond all earlier ends of its text opens a new one."""
    before = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = spans.distinct().withColumn("opens", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
    island = F.sum("opens").over(Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return opens.withColumn("island", island).groupBy("node", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def repeated_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """doc_id, start, end, n_words: the maximal word spans of each row covered by passages that occur twice or more."""
    rows = written(suffixes(docs, config), "suffixes")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("hashes").alias("hashes"), F.first("positions").alias("positions"))
    nodes = written(nodes, "nodes")
    whole = nodes.filter((F.col("copies") > 1) & (F.col("n_words") >= config.passage)).select("node", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))

    single = nodes.select("node", "rep", F.explode(F.arrays_zip("hashes", "positions")).alias("s")).select("node", "rep", F.col("s.hashes").alias("gram"), F.col("s.positions").alias("position"))
    place = F.struct("node", "position")
    # The grams of a hot passage hold many rows; an exchange of its own on the small side lets adaptive execution split them.
    often = single.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("gram").repartition("gram")
    kept = single.join(often, "gram", "left_semi")
    wanted = kept.groupBy("node", "rep").agg(F.sort_array(F.collect_list(F.struct("position", "gram"))).alias("s")).select("node", "rep", F.col("s.gram").alias("hashes"), F.col("s.position").alias("positions"))
    wanted = written(wanted, "wanted")
    context = contexts(docs, wanted, config)
    right = neighbour_matches(context, "right")
    left = neighbour_matches(context, "left")
    matches = written(right.union(left), "both")

    span = F.struct((F.col("position") - F.col("left_words")).alias("start"), (F.col("position") + F.col("right_words")).alias("end"))
    best = matches.groupBy("node", "position", "gram").agg(
        F.max("left_words").alias("l"), F.max("right_words").alias("r"), F.max(F.col("left_words") + F.col("right_words")).alias("both"), F.collect_set(span).alias("spans"))
    best = written(best.filter(F.col("l") + F.col("r") >= config.passage), "best")
    found = best.select("node", F.explode("spans").alias("m")).select("node", "m.start", "m.end").filter(F.col("end") - F.col("start") >= config.passage)
    open_grams = written(best.filter(F.col("both") < F.col("l") + F.col("r")).select("gram").distinct(), "open")
    spans = whole.union(found)
    if not open_grams.isEmpty():
        exact = window_matches(context, open_grams, config)
        spans = spans.union(exact.select("node", "start", (F.col("start") + config.passage).alias("end")))
    members = rows.select("doc_id", "node")
    return members.join(merged(spans).repartition("node"), "node").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))


ORACLE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(len(w) - 49)) AS s, unnest(list_transform(range(len(w) - 49), lambda i: md5(array_to_string(w[i + 1 : i + 50], ' ')))) AS g FROM w WHERE len(w) >= 50),
m AS (SELECT r, doc_id, s FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
b AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 50 THEN 0 ELSE 1 END AS begins FROM m),
i AS (SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY s) AS island FROM b)
SELECT doc_id, min(s) AS "start", max(s) + 50 AS "end", max(s) + 50 - min(s) AS n_words FROM i GROUP BY r, doc_id, island
"""


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))

"""Benchmark decontamination with DataFrame functions only.

Texts are normalised to words (lower case, punctuation removed). A document *window* has the word length of a benchmark item; a
document shorter than an item is one window. Windows and items get a 64-bit SimHash of their ``k``-word shingles, weighted by
multiplicity. Pairs of equal size are candidates if their fingerprints differ in at most ``radius`` bits: the fingerprint is cut
into four blocks of 16 bits, of which one differs in at most ``radius // 4`` bits (pigeonhole), so an equi-join of the windows' blocks
with all values within that distance of the items' blocks, on (size, block number, block value), finds all of them. Candidates
are verified by the exact weighted Jaccard similarity of their shingle multisets (``similarity`` or more).

Fingerprinting each of some 45 item sizes at each corpus position would cost thousands of operations per word, so windows are
laid only where a verified match is possible. An item's longest words (four words away from both ends where there is room) are
its *anchors*; the shingles that contain an anchor are over a fifth of the item's weight, so a window of similarity 0.8 or more shares
a shingle with an anchor in it, wherever it lies. Around each such shingle of a document *all* windows of the item's size that hold
its anchor are laid, so the order of the item's parts does not matter. Documents without an anchor word are dropped by a set test
inside the scan's stage; hits are linear in the text. This argument needs ``similarity`` >= 0.8, which the configuration enforces.
With ``every_window`` the windows are laid at each position instead, which gives the same rows (a test holds them against each
other).

Expected fingerprint distance at similarity 0.8 is 9.7 bits with a deviation of 2.9; the default radius of 23 is over 4.5
deviations away. Bit counts are kept in 16-bit lanes of 16 longs, which holds for items of up to 16,383 words.

Scale. Windows of equal words are fingerprinted and verified once, however many documents hold them. The anchors are sent to all
tasks if they are at most ``literal_anchors`` words and ``anchor_rows`` rows; beyond that, documents' words are joined with the
anchor table by a shuffle.

Defined results: null and empty texts (or texts of punctuation alone) match nothing; an item with fewer than ``k`` words is one
shingle; items without words are ignored. Repeated document rows count once. Extra columns are ignored. Ties between windows of
one document and item go to the leftmost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table, with_text, written


@dataclass(frozen=True)
class DecontaminationConfig:
    k: int = 5
    similarity: float = 0.8
    radius: int = 23
    literal_anchors: int = 20_000
    anchor_rows: int = 200_000
    every_window: bool = False

    def __post_init__(self):
        if self.similarity < 0.8 or self.k != 5:
            raise ValueError("the anchor bound holds for 5-word shingles and a similarity of 0.8 or more")


def normal_words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}\s]+", "")
    return F.filter(F.split(kept, r"\s+"), lambda w: w != "")


def shingle_starts(words: Column, k: int) -> Column:
    """First places (from 1) of all k-word shingles; fewer than k words make one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))


def shingles(words: Column, k: int) -> Column:
    return F.transform(shingle_starts(words, k), lambda i: F.array_join(F.slice(words, i, k), " "))


def _lane_sums(hashed: Column) -> list[Column]:
    """16 sums of 4 lanes: lane l of sum j counts the set bits at position j + 16 * l."""
    return [F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(F.lit(0x0001000100010001))).alias(f"lane{j}") for j in range(16)]


def _majority(count: Column) -> Column:
    """The fingerprint: bit b is set if more than half of ``count`` shingles have it. A lane holds a count below 2**14, so
    adding 2**14 - 1 - floor(count / 2) carries into its bit 14 exactly for a majority, and never into the sign."""
    bias = (F.lit(0x3FFF) - F.floor(count / 2).cast("long")) * F.lit(0x0001000100010001)
    bits = F.lit(0).cast("long")
    for j in range(16):
        top = F.shiftrightunsigned(F.col(f"lane{j}") + bias, 14).bitwiseAND(F.lit(0x0001000100010001))
        bits = bits.bitwiseOR(F.shiftleft(top, j))
    return bits


def hashed(words: Column, k: int) -> Column:
    """The hashes of all shingles."""
    return F.transform(shingle_starts(words, k), lambda i: F.xxhash64(F.slice(words, i, k)))


def fingerprints(windows: DataFrame) -> DataFrame:
    """(size, digest, fingerprint): the SimHash of the shingles of the windows (size, digest, hashes)."""
    sums = windows.select("size", "digest", F.explode("hashes").alias("h")).groupBy("size", "digest").agg(F.count("*").alias("n"), *_lane_sums(F.col("h")))
    return sums.select("size", "digest", _majority(F.col("n")).alias("fingerprint"))


def block(fingerprint: Column, number: Column) -> Column:
    """Block 0 .. 3 of 16 bits."""
    return F.call_function("shiftrightunsigned", fingerprint, number * 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def block_values(value: Column, bits: int) -> Column:
    """All 16-bit values that differ from ``value`` in at most ``bits`` bits."""
    masks = F.filter(F.sequence(F.lit(0), F.lit(0xFFFF)), lambda m: F.bit_count(m) <= bits)
    return F.transform(masks, lambda m: m.bitwiseXOR(value))


def normal_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, digest, words, size) of the items that have words; repeated rows once."""
    words = with_text(benchmark, "item_id").select("item_id", normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return words.select("item_id", digest(F.col("words")).alias("digest"), "words", F.size("words").alias("size"))


def digest(words: Column) -> Column:
    return F.md5(F.array_join(words, " "))


def around(words: Column, offset: Column, k: int) -> Column:
    """The k - 1 words on both sides of a word and itself; places beyond the text are empty strings."""
    pad = F.array_repeat(F.lit(""), k - 1)
    return F.slice(F.concat(pad, words, pad), offset + 1, 2 * k - 1)


def item_anchors(items: DataFrame, k: int) -> DataFrame:
    """(word, size, near): an item's longest words, away from the ends where there is room, with what is around each of them.

    Of an item with m shingles max(1, m // 5 - 3) word positions are taken. Each lies in k = 5 shingles, so together they lie in at
    least m // 5 + 1, over a fifth of the item's weight.
    """
    at = items.select("digest", "size", F.posexplode("words").alias("offset", "word"), F.col("words"))
    inner = F.when(F.col("size") >= 2 * k - 1, (F.col("offset") >= k - 1) & (F.col("offset") <= F.col("size") - k)).otherwise(True)
    longest = Window.partitionBy("digest").orderBy(F.length("word").desc(), "word", "offset")
    wanted = F.greatest(F.floor((F.col("size") - (k - 1)) / 5) - 3, F.lit(1))
    picked = at.filter(inner).withColumn("rank", F.row_number().over(longest)).filter(F.col("rank") <= wanted).select("digest", "word").distinct()
    everywhere = at.select("digest", "size", "word", around(F.col("words"), F.col("offset"), k).alias("near"))
    return picked.join(everywhere, ["digest", "word"]).select("word", "size", "near").distinct()


def shares_shingle(words: Column, position: Column, near: Column, size: Column, k: int) -> Column:
    """Whether the text agrees with an anchor's surroundings on a whole shingle around ``position`` (short items: always)."""
    found = size < k
    for j in range(k):
        first = position - (k - 1 - j)
        found = found | ((first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, k) == F.slice(near, j + 1, k)))
    return found


def anchored(words: DataFrame, items: DataFrame, config: DecontaminationConfig) -> DataFrame:
    """(doc_id, words, size, starts): the places of all windows that hold an anchor of an item of that size in a shingle of the item."""
    anchors = written(item_anchors(items, config.k), "anchors")
    few = anchors.select("word").distinct().limit(config.literal_anchors + 1).collect()
    n = F.size("words")
    if len(few) <= config.literal_anchors and anchors.count() <= config.anchor_rows:
        literal = F.array(*[F.lit(r["word"]) for r in few]) if few else F.array().cast("array<string>")
        met = words.select("doc_id", "words", F.array_intersect("words", literal).alias("met"))
        # explode_outer and the inner join, not a filter: a filter would be pushed below and cut the words a second time.
        places = F.when(F.size("met") > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("met", F.get("words", i))))
        hits = met.select("doc_id", "words", F.explode_outer(places).alias("position")).withColumn("word", F.get("words", F.col("position")))
        found = hits.join(F.broadcast(anchors), "word")
    else:
        hits = words.select("doc_id", "words", F.explode_outer(F.array_distinct("words")).alias("word")).join(anchors, "word")
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", i) == F.col("word"))
        found = hits.select("doc_id", "words", "size", "near", F.explode_outer(places).alias("position"))
    found = found.filter(shares_shingle(F.col("words"), F.col("position"), F.col("near"), F.col("size"), config.k))
    # A document id may stand for several texts, so a hash of the words is part of its identity.
    of_text = found.groupBy("doc_id", F.xxhash64("words").alias("text_hash"), "size").agg(F.collect_set("position").alias("positions"), F.first("words").alias("words"))
    last = F.size("words") - F.col("size")

    def starts(p: Column) -> Column:
        low = F.greatest(p - F.col("size") + 1, F.lit(0))
        return F.sequence(low, F.greatest(F.least(p, last), low))

    return of_text.select("doc_id", "words", "size", F.array_distinct(F.flatten(F.transform("positions", starts))).alias("starts"))


def everywhere(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, words, size, starts): all windows of all sizes of items."""
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # numbers up to the longest item's
    of_size = words.filter(F.size("words") > 0).select("doc_id", "words", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("size"))
    return of_size.withColumn("starts", F.sequence(F.lit(0), F.greatest(F.size("words") - F.col("size"), F.lit(0))))


def contamination(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, item_id, start (word number of the best window, from 0), n_words, distance (bits), similarity."""
    items = written(normal_items(benchmark), "items")
    texts = items.dropDuplicates(["digest"]).select("size", "digest", "words", hashed(F.col("words"), config.k).alias("hashes"))
    words = with_text(docs, "doc_id").select("doc_id", normal_words(F.col("text")).alias("words"))
    laid = written(everywhere(words, items) if config.every_window else anchored(words, items, config), "laid")
    windows = laid.select("doc_id", "size", "words", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "size", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words")).withColumn("digest", digest(F.col("words")))
    different = windows.select("size", "digest", "words").dropDuplicates(["size", "digest"])
    different = written(different.withColumn("hashes", hashed(F.col("words"), config.k)), "windows")

    prints = written(fingerprints(different), "prints")
    item_prints = fingerprints(texts).withColumnsRenamed({"digest": "item", "fingerprint": "item_print"})
    numbers = F.explode(F.array(*map(F.lit, range(4)))).alias("number")
    left = prints.select("*", numbers).withColumn("value", block(F.col("fingerprint"), F.col("number")))
    right = item_prints.select("*", numbers).withColumn("value", F.explode(block_values(block(F.col("item_print"), F.col("number")), config.radius // 4)))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    met = left.join(right.hint("merge"), ["size", "number", "value"]).withColumn("distance", distance).filter(F.col("distance") <= config.radius)
    close = met.select("size", "digest", "item", "distance").distinct()

    def sides(pairs: DataFrame, column: str) -> DataFrame:
        mine, theirs = different.select("size", "digest", F.col(column).alias("mine")), texts.select(F.col("digest").alias("item"), F.col(column).alias("theirs"))
        return pairs.join(mine, ["size", "digest"]).join(theirs, "item")

    # Equal shingles have equal hashes; what passes on hashes is verified on the shingles themselves.
    near = sides(close, "hashes").filter(weighted_jaccard(F.col("mine"), F.col("theirs")) >= config.similarity)
    exact = weighted_jaccard(shingles(F.col("mine"), config.k), shingles(F.col("theirs"), config.k))
    verified = sides(written(near.select(*close.columns), "near"), "words").select(*close.columns, exact.alias("similarity"))
    verified = written(verified.filter(F.col("similarity") >= config.similarity), "verified")
    found = windows.select("doc_id", "size", "start", "digest", F.size("words").alias("n_words")).join(verified, ["size", "digest"])
    named = found.join(items.select("item_id", F.col("digest").alias("item")), "item")
    best = F.min(F.struct(-F.col("similarity"), F.col("start"), "n_words", "distance", "similarity")).alias("best")
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.distance").alias("distance"), F.col("best.similarity").alias("similarity"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least multiplicities over sum of greatest, of two arrays taken as multisets."""
    both = F.array_intersect(a, b)
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))  # then no element is shared twice
    twice = F.aggregate(both, F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    shared = F.when(once, F.size(both)).otherwise(twice)
    return shared / (F.size(a) + F.size(b) - shared)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

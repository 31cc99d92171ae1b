"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's elements are its ``k``-word shingles labelled with their occurrence numbers. Each of ``sketches`` hash functions takes
the ``picks`` least elements and hashes them *in text order*, so that two texts share a sketch if they agree on the least
shingles and on their order: a sketch collision estimates edit similarity, not mere set overlap. Candidates are verified by the
exact word-level edit distance d, computed in a diagonal band: similarity 1 - d / max(n, m) >= ``similarity``.

Scale. Exact copies are one node (keyed by a 128-bit digest of the text). A bucket is never paired with itself: each member is
compared with the bucket's leader (its least node), which is linear in the bucket. What stays outside its leader's component is
dealt to smaller buckets of texts of like length, with leaders of their own. Rounds follow as long as one finds over ``least_share``
of all links: the members of such buckets get ``fresh`` new sketches of shingles of ``fresh_k`` words, again among texts of like
length, so that texts of a common passage are told apart by what else they hold. Rounds draw independent sketches, so
about that share of the links is what may still be missing. Each is linear in what is left. Candidate texts are fetched once per node and kept as word hashes; pairs that their numbers of words or the counts of
hashed words rule out are dropped before alignment (no accepted pair is). No bucket, class or component is collected in a task or
on the driver. Labels of leaders and classes are joined with salted keys; members of a hot bucket are split by adaptive execution.

What is found: with the default 48 sketches of 2 shingles a pair with 3-word shingle resemblance J meets at least once with
probability about 1 - (1 - J**2)**48. Word substitutions scattered over a text leave J near 0.34 at edit similarity 0.8, 0.44 at
0.85 and 0.57 at 0.9, so even at the accepted similarity few pairs never meet. A pair that meets only under leaders that are like
neither of the two is looked for again in the rounds; tests hold this against all pairs of 2,000 texts that share an opening. Short
texts (up to 14 words at 0.8) may be alike without a common shingle; buckets of their own (``short_keys``) lose none of their pairs.
Classes are the components of all verified links. Alignment takes memory linear in the two texts.

Defined results: null and empty texts are copies of each other; texts under ``k`` words match if their words are equal. Repeated
rows get one output row each. Extra columns are ignored. The class id is the least doc_id in the class (null only if all are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tables import bounded, discard_scratch, drop_finished_shuffles, scratch_mark, table, with_text, written
from .textarrays import lean, LOWER_ASCII, mix, same_row_windows, slices, TextSlice


@dataclass(frozen=True)
class NearDedupConfig:
    """``broadcast_nodes``: up to so many keys of 16 bytes (with a label of 16) are sent to all executors; beyond, joins shuffle.
    ``least_share``: rounds of fresh sketches go on while one finds more than this share of all links."""

    k: int = 3
    similarity: float = 0.8
    sketches: int = 48
    picks: int = 2
    fresh: int = 24
    fresh_k: int = 2
    least_share: float = 0.001
    broadcast_nodes: int = 500_000


#: Keys that one hot leader or class is spread over.
SALTS = 16

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(seed, seed + n, dtype=np.uint64) * _STEP + _STEP) | np.uint64(1)


def elements(part: TextSlice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, labelled hash, row) of a slice's shingles; a text of fewer than k words is one shingle."""
    start, end, row = part.words()
    word = part.hash_spans(start, end)
    at = same_row_windows(row, k)
    factors = _constants(k, 11)
    shingle = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        shingle += word[at + j] * factors[j]
    rows = row[at]
    n_words = np.bincount(row, minlength=part.n)
    short = np.flatnonzero(n_words < k)
    if len(short):
        where = np.searchsorted(row, short)
        own = np.array([_combined(word[w : w + n_words[r]]) for r, w in zip(short, where)], dtype=np.uint64)
        rows, shingle = np.concatenate([rows, short]), np.concatenate([shingle, own])
        order = np.argsort(rows, kind="stable")
        rows, shingle = rows[order], shingle[order]
    shingle = mix(shingle)
    key = shingle + mix(rows.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    occurrence = np.empty(len(key), dtype=np.uint64)
    occurrence[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return shingle, mix(shingle + occurrence * _STEP), rows


def _combined(words: np.ndarray) -> np.uint64:
    h = np.uint64(len(words) + 1)
    with np.errstate(over="ignore"):
        for w in words:
            h = (h ^ w) * _STEP
    return h


def sketch(part: TextSlice, config: NearDedupConfig, seed: int = 0) -> np.ndarray:
    """Array rows x sketches of order-sensitive sketch values; other seeds give independent ones."""
    shingle, labelled, rows = elements(part, config.k)
    begin = np.searchsorted(rows, np.arange(part.n))
    length = np.diff(np.append(begin, len(rows)))
    salt, factor, tail = (_constants(config.sketches, seed + s) for s in (101, 202, 303))
    weight = _constants(config.picks, 404)
    out = np.empty((part.n, config.sketches), dtype=np.uint64)
    for s in range(config.sketches):
        h = (labelled ^ salt[s]) * factor[s]
        picked = []
        for _ in range(config.picks):
            low = np.minimum.reduceat(h, begin)
            at = np.flatnonzero(h == np.repeat(low, length))
            if len(at) != part.n:  # equal hashes inside a row: the first stays
                at = at[np.searchsorted(rows[at], np.arange(part.n))]
            picked.append(np.where(low == _TOP, picked[-1] if picked else at, at))
            h[at] = _TOP
        ordered = np.sort(np.stack(picked), axis=0)
        value = np.full(part.n, tail[s])
        for j in range(config.picks):
            value = mix(value + shingle[ordered[j]] * weight[j])
        out[:, s] = value
    return out


def short_keys(words: tuple[int, ...], least: float) -> set[int]:
    """Bucket keys by which all pairs of short texts (an edit distance of up to 2 accepted) meet, bit 0 set unless the text may lead.

    Texts of one bucket are alike, or alike to each text that may lead, so comparing them with one such leader loses no link. Equal
    lengths: words but for one or two places, or but for one word at any places. A shorter text leads what gives it by leaving out
    one word (and, with two edits, by changing another) or two.
    """

    def limit(size: int) -> int:
        return int(np.floor((1 - least) * size + 1e-9))

    n, keys = len(words), set()

    def add(*key: object, led: int = 0) -> None:
        keys.add(hash((n - len_cut, *key)) & ~1 | led)

    len_cut = 0
    own, one, two = limit(n), limit(n + 1), limit(n + 2)
    without = [words[:i] + words[i + 1 :] for i in range(n)]
    pairs = [words[:i] + words[i + 1 : j] + words[j + 1 :] for j in range(n) for i in range(j)] if own == 2 else []
    if own == 1:
        for i, w in enumerate(without):
            add(1, i, w)
    if own == 2:
        for w in without:
            add(2, w)
        for at, w in zip([(i, j) for j in range(n) for i in range(j)], pairs):
            add(3, at, w)
    if one == 1:
        add(4, words)
    if one == 2:
        for i, w in enumerate(without):
            add(5, i, w)
    if two == 2:
        add(6, words)
    len_cut = 1
    if own == 1:
        for w in without:
            add(4, w, led=1)
    if own == 2:
        for w in set(without):
            for i in range(n - 1):
                add(5, i, w[:i] + w[i + 1 :], led=1)
    len_cut = 2
    for w in pairs:
        add(6, w, led=1)
    return keys


def short_lists(part: TextSlice, least: float) -> list[list[int]]:
    """``short_keys`` of a slice's texts; those for which more than two edits are accepted have none."""
    start, end, row = part.words()
    h = part.hash_spans(start, end).view(np.int64)
    cut = np.searchsorted(row, np.arange(part.n + 1))
    return [sorted(short_keys(tuple(h[a:b].tolist()), least)) if 0 < b - a < 3 / (1 - least) + 1e-9 else [] for a, b in zip(cut[:-1], cut[1:])]


def signatures(docs: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(doc_id, node, n_words, sketches, short) of every row; node is the digest of the text, short its ``short_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, values, short = [], [], []
            for part in slices(batch.column("text"), table=LOWER_ASCII):
                short += short_lists(part, config.similarity)
                words.append(np.bincount(part.words()[2], minlength=part.n))
                values.append(sketch(part, config).view(np.int64))
            if not words:
                continue
            flat = pa.array(np.concatenate(values).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * config.sketches), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(np.concatenate(words)), lists, pa.array(short, pa.list_(pa.int64()))], ["doc_id", "node", "n_words", "sketches", "short"])

    source = with_text(docs, "doc_id").select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, node binary, n_words long, sketches array<long>, short array<long>")


def word_classes(n_words: np.ndarray, least: float) -> np.ndarray:
    """Classes of numbers of words: two texts of similarity ``least`` or more differ by a factor of 1 / least at most, so they lie in
    equal or neighbouring classes."""
    return np.floor(np.log(np.maximum(n_words, 1)) / np.log(1.0001 / least)).astype(np.int64)


def fresh_buckets(texts: DataFrame, config: NearDedupConfig, seed: int) -> DataFrame:
    """(bucket, node) of the texts (node, text) by sketches of another seed, each for the two cells of the text's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for part in slices(batch.column("text"), table=LOWER_ASCII):
                found = sketch(part, config, seed)
                cell = word_classes(np.bincount(part.words()[2], minlength=part.n), config.similarity).astype(np.uint64)[:, None]
                values.append(mix(np.concatenate([found + cell * _STEP, found + (cell + np.uint64(1)) * _STEP], axis=1)).view(np.int64))
            if values:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * config.sketches)), pa.array(np.concatenate(values).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "sketches"])

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, sketches array<long>").select(F.explode("sketches").alias("bucket"), "node")


STRIP = 2048


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most ``limit``, by bit-parallel dynamic programming in a band.

    The rows of the table (symbols of ``a``) are cut into strips of ``STRIP`` bits of one integer. A strip is computed for the columns
    within ``limit`` of its rows only, from the scores along its upper border; border scores beyond the band are those of plain
    insertions, which no path of cost ``limit`` needs. Memory is linear in the longer sequence and does not depend on ``limit``.
    """
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[:short] != b[:short])
    start = int(unequal[0]) if len(unequal) else short
    a, b, short = a[start:], b[start:], short - start
    unequal = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(unequal[0]) if len(unequal) else short
    rows, columns = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    n, m = len(rows), len(columns)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return max(n, m)
    border, left = [0], 0  # scores along the lower border of the last strip, from column ``left`` on
    for top in range(0, n, STRIP):
        height = min(STRIP, n - top)
        low, high = max(0, top - limit), min(m, top + height + limit)
        above = border[low - left :]
        above += range(above[-1] + 1, above[-1] + 1 + high - low + 1 - len(above))
        places: dict[int, int] = {}
        for k, symbol in enumerate(rows[top : top + height]):
            places[symbol] = places.get(symbol, 0) | 1 << k
        full, last = (1 << height) - 1, 1 << (height - 1)
        plus, minus, score = full, 0, above[0] + height
        border, left = [score], low
        for symbol, was, now in zip(columns[low:high], above, above[1:]):
            equal = places.get(symbol, 0)
            vertical = equal | minus
            if now < was:
                equal |= 1
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
            up, down = (up << 1 | (now > was)) & full, (down << 1 | (now < was)) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
            border.append(score)
        if min(border) > limit:
            return None
    return border[-1] if border[-1] <= limit else None


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float | None:
    """1 - d / max(n, m) if that is at least ``least``."""
    size = max(len(a), len(b))
    if not size:
        return 1.0
    limit = int(np.floor((1 - least) * size + 1e-9))
    if abs(len(a) - len(b)) > limit:
        return None
    # Bag distance bounds the edit distance from below and rejects unrelated texts at once.
    symbols, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(code[: len(a)], minlength=len(symbols)) - np.bincount(code[len(a) :], minlength=len(symbols))
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > limit:
        return None
    d = edit_distance_within(code[: len(a)], code[len(a) :], limit)
    return None if d is None else 1 - d / size


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    found = []
    for part in slices(texts, table=LOWER_ASCII):
        start, end, row = part.words()
        h = part.hash_spans(start, end)
        cut = np.searchsorted(row, np.arange(part.n + 1))
        found += [h[cut[r] : cut[r + 1]] for r in range(part.n)]
    return found


#: Counts of a text's words by hash; their difference bounds the edit distance from below.
BINS = 256


def packed_words(texts: DataFrame) -> DataFrame:
    """(node, n_words, words, bins) of (node, text): 32 bits of each word's hash, and how many words fall in each bin (at most 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes(batch.column("text"))
            bins = [np.minimum(np.bincount((w >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(w) for w in words], pa.int64()), pa.array([(w >> np.uint64(32)).astype(np.uint32).tobytes() for w in words], pa.binary()), pa.array(bins, pa.binary())], ["node", "n_words", "words", "bins"])

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, n_words long, words binary, bins binary")


def possible(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose numbers of words and whose bins leave a similarity of ``least`` possible; no accepted pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("bins_a", "bins_b"))
            apart = x - y
            more, less = np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)
            longer = np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = pa.array(np.maximum(more, less) <= np.floor((1 - least) * longer + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    left, right = (packed.select(F.col("node").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab")
    sized = pairs.join(right, "b").join(left, "a").filter(F.abs(F.col("n_a") - F.col("n_b")) <= F.floor((1 - least) * F.greatest("n_a", "n_b") + 1e-9))
    return sized.mapInArrow(lean(run), "a binary, b binary")


def verify(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose words align, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("words_a"), batch.column("words_b"))
            found = [aligned_similarity(np.frombuffer(x.as_py(), dtype=np.uint32), np.frombuffer(y.as_py(), dtype=np.uint32), least) for x, y in sides]
            keep = pa.array([s is not None for s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array([s for s in found if s is not None], pa.float64())], ["a", "b", "similarity"])

    left, right = (packed.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b").mapInArrow(lean(run), "a binary, b binary, similarity double")


def star(members: DataFrame) -> DataFrame:
    """(bucket, node, leader) of the members (bucket, node) of buckets with two nodes or more; a leader is not paired with itself.

    The leader is the bucket's least node. The heads get an exchange of their own, so that adaptive execution can split a bucket
    with a large share of all members.
    """
    heads = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader != last")
    heads = heads.select("bucket", "leader").repartition("bucket")
    return members.join(heads.hint("merge"), "bucket").filter("node != leader").select("bucket", "node", "leader")


def led(members: DataFrame) -> DataFrame:
    """(node, leader) of the members (bucket, node) of ``short_keys``: the leader is the least node of those that may lead."""
    members = members.select(F.shiftright("bucket", 1).alias("bucket"), "node", (F.col("bucket") % 2 == 0).alias("leads"))
    heads = members.groupBy("bucket").agg(F.min(F.when(F.col("leads"), F.col("node"))).alias("leader"), F.min("node").alias("low"), F.max("node").alias("high"))
    heads = heads.filter("leader is not null and low != high").select("bucket", "leader").repartition("bucket")
    return members.join(heads.hint("merge"), "bucket").filter("node != leader").select("node", "leader").distinct()


def celled(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """The members (bucket, node) dealt to smaller buckets by ``word_classes``: a text is in two cells, its own class and the next, so
    texts of neighbouring classes share one."""
    class_ = F.floor(F.log(F.greatest("n_words", F.lit(1))) / float(np.log(1.0001 / least)))
    return members.join(sizes, "node").select("node", F.explode(F.array(class_, class_ + 1)).alias("cell"), "bucket").select(F.xxhash64("bucket", "cell").alias("bucket"), "node")


def near_duplicate_links(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, labels): members (doc_id, node); verified links (a, b, similarity) between different texts; labels
    (node, label) of the components' nodes."""
    begin = scratch_mark()
    rows = written(signatures(docs, config), "sketches")
    end = scratch_mark()
    members = written(rows.select("doc_id", "node"), "members")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sketches").alias("sketches"), F.first("short").alias("short"))
    buckets = nodes.select("node", F.explode("sketches").alias("bucket"))
    stars = written(star(buckets), "stars")  # bucket, node, leader
    met = stars.select("node", "leader").union(written(led(nodes.select("node", F.explode("short").alias("bucket"))), "short"))

    # Texts of all nodes that share a bucket with another one, one row per node.
    wanted = written(met.select("node").union(met.select("leader")).distinct(), "candidates")
    drop_finished_shuffles(docs.sparkSession)
    discard_scratch(docs.sparkSession, begin, end)
    reps = wanted.join(members.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node")
    reps = written(reps, "representatives")
    if reps.count() <= config.broadcast_nodes:
        reps = F.broadcast(reps)
    keyed = with_text(docs, "doc_id").withColumn("node", F.unhex(F.md5("text")))
    found = keyed.alias("d").join(reps.alias("r"), (F.col("d.node") == F.col("r.node")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi")
    texts = written(found.dropDuplicates(["node"]).select("node", "text"), "texts")
    packed = written(packed_words(texts), "packed")
    sizes = written(packed.select("node", "n_words"), "sizes")

    links, labels = [], docs.sparkSession.createDataFrame([], "node binary, label binary")

    def settle(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Verifies the pairs (node, leader) whose components differ, and joins the components of those that are alike."""
        pairs = written(pairs, "pairs")
        apart = different(pairs, labels, config.broadcast_nodes).select(F.col("leader").alias("a"), F.col("node").alias("b"))
        worth = written(possible(apart, packed, config.similarity), "possible")
        new = written(verify(worth, packed, config.similarity), "verified")
        links.append(new)
        labels = extended(labels, new, config.broadcast_nodes)
        drop_finished_shuffles(docs.sparkSession)
        return labels

    labels = settle(met.distinct(), labels)
    # What is left of the buckets is dealt by text length and gets new leaders; its members get new sketches, too, and these go on as
    # long as that is worth while.
    left = written(different(stars, labels, config.broadcast_nodes).select("bucket", "node").distinct(), "left")
    open_ = written(texts.join(left.select("node").distinct(), "node", "left_semi"), "open")
    dealt, total, turn = celled(left, sizes, config.similarity), links[0].count(), 0
    new = total + 1
    while new > config.least_share * total:
        turn += 1
        fresh = written(fresh_buckets(open_, replace(config, k=config.fresh_k, sketches=config.fresh), 1000 * turn), "fresh")
        now = fresh if turn > 1 else dealt.unionByName(fresh)
        labels = settle(star(now).select("node", "leader").distinct(), labels)
        new = links[-1].count()
        total += new
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)
    return members, all_links, labels


def different(stars: DataFrame, labels: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows whose node and leader are in different components. Up to ``broadcast_rows`` labels are sent to all executors. Beyond,
    they are joined by shuffles; a leader may lead a large share of all rows, so the (far fewer) labels of leaders are spread over
    ``SALTS`` keys."""
    own = labels.select("node", F.col("label").alias("own"))
    if bounded(labels, broadcast_rows) is not None:
        other = F.broadcast(labels.select(F.col("node").alias("leader"), F.col("label").alias("other")))
        joined = stars.join(F.broadcast(own), "node", "left").join(other, "leader", "left")
    else:
        heads = stars.select("leader").distinct().join(labels.withColumnRenamed("node", "leader"), "leader").withColumnRenamed("label", "other")
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stars.join(own, "node", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(heads, ["leader", "salt"], "left").drop("salt")
    return joined.filter(F.coalesce("own", "node") != F.coalesce("other", "leader")).drop("own", "other")


def extended(labels: DataFrame, links: DataFrame, broadcast_rows: int) -> DataFrame:
    """Labels after adding links: components of the (much smaller) graph of labels."""
    sent = F.broadcast if bounded(labels, broadcast_rows) is not None else (lambda df: df)
    a = sent(labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")))
    b = sent(labels.select(F.col("node").alias("b"), F.col("label").alias("label_b")))
    ends = links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    lifted = written(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), "lifted")
    if lifted.isEmpty():
        return labels
    joined = connected_components(lifted, broadcast_rows)
    step = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(bounded(step, broadcast_rows) or step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = joined.join(sent(labels.select("node")), "node", "left_anti")
    return written(moved.union(fresh), "labels")


def near_duplicate_classes(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """doc_id, node, label (of the class), class_id (least doc_id of the class), one row per input row."""
    members, _, labels = near_duplicate_links(docs, config)
    nodes = members.groupBy("node").agg(F.min("doc_id").alias("rep")).join(labels, "node", "left")
    linked = nodes.filter("label is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    classes = linked.groupBy("label").agg(F.min("rep").alias("class_id"))
    spread = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class may hold a third of all nodes
    alone = nodes.filter("label is null").select("node", F.col("node").alias("label"), F.col("rep").alias("class_id"))
    of_node = linked.join(spread, ["label", "salt"]).select("node", "label", "class_id").unionByName(alone)
    return members.join(of_node, "node").select("doc_id", "node", "label", "class_id")


def near_dedup(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), one row per input row."""
    return near_duplicate_classes(docs, config).select("doc_id", "class_id")


def one_of_each_class(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """``docs`` with one row of each class: the one of least doc_id (then of least text digest)."""
    rows = written(near_duplicate_classes(docs, config).select("doc_id", "node", "label"), "classes")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    stays = written(rows.groupBy("label").agg(F.min(first).alias("f")).select("f.doc_id", "f.node"), "stays")
    goes = rows.alias("r").join(stays.alias("s"), (F.col("r.node") == F.col("s.node")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")), "left_anti").distinct()
    goes = written(goes.select(F.col("doc_id").alias("__goes_id"), F.col("node").alias("__goes_node")), "goes")
    if goes.count() <= config.broadcast_nodes:
        goes = F.broadcast(goes)
    keyed = docs.withColumn("__node", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    left = keyed.join(goes, (F.col("__node") == F.col("__goes_node")) & F.col("doc_id").eqNullSafe(F.col("__goes_id")), "left_anti")
    if rows.groupBy("doc_id", "node").count().filter("count > 1").join(stays, "node", "left_semi").isEmpty():
        return left.drop("__node")
    return left.dropDuplicates(["doc_id", "__node"]).drop("__node")  # repeated rows


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))

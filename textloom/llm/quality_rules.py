"""Quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: the *trusted* one from labelled rows (quality 1, toxic 0) and the
*raw* one from every document. A document's score is the mean over its n-grams of log p_trusted - log p_raw, that is the
log-likelihood ratio divided by the number of n-grams, and it is kept when no base rule fails and the score is at least
``threshold``. Every document gets the same deterministic test. The raw model has ``smoothing`` added to each bucket; the trusted
one is drawn towards the raw one with the weight of as many n-grams, so an n-gram that few trusted texts could have shown says
nothing. The default threshold lies in the gap of the labelled rows of the sample tables: trusted texts score -0.16 or more, half of
the bad ones -1 or less.

Memory is bounded: a task holds one slice of text and two vectors of ``2**bits`` numbers; the fitted model has ``2**bits``
doubles whatever the corpus size, which is the proven bound for sending it to the workers.

Defined results: a null or empty text has no words and no n-grams, score 0.0, and fails the base rules. Repeated rows are
scored each (and counted each in the raw model). With no trusted row at all, the ratio is undefined and base rules decide
alone (score 0.0). Columns other than doc_id and text are ignored. A null doc_id is kept as a null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, with_text
from .textarrays import lean, mix, same_row_windows, slices, SPACE, TextSlice


@dataclass(frozen=True)
class QualityConfig:
    """``trusted_rows`` bounds the labelled sample that the trusted model is fitted on: the rows of least hashed id."""

    bits: int = 16
    gram: int = 4
    trusted_rows: int = 20_000
    threshold: float = -0.3
    min_words: int = 50
    max_repeat_percent: int = 50
    smoothing: float = 1.0


#: Ratios are summed as whole numbers of this size, so that a text's score does not depend on the texts beside it.
_UNIT = 1 << 32
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_buckets(part: TextSlice, bits: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, valid): hashed n-gram starting at each byte; not valid where it would leave its row."""
    size = len(part.data)
    code = np.zeros(size, dtype=np.uint32)
    for k in range(gram):
        code[: max(size - k, 0)] |= part.data[k:].astype(np.uint32) << np.uint32(8 * k)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    valid = np.ones(size, dtype=bool)
    for k in range(1, gram):
        last = part.offsets[1:] - k
        valid[last[last >= part.offsets[:-1]]] = False
    return bucket, valid


def count_grams(docs: DataFrame, trusted_ids: DataFrame, config: QualityConfig) -> DataFrame:
    """(bucket, raw, trusted): n-gram counts over all documents and over the trusted ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(1 << config.bits, dtype=np.int64)
        trusted = np.zeros(1 << config.bits, dtype=np.int64)
        for batch in batches:
            marked = np.asarray(batch.column("trusted").to_pylist(), dtype=bool)
            for part in slices(batch.column("text")):
                bucket, valid = gram_buckets(part, config.bits, config.gram)
                raw += np.bincount(bucket[valid], minlength=len(raw))
                own = np.repeat(marked[part.first : part.first + part.n], np.diff(part.offsets))
                trusted += np.bincount(bucket[valid & own], minlength=len(raw))
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(trusted[full])], ["bucket", "raw", "trusted"])

    # At most config.trusted_rows ids: a proven bound, so this side may be broadcast.
    ids = trusted_ids.select("doc_id", F.lit(True).alias("trusted"))
    marked = with_text(docs, "doc_id").join(F.broadcast(ids), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    parts = marked.mapInArrow(lean(count), "bucket long, raw long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def trusted_sample(labels: DataFrame, config: QualityConfig) -> DataFrame:
    """Ids of trusted labelled rows, at most ``config.trusted_rows`` of them by order of hashed id."""
    good = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.trusted_rows)


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> np.ndarray:
    """The log ratio of each bucket; zeros if there is no trusted text."""
    counts = count_grams(docs, trusted_sample(labels, config), config).toPandas()  # at most 2**bits rows
    raw, trusted = np.zeros(1 << config.bits), np.zeros(1 << config.bits)
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    if not trusted.sum():
        return np.zeros(1 << config.bits)
    a = config.smoothing
    prior = (raw + a) / (raw.sum() + a * len(raw))
    return np.log((trusted + a * len(raw) * prior) / (trusted.sum() + a * len(raw))) - np.log(prior)


def repeated_words(words_row: np.ndarray, word_hash: np.ndarray, rows: int) -> np.ndarray:
    """Per row: words that lie in a 3-word window found twice or more in the row."""
    at = same_row_windows(words_row, 3)
    key = mix(word_hash[at] * _ODD[0] + word_hash[at + 1] * _ODD[1] + word_hash[at + 2] * _ODD[2]) + mix(words_row[at].astype(np.uint64) * _ODD[0])
    hit = at[_in_groups(key)]
    covered = np.zeros(len(words_row) + 2, dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(words_row[covered[: len(words_row)]], minlength=rows)


def _in_groups(key: np.ndarray) -> np.ndarray:
    """True where the key occurs twice or more."""
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    found = np.zeros(len(key), dtype=bool)
    found[order] = same[1:] | same[:-1]
    return found


def duplicate_lines(part: TextSlice, inside: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(part.data == 0x0A)
    start = np.sort(np.concatenate([part.offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([part.offsets[1:], breaks]), kind="stable")
    words_before = np.zeros(len(inside) + 1, dtype=np.int64)
    np.cumsum(inside, out=words_before[1:])
    row = np.sort(np.concatenate([np.arange(part.n), part.rows_of(breaks)]), kind="stable")
    has_word = words_before[end] > words_before[start]
    start, end, row = start[has_word], end[has_word], row[has_word]
    key = part.hash_spans(start, end) + mix(row.astype(np.uint64) * _ODD[0])
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    return np.bincount(row[later], minlength=part.n)


def measure(part: TextSlice, units: np.ndarray, config: QualityConfig) -> dict[str, np.ndarray]:
    """All figures of the rows of a slice; ``units`` holds the log ratio of each bucket in units of 2**-32."""
    start, end, row = part.words()
    inside = ~SPACE[part.data]
    out = {
        "n_words": np.bincount(row, minlength=part.n),
        "word_chars": part.sum_by_row(inside & ((part.data & 0xC0) != 0x80)),
        "n_symbols": part.sum_by_row(_SYMBOL[part.data]),
        "n_dup_lines": duplicate_lines(part, inside),
        "n_repeat_words": repeated_words(row, part.hash_spans(start, end), part.n),
    }
    bucket, valid = gram_buckets(part, config.bits, config.gram)
    grams = part.sum_by_row(valid)
    out["score"] = part.sum_by_row(np.where(valid, units[bucket], 0)) / (_UNIT * np.maximum(grams, 1))
    out["base_failed"] = (out["n_words"] < config.min_words) | (100 * out["n_repeat_words"] > config.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= config.threshold)
    return out


FIGURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "score": "double"}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def score(docs: DataFrame, ratio: np.ndarray, config: QualityConfig = QualityConfig(), keep_columns: bool = False) -> DataFrame:
    """One row per input row: doc_id (or with ``keep_columns`` every input column) and the figures.

    With ``keep_columns`` the caller's columns of the same names as figures are replaced by the figures.
    """
    carried = [c for c in docs.columns if c not in FIGURES] if keep_columns else ["doc_id"]
    source = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]

    units = np.rint(ratio * _UNIT).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(part, units, config) for part in slices(batch.column("__text"))]
            arrays = [batch.column(c) for c in carried]
            for name, kind in FIGURES.items():
                values = np.concatenate([f[name] for f in found]) if found else np.zeros(0)
                arrays.append(pa.array(values, type=_ARROW[kind]))
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *FIGURES])

    return source.mapInArrow(lean(run), ", ".join(fields + [f"{n} {k}" for n, k in FIGURES.items()]))


def quality_rules(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    return score(docs, fit(docs, labels, config), config)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded inside the writing tasks (so ids are never shuffled), and written as
ORC with columns ``doc_id``, ``seq`` (position in its file) and ``ids`` (array<int>, each document closed by ``end_id``). File
part numbers ascend with the ids, so the concatenation of the files is the whole token stream in document order. Stripes can be
read in parallel; min/max row indexes and Bloom filters prune a lookup of single documents to few row groups.

``read_token_stream`` derives everything from the files: length and checksum per document, and the start of each document in
the stream as a prefix sum in two steps (inside each file, then over the file totals, one row per file).

Texts are encoded by the tokenizers library, piece by piece between white space: the default vocabulary's rules never join
characters across white space, and pieces repeat, so a bounded dictionary of pieces saves most calls; the distinct pieces
of a slice of texts are looked up once, and its ids are gathered at once. Texts with the separators
U+001C-U+001F, which are white space for Python only, are encoded whole, as are all texts for a vocabulary with other rules
(normaliser, pre-tokenizer, model or added tokens that ``PIECE_RULES`` does not state).

Defined results: null and empty texts hold the end id alone. Repeated rows and equal ids are kept each (ordered by a hash of the
text among equals); null ids come first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import scratch, table, with_text, written
from .textarrays import lean, row_slices
from .vocabularies import public_path


@dataclass(frozen=True)
class TokenOutputConfig:
    vocabulary: str | None = None
    end_id: int = 2
    cache_entries: int = 900_000
    slice_bytes: int = 4 << 20
    stripe_bytes: int = 16 << 20
    row_index_stride: int = 1_000
    bloom_fpp: float = 0.01
    compress: str = "lz4"


# The rules under which texts may be cut into pieces, as the vocabulary's file states them.
PIECE_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "model": {"type": "BPE", "end_of_word_suffix": "</w>"},
    "truncation": None, "padding": None,
}


def allows_pieces(vocabulary: str) -> bool:
    """Whether a vocabulary's file states the rules that ``PieceEncoder`` relies on."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = json.load(f)
    model = {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges") and v}
    added = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in rules.get("added_tokens") or [])
    return added and {k: rules.get(k) for k in PIECE_RULES} | {"model": model} == PIECE_RULES


@lru_cache(maxsize=1)
def _sign_weights() -> np.ndarray:
    """By code point: 3 for a full stop and a comma, 1 for any other sign, 0 for white space, letters and digits."""
    weights = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for run in re.finditer(r"(?:[^\w\s]|_)+", "".join(map(chr, range(sys.maxunicode + 1)))):
        weights[run.start() : run.end()] = 1
    weights[[ord("."), ord(",")]] = 3
    return weights


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def stops_beside_signs(code: np.ndarray) -> np.ndarray:
    """Places of the full stops and commas that have a sign (another stop as well) beside them."""
    stops, weight = np.flatnonzero((code == ord(".")) | (code == ord(","))), _sign_weights()
    before, after = np.maximum(stops - 1, 0), np.minimum(stops + 1, len(code) - 1)
    return stops[(weight[code[before]] > 0) & (stops > 0) | (weight[code[after]] > 0) & (stops < len(code) - 1)]


def stop_beside_sign(text: str) -> bool:
    """Whether a full stop or comma has a sign (another stop as well) beside it."""
    return len(stops_beside_signs(code_points(text))) > 0


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length`` of each span, one span after another."""
    ends = np.cumsum(length, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


# White space beyond ASCII, as ``str.split`` has it; pieces of letters and then signs, whose halves the vocabulary's
# rules encode apart: letters that NFC leaves alone and whose lower case is one letter, signs other than the apostrophe.
WIDE_SPACE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
LETTERS_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿŒœ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch


def encoded(tokenizer, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)(texts, add_special_tokens=False)]


class PieceEncoder:
    """Texts -> ids. Pieces are numbered in ``known``; by number, ``start`` and ``length`` say where a piece's ids are in ``pool`` (16
    bits each where the vocabulary allows it). So each distinct piece of a batch of texts is looked up once, and all ids of the batch
    are gathered at once.

    ``known`` holds at most ``cache_entries`` pieces (with 16 ids each on average) and those of one batch; when it is full, those met
    in two batches or more stay.
    """

    def __init__(self, vocabulary: str, cache_entries: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_pieces = allows_pieces(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.zeros(size, dtype=bool)
        self.ends_word[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        # The same model, for pieces that the vocabulary's normaliser and pattern leave as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache_entries, self.kind = cache_entries, np.uint16 if size <= 1 << 16 else np.int32
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, dtype=self.kind), 0
        self.start, self.length, self.met_again = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=bool)
        self.add([""], np.zeros(0, dtype=self.kind), np.zeros(1, dtype=np.int32))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spaced(self, texts: list[str]) -> list[str | None]:
        """Texts whose words between ASCII white space are pieces that encode to the text's ids one by one; None: encode it whole.

        The vocabulary normalises to NFC, lower-cases character by character and cuts letters, digits and runs of other signs
        apart. Where the text and its lower case are NFC already (and no capital sigma, whose lower case depends on its place,
        occurs) the lower-case text has the same ids; a full stop or comma is a piece of its own if no other sign is beside it.
        """
        found, lowered = list(texts), np.zeros(len(texts), dtype=bool)
        whole = [k for k, text in enumerate(texts) if any(c in text for c in "\x1c\x1d\x1e\x1f")]
        for k, text in enumerate(texts):
            if "\u03a3" not in text and is_normalized("NFC", text):
                low = text.lower()
                if "<|" not in low and is_normalized("NFC", low):
                    found[k], lowered[k] = low, True
        code = code_points("\n".join(found))
        first = np.cumsum([0] + [len(t) + 1 for t in found])
        beyond = np.flatnonzero(code > 0x7F)
        beyond = beyond[np.isin(code[beyond], WIDE_SPACE)]
        crowded, wide = (np.unique(np.searchsorted(first, at, side="right") - 1) for at in (stops_beside_signs(code), beyond))
        lowered[crowded] = False
        for k in crowded.tolist():
            found[k] = texts[k]
        for k in wide.tolist():
            found[k] = " ".join(found[k].split())
        for k in np.flatnonzero(lowered).tolist():
            found[k] = found[k].replace(".", " . ").replace(",", " , ")
        for k in whole:
            found[k] = None
        return found

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each closed by ``end_id``; number of ids of each text with it)."""
        spaced = self.spaced(texts) if self.by_pieces else [None] * len(texts)
        words = pc.ascii_split_whitespace(pa.array(spaced, pa.large_string()))
        distinct = words.values.dictionary_encode()
        number, word = self.numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), distinct.indices.to_numpy()
        each = self.length[number]
        own = self.pool[spans(self.start[number], each)].astype(np.int32)  # small enough for the processor's cache
        length = each[word]
        ids = own[spans((np.cumsum(each) - each)[word], length)]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[words.offsets.to_numpy()[1:]]
        whole = [k for k, t in enumerate(spaced) if t is None]
        if whole:
            parts = np.split(ids, ends[:-1])
            for k in whole:
                parts[k] = np.array(self.whole(texts[k]), dtype=np.int32)
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts], dtype=np.int64)
        return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces; new ones are learnt."""
        number = self.looked_up(pieces)
        if max(2 * len(self.known), self.used // 8) > self.cache_entries:
            self.met_again[number[number >= 0]] = True
            if max(len(self.known) + np.count_nonzero(number < 0), self.used // 16) > self.cache_entries:
                self.forget()
                number = self.looked_up(pieces)
        new = [pieces[k] for k in np.flatnonzero(number < 0).tolist()]
        if new:
            self.learn(new)
            number[number < 0] = self.looked_up(new)
        return number

    def looked_up(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))

    def forget(self) -> None:
        keep = np.flatnonzero(self.met_again[: len(self.known)])
        keep = keep[keep > 0]  # the empty piece is always known
        if 2 * len(keep) >= self.cache_entries or self.length[keep].sum(dtype=np.int64) >= 8 * self.cache_entries:
            keep = keep[:0]
        pieces, ids, length = list(self.known), self.pool[spans(self.start[keep], self.length[keep])], self.length[keep]
        self.clear()
        self.add([pieces[k] for k in keep.tolist()], ids, length)

    def add(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Numbers new pieces, given all their ids in order and the number of ids of each."""
        n, to, used = len(self.known), len(self.known) + len(pieces), self.used + len(ids)
        if to > len(self.start):
            self.start, self.length, self.met_again = (np.concatenate([x, np.zeros(max(to, len(x)), dtype=x.dtype)]) for x in (self.start, self.length, self.met_again))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(used, len(self.pool)), dtype=self.kind)])
        self.known.update(zip(pieces, range(n, to)))
        self.pool[self.used : used] = ids
        self.start[n:to], self.length[n:to] = self.used + np.cumsum(length, dtype=np.int64) - length, length
        self.used = used

    def learn(self, new: list[str]) -> None:
        """Encodes new pieces: letters alone and signs alone many at a time (each ends with its only word-end token), letters with
        signs behind them or in upper case from their halves, the others singly."""
        plain, halves, pairs, others = {}, [], [], []
        for piece in new:
            match = LETTERS_AND_SIGNS(piece)
            if not match:
                others.append(piece)
                continue
            letters, signs = match[1].lower(), match[2]
            if piece == letters or piece == signs:
                plain[piece] = None
            else:
                pairs.append(piece)
                halves += letters, signs
        plain.update(dict.fromkeys(h for h in halves if h not in self.known))
        singly = [w for w in others if not w.isalpha()]
        for tokenizer, words in ((self.plain, list(plain)), (self.tokenizer, [w for w in others if w.isalpha()])):
            for at in range(0, len(words), 5000):
                some = words[at : at + 5000]
                ids = np.array(encoded(tokenizer, [" ".join(some)])[0], dtype=np.int32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    self.add(some, ids, np.diff(ends, prepend=0))
                else:  # a letter whose lower case has a mark that is cut off, or no word ends in this vocabulary
                    singly += some
        found = encoded(self.tokenizer, singly) if singly else []
        self.add(singly, np.array(list(chain.from_iterable(found)), dtype=np.int32), np.array([len(x) for x in found], dtype=np.int32))
        half = self.looked_up(halves)
        length = self.length[half]
        self.add(pairs, self.pool[spans(self.start[half], length)], length.reshape(-1, 2).sum(axis=1))


@lru_cache(maxsize=2)
def encoder(vocabulary: str, cache_entries: int) -> PieceEncoder:
    return PieceEncoder(vocabulary, cache_entries)


def write_token_ids(docs: DataFrame, path: str, config: TokenOutputConfig = TokenOutputConfig()) -> None:
    """Encodes ``docs`` and writes the token stream in ascending doc_id order to the ORC folder ``path``."""
    vocabulary, entries = config.vocabulary or public_path("word_bpe_49k.json"), config.cache_entries
    end_id, slice_bytes = config.end_id, config.slice_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seq = encoder(vocabulary, entries), 0
        for batch in batches:
            for at, to in row_slices(batch.column("text"), slice_bytes):  # a bounded size of texts is held as ids at a time
                part = batch.slice(at, to - at)
                ids, lengths = coder.encode(part.column("text").to_pylist(), end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(seq, seq + len(lengths))), lists], ["doc_id", "seq", "ids"])
                seq += len(lengths)

    source = with_text(docs, "doc_id").withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    rows = ordered.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, seq long, ids array<int>")
    options = {
        "compression": config.compress, "orc.stripe.size": config.stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": config.row_index_stride,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": config.bloom_fpp,
    }
    rows.write.options(**options).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """Token arrays of single documents; the filter is pushed down to row indexes and Bloom filters. Ids have the type they were
    written with."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def read_token_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (of the type it was written with), start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.orc(path)
    id_type = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<i4")).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("seq"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "shard", "seq", "n_tokens", "ids_crc32"])

    shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    found = files.select("doc_id", shard.alias("shard"), "seq", "ids").mapInArrow(lean(run), f"doc_id {id_type}, shard int, seq long, n_tokens long, ids_crc32 long")
    found = written(found, "token-index")  # read twice below; the ids are decoded once
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("local_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # One row per file: the window without partitions and the broadcast are bounded by the number of files.
    totals = local.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return local.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, config: TokenOutputConfig = TokenOutputConfig()) -> DataFrame:
    write_token_ids(docs, path, config)
    return read_token_stream(docs.sparkSession, path)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), scratch(spark, "token-ids"))

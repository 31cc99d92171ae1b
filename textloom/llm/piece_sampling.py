"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The lattice of a text has an edge for every vocabulary piece at every place (and a byte-fallback edge for a character that no
piece covers). Forward filtering gives the log of the total weight of all paths to each character; backward sampling walks from
the end, choosing each edge with its exact conditional probability, so a segmentation z is drawn with probability proportional
to the product of its piece weights. A piece of rank r weighs 1 / (r + 1) ** sharpness (the files hold merge ranks, no
probabilities). Every choice uses a uniform number hashed from (seed, row key, position in the text): results depend neither on
partitioning nor on retries.

Pieces never join text across the start of a white-space run or next to a line break, so the lattice falls into short units.
Equal units of a slice of text share one lattice, and all walks of a slice are done together in array operations: memory is
bounded by the slice. The library's rules hold: spaces become U+2581 and one is put in front; other characters, a literal U+2581
included, are kept by byte fallback, so decoding is lossless for every text.

Defined results: null and empty texts give no pieces and decode to the empty text. Repeated rows with the same key get the same
pieces. A null key is a key like any other. Other columns are ignored by ``sample_pieces`` and kept by ``add_pieces``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .textarrays import lean, mix, row_slices, _power_table
from .vocabularies import public_path

SPACE_MARK = 0x2581
_LITERAL_MARK = 0x110000  # stands for a U+2581 of the text itself; no piece has it
_BREAK = 0x0A
_FALLBACK = -2
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PieceConfig:
    vocabulary: str | None = None
    seed: int = 20_240_601
    sharpness: float = 1.0
    fallback_log_weight: float = -12.0
    slice_bytes: int = 250_000


class Pieces:
    """Vocabulary tables: a hash table of all piece prefixes, log weights, and byte forms for decoding."""

    def __init__(self, names: list[str], is_byte: list[bool], usable: list[bool], sharpness: float):
        self.names = names
        first = min((k for k, ok in enumerate(usable) if ok), default=0)
        self.log_weight = np.array([-sharpness * np.log(k - first + 1.0) if ok else -np.inf for k, ok in enumerate(usable)])
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for k, b in enumerate(is_byte):
            if b:
                self.byte_id[int(names[k][1:-1], 16)] = k
        prefix: dict[str, int] = {}
        for k, name in enumerate(names):
            if usable[k]:
                for n in range(1, len(name)):
                    prefix.setdefault(name[:n], -1)
                prefix[name] = k
        self.longest = max((len(n) for n, ok in zip(names, usable) if ok), default=1)
        flat = np.frombuffer("".join(prefix).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in prefix])
        hashes = CodeHash(flat).spans(np.concatenate([[0], ends[:-1]]), ends)
        self._fill(hashes, np.array(list(prefix.values()), dtype=np.int32))
        self.decoded = [bytes([int(n[1:-1], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, is_byte)]

    def _fill(self, hashes: np.ndarray, values: np.ndarray) -> None:
        bits = max(12, int(np.ceil(np.log2(len(hashes) * 16 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -3, dtype=np.int32)
        for h, v in zip(hashes, values):
            at = int(h >> self.shift)
            while self.values[at] != -3:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = h, v

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -3 for neither."""
        at = (hashes >> self.shift).astype(np.int64)
        found = np.where(self.keys[at] == hashes, self.values[at], -3)
        open_ = np.flatnonzero((found == -3) & (self.values[at] != -3))
        where = at[open_]
        while len(open_):
            where = (where + 1) & self.mask
            hit = (self.keys[where] == hashes[open_]) & (self.values[where] != -3)
            found[open_[hit]] = self.values[where[hit]]
            go = ~hit & (self.values[where] != -3)
            open_, where = open_[go], where[go]
        return found

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return data[1:].decode()


class CodeHash:
    """Hashes of spans of a code-point array, equal for equal contents."""

    def __init__(self, codes: np.ndarray):
        self.prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power_table("base", len(codes)), out=self.prefix[1:])
        self.inverse = _power_table("inverse", len(codes) + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


@lru_cache(maxsize=2)
def pieces(vocabulary: str, sharpness: float) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    n = m.get_piece_size()
    byte = [m.is_byte(k) for k in range(n)]
    usable = [not (byte[k] or m.is_control(k) or m.is_unknown(k) or m.is_unused(k)) for k in range(n)]
    return Pieces([m.id_to_piece(k) for k in range(n)], byte, usable, sharpness)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated index ranges."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return np.arange(total) + shift


class Lattices:
    """Lattices of distinct units, laid end to end; the node of a character is the place after it."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, vocabulary: Pieces, fallback: float):
        size = len(codes)
        lengths = np.diff(np.append(starts, size))
        begin = np.repeat(starts, lengths)
        stop = begin + np.repeat(lengths, lengths)
        hashes = CodeHash(codes)
        source, target, piece = [], [], []
        alive = np.arange(size)
        for n in range(1, vocabulary.longest + 1):
            alive = alive[alive + n <= stop[alive]]
            found = vocabulary.look_up(hashes.spans(alive, alive + n))
            full = found >= 0
            source.append(alive[full])
            target.append(alive[full] + n - 1)
            piece.append(found[full])
            if n == 1:
                rest = alive[~full]
                source.append(rest)
                target.append(rest)
                piece.append(np.full(len(rest), _FALLBACK, dtype=np.int32))
            alive = alive[found != -3]
        source, target, piece = np.concatenate(source), np.concatenate(target), np.concatenate(piece)
        depth = target - begin[target]
        order = np.argsort(depth * size + target, kind="stable")  # edges of a node: shortest piece first
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        weight = np.where(piece >= 0, vocabulary.log_weight[piece], fallback)
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, dtype=np.int64)
        # Forward filtering, one step for all units' nodes of equal depth.
        total = np.zeros(size)
        value = np.empty(len(target))
        inner = source > begin[source] if len(source) else np.zeros(0, dtype=bool)
        level = np.searchsorted(depth, np.arange(int(depth[-1]) + 2 if len(depth) else 1))
        node_level = np.searchsorted(first, level)
        for d in range(len(level) - 1):
            a, b = level[d], level[d + 1]
            came = np.where(inner[a:b], total[source[a:b] - 1], 0.0)
            value[a:b] = weight[a:b] + came
            heads = first[node_level[d] : node_level[d + 1]] - a
            top = np.maximum.reduceat(value[a:b], heads)
            spread = np.diff(np.append(heads, b - a))
            mass = np.add.reduceat(np.exp(value[a:b] - np.repeat(top, spread)), heads)
            total[target[a:b][heads]] = top + np.log(mass)
        share = np.exp(value - total[target])
        running, edges, k = share, np.diff(np.append(first, len(target))), 1
        while len(later := first[edges > k]):  # one node's sums do not depend on the others beside it
            running[later + k] += running[later + k - 1]
            k += 1
        if len(first):
            running[np.append(first[1:], len(target)) - 1] = 1.0
        self.cumulative = running
        self.first_edge = np.empty(size, dtype=np.int64)
        self.first_edge[target[first]] = first
        self.source, self.piece, self.begin, self.log_total = source, piece, begin, total

    def draw(self, at: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first character) of an edge into each of the nodes ``at``."""
        edge = self.first_edge[at]
        open_ = np.flatnonzero(self.cumulative[edge] <= uniform)
        while len(open_):  # as many rounds as a node has edges, at most the longest piece
            edge[open_] += 1
            open_ = open_[self.cumulative[edge[open_]] <= uniform[open_]]
        return self.piece[edge], self.source[edge]


def sample_texts(texts: list[str], keys: np.ndarray, vocabulary: Pieces, config: PieceConfig) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): sampled piece ids of each text."""
    marked = ["" if not t else " " + t for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).copy()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
    if not len(codes):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    codes[codes == SPACE_MARK] = _LITERAL_MARK
    codes[codes == 0x20] = SPACE_MARK
    mark, brk = codes == SPACE_MARK, codes == _BREAK
    cut = np.zeros(len(codes), dtype=bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | brk[1:] | brk[:-1]
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(codes)))
    unit = CodeHash(codes).spans(start, start + length)
    _, example, which = np.unique(unit, return_index=True, return_inverse=True)
    own = length[example]
    lattice_start = np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64)
    lattices = Lattices(codes[_ranges(start[example], own)], lattice_start, vocabulary, config.fallback_log_weight)

    row = np.searchsorted(bounds, start, side="right") - 1
    key = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(config.seed * int(_STEP) % (1 << 64)))
    chosen = np.full(len(codes), -1, dtype=np.int32)
    shift = start - lattice_start[which]  # from a unit's lattice to its place in the slice
    at = lattice_start[which] + own[which] - 1
    row_key, row_start = key[row], bounds[row]
    while len(at):
        place = at + shift
        bits = mix(row_key + (place - row_start).astype(np.uint64) * _STEP)
        piece, source = lattices.draw(at, (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        chosen[place] = piece
        go = source > lattices.begin[at]
        at, shift, row_key, row_start = source[go] - 1, shift[go], row_key[go], row_start[go]

    kept = np.flatnonzero(chosen != -1)
    ids, width = chosen[kept], np.ones(len(kept), dtype=np.int64)
    fallback = np.flatnonzero(ids == _FALLBACK)
    if len(fallback):
        raw = codes[kept[fallback]]
        raw = np.where(raw == _LITERAL_MARK, SPACE_MARK, raw)
        encoded = [chr(c).encode() for c in raw.tolist()]
        width[fallback] = [len(e) for e in encoded]
        ids = np.repeat(ids, width)
        spots = _ranges((np.cumsum(width) - width)[fallback], width[fallback])
        ids[spots] = vocabulary.byte_id[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
    ends = np.concatenate([[0], np.cumsum(width)])
    return ids, ends[np.searchsorted(kept, bounds)]


def add_pieces(docs: DataFrame, config: PieceConfig = PieceConfig(), carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but earlier results) and pieces array<int>, n_pieces, lossless.

    The row key is doc_id; ``lossless`` tells whether decoding the pieces gave the text back.
    """
    added = ("pieces", "n_pieces", "lossless")
    names = [c for c in docs.columns if c not in added] if carried is None else carried
    vocabulary = config.vocabulary or public_path("piece_bpe_32k.model")
    own = "text" in names and docs.schema["text"].dataType.simpleString() == "string"  # then the text is sent once
    text = [] if own else [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")]
    source = docs.select(*names, *text, F.xxhash64(F.col("doc_id").cast("string")).alias("__key"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name not in ("__text", "__key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pieces(vocabulary, config.sharpness)
        for batch in batches:
            for a, b in row_slices(batch.column("text" if own else "__text"), config.slice_bytes):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text" if own else "__text").to_pylist()]
                ids, offsets = sample_texts(texts, part.column("__key").to_numpy(), table_, config)
                same = [table_.decode(ids[x:y]) == t for t, x, y in zip(texts, offsets[:-1], offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], lists, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())], [*names, *added])

    return source.mapInArrow(lean(run), ", ".join([*fields, "pieces array<int>", "n_pieces long", "lossless boolean"]))


def decode_pieces(encoded: DataFrame, config: PieceConfig = PieceConfig()) -> DataFrame:
    """doc_id and text from (doc_id, pieces)."""
    vocabulary = config.vocabulary or public_path("piece_bpe_32k.model")
    source = encoded.select("doc_id", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pieces(vocabulary, config.sharpness)
        for batch in batches:
            texts = [table_.decode(np.array(p or [], dtype=np.int64)) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_pieces(table(spark, sf_dir, "documents"), carried=["doc_id"])

"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's special strings (one token each) and then into pre-tokens. A pre-token's bytes form a linked
list; a heap holds the adjacent pairs by merge rank, the lowest-ranked (leftmost on ties) is merged repeatedly, and the count
is the number of initial symbols minus the number of merges. No identifiers are produced. Counts of pre-tokens are kept in a
per-process dictionary of at most ``cache_entries`` entries, so memory is bounded and frequent pre-tokens are merged once.
Characters that the tokenizers library and this module's patterns put in different classes (they follow different editions of Unicode)
are found once per process; texts with one of them are cut by the library's own pre-tokenizer.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, with_text
from .vocabularies import public_path

# Fixed value: the published pre-token pattern of byte-level BPE vocabularies.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class TokenCountConfig:
    vocabulary: str | None = None
    limit: int = 1024
    cache_entries: int = 400_000


def byte_characters() -> list[str]:
    """Byte-level vocabularies write byte b as this character: itself if printable Latin-1, else the next one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    kept = set(shown)
    return [chr(b) if b in kept else chr(next(hidden)) for b in range(256)]


def disputed_characters(pre_tokenize: Callable[[str], list]) -> str:
    """The characters that are letters or digits for one of the two, this module's patterns and ``pre_tokenize``, alone."""
    everything = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Co"))
    ours = regex.findall(r"[\p{L}\p{N}]", everything)
    signs = [c for c in regex.findall(r"[^\s\p{L}\p{N}]", everything) if unicodedata.category(c) != "Cn"]
    # Beside a sign a sign is no token of its own, and beside a letter (or digit) a letter (or digit) is none.
    found = []
    for beside, characters in (("!", ours), ("a", signs), ("1", signs)):
        cut = pre_tokenize("\n".join(beside + c for c in characters))
        together = {a for _, (a, b) in cut if b - a == 2}
        found += [c for k, c in enumerate(characters) if 3 * k in together]
    return "".join(found)


class PairMerger:
    """Counts the tokens of pre-tokens; ``counts`` is the bounded memory of earlier ones."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str], cache_entries: int, pre_tokenize: Callable[[str], list] | None = None):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.symbols = byte_characters()
        self.cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.find_all = regex.compile(PRE_TOKENS).findall
        self.pre_tokenize = pre_tokenize
        disputed = disputed_characters(pre_tokenize) if pre_tokenize else ""
        # A class of thousands of characters is looked through for each character of a text; most texts have none from the least on.
        self.disputed = frozenset(disputed)
        self.suspect = regex.compile(f"[{min(disputed)}-\U0010ffff]").search if disputed else None
        self.cache_entries = cache_entries
        self.counts = _Counts(self)

    def merged_length(self, data: bytes) -> int:
        """Symbols left of ``data`` after all merges."""
        n = len(data)
        if n < 2:
            return n
        rank = self.rank
        symbol: list[str | None] = [self.symbols[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank.get((symbol[k], symbol[k + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, k = heapq.heappop(heap)
            nxt = after[k]
            if symbol[k] is None or nxt >= n or rank.get((symbol[k], symbol[nxt])) != r:
                continue  # one of the two has been merged meanwhile
            symbol[k] += symbol[nxt]
            symbol[nxt] = None
            after[k] = after[nxt]
            left -= 1
            if after[k] < n:
                before[after[k]] = k
                if (r := rank.get((symbol[k], symbol[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank.get((symbol[before[k]], symbol[k]))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return left

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.disputed and not text.isascii() and self.suspect(text) and not self.disputed.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenize(text)]
        return self.find_all(text)

    def count(self, text: str) -> int:
        if self.cut is None or not self.cut.search(text):
            return sum(map(self.counts.__getitem__, self.find(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.find(p))) for p in parts)


class _Counts(dict):
    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger = merger

    def __missing__(self, token: str) -> int:
        if len(self) >= self.merger.cache_entries:
            self.clear()
        n = self.merger.merged_length(token.encode())
        if len(token) <= 64:
            self[token] = n
        return n


@lru_cache(maxsize=2)
def merger(vocabulary: str, cache_entries: int) -> PairMerger:
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    pre_tokenize = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    return PairMerger(pairs, [t["content"] for t in spec["added_tokens"]], cache_entries, pre_tokenize)


def token_counts(docs: DataFrame, config: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per input row."""
    vocabulary, entries = config.vocabulary or public_path("byte_bpe_50k.json"), config.cache_entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(vocabulary, entries).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = with_text(docs, "doc_id").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    found = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > config.limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

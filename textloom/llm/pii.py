"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs, URL schemes and identifier cues. Each anchor
starts a deterministic local parser that expands to the boundaries of one candidate and validates it. The work is linear in
the text, no backtracking search runs over it.

Kinds, in report order: ``email``, ``ip``, ``card``, ``phone`` (the base kinds, each leftmost and non-overlapping within its
kind; a candidate that fails its validation is dropped and its characters are not tried again), then the added kinds ``url``
(credentials in front of a host), ``account`` (a cued account number or IBAN) and ``secret`` (a cued key or token value).
Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans (the digest of an empty list). Repeated rows are reported each. Other
columns are ignored by ``find_pii`` and kept by ``mask_pii``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, with_text
from .textarrays import lean, row_slices, SLICE_BYTES

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
Span = tuple[int, int]

# Cue words in front of identifiers.
ACCOUNT_CUES = ("account", "acct", "iban")
SECRET_CUES = ("api_key", "apikey", "password", "passwd", "secret", "token")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_grouped_digits = re.compile(r"[0-9](?:[ -]?[0-9])*").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_dial = re.compile(r"[ ().0-9-]*").match
_credentials = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?").match
_account = re.compile(r"(?:\s{0,2}(?:no\.?|number|#))?\s{0,2}[:=#]?\s{0,2}([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){7,32})").match
_secret = re.compile(r"\"?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_/+=.-]{16,})").match


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *[(d, "digit") for d in "0123456789"]]:
        found.add_word(sign, kind)
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, kind)
    found.make_automaton()
    return found


_anchors = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def expand_email(text: str, at: int, floor: int) -> Span | None:
    """Address around the at-sign at ``at``; the local part may not reach back beyond ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _domain(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def expand_ips(text: str, start: int) -> tuple[list[Span], int]:
    """Addresses in the dotted run of numbers at ``start``, four numbers each, and the run's end."""
    run = _dotted(text, start)
    parts = run[0].split(".")
    spans, at = [], start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in four):
            spans.append((at, end))
        at = end + 1
    return spans, run.end()


def expand_card(text: str, start: int) -> tuple[Span | None, int]:
    """A card number that fills the run of (singly separated) digits at ``start``, and the run's end."""
    run = _grouped_digits(text, start)
    digits = run[0].replace(" ", "").replace("-", "")
    return (run.span() if 16 <= len(digits) <= 19 and luhn(digits) else None), run.end()


def expand_phone(text: str, plus: int) -> tuple[Span | None, int]:
    """A number after the plus sign, and where the search for further ones goes on."""
    if not ("0" <= text[plus + 1 : plus + 2] <= "9"):
        return None, plus + 1
    end = _dial(text, plus + 2).end()
    while end > plus + 3 and not ("0" <= text[end - 1] <= "9"):
        end -= 1
    if end <= plus + 3:
        return None, plus + 1
    return ((plus, end) if 8 <= sum("0" <= c <= "9" for c in text[plus:end]) <= 15 else None), end


def find_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in order of their starts."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for at, anchor in _anchors.iter(text):
        if anchor == "digit":
            if at >= past["card"]:
                one, past["card"] = expand_card(text, at)
                if one:
                    spans["card"].append(one)
            if at >= past["ip"]:
                some, past["ip"] = expand_ips(text, at)
                spans["ip"] += some
        elif anchor == "at":
            if at >= past["email"] and (one := expand_email(text, at, past["email"])):
                spans["email"].append(one)
                past["email"] = one[1]
        elif anchor == "plus":
            if at >= past["phone"]:
                one, past["phone"] = expand_phone(text, at)
                if one:
                    spans["phone"].append(one)
        elif anchor == "scheme":
            if at >= past["url"] and (m := _credentials(text, at + 1)):
                spans["url"].append(m.span())
                past["url"] = m.end()
        else:
            m = (_account if anchor == "account" else _secret)(text, at + 1)
            if m and m.start(1) >= past[anchor] and any(c.isdigit() for c in m[1]):
                spans[anchor].append(m.span(1))
                past[anchor] = m.end(1)
    return spans


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def masked(text: str, spans: dict[str, list[Span]] | None = None) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first (then longest) names the mask."""
    spans = find_spans(text) if spans is None else spans
    found = sorted((s, -e, k) for k, many in spans.items() for s, e in many)
    if not found:
        return text
    out, at = [], 0
    for start, minus_end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -minus_end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                found = find_spans(text)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(len(found[kind]))
                digests.append(hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest())
                spans.append(listed(found))
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    source = with_text(docs, "doc_id")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` masked; the other columns are untouched, a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for a, b in row_slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = [None if t is None else masked(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.withColumn(column, F.col(column).cast("string")).mapInArrow(lean(run), docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))

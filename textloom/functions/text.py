"""Text kernels: pure Column -> Column functions with Unicode-aware word and white-space classes.

Java's ``\\w`` and ``\\s`` are ASCII. WORD and SPACE agree with the Unicode classes of common scripting languages, and both Spark
and DuckDB accept them. A null text counts as empty unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NEITHER = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"
EDGE_SPACE = rf"^{SPACE}+|{SPACE}+$"
# ASCII punctuation removed before answers are compared, and the articles dropped.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
ARTICLES = ("a", "an", "the")
SNIPPET_GAP = rf"{SPACE}*(?:\.{{3,}}|…){SPACE}*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def words(c: Column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def clean_text(c: Column) -> Column:
    """White space collapsed and stripped, case kept."""
    return strip(collapse(F.coalesce(c, F.lit(""))))


def clean_for_exploration(c: Column) -> Column:
    """Lower case, white space collapsed, then everything but ASCII letters, digits and spaces deleted (gaps may stay double)."""
    return strip(F.regexp_replace(collapse(F.lower(F.coalesce(c, F.lit("")))), "[^a-zA-Z0-9 ]", ""))


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit("")))).cast("long")


def shortened(c: Column, limit: int) -> Column:
    """Collapsed text; beyond ``limit`` characters its start and " ..."."""
    flat = clean_text(c)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(" ..."))).otherwise(flat)


def for_duplicates(c: Column) -> Column:
    """Lower case, white space collapsed, then punctuation deleted, then stripped (in this order)."""
    return strip(F.regexp_replace(collapse(F.lower(F.coalesce(c, F.lit("")))), NEITHER, ""))


def duplicate_key(question: Column, answer: Column, answer_chars: int = 120) -> Column:
    return F.struct(for_duplicates(question).alias("question"), F.substring(for_duplicates(answer), 1, answer_chars).alias("answer"))


def for_evidence(c: Column) -> Column:
    """Typographic quotes to plain ones, white space collapsed, stripped, lower case."""
    return F.lower(strip(collapse(F.translate(F.coalesce(c, F.lit("")), "“”‘’", "\"\"''"))))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, '^"+|"+$', "")


def snippet_segments(snippet: Column, min_chars: int = 6) -> Column:
    """Parts of a normalised snippet between ellipses, without those shorter than ``min_chars``."""
    parts = F.transform(F.split(snippet, SNIPPET_GAP), lambda p: unquoted(for_evidence(p)))
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def retrieval_tokens(c: Column) -> Column:
    """Lower case; punctuation separates."""
    return words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NEITHER, " "))


def contains_any(c: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the lower-case text contains a keyword as a substring."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def answer_tokens(c: Column) -> Column:
    """Lower-case words without ASCII punctuation and without articles. An article also ends at a sign that is no letter or digit
    (a typographic quote, a dash), which stays; so the words are cut once more."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return words(F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ARTICLES)})(?![\p{{L}}\p{{N}}])", " "))


def answer_text(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (answer_text(prediction) == answer_text(gold)).cast("double")


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    def least(token: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda x: x == token)), F.size(F.filter(b, lambda x: x == token)))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + least(t))


def token_f1(prediction: Column, gold: Column, empty_equal: bool = False) -> Column:
    """Token F1; with ``empty_equal`` an empty side scores whether both are empty, else always 0."""
    p, g = answer_tokens(prediction), answer_tokens(gold)
    same = shared_tokens(p, g).cast("double")
    precision, recall = F.try_divide(same, F.size(p)), F.try_divide(same, F.size(g))
    score = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    if not empty_equal:
        return score
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(score)


def parsed_grade(c: Column, marker: str = "[RESULT]") -> Column:
    """The first number after the last marker if it is an integer 1..5, else null. A dot before a number is no part of it."""
    tail = F.when(F.contains(c, F.lit(marker)), F.substring_index(c, marker, -1))
    number = F.regexp_extract(tail, r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(number.rlike(r"^\+?0*[1-5]$"), F.right(number, F.lit(1)).cast("int"))


def first_third(c: Column) -> Column:
    """The first max(1, n // 3) words."""
    w = words(F.coalesce(c, F.lit("")))
    return F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) / 3).cast("int"))), " ")


def joined_key(*columns: Column) -> Column:
    return F.concat_ws("|", *columns)

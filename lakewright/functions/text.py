"""Text expressions shared by retrieval, verification and the rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = "[a-z0-9_-]+"

# Patterns of numbers, citations, list markers and sentence ends.
NUMBER = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"
CITATION = r"\[[^\[\]]*?\bp\.\s?\d+[^\[\]]*?\]"
LIST_MARKER = r"(?m)^\s*[-*]?\s*\d+[.)]\s"
SENTENCE_END = r"(?<=[.!?;:])\s+|\n"

# Words that carry no content of their own.
STOPWORDS = (
    "the", "this", "that", "what", "which", "does", "should", "have", "with", "many",
    "about", "into", "from", "were", "will", "would", "could", "when", "where",
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, underscores and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def content_words(text: Column) -> Column:
    """Distinct words of three or more characters that are not stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    long = F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3)
    return F.array_except(long, F.array(*(F.lit(w) for w in STOPWORDS)))


def normalised(text: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def stripped_claims(text: Column) -> Column:
    """Text without citations such as [Guide, p.3] and list markers."""
    text = F.regexp_replace(text, CITATION, "")
    return F.regexp_replace(text, LIST_MARKER, "\n")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def number_value(token: Column) -> Column:
    return F.regexp_replace(token, r"[,$%+]", "").try_cast("double")


def decimals(token: Column) -> Column:
    return F.length(F.regexp_extract(token, r"\.(\d+)", 1))


def format_cell(x: Column) -> Column:
    """Numbers with two places and no trailing zeros, NULL as ''."""
    short = F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")
    return F.when(x.isNull(), "").when(F.abs(x) < 1e12, short).otherwise(x.cast("string"))


def sentences(text: Column) -> Column:
    """Pieces that end after . ! ? ; : and white space, or at a line end."""
    cut = F.split(text, SENTENCE_END)
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text, in any case."""
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(text), w))

"""Checks on written text: numbers, leaked passages, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import decimals, normalised, number_tokens, number_value, stripped_claims

WINDOW, STEP = 60, 30
LONG, GRAM = 29, 16  # a piece without an inner word has one blank at most


def claims(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, token, value, places, is_pct): the numbers that a text states."""
    found = texts.select(id_col, F.posexplode(number_tokens(stripped_claims(F.col(text_col)))).alias("pos", "token"))
    return found.select(id_col, "pos", "token", number_value(F.col("token")).alias("value"), decimals(F.col("token")).alias("places"), F.col("token").endswith("%").alias("is_pct"))


def sources(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(value): the distinct numbers that texts hold."""
    found = texts.select(F.explode(number_tokens(F.col(text_col))).alias("token"))
    return found.select(number_value(F.col("token")).alias("value")).where("value is not null").distinct()


def offenders(stated: DataFrame, allowed: DataFrame, id_col: str) -> DataFrame:
    """(id, token, pos): stated numbers that no allowed value accounts for, each
    once, at its first place. A value accounts for a token if it equals it when
    rounded to the token's places; for a percentage also a value a hundred
    times smaller, to two places more.

    The match is an equality of rounded values, so that it is a hash join."""
    scaled = lambda value, p: F.round(value * F.pow(F.lit(10.0), p), 0)
    tokens = stated.where("value is not null").withColumn("p", F.col("places"))
    ways = F.when(F.col("is_pct"), F.array(F.struct(F.col("p"), F.col("value").alias("v")), F.struct((F.col("p") + 2).alias("p"), (F.col("value") / 100).alias("v"))))
    tokens = tokens.withColumn("way", F.explode(F.coalesce(ways, F.array(F.struct(F.col("p"), F.col("value").alias("v"))))))
    tokens = tokens.select(id_col, "pos", "token", F.col("way.p").alias("p"), scaled(F.col("way.v"), F.col("way.p")).alias("v"))
    keys = allowed.select("value").crossJoin(F.broadcast(tokens.select("p").distinct())).select("p", scaled(F.col("value"), F.col("p")).alias("v")).distinct()
    good = tokens.join(keys, ["p", "v"], "left_semi").select(id_col, "token").distinct()
    bad = tokens.join(good, [id_col, "token"], "left_anti")
    return bad.groupBy(id_col, "token").agg(F.min("pos").alias("pos"))


def windows(templates: DataFrame, id_col: str) -> DataFrame:
    """(id, piece): overlapping pieces of the normalised templates."""
    text = normalised(F.col("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("t") - WINDOW + 1, F.lit(1)), F.lit(STEP))
    cut = templates.select(id_col, text.alias("t")).where(F.length("t") >= WINDOW).select(id_col, F.explode(F.transform(starts, lambda i: F.substring("t", i, WINDOW))).alias("piece"))
    return cut.distinct()


def leaks(texts: DataFrame, templates: DataFrame, id_col: str = "doc_id", template_col: str = "item_id") -> DataFrame:
    """(id, template id): texts that hold a piece of a template verbatim, after
    normalisation. A piece is looked up by its longest inner word; one without
    an inner word has a part of at least ``LONG`` characters, and is looked up
    by the first ``GRAM`` of its longest part among the grams of long words. Only
    (id, key) pairs meet the pieces, and only texts that share a key are read
    again to confirm it."""
    pieces = windows(templates, template_col)
    parts = F.split("piece", " ")
    longest = lambda words: F.aggregate(words, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    inner = longest(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    pieces = pieces.withColumn("key", F.when(inner != "", inner).otherwise(F.concat(F.lit(" "), F.substring(longest(parts), 1, GRAM))))
    clean = texts.select(id_col, normalised(F.col("text")).alias("t"))
    words = F.array_distinct(F.split("t", " "))
    starts = lambda w: F.sequence(F.lit(1), F.length(w) - GRAM + 1)
    grams = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= LONG), lambda w: F.transform(starts(w), lambda i: F.concat(F.lit(" "), w.substr(i, F.lit(GRAM))))))
    keys = clean.select(id_col, F.explode(F.concat(words, F.array_distinct(grams))).alias("key"))
    maybe = keys.join(pieces, "key").select(id_col, template_col, "piece").distinct()
    held = maybe.groupBy(id_col).agg(F.collect_list(F.struct(template_col, "piece")).alias("pieces"))
    found = clean.join(held, id_col).select(id_col, F.explode(F.filter("pieces", lambda p: F.contains(F.col("t"), p["piece"]))).alias("p"))
    return found.select(id_col, f"p.{template_col}").distinct()


def redact(text: Column, piece: Column) -> Column:
    """Text without the lines that hold the leaked piece."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(normalised(line), piece)), "\n")


# Fixed value: identifier formats, and phrases that ask for personal data.
PII = (
    r"(?i)\b\d{3}-\d{2}-\d{4}\b|\b(?:\d[ -]?){13,16}\b|"
    r"\b(email\s*(address|id)|(phone|mobile|cell)\s*(no\.?|number|#)|home (address|phone)|mailing address|contact (number|info|details)|"
    r"personal (email|phone|contact|address|information|details)|social security( number)?|\bssn\b|passport(\s+number)?|"
    r"driver'?s licen[sc]e|credit card( number)?|bank account( number)?|routing number|date of birth|\bdob\b)\b"
)


def asks_pii(text: Column) -> Column:
    return text.rlike(PII)

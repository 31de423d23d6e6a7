"""Routing, slot, follow-up and merge rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import any_of, content_words
from .verification import asks_pii

# Words and patterns of the rules.
WRITE_INTENT = (
    r"(?i)\b(delete|drop|truncate|update|insert|upsert|alter|overwrite|wipe|purge|"
    r"remove\s+(the\s+)?(row|record|table|data)|set\s+\w+\s*=|grant|revoke)\b"
)
EXPLICIT_TIME = (
    r"(?i)(20\d{2})|(q[1-4])|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*20\d{2}|"
    r"(last|past|previous|trailing)\s+\d+\s*(day|week|month|quarter|year)|(h1|h2|first half|second half)|"
    r"\d{4}-\d{2}(-\d{2})?|(since|between|from)\s+\w+"
)
VAGUE_TIME = ("recently", "lately", "these days", "nowadays", "currently", "at the moment", "right now", "of late", "so far", "trending")
VAGUE_SUPERLATIVE = r"(?i)\b(top|best|worst|biggest|how's|hows|looking)\b"
CONNECTORS = ("and ", "what about", "same for", "same but", "also", "how about", "what if", "compared to")
REFERENCES = ("it", "that", "those", "this")
STAGE_NAMES = (
    "prospecting", "discovery", "evaluation", "proposal", "negotiation",
    "closed won", "closed lost", "qualify", "discover", "solution fit",
    "commercial align", "commit", "handoff",
)
PRODUCT_NAMES = (
    "product xyz", "opportunity tracker", "xyz-core", "xyz-analytics",
    "xyz-automation", "xyz-security",
)
UNFILLED = ("", "none", "null", "unknown", "unspecified", "n/a")
MIN_CONFIDENCE = 0.6
SHORT_QUESTION = 8
TIME_RANGE, POPULATION = "time_range", "segment_or_region"
QUESTIONS = {TIME_RANGE: "Which period?", POPULATION: "Which region or segment?"}


def is_filled(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(*UNFILLED), F.lit(False))


def has_time(question: Column) -> Column:
    return question.rlike(EXPLICIT_TIME)


def has_population(question: Column, names: tuple[str, ...]) -> Column:
    """A region or segment is named, as a word (not inside another)."""
    return question.rlike(r"(?i)\b(" + "|".join(names) + r")\b")


def is_vague(question: Column, route: Column) -> Column:
    return any_of(question, VAGUE_TIME) | (route.isin("SQL", "HYBRID") & question.rlike(VAGUE_SUPERLATIVE))


def missing_slots(question: Column, route: Column, time_slot: Column, population_slot: Column, names: tuple[str, ...]) -> Column:
    """Required slots that neither the slots nor the question fill."""
    needs = route.isin("SQL", "HYBRID")
    time = F.when(needs & ~is_filled(time_slot) & ~has_time(question), TIME_RANGE)
    population = F.when(needs & ~is_filled(population_slot) & ~has_population(question, names), POPULATION)
    return F.array_compact(F.array(time, population))


def decide(question: Column, route: Column, confidence: Column, sql_part: Column, time_slot: Column, population_slot: Column, names: tuple[str, ...], allowed: Column | None = None) -> Column:
    """struct(final_route, rule_id): the first rule that fires, else the
    proposal. Confidence is clamped to 0..1; on a quantitative route a population
    that does not exist counts as missing."""
    verdict = lambda r, rule: F.struct(F.lit(r).alias("final_route"), F.lit(rule).alias("rule_id"))
    proposed = F.upper(F.coalesce(route, F.lit("ASK")))
    effective = F.when((proposed == "HYBRID") & ~is_filled(sql_part), "RAG").otherwise(proposed)
    sure = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    quantitative = effective.isin("SQL", "HYBRID")
    population_slot = F.when(~quantitative, population_slot).otherwise(valid_population(population_slot, names))
    outside = F.lit(False) if allowed is None else quantitative & is_filled(population_slot) & (F.lower(F.trim(population_slot)) != "all") & ~F.array_contains(allowed, population_slot)
    return F.coalesce(
        F.when(asks_pii(question), verdict("REFUSE", "pii")),
        F.when(question.rlike(WRITE_INTENT), verdict("REFUSE", "write")),
        F.when(proposed == "OFF_TOPIC", verdict("REFUSE", "off_topic")),
        F.when(effective != proposed, verdict("RAG", "no_sql_half")),
        F.when(F.size(missing_slots(question, effective, time_slot, population_slot, names)) > 0, verdict("ASK", "missing_slot")),
        F.when(outside, verdict("REFUSE", "out_of_scope")),
        F.when(is_vague(question, effective) & ~has_time(question) & ~is_filled(time_slot), verdict("ASK", "vague_time")),
        F.when(sure < MIN_CONFIDENCE, verdict("ASK", "low_confidence")),
        F.struct(effective.alias("final_route"), F.lit(None).cast("string").alias("rule_id")),
    )


def narrowed_population(population_slot: Column, allowed: Column | None = None) -> Column:
    """The values that a population stands for: 'all' is what the user may see
    (null where nothing limits it), a value itself, nothing if unfilled."""
    whole = F.lit(None).cast("array<string>") if allowed is None else F.array_sort(allowed)
    return F.when(is_filled(population_slot), F.when(F.lower(F.trim(population_slot)) == "all", whole).otherwise(F.array(population_slot)))


def clarification(missing: Column, most: int = 3) -> Column:
    """The questions for missing slots, or a general one."""
    asked = F.filter(F.transform(F.slice(missing, 1, most), lambda m: F.create_map(*(F.lit(x) for kv in QUESTIONS.items() for x in kv))[m]), lambda q: q.isNotNull())
    return F.when(F.size(asked) > 0, F.array_join(asked, " ")).otherwise("Could you say more precisely what you need?")


def is_followup(question: Column, names: tuple[str, ...]) -> Column:
    """A connector at the start, a word that refers back, or a short question
    that names nothing."""
    q = F.regexp_replace(F.lower(F.trim(question)), r"\?+$", "")
    starts = F.exists(F.array(*(F.lit(c) for c in CONNECTORS)), lambda c: F.startswith(q, c))
    refers = F.arrays_overlap(F.regexp_extract_all(q, F.lit("[a-z0-9]+"), 0), F.array(*(F.lit(w) for w in REFERENCES)))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    concrete = has_time(question) | has_population(question, names) | any_of(question, STAGE_NAMES + PRODUCT_NAMES)
    return starts | refers | ((words <= SHORT_QUESTION) & ~concrete)


def strip_connector(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(question), r"(?i)^(" + "|".join(c.strip() + (r"\s" if c.endswith(" ") else "") for c in CONNECTORS) + ")", ""))


def substitute_stage(question: Column, old: Column, new: Column) -> Column:
    """``old`` replaced by ``new``, together with a number before it such as
    'Stage 2 - ' that belongs to the old one."""
    pattern = F.concat(F.lit(r"(?i)(stage\s*\d+\s*[-:—]\s*)?\Q"), old, F.lit(r"\E"))
    return F.regexp_replace(question, pattern, F.concat(F.lit(""), new))


def named_stage(text: Column, stages: tuple[str, ...] = STAGE_NAMES) -> Column:
    """The first of the known stages that a text names, in their order."""
    return F.get(F.filter(F.array(*(F.lit(x) for x in stages)), lambda x: F.contains(F.lower(text), x)), F.lit(0))


def _beyond(text: Column, stage: Column) -> Column:
    """Content words of a text besides its connector and a stage's name."""
    return F.array_except(content_words(strip_connector(text)), F.split(stage, " "))


def bare_stage_reply(recent: Column, reply: Column, stages: tuple[str, ...] = STAGE_NAMES) -> Column:
    """The question that a reply stands for which says nothing but another stage:
    the latest of the ``recent`` questions (oldest first) that names a different
    stage and more than that, with its stage replaced. Null for other replies."""
    new = named_stage(reply, stages)
    fits = lambda q: (named_stage(q, stages) != new) & (F.size(_beyond(q, named_stage(q, stages))) > 0)
    last = F.get(F.reverse(F.filter(recent, fits)), F.lit(0))
    as_typed = F.substr(reply, F.position(new, F.lower(reply)), F.length(new))
    return F.when(new.isNotNull() & (F.size(_beyond(reply, new)) == 0), substitute_stage(last, named_stage(last, stages), as_typed))


def keeps_stale_stage(recent: Column, reply: Column, merged: Column, stages: tuple[str, ...] = STAGE_NAMES) -> Column:
    """The reply names a stage, and the merge still holds another one that any of
    the recent questions named."""
    new = named_stage(reply, stages)
    stale = F.exists(F.transform(recent, lambda q: named_stage(q, stages)), lambda x: F.coalesce((x != new) & F.contains(F.lower(merged), x), F.lit(False)))
    return new.isNotNull() & stale


def keeps_content(source: Column, reply: Column, merged: Column) -> Column:
    """At least 60 % of the source's words survive and the reply is used."""
    kept = F.size(F.array_intersect(source, merged)) / F.greatest(F.size(source), F.lit(1))
    return ((F.size(source) == 0) | (kept >= 0.6)) & ((F.size(reply) == 0) | F.arrays_overlap(reply, merged))


def invents_nothing(source: Column, reply: Column, merged: Column) -> Column:
    return F.size(F.array_except(merged, F.array_union(source, reply))) == 0


def last_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` answered questions of each conversation: a user turn
    that is followed by an answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.where("role in ('user', 'assistant')").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    answered = paired.where("role = 'user' and next_role = 'assistant'")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return answered.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).select("conv_id", "turn", "back", F.col("text").alias("question"), "answer")


def overlap_with_previous(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_words, n_shared): content words of a user turn and how
    many the user turn before it had too."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = turns.where("role = 'user'").select("conv_id", "turn", content_words(F.col("text")).alias("w"))
    before = F.coalesce(F.lag("w").over(w), F.array().cast("array<string>"))
    return words.select("conv_id", "turn", F.size("w").alias("n_words"), F.size(F.array_intersect("w", before)).alias("n_shared"))


def keeps_stale_entity(reply: Column, merged: Column, entities: tuple[str, ...]) -> Column:
    """The reply names an entity, and the merge still holds another one."""
    names = F.array(*(F.lit(e) for e in entities))
    new = F.filter(names, lambda e: F.contains(F.lower(reply), e))
    old = F.filter(F.array_except(names, new), lambda e: F.contains(F.lower(merged), e))
    return (F.size(new) > 0) & (F.size(old) > 0)


def new_topic(flag: Column, pending: Column, reply: Column, merged: Column) -> Column:
    """A claimed change of topic holds only if the merged words do not carry
    the pending question on."""
    carried = F.size(F.array_except(F.array_intersect(pending, merged), reply)) > 0
    return flag & ~carried


def normalised_slots(slots: Column) -> Column:
    """A proposal's slots without those that say nothing."""
    return F.map_filter(slots, lambda name, value: is_filled(value))


def valid_population(value: Column, names: tuple[str, ...]) -> Column:
    """A region or segment that exists, or 'all'; anything else is cleared."""
    return F.when(F.lower(F.trim(value)).isin("all", *names), value)


def effective_question(pending: Column, reply: Column, merged: Column, merge_ok: Column, followup: Column) -> Column:
    """What is asked after a reply. A pending clarification comes before the
    history; a merge that fails its guards falls back to both texts in a row
    for a clarification, and to the reply alone for a follow-up."""
    clarified = F.when(merge_ok, merged).otherwise(F.concat_ws(" ", pending, reply))
    return F.when(pending.isNotNull(), clarified).when(followup & merge_ok, merged).otherwise(reply)

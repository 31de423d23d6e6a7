"""What each turn of a conversation asks for, after the turns before it.

A turn's effective question depends on those of earlier turns, so this is a
fold along each conversation: rows are dealt out and sorted by conversation and
turn, and a task reads on through them with a state of fixed size, the pending
question if the last turn had to be asked back, and the last two that were
answered. Nothing else is kept, however long a conversation is.

The rules of one step are those of ``rules``, for one turn at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import STOPWORDS
from .rules import CONNECTORS, STAGE_NAMES

RECENT = 2
SCHEMA = "effective string, how string, keeps_stale boolean, pending boolean"


@dataclass(frozen=True)
class Words:
    """The words that the steps look for, sent along with them."""

    stages: tuple[str, ...] = STAGE_NAMES
    connectors: tuple[str, ...] = CONNECTORS
    stopwords: tuple[str, ...] = STOPWORDS


def folder(words: Words = Words(), most: int = RECENT) -> Callable:
    """step(pending, recent, reply, answerable) -> (effective, how, keeps_stale,
    pending, recent). ``answerable`` says of a text whether it can be answered."""
    stop = frozenset(words.stopwords)
    lead = re.compile("(?i)^(" + "|".join(re.escape(c.strip()) + (r"\s" if c.endswith(" ") else "") for c in words.connectors) + ")")

    def stage(text: str) -> str | None:
        return next((s for s in words.stages if s in text.lower()), None)

    def beyond(text: str, name: str) -> set[str]:
        bare = lead.sub("", text.strip()).strip().lower()
        return {w for w in re.findall("[a-z0-9]+", bare) if len(w) >= 3 and w not in stop} - set(name.split(" "))

    def substituted(recent: list[str], reply: str) -> str | None:
        new = stage(reply)
        if new is None or beyond(reply, new):
            return None
        at = reply.lower().index(new)
        for question in reversed(recent):
            old = stage(question)
            if old and old != new and beyond(question, old):
                return re.sub(rf"(?i)(stage\s*\d+\s*[-:—]\s*)?{re.escape(old)}", lambda m: reply[at : at + len(new)], question)
        return None

    def step(pending: str | None, recent: list[str], reply: str, answerable: Callable[[str], bool]) -> tuple:
        how, effective, stale = "new", reply, False
        if pending is not None:  # the history has no say here
            how, effective = "clarified", f"{pending} {reply}"
        elif recent:
            other = substituted(recent, reply)
            how, effective = ("substituted", other) if other is not None else (how, effective)
            new = stage(reply)
            stale = new is not None and any(x and x != new and x in effective.lower() for x in map(stage, recent))
        if answerable(effective):
            return effective, how, stale, None, [*recent, effective][-most:]
        return effective, how, stale, effective, recent

    return step


def folded(turns: DataFrame, answerable: str, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", words: Words = Words()) -> DataFrame:
    """(id, turn, effective, how, keeps_stale, pending) for the users' turns.
    ``answerable`` is a pattern that a question must match to be answered; one
    that doesn't is asked back, and the next turn clarifies it.

    A null text is an empty one; null turns come first; rows that repeat a turn
    follow one another by their texts."""
    step, pattern = folder(words), answerable
    kinds = [turns.schema[c].dataType.simpleString() for c in (id_col, turn_col)]
    rows = turns.select(F.col(id_col).alias("i"), F.col(turn_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    rows = rows.repartition("i").sortWithinPartitions("i", F.col("t").asc_nulls_first(), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = re.compile(pattern).search
        now, pending, recent, begun = None, None, [], False
        for batch in batches:
            out = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or i != now:
                    now, pending, recent, begun = i, None, [], True
                effective, how, stale, pending, recent = step(pending, recent, x, lambda q: bool(fits(q)))
                out.append((effective, how, stale, pending is not None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, turn_col, "effective", "how", "keeps_stale", "pending"])

    return rows.mapInArrow(run, f"{id_col} {kinds[0]}, {turn_col} {kinds[1]}, {SCHEMA}")

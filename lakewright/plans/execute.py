"""Running a checked query: errors as values, row cap, deadline, rendering."""

from __future__ import annotations

import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import StageLog

MAX_ROWS = 200
NARRATE_ROWS = 20

# Words that ask for more than a table.
NARRATION_MARKERS = (
    "why", "what's driving", "whats driving", "what is driving", "explain",
    "reason", "cause", "root cause", "insight", "interpret", "so what",
    "summarize", "summarise", "trend", "story",
)


@dataclass
class Result:
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    error: str | None = None
    truncated: bool = False

    def flat_values(self) -> list:
        return [cell for row in self.rows for cell in row]

    def to_markdown(self, cap: int = MAX_ROWS) -> str:
        if not self.columns:
            return ""
        lines = [f"| {' | '.join(self.columns)} |", f"|{'---|' * len(self.columns)}"]
        lines += [f"| {' | '.join(format_value(v) for v in row)} |" for row in self.rows[:cap]]
        if len(self.rows) > cap or self.truncated:
            lines.append(f"showing {min(cap, len(self.rows))} of {len(self.rows)}{'+' if self.truncated else ''} rows")
        return "\n".join(lines)


def format_value(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, float) and abs(x) < 1e12:
        return re.sub(r"\.?0+$", "", f"{x:.2f}")
    return str(x)


def shown(df: DataFrame, denied: tuple[str, ...]) -> DataFrame:
    """``df`` without the denied columns, in any case of their names."""
    gone = {c.lower() for c in denied}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def run(df: DataFrame, max_rows: int = MAX_ROWS, timeout_s: float | None = 5.0, denied: tuple[str, ...] = (), log: StageLog | None = None) -> Result:
    """Collect at most ``max_rows`` rows. Denied columns are dropped before
    anything is computed; a late query is cancelled by its tag and the caller
    is released at once. ``log`` learns how long it took and how it ended."""
    df = shown(df, denied)
    began = time.perf_counter()

    def ended(outcome: str, result: Result) -> Result:
        if log:
            log.timer.ms["execute"], log.outcomes["execute"] = (time.perf_counter() - began) * 1000, outcome
        return result

    sc, tag = df.sparkSession.sparkContext, f"run-{uuid.uuid4().hex}"

    def work() -> list:
        sc.addJobTag(tag)  # of this thread's jobs only
        sc.setInterruptOnCancel(True)
        try:
            return df.limit(max_rows + 1).collect()
        finally:
            sc.removeJobTag(tag)

    pool = ThreadPoolExecutor(1)
    try:
        rows = pool.submit(work).result(timeout_s)
    except Late:
        sc.cancelJobsWithTag(tag)
        return ended("late", Result(error=f"the query took longer than {timeout_s:g} s"))
    except PySparkException as e:
        return ended("error", Result(error=f"{e.getCondition() or type(e).__name__}: {str(e).splitlines()[0][:300]}"))
    finally:
        pool.shutdown(wait=False)
    return ended("ok", Result(df.columns, [list(r) for r in rows[:max_rows]], truncated=len(rows) > max_rows))


def capped(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The first ``max_rows`` rows with a flag whether there are more; one pass
    that reads at most one row beyond the cap."""
    probe = df.limit(max_rows + 1).withColumn("_n", F.monotonically_increasing_id())
    more = probe.agg((F.count("*") > max_rows).alias("truncated"))
    return probe.orderBy("_n").limit(max_rows).drop("_n").crossJoin(F.broadcast(more))  # one row


def flat_values(df: DataFrame) -> DataFrame:
    """All cells as one column of strings."""
    cells = F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns))
    return df.select(F.explode(cells).alias("value"))


def clean_sql(text: Column) -> Column:
    """Model output without code fences, a leading label and a trailing ';'."""
    text = F.regexp_replace(text, r"(?is)^\s*```[a-z]*\s*|\s*```\s*$", "")
    text = F.regexp_replace(text, r"(?i)^\s*sql(query)?\s*:\s*", "")
    return F.regexp_replace(text, r"\s*;?\s*$", "")


def needs_narration(n_rows: Column, question: Column, markers: tuple[str, ...] = NARRATION_MARKERS) -> Column:
    """Many rows, or a question that asks for more than a table."""
    asks = F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.lower(question), m))
    return (n_rows > NARRATE_ROWS) | asks


def slot_block(slots: dict[str, object]) -> list[str]:
    """Known slots as instructions; lists become 'one of', and stages always
    mean the stages of the data."""
    lines = [f"{k}: one of {', '.join(map(str, v))}" if isinstance(v, (list, tuple, set)) else f"{k}: {v}" for k, v in slots.items() if v and k != "stage_definition"]
    return [*lines, "stage_definition: database stages"]

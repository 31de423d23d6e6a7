"""Trace log, user profiles and report output."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

TRACE_SCHEMA = "trace_id long, user long, route string, question string, timings map<string,double>, stages array<struct<name: string, ms: double>>"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session shares with its executors
    (``spark.checkpoint.dir``); a temporary folder, one for each application, in
    local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_lakewright_root", None) or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._lakewright_root = base
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_traces(traces: DataFrame, path: str) -> None:
    """One JSON object a line; appending never rewrites what is there."""
    traces.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """(username, allowed_regions, allowed_segments) from a YAML file; null
    means everything. ``users: {name: {regions: [...], segments: [...]}}``."""
    import yaml

    users = (yaml.safe_load(Path(path).read_text()) or {}).get("users") or {}
    rows = [(name, entry.get("regions"), entry.get("segments")) for name, entry in users.items()]
    return spark.createDataFrame(rows, "username string, allowed_regions array<string>, allowed_segments array<string>")


def effective_scope(users: DataFrame, regions: list[str], segments: list[str]) -> DataFrame:
    """(username, allowed): all values a user may name; an open dimension
    stands for its whole domain."""
    whole = lambda values: F.array(*(F.lit(v) for v in values))
    return users.select("username", F.array_union(F.coalesce("allowed_regions", whole(regions)), F.coalesce("allowed_segments", whole(segments))).alias("allowed"))


def build_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write ``df`` to ``path`` unless it is there already, and read it."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


class StageTimer:
    """Milliseconds of named stages; a name that is used twice is reported."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}
        self.repeated: list[str] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            if name in self.ms:
                self.repeated.append(name)
            self.ms[name] = self.ms.get(name, 0.0) + (time.perf_counter() - began) * 1000


STAGE_SCHEMA = "trace_id string, name string, rows long, ms double, outcome string"


class StageLog:
    """What Spark says of the stages of one run: the rows that passed each
    observed place of a plan, counted by Spark itself as the plan runs, and the
    time and outcome of each action."""

    def __init__(self, spark: SparkSession, trace_id: str | None = None) -> None:
        self.spark, self.trace_id = spark, trace_id or uuid.uuid4().hex
        self.timer, self.outcomes, self.seen = StageTimer(), {}, {}

    def observe(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted under ``name`` whenever it is run."""
        self.seen[name] = Observation(f"{name}-{self.trace_id}")
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"))

    @contextmanager
    def action(self, name: str) -> Iterator[None]:
        """An action, timed; its outcome is ok, or the kind of what it raised."""
        try:
            with self.timer.stage(name):
                yield
        except BaseException as e:
            self.outcomes[name] = type(e).__name__
            raise
        self.outcomes.setdefault(name, "ok")

    def records(self) -> list[tuple]:
        """(trace_id, name, rows, ms, outcome); counts only of plans that were run
        to their end, which is when Spark knows them."""
        done = all(o == "ok" for o in self.outcomes.values())
        counted = [(self.trace_id, n, o.get["rows"], None, None) for n, o in self.seen.items()] if done and self.outcomes else []
        return counted + [(self.trace_id, n, None, self.timer.ms.get(n), o) for n, o in self.outcomes.items()]

    def append(self, path: str) -> None:
        """One JSON object a line, behind what is there."""
        self.spark.createDataFrame(self.records(), STAGE_SCHEMA).coalesce(1).write.mode("append").json(path)


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGE_SCHEMA).json(path)


def report(df: DataFrame, title: str, path: str | None = None, rows: int = 200) -> str:
    """A small aggregate as a Markdown section, optionally written to a file
    next to the driver."""
    from ..plans.execute import run

    text = f"## {title}\n\n{run(df, max_rows=rows, timeout_s=None).to_markdown()}\n"
    if path:
        Path(path).write_text(text)
    return text

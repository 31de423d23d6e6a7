"""Stage metrics from Spark, and queries that take too long."""

import time

import pytest

from lakewright.plans import execute
from lakewright.sources import sinks


def test_rows_are_counted_as_the_plan_runs(spark, tmp_path):
    log = sinks.StageLog(spark, "t1")
    odd = log.observe("odd", log.observe("all", spark.range(1000)).where("id % 2 = 1"))
    with log.action("sum"):
        assert odd.agg({"id": "sum"}).first()[0] == 250_000
    path = str(tmp_path / "stages")
    log.append(path)
    other = sinks.StageLog(spark, "t2")
    with pytest.raises(ZeroDivisionError), other.action("fails"):
        1 / 0
    other.append(path)
    rows = {(r["trace_id"], r["name"]): (r["rows"], r["outcome"]) for r in sinks.read_stages(spark, path).collect()}
    assert rows == {("t1", "all"): (1000, None), ("t1", "odd"): (500, None), ("t1", "sum"): (None, "ok"), ("t2", "fails"): (None, "ZeroDivisionError")}


def test_a_late_query_is_cancelled_and_its_job_ends(spark):
    tracker = spark.sparkContext.statusTracker()
    slow = spark.range(0, 1 << 40, 1, 8).selectExpr("sum(hash(id, id * 3, cast(id as string))) AS n")
    log = sinks.StageLog(spark)
    began = time.perf_counter()
    result = execute.run(slow, timeout_s=1.0, log=log)
    assert "longer than 1 s" in result.error and time.perf_counter() - began < 10
    assert log.outcomes == {"execute": "late"} and log.records()[0][3] >= 1000
    deadline = time.perf_counter() + 30
    while tracker.getActiveJobsIds() and time.perf_counter() < deadline:
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()
    assert execute.run(spark.range(3), log=(again := sinks.StageLog(spark))).rows == [[0], [1], [2]] and again.outcomes == {"execute": "ok"}
    broken = sinks.StageLog(spark)
    assert execute.run(spark.range(1).selectExpr("id / 0"), log=broken).error.startswith("DIVIDE_BY_ZERO") and broken.outcomes == {"execute": "error"}

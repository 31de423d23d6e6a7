"""Model-driven paths with a scripted model."""

from pyspark.sql import functions as F

from lakewright.operators import chunking as C, compose as K, rules as U
from lakewright.plans.execute import Result
from lakewright.plans.guard import Guard

RESULT = Result(["region", "deals", "rate"], [["EMEA", 128, 0.42], ["NA", 1200, 0.1234]])


def guard(spark):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string").createOrReplaceTempView("things")
    return Guard(spark, {"things": ["id", "kind"]})


def test_sql_paths(spark):
    g = guard(spark)
    ok = K.answer_sql(K.ScriptedModel(["```sql\nSELECT count(*) AS n FROM things;\n```"]), g, "how many")
    assert ok.result.rows == [[2]] and not ok.repaired
    fixed = K.answer_sql(K.ScriptedModel(["SELECT idd FROM things", "SELECT id FROM things"]), g, "ids")
    assert fixed.repaired and len(fixed.result.rows) == 2
    assert "only queries" in K.answer_sql(K.ScriptedModel(["DROP TABLE things"]), g, "x").refused
    assert "only queries" in K.answer_sql(K.ScriptedModel(["SELECT idd FROM things", "DROP TABLE things"]), g, "x").refused
    assert K.answer_sql(K.ScriptedModel(["SELECT a FROM things", "SELECT b FROM things"]), g, "x").result.error


def test_verified_prose(spark):
    assert K.offending_numbers(spark, "EMEA 42%, 1200 of 2 regions, 99 more", RESULT) == ["99"]
    model = K.ScriptedModel(["there are 77", "there are 128"])
    assert K.narrate(spark, model, "explain", RESULT) == "there are 128" and "77" in model.prompts[1]
    assert K.narrate(spark, K.ScriptedModel(["77", "78"]), "explain", RESULT) == RESULT.to_markdown()
    assert K.narrate(spark, K.ScriptedModel([]), "how many", RESULT) == RESULT.to_markdown()
    hits = [("Guide, p.3", "within 14 days")]
    assert K.compose(spark, K.ScriptedModel(["1200 deals within 14 days [Guide, p.3]"]), "q", RESULT, hits).startswith("1200")
    assert "[Guide, p.3]" in K.compose(spark, K.ScriptedModel([]), "q", RESULT, hits)
    found = spark.createDataFrame([(1, "Guide, p.3", "within 14 days")], "rank int, citation string, text string")
    seen = []
    text = K.hybrid(spark, K.ScriptedModel(["SELECT id, kind FROM things", "2 things in 14 days"]), guard(spark), "count", "rule?", lambda q: seen.append(q) or found)
    assert text == "2 things in 14 days" and "id=1, kind=x" in seen[0]
    assert K.hybrid(spark, K.ScriptedModel(["DROP TABLE things", "14 days"]), guard(spark), "count", "rule?", lambda q: found) == "14 days"


def test_json(spark):
    assert K.salvage_json('Sure! {bad} {"route": "SQL", "n": {"a": 1}} bye') == {"route": "SQL", "n": {"a": 1}}
    assert K.salvage_json("none") is None
    assert K.ask_json(K.ScriptedModel(["?", '{"a": 1}']), "p", lambda x: "a" in x) == {"a": 1}
    assert K.ask_json(K.ScriptedModel(["?", "?"]), "p", lambda x: True) is None
    assert K.ask_json(K.ScriptedModel([]), "p", lambda x: True) is None


def test_guards_and_spans(spark):
    stages = ("discovery", "proposal")
    row = spark.range(1).select(
        U.keeps_stale_entity(F.lit("and in Proposal"), F.lit("criteria for discovery and proposal"), stages),
        U.keeps_stale_entity(F.lit("and in Proposal"), F.lit("criteria for proposal"), stages),
        U.new_topic(F.lit(True), F.array(F.lit("deals")), F.array(F.lit("fees")), F.array(F.lit("fees"))),
        U.new_topic(F.lit(True), F.array(F.lit("deals")), F.array(F.lit("fees")), F.array(F.lit("fees"), F.lit("deals"))),
    ).first()
    assert tuple(row) == (True, False, True, False)
    header = spark.createDataFrame([(1, 0, 0.0, 50.0), (1, 1, 50.0, 90.0)], "page int, col int, x0 double, x1 double")
    spans = spark.createDataFrame([(1, 2.0, 10.0, "key"), (1, 55.0, 10.5, "a"), (1, 70.0, 10.6, "b"), (1, 95.0, 30.0, "far"), (1, 1.0, 30.2, "k2")], "page int, x double, y double, text string")
    got = C.rows_from_spans(spans, header).orderBy("row_no", "col").collect()
    assert [(r["row_no"], r["col"], r["text"]) for r in got] == [(1, 0, "key"), (1, 1, "a b"), (2, 0, "k2"), (2, 1, "far")]


def test_slots_questions_and_reports(spark, tmp_path):
    from lakewright.sources import sinks

    slots = F.create_map(F.lit("a"), F.lit("none"), F.lit("b"), F.lit("2024"))
    yes, no, nothing = F.lit(True), F.lit(False), F.lit(None).cast("string")
    row = spark.range(1).select(
        U.normalised_slots(slots), U.valid_population(F.lit("Europe"), ("europe",)), U.valid_population(F.lit("mars"), ("europe",)),
        U.effective_question(F.lit("p"), F.lit("r"), F.lit("m"), yes, yes), U.effective_question(F.lit("p"), F.lit("r"), F.lit("m"), no, yes),
        U.effective_question(nothing, F.lit("r"), F.lit("m"), yes, yes), U.effective_question(nothing, F.lit("r"), F.lit("m"), yes, no),
        U.clarification(F.array(F.lit("time_range"))), U.clarification(F.array(F.lit("x"))),
    ).first()
    assert row[0] == {"b": "2024"} and tuple(row)[1:7] == ("Europe", None, "m", "p r", "m", "r")
    assert row[7] == "Which period?" and row[8].endswith("?")
    timer = sinks.StageTimer()
    for name in ("a", "b", "a"):
        with timer.stage(name):
            pass
    assert set(timer.ms) == {"a", "b"} and timer.repeated == ["a"]
    assert "| n |" in sinks.report(spark.range(1).selectExpr("id AS n"), "Rows", str(tmp_path / "r.md"))

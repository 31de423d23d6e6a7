"""The fold along conversations against the column rules, turn by turn."""

import random

from pyspark.sql import functions as F

from lakewright.operators import history as H, rules as U

NAMES = ("europe", "asia")
PATTERN = r"(?i)\b(europe|asia)\b"


def test_fold_equals_column_rules(spark):
    """Round by round over all conversations: the rules of each turn as columns,
    with the state that the turn before left."""
    rng = random.Random(5)
    says = ["What closes a deal in Discovery for Europe?", "Exit criteria of Stage 2 - Proposal in asia", "and Negotiation", "what about closed won?", "Show deals", "commit", "and the handoff owner", "", None, "same for Discovery", "Europe", "How many in Asia at Evaluation and Proposal?"]
    rows = [(c, t, rng.choice(says)) for c in range(40) for t in range(7) if rng.random() < 0.9]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    want = {}
    state = {}
    for turn in range(7):
        now = [(c, t, x or "", *state.get(c, (None, []))) for c, t, x in rows if t == turn]
        df = spark.createDataFrame(now, "conv_id long, turn long, text string, pending string, recent array<string>")
        other = U.bare_stage_reply(F.col("recent"), F.col("text"))
        merged = F.coalesce(F.when(F.size("recent") > 0, other), "text")
        effective = F.when(F.col("pending").isNotNull(), F.concat_ws(" ", "pending", "text")).otherwise(merged)
        stale = F.col("pending").isNull() & (F.size("recent") > 0) & F.coalesce(U.keeps_stale_stage(F.col("recent"), F.col("text"), merged), F.lit(False))
        how = F.when(F.col("pending").isNotNull(), "clarified").when((F.size("recent") > 0) & other.isNotNull(), "substituted").otherwise("new")
        for r in df.select("conv_id", "turn", "pending", "recent", effective.alias("e"), how.alias("how"), stale.alias("stale"), effective.rlike(PATTERN).alias("ok")).collect():
            want[r["conv_id"], r["turn"]] = (r["e"], r["how"], r["stale"], not r["ok"])
            state[r["conv_id"]] = (None, [*r["recent"], r["e"]][-2:]) if r["ok"] else (r["e"], r["recent"])
    got = {(r["conv_id"], r["turn"]): tuple(r)[2:] for r in H.folded(turns, PATTERN).collect()}
    assert got == want
    assert {x[1] for x in got.values()} == {"new", "clarified", "substituted"} and any(x[2] for x in got.values())


def test_odd_rows(spark):
    rows = [(None, None, None), (None, 1, "Asia?"), (1, None, "b"), (1, None, "a"), (1, 2, "Asia in Proposal"), (1, 2, "Europe")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, how string")
    got = [tuple(r) for r in H.folded(df, PATTERN).collect()]
    assert [r[2] for r in got if r[0] is None] == ["", " Asia?"]
    assert [(r[2], r[3], r[5]) for r in got if r[0] == 1] == [("a", "new", True), ("a b", "clarified", True), ("a b Asia in Proposal", "clarified", False), ("Europe", "new", False)]
    assert H.folded(df.limit(0), PATTERN).count() == 0

"""Conversation repair against plain dynamic programming over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from lakewright.llm import queries as Q
from lakewright.llm.common import prepare, table
from lakewright.llm.conversation_repair import BLANK, CHUNK, DUPLICATE, SOUND, START, TRUNCATED, Repair, bounds, chunk_table, continued, ended, search, symbol

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "us", "s": "u", "u": "a", "a": "u"}
CODE = {"s": 1, "u": 2, "a": 3}


def cheapest(rows):
    """(cost, audit, lines) for (role, text, fault) rows, by dynamic programming over (row, last initial)."""
    best = {"": (0, "", ())}

    def grown(found):
        for _ in range(3):
            for last, (cost, audit, lines) in list(found.items()):
                to = NEXT[last][0]
                line = "user:" if to == "u" else "assistant:"
                new = cost + 5, audit + "I", (*lines, line)
                found[to] = min(found.get(to, new), new)
        return found

    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, lines) in grown(best).items():
            to = NEXT[last][0]
            ways = [(last, (cost + 2, audit + "D", lines))]
            if fault not in (BLANK, DUPLICATE):
                more = 5 if fault == TRUNCATED else 0
                ways.append((to, (cost + more + 1, audit + "R", (*lines, ("user:" if to == "u" else "assistant:") + text))))
                if role[:1] and role[:1] in NEXT[last]:
                    ways.append((role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for node, new in ways:
                after[node] = min(after.get(node, new), new)
        best = after
    return min(v for k, v in grown(best).items() if k in ("", "a"))


def expected(rows):
    """The contract's columns for rows as dicts, by conversation."""
    found = {}
    for cid in {r["conv_id"] for r in rows}:
        kept = []
        for r in rows:
            if r["conv_id"] != cid:
                continue
            name = [" " if r[c] is None else str(r[c]) for c in ("conv_id", "turn", "role", "text")]
            act = zlib.crc32(f"{name[0]}:{name[1]}".encode()) % 20
            role = "user" if act == 4 else name[2]
            text = "" if act == 1 else re.sub("[.!?]", "", name[3]) if act == 2 else name[3]
            kept += [(r["turn"], role, text)] * {0: 0, 3: 2}.get(act, 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            word = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(BLANK if not word else DUPLICATE if (role, text) in seen else SOUND if word[-1] in ".!?" else TRUNCATED)
            seen.add((role, text))
        cost, audit, lines = cheapest([(role, text, f) for (_, role, text), f in zip(kept, faults, strict=True)])
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        found[cid] = (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def answers(df):
    return {r["conv"]: tuple(r)[1:] for r in Repair(Q.damaged(df), copies="copies").digests().collect()}


def test_search_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice([SOUND] * 4 + [BLANK, DUPLICATE, TRUNCATED])) for _ in range(rng.randint(0, 12))]
        codes = bytes(symbol(CODE.get(role[0], START), fault) for role, _, fault in rows)
        want = cheapest(rows)[:2]
        assert search(codes) == want and bounds(codes, True)[0] <= want[0]
        prefixes = {START: (0, "")}
        for i in range(0, len(codes), 3):
            prefixes = continued(prefixes, chunk_table(codes[i : i + 3], prefixes))
        assert ended(prefixes) == want


def test_repair_of_odd_rows(spark):
    """Nulls everywhere, turns that repeat, equal rows by the thousand,
    conversations over many chunks and partitions, extra columns."""
    prepare(spark)
    rng = random.Random(3)
    rows = []
    for cid in [None, 1, 2, 3, 4]:
        for _ in range(rng.choice([3, 40, 10 * CHUNK])):
            text = rng.choice([None, "", "  \n", "a.", "b", "c! ", "dd?", f"e{rng.randint(0, 99)}."])
            rows.append((cid, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), text))
    rows += [(9, 5, "user", "same.")] * 2000 + [(10, i, "user" if i % 2 == 0 else "assistant", f"t {i}.") for i in range(1000)]
    rows += [(11, i, "user", "x") for i in range(60) if zlib.crc32(f"11:{i}".encode()) % 20 == 0]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kind string").repartition(5)
    got = answers(df)
    assert got == expected([r.asDict() for r in df.collect()])
    assert got[11] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert answers(spark.createDataFrame([], SCHEMA)) == {}


def test_repaired_rows(spark):
    """The operator's own output: well-formed conversations, and the lines that the digest covers."""
    prepare(spark)
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes"), (2, 0, "assistant", "Alone."), (3, 0, "system", "S."), (3, 1, "user", "U.")]
    repair = Repair(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in repair.repaired().orderBy("conv", "place").collect():
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    reports = {r["conv"]: r for r in repair.digests().collect()}
    assert reports[1]["audit"] == "KRD" and lines[1] == ["user:Hi.", "assistant:Again."]
    assert reports[2]["audit"] == "D" and 2 not in lines
    assert reports[3]["audit"] == "RR" and reports[3]["cost"] == 2 and lines[3] == ["user:S.", "assistant:U."]
    assert all(r["repaired_sha256"] == hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c, r in reports.items())


def test_registered_query(spark, sf_dir):
    df = Q.queries()["op11_conversation_repair"](spark, sf_dir)
    rows = [r.asDict() for r in table(spark, sf_dir, "conversations").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in df.collect()} == expected(rows)
    assert [t for c, t in df.dtypes if c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] == ["bigint"] * 6


@pytest.mark.parametrize("text, fault", [("a.\x0b\x0c", SOUND), ("\x0b \r", BLANK), ("a ", TRUNCATED), ("a. ", TRUNCATED), ("漢。", TRUNCATED)])
def test_white_space_is_ascii(spark, text, fault):
    prepare(spark)
    report = Repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Y.")], SCHEMA)).digests().first()
    assert (report["blank"], report["truncated"]) == (int(fault == BLANK), int(fault == TRUNCATED))

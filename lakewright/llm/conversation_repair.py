"""Least-cost repair of conversations whose turns are lost, empty, repeated,
cut short or out of turn.

A conversation is well formed if its roles read ``(s?(ua)+)?`` by their
initials, a system message first or none, then user and assistant in turn. The
first fault of a row counts: *blank* (nothing but white space), *duplicate* (its
role and text came before), *truncated* (does not end in ``.``, ``!`` or ``?``).
Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and
duplicate rows must go), Insert an empty user or assistant message 5; a truncated
row that stays adds 5. Of all repairs that of least cost is taken, of equal ones
that whose string of initials (K, R, D, I) is least.

1. Faults are found on narrow rows (conversation, turn, role, digest of the
   text): equal rows are counted, the first place of each (role, text) is an
   aggregate, and a row is a duplicate if it stands later.
2. A range shuffle brings narrow rows into order, so that a long conversation is
   spread over tasks. Each task reads on through its conversations. One that
   lies within the partition and has at most ``CHUNK`` rows is repaired at once;
   of others each chunk is repaired for every role that may come before it and
   after it, and the chunks are then put together.
3. ``search`` is a depth-first branch-and-bound: an explicit stack of prefixes,
   a lower bound for what each suffix costs at least (its faults, and its
   neighbours that cannot follow one another), the best repair so far as
   incumbent (cost, audit), and for each node (row, last role) the best prefix
   that reached it; worse prefixes go. Two prefixes of one node are never a
   beginning of one another at equal cost, so the better one stays better.
4. The texts are shuffled once, by conversation, beside the found edits; a task
   streams through them and holds one batch, a conversation's edits and a hash.
   A hash of a whole conversation's text can't be split over tasks.

Cases: a null role or text is one space, and so blank; a null turn comes first; rows of one turn follow
one another by role and digest of the text; a null conversation is one like any
other; a role with another initial than s, u or a can't be kept; a conversation
all of whose rows count 0 times (``copies``) has zeros and an empty audit; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

CHUNK = 32
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # the role that came last
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FOLLOWS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))  # the roles that may come after each
SPOKEN = (USER, USER, ASSISTANT, USER)  # the one of them that an edit can give
RIGHT_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER), (ASSISTANT, None)}  # None: the end
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5


Found = tuple[int, str]  # cost and audit, compared in this order


def symbol(role: int, fault: int) -> int:
    """A row in one byte; START for a role that can't be kept."""
    return role * 4 + fault


def bounds(rows: bytes, closed: bool) -> list[int]:
    """What each suffix costs at least: its faulty rows by themselves, and 1 for
    each pair of sound neighbours (deleted rows between them don't count, and no
    row is in two pairs) that can't follow one another. ``closed``: the end follows the last row."""
    alone, pairs = 0, 0
    following: tuple[int | None, int] | None = (None, 0) if closed else None  # the next sound role, the pairs behind it
    out = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        role, fault = divmod(rows[i], 4)
        if fault != SOUND:
            alone += DELETE
            following = None if fault == TRUNCATED else following
        elif role == START:
            alone += REROLE
            following = None
        else:
            best = pairs
            if following and (role, following[0]) not in RIGHT_PAIRS:
                best = max(best, following[1] + 1)
            following, pairs = (role, pairs), best
        out[i] = alone + pairs
    return out


def search(rows: bytes, begin: int = START, ends: tuple[int, ...] = (START, ASSISTANT), closed: bool = True) -> Found | None:
    """The best repair of ``rows`` after a message of role ``begin`` that leaves
    one of role ``ends`` last; insertions at the very end only if ``closed``."""
    n, least = len(rows), bounds(rows, closed)
    best: Found | None = None
    reached: list[Found | None] = [None] * (4 * (n + 1))
    stack = [(0, "", 0, begin)]
    while stack:
        cost, audit, i, last = stack.pop()
        if reached[4 * i + last] not in (None, (cost, audit)):
            continue  # a better prefix came to this node meanwhile
        if best and (cost + least[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        if i == n and last in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        steps = []
        if i < n:
            role, fault = divmod(rows[i], 4)
            steps.append((cost + DELETE, audit + "D", i + 1, last))
            if fault in (SOUND, TRUNCATED):
                stays = cost + (CUT_SHORT if fault == TRUNCATED else 0)
                if role in FOLLOWS[last]:
                    steps.append((stays, audit + "K", i + 1, role))
                if role != SPOKEN[last]:
                    steps.append((stays + REROLE, audit + "R", i + 1, SPOKEN[last]))
        if i < n or closed:
            steps.append((cost + INSERT, audit + "I", i, SPOKEN[last]))
        steps.sort(key=lambda s: (s[0] + least[s[2]], s[1]), reverse=True)
        for step in steps:
            node, found = 4 * step[2] + step[3], step[:2]
            if reached[node] is None or found < reached[node]:
                reached[node] = found
                stack.append(step)
    return best


def continued(prefixes: dict[int, Found], table: dict[tuple[int, int], Found]) -> dict[int, Found]:
    """The best repairs by last role, after one more chunk."""
    out: dict[int, Found] = {}
    for (a, b), (cost, audit) in table.items():
        if a in prefixes:
            found = prefixes[a][0] + cost, prefixes[a][1] + audit
            out[b] = min(out.get(b, found), found)
    return out


def chunk_table(rows: bytes, before: Iterator[int] | range = range(4)) -> dict[tuple[int, int], Found]:
    found = {(a, b): search(rows, a, (b,), closed=False) for a in before for b in range(4)}
    return {k: v for k, v in found.items() if v}


def ended(prefixes: dict[int, Found]) -> Found:
    """The best of whole repairs, with what must be inserted at the end."""
    return min((cost + more[0], audit + more[1]) for last, (cost, audit) in prefixes.items() if (more := search(b"", last)))


class Counts:
    """What is counted along a conversation; two stretches can be put together."""

    NAMES = ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "first_role", "last_role")

    def __init__(self) -> None:
        self.lo = self.hi = self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    @classmethod
    def one(cls, turn: int | None, role: int, fault: int) -> Counts:
        self = cls()
        self.lo = self.hi = self.first_turn = self.last_turn = turn
        self.first_role = self.last_role = role
        self.turns = int(turn is not None)
        self.blank, self.duplicate, self.truncated = (int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED))
        return self

    def then(self, more: Counts) -> None:
        """Add the stretch that follows."""
        if self.last_turn is not None and self.last_turn == more.first_turn:
            self.turns -= 1
        if self.last_role is not None and more.first_role is not None and (self.last_role, more.first_role) not in RIGHT_PAIRS:
            self.illegal += 1
        for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(more, name))
        if self.lo is None:
            self.lo, self.first_turn = more.lo, more.first_turn
        self.hi = self.hi if more.hi is None else more.hi
        self.last_turn = self.last_turn if more.last_turn is None else more.last_turn
        self.first_role = more.first_role if self.first_role is None else self.first_role
        self.last_role = self.last_role if more.last_role is None else more.last_role

    def report(self, found: Found) -> dict[str, object]:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": found[0], "audit": found[1]}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = "lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, first_role int, last_role int"
_TABLE = "array<struct<before: int, last: int, cost: long, audit: string>>"


def _ordered(rows: DataFrame) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


class Repair:
    """Faults, edits and repaired rows of all conversations in ``rows``.
    ``copies`` names a column that says how many times a row stands."""

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: str | None = None) -> None:
        role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
        trimmed = F.rtrim(text, F.lit(WHITE))
        initial = F.substr(role, F.lit(1), F.lit(1))
        kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
        fault = F.when(trimmed == "", BLANK).when(F.substr(trimmed, F.lit(-1), F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
        times = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
        self.rows = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"), kind.alias("kind"), fault.alias("fault"), times.alias("times"))
        self.kind = self.rows.schema["conv"].dataType.simpleString()
        self.reports = stored(self._reports(), "repairs")

    def _faults(self) -> DataFrame:
        """Narrow rows, equal ones counted; ``late`` if all of them are duplicates."""
        stands = F.col("times") > 0
        narrow = self.rows.select("conv", *(F.when(stands, F.col(c)).alias(c) for c in ("turn", "role", "digest", "kind", "fault")), "times")
        narrow = narrow.groupBy("conv", "turn", "role", "digest", "kind", "fault").agg(F.sum("times").alias("times"))
        place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        keys = ("conv", "role", "digest")
        firsts = narrow.where("role is not null").groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        firsts = firsts.select(*(F.col(c).alias(f"f_{c}") for c in keys), "first").repartition(F.xxhash64("f_conv", "f_role", "f_digest", F.lit(1)))
        both = narrow.join(firsts, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
        return both.select(*narrow.columns, F.coalesce(place > F.col("first"), F.lit(False)).alias("late"))

    def _reports(self) -> DataFrame:
        """One row a conversation: counts, cost and audit."""
        keys = [F.col("conv").asc_nulls_first(), *_ordered(self.rows)]
        ordered = self._faults().repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "kind", "fault", "times", "late")
        schema = f"conv {self.kind}, report struct<{_REPORT.replace(' ', ': ')}>, part int, seq long, counts struct<{_COUNTS.replace(' ', ': ')}>, table {_TABLE}"
        schema = schema.replace(",:", ",")
        found = stored(ordered.mapInArrow(_stretches, schema), "stretches")
        parts = found.where("report is null").select("conv", "part", "seq", "counts", "table")
        parts = parts.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_together, f"conv {self.kind}, {_REPORT}")
        return found.where("report is not null").select("conv", "report.*").union(parts)

    def _walked(self, schema: str, walk) -> DataFrame:
        """The texts of each conversation after its report, in order."""
        report = F.struct(*(x.split()[0] for x in _REPORT.split(", ")))
        first = self.reports.select("conv", F.lit(0).alias("is_row"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"), ("kind", "int"), ("times", "long"))), report.alias("report"))
        rows = self.rows.where("times > 0").select("conv", F.lit(1).alias("is_row"), "turn", "role", "digest", "text", "kind", "times", F.lit(None).cast(first.schema["report"].dataType).alias("report"))
        both = first.union(rows).repartition("conv").sortWithinPartitions("conv", "is_row", *_ordered(rows))
        return both.select("conv", "role", "text", "kind", "times", "report").mapInArrow(walk, f"conv {self.kind}, {schema}")

    def repaired(self) -> DataFrame:
        """conv, place, role, text, edit (Keep, Rerole or Insert) of every row
        of the repaired conversations."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            place = 0
            kinds = None
            for conv, event, value in _events(batches):
                if event == "kinds":
                    kinds = value
                elif event == "begin":
                    place = 0
                elif event == "row":
                    out.append((conv, place, *value))
                    place += 1
                    if len(out) >= 1000:
                        yield _rows(out, kinds, ("place", "role", "text", "edit"))
                        out = []
            if out:
                yield _rows(out, kinds, ("place", "role", "text", "edit"))

        return self._walked("place long, role string, text string, edit string", walk)

    def digests(self) -> DataFrame:
        """conv, the counts, cost, audit, and the SHA-256 of the repaired rows as
        lines ``role:text``."""
        names = [x.split()[0] for x in _REPORT.split(", ")]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            kinds = digest = report = None
            lines = 0
            for conv, event, value in _events(batches):
                if event == "kinds":
                    kinds = value
                elif event == "begin":
                    digest, report, lines = hashlib.sha256(), value, 0
                elif event == "row":
                    digest.update(b"\n" * (lines > 0) + f"{value[0]}:{value[1]}".encode())
                    lines += 1
                else:
                    out.append((conv, *(report[n] for n in names), digest.hexdigest()))
                    if len(out) >= 1000:
                        yield _rows(out, kinds, (*names, "repaired_sha256"))
                        out = []
            if out:
                yield _rows(out, kinds, (*names, "repaired_sha256"))

        return self._walked(f"{_REPORT}, repaired_sha256 string", walk)


def _rows(out: list[tuple], kind: pa.DataType, names: tuple[str, ...]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*out, strict=True)]
    known = {"place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, known.get(n, pa.int64())) for c, n in zip(columns[1:], names, strict=True))], names=["conv", *names])


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, event, value) along sorted rows: first the id's type; then for
    each conversation ``begin`` with its report, its repaired ``row``s as (role,
    text, edit), and ``end``."""
    names = ("", "system", "user", "assistant")
    conv, audit, at, last, begun = None, "", 0, START, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            last, at = SPOKEN[last], at + 1
            yield conv, "row", (names[last], "", "Insert")

    for batch in batches:
        yield None, "kinds", batch.schema.field(0).type
        for c, role, text, kind, times, report in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if report is not None:
                if begun:
                    yield from inserted()
                    yield conv, "end", None
                conv, audit, at, last, begun = c, report["audit"], 0, START, True
                yield conv, "begin", report
                continue
            for _ in range(times):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    last = kind
                    yield conv, "row", (role, text, "Keep")
                elif edit == "R":
                    last = SPOKEN[last]
                    yield conv, "row", (names[last], text, "Rerole")
    if begun:
        yield from inserted()
        yield conv, "end", None


class _Stretch:
    """The rows of one conversation within a partition."""

    def __init__(self, conv: object, alone: bool) -> None:
        self.conv, self.alone = conv, alone
        self.counts, self.rows = Counts(), bytearray()
        self.prefixes: dict[int, Found] | None = None  # once a chunk is full
        self.chunks: list[dict] = []

    def add(self, turn: int | None, kind: int, fault: int) -> None:
        self.counts.then(Counts.one(turn, kind, fault))
        self.rows.append(symbol(kind, fault))
        if len(self.rows) == CHUNK:
            self.close()

    def close(self) -> None:
        """Put a full (or last) chunk away: at once if the conversation began in this partition."""
        if self.alone:
            before = self.prefixes or {START: (0, "")}
            self.prefixes = continued(before, chunk_table(bytes(self.rows), before))
        else:
            self.chunks.append(self.chunk())
            self.counts = Counts()
        self.rows = bytearray()

    def chunk(self) -> dict:
        table = chunk_table(bytes(self.rows))
        return {"counts": {n: getattr(self.counts, n) for n in Counts.NAMES}, "table": [{"before": a, "last": b, "cost": c, "audit": t} for (a, b), (c, t) in table.items()]}

    def report(self) -> dict:
        if self.prefixes is None:
            return self.counts.report(search(bytes(self.rows)))
        self.close()
        return self.counts.report(ended(self.prefixes))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations that lie within a partition; chunks of the
    first and the last one, which may go on in others."""
    part = TaskContext.get().partitionId()
    now: _Stretch | None = None
    out: list[dict] = []
    seq = 0

    def batch(kind: pa.DataType) -> pa.RecordBatch:
        report = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _REPORT.split(", ")])
        counts = pa.struct([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in _COUNTS.split(", ")])
        table = pa.list_(pa.struct([("before", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        columns = {"conv": kind, "report": report, "part": pa.int32(), "seq": pa.int64(), "counts": counts, "table": table}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in columns.items()], names=list(columns))

    def put_away() -> None:
        nonlocal seq
        for chunk in now.chunks:
            out.append({"conv": now.conv, "part": part, "seq": seq, **chunk})
            seq += 1
        now.chunks = []

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for conv, turn, role, fault, times, late in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv != conv:
                if now and now.alone:
                    out.append({"conv": now.conv, "report": now.report()})
                elif now:
                    now.close()
                    put_away()
                now = _Stretch(conv, alone=now is not None)
            for k in range(times):
                now.add(turn, role, fault if fault == BLANK or not late and k == 0 else DUPLICATE)
                if now.chunks:
                    put_away()
            if len(out) >= 1000:
                yield batch(kind)
                out = []
    if now:
        yield batch(kind)
        out = []
        if now.alone:  # it may go on: as chunks from its beginning
            last = {"counts": {n: getattr(now.counts, n) for n in Counts.NAMES}}
            now.prefixes = continued(now.prefixes or {START: (0, "")}, chunk_table(bytes(now.rows), now.prefixes or {START: (0, "")}))
            last["table"] = [{"before": START, "last": b, "cost": c, "audit": t} for b, (c, t) in now.prefixes.items()]
            out.append({"conv": now.conv, "part": part, "seq": seq, **last})
        else:
            now.close()
            put_away()
        yield batch(kind)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations from their chunks, in order."""
    names = tuple(x.split()[0] for x in _REPORT.split(", "))
    conv, counts, prefixes, begun = None, Counts(), {START: (0, "")}, False
    out: list[tuple] = []
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for c, more, table in zip(*(batch.column(n).to_pylist() for n in ("conv", "counts", "table")), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, *counts.report(ended(prefixes)).values()))
                conv, counts, prefixes, begun = c, Counts(), {START: (0, "")}, True
            part = Counts()
            part.__dict__.update(more)
            counts.then(part)
            prefixes = continued(prefixes, {(t["before"], t["last"]): (t["cost"], t["audit"]) for t in table})
    if begun:
        out.append((conv, *counts.report(ended(prefixes)).values()))
    if out:
        yield _rows(out, kind, names)

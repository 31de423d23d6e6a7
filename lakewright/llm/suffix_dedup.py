"""Exact repeated passages by an enhanced suffix array.

A byte is *covered* if it lies in a string of ``size`` bytes that also starts
at another place, in the same document or in any other.

1. Every window of ``size`` bytes is assigned to its anchor, the place of the
   smallest hash of a ``GRAM``-byte string inside it (the last of equal ones).
   The anchor depends on the window's bytes only, so equal windows meet under
   equal anchor fingerprints. Neighbouring windows with one anchor form a run,
   about one for 85 bytes; a run's context is the bytes of all its windows.
2. Runs are counted by fingerprint and by context (map-side combined, so that
   a passage in a third of all documents is one count). A fingerprint with one
   context that repeats has a tree of one leaf: the context is its only repeat.
3. The distinct contexts of all other fingerprints are dealt out by fingerprint,
   each with the number of its places; a task lays some megabyte of them end to
   end, sorts all window starts by prefix doubling, computes common prefix lengths
   from the doubling levels, and scans the intervals of common prefixes of at
   least ``size`` bytes with a stack. An interval whose occurrences differ in the
   byte to their left is a maximal repeat; others are covered by their extension
   to the left, and a context with several places is a repeat as a whole. Every
   repeat has all its contexts, and through them all its places.
4. A fingerprint with more than ``GROUP`` distinct contexts is split by salt;
   its windows are then also counted by content over all salts, and those that
   were alone under their salt are looked up in these counts.
5. The repeats' spans are joined with the places of their contexts, merged for
   each document and cut out of its text.

Cases: ids are integers; null text is empty; texts shorter than ``size`` are kept whole; equal
rows, also with the same id, repeat each other; null ids are documents like any
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import POWERS, U64, blocks, buffers, dealt_anew, mix, need_integers, stored

GRAM = 32
GROUP = 2048
BLOCK = 1 << 18
_PLACE = np.random.default_rng(3).integers(0, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)
_PLACE_BITS = U64((1 << 22) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; the array is cut short."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    data = np.ascontiguousarray(raw)
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * _PLACE[0]
    word ^= word >> U64(32)
    word *= _PLACE[1]
    word ^= word >> U64(29)
    out = word[:n] * _PLACE[2]
    for j in range(1, GRAM // 8):
        out += word[8 * j : 8 * j + n] * _PLACE[2 + j]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, fingerprint, context, first, last, reach, times) of the runs
    of windows; places count from the document's start. Equal runs that follow
    one another are one entry, whose windows go on to ``reach``."""
    for i, j in blocks(offsets, BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, hi, 4 * BLOCK):
            b = min(hi, a + 4 * BLOCK + size - 1)
            part = raw[a:b]
            if len(part) < size:
                break
            gram = gram_hashes(part)
            place = np.arange(len(gram), dtype=U64)
            anchor = ~sliding_min((gram & ~_PLACE_BITS) | (~place & _PLACE_BITS), size - GRAM + 1) & _PLACE_BITS
            start = np.arange(a, a + len(anchor))
            doc = np.searchsorted(offsets, start, "right") - 1 if j - i > 1 else np.full(len(start), i)
            valid = (start + size <= offsets[doc + 1]) & (start < a + 4 * BLOCK)
            start, doc, anchor = start[valid] - a, doc[valid], anchor[valid].astype(np.int64)
            if not len(start):
                continue
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            first, last = start[head], start[np.append(head[1:], len(start)) - 1]
            anchor, doc = anchor[head], doc[head]
            up, down = POWERS.upto(len(gram) + 1)
            total = np.zeros(len(gram) + 1, U64)
            np.cumsum(gram * up[: len(gram)], out=total[1:])
            context = (total[last + size - GRAM + 1] - total[first]) * down[first]
            context = mix(context + (anchor - first).astype(U64) * _PLACE[8] + (last - first).astype(U64) * _PLACE[9])
            # in periodic text one run follows another with the same context
            code, same = gram[anchor], np.zeros(len(doc), bool)
            same[1:] = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1]) & (context[1:] == context[:-1]) & (first[1:] == last[:-1] + 1)
            head = np.flatnonzero(~same)
            stop = np.append(head[1:], len(same))
            doc, reach = doc[head], last[stop - 1]
            shift = a - offsets[doc]
            yield doc, code[head], context[head], first[head] + shift, last[head] + shift, reach + shift, stop - head


SYMBOL, WORD = 9, 7  # bits of a symbol (a byte plus one; 0: past the end), symbols of a word


class ContextArray:
    """Enhanced suffix array of some contexts laid end to end."""

    def __init__(self, contexts: list[bytes], size: int) -> None:
        self.size = size
        lengths = np.array([len(c) for c in contexts])
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        n = len(self.text)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.owner = np.repeat(np.arange(len(contexts)), lengths)
        self.left_over = self.starts[self.owner + 1] - np.arange(n)
        symbols = np.zeros(n + WORD, np.int64)
        symbols[:n] = self.text.astype(np.int64) + 1
        self.word = np.zeros(n, np.int64)
        for s in range(WORD):
            part = np.where(self.left_over > s, symbols[s : s + n], 0)
            self.word |= part << (SYMBOL * (WORD - 1 - s))
        self.levels = [(WORD, np.unique(self.word, return_inverse=True)[1].astype(np.int64) + 1)]
        while self.levels[-1][0] < lengths.max():
            step, rank = self.levels[-1]
            nxt = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left_over > step)
            nxt[inside] = rank[inside + step]
            self.levels.append((2 * step, np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1))
        windows = np.flatnonzero(self.left_over >= size)
        self.sa = windows[np.argsort(self.levels[-1][1][windows], kind="stable")]
        self.lcp = self._lcp(self.sa[:-1], self.sa[1:])

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = np.minimum(self.left_over[a], self.left_over[b])
        got = np.zeros(len(a), np.int64)
        for step, rank in reversed(self.levels):
            some = np.flatnonzero(got < least)
            same = rank[a[some] + got[some]] == rank[b[some] + got[some]]
            got[some[same]] += step
        some = np.flatnonzero(got < least)
        x, y = self.word[a[some] + got[some]], self.word[b[some] + got[some]]
        for s in range(1, WORD):
            got[some] += x >> (SYMBOL * (WORD - s)) == y >> (SYMBOL * (WORD - s))
        return np.minimum(got, least)

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """(lb, rb, length) of the maximal repeats, children before parents: the
        intervals of the common-prefix tree whose left symbols differ."""
        left = np.where(self.sa == self.starts[self.owner[self.sa]], -1 - np.arange(len(self.sa)), self.text[self.sa - 1].astype(np.int64))
        differ = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
        deep = self.lcp >= self.size
        edge = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
        for lb, rb in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if differ[lb] == differ[rb]:
                continue  # one symbol stands before all of them
            stack = [(lb, self.size)]
            for k, depth in enumerate([*self.lcp[lb:rb].tolist(), 0], lb):
                begin = k
                while stack and stack[-1][1] > depth or stack and depth == 0:
                    begin, length = stack.pop()
                    if k > begin and differ[begin] != differ[k] and self._own_depth(begin, k, length):
                        yield begin, k, length
                if depth and (not stack or stack[-1][1] < depth):
                    stack.append((begin, depth))

    def _own_depth(self, lb: int, rb: int, length: int) -> bool:
        """Whether the interval's common prefix is as long as its stack entry
        says (the bottom entry stands for ``size``, which may not occur)."""
        return length > self.size or int(self.lcp[lb:rb].min()) == length

    def window_hashes(self) -> np.ndarray:
        up, down = POWERS.upto(len(self.text) + 1)
        total = np.zeros(len(self.text) + 1, U64)
        np.cumsum((self.text.astype(U64) + U64(1)) * up[: len(self.text)], out=total[1:])
        return mix((total[self.sa + self.size] - total[self.sa]) * down[self.sa])


_OUT = "kind int, fp long, ctx long, code long, n long, start long, length long, group_id long"


def _union(owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans that overlap or touch, for each owner."""
    if not len(owner):
        return owner, start, length
    wide = int((start + length).max()) + 2
    order = np.lexsort((start, owner))
    a = owner[order] * wide + start[order]
    b = np.maximum.accumulate(owner[order] * wide + (start + length)[order])
    new = np.append(True, a[1:] > b[:-1])
    head = np.flatnonzero(new)
    a, b = a[head], b[np.append(head[1:], len(b)) - 1]
    return a // wide, a % wide, b - a


def _scan(size: int, all_groups: bool):
    """Contexts sorted by (fp, salt) to places in them (``start`` counts from the
    context's): kind 0, parts of maximal repeats, group by group or (for cutting)
    their unions; kind 1, windows of split fingerprints with their counts."""

    def block(rows: dict[str, list]) -> pa.RecordBatch:
        array = ContextArray(rows["bytes"], size)
        many, fp, ctx = (np.array(rows[c], np.int64) for c in ("many", "fp", "ctx"))
        split = np.array(rows["split"], bool)
        owner = array.owner[array.sa]
        place = array.sa - array.starts[owner]
        whole = np.flatnonzero(many > 1)
        lengths = np.diff(array.starts)
        found = [(whole, np.zeros(len(whole), np.int64), lengths[whole], np.array([_name(rows["bytes"][k]) for k in whole] if all_groups else whole, np.int64))]
        deepest = np.zeros(len(array.sa), np.int64)
        for lb, rb, length in array.repeats():
            np.maximum(deepest[lb : rb + 1], length, out=deepest[lb : rb + 1])
            if all_groups:
                at = np.arange(lb, rb + 1)
                group = _name(array.text[array.sa[lb] : array.sa[lb] + length].tobytes())
                found.append((owner[at], place[at], np.full(len(at), length), np.full(len(at), group)))
        if not all_groups:  # the longest repeat at each place says it all
            at = np.flatnonzero(deepest)
            found.append((owner[at], place[at], deepest[at], np.zeros(len(at), np.int64)))
        o, start, length, group = (np.concatenate(x) for x in zip(*found, strict=True))
        if all_groups:
            use = ~split[o]
            o, start, length, group = o[use], start[use], length[use], group[use]
        else:
            o, start, length = _union(o, start, length)
            group = np.zeros(len(o), np.int64)
        zero = np.zeros(len(o), np.int64)
        out = [(zero, fp[o], ctx[o], zero, many[o], start, length, group)]
        # windows of split fingerprints: all, or one for each distinct string
        use = np.flatnonzero(split[owner])
        if len(use):
            n = many[owner]
            if not all_groups:
                cluster = np.concatenate(([0], np.cumsum(array.lcp < size)))
                first = np.append(True, np.diff(cluster) > 0)
                n, use = np.bincount(cluster, n).astype(np.int64)[cluster], use[first[use]]
            o, zero = owner[use], np.zeros(len(use), np.int64)
            out.append((zero + 1, fp[o], ctx[o], array.window_hashes()[use].view(np.int64), n[use], place[use], zero + size, zero))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=[x.split()[0] for x in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        held, last = 0, None
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (row[names.index("fp")], row[names.index("salt")])
                if held > 2 * BLOCK and key != last:
                    yield block(rows)
                    rows, held = {}, 0
                for name, value in zip(names, row, strict=True):
                    rows.setdefault(name, []).append(value)
                held, last = held + len(row[names.index("bytes")]), key
        if held:
            yield block(rows)

    return run


def _name(data: bytes) -> int:
    """The id of a repeated string."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Repeats:
    """Repeated strings of at least ``size`` bytes in all texts."""

    def __init__(self, docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> None:
        need_integers(docs, id_col)
        if size < GRAM + 8:
            raise ValueError(f"repeats of at least {GRAM + 8} bytes are found")
        self.size = size
        text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
        self.docs = docs.select(F.col(id_col).alias("doc_id"), text).withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k2": F.xxhash64("text")})
        runs_of = stored(self._runs(), "runs")
        prints = runs_of.groupBy("fp").agg(F.sum("times").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
        prints = dealt_anew(prints.select("fp", F.expr("lo <> hi").alias("several")), "fp")
        self.repeated = stored(runs_of.join(prints, "fp"), "repeated")
        contexts = self.repeated.where("several").groupBy("fp", "ctx").agg(F.sum("times").alias("many"), *(F.first(c).alias(c) for c in ("k1", "k2", "p0", "p1")))
        contexts = stored(contexts, "contexts")
        kinds = dealt_anew(contexts.groupBy("fp").agg(F.count("*").alias("kinds")), "fp")
        salt = F.pmod("ctx", F.ceil(F.col("kinds") / group).cast("long")).cast("int")
        self.contexts = stored(contexts.join(kinds, "fp").withColumns({"salt": salt, "split": F.col("kinds") > group}).drop("kinds"), "dealt")

    def _runs(self) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = buffers(batch.column(0))
                for doc, fp, ctx, p0, p1, reach, times in runs(raw, offsets, size):
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(at), batch.column(2).take(at), pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (p0, p1, reach, times))],
                        names=["k1", "k2", "fp", "ctx", "p0", "p1", "reach", "times"],
                    )

        return self.docs.select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, fp long, ctx long, p0 int, p1 int, reach int, times int")

    def _compared(self, all_groups: bool) -> DataFrame:
        """The repeats in the contexts of fingerprints with several."""
        size = self.size
        wanted = self.contexts.groupBy("k1", "k2").agg(F.collect_list(F.struct("fp", "ctx", "salt", "split", "many", "p0", "p1")).alias("w"))
        texts = self.docs.select("k1", "k2", F.col("text").cast("binary").alias("text")).join(wanted, ["k1", "k2"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[tuple[int, int]] = set()  # rows that repeat an id and a text bring a context once
            for batch in batches:
                rows = []
                for k1, k2, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (k1, k2) in done:
                        continue
                    done.add((k1, k2))
                    rows += [(w["fp"], w["ctx"], w["salt"], w["split"], w["many"], text[w["p0"] : w["p1"] + size]) for w in want]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["fp", "ctx", "salt", "split", "many", "bytes"])

        parts = texts.mapInArrow(cut, "fp long, ctx long, salt int, split boolean, many long, bytes binary")
        parts = parts.repartition("fp", "salt").dropDuplicates(["fp", "salt", "ctx"]).sortWithinPartitions("fp", "salt")
        return stored(parts.mapInArrow(_scan(size, all_groups), _OUT), "compared")

    def _whole(self) -> DataFrame:
        """Places of the contexts that are alone under their fingerprint."""
        return self.repeated.where("not several")

    def marks(self) -> DataFrame:
        """(k1, k2, start, length): parts of maximal repeats; their union over a
        document is what its repeated windows cover."""
        compared = self._compared(all_groups=False)
        windows = compared.where("kind = 1")
        often = windows.groupBy("fp", "code").agg(F.sum("n").alias("total")).where("total > 1")
        late = windows.where("n = 1").join(often, ["fp", "code"])
        inner = compared.where("kind = 0").select("fp", "ctx", "start", "length")
        places = self.repeated.where("several").join(inner.union(late.select(inner.columns)), ["fp", "ctx"])
        # a whole context goes on to the end of the equal runs that follow it
        all_of_it = (F.col("start") == 0) & (F.col("length") == F.col("p1") - F.col("p0") + self.size)
        length = F.when(all_of_it, F.col("reach") - F.col("p0") + self.size).otherwise(F.col("length"))
        places = places.select("k1", "k2", (F.col("p0") + F.col("start")).alias("start"), length.cast("long").alias("length"))
        return places.union(self._whole().select("k1", "k2", F.col("p0").cast("long"), (F.col("reach") - F.col("p0") + self.size).cast("long")))

    def spans(self) -> DataFrame:
        """(k1, k2, s, l): the starts and lengths of ``marks``, each once for all
        rows that repeat an id and a text; sets are merged before they move."""
        each = self.marks().groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("x"))
        return each.select("k1", "k2", F.col("x.start").alias("s"), F.col("x.length").alias("l"))

    def groups(self) -> DataFrame:
        """(group_id, length, doc_id, start): maximal repeats inside contexts with
        all their occurrences. Every repeated window lies in a group at the same
        place of each occurrence, and has no other places. Longer repeats show as
        groups that overlap; under a split fingerprint the groups are windows."""
        ids = self.docs.select("k1", "k2", "doc_id").distinct()
        each = F.explode(F.expr("transform(sequence(0, times - 1), i -> cast(p0 + i * (p1 - p0 + 1) as long))"))
        whole = self._whole().select(F.xxhash64("fp", "ctx").alias("group_id"), (F.col("p1") - F.col("p0") + self.size).cast("long").alias("length"), "k1", "k2", each.alias("start"))
        compared = self._compared(all_groups=True)
        windows = compared.where("kind = 1")
        often = dealt_anew(windows.groupBy(F.xxhash64("fp", "code").alias("group_id")).agg(F.sum("n").alias("total")).where("total > 1"), "group_id")
        windows = windows.withColumn("group_id", F.xxhash64("fp", "code")).join(often, "group_id")
        inner = compared.where("kind = 0").select("fp", "ctx", F.col("start").alias("shift"), "length", "group_id")
        inner = inner.union(windows.select("fp", "ctx", "start", "length", "group_id"))
        inner = self.repeated.where("several").join(inner, ["fp", "ctx"]).select("group_id", "length", "k1", "k2", "shift", each.alias("start"))
        inner = inner.select("group_id", "length", "k1", "k2", F.col("start") + F.col("shift"))
        return whole.union(inner).join(ids, ["k1", "k2"]).select("group_id", "length", "doc_id", "start")


def remove_repeats(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining
    bytes), spans (the maximal removed runs)."""
    found = Repeats(docs, size, id_col, text_col, group)
    spans = found.spans()
    both = found.docs.join(spans, ["k1", "k2"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "s", "l")
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s, length in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                a, b = merge_spans(np.array(s or [], np.int64), np.array(length or [], np.int64))
                left = b"".join(text[i:j] for i, j in zip([0, *b], [*a, len(text)], strict=True))
                rows.append((len(text), len(text) - len(left), len(a), hashlib.sha256(left).hexdigest(), left, [{"start": i, "end": j} for i, j in zip(a, b, strict=True)]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")


def merge_spans(start: np.ndarray, length: np.ndarray) -> tuple[list[int], list[int]]:
    """Unions of spans that overlap or touch."""
    if not len(start):
        return [], []
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + length)[order])
    cut = np.flatnonzero(a[1:] > b[:-1])
    return a[np.append(0, cut + 1)].tolist(), b[np.append(cut, len(b) - 1)].tolist()


def _whole_characters(text: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Spans narrowed to character boundaries; those that vanish are left out."""
    out = []
    for i, j in zip(a, b, strict=True):
        while i < j and text[i] & 0xC0 == 0x80:
            i += 1
        while j > i and j < len(text) and text[j] & 0xC0 == 0x80:
            j -= 1
        if i < j:
            out.append((i, j))
    return [i for i, _ in out], [j for _, j in out]


def cut_repeats(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with texts cut to what does not
    repeat (whole characters only) and ``n_chars`` counted again; rows whose
    repeats leave only white space go. A null text becomes an empty one."""
    found = Repeats(docs, size, id_col, text_col)
    spans = found.spans()
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("text"))
    keyed = keyed.withColumn("row", F.col("row").dropFields(text_col)) if len(docs.columns) > 1 else keyed
    both = keyed.join(spans, ["k1", "k2"], "left").select("row", "text", "s", "l")
    kind = both.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = [], []
            for text, s, length in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                a, b = _whole_characters(text, *merge_spans(np.array(s or [], np.int64), np.array(length or [], np.int64)))
                texts.append(b"".join(text[i:j] for i, j in zip([0, *b], [*a, len(text)], strict=True)).decode())
                cut.append(bool(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(cut)], names=["row", "text", "cut"])

    out = both.mapInArrow(run, f"row {kind}, text string, cut boolean").where(~F.col("cut") | F.col("text").rlike(r"\S"))

    def column(name: str):
        if name == text_col:
            return F.col("text").alias(name)
        if name == n_chars_col:
            kind = docs.schema[name].dataType
            return F.when(F.col("cut"), F.length("text")).otherwise(F.col(f"row.`{name}`")).cast(kind).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return out.select([column(c) for c in docs.columns])

"""Benchmark decontamination: word-pair seeds and Smith-Waterman alignment.

1. Test items become word sequences (A-Z lower-cased, marks and digits kept in
   words, see ``Words``). The possible seeds of each place of an item are the
   pairs of its word with the next and with the next but one; a text holds a
   seed where the two words are neighbours or have one word between them.
2. One pass over all documents counts in how many documents each possible seed
   occurs (counts are summed inside the tasks first). An item's places are
   ranked by that count and only the most frequent ones go, never more than
   an alignment can spare: whatever the counts are, an alignment that reaches the
   threshold has seeds left.
3. A second pass finds the seeds in each document. Where as many as such an
   alignment must have lie within its greatest length, and the words that the
   text shares with the item could add up to the threshold, that region and the
   item are aligned word by word by Smith-Waterman (match 2, mismatch -1, gap
   -1), many pairs at a time. The similarity is the best local score over the
   score of the whole item.

Why no alignment is lost: let it have k matches. Two matches that follow one
another with at most one word between them, in the text and in the item, are a
seed; all others cost at least 2. With t seeds the score is at most
2 k - 2 (k - 1 - t) = 2 + 2 t, so t >= threshold * words - 1, each seed at its
own place of the item and of the text. At least one seed is certain for items
of more than 1 / threshold words. As there are at most as many matches as the
item has words, the text's part has at most (3 - 2 threshold) * words words.

Documents are never shuffled. The items travel to the tasks in blocks of at
most ``ITEM_WORDS`` words, so what is broadcast at once has a fixed bound, and
a larger benchmark means more passes.

Cases: null and empty texts and items match nothing; items of one word have it
as their only seed, items of two words their pair; repeated items and documents
are reported each; an empty table on either side gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Words, blocks, buffers, mix

REACH = 2  # a pair's words are at most so far apart
ITEM_WORDS = 2_000_000
THRESHOLD = 0.4
MATCH, MISS, GAP = 2, 1, 1
_PLACE = np.random.default_rng(2).integers(0, 1 << 63, 2, dtype=np.uint64) * U64(2) + U64(1)


class _Text(Words):
    """Words without the marks around them, so that edited punctuation does
    not hide a copy; words of marks only are left out."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        letter = np.ones(256, bool)
        letter[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False
        clean = np.where(letter[raw], raw, 0x20).astype(np.uint8)
        super().__init__(clean, offsets)


def pairs(words: Words, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, place of the first word) of all pairs inside documents whose
    words are ``apart`` words apart; 0: of the single words."""
    n = len(words.hash)
    if n <= apart:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if not apart:
        return mix(words.hash * _PLACE[0]), np.arange(n)
    at = np.flatnonzero(words.doc[apart:] == words.doc[: n - apart])
    return mix(words.hash[at] * _PLACE[0] + words.hash[at + apart] * _PLACE[1]), at


class Items:
    """A block of test items: word codes, and seeds with their places."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        self.ids = ids
        raw, offsets = buffers(texts)
        words = _Text(raw, offsets)
        self.words = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        self.vocabulary = [np.unique(w) for w in self.words]
        self.length = words.count
        self.need = np.ones(len(ids), np.int64)
        codes, places = [], []
        for apart in range(REACH + 1):
            code, at = pairs(words, apart)
            use = (words.count[words.doc[at]] == 1) == (apart == 0)
            codes.append(code[use])
            places.append(at[use])
        self.code, self.place = np.concatenate(codes), np.concatenate(places)
        self.item = words.doc[self.place]
        order = np.argsort(self.code, kind="stable")
        self.code, self.place, self.item = self.code[order], self.place[order], self.item[order]
        self._filter()

    def keep(self, use: np.ndarray) -> None:
        self.code, self.place, self.item = self.code[use], self.place[use], self.item[use]
        self._filter()

    def _filter(self) -> None:
        """A bit table that tells almost all other pairs at once."""
        self.distinct = np.unique(self.code)
        bits = max(12, int(16 * max(1, len(self.distinct))).bit_length())
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.distinct >> self.shift] = True
        self.single = bool((self.length == 1).any())

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(codes, places) of the document's pairs that are among the seeds."""
        codes, places = [], []
        for apart in range(0 if self.single else 1, REACH + 1):
            code, at = pairs(words, apart)
            maybe = np.flatnonzero(self.table[code >> self.shift])
            code, at = code[maybe], at[maybe]
            hit = self.distinct[np.minimum(np.searchsorted(self.distinct, code), len(self.distinct) - 1)] == code
            codes.append(code[hit])
            places.append(at[hit])
        return np.concatenate(codes), np.concatenate(places)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each pair and the words [begin, end) of the text
    that it covers; all pairs advance together, one item word at a time.

    The gap cost is linear, so the best gap inside a row is a running maximum.
    """
    n, rows, columns = len(items), max(map(len, items)), max(map(len, texts))
    text, item = np.zeros((n, columns), U64), np.zeros((n, rows), U64)
    real, used = np.zeros((n, columns), bool), np.array([len(x) for x in items])
    for k in range(n):
        text[k, : len(texts[k])], real[k, : len(texts[k])] = texts[k], True
        item[k, : used[k]] = items[k]
    slope = np.arange(columns + 1) * GAP
    score = np.zeros((n, columns + 1), np.int32)
    begin = np.tile(np.arange(columns + 1), (n, 1))
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for r in range(rows):
        same = (text == item[:, r, None]) & real
        diagonal = score[:, :-1] + np.where(same, MATCH, -MISS)
        down = score[:, 1:] - GAP
        cell = np.zeros_like(score)
        cell[:, 1:] = np.maximum(np.maximum(diagonal, down), 0)
        start = np.tile(np.arange(columns + 1), (n, 1))
        start[:, 1:] = np.where(cell[:, 1:] == 0, start[:, 1:], np.where(diagonal >= down, begin[:, :-1], begin[:, 1:]))
        lifted = cell + slope
        source = np.where(lifted == np.maximum.accumulate(lifted, axis=1), np.arange(columns + 1), 0)
        source = np.maximum.accumulate(source, axis=1)
        across = np.take_along_axis(lifted, source, 1) - slope
        score, begin = np.maximum(across, 0), np.where(across > cell, np.take_along_axis(start, source, 1), start)
        score[used <= r] = 0
        top = score.argmax(1)
        better = score[every, top] > best
        best[better], first[better], last[better] = score[every, top][better], begin[every, top][better], top[better]
    return best, first, last


def _could_reach(words: np.ndarray, vocabulary: np.ndarray, score: float) -> bool:
    """Whether some stretch of ``words`` has so many words of the item, each
    counted as a match and every other word as a miss."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.where(vocabulary[at] == words, MATCH, -MISS), out=total[1:])
    return (total - np.minimum.accumulate(total)).max() >= score - 1e-9


def _regions(items: Items, code: np.ndarray, at: np.ndarray, words: Words, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, lo, hi): word ranges with as many seeds of one item as
    an alignment that reaches the threshold must have."""
    lo, hi = np.searchsorted(items.code, code, "left"), np.searchsorted(items.code, code, "right")
    many = hi - lo
    which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    if not len(which):
        return
    # A text place counts once for an item, in the order of item and place.
    pair = np.unique(items.item[which] * len(words.hash) + np.repeat(at, many))
    item, at = pair // len(words.hash), pair % len(words.hash)
    doc = words.doc[at]
    last = np.arange(len(at)) + items.need[item] - 1
    inside = last < len(at)
    last = np.minimum(last, len(at) - 1)
    # the most words of a text that such an alignment covers
    span = np.maximum(1, ((3 - 2 * threshold) * items.length[item] + 1e-9).astype(np.int64))
    first = np.flatnonzero(inside & (item[last] == item) & (doc[last] == doc) & (at[last] - at < span))
    if not len(first):
        return
    last, item, doc, span = last[first], item[first], doc[first], span[first]
    lo = np.maximum(words.first[doc], at[last] - span + 1)
    hi = np.minimum(words.first[doc + 1], at[first] + span)
    new = np.ones(len(first), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(first)) - 1
    for d, t, a, b, s in zip(doc[head].tolist(), item[head].tolist(), lo[head].tolist(), hi[tail].tolist(), span[head].tolist(), strict=True):
        score = threshold * MATCH * len(items.words[t])
        step = 4 * s + 64  # a long stretch of seeds is aligned in overlapping parts
        for p in range(a, max(a + 1, b - s), step):
            end = min(b, p + step + s)
            if _could_reach(words.hash[p:end], items.vocabulary[t], score):
                yield d, t, p, end


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of bounded size, read one after another."""
    ids, texts, held = [], [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = row[1].count(" ") + 1
        if held and held + n > ITEM_WORDS:
            yield Items(ids, pa.array(texts, pa.string()))
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += n
    if ids:
        yield Items(ids, pa.array(texts, pa.string()))


def _document_counts(texts: DataFrame, held) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        total = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in blocks(offsets):
                words = _Text(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                code, at = items.find(words)
                pair = np.unique(np.searchsorted(items.distinct, code) * (j - i) + words.doc[at])
                total += np.bincount(pair // (j - i), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.distinct[seen].view(np.int64)), pa.array(total[seen])], names=["code", "n"])

    found = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return found["code"].to_numpy().astype(np.int64).view(U64), found["n"].to_numpy()


def _rare(texts: DataFrame, items: Items, threshold: float) -> Items:
    """``items`` without the seeds of their most frequent places: half of those
    that an alignment must have can go, the other half is then certain."""
    code, n = _document_counts(texts, texts.sparkSession.sparkContext.broadcast(items))
    often = np.zeros(len(items.distinct), np.int64)
    often[np.searchsorted(items.distinct, code)] = n
    per = np.zeros(int(items.length.sum()), np.int64)
    np.maximum.at(per, items.place, often[np.searchsorted(items.distinct, items.code)])
    first, many = np.concatenate(([0], np.cumsum(items.length))), items.length > 1
    per[first[1:][many] - 1] = -1  # an item's last word begins no pair
    owner = np.repeat(np.arange(len(items.length)), items.length)
    order = np.lexsort((-per, owner))
    rank = np.empty(len(per), np.int64)
    rank[order] = np.arange(len(per)) - first[owner]
    needed = np.where(many, np.maximum(1, np.ceil(threshold * items.length - 1 - 1e-9)).astype(np.int64), 1)
    items.need = needed - needed // 2
    items.keep(rank[items.place] >= (needed // 2)[items.item])
    return items


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, start, end): the best alignment of each
    document and item whose similarity reaches ``threshold``; ``start`` and
    ``end`` are byte places in the document's text."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind, item_kind = base.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, similarity double, start long, end long"
    out = spark.createDataFrame([], schema)
    for items in _item_blocks(benchmark, item_col, item_text_col):
        if not len(items.code):
            continue
        items = _rare(base.select("text"), items, threshold)
        out = out.unionByName(base.mapInArrow(_finder(spark.sparkContext.broadcast(items), threshold), schema))
    return out


def _leaks(items: Items, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, start, end) of the best alignments in a batch."""
    raw, offsets = buffers(texts)
    for i, j in blocks(offsets):
        words = _Text(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        todo = sorted(_regions(items, *items.find(words), words, threshold), key=lambda r: r[3] - r[2])
        for k in range(0, len(todo), 64):
            some = todo[k : k + 64]
            score, first, last = align([items.words[t] for _, t, _, _ in some], [words.hash[lo:hi] for _, _, lo, hi in some])
            for (d, t, lo, _), s, a, b in zip(some, score.tolist(), first.tolist(), last.tolist(), strict=True):
                share = s / (MATCH * len(items.words[t]))
                if share >= threshold and share > best.get((d, t), (0,))[0]:
                    shift = int(offsets[i] - offsets[i + d])
                    best[d, t] = (share, int(words.start[lo + a]) + shift, int(words.end[lo + b - 1]) + shift)
        for (d, t), found in best.items():
            yield i + d, t, *found


def _finder(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        item_ids = pa.array(items.ids)
        for batch in batches:
            found = list(_leaks(items, batch.column(1), threshold))
            if found:
                d, t, share, a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), item_ids.take(pa.array(t)), pa.array(share), pa.array(a), pa.array(b)], names=["doc_id", "item_id", "similarity", "start", "end"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a copy of an
    item; a narrow filter."""
    spark = docs.sparkSession
    for items in _item_blocks(benchmark, item_col, item_text_col):
        if len(items.code):
            held = spark.sparkContext.broadcast(_rare(docs.select(F.col(text_col).alias("text")), items, threshold))
            docs = docs.mapInArrow(_dropper(held, threshold, docs.columns.index(text_col)), docs.schema)
    return docs


def _dropper(held, threshold: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for d, *_ in _leaks(held.value, batch.column(column), threshold):
                clean[d] = False
            yield batch.filter(pa.array(clean))

    return run

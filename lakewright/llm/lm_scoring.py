"""Cross-entropy difference scores from two matched n-gram models.

A target and a background bigram model are counted over whole texts. Both use
one vocabulary of V words (those of the corpus and the text's end) and the same
smoothing:

    p(w) = (c(w) + 1) / (N + V),   p(w | h) = (c(h, w) + M p(w)) / (c(h) + M).

Each token, and the end after the last one, has a loss (negative log2) in both
models; a document's score is the mean difference target - background, so
documents that are more like the target have lower scores. A text does not
judge itself: its own c(h, w), c(h) and c(w) are left out of the model that it
is part of (N stays), so that texts of the target and like texts outside it are
scored alike.

1. A bit filter of fixed size tells most texts at once to be of the background;
   those that pass it are joined with the target's ids. No other text is shuffled.
2. One pass counts the words; sums over the corpus, the number of distinct words
   and the ``HOT`` most frequent words go to the driver, so what it holds is of
   fixed size.
3. A second pass packs the distinct (word, word before) of each document, some
   megabytes of documents at a time, into buckets: by word, or by pair for the
   hot words, whose counts are sent along. So a bucket holds all that its counts
   need, and no word's pairs gather in one place. The number of buckets grows
   with the corpus. Each entry carries its document's own counts.
4. Each bucket sums its counts and gives each document its part of the losses;
   a task adds the parts of its buckets before it sends them, and they meet by
   block of documents.

The history's part of a loss, log2(c(h) + M), is summed where the history is the
word, as each word of a text is a history once. Keys are hashes: a word's of 48
bits inside its bucket, a word before of 40 bits inside the word.

Cases: null and empty texts have no tokens and null losses; null ids belong to
the background and pass through; repeated rows count and are scored each (a copy
of a text is no part of it, and counts); an empty target or background leaves the
uniform model; ids may be of any type; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, Words, bit_filter, blocks, buffers, filter_bit, mix, stored

PRIOR = 64.0  # M
START = U64(0x5EED)  # the history of a text's first word
END = U64(0xE7D)  # the word after a text's last
HOT = 4096
BUCKET = 500_000  # tokens of a bucket on average
GATHER = 4 << 20  # bytes of a block of documents; the larger, the fewer repeated keys
FILTER = 1 << 26  # bits of the filter
ROW = 8192  # entries of a packed row at the most, but for one word's
PARTS = 2_000_000  # documents whose parts a task adds up
WORD_BYTES, PAIR_BYTES = 6, 5  # of packed keys
SHORT = U64(16)  # bits that a packed word leaves out
_PLACE = np.random.default_rng(6).integers(0, 1 << 63, 2, dtype=np.uint64) * U64(2) + U64(1)


def _gathered(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """(id, text, target, bit) in batches of about ``GATHER`` bytes of text; rows
    whose bit is set are left to the table of those that were looked up."""
    held, size = [], 0
    for batch in batches:
        bit = batch.column(3).fill_null(-1).to_numpy()
        batch = batch.filter(pa.array((bit < 0) | ((wanted.value[bit >> 3] >> (bit & 7)) & 1 == 0)))
        if held and size + batch.column(1).nbytes > GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.column(1).nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Totals:
    """Sums over the corpus (first of the target, then of the background) and
    the hot words' counts in the order of their keys."""

    def __init__(self, events: list[int], texts: list[int], words: int, hot: list[tuple[int, int, int]]) -> None:
        self.events, self.texts, self.words = events, texts, words
        counts = {key: (target, background) for key, target, background in hot} | {int(END): tuple(texts)}
        keys = np.array(list(counts), np.int64).view(U64)
        order = np.argsort(keys)
        self.hot, self.count = keys[order], np.array(list(counts.values()), np.int64).reshape(-1, 2)[order].T
        self.short = self.hot >> SHORT
        self.buckets = max(1, -(-sum(events) // BUCKET))

    def places(self, word: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are hot, their places in the table)."""
        at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
        return keys[at] == word, at


def _count_words(texts: DataFrame, wanted: Broadcast, size: int | None) -> _Totals:
    names = ["word", "target", "background"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, wanted):
            raw, offsets = buffers(batch.column(1))
            own = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in blocks(offsets, GATHER):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, at = np.unique(words.hash, return_inverse=True)
                kinds = [np.append(np.bincount(at[use[words.doc]], minlength=len(key)), np.count_nonzero((words.count > 0) & use)) for use in (own[i:j], ~own[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(key, END).view(np.int64)), *map(pa.array, kinds)], names=names)

    counted = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).where("target + background > 0")
    seen = Observation()
    ends = F.col("word") == int(END)
    sums = [F.coalesce(F.sum(F.when(use, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k, use in enumerate((F.lit(True), ends)) for c in names[1:]]
    hot = counted.observe(seen, F.count("*").alias("words"), *sums).orderBy(F.desc(F.col("target") + F.col("background")), "word").limit(HOT).collect()
    s = seen.get
    return _Totals([s["target0"], s["background0"]], [s["target1"], s["background1"]], s["words"] if size is None else size, [tuple(r) for r in hot])


def _keys(x: np.ndarray, size: int) -> bytes:
    """The low bytes of keys."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _full(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _squeezed(arrays: list[np.ndarray]) -> bytes:
    """Some arrays of small integers, compressed together."""
    parts = [_small(x) for x in arrays]
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def _released(data: bytes, many: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    ends = 4 * many + np.cumsum(np.frombuffer(data, "<u4", many))
    return [_large(data[a:b]) for a, b in zip([4 * many, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_PACKED = ["word", "pair", "counts"]  # counts: pairs of a word, documents of a pair, and for each of these the document, n and m


def _events(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, document) of all tokens and ends."""
    full = np.flatnonzero(words.count)
    before_end = np.cumsum(words.count > 0) - 1
    at = np.arange(len(words.hash)) + before_end[words.doc]
    word, doc = np.full(len(words.hash) + len(full), END, U64), np.zeros(len(words.hash) + len(full), np.int64)
    word[at], doc[at] = words.hash, words.doc
    end = np.cumsum(words.count[full] + 1) - 1
    doc[end] = full
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[end - words.count[full]] = START
    return word, mix(before * _PLACE[0] + word * _PLACE[1]), doc


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of some sorted arrays changes."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _pack(words: Words, totals: _Totals) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, packed columns): words, the pairs of each word, the documents of
    each pair, and how often the document has the pair (n) and the word (m)."""
    word, pair, doc = _events(words)
    if not len(word):
        return
    _, at, own = np.unique(mix(word + doc.astype(U64) * _PLACE[1]), return_inverse=True, return_counts=True)
    own = own[at]
    hot, _ = totals.places(word, totals.hot)
    bucket = mix(np.where(hot, pair, word)) % U64(totals.buckets)
    word, pair = word >> SHORT, pair & U64((1 << 8 * PAIR_BYTES) - 1)
    minor = ((pair << SHORT) | doc.astype(U64),) if len(words.count) <= 1 << 16 else (doc, pair)
    order = np.lexsort((*minor, word, bucket))
    word, pair, doc, bucket, own = word[order], pair[order], doc[order], bucket[order].astype(np.int64), own[order]
    first = np.flatnonzero(_starts(bucket, word, pair, doc))
    n = np.diff(np.append(first, len(word)))
    word, pair, doc, bucket, own = (x[first] for x in (word, pair, doc, bucket, own))
    new_word = _starts(bucket, word)
    new_pair = new_word | _starts(pair)
    # a row ends with its bucket, or at the first new word when it is full
    heads = np.flatnonzero(new_word)
    full = _starts(heads // ROW) | _starts(bucket[heads])
    edges = np.append(heads[full], len(word)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        p, w = np.flatnonzero(new_pair[a:b]), np.flatnonzero(new_word[a:b])
        of_word = np.diff(np.append(np.searchsorted(p, w), len(p)))
        yield int(bucket[a]), [_keys(word[a:b][w], WORD_BYTES), _keys(pair[a:b][p], PAIR_BYTES), _squeezed([of_word, np.diff(np.append(p, b - a)), doc[a:b], n[a:b], own[a:b]])]


def _bucketer(held: Broadcast, wanted: Broadcast, id_kind: pa.DataType):
    names = ["block", "bucket", "target", "size", "ids", "n_tokens", *_PACKED]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(id_kind), pa.list_(pa.int64()), *[pa.binary()] * len(_PACKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, block = held.value, TaskContext.get().partitionId() << 32
        for batch, target in ((b.filter(pc.equal(b.column(2), t)), t) for b in _gathered(batches, wanted) for t in (False, True)):
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets, GATHER):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i).cast(id_kind))
                head = [[block], [block % totals.buckets], [target], [j - i], ids, [words.count.tolist()], *[[None]] * len(_PACKED)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(head, kinds, strict=True)], names=names)
                for bucket, columns in _pack(words, totals):
                    row = [block, bucket, target, j - i, None, None, *columns]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
                block += 1

    return run


def _losses(rows: list[dict], totals: _Totals) -> Iterator[tuple[dict, np.ndarray]]:
    """(row, (2, documents) parts of the losses) of the rows of one bucket."""
    counts = [_released(r["counts"], 5) for r in rows]
    size = [len(c[2]) for c in counts]
    target = np.repeat([r["target"] for r in rows], size)
    of_word, of_pair, doc, n, m = (np.concatenate(x) for x in zip(*counts, strict=True))
    words, at = np.unique(np.concatenate([_full(r["word"], WORD_BYTES) for r in rows]), return_inverse=True)
    at = np.repeat(at, of_word)
    at_word = np.repeat(at, of_pair)
    pair = np.concatenate([_full(r["pair"], PAIR_BYTES) for r in rows])
    at_pair = np.repeat(np.unique(mix(pair) + words[at] * _PLACE[0], return_inverse=True)[1], of_pair)
    is_hot, place = totals.places(words, totals.short)
    history = words != END >> SHORT
    loss = np.zeros((2, len(doc)))
    for model, mine in enumerate((target, ~target)):
        c, w = np.bincount(at_pair, n * mine), np.bincount(at_word, n * mine, len(words))
        w[is_hot] = totals.count[model][place[is_hot]]
        c, w = c[at_pair] - n * mine, w[at_word] - m * mine
        p = (w + 1.0) / (totals.events[model] + totals.words)
        loss[model] = n * (np.where(history[at_word], np.log2(w + PRIOR), 0) - np.log2(c + PRIOR * p))
    edges = np.concatenate(([0], np.cumsum(size))).tolist()
    for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
        yield r, np.array([np.bincount(doc[a:b], loss[model][a:b], r["size"]) for model in (0, 1)])


def _bucket_losses(held, schema: pa.Schema):
    """The losses' parts of a task's buckets; the rows that name a block's
    documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = held.value
        parts: dict[tuple[int, bool], np.ndarray] = {}
        rows: list[dict] = []

        def add() -> None:
            for r, part in _losses(rows, totals) if rows else ():
                key = (r["block"], r["target"])
                parts[key] = parts[key] + part if key in parts else part
            rows.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, target), part in parts.items():
                who = np.flatnonzero(part.any(0))
                row = [block, target, None, None, _small(who), part[:, who].astype("<f4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
            parts.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("ids")[k].is_valid:
                    one = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*(one.column(f.name).cast(f.type) if f.name in one.schema.names and f.name != "doc" else pa.nulls(1, f.type) for f in schema)], schema=schema)
                    continue
                row = {name: batch.column(name)[k].as_py() for name in ("block", "bucket", "target", "size", *_PACKED)}
                if rows and rows[-1]["bucket"] != row["bucket"]:
                    add()
                    if sum(x.shape[1] for x in parts.values()) > PARTS:
                        yield from flush()
                rows.append(row)
        add()
        yield from flush()

    return run


def _block_scores(held):
    def run(table: pa.Table) -> pa.Table:
        totals = held.value
        named = table.filter(table["ids"].is_valid())
        ids, count, target = named["ids"][0].values, np.array(named["n_tokens"][0].as_py(), np.int64), named["target"][0].as_py()
        own = np.array([target, not target])
        loss = np.tile(np.log2(np.maximum(0, np.array(totals.texts) - own) + PRIOR)[:, None], (1, len(count)))  # of START
        for doc, sums in zip(table["doc"].to_pylist(), table["loss"].to_pylist(), strict=True):
            if doc is not None:
                loss[:, _large(doc)] += np.frombuffer(sums, "<f4").reshape(2, -1)
        mean = loss / (count + 1)
        columns = [pa.array(v, mask=count == 0) for v in (*mean, mean[0] - mean[1])]
        return pa.table([ids, pa.array(count), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss (bits a token), score
    of all documents, with the documents of ``target_ids`` (one id column) as
    the target and all others as the background. ``vocabulary`` is V; None
    takes the number of distinct words of ``docs`` and the end."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType
    name = kind.simpleString()
    ids = target_ids.toDF("_target").select(F.col("_target").cast(kind)).where("_target is not null").distinct()
    wanted = bit_filter(ids, "_target", FILTER)
    placed = base.select("doc_id", "text", F.lit(False).alias("target"), filter_bit("doc_id", FILTER).alias("bit"))
    maybe = placed.mapInArrow(_passing(wanted), placed.schema).join(ids, F.col("doc_id") == F.col("_target"), "left")
    maybe = stored(maybe.select("doc_id", "text", F.col("_target").isNotNull().alias("target"), F.lit(None).cast("long").alias("bit")), "lm-texts")
    texts = placed.union(maybe)
    held = spark.sparkContext.broadcast(_count_words(texts, wanted, vocabulary))
    lists = f"ids array<{name}>, n_tokens array<long>"
    packed = texts.mapInArrow(_bucketer(held, wanted, to_arrow_type(kind)), f"block long, bucket long, target boolean, size int, {lists}, " + ", ".join(f"{c} binary" for c in _PACKED))
    schema = pa.schema([("block", pa.int64()), ("target", pa.bool_()), ("ids", pa.list_(to_arrow_type(kind))), ("n_tokens", pa.list_(pa.int64())), ("doc", pa.binary()), ("loss", pa.binary())])
    parts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_losses(held, schema), f"block long, target boolean, {lists}, doc binary, loss binary")
    return parts.groupBy("block").applyInArrow(_block_scores(held), f"doc_id {name}, n_tokens long, target_loss double, background_loss double, score double")


def _passing(wanted: Broadcast):
    """The rows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(3).to_numpy()
            yield batch.filter(pa.array((wanted.value[bit >> 3] >> (bit & 7)) & 1 == 1))

    return run

"""Document fingerprints by one-permutation MinHash.

1. Each distinct 5-word shingle is hashed once. The upper bits of a hash choose
   one of ``BINS`` bins, and every bin keeps its smallest hash.
2. An empty bin takes the value of the first full one in an order of its own, a
   random permutation that all texts share: each full bin is equally likely to
   be copied, independently for every empty bin (optimal densification), and the
   search ends for every text with a shingle.
3. Each value is hashed once more with its bin's number, so that the copies of
   one shingle agree by chance independently of each other; the ``BITS`` low bits
   of each bin are packed and written as hex digits.
4. Two fingerprints agree in a share p of their bins; values that differ still
   agree by chance with probability c = 2 ** -BITS, so the likeness, an estimate
   of the sets' Jaccard similarity, is (p - c) / (1 - c), and 0 where that is less.

``edited`` compares each document with the text that has its second half
replaced by the beginning of the next document. One range shuffle by id brings
neighbours together; a task streams through its documents and holds two of them.
The first and the last text of each partition are written beside the results,
and the pairs that lie across two partitions are finished from there.

Cases: null text is empty; texts without words have an empty fingerprint, which
is like (1) another empty one and unlike (0) all others; texts of 1 to 4 words
have their whole sequence as the one shingle; null ids come first; rows that
repeat an id follow one another by a hash of their texts; a single row is its
own next document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, blocks, buffers, mix, stored
from .near_dedup import shingle_sets

BINS, BITS = 256, 4
_SHIFT = U64(64 - (BINS - 1).bit_length())
_PLACE = U64(0x9E3779B97F4A7C15)
_ORDER = np.random.default_rng(12).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


class Fingerprints:
    """The bins of some texts: ``low``, (texts, BINS) low bits, and ``full``,
    whether a text has any shingle."""

    def __init__(self, low: np.ndarray, full: np.ndarray) -> None:
        self.low, self.full = low, full

    @classmethod
    def of(cls, texts: pa.Array) -> Fingerprints:
        raw, offsets = buffers(texts)
        low = np.zeros((len(texts), BINS), np.uint8)
        full = np.zeros(len(texts), bool)
        for i, j in blocks(offsets):
            low[i:j], full[i:j] = cls._bins(*shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        return cls(low, full)

    @staticmethod
    def _bins(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts) - 1
        owner = np.repeat(np.arange(n), np.diff(starts))
        place = owner * BINS + (values >> _SHIFT).astype(np.int64)
        least = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])  # a text's hashes ascend
        value, known = np.zeros(n * BINS, U64), np.zeros(n * BINS, bool)
        value[place[least]], known[place[least]] = values[least], True
        full = np.diff(starts) > 0
        empty = np.flatnonzero(~known & np.repeat(full, BINS))
        for turn in range(BINS):
            if not len(empty):
                break
            other = empty - empty % BINS + _ORDER[empty % BINS, turn]
            found = known[other]
            value[empty[found]] = value[other[found]]
            empty = empty[~found]
        low = mix(value.reshape(n, BINS) + np.arange(BINS, dtype=U64) * _PLACE) & U64((1 << BITS) - 1)
        return low.astype(np.uint8), full

    def take(self, which: slice) -> Fingerprints:
        return Fingerprints(self.low[which], self.full[which])

    def then(self, more: Fingerprints) -> Fingerprints:
        return Fingerprints(np.concatenate([self.low, more.low]), np.concatenate([self.full, more.full]))

    def packed(self) -> list[bytes]:
        bits = self.low[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8) & 1
        rows = np.packbits(bits.reshape(len(bits), BINS * BITS), axis=1)
        return [row.tobytes() if full else b"" for row, full in zip(rows, self.full, strict=True)]

    def likeness(self, other: Fingerprints) -> np.ndarray:
        chance = 2.0**-BITS
        share = (self.low == other.low).mean(axis=1) if len(self.low) else np.zeros(0)
        both = np.clip((share - chance) / (1 - chance), 0, 1)
        return np.where(self.full & other.full, both, (self.full == other.full).astype(float))


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def edit(text: str, following: str) -> str:
    """``text``, its second half replaced by as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(texts: list[str], following: list[str], own: Fingerprints, others: Fingerprints) -> list[pa.Array]:
    changed = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    edited = Fingerprints.of(pa.array(changed, pa.large_string()))
    sums = [hashlib.sha256(t.encode()).digest() for t in changed]
    columns = ([len(t) for t in texts], sums, own.packed(), edited.packed(), own.likeness(edited), own.likeness(others))
    return [pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.hex() for f in Fingerprints.of(batch.column(1)).packed()], pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: each document beside its edited text and the next one."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in _RESULT.split(", "))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of a partition in order; then one row about its edges."""
        opening = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = Fingerprints.of(batch.column(1))
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if held:
                ids, texts, own = pa.concat_arrays([held[0], ids]), held[1] + texts, held[2].then(own)
            else:
                opening = texts[0]
            n = len(texts) - 1
            done = _compared(texts[:-1], texts[1:], own.take(slice(0, n)), own.take(slice(1, n + 1)))
            yield _batch([ids.slice(0, n), *done, *(pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.string()))])
            held = ids.slice(n, 1), texts[-1:], own.take(slice(n, n + 1))
        if held:
            edge = (pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([opening], pa.string()), pa.array(held[1], pa.string()))
            yield _batch([held[0], *(pa.nulls(1, t) for t in _KINDS), *edge])

    def _batch(arrays: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "part", "opening", "closing"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (Fingerprints.of(batch.column(c)) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, other)], names=names)

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text, F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stored(rows.mapInArrow(walk, f"doc_id {kind}, {_RESULT}, part int, opening string, closing string"), "fingerprints")
    edges = found.where("part is not null").select("doc_id", "part", "opening", "closing")
    # the numbers of the partitions only: one row each
    ends = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = edges.drop("opening").join(ends, "part").join(edges.select(F.col("part").alias("next"), "opening"), "next")
    last = pairs.select("doc_id", "closing", "opening").mapInArrow(finish, f"doc_id {kind}, {_RESULT}")
    written = found.where("part is null").select(names).union(last)
    return written.select(*(F.lower(F.hex(c)).alias(c) if kind == "binary" else c for c, kind in written.dtypes))

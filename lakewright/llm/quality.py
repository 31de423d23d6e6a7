"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)):
all pairwise interactions in time linear in the number of features.

Features of a document: its words hashed to ``WORD_SLOTS`` slots, weighted so
that their squares sum to 1; structure statistics (shares of letters, digits,
capitals, punctuation and doubled punctuation, word length, shares of distinct,
most frequent, repeated and letterless words, words, lines) as one indicator
each of a fixed bin; and the metadata column ``n_chars`` as a binned logarithm.

Training: a bounded sample of labelled rows (``SAMPLE_ROWS``) is turned into
features once, written to the shared folder and dealt to ``SHARDS`` shards;
in each round every shard runs some epochs of AdaGrad from the common model and
the models are averaged. What reaches the driver is the models, whose size is
fixed. Scoring is a narrow map.

Cases: null and empty texts are scored by their (empty) statistics; null labels
and null ids teach nothing; several labels of one id are averaged; repeated
rows are scored each; extra columns are ignored; without any labelled row every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLOCK_BYTES, U64, Words, blocks, bounded_sample, buffers, mix, spread, stored

WORD_SLOTS = 1 << 13
RANK = 8
SAMPLE_ROWS = 16_000
SHARDS = 8
ROUNDS = 5
EPOCHS = 3  # of each shard in a round
BINS = 24
STATS = ("letters", "digits", "capitals", "marks", "doubled", "word_length", "distinct", "commonest", "repeated", "letterless", "words", "lines", "n_chars")
SIZE = WORD_SLOTS + BINS * len(STATS)

_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 white space, 3 mark
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 2


def features(raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, slots, values): the non-zero features of each document."""
    n = len(offsets) - 1
    words = Words(raw, offsets)
    doc, code, count = words.doc, words.hash, words.count
    by_kind, capitals, lines, doubled = np.zeros((n, 4)), np.zeros(n), np.zeros(n), np.zeros(n)
    letters_before = np.zeros(len(raw) + 1, np.int32)
    for a in range(0, len(raw), 4 * BLOCK_BYTES):
        b = min(len(raw), a + 4 * BLOCK_BYTES)
        owner = np.searchsorted(offsets, np.arange(a, b), "right") - 1 if n > 1 else np.zeros(b - a, np.int64)
        part = raw[a:b]
        kind = _KIND[part]
        by_kind += np.bincount(owner * 4 + kind, minlength=4 * n).reshape(n, 4)
        capitals += np.bincount(owner, (part >= 65) & (part <= 90), n)
        lines += np.bincount(owner, part == 10, n)
        doubled[:] += np.bincount(owner[1:], (kind[1:] == 3) & (kind[:-1] == 3), n)
        letters_before[a + 1 : b + 1] = letters_before[a] + np.cumsum(kind == 0)
    letterless = spread(letters_before[words.end] == letters_before[words.start], words.first)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    repeated = spread(same, words.first)
    order = np.lexsort((code, doc))
    doc_o, code_o = doc[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code_o[1:] != code_o[:-1]) | (doc_o[1:] != doc_o[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(code)))
    kinds = np.bincount(doc_o[at], minlength=n)
    kind_starts = np.concatenate(([0], np.cumsum(kinds)))
    most = spread(times, kind_starts, np.maximum)
    # words that share a slot are added up
    slot = (mix(code_o[at]) % U64(WORD_SLOTS)).astype(np.int64)
    pair, back = np.unique(doc_o[at] * WORD_SLOTS + slot, return_inverse=True)
    weight = np.log1p(np.bincount(back, times, len(pair)))
    owner, slot = pair // WORD_SLOTS, pair % WORD_SLOTS
    norm = np.sqrt(np.bincount(owner, weight * weight, n))
    weight = weight / np.maximum(norm[owner], 1e-9)
    size, tokens = np.maximum(1, np.diff(offsets)), np.maximum(1, count)
    share = lambda x, of: np.minimum(BINS - 1, (np.sqrt(x / of) * (BINS - 1)).astype(np.int64))
    power = lambda x: np.minimum(BINS - 1, np.log2(np.maximum(x, 0) + 1).astype(np.int64))
    bins = np.stack(
        [share(by_kind[:, 0], size), share(by_kind[:, 1], size), share(capitals, size), share(by_kind[:, 3], size), share(doubled, size)]
        + [np.minimum(BINS - 1, (by_kind[:, [0, 1, 3]].sum(1) / tokens).astype(np.int64)), share(kinds, tokens), share(most, tokens), share(repeated, tokens)]
        + [share(letterless, tokens), power(count), power(lines), power(n_chars)],
        axis=1,
    )
    k = len(STATS)
    slots = np.concatenate([slot, (WORD_SLOTS + np.arange(k) * BINS + bins).ravel()])
    values = np.concatenate([weight, np.full(n * k, 0.5)])
    owner = np.concatenate([owner, np.repeat(np.arange(n), k)])
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    return starts, slots[order], values[order]


class Machine:
    """Parameters and the linear-time score."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def fresh(cls, size: int = SIZE, rank: int = RANK) -> Machine:
        return cls(0.0, np.zeros(size), np.random.default_rng(7).normal(0, 0.05, (size, rank)))

    def raw(self, starts: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        vx = self.v[slots] * values[:, None]
        together = spread(vx, starts)
        own = spread((vx * vx).sum(1), starts)
        return self.w0 + spread(self.w[slots] * values, starts) + 0.5 * ((together * together).sum(1) - own)

    def score(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*x), -30, 30)))

    def epoch(self, starts: np.ndarray, slots: np.ndarray, values: np.ndarray, label: np.ndarray, rate: float = 0.3, decay: float = 1e-5, step: int = 32) -> Machine:
        """One pass of AdaGrad over the rows."""
        m = Machine(self.w0, self.w.copy(), self.v.copy())
        g0, gw, gv = 1.0, np.ones_like(m.w), np.ones_like(m.v)
        for a in range(0, len(label), step):
            b = min(len(label), a + step)
            lo, hi = starts[a], starts[b]
            s, x, st = slots[lo:hi], values[lo:hi], starts[a : b + 1] - lo
            owner = np.repeat(np.arange(b - a), np.diff(st))
            miss = (m.score(st, s, x) - label[a:b]) / (b - a)
            vx = m.v[s] * x[:, None]
            together = spread(vx, st)
            used, back = np.unique(s, return_inverse=True)
            dw, dv = np.zeros(len(used)), np.zeros((len(used), m.v.shape[1]))
            np.add.at(dw, back, miss[owner] * x)
            np.add.at(dv, back, (miss[owner] * x)[:, None] * (together[owner] - vx))
            dw, dv, d0 = dw + decay * m.w[used], dv + decay * m.v[used], miss.sum()
            dw, dv, d0 = dw * 4, dv * 4, d0 * 4
            g0, gw[used], gv[used] = g0 + d0 * d0, gw[used] + dw * dw, gv[used] + dv * dv
            m.w0 -= rate * d0 / np.sqrt(g0)
            m.w[used] -= rate * 4 * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
        return m


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, tuple[np.ndarray, ...]]]:
    """Blocks of (.., text, n_chars) batches with their features."""
    for batch in batches:
        raw, offsets = buffers(batch.column(batch.num_columns - 2))
        n_chars = batch.column(batch.num_columns - 1).fill_null(0).to_numpy()
        for i, j in blocks(offsets):
            yield batch, i, j, features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_chars[i:j])


def _inputs(docs: DataFrame, text_col: str, n_chars_col: str | None) -> list[Column]:
    size = F.col(n_chars_col) if n_chars_col and n_chars_col in docs.columns else F.length(text_col)
    return [F.col(text_col).alias("_text"), F.coalesce(size, F.length(text_col), F.lit(0)).cast("long").alias("_n_chars")]


def _learner(now: Broadcast, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Epochs over one shard, each in an order of its own."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "label"], ignore_index=True)
        m = now.value
        for e in range(EPOCHS):
            pdf = pdf.sample(frac=1, random_state=EPOCHS * k + e)
            starts = np.concatenate(([0], np.cumsum(pdf["slots"].map(len))))
            m = m.epoch(starts, np.concatenate(pdf["slots"].to_numpy()), np.concatenate(pdf["values"].to_numpy()), pdf["label"].to_numpy())
        packed = np.concatenate(([m.w0], m.w, m.v.ravel())).astype("<f4").tobytes()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "model": [packed]})

    return learn


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n_chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Machine | None:
    """A model from the labels of ids for which ``usable`` (over ``doc_id``) holds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null")
    known = known.where(usable).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known = bounded_sample(known, [], "doc_id", sample_rows)  # so its size for a broadcast is bounded
    rows = docs.select(F.col(id_col).alias("doc_id"), *_inputs(docs, text_col, n_chars_col)).join(F.broadcast(known), "doc_id")
    rows = rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit("order")).alias("place"), "_text", "_n_chars")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, (starts, slots, values) in _feature_rows(batches):
            own = [batch.column(c).slice(i, j - i) for c in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (slots.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([*own, *lists], names=["label", "shard", "place", "slots", "values"])

    table = stored(rows.mapInArrow(extract, "label int, shard int, place long, slots array<int>, values array<double>").repartition(SHARDS, "shard"), "features")
    spark, model = docs.sparkSession, Machine.fresh()
    if table.isEmpty():
        return None
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model)
        found = table.groupBy("shard").applyInPandas(_learner(now, k), "shard int, n long, model binary").toPandas().sort_values("shard")
        mean = np.average([np.frombuffer(x, "<f4").astype(float) for x in found["model"]], axis=0, weights=found["n"])
        model = Machine(float(mean[0]), mean[1 : SIZE + 1], mean[SIZE + 1 :].reshape(SIZE, -1))
        now.unpersist()
    return model


def score_quality(docs: DataFrame, model: Machine | None, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", keep: dict[str, Column] | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, the columns of ``keep``, score, predicted (score >= threshold)."""
    keep = keep or {}
    if not {"_text", "_n_chars", "score", "predicted"}.isdisjoint(keep):
        raise ValueError("keep has a name that score_quality() adds")
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keep.items()), *_inputs(docs, text_col, n_chars_col))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch, i, j, x in _feature_rows(batches):
            score = model.score(*x) if model else np.full(j - i, 0.5)
            own = [c.slice(i, j - i) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-2], "score", "predicted"])

    return base.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))

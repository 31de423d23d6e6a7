"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: counts of every byte after every
context of 0 to ``depth`` bytes. A byte costs -log2 of its share after the
longest context that the language has seen (escape method C: a context with n
followers of q kinds gives c / (n + q) to a follower and q / (n + q) to the
escape, which leads to the context one byte shorter, and at last to 8 bits for
any byte). Statistics are frozen: code lengths are sums over a text and do not
depend on its order of evaluation, so the trees are flattened into tables of
complete costs and a task scores whole blocks by table lookup.

Learning: the (depth + 1)-grams of a bounded sample of labelled texts are
counted inside the tasks, summed by key across them, and give the counts of all
shorter contexts as sums. The model's size is bounded by the sample.

Cases: ``lang_pred`` is ``und`` and ``score`` 0 for null texts, texts without a
letter, and if nothing could be learned; ties go to the first language in
alphabetical order; null languages teach nothing; repeated rows are scored
each; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLOCK_BYTES, U64, blocks, bounded_sample, buffers, spread

DEPTH = 4
SAMPLE_DOCS = 2000  # of each language, at most
PAD = 0x0A


def windows(raw: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, starts, documents): each byte with the ``depth`` bytes before it
    as one integer, the newest byte lowest. Texts begin after line feeds, and
    parts of a long text after the bytes before them."""
    for i, j in blocks(offsets):
        step = 4 * BLOCK_BYTES
        cuts = [(d, a, min(a + step, int(offsets[d + 1]))) for d in range(i, j) for a in range(int(offsets[d]), int(offsets[d + 1]), step)]
        for at in range(0, len(cuts), 1 if j - i == 1 else max(1, len(cuts))):
            some = cuts[at : at + (1 if j - i == 1 else len(cuts))]
            pieces = []
            for d, a, b in some:
                lead = raw[max(int(offsets[d]), a - depth) : a]
                pieces += [np.full(depth - len(lead), PAD, np.uint8), lead, raw[a:b]]
            text = np.concatenate(pieces).astype(U64)
            keys = text.copy()
            for k in range(1, depth + 1):
                keys[k:] |= text[:-k] << U64(8 * k)
            sizes = np.array([b - a for _, a, b in some])
            starts = np.concatenate(([0], np.cumsum(sizes)))
            place = np.arange(starts[-1]) + np.repeat(np.arange(1, len(some) + 1) * depth, sizes)
            yield keys[place], starts, np.array([d for d, _, _ in some])


def count_windows(docs: DataFrame, lang: str, text: str, depth: int) -> DataFrame:
    """(lang, key, n) over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            raw, offsets = buffers(batch.column(1))
            for keys, starts, which in windows(raw, offsets, depth):
                owner = np.repeat(names[which], np.diff(starts))
                for name in set(names[which]):
                    held[name].append(np.unique(keys[owner == name], return_counts=True))
                    if len(held[name]) >= 16:
                        held[name] = [merged(held[name])]
        for name, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    counted = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


class ContextTrees:
    """Cost tables: ``cost[k][l]`` bits of each (k + 1)-gram of ``grams[k]`` in
    language l, ``escape[k][l]`` bits for leaving each context of ``contexts[k]``."""

    def __init__(self, counts: pd.DataFrame, depth: int) -> None:
        self.langs = sorted(set(counts["lang"]))
        self.depth = depth
        self.grams, self.cost, self.contexts, self.escape = [], [], [], []
        own = {x: (g["key"].to_numpy().astype(U64), g["n"].to_numpy()) for x, g in counts.groupby("lang")}
        for k in range(depth + 1):
            below = U64((1 << 8 * (k + 1)) - 1)
            seen = [merged([(own[x][0] & below, own[x][1])]) for x in self.langs]
            grams = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, U64)
            contexts = np.unique(grams >> U64(8))
            shorter = np.searchsorted(self.grams[k - 1], grams & U64((1 << 8 * k) - 1)) if k else None
            cost = np.empty((len(self.langs), len(grams)))
            escape = np.zeros((len(self.langs), len(contexts)))
            for i, (keys, n) in enumerate(seen):
                own_context, back = np.unique(keys >> U64(8), return_inverse=True)
                followers, kinds = np.bincount(back, n), np.bincount(back)
                place = np.searchsorted(contexts, own_context)
                escape[i, place] = np.log2((followers + kinds) / kinds)
                fallback = self.cost[k - 1][i][shorter] if k else np.full(len(grams), 8.0)
                cost[i] = fallback + escape[i][np.searchsorted(contexts, grams >> U64(8))]
                cost[i, np.searchsorted(grams, keys)] = np.log2((followers + kinds)[back] / n)
            self.grams.append(grams)
            self.contexts.append(contexts)
            self.cost.append(cost)
            self.escape.append(escape)
        self._index()

    def _index(self) -> None:
        """A direct index of the longest grams; what it misses is searched."""
        top = self.grams[-1]
        bits = max(4, int(4 * max(1, len(top))).bit_length())
        self.shift = U64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[self._hash(top)] = np.arange(len(top), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each run of windows in each language."""
        total = np.zeros((len(starts) - 1, len(self.langs)))
        row = self.slot[self._hash(keys)]
        missed = np.flatnonzero(self.grams[-1][row] != keys)
        found, rest = self._search(self.depth, keys[missed])
        row[missed[found]] = rest
        gone = np.ones(len(missed), bool)
        gone[found] = False
        gone = missed[gone]
        late = self._late(keys[gone])
        for i in range(len(self.langs)):
            one = self.cost[-1][i][row]
            one[gone] = late[:, i]
            total[:, i] = spread(one, starts)
        return total

    def _search(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams[k], keys), len(self.grams[k]) - 1)
        hit = np.flatnonzero(self.grams[k][at] == keys)
        return hit, at[hit]

    def _late(self, keys: np.ndarray) -> np.ndarray:
        """Costs of windows that no language has seen at full length."""
        out = np.zeros((len(keys), len(self.langs)))
        left = np.arange(len(keys))
        for k in range(self.depth, -1, -1):
            keys = keys & U64((1 << 8 * (k + 1)) - 1)
            hit, at = self._search(k, keys)
            out[left[hit]] += self.cost[k][:, at].T
            stay = np.ones(len(left), bool)
            stay[hit] = False
            left, keys = left[stay], keys[stay]
            context = np.minimum(np.searchsorted(self.contexts[k], keys >> U64(8)), len(self.contexts[k]) - 1)
            known = np.flatnonzero(self.contexts[k][context] == keys >> U64(8))
            out[left[known]] += self.escape[k][:, context[known]].T
        out[left] += 8.0
        return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id", depth: int = DEPTH, sample_docs: int = SAMPLE_DOCS) -> ContextTrees | None:
    some = bounded_sample(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), [lang], order, sample_docs)
    counts = count_windows(some, lang, text, depth).toPandas()
    return ContextTrees(counts, depth) if len(counts) else None


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred, score (posterior of the
    predicted language under equal priors), bits_per_byte."""
    keep = keep or {}
    if not {"_text", "lang_pred", "score", "bits_per_byte"}.isdisjoint(keep):
        raise ValueError("keep has a name that identify() adds")
    held = docs.sparkSession.sparkContext.broadcast(trees)
    base = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keep.items()), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            n = batch.num_rows
            text = batch.column(batch.num_columns - 1)
            raw, offsets = buffers(text)
            total = np.zeros((n, len(trees.langs) if trees else 1))
            for keys, starts, which in windows(raw, offsets, trees.depth) if trees else ():
                np.add.at(total, which, trees.bits(keys, starts))
            best = total.argmin(1)
            least = total[np.arange(n), best]
            score = 1 / np.exp2(np.minimum(0, least[:, None] - total)).sum(1)
            good = text.is_valid().to_numpy(zero_copy_only=False) & (trees is not None)
            names = np.array(trees.langs if trees else ["und"], object)[best]
            names[~good] = "und"
            size = np.maximum(1, np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(good, score, 0.0)), pa.array(np.where(good, least / size, 0.0))],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"],
            )

    return base.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "bits_per_byte double"]))

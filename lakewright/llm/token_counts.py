"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbol
ids. In each step every sequence finds its lowest-rank adjacent pair, and all
occurrences of that pair in all sequences are merged at once; sequences without
a mergeable pair leave the array with their number of surviving symbols. A
merge can only make pairs of higher rank than its own, so merging all
occurrences of the lowest pair together equals merging them one by one.

The map over documents is narrow: no shuffle, and the memory of a task depends
on its batch and on a bounded word cache, not on the table.

Cases: null and empty texts have 0 tokens; repeated rows each give a row; an
empty table gives an empty result; columns other than the id and the text are
ignored, whatever their names; a null id is passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Vocabulary, byte_symbols, parts, pre_tokens

NONE = np.iinfo(np.int32).max
CACHE_WORDS = 300_000
GATHER_BYTES = 1 << 20


class RankMerger:
    def __init__(self, vocabulary: Vocabulary) -> None:
        stands = byte_symbols()
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in stands.items():
            self.of_byte[byte] = vocabulary.ids[char]
        ids = vocabulary.ids
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in vocabulary.merges), strict=True))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each word."""
        n = len(words)
        out = np.zeros(n, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        which = np.flatnonzero(sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = sizes[which]
        made_by_rank = np.zeros(len(self.keys), np.int64)
        made_by_rank[self.ranks] = self.made
        rank = np.full(len(symbol), NONE, np.int32)
        if len(symbol) > 1:
            rank[:-1] = self._ranks(symbol[:-1], symbol[1:])
        rank[np.cumsum(sizes) - 1] = NONE  # no pair reaches into the next word
        while len(which):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                out[which[done]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbol, rank, which, sizes, least = symbol[stay], rank[stay], which[~done], sizes[~done], least[~done]
                if not len(which):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of touching occurrences (a run of one symbol) every second is taken
            fresh = np.concatenate(([True], np.diff(hit) != 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = made_by_rank[rank[hit]]
            last = rank[hit + 1] == NONE
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            word = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes) - 1
            last &= hit + 1 == ends[word[hit]]
            sizes = sizes - np.bincount(word[hit], minlength=len(sizes))
            moved = np.cumsum(keep) - 1
            symbol, rank, word, hit = symbol[keep], rank[keep], word[keep], moved[hit]
            rank[hit] = NONE
            inner = hit[~last]
            rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
            before = hit[hit > 0] - 1
            before = before[word[before] == word[before + 1]]
            rank[before] = self._ranks(symbol[before], symbol[before + 1])
        return out


class Counter:
    def __init__(self, content: str) -> None:
        self.vocabulary = Vocabulary(content)
        self.merger = RankMerger(self.vocabulary)
        self.known: dict[str, int] = {}

    def _count(self, pieces: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        new = list({w for _, words in pieces for w in words if w not in self.known})
        known = self.known
        if len(known) + len(new) > CACHE_WORDS:  # only speed depends on what is kept
            known = self.known = {}
            new = list({w for _, words in pieces for w in words})
        known.update(zip(new, self.merger.counts([w.encode() for w in new]).tolist(), strict=True))
        for i, words in pieces:
            out[i] += sum(map(known.__getitem__, words))

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held, size = [], 0
        for i, text in enumerate(texts):
            for section, special in self.vocabulary.sections(text or ""):
                for part in parts(section):
                    held.append((i, pre_tokens(part)))
                    size += len(part)
                    if size > GATHER_BYTES:
                        self._count(held, out)
                        held, size = [], 0
                out[i] += special >= 0
        self._count(held, out)
        return out


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens`` without
    begin, end or added special tokens, ``over_limit`` (n_tokens > limit)."""
    with open(tokenizer_json, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content.value)
        for batch in batches:
            n = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), size.alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

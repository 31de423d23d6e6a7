"""Exact BM25 top-k by block-max WAND over sharded inverted indexes.

Index: every task deals the documents that it reads into ``CLUSTERS`` groups of
similar ones (k-means on the most frequent words of its first documents) and
closes a group as a segment at ``SHARD_DOCS`` documents or ``SHARD_POSTINGS``
postings, so that segments are large and of alike documents. In a segment they
lie from the longest to the shortest, so that neighbours have alike bounds.
A segment is one row of a Parquet table: sorted term codes, posting lists
(document, term frequency) in term order, and document lengths. Texts are not
shuffled, and every document is indexed.

Queries are a table too: their words are joined with the document frequencies
summed over all shards (global statistics), and they are searched in blocks of
bounded size, each block against every segment.

Search of a segment, for many queries at once:

* a query's threshold is the k-th best score that it has found so far; it rises
  with every segment, is carried over the segments of a task, and begins at a
  value that all shards share: the k-th best over the longest documents of some
  segments (one in ``LEAD_SHARE``, ``LEAD_DOCS`` of each), which a first pass scores;
* a segment is skipped where the sum of the terms' largest impacts does not
  reach the threshold;
* postings of words with short lists are read whole, from tables of lists of
  about one length; those of the others (words that are frequent in the segment
  and among the ``DENSE_TERMS`` most frequent ones of the queries) stand in a
  matrix with one row for each document. A block of ``BLOCK_DOCS`` documents is
  bounded by the sum of its frequent words' block maxima and the largest sum of
  the others; blocks are visited in order, and one that does not reach the
  threshold is skipped. So the pivot moves from block to block, for all queries
  together;
* the matrix is multiplied in 32-bit floats, whose error is bounded (``NEAR``);
  pairs that can reach the threshold are scored again in 64 bits, and scores that
  reach it enter the k best.

Only rows that reach the shared threshold leave a task; they are merged by
score and id. Scores are rounded to six places, and equal scores are ordered by
id, so that the result does not depend on the sharding.

score(q, d) = sum over the query's words of
    ln(1 + (N - n + 0.5) / (n + 0.5)) * tf (K1 + 1) / (tf + K1 (1 - B + B dl / avgdl)).

Cases: ids are integers; null and empty texts are indexed with length 0 and
found by nothing; a query without words has no results; null ids are indexed
and can be results (last among equals), but are no queries; repeated documents
are results each, and queries that repeat an id are one query with all their
words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Words, blocks, buffers, need_integers, spread, stored

K1, B = 1.2, 0.75
TEXT_BYTES = 1 << 18  # of texts that are counted at once
SHARD_DOCS = 4096
SHARD_POSTINGS = 500_000
CLUSTERS, CLUSTER_TERMS, CLUSTER_ROUNDS, CLUSTER_POSTINGS = 6, 256, 6, 400_000
BLOCK_DOCS = 128
DENSE_TERMS, DENSE_SHARE = 1024, 16  # at most so many words, each in 1/16 of a segment's documents at least
QUERY_TERMS, QUERY_BLOCK = 1_500_000, 4096  # of a block of queries on average
CHUNK, CELLS, PAIRS = 512, 1 << 18, 1024  # queries that are bounded at once, scores that lie side by side, pairs that are scored anew at once
LEAD_SHARDS, LEAD_SHARE, LEAD_DOCS = 96, 8, 64
NO_ID = np.iinfo(np.int64).max
SLACK = 2e-6  # rounding to six places
NEAR = 1 + 2e-4  # a sum of DENSE_TERMS products of 32-bit floats is off by DENSE_TERMS / 2**24 of itself at the most
WIDTHS = np.array([*range(1, 8), *(w << e for e in range(14) for w in (8, 10, 12, 14))])  # of tables of posting lists
_SEGMENT = "shard long, ids binary, lengths binary, terms binary, sizes binary, docs binary, tfs binary"


def term_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, document lengths, row, term, tf) of blocks of texts."""
    raw, offsets = buffers(texts)
    for i, j in blocks(offsets, TEXT_BYTES):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        order = np.lexsort((words.hash, words.doc))
        doc, term = words.doc[order], words.hash[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        yield i, words.count, doc[at], term[at], np.diff(np.append(at, len(doc)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range of each."""
    many = hi - lo
    owner = np.repeat(np.arange(len(lo)), many)
    return np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many), owner


class Clusters:
    """Centers of documents by their frequent words. They decide which documents
    lie together, and so how much can be skipped, not what is found."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray) -> None:
        kinds, size = np.unique(term, return_counts=True)
        self.terms = np.sort(kinds[np.argsort(-size, kind="stable")[:CLUSTER_TERMS]])
        x = self._vectors(n, row, term)
        rng = np.random.default_rng(5)
        self.centers = x[:1]
        for _ in range(CLUSTERS - 1):
            far = np.maximum(0, 1 - (x @ self.centers.T).max(1)).astype(float) ** 2
            if far.sum() <= 0:
                break
            self.centers = np.vstack((self.centers, x[rng.choice(n, p=far / far.sum())]))
        for _ in range(CLUSTER_ROUNDS):
            own = (x @ self.centers.T).argmax(1)
            sums = np.array([x[own == c].sum(0) for c in range(len(self.centers))])
            self.centers = sums / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True))

    def _vectors(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(self.terms)), np.float32)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            use = self.terms[at] == term
            x[row[use], at[use]] = 1
        return x / np.maximum(1e-6, np.sqrt(x.sum(1, keepdims=True)))

    def of(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        return (self._vectors(n, row, term) @ self.centers.T).argmax(1)


class Group:
    """Documents that will be one segment."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.postings = 0

    def add(self, ids: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((ids, length, (row + self.docs).astype(np.uint16), term, tf.astype(np.int32)))
        self.docs += len(ids)
        self.postings += len(term)

    def segment(self, shard: int) -> pa.RecordBatch:
        ids, length, row, term, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts.clear()
        docs = np.argsort(-length, kind="stable")
        place = np.empty(len(ids), np.uint16)
        place[docs] = np.arange(len(ids))
        order = np.lexsort((place[row], term))
        term = term[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        kinds, size = term[first], np.diff(np.append(first, len(term)))
        columns = (ids[docs].astype("<i8"), length[docs].astype("<i4"), kinds.astype("<u8"), size.astype("<i4"), place[row[order]].astype("<u2"), tf[order].astype("<i4"))
        return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in _SEGMENT.split(", ")])


def segments(batches: Iterator[pa.RecordBatch], shard: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's (id, text) rows, numbered from ``shard`` on. The
    clusters are those of its first documents."""

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for i, count, doc, term, tf in term_counts(batch.column(1)):
                yield batch.column(0).slice(i, len(count)).to_numpy(), count, doc, term, tf

    parts = parts()
    first = Group()
    while first.postings < CLUSTER_POSTINGS and first.docs < shard_docs and (part := next(parts, None)):
        first.add(*part)
    if not first.parts:
        return
    whole = tuple(np.concatenate(x) for x in zip(*first.parts, strict=True))
    clusters = Clusters(first.docs, *whole[2:4])
    groups = [Group() for _ in clusters.centers]
    del first
    for ids, length, row, term, tf in chain([whole], parts):
        own = clusters.of(len(ids), row, term).astype(np.uint8)
        docs = np.argsort(own, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[docs] = np.arange(len(ids))
        order = np.argsort(own[row], kind="stable")
        row, term, tf = place[row[order]], term[order], tf[order]
        edge = np.searchsorted(own[docs], np.arange(len(groups) + 1))
        cut = np.searchsorted(row, edge)
        for c, group in enumerate(groups):
            new, entries = docs[edge[c] : edge[c + 1]], slice(cut[c], cut[c + 1])
            if not len(new):
                continue
            if group.docs and (group.docs + len(new) > shard_docs or group.postings + cut[c + 1] - cut[c] > SHARD_POSTINGS):
                yield group.segment(shard)
                shard += 1
                group = groups[c] = Group()
            group.add(ids[new], length[new], row[entries] - edge[c], term[entries], tf[entries])
    for group in groups:
        if group.docs:
            yield group.segment(shard)
            shard += 1


class Segment:
    """One segment's postings, opened for search; ``head`` limits it to its
    first documents."""

    def __init__(self, row: dict, average: float, block_docs: int = BLOCK_DOCS, head: int | None = None) -> None:
        part = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, length = part("ids", "<i8")[:head], part("lengths", "<i4")[:head]
        self.terms, size = part("terms", "<u8"), part("sizes", "<i4").astype(np.int64)
        docs, tf = part("docs", "<u2"), part("tfs", "<i4")
        if head is not None:
            use = docs < head
            size = spread(use, np.concatenate(([0], np.cumsum(size))))
            docs, tf = docs[use], tf[use]
        norm = K1 * (1 - B + B * length / max(average, 1e-9))
        self.n, self.size = len(self.ids), size
        self.docs, self.impact = docs.astype(np.int64), tf * (K1 + 1) / (tf + norm[docs])
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.most = spread(self.impact, self.first, np.maximum)  # a term's largest impact
        self.edges = np.append(np.arange(0, self.n, block_docs), self.n)

    def search(self, queries: Queries, best: Best) -> None:
        """Offer ``best`` all documents that can be among the k best."""
        if not len(self.docs) or not len(queries.terms):
            return
        here = self._meet(queries)
        most = np.zeros(queries.matrix.shape[1])
        most[self.columns] = self.block_most.max(axis=0)
        found, batch = [], max(CELLS // self.n, 32)
        for q in range(0, len(queries.ids), CHUNK):
            many = min(CHUNK, len(queries.ids) - q)
            part = slice(queries.first[q], queries.first[q + many])
            term = here[queries.term[part]]
            have = np.flatnonzero(term >= 0)
            term, owner, weight = term[have], queries.owner[part][have] - q, queries.weight[part][have]
            bound = np.bincount(owner, weight * self.most[term], many) + queries.matrix[q : q + many] @ most
            alive = np.flatnonzero((bound > 0) & (bound * NEAR >= best.least[q : q + many] - SLACK))
            begin = np.searchsorted(owner, np.arange(many + 1))
            for i in range(0, len(alive), batch):
                some = alive[i : i + batch]
                entry, who = _ranges(begin[some], begin[some + 1])
                found.append(self._batch(queries, q + some, self._rest(len(some), who, term[entry], weight[entry]), best.least[q + some] - SLACK, best.k))
        if found:
            best.offer(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _meet(self, queries: Queries) -> np.ndarray:
        """Make columns of the words that are frequent here and in the queries.
        The place of each other word of the queries among the segment's words, or -1."""
        at = np.minimum(np.searchsorted(queries.terms, self.terms), len(queries.terms) - 1)
        have = np.flatnonzero((queries.terms[at] == self.terms) & (self.size > 0))
        here = np.full(len(queries.terms), -1, np.int32)
        here[queries.number[at[have]]] = have
        term = here[: queries.matrix.shape[1]]
        self.columns = np.flatnonzero((term >= 0) & (self.size[term] * DENSE_SHARE >= self.n))
        term = term[self.columns]
        here[self.columns] = -1
        place, column = _ranges(self.first[term], self.first[term + 1])
        self.matrix = np.zeros((self.n, len(term)))
        self.matrix[self.docs[place], column] = self.impact[place]
        self.single = self.matrix.astype(np.float32)
        self.block_most = np.maximum.reduceat(self.single, self.edges[:-1], axis=0)
        self._lists(here[here >= 0])
        return here

    def _lists(self, term: np.ndarray) -> None:
        """Lay the posting lists of ``term`` out as tables of lists of about one length."""
        width = np.searchsorted(WIDTHS, self.size[term])
        self.kind, self.row, self.tables = np.zeros(len(self.size), np.int8), np.zeros(len(self.size), np.int64), {}
        for k in np.unique(width).tolist():
            own = term[width == k]
            self.kind[own], self.row[own] = k, np.arange(len(own))
            docs, impact = np.zeros((len(own), WIDTHS[k]), np.int64), np.zeros((len(own), WIDTHS[k]))
            place, row = _ranges(self.first[own], self.first[own + 1])
            column = place - self.first[own][row]
            docs[row, column], impact[row, column] = self.docs[place], self.impact[place]
            self.tables[k] = docs, impact

    def _rest(self, many: int, who: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of all documents from the words that are no columns."""
        kind = self.kind[term]
        order = np.argsort(kind, kind="stable")
        row, base, weight = self.row[term[order]], who[order] * self.n, weight[order]
        edge = np.searchsorted(kind[order], np.arange(len(WIDTHS) + 1))
        end = np.concatenate(([0], np.cumsum(np.diff(edge) * WIDTHS)))
        cell, value = np.empty(end[-1], np.int64), np.empty(end[-1])
        for k, (docs, impact) in self.tables.items():
            part, to = slice(edge[k], edge[k + 1]), slice(end[k], end[k + 1])
            if end[k] < end[k + 1]:
                own = cell[to].reshape(-1, WIDTHS[k])
                docs.take(row[part], axis=0, out=own, mode="clip")
                own += base[part, None]
                own = value[to].reshape(-1, WIDTHS[k])
                impact.take(row[part], axis=0, out=own, mode="clip")
                own *= weight[part, None]
        return np.bincount(cell, value, many * self.n).astype(float, copy=False).reshape(many, self.n)

    def _batch(self, queries: Queries, some: np.ndarray, rest: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document's id, score) of the pairs that can reach a query's threshold."""
        w = queries.matrix[np.ix_(some, self.columns)]
        single = w.astype(np.float32)
        bound = single @ self.block_most.T + np.maximum.reduceat(rest, self.edges[:-1], axis=1)
        bound = np.where(bound > 0, bound * NEAR, -np.inf)
        pairs = [(np.zeros(0, np.int64),) * 2]
        for b, (lo, hi) in enumerate(pairwise(self.edges.tolist())):
            live = np.flatnonzero(bound[:, b] >= least)
            if len(live):
                score = (single[live] @ self.single[lo:hi].T + rest[live, lo:hi]) * NEAR
                row = np.flatnonzero(score.max(axis=1) >= least[live])
                score = score[row]
                if 0 < k < hi - lo:  # that many documents have a score of at least this
                    least[live[row]] = np.maximum(least[live[row]], np.partition(score, -k, axis=1)[:, -k] / NEAR**2 - SLACK)
                q, d = np.nonzero((score > 0) & (score >= least[live[row], None]))
                pairs.append((live[row[q]], d + lo))
        q, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
        score = rest[q, d]
        for i in range(0, len(q), PAIRS):
            part = slice(i, i + PAIRS)
            score[part] += np.einsum("ij,ij->i", w[q[part]], self.matrix[d[part]])
        return some[q], self.ids[d], score


class Queries:
    """A block of queries: distinct terms, and (query, term, weight) in the
    order of the queries; terms are numbered from the most frequent one on."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.ids = table["query_id"].to_numpy()
        lists = table["terms"].combine_chunks()
        many = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        self.first = np.concatenate(([0], np.cumsum(many)))
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), many)
        self.terms, term, size = np.unique(flat.field("term").to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True, return_counts=True)
        self.number = np.empty(len(size), np.int32)
        self.number[np.argsort(-size, kind="stable")] = np.arange(len(size))
        self.term = self.number[term]
        self.weight = flat.field("weight").to_numpy(zero_copy_only=False)

    def open(self) -> Queries:
        """With a matrix of the weights of the most frequent terms, which each worker makes itself."""
        if not hasattr(self, "matrix"):
            use = np.flatnonzero(self.term < DENSE_TERMS)
            self.matrix = np.zeros((len(self.ids), min(DENSE_TERMS, len(self.terms))))
            self.matrix[self.owner[use], self.term[use]] = self.weight[use]
        return self


class Best:
    """The k best scores of each query and the documents that reach them."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least = k, least.copy()
        self.top = np.zeros((len(least), k))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 6)
        use = np.flatnonzero((score > 0) & (score >= self.least[query] - SLACK))
        if not len(use):
            return
        query, ids, score = query[use], ids[use], score[use]
        self.found.append((query, ids, score))
        order = np.lexsort((-score, query))
        rows, first, row = np.unique(query[order], return_index=True, return_inverse=True)
        rank = np.arange(len(row)) - first[row]
        use = np.flatnonzero(rank < self.k)
        both = np.zeros((len(rows), 2 * self.k))
        both[:, : self.k] = self.top[rows]
        both[row[use], self.k + rank[use]] = score[order[use]]
        both.partition(self.k, axis=1)
        self.top[rows] = both[:, self.k :]
        self.least[rows] = np.maximum(self.least[rows], both[:, self.k])
        if sum(len(x[0]) for x in self.found[-64:]) > 1 << 20:
            self.found = [self.result()]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), at most k of each query."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, doc, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        begin = np.searchsorted(query, query)
        use = (np.arange(len(query)) - begin < self.k) & (score >= self.least[query] - SLACK)
        return query[use], doc[use], score[use]


class Index:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> None:
        self.block_docs = block_docs
        need_integers(docs, id_col)
        base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            return segments(batches, TaskContext.get().partitionId() << 32, shard_docs)

        self.table = stored(base.mapInArrow(build, _SEGMENT), "index")
        total = self.table.select(F.expr("length(ids) div 8").alias("n"), F.col("lengths")).mapInArrow(_sizes, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
        self.n, self.words = (x or 0 for x in total)
        order, lead = F.xxhash64("shard"), max(LEAD_SHARDS, self.table.count() // LEAD_SHARE)
        last = self.table.select(order.alias("o")).orderBy("o").limit(lead).agg(F.max("o")).first()[0]
        self.lead = self.table.where(order <= F.lit(last))

    def frequencies(self) -> DataFrame:
        """(term, n): in how many documents each term occurs."""
        return self.table.select("terms", "sizes").mapInArrow(_list_sizes, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))

    def queries(self, queries: DataFrame) -> DataFrame:
        """(block, query_id, terms) of (id, text) rows, with the terms' weights."""
        terms = queries.mapInArrow(_query_terms, "query_id long, term long, tf long").groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))
        weight = F.log1p((F.lit(self.n) - F.col("n") + 0.5) / (F.col("n") + 0.5)) * F.col("tf")
        rows = terms.join(self.frequencies(), "term").select("query_id", F.struct("term", weight.alias("weight")).alias("t"))
        return stored(rows.groupBy("query_id").agg(F.collect_list("t").alias("terms")), "queries")

    def top(self, block: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score) of a block of queries, before the merge."""
        spark = self.table.sparkSession
        queries = Queries(block.select("query_id", "terms").toArrow())
        if not len(queries.ids):
            return spark.createDataFrame([], "query_id long, doc_id long, score double")
        start = np.zeros(len(queries.ids))
        held = spark.sparkContext.broadcast((queries, start))
        lead = self._search(self.lead, held, k, LEAD_DOCS).groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("least")).where("least is not null").toArrow()
        place = np.argsort(queries.ids)
        start[place[np.searchsorted(queries.ids[place], lead["query_id"].to_numpy())]] = lead["least"].to_numpy()
        held.destroy()
        held = spark.sparkContext.broadcast((queries, start))
        found = stored(self._search(self.table, held, k), "top")
        held.destroy()
        return found

    def _search(self, table: DataFrame, held, k: int, head: int | None = None) -> DataFrame:
        average, block_docs = self.words / max(1, self.n), self.block_docs

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, start = held.value
            queries, best = queries.open(), Best(start, k)
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {name: batch.column(name)[r].as_buffer() for name in batch.schema.names if name != "shard"}
                    Segment(row, average, block_docs, head).search(queries, best)
            q, doc, score = best.result()
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(doc, mask=doc == NO_ID), pa.array(score)], names=["query_id", "doc_id", "score"])

        return table.mapInArrow(search, "query_id long, doc_id long, score double")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [int(np.frombuffer(x, "<i4").sum()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64())], names=["n", "words"])


def _list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(np.frombuffer(sizes, "<i4").astype(np.int64))], names=["term", "n"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, count, doc, term, tf in term_counts(batch.column(1)):
            ids = batch.column(0).slice(i, len(count)).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(term.view(np.int64)), pa.array(tf)], names=["query_id", "term", "tf"])


def search_all(docs: DataFrame, is_query: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of all rows for
    each row of ``docs`` for which ``is_query`` holds."""
    index = Index(docs, id_col, text_col, shard_docs, block_docs)
    queries = docs.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    queries = index.queries(queries)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    n_blocks = max(1, -(-size["terms"] // QUERY_TERMS), -(-size["n"] // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    found = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for b in range(n_blocks):
        found = found.unionByName(index.top(queries.where(block == b), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

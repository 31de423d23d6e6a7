"""A lexical index that is built once, grows by what is new, and answers many
queries in one pass.

``segments`` holds up to ``SEGMENT_DOCS`` documents a row, column by column: ids
and lengths, and for each distinct word (by a 64-bit hash) its documents, counts
and what bounds its score there, the largest count and the shortest document.
Documents are cut where they lie; nothing but the words' counts is shuffled. A
file holds ``FILE_SEGMENTS`` of them, so that a task that reads segments needs the
same memory however large the index is.

A query is scored against a segment as a product of sparse matrices inside a
task, which keeps the k best of each query. Segments meet queries in blocks of
bounded size, so that no (query, document) pair is a row; a segment whose bound
lies below a query's k-th best so far is not read for it.

Every build writes its own folders and then one row of ``manifest``, the commit;
only builds named there are read. A build over the same files as the last does
nothing. Otherwise (id, digest) pairs say which documents are new, and only they
are added; a document that is gone or changed has the index built anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokens
from ..sources.sinks import shared_path, shared_root

# BM25 constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
SEGMENT_DOCS, SEGMENT_WORDS = 1024, 1 << 20
FILE_SEGMENTS = 4  # of one file, as Spark's reader lays out all rows of a file at once
BLOCK_TERMS, BLOCK_QUERIES = 200_000, 1024
PRODUCTS = 1 << 22  # numbers that are multiplied at once
BATCH_BYTES = 8 << 20  # of an Arrow batch; a longer row stands alone

_MANIFEST = "build string, seq int, source string, docs long, words long, n_terms long, n_postings long, mean_idf double"


class MissingIndex(FileNotFoundError):
    """There is no lexical index at a path: it has to be built first."""


def source_print(df: DataFrame) -> str | None:
    """What ``df`` is read from and how: its plan and its files with their sizes
    and times; None if it isn't read from files."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    spark, parts = df.sparkSession, [str(df.semanticHash())]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for f in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        parts.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def bounded_batches(spark: SparkSession) -> None:
    """Words and segments reach Python in batches of bounded size: a batch is held
    whole as long as a part of it is in use."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


class LexicalIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        try:
            self.builds = sorted(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: r["seq"])
        except AnalysisException as e:
            raise MissingIndex(f"no lexical index at {path}; build it first") from e
        if not self.builds:
            raise MissingIndex(f"no lexical index at {path}; build it first")
        self.spark, self.path = spark, path
        read = lambda name: spark.read.parquet(*dict.fromkeys(f"{path}/{name}/{b['build']}" for b in self.builds))
        self.segments, self.contents = read("segments"), read("contents")
        self.terms = read("terms").groupBy("h").agg(F.sum("n").alias("n"))
        self.last = self.builds[-1]

    @property
    def stats(self) -> DataFrame:
        """One row: docs, avgdl, mean_idf, n_terms, n_postings."""
        s = self.last
        row = (s["docs"], s["words"] / s["docs"] if s["docs"] else None, s["mean_idf"], s["n_terms"], s["n_postings"])
        return self.spark.createDataFrame([row], "docs long, avgdl double, mean_idf double, n_terms long, n_postings long")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", force: bool = False) -> LexicalIndex:
        """Bring the index at ``path`` up to ``docs`` and open it. Without a path,
        there is one index for each source in the session's shared folder."""
        spark, source = docs.sparkSession, source_print(docs)
        path = path or (f"{shared_root(spark)}/lexical-index-{source}" if source else shared_path(spark, "lexical-index"))
        old: LexicalIndex | None = None
        try:
            old = None if force else cls(spark, path)
        except MissingIndex:
            pass
        if old and source and old.last["source"] == source:
            return old
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
        if old:
            same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
            if not old.contents.join(rows, same(old.contents, rows), "left_anti").isEmpty():
                old = None
            else:
                rows = rows.join(old.contents, same(rows, old.contents), "left_anti")
        if old is None:
            cls._delete(spark, f"{path}/manifest")
        cls._add(rows, path, source, old)
        return cls(spark, path)

    @staticmethod
    def _delete(spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    @classmethod
    def _add(cls, rows: DataFrame, path: str, source: str | None, old: LexicalIndex | None) -> None:
        """Write one build, and commit it."""
        spark, build = rows.sparkSession, uuid.uuid4().hex
        bounded_batches(spark)
        kind = rows.schema["doc_id"].dataType.simpleString()
        hashed = F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w))
        schema = f"n int, words long, ids array<{kind}>, digests array<string>, lengths array<int>, terms array<long>, starts array<int>, owners array<int>, counts array<int>, peaks array<int>, shortest array<int>"
        rows.select("doc_id", "digest", hashed.alias("w")).mapInArrow(_segments(), schema).write.option("maxRecordsPerFile", FILE_SEGMENTS).parquet(f"{path}/segments/{build}")
        segments = spark.read.parquet(f"{path}/segments/{build}")
        added = segments.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        if not added["n"] and old:  # nothing but another state of the files
            row = (old.last["build"], old.last["seq"] + 1, source, *(old.last[c] for c in ("docs", "words", "n_terms", "n_postings", "mean_idf")))
        else:
            segments.select(F.explode(F.arrays_zip("ids", "digests")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.digests").alias("digest")).write.parquet(f"{path}/contents/{build}")
            found = F.expr("transform(terms, (h, i) -> struct(h, starts[i + 1] - starts[i] as n))")
            segments.select(F.explode(found).alias("x")).select("x.*").groupBy("h").agg(F.sum("n").alias("n")).write.parquet(f"{path}/terms/{build}")
            docs = (added["n"] or 0) + (old.last["docs"] if old else 0)
            terms = spark.read.parquet(f"{path}/terms/{build}")
            terms = terms.union(old.terms).groupBy("h").agg(F.sum("n").alias("n")) if old else terms
            s = terms.agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.avg(_idf(F.lit(docs))).alias("mean")).first()
            row = (build, old.last["seq"] + 1 if old else 0, source, docs, (added["words"] or 0) + (old.last["words"] if old else 0), s["terms"], s["postings"] or 0, s["mean"])
        columns = (F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(row, _MANIFEST.split(", "), strict=True))
        spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    def _wanted(self, queries: DataFrame) -> DataFrame:
        words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        return words.groupBy("query_id", F.xxhash64("term").alias("h")).agg(F.count("*").alias("qtf"))

    def bm25(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries (query_id, text). The idf
        of terms in more than half of the documents is replaced by EPSILON times
        the mean idf; a repeated query word counts again; documents that share
        no word have score 0 and fill up by id."""
        docs = F.lit(self.last["docs"])
        weight = F.when(_idf(docs) < 0, F.lit(self.last["mean_idf"]) * EPSILON).otherwise(_idf(docs))
        weighted = self._wanted(queries).join(self.terms, "h").select("query_id", "h", (weight * F.col("qtf")).alias("w"))
        return self._best(queries, weighted, k, plain=False)

    def overlap(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Documents by the number of distinct query words that they hold."""
        return self._best(queries, self._wanted(queries).select("query_id", "h", F.lit(1.0).alias("w")), k, plain=True)

    def _best(self, queries: DataFrame, weights: DataFrame, k: int, plain: bool) -> DataFrame:
        bounded_batches(self.spark)
        every = queries.select("query_id").distinct()
        each = weights.groupBy("query_id").agg(F.collect_list(F.struct("h", "w")).alias("t"))
        n, terms = queries.agg(F.count("*"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0))).first()  # as many at most
        parts = max(1, -(-terms // BLOCK_TERMS), -(-n // BLOCK_QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("block")
        blocks = every.join(each, "query_id", "left").groupBy(block).agg(F.collect_list(F.struct("query_id", "t")).alias("asked")).repartition(min(parts, 64))
        kinds = queries.schema["query_id"].dataType, self.segments.schema["ids"].dataType.elementType
        avgdl = self.last["words"] / self.last["docs"] if self.last["docs"] else 1.0
        columns = ("ids", "lengths", "terms", "starts", "owners", "counts", "peaks", "shortest")
        pairs = self.segments.select(*columns).crossJoin(blocks)  # a stated query set, in blocks
        found = pairs.mapInArrow(_scored(k, plain, avgdl or 1.0), f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double")
        return ranked(found, "query_id", k)


def _idf(docs):
    return F.log(docs - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)


def ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each group, by score and then id."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "rank", "doc_id", "score")


def _segments():
    most_docs, most_words = SEGMENT_DOCS, SEGMENT_WORDS

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
        words = batch.column(2)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int32)
        owner, term = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), words.flatten().to_numpy()
        order = np.argsort(term, kind="stable")  # owners ascend
        owner, term = owner[order], term[order]
        del words, order
        new = np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))[: len(term)]
        head = np.flatnonzero(new)
        counts = np.diff(np.append(head, len(term)))
        owner, term = owner[head], term[head]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        peaks, shortest = (op.reduceat(x, first) if len(first) else x for op, x in ((np.maximum, counts), (np.minimum, lengths[owner])))
        columns = {
            "n": pa.array([len(lengths)], pa.int32()),
            "words": pa.array([int(lengths.sum())], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), batch.column(0)),
            "digests": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), batch.column(1)),
            "lengths": lists(lengths),
            "terms": lists(term[first].astype(np.int64)),
            "starts": lists(np.append(first, len(term)).astype(np.int32)),
            "owners": lists(owner.astype(np.int32)),
            "counts": lists(counts.astype(np.int32)),
            "peaks": lists(peaks.astype(np.int32)),
            "shortest": lists(shortest.astype(np.int32)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = [], 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at : at + most_docs - docs]), most_words - words, "right")
                taken = max(int(room), 0 if held else 1)
                if taken:
                    held.append(batch.slice(at, taken))
                    docs, words, at = docs + taken, words + int(sizes[at : at + taken].sum()), at + taken
                if docs >= most_docs or words >= most_words or not taken or at < batch.num_rows:
                    yield one(held)
                    docs, words = 0, 0
        if held:
            yield one(held)

    return run


def _scored(k: int, plain: bool, avgdl: float):
    products, k1, b = PRODUCTS, K1, B

    class Asked:
        """A block of queries, its terms sorted; and the best of each so far."""

        def __init__(self, rows: pa.StructArray) -> None:
            self.names, t = rows.field("query_id"), rows.field("t")
            sizes = pc.fill_null(pc.list_value_length(t), 0).to_numpy()
            flat = t.flatten()
            h, w, q = flat.field("h").to_numpy(), flat.field("w").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(h, kind="stable")
            self.h, self.w, self.q = h[order], w[order], q[order]
            self.first = np.flatnonzero(np.append(True, self.h[1:] != self.h[:-1])[: len(h)])
            self.many = np.diff(np.append(self.first, len(h)))
            self.terms = self.h[self.first]
            self.best: tuple[np.ndarray, np.ndarray] | None = None  # (k, queries) scores and ids

        def least(self) -> np.ndarray:
            """What a document must reach for each query."""
            if self.best is None or len(self.best[0]) < k:
                return np.full(len(self.names), -np.inf)
            return self.best[0][-1]

        def meet(self, s: dict[str, np.ndarray]) -> None:
            n, width = len(s["lengths"]), len(self.names)
            at = np.searchsorted(s["terms"], self.terms)
            hit = np.flatnonzero(s["terms"][np.minimum(at, len(s["terms"]) - 1)] == self.terms) if len(s["terms"]) else np.zeros(0, np.int64)
            at = at[hit]
            gain = lambda tf, dl: np.ones(len(tf)) if plain else tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            entry, many = self.spans(self.first[hit], self.many[hit])
            most = np.repeat(gain(s["peaks"][at], s["shortest"][at]), many)
            bound = np.bincount(self.q[entry], np.maximum(self.w[entry], 0) * most, minlength=width)
            alive = bound + 1e-6 >= self.least()
            if not alive.any():
                return
            scores = np.zeros(n * width)
            sizes = s["starts"][at + 1] - s["starts"][at]
            for i, j in self.chunks(sizes * self.many[hit]):
                post, many = self.spans(s["starts"][at[i:j]], sizes[i:j])
                term = np.repeat(hit[i:j], sizes[i:j])
                owner = s["owners"][post]
                value = gain(s["counts"][post], s["lengths"][owner])
                entry, many = self.spans(self.first[term], self.many[term])
                scores += np.bincount(np.repeat(owner, many) * width + self.q[entry], np.repeat(value, many) * self.w[entry], minlength=n * width)
            scores = np.round(scores.reshape(n, width), 6) + 0.0
            scores[:, ~alive] = -np.inf
            top = np.argsort(-scores, axis=0, kind="stable")[:k]  # ids ascend within a segment
            found = np.take_along_axis(scores, top, 0), s["ids"][top]
            if self.best is not None:
                found = tuple(np.concatenate(x) for x in zip(self.best, found, strict=True))
                order = np.lexsort((found[1], -found[0]), axis=0)[:k]
                found = tuple(np.take_along_axis(x, order, 0) for x in found)
            self.best = found

        @staticmethod
        def spans(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """start[i], start[i] + 1, ... (many[i] of them) one after another."""
            return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum()), many

        @staticmethod
        def chunks(cost: np.ndarray) -> Iterator[tuple[int, int]]:
            total, i = np.cumsum(cost), 0
            while i < len(cost):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + products, "right")))
                yield i, j
                i = j

    def keys(ids: pa.Array) -> np.ndarray:
        """Ids as numbers or texts that sort as they do, a null before all."""
        if pa.types.is_integer(ids.type):
            return pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        return np.array(["" if x is None else f"={x}" for x in ids.to_pylist()])

    def ids_of(found: np.ndarray, kind: pa.DataType) -> pa.Array:
        if pa.types.is_integer(kind):
            return pa.array(found, mask=found == np.iinfo(np.int64).min).cast(kind)
        return pa.array([x[1:] if x else None for x in found.tolist()], pa.string()).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Asked] = {}
        kind = None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            kind = column["ids"].type.value_type
            for r in range(batch.num_rows):
                block = column["block"][r].as_py()
                if block not in blocks:
                    blocks[block] = Asked(column["asked"][r].values)
                s = {c: column[c][r].values.to_numpy(zero_copy_only=False) for c in ("lengths", "terms", "starts", "owners", "counts", "peaks", "shortest")}
                s["ids"] = keys(column["ids"][r].values)
                if len(s["lengths"]):
                    blocks[block].meet(s)
        for asked in blocks.values():
            if asked.best is None:
                continue
            scores, ids = asked.best
            keep = scores > (0 if plain else -np.inf)
            rank, query = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(query)), ids_of(ids[rank, query], kind), pa.array(scores[rank, query])], names=["query_id", "doc_id", "score"])

    return run

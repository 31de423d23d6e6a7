"""A stored collection of vectors with exact search.

Vectors are put into cells around centres, which k-means finds on a bounded
sample (``SAMPLE`` vectors by a hash of their ids; every vector is indexed), and
lie in pages of one cell each with a centre and a radius of their own. For a
query q and a page, q . x <= q . centre + |q| * radius holds for each of its
vectors, so a page whose bound is below a query's k-th best so far can't change
the answer and is not multiplied. Results are those of brute force.

Pages meet queries in blocks of bounded size in one plan; tasks keep the k best
of each query, and no pair is a row. How much the bounds save depends on the
data: ``share_read`` says it.

Cases: null vectors are left out; rows that repeat an id are found each; without
vectors or queries the result is empty; all vectors have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import shared_path, shared_root
from .lexical import ranked, source_print

SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
PAGE_VECTORS = 512
BLOCK_QUERIES = 1024


class MissingVectors(FileNotFoundError):
    """There is no vector collection at a path: it has to be built first."""


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly chosen vectors on; empty cells keep their centre."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        many = np.bincount(own, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[many > 0] = total[many > 0] / many[many > 0, None]
    return centres


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        try:
            self.about = spark.read.parquet(f"{path}/about").first()
        except AnalysisException as e:
            raise MissingVectors(f"no vector collection at {path}; build it first") from e
        self.spark, self.pages = spark, spark.read.parquet(f"{path}/pages")

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, force: bool = False) -> VectorIndex:
        """Write the collection of (doc_id, v) unless the one at ``path`` is of
        the same source, and open it; what is written last says that it is whole."""
        spark, source = vectors.sparkSession, source_print(vectors)
        path = path or (f"{shared_root(spark)}/vectors-{source}" if source else shared_path(spark, "vectors"))
        if not force:
            try:
                old = cls(spark, path)
                if source and old.about["source"] == source:
                    return old
            except MissingVectors:
                pass
        rows = vectors.select("doc_id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
        n = rows.count()
        share = F.lit(min(1.0, SAMPLE / max(n, 1)))
        kept = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20) < share
        sample = np.array([r[0] for r in rows.where(kept).select("v").limit(2 * SAMPLE).collect()])
        cells = max(1, min(MOST_CELLS, math.isqrt(n), len(sample)))
        centres = centres_of(sample, cells) if len(sample) else np.zeros((1, 1))
        kind = rows.schema["doc_id"].dataType.simpleString()
        put = rows.mapInArrow(_placed(centres), f"cell int, doc_id {kind}, v array<double>")
        pages = put.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (cells * PAGE_VECTORS * 64))))).sortWithinPartitions("cell", "doc_id")
        schema = f"cell int, n int, ids array<{kind}>, flat array<double>, centre array<double>, radius double"
        pages.mapInArrow(_paged(PAGE_VECTORS), schema).write.mode("overwrite").parquet(f"{path}/pages")
        spark.range(1).select(F.lit(source).cast("string").alias("source"), F.lit(n).cast("long").alias("n"), F.lit(cells).alias("cells")).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score): the k largest products of each query (query_id, q)."""
        kinds = queries.schema["query_id"].dataType.simpleString(), self.pages.schema["ids"].dataType.elementType.simpleString()
        found = self._pairs(queries).mapInArrow(_searched(k, report=False), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
        return ranked(found, "query_id", k)

    def share_read(self, queries: DataFrame, k: int = 10) -> float:
        """The share of all (query, vector) products that a search computes."""
        got = self._pairs(queries).mapInArrow(_searched(k, report=True), "read long, total long").agg(F.sum("read"), F.sum("total")).first()
        return (got[0] or 0) / (got[1] or 1)

    def _pairs(self, queries: DataFrame) -> DataFrame:
        parts = max(1, -(-queries.count() // BLOCK_QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("block")
        asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
        blocks = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "q")).alias("asked")).repartition(min(parts, 64))
        return self.pages.select("ids", "flat", "centre", "radius").crossJoin(blocks)  # a stated query set, in blocks


def _placed(centres: np.ndarray):
    half = (centres**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = np.argmax(flat @ centres.T - half, axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "doc_id", "v"])

    return run


def _paged(most: int):
    def page(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        centre = flat.mean(axis=0)
        radius = float(np.sqrt(((flat - centre) ** 2).sum(axis=1).max()))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [batch.column(0).slice(0, 1), pa.array([batch.num_rows], pa.int32()), one(batch.column(1)), one(pa.array(flat.ravel())), one(pa.array(centre)), pa.array([radius])]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "n", "ids", "flat", "centre", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, most):
                    yield page(batch.slice(at, min(most, b - at)))

    return run


def _searched(k: int, report: bool):
    class Asked:
        def __init__(self, rows: pa.StructArray) -> None:
            self.names = rows.field("query_id")
            self.q = rows.field("q").flatten().to_numpy().reshape(len(self.names), -1)
            self.length = np.sqrt((self.q**2).sum(axis=1))
            self.found: tuple | None = None  # query, score, id of the k best of each
            self.least = np.full(len(self.names), -np.inf)

        def meet(self, ids: np.ndarray, flat: np.ndarray, bound: np.ndarray) -> int:
            live = np.flatnonzero(bound + 1e-6 >= self.least)
            if not len(live):
                return 0
            scores = np.round(self.q[live] @ flat.T, 6) + 0.0
            least = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
            row, at = np.nonzero(scores >= np.maximum(least, self.least[live])[:, None])
            new = (live[row], scores[row, at], ids[at])
            query, score, doc = new if self.found is None else (np.concatenate(x) for x in zip(self.found, new, strict=True))
            order = np.lexsort((doc, -score, query))
            query, score, doc = query[order], score[order], doc[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            use = place < k
            self.found = query[use], score[use], doc[use]
            last = place == k - 1
            self.least[query[last]] = score[last]
            return len(live) * len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Asked] = {}
        read = total = 0
        kind = None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            kind = column["ids"].type.value_type
            waiting = []
            for r in range(batch.num_rows):
                block = column["block"][r].as_py()
                asked = blocks.setdefault(block, None) or Asked(column["asked"][r].values)
                blocks[block] = asked
                bound = asked.q @ column["centre"][r].values.to_numpy() + asked.length * column["radius"][r].as_py()
                waiting.append((-bound.mean(), r, asked, bound))
            for _, r, asked, bound in sorted(waiting, key=lambda w: w[:2]):  # near ones first
                ids = column["ids"][r].values.to_numpy(zero_copy_only=False)
                read += asked.meet(ids, column["flat"][r].values.to_numpy().reshape(len(ids), -1), bound)
                total += len(ids) * len(asked.names)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([total], pa.int64())], names=["read", "total"])
            return
        for asked in blocks.values():
            if asked.found is not None:
                query, score, doc = asked.found
                yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(query)), pa.array(doc.tolist(), kind), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run

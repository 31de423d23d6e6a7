"""Dense retrieval, fusion of ranked lists and their measures; lexical search is in ``lexical``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import stored
from .lexical import LexicalIndex, MissingIndex, ranked

# Fixed value: the fusion constant.
RRF_K = 60
BLOCK_VALUES = 4_000_000  # numbers of a block of query vectors
BATCH_ROWS, BATCH_QUERIES = 4096, 512  # whose products lie side by side


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine search of unit vectors: (query_id, rank, doc_id, score) for
    vectors (doc_id, v) and a stated set of queries (query_id, q). Queries go to
    the vectors in blocks of fixed size; tasks multiply blocks and keep the k
    best of each query, so that no pair is ever a row."""
    n, width = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    parts = max(1, -(-n * (width or 1) // BLOCK_VALUES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    kind, other = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "doc_id")))
    schema = f"query_id {kind}, doc_id {other}, score double"
    found = []
    for b in range(parts):
        some = queries.where(block == b).select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow().combine_chunks()
        if len(some):
            held = vectors.sparkSession.sparkContext.broadcast((some["query_id"].combine_chunks(), np.array(some["q"].to_pylist())))
            found.append(vectors.select("doc_id", F.col("v").cast("array<double>").alias("v")).where("v is not null").mapInArrow(_best(held, k), schema))
    return ranked(reduce(DataFrame.unionByName, found), "query_id", k) if found else queries.sparkSession.createDataFrame([], f"query_id {kind}, rank int, doc_id {other}, score double")


def _best(held, k: int):
    batch_rows, batch_queries = BATCH_ROWS, BATCH_QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = held.value
        found = [(np.zeros(0, np.int64), np.zeros(0), None) for _ in range(0, len(names), batch_queries)]
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                ids, matrix = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy().reshape(len(part), -1)
                for b, (query, score, doc) in enumerate(found):
                    own = np.round(asked[b * batch_queries : (b + 1) * batch_queries] @ matrix.T, 6)
                    least = np.partition(own, -min(k, own.shape[1]), axis=1)[:, -min(k, own.shape[1])]
                    q, d = np.nonzero(own >= least[:, None])  # ties stay until the ids decide
                    query, score = np.concatenate([query, q]), np.concatenate([score, own[q, d]])
                    doc = ids[d] if doc is None else np.concatenate([doc, ids[d]])
                    order = np.lexsort((doc, -score, query))
                    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
                    found[b] = (query[order], score[order], doc[order])
        for b, (query, score, doc) in enumerate(found):
            if doc is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query + b * batch_queries)), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run


def fuse(lists: dict[str, DataFrame], by: str = "query_id", k: int = 7) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; keeps each list's own rank."""
    tagged = [df.select(by, "doc_id", "rank", F.lit(name).alias("src")) for name, df in lists.items()]
    own = [F.max(F.when(F.col("src") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    score = F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score")
    fused = reduce(DataFrame.unionByName, tagged).groupBy(by, "doc_id").agg(score, *own)
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("doc_id"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "rank", "doc_id", "score", *(f"{name}_rank" for name in lists))


def with_payload(hits: DataFrame, payload: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits with the columns of ``payload`` merged in by id; a hit without one
    keeps its ranks. Hits are stored, so that Spark knows how few they are before
    it reads the payload, of which only what a hit names is shuffled then."""
    hits = stored(hits, "hits")
    return hits.join(payload.join(hits.select(id_col), id_col, "left_semi"), id_col, "left")


# Rows of a table, lines without content, and the marks around words.
NUMBERED_ROW, RULE_LINE, MARKS = r"^\s*\d+\s*[—-]", r"^[\s|:-]+$", r"^[.,;:—-]+|[.,;:—-]+$"
SNIPPET = 180


def snippet(text: Column, question: Column) -> Column:
    """The line of a passage that shares most words with a question, the first of
    equals. The passage's first line is its heading and is left out where there
    are more; numbered rows come before all others, and rules come last. Words of
    more than three letters meet where one holds the other."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    body = F.when(F.size(lines) > 1, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    rows, plain = F.filter(body, lambda x: x.rlike(NUMBERED_ROW)), F.filter(body, lambda x: ~x.rlike(RULE_LINE))
    lines = F.when(F.size(rows) > 0, rows).when(F.size(plain) > 0, plain).otherwise(body)
    bare = lambda w: F.lower(F.regexp_replace(w, MARKS, ""))
    asked = F.transform(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) > 3), bare)

    def shared(line: Column) -> Column:
        own = F.filter(F.transform(F.split(line, r"\s+"), bare), lambda w: F.length(w) > 3)
        return F.aggregate(asked, F.lit(0), lambda n, q: n + F.size(F.filter(own, lambda w: F.contains(w, q) | F.contains(q, w))))

    best = F.array_min(F.transform(lines, lambda x, i: F.struct((-shared(x)).alias("less"), i.alias("place"), x.alias("line"))))
    return F.substring(F.coalesce(best["line"], text), 1, SNIPPET)


def context_blocks(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, context): the hits of each query as one text in the order of their
    ranks, each under a line that names its document, page and section. Hits:
    by, rank, doc, page, section, text; an empty section shows as '-'."""
    section = F.when(F.coalesce("section", F.lit("")) == "", "-").otherwise(F.col("section"))
    # fixed value: the head of a passage
    one = F.format_string("--- doc: %s | page: %s | section: %s ---\n%s\n", F.col("doc").cast("string"), F.col("page").cast("string"), section, F.coalesce("text", F.lit("")))
    each = hits.select(by, F.struct("rank", one.alias("block")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return each.select(by, F.array_join("x.block", "\n").alias("context"))


def eval_means(cases: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, mean, n) over cases (route, expected_route, metrics): cases that
    took another route are not scored, and nulls do not count."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")
    scored = cases.where("route = expected_route").select(each).select("x.*")
    return scored.groupBy("metric").agg(F.round(F.avg("value"), 3).alias("mean"), F.count("value").alias("n"))


def context_recall(retrieved: DataFrame, relevant: DataFrame, by: str = "query_id") -> DataFrame:
    """Share of relevant items found; 1 where nothing is relevant."""
    wanted = relevant.select(by, "doc_id").distinct()
    hit = wanted.join(retrieved.select(by, "doc_id").distinct().withColumn("hit", F.lit(1)), [by, "doc_id"], "left")
    share = hit.groupBy(by).agg((F.count("hit") / F.count("*")).alias("recall"))
    return retrieved.select(by).distinct().join(share, by, "left").select(by, F.round(F.coalesce("recall", F.lit(1.0)), 6).alias("recall"))


def context_precision(retrieved: DataFrame, relevant: DataFrame, by: str = "query_id") -> DataFrame:
    """Mean of precision at the ranks of hits; repeats count each; 0 without."""
    wanted = relevant.select(by, "doc_id").distinct().withColumn("hit", F.lit(1))
    marked = retrieved.join(wanted, [by, "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("p", F.when(F.col("hit") == 1, F.sum("hit").over(w) / F.col("rank")))
    return marked.groupBy(by).agg(F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 6).alias("precision"))

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and hands the reread table to the next one.
All stages but the last return the columns that they were given.

Cases, for all stages: a null or empty text is a document like any other, but
where a stage says so; extra columns pass through, whatever their names; rows
with a null id pass through near-dedup; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewright.llm.common import held_out, prepare, release, stored, table, written
from lakewright.llm.decontamination import drop_leaks
from lakewright.llm.near_dedup import keep_one
from lakewright.llm.packing import pack_documents
from lakewright.llm.quality import score_quality, train
from lakewright.llm.queries import tokenizer_path
from lakewright.llm.suffix_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 10) does not reject. An
    empty text has a score too, and goes or stays by it; repeated rows are
    scored each. Without labels nothing is learned and nothing goes."""
    prepare(spark)
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = score_quality(docs, model, keep={"_row": F.struct(*(F.col(c) for c in docs.columns))})
    return scored.where("predicted = 1").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 7): that with the
    smallest id, once if the id is repeated. Texts without words are in no
    group and stay, as rows without an id do."""
    prepare(spark)
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages (operator 3), every occurrence cut
    back to whole characters; documents of which only white space is left go.
    A null text becomes an empty one and stays."""
    prepare(spark)
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark passage (operator 2). Null and
    empty texts hold none; without benchmark items nothing goes."""
    prepare(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the training sequences (operator 9). A
    null or empty text is a piece of one token, the end."""
    prepare(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, minima, suffix arrays and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        began = len(written(spark))
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, began, keep=1)  # the stage's own tables
    return docs

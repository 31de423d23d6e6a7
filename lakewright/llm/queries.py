"""The registered queries of the training-data operators.

Each opN query applies its operator with production parameters to its whole
table and derives the digest columns of its contract from the operator's own
output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import twins
from .common import held_out, prepare, table
from .conversation_repair import Repair
from .decontamination import find_leaks
from .fingerprints import edited
from .language_id import identify, learn
from .lm_scoring import cross_entropy_difference
from .manifest import Manifest, digest_of, fold, leaf_of
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import score_quality, train
from .search import search_all
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .warc import read_archives, resolve, write_archives

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, trees, keep={"held_out": held_out("doc_id", 4, 2)})


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return score_quality(docs, model, keep={"held_out": held_out("doc_id", 5, 0)})


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return resolve(read_archives(spark, write_archives(table(spark, sf_dir, "pages"))))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return search_all(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


OP5_SQL = """
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term
  FROM documents
),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM w GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*)::DOUBLE AS d FROM tf GROUP BY term),
sc AS (
  SELECT q.doc_id AS query_id, p.doc_id AS doc_id,
    round(sum(q.f * ln(1 + (n - d + 0.5) / (d + 0.5)) * p.f * 2.2 / (p.f + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM tf q JOIN tf p USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id CROSS JOIN st
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, p.doc_id
)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10
"""


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good and not toxic."""
    prepare(spark)
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, each row's by the CRC-32 of its place: ``copies``
    is 0 for a lost row and 2 for a repeated one."""
    blank = F.lit(" ")
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    act = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(act == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(act == 1, "").when(act == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(act == 0, 0).when(act == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return Repair(damaged(table(spark, sf_dir, "conversations")), copies="copies").digests().withColumnRenamed("conv", "conv_id")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return edited(table(spark, sf_dir, "documents"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the id's crc32 (a null id has none), A-Z of the text are
    lower-cased after the manifest was made; proofs show it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_of(*(F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS))
    manifest = Manifest(docs, FIELDS, "lang", "doc_id", carry={"changed": F.when(tampered & F.col("text").rlike("[A-Z]"), changed)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = manifest.proofs().select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", digest_of(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_suffix_dedup, op4_warc, op5_search, op6_lm_scoring, op7_near_dedup, op8_token_counts, op9_packing, op10_quality, op11_conversation_repair, op12_fingerprints, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op5_search": OP5_SQL, "op11_conversation_repair": twins.OP11, "op13_manifest": twins.OP13}

"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared folder before the next stage reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import decontaminate, jaccard_join, mixing, quality, secrets
from corvid.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that have changed."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("bigint"), "n_chars").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.7 go."""
    docs = docs.select(*COLUMNS)
    field = quality.train_on(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, field).where("score >= 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id stays.

    Documents without shingles are components of their own. Of rows with that id, texts of other components
    don't count, and the text with the least hash stays; rows that repeat id and text are one document. Rows
    without an id all stay, unless they are near a document with one.
    """
    docs = docs.select(*COLUMNS)
    joined = jaccard_join.jaccard_join(docs)
    first = joined.where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    empty = joined.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    named = hashed.join(first.unionByName(empty), ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    unnamed = joined.where("doc_id IS NULL AND component_id IS NULL").select("text_hash").distinct()
    return named.select("row.*").unionByName(hashed.where("doc_id IS NULL").join(unnamed, "text_hash", "left_semi").select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that they cover by more than half go."""
    return _recounted(decontaminate.remove_contamination(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes ``[secret]``; all documents stay.

    Texts that the ledger in the shared folder has aren't scanned again. Findings are of blobs, so they go to
    documents by the digest of the text.
    """
    docs = docs.select(*COLUMNS)
    return _recounted(secrets.mask_secrets(docs, secrets.shared_ledger(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its block, slot and position in the mixture."""
    return mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
]
#: SQL can't express a trained field or earliest-deadline-first; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

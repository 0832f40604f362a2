"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and calls one operator of
``tidemark.llm``; all but the last return the columns of ``docs``. Documents with equal ids stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, pieces, pii, quality
from tidemark.llm.common import cut, documents, drop, small_batches
from tidemark.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    small_batches(spark)
    return quality.ledger(docs, name="_ledger").where(~quality.fails("v2", name="_ledger")).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    small_batches(spark)
    others = jaccard.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stands in benchmark windows."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.flag(docs, items).where("NOT contaminated").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in the place of each span of personal data."""
    small_batches(spark)
    masked = pii.mask(pii.detect(docs, to="_spans"), spans="_spans")
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, the end id last."""
    small_batches(spark)
    coded = pieces.code(docs, vocabulary(), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("personal data", mask_personal_data),
    ("SentencePiece encoding", to_ids),
]
#: The fourth and fifth stage have no SQL; the tests compare the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        last, docs = docs, cut(stage(spark, docs, sf_dir))
        if hasattr(last, "_written"):  # the next one is written, so nothing is computed from its input any more
            drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline from raw documents to packed token sequences.

Five stages in this order: quality rules, SimHash near-dedup, benchmark
decontamination, PII masking, packing. Each takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes it as Parquet in the shared checkpoint
folder and reads it again as the next stage's documents, so no stage is ever
computed twice and a lost executor costs one stage's tasks only. All stages but
the last return the columns of documents, whatever other columns there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline.llm import decontamination, packing, pii, quality, simhash
from shredline.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are content for the most part."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by fingerprints at most 2 bits apart: the one of the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs.select(*COLUMNS), items)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("PII", mask_pii), ("packing", pack)]

#: Fingerprints, a fitted model and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

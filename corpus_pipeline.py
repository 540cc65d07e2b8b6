"""Preparation of a training corpus in stages; each reads what its predecessor kept.

toxicity         rows the network predicts toxic go
near_duplicates  one document of each near-duplicate component stays
decontamination  documents that leak a benchmark item go
secrets          live-looking secret values are masked; no document goes
encoding         byte-level BPE ids (4-byte little-endian) of every remaining document, and their decoded bytes

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.llm import registry
from riskline.llm.byte_bpe import encode
from riskline.llm.common import materialize, table
from riskline.llm.decontaminate import decontaminate
from riskline.llm.jaccard_join import one_of_each
from riskline.llm.secrets import redact
from riskline.llm.toxicity_gru import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode(docs, registry.BYTE_RANKS, registry.public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secret_scan), ("encoding", encoding)]

#: A trained network decides in the first stage: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

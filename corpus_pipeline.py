"""A corpus pipeline of five operators: each stage takes what the one before kept.

Stages: quality rules (documents that fail go), n-gram Jaccard join (one row of each group stays, of its smallest id), substring
dedup (repeated sentence spans are cut from the texts), secret scans (live-looking secrets are replaced), packing. All
but the last return the columns of ``documents``. Defined cases are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, packing, quality, secrets, substrings
from quarry.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, so n_chars is counted anew where the column is there."""
    return _recounted(substrings.without_repeats(docs, substrings.covered(docs)))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Fitted models and tokenizers are beyond SQL; tests/llm holds run() against the brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

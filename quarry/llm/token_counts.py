"""Exact length histogram (operator 10).

Documents are counted by encoded length; suffix sums over the histogram answer totals, quantiles and truncated totals
for every context limit. The histogram has at most one row per distinct length. Its running sums are taken within
blocks of ``BLOCK`` lengths and over the blocks' totals, so that no task holds more than one block. The counts are
written once, as both sums read them: texts are encoded once.

Defined cases: null text has length 0; null and repeated ids count once per row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, slices, table, texts_of
from quarry.llm.encoding import Encoder

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str, spaces: bool = True) -> DataFrame:
    """doc_id, length: ids of each whole text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, spaces)
        for batch in batches:
            for piece in slices(batch):
                _, ends = encoder.encode(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends, prepend=0).astype(np.int64))], names=["doc_id", "length"])

    return texts_of(docs).mapInArrow(counted, "doc_id long, length long")


def histogram(sizes: DataFrame) -> DataFrame:
    """limit (each length that occurs), n_docs of that length, docs_at_most, docs_over, tokens_at_most, tokens_over,
    truncated_total (tokens kept if every document is cut at limit), tokens_lost, quantile (share of documents within
    limit)."""
    counts = materialize(sizes.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    before, everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "dt"), *(F.sum(x).over(everything).alias(f"{x}_all") for x in "dt")
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(blocks, "block").select(
        F.col("length").alias("limit"), "n_docs", (F.col("d_before") + F.sum("n_docs").over(inside)).alias("docs_at_most"),
        (F.col("t_before") + F.sum(tokens).over(inside)).alias("tokens_at_most"), "d_all", "t_all",
    )
    over = F.col("d_all") - F.col("docs_at_most")
    kept = F.col("tokens_at_most") + F.col("limit") * over
    return rows.select(
        "limit", "n_docs", "docs_at_most", over.alias("docs_over"), "tokens_at_most", (F.col("t_all") - F.col("tokens_at_most")).alias("tokens_over"),
        kept.alias("truncated_total"), (F.col("t_all") - kept).alias("tokens_lost"), (F.col("docs_at_most") / F.col("d_all")).alias("quantile"),
    )


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total, docs_over, for any limits, from histogram()'s rows: those of the largest length within a
    limit, moved by what its longer documents still gain."""
    spark = answers.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "asked long")
    found = asked.join(F.broadcast(answers), F.col("limit") <= F.col("asked"), "left").groupBy("asked").agg(F.max_by(F.struct("limit", "truncated_total", "docs_over"), "limit").alias("x"))
    total = answers.agg(F.sum("n_docs").alias("all_docs"))
    over = F.coalesce(F.col("x.docs_over"), F.col("all_docs"))
    kept = F.coalesce(F.col("x.truncated_total") + (F.col("asked") - F.col("x.limit")) * F.col("x.docs_over"), F.col("asked") * F.col("all_docs"))
    return found.crossJoin(total).select(F.col("asked").alias("limit"), F.coalesce(kept, F.lit(0)).alias("truncated_total"), F.coalesce(over, F.lit(0)).alias("docs_over"))


def at_quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length within which at least that share of the documents lies."""
    asked = answers.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(F.broadcast(answers.select("limit", "quantile")), F.col("quantile") >= F.col("share"), "left").groupBy("share").agg(F.min("limit").alias("length"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return histogram(lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))

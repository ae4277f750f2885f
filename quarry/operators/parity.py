"""Comparing two outputs, and run outputs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows that differ: in one table only, or by more than the tolerance in some column."""
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("_a"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("_b"))
    j = left.join(right, keys, "full")
    differs = F.lit(False)
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differs = differs | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    side = F.when(F.col("_b").isNull(), "a only").when(F.col("_a").isNull(), "b only").when(differs, "differs")
    return j.withColumn("finding", side).where("finding is not null").drop("_a", "_b")


def compare_places(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Top lists (place, ticker, columns) held against each other place by place: one row of the numbers of rows on each
    side, places whose tickers differ, the first of them, and places at which some column differs by more than the
    tolerance or is missing on one side."""
    left = a.select("place", F.col("ticker").alias("_ta"), *(F.col(c).alias(f"_a{k}") for k, c in enumerate(columns)))
    right = b.select("place", F.col("ticker").alias("_tb"), *(F.col(c).alias(f"_b{k}") for k, c in enumerate(columns)))
    j = left.join(right, "place", "full")
    other = ~F.col("_ta").eqNullSafe(F.col("_tb"))
    off = F.lit(False)
    for k in range(len(columns)):
        x, y = F.col(f"_a{k}"), F.col(f"_b{k}")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    count = lambda test: F.count(F.when(test, 1))
    return j.agg(count(F.col("_ta").isNotNull()).alias("rows_a"), count(F.col("_tb").isNotNull()).alias("rows_b"), count(other).alias("tickers_differ"), F.min(F.when(other, F.col("place"))).alias("first_place"), count(off).alias("scores_differ"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A 12-digit hexadecimal fingerprint of all rows, whatever their order, and their number."""
    row = F.xxhash64(*df.columns)
    total = df.agg(F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_000_007))).alias("s"), F.count("*").alias("n_rows"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", "x", "s", "n_rows"), 256), 1, 12).alias("fingerprint"), "n_rows")


def last_per_ticker(rows: DataFrame, n: int = 52, time: str = "d") -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col(time).desc()))).where(F.col("_k") <= n).drop("_k")


def varies_within(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Keys within which a value that should be one varies."""
    return rows.groupBy(by).agg(F.countDistinct(value).alias("n")).where("n > 1")

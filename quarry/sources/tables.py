"""Reading bars and panels, and writing run outputs as partitioned Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("d", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
FIELDS = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Daily bars from CSV, JSON, ORC or Parquet; rows that lack any of the five values go."""
    reader = spark.read.schema(BARS)
    if form == "csv":
        reader = reader.option("header", True)
    return reader.format(form).load(path).dropna(subset=list(FIELDS))


def read_panel(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).option("header", True).load(path)


def long_bars(wide: DataFrame, separator: str = "__") -> DataFrame:
    """d and <ticker>__<field> columns to (ticker, d, open, high, low, close, volume); incomplete rows go."""
    columns = [c for c in wide.columns if separator in c]
    long = wide.select("d", F.inline(F.array(*(F.struct(F.lit(c.split(separator)[0]).alias("ticker"), F.lit(c.split(separator)[1].lower()).alias("field"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))))
    return long.groupBy("ticker", "d").agg(*(F.max(F.when(F.col("field") == f, F.col("v"))).alias(f) for f in FIELDS)).dropna(subset=list(FIELDS))


def unpivot_bars(bars: DataFrame) -> DataFrame:
    """ticker, d, field, value."""
    return bars.unpivot(["ticker", "d"], list(FIELDS), "field", "value")


def write_tables(tables: dict[str, DataFrame], root: str, by: list[str] | None = None, **labels: str) -> None:
    """One Parquet table for each name under root, partitioned by the labels (such as run_label) and by the columns
    ``by`` of its own. What is there under the same labels is replaced, so that a repeated run leaves no rows twice."""
    for name, df in tables.items():
        rows = df.withColumns({k: F.lit(v) for k, v in labels.items()})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*labels, *(by or [])).parquet(f"{root}/{name}")


def write_consolidated(panel: DataFrame, path: str, order: list[str]) -> None:
    panel.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in a temporary one only where the session
    names none and runs on this machine alone, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "").rstrip("/")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

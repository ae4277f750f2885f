"""Panel tables made from the star-schema tables: a supplier plays a ticker, the market mean the benchmark, a region the
sector. The SQL forms, which the oracles use, stand beside the DataFrame forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.windows import ratio, series, week_end


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, by_ticker: bool = False) -> DataFrame:
    """ticker, d, open, high, low, close, volume. by_ticker deals the raw rows by ticker first, so that whatever follows for
    each ticker (these sums, its windows, its weeks) needs no other shuffle or sort."""
    price = F.col("l_extendedprice") / F.col("l_quantity") / 100
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("d"), price.alias("px"), F.col("l_quantity").alias("q"), order.alias("k"))
    return (rows.repartition("ticker") if by_ticker else rows).groupBy("ticker", "d").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("q").cast("double").alias("volume")
    )


def daily_benchmark(bar: DataFrame) -> DataFrame:
    return bar.groupBy("d").agg(F.avg("close").alias("bench"))


def weekly(bar: DataFrame) -> DataFrame:
    """ticker, week_key, close, high, volume, data_date."""
    return bar.groupBy("ticker", week_end(F.col("d")).alias("week_key")).agg(
        F.max_by("close", "d").alias("close"), F.max("high").alias("high"), F.sum("volume").alias("volume"), F.max("d").alias("data_date")
    )


def weekly_benchmark(week: DataFrame) -> DataFrame:
    return week.groupBy("week_key").agg(F.avg("close").alias("bench_close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


def ahead_benchmark(week: DataFrame) -> DataFrame:
    """week_key, bfwd (the benchmark's next-week return), s (its deviation); one row for each week."""
    bench = weekly_benchmark(week).select("week_key", (F.lead("bench_close").over(Window.orderBy("week_key")) / F.col("bench_close") - 1).alias("bfwd"))
    return bench.withColumn("s", F.stddev_samp("bfwd").over(Window.partitionBy()))


def label(fwd: Column) -> Column:
    """Whether the next week's return is a quarter of a deviation above the benchmark's."""
    return F.when(fwd.isNull() | F.col("bfwd").isNull(), None).when(fwd > F.col("bfwd") + 0.25 * F.col("s"), 1).otherwise(0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, week_key, sector, score, fwd_ret, bench_ret, y: a reversal score with the realised next-week returns."""
    week, w = weekly(bars(spark, sf_dir, by_ticker=True)), series("ticker", "week_key")
    ret = week.select("ticker", "week_key", (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("r"), (ratio(F.lead("close").over(w), F.col("close")) - 1).alias("fwd"))
    bench, y = ahead_benchmark(week), label(F.col("fwd"))
    return ret.join(sectors(spark, sf_dir), "ticker").join(F.broadcast(bench), "week_key").select(
        "ticker", "week_key", "sector", F.round(-F.col("r"), 6).alias("score"), F.round("fwd", 6).alias("fwd_ret"), F.round("bfwd", 6).alias("bench_ret"), y.alias("y")
    )


BARS_SQL = """px as (select l_suppkey as ticker, cast(l_shipdate as date) as d, l_extendedprice / l_quantity / 100 as px, l_quantity as q,
  row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) as k from lineitem),
bars as (select ticker, d, arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close, cast(sum(q) as double) as volume from px group by ticker, d)"""
WEEKLY_SQL = BARS_SQL + """,
weekly as (select ticker, cast(cast(date_trunc('week', d) as date) + 6 as date) as week_key, arg_max(close, d) as close, max(high) as high,
  sum(volume) as volume, max(d) as data_date from bars group by 1, 2)"""
SECTORS_SQL = """sect as (select s_suppkey as ticker, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
SCORED_SQL = WEEKLY_SQL + ",\n" + SECTORS_SQL + """,
bench as (select week_key, avg(close) as bench_close from weekly group by week_key),
ret as (select ticker, week_key, close / nullif(lag(close) over w, 0) - 1 as r, lead(close) over w / nullif(close, 0) - 1 as fwd
  from weekly window w as (partition by ticker order by week_key)),
bret as (select week_key, lead(bench_close) over (order by week_key) / bench_close - 1 as bfwd from bench),
sd as (select stddev_samp(bfwd) as s from bret),
scored as (select ret.ticker, ret.week_key, sector, round(-r, 6) as score, round(fwd, 6) as fwd_ret, round(bfwd, 6) as bench_ret,
  case when fwd is null or bfwd is null then null when fwd > bfwd + 0.25 * s then 1 else 0 end as y
  from ret join sect using (ticker) join bret using (week_key) cross join sd)"""

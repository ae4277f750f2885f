"""Daily technical indicators over bars (ticker, d, open, high, low, close, volume). All share one window per ticker, so
one shuffle and one sort serve them all; an ordered pass in Python is followed by another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.lookback import Known, Rows, deviation, extreme, greater, less, look_back, mean, of, total
from quarry.functions.lookback import ratio as known_ratio
from quarry.functions.recurrences import Smooth, smooth
from quarry.functions.windows import Rolling, change, days_since, flag, ratio, rolled, series, streak


def enough_history(bars: DataFrame, least: int = 100) -> DataFrame:
    """Rows of tickers with at least that many bars."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(F.col("_n") >= least).drop("_n")


def on_balance_volume() -> Column:
    step = F.col("close") - F.lag(F.col("close")).over(series())
    return F.sum(F.when(step.isNull() | (step > 0), F.col("volume")).when(step < 0, -F.col("volume")).otherwise(0.0)).over(series().rowsBetween(Window.unboundedPreceding, 0))


def with_trend(bars: DataFrame) -> DataFrame:
    """Averages, volume, range and momentum columns that need rolling windows only."""
    edges = [Rolling(f"{kind}{n}", kind, "close", n, m) for kind in ("max", "min") for n, m in ((90, 90), (252, 60))]
    long = rolled(bars, [*(Rolling(f"SMA_{n}", "avg", "close", n, n) for n in (20, 50, 200)), Rolling("_volume_20", "avg", "volume", 20, 20), *edges])
    t = long.select(
        "*", on_balance_volume().alias("OBV"),
        *(change(F.col("close"), n).alias(k) for k, n in (("RET_1M", 20), ("RET_3M", 60), ("RET_6M", 126))), (change(F.col("volume"), 14) * 100).alias("VROC_14"),
        ratio(F.col("volume"), F.col("_volume_20")).alias("Vol_Rel_20"), streak(F.col("volume") > F.lag(F.col("volume")).over(series())).alias("Consecutive_Volume_Growth"),
        (F.lead(F.col("close"), 20).over(series()) / F.col("close") - 1).alias("fwd_20"),
    ).drop("_volume_20")
    above = F.col("SMA_50") > F.col("SMA_200")
    was_above, was_below = F.lag(F.col("SMA_50") > F.col("SMA_200")).over(series()), F.lag(F.col("SMA_50") < F.col("SMA_200")).over(series())
    base = F.when(F.col("RET_3M") == 0, 1e-9).otherwise(F.col("RET_3M")) + 1e-9
    return t.select(
        "*", change(F.col("OBV"), 20).alias("OBV_trend"), change(F.col("SMA_20"), 5).alias("MA_SLOPE_20"),
        F.when(flag(was_below) & flag(above), 1).when(flag(was_above) & flag(F.col("SMA_50") < F.col("SMA_200")), -1).otherwise(0).alias("Cross_Signal"),
        F.col("Consecutive_Volume_Growth").alias("Vol_StreakUp"), ratio(F.col("close") - F.col("min90"), F.col("max90") - F.col("min90")).alias("FIB_Range_90D"),
        (F.col("RET_1M") / base).alias("Ret13_Ratio"), ratio(F.col("close") - F.col("min252"), F.col("max252") - F.col("min252")).alias("Pct_in_52w_range"),
        ratio(F.col("max252") - F.col("close"), F.col("max252")).alias("Drawdown_52w"),
    )


def with_cross_days(trend: DataFrame, fast: str = "SMA_50", slow: str = "SMA_200") -> DataFrame:
    """Rows since the fast average rose above the slow one, and since it fell back."""
    above = trend.withColumn("_a", flag(F.col(fast) > F.col(slow)))
    was = F.coalesce(F.lag("_a").over(series()), F.lit(False))
    marked = above.withColumn("_up", F.col("_a") & ~was).withColumn("_down", ~F.col("_a") & was)
    return marked.select("*", days_since(F.col("_up")).alias("Days_since_Golden"), days_since(F.col("_down")).alias("Days_since_Death")).drop("_a", "_up", "_down")


_OSCILLATORS = {**dict.fromkeys(("MFI_14", "PctB", "CCI_20", "STOCHk", "Aroon_up", "Aroon_down", "STOCHd", "Aroon_Diff_25"), "double"), "STOCH_Cross": "int"}


def _oscillators(rows: Rows) -> dict[str, Known]:
    high, low, close, volume = (rows[c] for c in ("high", "low", "close", "volume"))
    typical = of(lambda h, lo, c: (h + lo + c) / 3, high, low, close)
    up, moved = of(np.subtract, typical, rows.before(typical, 1))
    flow, known = of(np.multiply, typical, volume)
    plus, minus = (total(rows.last((np.where(way, flow, 0.0), known | ~way), 14)) for way in (moved & greater(up, np.zeros(1)), moved & (up < 0)))
    closes, typicals = rows.last(close, 25), rows.last(typical, 20)
    middle, spread, average = mean(closes[-20:]), deviation(closes[-20:]), mean(typicals)
    off = sum((np.where(ok & average[1], np.abs(x - average[0]), 0.0) for x, ok in typicals), 0.0) / 20
    floor, top = extreme(rows.last(low, 14), less)[0], extreme(rows.last(high, 14))[0]
    k = mean(rows.last(rows.since(14, known_ratio(of(lambda c, lo: 100 * (c - lo), close, floor), of(np.subtract, top, floor))), 3), 3)
    d = mean(rows.last(k, 3), 3)
    aroon = {name: rows.since(25, of(lambda place: 100 * (24 - place) / 24, extreme(closes, beyond)[1])) for name, beyond in (("Aroon_up", greater), ("Aroon_down", less))}
    over, under = ((beyond(k[0], d[0]), k[1] & d[1]) for beyond in (greater, less))

    def begun(state: Known) -> np.ndarray:
        was, seen = rows.before(state, 1)
        return state[0] & state[1] & ~was & seen

    cross = np.where(begun(over), 1, np.where(begun(under), -1, 0))
    return {
        "MFI_14": rows.since(15, known_ratio(of(lambda p: 100 * p, plus), of(np.add, plus, minus))),
        "PctB": rows.since(20, known_ratio(of(lambda c, m, s: c - (m - 2 * s), close, middle, spread), of(lambda s: 4 * s, spread))),
        "CCI_20": rows.since(20, known_ratio(of(np.subtract, typical, average), (0.015 * off, average[1]))),
        "STOCHk": k, "STOCHd": d, **aroon, "Aroon_Diff_25": of(np.subtract, aroon["Aroon_up"], aroon["Aroon_down"]), "STOCH_Cross": (cross, np.ones(len(cross), dtype=bool)),
    }


def _with_oscillators(numbered: DataFrame) -> DataFrame:
    """numbered: rows in the order of their series, with their number there as _n."""
    return look_back(numbered, "_n", ("high", "low", "close", "volume"), 24, _OSCILLATORS, _oscillators).drop("_n")


def with_oscillators(bars: DataFrame) -> DataFrame:
    """Money flow, Bollinger %B, CCI, stochastics and Aroon. Spark's frames add up 14 to 25 rows anew for every row; here a
    task does so for a batch of rows at once."""
    return _with_oscillators(bars.withColumn("_n", F.row_number().over(series())))


def _smoothed(bars: DataFrame) -> DataFrame:
    """bars in the order of their series, with the averages that the recurrent indicators are made of."""
    lag = lambda c: F.lag(c).over(series())
    up, down = F.col("high") - lag(F.col("high")), lag(F.col("low")) - F.col("low")
    t = bars.select(
        "*", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag(F.col("close"))), F.abs(F.col("low") - lag(F.col("close")))).alias("_tr"), F.greatest(F.col("close") - lag(F.col("close")), F.lit(0.0)).alias("_g"),
        F.greatest(lag(F.col("close")) - F.col("close"), F.lit(0.0)).alias("_l"), lag(F.col("close")).isNotNull().alias("_has"), F.when(flag((up > down) & (up > 0)), up).otherwise(0.0).alias("_pdm"),
        F.when(flag((down > up) & (down > 0)), down).otherwise(0.0).alias("_mdm"),
    )

    def dx(rows: pd.DataFrame) -> pd.Series:
        total = rows["_p"] + rows["_m"]
        return 100 * (rows["_p"] - rows["_m"]).abs() / total.where(total != 0)

    then = lambda name: lambda rows: rows[name].where(rows["_has"])
    return smooth(t, "ticker", "d", [
        Smooth("_e12", 12, "ema", lambda rows: rows["close"]), Smooth("_e26", 26, "ema", lambda rows: rows["close"]), Smooth("_signal", 9, "ema", lambda rows: rows["_e12"] - rows["_e26"]),
        Smooth("_gain", 14, "rma", then("_g")), Smooth("_loss", 14, "rma", then("_l")), Smooth("ATR", 14, "rma", lambda rows: rows["_tr"]),
        Smooth("_p", 14, "rma", then("_pdm")), Smooth("_m", 14, "rma", then("_mdm")), Smooth("ADX_14", 14, "rma", dx),
    ])


def _recurrent(t: DataFrame, *columns: str) -> DataFrame:
    macd = F.col("_e12") - F.col("_e26")
    t = t.select("*", macd.alias("MACD"), (macd - F.col("_signal")).alias("MACDh"), ratio(100 * F.col("_gain"), F.col("_gain") + F.col("_loss")).alias("RSI_14"), (ratio(F.col("ATR"), F.col("close")) * 100).alias("ATRp_14"))
    t = t.withColumn("MACD_Hist_Slope_5", F.col("MACDh") - F.lag("MACDh", 5).over(series()))
    return t.select(*columns, "MACD", "MACDh", "MACD_Hist_Slope_5", "RSI_14", "ATRp_14", "ADX_14")


def with_recurrent(bars: DataFrame) -> DataFrame:
    """MACD with its histogram and slope, RSI, ATR in percent and ADX."""
    return _recurrent(_smoothed(bars), *bars.columns)


def with_all(bars: DataFrame) -> DataFrame:
    """Trend, oscillators and recurrences in one chain, without joins. The ordered passes come first and share one order, as
    they end Spark's knowledge of it: all later windows share the one shuffle after them."""
    t = _with_oscillators(_smoothed(bars.withColumn("_n", F.row_number().over(series()))))
    t = _recurrent(t, *bars.columns, *_OSCILLATORS)
    return with_trend(t.select(*(c for c in t.columns if c not in _OSCILLATORS), *_OSCILLATORS))


def with_fallbacks(bars: DataFrame) -> DataFrame:
    """SMA_20, SMA_50, SMA_200 and ATRp_14 where they are absent: plain means over as many bars as there are."""
    close, before = F.col("close"), F.lag("close").over(series())
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    new = [Rolling(f"SMA_{n}", "avg", "close", n, 1) for n in (20, 50, 200)] + [Rolling("ATRp_14", "avg", "_reach", 14, 1)]
    t = rolled(bars.withColumn("_reach", reach), [x for x in new if x.name not in bars.columns])
    return (t if "ATRp_14" in bars.columns else t.withColumn("ATRp_14", ratio(F.col("ATRp_14"), close) * 100)).drop("_reach")


def relative_strength(trend: DataFrame, benchmark: DataFrame) -> DataFrame:
    """RS columns: return less the benchmark's on the same day, missing as 0. benchmark: d, bench."""
    w = Window.orderBy("d")
    lagged = benchmark.select("d", *((F.col("bench") / F.lag("bench", n).over(w) - 1).alias(f"_b{k}") for k, n in (("1M", 20), ("3M", 60), ("6M", 126))))
    joined = trend.join(F.broadcast(lagged), "d", "left")
    return joined.select("*", *(F.coalesce(F.col(f"RET_{k}") - F.col(f"_b{k}"), F.lit(0.0)).alias(f"RS{k}") for k in ("1M", "3M", "6M"))).drop("_b1M", "_b3M", "_b6M")


def relative_strength_aligned(bars: DataFrame, benchmark: DataFrame, n: int = 20) -> DataFrame:
    """The variant on the ticker's own rows: the benchmark's close is carried forward to them and lagged there."""
    joined = bars.join(benchmark, "d", "left").withColumn("_b", F.last("bench", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    return joined.withColumn("RS_own", change(F.col("close"), n) - change(F.col("_b"), n)).drop("_b", "bench")


def return_classes(rows: DataFrame, value: str = "fwd_20", day: str = "d", high: float = 0.6, low: float = 0.4) -> DataFrame:
    """Return_Rank in each day's cross-section and Target_Class; the middle is dropped."""
    from quarry.functions.windows import percentile_rank

    ranked = rows.where(F.col(value).isNotNull()).withColumn("Return_Rank", percentile_rank(F.col(value), day))
    cls = F.when(F.col("Return_Rank") >= high, 1).when(F.col("Return_Rank") <= low, 0)
    return ranked.withColumn("Target_Class", cls).where(F.col("Target_Class").isNotNull())


def with_forward_close(bars: DataFrame, days: int = 7, name: str = "next_close") -> DataFrame:
    """As-of join forward: the first close at least ``days`` calendar days on. Each row stands once with its own day and
    once with the day it asks for; from the last day back, the close seen last is the one wanted. One sort, linear."""
    number = F.datediff(F.col("d"), F.lit("1970-01-01"))
    both = bars.withColumn("_q", F.explode(F.array(F.struct(number.alias("at"), F.lit(0).alias("asks")), F.struct((number + days).alias("at"), F.lit(1).alias("asks")))))
    w = Window.partitionBy("ticker").orderBy(F.col("_q.at").desc(), F.col("_q.asks")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_q.asks") == 0, F.struct("close")), ignorenulls=True).over(w)
    return both.withColumn(name, seen["close"]).where("_q.asks = 1").drop("_q")


def as_of(rows: DataFrame, day: str, key: str = "ticker", time: str = "d") -> DataFrame:
    """As-of join backward: the last row of each key at or before the day."""
    others = [c for c in rows.columns if c not in (key,)]
    last = rows.where(F.col(time) <= F.lit(day).cast("date")).groupBy(key).agg(F.max_by(F.struct(*others), time).alias("r"))
    return last.select(key, "r.*")


def forward_targets(bars: DataFrame, benchmark: DataFrame, ahead: int = 7, width: float = 2.0, hold_back: int = 7) -> DataFrame:
    """Next-week price and return (missing as 0), the benchmark's return ``ahead`` rows on, its band of ``width`` sample
    deviations, Target 1 / 2 / 3, and Target3; all null in the last, incomplete days. Without a benchmark value the band
    is 5 % either side and the target 2."""
    b = benchmark.select("d", (F.lead("bench", ahead).over(Window.orderBy("d")) / F.col("bench") - 1).alias("bench_fwd"))
    b = b.crossJoin(b.agg(F.stddev_samp("bench_fwd").alias("_s")))
    t = with_forward_close(bars, 7).withColumn("ret_week", F.coalesce(ratio(F.col("next_close"), F.col("close")) - 1, F.lit(0.0))).join(b, "d", "left")
    t = t.withColumn("band_low", F.coalesce(F.col("bench_fwd") - width * F.col("_s"), F.lit(-0.05))).withColumn("band_high", F.coalesce(F.col("bench_fwd") + width * F.col("_s"), F.lit(0.05)))
    target = F.when(F.col("bench_fwd").isNull(), 2).when(F.col("ret_week") < F.col("band_low"), 1).when(F.col("ret_week") > F.col("band_high"), 3).otherwise(2)
    t = t.withColumn("Target", target).withColumn("Target3", (F.col("Target") == 3).cast("int"))
    t = t.crossJoin(F.broadcast(bars.agg(F.date_sub(F.max("d"), hold_back).alias("_cut"))))
    return t.select(*bars.columns, *(F.when(F.col("d") <= F.col("_cut"), F.col(c)).alias(c) for c in ("next_close", "ret_week", "bench_fwd", "band_low", "band_high", "Target", "Target3")))

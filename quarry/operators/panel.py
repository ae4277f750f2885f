"""Weekly panel: cleaning, universe masks, per-ticker window features and cross-sectional operators.

The panel has ticker, week_key, close, high, volume. Ticker windows come first, then week windows: two shuffles.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.windows import clip, flag, last_rows, ratio, rolling, series, week_end
from quarry.operators.order_statistics import medians

KEY, TIME = "ticker", "week_key"

# Columns that are ranked, those that are never features, and the tables' names for one thing.
RANKED = (
    "RET_1M", "RET_3M", "RET_6M", "RS1M", "RS3M", "RS6M", "Momentum_Score", "RelStr_Score", "RiskAdjMom_3M", "RiskAdjMom_6M", "Vol_Rel_20", "Drawdown_52w", "GapPct", "Vol_12w", "MomAccel_1w", "PriceToHigh4w",
)
LEAKS = ("Target", "Target3", "next_close", "ret_week", "bench_fwd", "band_low", "band_high", "y", "fwd_ret", "bench_ret")


def roll(agg, value: Column, n: int, least: int) -> Column:  # noqa: ANN001
    return rolling(agg, value, n, least, KEY, TIME)


# --- cleaning -------------------------------------------------------------------------------------------------------


def clean_name(name: str) -> str:
    """Runs of characters other than letters, digits and _ become one _, none at the ends."""
    return re.sub(r"[\W_]+", "_", name).strip("_")


def cleaned_columns(df: DataFrame) -> DataFrame:
    """Clean names; of columns whose clean names agree the first stays."""
    names = [clean_name(c) for c in df.columns]
    numbered = df.toDF(*(f"c{k}" for k in range(len(names))))
    return numbered.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names) if names.index(n) == k))


def ensure_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as double; text that is no number and absent columns are null."""
    new = {c: (F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")) for c in columns}
    return df.withColumns(new)


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def check_panel(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """df, if it has the columns and rows whose label is known."""
    if require(df, columns).where(F.col(label).isNotNull()).isEmpty():
        raise ValueError("no rows with a known label")
    return df


def normal_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def binary_label(c: Column) -> Column:
    return F.when(c.isNotNull(), (c >= 0.5).cast("int"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def filled(c: Column, backward_first: bool = True) -> Column:
    """Gaps of a series filled from the next value and then the last one, or the other way round."""
    back = F.last(c, ignorenulls=True).over(Window.partitionBy(KEY).orderBy(F.col(TIME).desc()).rowsBetween(Window.unboundedPreceding, 0))
    forth = F.last(c, ignorenulls=True).over(series(KEY, TIME).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(back, forth) if backward_first else F.coalesce(forth, back)


def in_band(price: Column, low: float | None = None, high: float | None = None) -> Column:
    """low < price < high; a missing price is outside if there is a limit."""
    over = flag(price > low) if low is not None else F.lit(True)
    return over & (flag(price < high) if high is not None else F.lit(True))


def price_between(df: DataFrame, price: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within the band."""
    return df.where(in_band(F.col(price), low, high))


def mostly_present(df: DataFrame, features: list[str], most_missing: float = 0.55) -> DataFrame:
    gone = sum((F.col(c).isNull().cast("int") for c in features[1:]), F.col(features[0]).isNull().cast("int"))
    return df.where(gone / len(features) <= most_missing)


def feature_list(df: DataFrame, wanted: list[str], leaks: tuple[str, ...] = LEAKS) -> list[str]:
    """Wanted columns that are there, in order, each once, without leaks."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns and c not in leaks]


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by an order that leaves no ties open."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


# --- windows --------------------------------------------------------------------------------------------------------


def gap_shift(value: Column, n: int = 1, most_weeks: int = 2) -> Column:
    """lag over n rows, null where this row is more than most_weeks after the one before it."""
    return F.when(F.datediff(F.col(TIME), F.lag(TIME).over(series(KEY, TIME))) <= 7 * most_weeks, F.lag(value, n).over(series(KEY, TIME)))


def with_returns(panel: DataFrame) -> DataFrame:
    """Weekly returns and what follows from them and from prices and volumes of the last weeks. Without a volume, relative
    volume stands for it; without either, what needs it is null."""
    traded = next((F.col(c) for c in ("volume", "Vol_Rel_20") if c in panel.columns), F.lit(None).cast("double"))
    p = panel.withColumn("Close_prev", gap_shift(F.col("close")))
    p = p.withColumn("Ret_1w_calc", ratio(F.col("close"), F.col("Close_prev")) - 1)
    p = p.select("*", F.when(F.col("close") > 0, F.ln(ratio(F.col("close"), F.col("Close_prev")))).alias("LogRet_1w"), F.col("Ret_1w_calc").alias("GapPct"))
    vol = F.nullif(traded, F.lit(0.0))
    mean8, std8 = roll(F.avg, traded, 8, 4), roll(F.stddev_samp, traded, 8, 4)
    p = p.select(
        "*", roll(F.stddev_samp, F.col("LogRet_1w"), 12, 6).alias("Vol_12w"), (F.col("Ret_1w_calc") - gap_shift(F.col("Ret_1w_calc"))).alias("MomAccel_1w"),
        ratio(F.col("close"), roll(F.max, F.col("close"), 4, 2)).alias("PriceToHigh4w"), ratio(F.col("close"), roll(F.min, F.col("close"), 4, 2)).alias("PriceToLow4w"),
        ratio(traded - mean8, std8).alias("VolZScore_8w"),
        *((F.col("close") / F.nullif(F.lag("close", n).over(series(KEY, TIME)), F.lit(0.0)) - 1).alias(k) for k, n in (("RET_3M", 13), ("RET_6M", 26))),
        roll(F.avg, F.abs(F.col("Ret_1w_calc")) / (F.col("close") * vol), 4, 2).alias("_illiq"),
    )
    return p.select("*", *((F.col(f"RET_{k}") / (F.col("Vol_12w") + 1e-6)).alias(f"RiskAdjMom_{k}") for k in ("3M", "6M")))


def with_lottery(panel: DataFrame, ret: str = "Ret_1w_calc") -> DataFrame:
    """Lottery demand (minus the mean of the five best of twelve returns), distance to the 52-week high, and information
    discreteness over 52 weeks."""
    r = F.col(ret)
    best = F.slice(F.sort_array(F.collect_list(clip(r, -0.99, 10.0)).over(last_rows(12, KEY, TIME)), asc=False), 1, 5)
    known = F.count(r).over(last_rows(12, KEY, TIME))
    year = last_rows(52, KEY, TIME)
    n = F.count(r).over(year)
    share = lambda test: F.sum(F.when(test, 1).otherwise(0)).over(year) / n
    drift = F.signum(F.sum(F.ln(F.when(r > -1, 1 + r))).over(year))
    p = panel.withColumn("_best", best)
    return p.select(
        "*", F.when(known >= 5, -F.aggregate("_best", F.lit(0.0), lambda a, x: a + x) / F.size("_best")).alias("MAX5_21d_neg"),
        clip(ratio(F.col("close"), roll(F.max, F.col("high"), 52, 26)), 0.0, 1.0).alias("Ratio_52w_High"),
        F.when(n >= 20, drift * (share(r < 0) - share(r > 0))).alias("Information_Discreteness_12M"),
    ).drop("_best")


def with_masks(panel: DataFrame, ret: str, price: float = 5.0, dollars: float = 5e6, still: float = 0.2) -> DataFrame:
    """Universe masks: price, dollar volume, share of unmoved weeks, and all three. Without a volume, relative volume
    stands for it, to be over a half; without either, all rows pass."""
    if "volume" in panel.columns:
        active = flag(roll(F.avg, F.col("close") * F.nullif(F.col("volume"), F.lit(0.0)), 4, 2) > dollars)
    elif "Vol_Rel_20" in panel.columns:
        active = flag(roll(F.avg, F.col("close") * F.col("Vol_Rel_20"), 4, 2) > 0.5)
    else:
        active = F.lit(True)
    unmoved = F.coalesce(F.abs(F.col(ret)) < 1e-4, F.lit(False)).cast("double")
    w12 = last_rows(12, KEY, TIME)
    share = F.when(F.count(unmoved).over(w12) >= 6, F.avg(unmoved).over(w12))
    p = panel.select("*", flag(F.col("close") > price).alias("univ_price"), active.alias("univ_volume"), flag(share < still).alias("univ_moves"))
    return p.withColumn("univ_pass", F.col("univ_price") & F.col("univ_volume") & F.col("univ_moves"))


def funnel(masked: DataFrame) -> DataFrame:
    """Distinct tickers after each mask."""
    steps = {"all_tickers": F.lit(True), "after_price": F.col("univ_price"), "after_volume": F.col("univ_price") & F.col("univ_volume"), "after_all": F.col("univ_pass")}
    return masked.agg(*(F.countDistinct(F.when(test, F.col(KEY))).alias(k) for k, test in steps.items()))


def regime(benchmark: DataFrame, value: str = "bench_close", expanding: bool = False) -> DataFrame:
    """week_key, regime of the benchmark: 0 volatile, 1 falling, 3 rising, 2 else. Volatile is above the quartile of all
    weeks, or, expanding, of the weeks so far, without a look ahead. One row for each week."""
    w = Window.orderBy(TIME)
    w4 = w.rowsBetween(-3, 0)
    b = benchmark.select(TIME, (ratio(F.col(value), F.lag(value, 4).over(w)) - 1).alias("r4"), F.ln(ratio(F.col(value), F.lag(value).over(w))).alias("_l"))
    b = b.withColumn("vol4", F.when(F.count("_l").over(w4) >= 2, F.stddev_samp("_l").over(w4)))
    if expanding:
        b = b.withColumn("_q", F.percentile("vol4", F.lit(0.75)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        b = b.crossJoin(b.agg(F.percentile("vol4", F.lit(0.75)).alias("_q")))
    r = F.when(F.col("r4").isNull() | F.col("vol4").isNull(), None).when(F.col("vol4") > F.col("_q"), 0).when(F.col("r4") < -0.02, 1).when(F.col("r4") > 0.02, 3).otherwise(2)
    return b.select(TIME, "r4", "vol4", r.alias("regime"))


# --- cross-section --------------------------------------------------------------------------------------------------


def ranks(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """<column>__rank: percentile rank of each column in its week, ties averaged; missing values have none. The rows are
    shuffled once, by week; a task ranks the columns of one week at a time, of which it holds some 30 bytes a value."""
    own = columns if columns is not None else [c for c in RANKED if c in panel.columns]
    kept = panel.select(*panel.columns, *(F.col(c).cast("double").alias(f"{c}__rank") for c in own))

    def ranked(rows: pa.Table) -> pa.Table:
        for c in own:
            at = rows.schema.get_field_index(f"{c}__rank")
            rows = rows.set_column(at, rows.field(at), pa.array(_shares(rows.column(at)), pa.float64(), from_pandas=True))
        return rows

    return kept.groupBy(TIME).applyInArrow(ranked, kept.schema)


def _shares(values: pa.ChunkedArray) -> np.ndarray:
    """Tie-averaged ranks as shares of the values that are there; nan for those that are not. NaN values tie, after all others."""
    known = np.flatnonzero(~values.is_null().to_numpy())
    x = values.drop_null().to_numpy()
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))]) if len(x) else np.zeros(0, int)
    ends = np.r_[new[1:], len(x)] if len(x) else new
    out = np.full(len(values), np.nan)
    out[known[order]] = np.repeat((new + 1 + (ends - new - 1) / 2) / max(len(x), 1), ends - new)
    return out


def with_snapshot(weekly: DataFrame, daily: DataFrame, columns: list[str], day: str = "d") -> DataFrame:
    """weekly with the columns of each ticker's last daily row of the week, which replace its own of the same name;
    risk-adjusted momenta follow the daily returns. Weeks without a daily row go."""
    last = first_of(daily.withColumn(TIME, week_end(F.col(day))).select(KEY, TIME, day, *columns), [KEY, TIME], [F.col(day).desc()]).drop(day)
    p = weekly.drop(*columns).join(last, [KEY, TIME])
    return p.withColumns({f"RiskAdjMom_{k}": F.col(f"RET_{k}") / (F.col("Vol_12w") + 1e-6) for k in ("3M", "6M") if f"RET_{k}" in columns})


def winsorised(panel: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The column held between its week's quantiles."""
    edges = panel.groupBy(TIME).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_e"))
    held = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_e")[0]), F.col("_e")[1]))
    return panel.join(F.broadcast(edges), TIME).withColumn(column, held).drop("_e")


def illiquidity(panel: DataFrame) -> DataFrame:
    """Amihud illiquidity: log of one plus the mean of |return| / dollar volume, winsorised."""
    return winsorised(panel.withColumn("Amihud_ILLIQ_20d", F.log1p("_illiq")), "Amihud_ILLIQ_20d")


def sector_neutral(panel: DataFrame, columns: list[str]) -> DataFrame:
    """<column>__sn: less the mean of the week and sector."""
    w = Window.partitionBy(TIME, "sector")
    return panel.select("*", *((F.col(c) - F.avg(c).over(w)).alias(f"{c}__sn") for c in columns))


def relevance(scored: DataFrame, label: str = "y", prob: str | None = "prob") -> DataFrame:
    """Relevance 0 to 3 from the label and whether the probability is at or above the global median; 2y without one."""
    if prob is None or prob not in scored.columns:
        return scored.withColumn("relevance", 2 * F.col(label))
    high = F.col(prob) >= F.lit(medians(scored, [prob]).get(prob)).cast("double")
    r = F.when((F.col(label) == 1) & high, 3).when(F.col(label) == 1, 2).when((F.col(label) == 0) & high, 1).when(F.col(label) == 0, 0)
    return scored.withColumn("relevance", r)


def date_spread(panel: DataFrame) -> DataFrame:
    """Weeks whose rows have more than one raw date: first, last and how many."""
    return panel.groupBy(TIME).agg(F.min("data_date").alias("first_date"), F.max("data_date").alias("last_date"), F.countDistinct("data_date").alias("n_dates")).where("n_dates > 1")

"""Registered queries over daily bars, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.windows import percentile_rank
from quarry.operators import indicators, metrics, panel, parity, rules
from quarry.plans.registry import Catalog, r, shown
from quarry.sources import tables
from quarry.sources.fixtures import BARS_SQL, bars, daily_benchmark

daily = Catalog()
_W = "window w as (partition by ticker order by d)"


def _win(agg: str, c: str, n: int, least: int) -> str:
    w = f"over (partition by ticker order by d rows between {n - 1} preceding and current row)"
    return f"case when count({c}) {w} >= {least} then {agg}({c}) {w} end"


TREND_SQL = BARS_SQL + f""",
t0 as (select *, row_number() over w as n, lag(close) over w as c1, lag(volume) over w as v1,
  {_win('avg', 'close', 20, 20)} as SMA_20, {_win('avg', 'close', 50, 50)} as SMA_50, {_win('avg', 'close', 200, 200)} as SMA_200,
  close / nullif(lag(close, 20) over w, 0) - 1 as RET_1M, close / nullif(lag(close, 60) over w, 0) - 1 as RET_3M, close / nullif(lag(close, 126) over w, 0) - 1 as RET_6M,
  (volume / nullif(lag(volume, 14) over w, 0) - 1) * 100 as VROC_14, volume / nullif({_win('avg', 'volume', 20, 20)}, 0) as Vol_Rel_20,
  {_win('max', 'close', 90, 90)} as max90, {_win('min', 'close', 90, 90)} as min90, {_win('max', 'close', 252, 60)} as max252, {_win('min', 'close', 252, 60)} as min252,
  lead(close, 20) over w / close - 1 as fwd_20 from bars {_W}),
t1 as (select *, sum(case when c1 is null or close > c1 then volume when close < c1 then -volume else 0 end) over (partition by ticker order by d rows unbounded preceding) as OBV,
  n - coalesce(max(case when not coalesce(volume > v1, false) then n end) over (partition by ticker order by d rows unbounded preceding), 0) as up_streak,
  lag(SMA_50 > SMA_200) over w as was_above, lag(SMA_50 < SMA_200) over w as was_below, SMA_20 / nullif(lag(SMA_20, 5) over w, 0) - 1 as MA_SLOPE_20 from t0 {_W}),
trend as (select *, OBV / nullif(lag(OBV, 20) over w, 0) - 1 as OBV_trend,
  case when coalesce(was_below, false) and coalesce(SMA_50 > SMA_200, false) then 1 when coalesce(was_above, false) and coalesce(SMA_50 < SMA_200, false) then -1 else 0 end as Cross_Signal,
  (close - min90) / nullif(max90 - min90, 0) as FIB_Range_90D, RET_1M / (case when RET_3M = 0 then 1e-9 else RET_3M end + 1e-9) as Ret13_Ratio,
  (close - min252) / nullif(max252 - min252, 0) as Pct_in_52w_range, (max252 - close) / nullif(max252, 0) as Drawdown_52w from t1 {_W})"""
_TREND = ["SMA_20", "SMA_50", "SMA_200", "OBV", "RET_1M", "RET_3M", "RET_6M", "VROC_14", "Vol_Rel_20", "OBV_trend", "MA_SLOPE_20", "FIB_Range_90D", "Ret13_Ratio", "Pct_in_52w_range", "Drawdown_52w", "fwd_20"]


@daily.add("daily_bars", f"with {BARS_SQL} select ticker, d, {', '.join(r(c, digits=10) for c in tables.FIELDS)} from bars")
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return shown(bars(spark, d), 10)


@daily.add("bars_unpivot", f"""with {BARS_SQL}, u as (unpivot (select ticker, d, open, high, low, close, volume from bars) on open, high, low, close, volume into name field value value)
select field, d, count(*) as n, {r('sum(value)', 'total')} from u group by field, d""")
def bars_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return shown(tables.unpivot_bars(bars(spark, d)).groupBy("field", "d").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@daily.add("trend_indicators", f"with {TREND_SQL} select ticker, d, {', '.join(map(r, _TREND))}, cast(up_streak as bigint) as Consecutive_Volume_Growth, cast(up_streak as bigint) as Vol_StreakUp, cast(Cross_Signal as bigint) as Cross_Signal from trend")
def trend_indicators(spark: SparkSession, d: str) -> DataFrame:
    t = indicators.with_trend(bars(spark, d, by_ticker=True))
    return shown(t.select("ticker", "d", *_TREND, "Consecutive_Volume_Growth", "Vol_StreakUp", "Cross_Signal"))


@daily.add("cross_days", f"""with {TREND_SQL}, a as (select ticker, d, n, coalesce(SMA_50 > SMA_200, false) as above from trend),
b as (select *, coalesce(lag(above) over w, false) as was, count(*) over (partition by ticker) as total from a {_W})
select ticker, d, cast(coalesce(n - max(case when above and not was then n end) over p, total + 1) as bigint) as Days_since_Golden,
cast(coalesce(n - max(case when not above and was then n end) over p, total + 1) as bigint) as Days_since_Death from b
window p as (partition by ticker order by d rows unbounded preceding)""")
def cross_days(spark: SparkSession, d: str) -> DataFrame:
    t = indicators.with_cross_days(indicators.with_trend(bars(spark, d, by_ticker=True)))
    return shown(t.select("ticker", "d", "Days_since_Golden", "Days_since_Death"))


_OSC = ["MFI_14", "PctB", "CCI_20", "STOCHk", "STOCHd", "Aroon_up", "Aroon_down", "Aroon_Diff_25"]
_ROWS = "over (partition by ticker order by d rows between {} preceding and current row)"


_OSC_SQL = f"""a as (select *, (high + low + close) / 3 as tp, row_number() over w as n from bars {_W}),
b as (select *, tp - lag(tp) over w as up, avg(tp) {_ROWS.format(19)} as mean_tp, list(tp) {_ROWS.format(19)} as tps, list(close) {_ROWS.format(24)} as cs,
  100 * (close - min(low) {_ROWS.format(13)}) / nullif(max(high) {_ROWS.format(13)} - min(low) {_ROWS.format(13)}, 0) as k0,
  avg(close) {_ROWS.format(19)} as m, stddev_pop(close) {_ROWS.format(19)} as s from a {_W}),
c as (select *, sum(case when up > 0 then tp * volume else 0 end) {_ROWS.format(13)} as pos, sum(case when up < 0 then tp * volume else 0 end) {_ROWS.format(13)} as neg,
  list_sum(list_transform(tps, lambda x: abs(x - mean_tp))) / 20 as dev, case when n >= 14 then k0 end as k1,
  case when n >= 25 then 100 * (24 - (list_position(cs, list_max(cs)) - 1)) / 24.0 end as au, case when n >= 25 then 100 * (24 - (list_position(cs, list_min(cs)) - 1)) / 24.0 end as ad from b),
e as (select *, {_win('avg', 'k1', 3, 3)} as k from c), f as (select *, {_win('avg', 'k', 3, 3)} as dd from e),
g as (select *, lag(k) over w as pk, lag(dd) over w as pd from f {_W})"""


@daily.add("oscillators", f"""with {BARS_SQL}, {_OSC_SQL}
select ticker, d, {r('case when n >= 15 then 100 * pos / nullif(pos + neg, 0) end', 'MFI_14')}, {r('case when n >= 20 then (close - (m - 2 * s)) / nullif(4 * s, 0) end', 'PctB')},
{r('case when n >= 20 then (tp - mean_tp) / nullif(0.015 * dev, 0) end', 'CCI_20')}, {r('k', 'STOCHk')}, {r('dd', 'STOCHd')}, {r('au', 'Aroon_up')}, {r('ad', 'Aroon_down')}, {r('au - ad', 'Aroon_Diff_25')},
cast(case when pk <= pd and k > dd then 1 when pk >= pd and k < dd then -1 else 0 end as bigint) as STOCH_Cross from g""")
def oscillators(spark: SparkSession, d: str) -> DataFrame:
    return shown(indicators.with_oscillators(bars(spark, d, by_ticker=True).drop("open")).select("ticker", "d", *_OSC, "STOCH_Cross"))


_RECURRENT_FINAL = f"""select ticker, d, {r('macd', 'MACD')}, {r('macd - sig', 'MACDh')}, {r('(macd - sig) - lag(macd - sig, 5) over w', 'MACD_Hist_Slope_5')}, {r('100 * gain / nullif(gain + loss, 0)', 'RSI_14')},
{r('atr / nullif(close, 0) * 100', 'ATRp_14')}, {r('adx', 'ADX_14')} from f {_W}"""


def _recurrent_sql(final: str = _RECURRENT_FINAL, first: str = f"with recursive {BARS_SQL},") -> str:
    """A recursive walk over row numbers that carries count, seed sum and value of each smoothed column."""
    steps = [("e12", 12, "ema", "b.close"), ("e26", 26, "ema", "b.close"), ("sig", 9, "ema", None), ("gain", 14, "rma", "b.g"), ("loss", 14, "rma", "b.l"), ("atr", 14, "rma", "b.tr"), ("p", 14, "rma", "b.pdm"), ("m", 14, "rma", "b.mdm"), ("adx", 14, "rma", None)]

    def value(k: str, n: int, kind: str, x: str, c: str, s: str) -> str:
        w = 2 / (n + 1) if kind == "ema" else 1 / n
        return f"case when {x} is null then {s} when {c} < {n - 1} then {s} + {x} when {c} = {n - 1} then ({s} + {x}) / {n} else {s} + {w!r} * ({x} - {s}) end"

    def emitted(k: str, n: int, x: str) -> str:
        return f"case when {x} is not null and {k}_c >= {n} then {k}_s end"

    plain = [s for s in steps if s[3]]
    walk = ", ".join(f"w.{k}_c + (case when {x} is null then 0 else 1 end) as {k}_c, {value(k, n, kind, x, f'w.{k}_c', f'w.{k}_s')} as {k}_s" for k, n, kind, x in plain)
    zero = ", ".join(f"0 as {k}_c, cast(0 as double) as {k}_s" for k, *_ in plain)
    out = ", ".join(f"{emitted(k, n, x.replace('b.', ''))} as {k}" for k, n, _, x in plain)

    def chained(k: str, n: int, kind: str, source: str, of: str) -> str:
        return f"""{k}_w(ticker, rn, x, c, s) as (select ticker, cast(0 as bigint), cast(null as double), 0, cast(0 as double) from bars group by ticker union all
  select b.ticker, b.rn, b.{source}, w.c + (case when b.{source} is null then 0 else 1 end), {value(k, n, kind, f'b.{source}', 'w.c', 'w.s')} from {k}_w w join {of} b on b.ticker = w.ticker and b.rn = w.rn + 1)"""

    return f"""{first}
h as (select *, row_number() over w as rn, lag(close) over w as c1, lag(high) over w as h1, lag(low) over w as l1 from bars {_W}),
x as (select ticker, d, rn, close, greatest(high - low, abs(high - c1), abs(low - c1)) as tr, case when c1 is not null then greatest(close - c1, 0) end as g,
  case when c1 is not null then greatest(c1 - close, 0) end as l, case when c1 is not null then case when high - h1 > l1 - low and high - h1 > 0 then high - h1 else 0 end end as pdm,
  case when c1 is not null then case when l1 - low > high - h1 and l1 - low > 0 then l1 - low else 0 end end as mdm from h),
walk as (select ticker, cast(0 as bigint) as rn, cast(null as date) as d, cast(null as double) as close, cast(null as double) as g, cast(null as double) as l, cast(null as double) as tr, cast(null as double) as pdm, cast(null as double) as mdm, {zero} from bars group by ticker
  union all select b.ticker, b.rn, b.d, b.close, b.g, b.l, b.tr, b.pdm, b.mdm, {walk} from walk w join x b on b.ticker = w.ticker and b.rn = w.rn + 1),
y as (select ticker, rn, d, close, {out} from walk where rn > 0),
z as (select *, e12 - e26 as macd, case when p + m = 0 then null else 100 * abs(p - m) / (p + m) end as dx from y),
{chained('sig', 9, 'ema', 'macd', 'z')}, {chained('adx', 14, 'rma', 'dx', 'z')},
f as (select z.*, case when sw.x is not null and sw.c >= 9 then sw.s end as sig, case when aw.x is not null and aw.c >= 14 then aw.s end as adx
  from z join sig_w sw on sw.ticker = z.ticker and sw.rn = z.rn join adx_w aw on aw.ticker = z.ticker and aw.rn = z.rn)
{final}"""


@daily.add("recurrent_indicators", _recurrent_sql())
def recurrent_indicators(spark: SparkSession, d: str) -> DataFrame:
    return shown(indicators.with_recurrent(bars(spark, d, by_ticker=True)).select("ticker", "d", "MACD", "MACDh", "MACD_Hist_Slope_5", "RSI_14", "ATRp_14", "ADX_14"))


_BENCH = "db as (select d, avg(close) as bench from bars group by d)"


@daily.add("relative_strength", f"""with {TREND_SQL}, {_BENCH}, bl as (select d, bench / lag(bench, 20) over (order by d) - 1 as b1, bench / lag(bench, 60) over (order by d) - 1 as b3,
  bench / lag(bench, 126) over (order by d) - 1 as b6 from db)
select ticker, d, {r('coalesce(RET_1M - b1, 0)', 'RS1M')}, {r('coalesce(RET_3M - b3, 0)', 'RS3M')}, {r('coalesce(RET_6M - b6, 0)', 'RS6M')} from trend left join bl using (d)""")
def relative_strength(spark: SparkSession, d: str) -> DataFrame:
    return shown(indicators.relative_strength(indicators.with_trend(bars(spark, d, by_ticker=True)), daily_benchmark(bars(spark, d))).select("ticker", "d", "RS1M", "RS3M", "RS6M"))


@daily.add("relative_strength_aligned", f"""with {BARS_SQL}, db as (select d, avg(close) as bench from bars where day(d) <> 15 group by d),
j as (select ticker, bars.d, close, last_value(bench ignore nulls) over (partition by ticker order by bars.d rows unbounded preceding) as b from bars left join db on bars.d = db.d)
select ticker, d, {r('(close / nullif(lag(close, 20) over w, 0) - 1) - (b / nullif(lag(b, 20) over w, 0) - 1)', 'RS_own')} from j {_W}""")
def relative_strength_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark lacks the 15th of each month here, so that carrying it forward matters."""
    b = bars(spark, d)
    return shown(indicators.relative_strength_aligned(b, daily_benchmark(b.where(F.dayofmonth("d") != 15))).select("ticker", "d", "RS_own"))


TARGETS_SQL = BARS_SQL + f""", {_BENCH},
bf as (select d, lead(bench, 7) over (order by d) / bench - 1 as bench_fwd from db), sd as (select stddev_samp(bench_fwd) as s from bf), cut as (select max(d) - 7 as cut from bars),
n as (select *, first_value(close) over (partition by ticker order by d - date '1970-01-01' range between 7 following and unbounded following) as next_close from bars),
u as (select n.*, coalesce(next_close / nullif(close, 0) - 1, 0) as ret_week, bench_fwd, coalesce(bench_fwd - 2 * s, -0.05) as band_low, coalesce(bench_fwd + 2 * s, 0.05) as band_high from n left join bf using (d) cross join sd),
v as (select *, case when bench_fwd is null then 2 when ret_week < band_low then 1 when ret_week > band_high then 3 else 2 end as target from u)"""


@daily.add("forward_targets", f"""with {TARGETS_SQL} select ticker, d, {', '.join(r(f'case when d <= cut then {c} end', c, 10) for c in ('next_close', 'ret_week', 'bench_fwd', 'band_low', 'band_high'))},
cast(case when d <= cut then target end as bigint) as Target, cast(case when d <= cut then (target = 3)::int end as bigint) as Target3 from v cross join cut""")
def forward_targets(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return shown(indicators.forward_targets(b, daily_benchmark(b)).select("ticker", "d", "next_close", "ret_week", "bench_fwd", "band_low", "band_high", "Target", "Target3"), 10)


@daily.add("return_classes", f"""with {TREND_SQL}, a as (select ticker, d, round(fwd_20, 9) as v from trend where fwd_20 is not null),
b as (select *, (rank() over (partition by d order by v) + (count(*) over (partition by d, v) - 1) / 2) / count(*) over (partition by d) as rk from a)
select ticker, d, {r('rk', 'Return_Rank')}, cast(case when rk >= 0.6 then 1 else 0 end as bigint) as Target_Class from b where rk >= 0.6 or rk <= 0.4""")
def return_classes(spark: SparkSession, d: str) -> DataFrame:
    t = indicators.with_trend(bars(spark, d, by_ticker=True)).select("ticker", "d", F.round("fwd_20", 9).alias("v"))
    return shown(indicators.return_classes(t, "v").select("ticker", "d", "Return_Rank", "Target_Class"))


@daily.add("as_of_snapshot", f"""with {TREND_SQL} select ticker, arg_max(d, d) as d, {r('arg_max(close, d)', 'close')}, {r('max(case when d = last then SMA_50 end)', 'SMA_50')} from
(select *, max(d) over (partition by ticker) as last from trend where d <= date '1998-06-30') group by ticker""")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return shown(indicators.as_of(indicators.with_trend(bars(spark, d, by_ticker=True)).select("ticker", "d", "close", "SMA_50"), "1998-06-30"))


_RULE = f"""with {TREND_SQL}, {_BENCH}, bl as (select d, bench / lag(bench, 20) over (order by d) - 1 as b1, bench / lag(bench, 60) over (order by d) - 1 as b3, bench / lag(bench, 126) over (order by d) - 1 as b6 from db),
s0 as (select trend.*, coalesce(RET_1M - b1, 0) as RS1M, coalesce(RET_3M - b3, 0) as RS3M, coalesce(RET_6M - b6, 0) as RS6M, coalesce(SMA_50 / nullif(SMA_200, 0), 1) as ma, coalesce(close / nullif(SMA_200, 0), 1) as cm,
  coalesce(close > SMA_200, false) as above from trend left join bl using (d)),
s1 as (select *, coalesce(Pct_in_52w_range >= 0.9 and Vol_Rel_20 < 1.2, false) as quiet, coalesce(RS1M >= 0.02, false)::int + coalesce(RS3M >= 0.04, false)::int + coalesce(RS6M >= 0, false)::int as strong from s0),
s2 as (select *, round((above::int + (ma >= 1.02)::int + (cm >= 1.02)::int) / 5.0 * 100, 0) as Trend_Score, round(coalesce(Vol_Rel_20 >= 1.2, false)::int / 4.0 * 100, 0) as Momentum_Score,
  round((strong + coalesce(Ret13_Ratio >= 1.1, false)::int) / 4.0 * 100, 0) as RelStr_Score, round((1 + (not quiet)::int) / 4.0 * 100, 0) as RiskPos_Score from s1)
select ticker, d, {r('Trend_Score')}, {r('Momentum_Score')}, {r('RelStr_Score')}, {r('RiskPos_Score')}, cast(quiet::int as bigint) as NearHigh_NoVol,
case when strong >= 2 and quiet then 'RS Leader | NearHigh NO Vol' when strong >= 2 then 'RS Leader' when quiet then 'NearHigh NO Vol'
  when Trend_Score = greatest(Trend_Score, Momentum_Score, RelStr_Score, RiskPos_Score) then 'Trend' when Momentum_Score = greatest(Momentum_Score, RelStr_Score, RiskPos_Score) then 'Momentum'
  when RelStr_Score >= RiskPos_Score then 'RelStr' else 'RiskPos' end as Setup_Tag,
cast(greatest(0, (RS1M >= 0.1)::int - (ma >= 1.18)::int) as bigint) as ScoreSimple from s2"""


@daily.add("rule_scores_defaults", _RULE)
def rule_scores_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Rules where RSI, MACD, ADX, Aroon, %B and ATR are absent, so that defaults apply."""
    t = indicators.relative_strength(indicators.with_trend(bars(spark, d, by_ticker=True)), daily_benchmark(bars(spark, d)))
    return shown(rules.rule_scores(t).select("ticker", "d", "Trend_Score", "Momentum_Score", "RelStr_Score", "RiskPos_Score", "NearHigh_NoVol", "Setup_Tag", "ScoreSimple"))


@daily.add("rule_scores_defaults_all", _RULE)
def rule_scores_defaults_all(spark: SparkSession, d: str) -> DataFrame:
    """The same rules on every bar of every ticker, over trend and relative strength."""
    return rule_scores_defaults(spark, d)


@daily.add("rule_scores_without_indicators", f"""with {BARS_SQL}, s as (select ticker, d, coalesce(close / nullif(close, 0), 1) as ma, 0.2 as dd, 0.5 as pct, 1.0 as vol from bars)
select ticker, d, round(((ma >= 1.02)::int * 2) / 5.0 * 100, 0) + 0.0 as Trend_Score, 0.0 as Momentum_Score, 25.0 as RelStr_Score, round((1 + (not (pct >= 0.9 and vol < 1.2))::int) / 4.0 * 100, 0) + 0.0 as RiskPos_Score,
cast((pct >= 0.9 and vol < 1.2)::int as bigint) as NearHigh_NoVol, 'RiskPos' as Setup_Tag, cast(0 as bigint) as ScoreSimple from s""")
def rule_scores_without_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Rules on bars without any indicator: every column has its default, the averages the close."""
    rows = bars(spark, d).select("ticker", "d", "close")
    return shown(rules.rule_scores(rows).select("ticker", "d", "Trend_Score", "Momentum_Score", "RelStr_Score", "RiskPos_Score", "NearHigh_NoVol", "Setup_Tag", "ScoreSimple"))


_RULES_SQL = f"""with recursive {TREND_SQL}, {_BENCH}, bl as (select d, bench / lag(bench, 20) over (order by d) - 1 as b1, bench / lag(bench, 60) over (order by d) - 1 as b3,
  bench / lag(bench, 126) over (order by d) - 1 as b6 from db),
osc as (with {_OSC_SQL} select ticker, d, case when n >= 20 then (close - (m - 2 * s)) / nullif(4 * s, 0) end as PctB, au - ad as aroon from g),
rec as ({_recurrent_sql(f"""select ticker, d, macd as MACD, (macd - sig) - lag(macd - sig, 5) over w as slope, 100 * gain / nullif(gain + loss, 0) as RSI, atr / nullif(close, 0) * 100 as atrp, adx from f {_W}""", "with recursive")}),
s0 as (select trend.*, PctB, aroon, MACD, slope, RSI, atrp, adx, coalesce(RET_1M - b1, 0) as RS1M, coalesce(RET_3M - b3, 0) as RS3M, coalesce(RET_6M - b6, 0) as RS6M,
  coalesce(SMA_50 / nullif(SMA_200, 0), 1) as ma, coalesce(close / nullif(SMA_200, 0), 1) as cm, coalesce(close > SMA_200, false) as above
  from trend join osc using (ticker, d) join rec using (ticker, d) left join bl using (d)),
s1 as (select *, coalesce(Vol_Rel_20 >= 1.2, false) as loud, coalesce(Pct_in_52w_range >= 0.9, false) as near, coalesce(adx >= 20, false) as moving,
  coalesce(RS1M >= 0.02, false)::int + coalesce(RS3M >= 0.04, false)::int + coalesce(RS6M >= 0, false)::int as strong from s0),
s2 as (select *, near and loud and moving as breakout, near and coalesce(Vol_Rel_20 < 1.2, false) as quiet,
  coalesce(Pct_in_52w_range between 0.2 and 0.5 and Drawdown_52w between 0.2 and 0.4 and slope > 0 and RSI >= 45, false) as recovery,
  above and coalesce(ma >= 1 and aroon >= 20 and adx between 18 and 40 and RSI between 45 and 55 and PctB between 0.2 and 0.5 and slope > 0, false) as pullback,
  coalesce(RSI between 28 and 40 and slope > 0 and PctB <= 0.2 and adx < 25, false) as rebound from s1),
s3 as (select *,
  round((above::int + (ma >= 1.02)::int + (cm >= 1.02)::int + coalesce(aroon >= 50, false)::int + coalesce(adx between 18 and 35, false)::int) / 5.0 * 100, 0) as Trend_Score,
  round((coalesce(RSI between 58 and 72, false)::int + coalesce(MACD > 0, false)::int + coalesce(slope > 0, false)::int + (loud or coalesce(PctB between 0.8 and 1.1, false))::int) / 4.0 * 100, 0) as Momentum_Score,
  round((strong + coalesce(Ret13_Ratio >= 1.1, false)::int) / 4.0 * 100, 0) as RelStr_Score,
  round((breakout::int + recovery::int + coalesce(atrp <= 4, false)::int + (not quiet)::int) / 4.0 * 100, 0) as RiskPos_Score,
  concat_ws(' | ', case when pullback then 'Trend+Pullback' end, case when breakout then 'Breakout+Vol' end, case when strong >= 2 then 'RS Leader' end,
    case when recovery then 'Value Recov' end, case when rebound then 'Rebound' end, case when quiet then 'NearHigh NO Vol' end) as tags from s2)
select ticker, d, {r('Trend_Score')}, {r('Momentum_Score')}, {r('RelStr_Score')}, {r('RiskPos_Score')}, cast(quiet::int as bigint) as NearHigh_NoVol,
case when tags <> '' then tags when Trend_Score = greatest(Trend_Score, Momentum_Score, RelStr_Score, RiskPos_Score) then 'Trend'
  when Momentum_Score = greatest(Momentum_Score, RelStr_Score, RiskPos_Score) then 'Momentum' when RelStr_Score >= RiskPos_Score then 'RelStr' else 'RiskPos' end as Setup_Tag,
cast(greatest(0, 2 * coalesce(atrp >= 3 and atrp <= 5.5, false)::int + coalesce(atrp > 5.5 and atrp <= 8, false)::int - 2 * coalesce(atrp < 1.8, false)::int + (RS1M >= 0.1)::int
  + coalesce(atrp <= 3 and RET_6M <= -0.08, false)::int + coalesce(atrp > 3 and RET_1M > -0.08, false)::int - (ma >= 1.18)::int - coalesce(PctB >= 0.9 and Vol_Rel_20 < 1.2, false)::int) as bigint) as ScoreSimple from s3"""


@daily.add("rule_scores", _RULES_SQL)
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rules over the full set of indicators."""
    full = indicators.relative_strength(indicators.with_all(bars(spark, d, by_ticker=True)), daily_benchmark(bars(spark, d)))
    return shown(rules.rule_scores(full).select("ticker", "d", "Trend_Score", "Momentum_Score", "RelStr_Score", "RiskPos_Score", "NearHigh_NoVol", "Setup_Tag", "ScoreSimple"))


#: The indicators that the coverage report expects, in its order.
EXPECTED = [
    "MFI_14", "MACDh_12_26_9", "PctB", "OBV_trend", "STOCH_Cross", "ADX_14", "MA_SLOPE_20", "Cross_Signal", "ATRp_14", "VROC_14", "Consecutive_Volume_Growth", "FIB_Range_90D", "RSI_14", "MACD_Hist_Slope_5",
    "RET_1M", "RET_3M", "RET_6M", "Aroon_Diff_25", "Vol_Rel_20", "Vol_StreakUp", "Days_since_Golden", "Days_since_Death", "Ret13_Ratio", "Pct_in_52w_range", "Drawdown_52w", "SMA_50", "SMA_200",
    "RS1M_SPY", "RS3M_SPY", "RS6M_SPY",
]
_TREND_EXPECTED = [c for c in EXPECTED if c in _TREND]
_COVERED = " + ".join(f"(count({c}) > 0)::int" for c in _TREND_EXPECTED)
#: Always there: Cross_Signal and the streaks, days since crossings, STOCH_Cross, relative strength.
_COVERAGE_SQL = f"""with recursive {TREND_SQL},
osc as (with {_OSC_SQL} select ticker, d, case when n >= 15 then 100 * pos / nullif(pos + neg, 0) end as MFI, case when n >= 20 then (close - (m - 2 * s)) / nullif(4 * s, 0) end as PctB, au - ad as aroon from g),
rec as ({_recurrent_sql(f"""select ticker, d, macd - sig as hist, (macd - sig) - lag(macd - sig, 5) over w as slope, 100 * gain / nullif(gain + loss, 0) as RSI, atr / nullif(close, 0) * 100 as atrp, adx from f {_W}""", "with recursive")}),
p as (select ticker, count(*) as n_rows, max(d) as last_day, cast(9 + {_COVERED} + (count(MFI) > 0)::int + (count(PctB) > 0)::int + (count(aroon) > 0)::int + (count(hist) > 0)::int + (count(slope) > 0)::int
  + (count(RSI) > 0)::int + (count(atrp) > 0)::int + (count(adx) > 0)::int as bigint) as present from trend join osc using (ticker, d) join rec using (ticker, d) group by ticker having count(*) >= 100)
select *, case when present = 30 then 'PASS' when present >= 24 then 'WARN' else 'FAIL' end as status from p"""


@daily.add("indicator_coverage", _COVERAGE_SQL)
def indicator_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tickers with enough history, and how many of the expected indicators each has."""
    b = indicators.enough_history(bars(spark, d, by_ticker=True))
    full = indicators.relative_strength(indicators.with_cross_days(indicators.with_all(b)), daily_benchmark(b))
    renamed = full.withColumnsRenamed({"MACDh": "MACDh_12_26_9", "RS1M": "RS1M_SPY", "RS3M": "RS3M_SPY", "RS6M": "RS6M_SPY"})
    return shown(metrics.coverage(renamed, EXPECTED))


@daily.add("last_rows_per_ticker", f"with {BARS_SQL}, k as (select *, row_number() over (partition by ticker order by d desc) as k from bars) select ticker, d, {r('close', digits=10)} from k where k <= 52")
def last_rows_per_ticker(spark: SparkSession, d: str) -> DataFrame:
    return shown(parity.last_per_ticker(bars(spark, d)).select("ticker", "d", "close"), 10)


@daily.add("cleaned_panel", f"""with {BARS_SQL}, a as (select ' s' || ticker || ' ' as t, d, cast(cast(close as decimal(20,10)) as varchar) || case when ticker % 7 = 0 then 'x' else '' end as px, case when volume > 25 then 0.7 when volume > 10 then 0.2 end as label, volume from bars),
b as (select upper(trim(t)) as Ticker, d as Data_Date, try_cast(px as double) as Ret_Una_sem, case when label >= 0.5 then 1 when label is not null then 0 end as y, coalesce(cast(null as double), 0) as absent, volume from a)
select Ticker, Data_Date, {r('Ret_Una_sem', digits=10)}, cast(y as bigint) as y, {r('absent')}, {r('volume')} from b
where Ret_Una_sem > 5 and Ret_Una_sem < 500 and Data_Date between date '1996-01-01' and date '1999-12-31' and ((y is null)::int + 0) / 2.0 <= 0.3""")
def cleaned_panel(spark: SparkSession, d: str) -> DataFrame:
    raw = bars(spark, d).select(
        F.concat(F.lit(" s"), F.col("ticker").cast("string"), F.lit(" ")).alias("Ticker"), F.col("d").alias("Data Date"),
        F.concat(F.col("close").cast("decimal(20,10)").cast("string"), F.when(F.col("ticker") % 7 == 0, "x").otherwise("")).alias("Ret. Una sem"),
        F.when(F.col("volume") > 25, 0.7).when(F.col("volume") > 10, 0.2).alias("label"), "volume", F.lit(1).alias("Data.Date"),
    )
    c = panel.ensure_numeric(panel.cleaned_columns(raw), ["Ret_Una_sem", "absent"])
    price = panel.first_present(c, ["Close", "Ret_Una_sem"])
    c = panel.require(c, ["Ticker", "Data_Date"]).withColumn("Ticker", panel.normal_ticker(F.col("Ticker"))).withColumn("y", panel.binary_label(F.col("label"))).withColumn("absent", F.coalesce("absent", F.lit(0.0)))
    c = panel.mostly_present(panel.price_between(c, price, 5, 500).where(F.col("Data_Date").between("1996-01-01", "1999-12-31")), ["y", "volume"], 0.3)
    return shown(c.select("Ticker", "Data_Date", "Ret_Una_sem", "y", "absent", "volume"), 10)


@daily.add("volume_rank", f"""with {BARS_SQL} select ticker, d, {r('(rank() over (partition by d order by volume) + (count(*) over (partition by d, volume) - 1) / 2) / count(*) over (partition by d)', 'pct')} from bars""")
def volume_rank(spark: SparkSession, d: str) -> DataFrame:
    return shown(bars(spark, d).select("ticker", "d", percentile_rank(F.col("volume"), "d").alias("pct")))


@daily.add("fingerprint")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return parity.fingerprint(spark.read.parquet(f"{d}/lineitem.parquet"))

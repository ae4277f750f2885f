"""Registered queries over the weekly panel: features, masks, cross-section, selections. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.windows import percentile_rank
from quarry.operators import asof, metrics, panel, validate
from quarry.plans.registry import Catalog, r, shown
from quarry.sources.fixtures import SECTORS_SQL, WEEKLY_SQL, bars, sectors, weekly, weekly_benchmark

weeks = Catalog()
_W = "window w as (partition by ticker order by week_key)"


def _win(agg: str, c: str, n: int, least: int) -> str:
    w = f"over (partition by ticker order by week_key rows between {n - 1} preceding and current row)"
    return f"case when count({c}) {w} >= {least} then {agg}({c}) {w} end"


def _gap(x: str) -> str:
    return f"case when week_key - lag(week_key) over w <= 14 then lag({x}) over w end"


def pct_sql(c: str, by: str = "week_key") -> str:
    return f"case when {c} is not null then (rank() over (partition by {by} order by {c} nulls last) + (count({c}) over (partition by {by}, {c}) - 1) / 2) / count({c}) over (partition by {by}) end"


FEATURES_SQL = WEEKLY_SQL + f""",
f0 as (select *, close / nullif({_gap('close')}, 0) - 1 as Ret_1w_calc, ln(close / nullif({_gap('close')}, 0)) as LogRet_1w, close / nullif(lag(close, 13) over w, 0) - 1 as RET_3M,
  close / nullif(lag(close, 26) over w, 0) - 1 as RET_6M, close / nullif({_win('max', 'close', 4, 2)}, 0) as PriceToHigh4w, close / nullif({_win('min', 'close', 4, 2)}, 0) as PriceToLow4w,
  (volume - {_win('avg', 'volume', 8, 4)}) / nullif({_win('stddev_samp', 'volume', 8, 4)}, 0) as VolZScore_8w from weekly {_W}),
f1 as (select *, abs(Ret_1w_calc) / (close * nullif(volume, 0)) as il from f0),
feat as (select *, {_win('stddev_samp', 'LogRet_1w', 12, 6)} as Vol_12w, Ret_1w_calc - {_gap('Ret_1w_calc')} as MomAccel_1w, {_win('avg', 'il', 4, 2)} as illiq from f1 {_W})"""
_FEATURES = ["Ret_1w_calc", "LogRet_1w", "Vol_12w", "MomAccel_1w", "PriceToHigh4w", "PriceToLow4w", "VolZScore_8w", "RET_3M", "RET_6M"]


def week_panel(spark: SparkSession, d: str) -> DataFrame:
    return weekly(bars(spark, d, by_ticker=True))


@weeks.add("weekly_top_movers", f"""with {WEEKLY_SQL}, a as (select ticker, week_key, round(close / nullif({_gap('close')}, 0) - 1, 9) as ret from weekly {_W}),
b as (select *, {pct_sql('ret')} as pct, row_number() over (partition by week_key order by ret desc, ticker) as place from a where ret is not null)
select week_key, place, ticker, {r('ret')}, {r('pct')} from b where place <= 5""")
def weekly_top_movers(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest movers of each week, with their percentile."""
    p = week_panel(spark, d).withColumn("ret", F.round(F.col("close") / F.nullif(panel.gap_shift(F.col("close")), F.lit(0.0)) - 1, 9)).where("ret is not null")
    p = p.withColumn("pct", percentile_rank(F.col("ret"), "week_key"))
    return shown(metrics.top(p.withColumn("score", F.col("ret")), 5).select("week_key", "place", "ticker", "ret", "pct"))


@weeks.add("weekly_panel", f"with {WEEKLY_SQL} select ticker, week_key, {r('close', digits=10)}, {r('high', digits=10)}, {r('volume')}, data_date from weekly")
def weekly_panel(spark: SparkSession, d: str) -> DataFrame:
    return shown(week_panel(spark, d), 10)


@weeks.add("panel_features", f"with {FEATURES_SQL} select ticker, week_key, {', '.join(map(r, _FEATURES))}, {r('RET_3M / (Vol_12w + 1e-6)', 'RiskAdjMom_3M')}, {r('RET_6M / (Vol_12w + 1e-6)', 'RiskAdjMom_6M')} from feat")
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.with_returns(week_panel(spark, d)).select("ticker", "week_key", *_FEATURES, "RiskAdjMom_3M", "RiskAdjMom_6M"))


_R12 = "over (partition by ticker order by week_key rows between 11 preceding and current row)"
_R52 = "over (partition by ticker order by week_key rows between 51 preceding and current row)"


@weeks.add("lottery_and_discreteness", f"""with {FEATURES_SQL}, a as (select *, case when count(Ret_1w_calc) {_R12} >= 5 then list(greatest(-0.99, least(10, Ret_1w_calc))) filter (Ret_1w_calc is not null) {_R12} end as l,
  case when Ret_1w_calc > -1 then ln(1 + Ret_1w_calc) end as g from feat),
b as (select *, list_slice(list_reverse_sort(l), 1, 5) as best, count(Ret_1w_calc) {_R52} as n from a)
select ticker, week_key, {r('-list_sum(best) / len(best)', 'MAX5_21d_neg')}, {r(f"case when {_win('max', 'high', 52, 26)} is not null then least(1, greatest(0, close / {_win('max', 'high', 52, 26)})) end", 'Ratio_52w_High')},
{r(f'case when n >= 20 then sign(sum(g) {_R52}) * (sum((Ret_1w_calc < 0)::int) {_R52} / n - sum((Ret_1w_calc > 0)::int) {_R52} / n) end', 'Information_Discreteness_12M')} from b""")
def lottery_and_discreteness(spark: SparkSession, d: str) -> DataFrame:
    p = panel.with_lottery(panel.with_returns(week_panel(spark, d)))
    return shown(p.select("ticker", "week_key", "MAX5_21d_neg", "Ratio_52w_High", "Information_Discreteness_12M"))


@weeks.add("illiquidity", f"""with {FEATURES_SQL}, a as (select ticker, week_key, ln(1 + illiq) as v from feat), q as (select week_key, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from a group by week_key)
select ticker, week_key, {r('case when v is not null then least(greatest(v, lo), hi) end', 'Amihud_ILLIQ_20d')} from a join q using (week_key)""")
def illiquidity(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.illiquidity(panel.with_returns(week_panel(spark, d))).select("ticker", "week_key", "Amihud_ILLIQ_20d"))


MASKS_SQL = FEATURES_SQL + f""", m0 as (select *, close * nullif(volume, 0) as dv, (coalesce(abs(Ret_1w_calc) < 1e-4, false))::int as still from feat),
masks as (select *, coalesce(close > 5, false) as u1, coalesce({_win('avg', 'dv', 4, 2)} > 500, false) as u2, coalesce({_win('avg', 'still', 12, 6)} < 0.2, false) as u3 from m0)"""


def masked(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_masks(panel.with_returns(week_panel(spark, d)), "Ret_1w_calc", dollars=500)


@weeks.add("universe_masks", f"with {MASKS_SQL} select ticker, week_key, u1 as univ_price, u2 as univ_volume, u3 as univ_moves, u1 and u2 and u3 as univ_pass from masks")
def universe_masks(spark: SparkSession, d: str) -> DataFrame:
    return masked(spark, d).select("ticker", "week_key", "univ_price", "univ_volume", "univ_moves", "univ_pass")


@weeks.add("universe_funnel", f"""with {MASKS_SQL} select count(distinct ticker) as all_tickers, count(distinct case when u1 then ticker end) as after_price, count(distinct case when u1 and u2 then ticker end) as after_volume,
count(distinct case when u1 and u2 and u3 then ticker end) as after_all from masks""")
def universe_funnel(spark: SparkSession, d: str) -> DataFrame:
    return panel.funnel(masked(spark, d))


@weeks.add("tickers_per_week", f"""with {MASKS_SQL}, a as (select week_key, count(distinct ticker) as n, count(distinct case when u1 and u2 and u3 then ticker end) as m from masks group by week_key)
select {r('median(n)', 'before_masks')}, {r('median(m)', 'after_masks')} from a""")
def tickers_per_week(spark: SparkSession, d: str) -> DataFrame:
    n = masked(spark, d).groupBy("week_key").agg(F.countDistinct("ticker").alias("n"), F.countDistinct(F.when(F.col("univ_pass"), F.col("ticker"))).alias("m"))
    return shown(n.agg(F.percentile("n", F.lit(0.5)).alias("before_masks"), F.percentile("m", F.lit(0.5)).alias("after_masks")))


_RANKED = ["Ret_1w_calc", "Vol_12w", "MomAccel_1w", "PriceToHigh4w", "GapPct", "RET_3M", "RET_6M", "RiskAdjMom_3M", "RiskAdjMom_6M"]
_RANK_SQL = FEATURES_SQL + ", rk as (select ticker, week_key, " + ", ".join(f"round({c}, 9) as {c}" for c in _RANKED) + " from (select *, Ret_1w_calc as GapPct, RET_3M / (Vol_12w + 1e-6) as RiskAdjMom_3M, RET_6M / (Vol_12w + 1e-6) as RiskAdjMom_6M from feat))"


@weeks.add("rank_features", f"with {_RANK_SQL} select ticker, week_key, {', '.join(r(pct_sql(c), c + '__rank') for c in _RANKED)}, {r('1 - ' + pct_sql('Ret_1w_calc'), 'ReversalSignal_1w')} from rk")
def rank_features(spark: SparkSession, d: str) -> DataFrame:
    p = panel.with_returns(week_panel(spark, d)).select("ticker", "week_key", *(F.round(c, 9).alias(c) for c in _RANKED))
    ranked = panel.ranks(p, _RANKED).withColumn("ReversalSignal_1w", 1 - F.col("Ret_1w_calc__rank"))
    return shown(ranked.select("ticker", "week_key", *(f"{c}__rank" for c in _RANKED), "ReversalSignal_1w"))


@weeks.add("sector_neutral", f"""with {FEATURES_SQL}, {SECTORS_SQL} select ticker, week_key, {', '.join(r(f'{c} - avg({c}) over (partition by week_key, sector)', c + '__sn') for c in ('Ret_1w_calc', 'Vol_12w'))} from feat join sect using (ticker)""")
def sector_neutral(spark: SparkSession, d: str) -> DataFrame:
    p = panel.with_returns(week_panel(spark, d)).join(sectors(spark, d), "ticker")
    return shown(panel.sector_neutral(p, ["Ret_1w_calc", "Vol_12w"]).select("ticker", "week_key", "Ret_1w_calc__sn", "Vol_12w__sn"))


REGIME_SQL = WEEKLY_SQL + """, bench as (select week_key, avg(close) as bc from weekly group by week_key),
g0 as (select week_key, bc / lag(bc, 4) over (order by week_key) - 1 as r4, ln(bc / lag(bc) over (order by week_key)) as l from bench),
g1 as (select *, case when count(l) over z >= 2 then stddev_samp(l) over z end as vol4 from g0 window z as (order by week_key rows between 3 preceding and current row)),
reg as (select week_key, r4, vol4, case when r4 is null or vol4 is null then null when vol4 > (select quantile_cont(vol4, 0.75) from g1) then 0 when r4 < -0.02 then 1 when r4 > 0.02 then 3 else 2 end as regime from g1)"""


@weeks.add("market_regime", f"with {REGIME_SQL} select week_key, {r('r4')}, {r('vol4')}, cast(regime as bigint) as regime from reg")
def market_regime(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.regime(weekly_benchmark(week_panel(spark, d))))


@weeks.add("regime_join", f"with {REGIME_SQL} select regime::bigint as regime, count(*) as n, {r('avg(close)', 'mean_close')} from weekly left join reg using (week_key) group by regime")
def regime_join(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d)
    return shown(p.join(panel.regime(weekly_benchmark(p)), "week_key", "left").groupBy("regime").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")))


@weeks.add("regime_expanding", f"""with {REGIME_SQL}, q as (select *, quantile_cont(vol4, 0.75) over (order by week_key rows unbounded preceding) as q from g1)
select week_key, {r('r4')}, {r('vol4')}, cast(case when r4 is null or vol4 is null then null when vol4 > q then 0 when r4 < -0.02 then 1 when r4 > 0.02 then 3 else 2 end as bigint) as regime from q""")
def regime_expanding(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.regime(weekly_benchmark(week_panel(spark, d)), expanding=True))


@weeks.add("time_decay", f"with {WEEKLY_SQL} select ticker, week_key, {r('pow(0.5, ((select max(week_key) from weekly) - week_key) / 7.0 / 26)', 'weight')} from weekly")
def time_decay(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d)
    latest = p.agg(F.max("week_key").alias("_m"))
    return shown(p.crossJoin(F.broadcast(latest)).select("ticker", "week_key", F.pow(F.lit(0.5), F.datediff("_m", "week_key") / 7 / 26).alias("weight")))


@weeks.add("date_spread", f"with {WEEKLY_SQL} select week_key, min(data_date) as first_date, max(data_date) as last_date, count(distinct data_date) as n_dates from weekly group by week_key having count(distinct data_date) > 1")
def date_spread(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.date_spread(week_panel(spark, d)))


@weeks.add("first_per_month", f"""with {WEEKLY_SQL}, a as (select *, row_number() over (partition by ticker, date_trunc('month', week_key) order by week_key) as k from weekly)
select ticker, week_key, {r('close', digits=10)} from a where k = 1""")
def first_per_month(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d).withColumn("month", F.date_trunc("month", "week_key"))
    return shown(panel.first_of(p, ["ticker", "month"], [F.col("week_key")]).select("ticker", "week_key", "close"), 10)


@weeks.add("filled_gaps", f"""with {WEEKLY_SQL}, a as (select ticker, week_key, case when ticker % 3 <> 0 and day(week_key) > 9 then close end as v from weekly)
select ticker, week_key, {r('coalesce(first_value(v ignore nulls) over (partition by ticker order by week_key rows between current row and unbounded following), last_value(v ignore nulls) over (partition by ticker order by week_key rows unbounded preceding), 0)', 'back_first', 10)},
{r('coalesce(last_value(v ignore nulls) over (partition by ticker order by week_key rows unbounded preceding), first_value(v ignore nulls) over (partition by ticker order by week_key rows between current row and unbounded following), 0)', 'forth_first', 10)} from a""")
def filled_gaps(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d).withColumn("v", panel.finite(F.when((F.col("ticker") % 3 != 0) & (F.dayofmonth("week_key") > 9), F.col("close"))))
    fill = lambda first: F.coalesce(panel.filled(F.col("v"), first), F.lit(0.0))
    return shown(p.select("ticker", "week_key", fill(True).alias("back_first"), fill(False).alias("forth_first")), 10)


@weeks.add("anchor_week", f"""with {WEEKLY_SQL}, l as (select ticker, max(week_key) as w from weekly group by ticker), c as (select w, count(*) as n from l group by w)
select (select w from c order by n desc, w desc limit 1) as anchor, {r('max(n) / sum(n)', 'coverage')}, cast(sum(n) as bigint) as tickers from c""")
def anchor_week(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.anchor(week_panel(spark, d)))


_CUT = "weekly.ticker % 4 <> 1 or weekly.week_key <= date '2001-06-03'"


@weeks.add("missing_at_anchor", f"""with {WEEKLY_SQL}, s as (select * from weekly where {_CUT}), l as (select ticker, max(week_key) as w from s group by ticker), c as (select w, count(*) as n from l group by w),
a as (select w as anchor from c order by n desc, w desc limit 1) select ticker, w as last_week, anchor from l cross join a where w < anchor""")
def missing_at_anchor(spark: SparkSession, d: str) -> DataFrame:
    return metrics.missing_at_anchor(week_panel(spark, d).where("ticker % 4 <> 1 or week_key <= date '2001-06-03'"))


@weeks.add("anchor_rows", f"""with {WEEKLY_SQL}, l as (select ticker, max(week_key) as w from weekly group by ticker), c as (select w, count(*) as n from l group by w),
a as (select w as anchor, n / (select sum(n) from c) as cov from c order by n desc, w desc limit 1)
select ticker, week_key, {r('close', digits=10)} from weekly join l using (ticker) cross join a where case when cov >= 0.5 then week_key = anchor else week_key = w end""")
def anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.anchor_rows(week_panel(spark, d)).select("ticker", "week_key", "close"), 10)


_PROFILE = ["Ret_1w_calc", "Vol_12w", "VolZScore_8w"]


def _profile_sql(c: str) -> str:
    q = ", ".join(r(f"quantile_cont({c}, {s})", f"q{round(100 * s)}") for s in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0))
    return f"select '{c}' as feature, {r(f'1 - count({c}) / count(*)', 'null_share')}, {q}, {r(f'skewness({c})', 'skew')} from feat"


@weeks.add("feature_profile", f"with {FEATURES_SQL} " + " union all ".join(map(_profile_sql, _PROFILE)))
def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.profile(panel.with_returns(week_panel(spark, d)), _PROFILE))


@weeks.add("feature_correlation", f"""with {FEATURES_SQL}, c as (select 'MomAccel_1w' as feature, b, x from (select abs(corr(MomAccel_1w, Ret_1w_calc)) as Ret_1w_calc, abs(corr(MomAccel_1w, Vol_12w)) as Vol_12w from feat) unpivot (x for b in (Ret_1w_calc, Vol_12w))
union all select 'PriceToHigh4w', b, x from (select abs(corr(PriceToHigh4w, Ret_1w_calc)) as Ret_1w_calc, abs(corr(PriceToHigh4w, Vol_12w)) as Vol_12w from feat) unpivot (x for b in (Ret_1w_calc, Vol_12w)))
select feature, arg_max(b, x) as base, {r('max(x)', 'max_abs_corr')}, max(x) > 0.85 as alert from c group by feature""")
def feature_correlation(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.correlations(panel.with_returns(week_panel(spark, d)), ["MomAccel_1w", "PriceToHigh4w"], ["Ret_1w_calc", "Vol_12w"]))


@weeks.add("walk_forward_folds", f"""with {WEEKLY_SQL}, n0 as (select week_key, row_number() over (order by week_key) - 1 as w, count(*) over () as n from (select distinct week_key from weekly)),
k as (select *, greatest(3, (n - 39) // 6) as size from n0), j as (select unnest(range(6)) as j), b as (select distinct n, size, j, n - size - j * (size + 4) as vs from k cross join j),
b2 as (select *, row_number() over (order by vs) as fold from b where vs > 39)
select cast(fold as bigint) as fold, case when w < vs - 4 then 'train' else 'val' end as role, week_key from k join b2 on w < vs - 4 or (w >= vs and w < vs + b2.size)""")
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    return shown(validate.splits(week_panel(spark, d)))


@weeks.add("overlapping_folds", f"""with {WEEKLY_SQL}, n0 as (select week_key, row_number() over (order by week_key) - 1 as w, count(*) over () as n from (select distinct week_key from weekly)),
k as (select *, greatest(3, n // 12) as size from n0), j as (select unnest(range(6)) as j), b as (select distinct n, size, j + 1 as fold, cast(floor(35 + (n - 1 - size - 35) * j / 5.0) as bigint) as te from k cross join j)
select fold, case when w < te then 'train' else 'val' end as role, week_key from k join b on w < te or (w >= te + 1 and w < least(b.n, te + 1 + b.size))""")
def overlapping_folds(spark: SparkSession, d: str) -> DataFrame:
    return shown(validate.splits(week_panel(spark, d), validate.overlapping_bounds))


@weeks.add("fold_sizes", f"""with {WEEKLY_SQL}, n0 as (select week_key, row_number() over (order by week_key) - 1 as w, count(*) over () as n from (select distinct week_key from weekly)),
k as (select *, greatest(3, (n - 39) // 6) as size from n0), j as (select unnest(range(6)) as j), b as (select distinct n, size, j, n - size - j * (size + 4) as vs from k cross join j),
b2 as (select *, row_number() over (order by vs) as fold from b where vs > 39),
f as (select fold, w < vs - 4 as tr, week_key from k join b2 on w < vs - 4 or (w >= vs and w < vs + b2.size))
select cast(fold as bigint) as fold, count(*) filter (tr) as n_train, count(*) filter (not tr) as n_val, count(*) filter (tr) >= 2000 and count(*) filter (not tr) >= 200 as used from weekly join f using (week_key) group by fold""")
def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d)
    return shown(validate.fold_sizes(p, validate.splits(p)))


@weeks.add("fold_overlap", f"""with {WEEKLY_SQL}, n0 as (select week_key, row_number() over (order by week_key) - 1 as w, count(*) over () as n from (select distinct week_key from weekly)),
k as (select *, greatest(3, n // 12) as size from n0), j as (select unnest(range(6)) as j), b as (select distinct n, size, j + 1 as fold, cast(floor(35 + (n - 1 - size - 35) * j / 5.0) as bigint) as te from k cross join j)
select week_key, count(*) as n from k join b on w >= te + 1 and w < least(b.n, te + 1 + b.size) group by week_key having count(*) > 1""")
def fold_overlap(spark: SparkSession, d: str) -> DataFrame:
    return validate.overlap(validate.splits(week_panel(spark, d), validate.overlapping_bounds))


@weeks.add("holdout_rows", f"with {WEEKLY_SQL}, h as (select distinct week_key from weekly order by week_key desc limit 20) select ticker, week_key, {r('close', digits=10)} from weekly semi join h using (week_key)")
def holdout_rows(spark: SparkSession, d: str) -> DataFrame:
    p = week_panel(spark, d)
    return shown(p.join(F.broadcast(validate.holdout_weeks(p)), "week_key", "left_semi").select("ticker", "week_key", "close"), 10)


@weeks.add("week_calendar", f"""with {WEEKLY_SQL}, f as (select cast(unnest(generate_series((select max(week_key) from weekly) - interval 84 day, (select max(week_key) from weekly) + interval 14 day, interval 7 day)) as date) as week_key)
select week_key, week_key in (select week_key from weekly) as present from f""")
def week_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The last weeks and two to come, and whether the panel has them (an anti-join finds those it lacks)."""
    p = week_panel(spark, d).select("week_key").distinct()
    dates = p.agg(F.max("week_key").alias("m")).select(F.explode(F.sequence(F.date_sub("m", 84), F.date_add("m", 14), F.expr("interval 7 days"))).alias("week_key"))
    gone = dates.join(p, "week_key", "left_anti").withColumn("present", F.lit(False))
    return gone.unionByName(dates.intersect(p).withColumn("present", F.lit(True)))


@weeks.add("incremental_momentum", f"""with {WEEKLY_SQL} select ticker, week_key, {r('close / nullif(lag(close) over w, 0) - 1', 'plain_ret')}, {r('close / nullif(lag(close, 4) over w, 0) - 1', 'ret_4')} from weekly {_W}""")
def incremental_momentum(spark: SparkSession, d: str) -> DataFrame:
    """The variant without the gap rule."""
    w = Window.partitionBy("ticker").orderBy("week_key")
    ret = lambda n: F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1
    return shown(week_panel(spark, d).select("ticker", "week_key", ret(1).alias("plain_ret"), ret(4).alias("ret_4")))


_BUSY_SQL = WEEKLY_SQL + ", busy as (select ticker, d as day, close as busy_close from bars where volume >= 45)"


def _asof(spark: SparkSession, d: str, direction: str, tolerance: float | None = None) -> DataFrame:
    """Each week's row with a day of large volume of its ticker."""
    busy = bars(spark, d).where("volume >= 45").select("ticker", F.col("d").alias("day"), F.col("close").alias("busy_close"))
    found = asof.asof_join(week_panel(spark, d).select("ticker", "week_key", "close"), busy, ["ticker"], "week_key", "day", direction, tolerance)
    return shown(found)


@weeks.add("asof_backward", f"with {_BUSY_SQL} select w.ticker, w.week_key, {r('w.close', 'close')}, day, {r('busy_close')} from weekly w asof left join busy b on w.ticker = b.ticker and w.week_key >= b.day")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "backward")


@weeks.add("asof_forward", f"""with {_BUSY_SQL}, j as (select w.ticker, w.week_key, close, day, busy_close, coalesce(day - w.week_key <= 30, false) as near from weekly w asof left join busy b on w.ticker = b.ticker and w.week_key <= b.day)
select ticker, week_key, {r('close')}, case when near then day end as day, {r('case when near then busy_close end', 'busy_close')} from j""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "forward", 30)


@weeks.add("asof_nearest", f"""with {_BUSY_SQL}, x as (select w.ticker, w.week_key, close, day as d1, busy_close as c1 from weekly w asof left join busy b on w.ticker = b.ticker and w.week_key >= b.day),
y as (select x.*, day as d2, busy_close as c2 from x asof left join busy b on x.ticker = b.ticker and x.week_key <= b.day), z as (select *, d1 is null or coalesce(d2 - week_key < week_key - d1, false) as late from y),
q as (select *, case when late then d2 else d1 end as day0, case when late then c2 else c1 end as c0 from z)
select ticker, week_key, {r('close')}, case when abs(day0 - week_key) <= 10 then day0 end as day, {r('case when abs(day0 - week_key) <= 10 then c0 end', 'busy_close')} from q""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "nearest", 10)

"""Registered queries over the scored panel: ranking metrics, reports, blending and comparison. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import boosting, metrics, panel, parity, validate
from quarry.plans.registry import Catalog, r, shown
from quarry.sources.fixtures import SCORED_SQL
from quarry.sources.fixtures import scored as scored_rows

ranking = Catalog()
KNOWN_SQL = SCORED_SQL + ",\nkn as (select * from scored where score is not null and y is not null),\npk as (select *, row_number() over (partition by week_key order by score desc, ticker) as place from kn),\nhas as (select * from scored where score is not null),\npl as (select *, row_number() over (partition by week_key order by score desc, ticker) as place from has)"


@ranking.add("scored_panel", f"with {SCORED_SQL} select ticker, week_key, sector, {r('score')}, {r('fwd_ret')}, {r('bench_ret')}, cast(y as bigint) as y from scored")
def scored_panel(spark: SparkSession, d: str) -> DataFrame:
    return shown(scored_rows(spark, d))


@ranking.add("precision_by_week", f"with {KNOWN_SQL} select week_key, {r('avg(y)', 'p_at_k')}, count(*) as n from pk where place <= 20 group by week_key")
def precision_by_week(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.precision_by_week(scored_rows(spark, d), 20))


@ranking.add("precision_summary", f"""with {KNOWN_SQL}, w as (select week_key, avg(y) filter (place <= 10) as a, avg(y) filter (place <= 15) as b, avg(y) filter (place <= 20) as c, sum(y) as s, count(*) as n from pk group by week_key)
select {r('avg(a)', 'p_at_10')}, {r('avg(b)', 'p_at_15')}, {r('avg(c)', 'p_at_20')}, {r('sum(s) / sum(n)', 'base_rate')}, {r('avg(c) / (sum(s) / sum(n))', 'lift')} from w""")
def precision_summary(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.precision_summary(scored_rows(spark, d)))


@ranking.add("oof_holdout_gap", f"""with {KNOWN_SQL}, h as (select distinct week_key from kn order by week_key desc limit 20), w as (select week_key, avg(y) as p, week_key in (select week_key from h) as ho from pk where place <= 20 group by week_key)
select {r('avg(p) filter (not ho)', 'oof')}, {r('avg(p) filter (ho)', 'holdout')}, {r('avg(p) filter (not ho) - avg(p) filter (ho)', 'gap')} from w""")
def oof_holdout_gap(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.known(scored_rows(spark, d))
    p = metrics.precision_by_week(s, 20).join(F.broadcast(validate.holdout_weeks(s).withColumn("h", F.lit(True))), "week_key", "left")
    out = p.agg(F.avg(F.when(F.col("h").isNull(), F.col("p_at_k"))).alias("oof"), F.avg(F.when(F.col("h"), F.col("p_at_k"))).alias("holdout"))
    return shown(out.withColumn("gap", F.col("oof") - F.col("holdout")))


_DISC = "case when {p} <= 20 then 1 / log2({p} + 1) else 0 end"


@ranking.add("ndcg", f"""with {KNOWN_SQL}, a as (select *, count(*) over (partition by week_key) as n, row_number() over (partition by week_key order by score desc) as p, row_number() over (partition by week_key order by y desc) as q,
avg(y) over (partition by week_key, score) as g from kn), b as (select week_key, sum(g * {_DISC.format(p='p')}) as dcg, sum(y * {_DISC.format(p='q')}) as ideal from a where n >= 2 group by week_key)
select {r('avg(coalesce(dcg / nullif(ideal, 0), 0))', 'ndcg')} from b""")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.ndcg(scored_rows(spark, d)))


@ranking.add("top_bottom_spread", f"""with {KNOWN_SQL}, lo as (select *, row_number() over (partition by week_key order by score, ticker) as place from has),
t as (select avg(x) as t from (select avg(fwd_ret) as x from pl where place <= 20 group by week_key)), b as (select avg(x) as b from (select avg(fwd_ret) as x from lo where place <= 20 group by week_key))
select {r('t', 'top_ret')}, {r('b', 'bottom_ret')}, {r('t - b', 'spread')} from t cross join b""")
def top_bottom_spread(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.spread(scored_rows(spark, d)))


@ranking.add("hit_rate", f"with {KNOWN_SQL}, a as (select week_key, avg((coalesce(fwd_ret > bench_ret, false))::int) as h from pl where place <= 20 and bench_ret is not null group by week_key) select {r('avg(h)', 'hit_rate')} from a")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.hit_rate(scored_rows(spark, d)))


@ranking.add("sector_concentration", f"with {KNOWN_SQL}, n as (select week_key, sector, count(*) as n from pl where place <= 20 and sector is not null group by all) select week_key, {r('sum(n * n) / (sum(n) * sum(n))', 'hhi')} from n group by week_key")
def sector_concentration(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.sector_concentration(scored_rows(spark, d)))


def _spearman(other: str, least: int) -> str:
    rank = "rank() over (partition by week_key order by {c}) + (count(*) over (partition by week_key, {c}) - 1) / 2"
    return f"""sp as (select week_key, count(*) as n, case when stddev_pop(a) * stddev_pop(b) > 0 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as rho
from (select week_key, {rank.format(c='score')} as a, {rank.format(c=other)} as b from has where {other} is not null) group by week_key having count(*) >= {least})"""


@ranking.add("rank_stability", f"with {KNOWN_SQL}, {_spearman('y', 5)} select week_key, n, {r('rho', 'spearman')} from sp")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.weekly_spearman(scored_rows(spark, d), "y", 5))


@ranking.add("spearman_attribution", f"with {KNOWN_SQL}, {_spearman('fwd_ret', 20)} select week_key, n, {r('rho', 'spearman')} from sp")
def spearman_attribution(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.weekly_spearman(scored_rows(spark, d), "fwd_ret", 20))


@ranking.add("roc_auc", f"""with {KNOWN_SQL}, a as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from kn), b as (select sum(y) as p, count(*) - sum(y) as n, sum(rk) filter (y = 1) as s from a)
select {r('(s - p * (p + 1) / 2) / (p * n)', 'auc')} from b""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.roc_auc(scored_rows(spark, d)))


@ranking.add("average_precision", f"""with {KNOWN_SQL}, a as (select score, sum(y) as p, count(*) as n from kn group by score), b as (select p, sum(p) over (order by score desc) as pu, sum(n) over (order by score desc) as nu, sum(p) over () as total from a)
select {r('sum(p / total * pu / nu)', 'average_precision')} from b""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.average_precision(scored_rows(spark, d)))


@ranking.add("permutation_test", f"""with {KNOWN_SQL}, o as (select avg(x) as o from (select avg(y) as x from pk where place <= 20 group by week_key)),
z as (select perm, week_key, y, row_number() over (partition by perm, week_key order by md5(perm::varchar || '|' || week_key::varchar || '|' || ticker::varchar)) as k from kn cross join (select unnest(range(500)) as perm)),
v as (select perm, avg(x) as v from (select perm, week_key, avg(y) as x from z where k <= 20 group by all) group by perm)
select {r('max(o)', 'observed')}, {r('avg(v)', 'perm_mean')}, {r('avg((round(v, 12) >= round(o, 12))::int)', 'p_value')} from v cross join o""")
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.permutation_test(scored_rows(spark, d)))


@ranking.add("permutation_test_full", ranking.sql["permutation_test"].replace("range(500)", "range(1000)"))
def permutation_test_full(spark: SparkSession, d: str) -> DataFrame:
    """The older pipeline's number of shuffles, 1,000."""
    return shown(metrics.permutation_test(scored_rows(spark, d), n=1000))


@ranking.add("fold_measures", f"""with {KNOWN_SQL}, f as (select *, year(week_key) as fold from kn),
a as (select fold, score, sum(y) as p, sum(1 - y) as n from f group by all), b as (select *, sum(p) over w as pu, sum(n) over w as nu, sum(p) over (partition by fold) as ap, sum(n) over (partition by fold) as an from a window w as (partition by fold order by score desc))
select fold, cast(sum(p + n) as bigint) as n_rows, {r('sum(p) / sum(p + n)', 'base_rate')}, {r('sum(p * (an - nu + n / 2)) / max(ap * an)', 'auc')}, {r('sum(p / ap * pu / (pu + nu))', 'average_precision')} from b group by fold""")
def fold_measures(spark: SparkSession, d: str) -> DataFrame:
    """A year stands for a fold."""
    return shown(metrics.fold_measures(scored_rows(spark, d).withColumn("fold", F.year("week_key").cast("long"))))


@ranking.add("pair_gradients", f"""with {KNOWN_SQL}, v as (select *, median(score) over (partition by week_key) as m from kn),
x as (select *, 2 * y + (score >= m)::int as rel, row_number() over (partition by week_key order by score desc, ticker) as k from v), z as (select *, 2 ** rel - 1 as gain, case when k <= 20 then 1 / log2(k + 1) else 0 end as disc from x),
i as (select week_key, sum(gain / log2(q + 1)) as ideal from (select *, row_number() over (partition by week_key order by gain desc, ticker) as q from z) where q <= 20 group by week_key),
pr as (select a.week_key, a.ticker, sign(a.rel - b.rel) as s, abs(a.gain - b.gain) * abs(a.disc - b.disc) / ideal as delta, 1 / (1 + exp(greatest(-50, least(50, sign(a.rel - b.rel) * (a.score - b.score))))) as rho
  from z a join z b on a.week_key = b.week_key and a.rel <> b.rel and (a.k <= 20 or b.k <= 20) join i on i.week_key = a.week_key where ideal > 0),
t as (select week_key, ticker, -sum(s * rho * delta) as g, sum(rho * (1 - rho) * delta) as h from pr group by all)
select ticker, week_key, {r('coalesce(g, 0)', 'gradient')}, {r('coalesce(h, 0)', 'curvature')} from kn left join t using (ticker, week_key)""")
def pair_gradients(spark: SparkSession, d: str) -> DataFrame:
    """The ranker's gradients at the panel's scores; a row's relevance is 2y, and 1 more from the week's median score on."""
    s = metrics.known(scored_rows(spark, d))
    m = F.percentile("score", F.lit(0.5)).over(Window.partitionBy("week_key"))
    graded = s.withColumn("relevance", 2 * F.col("y") + (F.col("score") >= m).cast("int"))
    return shown(boosting.pair_gradients(graded, 20))


DECILE_SQL = """de as (select week_key, list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e, count(*) as n from has where fwd_ret is not null group by week_key having count(*) >= 20),
db as (select has.week_key, fwd_ret, len(e) - 1 as k, greatest(1, len(list_filter(e, lambda x: x < score))) as b from has join de using (week_key) where fwd_ret is not null),
dm as (select week_key, avg(fwd_ret) filter (b = k) as hi, avg(fwd_ret) filter (b = 1) as lo from db group by week_key having max(k) >= 2)"""


@ranking.add("decile_spread", f"with {KNOWN_SQL}, {DECILE_SQL.replace('0.30000000000000004', '0.3')} select week_key, {r('hi', 'top_bucket', 9)}, {r('lo', 'low_bucket', 9)}, {r('hi - lo', 'decile_spread', 9)} from dm")
def decile_spread(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.decile_spread(scored_rows(spark, d)), 9)


_ATTR = """ab as (select week_key, count(fwd_ret) as n_valid, """ + ", ".join(f"avg(fwd_ret) filter (place <= {n}) as t{n}" for n in (1, 3, 5, 10, 20)) + """,
sum(fwd_ret * (21 - place)) filter (place <= 20) / sum(21 - place) filter (place <= 20 and fwd_ret is not null) as lw, avg((fwd_ret > bench_ret)::int) filter (place <= 3) as b3, avg((fwd_ret > bench_ret)::int) filter (place <= 10) as b10 from pl group by week_key)"""


@ranking.add("attribution", f"with {KNOWN_SQL}, {_ATTR} select week_key, n_valid, {', '.join(r(f't{n}', f'top{n}_ret', 9) for n in (1, 3, 5, 10, 20))}, {r('lw', 'top20_lw_ret', 9)}, {r('b3', 'top3_beat', 9)}, {r('b10', 'top10_beat', 9)} from ab")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.attribution(scored_rows(spark, d)), 9)


@ranking.add("attribution_summary", f"""with {KNOWN_SQL}, {_ATTR}, {DECILE_SQL.replace('0.30000000000000004', '0.3')}, {_spearman('fwd_ret', 20)}
select {r('(select avg(rho) from sp)', 'spearman_mean')}, {r('(select median(rho) from sp)', 'spearman_median')}, {r('(select avg((rho > 0)::int) from sp)', 'spearman_positive')},
{r('(select avg(hi - lo) from dm)', 'mean_decile_spread')}, {r('(select avg(t3 - t20) from ab)', 'top3_less_top20')}""")
def attribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.attribution_summary(scored_rows(spark, d)))


@ranking.add("score_shift", f"""with {KNOWN_SQL}, a as (select score, week_key = max(week_key) over () as now from has), b as (select avg(score) filter (now) as m1, avg(score) filter (not now) as m0, stddev_samp(score) filter (not now) as s from a)
select {r('m1', 'mean_last')}, {r('m0', 'mean_before')}, {r('s', 'std_before')}, {r('abs(m1 - m0) / greatest(s, 1e-6)', 'shift')}, abs(m1 - m0) / greatest(s, 1e-6) > 1.5 as warned from b""")
def score_shift(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.score_shift(scored_rows(spark, d)))


@ranking.add("turnover", f"""with {KNOWN_SQL}, w as (select week_key, row_number() over (order by week_key) as w from (select distinct week_key from scored)), t as (select ticker, week_key, w from pl join w using (week_key) where place <= 20),
j as (select t.week_key, t.w, p.ticker as was from t left join t p on p.ticker = t.ticker and p.w = t.w - 1)
select week_key, count(*) as n, count(was) as kept, {r('1 - count(was) / count(*)', 'turnover')} from j where w > 1 group by week_key""")
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.turnover(scored_rows(spark, d)))


@ranking.add("score_smoothing", f"with {KNOWN_SQL} select a.ticker, a.week_key, {r('case when b.score is not null then 0.3 * b.score + 0.7 * a.score else a.score end', 'smoothed', 9)} from scored a left join scored b on b.ticker = a.ticker and b.week_key = a.week_key - 7")
def score_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.smoothed(scored_rows(spark, d), 0.3).select("ticker", "week_key", "smoothed"), 9)


@ranking.add("run_comparison", f"""with {KNOWN_SQL}, ra as (select week_key, avg(y) as p from pk where place <= 20 group by week_key),
rb as (select week_key, avg(y) as p from (select *, row_number() over (partition by week_key order by -score desc, ticker) as k from kn) where k <= 20 group by week_key), j as (select rb.p - ra.p as d from ra full join rb using (week_key))
select count(*) filter (d > 0) as better, count(*) filter (d < 0) as worse, count(*) filter (d = 0) as same, {r('max(d)', 'best_change')}, {r('min(d)', 'worst_change')}, {r('avg(d)', 'mean_change')} from j""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    s = scored_rows(spark, d)
    return shown(metrics.compare_runs(s, s.withColumn("score", -F.col("score"))))


SUMMARY_SQL = f"""{KNOWN_SQL}, u as (select week_key, count(*) as universe from has group by week_key), tt as (select * from pl where place <= 20),
su as (select week_key, avg(score) as ms, avg(fwd_ret) as mr, max(bench_ret) as br, avg((fwd_ret > bench_ret)::int) as hr, avg(y) as pr, arg_max(ticker, row(fwd_ret, -ticker)) filter (fwd_ret is not null) as bt, arg_min(ticker, row(fwd_ret, ticker)) filter (fwd_ret is not null) as wt from tt group by week_key)"""


@ranking.add("weekly_summary", f"with {SUMMARY_SQL} select week_key, universe, {r('ms', 'mean_score')}, {r('mr', 'mean_ret')}, {r('br', 'bench_ret')}, {r('hr', 'hit_rate')}, {r('pr', 'precision')}, bt as best_ticker, wt as worst_ticker from u join su using (week_key)")
def weekly_summary(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.weekly_summary(scored_rows(spark, d)))


@ranking.add("weekly_summary_symbols", f"""with {SUMMARY_SQL}, b as (select week_key, 'T' || lpad(ticker::varchar, 6, '0') as t, fwd_ret from tt where fwd_ret is not null),
e as (select week_key, arg_min(t, row(-fwd_ret, t)) as best_ticker, arg_min(t, row(fwd_ret, t)) as worst_ticker from b group by week_key)
select week_key, universe, {r('ms', 'mean_score')}, {r('mr', 'mean_ret')}, {r('br', 'bench_ret')}, {r('hr', 'hit_rate')}, {r('pr', 'precision')}, best_ticker, worst_ticker from u join su using (week_key) left join e using (week_key)""")
def weekly_summary_symbols(spark: SparkSession, d: str) -> DataFrame:
    """With tickers that are strings."""
    s = scored_rows(spark, d)
    return shown(metrics.weekly_summary(s.withColumn("ticker", F.concat(F.lit("T"), F.lpad(F.col("ticker").cast("string"), 6, "0")))))


@ranking.add("backtest_averages", f"""with {SUMMARY_SQL} select {r('avg(pr)', 'precision')}, {r('avg(mr)', 'mean_ret')}, {r('avg(hr)', 'hit_rate')}, arg_max(week_key, mr) as best_week, arg_min(week_key, mr) as worst_week, count(*) as weeks from su where mr is not null""")
def backtest_averages(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.backtest_averages(metrics.weekly_summary(scored_rows(spark, d))))


@ranking.add("dynamic_k", f"with {KNOWN_SQL}, e as (select week_key, quantile_cont(score, 0.95) as e from has group by week_key) select week_key, cast(least(greatest(count(*) filter (score >= e), 5), 20) as bigint) as k from has join e using (week_key) group by week_key")
def dynamic_k(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.dynamic_k(scored_rows(spark, d)))


@ranking.add("ranked_list", f"with {KNOWN_SQL} select 'top' as side, week_key, place, ticker from pl where place <= 20 union all select 'bottom', week_key, row_number() over (partition by week_key order by score, ticker) as k, ticker from has qualify k <= 5")
def ranked_list(spark: SparkSession, d: str) -> DataFrame:
    s = scored_rows(spark, d).where("score is not null")
    sides = [metrics.top(s, k, best=b).select(F.lit(n).alias("side"), "week_key", "place", "ticker") for n, k, b in (("top", 20, True), ("bottom", 5, False))]
    return shown(sides[0].unionByName(sides[1]))


_PROB = "pr as (select *, round(0.5 + 0.5 * score / (1 + abs(score)), 6) as prob, fwd_ret as ranker from kn)"


def _with_models(spark: SparkSession, d: str) -> DataFrame:
    """Two stand-in model scores on the scored panel."""
    s = metrics.known(scored_rows(spark, d))
    return s.withColumn("prob", F.round(0.5 + 0.5 * F.col("score") / (1 + F.abs("score")), 6)).withColumn("ranker", F.col("fwd_ret"))


@ranking.add("relevance_labels", f"with {KNOWN_SQL}, {_PROB}, m as (select median(prob) as m from pr) select ticker, week_key, cast(case when y = 1 then 2 else 0 end + (prob >= m)::int as bigint) as relevance from pr cross join m")
def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel.relevance(_with_models(spark, d)).select("ticker", "week_key", "relevance"))


_PCT = "(rank() over (partition by {by} order by ranker) + (count(*) over (partition by {by}, ranker) - 1) / 2) / count(*) over (partition by {by})"


@ranking.add("blended_score", f"with {KNOWN_SQL}, {_PROB} select ticker, week_key, {r('0.6 * prob + 0.4 * ' + _PCT.format(by='week_key'), 'score')} from pr")
def blended_score(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.blend(_with_models(spark, d), 0.6).select("ticker", "week_key", "score"))


def _grid_sql(fold: str) -> str:
    by = "fold, week_key"
    return f"""with {KNOWN_SQL}, {_PROB}, q as (select *, {fold} as fold from pr), z as (select *, {_PCT.format(by=by)} as pct from q),
g as (select z.*, round(0.35 + 0.05 * i, 2) as w from z cross join (select unnest(range(11)) as i)),
k as (select fold, w, week_key, y, row_number() over (partition by fold, w, week_key order by round(w * prob + (1 - w) * pct, 9) desc, ticker) as k from g),
p as (select fold, w, round(avg(x), 12) as p from (select fold, w, week_key, avg(y) as x from k where k <= 20 group by all) group by all)"""


@ranking.add("blend_weights", f"{_grid_sql('year(week_key)')} select fold, {r('arg_max(w, row(p, -w))', 'weight')}, {r('max(p)', 'p_at_k')} from p group by fold")
def blend_weights(spark: SparkSession, d: str) -> DataFrame:
    """A year stands for a fold."""
    return shown(metrics.best_weight(_with_models(spark, d).withColumn("fold", F.year("week_key").cast("long"))))


@ranking.add("blend_weight_overall", f"{_grid_sql('1')} select {r('arg_max(w, row(p, -w))', 'weight')}, {r('max(p)', 'p_at_k')} from p")
def blend_weight_overall(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.best_weight(_with_models(spark, d), None))


@ranking.add("class_ratio", f"with {SCORED_SQL} select {r('greatest(count(*) filter (y = 0), 1) / greatest(count(*) filter (y = 1), 1)', 'ratio')} from scored")
def class_ratio(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.class_ratio(scored_rows(spark, d)))


@ranking.add("before_anchor", f"with {SCORED_SQL} select ticker, week_key, cast(y as bigint) as y from scored where week_key <= date '1999-06-27' - 7 and y is not null")
def before_anchor(spark: SparkSession, d: str) -> DataFrame:
    return shown(validate.before_anchor(scored_rows(spark, d), "1999-06-27").select("ticker", "week_key", "y"))


@ranking.add("run_parity", f"""with {KNOWN_SQL}, sb as (select *, round(score + case when ticker % 10 = 3 then 0.001 else 0 end, 6) as s2 from has where ticker % 10 <> 4),
j as (select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.week_key, b.week_key) as week_key, a.score as a_score, b.s2 as b_score, a.ticker is null as na, b.ticker is null as nb from (select * from has where ticker % 10 <> 5) a full join sb b on a.ticker = b.ticker and a.week_key = b.week_key)
select ticker, week_key, {r('a_score')}, {r('b_score')}, case when nb then 'a only' when na then 'b only' else 'differs' end as finding from j where na or nb or abs(a_score - b_score) > 1e-4""")
def run_parity(spark: SparkSession, d: str) -> DataFrame:
    s = scored_rows(spark, d).where("score is not null").select("ticker", "week_key", "score")
    other = s.where("ticker % 10 <> 4").withColumn("score", F.round(F.col("score") + F.when(F.col("ticker") % 10 == 3, 0.001).otherwise(0.0), 6))
    return shown(parity.compare(s.where("ticker % 10 <> 5"), other, ["ticker", "week_key"], ["score"]))


@ranking.add("benchmark_varies", f"with {SCORED_SQL} select week_key, count(distinct bench_ret) as n from scored group by week_key having count(distinct bench_ret) > 1")
def benchmark_varies(spark: SparkSession, d: str) -> DataFrame:
    return parity.varies_within(scored_rows(spark, d), "bench_ret", "week_key")

"""Pipelines: holdout evaluation with a production ranking, older price-filtered variants, walk-forward backtests and
ablations. Each names its models as jobs; all jobs of a call are fitted together."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.windows import flag
from quarry.operators import metrics, panel, validate
from quarry.operators.model import Fitted, Job, Settings, calibrate, calibrated, fit_jobs, stack
from quarry.sources import tables

WEEK = "week_key"
EVER = (datetime.date.min, datetime.date.max)


@dataclass(frozen=True)
class Context:
    """A prepared panel: rows with y, features, masks, one for each ticker and week; the feature list; and the anchor
    week."""

    rows: DataFrame
    features: tuple[str, ...]
    anchor: str


def prepare(rows: DataFrame, features: list[str]) -> Context:
    panel.check_panel(rows, ["ticker", WEEK, "close", "y", *features])
    return Context(rows, tuple(panel.feature_list(rows, features)), str(metrics.anchor(rows).first()["anchor"]))


def _usable(c: Context, mask: str | None) -> DataFrame:
    return c.rows.where(flag(F.col(mask))) if mask else c.rows


def _holdout_job(c: Context, name: str, features: tuple[str, ...], mask: str | None, folds: int, holdout: int, bounds=validate.fold_bounds) -> tuple[Job, str]:  # noqa: ANN001
    """(the job, the flag that its scored rows have); the flag's name is made of the mask's."""
    known = _usable(c, mask).where("y is not null")
    weeks = validate.week_list(known)
    late = [r[0] for r in validate.holdout_weeks(known, holdout).orderBy(WEEK).collect()]
    pool = [w for w in weeks if w not in set(late)]
    scored = f"_known_{mask or 'all'}"
    options = {} if bounds is validate.overlapping_bounds else {"folds": folds}
    return Job(name, pool[-1], validate.fold_ranges(pool, bounds, **options), (late[0], late[-1]), features, mask, scored), scored


def _known_flags(rows: DataFrame, masks: set[str | None]) -> DataFrame:
    """Flags of the rows that a holdout scores: those that have a label, and the mask."""
    return rows.withColumns({f"_known_{m or 'all'}": F.col("y").isNotNull() & (flag(F.col(m)) if m else F.lit(True)) for m in masks})


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*(x for x in df.columns if x.startswith("_known_") or x == "_now"))


def run_holdouts(c: Context, runs: dict[str, tuple[list[str] | None, str | None]], s: Settings = Settings(), folds: int = 6, holdout: int = 20, bounds=validate.fold_bounds) -> dict[str, Fitted]:  # noqa: ANN001
    """Holdout evaluations of several named (features, mask) at once."""
    jobs = [_holdout_job(c, name, tuple(features or c.features), mask, folds, holdout, bounds)[0] for name, (features, mask) in runs.items()]
    return fit_jobs(_known_flags(c.rows, {mask for _, mask in runs.values()}), jobs, s)


def run_holdout(c: Context, features: list[str] | None = None, mask: str | None = None, s: Settings = Settings(), folds: int = 6, holdout: int = 20) -> dict[str, DataFrame]:
    """Tables: holdout (scored), metrics (one row), folds, importance."""
    fitted = run_holdouts(c, {"run": (features, mask)}, s, folds, holdout)
    if not fitted:
        raise ValueError("too few training rows")
    f = fitted["run"]
    importance = [(i + 1, n, v) for i, (n, v) in enumerate(f.features)]
    return {
        "holdout": _plain(f.scored), "metrics": _measured(f, s), "folds": f.fold_table,
        "importance": c.rows.sparkSession.createDataFrame(importance, "place int, feature string, importance double"),
    }


def _at_anchor(c: Context, name: str, anchor: str, features: tuple[str, ...], mask: str | None, folds: int, score: tuple[datetime.date, datetime.date], weeks: list[datetime.date], days: int = 7) -> Job | None:
    """The job of an anchor, trained on the weeks that were known so many days before; none without any."""
    until = datetime.date.fromisoformat(anchor) - datetime.timedelta(days=days)
    before = [w for w in weeks if w <= until]
    return Job(name, before[-1], validate.fold_ranges(before, folds=folds), score, features, mask, "_now") if before else None


def run_production(c: Context, features: list[str] | None = None, mask: str | None = None, s: Settings = Settings(), folds: int = 6) -> dict[str, DataFrame]:
    """Tables at the anchor, trained on what was known before it: ranking, all_last, bottom, missing. With too few training
    rows the first three are empty."""
    own, rows = tuple(features or c.features), _usable(c, mask)
    now = metrics.anchor_rows(panel.mostly_present(rows, list(own))).select("ticker", WEEK).distinct().withColumn("_now", F.lit(True))
    job = _at_anchor(c, "production", c.anchor, own, mask, folds, EVER, validate.week_list(rows.where("y is not null")))
    fitted = fit_jobs(c.rows.join(now, ["ticker", WEEK], "left"), [job] if job else [], s)
    scored = _plain(fitted["production"].scored) if fitted else _nothing(c)
    return {"ranking": metrics.placed(scored).where(F.col("place") <= s.k), "all_last": scored, "bottom": metrics.top(scored, 5, best=False), "missing": metrics.missing_at_anchor(rows)}


def _nothing(c: Context) -> DataFrame:
    """No scored rows."""
    return c.rows.limit(0).withColumns({x: F.lit(None).cast("double") for x in ("prob", "ranker", "ranker_pct", "score", "prob_final")})


def run_pipeline(c: Context, features: list[str] | None = None, mask: str | None = None, s: Settings = Settings(), folds: int = 6, holdout: int = 20) -> dict[str, DataFrame]:
    """The tables of both: the holdout evaluation and the production ranking."""
    return run_holdout(c, features, mask, s, folds, holdout) | run_production(c, features, mask, s, folds)


def _measured(f: Fitted, s: Settings) -> DataFrame:
    h = f.scored
    out = metrics.precision_summary(h, (10, 15, s.k) if s.k > 15 else (s.k,))
    for other in (metrics.ndcg(h, s.k), metrics.roc_auc(h), metrics.average_precision(h), metrics.spread(h, s.k), metrics.hit_rate(h, s.k)):
        out = out.crossJoin(other)
    oof = metrics.precision_by_week(f.oof, s.k).agg(F.avg("p_at_k").alias("oof_p_at_k"))
    return out.crossJoin(oof).withColumn("blend_weight", F.lit(f.weight)).withColumn("gap", F.col("oof_p_at_k") - F.col(f"p_at_{s.k}"))


def run_variants(c: Context, bands: dict[str, tuple[float | None, float | None]], s: Settings = Settings(), stacked: bool = True, overlapping: bool = True) -> DataFrame:
    """The older pipelines' runs side by side: a price band instead of masks, overlapping folds, a stacked score. One row of
    metrics for each band, by precision at k."""
    inside = {f"_band_{i}": panel.in_band(F.col("close"), *band) for i, band in enumerate(bands.values())}
    banded = Context(c.rows.withColumns(inside), c.features, c.anchor)
    runs = {name: (None, f"_band_{i}") for i, name in enumerate(bands)}
    fitted = run_holdouts(banded, runs, s, bounds=validate.overlapping_bounds if overlapping else validate.fold_bounds)
    out = None
    for name, f in fitted.items():
        if stacked:
            f.oof, f.scored = stack(f.oof, f.scored, s.k)
            f.scored = calibrated(f.scored, calibrate(f.oof))
        low, high = bands[name]
        row = _measured(f, s).withColumn("low", F.lit(low).cast("double")).withColumn("high", F.lit(high).cast("double")).withColumn("run_label", F.lit(name))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("too few training rows")
    return out.orderBy(F.col(f"p_at_{s.k}").desc_nulls_last(), "run_label")


def run_price_variant(c: Context, low: float | None, high: float | None, s: Settings = Settings(), stacked: bool = False, overlapping: bool = False) -> DataFrame:
    """One band of run_variants."""
    return run_variants(c, {"band": (low, high)}, s, stacked, overlapping).drop("run_label")


def run_anchors(c: Context, anchors: list[str], features: list[str] | None = None, mask: str | None = None, s: Settings = Settings(), folds: int = 6) -> DataFrame:
    """Scores of the anchor weeks, each trained on what was known a week before it and, with a mask, on rows that have it;
    scored are a ticker's rows at the anchor most of whose features are there. Anchors with fewer than ``s.least_train``
    training rows have none."""
    own, rows = tuple(features or c.features), _usable(c, mask)
    now = panel.first_of(panel.mostly_present(rows, list(own)), ["ticker", WEEK], [F.col("data_date").desc()]).select("ticker", WEEK).withColumn("_now", F.lit(True))
    weeks = validate.week_list(rows.where("y is not null"))
    day = datetime.date.fromisoformat
    jobs = [_at_anchor(c, a, a, own, mask, folds, (day(a), day(a)), weeks) for a in anchors]
    fitted = fit_jobs(c.rows.join(now, ["ticker", WEEK], "left"), [j for j in jobs if j], s)
    out = _nothing(c)
    if fitted:
        parts = [_plain(f.scored) for f in fitted.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    return out.withColumn("beat", metrics.beat_benchmark(F.col("fwd_ret"), F.col("bench_ret")))


def run_single_backtest(c: Context, anchor: str, features: list[str] | None = None, mask: str | None = None, s: Settings = Settings(), folds: int = 6) -> DataFrame:
    """run_anchors of one."""
    return run_anchors(c, [anchor], features, mask, s, folds)


def run_backtest(c: Context, anchors: list[str], s: Settings = Settings(), folds: int = 6, features: list[str] | None = None, mask: str | None = None) -> dict[str, DataFrame]:
    """All anchors that the panel has, fitted together. Tables: scored (written), summary, attribution, averages, absent
    (anchors that the panel lacks)."""
    wanted = c.rows.sparkSession.createDataFrame([(a,) for a in anchors], "a string").select(F.col("a").cast("date").alias(WEEK))
    weeks = c.rows.select(WEEK).distinct()
    there = [str(x[0]) for x in wanted.join(weeks, WEEK, "left_semi").orderBy(WEEK).collect()]
    keep = ["ticker", WEEK, "sector", "close", "y", "fwd_ret", "bench_ret", "prob", "ranker", "ranker_pct", "score", "prob_final", "beat"]
    rows = run_anchors(c, there, features, mask, s, folds)
    scored = tables.stored(rows.select(*(x for x in keep if x in rows.columns)), "backtest")
    summary = metrics.weekly_summary(scored, s.k)
    return {"scored": scored, "summary": summary, "attribution": metrics.attribution(scored), "averages": metrics.backtest_averages(summary), "absent": wanted.join(weeks, WEEK, "left_anti")}


def run_ablation(c: Context, runs: dict[str, tuple[list[str], str | None]], s: Settings = Settings(), folds: int = 6) -> DataFrame:
    """One row of holdout metrics for each named (features, mask); all are fitted together."""
    out = None
    for label, f in run_holdouts(c, runs, s, folds).items():
        row = _measured(f, s).withColumn("run_label", F.lit(label))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("too few training rows")
    return out


def save(found: dict[str, DataFrame], root: str, run_label: str, anchor: str | None = None) -> None:
    """The tables of a run or a backtest under root, partitioned by run and, if given, anchor date."""
    tables.write_tables(found, root, run_label=run_label, **({"anchor_date": anchor} if anchor else {}))

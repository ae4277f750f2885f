"""Long rolling windows: doubled lags give what frames give, and the plans hold no long frames and one shuffle by ticker."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.windows import Rolling, rolled, rolling
from quarry.operators import indicators
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"avg": F.avg, "max": F.max, "min": F.min}


def test_doubled_lags_equal_frames(spark):
    rows = [(t, i, None if (i * t) % 5 == 1 else float((i * 37 + t) % 23)) for t, n in ((1, 70), (2, 3), (3, 33)) for i in range(n)] + [(4, i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "ticker int, d int, v double")
    wanted = [Rolling(f"{kind}{n}", kind, "v", n, m) for kind in KINDS for n, m in ((1, 1), (2, 1), (7, 3), (20, 20), (32, 10), (63, 1))]
    frames = {r.name: rolling(KINDS[r.kind], F.col("v"), r.n, r.least) for r in wanted}
    got, want = (sorted(x.collect()) for x in (rolled(df, wanted).select("ticker", "d", *frames), df.select("ticker", "d", *(c.alias(k) for k, c in frames.items()))))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    assert rolled(df, []).columns == df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["trend_indicators", "cross_days", "fallback_indicators"])
def test_no_long_frames_and_one_shuffle(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF))
    assert not [n for n in map(int, re.findall(r"RowFrame, -(\d+), currentrow", plan)) if n > 26]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_fallbacks_of_bars_that_have_all(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 1.0, 1.5, 9.0, 9.0, 9.0, 7.0)], "ticker int, d int, high double, low double, close double, SMA_20 double, SMA_50 double, SMA_200 double, ATRp_14 double")
    assert indicators.with_fallbacks(rows).collect() == rows.collect()


def test_ranks_of_missing_and_tied_values(spark):
    from quarry.functions.windows import percentile_rank
    from quarry.operators import panel

    values = [None, 1.0, 1.0, float("nan"), float("nan"), -0.0, 0.0, None, 5.0]
    df = spark.createDataFrame([(t, w, v, None if w else v) for w in range(2) for t, v in enumerate(values)], "ticker int, week_key int, a double, b double")
    got = panel.ranks(df, ["a", "b"]).select("ticker", "week_key", "a__rank", "b__rank")
    want = df.select("ticker", "week_key", *(percentile_rank(F.col(c), "week_key").alias(f"{c}__rank") for c in "ab"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert len(re.findall(r"Exchange hashpartitioning", _plan(panel.ranks(df, ["a", "b"])))) == 1


@pytest.mark.parametrize("name", ["rule_scores", "full_panel_ranks"])
def test_indicators_come_without_joins_of_bars(spark, name):
    assert not re.findall(r"SortMergeJoin \[ticker#\d+L?, d#", _plan(catalog.queries()[name](spark, SF)))


@pytest.mark.parametrize(("module", "name", "times"), [("order_statistics", "relevance_labels", 1), ("order_statistics", "median_imputer", 1), ("metrics", "fold_measures", 1)])
def test_passes_read_what_is_stored_once(spark, monkeypatch, module, name, times):
    import importlib

    from quarry.sources import tables

    found, seen = importlib.import_module(f"quarry.operators.{module}"), []
    monkeypatch.setattr(found, "stored", lambda df, what: seen.append(what) or tables.stored(df, what), raising=False)
    catalog.queries()[name](spark, SF).collect()
    assert len(seen) == times


@pytest.mark.parametrize(("module", "name"), [("comparison_queries", "saved_runs"), ("model_queries", "forest_probability"), ("model_queries", "feature_importance")])
def test_queries_that_read_rows_many_times_store_them(spark, monkeypatch, module, name):
    import importlib

    class Stored(Exception):
        pass

    def stop(df, what):
        raise Stored

    monkeypatch.setattr(importlib.import_module(f"quarry.plans.{module}").tables, "stored", stop)
    with pytest.raises(Stored):
        catalog.queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["label_correlations", "new_feature_positions"])
def test_labelled_features_come_from_one_pass_over_the_rows(spark, name):
    """They were joined to labels made of the same rows, read twice more."""
    plan = _plan(catalog.queries()[name](spark, SF))
    assert "labelled-" in plan and "l_suppkey" not in plan and "SortMergeJoin" not in plan

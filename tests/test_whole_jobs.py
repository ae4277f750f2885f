"""Queries that look at all of their input, not at a part of it."""

import pytest

from quarry.operators.model import Settings
from quarry.plans import backtest, catalog, model_queries
from quarry.sources.fixtures import bars

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["rule_scores_defaults", "rule_scores_defaults_all"])
def test_default_rule_scores_of_every_bar(spark, name):
    every = bars(spark, SF).select("ticker", "d")
    got = catalog.queries()[name](spark, SF).select("ticker", "d")
    assert got.count() == every.count() and got.exceptAll(every).count() == 0
    assert not any("n % 20" in sql for sql in catalog.oracle_sql().values())


@pytest.mark.parametrize(("name", "jobs"), [("pipeline_metrics", 1), ("production_ranking", 1), ("price_variant", 1), ("backtest_summary", 17), ("ablation", 3), ("fold_table", 1), ("run_variants", 3)])
def test_model_queries_run_at_the_librarys_sizes(spark, monkeypatch, name, jobs):
    seen = []

    def fit(rows, found, s):
        seen.append((s, [len(j.folds) for j in found]))
        raise Seen

    monkeypatch.setattr(backtest, "fit_jobs", fit)
    with pytest.raises(Seen):
        catalog.queries()[name](spark, SF)
    (s, folds), = seen
    assert s == Settings() and s.trees >= 60 and len(folds) == jobs and all(n >= 5 for n in folds)


@pytest.mark.parametrize("name", ["forest_probability", "feature_importance"])
def test_forest_queries_take_the_forests_defaults(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(model_queries, "fit_forest", lambda train, **sizes: seen.append(sizes))
    catalog.queries()[name](spark, SF)
    assert seen == [{}]


def test_backtest_anchors_and_ablation_runs(spark):
    rows = model_queries.modelling_panel(spark, SF).persist()
    anchors = model_queries.last_anchors(rows)
    known = sorted(str(r[0]) for r in rows.where("y is not null").select("week_key").distinct().collect())
    assert len(anchors) == 17 and anchors == known[-17:]
    assert model_queries.RUNS["ABLATION"] == (model_queries.RUNS["BASELINE"][0], model_queries.RUNS["NEW"][1])


def test_default_rule_scores_of_every_bar_are_computed_from_its_indicators(spark):
    """The job had become one of bars without indicators, whose scores are all the same."""
    got = catalog.queries()["rule_scores_defaults_all"](spark, SF).groupBy("Trend_Score", "RelStr_Score", "Setup_Tag").count().collect()
    assert len(got) > 3
    assert "SMA_200" in catalog.oracle_sql()["rule_scores_defaults_all"]
    assert catalog.queries()["rule_scores_without_indicators"](spark, SF).count() == bars(spark, SF).count()

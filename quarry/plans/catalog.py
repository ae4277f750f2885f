"""All registered panel queries and the SQL that gives the same rows."""

from __future__ import annotations

from quarry.plans.comparison_queries import comparisons
from quarry.plans.daily_queries import daily
from quarry.plans.feature_queries import features
from quarry.plans.model_queries import models
from quarry.plans.registry import Query
from quarry.plans.scored_queries import ranking
from quarry.plans.weekly_queries import weeks


#: They fit many models, and stand last in this order.
SLOW = ("feature_importance", "forest_probability", "production_ranking", "pipeline_metrics", "fold_table", "price_variant", "run_variants", "ablation", "backtest_summary")


def queries() -> dict[str, Query]:
    every = {**daily.queries, **weeks.queries, **features.queries, **ranking.queries, **comparisons.queries, **models.queries}
    return {name: query for name, query in every.items() if name not in SLOW} | {name: every[name] for name in SLOW}


def oracle_sql() -> dict[str, str]:
    return {**daily.sql, **weeks.sql, **features.sql, **ranking.sql, **comparisons.sql, **models.sql}

"""The search for a blend weight ranks few rows, and the same ones as a ranking of all."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.windows import percentile_rank
from quarry.operators import metrics

SCHEMA = "fold long, week_key date, ticker long, y int, prob double, ranker double"


def rows(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    value = {"spread": rng.random, "tied": lambda: rng.randrange(3) / 2, "equal": lambda: 0.5, "close": lambda: 0.5 + rng.randrange(9) * 4e-10, "odd": lambda: rng.choice([float("nan"), float("inf"), None, 0.1, 0.9])}[kind]
    return [(w % 2, datetime.date(2020, 1, 5) + datetime.timedelta(7 * w), t, rng.choice([0, 1, None] if kind == "odd" else [0, 1]), value(), value()) for w in range(5) for t in rng.sample(range(500), 90 if w else 7)]


def ranked_all(scored, by):
    """p_at_k of each weight by a ranking of every row."""
    keys = [by] if by else []
    r = scored.where("y is not null and prob is not null").withColumn("pct", percentile_rank(F.col("ranker"), *keys, "week_key")).where("pct is not null")
    grid = r.crossJoin(scored.sparkSession.range(11).select(F.round(0.35 + 0.05 * F.col("id"), 2).alias("weight")))
    place = F.row_number().over(Window.partitionBy(*keys, "weight", "week_key").orderBy(F.round(F.col("weight") * F.col("prob") + (1 - F.col("weight")) * F.col("pct"), 9).desc(), "ticker"))
    p = grid.withColumn("p", place).where("p <= 20").groupBy(*keys, "weight", "week_key").agg(F.avg("y").alias("v")).groupBy(*keys, "weight").agg(F.round(F.avg("v"), 12).alias("p"))
    return p.groupBy(*keys).agg(F.max_by("weight", F.struct("p", -F.col("weight"))).alias("weight"), F.max("p").alias("p_at_k"))


@pytest.mark.parametrize("kind", ["spread", "tied", "equal", "close", "odd"])
def test_best_weight_equals_a_ranking_of_all_rows(spark, kind):
    scored = spark.createDataFrame(rows(kind), SCHEMA)
    for by in ("fold", None):
        assert sorted(metrics.best_weight(scored, by).collect()) == sorted(ranked_all(scored, by).collect())


@pytest.mark.parametrize("kind", ["spread", "equal"])
def test_few_rows_of_a_batch_are_ranked_by_blends(kind):
    rng = random.Random(1)
    n, value = 9000, rng.random if kind == "spread" else lambda: 0.5
    batch = pa.RecordBatch.from_pydict({"week_key": [0] * 3000 + [1] * 6000, "ticker": list(range(n)), "_prob": [value() for _ in range(n)], "_pct": [value() for _ in range(n)]})
    got = list(metrics._first_by_weights(iter([batch]), ["week_key"], 20))
    assert sum(b.num_rows for b in got) <= 2 * 11 * 40
    assert {w for b in got for w in b.column("_w").to_pylist()} == set(range(11))


def test_no_row_is_repeated_for_each_weight_before_it_is_chosen(spark):
    plan = metrics.best_weight(spark.createDataFrame(rows("spread"), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan

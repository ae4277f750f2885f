import numpy as np
from pyspark.sql import functions as F

from quarry.functions.recurrences import Smooth, smooth
from quarry.functions.windows import percentile_rank, streak
from quarry.operators import panel, validate
from quarry.sources import tables


def test_clean_names_keep_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Ret. Una sem", "Ret Una.sem", " CCI_20_0.015 "])
    out = panel.cleaned_columns(df)
    assert out.columns == ["Ret_Una_sem", "CCI_20_0_015"] and out.first()[0] == 1


def test_ensure_numeric_and_absent_columns(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "a string")
    assert [tuple(r) for r in panel.ensure_numeric(df, ["a", "b"]).collect()] == [(1.5, None), (None, None), (None, None)]


def test_percentile_rank_averages_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None)], "g int, x double")
    got = sorted((r.p for r in df.select(percentile_rank(F.col("x"), "g").alias("p")).collect()), key=lambda v: (v is None, v))
    assert got == [0.5, 0.5, 1.0, None]


def test_streak(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 3, 4])], "ticker string, d int, v int")
    w = __import__("quarry.functions.windows", fromlist=["series"]).series()
    got = df.select("d", streak(F.col("v") > F.lag("v").over(w)).alias("s")).orderBy("d").collect()
    assert [r.s for r in got] == [0, 1, 2, 0, 1]


def test_smooth_seeds_with_the_mean_and_passes_over_nulls(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, 3.0, None, 5.0])], "ticker string, d int, v double")
    out = smooth(df, "ticker", "d", [Smooth("e", 2, "ema", lambda r: r["v"]), Smooth("r", 2, "rma", lambda r: r["v"])]).orderBy("d").collect()
    assert [r.e for r in out] == [None, None, 2.0, None, 4.0] and [r.r for r in out] == [None, None, 2.0, None, 3.5]


def test_folds_are_apart():
    for n in (20, 41, 60, 120, 357):
        folds = validate.fold_bounds(n)
        for train_end, start, end in folds:
            assert start - train_end >= min(4, n - train_end - 1) and 0 < train_end and end <= n
        assert all(a[2] < b[1] for a, b in zip(folds, folds[1:], strict=False))


def test_wide_bars_become_long(spark):
    wide = spark.createDataFrame([("2020-01-01", *map(float, range(10)))], ["d", *(f"{t}__{f}" for t in ("A", "B") for f in ("Open", "High", "Low", "Close", "Volume"))])
    got = {r.ticker: r.close for r in tables.long_bars(wide).collect()}
    assert got == {"A": 3.0, "B": 8.0}


def test_empty_bars(spark):
    from quarry.operators.indicators import with_oscillators, with_recurrent, with_trend

    empty = spark.createDataFrame([], tables.BARS)
    assert with_trend(empty).count() == with_oscillators(empty).count() == with_recurrent(empty).count() == 0


def test_smooth_goes_on_over_stretches_and_batches(spark):
    rng = np.random.default_rng(3)
    values = {k: [None if x < -1 else float(x) for x in rng.normal(0, 1, n)] for k, n in ((1, 700), (2, 1), (3, 13), (4, 300))}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "ticker int, d int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r.ticker, r.d): (r.e, r.r) for r in smooth(df, "ticker", "d", [Smooth("e", 12, "ema", lambda r: r["v"]), Smooth("r", 14, "rma", lambda r: r["v"])]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, vs in values.items():
        for at, n, w in ((0, 12, 2 / 13), (1, 14, 1 / 14)):
            seen, y = [], None
            for i, x in enumerate(vs):
                if x is not None:
                    seen.append(x)
                    y = y + w * (x - y) if len(seen) > n else sum(seen) / n if len(seen) == n else None
                want = y if x is not None else None
                assert got[k, i][at] is None if want is None else abs(got[k, i][at] - want) < 1e-9

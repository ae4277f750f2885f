"""Looking back in an ordered pass gives what window frames give, for any batches, and the oscillators hold no frames."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import lookback
from quarry.functions.windows import last_rows, series
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_look_back_equals_frames(spark, batch):
    value = lambda t, i: None if (i * t) % 5 == 1 else float("nan") if t == 4 and i % 7 == 0 else 3.7 if t == 5 else float((i * 37 + t) % 11)
    rows = [(t, i, value(t, i)) for t, n in ((1, 70), (2, 3), (3, 33), (4, 40), (5, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker int, d int, v double")
    frames = {"total": F.sum, "mean": F.avg, "deviation": F.stddev_pop, "most": F.max, "least": F.min}

    def made(r):
        last = r.last(r["v"], 6)
        return {"total": lookback.total(last), "mean": lookback.mean(last), "deviation": lookback.deviation(last), "most": lookback.extreme(last)[0], "least": lookback.extreme(last, lookback.less)[0]}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = lookback.look_back(df.withColumn("_n", F.row_number().over(series())), "_n", ("v",), 5, dict.fromkeys(frames, "double"), made).drop("_n").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = df.select("*", *(f("v").over(last_rows(6)).alias(k) for k, f in frames.items())).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)


def test_oscillators_hold_no_frames(spark):
    """They held six windows, whose frames added up to 25 rows anew for every row."""
    plan = catalog.queries()["oscillators"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"RowFrame, -\d+", plan) and len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and len(re.findall(r"Sort \[", plan)) == 1
    assert "min_by" not in plan  # the open price, which none of them reads
    whole = catalog.queries()["rule_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"stddev_pop|array_position", whole)


def test_oscillators_of_series_longer_than_a_batch(spark):
    """Closes rise, then fall (as in the SQL, Aroon's place is counted from the oldest of 25 rows); a constant series has no spread, so no %B and no stochastics."""
    from quarry.operators.indicators import with_oscillators

    close = lambda t, i: 1.1 if t == 2 else 50.0 + (i if i < 15000 else 30000 - i)
    rows = [(t, i, *[close(t, i)] * 4, 1.0) for t, n in ((1, 25000), (2, 40)) for i in range(n)]
    t = with_oscillators(spark.createDataFrame(rows, "ticker int, d int, open double, high double, low double, close double, volume double"))
    found = {r["d"]: r for r in t.where("ticker = 1").collect()}
    assert len(found) == 25000 and found[23]["Aroon_up"] is None and found[18]["PctB"] is None and found[13]["MFI_14"] is None and found[17]["STOCHd"] == 100 and found[16]["STOCHd"] is None
    assert all((found[i]["Aroon_up"], found[i]["Aroon_down"]) == (0, 100) and found[i]["STOCHk"] == 100 and found[i]["MFI_14"] == 100 for i in range(24, 15000))
    assert all((found[i]["Aroon_up"], found[i]["Aroon_down"]) == (100, 0) and found[i]["STOCHk"] == 0 and found[i]["MFI_14"] == 0 for i in range(15025, 25000))
    assert {r["PctB"] for r in t.where("ticker = 2").collect()} == {r["STOCHk"] for r in t.where("ticker = 2").collect()} == {None}

"""Window expressions that the operators share. Lengths count rows; ``least`` counts values that are not null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str = "ticker", time: str = "d") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def last_rows(n: int, key: str = "ticker", time: str = "d") -> WindowSpec:
    return series(key, time).rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], value: Column, n: int, least: int, key: str = "ticker", time: str = "d") -> Column:
    """agg over the last n rows, null while fewer than least values are known."""
    w = last_rows(n, key, time)
    return F.when(F.count(value).over(w) >= least, agg(value).over(w))


@dataclass(frozen=True)
class Rolling:
    """Output column: kind ('avg', 'max' or 'min') of a column over the last n rows, null while fewer than least values are
    known."""

    name: str
    kind: str
    column: str
    n: int
    least: int


_JOINED = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_PARTS = {"avg": ("sum", "count"), "max": ("max", "count"), "min": ("min", "count")}


def rolled(df: DataFrame, wanted: list[Rolling], key: str = "ticker", time: str = "d") -> DataFrame:
    """df with long rolling aggregates. Spark walks a frame anew for every row; here the aggregate of the last 2, 4, 8 ..
    rows comes from that of half as many and its lag, and a length is put together of its powers of two, so that a row
    takes some steps for each binary digit of the length. Nothing is subtracted, so nothing cancels out."""
    if not wanted:
        return df
    w = series(key, time)
    part = lambda column, kind: f"_{kind}_{column}"
    sums, longest = {(r, kind): 0 for r in wanted for kind in _PARTS[r.kind]}, {}
    for r, kind in sums:
        longest[r.column, kind] = max(r.n, longest.get((r.column, kind), 0))
    first = {"sum": lambda c: F.coalesce(c, F.lit(0.0)), "count": lambda c: c.isNotNull().cast("int"), "max": lambda c: c, "min": lambda c: c}
    t, size, begun = df.select("*", *(first[kind](F.col(c)).alias(part(c, kind)) for c, kind in longest)), 1, []
    while size <= max(longest.values()):
        new = {}
        for (r, kind), reached in sums.items():
            if r.n & size:
                here, name = part(r.column, kind), f"_{kind}_of_{r.name}"
                piece = F.lag(here, reached).over(w) if reached else F.col(here)
                new[name] = _JOINED[kind](F.col(name), piece) if reached else piece
                sums[r, kind] = reached + size
        own = {part(c, kind): _JOINED[kind](F.col(part(c, kind)), F.lag(part(c, kind), size).over(w)) for (c, kind), n in longest.items() if 2 * size <= n}
        kept = [x for x in [*df.columns, *begun] if x not in new]
        t = t.select(*kept, *(x.alias(name) for name, x in (new | own).items()))
        begun, size = [*(x for x in begun if x not in new), *new], 2 * size
    value = lambda r: F.col(f"_sum_of_{r.name}") / F.col(f"_count_of_{r.name}") if r.kind == "avg" else F.col(f"_{r.kind}_of_{r.name}")
    return t.select(*df.columns, *(F.when(F.col(f"_count_of_{r.name}") >= r.least, value(r)).alias(r.name) for r in wanted))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def change(value: Column, n: int, key: str = "ticker", time: str = "d") -> Column:
    """Relative change over n rows."""
    return ratio(value, F.lag(value, n).over(series(key, time))) - 1


def flag(test: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(test, F.lit(False))


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1 with ties averaged; null stays. Ties are the rows of the same order, so one sort serves both."""
    ordered = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    ties = F.count(value).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2)


def percentile_rank(value: Column, *by: str) -> Column:
    """Rank of each value in its group as a share of the group's values; ties get the mean of their ranks; null stays."""
    return average_rank(value, *by) / F.nullif(F.count(value).over(Window.partitionBy(*by)), F.lit(0))


def week_end(day: Column) -> Column:
    """Sunday of the Monday-to-Sunday week."""
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def days_since(event: Column, key: str = "ticker", time: str = "d") -> Column:
    """Rows since the last event; one more than the series has rows if there was none."""
    number = F.row_number().over(series(key, time))
    last = F.last(F.when(event, number), ignorenulls=True).over(series(key, time).rowsBetween(Window.unboundedPreceding, 0))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    return F.coalesce(number - last, total + 1)


def streak(rising: Column, key: str = "ticker", time: str = "d") -> Column:
    """Length of the run of rows for which rising holds."""
    number = F.row_number().over(series(key, time))
    broken = F.coalesce(F.max(F.when(~flag(rising), number)).over(series(key, time).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return number - broken


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Rounded, with non-finite values as null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits))

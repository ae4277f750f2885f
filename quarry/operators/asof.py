"""As-of join of two tables: to each left row the right row of the same keys whose time is nearest before or after.

Rows of both sides are dealt over ranges of (keys, time), so one key may lie in many ranges. Within a range the last right
row seen is a window; what a range does not know comes from the ranges before it, of which each key that crosses an edge
has one row: no more than there are ranges. An edge may lie between rows of one time, so the side that is looked at goes
first within a time: right rows before left ones, and after them for a join that only looks forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import stored


def _number(df: DataFrame, time: str) -> Column:
    """Times as numbers: dates in days, timestamps in microseconds."""
    kind = df.schema[time].dataType.simpleString()
    return F.unix_date(F.col(time)) if kind == "date" else F.unix_micros(F.col(time)) if kind.startswith("timestamp") else F.col(time)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, direction: str = "backward", tolerance: float | None = None, names: list[str] | None = None) -> DataFrame:
    """left with ``names`` of right (all that are not keys, if not given), null where no right row fits. backward takes the
    last right row at or before the left row's time, forward the first at or after it, nearest the nearer of the two, of
    equals the earlier. Farther than ``tolerance`` (days for dates, microseconds for timestamps) none fits. Of right rows
    with the same keys and time the one that hashes highest is taken. Null keys or times fit nothing; left rows stay."""
    own = names or [c for c in right.columns if c not in by]
    keys = [f"_k{i}" for i in range(len(by))]
    a = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), _number(left, time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    b = right.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), _number(right, right_time).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(*own).alias("_r"))
    fits = F.lit(True)
    for k in (*keys, "_t"):
        fits = fits & F.col(k).isNotNull()
    rows = a.where(fits).unionByName(b.where(fits), allowMissingColumns=True).withColumn("_h", F.xxhash64("_l", "_r"))
    inner = [F.col(c).desc() if direction == "forward" else F.col(c) for c in ("_side", "_h")]
    ranged = stored(rows.repartitionByRange(*keys, "_t", *inner).withColumn("_part", F.spark_partition_id()), "asof")
    out = ranged
    for name in ("backward", "forward"):
        if direction in (name, "nearest"):
            out = _seen(out, ranged, keys, name)
    gap = lambda c: F.abs(F.col(c)["t"] - F.col("_t"))
    if direction == "nearest":
        found = F.when(F.col("_backward").isNull() | (gap("_forward") < gap("_backward")), F.col("_forward")).otherwise(F.col("_backward"))
    else:
        found = F.col(f"_{direction}")
    out = out.where("_side = 1").withColumn("_found", found)
    if tolerance is not None:
        out = out.withColumn("_found", F.when(gap("_found") <= tolerance, F.col("_found")))
    met = out.select("_l.*", *(F.col("_found")["r"][c].alias(c) for c in own))
    rest = left.where(~F.coalesce(F.col(time).isNotNull() & F.forall(F.array(*(F.col(c).isNotNull() for c in by)), lambda x: x), F.lit(False)))
    return met.unionByName(rest.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in own)))


def _seen(rows: DataFrame, ranged: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """rows with _backward or _forward: t, h and r of the nearest right row that way, of equally near ones that of the
    highest hash, which may lie in another range than the first of them."""
    ahead = direction == "forward"
    order = [F.col("_t").desc(), F.col("_side"), F.col("_h")] if ahead else [F.col("_t"), F.col("_side"), F.col("_h")]
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_h").alias("h"), F.col("_r").alias("r")))
    best = lambda t, h: F.struct(-t if ahead else t, h)
    ends = ranged.groupBy("_part", *keys).agg(F.max_by(mine, F.when(F.col("_side") == 0, best(F.col("_t"), F.col("_h")))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if ahead else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("_end").isNotNull(), best(F.col("_end")["t"], F.col("_end")["h"]))
    carried = ends.select("_part", *keys, F.max_by("_end", end).over(before).alias("_carried")).where(F.col("_carried").isNotNull())
    joined = rows.join(F.broadcast(carried), ["_part", *keys], "left")  # one row for each key that crosses into a range
    seen, other = F.col("_here"), F.col("_carried")
    higher = (other["t"] == seen["t"]) & (other["h"] > seen["h"])
    return joined.withColumn("_here", F.last(mine, ignorenulls=True).over(here)).withColumn(f"_{direction}", F.when(seen.isNull() | higher, other).otherwise(seen)).drop("_carried", "_here")

"""Ranking-quality metrics, selections and reports over a scored panel (ticker, week_key, sector, score, fwd_ret,
bench_ret, y). Ties in score are broken by ticker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.windows import average_rank, flag, percentile_rank
from quarry.operators.order_statistics import long_form, quantiles
from quarry.sources.tables import stored

WEEK = "week_key"
WEIGHTS = [round(0.35 + 0.05 * i, 2) for i in range(11)]


def placed(scored: DataFrame, by: str = WEEK, best: bool = True) -> DataFrame:
    """place from 1 in each week, by score and then ticker; missing scores come last."""
    order = F.col("score").desc_nulls_last() if best else F.col("score").asc_nulls_last()
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col("ticker"))))


def top(scored: DataFrame, k: int, by: str = WEEK, best: bool = True) -> DataFrame:
    return placed(scored, by, best).where(F.col("place") <= k)


def known(scored: DataFrame) -> DataFrame:
    """Rows with a label and a finite score."""
    return scored.where("score is not null and y is not null and not isnan(score) and abs(score) < double('infinity')")


def precision_by_week(scored: DataFrame, k: int) -> DataFrame:
    return top(known(scored), k).groupBy(WEEK).agg(F.avg("y").alias("p_at_k"), F.count("*").alias("n"))


def precision_summary(scored: DataFrame, ks: tuple[int, ...] = (10, 15, 20)) -> DataFrame:
    """Mean precision at each k, base rate and lift at the largest."""
    ranked = placed(known(scored))
    weekly = ranked.groupBy(WEEK).agg(*(F.avg(F.when(F.col("place") <= k, F.col("y"))).alias(f"p{k}") for k in ks), F.sum("y").alias("_y"), F.count("*").alias("_n"))
    out = weekly.agg(*(F.avg(f"p{k}").alias(f"p_at_{k}") for k in ks), (F.sum("_y") / F.sum("_n")).alias("base_rate"))
    return out.withColumn("lift", F.col(f"p_at_{max(ks)}") / F.nullif(F.col("base_rate"), F.lit(0.0)))


def ndcg(scored: DataFrame, k: int = 20) -> DataFrame:
    """Mean NDCG at k over weeks of at least two rows with some positive; tied scores share their mean gain."""
    w = Window.partitionBy(WEEK)
    discount = lambda place: F.when(place <= k, 1 / F.log2(place + 1)).otherwise(0.0)
    r = known(scored).select(WEEK, "score", F.col("y").cast("double").alias("y"), F.count("*").over(w).alias("n"))
    r = r.select(
        "*", discount(F.row_number().over(w.orderBy(F.col("score").desc()))).alias("d"), discount(F.row_number().over(w.orderBy(F.col("y").desc()))).alias("best"),
        F.avg("y").over(Window.partitionBy(WEEK, "score")).alias("gain"),
    )
    weekly = r.where("n >= 2").groupBy(WEEK).agg(F.sum(F.col("gain") * F.col("d")).alias("dcg"), F.sum(F.col("y") * F.col("best")).alias("ideal"))
    return weekly.agg(F.avg(F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0))).alias("ndcg"))


def spread(scored: DataFrame, k: int = 20) -> DataFrame:
    """Mean weekly return of the top k less that of the bottom k; without returns, of the labels' means."""
    value = "fwd_ret" if "fwd_ret" in scored.columns else "y"
    rows = scored.where("score is not null")
    sides = [top(rows, k, best=b).groupBy(WEEK).agg(F.avg(value).alias("r")).agg(F.avg("r").alias(name)) for b, name in ((True, "top_ret"), (False, "bottom_ret"))]
    return sides[0].crossJoin(sides[1]).withColumn("spread", F.col("top_ret") - F.col("bottom_ret"))


def hit_rate(scored: DataFrame, k: int = 20) -> DataFrame:
    """Mean weekly share of the top k that beat the benchmark, over weeks with a benchmark."""
    rows = top(scored.where("score is not null and bench_ret is not null"), k)
    return rows.groupBy(WEEK).agg(F.avg(flag(F.col("fwd_ret") > F.col("bench_ret")).cast("double")).alias("h")).agg(F.avg("h").alias("hit_rate"))


def sector_concentration(scored: DataFrame, k: int = 20) -> DataFrame:
    """Herfindahl index of the top k's sectors, by week."""
    n = top(scored.where("score is not null"), k).where("sector is not null").groupBy(WEEK, "sector").agg(F.count("*").alias("n"))
    return n.groupBy(WEEK).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def weekly_spearman(scored: DataFrame, other: str, least: int) -> DataFrame:
    """Rank correlation of score and another column in each week of at least ``least`` rows."""
    rows = scored.where(F.col("score").isNotNull() & F.col(other).isNotNull())
    ranked = rows.select(WEEK, average_rank(F.col("score"), WEEK).alias("a"), average_rank(F.col(other), WEEK).alias("b"))
    return ranked.groupBy(WEEK).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("spearman")).where(F.col("n") >= least)


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half, of all rows or of each group. Scores are grouped first, so equal ones
    are one row."""
    return _thresholds(scored, by or []).groupBy(*(by or [])).agg(_auc().alias("auc"))


def average_precision(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over thresholds of the step in recall times precision, of all rows or of each group."""
    return _thresholds(scored, by or []).groupBy(*(by or [])).agg(_precision().alias("average_precision"))


def _auc() -> Column:
    """Of a group of _thresholds."""
    below = F.col("all_neg") - F.col("neg_up")
    return F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.max("all_pos") * F.max("all_neg"))


def _precision() -> Column:
    return F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("pos_up") / (F.col("pos_up") + F.col("neg_up")))


def _thresholds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores of each group with their positives and negatives and those at or above them. Groups and scores are
    dealt over ranges, which are written so that they stay; sums run over a group's few ranges, and within each. All groups
    take one pass, and no group is in one task."""
    by = known(scored).groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranged = stored(by.repartitionByRange(*keys, "score").withColumn("range", F.spark_partition_id()), "scores")
    ranges = ranged.groupBy("range", *keys).agg(F.min("score").alias("least"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above, every = Window.partitionBy(*keys).orderBy(F.col("least").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranges = ranges.select(
        "range", *keys, *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "pn"), F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg")
    )
    up = Window.partitionBy("range", *keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(ranges, ["range", *keys]).select(
        *keys, "score", "pos", "neg", "all_pos", "all_neg", (F.col("p_above") + F.sum("pos").over(up)).alias("pos_up"), (F.col("n_above") + F.sum("neg").over(up)).alias("neg_up")
    )


def fold_measures(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """fold, n_rows, base_rate, auc, average_precision of each fold's known rows."""
    rows = F.sum(F.col("pos") + F.col("neg"))
    return _thresholds(scored, [fold]).groupBy(fold).agg(rows.alias("n_rows"), (F.sum("pos") / rows).alias("base_rate"), _auc().alias("auc"), _precision().alias("average_precision"))


CHUNK, MERGED, AT_ONCE = 16_384, 64, 8192
_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_BEGIN = np.array((0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), np.uint32)


def _md5(words: np.ndarray) -> np.ndarray:
    """(4, message) words of the MD5 of messages of one block each, (16, message)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _BEGIN)
    f, high, there = np.empty_like(a), np.empty_like(a), words.any(axis=1)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f += a
        f += _SINES[i]
        if there[g]:
            f += words[g]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=high)
        f <<= np.uint32(_SHIFTS[i])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack((a, b, c, d)) + _BEGIN[:, None]


def _tail_words(tails: list[bytes], h: int) -> np.ndarray | None:
    """(16, tail) words of one MD5 block for each tail behind h bytes that are still zero; None if one is too long."""
    sizes = np.array([len(x) for x in tails])
    width = int(sizes.max())
    if h + width > 55:
        return None
    blocks = np.zeros((len(tails), 64), np.uint8)
    blocks[:, h : h + width] = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in tails), np.uint8).reshape(-1, width)
    blocks[np.arange(len(tails)), h + sizes] = 0x80
    words = blocks.view("<u4").astype(np.uint32)
    words[:, 14] = 8 * (h + sizes)
    return np.ascontiguousarray(words.T)


def md5_words(heads: list[bytes], tails: list[bytes], behind: np.ndarray | None) -> np.ndarray:
    """(4, head, tail) words of the MD5 of each head, all of one length, followed by each tail (behind: their words): many
    at once where a message fits one block of MD5, one by one where not."""
    if behind is None:
        flat = np.frombuffer(b"".join(hashlib.md5(x + y).digest() for x in heads for y in tails), "<u4")
        return flat.astype(np.uint32).reshape(len(heads), len(tails), 4).transpose(2, 0, 1)
    before = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in heads), "<u4").astype(np.uint32).reshape(-1, 16).T
    return _md5((behind[:, None, :] | before[:, :, None]).reshape(16, -1)).reshape(4, len(heads), len(tails))


def _first_by_hash(rows: pa.Table, k: int, n: int) -> pa.Table:
    """For each of n shuffles the k rows of a chunk whose hashes are least: perm, first (k: the hash, y)."""
    tails, y, week = [x.encode() for x in rows["ticker"].to_pylist()], np.asarray(rows["y"]), str(rows[WEEK][0])
    size, at_once = len(tails), max(1, AT_ONCE // len(tails))
    limit = min((3 * k << 32) // size, (1 << 32) - 1)  # hashes are spread evenly, so some 3 k of them lie below
    hashes, labels, perms = [], [], [p for digits in range(1, 20) for p in range(10 ** (digits - 1) if digits > 1 else 0, min(n, 10**digits))]
    at, behind = 0, {}
    while at < n:
        some = [p for p in perms[at : at + at_once] if len(str(p)) == len(str(perms[at]))]
        heads = [f"{p}|{week}|".encode() for p in some]
        h = len(heads[0])
        if h not in behind:
            behind = {h: _tail_words(tails, h)}
        parts = [md5_words(heads, tails[i : i + AT_ONCE], None if behind[h] is None else behind[h][:, i : i + AT_ONCE]) for i in range(0, size, AT_ONCE)]
        words = (parts[0] if len(parts) == 1 else np.concatenate(parts, axis=2)).byteswap()
        for j in range(len(some)):
            few = np.flatnonzero(words[0, j] < limit)
            own = words[:, j, few] if len(few) >= k else words[:, j]
            order = np.lexsort(own[::-1])[:k]
            hashes.append(np.ascontiguousarray(own[:, order].T).byteswap().tobytes())
            labels.append(y[few[order] if len(few) >= k else order])
        at += len(some)
    flat, each = np.concatenate(labels), min(k, size)
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(b"".join(hashes))]).cast(pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.StructArray.from_arrays([keys, pa.array(flat)], names=["k", "y"]))
    return pa.table({WEEK: pa.array([rows[WEEK][0].as_py()] * n, pa.date32()), "chunk": pa.array([rows["chunk"][0].as_py()] * n, pa.int64()), "perm": pa.array(perms, pa.int64()), "first": lists})


def permutation_test(scored: DataFrame, k: int = 20, n: int = 500) -> DataFrame:
    """Observed precision at k, its mean under n shuffles of scores within weeks, and the share at least as high. A
    shuffle orders a week's rows by a hash of its number and the row; only the k first by hash are looked at. Means are
    compared after rounding, so that equal ones are, in whatever order they were summed. A week's rows lie in chunks of about CHUNK; each chunk keeps its own k first for every shuffle, and MERGED chunks at a time become
    one, so that no row or task holds a large week. Hashes are MD5 of many rows at once."""
    rows = known(scored).select(WEEK, "ticker", "y")
    observed = precision_by_week(scored, k).agg(F.avg("p_at_k").alias("observed"))
    largest = rows.groupBy(WEEK).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most, parts = -(-largest // CHUNK), int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("ticker"), F.ceil(F.count("*").over(Window.partitionBy(WEEK)) / CHUNK)) if most > 1 else F.lit(0).cast("long")
    plain = rows.select(WEEK, F.col("ticker").cast("string").alias("ticker"), F.col("y").cast("double").alias("y"), chunk.alias("chunk"))
    schema = f"{WEEK} date, chunk long, perm long, first array<struct<k: binary, y: double>>"
    kept = plain.repartition(parts, WEEK, "chunk").groupBy(WEEK, "chunk").applyInArrow(lambda held: _first_by_hash(held, k, n), schema)
    while most > 1:
        some = kept.withColumn("chunk", F.floor(F.col("chunk") / MERGED)).groupBy(WEEK, "chunk", "perm").agg(F.collect_list("first").alias("lists"))
        kept, most = some.select(WEEK, "chunk", "perm", F.slice(F.sort_array(F.flatten("lists")), 1, k).alias("first")), -(-most // MERGED)
    mean = F.aggregate("first", F.lit(0.0), lambda total, x: total + x["y"]) / F.size("first")
    perms = kept.select("perm", mean.alias("v")).groupBy("perm").agg(F.avg("v").alias("v"))
    return perms.crossJoin(observed).agg(F.max("observed").alias("observed"), F.avg("v").alias("perm_mean"), F.avg(F.when(F.round("v", 12) >= F.round("observed", 12), 1.0).otherwise(0.0)).alias("p_value"))


def decile_spread(scored: DataFrame, buckets: int = 10, least: int = 20) -> DataFrame:
    """Mean return of the highest and lowest quantile bucket of each week; equal edges are merged, buckets are closed on
    the right."""
    rows = scored.where("score is not null and fwd_ret is not null")
    cuts = F.array_distinct(F.percentile("score", F.array(*(F.lit(i / buckets) for i in range(buckets + 1)))))
    edges = rows.groupBy(WEEK).agg(cuts.alias("e"), F.count("*").alias("n")).where(F.col("n") >= least)
    b = rows.join(edges, WEEK).withColumn("b", F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col("score")))))
    last = F.size("e") - 1
    means = b.groupBy(WEEK).agg(F.avg(F.when(F.col("b") == last, F.col("fwd_ret"))).alias("top_bucket"), F.avg(F.when(F.col("b") == 1, F.col("fwd_ret"))).alias("low_bucket"), F.max(last).alias("k"))
    return means.where("k >= 2").select(WEEK, "top_bucket", "low_bucket", (F.col("top_bucket") - F.col("low_bucket")).alias("decile_spread"))


def attribution(scored: DataFrame) -> DataFrame:
    """By week: returns of the first 1, 3, 5, 10 and 20, the linearly weighted 20, and shares beating the benchmark."""
    p, r = F.col("place"), F.col("fwd_ret")
    ranked = placed(scored.where("score is not null"))
    weight = F.when(r.isNotNull() & (p <= 20), 21 - p)
    beat = lambda n: F.avg(F.when((p <= n) & r.isNotNull() & F.col("bench_ret").isNotNull(), (r > F.col("bench_ret")).cast("double")))
    return ranked.groupBy(WEEK).agg(
        F.count(F.when(r.isNotNull(), 1)).alias("n_valid"), *(F.avg(F.when(p <= n, r)).alias(f"top{n}_ret") for n in (1, 3, 5, 10, 20)),
        (F.sum(r * weight) / F.sum(weight)).alias("top20_lw_ret"), beat(3).alias("top3_beat"), beat(10).alias("top10_beat"),
    )


def attribution_summary(scored: DataFrame) -> DataFrame:
    """Mean, median and positive share of the weekly Spearman, mean decile spread, mean of top 3 less top 20."""
    a = weekly_spearman(scored, "fwd_ret", 20).agg(F.avg("spearman").alias("spearman_mean"), F.percentile("spearman", F.lit(0.5)).alias("spearman_median"), F.avg((F.col("spearman") > 0).cast("double")).alias("spearman_positive"))
    b = decile_spread(scored).agg(F.avg("decile_spread").alias("mean_decile_spread"))
    c = attribution(scored).where("top3_ret is not null and top20_ret is not null").agg(F.avg(F.col("top3_ret") - F.col("top20_ret")).alias("top3_less_top20"))
    return a.crossJoin(b).crossJoin(c)


def beat_benchmark(r: Column, b: Column) -> Column:
    return F.when(r.isNotNull() & b.isNotNull(), (r > b).cast("int"))


def score_shift(scored: DataFrame, warn: float = 1.5) -> DataFrame:
    """How far the last week's mean score lies from the earlier ones', in their deviations."""
    s = scored.where("score is not null").crossJoin(F.broadcast(scored.where("score is not null").agg(F.max(WEEK).alias("_last"))))
    now = F.col(WEEK) == F.col("_last")
    out = s.agg(F.avg(F.when(now, F.col("score"))).alias("mean_last"), F.avg(F.when(~now, F.col("score"))).alias("mean_before"), F.stddev_samp(F.when(~now, F.col("score"))).alias("std_before"))
    out = out.withColumn("shift", F.abs(F.col("mean_last") - F.col("mean_before")) / F.greatest(F.col("std_before"), F.lit(1e-6)))
    return out.withColumn("warned", F.col("shift") > warn)


def turnover(scored: DataFrame, k: int = 20) -> DataFrame:
    """By week: share of the top k that was not in the week before's."""
    t = top(scored.where("score is not null"), k).select("ticker", WEEK)
    weeks = scored.select(WEEK).distinct().withColumn("w", F.row_number().over(Window.orderBy(WEEK)))
    t = t.join(F.broadcast(weeks), WEEK)
    before = t.select("ticker", (F.col("w") + 1).alias("w"), F.lit(1).alias("kept"))
    return t.join(before, ["ticker", "w"], "left").groupBy(WEEK, "w").agg(F.count("*").alias("n"), F.count("kept").alias("kept")).where("w > 1").select(WEEK, "n", "kept", (1 - F.col("kept") / F.col("n")).alias("turnover"))


def smoothed(scored: DataFrame, alpha: float) -> DataFrame:
    """alpha * last week's score + (1 - alpha) * this one's, where the ticker has a score in the week before."""
    before = scored.select("ticker", F.date_add(WEEK, 7).alias(WEEK), F.col("score").alias("_p"))
    s = scored.join(before, ["ticker", WEEK], "left")
    return s.withColumn("smoothed", F.when(F.col("_p").isNotNull(), alpha * F.col("_p") + (1 - alpha) * F.col("score")).otherwise(F.col("score"))).drop("_p")


def compare_runs(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """Weeks in which run b is better or worse than a by precision at k, with the best and worst change."""
    left, right = (precision_by_week(x, k).select(WEEK, F.col("p_at_k").alias(n)) for x, n in ((a, "p_a"), (b, "p_b")))
    j = left.join(right, WEEK, "full").withColumn("d", F.col("p_b") - F.col("p_a"))
    count = lambda test: F.count(F.when(test, 1))
    return j.agg(count(F.col("d") > 0).alias("better"), count(F.col("d") < 0).alias("worse"), count(F.col("d") == 0).alias("same"), F.max("d").alias("best_change"), F.min("d").alias("worst_change"), F.avg("d").alias("mean_change"))


def weekly_summary(scored: DataFrame, k: int = 20) -> DataFrame:
    """By week: universe size, mean score and return of the top k, the benchmark, hit rate, realised precision, and the
    best and worst ticker of the top k."""
    universe = scored.where("score is not null").groupBy(WEEK).agg(F.count("*").alias("universe"))
    t = top(scored.where("score is not null"), k)
    known_ret = F.when(F.col("fwd_ret").isNotNull(), F.col("ticker"))
    best = t.groupBy(WEEK).agg(
        F.avg("score").alias("mean_score"), F.avg("fwd_ret").alias("mean_ret"), F.max("bench_ret").alias("bench_ret"), F.avg(beat_benchmark(F.col("fwd_ret"), F.col("bench_ret"))).alias("hit_rate"),
        F.avg("y").alias("precision"), F.min_by(known_ret, F.when(F.col("fwd_ret").isNotNull(), F.struct(-F.col("fwd_ret"), F.col("ticker")))).alias("best_ticker"), F.min_by(known_ret, F.when(F.col("fwd_ret").isNotNull(), F.struct("fwd_ret", "ticker"))).alias("worst_ticker"),
    )
    return universe.join(best, WEEK)


def backtest_averages(summary: DataFrame) -> DataFrame:
    """Means over weeks, and the best and worst week by return."""
    rows = summary.where("mean_ret is not null")
    return rows.agg(F.avg("precision").alias("precision"), F.avg("mean_ret").alias("mean_ret"), F.avg("hit_rate").alias("hit_rate"), F.max_by(WEEK, "mean_ret").alias("best_week"), F.min_by(WEEK, "mean_ret").alias("worst_week"), F.count("*").alias("weeks"))


def dynamic_k(scored: DataFrame, share: float = 0.95, low: int = 5, high: int = 20) -> DataFrame:
    """By week: how many scores are at or above their quantile, held within bounds."""
    edge = scored.where("score is not null").groupBy(WEEK).agg(F.percentile("score", F.lit(share)).alias("e"))
    n = scored.join(edge, WEEK).groupBy(WEEK).agg(F.count(F.when(F.col("score") >= F.col("e"), 1)).alias("n"))
    return n.select(WEEK, F.least(F.greatest(F.col("n"), F.lit(low)), F.lit(high)).alias("k"))


def anchor(panel: DataFrame) -> DataFrame:
    """The most common last week of the tickers (the latest of equals), and the share of tickers that have it."""
    last = panel.groupBy("ticker").agg(F.max(WEEK).alias(WEEK))
    counts = last.groupBy(WEEK).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(WEEK, F.struct("n", WEEK)).alias("anchor"), (F.max("n") / F.sum("n")).alias("coverage"), F.sum("n").alias("tickers"))


def missing_at_anchor(panel: DataFrame) -> DataFrame:
    last = panel.groupBy("ticker").agg(F.max(WEEK).alias("last_week"))
    return last.crossJoin(F.broadcast(anchor(panel))).where("last_week < anchor").select("ticker", "last_week", "anchor")


def anchor_rows(panel: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows at the anchor, or each ticker's last row if the anchor covers too few tickers."""
    last = panel.withColumn("_l", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col(WEEK).desc())))
    return last.crossJoin(F.broadcast(anchor(panel))).where(F.when(F.col("coverage") >= least, F.col(WEEK) == F.col("anchor")).otherwise(F.col("_l") == 1)).select(*panel.columns)


def profile(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Null share, quantiles and bias-corrected skewness of each column, one row for each."""
    panel = stored(panel.select(*columns), "profiled")
    long = panel.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))))
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    n = F.count("v")
    out = long.groupBy("feature").agg((1 - n / F.count("*")).alias("null_share"), F.when(n > 2, F.skewness("v") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    found = quantiles(long_form(panel, columns), shares).groupBy(F.col("grp").alias("feature")).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"q{round(100 * s)}") for s in shares))
    return out.join(found, "feature", "left").select("feature", "null_share", *(f"q{round(100 * s)}" for s in shares), "skew")


def correlations(panel: DataFrame, new: list[str], base: list[str], alert: float = 0.85) -> DataFrame:
    """For each new column the base column it correlates most with (pairwise complete, over 50 rows), and an alert."""
    pairs = [(a, b) for a in new for b in base]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = panel.agg(*(F.when(F.count(F.when(both(a, b), 1)) > 50, F.abs(F.corr(a, b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    long = row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("feature"), F.lit(b).alias("base"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))
    return long.where("r is not null").groupBy("feature").agg(F.max_by("base", "r").alias("base"), F.max("r").alias("max_abs_corr"), (F.max("r") > alert).alias("alert"))


def coverage(rows: DataFrame, expected: list[str]) -> DataFrame:
    """By ticker: rows, last day, how many expected columns have values, and PASS, WARN or FAIL."""
    have = [c for c in expected if c in rows.columns]
    a = rows.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.max("d").alias("last_day"), *(F.count(c).alias(f"_{c}") for c in have))
    ok = sum((F.when(F.col(f"_{c}") > 0, 1).otherwise(0) for c in have), F.lit(0))
    status = F.when(F.col("present") == len(expected), "PASS").when(F.col("present") >= 0.8 * len(expected), "WARN").otherwise("FAIL")
    return a.select("ticker", "n_rows", "last_day", ok.alias("present")).withColumn("status", status)


def blend(scored: DataFrame, weight: float, prob: str = "prob") -> DataFrame:
    """score = weight * prob + (1 - weight) * percentile rank of the ranker's score in its week."""
    r = scored.withColumn("ranker_pct", percentile_rank(F.col("ranker"), WEEK))
    return r.withColumn("score", weight * F.col(prob) + (1 - weight) * F.col("ranker_pct"))


def _first_by_weights(batches: Iterator[pa.RecordBatch], groups: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """Of each stretch of rows of one group those that can be among its k first for a blend weight, once for each such
    weight, whose number is in ``_w``. Blends are compared up to what rounding may change; of more than k rows of one
    blend those of the smallest tickers are kept."""
    for batch in batches:
        n = batch.num_rows
        new = np.arange(n) == 0
        for g in groups:
            new[1:] |= pc.fill_null(pc.not_equal(batch.column(g)[1:], batch.column(g)[:-1]), True).to_numpy(zero_copy_only=False)
        cut = [*np.flatnonzero(new).tolist(), n]
        prob, pct = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_prob", "_pct"))
        for w, weight in enumerate(WEIGHTS):
            blended = weight * prob + (1 - weight) * pct
            blended[np.isnan(blended)] = np.inf  # as Spark has them
            taken = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own, at = blended[a:b], np.arange(b - a)
                if b - a > k:
                    at = np.flatnonzero(own >= np.partition(own, b - a - k)[b - a - k] - 2e-9)
                if len(at) > 2 * k and np.isfinite(own[at]).all():
                    keys = pa.table({"s": own[at], "ticker": batch.column("ticker").take(pa.array(a + at))})
                    at = at[pc.sort_indices(keys, [("s", "descending"), ("ticker", "ascending")], null_placement="at_start").to_numpy()]
                    first = np.flatnonzero(np.r_[True, own[at][1:] != own[at][:-1]])
                    at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k]
                taken.append(a + at)
            some = batch.take(pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64)))
            yield some.append_column("_w", pa.array(np.full(some.num_rows, w), pa.int64()))


def best_weight(scored: DataFrame, by: str | None = "fold", k: int = 20) -> DataFrame:
    """For each fold (or over all rows) the first blend weight of .35, .40 .. .85 with the best precision at k. Ranks are
    made where a week's rows lie in order; there, each batch keeps the rows that can be among the k first for a weight, and
    only these are ranked by blends."""
    keys = [by] if by else []
    r = scored.where("y is not null and prob is not null").withColumn("_pct", percentile_rank(F.col("ranker"), *keys, WEEK)).where("_pct is not null")
    rows = r.select(*keys, WEEK, "ticker", "y", F.col("prob").cast("double").alias("_prob"), F.col("_pct").cast("double").alias("_pct"))
    few = rows.mapInArrow(lambda batches: _first_by_weights(batches, [*keys, WEEK], k), T.StructType([*rows.schema, T.StructField("_w", T.LongType())]))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("_w").cast("int") + 1)
    mixed = few.withColumn("weight", weight).withColumn("s", F.round(F.col("weight") * F.col("_prob") + (1 - F.col("weight")) * F.col("_pct"), 9))
    place = F.row_number().over(Window.partitionBy(*keys, "weight", WEEK).orderBy(F.col("s").desc(), F.col("ticker")))
    p = mixed.withColumn("p", place).where(F.col("p") <= k).groupBy(*keys, "weight", WEEK).agg(F.avg("y").alias("v")).groupBy(*keys, "weight").agg(F.round(F.avg("v"), 12).alias("p_at_k"))
    return p.groupBy(*keys).agg(F.max_by("weight", F.struct("p_at_k", -F.col("weight"))).alias("weight"), F.max("p_at_k").alias("p_at_k"))


def class_ratio(scored: DataFrame) -> DataFrame:
    n = lambda v: F.greatest(F.count(F.when(F.col("y") == v, 1)), F.lit(1))
    return scored.agg((n(0) / n(1)).alias("ratio"))


def anchor_by_benchmark(panel: DataFrame, benchmark: int | str) -> DataFrame:
    """anchor: the benchmark ticker's last week, or the last of all where it has none."""
    return panel.agg(F.coalesce(F.max(F.when(F.col("ticker") == benchmark, F.col(WEEK))), F.max(WEEK)).alias("anchor"))


def placed_by_keys(scored: DataFrame, keys: list[str], by: str = WEEK) -> DataFrame:
    """place from 1 in each week by several scores, the first that differs deciding, and then by ticker."""
    order = [F.col(c).desc_nulls_last() for c in keys]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order, "ticker")))


def label_correlations(panel: DataFrame, columns: list[str], label: str = "y", least: int = 50) -> DataFrame:
    """feature, r: absolute correlation of each column with the label, over more than ``least`` rows that have both."""
    both = [F.col(c).isNotNull() & F.col(label).isNotNull() for c in columns]
    row = panel.agg(*(F.when(F.count(F.when(b, 1)) > least, F.abs(F.corr(c, label))).alias(c) for c, b in zip(columns, both, strict=True)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns)))).where("r is not null")


def new_feature_positions(importance: DataFrame, new: list[str], alert: int = 30) -> DataFrame:
    """Of importance (feature, importance): place, feature, importance of the new features, whether the place is beyond
    ``alert``, and whether it is the best or the worst of the new ones."""
    ranked = importance.withColumn("place", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))).where(F.col("feature").isin(new))
    every = Window.partitionBy()
    return ranked.select(
        "place", "feature", "importance", (F.col("place") > alert).alias("alert"),
        (F.col("place") == F.min("place").over(every)).alias("best"), (F.col("place") == F.max("place").over(every)).alias("worst"),
    )


def run_deltas(runs: DataFrame, measure: str, base: str = "BASELINE") -> DataFrame:
    """place, run_label, the measure, its change from the base run, and whether the run is the best; runs has a row for
    each."""
    order = Window.orderBy(F.col(measure).desc_nulls_last(), "run_label")
    b = runs.where(F.col("run_label") == base).agg(F.max(measure).alias("_base"))
    out = runs.crossJoin(F.broadcast(b)).withColumn("place", F.row_number().over(order))
    return out.select("place", "run_label", measure, (F.col(measure) - F.col("_base")).alias("change"), (F.col("place") == 1).alias("best"))

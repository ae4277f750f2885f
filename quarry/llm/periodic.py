"""Periodic run detection by recursive frequency splitting (operator 13).

A run is a stretch of consecutive words whose words q apart are equal, q being the smallest such period, of at least
``least`` words and two periods, that no neighbouring word extends. Each word of a run occurs at least twice in it, so a
word that occurs once in a segment splits it; the pieces are counted anew until none splits further. What is left is
scanned lag by lag. In a long segment only those lags are scanned that a repeated stretch of words proposes: a run of
period q in k .. 2k-1 holds a stretch of k/2 words that begins at a multiple of k/2 and occurs again q words later, so
the occurrences of such stretches k to 2k-1 words on name every run; they number no more than the segment's words for
each power of two. Words are compared by the ids that their bytes get, never by a hash.

Defined cases: null text has no words and no runs; each row is taken by itself, so repeated and null ids do no harm; an
empty table gives no rows; other columns are not read. A task holds one text, and arrays over its words, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import flat_bytes, is_word, runs, slices, table, texts_of

LEAST = 12
#: Segments of up to so many words are scanned at every lag; ROUNDS of splitting are enough for prose, and what more
#: would split is scanned as it is, with the same runs.
SCAN, ROUNDS, SHORT_LAGS = 2048, 64, 8
WHITE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return np.asarray(words.dictionary_encode().indices, dtype=np.int64) if len(start) else np.zeros(0, np.int64)


def surviving(ids: np.ndarray, segment: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Places of the words of each segment that is left. segment is a number for each word, equal within a text."""
    at, done = np.arange(len(ids)), []
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, key, count = np.unique(segment * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        often = count[key] > 1
        breaks = np.flatnonzero(segment[1:] != segment[:-1]) + 1
        whole = np.minimum.reduceat(often, np.concatenate(([0], breaks)))  # segments that nothing splits
        size = np.diff(np.concatenate(([0], breaks, [len(at)])))
        stable = np.repeat(whole & (size >= least), size)
        done += np.split(at[stable], np.cumsum(size[whole & (size >= least)])[:-1]) if stable.any() else []
        keep = often & ~np.repeat(whole, size)
        piece = np.cumsum(np.concatenate(([True], (segment[1:] != segment[:-1]) | ~keep[:-1] | ~keep[1:])))[keep]
        at = at[keep]
        long = np.bincount(piece)[piece] >= least
        at, segment = at[long], np.unique(piece[long], return_inverse=True)[1]
    return done + (np.split(at, np.flatnonzero(segment[1:] != segment[:-1]) + 1) if len(at) else [])


def _stretches(equal: np.ndarray, lag: int, least: int) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    length = edge[1::2] - edge[::2] + lag
    enough = length >= max(least, 2 * lag)
    return [(s, n, lag) for s, n in zip(edge[::2][enough].tolist(), length[enough].tolist(), strict=True)]


def _by_lag(ids: np.ndarray, lags: range, least: int) -> list[tuple[int, int, int]]:
    found = []
    for q in lags:
        equal = ids[q:] == ids[:-q]
        if np.count_nonzero(equal) >= max(least - q, q):
            found += _stretches(equal, q, least)
    return found


def _proposed(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Stretches of lags of SHORT_LAGS and more, where a repeated stretch of words proposes one."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]  # ranks[j][i] names the 2**j words from i on
    while 2 ** len(ranks) <= n:
        half = 2 ** (len(ranks) - 1)
        a, b = ranks[-1][: n - 2 * half + 1], ranks[-1][half : n - half + 1]
        ranks.append(np.unique(a * (n + 1) + b, return_inverse=True)[1].astype(np.int64))
    found: set[tuple[int, int, int]] = set()
    k = SHORT_LAGS
    while 2 * k <= n:
        g = k // 2
        rank = ranks[g.bit_length() - 1]
        keys = np.sort(rank * (n + 1) + np.arange(len(rank)))
        p = np.arange(0, len(rank), g)
        low, high = np.searchsorted(keys, rank[p] * (n + 1) + np.minimum(p + k, n)), np.searchsorted(keys, rank[p] * (n + 1) + np.minimum(p + 2 * k, n))
        size = high - low
        a = np.repeat(p, size)
        b = keys[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())] % (n + 1)
        q = b - a
        left, right = _common(ranks, a, b, -1), _common(ranks, a, b, 1)
        length = left + right + q
        enough = length >= np.maximum(least, 2 * q)
        found.update(zip((a - left)[enough].tolist(), length[enough].tolist(), q[enough].tolist(), strict=True))
        k *= 2
    return list(found)


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from a and b (a < b) on, or before them where way is -1."""
    n, have = len(ranks[0]), np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        step = 2**j
        x, y = (a + have, b + have) if way > 0 else (a - have - step, b - have - step)
        fits = (y + step <= n) if way > 0 else (x >= 0)
        same = np.zeros(len(a), bool)
        same[fits] = ranks[j][x[fits]] == ranks[j][y[fits]]
        have += step * same
    return have


def runs_in(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment, by start and then period."""
    n = len(ids)
    found = _by_lag(ids, range(1, n // 2 + 1), least) if n <= SCAN else _by_lag(ids, range(1, SHORT_LAGS), least) + _proposed(ids, least)
    smallest: dict[tuple[int, int], int] = {}  # a multiple of the period gives the same stretch
    for s, length, q in found:
        smallest[s, length] = min(q, smallest.get((s, length), q))
    return sorted((s, length, q) for (s, length), q in smallest.items())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed (the words but those that a run
    contains after its first period, joined by one space)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, text = flat_bytes(part.column(1))
                inside = is_word(data)
                start, end = runs(inside, text)
                first = np.searchsorted(start, text)
                ids = word_ids(data, start, end, inside)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
                for at in surviving(ids, doc, least):
                    d = int(doc[at[0]])
                    found[d] += [(int(at[s]) - int(first[d]), n, q) for s, n, q in runs_in(ids[at], least)]
                raw, collapsed = data.tobytes(), []
                for d in range(part.num_rows):
                    words = raw[text[d] : text[d + 1]].split()
                    if found[d]:
                        found[d].sort()
                        gone = np.zeros(len(words) + 1, np.int64)
                        for s, n, q in found[d]:
                            gone[s + q] += 1
                            gone[s + n] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words).decode())
                flat = np.array([x for rows in found for x in rows], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
                columns = [part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(offsets, fields), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return texts_of(docs).mapInArrow(scanned, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h = crc32(decimal doc_id) and g = floor(h / 10), where 10 divides h the n words of a text become
    periodic from word a = g % n on, with period 1 + floor((n - a) / (3 + g % 8)); they are joined by one space. Other
    texts, those without words and those without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WHITE), lambda w: w != "")

    def tail(w: Column) -> Column:
        n, g = F.size(w), F.col("g")
        return F.transform(F.array(F.struct(n.alias("n"), (g % n).cast("int").alias("a"))), lambda x: _wound(w, x["a"], F.lit(1) + F.floor((x["n"] - x["a"]) / (F.lit(3) + g % 8)).cast("int")))[0]

    def _wound(w: Column, a: Column, p: Column) -> Column:
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.col("text")))[0]
    rows = texts_of(docs).withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10))
    return rows.select("doc_id", F.when(F.coalesce(F.col("h") % 10 == 0, F.lit(False)), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, the longest of them, and digests of all runs and of the collapsed words."""
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    length = -F.col("best.n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.n) div best.period").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

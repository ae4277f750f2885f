"""Approximate nearest neighbours by multi-index hashing (operator 8).

A rotation that makes the signs of rotated vectors good binary codes (iterative quantisation) is learned on at most
``sample_rows`` vectors, with the Hamming radius within which the sample's own neighbours lie. Every vector is indexed:
equal vectors once, with the smallest ids they have (more can never be among the nearest). Rows and queries are dealt
over cells of bounded blocks, a row once for each 16,384 queries and a query once for each 16,384 rows. A cell cuts the codes into substrings and indexes each; by the pigeonhole principle every
code within the radius agrees with the query in some substring up to a few bits, so probing those buckets finds them
all. The codes found within the radius are reranked by true distances. Where a cell finds fewer than k, its radius grows.

Defined cases: vectors that are null, empty, zero or of another length than most, or hold nulls or non-finite
components take no part; fewer than k candidates are all returned; ties go to the smaller id; rows that repeat an id
with one vector count once; null ids take no part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, sampled, stream, table

SUBSTRINGS = 4
ROW_BLOCK = QUERY_BLOCK = 16_384


@dataclass
class Codes:
    """mean and rotation of the codes, and the radius to search."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as unsigned 64-bit integers."""
        signs = (vectors - self.mean) @ self.rotation > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def learn(sample: np.ndarray, k: int, share: float = 0.97, steps: int = 40, probes: int = 300) -> Codes:
    """Iterative quantisation on the sample; the radius holds that share of the neighbours inside the sample. Neighbours
    in the whole table are nearer than those in a sample, so the radius errs to the large side."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:64].T
    z = centred @ axes
    side = axes.shape[1]
    rotation = np.linalg.qr((stream(21, side * side) / 2.0**63 - 1).reshape(side, side))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
        rotation = (u @ v).T
    codes = Codes(mean, axes @ rotation, 64)
    own, asked = codes.of(sample), sample[:probes]
    distance = (asked**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1)[None] - 2 * asked @ sample.T
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, axis=1)[:, : min(k, len(sample) - 1)]
    if near.size:
        apart = np.bitwise_count(own[: len(asked), None] ^ own[near])
        codes.radius = int(np.ceil(np.quantile(apart, share)))
    return codes


class MultiIndex:
    """Buckets of every substring of some codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.cuts = codes, np.linspace(0, bits, min(SUBSTRINGS, bits) + 1).astype(int)
        self.order, self.values, self.first = [], [], []
        for k in range(len(self.cuts) - 1):
            part = self.part(codes, k)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.order.append(order)
            self.values.append(values)
            self.first.append(np.append(first, len(codes)))

    def part(self, codes: np.ndarray, k: int) -> np.ndarray:
        return codes >> np.uint64(self.cuts[k]) & np.uint64((1 << int(self.cuts[k + 1] - self.cuts[k])) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code is within the radius: radius = parts * t + rest, so some substring among the first
        rest + 1 differs in at most t bits, or some other one in at most t - 1."""
        parts = len(self.order)
        t, rest = divmod(radius, parts)
        hit = np.zeros(len(self.codes), dtype=bool)
        for k in range(parts):
            most = t if k <= rest else t - 1
            if most < 0:
                continue
            near = np.flatnonzero(np.bitwise_count(self.values[k] ^ self.part(np.array([code]), k)) <= most)
            size = self.first[k][near + 1] - self.first[k][near]
            at = np.repeat(self.first[k][near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit[self.order[k][at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def search_cell(codes: Codes, k: int, ids: list[list[int]], rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
    """(query id, row id, distance) of the k nearest found in this cell."""
    index, out = MultiIndex(codes.of(rows), codes.bits), []
    for query_id, query, code in zip(query_ids.tolist(), queries, codes.of(queries), strict=True):
        radius = codes.radius
        while True:
            found = index.within(code, radius)
            n = sum(len(ids[r]) for r in found[: k + 1].tolist()) if len(found) <= k else k + 1
            if n > k or radius >= codes.bits:
                break
            radius = min(radius + 2, codes.bits)
        distance = np.sqrt(((rows[found] - query) ** 2).sum(axis=1))
        if len(found) > k + 1:
            edge = np.partition(distance, k)[k]
            found, distance = found[distance <= edge], distance[distance <= edge]
        best = sorted((d, i) for d, r in zip(distance.tolist(), found.tolist(), strict=True) for i in ids[r] if i != query_id)[:k]
        out.extend((query_id, i, d) for d, i in best)
    return out


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = 4000) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k rows nearest to each query, itself left out. rows and
    queries have vec_id and embedding."""
    spark = rows.sparkSession
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == queries.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    clean = [
        x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        for x in (rows, queries)
    ]
    sample = sampled(clean[0], "vec_id", sample_rows).toArrow().combine_chunks().sort_by("vec_id")
    schema = "query_id long, rank int, vec_id long, score double"
    if sample.num_rows == 0:
        return spark.createDataFrame([], schema)
    size = np.asarray(sample["embedding"].combine_chunks().value_lengths())
    dimension = int(np.bincount(size).argmax())
    codes = learn(_matrix(sample.filter(pa.array(size == dimension))["embedding"]), k)
    row_in, query_in = (x.where(F.size("embedding") == dimension).dropDuplicates(["vec_id", "embedding"]) for x in clean)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = row_in.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    index = materialize(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "index")
    asked = materialize(query_in, "queries")
    row_blocks, query_blocks = (max(1, -(-x.count() // block)) for x, block in ((index, ROW_BLOCK), (asked, QUERY_BLOCK)))
    left = index.withColumn("i", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(row_blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = []
        if mine.num_rows and theirs.num_rows:
            found = search_cell(codes, k, mine["ids"].to_pylist(), _matrix(mine["embedding"]), np.asarray(theirs["vec_id"]), _matrix(theirs["embedding"]))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))

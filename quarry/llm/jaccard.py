"""N-gram Jaccard join by MinHash banding (operator 2).

Texts whose sets of word n-grams are equal form a class, of which one row goes on. Each class gets a MinHash signature
of ``bands`` x ``rows``; ``choose_bands`` picks these for a target recall at the threshold. Classes that share a band's
hash are candidates. A bucket whose members are those of a bucket of an earlier band is left out, for it brings no new
pair. The n-gram sets of the classes that are left are joined to their buckets and verified there, exactly, each pair
in the first band that both share. Buckets of more than ``CELL`` members are dealt over cells, one for each pair of
sub-buckets, so that no task holds more than two sub-buckets and no pair is lost. A cell returns one row for each
member that has partners: how many, and one edge to the member's group. Groups are the connected components. Rows of
common classes and buckets meet theirs by broadcast, so no task gets all of them.

Defined cases: words are lower-cased; a text of fewer words than n has one n-gram, all its words; texts without words
(null, empty, blank) have no n-grams, no links and each its own group, the row's id; rows that repeat an id count as
one document if their texts agree, and otherwise the id is linked as any of its texts is; rows with a null id take no
part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import Words, join_common, materialize, mix, slices, stream, table, texts_of, unused
from quarry.llm.components import connected_components

CELL = 400
COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the largest rows for which bands * rows <= most hashes find a pair at the threshold with at least
    that probability; larger rows mean fewer false candidates."""
    for rows in range(16, 0, -1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash), sorted, each once for each text."""
    doc, grams = words.grams(n)
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def band_hashes(doc: np.ndarray, grams: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have n-grams, their band hashes as a matrix)."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    odd, add = stream(11, bands * rows) | np.uint64(1), stream(12, bands * rows)
    out = np.zeros((len(first), bands), dtype=np.uint64)
    for k in range(bands * rows if len(first) else 0):
        least = np.minimum.reduceat((grams * odd[k] + add[k]) >> np.uint64(16), first)
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(31) + least)
    return doc[first], out


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key1, key2 (a digest of the n-gram set; null without words), band hashes."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, grams = gram_sets(Words.of(part.column(1), lower=True), n)
                has, hashes = band_hashes(doc, grams, bands, rows)
                first = np.searchsorted(doc, has)
                sums = [np.add.reduceat(mix(grams + np.uint64(k)), first).astype(np.int64) if len(has) else np.zeros(0, np.int64) for k in (1, 2)]
                keys, signature = [], np.zeros((part.num_rows, bands), dtype=np.int64)
                present = np.zeros(part.num_rows, dtype=bool)
                present[has] = True
                for x in sums:
                    full = np.zeros(part.num_rows, dtype=np.int64)
                    full[has] = x
                    keys.append(pa.array(full, mask=~present))
                signature[has] = hashes.astype(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(signature.ravel(), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *keys, lists], names=["doc_id", "key1", "key2", "bands"])

    return texts_of(docs).where("doc_id is not null").mapInArrow(sketched, "doc_id long, key1 long, key2 long, bands array<long>")


def verify_cell(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, band: int, hashes: np.ndarray, sets: list[np.ndarray],
                threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members with partners, their number of partners, a member that stands for the group) of one cell. Pairs lie
    across its two sides, or, in a cell of one sub-bucket, anywhere."""
    m = len(ids)
    sizes = np.array([len(x) for x in sets])
    both = _shared(sets)
    pairs = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(pairs, False)
    if across:
        pairs &= side[:, None] != side[None, :]
    for k in range(band):
        pairs &= hashes[:, k][:, None] != hashes[:, k][None, :]
    links = pairs @ copies
    group = np.arange(m)
    while True:  # smallest index among neighbours until nothing changes
        near = np.minimum(group, np.where(pairs, group[None, :], m).min(axis=1))
        near = np.minimum(near, near[near])
        if (near == group).all():
            break
        group = near
    has = np.flatnonzero(links)
    return ids[has], links[has], ids[group[has]]


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Two sets are intersected; more are multiplied as 0/1 matrices, a block of n-grams at
    a time, without those that only one set has."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], dtype=np.float64)
    out = np.diag(np.array([len(x) for x in sets], dtype=np.float64))
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    use = count[column] > 1
    row, column = row[use], column[use]
    dense = np.cumsum(count > 1) - 1
    column = dense[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int((count > 1).sum())
    lone = np.zeros(m)
    for at in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((m, min(COLUMNS, total - at)), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        part = block @ block.T
        lone += np.diag(part)
        out += part
    out[np.arange(m), np.arange(m)] -= lone
    return out


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key1, key2, bands of every row; for each class of equal n-gram sets cls, rep (smallest id), n (rows),
    class_id (smallest id of the documents reached by links), first (the class that has it, of more the smallest), n_links).
    """
    bands, rows = choose_bands(threshold, recall)
    every = materialize(sketch(docs, n, bands, rows), "sketch")
    keyed = every.where("key1 is not null")
    classes = keyed.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    reps = keyed.join(classes.select("key1", "key2", F.col("rep").alias("doc_id"), "copies"), ["key1", "key2", "doc_id"], "left_semi")
    reps = reps.dropDuplicates(["key1", "key2"]).join(classes.select("key1", "key2", "copies"), ["key1", "key2"])
    # a class is known by its key from here on: one id may stand for two classes if its rows differ
    reps = materialize(reps.select(F.xxhash64("key1", "key2").alias("cls"), "copies", "bands"), "representatives")
    spread = reps.select("cls", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("d1"), F.sum(F.xxhash64("cls", F.lit(5)).cast("decimal(38,0)")).alias("d2"))
    buckets = buckets.where("m > 1").groupBy("m", "d1", "d2").agg(F.min(F.struct("band", "hash")).alias("b"))
    buckets = materialize(buckets.select("b.band", "b.hash", F.ceil(F.col("m") / CELL).cast("int").alias("parts"), F.col("m").alias("n")), "buckets")
    members = materialize(join_common(spread, buckets, ["band", "hash"]), "members")
    wanted = members.select("cls").distinct()
    sets = _sets(docs, wanted, classes, n)
    own = F.pmod(F.xxhash64("cls", F.lit(9)), F.col("parts")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("cls", "band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    cells = cells.join(sets.join(reps, "cls"), "cls")

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"cls": [], "links": [], "to": []}, dtype="int64")
        grams = [np.frombuffer(x, dtype=np.uint64) for x in pdf["grams"]]
        found = verify_cell(
            pdf["cls"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy(), int(pdf["band"].iat[0]), np.stack(pdf["bands"].to_numpy()), grams, threshold, bool(pdf["i"].iat[0] != pdf["j"].iat[0])
        )
        return pd.DataFrame(dict(zip(("cls", "links", "to"), found, strict=True)))

    found = materialize(cells.groupBy("band", "hash", "i", "j").applyInPandas(verified, "cls long, links long, to long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    names = classes.select(F.xxhash64("key1", "key2").alias("cls"), "rep", "copies", "n")
    groups = connected_components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    grouped = names.join(groups.withColumnRenamed("v", "cls"), "cls")
    least = grouped.groupBy("label").agg(F.min(F.struct("rep", "cls")).alias("least"))
    joined = grouped.join(least, "label").join(links, "cls").select("cls", "least", "links")
    per_class = names.join(joined, "cls", "left").select(
        "cls", "n", "rep", F.coalesce("least.rep", "rep").alias("class_id"), F.coalesce("least.cls", "cls").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return every, materialize(per_class, "per-class")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """doc_id, class_id (smallest id of the documents reached by links), n_links (other documents whose n-gram sets have
    a Jaccard similarity of at least threshold, equal ones included)."""
    every, per_class = jaccard_classes(docs, n, threshold, recall)
    keyed, per_class = every.where("key1 is not null"), per_class.select("cls", "n", "class_id", "n_links")
    rows_in = join_common(keyed.select("doc_id", F.xxhash64("key1", "key2").alias("cls")), per_class, "cls").select("doc_id", "class_id", "n_links")
    alone = every.where("key1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows_in.union(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """cls, grams (sorted hashes as bytes) of the wanted classes, from the text of one document of each."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, grams = gram_sets(Words.of(part.column(1), lower=True), n)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                first = np.minimum(cut[:-1], max(len(grams) - 1, 0))
                sums = [np.add.reduceat(np.append(mix(grams + np.uint64(k)), np.uint64(0)), first) if len(grams) else np.zeros(part.num_rows, np.uint64) for k in (1, 2)]
                raw = [grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in sums), pa.array(raw, pa.binary())], names=["key1", "key2", "grams"])

    ids = classes.withColumn("cls", F.xxhash64("key1", "key2")).join(wanted, "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = texts_of(docs).join(ids, "doc_id", "left_semi")
    found = texts.mapInArrow(gathered, "key1 long, key2 long, grams binary").select(F.xxhash64("key1", "key2").alias("cls"), "grams")
    return found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _with_class(docs: DataFrame, name: str, n: int) -> DataFrame:
    """docs with the class of each row's text, null without words."""
    plain = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    text, columns = docs.columns.index("text"), len(docs.columns)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, grams = gram_sets(Words.of(part.column(text), lower=True), n)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
                present = np.zeros(part.num_rows, dtype=bool)
                present[doc[first]] = True
                keys = []
                for k in (1, 2):
                    full = np.zeros(part.num_rows, dtype=np.int64)
                    full[doc[first]] = np.add.reduceat(mix(grams + np.uint64(k)), first).astype(np.int64) if len(first) else 0
                    keys.append(pa.array(full, mask=~present))
                yield pa.RecordBatch.from_arrays([*part.columns, *keys], names=[f"c{i}" for i in range(columns + 2)])

    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(plain.schema)] + [StructField(f"c{columns + k}", LongType()) for k in (0, 1)]
    made = plain.mapInArrow(classed, StructType(fields))
    keys = [F.col(f"c{columns + k}") for k in (0, 1)]
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.when(keys[0].isNotNull(), F.xxhash64(*keys)).alias(name))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row of each group of near duplicates. It is decided by id and set of n-grams: of a group stays the class with
    the smallest id, and of its rows with that id one, the first by text and then by a hash of all columns. A null id
    counts as larger than any other. Other texts of an id whose row goes stay or go with their own group; texts without
    words have none, and all stay. Texts are shuffled once, and rows without words are spread at will."""
    largest = F.lit((1 << 63) - 1)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), largest).alias("doc_id"), "text")
    _, classes = jaccard_classes(ids, n, threshold, recall)
    cls, own, row, stays = (unused(x, docs.columns) for x in ("cls", "own", "row", "stays"))
    kept = classes.where("cls = first").select(F.col("cls").alias(cls), F.col("rep").alias(own), F.lit(True).alias(stays))
    rows = _with_class(docs, cls, n).withColumn(own, F.when(F.col(cls).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.coalesce(F.col("doc_id").cast("long"), largest)))
    met = rows.join(kept, [cls, own], "left").where(F.col(stays) | F.col(cls).isNull())
    order = Window.partitionBy(cls, own).orderBy("text", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return met.withColumn(row, F.row_number().over(order)).where((F.col(row) == 1) | F.col(cls).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))

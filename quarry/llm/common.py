"""Helpers that the corpus operators share: tables, shared storage, and word arrays over Arrow text.

Word arrays are numpy views of one Arrow string array: each word is the byte range of a maximal run of characters
other than space and tab..carriage return, with a 64-bit hash that is the same in every process. A chunk never holds
more than ``CHUNK_BYTES`` of text unless a single text is longer, so a task's memory is bounded by its longest text.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
HOT_ROWS = HOT_SHARE = 10_000
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on this machine
    alone, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_common(rows: DataFrame, facts: DataFrame, keys: str | list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined to facts, which has one row for each key and in ``n`` how many of the rows have it (``total``
    together, summed up if not given). Keys that more than HOT_ROWS rows have, and more than one in HOT_SHARE, number
    HOT_SHARE at most; these facts are broadcast, so no task gets all the rows of a common key. rows is read twice."""
    keys = [keys] if isinstance(keys, str) else keys
    if total is None:
        total = facts.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_ROWS, total // HOT_SHARE)
    rest = facts.where(~hot).drop(n)
    if total <= HOT_ROWS:  # no key can be hot
        return rows.join(rest, keys)
    few = F.broadcast(facts.where(hot).drop(n))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(rest, keys))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit bijection that spreads its input over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK))


_BYTE_VALUE = stream(1, 256)
_PRIME = (1 << 31) - 1
_BASES = (0x3C6EF372, 0x5BE0CD19)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_IS_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_STOPS = np.isin(np.arange(256), [ord(x) for x in ".!?\n"])
_CLAUSES = _STOPS | np.isin(np.arange(256), [ord(x) for x in ",;:"])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 2 * CHUNK_BYTES):
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), _PRIME)) % np.uint64(_PRIME)))
        have = have.astype(np.uint32)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def _modulo(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomials of values (below 2**31, overwritten) in the base, over ranges, modulo the prime. Sums of halved products stay below
    2**64 for up to 2**31 values."""
    prime = np.uint64(_PRIME)
    values *= powers(base, len(values))
    upper = values >> np.uint64(31)
    values &= prime
    values += upper
    del upper
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:], dtype=np.uint64)
    inverse = powers(pow(base, -1, _PRIME), len(values) + 1)
    return (sums[end] - sums[start]) % prime * inverse[start] % prime


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many ranges at once, equal for equal content wherever it stands: two
    bases modulo a prime, each over its own half of the values' bits."""
    parts = []
    for k, base in enumerate(_BASES):
        half = values >> np.uint64(31 * k)
        half &= np.uint64(_PRIME)
        parts.append(_modulo(half, start, end, base))
    first, second = parts
    return mix((first << np.uint64(31) | second) + (end - start).astype(np.uint64) * np.uint64(_STEP))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(_BYTE_VALUE[data], start, end)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, with the number of bytes at the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    text = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[text[0] : text[-1]], text - text[0]


def is_word(data: np.ndarray) -> np.ndarray:
    """Which bytes are of words: all but space and tab to carriage return."""
    return _IS_WORD[data]


def runs(inside: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each maximal run of marked bytes within a text."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = text[1:-1][(text[1:-1] > 0) & (text[1:-1] < len(inside))]
    opens[cut] |= inside[cut]
    closes[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


@dataclass
class Words:
    """All words of some texts. Text d has words first[d]:first[d+1]; word w has bytes start[w]:end[w]."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
        """Words of lower-cased texts, or runs of letters and digits only, if so asked."""
        data, text = flat_bytes(pc.utf8_lower(texts.cast(pa.large_string())) if lower else texts)
        start, end = runs((_IS_LETTER if letters else _IS_WORD)[data], text)
        return cls(data, text, start, end, np.searchsorted(start, text), byte_hashes(data, start, end))

    def __len__(self) -> int:
        return len(self.text) - 1

    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word, or of all if fewer."""
        return range_hash(_BYTE_VALUE[self.data], self.start, np.minimum(self.start + n, self.end))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of n words; a shorter text that has words counts as one run."""
        count = np.diff(self.first)
        size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(self)), size)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + self.first[:-1][doc]
        return doc, range_hash(self.hashes, at, np.minimum(at + n, self.first[1:][doc]))

    def sentences(self, clauses: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each sentence, with the number of words at the end; first sentence of each text, likewise).
        A sentence ends with a word that a full stop, exclamation or question mark closes, or before a line end; a clause also with one that a comma, semicolon or
        colon closes."""
        stops = np.concatenate(([0], np.cumsum((_CLAUSES if clauses else _STOPS)[self.data])))
        begins = np.zeros(len(self.start), dtype=bool)
        begins[1:] = stops[self.start[1:]] > stops[self.end[:-1] - 1]
        begins[self.first[:-1][np.diff(self.first) > 0]] = True
        at = np.append(np.flatnonzero(begins), len(self.start))
        return at, np.searchsorted(at[:-1], self.first)


def sums_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, of the ids that hash lowest: a bounded sample that does not depend on the order or number
    of files. Of ids that many rows repeat those rows are taken that hash lowest."""
    ids = rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)
    return rows.join(F.broadcast(ids), id_col).orderBy(F.xxhash64(*rows.columns)).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` documents that have a label (doc_id, y), those whose ids hash lowest. They
    are chosen by ids alone and sent to where the texts are read, so no text is shuffled but the sample's own. Of labels
    that differ the larger is taken, of rows that repeat an id the smallest text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(labels, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "y")


def fit_in_one_task(features: DataFrame, counted: str, most: int, fit: Callable[[pa.Table], object | None]) -> object | None:
    """What fit makes of the rows of features (doc_id and more), in one task, so that the driver gets the model alone.
    Rows come in the order of their ids' hashes; one with which the lists in the column ``counted`` would hold more than
    ``most`` values together is left out, so the task's memory is bounded however long the texts are."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            taken = []
            for i, size in enumerate(np.asarray(pc.fill_null(pc.list_value_length(batch.column(counted)), 0)).tolist()):
                if held + size <= most:
                    held += size
                    taken.append(i)
            parts.append(batch if len(taken) == batch.num_rows else batch.take(pa.array(taken, pa.int64())))
        model = fit(pa.Table.from_batches(parts).combine_chunks().sort_by("doc_id")) if parts else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = features.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = rows.mapInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Minimise by full-batch Adam from zero; gradient(weights) gives the gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a z + b), by Newton steps with targets kept off 0 and 1."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target)), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about limit bytes of text, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    total, at = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            total, at = 0, i
        total += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """name with as many underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name

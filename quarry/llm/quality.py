"""Quality rules (operator 4): hashed word and character n-gram logistic regression.

The model is fitted on at most ``max_rows`` labelled documents (a bounded sample, the lowest by a hash of their ids, up
to ``max_features`` features), calibrated by Platt scaling on a fifth of them, in one task, so that the driver gets the
weights alone, and applied to every document in Arrow batches against a fixed threshold, after fixed base rules. A
document's features are the shares of its word 1- and 2-grams and character 4-grams in hashed buckets, so its length
alone does not move the score.

Defined cases: null text has no words and fails the base rules; documents without labels are scored, not trained on;
null ids are scored; of labels that differ the better counts; without labels of both classes the base rules decide
alone; an empty table gives no rows; other columns are not read, and stay as they are where documents are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Words, adam, fit_in_one_task, labelled_sample, mix, platt, sigmoid, slices, sums_by, table, texts_of

WORD_BITS, CHAR_BITS = 16, 14
WIDTH = (2 << WORD_BITS) + (1 << CHAR_BITS)
SCALE = 30.0
BLOCK = 1 << 20
KEEP_FROM = 0.3
_SYMBOL = np.isin(np.arange(256), [ord(x) for x in "#*$%&|<>"])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gram_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each feature occurrence, one pair of arrays for each family."""
    yield words.doc(), (mix(words.hashes + np.uint64(1)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    doc, grams = words.grams(2)
    yield doc, (mix(grams + np.uint64(2)) >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << WORD_BITS)
    points = np.frombuffer(words.data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    if len(points) > 3:
        code = points[:-3] * np.uint32(0x9E3779B1) ^ points[1:-2] * np.uint32(0x85EBCA77) ^ points[2:-1] * np.uint32(0xC2B2AE3D) ^ points[3:]
        bucket = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + (2 << WORD_BITS)
        before = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))[words.text]
        doc = np.repeat(np.arange(len(words)), np.diff(before))
        whole = doc[3:] == doc[:-3]
        yield doc[3:][whole], bucket[whole]


def raw_scores(words: Words, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words))
    for doc, bucket in gram_features(words):
        count = np.maximum(sums_by(doc, len(words)), 1)
        total += SCALE * sums_by(doc, len(words), weights[bucket]) / count
    return total


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, words: Words) -> np.ndarray:
        """Calibrated probability of good quality."""
        return sigmoid(self.a * (raw_scores(words, self.weights) + self.bias) + self.b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_features: int = 12_000_000, steps: int = 120, ridge: float = 1e-4) -> Model | None:
    """Fit on labelled documents; None where the labels lack a class."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and quality in (0, 1)")
    rows = labelled_sample(docs, labels, max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, at, share = Words.of(part.column(1)), [], []
                for doc, bucket in gram_features(words):
                    key, n = np.unique(doc * WIDTH + bucket, return_counts=True)
                    of = key // WIDTH
                    at.append(key)
                    share.append(SCALE * n / np.maximum(sums_by(doc, len(words)), 1)[of])
                key, value = np.concatenate(at), np.concatenate(share).astype(np.float32)
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                cut = np.searchsorted(key, np.arange(len(words) + 1) * WIDTH).astype(np.int32)
                buckets = pa.ListArray.from_arrays(cut, (key % WIDTH).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), buckets, pa.ListArray.from_arrays(cut, value)], names=["doc_id", "y", "at", "x"])

    sample = rows.mapInArrow(features, "doc_id long, y int, at array<int>, x array<float>")
    return fit_in_one_task(sample, "at", max_features, lambda got: _fit(got, steps, ridge))


def _fit(got: pa.Table, steps: int, ridge: float) -> Model | None:
    """The model of one bounded sample; the features are gone through in blocks, so that little is held beside them."""
    y = np.asarray(got["y"], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return None
    lists = got["at"].combine_chunks()
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(lists.value_lengths()))
    column, value = np.asarray(lists.flatten()), np.asarray(got["x"].combine_chunks().flatten())
    held = np.asarray(mix(np.asarray(got["doc_id"]).astype(np.uint64))) % np.uint64(5) == 0
    fit = ~held if y[~held].min() < y[~held].max() else np.ones(len(y), bool)
    blocks = [slice(k, k + BLOCK) for k in range(0, len(row), BLOCK)]

    def margin(w: np.ndarray) -> np.ndarray:
        return sum((sums_by(row[k], len(y), value[k] * w[column[k]]) for k in blocks), np.zeros(len(y))) + w[-1]

    def gradient(w: np.ndarray) -> np.ndarray:
        error = np.where(fit, sigmoid(margin(w)) - y, 0) / fit.sum()
        slope = sum((sums_by(column[k], WIDTH, value[k] * error[row[k]]) for k in blocks), np.zeros(WIDTH))
        return np.append(slope, error.sum()) + ridge * np.append(w[:-1], 0)

    w = adam(gradient, WIDTH + 1, steps)
    a, b = platt(margin(w)[held], y[held]) if held.any() else (1.0, 0.0)
    return Model(w[:-1].astype(np.float32), float(w[-1]), a, b)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n, data = len(words), words.data
    n_words = np.diff(words.first)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[words.text[1:]] - total[words.text[:-1]]

    points = per_text((data & 0xC0) != 0x80)
    doc, grams = words.grams(8)
    many = (n_words >= 8)[doc]
    doc, grams, at = doc[many], grams[many], np.flatnonzero(many)
    order = np.lexsort((grams, doc))
    same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    opened = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    # the first word of each run: runs stand in text order, one for each word but the last seven of a text
    runs = np.where(n_words >= 8, n_words - 7, (n_words > 0).astype(np.int64))
    all_doc = np.repeat(np.arange(n), runs)
    first = np.arange(len(all_doc)) - np.repeat(np.cumsum(runs) - runs, runs) + words.first[:-1][all_doc]
    start = first[at][twice]
    np.add.at(opened, start, 1)
    np.add.at(opened, start + 8, -1)
    covered = np.cumsum(opened)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(covered)))
    return {
        "n_words": n_words, "word_chars": points - per_text(_SPACE[data]), "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": _duplicate_lines(words), "n_repeat_words": total[words.first[1:]] - total[words.first[:-1]],
    }


def _duplicate_lines(words: Words) -> np.ndarray:
    raw, out = words.data.tobytes(), np.zeros(len(words), dtype=np.int64)
    for d, (a, b) in enumerate(zip(words.text[:-1].tolist(), words.text[1:].tolist(), strict=True)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            lines = [x for x in lines if x.split(None, 1)]
            out[d] = len(lines) - len(set(lines))
    return out


def judge(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and quality (calibrated probability; null without a model)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(1))
                counts = base_counts(words)
                failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
                p = model.probability(words) if model else np.ones(len(words))
                columns = [part.column(0), *(pa.array(counts[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (p >= keep_from))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p if model else [None] * len(p), pa.float64())], names=["doc_id", *names, "base_failed", "kept", "quality"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, quality double"
    return texts_of(docs).mapInArrow(judged, schema)


def filter_documents(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(at))
                counts = base_counts(words)
                good = (counts["n_words"] >= 20) & (100 * counts["n_repeat_words"] <= 30 * counts["n_words"])
                if model:
                    good &= model.probability(words) >= keep_from
                yield part.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))

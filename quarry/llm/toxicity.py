"""Toxicity by multiple-instance learning (operator 7).

A document is a bag of sentences. A sentence's toxicity is a logistic function of its hashed words; a document is toxic
unless all its sentences are harmless (noisy-or), and only document labels are used to fit the sentence scores. The fit
takes at most ``max_rows`` labelled documents, a bounded sample of up to ``max_words`` words, in one task, so that the
driver gets the weights alone; every document is scored. A last Platt step on a fifth of the sample calibrates the
document score. Sentences with a score of ``OFFENDING`` or more are located.

Defined cases: null and empty texts have no sentences and get the score of a bag without offence; words of fewer than
two training documents have no say; null ids are scored and not held out; of labels that differ the worse counts;
without labels of both classes every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Words, adam, fit_in_one_task, labelled_sample, mix, platt, sigmoid, slices, sums_by, table, texts_of

BITS = 17
SPARE = 1 << BITS  # the place of features that too few documents have
PREFIXES = (4, 5, 6)
OFFENDING = 0.5
THRESHOLD = 0.7
_PRIOR = -7.0


def buckets(words: Words) -> list[np.ndarray]:
    """Hashed features of each word: itself, and its first bytes, by which inflected and compound words are known."""
    keys = [words.hashes, *(words.prefix(n) for n in PREFIXES)]
    return [(mix(key + np.uint64(7 + k)) >> np.uint64(64 - BITS)).astype(np.int32) for k, key in enumerate(keys)]


def _log_odds(total: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(-total)."""
    return np.log(np.expm1(np.clip(total, 1e-9, 500)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def sentences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log odds of each sentence, first words, first sentence of each text)."""
        at, of = words.sentences()
        if len(at) == 1:
            return np.zeros(0), at, of
        each = sum(self.weights[x].astype(float) for x in buckets(words))
        return np.add.reduceat(each, at[:-1]) + self.bias, at, of

    def documents(self, odds: np.ndarray, of: np.ndarray) -> np.ndarray:
        harm = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, odds))))
        return sigmoid(self.a * _log_odds(harm[of[1:]] - harm[of[:-1]]) + self.b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_words: int = 6_000_000, steps: int = 150, ridge: float = 3e-4) -> Model | None:
    """Fit on labelled documents outside the held-out third."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and toxic in (0, 1)")
    rows = labelled_sample(docs, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"), max_rows)
    families = [f"f{k}" for k in range(1 + len(PREFIXES))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(1), lower=True, letters=True)
                at, of = words.sentences()
                sentence = np.repeat(np.arange(len(at) - 1), np.diff(at)) - np.repeat(of[:-1], np.diff(words.first))
                cut = words.first.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.ListArray.from_arrays(cut, sentence.astype(np.int32)), *(pa.ListArray.from_arrays(cut, x) for x in buckets(words))],
                    names=["doc_id", "y", "sentence", *families],
                )

    sample = rows.mapInArrow(features, "doc_id long, y int, sentence array<int>, " + ", ".join(f"{f} array<int>" for f in families))
    return fit_in_one_task(sample, "sentence", max_words, lambda got: _fit(got, families, steps, ridge))


def _fit(got: pa.Table, families: list[str], steps: int, ridge: float) -> Model | None:
    y = np.asarray(got["y"], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return None
    lists = got["sentence"].combine_chunks()
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(lists.value_lengths()))
    inner, columns = np.asarray(lists.flatten()), [np.asarray(got[f].combine_chunks().flatten()) for f in families]
    bag = np.cumsum(np.concatenate(([False], (np.diff(doc) != 0) | (np.diff(inner) != 0)))[: len(doc)])
    bag_doc = doc[np.concatenate(([True], np.diff(bag) != 0))[: len(doc)]]
    held = mix(np.asarray(got["doc_id"]).astype(np.uint64)) % np.uint64(5) == 0
    del got, lists, inner
    known = sum(sums_by(np.unique(doc.astype(np.int64) << BITS | c) & SPARE - 1, 1 << BITS) for c in columns) >= 2
    columns = [np.where(known[c], c, np.int32(SPARE)) for c in columns]
    bag, bag_doc = bag.astype(np.int32), bag_doc.astype(np.int32)
    fit = ~held if y[~held].min() < y[~held].max() else np.ones(len(y), bool)

    def harm(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sum(sums_by(bag, len(bag_doc), w[c]) for c in columns) + w[-1] + _PRIOR
        return z, sums_by(bag_doc, len(y), np.logaddexp(0, z))

    def gradient(w: np.ndarray) -> np.ndarray:
        z, total = harm(w)
        slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0) * fit / fit.sum()
        push = slope[bag_doc] * sigmoid(z)
        each = push[bag]
        g = np.append(sum(sums_by(c, SPARE + 1, each) for c in columns), push.sum()) + ridge * np.append(np.sign(w[:-1]), 0)
        g[SPARE] = 0
        return g

    w = adam(gradient, SPARE + 2, steps)
    a, b = platt(_log_odds(harm(w)[1][held]), y[held]) if held.any() else (1.0, 0.0)
    return Model(w[:SPARE].astype(np.float32), float(w[-1]) + _PRIOR, a, b)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences, offending (start and end of offending sentences, in bytes of the lower-cased
    text), worst (score of the worst sentence)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(1), lower=True, letters=True)
                at, of = words.sentences()
                if model:
                    odds, at, of = model.sentences(words)
                    sentence, document = sigmoid(odds), model.documents(odds, of)
                else:
                    sentence, document = np.zeros(len(at) - 1), np.zeros(len(words))
                bad = np.flatnonzero(sentence >= OFFENDING)
                cut = np.searchsorted(bad, of).astype(np.int32)
                origin = np.repeat(words.text[:-1], np.diff(cut))
                worst = [float(sentence[i:j].max()) if j > i else 0.0 for i, j in zip(of[:-1], of[1:], strict=True)]
                columns = {
                    "doc_id": part.column(0), "score": pa.array(document), "predicted": pa.array((document >= threshold).astype(np.int32)),
                    "n_sentences": pa.array(np.diff(of).astype(np.int64)), "worst": pa.array(worst, pa.float64()),
                    "starts": pa.ListArray.from_arrays(cut, (words.start[at[bad]] - origin).astype(np.int64)),
                    "ends": pa.ListArray.from_arrays(cut, (words.end[at[bad + 1] - 1] - origin).astype(np.int64)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = texts_of(docs).mapInArrow(scored, "doc_id long, score double, predicted int, n_sentences long, worst double, starts array<long>, ends array<long>")
    return rows.withColumn("offending", F.arrays_zip("starts", "ends")).drop("starts", "ends")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"), "worst")

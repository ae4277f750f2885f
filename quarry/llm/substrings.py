"""Substring dedup by sliding sentence spans (operator 5).

From every sentence of a text two runs are hashed: the shortest of at least ``span`` consecutive sentences and
``min_words`` words that begins there, and the shortest that ends there. A sentence alone is a run as well if it has
``min_words`` words. Clauses that a comma, semicolon or colon closes count as sentences, so that a passage that begins
or ends inside a long sentence is found. A clause of ``min_words`` words or more, which can hold a passage of its own, is
cut further, before words that a hash of the word chooses (one in four) and before a word said twice in a row: places
that depend on the words alone, so a passage that no mark closes is cut alike wherever it stands. Runs meet over all
documents, in one shuffle: the first occurrence is the one in the document with the smallest key, there the earliest one.
Sentences that any other occurrence covers are removed. A text has one row for each different run, so text said over and
over is no hot group. Runs that are common in a sample of the documents are dealt over ``SALTS`` groups each, and their
first documents are broadcast; the sample decides who gathers where, not what is removed.

A document is a doc_id with a text; its key is the id, a null id first, then a hash of the text. Defined cases: rows that
repeat an id with other texts are documents of their own, and so are rows with null ids and different texts; rows that
repeat both are one document and get equal results; null and empty texts have no sentences and stay; an empty table
gives no rows; other columns stay as they are, whatever their names. Words are compared as they stand, white space
between them is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Words, materialize, mix, range_hash, slices, table, unused

SPAN, MIN_WORDS = 2, 20
#: One document in SAMPLE shows which runs are common: those with more than COMMON rows there and more than one row in
#: SHARE, which are SHARE at most.
SAMPLE, COMMON, SHARE, SALTS = 64, 16, 10_000, 64
_NO_ID = -(2**63)
_RUN = "struct<sentence:int,size:int>"


def document_keys(doc_id: np.ndarray, text_hash: np.ndarray) -> pa.Array:
    """doc_id * 2**63 + text_hash, which lies below 2**63, as decimals of 38 digits."""
    low = (text_hash | doc_id << 63).astype("<i8")
    raw = np.stack([low, (doc_id >> 1).astype("<i8")], axis=1)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(low), [None, pa.py_buffer(raw.tobytes())])


def _identified(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """docs with two more columns: the id, and the hash of the text below 2**63."""
    return docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), names[1]: F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 1)})


def pieces(words: Words, cut_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence as this operator counts them, with the number of words at the end; first sentence of
    each text, likewise; first word of each clause, likewise)."""
    clause, _ = words.sentences(clauses=True)
    size = np.diff(clause)
    begins = np.repeat(size >= cut_words, size)
    same = np.zeros(len(begins), dtype=bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    begins &= same | (words.hashes & np.uint64(3) == 0)
    begins[clause[:-1]] = True
    at = np.append(np.flatnonzero(begins), len(begins))
    return at, np.searchsorted(at[:-1], words.first), clause


def sentence_runs(words: Words, span: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, first sentence in the text, sentences, hash) of every run that counts, each once."""
    at, of, clause = pieces(words, min_words)
    n = len(at)
    doc = np.repeat(np.arange(len(words)), np.diff(of))
    place = np.arange(len(doc))
    stop = np.maximum(place + span, np.searchsorted(at, at[:-1] + min_words))
    begin = np.minimum(place + 1 - span, np.searchsorted(at, at[1:] - min_words, "right") - 1)
    ahead, back, long = np.flatnonzero(stop <= of[1:][doc]), np.flatnonzero(begin >= of[:-1][doc]), np.flatnonzero(np.diff(clause) >= min_words)
    first = np.concatenate((ahead, begin[back], np.searchsorted(at, clause[long])))
    stop = np.concatenate((stop[ahead], back + 1, np.searchsorted(at, clause[long + 1])))
    first, stop = np.divmod(np.unique(first * n + stop), max(n, 1))
    doc = doc[first]
    return doc, first - of[doc], stop - first, mix(range_hash(words.hashes, at[first], at[stop]) + np.uint64(1))


def spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (the document's key), hash, sentence and size of the first run of the text that has this hash, and further
    such runs (null without any)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, sentence, size, key = sentence_runs(Words.of(part.column(2)), span, min_words)
                order = np.lexsort((sentence, key, doc))
                doc, sentence, size, key = doc[order], sentence[order].astype(np.int32), size[order].astype(np.int32), key[order].astype(np.int64)
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                first = np.flatnonzero(new)
                cut = np.append(first, len(doc)) - np.arange(len(first) + 1)
                run = pa.StructArray.from_arrays([pa.array(sentence[~new]), pa.array(size[~new])], names=["sentence", "size"])
                more = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32), mask=np.append(np.diff(cut) == 0, False)), run)
                own = doc[first]
                keys = document_keys(np.asarray(part.column(0))[own], np.asarray(part.column(1))[own])
                yield pa.RecordBatch.from_arrays([keys, pa.array(key[first]), pa.array(sentence[first]), pa.array(size[first]), more], names=["doc", "hash", "sentence", "size", "more"])

    rows = _identified(docs.select("doc_id", F.col("text").cast("string").alias("text")), ("id", "text_hash"))
    return rows.select("id", "text_hash", "text").mapInArrow(found, f"doc decimal(38,0), hash long, sentence int, size int, more array<{_RUN}>")


def covered(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, runs (first sentence and size of each run to remove), firsts (keys of documents that keep them)."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    counts = materialize(spans(few, span, min_words).groupBy("hash").agg(F.count("*").alias("n")), "sampled-runs")
    most = max(COMMON, (counts.agg(F.sum("n")).first()[0] or 0) // SHARE)
    common = F.broadcast(counts.where(F.col("n") > most).select("hash", F.lit(True).alias("common")))
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(-1)
    dealt = spans(docs, span, min_words).join(common, "hash", "left").withColumn("salt", salt).drop("common")
    met = Window.partitionBy("hash", "salt")
    found = dealt.select("*", F.min("doc").over(met).alias("first"), F.count("*").over(met).alias("n"))
    found = materialize(found.where("n > 1 or salt >= 0 or more is not null").drop("n"), "shared-runs")
    salted = found.where("salt >= 0")
    firsts = F.broadcast(salted.groupBy("hash").agg(F.min("first").alias("first")))
    joined = found.where("salt < 0").unionByName(salted.drop("first").join(firsts, "hash"))
    own = F.array(F.struct("sentence", "size"))
    runs = F.when(F.col("doc") == F.col("first"), F.col("more")).when(F.col("more").isNull(), own).otherwise(F.concat(own, "more"))
    gone = joined.select("doc", "first", runs.alias("runs")).where("runs is not null")
    return gone.groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.collect_set("first").alias("firsts"))


def _removed(words: Words, runs: list[list[dict] | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each sentence goes, first words, first sentences)."""
    at, of, _ = pieces(words, min_words)
    change = np.zeros(len(at), dtype=np.int64)
    for d, own in enumerate(runs):
        for run in own or ():
            if of[d] + run["sentence"] + run["size"] <= of[d + 1]:
                change[of[d] + run["sentence"]] += 1
                change[of[d] + run["sentence"] + run["size"]] -= 1
    return np.cumsum(change)[:-1] > 0, at, of


def _cut(words: Words, gone: np.ndarray, at: np.ndarray, of: np.ndarray, texts: list[str | None]) -> list[str | None]:
    """The texts without the sentences that go; each takes the white space after it along."""
    out = list(texts)
    for d in np.unique(np.repeat(np.arange(len(words)), np.diff(of))[gone]).tolist():
        stop, kept, lo = int(words.text[d + 1]), [], int(words.text[d])
        for s in range(of[d], of[d + 1]):
            hi = int(words.start[at[s + 1]]) if s + 1 < of[d + 1] else stop
            if not gone[s]:
                kept.append(words.data[lo:hi].tobytes())
            lo = hi
        out[d] = b"".join(kept).decode()
    return out


def without_repeats(docs: DataFrame, removal: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its texts cut. removal is what covered() gives for the same min_words."""
    return _marked(docs, removal, min_words, "left").select(*(F.col(f"`{c}`") for c in docs.columns))


def changed(docs: DataFrame, removal: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that lose sentences, one row for each row: doc_id, first_doc_ids (documents that keep them, null for a
    null id), n_sentences, n_removed, words_removed, and the text that stays."""
    rows = _marked(docs.select("doc_id", "text"), removal, min_words, "inner").where("n_removed > 0")
    return rows.select("doc_id", "first_doc_ids", "n_sentences", "n_removed", "words_removed", "text")


def _marked(docs: DataFrame, removal: DataFrame, min_words: int, how: str) -> DataFrame:
    """docs with its text cut, and the further columns of changed(); of these, names that docs has get underscores."""
    fields, at = docs.columns, docs.columns.index("text")
    doc_id, text_hash, key, runs, firsts, *extra = (unused(x, docs.columns) for x in ("id", "hash", "key", "runs", "firsts", "first_doc_ids", "n_sentences", "n_removed", "words_removed"))
    wide = F.col(doc_id).cast("decimal(19,0)") * F.lit(Decimal(2**63)) + F.col(text_hash).cast("decimal(19,0)")
    keyed = _identified(docs, (doc_id, text_hash)).withColumn(key, wide.cast("decimal(38,0)"))
    own = removal.select(F.col("doc").alias(key), F.col("runs").alias(runs), F.col("firsts").alias(firsts))
    marked = keyed.join(own, key, how).select(*(F.col(f"`{c}`") for c in fields), runs, firsts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, fields[at]):
                words = Words.of(part.column(at))
                gone, first, of = _removed(words, part.column(len(fields)).to_pylist(), min_words)
                kept = [sorted(int(x) >> 63 for x in xs or ()) for xs in part.column(len(fields) + 1).to_pylist()]
                texts = pa.array(_cut(words, gone, first, of, part.column(at).to_pylist()), pa.string())
                doc = np.repeat(np.arange(len(words)), np.diff(of))
                counts = [np.diff(of), np.bincount(doc, gone, len(words)), np.bincount(doc, gone * np.diff(first), len(words))]
                ids = pa.array([[None if x == _NO_ID else x for x in dict.fromkeys(xs)] for xs in kept], pa.list_(pa.int64()))
                columns = [texts if k == at else part.column(k) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*columns, ids, *(pa.array(x.astype(np.int64)) for x in counts)], names=[*fields, *extra])

    marked_text = docs.withColumn("text", F.col("text").cast("string")).schema
    more = "".join(f", `{name}` {kind}" for name, kind in zip(extra, ("array<long>", "long", "long", "long"), strict=True))
    return marked.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked_text) + more)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose sentences: doc_id, first_doc_ids (documents that keep them), counts, and the text that stays."""
    docs = table(spark, sf_dir, "documents")
    return changed(docs, materialize(covered(docs), "covered"))

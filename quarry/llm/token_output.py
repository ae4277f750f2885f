"""Token-id output with Re-Pair grammar compression (operator 3).

Documents are put in ascending id order by range partitions and encoded there. Each partition cuts its ids into shards
of about ``shard_tokens`` (whole documents); a shard is one row of a Parquet dataset in the file format below. In a
shard, rounds replace frequent adjacent pairs of symbols by nonterminals, the most frequent first: a round takes all
pairs that reach its threshold, which falls to a quarter each time down to ``least``, and rounds go on there until no
pair reaches it, so no frequent pair is left. A rule takes the room of three symbols (two sides and a length), so with
``least`` = 4 each rule pays for itself; rarer pairs would make no file smaller. No pair spans two documents, so each
document has its own symbols, and the expansion lengths of the nonterminals tell where any token lies without decoding what
stands before it.

File format, one row per shard: ``part`` int and ``seq`` int (order of shards), ``n_tokens`` long, ``base`` int (ids
below it are terminals), ``doc_ids`` and ``doc_symbols`` (little-endian int64: ids, and end of each document in
symbols; ``null_ids`` marks ids that are null), and, packed, ``rules`` (left and right sides in turn; rule r defines
symbol base + r from smaller symbols), ``lengths`` (expansion length of each rule) and ``symbols``. Packed integers are
their number and the number of planes (int64 each), the low 16 bits of each, and for every further bit, from the lowest,
a plane: that bit of all of them, eight a byte.

Defined cases: null text encodes as empty; a null doc_id comes first in the order; rows that repeat an id are kept, in
the order of their texts' hashes; an empty table gives no files' rows and no result rows; columns other than the two
named are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, slices, table, texts_of
from quarry.llm.encoding import Encoder

SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, base int, doc_ids binary, null_ids binary, doc_symbols binary,"
    " rules binary, lengths binary, symbols binary"
)
LEAST = 4
FALL = 4
_HASH_BITS = 20


def _pairs(seq: np.ndarray, last: np.ndarray, newest: int) -> np.ndarray:
    """Places of pairs with a symbol of newest or above, none across the end of a document."""
    recent = seq >= newest
    return np.flatnonzero((recent[:-1] | recent[1:]) & ~last[:-1])


def _frequent(seq: np.ndarray, last: np.ndarray, least: int | None) -> tuple[int, np.ndarray]:
    """(threshold, places of pairs that may reach it), by counts of pairs' hashes; a first threshold lies a fall below
    the largest count."""
    hashed = (seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASH_BITS)
    count = np.bincount(hashed, minlength=1 << _HASH_BITS)
    least = least or max(LEAST, int(count.max()) // FALL)
    return least, np.flatnonzero((count >= least)[hashed] & ~last[:-1])


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends in symbols, rules), replacing until no pair occurs ``least`` times. Where two chosen pairs overlap
    the left one is replaced, so none of a round's pairs is left after it: when the threshold stays, only pairs with a
    new symbol can reach it."""
    seq, sizes = ids.astype(np.uint32), np.diff(ends, prepend=0)
    last = np.zeros(len(seq), dtype=bool)
    last[ends[ends > 0] - 1] = True
    rules, top, newest, threshold = [], base, 0, None
    while len(seq) > 1:
        if threshold == least and newest:
            at = _pairs(seq, last, newest)
        else:
            threshold, at = _frequent(seq, last, threshold and max(least, threshold // FALL))
            newest = 0
        key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(at) else at
        chosen = ordered[edge][np.diff(np.append(edge, len(at))) >= threshold]
        if not len(chosen):
            if threshold == least:
                break
            continue
        place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = chosen[place] == key
        at, place = at[hit], place[hit]
        run = np.concatenate(([True], np.diff(at) != 1))
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - begin) % 2 == 0
        at, place = at[even], place[even]
        seq[at] = top + place
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([(chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)], axis=1))
        newest, top = top, top + len(chosen)
    stops = np.zeros(len(ends), dtype=np.int64)
    stops[sizes > 0] = np.flatnonzero(last) + 1
    return seq, np.maximum.accumulate(stops) if len(stops) else stops, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; both sides of a rule are older symbols."""
    lengths = np.zeros(len(rules), dtype=np.uint32)
    known, todo = np.zeros(len(rules), bool), np.arange(len(rules))
    while len(todo):
        sides = rules[todo].astype(np.int64) - base
        ready = ((sides < 0) | known[np.maximum(sides, 0)]).all(axis=1) if len(rules) else np.zeros(0, bool)
        now = todo[ready]
        lengths[now] = np.where(sides[ready] < 0, 1, lengths[np.maximum(sides[ready], 0)]).sum(axis=1)
        known[now] = True
        todo = todo[~ready]
    return lengths


def sizes_of(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    out = np.ones(len(symbols), dtype=np.int64)
    deep = symbols >= base
    out[deep] = lengths[symbols[deep] - base]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids that the symbols stand for: lengths say where each side of a rule goes, level by level."""
    size = sizes_of(symbols, lengths, base)
    stop = np.cumsum(size)
    out, at = np.empty(stop[-1] if len(stop) else 0, dtype=np.uint32), stop - size
    while len(symbols):
        deep = symbols >= base
        out[at[~deep]] = symbols[~deep]
        left, right = rules[symbols[deep] - base].T
        at = np.concatenate((at[deep], at[deep] + sizes_of(left, lengths, base)))
        symbols = np.concatenate((left, right))
    return out


def packed(values: np.ndarray) -> bytes:
    planes = max(0, int(values.max(initial=0)).bit_length() - 16)
    high = (np.packbits((values >> np.uint32(16 + k)).astype(np.uint8) & 1) for k in range(planes))
    return b"".join((np.array([len(values), planes], "<i8").tobytes(), values.astype("<u2").tobytes(), *(x.tobytes() for x in high)))


class Packed:
    """Packed integers opened for reading; a slice unpacks its own part."""

    def __init__(self, raw: bytes):
        self.n, planes = np.frombuffer(raw, "<i8", 2).tolist()
        self.low = np.frombuffer(raw, "<u2", self.n, 16)
        self.high = np.frombuffer(raw, np.uint8, offset=16 + 2 * self.n).reshape(planes, -1) if planes else []

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(self.n)
        out = self.low[start:stop].astype(np.uint32)
        for k, plane in enumerate(self.high):
            bits = np.unpackbits(plane[start // 8 : -(-stop // 8)])[start % 8 :][: stop - start]
            out |= bits.astype(np.uint32) << np.uint32(16 + k)
        return out


def shard_row(part: int, seq: int, doc_ids: list[int | None], ids: list[bytes], base: int) -> dict:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    symbols, stops, rules = repair(flat, ends, base)
    return {
        "part": part, "seq": seq, "n_tokens": len(flat), "base": base,
        "doc_ids": np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
        "null_ids": np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
        "doc_symbols": stops.astype("<i8").tobytes(), "rules": packed(rules.ravel()),
        "lengths": packed(rule_lengths(rules, base)), "symbols": packed(symbols),
    }


class Shard:
    """A shard row opened for reading."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.symbols = Packed(row["symbols"])
        self.rules = Packed(row["rules"])[:].reshape(-1, 2)
        self.lengths = Packed(row["lengths"])[:]
        self.stops = np.frombuffer(row["doc_symbols"], dtype="<i8")
        nulls = np.frombuffer(row["null_ids"], dtype=np.uint8)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(row["doc_ids"], dtype="<i8"), nulls, strict=True)]

    def _own(self, k: int) -> np.ndarray:
        return self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, of whose shard nothing else is decoded."""
        return expand(self._own(k), self.rules, self.lengths, self.base)

    def tokens(self, k: int, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1 of the k-th document; only the symbols that hold them are expanded."""
        own = self._own(k)
        stop = np.cumsum(sizes_of(own, self.lengths, self.base))
        lo, hi = np.searchsorted(stop, start, "right"), np.searchsorted(stop, start + n, "left") + 1
        skipped = int(stop[lo - 1]) if lo else 0
        return expand(own[lo:hi], self.rules, self.lengths, self.base)[start - skipped : start - skipped + n]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the whole shard, end of each document in them)."""
        every = self.symbols[:]
        total = np.concatenate(([0], np.cumsum(sizes_of(every, self.lengths, self.base))))
        return expand(every, self.rules, self.lengths, self.base), total[self.stops]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, base: int = 1 << 16, shard_tokens: int = 1 << 20,
                 partitions: int | None = None) -> None:
    """Encode documents in ascending doc_id order, each followed by end_id, and write the shards to path."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, doc_ids, ids, held = Encoder.of(tokenizer, spaces=True), TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard_row(part, seq, doc_ids, ids, base)], schema=SHARD_ARROW)

        for batch in batches:
            for piece in slices(batch):
                for doc_id, got in zip(piece.column(0).to_pylist(), encoder.encode_each(piece.column(1)), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(got + end)
                    held += len(got) // 4 + 1
                    if held >= shard_tokens:
                        yield row()
                        seq, doc_ids, ids, held = seq + 1, [], [], 0
        if doc_ids:
            yield row()

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # an id that many rows repeat is dealt over partitions
    ordered = texts_of(docs).repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("base", pa.int32()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()),
    ("doc_symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. Starts come from two running sums, over partitions and over the shards of each."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ids, ends = shard.all()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    shards = files.select("part", "seq", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("inside"))
    shards = shards.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("origin"))
    rows = files.mapInArrow(documents, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(shards, ["part", "seq"]).select("doc_id", (F.col("origin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, base=50257)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Hierarchical multi-length packing (operator 9).

Documents are encoded where they are read. Whole windows of the largest size leave a long document first; its rest goes
to the smallest tier (context size) that holds it. Windows are opened from the longest tier that has pieces, at that
tier's size; the gap after the first piece is filled from the shorter tiers, largest fitting piece first, and the last
gap by cutting a piece, whose rest is routed again. So every window is exactly full. What remains at the end of a
partition, less than a window, is cut into powers of two, so that nothing is padded. Each partition packs its own rows;
at most ``HELD_TOKENS`` wait, so memory does not grow with the partition, and a lost task is redone with the same rows
and the same sequence ids.

Step groups hold sequences of one tier and ``step_tokens`` tokens each, so that all steps cost the same; only the last
group of each tier and partition is smaller.

Defined cases: null text is empty, so the document is its end id alone; null and repeated ids are packed like others,
each row on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import slices, table, texts_of
from quarry.llm.encoding import Encoder

TIERS = (256, 512, 1024, 2048, 4096)
HELD_TOKENS = 1 << 20
_SCHEMA = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(),
    "offset": pa.int64(), "sequence_tokens": pa.int64(), "tier": pa.int64(), "step_group": pa.int64(),
}


class Packer:
    """Packs pieces (document, ids, start, length) of one partition; rows() takes what is packed so far."""

    def __init__(self, origin: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8 * 4096):
        self.tiers, self.step_tokens, self.origin = tiers, step_tokens, origin
        self.waiting = [deque() for _ in tiers]
        self.held = self.sequences = self.groups = 0
        self.steps: dict[int, tuple[int, int]] = {}
        self.out: list[tuple] = []

    def add(self, doc: object, ids: bytes) -> None:
        n, at, top = len(ids) // 4, 0, self.tiers[-1]
        while n - at >= top:
            self._emit([(doc, ids, at, top)], top)
            at += top
        if at < n:
            self._route((doc, ids, at, n - at))
        if self.held > HELD_TOKENS:
            self.pack(HELD_TOKENS // 8)

    def _route(self, piece: tuple) -> None:
        self.waiting[next(k for k, size in enumerate(self.tiers) if piece[3] <= size)].append(piece)
        self.held += piece[3]

    def _take(self, k: int) -> tuple:
        piece = self.waiting[k].popleft()
        self.held -= piece[3]
        return piece

    def pack(self, leave: int = 0) -> None:
        """Fill windows while more than ``leave`` tokens wait."""
        while self.held > leave:
            k = max(k for k, x in enumerate(self.waiting) if x)
            window, gap = [self._take(k)], self.tiers[k]
            gap -= window[0][3]
            while gap and self.held:
                fits = next((j for j in range(k, -1, -1) if self.waiting[j] and self.waiting[j][0][3] <= gap), None)
                if fits is not None:
                    piece = self._take(fits)
                else:
                    doc, ids, at, n = self._take(min(j for j, x in enumerate(self.waiting) if x))
                    piece = (doc, ids, at, gap)
                    self._route((doc, ids, at + gap, n - gap))
                window.append(piece)
                gap -= piece[3]
            if gap:
                self._split(window)
            else:
                self._emit(window, self.tiers[k])

    def _split(self, pieces: list[tuple]) -> None:
        """Cut a last, partly filled window into sequences whose lengths are powers of two."""
        total, queue = sum(x[3] for x in pieces), deque(pieces)
        while total:
            size = need = 1 << total.bit_length() - 1
            window = []
            while need:
                doc, ids, at, n = queue.popleft()
                if n > need:
                    queue.appendleft((doc, ids, at + need, n - need))
                    n = need
                window.append((doc, ids, at, n))
                need -= n
            self._emit(window, size)
            total -= size

    def _emit(self, window: list[tuple], size: int) -> None:
        group, filled = self.steps.get(size, (-1, self.step_tokens))
        if filled + size > self.step_tokens:
            group, filled = self.groups, 0
            self.groups += 1
        self.steps[size] = (group, filled + size)
        offset = 0
        for doc, ids, at, n in window:
            crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)])
            self.out.append((doc, at, n, crc, len(ids) // 4, self.origin + self.sequences, offset, size, size, self.origin + group))
            offset += n
        self.sequences += 1

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * len(_SCHEMA)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.values(), strict=True)], names=list(_SCHEMA))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8 * 4096) -> DataFrame:
    """Pieces of all documents in packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (real tokens of the sequence; its padded length too), tier and step_group."""
    if any(x & (x - 1) for x in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer, spaces=False), Packer(TaskContext.get().partitionId() << 40, tiers, step_tokens)
        for batch in batches:
            for piece in slices(batch):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode_each(piece.column(1)), strict=True):
                    packer.add(doc_id, ids + end)
                if packer.out:
                    yield packer.rows()
        packer.pack()
        yield packer.rows()

    schema = ", ".join(f"{name} long" for name in _SCHEMA)
    return texts_of(docs).mapInArrow(packed, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

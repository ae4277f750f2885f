"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over the pieces reads each word once. At every position its output links name the pieces that
end there, and each relaxes the best score of that position. For a ``unigram`` model the score of a path is the sum of
its pieces' scores. In a ``bpe`` model the scores are merge priorities, not costs: the path wanted is the one that
merging by priority builds. It is the one path each of whose neighbouring pieces stay apart when merged on their own, so
a piece relaxes a position only if it follows the best path's last piece that way; exactly one does. A word that begins
with a run of spaces, whose merges tie, is merged by a heap instead. Characters that no piece covers become byte pieces.
Ids of words met before are gathered from flat arrays.

Defined cases: null and empty texts have no ids; runs of spaces are kept; an unknown character is its UTF-8 bytes; null
and repeated ids give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import byte_hashes, flat_bytes, runs, slices, table, texts_of
from quarry.llm.encoding import Known

SPACE = "▁"
_UNKNOWN = -1
_UNKNOWN_PENALTY = 10.0


class Pieces:
    """An encoder for the pieces of a model: id -> (text, score), with ids of byte pieces."""

    _loaded: dict[tuple[str, str], Pieces] = {}

    def __init__(self, texts: dict[int, str], scores: dict[int, float], byte_ids: list[int], kind: str = "bpe"):
        import ahocorasick

        self.kind, self.ids, self.byte_ids = kind, {t: i for i, t in texts.items()}, byte_ids
        self.texts, self.scores = texts, scores
        self.raw = {i: t.replace(SPACE, " ").encode() for i, t in texts.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.rank = {t: scores[i] for i, t in texts.items()}
        self.lowest = min(scores.values(), default=0.0)
        self.apart: dict[tuple[str, str], bool] = {}
        self.known = Known(lambda part: self._unit(part.replace(" ", SPACE)))
        size = max(self.raw, default=-1) + 1
        self.raw_size = np.array([len(self.raw.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.raw_flat = np.frombuffer(b"".join(self.raw.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.automaton = ahocorasick.Automaton()
        for i, t in texts.items():
            if kind == "unigram" or self.merged(t) == [t]:
                self.automaton.add_word(t, (len(t), i, t))
        self.automaton.make_automaton()

    @classmethod
    def of(cls, path: str, kind: str = "bpe") -> Pieces:
        if (path, kind) not in cls._loaded:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            every = range(model.get_piece_size())
            plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
            scores = {i: model.get_score(i) for i in plain}
            cls._loaded[path, kind] = cls({i: model.id_to_piece(i) for i in plain}, scores, [i for i in every if model.is_byte(i)], kind)
        return cls._loaded[path, kind]

    def merged(self, text: str) -> list[str]:
        """Merging by priority, the leftmost of equals first: the definition, for single pieces and pairs."""
        parts: list[str | None] = list(text)
        after, before, heap = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                pair = parts[k] + parts[after[k]]
                if pair in self.rank:
                    heapq.heappush(heap, (-self.rank[pair], k, pair))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j < 0 or len(parts[k]) + len(parts[j]) != len(pair) or parts[k] + parts[j] != pair:
                continue
            parts[k], parts[j], after[k] = pair, None, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [x for x in parts if x is not None]

    def _stay_apart(self, a: str, b: str) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self.apart[a, b] = self.merged(a + b) == [a, b]
        return known

    def _bpe_path(self, unit: str) -> list[str]:
        best: list[str | None] = [""] + [None] * len(unit)
        done = 0
        for end, (size, _, piece) in self.automaton.iter(unit):
            stop = end + 1
            while done < stop - 1:
                done += 1
                self._cover(best, unit, done)
            start = stop - size
            if best[stop] is None and best[start] is not None and (start == 0 or self._stay_apart(best[start], piece)):
                best[stop] = piece
        while done < len(unit):
            done += 1
            self._cover(best, unit, done)
        path, at = [], len(unit)
        while at:
            path.append(best[at])
            at -= len(best[at])
        return path[::-1]

    def _cover(self, best: list[str | None], unit: str, stop: int) -> None:
        """A position that no piece reaches is reached by its single character, which becomes bytes."""
        if best[stop] is None and unit[stop - 1] not in self.rank:
            best[stop] = unit[stop - 1]

    def _unigram_path(self, unit: str) -> list[str]:
        unknown = self.lowest - _UNKNOWN_PENALTY
        score, back = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(len(unit) + 1)]
        for end, (size, i, _) in self.automaton.iter(unit):
            found[end + 1].append((size, self.scores[i]))
        for stop in range(1, len(unit) + 1):
            if unit[stop - 1] not in self.rank:
                found[stop].append((1, unknown))
            for size, gain in found[stop]:
                if score[stop - size] + gain > score[stop]:
                    score[stop], back[stop] = score[stop - size] + gain, size
        path, at = [], len(unit)
        while at:
            path.append(unit[at - back[at] : at])
            at -= back[at]
        return path[::-1]

    def path(self, unit: str) -> list[str]:
        if self.kind == "unigram":
            return self._unigram_path(unit)
        if unit[:2] == SPACE * 2:  # runs of spaces tie in priority
            return self.merged(unit)
        return self._bpe_path(unit)

    def _unit(self, unit: str) -> bytes:
        out = array("I")
        for piece in self.path(unit):
            i = self.ids.get(piece, _UNKNOWN)
            if i != _UNKNOWN:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
        return out.tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's ids end)."""
        if self.kind == "unigram":
            each = [self._unit(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), dtype="<u4"), np.cumsum([len(x) // 4 for x in each], dtype=np.int64)
        data, text = spaced(texts)
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[runs(data == 32, text)[0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))[: len(start)]
        ids, sizes = self.known.ids(data, start, end, byte_hashes(data, start, end))
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(start, text)[1:]]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that the ids stand for, each text with the space before it."""
        size = self.raw_size[ids]
        stop = np.cumsum(size)
        at = np.cumsum(self.raw_size) - self.raw_size
        return self.raw_flat[np.repeat(at[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        text = self.decoded(ids).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins) of the texts as they are encoded: a space before each that is not empty, and the
    model's own mark for spaces taken for one."""
    plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return flat_bytes(pc.if_else(pc.equal(plain, nothing), plain, pc.binary_join_element_wise(nothing, plain, space)))


def encode_documents(docs: DataFrame, model: str, kind: str = "bpe", with_ids: bool = True) -> DataFrame:
    """doc_id, ids (unless with_ids is false), n_ids, n_bytes (ids that are byte pieces), ids_crc32, round_trip (whether
    decoding gives the text back; a text that holds the model's own space mark comes back with spaces)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model, kind)
        low, high = pieces.byte_ids[0], pieces.byte_ids[-1]
        for batch in batches:
            for part in slices(batch):
                ids, ends = pieces.encode(part.column(1))
                cut = np.concatenate(([0], ends)).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = {
                    "doc_id": part.column(0),
                    **({"ids": pa.ListArray.from_arrays(cut.astype(np.int32), ids.astype(np.int32))} if with_ids else {}),
                    "n_ids": pa.array(np.diff(cut)),
                    "n_bytes": pa.array(np.diff(np.concatenate(([0], np.cumsum((ids >= low) & (ids <= high))))[cut]).astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64()),
                    "round_trip": pa.array(_round_trips(pieces, part.column(1), ids, cut), pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ids = "ids array<int>, " if with_ids else ""
    return texts_of(docs).mapInArrow(encoded, f"doc_id long, {ids}n_ids long, n_bytes long, ids_crc32 long, round_trip boolean")


def _round_trips(pieces: Pieces, texts: pa.Array, ids: np.ndarray, cut: np.ndarray) -> list[bool]:
    data, text = spaced(texts)
    back = pieces.decoded(ids)
    if np.array_equal(back, data):
        return [True] * len(texts)
    stop = np.concatenate(([0], np.cumsum(pieces.raw_size[ids])))[cut]
    return [np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(stop[:-1], stop[1:], text[:-1], text[1:], strict=True)]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

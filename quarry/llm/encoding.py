"""Encoding of whole texts with public tokenizers, part by part.

The tokenizers' own split never joins characters across the places where ``Encoder`` cuts, so the ids of a text are
those of its parts one after the other. The parts of all texts of a chunk are hashed at once, and ids of parts met before
are gathered from ``Known``, flat arrays in the worker's memory, where its bytes are compared; a part is made once. A part of letters and printable
ASCII is split into words as the tokenizer splits it, and words go to the library's model; any other part goes through
the whole library.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from quarry.llm.common import Words, byte_hashes, flat_bytes, runs

MAX_PARTS, MAX_IDS, FRESH = 1_000_000, 8_000_000, 60_000
#: Eight-byte blocks of known parts' own bytes, and the size from which two parts are compared one by one.
MAX_BLOCKS, ALONE = 2_000_000, 256
MAX_WORDS, LONG = 200_000, 256
#: Parts that are split here, and their split with a space before them or without; special tokens hold "<|".
_SIMPLE = regex.compile(r"[ \n]?[!-~\p{L}]*")
#: Parts that the tokenizer splits from one another wherever they stand side by side, and how many go to it at once.
_APART, AT_ONCE = regex.compile(r"[ \n][!-~\p{L}]+"), 1 << 14
_SPACED = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s")
_WHITE = regex.compile(r"\p{White_Space}+")
_BARE = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

_ODD, _WIDE = np.isin(np.arange(256), [9, 11, 12, 13]), np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level tokenizers show a byte as itself where that prints, the others in order as the characters from 256 on.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Table(dict):
    """key -> bytes, filled on demand. Two generations of at most MAX_WORDS entries each: when one is full, it takes the
    place of the older one. Keys of more than LONG characters are not kept."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MAX_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one integer; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def _block(every: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Block k of the parts of that many bytes from start on, zeros behind their ends."""
    left = np.minimum(size - 8 * k, 8).astype(np.uint64)
    return every[start + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))


class Known:
    """Ids of parts that are looked up by their 64-bit hashes, in arrays sorted by hash: an older, large set, and what is
    new since. The bytes of a part are kept and compared, so that a part whose hash another one has is made anew. Of more
    than MAX_PARTS parts or MAX_IDS ids the half used last stays."""

    def __init__(self, make: Callable[[str], bytes], make_all: Callable[[list[bytes]], list[bytes]] | None = None):
        """make_all, if given, does what make does to many parts at once, given as bytes."""
        self.make, self.make_all, self.clock, self.used, self.flat = make, make_all, 0, 0, np.zeros(1 << 16, dtype=np.uint32)
        self.filled, self.own = 0, np.zeros(1 << 16, dtype=np.uint64)
        self.old, self.new = self._empty(), self._empty()

    @staticmethod
    def _empty() -> list[np.ndarray]:
        """Hashes, first places in flat, numbers of ids, when each was used last, first blocks in own, sizes in bytes."""
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(5))]

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, one after the other; number of ids of each)."""
        self.clock += 1
        self._shrink()
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.cumsum(first) - 1
        one, every = order[first], blocks(data)
        at, sizes = (x[of] for x in self._find(ordered[first], data, every, start[one], end[one]))
        other = np.flatnonzero(~self._same(every, start, end - start, every, start[one][of], (end - start)[one][of], 1))
        if len(other):  # parts that share the hash of another part of this chunk
            made = self._made(data, start[other], end[other])
            sizes[other] = [len(x) // 4 for x in made]
            at[other] = self._store(made)
        stop = np.cumsum(sizes)
        return self.flat[np.repeat(at - (stop - sizes), sizes) + np.arange(stop[-1])], sizes

    @staticmethod
    def _same(every: np.ndarray, start: np.ndarray, size: np.ndarray, theirs: np.ndarray, their_start: np.ndarray, their_size: np.ndarray, step: int) -> np.ndarray:
        """Which parts agree byte by byte; the others' next block is ``8 // step`` places on (they lie in bytes or blocks)."""
        same = size == their_size
        for k in range(-(-int(min(size.max(initial=0), ALONE)) // 8)):
            i = np.flatnonzero(same & (size > 8 * k))
            i = i[start[i] != their_start[i]] if step == 1 and theirs is every else i
            right = _block(theirs, their_start[i], size[i], k) if step == 1 else theirs[their_start[i] + k]
            same[i] = _block(every, start[i], size[i], k) == right
        for i in np.flatnonzero(same & (size > ALONE)).tolist():
            if step == 1 and theirs is every and start[i] == their_start[i]:
                continue
            k = np.arange(-(-int(size[i]) // 8))
            right = theirs[their_start[i] + 8 * k] if step == 1 else theirs[their_start[i] + k]
            left = every[start[i] + 8 * k]
            same[i] = (left[:-1] == right[:-1]).all() and _block(every, start[i : i + 1], size[i : i + 1], int(k[-1]))[0] == (
                _block(theirs, their_start[i : i + 1], size[i : i + 1], int(k[-1]))[0] if step == 1 else right[-1]
            )
        return same

    def _find(self, keys: np.ndarray, data: np.ndarray, every: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size, todo, fresh = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool), np.ones(len(keys), bool)
        for have in (self.old, self.new):
            if len(have[0]):
                place = np.minimum(np.searchsorted(have[0], keys), len(have[0]) - 1)
                hit = np.flatnonzero(have[0][place] == keys)
                fresh[hit] = False
                place = place[hit]
                same = self._same(every, start[hit], end[hit] - start[hit], self.own, have[4][place], have[5][place], 8)
                hit, place = hit[same], place[same]
                at[hit], size[hit], todo[hit] = have[1][place], have[2][place], False
                have[3][place] = self.clock
        missing = np.flatnonzero(todo)
        if len(missing):
            made = self._made(data, start[missing], end[missing])
            size[missing] = [len(x) // 4 for x in made]
            at[missing] = self._store(made)
            keep = missing[fresh[missing]]  # a hash stands for one part alone
            place = np.searchsorted(self.new[0], keys[keep])
            own, length = self._keep(every, start[keep], end[keep] - start[keep]), end[keep] - start[keep]
            added = (keys[keep], at[keep], size[keep], np.full(len(keep), self.clock), own, length)
            self.new = [np.insert(x, place, y.astype(x.dtype)) for x, y in zip(self.new, added, strict=True)]
        return at, size

    def _made(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        parts = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return self.make_all(parts) if self.make_all else [self.make(x.decode()) for x in parts]

    def _store(self, made: list[bytes]) -> np.ndarray:
        """Where the ids of each part are in flat from now on."""
        ids, size = np.frombuffer(b"".join(made), dtype="<u4"), np.array([len(x) // 4 for x in made])
        at = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return at

    def _keep(self, every: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the bytes of each part are in own from now on, in whole blocks."""
        n = -(-size // 8)
        stop = self.filled + np.cumsum(n)
        if len(n) and stop[-1] > len(self.own):
            self.own = np.concatenate((self.own[: self.filled], np.zeros(int(stop[-1]), np.uint64)))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = np.minimum(np.repeat(size, n) - 8 * k, 8).astype(np.uint64)
        self.own[self.filled : self.filled + len(k)] = every[np.repeat(start, n) + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        self.filled += len(k)
        return stop - n

    @staticmethod
    def _moved(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those ranges of flat, one after the other; where each is then)."""
        stop = np.cumsum(size, dtype=np.int64)
        return flat[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], stop - size

    def _shrink(self) -> None:
        full = self.used > MAX_IDS or self.filled > MAX_BLOCKS
        if len(self.new[0]) > FRESH or full:
            every = [np.concatenate(x) for x in zip(self.old, self.new, strict=True)]
            order = np.argsort(every[0])
            self.old, self.new = [x[order] for x in every], self._empty()
        if len(self.old[0]) > MAX_PARTS or full:
            keep = (self.old[3] > np.median(self.old[3])) & (self.old[2] <= LONG) & (self.old[5] <= 8 * LONG)
            key, at, size, stamp, own, length = (x[keep] for x in self.old)
            self.flat, at = self._moved(self.flat, at, size)
            self.own, own = self._moved(self.own, own, -(-length // 8))
            self.old, self.used, self.filled = [key, at.astype(np.int32), size, stamp, own.astype(np.int32), length], len(self.flat), len(self.own)


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Bytes of white space other than space and line end: tab, vertical tab, form feed, return, and the wide ones."""
    odd, padded = _ODD[data], np.append(data, [0, 0])
    wide = np.flatnonzero(_WIDE[data])
    first, one, two = padded[wide], padded[wide + 1], padded[wide + 2]
    pair = (first == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (first == 0xE2) & (((one == 0x80) & (((two >= 0x80) & (two <= 0x8A)) | np.isin(two, [0xA8, 0xA9, 0xAF]))) | ((one == 0x81) & (two == 0x9F)))
    triple = general | ((first == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((first == 0xE3) & (one == 0x80) & (two == 0x80))
    for found, n in ((pair, 2), (triple, 3)):
        for k in range(n):
            odd[wide[found] + k] = True
    return odd


def spaced_parts(data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each part, first part of each text, with the number of parts at the end). A part begins with the last of
    a run of spaces and line ends; the rest of the run is a part before it, as is the whole run at the end of a text. A
    run beside other white space, or a longer one before what may be a special token, begins no part."""
    n = len(data)
    start, end = runs((data == 32) | (data == 10), text)
    begins, ends, odd = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.append(_odd_spaces(data), [False, False])
    filled = np.diff(text) > 0
    begins[text[:-1][filled]], ends[text[1:][filled]] = True, True
    after = np.append(data, [0, 0]).astype(np.uint16)
    special = (end - start > 1) & (after[end] == ord("<")) & (after[end + 1] == ord("|"))
    good = ~((~begins[start] & odd[start - 1]) | (~ends[end] & (odd[end] | special)))
    start, end = start[good], end[good]
    begins[start] = True
    begins[end[~ends[end]] - 1] = True
    at = np.flatnonzero(begins[:n])
    return at, np.searchsorted(at, text)


class Encoder:
    """Ids of texts; ``spaces`` says whether the tokenizer keeps white space (byte level) or drops it (word ends)."""

    _loaded: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.spaces = Tokenizer.from_file(path), spaces
        self.model = self.library.model
        self.words = Table(self._word)
        self.known = Known(self._spaced, self._spaced_all) if spaces else Known(self._bare)
        #: Bytes that each id stands for: byte-level tokens show each byte as one character.
        self.sizes = np.zeros(self.library.get_vocab_size() if spaces else 0, dtype=np.int64)
        for token, k in self.library.get_vocab().items() if spaces else ():
            self.sizes[k] = len(token)

    @classmethod
    def of(cls, path: str, spaces: bool) -> Encoder:
        """One for each worker process."""
        if (path, spaces) not in cls._loaded:
            cls._loaded[path, spaces] = cls(path, spaces)
        return cls._loaded[path, spaces]

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """One word of the tokenizer's split, its space included."""
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", "Ġ")
        else:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        return _packed([t.id for t in self.model.tokenize(shown)])

    def _spaced(self, part: str) -> bytes:
        """A part of a text with the white space before it."""
        if _WHITE.fullmatch(part):
            return self._word(part)
        if "<|" in part or not _SIMPLE.fullmatch(part):
            return self.whole(part)
        return b"".join(map(self.words.__getitem__, _SPACED.findall(part)))

    def _spaced_all(self, parts: list[bytes]) -> list[bytes]:
        """What _spaced gives for each part. Most go to the library side by side, as one text; as each id stands for a
        number of bytes, the parts' sizes tell where their ids end."""
        texts = [x.decode() for x in parts]
        out: list[bytes] = [b""] * len(parts)
        apart = [i for i, x in enumerate(texts) if _APART.fullmatch(x) and "<|" not in x]
        for k in range(0, len(apart), AT_ONCE):
            some = apart[k : k + AT_ONCE]
            got = self.library.encode_batch_fast(["".join([texts[i] for i in some])], add_special_tokens=False)[0].ids
            ids, ends = np.array(got, dtype="<u4"), np.cumsum([len(parts[i]) for i in some])
            stops = np.cumsum(self.sizes[ids])
            last = np.searchsorted(stops, ends)
            if stops[-1] == ends[-1] and (stops[last] == ends).all():
                raw, cut = ids.tobytes(), (4 * (last + 1)).tolist()
                for i, a, b in zip(some, [0, *cut[:-1]], cut, strict=True):
                    out[i] = raw[a:b]
        return [x or self._spaced(t) for x, t in zip(out, texts, strict=True)]

    def _bare(self, part: str) -> bytes:
        """A part without white space at its ends."""
        if not part.isascii() and ("Σ" in part or "İ" in part or not unicodedata.is_normalized("NFC", part)):
            return self.whole(part)
        if part.isalpha():
            return self.words[part.lower()]
        if "<|" in part or not _SIMPLE.fullmatch(part):
            return self.whole(part)
        return b"".join(map(self.words.__getitem__, _BARE.findall(part.lower())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's ids end); null counts as empty."""
        if self.spaces:
            data, text = flat_bytes(texts)
            start, first = spaced_parts(data, text)
            end = np.append(start[1:], len(data))
            hashes = byte_hashes(data, start, end)
        else:
            words = Words.of(texts)
            data, start, end, first, hashes = words.data, words.start, words.end, words.first, words.hashes
        ids, sizes = self.known.ids(data, start, end, hashes)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[first[1:]]

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode(texts)
        raw, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

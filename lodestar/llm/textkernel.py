"""Vectorised word kernels over Arrow string buffers.

Texts stay UTF-8 bytes.  Every word class used here is separated by ASCII
bytes only, so splitting on bytes equals splitting on characters.  Words and
windows get 64-bit polynomial (Rabin-Karp) hashes; a window's hash depends on
nothing but its words, so equal windows agree in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about this many bytes, so the 8-byte-a-byte
#: temporaries stay small whatever the size of an Arrow batch.
BLOCK_BYTES = (1 << 19) - 1024

_M64 = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base mod 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_CHAR = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))
_WORD = (_Powers(0xE7037ED1A0B428DB), _Powers(0x8EBC6AF09C88C6E3))
_BYTE = (_splitmix(256, 0x1234567), _splitmix(256, 0x89ABCDE))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of a word; ranges are the separators, ends included."""
    word = np.ones(256, dtype=bool)
    for a, b in ranges:
        word[a : b + 1] = False
    return word


#: [^\x20\x09-\x0D]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing: digits, a-z, non-ASCII)
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts and the len + 1 offsets between them."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column) -> Texts:
    """The bytes of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def blocks(texts: Texts, size: int = BLOCK_BYTES):
    """(first, end) ranges of texts of about size bytes; a longer text stands alone."""
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(texts.offsets, texts.offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def part(texts: Texts, i: int, j: int) -> Texts:
    off = texts.offsets[i : j + 1]
    return Texts(texts.data[off[0] : off[-1]], off - off[0])


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, 64-bit hashes, and for each
    text the range bounds[i]:bounds[i + 1] of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    text: Texts

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(texts: Texts, word: np.ndarray, lower: bool = False, salt: int = 0, hashes: bool = True) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), texts)
    inside = word[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = texts.offsets[:-1]
    edges = edges[edges < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = texts.offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(start, texts.offsets)
    h = np.zeros(0, np.uint64)
    if hashes and len(start):
        up, down = _CHAR[salt].get(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[salt][data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, h, bounds, texts)


def windows_of(words: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of one text.

    Returns (at, hash): at is the index of the window's first word in words.
    """
    n = len(words.start)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _WORD[salt].get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * up[:n], out=total[1:])
    h = mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))
    ok = np.ones(n - k + 1, dtype=bool)
    inner = words.bounds[1:-1]
    for back in range(1, k):  # windows that would run over the end of a text
        at = inner - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    # an inner bound that lies less than k words from several ends is covered above
    at = np.flatnonzero(ok)
    return at, h[at]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1] and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of at."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:-1]) > 0

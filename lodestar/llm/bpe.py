"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is split by the pattern into pieces.  The distinct pieces of a slice are
sorted into buckets by length, one padded matrix of byte ids each.  In a round
every row merges its leftmost pair of the smallest rank: the pairs' ranks come
from a hashed table of pairs, the row is compacted by one, and only the two
pairs beside the merge are looked up again.  Rows without a pair leave.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkernel as K
from .common import map_columns

#: Pieces that a worker remembers, and bytes of pieces; then it starts anew.
CACHE_PIECES = 200_000
CACHE_BYTES = 4 << 20
#: Longer pieces are merged with a heap: a matrix row would take the square of the length.
MATRIX_LENGTH = 512
#: Cells of one matrix at most.
MATRIX_CELLS = 1 << 20
#: Text bytes that are gathered at once.
BLOCK = 1 << 19
NO_RANK = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file of lines 'base64 rank'."""
    got = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                got[int(rank)] = base64.b64decode(token)
    if sorted(got) != list(range(len(got))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [got[i] for i in range(len(got))]


class PairTable:
    """Open-addressing hash table from a pair of tokens to the rank of their concatenation."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for r, t in enumerate(tokens):
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NO_RANK, dtype=np.int32)
        left, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        slot = self._slot(left)
        while len(left):  # of the keys that want one empty slot the first takes it, the others go on
            empty = self.keys[slot] == -1
            takes, first = np.unique(np.where(empty, slot, -1), return_index=True)
            first = first[takes >= 0]
            self.keys[slot[first]], self.values[slot[first]] = left[first], value[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (K.mix(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each concatenation, NO_RANK where it is no token; a or b of -1 is padding."""
        shape = a.shape
        key = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        out = np.full(key.shape, NO_RANK, dtype=np.int32)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        slot = self._slot(key[todo])
        while len(todo):
            found = self.keys[slot]
            same = found == key[todo]
            out[todo[same]] = self.values[slot[same]]
            go = ~same & (found != -1)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_end = np.cumsum(lengths)
        self.token_size = lengths
        self.token_data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.bytes = 0

    # What only encoding needs is made when it is first asked for.

    @cached_property
    def whole(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def single(self) -> np.ndarray:
        return np.array([self.whole[bytes([b])] for b in range(256)], dtype=np.int32)

    @cached_property
    def pairs(self) -> PairTable:
        return PairTable(self.tokens)

    # -- merging ---------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece; a piece that is a token is that token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.whole.get(p)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(p) > MATRIX_LENGTH:
                out[i] = self._merge_long(p)
            else:  # widths grow by a quarter, so padding stays under a fifth
                n, width = len(p), 2
                while width < n:
                    width += max(1, width // 4)
                buckets.setdefault(width, []).append(i)
        for width, members in sorted(buckets.items()):
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                self._merge_bucket(pieces, members[at : at + step], width, out)
        return out

    def _merge_bucket(self, pieces: list[bytes], members: list[int], width: int, out: list) -> None:
        sizes = np.array([len(pieces[i]) for i in members], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces[i] for i in members), dtype=np.uint8)
        row = np.full((len(members), width), -1, dtype=np.int32)
        row[np.repeat(np.arange(len(members)), sizes), K.spread(np.zeros(len(members), np.int64), sizes)] = self.single[data]
        rank = self.pairs.get(row[:, :-1], row[:, 1:])
        who = np.array(members, dtype=np.int64)
        cols = np.arange(width)
        while len(who):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            done = best == NO_RANK
            if done.any():
                ends = (row[done] >= 0).sum(axis=1)
                for i, r, n in zip(who[done].tolist(), row[done], ends.tolist()):
                    out[i] = r[:n].copy()
                live = ~done
                row, rank, who, at, best = row[live], rank[live], who[live], at[live], best[live]
                if not len(who):
                    break
            each = np.arange(len(who))
            row[each, at] = best
            # compaction: what stands right of the merged pair moves one to the left
            right = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            row = np.take_along_axis(row, right, axis=1)
            row[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(right[:, :-1], width - 2), axis=1)
            rank[:, -1] = NO_RANK
            next_ = np.where(at + 1 < width, row[each, np.minimum(at + 1, width - 1)], -1)
            ok = at < width - 1
            rank[each[ok], at[ok]] = self.pairs.get(best, next_)[ok]
            back = at > 0
            rank[each[back], at[back] - 1] = self.pairs.get(row[each[back], at[back] - 1], best[back])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges, smallest rank first and leftmost of equals, by a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        first = self.pairs.get(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        token = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = first.tolist() + [int(NO_RANK)]
        whole, tokens = self.whole, self.tokens
        while heap:
            r, i = heapq.heappop(heap)
            if pair[i] != r:
                continue
            j = after[i]
            token[i], pair[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a < 0:
                    continue
                got = whole.get(tokens[token[a]] + tokens[token[b]], int(NO_RANK)) if b < n else int(NO_RANK)
                pair[a] = got
                if got != NO_RANK:
                    heapq.heappush(heap, (got, a))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, dtype=np.int32)

    # -- texts -----------------------------------------------------------

    def _number(self, pieces: list[str]) -> np.ndarray:
        """Index of each piece in the store; new pieces are merged and added."""
        new: list[str] = []
        index = self.index
        for p in set(pieces):
            if p not in index:
                index[p] = len(index)
                new.append(p)
        if new:
            coded = [p.encode() for p in new]
            got = self.merge(coded)
            counts = np.array([len(g) for g in got], dtype=np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, *got])
            self.bytes += sum(map(len, coded))
        return np.fromiter(map(index.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[np.ndarray] = []
        find = self.pattern.findall
        i = 0
        while i < len(texts):
            pieces: list[str] = []
            ends, size = [], 0
            while i < len(texts) and (not ends or size + len(texts[i]) <= BLOCK):
                pieces += find(texts[i])
                ends.append(len(pieces))
                size += len(texts[i])
                i += 1
            if len(self.index) > CACHE_PIECES or self.bytes > CACHE_BYTES:
                self._clear()
            which = self._number(pieces)
            counts = self.count[which]
            ids = self.ids[K.spread(self.start[which], counts)]
            total = np.concatenate(([0], np.cumsum(counts)))
            out += np.split(ids, total[np.array(ends[:-1], dtype=np.int64)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids."""
        parts = []
        for i in range(0, len(ids), BLOCK // 4):
            x = ids[i : i + BLOCK // 4].astype(np.int64)
            size = self.token_size[x]
            parts.append(self.token_data[K.spread(self.token_end[x] - size, size)].tobytes())
        return b"".join(parts)


_codecs: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    key = (shared.value[0], pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value[1], pattern)
    return _codecs[key]


def _share(spark, path: str):
    """A vocabulary file, some 100,000 tokens at most, on all executors; only the driver reads the path."""
    return spark.sparkContext.broadcast((path, read_ranks(path)))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (little-endian unsigned 32-bit integers, packed).

    Special tokens are not looked for: their spelling is ordinary text.

    Edge cases: a null or empty text has no ids (0, empty bytes); a text of any
    length is whole; columns named as the new ones are replaced; an empty table
    stays empty.
    """
    shared = _share(docs.sparkSession, ranks_path)

    def columns(text: pa.Array) -> list[pa.Array]:
        got = _codec(shared, pattern).encode([x or "" for x in text.to_pylist()])
        return [pa.array([len(g) for g in got], pa.int64()), pa.array([g.astype("<u4").tobytes() for g in got], pa.binary())]

    return map_columns(docs, text_col, columns, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def bpe_decode(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """coded with decoded, the bytes of its ids; null ids decode to no bytes.

    An id outside the vocabulary raises.
    """
    shared = _share(coded.sparkSession, ranks_path)

    def columns(ids: pa.Array) -> list[pa.Array]:
        codec = _codec(shared, pattern)
        return [pa.array([codec.decode(np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype="<u4")) for x in ids], pa.binary())]

    return map_columns(coded, ids_col, columns, [T.StructField("decoded", T.BinaryType())])


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids and decoded: bpe_encode, and bpe_decode of its ids, in one pass through a worker.

    Edge cases are those of the two.
    """
    shared = _share(docs.sparkSession, ranks_path)

    def columns(text: pa.Array) -> list[pa.Array]:
        codec = _codec(shared, pattern)
        got = [g.astype("<u4").tobytes() for g in codec.encode([x or "" for x in text.to_pylist()])]
        decoded = [codec.decode(np.frombuffer(g, dtype="<u4")) for g in got]
        return [pa.array([len(g) // 4 for g in got], pa.int64()), pa.array(got, pa.binary()), pa.array(decoded, pa.binary())]

    return map_columns(docs, text_col, columns, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

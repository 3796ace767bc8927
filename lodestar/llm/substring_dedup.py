"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Every document's windows of `window` words are hashed and counted over the
whole corpus; a window that starts earlier elsewhere is a repeat; repeated
windows merge into maximal removal intervals, and the words in them go.

Plan, with documents cut into chunks of consecutive ids:

1. One shuffle brings the texts of a chunk together.
2. A chunk sends each of its distinct window hashes once, sorted and packed in
   one binary value for each hash range ("bucket"): the pre-aggregation that
   keeps a window shared by a third of all documents at one entry a chunk.
3. A bucket marks the hashes that a lower chunk has too, and answers with one
   bit a hash.  Chunks are in id order, so a lower chunk is an earlier start.
4. Chunks, whose shuffle Spark reuses, merge marked windows into intervals.

Nothing is collected, broadcast or paired.  A bucket holds one hash range of
one size, whatever the keys.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bounded_batches, keyed_text, lean, lean_pair, partitions_for

WINDOW = 20
#: Chunks for each shuffle partition, so that hashing chunks to partitions is even.
CHUNKS_EACH = 3
#: Hash ranges for each shuffle partition: a task holds one range at a time.
BUCKETS_EACH = 2


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes byte plane by byte plane: the high planes are runs, which the shuffle's codec removes."""
    return np.ascontiguousarray(h.byteswap().view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().byteswap()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Increases with the hash, so a sorted array falls into consecutive buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ordered(ids: pa.Array, h: pa.Array, text: pa.Array) -> np.ndarray:
    """Row order by id, nulls first; rows that share an id by a hash of their text, then the text, so that any arrival order gives the same."""
    key = np.asarray(ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min))
    h = np.asarray(h).astype(np.int64).view(np.uint64)
    order = np.lexsort((h, key))
    if len(key) > 1 and ((np.diff(key[order]) == 0) & (np.diff(h[order]) == 0)).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (key[i], h[i], text[i].as_py() or "")), dtype=np.int64)
    return order


class Chunks:
    """Which chunk a row is of: ranges of ids, and within an id of very many rows ranges of the hash; chunk numbers are in (id, hash) order."""

    def __init__(self, bounds: list[float], heavy: dict[float, int]):
        """bounds: ids that begin a range; heavy: ids with the number of chunks they take."""
        self.bounds = np.array(sorted({*bounds, *heavy, *(np.nextafter(x, np.inf) for x in heavy)}), dtype=np.float64)
        self.parts = np.ones(len(self.bounds) + 1, dtype=np.int64)
        for x, n in heavy.items():
            self.parts[np.searchsorted(self.bounds, x, side="right")] = n
        self.first = np.cumsum(self.parts) - self.parts

    def of(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids.astype(np.float64), side="right")
        high = h.astype(np.int64).view(np.uint64) >> np.uint64(32)
        return self.first[at] + (high * self.parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _chunks(rows: DataFrame, chunks: int) -> Chunks:
    """About `chunks` ranges of equally many rows; what the driver gets is of that order."""
    bounds = rows.approxQuantile("doc_id", [i / chunks for i in range(1, chunks)], 0.25 / chunks) or []
    fair = max(1, rows.count() // chunks)
    counts = rows.groupBy("doc_id").count().where(F.col("count") > 2 * fair).collect()  # chunks / 2 ids at most
    least = -(2.0**63)
    return Chunks([float(x) for x in bounds], {least if r["doc_id"] is None else float(r["doc_id"]): -(-r["count"] // fair) for r in counts})


def _chunk_windows(texts: K.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(global word index, hash) of every window of a chunk, in (document, start) order."""
    ats, hs, base = [], [], 0
    for i, j in K.blocks(texts):
        w = K.words_of(K.part(texts, i, j), K.SPACED)
        at, h = K.windows_of(w, k)
        ats.append(at + base)
        hs.append(h)
        base += len(w.start)
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *ats]), np.concatenate([z.astype(np.uint64), *hs])


def _send(k: int, buckets: int):
    def send(batches):
        for chunk, group in itertools.groupby(_by_chunk(batches), key=lambda x: x[0]):
            hs = [h for _, t in group for h in [np.unique(_chunk_windows(t, k)[1])]]
            h = np.unique(np.concatenate(hs)) if len(hs) > 1 else hs[0]
            edges = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            rows = [(chunk, b, h[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b + 1] > edges[b]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([_pack(r[2]) for r in rows], pa.binary())], names=["chunk", "bucket", "hashes"])

    return send


def _by_chunk(batches):
    """(chunk, texts) of runs of rows of one chunk; rows arrive sorted by chunk."""
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield int(chunk[a]), K.texts_of(batch.column("text").slice(a, b - a))


def _mark(batches):
    """Of each hash of a bucket, all but the lowest chunk's entry are marked."""
    got: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for c, b, blob in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("hashes")):
            got.setdefault(b, []).append((c, _unpack(blob.as_buffer())))
    for b in sorted(got):
        rows = sorted(got.pop(b), key=lambda r: r[0])
        h = np.concatenate([r[1] for r in rows])
        order = np.argsort(h, kind="stable")
        later = np.zeros(len(h), dtype=bool)
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        edges = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
        out = [(r[0], b, e - s, np.packbits(later[s:e]).tobytes()) for r, s, e in zip(rows, edges[:-1], edges[1:]) if later[s:e].any()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["chunk", "bucket", "n", "bits"])


def _keep(k: int, buckets: int):
    def keep(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        ids, h, text = (pa.concat_arrays(docs[c].chunks) if docs[c].num_chunks else pa.array([], docs.schema.field(c).type) for c in ("doc_id", "h", "text"))
        order = _ordered(ids, h, text)
        ids, text = ids.take(pa.array(order)), text.take(pa.array(order))
        texts = K.texts_of(text)
        at, h = _chunk_windows(texts, k)
        if len(h):
            distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            marked = np.zeros(len(distinct), dtype=bool)
            edges = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
            for b, n, bits in zip(marks["bucket"].to_pylist(), marks["n"].to_pylist(), marks["bits"].to_pylist()):
                if n != edges[b + 1] - edges[b]:
                    raise RuntimeError("a chunk's windows changed between two reads of the input")
                marked[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            gone = at[marked[inverse] | (first[inverse] != np.arange(len(h)))]
        else:
            gone = at
        kept, words, removed, base = [], [], [], 0
        for i, j in K.blocks(texts):
            w = K.words_of(K.part(texts, i, j), K.SPACED, hashes=False)
            n = len(w.start)
            cut = K.covered(n, gone[np.searchsorted(gone, base) : np.searchsorted(gone, base + n)] - base, k) if n else np.zeros(0, bool)
            base += n
            counts = w.counts()
            total = np.concatenate(([0], np.cumsum(cut)))
            words.append(counts)
            removed.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
            kept.append(join_words(w, ~cut))
        return pa.table({"doc_id": ids, "n_words": pa.array(np.concatenate(words), pa.int64()), "n_removed": pa.array(np.concatenate(removed), pa.int64()), "kept": pa.concat_arrays(kept)})

    return keep


def join_words(w: K.Words, keep: np.ndarray) -> pa.Array:
    """For each text its kept words, joined by one space."""
    which = np.flatnonzero(keep)
    doc = np.searchsorted(w.bounds, which, side="right") - 1
    last = np.ones(len(which), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = w.end[which] - w.start[which]
    out_size = size + ~last  # and the space after it
    ends = np.cumsum(out_size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    out[K.spread(ends - out_size, size)] = w.text.data[K.spread(w.start[which], size)]
    per = np.zeros(len(w.text), dtype=np.int64)
    np.add.at(per, doc, out_size)
    offsets = np.concatenate(([0], np.cumsum(per)))
    return pa.LargeStringArray.from_buffers(len(w.text), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text) of every row of docs.

    Words are runs of anything but ASCII white space.  A word goes if a window
    of `window` words that covers it also starts earlier: in a smaller id, or
    in the same document further left.  Windows are those of the input.

    Edge cases: a null text has no words and a kept text of ''; a text shorter
    than the window keeps all its words, one of any length is whole; a null id
    counts as the smallest; rows that share an id are ordered by a hash of their
    text, and of equal rows one is first; an empty table gives an empty result;
    other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    n = partitions_for(rows)
    ranges = _chunks(rows, CHUNKS_EACH * n)

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series, h: pd.Series) -> pd.Series:  # the texts stay in the JVM
        return pd.Series(ranges.of(ids.fillna(-(2**63)).to_numpy(), h.to_numpy()).astype("int32"))

    rows = rows.withColumn("chunk", chunk_of("doc_id", "h")).repartition(n, "chunk")
    buckets = BUCKETS_EACH * n
    # All columns go in, unused ones too: the exchange below is then the same as that of the last step, and runs once.
    sent = rows.sortWithinPartitions("chunk").mapInArrow(lean(_send(window, buckets)), "chunk int, bucket int, hashes binary")
    marks = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(_mark), "chunk int, bucket int, n long, bits binary")
    keep = lean_pair(_keep(window, buckets))
    return rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")

"""Benchmark decontamination by winnowing.

Of every `window` consecutive words (k-grams of `gram` words, window - gram + 1
of them) both sides keep the smallest k-gram hash.  Equal windows keep equal
fingerprints, so joining the fingerprints finds every shared window; a hit is
then extended: the windows around it are compared by their own hash, and
touching windows merge into maximal shared spans.

A benchmark of at most BROADCAST_CHARS characters is a broadcast index:
documents are scanned once, in the partitions they come in, and nothing is
shuffled.  A larger one is joined: fingerprints of both sides meet in a shuffle,
the texts they name are read again for the windows around them, and those meet
the benchmark's windows in a second one.  Neither the driver nor a task then
holds more of the benchmark than one item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import bounded_batches, cut, fresh, map_columns, merged

WINDOW = 8
GRAM = 5
#: A benchmark of more characters (and one for each item) is joined; an index of so many is about 60 MB.
BROADCAST_CHARS = 1 << 23
CONTAMINATED_ITEMS = 2

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.LongType())),
]


def winnow(grams: np.ndarray, at: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Which k-grams are the smallest (ties: all of them) of some `width` consecutive ones of their text.

    at holds the k-grams' first words, bounds the texts' word ranges.
    """
    n = len(grams)
    chosen = np.zeros(n, dtype=bool)
    if n < width:
        return chosen
    low = grams[: n - width + 1].copy()
    for i in range(1, width):
        np.minimum(low, grams[i : n - width + 1 + i], out=low)
    # k-grams of one text follow each other, so a window is whole if its ends are width - 1 words apart in one text
    doc = np.searchsorted(bounds, at, side="right")
    whole = doc[: n - width + 1] == doc[width - 1 :]
    for i in range(width):
        chosen[i : n - width + 1 + i] |= whole & (grams[i : n - width + 1 + i] == low)
    return chosen


@dataclass
class Index:
    """A broadcast benchmark: sorted fingerprints, sorted window hashes, and the items of each window."""

    prints: np.ndarray
    windows: np.ndarray
    first: np.ndarray  # items of window i: item[first[i]:first[i + 1]]
    item: np.ndarray
    ids: list[str]
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: the same three for whole short items


def _csr(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair = np.unique(np.rec.fromarrays([h, item], names="h,i"))
    windows, first = np.unique(pair.h, return_index=True)
    return windows, np.concatenate((first, [len(pair)])).astype(np.int64), np.asarray(pair.i, dtype=np.int64)


def index_of(ids: list[str], texts: list[str | None], window: int, gram: int, least: int = 1) -> Index:
    names = sorted(set(ids))
    number = {x: i for i, x in enumerate(names)}
    item = np.array([number[x] for x in ids], dtype=np.int64)
    w = K.words_of(K.texts_of(pa.array(texts, pa.large_string())), K.ALNUM, lower=True)
    at, h = K.windows_of(w, window)
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    gat, g = K.windows_of(w, gram)
    prints = np.unique(g[winnow(g, gat, w.bounds, window - gram + 1)])
    short = {}
    counts = w.counts()
    for n in sorted(set(counts[(counts >= max(1, least)) & (counts < window)].tolist())):
        sat, sh = K.windows_of(w, n)
        sdoc = np.searchsorted(w.bounds, sat, side="right") - 1
        own = counts[sdoc] == n
        short[n] = _csr(sh[own], item[sdoc[own]])
    return Index(prints, *_csr(h, item[doc]), names, short)


def _lookup(sorted_values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in sorted_values, -1 if it isn't there."""
    if not len(sorted_values):
        return np.full(len(h), -1, dtype=np.int64)
    i = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return np.where(sorted_values[i] == h, i, -1)


def scan(texts: K.Texts, index: Index, window: int, gram: int):
    """(n_words, n_hit, items, spans) of each text."""
    for i, j in K.blocks(texts):
        w = K.words_of(K.part(texts, i, j), K.ALNUM, lower=True)
        n = len(w.start)
        hit = np.zeros(n, dtype=bool)
        items: list[set[str]] = [set() for _ in range(j - i)]

        def mark(at, found, k, first, item):
            ok = found >= 0
            at, found = at[ok], found[ok]
            if not len(at):
                return
            np.logical_or(hit, K.covered(n, at, k), out=hit)
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            pair = np.unique(doc * len(first) + found)  # a window of one text once, however often it occurs
            for d, f in zip((pair // len(first)).tolist(), (pair % len(first)).tolist()):
                items[d].update(index.ids[x] for x in item[first[f] : first[f + 1]])

        at, h = windows_near(w, index.prints, window, gram)
        mark(at, _lookup(index.windows, h), window, index.first, index.item)
        for k, (values, first, item) in index.short.items():
            sat, sh = K.windows_of(w, k)
            mark(sat, _lookup(values, sh), k, first, item)
        for d in range(j - i):
            a, b = int(w.bounds[d]), int(w.bounds[d + 1])
            yield b - a, *_spans(hit[a:b]), sorted(items[d])


def fingerprints(w: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-grams that winnowing keeps."""
    at, g = K.windows_of(w, gram)
    kept = winnow(g, at, w.bounds, window - gram + 1)
    return at[kept], g[kept]


def windows_near(w: K.Words, prints: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that hold one of the sorted fingerprints."""
    pat, pg = fingerprints(w, window, gram)
    joined = pat[_lookup(prints, pg) >= 0]
    at, h = K.windows_of(w, window)
    if not len(joined) or not len(at):
        return at[:0], h[:0]
    near = np.unique((joined[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
    slot = _lookup(at, near)
    slot = slot[slot >= 0]
    return at[slot], h[slot]


def _spans(hit: np.ndarray) -> tuple[int, list[int]]:
    """(hit words, start and end of each maximal run of them, flat)."""
    n = int(hit.sum())
    return n, np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist() if n else []


# -- a benchmark too large to broadcast ---------------------------------------------


def _item_windows(window: int, gram: int, least: int):
    """(k, h, item): an item's windows of k words; k of 0: its fingerprints, without the item."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item").to_pylist()
            texts = K.texts_of(batch.column("text"))
            for i, j in K.blocks(texts):
                w = K.words_of(K.part(texts, i, j), K.ALNUM, lower=True)
                counts = w.counts()
                _, g = fingerprints(w, window, gram)
                g = np.unique(g)
                rows = [(np.zeros(len(g), np.int32), g, [None] * len(g))]
                for k in [window, *(n for n in range(max(1, least), window) if (counts == n).any())]:
                    at, h = K.windows_of(w, k)
                    doc = np.searchsorted(w.bounds, at, side="right") - 1
                    own = counts[doc] == k if k < window else np.ones(len(at), bool)
                    rows.append((np.full(int(own.sum()), k, np.int32), h[own], [ids[i + d] for d in doc[own].tolist()]))
                for k, h, item in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h.view(np.int64)), pa.array(item, pa.string())], names=["k", "h", "item"])

    return run


def _document_keys(window: int, gram: int, short: list[int]):
    """(a, b, k, h): a text's fingerprints (k of 0), and its windows of the short items' lengths; once each."""

    def run(batches):
        for batch in batches:
            texts = K.texts_of(batch.column("text"))
            keys = [batch.column(c) for c in ("a", "b")]
            for i, j in K.blocks(texts):
                w = K.words_of(K.part(texts, i, j), K.ALNUM, lower=True)
                for k, (at, h) in [(0, fingerprints(w, window, gram)), *((k, K.windows_of(w, k)) for k in short)]:
                    doc = np.searchsorted(w.bounds, at, side="right") - 1
                    pair = np.unique(np.rec.fromarrays([doc, h], names="d,h"))
                    d = pa.array(i + pair.d)
                    yield pa.RecordBatch.from_arrays([*(x.take(d) for x in keys), pa.array(np.full(len(pair), k, np.int32)), pa.array(np.ascontiguousarray(pair.h).view(np.int64))], names=["a", "b", "k", "h"])

    return run


def _extend(window: int, gram: int):
    """(a, b, k, h, at): the windows around a text's joined fingerprints, and its joined short ones."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c) for c in ("a", "b")]
            for row in range(batch.num_rows):
                w = K.words_of(K.texts_of(batch.column("text").slice(row, 1)), K.ALNUM, lower=True)
                joined = batch.column("joined")[row].as_py()
                by: dict[int, list[int]] = {}
                for x in joined:
                    by.setdefault(x["k"], []).append(x["h"])
                for k, hashes in by.items():
                    wanted = np.sort(np.array(hashes, dtype=np.int64).view(np.uint64))
                    if k == 0:
                        at, h = windows_near(w, wanted, window, gram)
                    else:
                        at, h = K.windows_of(w, k)
                        ok = _lookup(wanted, h) >= 0
                        at, h = at[ok], h[ok]
                    same = pa.array(np.full(len(at), row))
                    yield pa.RecordBatch.from_arrays([*(x.take(same) for x in keys), pa.array(np.full(len(at), k or window, np.int32)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int64))], names=["a", "b", "k", "h", "at"])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, window: int, gram: int, least: int) -> DataFrame:
    """docs, with the hits (at, k) and items of its text in two more columns, null without any.

    Texts are told apart by 128 bits of hash: what many documents have in common
    is joined once, and no key of a join is an item's or a document's id.
    """
    known = benchmark.mapInArrow(_item_windows(window, gram, least), "k int, h long, item string")
    windows = cut(known.distinct())
    short = sorted(r["k"] for r in windows.where((F.col("k") > 0) & (F.col("k") < window)).select("k").distinct().collect())  # under `window` numbers
    a, b, hits, items, of_a, of_b = fresh(docs, "a", "b", "hits", "items_", "of_a", "of_b")
    keyed = docs.withColumns({a: F.xxhash64(F.col(f"`{text}`")), b: F.xxhash64(F.lit("second"), F.col(f"`{text}`"))})
    texts = keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    # Semi joins of plain shuffles: AQE splits the key of a passage that a third of all documents hold.
    keys = windows.where(F.col("k") < window).select("k", "h")
    met = texts.mapInArrow(_document_keys(window, gram, short), "a long, b long, k int, h long").join(merged(keys), ["k", "h"], "left_semi")
    met = met.distinct().groupBy("a", "b").agg(F.collect_list(F.struct("k", "h")).alias("joined"))
    again = texts.groupBy("a", "b").agg(F.first("text").alias("text")).join(met, ["a", "b"])
    found = again.mapInArrow(_extend(window, gram), "a long, b long, k int, h long, at long")
    found = cut(found.join(merged(windows.where("k > 0").select("k", "h")), ["k", "h"], "left_semi"))
    where = found.groupBy("a", "b").agg(F.collect_list(F.struct("at", "k")).alias(hits))
    which = found.select("a", "b", "k", "h").distinct().join(windows.where("k > 0"), ["k", "h"]).select("a", "b", "item").distinct()
    both = where.join(which.groupBy("a", "b").agg(F.sort_array(F.collect_list("item")).alias(items)), ["a", "b"]).select(F.col("a").alias(of_a), F.col("b").alias(of_b), hits, items)
    return keyed.join(both, (F.col(a) == F.col(of_a)) & (F.col(b) == F.col(of_b)), "left").select([F.col(f"`{c}`") for c in docs.columns] + [F.col(hits), F.col(items)])


def _decontaminate_joined(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, gram: int, least: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [f.name for f in FIELDS]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in names])
    rows = _joined(docs, benchmark, text_col, window, gram, least)
    schema = T.StructType([*docs.schema.fields, *FIELDS])
    names = schema.names

    def run(batches):
        for batch in batches:
            given, found = batch.columns[:-2], batch.columns[-2].to_pylist()
            items = [x or [] for x in batch.columns[-1].to_pylist()]
            words: list[int] = []
            text = batch.column(text_col)
            for i, j in K.blocks(texts := K.texts_of(text)):
                words += K.words_of(K.part(texts, i, j), K.ALNUM, lower=True, hashes=False).counts().tolist()
            hit, spans = [], []
            for n, places in zip(words, found):
                covered = np.zeros(n, dtype=bool)
                for x in places or ():
                    covered[x["at"] : x["at"] + x["k"]] = True
                count, flat = _spans(covered)
                hit.append(count)
                spans.append(flat)
            yield pa.RecordBatch.from_arrays([*given, pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_chars: int = BROADCAST_CHARS,
    min_item_words: int = 1,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items that occur, sorted) and
    spans (start and end word of each maximal hit run, flat).

    Words are lower-cased runs of digits, letters and non-ASCII characters.  An
    item's windows are its `window` consecutive words; an item of fewer words is
    one window; its length then has no fingerprint guarantee, so all the
    document's windows of that length are looked up.  Items of fewer than
    min_item_words words match nothing.

    Edge cases: a null or empty document has no words and no hits; an item
    without words matches nothing; a null item id reads as 'null'; items that
    share an id count once; an empty benchmark gives no hits; a text of any
    length is read whole; rows are judged each on its own, whatever their ids;
    columns of docs with the names above are replaced; an empty table stays
    empty.
    """
    if not 1 <= min_item_words <= window:
        raise ValueError("min_item_words is from 1 to the window")
    items = benchmark.select(F.coalesce(F.col(f"`{item_id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    if size > broadcast_chars:
        return _decontaminate_joined(docs, items, text_col, window, gram, min_item_words)
    rows = items.collect()  # broadcast_chars characters at most
    index = docs.sparkSession.sparkContext.broadcast(index_of([r["item"] for r in rows], [r["text"] for r in rows], window, gram, min_item_words))

    def columns(text: pa.Array) -> list[pa.Array]:
        found = list(scan(K.texts_of(text), index.value, window, gram))
        n_words, n_hit, spans, hit_items = zip(*found) if found else ((), (), (), ())
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hit_items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]

    return map_columns(docs, text_col, columns, FIELDS)

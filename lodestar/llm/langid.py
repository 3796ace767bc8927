"""Language identification as inference of a mixture of languages.

A language is a smoothed distribution over byte trigrams, counted over every
training text.  A document is a mixture: expectation-maximisation estimates the
languages' proportions from its trigrams' likelihoods.  Which languages it has
is decided by penalised likelihood over nested sets: a further language must
raise the log-likelihood by more than it costs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import bounded_batches, lean, map_columns, rows_for

#: Bytes fall into 64 classes, so a trigram is one of 64**3 numbers.
GRAMS = 64**3
EM_ROUNDS = 12
#: Cost of each language beyond the first, as a multiple of BIC's log(n) / 2.
#: Trigrams overlap threefold, so their likelihoods count their evidence about three times.
PENALTY = 3.0
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Languages of a model at most: the driver and each worker hold 64**3 numbers a language, 2 MB.
MAX_LANGS = 128

CLASSES = np.zeros(256, dtype=np.int32)  # 0: any ASCII that is no letter
CLASSES[97:123] = np.arange(1, 27)
CLASSES[65:91] = np.arange(1, 27)
CLASSES[128:] = 27 + np.arange(128) % 37

FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("proportions", T.ArrayType(T.DoubleType())),
]


def grams_of(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, index of its text) of all trigrams inside one text that hold a letter.

    A text begins and ends with a non-letter, so one letter makes a trigram too.
    """
    lengths = np.diff(texts.offsets)
    n = len(texts.data) + 2 * len(texts)
    c = np.zeros(n, dtype=np.int32)
    shift = np.repeat(1 + 2 * np.arange(len(texts)), lengths)
    c[np.arange(len(texts.data)) + shift] = CLASSES[texts.data]
    if n < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    g = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
    ok = g != 0
    ends = texts.offsets[1:-1] + 2 * np.arange(1, len(texts))  # first class of the next text
    ok[ends - 1] = ok[ends - 2] = False
    at = np.flatnonzero(ok)
    doc = np.repeat(np.arange(len(texts)), lengths + 2)
    return g[at], doc[at]


class Model:
    """Languages in name order and the log-probabilities of trigrams in each."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = SMOOTHING):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs], dtype=np.float64).reshape(len(self.langs), GRAMS)
        seen = max(1, int((table.sum(axis=0) > 0).sum()))
        p = (table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * (seen + 1))
        self.p = np.ascontiguousarray(p.T)  # trigram x language

    def infer(self, gram: np.ndarray, doc: np.ndarray, docs: int, rounds: int, penalty: float):
        """(proportions, chosen) of each text, both docs x languages."""
        L = len(self.langs)
        key, count = np.unique(doc * GRAMS + gram, return_counts=True)
        d, g, c = key // GRAMS, key % GRAMS, count.astype(np.float64)
        have, start = np.unique(d, return_index=True)
        shares = np.full((docs, L), 1.0 / L)
        chosen = np.zeros((docs, L), dtype=bool)
        if not len(have):
            return shares, chosen
        total = np.add.reduceat(c, start)
        p = self.p[g]
        row = np.repeat(np.arange(len(have)), np.diff(np.concatenate((start, [len(d)]))))

        def log_likelihood(q, rows, pi, c, start):
            return np.add.reduceat(c * np.log((q * pi[rows]).sum(axis=1)), start)

        def em(q, rows, pi, c, start, total):
            for _ in range(rounds):
                w = q * pi[rows]
                w *= (c / w.sum(axis=1))[:, None]
                pi = np.add.reduceat(w, start, axis=0) / total[:, None]
            return pi

        single = np.add.reduceat(c[:, None] * np.log(p), start, axis=0)
        best = single.argmax(axis=1)
        top = single.max(axis=1)
        pick = np.zeros((len(have), L), dtype=bool)
        pick[np.arange(len(have)), best] = True
        pi = pick.astype(np.float64)
        if L > 1:
            full = em(p, row, np.full((len(have), L), 1.0 / L), c, start, total)
            value = top - 0.0
            cost = penalty * 0.5 * np.log(np.maximum(total, 2))
            ceiling = log_likelihood(p, row, full, c, start)
            # no set can beat one language where all languages together don't pay for one more
            open_ = np.flatnonzero(ceiling - cost > value)
            order = np.argsort(-full, axis=1, kind="stable")
            sizes = np.diff(np.concatenate((start, [len(d)])))
            for k in range(2, L + 1):
                if not len(open_):
                    break
                mask = np.zeros((len(open_), L), dtype=bool)
                np.put_along_axis(mask, order[open_, :k], True, axis=1)
                some = K.spread(start[open_], sizes[open_])
                sub_start = np.concatenate(([0], np.cumsum(sizes[open_])[:-1]))
                sub_row = np.repeat(np.arange(len(open_)), sizes[open_])
                begin = np.where(mask, np.maximum(full[open_], 1e-3), 0.0)
                begin /= begin.sum(axis=1, keepdims=True)
                got = em(p[some], sub_row, begin, c[some], sub_start, total[open_])
                score = log_likelihood(p[some], sub_row, got, c[some], sub_start) - (k - 1) * cost[open_]
                better = score > value[open_]
                at = open_[better]
                value[at], pi[at], pick[at] = score[better], got[better], mask[better]
                open_ = open_[ceiling[open_] - k * cost[open_] > value[open_]]
        shares[have], chosen[have] = pi, pick
        return shares, chosen


def train(rows: DataFrame, text_col: str, lang_col: str) -> Model:
    """Counts of every training text's trigrams by language: summed in each task, then in Spark.

    The driver receives at most 64**3 numbers a language.
    """

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            step = rows_for(batch.column("text"), K.BLOCK_BYTES)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                gram, doc = grams_of(K.texts_of(part.column("text")))
                names, which = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                both = np.bincount(which[doc] * GRAMS + gram, minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
                for name, row in zip(names.tolist(), both):
                    got[name] = got[name] + row if name in got else row.astype(np.int64)
        for name, row in got.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "gram", "n"])

    bounded_batches(rows.sparkSession)
    langs = rows.select(F.col(lang_col).cast("string").alias("lang")).where("lang is not null").distinct().limit(MAX_LANGS + 1).count()
    if langs > MAX_LANGS:
        raise ValueError(f"training texts have over {MAX_LANGS} languages: the column of languages is not clean")
    used = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = used.mapInArrow(lean(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    table = sums.toArrow()  # at most 64**3 rows a language
    lang = np.array(table["lang"].to_pylist(), dtype=object)
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    for name in set(lang.tolist()):
        counts[name] = np.zeros(GRAMS, dtype=np.int64)
        counts[name][gram[lang == name]] = n[lang == name]
    return Model(counts)


def predict(texts: K.Texts, model: Model, rounds: int = EM_ROUNDS, penalty: float = PENALTY):
    """(language, its proportion, languages, their proportions) of each text."""
    for i, j in K.blocks(texts):
        block = K.part(texts, i, j)
        n = j - i
        ascii_letter = np.zeros(256, dtype=np.int64)
        ascii_letter[65:91] = ascii_letter[97:123] = 1
        letters = np.concatenate(([0], np.cumsum(ascii_letter[block.data])))
        has = letters[block.offsets[1:]] > letters[block.offsets[:-1]]
        for d in np.flatnonzero(~has):
            has[d] = any(ch.isalpha() for ch in block.bytes(d).decode())
        if not model.langs:
            yield from [(UNDETERMINED, 0.0, [], [])] * n
            continue
        gram, doc = grams_of(block)
        shares, chosen = model.infer(gram, doc, n, rounds, penalty)
        best = np.where(chosen.any(axis=1), np.where(chosen, shares, -1.0).argmax(axis=1), 0)
        for d in range(n):
            if not has[d]:
                yield UNDETERMINED, 0.0, [], []
                continue
            at = np.flatnonzero(chosen[d])
            yield model.langs[best[d]], float(min(1.0, shares[d, best[d]])), [model.langs[x] for x in at], shares[d, at].tolist()


def identify(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang", rounds: int = EM_ROUNDS, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score (its proportion), langs and proportions.

    training holds labelled texts; all of them are counted.  A prediction reads
    the text alone.

    Edge cases: a null text, or one without a letter, is 'und' with score 0; so
    is every text if no labelled text exists; training rows with null text or
    language are left out; over MAX_LANGS distinct languages raise; equal
    likelihoods go to the first name; a text of any length is read whole;
    repeated rows have equal results; columns of docs with the names above are
    replaced; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training, text_col, lang_col))

    def columns(text: pa.Array) -> list[pa.Array]:
        cols = list(zip(*predict(K.texts_of(text), model.value, rounds, penalty))) or [(), (), (), ()]
        return [pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]

    return map_columns(docs, text_col, columns, FIELDS)


def held_out(id_col: str = "doc_id"):
    """The fold that training never sees: crc32 of the id as text, mod 4, is 2; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Secret scans: base patterns, and a character convolutional network in numpy.

The base patterns find secrets of known shape; those findings stay.  Beside
them every candidate (a long run of key characters, or a quoted value) is scored
by a small convolutional network over all its characters and those around it,
and those over the threshold are added with the kind 'cnn', whether a base
finding lies there too or not: the network's word on a base finding is a result.

It is trained on labelled findings: a reviewer's list if one is given, else
findings of a bounded sample of the documents themselves (values of assignments
and access keys are secrets, candidates that no base pattern touches are not,
hex runs alone are neither) and made-up ones of the shapes that no pattern
knows.  All are cut as the scan would cut them.  Scores are calibrated by
logistic scaling on findings the network has not seen, and the threshold is the
highest that keeps a required recall on them, where a secret that the scan would
not cut out counts as missed.
"""

from __future__ import annotations

import bisect
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import map_columns

KINDS = ("assign", "access", "hex", "cnn")
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE_LENGTH = 12
#: Labelled findings that the network is fitted on, at most.
MAX_LABELLED = 3000
MIN_RECALL = 0.98

#: Documents that give findings to fit on, about; those of the smallest hashes of their text.
SAMPLE_DOCS = 20_000
#: Findings longer than this are not fitted on (they are scored whole).
FIT_LENGTH = 512
QUOTED_LENGTH = 8

BEFORE, AFTER = 24, 16
CLASSES, DIM, WIDTH, FILTERS = 100, 8, 5, 16
HALF = WIDTH // 2
#: Convolution windows of one matrix, at most about; longer candidates go through in parts.
WINDOWS = 1 << 15

#: Keywords in either case (ASCII), then the assignment and its value.
ASSIGN = re.compile(
    ("(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").encode()
    + rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _chars(*ranges: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list("".join(ranges).encode())] = True
    return out


HEX = _chars(string.digits, "abcdef")
KEY = _chars(string.ascii_letters, string.digits, "+/_=-")
KEY_TEXT = string.ascii_letters + string.digits + "+/_=-"
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]+")
_HEX = re.compile(rb"[0-9a-f]+")
#: Printable ASCII without space and quotes.
_QUOTED = re.compile(rb"""["']([!#-&(-~]{%d,})(?=["'])""" % QUOTED_LENGTH)
_LOWER = bytes(K.LOWER)

FIELDS = [
    T.StructField(
        "findings",
        T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])),
    )
]


# -- the network -------------------------------------------------------------

_CLASS = np.zeros(256, dtype=np.int64)  # 0 padding, 1-95 printable ASCII, 96 white space, 97 control, 98 non-ASCII
_CLASS[1:32] = 97
_CLASS[32:127] = np.arange(1, 96)
_CLASS[127] = 97
_CLASS[128:] = 98
_CLASS[[9, 10, 11, 12, 13]] = 96


def encode(before: bytes, body: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes that the windows centred on what stands before, in and after a candidate read; body of any length."""
    before, after = before[-BEFORE:].rjust(BEFORE, b"\0"), after[:AFTER].ljust(AFTER, b"\0")
    parts = (b"\0" * HALF + before + (body + after)[:HALF], before[-HALF:] + body + after[:HALF], (before + body)[-HALF:] + after + b"\0" * HALF)
    return tuple(_CLASS[np.frombuffer(x, dtype=np.uint8)] for x in parts)


def _stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(padded matrix of classes, windows of each row)."""
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), n.max()), dtype=np.int64)
    for row, r in zip(out, rows):
        row[: len(r)] = r
    return out, n - (WIDTH - 1)


class CharCNN:
    """Embedding, convolution, ReLU; the greatest value of each filter before, in and after the candidate and its mean in it; one logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (CLASSES, DIM))
        self.embed[0] = 0
        self.conv = r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.2, 4 * FILTERS)
        self.out_bias = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _windows(self, x: np.ndarray, n: np.ndarray):
        """(what each window reads, ReLU outputs: zero beyond a row's n windows)."""
        e = self.embed[x]
        size = x.shape[1] - WIDTH + 1
        cols = np.concatenate([e[:, i : i + size] for i in range(WIDTH)], axis=2)
        y = np.maximum(cols @ self.conv + self.bias, 0)
        y *= (np.arange(size)[None, :] < n[:, None])[:, :, None]
        return cols, y

    def logits(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The network's output for each encoded candidate; those of about one length go together, long ones in parts."""
        pooled = np.zeros((len(found), 4 * FILTERS))
        for k in (0, 2):
            for i in range(0, len(found), 512):
                y = self._windows(*_stacked([f[k] for f in found[i : i + 512]]))[1]
                pooled[i : i + 512, k * FILTERS : (k + 1) * FILTERS] = y.max(axis=1)
        sizes = np.array([len(f[1]) - WIDTH + 1 for f in found], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and sizes[order[end]] * (end + 1 - at) <= WINDOWS:
                end += 1
            rows = order[at:end]
            for part in range(0, int(sizes[rows].max()), WINDOWS):
                y = self._windows(*_stacked([found[i][1][part : part + WINDOWS + WIDTH - 1] for i in rows.tolist()]))[1]
                top = pooled[rows, FILTERS : 2 * FILTERS]
                pooled[rows, FILTERS : 2 * FILTERS] = np.maximum(top, y.max(axis=1))
                pooled[rows, 3 * FILTERS :] += y.sum(axis=1) / sizes[rows, None]
            at = end
        return pooled @ self.out + self.out_bias

    def score(self, found: list) -> np.ndarray:
        """Calibrated probability that each candidate is a secret."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(found) + self.shift, -40, 40)))

    def fit(self, found: list, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> CharCNN:
        """Adam over the logistic loss with a small decay of the weights."""
        r = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out")
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        v = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(found))
            for s in range(0, len(order), batch):
                i = order[s : s + batch]
                rows = np.arange(len(i))
                seen, parts = [], []
                for k in range(3):
                    x, n = _stacked([found[j][k] for j in i.tolist()])
                    cols, out = self._windows(x, n)
                    pos = out.argmax(axis=1)
                    seen.append((x, n, cols, out, pos))
                    parts.append(np.take_along_axis(out, pos[:, None], axis=1)[:, 0])
                size = seen[1][1]
                pooled = np.concatenate([*parts, seen[1][3].sum(axis=1) / size[:, None]], axis=1)
                z = pooled @ self.out + self.out_bias
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) / len(i)
                grad = {n: decay * getattr(self, n) for n in names}
                grad["out"] = grad["out"] + pooled.T @ d
                dp = d[:, None] * self.out
                for k, (x, n, cols, out, pos) in enumerate(seen):
                    dy = np.zeros_like(out)
                    own = dp[:, k * FILTERS : (k + 1) * FILTERS]
                    np.put_along_axis(dy, pos[:, None], own[:, None], axis=1)
                    if k == 1:
                        dy += (dp[:, 3 * FILTERS :] / size[:, None])[:, None]
                    dy *= out > 0
                    grad["conv"] = grad["conv"] + np.tensordot(cols, dy, axes=([0, 1], [0, 1]))
                    grad["bias"] = grad["bias"] + dy.sum(axis=(0, 1))
                    back = dy @ self.conv.T
                    embed = np.zeros_like(self.embed)
                    for w in range(WIDTH):
                        np.add.at(embed, x[:, w : w + dy.shape[1]], back[:, :, w * DIM : (w + 1) * DIM])
                    grad["embed"] = grad["embed"] + embed
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * grad[n]
                    v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))
                self.out_bias -= rate * float(d.sum()) * 4
                self.embed[0] = 0
        return self

    def calibrate(self, found: list, y: np.ndarray, min_recall: float, missed: int = 0) -> CharCNN:
        """Logistic scaling of the logits by Newton's method, then the highest threshold with the recall.

        The targets are (n + 1) / (n + 2) and 1 / (n + 2) for n findings of a
        label, so scores of separable findings stay off 0 and 1.  missed:
        secrets beside those found that no threshold finds; if they alone are
        too many, the threshold is the lowest score of a secret.
        """
        z = self.logits(found)
        good, bad = (y > 0).sum(), (y <= 0).sum()
        target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        a, b = 1.0, 0.0
        loss = lambda a, b: (np.logaddexp(0, a * z + b) - target * (a * z + b)).sum() + 5e-3 * (a - 1) ** 2
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            w = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - target) * z).sum() + 1e-2 * (a - 1), (p - target).sum()])
            h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            move, size = np.linalg.solve(h, g), 1.0
            while size > 1e-6 and loss(a - size * move[0], b - size * move[1]) > loss(a, b):
                size /= 2
            a, b = a - size * move[0], b - size * move[1]
            if abs(size * move).max() < 1e-9:
                break
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        scores = np.sort(self.score([f for f, one in zip(found, y) if one > 0]))
        # at most (1 - recall) of the secrets may fall below
        last = max(int((1 - min_recall) * (len(scores) + missed)) - missed, 0)
        self.threshold = float(scores[last]) if len(scores) else 1.0
        return self


def labelled_findings(n: int = MAX_LABELLED, seed: int = 3) -> list[tuple[bytes, bytes, bytes, int]]:
    """(before, candidate, after, label) of n made-up findings, half of them secrets.

    No corpus at hand labels secrets, so these stand in for a reviewer's list;
    any such list can be given to scan_secrets instead.
    """
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(len(alphabet), size=k))
    alnum = string.ascii_letters + string.digits
    syllables = "the an re tion er in ou es st ing le de la que en und ch ie ción os as".split()
    onsets = "b c d f g h j k l m n p qu r s t v w z bl br ch cl cr dr fl fr gl gr kn pf ph pl pr sch sh sk sl sp spr st str sw th tr tw wh zw".split()
    vowels, codas = "a e i o u ai au ea ee ei eu ie io oo ou y".split(), ["", *"n r s t l m d g ck ch ft ght ld mp nd ng nk nt pf rd rn rt ss st tz x".split()]
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(5))

    def secret():
        kind = int(r.integers(9))
        if kind == 8:
            return chars(alnum, int(r.integers(3, 8))) + pick("!@#$%^&*?") + chars(alnum + "!@#$%^&*.?", int(r.integers(5, 16)))
        if kind == 0:
            return "AKIA" + chars(string.ascii_uppercase + string.digits, 16)
        if kind == 1:
            return chars("0123456789abcdef", pick([32, 40, 64]))
        if kind == 2:
            return pick(["ghp_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "npm_", "AIza"]) + chars(alnum, int(r.integers(20, 40)))
        if kind == 3:
            return "eyJ" + chars(alnum + "_-", int(r.integers(30, 80)))
        if kind == 4:
            return chars(alnum + "+/", int(r.integers(27, 60))) + pick(["=", "==", ""])
        if kind == 5:
            return chars(alnum, int(r.integers(20, 44)))
        if kind == 6:
            return chars(alnum + "_-", int(r.integers(16, 32)))
        return chars(string.ascii_letters, int(r.integers(16, 32)))

    def plain():
        """Digit-free text as prose and code have it."""
        kind = int(r.integers(6))
        if kind == 0:
            return pick("=-_") * int(r.integers(12, 60))
        if kind == 1:
            return pick("-_/").join(word() for _ in range(int(r.integers(3, 6))))
        if kind == 2:
            return "".join(word().capitalize() for _ in range(4))
        out, least = "", int(r.integers(CANDIDATE_LENGTH, 28))
        while len(out) < least:
            out += pick([word(), pick(onsets) + pick(vowels) + pick(codas)])
        return (out, out.capitalize(), out.upper())[kind - 3]

    def harmless():
        kind = int(r.integers(14))
        if kind == 12:
            return pick(["http://", "https://", "/"]) + ".".join(word() for _ in range(2)) + "/" + word() + pick([".html", "/", ".png", f"?id={r.integers(10**5)}"])
        if kind == 13:
            return word() + pick([";", ".", ",", ":", "|"]) + word() + pick(["()", ".", "!", ":" + word()])
        if kind > 7:
            return plain()
        if kind == 0:
            return "-".join(word() for _ in range(4)) + str(int(r.integers(100)))
        if kind == 1:
            return word() + "_" + word() + "_" + word() + str(int(r.integers(2030)))
        if kind == 2:
            return f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}-{word()}"
        if kind == 3:
            return "/".join(["", *(word() for _ in range(4)), str(int(r.integers(10**4)))])
        if kind == 4:
            return chars(string.digits, int(r.integers(12, 20)))
        if kind == 5:
            return pick("=-_") * int(r.integers(12, 40)) + str(int(r.integers(10)))
        if kind == 6:
            return word().capitalize() + word().capitalize() + word().capitalize() + word() + str(int(r.integers(1000)))
        return "+" + "-".join(chars(string.digits, k) for k in (2, 3, 4, 4))

    out = []
    for i in range(n):
        label = i % 2
        body = secret() if label else harmless()
        quoted = any(c not in KEY_TEXT for c in body)
        name = pick(["key", "token", "auth", "credential", "secret", "passwd", "id", "ref", "see", "file", "item"])
        lead = pick([f'{name} = "', f"{name}: ", f"{name}=", "Bearer ", f"export {name.upper()}=", f"{word()} ", f"({word()} "])
        mark = pick("\"'") if quoted else ""
        before, after = prose() + " " + lead.rstrip('"') + (mark or '"' * lead.endswith('"')), (mark or "") + pick(['" ', " ", ". ", ", ", "\n", '";\n']) + prose()
        out.append((before.encode(), body.encode(), after.encode(), label))
    return out


def train(findings: list[tuple[bytes, bytes, bytes, int]], min_recall: float = MIN_RECALL) -> CharCNN:
    """Fitted on two of three findings, calibrated on the third."""
    cuts = [as_scanned(b, c, a) for b, c, a, _ in findings]
    y = np.array([float(label) for *_, label in findings])
    third = np.zeros(len(cuts), dtype=bool)
    for label in (0.0, 1.0):
        third[np.flatnonzero(y == label)[2::3]] = True
    there = np.array([c is not None for c in cuts], dtype=bool)
    x = [encode(*c) if c else None for c in cuts]
    of = lambda which: [x[i] for i in np.flatnonzero(which).tolist()]
    fitted, held = ~third & there, third & there
    return CharCNN().fit(of(fitted), y[fitted]).calibrate(of(held), y[held], min_recall, int((y[third & ~there] > 0).sum()))


def as_scanned(before: bytes, body: bytes, after: bytes) -> tuple[bytes, bytes, bytes] | None:
    """The finding as the scan cuts it: the longest candidate that overlaps body, in its context; None if there is none."""
    text, lo, hi = before + body + after, len(before), len(before) + len(body)
    own = [(e - s, -s) for s, e in candidates(text) if s < hi and e > lo]
    if not own:
        return None
    n, start = max(own)
    return text[:-start], text[-start : n - start], text[n - start :]


def document_findings(docs: DataFrame, text_col: str, most: int, sample_docs: int = SAMPLE_DOCS) -> list[tuple[bytes, bytes, bytes, int]]:
    """At most `most` labelled findings, as many of each label as there are up to half, of about sample_docs documents.

    Documents and findings are taken in the order of a hash of their text, so
    the same table gives the same findings; equal findings count once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.select(text.alias("text")).where("text is not null").where(F.shiftrightunsigned(F.xxhash64("text"), 33) < int(share * 2**31))

    def harvest(batches):
        for batch in batches:
            for x in batch.column("text").to_pylist():
                text = x.encode()
                out = [(text[max(0, s - BEFORE) : s], text[s:e], text[e : e + AFTER], label) for s, e, label in labelled_candidates(text) if e - s <= FIT_LENGTH]
                for i in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000]), (pa.binary(), pa.binary(), pa.binary(), pa.int32()))], names=["before", "body", "after", "label"])

    found = rows.mapInArrow(harvest, "before binary, body binary, after binary, label int").distinct()
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("before", "body", "after"), "body", "before", "after"))).where(F.col("nth") <= most // 2)
    return [(bytes(r["before"]), bytes(r["body"]), bytes(r["after"]), r["label"]) for r in found.orderBy("nth", "label").collect()]  # `most` rows at most


# -- the scan ----------------------------------------------------------------


def base_findings(text: bytes, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base patterns; leftmost, non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_LENGTH["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_LENGTH["access"]]
    out += [(s, 2, e) for s, e in hexes or ()]
    return sorted(out)


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Spans to score, in bytes: runs of key characters, and what stands in quotes without a space."""
    own = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= CANDIDATE_LENGTH]
    quoted = [m.span(1) for m in _QUOTED.finditer(text)]
    return sorted({*own, *quoted})


def labelled_candidates(text: bytes):
    """(start, end, label) of the candidates that the base patterns say something about."""
    hexes = [m.span() for m in _HEX.finditer(text) if m.end() - m.start() >= MIN_LENGTH["hex"]]
    base = base_findings(text, hexes)
    sure = _Spans([(s, e) for s, k, e in base if k < 2])
    unsure = _Spans(hexes)
    for s, e in candidates(text):
        if sure.touch(s, e):
            yield s, e, 1
        elif not unsure.touch(s, e):
            yield s, e, 0


class _Spans:
    """Spans in order of their start, and how far those up to each reach."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.reach = list(itertools.accumulate((e for _, e in spans), max))

    def touch(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def _runs(texts: K.Texts, chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    w = K.words_of(texts, chars, hashes=False)
    long = w.end - w.start >= least
    return w.start[long], w.end[long]


def _occurrences(data: bytes, word: bytes):
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + len(word))


def scan(texts: K.Texts, model: CharCNN):
    """Findings of each text: (kind, start, end, score) in code points, by start and kind; base findings have no score."""
    for i, j in K.blocks(texts):
        block = K.part(texts, i, j)
        data = block.data.tobytes()
        low = data.translate(_LOWER)
        at = [p for k in KEYWORDS for p in _occurrences(low, k)] + list(_occurrences(data, b"AKIA"))
        hex_start, hex_end = _runs(block, HEX, MIN_LENGTH["hex"])
        run_start, run_end = _runs(block, KEY, CANDIDATE_LENGTH)
        home = lambda p: np.searchsorted(block.offsets, p, side="right") - 1
        marks = home(np.flatnonzero((block.data == 34) | (block.data == 39)))
        quotes = np.flatnonzero(np.bincount(marks, minlength=j - i) > 1)
        docs = np.unique(np.concatenate([home(np.array(at, dtype=np.int64)), home(hex_start), home(run_start), quotes]))
        found: list[list] = [[] for _ in range(j - i)]
        wanted: list[tuple[int, int, int]] = []
        for d in docs.tolist():
            a, b = int(block.offsets[d]), int(block.offsets[d + 1])
            lo, hi = np.searchsorted(hex_start, [a, b])
            found[d] = [(s, k, e, None) for s, k, e in base_findings(data[a:b], [(int(s) - a, int(e) - a) for s, e in zip(hex_start[lo:hi], hex_end[lo:hi])])]
            lo, hi = np.searchsorted(run_start, [a, b])
            own = set(zip((run_start[lo:hi] - a).tolist(), (run_end[lo:hi] - a).tolist()))
            own.update(m.span(1) for m in _QUOTED.finditer(data[a:b]))
            wanted += [(d, s, e) for s, e in sorted(own)]
        for k in range(0, len(wanted), 4096):
            some = wanted[k : k + 4096]
            x = []
            for d, s, e in some:
                a, b = int(block.offsets[d]), int(block.offsets[d + 1])
                x.append(encode(data[max(a, a + s - BEFORE) : a + s], data[a + s : a + e], data[a + e : min(b, a + e + AFTER)]))
            for (d, s, e), p in zip(some, model.score(x).tolist()):
                if p >= model.threshold:
                    found[d].append((s, 3, e, p))
        for d in range(j - i):
            if found[d]:
                raw = block.data[block.offsets[d] : block.offsets[d + 1]]
                point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                yield [(KINDS[k], int(point[s]), int(point[e]), p) for s, k, e, p in sorted(found[d], key=lambda f: f[:3])]
            else:
                yield []


def scan_secrets(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, min_recall: float = MIN_RECALL) -> DataFrame:
    """docs with findings: kind, start, end (code points, end exclusive) and, of those of the network, its score.

    labelled may hold a reviewer's findings (before, text, after, label 0/1), of
    which max_labelled rows are fitted on, those of the smallest hashes;
    otherwise max_labelled made-up ones and at most as many of the documents'
    own (see document_findings) are.

    Edge cases: a null or empty text has no findings; base findings stay
    whatever the network says; equal starts are ordered by kind as listed; a
    text and a candidate of any length are read whole; rows are judged each on
    its own, so repeated rows have equal findings; a column of docs named
    findings is replaced; an empty table stays empty (and is fitted on made-up
    findings).
    """
    spark: SparkSession = docs.sparkSession
    if labelled is None:
        rows = labelled_findings(max_labelled) + document_findings(docs, text_col, max_labelled)
    else:
        given = labelled.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "text", "after")), F.col("label").cast("int").alias("label")).where("label is not null")
        given = given.orderBy(F.xxhash64("before", "text", "after"), "text", "before", "after", "label").limit(max_labelled)
        rows = [(r["before"].encode(), r["text"].encode(), r["after"].encode(), r["label"]) for r in given.collect()]
    model = spark.sparkContext.broadcast(train(rows, min_recall))

    def columns(text: pa.Array) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return [pa.array([[dict(zip(("kind", "start", "end", "score"), f)) for f in fs] for fs in scan(K.texts_of(text), model.value)], kind)]

    return map_columns(docs, text_col, columns, FIELDS)

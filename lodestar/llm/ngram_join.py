"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word n-grams ("tokens").  Two documents
link when their Jaccard similarity reaches a percentage.  The join is exact:

1. Documents of one set are one class; its smallest id stands for it.
2. A token that no other class has can't be shared.  Chunks of classes send
   each distinct token hash once, packed by hash range; one bit a token comes
   back.  A class whose shared tokens are under the percentage of its set
   links with nothing and is done; most end here.
3. The others are partitioned into groups of similar documents (the smallest
   token hash, split where a group holds many tokens).  A group is one row with
   its members' tokens and their union.  The matrix has a row for each token and
   group, limited to the tokens of some member's prefix: in one order of all
   tokens, rare ones first, two linked sets share a token within both prefixes.
4. A document asks the groups that the matrix gives for its prefix.  It travels
   to a group, where its overlap with the group's union is bound first; only if
   that allows the percentage is the group opened and intersections counted.
   What is found returns as stars, not as links.
5. This goes in two turns.  In the first a group is compared within itself, and
   each token's documents ask one of its groups, so the members of a large
   cluster meet in few steps.  Components are then known, and in the second turn
   a document asks a group only if they may belong to different ones: groups
   that a token finds in one component are one row, and of two rows the one with
   fewer documents asks.
6. Components come from contraction: every node that has a smaller neighbour
   goes into it, until no edge is left.

Hot groups stay bounded: equal sets are one class before anything is compared,
a group and those that ask it are cut by token count, and a cluster in many
groups is linked through one of them, not in all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bounded_batches, cut, keyed_text, lean, lean_pair, merged, partitions_for
from .substring_dedup import BUCKETS_EACH, CHUNKS_EACH, _bucket, _pack, _unpack

SHINGLE = 4
PERCENT = 85
#: Shared tokens of one group of the matrix, at most about (8 bytes each).
GROUP_TOKENS = 1 << 16
#: Documents of one group, at most about.
GROUP_DOCS = 256
#: Counters of the fixed-size sketch that orders tokens by frequency.
SKETCH = 1 << 18
SLICES = 64
#: Tokens of the documents that ask a group together, and those documents, at most about.
ASKED_TOKENS = 1 << 17
ASKED_DOCS = 256
#: Rows equal in id and text beyond which they are made one before texts are placed.
REPEATED_ROWS = 64


def token_sets(texts: K.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): each text's distinct token hashes in order, tokens[bounds[i]:bounds[i + 1]].

    A text of fewer than `size` words, but not none, has its whole sequence as its one token.
    """
    parts, counts = [], []
    for i, j in K.blocks(texts):
        w = K.words_of(K.part(texts, i, j), K.SPACED, lower=True)
        at, h = K.windows_of(w, size)
        doc = np.searchsorted(w.bounds, at, side="right") - 1
        n = w.counts()
        for k in range(1, size):
            if (n == k).any():
                sat, sh = K.windows_of(w, k)
                sdoc = np.searchsorted(w.bounds, sat, side="right") - 1
                own = n[sdoc] == k
                doc, h = np.concatenate([doc, sdoc[own]]), np.concatenate([h, sh[own]])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        parts.append(h[new])
        counts.append(np.bincount(doc[new], minlength=j - i))
    z = np.zeros(0, np.uint64)
    return np.concatenate([z, *parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts])))).astype(np.int64)


def _segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its tokens."""
    a = K.mix(_segment_sum(K.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), bounds))
    b = K.mix(_segment_sum(K.mix(tokens + np.uint64(0x14057B7EF767814F)), bounds))
    return a.view(np.int64), b.view(np.int64)


def _describe(size: int):
    def describe(batches):
        for batch in batches:
            tokens, bounds = token_sets(K.texts_of(batch.column("text")), size)
            a, b = _fingerprints(tokens, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.diff(bounds), pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "h", "n", "fa", "fb"])

    return describe


def _column(table: pa.Table, name: str):
    column = table[name]
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _standing(docs: pa.Table, others: pa.Table, size: int):
    """The classes of a chunk: (ids, tokens, bounds), one document each, in id and fingerprint order."""
    reps = others.filter(pc.is_valid(others["fa"]))
    want = set(zip(reps["doc_id"].to_pylist(), reps["fa"].to_pylist()))
    ids = _column(docs, "doc_id")
    ids_list = ids.to_pylist()
    wanted_ids = {x for x, _ in want}
    at = np.array([i for i, x in enumerate(ids_list) if x in wanted_ids], dtype=np.int64)
    texts = K.texts_of(_column(docs, "text").take(pa.array(at)))
    tokens, bounds = token_sets(texts, size)
    fa, _ = _fingerprints(tokens, bounds)
    first: dict[tuple, int] = {}
    for i, (row, f) in enumerate(zip(at.tolist(), fa.tolist())):
        key = (ids_list[row], f)
        if key in want:
            first.setdefault(key, i)
    keep = np.array([first[k] for k in sorted(first, key=lambda k: (-(2**63) if k[0] is None else k[0], k[1]))], dtype=np.int64)
    n = np.diff(bounds)[keep] if len(keep) else np.zeros(0, np.int64)
    own = tokens[K.spread(bounds[:-1][keep], n)] if len(keep) else tokens[:0]
    return [ids_list[at[i]] for i in keep.tolist()], own, np.concatenate(([0], np.cumsum(n))).astype(np.int64)


def _send(size: int, buckets: int):
    def send(docs: pa.Table, others: pa.Table) -> pa.Table:
        _, tokens, _ = _standing(docs, others, size)
        h = np.unique(tokens)
        edges = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        used = [b for b in range(buckets) if edges[b + 1] > edges[b]]
        return pa.table([pa.array([chunk] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([_pack(h[edges[b] : edges[b + 1]]) for b in used], pa.binary())], names=["chunk", "bucket", "hashes"])

    return send


def _mark(batches):
    """Of each hash of a bucket, whether two chunks have it."""
    got: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for c, b, blob in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("hashes")):
            got.setdefault(b, []).append((c, _unpack(blob.as_buffer())))
    for b in sorted(got):
        rows = sorted(got.pop(b), key=lambda r: r[0])
        h = np.concatenate([r[1] for r in rows])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        shared = np.zeros(len(h), dtype=bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        edges = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
        out = [(r[0], b, e - s, np.packbits(shared[s:e]).tobytes()) for r, s, e in zip(rows, edges[:-1], edges[1:]) if shared[s:e].any()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["chunk", "bucket", "m", "bits"])


def _survive(size: int, buckets: int, percent: int):
    def survive(docs: pa.Table, others: pa.Table) -> pa.Table:
        ids, tokens, bounds = _standing(docs, others, size)
        distinct, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = count > 1
        edges = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
        marks = others.filter(pc.is_valid(others["bits"]))
        for b, m, bits in zip(marks["bucket"].to_pylist(), marks["m"].to_pylist(), marks["bits"].to_pylist()):
            if m != edges[b + 1] - edges[b]:
                raise RuntimeError("a chunk's tokens changed between two reads of the input")
            shared[edges[b] : edges[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
        is_shared = shared[inverse]
        n = np.diff(bounds)
        have = _segment_sum(is_shared.astype(np.int64), bounds)
        stay = np.flatnonzero((100 * have >= percent * n) & (n > 0))
        blobs = [tokens[bounds[i] : bounds[i + 1]][is_shared[bounds[i] : bounds[i + 1]]].tobytes() for i in stay.tolist()]
        return pa.table([pa.array([ids[i] for i in stay.tolist()], pa.int64()), pa.array(n[stay], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "tokens"])

    return survive


def _sketch(batches):
    """Counters of one task's tokens, in slices."""
    total = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        for blob in batch.column("tokens"):
            np.add.at(total, (np.frombuffer(blob.as_buffer(), np.uint64) % np.uint64(SKETCH)).astype(np.int64), 1)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(SLICES, -1)], pa.binary())], names=["slice", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table([pa.array([table["slice"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def _prefixes(shared_sketch, percent: int):
    """(token, gid, doc_id, n) for the prefix tokens of each document."""

    def prefixes(batches):
        counts = shared_sketch.value
        for batch in batches:
            found, docs = [], []
            for row, (n, blob) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens"))):
                t = np.frombuffer(blob.as_buffer(), np.uint64)
                # of the whole set's first n - ceil(n * percent / 100) + 1 tokens, the n - len(t) unshared ones come first
                take = n - -(-n * percent // 100) + 1 - (n - len(t))
                order = np.lexsort((t, counts[(t % np.uint64(SKETCH)).astype(np.int64)]))[: max(0, take)]
                found.append(t[order].view(np.int64))
                docs.append(np.full(len(order), row))
            if found:
                at = pa.array(np.concatenate(docs))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(batch.column(c).take(at) for c in ("gid", "doc_id", "n"))], names=["token", "gid", "doc_id", "n"])

    return prefixes


def _bundle(table: pa.Table) -> pa.Table:
    """One row for a group: its documents, their sizes and tokens, and the union of the tokens."""
    table = table.sort_by("doc_id")
    blobs = table["tokens"].to_pylist()
    tokens = b"".join(blobs)
    union = np.unique(np.frombuffer(tokens, np.uint64)).tobytes()
    return pa.table(
        [pa.array([table["gid"][0].as_py()], pa.int64()), pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())), pa.array([table["n"].to_pylist()], pa.list_(pa.int64())), pa.array([[len(b) // 8 for b in blobs]], pa.list_(pa.int64())), pa.array([tokens], pa.binary()), pa.array([union], pa.binary())],
        names=["gid", "ids", "sizes", "lengths", "tokens", "union"],
    )


class Group:
    def __init__(self, ids, sizes, lengths, tokens: bytes):
        self.ids = ids
        self.n = np.array(sizes, dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.tokens = np.frombuffer(tokens, np.uint64)

    def take(self, rows: np.ndarray) -> Group:
        g = Group.__new__(Group)
        lengths = np.diff(self.bounds)[rows]
        g.ids, g.n = [self.ids[i] for i in rows.tolist()], self.n[rows]
        g.tokens = self.tokens[K.spread(self.bounds[:-1][rows], lengths)]
        g.bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        return g

    def bound(self, union: np.ndarray, percent: int) -> np.ndarray:
        """Members whose overlap with a token union allows the similarity with some set within it."""
        i = np.minimum(np.searchsorted(union, self.tokens), max(0, len(union) - 1))
        inside = (union[i] == self.tokens) if len(union) else np.zeros(len(self.tokens), bool)
        return np.flatnonzero(100 * _segment_sum(inside.astype(np.int64), self.bounds) >= percent * self.n)


def intersections(a: Group, b: Group) -> np.ndarray:
    """Sizes of all intersections of members of a and b.

    Tokens that many members have are counted by a matrix product, the others by listing who has them.
    """
    na, nb = len(a.n), len(b.n)
    out = np.zeros(na * nb, dtype=np.int64)
    common = np.intersect1d(a.tokens, b.tokens)
    if not len(common):
        return out.reshape(na, nb)

    def sides(g):
        i = np.minimum(np.searchsorted(common, g.tokens), len(common) - 1)
        ok = common[i] == g.tokens
        row = np.repeat(np.arange(len(g.n)), np.diff(g.bounds))[ok]
        col = i[ok]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        return row, col, np.searchsorted(col, np.arange(len(common) + 1))

    (ra, ca, ea), (rb, cb, eb) = sides(a), sides(b)
    ka, kb = np.diff(ea), np.diff(eb)
    work = ka * kb
    heavy = work * 16 >= na * nb
    hot = np.flatnonzero(heavy)
    for s in range(0, len(hot), 4096):
        cols = hot[s : s + 4096]
        x, y = np.zeros((na, len(cols)), np.float32), np.zeros((nb, len(cols)), np.float32)
        x[ra[K.spread(ea[cols], ka[cols])], np.repeat(np.arange(len(cols)), ka[cols])] = 1
        y[rb[K.spread(eb[cols], kb[cols])], np.repeat(np.arange(len(cols)), kb[cols])] = 1
        out += (x @ y.T).astype(np.int64).ravel()
    light = np.flatnonzero(~heavy)
    ends = np.cumsum(work[light])
    at = 0
    while at < len(light):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), side="right")))
        cols = light[at:end]
        # every row of a that has the token, repeated for each row of b that has it
        left = ra[K.spread(ea[cols], ka[cols])]
        each = np.repeat(kb[cols], ka[cols])
        right = rb[K.spread(np.repeat(eb[cols], ka[cols]), each)]
        np.add.at(out, np.repeat(left, each) * nb + right, 1)
        at = end
    return out.reshape(na, nb)


def stars(a: Group, b: Group, percent: int, same: bool) -> list[tuple[int, int]]:
    """(document, smallest document of its component) over the links between a and b."""
    if not same and not (len(a.n) and len(b.n)):
        return []
    common = intersections(a, b)
    link = 100 * common >= percent * (a.n[:, None] + b.n[None, :] - common)
    if same:
        np.fill_diagonal(link, False)
    out, left, right = [], np.ones(len(a.n), bool), np.ones(len(b.n), bool)
    if same:
        right = left
    for start in np.flatnonzero(link.any(axis=1)).tolist():
        if not left[start]:
            continue
        members, front, side = [], np.array([start]), 0
        left[start] = False
        while len(front):
            members += [(a if side == 0 else b).ids[i] for i in front.tolist()]
            if same:
                reach = link[front].any(axis=0) & left
                left[reach] = False
            elif side == 0:
                reach = link[front].any(axis=0) & right
                right[reach] = False
            else:
                reach = link[:, front].any(axis=1) & left
                left[reach] = False
            front, side = np.flatnonzero(reach), (0 if same else 1 - side)
        least = min(members)
        out += [(x, least) for x in members if x != least]
    return out


def _open(percent: int):
    def open_(groups: pa.Table, asking: pa.Table) -> pa.Table:
        """Links of a group's members with the documents that ask it, and, in its first slice, among themselves."""
        got: list[tuple[int, int]] = []
        if groups.num_rows:
            r = groups.slice(0, 1).to_pylist()[0]
            own = Group(r["ids"], r["sizes"], r["lengths"], r["tokens"])
            if r["within"]:
                got += stars(own, own, percent, True)
            if asking.num_rows:
                blobs = asking["tokens"].to_pylist()
                some = Group(asking["doc_id"].to_pylist(), asking["n"].to_pylist(), [len(b) // 8 for b in blobs], b"".join(blobs))
                some = some.take(some.bound(np.frombuffer(r["union"], np.uint64), percent))
                if len(some.n):  # the group is opened
                    got += stars(some, own.take(own.bound(np.unique(some.tokens), percent)), percent, False)
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["u", "v"])

    return open_


def _answers(asks: DataFrame, grouped: DataFrame, bundles: DataFrame, percent: int, within: bool) -> DataFrame:
    """Edges (u, v) between documents and the groups they ask (doc_id, asked); within: also inside of each group."""
    told = asks.join(grouped.select("doc_id", "n", "tokens"), "doc_id")
    many = told.groupBy("asked").agg(F.greatest(F.ceil(F.sum(F.octet_length("tokens") / 8) / ASKED_TOKENS), F.ceil(F.count("*") / ASKED_DOCS)).cast("int").alias("slices"))
    many = cut(many)
    told = told.join(many, "asked").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.greatest("slices", F.lit(1))).cast("int"))
    opened = bundles.join(many, bundles["gid"] == many["asked"], "left" if within else "inner").drop("asked")
    opened = opened.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("slices", F.lit(1)), F.lit(1)) - 1)))
    opened = opened.withColumn("within", F.lit(within) & (F.col("slice") == 0) & (F.size("ids") > 1)).drop("slices")
    told = told.select(F.col("asked").alias("gid"), "slice", "doc_id", "n", "tokens")
    return cut(opened.groupBy("gid", "slice").cogroup(told.groupBy("gid", "slice")).applyInArrow(_open(percent), "u long, v long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (u, v).

    Every node that has a smaller neighbour goes into the smallest of them, and
    on into what that goes into (pointer jumping); edges between what is left
    make the next round.  Nodes go once, so rounds are few, and no join gathers
    a component: its nodes are partially aggregated, or one side of a join whose
    other side has a row a key.
    """
    left = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    left = cut(left)
    found = None
    while not left.isEmpty():
        into = cut(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))
        while True:
            up = into.select(F.col("node").alias("component"), F.col("component").alias("top"))
            new = cut(into.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")))
            into = new.select("node", "component")
            if new.where("moved").isEmpty():
                break
        to = lambda c: into.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
        moved = left.join(to("u"), "u").join(to("v"), "v", "left").select("u_", F.coalesce("v_", "v").alias("v_"))
        left = cut(moved.select(F.greatest("u_", "v_").alias("u"), F.least("u_", "v_").alias("v")).where("u <> v").distinct())
        if found is not None:
            up = into.select(F.col("node").alias("component"), F.col("component").alias("top"))
            found = cut(found.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")).unionAll(into))
        else:
            found = into
    if found is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionAll(roots)


def _second_turn(prefixes: DataFrame, known: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """What documents ask once components are known: (doc_id, asked)."""
    labelled = prefixes.join(known.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = cut(labelled.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token"))
    rows = cut(labelled.join(mixed, "token", "left_semi"))
    # A group in which the token finds one component, or a group of several.
    of_group = rows.groupBy("token", "gid").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("docs"))
    pure = F.col("a") == F.col("b")
    of_group = cut(of_group.select("token", "gid", pure.alias("pure"), F.when(pure, F.col("a")).otherwise(F.col("gid")).alias("id"), "lo", "hi", "docs"))
    sides = cut(of_group.groupBy("token", "pure", "id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("docs").alias("docs"), F.collect_list("gid").alias("gids")))
    other = sides.select("token", *(F.col(c).alias(f"{c}_b") for c in ("pure", "id", "lo", "hi", "docs", "gids")))
    fits = (100 * F.col("hi") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo"))
    smaller = (F.col("docs") < F.col("docs_b")) | ((F.col("docs") == F.col("docs_b")) & (F.struct("pure", "id") < F.struct("pure_b", "id_b")))
    pairs = sides.join(other, "token").where(fits & smaller).select("token", "pure", "id", F.explode("gids_b").alias("asked"))
    askers = rows.select("token", "gid", "doc_id").join(merged(of_group.select("token", "gid", "pure", "id")), ["token", "gid"])
    asks = askers.join(merged(pairs), ["token", "pure", "id"]).where("gid <> asked").select("doc_id", "asked").distinct()
    return cut(asks.join(merged(asked), ["doc_id", "asked"], "left_anti"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.

    Edge cases: a null or empty text, or one of white space, has an empty set
    and is its own component; a shorter text than `shingle` words has one
    token; rows that share an id count as linked, empty ones aside; a null id
    is one such id, counts as the smallest and is null in the result; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed_text(docs, id_col, text_col)
    n = partitions_for(rows)
    buckets, chunks = BUCKETS_EACH * n, CHUNKS_EACH * n
    least = F.lit(-(2**63)).cast("long")
    # null ids take the smallest long inside
    rows = rows.select(F.coalesce("doc_id", least).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    each = cut(rows.mapInArrow(lean(_describe(shingle)), "doc_id long, h long, n long, fa long, fb long"))
    classes = each.where("n > 0").groupBy("fa", "fb", "n").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("fa", "fb", "n", "first.*")
    # A chunk is a part of the hash of id and text, so an id that many rows share is no chunk's alone.
    chunk_of = F.pmod(F.xxhash64("doc_id", "h"), F.lit(chunks)).cast("int").alias("chunk")
    if not each.groupBy("doc_id", "h").count().where(F.col("count") > REPEATED_ROWS).isEmpty():
        rows = rows.dropDuplicates(["doc_id", "h"])
    placed = rows.select(chunk_of, "doc_id", "text").repartition(n, "chunk")
    reps = classes.select(chunk_of, "doc_id", "fa", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("binary").alias("bits"))
    sent = placed.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(lean_pair(_send(shingle, buckets)), "chunk int, bucket int, hashes binary")
    marks = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(_mark), "chunk int, bucket int, m long, bits binary")
    marks = marks.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("fa"), "bucket", "m", "bits")
    survivors = placed.groupBy("chunk").cogroup(reps.union(marks).groupBy("chunk")).applyInArrow(lean_pair(_survive(shingle, buckets, percent)), "doc_id long, n long, tokens binary")
    survivors = cut(survivors)

    counts = survivors.mapInArrow(_sketch, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    table = np.zeros((SLICES, SKETCH // SLICES), dtype=np.int64)
    for r in counts.collect():  # SLICES rows of a fixed size
        table[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    sketch = spark.sparkContext.broadcast(table.ravel())

    # groups of similar documents: by their smallest token, cut by token count
    keyed = survivors.select("doc_id", "n", "tokens", F.xxhash64(F.substring("tokens", 1, 8)).alias("least"))
    sizes = keyed.groupBy("least").agg(F.greatest(F.ceil(F.sum(F.octet_length("tokens") / 8) / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_DOCS)).alias("parts"))
    grouped = keyed.join(sizes, "least").select("doc_id", "n", "tokens", F.xxhash64("least", F.pmod(F.xxhash64("doc_id"), F.greatest("parts", F.lit(1)))).alias("gid"))
    grouped = cut(grouped)
    bundles = cut(grouped.groupBy("gid").applyInArrow(_bundle, "gid long, ids array<long>, sizes array<long>, lengths array<long>, tokens binary, union binary"))
    prefixes = cut(grouped.select("gid", "doc_id", "n", "tokens").mapInArrow(lean(_prefixes(sketch, percent)), "token long, gid long, doc_id long, n long"))
    # The first turn: all of a token's documents ask the first of its groups.
    first = cut(prefixes.groupBy("token").agg(F.min("gid").alias("asked"), F.max("gid").alias("last")).where("asked <> last").select("token", "asked"))
    asked = cut(prefixes.join(first, "token").where("gid <> asked").select("doc_id", "asked").distinct())
    known = cut(components(_answers(asked, grouped, bundles, percent, True)))
    # The second: who may still belong together and has not met.
    asks = _second_turn(prefixes, known, asked, percent)
    links = _answers(asks, grouped, bundles, percent, False)
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    tops = components(links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v")))
    tops = cut(tops.select(F.col("node").alias("component"), F.col("component").alias("top")))
    comp = known.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    comp = comp.unionAll(tops.select(F.col("component").alias("node"), F.col("top").alias("component")).join(known, "node", "left_anti"))

    of_class = classes.join(comp.select(F.col("node").alias("doc_id"), F.col("component")), "doc_id", "left").select("fa", "fb", "n", F.coalesce("component", "doc_id").alias("component"))
    of_class = cut(of_class)  # so the caller's plan, which runs all its shuffles at once, has one join of this operator
    # Empty documents are in no class; they stay out of the join, where they would meet in one key.
    out = each.where("n > 0").join(merged(of_class), ["fa", "fb", "n"]).select("doc_id", "n", "component")
    out = out.union(each.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    back = lambda c: F.when(F.col(c) != least, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"))

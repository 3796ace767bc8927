"""Joins, dedup and decontamination against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.ngram_join import jaccard_components
from lodestar.llm.substring_dedup import Chunks, substring_dedup
from tests.llm import brute

VOCAB = "a b c d e f g h The THE é ß x, y. 漢字".split()


def made_up(seed, n=60):
    """Random texts, copies, near copies, nulls, empties, shared passages and one long text."""
    r = random.Random(seed)
    words = lambda k: [r.choice(VOCAB) + str(r.randrange(30)) for _ in range(k)]
    passage, base = words(30), words(80)
    texts = [None, "", "   \n\t", "one", "one two three", "ONE two three", " ".join(words(6000))]
    for i in range(n):
        w = list(base) if i % 3 == 0 else words(r.randrange(1, 60))
        if i % 3 == 0:
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(VOCAB) + "new"
        if i % 4 == 1:
            at = r.randrange(len(w))
            w[at:at] = passage
        texts.append(r.choice([" ", "\n", "  "]).join(w))
    texts += r.sample(texts, 10)
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_jaccard(documents, seed, k, percent):
    rows = made_up(seed)
    got = sorted(map(tuple, jaccard_components(documents(rows, ["component_id", "n"]), shingle=k, percent=percent).collect()))
    assert got == brute.jaccard_components(rows, k, percent)


def test_jaccard_chain_of_links(documents):
    """Neighbours link, ends don't: one component through all."""
    words = [f"w{i}" for i in range(140)]
    rows = [(100 - i, " ".join(words[2 * i : 2 * i + 60])) for i in range(30)]
    got = sorted(map(tuple, jaccard_components(documents(rows)).collect()))
    assert got == brute.jaccard_components(rows, 4, 85)
    assert {c for *_, c in got} == {71}


def test_jaccard_hot_group(documents, monkeypatch):
    """A third of all rows are near copies; groups are cut small, and no link is lost."""
    from lodestar.llm import ngram_join

    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 256)
    r = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(90)] = f"n{r.randrange(10)}"
        rows.append((i, " ".join(w) if i % 3 == 0 else " ".join(f"u{r.randrange(10**6)}" for _ in range(30))))
    got = sorted(map(tuple, jaccard_components(documents(rows)).collect()))
    assert got == brute.jaccard_components(rows, 4, 85)


def test_substrings_of_an_id_of_many_rows(documents):
    """A third of all rows has no id, another one id; texts of one id are ordered by their hash."""
    import xxhash

    r = random.Random(6)
    words = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(30))) for _ in range(120)]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(words)]
    chunks = Chunks([4.0, 60.0], {-(2.0**63): 5, 5.0: 4})
    h = {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in words}
    order = sorted(rows, key=lambda x: (-(2**63) if x[0] is None else x[0], h[x[1]], x[1]))
    of = chunks.of(np.array([-(2**63) if i is None else i for i, _ in order]), np.array([h[t] for _, t in order], np.uint64).view(np.int64))
    assert (np.diff(of) >= 0).all() and of.max() == 13 and len(set(of.tolist())) >= 10
    numbered = {(i, t): k for k, (i, t) in enumerate(order)}
    want = sorted((k, n, gone, kept) for k, n, gone, kept in brute.repeated_windows([(numbered[x], x[1]) for x in rows], 4))
    got = substring_dedup(documents(rows), window=4).collect()
    assert sorted((x["n_words"], x["n_removed"], x["kept"]) for x in got) == sorted(x[1:] for x in want)


def test_jaccard_repeated_rows_and_one_id(documents, monkeypatch):
    """A third of all rows is one row, another third shares its id."""
    from lodestar.llm import ngram_join

    monkeypatch.setattr(ngram_join, "REPEATED_ROWS", 5)
    r = random.Random(9)
    text = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(20))
    same = text()
    rows = [(7, same)] * 30 + [(7, text()) for _ in range(30)] + [(100 + i, text()) for i in range(29)] + [(3, same)]
    got = {}
    for d in jaccard_components(documents(rows)).collect():
        got.setdefault(d["doc_id"], []).append(d["component_id"])
    assert len(got.pop(7)) == 60 and got.pop(3) == [3] and all(v == [k] for k, v in got.items())


def test_jaccard_nulls_and_repeated_ids(documents):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, None), (2, "q w e r t y"), (2, "q w e r t y")]
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(rows)).collect())
    assert got == [(False, None, 2, None), (True, 1, 0, 1), (True, 1, 2, None), (True, 2, 3, 2), (True, 2, 3, 2)]


@pytest.mark.parametrize("seed, k", [(1, 20), (2, 5), (3, 1)])
def test_substrings(documents, seed, k):
    rows = made_up(seed)
    got = sorted(map(tuple, substring_dedup(documents(rows, ["kept", "chunk"]), window=k).collect()))
    assert got == sorted(brute.repeated_windows(rows, k))


def test_substrings_within_a_document_and_repeated_rows(documents):
    w = " ".join("abcdefghij")
    rows = [(1, f"{w} {w} {w}"), (2, None), (3, w), (3, w)]
    got = sorted(map(tuple, substring_dedup(documents(rows), window=10).collect()))
    assert got == sorted(brute.repeated_windows(rows, 10))


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 4), (3, 8), (4, 20)])
def test_lines(documents, seed, least):
    r = random.Random(seed)
    lines = ["", "", " ", "one", "a b", "two words", "of three words", "this has four words", "a longer line of seven words here", "the longest line of them all, with as many as eleven"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 24)))) for i in range(-5, 40)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, rows[3][1]), (54, rows[3][1])]
    got = line_dedup(documents(rows, ["kept", "runs", "of", "own", "found", "FOUND_"]), min_words=least)
    assert {"runs", "of", "own", "found", "FOUND_"} <= set(got.columns)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "n_runs", "kept").collect())) == sorted(brute.repeated_lines(rows, least))


def test_lines_of_equal_rows_are_one_document(documents):
    line = "a line of as many words as it takes"
    rows = [(1, f"{line}\nb\nc")] * 3 + [(2, f"{line}\nb\nz"), (None, "q"), (None, "q")]
    got = sorted(map(tuple, line_dedup(documents(rows)).select("doc_id", "n_removed").collect()), key=str)
    assert got == [(1, 0)] * 3 + [(2, 2)] + [(None, 0)] * 2
    with pytest.raises(ValueError):
        line_dedup(documents(rows), min_words=0)


def test_long_runs_of_short_lines_and_a_hot_blank_line(documents, spark):
    """Runs of 40 lines need ranks of 32 lines; the blank line is a third of all, and beside it everything else."""
    r = random.Random(8)
    short = [f"w{i}" for i in range(30)]
    run = [r.choice(short) if i % 2 else "" for i in range(90)]
    rows = [(i, "\n".join([f"only {i}", *run[r.randrange(8) : r.randrange(70, 90)], "", f"{r.random()}", "", f"last {i}"])) for i in range(40)]
    got = sorted(map(tuple, line_dedup(documents(rows), min_words=20).select("doc_id", "n_lines", "n_removed", "n_runs", "kept").collect()))
    assert got == brute.repeated_lines(rows, 20)
    assert sum(x[2] for x in got) > 1500


@pytest.mark.parametrize("seed, broadcast_chars", [(1, 1 << 20), (2, 1 << 20), (2, 0), (3, 0)])
def test_decontamination(spark, documents, seed, broadcast_chars):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 60])] + [(90, None), (91, ""), (92, "!!"), (93, "w1 W2 w3 w4 w5 w6 w7 w8 w9"), (93, "w9 w8")]
    rows = [(1, None), (2, ""), (3, "W1, w2; w3 w4 w5 w6 w7 w8")]
    for i in range(10, 60):
        w = text(r.randrange(1, 80)).split()
        if i % 2:
            chunk = (r.choice(items)[1] or "").split()
            at = r.randrange(len(w) + 1)
            w[at:at] = chunk[r.randrange(3) : 15]
        rows.append((i, " ".join(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in decontaminate(documents(rows, ["items", "spans", "a", "hits", "of_a", "b"]), benchmark, broadcast_chars=broadcast_chars).collect()}
    assert got == {i: brute.contamination(t, items, 8) for i, t in rows}


@pytest.mark.parametrize("broadcast_chars", [1 << 20, 0])
def test_decontamination_spans_and_edges(spark, documents, broadcast_chars):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i"), (None, "k l")], "item_id long, text string")
    rows = [(1, "x A B C D E F G H I x k l"), (1, "x A B C D E F G H I x k l"), (None, "k l"), (7, None), (8, "q " * 50_000 + "k l")]
    got = decontaminate(documents(rows), benchmark, broadcast_chars=broadcast_chars).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["spans"], r["items"]) for r in got), key=str)
    assert found == sorted([(1, 13, [1, 10, 11, 13], ["1", "null"])] * 2 + [(None, 2, [0, 2], ["null"]), (7, 0, [], []), (8, 50_002, [50_000, 50_002], ["null"])], key=str)
    few = decontaminate(documents(rows), benchmark, broadcast_chars=broadcast_chars, min_item_words=3).where("n_hit > 0").collect()
    assert [(r["doc_id"], r["items"]) for r in few] == [(1, ["1"])] * 2
    assert decontaminate(documents([(1, "a b c")]), benchmark.limit(0), broadcast_chars=broadcast_chars).first()["items"] == []
    assert decontaminate(documents([]), benchmark, broadcast_chars=broadcast_chars).count() == 0
    with pytest.raises(ValueError):
        decontaminate(documents([]), benchmark, min_item_words=9)


def test_the_joined_benchmark_leaves_the_driver_alone(spark, documents, monkeypatch):
    """Above the bound nothing of the benchmark is collected or broadcast but its short lengths."""
    from lodestar.llm import decontaminate as module

    monkeypatch.setattr(module, "index_of", None)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(3000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(documents([(5, "so " + items[77][1]), (6, "clean")]), benchmark, broadcast_chars=10_000).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in got) == [(5, 30, ["77"]), (6, 0, [])]


@pytest.mark.parametrize("op", [jaccard_components, substring_dedup, line_dedup])
def test_empty_tables(documents, op):
    assert op(documents([])).count() == 0


def test_registered_queries_match_sql(spark, sf_dir):
    from lodestar.llm.queries import ORACLES, QUERIES
    from tests.compare import assert_same

    for name in ORACLES:
        assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


def test_digests_of_registered_queries(spark, sf_dir):
    import hashlib

    from lodestar.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = sorted((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute.repeated_windows(list(docs.items()), 20))
    assert sorted(map(tuple, QUERIES["op10_substring_dedup"](spark, sf_dir).collect())) == expected
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in QUERIES["op2_decontaminate"](spark, sf_dir).collect():
        n, hit, got = brute.contamination(docs[r["doc_id"]], items, 8)
        assert tuple(r)[1:] == (n, hit, len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), len(got) >= 2)
    got = sorted(map(tuple, QUERIES["op1_ngram_jaccard_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute.jaccard_components(list(docs.items()), 4, 85)

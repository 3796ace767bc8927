"""The pipeline's stages against plain versions, on a small fixture."""

import base64
import hashlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from lodestar.llm.common import written
from lodestar.plans import explain
from tests.llm import brute
from tests.test_checkpoints import _grouped, _shuffles, _within


def test_run(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = src.limit(120).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(5).collect()]
    rows = [tuple(r) for r in docs]
    one_line = max((r[1] for r in rows), key=len)[:3000].replace("\n", " ")
    near = one_line.split(" ")
    near[0] = "Changed"
    rows += [(9000, one_line, "en", "s", len(one_line)), (9001, None, "en", "s", 0), (9002, "12 !", "en", "s", 4), (9003, " ".join(near), "en", "s", 1), (9004, f"{items[0][1]} and {items[1][1]}", "en", "s", 1), (9005, rows[3][1], "en", "s", 1), (9006, f"said {items[2][1]} indeed", None, None, None)]
    spark.createDataFrame(rows, src.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    where = str(tmp_path)

    have = spark.read.parquet(f"{where}/documents.parquet")
    want = {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, have, where)
        out.write.parquet(f"{where}/{k}")
        have = spark.read.parquet(f"{where}/{k}")
        if k == 0:
            want = {i: t for i, t in want.items() if any(c.isalpha() for c in t or "")}
        elif k == 1:
            want = {i: kept for i, _, gone, _, kept in brute.repeated_lines(list(want.items()), 8) if not gone or len(kept) >= P.KEPT_SHARE * len(want[i])}
        elif k == 2:
            want = {i: want[i] for i, _, c in brute.jaccard_components(list(want.items()), 5, 80) if i == c}
            assert 9003 not in want
        elif k == 3:
            want = {i: t for i, t in want.items() if not brute.contamination(t, items, 8)[2]}
            assert 9004 not in want and 9006 not in want
        if k < 4:
            assert have.columns == list(P.COLUMNS)
            assert {r["doc_id"]: r["text"] for r in have.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) or r["text"] == dict((x[0], x[1]) for x in rows).get(r["doc_id"]) for r in have.collect())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(P.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in want.items():
        ids = enc.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, have.collect())) == sorted(expected)
    assert sorted(map(tuple, P.run(spark, where).collect())) == sorted(expected)


def test_one_item_contaminates(spark, documents, tmp_path):
    words = [f"w{i}" for i in range(20)]
    item = " ".join(words)
    spark.createDataFrame([(1, item), (2, "another item of the benchmark with nine whole words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (2, "before " + " ".join(words[5:13]) + " after"), (3, "before " + " ".join(words[5:12]) + " after"), (4, None), (5, "")]
    kept = P.drop_contaminated(spark, documents(rows), str(tmp_path))
    assert kept.columns == list(P.COLUMNS)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_an_item_of_one_word_contaminates_nothing(spark, documents, tmp_path):
    spark.createDataFrame([(1, "the"), (2, "two words"), (3, None), (4, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = P.drop_contaminated(spark, documents([(1, "the end"), (2, "the two words")]), str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_jaccard_stage_keeps_one_row_of_each_group(spark, documents, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (3, long + " more"), (None, long), (None, "another text of some six words"), (7, "another text of some six words"), (8, "quite a different text of eight words here"), (8, long), (9, None), (10, ""), (10, "")]
    kept = P.jaccard_join(spark, documents(rows, ["key", "component_id"]), str(tmp_path))
    assert kept.columns == list(P.COLUMNS)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # the null id is the smallest of both groups
    want = [(None, long), (None, "another text of some six words"), (8, "quite a different text of eight words here"), (9, None), (10, "")]
    assert got == sorted(want, key=str)
    assert P.jaccard_join(spark, documents([(4, long), (4, long), (6, long)]), "").count() == 1


def test_stages_with_nulls_and_clashing_columns(spark, documents, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "Eins zwei drei"), (None, None), (4, ""), (4, "x y z"), (4, "x y z"), (6, "one two three four")]
    clash = ["kept", "n_words", "items", "langs", "score", "key", "_of", "_runs", "ids", "doc"]
    df = documents(rows, clash)
    spark.createDataFrame([], df.schema).write.parquet(str(tmp_path / "documents.parquet"))
    counts = {"language_id": 4, "line_dedup": 6, "ngram_jaccard_join": 5, "benchmark_decontamination": 5, "byte_level_bpe": 6}
    for name, stage in P.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.count() == counts[name], name
        if name != "byte_level_bpe":
            assert out.columns == list(P.COLUMNS)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from lodestar.llm import common

    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(lambda: Elsewhere.conf)
            _jsc = type("", (), {"sc": staticmethod(lambda: type("", (), {"getCheckpointDir": staticmethod(lambda: type("", (), {"isDefined": staticmethod(lambda: False)}))}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Elsewhere)


def test_the_jaccard_stage_ends_in_a_small_plan(spark, documents, tmp_path):
    rows = [(i, f"{'one two three four five six seven eight nine ten ' * 3}{i % 3}") for i in range(30)]
    text = explain(P.jaccard_join(spark, documents(rows), str(tmp_path)), "simple")
    # Only the two joins with the keys that stay are left, and the removal of copies.
    assert text.count("Join") == 2 and text.count("Exchange hashpartitioning") <= 5


def test_shuffle_files_go_with_what_is_written(spark, tmp_path):
    before = _shuffles(spark)
    assert written(_grouped(spark), str(tmp_path / "out")).count() == 10
    own = lambda: _shuffles(spark) - before
    assert _within(5, lambda: len(own()) <= 1)  # count()'s own stays

"""The fixity audit and shard placement."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import sharding, warc_audit

PAGES = "page_id long, url string, html string"


def audit(spark, a, b):
    rows = warc_audit.audit(spark.createDataFrame(a, PAGES).selectExpr("*", "1 AS node"), spark.createDataFrame(b, PAGES)).collect()
    return sorted((r["page_id"] is not None, r["page_id"] or 0, r["status"]) for r in rows)


def test_damage_is_located(spark):
    a = [(i, f"http://x/{i}", "body " * (i % 50)) for i in range(1500)]
    b = [(i, u, h + "!" if i == 7 else h) for i, u, h in a if i != 99] + [(5000, "u", "h")]
    assert audit(spark, a, b) == [(True, 7, "altered"), (True, 99, "missing"), (True, 5000, "extra")]
    assert audit(spark, a, a) == []


def test_nulls_copies_and_empty(spark):
    a = [(None, None, None), (1, "u", "h"), (1, "u", "h"), (2, "u", "x"), (2, "u", "y")]
    assert audit(spark, a, a[::-1]) == []
    assert audit(spark, a, a[1:]) == [(False, 0, "missing")]
    assert audit(spark, a, a[:2] + a[3:]) == [(True, 1, "altered")]
    assert audit(spark, [], []) == []
    assert audit(spark, [], a[1:2]) == [(True, 1, "extra")]


def plain_fill(names, slots):
    order = {n: [(o + j * s) % slots for j in range(slots)] for n in names for o, s in [sharding.preference(n, slots)]}
    table, turn = {}, {n: iter(order[n]) for n in names}
    while len(table) < slots:
        for n in sorted(names):
            slot = next((x for x in turn[n] if x not in table), None)
            if slot is not None:
                table[slot] = n
    return [table[i] for i in range(slots)]


def test_fill_is_the_plain_one():
    for names in (["a"], ["a", "b", "c"], [f"s{i}" for i in range(17)]):
        got = sharding.fill(names, 101)
        assert got == plain_fill(names, 101)
        counts = [got.count(n) for n in names]
        assert max(counts) - min(counts) <= 1


def test_losing_a_shard_moves_few_others():
    names = [f"s{i}" for i in range(10)]
    before, after = sharding.fill(names, 5003), sharding.fill(names[1:], 5003)
    moved = sum(x != y for x, y in zip(before, after) if x != "s0")
    assert moved < 0.15 * 5003
    assert "s0" not in after


@pytest.mark.parametrize("names, slots", [([], 7), (["a"], 8), (["a"] * 3 + ["b"], 1), ([str(i) for i in range(9)], 7)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_placement(spark):
    rows = [(i if i else None, "x") for i in range(50)] + [(5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    got = sharding.place(df, "doc_id", ["a", "b", "c"], 101)
    table = sharding.fill(["a", "b", "c"], 101)
    out = got.withColumn("want", sharding.slot_of(F.col("doc_id"), 101)).collect()
    assert len(out) == 51
    assert all(r["slot"] == r["want"] and r["shard"] == table[r["slot"]] for r in out)
    assert sharding.place(df.limit(0), "doc_id", ["a"]).count() == 0


def test_long_keys_and_a_key_named_as_a_result(spark):
    df = spark.createDataFrame([("k" * 100_000, 1), (None, 2), ("", 3)], "slot string, at int")
    got = {r["at"]: (r["slot"], r["shard"]) for r in sharding.place(df, "slot", ["a", "b"], 101).collect()}
    assert got[2] == got[3] and len(got) == 3
    table = sharding.fill(["a", "b"], 101)
    for key, at in (("k" * 100_000, 1), ("", 2)):
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert got[at] == (slot, table[slot])


def test_long_bodies_and_many_extras(spark):
    a = [(i, "u", "body") for i in range(40)] + [(40, "u", "x" * 2_000_000)]
    b = [(i, "u", "body") for i in range(40)] + [(40, "u", "x" * 1_999_999 + "y")] + [(1000 + i, "u", "h") for i in range(3000)]
    got = audit(spark, a, b)
    assert got[0] == (True, 40, "altered") and len(got) == 3001 and {s for *_, s in got[1:]} == {"extra"}


def test_descent_reads_differing_branches_alone(spark):
    """Of two trees that differ in one leaf, the nodes compared below the root are those of its branch."""
    leaves = spark.range(1 << 18).selectExpr("id AS node", "0 AS copy", "md5(CAST(id AS STRING)) AS hash")
    both = leaves.union(leaves.selectExpr("node", "1 AS copy", "IF(node = 77000, 'z', hash) AS hash"))
    levels = [both]
    for _ in range(3):
        levels.append(warc_audit._parents(levels[-1]))
    assert [r["node"] for r in warc_audit.descend(levels).collect()] == [77000]
    assert warc_audit.descend([x.where("copy = 0").unionByName(x.where("copy = 0").selectExpr("1 AS copy", "node", "hash")) for x in levels]).count() == 0

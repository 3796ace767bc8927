"""WARC fixity audit by Merkle trees over ordered offset ranges.

The manifest lays the records of the primary copy out in archive files and
gives each its offset.  In a copy's tree a leaf is a range of offsets: the hash
of its records' hashes in offset order.  Every 256 neighbouring nodes have a
parent, up to one root.  The audit compares the two roots and, level by level,
only the children of nodes that differ, down to the ranges and then the records
that are altered, missing or extra.

A copy's records take the manifest's offsets by their id, so one record of
another length does not shift those after it.  Records that the manifest does
not know share one range in front of each file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, merged

#: Bytes of one leaf's range.
RANGE_BYTES = 1 << 16
#: Records of one archive file, about.
FILE_RECORDS = 512
#: A parent has 2**8 children at most.
FANOUT_BITS = 8
#: Ranges in a file: 2**24 of 64 KB, 1 TB.
RANGE_BITS = 24


def record_bytes(url: Column, body: Column) -> Column:
    """A resource record of the WARC format."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    end = F.lit("\r\n")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), end, end, body, end, end)


def digests(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """id, nth, digest, length and copies of each record: equal records of one id are one, with a count.

    nth tells apart different records of one id.
    """
    raw = record_bytes(F.col(url_col), F.col(body_col))
    each = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("length"))
    same = each.groupBy("id", "digest", "length").agg(F.count("*").alias("copies"))
    return same.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("digest")))


def manifest(records: DataFrame, files: int) -> DataFrame:
    """id, nth, file and offset: files by a hash of the id, records in id order within one."""
    w = Window.partitionBy("file").orderBy("id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
    return placed.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(w), F.lit(0)))


def _leaves(records: DataFrame) -> DataFrame:
    """node (file and range in one number, in order) and hash of each range of each copy."""
    entry = F.struct("offset", "id", "nth", "digest", "copies")
    line = lambda r: F.concat_ws(":", r["offset"], r["id"], r["nth"], r["digest"], r["copies"])
    return records.groupBy("copy", "node").agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(entry)), line)), 256).alias("hash"))


def _parents(nodes: DataFrame) -> DataFrame:
    child = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"], r["hash"]))
    return nodes.groupBy("copy", F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.sha2(F.concat_ws(",", child), 256).alias("hash"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of both copies' nodes, leaves first, the roots last.  Each is kept, so that descent reads a level, not all below it."""
    out = [cut(_leaves(records))]
    for _ in range(levels):
        out.append(cut(_parents(out[-1])))
    return out


def differing(nodes: DataFrame) -> DataFrame:
    """Nodes whose hash is not the same in both copies, or that one copy lacks."""
    return nodes.groupBy("node", "hash").agg(F.count("*").alias("copies")).where("copies < 2").select("node").distinct()


def descend(levels: list[DataFrame]) -> DataFrame:
    """The leaves that differ: from the roots down, only the children of nodes that differ are compared."""
    found = differing(levels[-1])
    for nodes in levels[-2::-1]:
        below = nodes.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(found.withColumnRenamed("node", "up"), "up", "left_semi")
        found = differing(below)
    return found


def audit(primary: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id, status (altered, missing, extra), file, offset, expected_sha256 and found_sha256 of each record that differs.

    Edge cases: null urls and bodies are empty; a null id is one id of its own
    and null in the result; different records of one id are told apart by the
    order of their hashes; a record kept in another number of copies is altered;
    other columns are not read; bodies of any length are hashed whole; equal
    copies, also empty ones, give no rows.
    """
    ours = digests(primary, id_col, url_col, body_col)
    ours = cut(ours)
    files = max(1, math.ceil(ours.count() / FILE_RECORDS))
    levels = math.ceil((RANGE_BITS + 1 + files.bit_length()) / FANOUT_BITS)
    plan = manifest(ours, files)
    node = F.shiftleft(F.col("file"), RANGE_BITS + 1) + F.col("range")
    ours = cut(plan.withColumn("range", 1 + F.floor(F.col("offset") / RANGE_BYTES)).withColumn("node", node))
    known = ours.select("id", "nth", "file", "offset", "range")
    theirs = digests(replica, id_col, url_col, body_col).join(merged(known), ["id", "nth"], "left")
    # unknown records: range 0 of the file their id hashes to, so they spread over as many leaves as there are files
    theirs = theirs.withColumns({"file": F.coalesce("file", F.pmod(F.xxhash64("id"), F.lit(files))), "range": F.coalesce("range", F.lit(0).cast("long")), "offset": F.coalesce("offset", F.lit(-1).cast("long"))})
    theirs = cut(theirs.withColumn("node", node))

    both = ours.select("id", "nth", "file", "offset", "digest", "copies", "node", F.lit(0).alias("copy")).unionByName(theirs.select("id", "nth", "file", "offset", "digest", "copies", "node", F.lit(1).alias("copy")))
    found = both.join(descend(tree(both, levels)), "node", "left_semi")
    of = lambda copy, c: F.max(F.when(F.col("copy") == copy, F.col(c)))
    pairs = found.groupBy("id", "nth").agg(of(0, "digest").alias("expected_sha256"), of(1, "digest").alias("found_sha256"), of(0, "copies").alias("ca"), of(1, "copies").alias("cb"), F.coalesce(of(0, "file"), of(1, "file")).alias("file"), of(0, "offset").alias("offset"))
    pairs = pairs.where(~(F.col("expected_sha256").eqNullSafe(F.col("found_sha256")) & F.col("ca").eqNullSafe(F.col("cb"))))
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra").otherwise("altered")
    return pairs.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), status.alias("status"), "file", "offset", "expected_sha256", "found_sha256")

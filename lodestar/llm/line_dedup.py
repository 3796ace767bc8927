"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is a sequence of line ids (128-bit hashes).  Suffixes are ranked by
their first line, then by their first 2, 4, ... lines: the rank of 2h lines is
the order of the pairs (rank of h lines here, rank of h lines h lines on).
Suffixes of one rank share a prefix of that length: a longest-common-prefix
interval.  A suffix alone in its rank leaves at once, so later rounds hold only
what still repeats, and doubling goes on as long as a run that could count is
longer than the ranks reach.

A run of lines counts if it holds at least `min_words` words, in however many
lines, and starts earlier as a whole.  Every line of such a run lies in one of
its tight windows: the shortest run from some line on, or up to some line, that
holds min_words words.  (From the start on, tight windows cover all but the last
lines, and the tight window up to the end covers those.)  A window of m lines,
2**j <= m < 2**(j + 1), lies in the interval of its two ranks of 2**j lines, at
its start and at m - 2**j lines on.  In each interval all but the first window
are later copies; they merge into maximal repeated runs, whose lines go.

Ranks come from counts of distinct pairs, never from a sort of all suffixes in
one place: pairs are pre-aggregated, so a line that a third of all documents
share is one row, and the pairs of one rank are ordered in ranges of bounded
size.  All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, merged

MIN_WORDS = 8
#: The first ranks are offsets of this many hash ranges plus the order within one.
RANGES = 1024
_WORD = r"[^\x20\x09-\x0D]+"


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Distinct repeated lines (a, b) with their words and rank: how many repeated suffixes come before."""
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("words").alias("words")).where("n > 1")
    repeated = repeated.withColumn("range", F.shiftrightunsigned("a", 54))
    totals = repeated.groupBy("range").agg(F.sum("n").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = repeated.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(offsets), "range").select("a", "b", "words", (F.col("offset") + F.col("inside")).alias("rank"))


def _doubled(ranks: DataFrame, step: int, width: int) -> DataFrame:
    """Suffixes ranked by the pair of ranks here and `step` lines on; those of a rank of their own leave.

    The pairs of one rank are ordered in ranges of `width` second ranks, so a
    rank that a third of all suffixes share is no single task's.
    """
    on = Window.partitionBy("doc", "hash").orderBy("pos").rangeBetween(step, step)
    pairs = ranks.select("doc", "hash", "pos", "rank", F.max("rank").over(on).alias("next")).where("next is not null")
    counts = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").withColumn("range", F.floor(F.col("next") / width))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("rank", "range").agg(F.sum("n").alias("total"))
    offsets = totals.select("rank", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "range").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(merged(offsets), ["rank", "range"])
    new = placed.select("rank", "next", (F.col("rank") + F.col("offset") + F.col("inside")).alias("new"))
    return pairs.join(merged(new), ["rank", "next"]).select("doc", "hash", "pos", F.col("new").alias("rank"))


def _tight_windows(active: DataFrame, min_words: int) -> DataFrame:
    """doc, hash, start and m: the shortest runs of repeated lines, from each line on and up to each, that hold min_words words."""
    lines = Window.partitionBy("doc", "hash").orderBy("pos")
    # Lines that follow each other are an island; total is the words up to the end of a line.
    opens = F.coalesce(F.lag("pos").over(lines) != F.col("pos") - 1, F.lit(True)).alias("opens")
    marked = active.select("doc", "hash", "pos", "words", (F.col("pos") - F.row_number().over(lines)).alias("island"), F.sum("words").over(lines).alias("total"), opens)
    own = F.struct("pos", "total")
    ahead = F.struct((F.col("pos") - 1).alias("pos"), (F.col("total") - F.col("words")).alias("total"))
    # Each row is the gap after a line; an island has one more, in front of its first line.
    gaps = marked.select("doc", "hash", "island", F.explode(F.when(F.col("opens"), F.array(ahead, own)).otherwise(F.array(own))).alias("gap")).select("doc", "hash", "island", "gap.*")
    island = Window.partitionBy("doc", "hash", "island")
    up = island.orderBy("total").rangeBetween(Window.unboundedPreceding, -min_words)
    down = island.orderBy(F.desc("total")).rangeBetween(Window.unboundedPreceding, -min_words)
    both = gaps.select("doc", "hash", "pos", F.min("pos").over(down).alias("end"), F.max("pos").over(up).alias("begin"))
    ends = F.array(F.struct((F.col("pos") + 1).alias("start"), F.col("end").alias("last")), F.struct((F.col("begin") + 1).alias("start"), F.col("pos").alias("last")))
    found = both.select("doc", "hash", F.explode(ends).alias("w")).where("w.start is not null and w.last is not null")
    return found.select("doc", "hash", "w.start", (F.col("w.last") - F.col("w.start") + 1).alias("m")).distinct()


def _later(windows: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """The windows of size to 2 * size - 1 lines that also start earlier."""
    due = windows.where((F.col("m") >= size) & (F.col("m") < 2 * size))
    at = lambda pos, name: ranks.select("doc", "hash", F.col("pos").alias(pos), F.col("rank").alias(name))
    due = due.withColumn("second", F.col("start") + F.col("m") - size)
    due = due.join(merged(at("start", "head")), ["doc", "hash", "start"]).join(merged(at("second", "tail")), ["doc", "hash", "second"])
    first = due.groupBy("head", "tail", "m").agg(F.min(F.struct("doc", "hash", "start")).alias("first")).select("first.*", "m")
    # Windows have keys of their own, so an interval of a third of all windows is no key of this join.
    return due.join(merged(first), ["doc", "hash", "start", "m"], "left_anti").select("doc", "hash", "start", "m")


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, hash and runs: the maximal line ranges (start, end) that repeat earlier lines."""
    line = F.posexplode(F.split("text", "\n"))
    lines = docs.where("text is not null").select("doc", "hash", line.alias("pos", "line"))
    a, b = F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b")
    repeated = _first_ranks(lines.select(a, b, F.regexp_count("line", F.lit(_WORD)).alias("words")))
    active = lines.select("doc", "hash", "pos", a, b).join(merged(repeated), ["a", "b"]).select("doc", "hash", "pos", "rank", "words")
    # Rows equal in id and text are one document.
    active = cut(active.dropDuplicates(["doc", "hash", "pos"]))
    windows = cut(_tight_windows(active, min_words))
    longest, suffixes = windows.agg(F.max("m")).first()[0] or 0, active.count()
    # At most half of all suffixes are distinct pairs of one rank: about its square root of them in a range, and as many ranges.
    width = max(1, math.isqrt(2 * suffixes))
    ranks, size = active.select("doc", "hash", "pos", "rank"), 1
    later = _later(windows, ranks, size)
    while 2 * size <= longest:
        ranks = cut(_doubled(ranks, size, width))
        size *= 2
        if ranks.isEmpty():
            break
        later = later.unionAll(_later(windows, ranks, size))
    # gaps and islands: a copy that starts after the end of all before it begins a new run
    w = Window.partitionBy("doc", "hash").orderBy("start", "m")
    reach = F.max(F.col("start") + F.col("m")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = later.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(w)).groupBy("doc", "hash", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("m")).alias("end"))
    return islands.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """lines outside the runs, in order: one slice before each run and one after the last."""
    n = F.size(runs)
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["end"])
    end = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get(runs, k)["start"])
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with n_lines, n_removed, n_runs and kept: the text without later copies of repeated runs.

    Lines end at a line feed and compare as they are; words are runs of anything
    but ASCII white space.  A line goes if it lies in a run of consecutive lines
    that holds at least min_words words and also starts earlier: in a smaller
    id, or further up in the document.  So a long line that repeats alone goes,
    a short one only with its neighbours.  Runs are judged on the input.

    Edge cases: a null text has no lines and a kept text of null; an empty text
    has one empty line; a null id counts as the smallest; rows equal in id and
    text are one document, whose copies keep the same lines; rows that share an
    id alone are ordered by a hash of their text; a text of any length is whole;
    columns of docs with the names above are replaced, others of any name pass
    through; an empty table stays empty.
    """
    if min_words < 1:
        raise ValueError("min_words is at least 1")
    made = ("n_lines", "n_removed", "n_runs", "kept")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in made])
    of, own, found = fresh(docs, "of", "own", "found")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)).cast("long"))
    text = F.col(f"`{text_col}`").cast("string")
    read = docs.select(key.alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    runs = later_copies(read, min_words).select(F.struct("doc", "hash").alias(of), F.col("runs").alias(found))
    lines = F.split(text, "\n")
    joined = docs.withColumn(own, F.struct(key.alias("doc"), F.xxhash64(text).alias("hash"))).join(merged(runs), F.col(own) == F.col(of), "left")
    gone = F.coalesce(F.aggregate(found, F.lit(0), lambda n, r: n + r["end"] - r["start"]), F.lit(0))
    kept = F.when(F.col(found).isNull(), text).otherwise(F.array_join(_without(lines, F.col(found)), "\n"))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_removed"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_runs"),
        kept.alias("kept"),
    )

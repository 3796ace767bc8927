"""The corpus pipeline: from raw documents to token ids.

Each stage works on all that the one before kept, and its decisions take
effect.  All stages but the last return the columns of documents.  run() writes
each stage's result as Parquet in the shared folder of spark.checkpoint.dir and
reads it again, so no stage is computed twice and a lost executor costs at most
the stage at hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from lodestar.llm.common import checkpoint_dir, cut, removed, written
from lodestar.llm.queries import RANKS

#: As a near duplicate is one of a similarity of 0.8.
KEPT_SHARE = 0.2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language ('und': null, or no letter) go; lang is the predicted one.

    A null or empty text goes; a null lang is predicted like any other but not
    learned from; rows with a null or repeated id stay as they are, each on its
    own; equal likelihoods go to the first name; an empty table stays empty.
    """
    training = docs.where(~langid.held_out("doc_id")).select("text", "lang")
    out = langid.identify(docs.select(*COLUMNS), training).where(F.col("lang_pred") != langid.UNDETERMINED)
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which less than KEPT_SHARE of the characters was left.

    What is left of a near copy without the lines it shares is shreds, which no
    later stage could know as copies.  n_chars follows the new text.  A null text has no lines and stays null; an
    empty one is one empty line and stays; a null id counts as the smallest; rows
    equal in id and text are one document, so all of them keep their lines (the
    Jaccard join keeps one); an empty table stays empty.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.length("kept") >= KEPT_SHARE * F.length("text")))
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by id and text, so different texts that share an id, or
    have none, are judged each on its own; of rows equal in both one stays.  A
    null id counts as the smallest; in a group, equal ids are ordered by a hash
    of their text.  Texts without words are linked with nothing and stay (once
    for each id and text); an empty table stays empty.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    # Every row of a key has its component: one row a key, so copies don't multiply in the join.
    found = ngram_join.jaccard_components(keyed, id_col="key", shingle=5, percent=80).select(F.col("doc_id").alias("key"), "component_id").distinct()
    held = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    first = held.join(found, "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key", "rows")).alias("first"))
    # Cut, so that the last plan is the two joins below and not the join's own end twice over.
    stay = cut(first.select(F.col("first.key").alias("kept_key"), F.col("first.rows").alias("kept_rows")))
    kept = keyed.join(stay.where("kept_rows = 1"), F.col("key") == F.col("kept_key"), "left_semi")
    copies = keyed.join(stay.where("kept_rows > 1"), F.col("key") == F.col("kept_key"), "left_semi").dropDuplicates(["key"])
    return kept.unionAll(copies).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go.

    An item of a single word is no passage and contaminates nothing; without an
    item, or with null or empty ones alone, all documents stay.  Null and empty
    texts, null and repeated ids stay, each row on its own.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(docs.select(*COLUMNS), benchmark, min_item_words=2)
    return out.where(F.size("items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and what they decode to, as digests: one row a document, whatever its id.

    A null or empty text has no ids; a text of any length is whole; an empty
    table stays empty.
    """
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.bpe_round_trip(docs.select("doc_id", "text"), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]

#: Mixture inference and byte-pair merges are no SQL: the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written, then read, and the one before it removed."""
    folder = f"{checkpoint_dir(spark)}/lodestar-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered opN_ queries: each operator over its whole table, digests as the contracts name them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, line_dedup, ngram_join, secrets, sharding, substring_dedup, warc_audit

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM w, range(1, greatest(len(ws) - 2, 2)) AS r(i) WHERE len(ws) > 0
), n AS (
  SELECT w.doc_id, count(s.h) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM n
  UNION
  SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reach.r) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= decontaminate.CONTAMINATED_ITEMS).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS k, array_to_string(ws[i:i + least(len(ws), 8) - 1], ' ') AS h FROM b, range(1, greatest(len(ws) - 6, 2)) AS r(i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS h FROM d, (SELECT DISTINCT k FROM iw) AS ks, range(1, len(ws) - k + 2) AS r(i)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.h = iw.h
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, j FROM hit, range(i, i + k) AS r(j)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of pages with known damage: some bodies altered, some records lost, some added."""
    p = F.col("page_id")
    copy = pages.select("page_id", "url", F.when(p % 97 == 3, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")).alias("html")).where(p % 101 != 5)
    return copy.union(pages.where(p % 103 == 7).select((p + 10**12).alias("page_id"), "url", "html"))


def op3_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc_audit.audit(pages, damaged(pages)).select("page_id", "status", "expected_sha256", "found_sha256")


OP3_SQL = """
WITH a AS (
  SELECT page_id, url, html FROM pages
), b AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN html || '!' ELSE html END AS html FROM pages WHERE page_id % 101 <> 5
  UNION ALL
  SELECT page_id + 1000000000000, url, html FROM pages WHERE page_id % 103 = 7
), ah AS (
  SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS h FROM a
), bh AS (
  SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS h FROM b
)
SELECT coalesce(ah.page_id, bh.page_id) AS page_id,
       CASE WHEN bh.h IS NULL THEN 'missing' WHEN ah.h IS NULL THEN 'extra' ELSE 'altered' END AS status,
       ah.h AS expected_sha256, bh.h AS found_sha256
FROM ah FULL JOIN bh ON ah.page_id = bh.page_id
WHERE ah.h IS DISTINCT FROM bh.h
"""

SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


#: The filled table as a list of shard numbers: the filling is the operator's own, and tested against a plain one.
OP4_SQL = f"""
WITH t AS (SELECT [{", ".join(str(SHARDS.index(x)) for x in sharding.fill(SHARDS))}] AS shards),
k AS (SELECT doc_id, CAST(CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(shards[slot + 1] AS VARCHAR), 3, '0') AS shard FROM k, t
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i, ls[i] AS line, sum(len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM d, range(1, 1 + len(ls)) AS r(i)
), g AS (
  SELECT doc_id, i, upto, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY i), 0) AS ahead FROM l
), w AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.ahead >= 8 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.ahead >= 8 GROUP BY b.doc_id, b.i
), c AS (
  SELECT doc_id, s, e FROM (SELECT w.doc_id, s, e, row_number() OVER (PARTITION BY array_to_string(ls[s:e], chr(10)) ORDER BY w.doc_id, s) AS nth FROM w JOIN d ON w.doc_id = d.doc_id) WHERE nth > 1
), x AS (
  SELECT DISTINCT doc_id, j FROM c, range(s, e + 1) AS r(j)
), h AS (
  SELECT l.doc_id, l.i, l.line, x.j IS NOT NULL AS gone FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.j
), k AS (
  SELECT doc_id, i, line, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM h
)
SELECT d.doc_id,
       CAST(count(k.i) AS BIGINT) AS n_lines,
       CAST(count(k.i) FILTER (WHERE k.gone) AS BIGINT) AS n_removed,
       CAST(count(k.i) FILTER (WHERE k.begins) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE NOT k.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    training = docs.where(~F.col("held_out")).select("text", "lang")
    out = langid.identify(docs.select("doc_id", "held_out", "text"), training)
    return out.select("doc_id", "held_out", "lang_pred", "score", "langs", "proportions")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col("findings")
    spelled = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    of = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "cnn")),
        F.sha2(spelled(F.filter(f, lambda x: x["kind"] != "cnn")), 256).alias("base_sha256"),
        spelled(f).alias("spans"),
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), f AS (
  SELECT doc_id, j, word, array_to_string(list(word) OVER v, ' ') AS span, count(*) OVER v AS size
  FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), k AS (
  SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY span ORDER BY doc_id, j) AS rn FROM f WHERE size = 20) WHERE rn > 1
), c AS (
  SELECT DISTINCT doc_id, x AS j FROM k, range(j, j + 20) AS r(x)
), g AS (
  SELECT p.doc_id, p.j, p.word, c.j IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.j = c.j
)
SELECT d.doc_id, CAST(count(g.j) AS BIGINT) AS n_words, CAST(count(g.j) FILTER (WHERE g.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.j) FILTER (WHERE NOT g.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_fixity_audit": op3_warc_fixity_audit,
    "op4_shard_placement": op4_shard_placement,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_warc_fixity_audit": OP3_SQL,
    "op4_shard_placement": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_substring_dedup": OP10_SQL,
}

"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op2_token_counts")
def op2(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers

    from wattline.llm.tokens import token_counts

    return token_counts(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query("op5_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""")
def op5(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.exact import exact_groups

    return exact_groups(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_byte_bpe")
def op8(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers as P

    from wattline.llm.bpe import bpe_digests

    return bpe_digests(table(spark, root, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).withColumnRenamed("id", "doc_id")


@query("op9_language_id")
def op9(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.common import remainder
    from wattline.llm.language import identify, language_sample

    docs = table(spark, root, "documents")
    sample = language_sample(docs.where(remainder("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), sample).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op10_simhash")
def op10(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.simhash import near_groups

    return near_groups(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_decontamination", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.decontaminate import contamination

    found = contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op4_toxicity")
def op4(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.common import remainder
    from wattline.llm.toxicity import toxicity

    found = toxicity(table(spark, root, "documents"), table(spark, root, "labels"), remainder("doc_id", 3) != 1).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_quality")
def op7(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.common import remainder
    from wattline.llm.quality import quality

    found = quality(table(spark, root, "documents"), table(spark, root, "labels"), remainder("doc_id", 5) != 0).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN g.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first < p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h""")
def op1(spark: SparkSession, root: str) -> DataFrame:
    from wattline.functions.ordered import shared_folder
    from wattline.llm.common import type_of
    from wattline.llm.warc import read_warc, write_warc

    pages, path = table(spark, root, "pages"), shared_folder(spark, "warc")
    kind = type_of(pages, "page_id")
    write_warc(pages, path)
    return read_warc(spark, path).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"),
    )


@query("op3_kd_shards")
def op3(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.kdtree import kd_shards

    return kd_shards(table(spark, root, "documents"), shards=40).withColumnRenamed("id", "doc_id")


@query("op11_packing")
def op11(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers as P

    from wattline.llm.packing import pack

    return pack(table(spark, root, "documents"), P.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query("op12_whitening")
def op12(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.whitening import whiten

    return whiten(table(spark, root, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
    FROM s WHERE alike) WHERE n <= 5),
c AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 10""")
def op13(spark: SparkSession, root: str) -> DataFrame:
    from wattline.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0, label=label)

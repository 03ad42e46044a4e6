"""The contract queries of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import bpe, langid, mixing, near_dup, pii, quality, topk, toxicity, webp, wrapper
from tabulith.llm.common import held_out, table


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document. Nulls, ties, repeated rows and empty tables: see ``near_dup``."""
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, and the shards of the copies. Awkward input: see ``mixing``."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as WebP and read back: sizes, digests and features. Awkward input: see ``webp``."""
    return webp.described(webp.stored(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views, learned from labels that are not held out. Awkward input: see ``quality``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = quality.learn(docs.where("not held_out"), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select("row.doc_id", "row.held_out", "score", "content", "metadata", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by digest, and the digest of the bytes decoded from them. Awkward input: see ``bpe``."""
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False, digest=True)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out. Awkward input: see ``langid``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    got = langid.predict(docs, langid.learn(docs.where("not held_out")))
    return got.select("row.doc_id", "row.held_out", "lang_pred", "score", "bits", "rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out. Awkward input: see ``toxicity``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("row.doc_id", "row.held_out", "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest products of each query vector. Awkward input: see ``topk``."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and digest of base spans, and all spans. Awkward input: see ``pii``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.detect(docs, pii.learn(docs))
    return got.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Awkward input: see ``wrapper``."""
    got = wrapper.main_texts(table(spark, sf_dir, "pages"))
    return got.select("row.page_id", "row.url", "text", "n_chars")


OP6 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score, c.r
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6}

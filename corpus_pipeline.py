"""The corpus pipeline: five stages over documents, each an operator of tabulith.llm.

A stage takes (spark, docs, sf_dir) and gives the documents for the next one, with the same
columns; the last gives token ids. Every stage works on all that its predecessor kept.

An empty table goes through all stages and gives an empty result. Texts of any length are read whole
in each. Null texts go in the first stage; given to a later one, each stays a row of its own. Ties
(of languages by name, of documents by doc_id, of places in the mix by hash) are settled alike on
every run. Extra columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import bpe, langid, mixing, near_dup, pii
from tabulith.llm.common import held_out, staged, table

#: The method is not SQL: models, sketches and byte merges. tests/llm holds the brute-force comparison.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and texts far from all models go."""
    model = langid.learn(docs.where(~held_out()))
    return langid.predict(docs, model).where("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest doc_id; of repeated rows one."""
    keep = near_dup.classes(docs).where("keeper").select(F.struct("doc_id", "text_hash").alias("kept")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("own"))
    return rows.join(keep, F.col("own").eqNullSafe(F.col("kept"))).dropDuplicates(["own"]).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.masked(docs, pii.learn(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, once per copy drawn."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and decoded bytes, for every document."""
    return bpe.encode(docs, ids=True, digest=True)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

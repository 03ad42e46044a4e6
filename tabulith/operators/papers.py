"""Joins of papers with detections, marks and metadata: what is to do, what is done, what was accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions import papers as fn

KEY = "pdf_id"


def literature(papers: DataFrame) -> DataFrame:
    """Papers whose title or abstract speaks of Nd isotopes."""
    return papers.where(fn.is_isotope_paper(F.col("title"), F.col("abstract")))


def pending(papers: DataFrame, done: DataFrame) -> DataFrame:
    """Papers without a mark (or without detections): what a run has left to do."""
    return papers.join(done.select(KEY).distinct(), KEY, "left_anti")


def to_extract(papers: DataFrame, detections: DataFrame, marks: DataFrame) -> DataFrame:
    """Papers that have detections and no mark yet."""
    return pending(papers, marks).join(detections.select(KEY).distinct(), KEY, "left_semi")


def accepted(papers: DataFrame, marks: DataFrame) -> DataFrame:
    """Papers with a mark that says they hold an Sm-Nd table."""
    return papers.join(marks.where("has_header").select(KEY).distinct(), KEY, "left_semi")


def to_fuse(tables: DataFrame, marks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tables of accepted papers that have metadata."""
    kept = tables.join(marks.where("has_header").select(KEY).distinct(), KEY, "left_semi")
    return kept.join(metadata.select(KEY).distinct(), KEY, "left_semi")


def paper_defaults(papers: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Per paper the values that hold for all its samples."""
    return papers.select(KEY, *[c.alias(k) for k, c in fn.defaults(F.col("title"), F.col("abstract"), terms).items()])

"""Edges that need software beyond Spark: decoding PDFs, the table detector, spreadsheets.

The engine's inputs are DataFrames, so these are typed interfaces. Give an implementation
where its software is installed; ``decoded`` and ``detected`` run it once per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

GLYPHS = "pdf_id string, page int, seq long, ch string, font string, x0 double, y0 double, x1 double, y1 double, size double, page_w double, page_h double, error string"
DETECTIONS = "pdf_id string, page int, place int, score double, x0 double, y0 double, x1 double, y1 double, error string"


class Decoder(Protocol):
    """Reads a PDF's pages into glyph rows (the columns of GLYPHS without pdf_id and error)."""

    def glyphs(self, content: bytes) -> Iterable[tuple]: ...


class Detector(Protocol):
    """Finds tables on a PDF's pages: page, place, score and a normalised box."""

    def boxes(self, content: bytes) -> Iterable[tuple]: ...


def _run(papers: DataFrame, make: Callable[[], object], method: str, schema: str) -> DataFrame:
    """papers: pdf_id, content. What one paper raises becomes a row with its error; the others go on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = make()  # models are loaded once per task
        for f in frames:
            for pdf_id, content in zip(f["pdf_id"], f["content"], strict=True):
                try:
                    rows = [(pdf_id, *r, None) for r in getattr(tool, method)(bytes(content))]
                except Exception as e:
                    rows = [(pdf_id, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return papers.select("pdf_id", "content").mapInPandas(run, schema)


def decoded(papers: DataFrame, make: Callable[[], Decoder]) -> DataFrame:
    return _run(papers, make, "glyphs", GLYPHS)


def detected(papers: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    return _run(papers, make, "boxes", DETECTIONS)


class Missing:
    """Stands for software that isn't installed: using it says so."""

    def __init__(self, what: str):
        self.what = what

    def __getattr__(self, name: str):
        raise NotImplementedError(f"{self.what} needs an implementation; pass one to decoded() or detected()")

"""Glyphs by the page: a page is one row until its glyphs are needed, and then they are flat arrays.

A page's glyphs as rows would be shuffled, sorted and spilled one by one, at some hundred bytes for
each character of a text. Here pages are shuffled as they came (packed), and a kernel gets the
glyphs of a few pages at a time as numpy arrays, in reading order. What a kernel gives is a
function of its pages alone, so it runs where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["pdf_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]
NUMBERS = (*BOX, "size", "page_w", "page_h")
#: Pages that a kernel gets at once.
PAGES_AT_ONCE = 64


@dataclass
class Glyphs:
    """Glyphs of several pages by page and seq: ``page`` is the page's row. Numbers that are null are NaN, characters that are null empty."""

    pages: int
    page: np.ndarray
    columns: dict[str, np.ndarray]
    ch: pa.StringArray | None = None
    _blank: np.ndarray | None = field(default=None, repr=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.page)

    def where(self, kept: np.ndarray) -> Glyphs:
        return Glyphs(self.pages, self.page[kept], {k: v[kept] for k, v in self.columns.items()}, None if self.ch is None else self.ch.filter(pa.array(kept)))

    def boxes(self) -> np.ndarray:
        return np.stack([self.columns[c] for c in BOX])

    def shrunk(self, share: float) -> np.ndarray:
        x0, y0, x1, y1 = (self.columns[c] for c in BOX)
        dx, dy = 0.5 * share * (x1 - x0), 0.5 * share * (y1 - y0)
        return np.stack([x0 + dx, y0 + dy, x1 - dx, y1 - dy])

    def blank(self) -> np.ndarray:
        """Whether a glyph shows nothing but spaces."""
        if self._blank is None:
            ends = np.frombuffer(self.ch.buffers()[1], np.int32)[self.ch.offset : self.ch.offset + len(self.ch) + 1]
            size = np.diff(ends)
            data = np.frombuffer(self.ch.buffers()[2] or b"", np.uint8)
            first = np.zeros(len(size), np.uint8)
            some = size > 0
            first[some] = data[ends[:-1][some]]
            got = ~some | ((size == 1) & (first == 32))
            for k in np.flatnonzero((size > 1) & (first == 32)):
                got[k] = not self.ch[k].as_py().strip(" ")
            self._blank = got
        return self._blank

    def first(self) -> np.ndarray:
        """Whether a glyph is the first of its page."""
        got = np.ones(len(self.page), bool)
        got[1:] = self.page[1:] != self.page[:-1]
        return got


Decode = Callable[[pa.RecordBatch, tuple[str, ...]], Glyphs]
Kernel = Callable[[Glyphs, pa.RecordBatch], dict]


@dataclass
class Sheets:
    """rows: pdf_id, page and parts (an array of what ``decode`` reads); decode: the glyphs of a batch of them, with the columns asked for."""

    rows: DataFrame
    decode: Decode

    def but(self, change: Callable[[Glyphs], Glyphs]) -> Sheets:
        """The same pages with their glyphs changed."""
        decode = self.decode
        return Sheets(self.rows, lambda batch, names: change(decode(batch, names)))


def by_seq(glyphs: Glyphs, seq: np.ndarray) -> Glyphs:
    """Glyphs put in order of page and seq, as far as they aren't."""
    same = glyphs.page[1:] == glyphs.page[:-1]
    if np.all(glyphs.page[1:] >= glyphs.page[:-1]) and np.all(~same | (seq[1:] >= seq[:-1])):
        return glyphs
    order = np.lexsort((seq, glyphs.page))
    return Glyphs(glyphs.pages, glyphs.page[order], {k: v[order] for k, v in glyphs.columns.items()}, None if glyphs.ch is None else glyphs.ch.take(pa.array(order)))


def owners(lists: pa.Array) -> np.ndarray:
    """The row of each element of the lists; null lists have none."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def numbers(a: pa.Array) -> np.ndarray:
    return pc.cast(a, pa.float64()).to_numpy(zero_copy_only=False)


def strings(a: pa.Array) -> pa.StringArray:
    a = pc.fill_null(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a, "")
    return a if a.type == pa.string() else a.cast(pa.string())


def _unpacked(batch: pa.RecordBatch, names: tuple[str, ...]) -> Glyphs:
    lists = batch.column("parts")
    flat = lists.flatten()
    part = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    columns = {n: numbers(part[n]) for n in names if n in NUMBERS}
    if "font" in names:
        columns["font"] = pc.is_valid(part["font"]).to_numpy(zero_copy_only=False)
    glyphs = Glyphs(len(batch), owners(lists), columns, strings(part["ch"]) if "ch" in names else None)
    return by_seq(glyphs, part["seq"].to_numpy(zero_copy_only=False))


def of(glyphs: DataFrame | Sheets, names: tuple[str, ...]) -> Sheets:
    """Glyph rows as pages of the columns asked for; pages stay as they are."""
    if isinstance(glyphs, Sheets):
        return glyphs
    packed = glyphs.groupBy(*PAGE).agg(F.collect_list(F.struct("seq", *[n for n in names if n in glyphs.columns])).alias("parts"))
    return Sheets(packed, _unpacked)


def over(glyphs: DataFrame | Sheets, names: tuple[str, ...], kernel: Kernel, made: str, areas: DataFrame | None = None) -> DataFrame:
    """What ``kernel`` gives for the glyphs of some pages and the rows of those pages: columns by the names of ``made`` (DDL).

    With areas (pdf_id, page and more) every page that has some gets them as ``areas``, a list of
    structs, whether it has glyphs or not, and no other page comes.
    """
    sheets = of(glyphs, names)
    rows, decode = sheets.rows, sheets.decode
    if areas is not None:
        rest = [c for c in areas.columns if c not in PAGE]
        rows = areas.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("areas")).join(rows, PAGE, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                got = kernel(decode(part, names), part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in got.values()], names=list(got))

    return rows.mapInArrow(run, made)


def kinds(df: DataFrame, *columns: str) -> str:
    """The DDL of some columns."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def keyed(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, pa.Array]:
    """pdf_id and page of rows of a batch."""
    at = pa.array(rows)
    return {c: batch.column(c).take(at) for c in PAGE}


def areas_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The page's row of each area of a batch, and the areas' columns."""
    lists = batch.column("areas")
    flat = lists.flatten()
    return owners(lists), {f.name: flat.field(k) for k, f in enumerate(flat.type)}


def joined(ch: pa.StringArray, taken: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The concatenation of runs of taken characters; sizes are those of the runs."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), ch.take(pa.array(taken))), "")


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... size[k] times, for all k."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def contained(page: np.ndarray, boxes: np.ndarray, a_page: np.ndarray, a_boxes: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(area, glyph) of all glyphs inside areas of their page, by area and then by glyph.

    Glyphs are sorted by page and top, so an area is held against those between its top and bottom only.
    """
    known = np.flatnonzero(~np.isnan(boxes).any(axis=0))
    wanted = np.flatnonzero(a_boxes[3] >= a_boxes[1])
    if not len(known) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tops = boxes[1][known]
    low, high = tops.min(), tops.max()
    span = high - low + 4.0
    key = page[known] * span + (tops - low)
    order = None
    if np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, known = key[order], known[order]
    # bounds are widened, as keys are rounded; the boxes decide
    place = lambda y: a_page[wanted] * span + (np.clip(y[wanted], low - 1.5, high + 1.5) - low)
    slack = 1e-9 * max(abs(key[-1]), abs(key[0]), 1.0)
    begin, end = np.searchsorted(key, place(a_boxes[1]) - slack, "left"), np.searchsorted(key, place(a_boxes[3]) + slack, "right")
    size = np.maximum(end - begin, 0)
    a, g = np.repeat(wanted, size), known[ranges(begin, size)]
    x0, y0, x1, y1 = (b[g] for b in boxes)
    c0, d0, c1, d1 = (b[a] for b in a_boxes)
    inside = (c0 <= x0) & (d0 <= y0) & (x1 <= c1) & (y1 <= d1) if closed else (c0 < x0) & (d0 < y0) & (x1 < c1) & (y1 < d1)
    inside &= page[g] == a_page[a]
    a, g = a[inside], g[inside]
    if order is not None:
        order = np.lexsort((g, a))
        a, g = a[order], g[order]
    return a, g


def boxes_of(columns: dict[str, pa.Array]) -> np.ndarray:
    return np.stack([numbers(columns[c]) for c in BOX])

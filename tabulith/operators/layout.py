"""Page layout: glyphs, boxes and ink profiles as range joins, windows and aggregates.

Glyphs are rows (pdf_id, page, seq, ch, font, x0, y0, x1, y1, size) with the origin at the top
left; boxes are (x0, y0, x1, y1). What goes through all glyphs of a page takes them as rows or by
the page (``sheets.Sheets``), and works on arrays, some pages at a time; keys tell the areas of a
page apart. ``within`` is the range join of rows: a hash join by page with the range as its
condition. A page's areas are the build side, and a page bounds their number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.operators import sheets
from tabulith.operators.sheets import BOX, PAGE, Glyphs, Sheets

#: What an area without any glyph is treated as: the column threshold and the space threshold.
NO_GLYPHS = (50.55555, 1.4)


def flip(height: Column) -> list[Column]:
    """Box columns between a bottom-left and a top-left origin."""
    return [F.col("x0"), (height - F.col("y1")).alias("y0"), F.col("x1"), (height - F.col("y0")).alias("y1")]


def shrink(share: float) -> list[Column]:
    """Box columns drawn in about the centre by a share of the size; -1 undoes 0.5."""
    dx, dy = (F.lit(0.5 * share) * (F.col(b) - F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1")))
    return [(F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") - dx).alias("x1"), (F.col("y1") - dy).alias("y1")]


def rotate(direction: Column) -> list[Column]:
    """Normalised boxes on the page turned by direction (up, left, down or right); other directions give null."""
    x0, y0, x1, y1 = map(F.col, BOX)
    turned = {"up": (x0, y0, x1, y1), "left": (1 - y1, x0, 1 - y0, x1), "down": (1 - x1, 1 - y1, 1 - x0, 1 - y0), "right": (y0, 1 - x1, y1, 1 - x0)}
    out = []
    for i, name in enumerate(BOX):
        c = None
        for d, box in turned.items():
            c = F.when(direction == d, box[i]) if c is None else c.when(direction == d, box[i])
        out.append(c.alias(name))
    return out


def normalised_pixels(width: Column, height: Column) -> list[Column]:
    """Detector boxes in pixels as shares of the page; coordinates are cut to whole pixels first."""
    return [(F.col(c).cast("int") / (width if c[0] == "x" else height)).alias(c) for c in BOX]


def confident(detections: DataFrame, least: float = 0.9) -> DataFrame:
    """Detections of a score of at least ``least``, numbered within their page by their place."""
    order = Window.partitionBy(*PAGE).orderBy("place")
    return detections.where(F.col("score") >= least).withColumn("table_id", F.row_number().over(order) - 1)


def on_page(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Normalised areas in the units of their page. pages: pdf_id, page, width, height."""
    scaled = areas.join(pages, PAGE)
    return scaled.withColumns({"x0": F.col("x0") * F.col("width"), "y0": F.col("y0") * F.col("height"), "x1": F.col("x1") * F.col("width"), "y1": F.col("y1") * F.col("height")})


def within(glyphs: DataFrame, areas: DataFrame, closed: bool = True) -> DataFrame:
    """Glyphs with every area of their page that contains them; area columns are prefixed with a_."""
    named = areas.select(*[F.col(c).alias(c if c in PAGE else f"a_{c}") for c in areas.columns]).where("a_y1 >= a_y0")
    inside = (F.col("a_x0") <= F.col("x0")) & (F.col("a_y0") <= F.col("y0")) & (F.col("x1") <= F.col("a_x1")) & (F.col("y1") <= F.col("a_y1"))
    if not closed:
        inside = (F.col("a_x0") < F.col("x0")) & (F.col("a_y0") < F.col("y0")) & (F.col("x1") < F.col("a_x1")) & (F.col("y1") < F.col("a_y1"))
    return glyphs.join(named.hint("shuffle_hash"), PAGE).where(inside)


def in_order(place: str = "seq", what: str = "ch") -> Column:
    """The concatenation of a group's characters by place."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what]), "")


def _texts(glyphs: Glyphs, a_page: np.ndarray, a_boxes: np.ndarray) -> pa.Array:
    """Text of each area: the glyphs whose shrunk boxes it contains, in reading order."""
    area, glyph = sheets.contained(glyphs.page, glyphs.shrunk(0.5), a_page, a_boxes)
    return sheets.joined(glyphs.ch, glyph, np.bincount(area, minlength=len(a_page)))


def area_text(glyphs: DataFrame | Sheets, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each area: its shrunk glyphs in reading order. Areas without glyphs have an empty text."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        page, columns = sheets.areas_of(batch)
        return sheets.keyed(batch, page) | {k: columns[k] for k in keys} | {"text": _texts(g, page, sheets.boxes_of(columns))}

    return sheets.over(glyphs, ("ch", *BOX), kernel, f"{sheets.kinds(areas, *PAGE, *keys)}, text string", areas.select(*PAGE, *keys, *BOX))


def with_spaces(glyphs: DataFrame, space: Column) -> DataFrame:
    """Glyphs with blanks between those that are further apart than a third of ``space``; a blank has its predecessor's box.

    seq becomes 2 * seq, and one more for the blank.
    """
    after = Window.partitionBy(*PAGE).orderBy("seq")
    gap = (F.abs(F.lead("x0").over(after) - F.col("x1")) > space / 3) | (F.abs(F.lead("y1").over(after) - F.col("y1")) > space / 3)
    return _followed_by_blanks(glyphs.withColumn("twin", F.coalesce(gap, F.lit(False))), glyphs.columns)


def with_marked_spaces(glyphs: DataFrame) -> DataFrame:
    """For pages that mark blanks by glyphs without a box: the glyph before one gets a blank with its own box, and the marks go."""
    after = Window.partitionBy(*PAGE).orderBy("seq")
    marked = glyphs.withColumn("twin", F.coalesce((F.lead("ch").over(after) == " ") & F.lead("x0").over(after).isNull(), F.lit(False)))
    return _followed_by_blanks(marked.where("x0 is not null"), glyphs.columns)


def _followed_by_blanks(rows: DataFrame, columns: list[str]) -> DataFrame:
    own = [c for c in columns if c not in ("seq", "ch")]
    one = F.struct((2 * F.col("seq")).alias("seq"), F.col("ch"))
    blank = F.struct((2 * F.col("seq") + 1).alias("seq"), F.lit(" ").alias("ch"))
    return rows.select(*own, F.inline(F.when(F.col("twin"), F.array(one, blank)).otherwise(F.array(one)))).select(*columns)


def spaced_texts(glyphs: DataFrame | Sheets, share: float) -> DataFrame:
    """Text of each page with the blanks of ``with_spaces``, for a space of ``share`` of a glyph's size, and how many are inserted."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        n = len(g)
        space, gap = g["size"] * share / 3, np.zeros(n, bool)
        gap[:-1] = (np.abs(g["x0"][1:] - g["x1"][:-1]) > space[:-1]) | (np.abs(g["y1"][1:] - g["y1"][:-1]) > space[:-1])
        gap[:-1] &= ~g.first()[1:]
        ends = np.arange(n) + np.cumsum(gap)
        taken = np.full(n + int(gap.sum()), n)
        taken[ends - gap] = np.arange(n)
        count, inserted = np.bincount(g.page, minlength=g.pages), np.bincount(g.page[gap], minlength=g.pages)
        some = np.flatnonzero(count)
        text = sheets.joined(pa.concat_arrays([g.ch, pa.array([" "])]), taken, (count + inserted)[some])
        return sheets.keyed(batch, some) | {"inserted": inserted[some], "text": text}

    own = sheets.of(glyphs, ("ch", *BOX, "size"))
    return sheets.over(own, ("ch", *BOX, "size"), kernel, f"{sheets.kinds(own.rows, *PAGE)}, inserted long, text string")


def marked_blanks(glyphs: DataFrame | Sheets) -> DataFrame:
    """Per page what ``with_marked_spaces`` gives: how many glyphs, how many of them blanks, and the sum of their right borders."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        bare, twin = np.isnan(g["x0"]), np.zeros(len(g), bool)
        mark = bare & pc.equal(g.ch, " ").to_numpy(zero_copy_only=False)
        twin[:-1] = mark[1:] & ~g.first()[1:]
        twin &= ~bare
        own, twins = np.bincount(g.page[~bare], minlength=g.pages), np.bincount(g.page[twin], minlength=g.pages)
        reach = np.nan_to_num(g["x1"]) * (~bare + twin.astype(np.int64))
        some = np.flatnonzero(own)
        return sheets.keyed(batch, some) | {"n": (own + twins)[some], "blanks": twins[some], "reach": np.bincount(g.page, reach, g.pages)[some]}

    own = sheets.of(glyphs, ("ch", *BOX))
    return sheets.over(own, ("ch", *BOX), kernel, f"{sheets.kinds(own.rows, *PAGE)}, n long, blanks long, reach double")


def text_layer(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """pages with has_text: whether a glyph with a font stands on the page."""
    some = glyphs.where("font is not null").select(*PAGE).distinct().withColumn("has_text", F.lit(True))
    return pages.join(some, PAGE, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def _votes(g: Glyphs, page: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per area: glyphs that are wider than high, the others, and whether it is turned."""
    area, glyph = sheets.contained(g.page, g.boxes(), page, boxes)
    across = ((g["x1"] - g["x0"]) > (g["y1"] - g["y0"]))[glyph]
    wide, high = np.bincount(area[across], minlength=len(page)), np.bincount(area[~across], minlength=len(page))
    return wide, high, (wide + high >= 10) & (wide >= high)


def direction(glyphs: DataFrame | Sheets, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Per area: how many glyphs in it are wider than high, how many not, and the direction that they vote for."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        page, columns = sheets.areas_of(batch)
        wide, high, turned = _votes(g, page, sheets.boxes_of(columns))
        return sheets.keyed(batch, page) | {k: columns[k] for k in keys} | {"wide": wide, "high": high, "direction": pc.if_else(pa.array(turned), "left", "up")}

    return sheets.over(glyphs, tuple(BOX), kernel, f"{sheets.kinds(areas, *PAGE, *keys)}, wide long, high long, direction string", areas.select(*PAGE, *keys, *BOX))


def _mean_sizes(g: Glyphs, page: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Per area the mean size of the glyphs of a size that lie in it; NaN without any."""
    sized = g.where((g["size"] != 0) & ~np.isnan(g["size"]))
    area, glyph = sheets.contained(sized.page, sized.boxes(), page, boxes, closed=False)
    n = np.bincount(area, minlength=len(page))
    return np.where(n > 0, np.bincount(area, sized["size"][glyph], len(page)) / np.maximum(n, 1), np.nan)


def font_thresholds(glyphs: DataFrame | Sheets, areas: DataFrame, keys: list[str], zoom: Column) -> DataFrame:
    """Per area the space and column thresholds, from the mean size of its glyphs.

    A page without glyphs gets fixed values; an area without any on a page with some is an error
    (thresholds are null).
    """

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        page, columns = sheets.areas_of(batch)
        mean = _mean_sizes(g, page, sheets.boxes_of(columns))
        some = np.bincount(g.page, minlength=g.pages) > 0
        return sheets.keyed(batch, page) | {k: columns[k] for k in columns} | {"mean": pa.array(mean, mask=np.isnan(mean)), "some": some[page]}

    rest = [c for c in areas.columns if c not in PAGE]
    got = sheets.over(glyphs, (*BOX, "size"), kernel, f"{sheets.kinds(areas, *PAGE, *rest)}, mean double, some boolean", areas)
    auto, space = NO_GLYPHS
    return got.select(
        *PAGE,
        *keys,
        F.when(~F.col("some"), F.lit(space)).otherwise(F.col("mean") * 0.8).alias("space_threshold"),
        F.when(~F.col("some"), F.lit(auto)).otherwise((F.col("mean") * 0.55 * 1.65 * zoom).cast("int").cast("double")).alias("column_threshold"),
        (F.col("some") & F.col("mean").isNull()).alias("error"),
    )


_STEMS = sorted({w[:k] for w in ("Table", "TABLE") for k in range(6)})


def _anchors(g: Glyphs) -> np.ndarray:
    """Glyphs where the word Table or TABLE begins; a word that ends the page doesn't count."""
    place = np.flatnonzero(pc.is_in(g.ch, pa.array(_STEMS)).to_numpy(zero_copy_only=False))
    place = place[place + 5 < len(g)]
    place = place[g.page[place] == g.page[place + 5]]
    word = pc.binary_join_element_wise(*[g.ch.take(pa.array(place + k)) for k in range(5)], "")
    return place[pc.is_in(word, pa.array(["Table", "TABLE"])).to_numpy(zero_copy_only=False)]


def _caption_areas(g: Glyphs, page: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outline, box from its anchor down to it) of the outlines with an anchor that is near enough. Of equally near anchors the first counts."""
    at = _anchors(g)
    starts = np.searchsorted(g.page, np.arange(g.pages))
    begin = np.searchsorted(g.page[at], page)
    size = np.searchsorted(g.page[at], page, "right") - begin
    o, k = np.repeat(np.arange(len(page)), size), at[sheets.ranges(begin, size)]
    far = (boxes[1][o] - g["y0"][k]) / g["page_h"][k]
    above = (g["y0"][k] < boxes[1][o]) & ~np.isnan(far)
    o, k, far = o[above], k[above], far[above]
    order = np.lexsort((k, far, o))
    o, k, far = o[order], k[order], far[order]
    best = np.ones(len(o), bool)
    best[1:] = o[1:] != o[:-1]
    o, k, far = o[best], k[best], far[best]
    x0, y0, x1, _ = (b[o] for b in boxes)
    left, top = g["x0"][k], g["y0"][k]
    beside = (np.abs(x0 - left) / g["page_w"][k] < 0.1) | ((x0 < left) & (left < x1))
    near = (k > starts[g.page[k]]) & (far < 0.2) & beside
    over = np.maximum(x0 - left, 0.0)  # a caption that begins left of the outline ends as far right of it
    return o[near], np.stack([x0 - over, top, x1 + over, y0])[:, near]


def captions(glyphs: DataFrame | Sheets, outlines: DataFrame, keys: list[str]) -> DataFrame:
    """Caption of each outline: from the nearest 'Table' above it down to the outline; empty if none is near enough.

    glyphs: with page_w and page_h; outlines: in page units. An anchor at a page's very start doesn't count.
    """

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        page, columns = sheets.areas_of(batch)
        outline, scan = _caption_areas(g, page, sheets.boxes_of(columns))
        found = _texts(g, page[outline], scan)
        place = np.full(len(page), len(outline))
        place[outline] = np.arange(len(outline))
        caption = pa.concat_arrays([found, pa.array([""])]).take(pa.array(place))
        return sheets.keyed(batch, page) | {k: columns[k] for k in keys} | {"caption": caption}

    return sheets.over(glyphs, ("ch", *BOX, "page_w", "page_h"), kernel, f"{sheets.kinds(outlines, *PAGE, *keys)}, caption string", outlines.select(*PAGE, *keys, *BOX))


def _words(g: Glyphs, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of the glyphs of each word, the glyphs that aren't blank, and the number of each of those words on its page."""
    blank, fresh = g.blank(), np.ones(len(g), bool)
    near = (g["x0"][1:] - g["x1"][:-1] <= gap) & (np.abs(g["y0"][1:] - g["y0"][:-1]) <= gap) & ~blank[:-1]
    fresh[1:] = ~near | g.first()[1:]
    number = np.cumsum(fresh)
    shown = np.flatnonzero(~blank)
    first = np.ones(len(shown), bool)
    first[1:] = number[shown[1:]] != number[shown[:-1]]
    begin = np.flatnonzero(first)
    before = np.concatenate([[0], number])[np.searchsorted(g.page, g.page[shown[begin]])]
    return begin, shown, number[shown[begin]] - before


def _word_boxes(g: Glyphs, begin: np.ndarray, shown: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros((4, 0))
    return np.stack([low.reduceat(g[c][shown], begin) for c, low in zip(BOX, (np.fmin, np.fmin, np.fmax, np.fmax), strict=True)])


def words(glyphs: DataFrame | Sheets, gap: float = 3.0) -> DataFrame:
    """Words of each page with their boxes: a blank, or a step of more than ``gap`` to the right or between lines, ends one."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        begin, shown, number = _words(g, gap)
        text = sheets.joined(g.ch, shown, np.diff(np.append(begin, len(shown))))
        boxes = [pa.array(b, mask=np.isnan(b)) for b in _word_boxes(g, begin, shown)]
        return sheets.keyed(batch, g.page[shown[begin]]) | {"word": number, "text": text} | dict(zip(BOX, boxes, strict=True))

    own = sheets.of(glyphs, ("ch", *BOX))
    return sheets.over(own, ("ch", *BOX), kernel, f"{sheets.kinds(own.rows, *PAGE)}, word long, text string, x0 double, y0 double, x1 double, y1 double")


def _sessions(page: np.ndarray, values: np.ndarray, tolerance: float) -> tuple[np.ndarray, ...]:
    """Sessions of equal and following values of each page: page, first, mean of the distinct values, and how many values."""
    known = ~np.isnan(values)
    page, values = page[known], values[known]
    order = np.lexsort((values, page))
    page, values = page[order], values[order]
    if not len(page):
        return page, values, values, page
    other = np.ones(len(page), bool)
    other[1:] = (page[1:] != page[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(other)
    n, page, values = np.diff(np.append(at, len(page))), page[at], values[at]
    fresh = np.ones(len(page), bool)
    fresh[1:] = (page[1:] != page[:-1]) | (values[1:] - values[:-1] > tolerance)
    at = np.flatnonzero(fresh)
    return page[at], values[at], np.add.reduceat(values, at) / np.diff(np.append(at, len(page))), np.add.reduceat(n, at)


def _edges(page: np.ndarray, boxes: np.ndarray, pages: int, scale: int, tolerance: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page, whether it is a column line, and position of each candidate rule."""
    rows = _sessions(np.tile(page, 2), np.concatenate([boxes[1], boxes[3]]), tolerance)
    starts = _sessions(page, boxes[0], tolerance)
    columns = starts[3] >= least
    ends = np.full(pages, -np.inf)
    np.fmax.at(ends, page, boxes[2])
    right = np.flatnonzero(np.isfinite(ends))
    own = np.concatenate([rows[0], starts[0][columns], right])
    at = np.concatenate([rows[2], starts[1][columns], ends[right]])
    return own, np.arange(len(own)) >= len(rows[0]), np.trunc(at).astype(np.int64) * scale


_EDGES = "kind string, position int"


def _edge_rows(batch: pa.RecordBatch, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    page, column, position = edges
    return sheets.keyed(batch, page) | {"kind": pc.if_else(pa.array(column), "v", "h"), "position": position.astype(np.int32)}


def page_edges(glyphs: DataFrame | Sheets, gap: float = 3.0, scale: int = 6, tolerance: float = 3.0, least: int = 3) -> DataFrame:
    """``word_edges`` of ``words``, without the words as rows."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        begin, shown, _ = _words(g, gap)
        return _edge_rows(batch, _edges(g.page[shown[begin]], _word_boxes(g, begin, shown), g.pages, scale, tolerance, least))

    own = sheets.of(glyphs, ("ch", *BOX))
    return sheets.over(own, ("ch", *BOX), kernel, f"{sheets.kinds(own.rows, *PAGE)}, {_EDGES}")


def word_edges(found: DataFrame, scale: int = 6, tolerance: float = 3.0, least: int = 3) -> DataFrame:
    """Candidate rules of a page in pixels: pdf_id, page, kind (h or v), position. found: see ``words``.

    Rows part at tops and bottoms of lines, columns where ``least`` words or more begin, and at the
    right of them all; positions within the tolerance are one.
    """

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        return _edge_rows(batch, _edges(g.page, g.boxes(), g.pages, scale, tolerance, least))

    own = sheets.of(found.withColumn("seq", F.col("word").cast("long")), tuple(BOX))
    return sheets.over(own, tuple(BOX), kernel, f"{sheets.kinds(own.rows, *PAGE)}, {_EDGES}")


# ---- profiles ---------------------------------------------------------------------------


def row_separators(profile: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Lines in the middle of runs of rows with no more ink than ``least``. profile: keys, y, ink; y without gaps."""
    order = Window.partitionBy(*keys).orderBy("y")
    blank = profile.where(F.col("ink") <= least).withColumn("island", F.col("y") - F.row_number().over(order))
    runs = blank.groupBy(*keys, "island").agg(F.min("y").alias("start"), F.count("*").alias("n"))
    return runs.select(*keys, "start", "n", F.floor(F.col("start") + 0.5 * (F.col("n") - 1) + 0.5).cast("int").alias("y"))


def bands(separators: DataFrame, keys: list[str]) -> DataFrame:
    """Strips between neighbouring separators: keys, band, top, bottom."""
    order = Window.partitionBy(*keys).orderBy("y")
    return separators.select(*keys, (F.row_number().over(order) - 1).alias("band"), F.col("y").alias("top"), F.lead("y").over(order).alias("bottom")).where("bottom is not null")


def column_gaps(profile: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Runs of columns without ink, of more than ``threshold`` columns, per band. profile: keys, band, x, ink; x without gaps."""
    order = Window.partitionBy(*keys, "band").orderBy("x")
    blank = profile.where(F.col("ink") == 0).withColumn("island", F.col("x") - F.row_number().over(order))
    runs = blank.groupBy(*keys, "band", "island").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    return runs.where(F.col("right") - F.col("left") >= threshold).select(*keys, "band", "left", "right")


def page_gaps(glyphs: DataFrame | Sheets, profile: Callable[[Glyphs], tuple[np.ndarray, np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """``column_gaps`` of a profile of each page, without the profile as rows. profile: band, x and ink (0 or 1) of each glyph."""

    def kernel(g: Glyphs, batch: pa.RecordBatch) -> dict:
        band, x, ink = profile(g)
        order = np.lexsort((ink, x, band, g.page))
        page, band, x, ink = g.page[order], band[order], x[order], ink[order]
        other = np.ones(len(page), bool)
        other[:-1] = (page[1:] != page[:-1]) | (band[1:] != band[:-1]) | (x[1:] != x[:-1])
        clear = np.flatnonzero(other & (ink == 0))  # a column's last glyph has most ink
        page, band, x = page[clear], band[clear], x[clear]
        fresh = np.ones(len(page), bool)
        fresh[1:] = (page[1:] != page[:-1]) | (band[1:] != band[:-1]) | (x[1:] != x[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(page))[: len(begin)] - 1
        wide = x[end] - x[begin] >= least
        begin, end = begin[wide], end[wide]
        return sheets.keyed(batch, page[begin]) | {"band": band[begin].astype(np.int32), "left": x[begin].astype(np.int32), "right": x[end].astype(np.int32)}

    own = sheets.of(glyphs, ("ch", *BOX))
    return sheets.over(own, ("ch", *BOX), kernel, f"{sheets.kinds(own.rows, *PAGE)}, band int, left int, right int")


def blocks(gaps: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """Blank (kind 0) and content (kind 1) blocks of each band that has a gap, from column 0 to ``last``.

    Neighbours share a border. What follows the last gap is content, unless that gap ends at column 1.
    """
    order = Window.partitionBy(*keys, "band").orderBy("left")
    framed = gaps.withColumns({"before": F.coalesce(F.lag("right").over(order), F.lit(0)), "first": F.row_number().over(order) == 1, "final": F.lead("left").over(order).isNull()})
    block = lambda a, b, kind: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("x1"), F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"))
    content = F.when(~(F.col("first") & (F.col("left") == 0)), block(F.col("before"), F.col("left"), 1))
    tail = F.when(F.col("final") & (F.col("right") != last), block(F.col("right"), last, F.when(F.col("right") == 1, 0).otherwise(1)))
    made = F.filter(F.array(content, block(F.col("left"), F.col("right"), 0), tail), lambda x: x.isNotNull())
    return framed.select(*keys, "band", F.inline(made))


def glyph_bands(glyphs: DataFrame, keys: list[str], low: str = "y0", high: str = "y1") -> DataFrame:
    """Runs of overlapping glyph intervals: keys, band, top, bottom, glyphs. This stands in for ink where there is no image."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0)
    spans = glyphs.groupBy(*keys, low, high).agg(F.count("*").alias("n"))  # equal intervals first: lines have few
    marked = spans.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(order) - 1)
    return marked.groupBy(*keys, "band").agg(F.min(low).alias("top"), F.max(high).alias("bottom"), F.sum("n").alias("glyphs"))


def rule_lines(segments: DataFrame, keys: list[str], pixels: int = 2000) -> DataFrame:
    """framed or unframed, by how many pixels of vertical rules a table has. segments: keys, length."""
    return segments.groupBy(*keys).agg(F.when(F.sum("length") > pixels, "framed").otherwise("unframed").alias("table_type"))

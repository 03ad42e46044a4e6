"""Glyphs by the page against glyphs as rows, and how much the queries over them shuffle."""

import pytest
from pyspark.sql import functions as F

from tabulith.operators import layout, sheets
from tabulith.plans import fixtures as fx
from tabulith.plans import registry

SF_DIR = "/root/testdata/sf0.001"
BY_PAGE = ["glyph_cell_text", "caption_nearest", "word_edges", "word_boxes", "space_insertion", "space_duplication", "direction_vote", "content_blocks", "column_gaps"]  # queries that must not shuffle glyphs one by one


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in (sc.statusStore().executorList(False).apply(k) for k in range(sc.statusStore().executorList(False).size())))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts of one to four bytes a character, around the size of a page, empty, null, and two of one id."""
    texts = ["", None, "a", "é∂𝒳 x" * 900, "x " * 2000, "y " * 2000 + "z", "tail" * 141 + "ab", "tail" * 141 + "abc", " " * 570, "Lorem  ipsum\n" * 700]
    rows = [(k, t, "en", "web", 0) for k, t in enumerate(texts)] + [(9, "again\t" * 300, "en", "web", 0), (12, "Ω" * 568, "en", "web", 0), (15, "q" * 4001, "en", "web", 0)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_pages_hold_the_glyphs_of_rows(spark, odd):
    def listed(g, batch):
        shown = {c: g[c] for c in sheets.NUMBERS}
        return sheets.keyed(batch, g.page) | {"ch": g.ch} | shown

    names = ("ch", *sheets.NUMBERS)
    made = "pdf_id long, page int, ch string, " + ", ".join(f"{c} double" for c in sheets.NUMBERS)
    got = sheets.over(fx.glyph_pages(spark, odd), names, listed, made)
    want = fx.glyphs(spark, odd).select("pdf_id", "page", *names)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 20000


def test_areas_hold_the_glyphs_that_a_range_join_finds(spark, odd):
    sizes = "explode(array(array(0, 0, 1, 1), array(0.1, 0.15, 0.9, 0.55), array(0.3, 0.3, 0.3, 0.9), array(0.5, 0.5, 0.2, 0.2))) AS b"
    areas = fx.sheets(spark, odd).selectExpr("*", sizes).selectExpr("pdf_id", "page", "CAST(b[0] * 100 + b[2] * 10 AS INT) AS k", *[f"CAST(b[{i}] * {n} AS DOUBLE) AS {c}" for i, (c, n) in enumerate(zip(layout.BOX, ("width", "height") * 2, strict=True))]).distinct()
    glyphs = fx.glyphs(spark, odd)
    found = layout.within(glyphs.select("pdf_id", "page", "seq", "ch", *layout.shrink(0.5)), areas).groupBy("pdf_id", "page", "a_k").agg(layout.in_order().alias("text"))
    want = {(r.pdf_id, r.page, r.a_k): r.text for r in found.collect() if r.pdf_id != 9}
    for source in (glyphs, fx.glyph_pages(spark, odd)):
        rows = layout.area_text(source, areas, ["k"]).collect()
        assert {(r.pdf_id, r.page, r.k): r.text for r in rows if r.text and r.pdf_id != 9} == want and len(rows) == areas.count()


def test_blanks_of_pages_are_those_of_rows(spark, odd):
    once = fx.glyphs(spark, odd).where("pdf_id <> 9")
    rows = layout.with_spaces(once, F.col("size") * 0.8).groupBy("pdf_id", "page").agg(F.count_if(F.col("seq") % 2 == 1).alias("inserted"), layout.in_order().alias("text"))
    got = layout.spaced_texts(once, 0.8)
    assert got.exceptAll(rows).count() == rows.exceptAll(got).count() == 0
    bare = once.withColumns({c: F.when(F.col("ch") != " ", F.col(c)) for c in layout.BOX})
    rows = layout.with_marked_spaces(bare).groupBy("pdf_id", "page").agg(F.count("*").alias("n"), F.count_if(F.col("seq") % 2 == 1).alias("blanks"), F.sum("x1").alias("reach"))
    got = layout.marked_blanks(bare)
    assert got.exceptAll(rows).count() == rows.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", BY_PAGE)
def test_glyphs_are_not_shuffled_one_by_one(spark, name):
    text = spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    registry.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 2 * text


def test_meta_of_printed_pages_is_that_of_rows(spark):
    from tabulith.operators import extract

    detections, pages, rows = fx.printed(spark, SF_DIR)
    want, got = (extract.table_meta(detections, pages, g) for g in (rows, fx.printed_pages(spark, SF_DIR)))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.where("direction = 'left'").count() and got.where("direction = 'up'").count()

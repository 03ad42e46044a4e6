"""Gates, fusion, layout and grids on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.operators import fuse, gates, grid, layout
from tabulith.sources import readers, writers

CELL = "pdf_id long, page int, table_id int, rid int, cid int, value string"


def table(rows, pdf_id=1, page=0, table_id=0):
    return [(pdf_id, page, table_id, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def quality(spark, rows):
    return gates.table_quality(spark.createDataFrame(table(rows), CELL)).first()


GOOD = [["Sample", "Sm (ppm)", "143Nd/144Nd", "2σ"], *[[f"S{i}", f"{i}.5", f"0.51200{i}", f"0.00001{i}"] for i in range(1, 8)]]


def test_a_good_table_and_each_gate(spark):
    got = quality(spark, GOOD)
    assert (got.bad, got.has_header, got.accepted_extract, got.accepted_fuse) == (False, True, True, True)
    assert quality(spark, GOOD[:4]).bad_format
    assert quality(spark, [*GOOD, ["S9", "(cid:3)", "", ""]]).bad_encoding
    assert quality(spark, [*GOOD, ["S9", "1.2.3.4", "", ""]]).bad_mixture
    assert quality(spark, [*GOOD, ["S9", "O土1", "", ""]]).bad_text
    assert quality(spark, [["a b"] * 4] * 8).bad_text
    assert quality(spark, [[None] * 4] * 8).bad_format


def test_no_tables(spark):
    none = spark.createDataFrame([], CELL)
    assert gates.table_quality(none).count() == 0
    assert fuse.fuse(none, ["a"], ["b"]).count() == 0


def test_attempts(spark):
    rows = [(1, 0, 0, 0, True, False, None), (1, 0, 0, 1, None, None, "no grid"), (1, 0, 0, 2, True, True, None), (1, 0, 0, 3, False, False, None), (2, 0, 0, 0, True, False, None)]
    df = spark.createDataFrame(rows, "pdf_id long, page int, table_id int, attempt int, bad boolean, has_header boolean, error string")
    assert [(r.pdf_id, r.attempt) for r in gates.select_attempt(df).collect()] == [(1, 2)]
    assert [(r.attempt, r.error) for r in gates.errors(df).collect()] == [(1, "no grid")]


def attributes(spark, *tables):
    cells = spark.createDataFrame([c for t in tables for c in t], CELL)
    return {(r["sample"], r.header): r.value for r in fuse.fuse(cells, ["karakol"], ["granite"]).collect()}


def test_last_write_wins_and_lithology_only_if_absent(spark):
    first = [["Sample", "Sm", "143Nd/144Nd", ""], *[[f"S{i % 2}", f"{i}.5", f"0.51200{i}", "granite" if i < 3 else "7"] for i in range(1, 8)]]
    got = attributes(spark, table(first))
    assert got["S1", "Sm"] == "7.5" and got["S0", "Sm"] == "6.5"
    assert got["S1", "Lithology"] == "granite" and got["S1", ""] == "7"


def test_plutons_fill_downwards(spark):
    rows = [["Sample", "Sm", "143Nd/144Nd", "x"], ["Karakol", "", "", ""], *[[f"S{i}", f"{i}.5", f"0.51200{i}", "1"] for i in range(1, 4)], ["other", "", "", ""], *[[f"T{i}", f"{i}.7", f"0.51210{i}", "2"] for i in range(1, 4)]]
    got = attributes(spark, table(rows))
    assert {got[s, "Pluton"] for s in ("S1", "S2", "S3", "T1", "T2", "T3")} == {"Karakol"}
    with_column = [[*rows[0][:3], "Pluton"], *rows[1:]]
    assert attributes(spark, table(with_column))["S1", "Pluton"] == "1"


def test_secondary_tables_in_both_orientations(spark):
    down = [["Sample", "Latitude", "x", "y"], *[[f"S{i}", f"{i}0.1", "1", "2"] for i in range(1, 8)]]
    across = [["Name", "S1", "S2", "S3", "S4"], *[["Longitude" if k == 0 else "z", *[f"{k}{i}.3" for i in range(1, 5)]] for k in range(7)]]
    got = attributes(spark, table(GOOD), table(down, page=1), table(across, page=2))
    assert got["S2", "Latitude"] == "20.1" and got["S3", "Longitude"] == "03.3"
    assert ("Name", "Longitude") not in got


def test_records_follow_the_order_of_attributes(spark):
    def record(*pairs):
        rows = [(1, "S", h, v, k) for k, (h, v) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "pdf_id long, sample string, header string, value string, first_seq int")
        papers = spark.createDataFrame([(1, "t", None, "j", "1999", "1", "2", "d", "3", ["A"])], "pdf_id long, title string, abstract string, journal string, year string, first_page string, last_page string, doi string, volume string, author array<string>")
        return fuse.records(df, papers, {k: [] for k in ("geotectonic", "tectonic", "subtectonic", "lithology", "pluton")}).first()

    ratio, sigma = "143Nd/144Nd", "2σ"
    a = record(("Sample", "S"), (ratio, "0.512±0.000012"), (sigma, ""))
    assert (a[ratio], a[sigma]) == ("0.512", "")
    b = record(("Sample", "S"), (sigma, "0.5"), (ratio, "0.512±0.000012"))
    assert (b[ratio], b[sigma]) == ("0.512", "12")
    c = record(("Sample", "S"), (ratio, "0.5(1)±3"), ("Sm", "1"))
    assert (c[ratio], c[sigma]) == ("0.5", "1")
    d = record(("Sample", "S"), ("Sm", "1"), (ratio, "0.5(1)±3"))
    assert (d[ratio], d[sigma]) == ("0.5(1)", "3")
    assert (a["Ref. Author"], a["Page"], a["DOI"], len(a) - 1) == ("A et al.", "1-2", "d", 25)


def test_fill_rate_without_records(spark):
    from tabulith.functions.cells import COLUMNS

    none = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in COLUMNS))
    assert tuple(fuse.fill_rate(none).first()) == (0, 0, None)


GLYPH = "pdf_id long, page int, seq long, ch string, font string, x0 double, y0 double, x1 double, y1 double, size double, page_w double, page_h double"


def line(text, y=100.0, x=10.0, seq=0, step=6.0):
    return [(1, 0, seq + i, ch, "F", x + i * step, y, x + i * step + 5, y + 10, 10.0, 500.0, 600.0) for i, ch in enumerate(text)]


def test_area_text_and_spaces(spark):
    glyphs = spark.createDataFrame(line("abc") + line("def", x=60.0, seq=3), GLYPH)
    areas = spark.createDataFrame([(1, 0, 1, 0.0, 90.0, 40.0, 120.0), (1, 0, 2, 200.0, 0.0, 210.0, 10.0)], "pdf_id long, page int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.text for r in layout.area_text(glyphs, areas, ["k"]).collect()} == {1: "abc", 2: ""}
    spaced = layout.with_spaces(glyphs, F.lit(9.0)).groupBy("page").agg(layout.in_order().alias("text"))
    assert spaced.first().text == "abc def"


def test_words_and_their_edges(spark):
    rows = [g for k in range(3) for g in line("ab cd", y=100.0 + 20 * k, seq=5 * k)]
    found = layout.words(spark.createDataFrame(rows, GLYPH))
    assert sorted((r.text, r.x0, r.y0) for r in found.collect()) == sorted((t, x, 100.0 + 20 * k) for k in range(3) for t, x in (("ab", 10.0), ("cd", 28.0)))
    edges = layout.word_edges(found).collect()
    assert sorted(e.position for e in edges if e.kind == "v") == [60, 168, 39 * 6]
    assert sorted(e.position // 6 for e in edges if e.kind == "h") == [100, 110, 120, 130, 140, 150]


def test_captions_need_an_anchor_that_is_near(spark):
    glyphs = spark.createDataFrame(line("x Table 1. Rocks", y=80.0), GLYPH)
    near, far = (1, 0, 1, 20.0, 100.0, 200.0, 300.0), (1, 0, 2, 20.0, 400.0, 200.0, 500.0)
    outlines = spark.createDataFrame([near, far], "pdf_id long, page int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.caption for r in layout.captions(glyphs, outlines, ["k"]).collect()} == {1: "Table 1. Rocks", 2: ""}


def test_separators_agree_with_a_scan(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        ink = rng.integers(0, 3, 60)
        want, y = [], 0
        while y < len(ink):
            if ink[y] == 0:
                start = y
                while y < len(ink) and ink[y] == 0:
                    y += 1
                want.append(int(start + 0.5 * (y - start - 1) + 0.5))
            y += 1
        df = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(ink)], "k int, y int, ink int")
        assert sorted(r.y for r in layout.row_separators(df, ["k"]).collect()) == want
        assert grid.separators(np.repeat(ink[:, None] > 0, 3, axis=1), 0) == want


def test_rotation_four_times_is_the_identity(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.6)], "x0 double, y0 double, x1 double, y1 double")
    for _ in range(4):
        df = df.select(*layout.rotate(F.lit("left")))
    assert tuple(df.first()) == pytest.approx((0.1, 0.2, 0.3, 0.6))


def test_a_borderless_table_of_three_by_three():
    ink = np.zeros((100, 300), dtype=bool)
    for y in (15, 45, 75):
        for x in (20, 120, 220):
            ink[y : y + 12, x : x + 50] = True
    got = grid.borderless(ink, 20)
    assert (len(got.rows) - 1, len(got.columns) - 1, len(got.cells)) == (3, 3, 9)
    assert grid.borderless(np.zeros((10, 10), dtype=bool), 2) is None
    assert grid.borderless(np.ones((10, 10), dtype=bool), 2) is None


def test_a_ruled_table_with_a_wide_cell():
    horizontal = [(y, 0, 300) for y in (0, 50, 100, 150)]
    vertical = [(0, 0, 150), (300, 0, 150), (100, 0, 150), (200, 50, 150)]
    got = grid.ruled(horizontal, vertical, 20)
    assert (0, 1, 1, 3) in got.cells and (1, 2, 1, 2) in got.cells
    assert len(got.cells) == 8
    assert grid.ruled([], [], 20) is None


def test_detections_round_trip(spark, tmp_path):
    rows = [("p1", 0, 0, 0.1, 0.2, 0.5, 0.6), ("p1", 0, 1, 0.3, 0.7, 0.9, 0.95), ("p2", 3, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pdf_id string, page int, table_id int, x0 double, y0 double, x1 double, y1 double")
    writers.write_detections(df, f"file://{tmp_path}/found")
    assert sorted(map(tuple, readers.read_detections(spark, f"file://{tmp_path}/found").collect())) == rows
    lines = spark.createDataFrame([("/in/p3.pdf_007:[]",), ("nonsense",), (None,)], "value string")
    assert readers.parse_detections(lines).count() == 0


def test_xml_metadata_marks_and_labels(spark, tmp_path):
    xml = '<page id="1" bbox="0,0,200,400">\n<text font="F" bbox="10,20,15,30" size="9.5">A</text>\n<text> </text>\n<text font="F" bbox="20,20,25,30" size="9.5">&amp;</text></page>'
    got = readers.parse_glyphs(spark.createDataFrame([("p", 0, xml)], "pdf_id string, page int, xml string")).orderBy("seq").collect()
    assert [(g.ch, g.x0, g.y0, g.y1, g.size) for g in got] == [("A", 10.0, 370.0, 380.0, 9.5), (" ", None, None, None, None), ("&amp;", 20.0, 370.0, 380.0, 9.5)]
    meta = '{"p1": {"title": "T", "abstract": "A", "journal": "J", "year": 1999, "first_page": 1, "last_page": "9", "doi": "d", "volume": 3, "author": {"name": ["X", "Y"]}}, "p2": {}}'
    got = {r.pdf_id: r for r in readers.parse_metadata(spark.createDataFrame([(meta,)], "value string")).collect()}
    assert (got["p1"].year, got["p1"].author, got["p2"].title, got["p2"].author) == ("1999", ["X", "Y"], None, [])
    (tmp_path / "marks").mkdir()
    (tmp_path / "marks/1_a.pdf.txt").write_text("[1, 0]")
    (tmp_path / "marks/0_b.pdf.txt").write_text("[]")
    assert sorted((r.pdf_id, r.has_header, r.table_marks) for r in readers.read_marks(spark, f"file://{tmp_path}/marks").collect()) == [("a", True, [1, 0]), ("b", False, [])]
    (tmp_path / "terms.json").write_text('["b", "a", "b"]')
    assert readers.read_terms(spark, {"k": f"file://{tmp_path}/terms.json"}) == {"k": ["a", "b"]}
    (tmp_path / "labels.csv").write_text("id,available,degree,encode,format,mixed,unused,total\n209,-100,,1,,,,\n210,,,,1,,,2\n")
    assert [tuple(r)[:5] for r in readers.read_labels(spark, f"file://{tmp_path}/labels.csv").orderBy("pdf_id").collect()] == [("0209", False, 0, 1, 0), ("0210", True, 0, 0, 1)]


def test_merged_cells_and_records_are_written(spark, tmp_path):
    units = spark.createDataFrame([(1, 0, 0, 0, 1, 0, 2, "wide"), (1, 0, 0, 0, 1, 2, 3, "c")], "pdf_id long, page int, table_id int, row_begin int, row_end int, column_begin int, column_end int, text string")
    cells = writers.spread(units)
    assert sorted((r.rid, r.cid, r.value) for r in cells.collect()) == [(0, 0, "wide"), (0, 1, ""), (0, 2, "c")]
    writers.write_cells(cells, f"file://{tmp_path}/cells")
    assert readers.read_cells(spark, f"file://{tmp_path}/cells").count() == 3
    writers.write_table_sheets(cells, f"file://{tmp_path}/sheets", 3)
    assert spark.read.csv(f"file://{tmp_path}/sheets").count() == 1


def test_papers_are_listed_by_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.pdf", "deep/b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert sorted(r.pdf_id for r in readers.list_papers(spark, f"file://{tmp_path}").collect()) == ["a", "b"]


def test_an_adapter_reports_what_a_paper_raises(spark):
    from tabulith.sources import adapters

    class Fails:
        def boxes(self, content):
            if content == b"bad":
                raise ValueError("broken")
            return [(0, 0, 0.95, 0.1, 0.1, 0.9, 0.9)]

    papers = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "pdf_id string, content binary")
    got = {r.pdf_id: r for r in adapters.detected(papers, Fails).collect()}
    assert got["a"].score == 0.95 and got["b"].error == "ValueError: broken"


def test_increments_read_each_file_once(spark, tmp_path):
    from tabulith.streaming import ingest, state, upsert_stream

    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}"
    facts = lambda rows: spark.createDataFrame(rows, "k string, v int, at int").coalesce(1)
    facts([("a", 1, 1), ("b", 2, 1)]).write.parquet(source)
    run = lambda: (ingest(spark, source, "k string, v int, at int", f"{root}/c1", f"{root}/out"), spark.read.parquet(f"{root}/out").count())[1]
    assert (run(), run()) == (2, 2)
    facts([("a", 5, 2)]).write.mode("append").parquet(source)
    assert run() == 3
    merge = lambda df: df.groupBy("k").agg(F.max_by("v", "at").alias("v"))
    upsert_stream(spark, source, "k string, v int, at int", f"{root}/c2", f"{root}/state", lambda df: df, merge)
    assert {r.k: r.v for r in state(spark, f"{root}/state").collect()} == {"a": 5, "b": 2}


def test_states_are_versions(spark, tmp_path):
    from tabulith.streaming import state, upsert_stream, versions

    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    merge = lambda facts: facts.groupBy("k").agg(F.max_by("v", "at").alias("v"))
    for n in range(2):
        spark.createDataFrame([(1, n, f"v{n}"), (2 + n, n, "once")], "k int, at int, v string").write.mode("append").parquet(source)
        upsert_stream(spark, source, "k int, at int, v string", f"file://{tmp_path}/checkpoint", target, lambda rows: rows, merge)
        assert versions(spark, target) == list(range(n + 1))
        assert {r.k: r.v for r in state(spark, target).collect()} == {1: f"v{n}", **{2 + i: "once" for i in range(n + 1)}}

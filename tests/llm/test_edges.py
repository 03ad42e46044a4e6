"""Every query and the pipeline on awkward rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulith.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, size int, key string, score double, text_hash int, chunk int, held_out string, y int"
CLASH = ("r", 1, 2, "k", 0.5, 3, 4, "x", 5)
LONG = "Das ist ein langer Text über Häuser und Wälder. " * 9000


def documents():
    plain = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(i, f"{plain} number {i} " * 3, "en", f"s{i % 3}", 100) for i in range(30)]
    rows += [(100 + i, f"der schnelle braune Fuchs springt über den faulen Hund Nummer {i} " * 3, "de", None, None) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \n\t", None, "s1", 3), (203, LONG, "de", "s2", len(LONG)), (204, "12345 67890", "en", "s0", 11)]
    rows += [(205, "same text here for all of us", "en", "s0", 28)] * 3 + [(206, "same text here for all of us", "en", "s0", 28), (None, "no id but words enough to count", "en", "s1", 31)]
    rows += [(207, "mail a.b@c.example.org or 10.0.0.1, +49 30 1234567 and 4111 1111 1111 1111 \U0001f600 \u0000é", "en", "s1", 90)]
    return [(*r, *CLASH) for r in rows]


@pytest.fixture(scope="module", params=["awkward", "empty"])
def sf_dir(spark, tmp_path_factory, request):
    root = f"file://{tmp_path_factory.mktemp(request.param)}"
    full = request.param == "awkward"
    docs = documents() if full else []
    labels = [(r[0], i % 4 > 0, i % 5 == 0) for i, r in enumerate(docs)]
    vectors = [(i, [float(i % 7), 0.5, -1.0 * (i % 3)]) for i in range(60)] + [(70, None), (100, [None, 1.0, 2.0]), (150, [float("nan"), 1.0, 2.0]), (200, [float("inf"), 0.0, 0.0]), (50, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    pages = [(1, "http://a.example/1", "<p>One &amp; two</p>"), (1, "http://a.example/1", "<p>One &amp; two</p>"), (2, None, "<div><p>x"), (3, "bad", None), (4, "http://a.example/2", ""), (None, "", "<b>" * 500 + "deep" + "<")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels] + ([(0, None, None), (None, 1, 1), (5, 0, 0)] if full else []), "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(vectors if full else [], "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(pages if full else [], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root, full


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_for_each_input(spark, sf_dir, name):
    root, full = sf_dir
    got = queries.queries()[name](spark, root).collect()
    if not full:
        assert got == []
        return
    if name == "op6_topk":
        assert {r.query_id for r in got} == {0, 50} and all(r.vec_id not in (70, 100, 150, 200) for r in got)
        return
    key = "page_id" if "page_id" in got[0] else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    ids = [r[0] for r in spark.read.parquet(f"{root}/{table}.parquet").select(key).collect()]
    assert sorted((r[key] for r in got), key=str) == sorted(ids, key=str)
    if name == "op1_near_dup":
        group = {r.doc_id: r.class_id for r in got}
        assert group[205] == group[206] == 205 and group[200] == 200 and group[201] == group[202] == 201
    if name == "op9_langid":
        assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202, 204)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    if name in ("op3_toxicity", "op5_quality"):
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    if name == "op7_pii":
        r = next(r for r in got if r.doc_id == 207)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)


def test_the_pipeline_takes_them(spark, sf_dir):
    root, full = sf_dir
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = corpus_pipeline.run(spark, root).collect()
    assert bool(got) == full and all(len(r.ids) == r.n_tokens for r in got)


def test_a_text_alone(spark, tmp_path):
    spark.createDataFrame([(1, "one text", "en", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name in ("op1_near_dup", "op3_toxicity", "op5_quality", "op9_langid", "op2_mixing"):
        assert queries.queries()[name](spark, f"file://{tmp_path}").count() == 1
    assert queries.queries()["op8_bpe"](spark, f"file://{tmp_path}").select(F.sum("n_tokens")).first()[0] == 2

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tabulith.functions import cells, papers, text
from tabulith.operators.gates import mixed_cell

PIECES = [*"0123456789.,-()[]±–@+ Ee", "Nd", "Sm", "ab", "\t", " ", "٣", "²", "(cid:12)", "ε", "\n", "12.5", "0.000"]


def words(seed, n=400, most=12):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(most))) for _ in range(n)]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [r.y for r in df.select("i", make(F.col("v")).alias("y")).orderBy("i").collect()]


HEADERS = [
    ("εNd(t)", "εNd(t)"), ("143Nd/144Nd", "143Nd/144Nd"), ("147Sm/144Nd", "147Sm/144Nd"), ("Sm (ppm)", "Sm"), ("Nd [ppm]", "Nd"), ("nd ppm", "Nd"), ("Percentage", "Age(Ma)"),
    ("Combination", "Nation/Region/GeoTectonic unit/Groups"), ("±2σ", "2σ"), ("87Sr/86Sr 2σ", ""), ("Sub Groups", "Subtectonic unit/Sub groups"), ("Tectonic unit", "Tectonic unit"),
    ("Rock type", "Lithology"), ("SAMPLE", "Sample"), ("fSm/Nd", "fSm/Nd"), ("TDM1", "TDM1"), ("TDM2 (Ga)", "TDM2"), ("TDM", ""), ("", ""), (None, ""), ("S.m", "Sm"), ("Sm\\", ""),
]


@pytest.mark.parametrize("header, kind", HEADERS)
def test_header_type(spark, header, kind):
    assert column(spark, [header], cells.header_type) == [kind]


def test_strip_and_blanks_are_unicode(spark):
    got = column(spark, values := [*words(1), "　x\x1c", "  "], text.strip)
    assert got == [v.strip() for v in values]
    assert column(spark, values, text.filled) == [bool(v.strip()) for v in values]


def test_is_value(spark):
    values = words(2)
    assert column(spark, values, cells.is_value) == [bool(v.strip()) and not re.search("[A-Za-z]", v) for v in values]


@pytest.mark.parametrize(
    "ratio, parts",
    [("0.512±0.000012", ("0.512", "12")), ("0.512 ± 0.000012", ("0.512", "0000012")), ("0.5126(8)", ("0.5126", "8")), ("0.5126", ("0.5126", "")), (")0.5(", (")0.5(", "")), ("a±b±c", ("a", "b"))],
)
def test_uncertainty(spark, ratio, parts):
    df = spark.createDataFrame([(ratio, "")], "r string, s string")
    assert tuple(df.select(*cells.settled(F.col("r"), F.col("s"))).first()) == parts


def test_repeats(spark):
    values = ["abcdefabcde", "abcdeabcd", "aaaaaa", "aaaaa", "", "ab" * 4]

    def again(s):
        return any(s[i : i + 5] in s[i + 1 :] for i in range(len(s) - 4))

    assert column(spark, values, lambda c: text.repeats(c, 5)) == [again(v) for v in values]


def mixed(cell):
    """The rule, read off its description."""
    shown = [c for c in cell if c.strip()]
    if not shown:
        return False
    numeric = sum(c.isdigit() or c in string.punctuation or c in "Ee±–+" for c in shown) / len(shown) > 0.7
    signs, dashes = cell.count("±"), cell.count("–")
    dots = cell.count(".") - signs - dashes - cell.count("@") - len(re.findall(r"\(.*?\)", cell))
    again = any(cell[i : i + 5] in cell[i + 1 :] for i in range(len(cell) - 4))
    return numeric and (dots >= 2 or signs >= 2 or dashes >= 2 or again)


def test_mixed_cells(spark):
    values = [*words(3, 600, 16), "127 ± 4 Ma130 ± 4 Ma97.7 ± 1.5 Ma", "14,154,00014,154,000"]
    assert column(spark, values, mixed_cell) == [mixed(v) for v in values]


@pytest.mark.parametrize("abstract, age", [("at 127 ± 4 Ma and 130 Ma", "127 ± 4 Ma (?)"), ("97.7 Ma", "97.7 Ma"), ("none", ""), ("12\r3 Ma", "12\r3 Ma")])
def test_age(spark, abstract, age):
    assert column(spark, [abstract], papers.age) == [age]


def test_places_and_names(spark):
    title = "Ages in the Bayan Batholith, Central Altai, Tianshan"
    df = spark.createDataFrame([(title,)], "t string")
    assert tuple(df.select(*papers.places(F.col("t"))).first()) == (" Tianshan", " Central Altai", "the Bayan Batholith")
    df = spark.createDataFrame([("Rocks from Northern Beishan of the Tarim on Asia",)], "t string")
    assert tuple(df.select(*papers.names(F.col("t"))).first()) == ("Asia", "the Tarim", "Northern Beishan")
    assert tuple(spark.createDataFrame([("",)], "t string").select(*papers.names(F.col("t"))).first()) == ("", "", "")


def test_terms_prefer_the_longest_and_are_literal(spark):
    found = column(spark, ["in NORTH  tarim", "north tarim basin", "CALMALLÍ stock", "a.c", "abc", None], lambda c: papers.first_term(c, ["tarim", "north tarim", "calmallí", "a.c"]))
    assert found == ["tarim", "north tarim", "CALMALLÍ", "a.c", "", None]
    assert column(spark, ["x"], lambda c: papers.first_term(c, [])) == [""]


def test_long_runs_of_capitals_do_not_overflow(spark):
    long = " of " + "And " * 60_000
    assert column(spark, [long], papers.pluton) == [""]
    assert column(spark, [long + "pluton"], papers.pluton)[0].startswith("And And")
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(F.length(papers.names(F.col("t"))[0])).first()[0] > 200_000


def test_sql_functions(spark):
    from tabulith.functions import register

    assert "table_header_type" in register(spark)
    got = spark.sql("SELECT table_header_type('Sm (ppm)') AS a, paper_age('97.7 Ma') AS b, text_filled(' ') AS c").first()
    assert tuple(got) == ("Sm", "97.7 Ma", False)


@pytest.mark.parametrize("name", ["numeric_cell_filter"])
def test_generated_code_is_compiled(spark, name):
    """A method of more than 8000 bytes is interpreted for good."""
    from tabulith.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_cells_of_a_table_stay_together(spark):
    """Lines are shuffled once, by table, and never as cells; each is spelt once."""
    from tabulith.operators import gates
    from tabulith.plans import fixtures as fx

    made = fx.cells(spark, "/root/testdata/sf0.001")
    plan = gates.table_quality(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("transform(CASE WHEN (rid") == 1


def test_classes_are_counted_as_they_match(spark):
    shown = [chr(i) * 2 + "a1" for i in range(1, 128)] + ["", "é1", "٣٣", None]
    got = spark.createDataFrame([(v,) for v in shown], "v string").select("v", *[text.counted(F.col("v"), a, b).alias(n) for n, a, b in (("digit", "[0-9]", text.DIGIT), ("word", "[^ ]", "[^ ]"))])
    for r in got.collect():
        assert (r.digit, r.word) == ((None, None) if r.v is None else (sum(ch.isdigit() for ch in r.v), sum(ch != " " for ch in r.v)))

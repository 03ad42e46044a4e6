"""Readers of the pipeline's inputs; each gives a DataFrame of a fixed schema and reads by Spark alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_PDF = 30 << 20
#: Files of glyphs up to this size are leftovers of a failed run, not pages.
LEAST_GLYPH_FILE = 3 << 10
METADATA = "map<string, struct<title:string, abstract:string, journal:string, year:string, first_page:string, last_page:string, doi:string, volume:string, author:struct<name:array<string>>>>"


def file_name(path: Column) -> Column:
    """The last part of a path without its extension; empty without a dot."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def list_papers(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """pdf_id, path, length and small (not too large for glyph extraction) of all files below path whose name contains suffix; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    found = found.where(F.contains(F.element_at(F.split("path", "/"), -1), F.lit(suffix)))
    return found.select(file_name(F.col("path")).alias("pdf_id"), "path", "length", (F.col("length") <= LARGEST_PDF).alias("small"))


def parse_detections(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines '<pdf>_<page>:[[x0,y0,x1,y1],...]' as rows pdf_id, page, table_id, x0, y0, x1, y1; pages without boxes have none."""
    v = F.col(column)
    head, boxes = F.substring_index(v, ":", 1), F.substring_index(v, ":", -1)
    rows = lines.select(
        file_name(F.concat(F.regexp_replace(head, r"\.pdf_[0-9]+$", ""), F.lit("."))).alias("pdf_id"),
        F.substring_index(head, "_", -1).cast("int").alias("page"),
        F.posexplode(F.from_json(boxes, "array<array<double>>")).alias("table_id", "box"),
    )
    return rows.select("pdf_id", "page", "table_id", *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return parse_detections(spark.read.text(path))


def parse_glyphs(pages: DataFrame) -> DataFrame:
    """Glyph elements of XML pages as rows with a top-left origin. pages: pdf_id, page, xml.

    Elements without a box mark blanks and keep null boxes. Entities stay as they are written.
    """
    text = r"<text(?=[ >])[^>]*>[^<]*</text>"
    attribute = lambda c, name: F.nullif(F.regexp_extract(c, rf'\b{name}="([^"]*)"', 1), F.lit(""))
    size = F.split(F.regexp_extract("xml", r'<page[^>]*\bbbox="([^"]*)"', 1), ",")
    rows = pages.select("pdf_id", "page", size[2].try_cast("double").alias("page_w"), size[3].try_cast("double").alias("page_h"), F.posexplode(F.regexp_extract_all("xml", F.lit(text), F.lit(0))).alias("seq", "element"))
    box = F.split(attribute(F.col("element"), "bbox"), ",")
    rows = rows.select("*", *[box[i].try_cast("double").alias(c) for i, c in enumerate(("x0", "b0", "x1", "b1"))])
    return rows.select(
        "pdf_id", "page", F.col("seq").cast("long").alias("seq"), F.regexp_extract("element", r">([^<]*)<", 1).alias("ch"), attribute(F.col("element"), "font").alias("font"),
        "x0", (F.col("page_h") - F.col("b1")).alias("y0"), "x1", (F.col("page_h") - F.col("b0")).alias("y1"), attribute(F.col("element"), "size").try_cast("double").alias("size"), "page_w", "page_h",
    )


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of files '<pdf>_<page>_*.xml' that are large enough to be pages."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).where(F.col("length") > LEAST_GLYPH_FILE)
    name = file_name(F.col("path"))
    key = r"^(.*)_([0-9]+)_[^_]*$"
    return parse_glyphs(read.select(F.regexp_extract(name, key, 1).alias("pdf_id"), F.regexp_extract(name, key, 2).try_cast("int").alias("page"), F.col("content").cast("string").alias("xml")))


def parse_metadata(texts: DataFrame, column: str = "value") -> DataFrame:
    """A JSON object of papers by name as rows: pdf_id and the paper's fields, author as an array of names."""
    rows = texts.select(F.explode(F.from_json(F.col(column), METADATA)).alias("pdf_id", "m"))
    fields = ("title", "abstract", "journal", "year", "first_page", "last_page", "doi", "volume")
    return rows.select("pdf_id", *[F.col(f"m.{c}").alias(c) for c in fields], F.coalesce("m.author.name", F.array().cast("array<string>")).alias("author"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(spark.read.text(path, wholetext=True))


def read_terms(spark: SparkSession, paths: dict[str, str]) -> dict[str, list[str]]:
    """Dictionaries: one JSON array of strings for each kind; sorted, without repeats."""
    found = {}
    for kind, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("term")).distinct()
        found[kind] = sorted(r.term for r in rows.collect())  # a dictionary is part of the plan, not of the data
    return found


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks from files '{0|1}_<paper>.txt' that hold a JSON array of 0 and 1."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    read = spark.read.text(path, wholetext=True)
    paper = F.regexp_replace(F.regexp_extract(name, r"^[01]_([^.]*)", 1), "%20", " ")
    return read.select(paper.alias("pdf_id"), name.startswith("1_").alias("has_header"), F.from_json("value", "array<int>").alias("table_marks"))


def parse_labels(rows: DataFrame) -> DataFrame:
    """Label sheets with string columns id, available, degree, encode, format, mixed, total: blanks are 0, availability -100 is none, ids have four digits at least."""
    number = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("0")).try_cast("double").cast("int")
    return rows.select(F.lpad(number("id").cast("string"), 4, "0").alias("pdf_id"), (number("available") != -100).alias("available"), *[number(c).alias(c) for c in ("degree", "encode", "format", "mixed", "total")])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    names = ("id", "available", "degree", "encode", "format", "mixed", "unused", "total")
    return parse_labels(spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True, enforceSchema=True))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Tables in long form (parquet): pdf_id, page, table_id, rid, cid, value."""
    return spark.read.parquet(path).select("pdf_id", "page", "table_id", "rid", "cid", "value")

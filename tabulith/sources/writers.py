"""Sinks. Each is one distributed write whose commit is atomic, so a run that dies leaves nothing behind that looks done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.cells import COLUMNS
from tabulith.functions.text import filled
from tabulith.operators.gates import TABLE


def write_detections(detections: DataFrame, path: str) -> None:
    """A line for each page: '<pdf>_<page>:[[x0,y0,x1,y1],...]'."""
    box = F.array("x0", "y0", "x1", "y1")
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("table_id", box.alias("box")))), lambda x: x.box)
    pages = detections.groupBy("pdf_id", "page").agg(F.to_json(boxes).alias("boxes"))
    pages.select(F.format_string("%s.pdf_%03d:%s", F.col("pdf_id").cast("string"), "page", "boxes").alias("value")).write.mode("append").text(path)


#: Folders of a sink: as many at any number of papers.
BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("pdf_id").cast("string")), F.lit(BUCKETS)))


def write_cells(cells: DataFrame, path: str) -> None:
    """Tables in long form by a bucket of the paper; a merged cell has its text at the top left, and empty texts elsewhere."""
    _bucketed(cells).write.mode("append").partitionBy("bucket").parquet(path)


def spread(units: DataFrame) -> DataFrame:
    """Cells of a grid (row_begin, row_end, column_begin, column_end, text) as long-form cells: one for each place that a unit covers."""
    rows = units.select(*TABLE, "row_begin", "column_begin", "text", F.explode(F.sequence(F.col("row_begin"), F.greatest(F.col("row_end") - 1, "row_begin"))).alias("rid"), "column_end")
    cells = rows.select(*TABLE, "rid", "row_begin", "column_begin", "text", F.explode(F.sequence(F.col("column_begin"), F.greatest(F.col("column_end") - 1, "column_begin"))).alias("cid"))
    head = (F.col("rid") == F.col("row_begin")) & (F.col("cid") == F.col("column_begin"))
    return cells.select(*TABLE, "rid", "cid", F.when(head, F.col("text")).otherwise("").alias("value"))


def write_table_sheets(cells: DataFrame, path: str, columns: int) -> None:
    """Tables as wide CSV by a bucket of the paper, ``columns`` wide; rows in order."""
    wide = cells.groupBy(*TABLE, "rid").pivot("cid", list(range(columns))).agg(F.first("value"))
    _bucketed(wide).repartition(*[F.col(k) for k in TABLE]).sortWithinPartitions("bucket", *TABLE, "rid").write.mode("append").partitionBy("bucket").csv(path)


def write_captions(captions: DataFrame, path: str) -> None:
    """Captions that aren't blank; the others belong to the error table."""
    captions.where(filled(F.col("caption"))).write.mode("append").parquet(path)


def write_marks(marks: DataFrame, path: str) -> None:
    marks.write.mode("append").parquet(path)


def write_records(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """The 25 columns of the output record, as Parquet or CSV with a header."""
    out = records.select(*[F.col(f"`{c}`") for c in COLUMNS])
    out.write.mode("errorifexists").option("header", True).format(kind).save(path)

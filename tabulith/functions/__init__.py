"""Column expressions, and their registration as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Make the scalar expressions callable from SQL text as session functions; returns their names.

    They are SQL functions without Python bodies, so Catalyst inlines them.
    """
    from pyspark.sql import functions as F

    from tabulith.functions import cells, papers, text

    made = {
        "table_header_type": cells.header_type,
        "table_is_value": cells.is_value,
        "table_has_sm_nd": cells.has_sm_nd,
        "table_sigma_digits": cells.sigma_digits,
        "paper_age": papers.age,
        "paper_pluton": papers.pluton,
        "text_strip": text.strip,
        "text_filled": text.filled,
    }
    for name, build in made.items():
        column = build(F.col("x"))
        kind = spark.range(0).select(F.lit("").alias("x")).select(column.alias("y")).schema["y"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {_sql(spark, column)}")
    return sorted(made)


def _sql(spark: SparkSession, column) -> str:
    """The column as SQL text over x."""
    plan = spark.range(0).selectExpr("'' AS x").select(column.alias("y"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql().replace("`x`", "x")

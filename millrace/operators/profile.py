"""Column profiles from one fused aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls, null share (percent) and exact distinct non-null values of each column.

    The table is unpivoted to (column, value) and grouped twice, first by value:
    the distinct counts then take one shuffle of partial counts instead of an
    Expand for each column, and no column's values meet in one task.
    """
    columns = columns or df.columns
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        ).alias("pair")
    ).select("pair.*")
    by_value = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        by_value.groupBy("column_name")
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("unique_count"),
        )
        .withColumn("null_percentage", F.bround(100.0 * F.col("null_count") / F.col("row_count"), 2))
        .select("column_name", "row_count", "null_count", "null_percentage", "unique_count")
    )

"""Streams: a stored cleaning plan applied as it is, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.plans.cleaning import CleaningPlan, apply


def stream_files(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(stream: DataFrame, plan: CleaningPlan) -> DataFrame:
    """The plan is a projection, so it needs no state."""
    return apply(stream, plan)


def window_counts(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, sum and mean by window and key; what comes later than ``late`` is left out."""
    w = F.window(time, width)
    counts = stream.withWatermark(time, late) if stream.isStreaming else stream
    return counts.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start"), by, "n", F.bround("total", 4).alias("total")
    )

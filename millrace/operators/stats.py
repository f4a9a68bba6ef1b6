"""Exploratory statistics, histograms, boxes and the tests that decisions rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quantiles import exact_quantile_columns, group_quantiles


def whole_numbers(c: Column) -> Column:
    """Aggregate: all non-null values are whole."""
    return F.bool_and(c % 1 == 0)


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row of statistics, rounded half-even to four digits; skewness and kurtosis corrected for bias."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    row = rows.agg(
        F.count("x").alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.sum("x").alias("sum"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.var_samp("x").alias("variance"),
        F.skewness("x").alias("g1"),
        F.kurtosis("x").alias("g2"),
    ).withColumns({"q": exact_quantile_columns(rows, {"x": F.col("x")})["x"]})
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    values = {
        "min": F.col("min"), "max": F.col("max"), "sum": F.col("sum"), "range": F.col("max") - F.col("min"), "mean": F.col("mean"), "median": F.col("q")[1],
        "std": F.col("std"), "variance": F.col("variance"), "skewness": skew, "kurtosis": kurt, "q1": F.col("q")[0], "q2": F.col("q")[1], "q3": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0],
    }
    return row.select("n", *[F.bround(v, 4).alias(k) for k, v in values.items()])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, left, right and n of ``bins`` equal bins, empty ones too; the last is closed.

    A constant column spans half a unit to either side.  The range is a small
    aggregate that joins the scan as one row; values are never collected.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).where("lo is not null")
    one = F.broadcast(span)  # one row
    place = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    counts = x.join(one).groupBy(place.cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    edges = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return edges.join(counts, F.col("bin") == F.col("at"), "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), F.coalesce("n", F.lit(0)).alias("n")
    )


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def group_means(df: DataFrame, by: Column, value: str) -> DataFrame:
    return df.where(by.isNotNull()).groupBy(by.alias("x")).agg(F.bround(F.avg(value), 4).alias("y"))


def boxes(df: DataFrame, by: str, value: str, groups: int = 10) -> DataFrame:
    """Minimum, quartiles and maximum of the first ``groups`` groups in order of their key."""
    rows = df.select(F.col(by).alias("x"), F.col(value).alias("v")).where("x is not null and v is not null")
    first = rows.select("x").distinct().orderBy("x").limit(groups)
    out = group_quantiles(rows.join(F.broadcast(first), "x", "left_semi"), ["x"], F.col("v"))  # at most ``groups`` keys
    return out.select("x", *[F.bround(c, 4).alias(n) for n, c in (("min", F.col("lo")), ("q1", F.col("q")[0]), ("median", F.col("q")[1]), ("q3", F.col("q")[2]), ("max", F.col("hi")))])


def outlier_share(df: DataFrame, column: str) -> DataFrame:
    """Share of rows beyond 1.5 interquartile ranges, and whether it is above 5 %."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    q = exact_quantile_columns(x, {"x": F.col("x")}, (0.25, 0.75))["x"]
    reach = 1.5 * (q[1] - q[0])
    out = x.agg(F.avg(((F.col("x") < q[0] - reach) | (F.col("x") > q[1] + reach)).cast("double")).alias("share"))
    return out.select(F.bround("share", 6).alias("share"), (F.col("share") > 0.05).alias("many"))


def importance(df: DataFrame, column: str) -> DataFrame:
    """Coefficient of variation and its class: above 0.5 high, above 0.2 medium, else low."""
    out = df.agg(F.count(column).alias("n"), (F.stddev_samp(column) / F.avg(column)).alias("cv"))
    level = F.when(F.col("n") < 5, "low").when(F.col("cv") > 0.5, "high").when(F.col("cv") > 0.2, "medium").otherwise("low")
    return out.select("n", F.bround("cv", 6).alias("cv"), level.alias("level"))


def correlation_free_scatter(df: DataFrame, x: str, y: str, n: int = 500, seed: int = 42) -> DataFrame:
    """A reproducible sample of pairs without nulls, by order of a hash."""
    pairs = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    return pairs.orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y").limit(n)

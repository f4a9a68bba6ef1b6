"""Tables that describe tables: flags, column data, totals, training statistics, input schemas, and lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.joins import KEY_NAME
from millrace.operators.profile import profile_columns
from millrace.operators.quantiles import exact_quantile_columns
from millrace.operators.rows import mixed_kinds
from millrace.operators.stats import value_counts

NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def is_numeric(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def dataset_flags(df: DataFrame, id_share: float = 0.95) -> DataFrame:
    """One row: missing values, repeated rows, mixed columns and potential identifiers of a table."""
    p = profile_columns(df)
    ids = p.agg(
        F.max(F.col("null_count") > 0).alias("has_missing_values"),
        F.array_sort(F.collect_list(F.when(F.col("unique_count") / (F.col("row_count") - F.col("null_count")) > id_share, F.col("column_name")))).alias("potential_id_columns"),
    )
    # repeated rows: as many distinct hashes of whole rows as rows, but for chance collisions of 64 bits
    repeated = df.groupBy(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__NA__")) for c in df.columns])).count().agg(F.max(F.col("count") > 1).alias("has_duplicates"))
    mixed = mixed_kinds(df).agg(F.coalesce(F.max("mixed"), F.lit(False)).alias("has_mixed_types"))
    out = ids.join(F.broadcast(repeated)).join(F.broadcast(mixed))  # one row each
    return out.select("has_missing_values", F.coalesce("has_duplicates", F.lit(False)).alias("has_duplicates"), "has_mixed_types", "potential_id_columns")


def sample_values(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """column_name and the first ``n`` non-null values of each column in order, as strings."""
    pairs = df.select(F.col(f"`{order}`").alias("__o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("p"))
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy("__o", "v"))
    first = pairs.select("__o", "p.*").where("v is not null").withColumn("nth", nth).where(F.col("nth") <= n)
    listed = first.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("vs"))
    return listed.select("column_name", F.transform("vs", lambda x: x["v"]).alias("sample_values"))


def primary_keys(df: DataFrame) -> DataFrame:
    """Columns with a value a row and a key's name."""
    p = profile_columns(df).where("unique_count = row_count").select("column_name")
    return p.where(F.col("column_name").rlike(KEY_NAME.pattern))


def column_data(df: DataFrame, column: str, kind: str, order: str | None = None) -> DataFrame:
    """What a planner sees of a column, as rows (name, value): counts of the 20 commonest values, quartiles, or the range of dates; nothing of identifiers."""
    c = F.col(f"`{column}`")
    if kind == "categorical":
        return value_counts(df, column, 20).select(F.col("value").cast("string").alias("name"), F.col("n").cast("string").alias("value"))
    if kind == "numeric":
        x = c.cast("double")
        q = exact_quantile_columns(df, {"x": x})["x"]
        a = df.agg(F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max")).withColumn("q", q)
        parts = {"min": F.col("min"), "q25": F.col("q")[0], "median": F.col("q")[1], "mean": F.col("mean"), "q75": F.col("q")[2], "max": F.col("max")}
        pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.bround(v, 4).cast("string").alias("value")) for k, v in parts.items()])
        return a.select(F.explode(pairs).alias("p")).select("p.*")
    if kind in ("date", "datetime"):
        a = df.agg(F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"))
        pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("min", "max")])
        return a.select(F.explode(pairs).alias("p")).select("p.*")
    return df.sparkSession.createDataFrame([], "name string, value string")


def totals(metadata: DataFrame) -> DataFrame:
    """Sums over datasets of rows before and after, missing values, repeated and dropped rows."""
    return metadata.agg(*[F.sum(c).alias(c) for c in ("rows_before", "rows_after", "missing_before", "missing_after", "duplicates_removed", "rows_dropped")])


def dataset_metadata(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: a dataset's rows and missing values before and after cleaning, and its repeated rows."""

    def counted(df: DataFrame, tag: str) -> DataFrame:
        nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
        return df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.coalesce(F.sum(nulls), F.lit(0)).alias(f"missing_{tag}"))

    repeated = before.groupBy(*[F.col(f"`{c}`") for c in before.columns]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates_removed"))
    out = counted(before, "before").join(F.broadcast(counted(after, "after"))).join(F.broadcast(repeated))  # one row each
    return out.select(F.lit(name).alias("dataset"), "*", (F.col("rows_before") - F.col("rows_after") - F.col("duplicates_removed")).alias("rows_dropped"))


def joined_kinds(df: DataFrame) -> DataFrame:
    """column_name and kind of a join's columns: numeric by type, categorical up to max(20, 5 % of rows) values, else text."""
    numeric = [c for c, t in df.dtypes if is_numeric(t)]
    p = profile_columns(df)
    kind = F.when(F.col("column_name").isin(numeric), "numeric").when(F.col("unique_count") <= F.greatest(F.lit(20.0), 0.05 * F.col("row_count")), "categorical").otherwise("text")
    return p.select("column_name", kind.alias("kind"))


def training_stats(df: DataFrame, numeric: list[str], categorical: list[str], options: int = 50) -> DataFrame:
    """feature, kind, min, max, mean, std and options (the most frequent values): what inputs are checked against, and asked for, at prediction."""
    none = F.lit(None).cast("double")
    parts = []
    if numeric:
        a = df.agg(*[F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.bround(F.avg(x), 6).alias("mean"), F.bround(F.stddev_samp(x), 6).alias("std")).alias(f"f{i}") for i, x in enumerate(F.col(f"`{c}`").cast("double") for c in numeric)])
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"), F.col(f"f{i}.min"), F.col(f"f{i}.max"), F.col(f"f{i}.mean"), F.col(f"f{i}.std")) for i, c in enumerate(numeric)])
        parts.append(a.select(F.explode(pairs).alias("p")).select("p.*", F.lit(None).cast("array<string>").alias("options")))
    if categorical:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in categorical])).alias("p")).select("p.*")
        counted = pairs.where("v is not null").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.withColumn("nth", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "v"))).where(F.col("nth") <= options)
        listed = top.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("options"))
        parts.append(listed.select("feature", F.lit("categorical").alias("kind"), *[none.alias(c) for c in ("min", "max", "mean", "std")], "options"))
    return reduce(DataFrame.unionByName, parts)


def lookup_column(df: DataFrame, by: str) -> str | None:
    """For a lookup table (every value of ``by`` once) its first numeric column, else none."""
    c = F.col(f"`{by}`")
    most = df.where(c.isNotNull()).groupBy(c).count().agg(F.max("count").alias("m")).first()["m"]
    return next((n for n, t in df.dtypes if n != by and is_numeric(t)), None) if most == 1 else None


def bar_counts(df: DataFrame, by: str, k: int = 15) -> DataFrame:
    """x and y of a bar or pie: the ``k`` largest counts, or of a lookup table the sum of its first number by category, all in key order."""
    c = F.col(f"`{by}`")
    if number := lookup_column(df, by):
        return df.where(c.isNotNull()).groupBy(c.alias("x")).agg(F.sum(F.col(f"`{number}`").cast("double")).alias("y")).orderBy("x")
    return value_counts(df, by, k).select(F.col("value").alias("x"), F.col("n").cast("double").alias("y"))

"""Targets, encodings, scalers, splits and feature scores."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.places import boolean_of
from millrace.operators.ordered import with_running
from millrace.operators.profile import profile_columns
from millrace.operators.quantiles import exact_quantile_columns

_OPS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "=": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b),
}


def target_by_rules(rules: list[dict], default=0) -> Column:
    """Rules (column, op, value, and output, 1 if absent); the last that matches wins.  ``between`` takes ``value2``."""
    out = F.lit(default)
    for r in rules:
        c, v = F.col(r["column"]), F.lit(r["value"])
        hit = c.between(v, F.lit(r["value2"])) if r["op"] == "between" else _OPS[r["op"]](c, v)
        out = F.when(hit, F.lit(r.get("output", 1))).otherwise(out)
    return out


_SAFE = re.compile(r"^[\w\s.<>=!+\-*/%()'`,]*$")


def target_by_expression(df: DataFrame, expression: str, default=0) -> Column:
    """1 where a boolean expression over the table's columns holds, else the default."""
    words = {w for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", expression)) if w.lower() not in {"and", "or", "not", "is", "null", "in", "between", "true", "false"}}
    if not _SAFE.match(expression) or words - set(df.columns):
        raise ValueError(f"expression names {sorted(words - set(df.columns))} or holds characters that aren't allowed")
    return F.when(F.expr(expression), 1).otherwise(F.lit(default))


def encoding_for(distinct: int) -> str:
    """Encoding by the number of categories."""
    for most, kind in ((2, "one_hot_drop_first"), (10, "one_hot"), (100, "target"), (200, "frequency"), (500, "m_estimate")):
        if distinct <= most:
            return kind
    return "ordered_target"


def one_hot(df: DataFrame, column: str, drop_first: bool = False, most: int = 100) -> DataFrame:
    """Indicator columns of the sorted categories; more than ``most`` categories are an error."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values[1 if drop_first else 0 :]])


def _with_stats(df: DataFrame, column: str, stats: DataFrame) -> DataFrame:
    return df.join(stats.withColumnRenamed(column, "__k"), F.col(column).eqNullSafe(F.col("__k")), "left").drop("__k")


def target_encoded(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Mean of the target by category, drawn to the overall mean with weight ``smoothing`` (m-estimate)."""
    prior = F.broadcast(df.agg(F.avg(target).alias("__prior")))
    stats = df.groupBy(column).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    out = _with_stats(df, column, stats).join(prior)
    return out.withColumn(f"{column}_enc", (F.col("__s") + smoothing * F.col("__prior")) / (F.col("__n") + smoothing)).drop("__s", "__n", "__prior")


def frequency_encoded(df: DataFrame, column: str) -> DataFrame:
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__all")))
    out = _with_stats(df, column, df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))).join(total)
    return out.withColumn(f"{column}_freq", F.col("__n") / F.col("__all")).drop("__n", "__all")


def ordered_target_encoded(df: DataFrame, column: str, target: str, order: str, smoothing: float = 1.0, ties: list[str] | None = None) -> DataFrame:
    """Mean of the target over earlier rows of the category only, so that a row's own target doesn't leak.

    A category of any size is spread over ranges of the order; rows of equal
    order follow ``ties``, by default all other columns.
    """
    prior = F.broadcast(df.agg(F.avg(target).alias("__prior")))
    sums = with_running(df, {"__s": F.col(target).cast("double"), "__t": F.col(target).isNotNull().cast("long")}, order, [column], ties)
    return sums.join(prior).withColumn(f"{column}_enc", (F.col("__s") + smoothing * F.col("__prior")) / (F.col("__t") + smoothing)).drop("__prior", "__s", "__t")


#: Weight of the overall mean in the m-estimate.
M_ESTIMATE = 30.0


@dataclass(frozen=True)
class Encoding:
    """How one column is encoded."""

    column: str
    kind: str


def encoding_plan(df: DataFrame, columns: list[str]) -> list[Encoding]:
    """An encoding for each categorical column by its number of categories, from one profile."""
    distinct = {r["column_name"]: r["unique_count"] for r in profile_columns(df, columns).collect()}
    return [Encoding(c, encoding_for(distinct.get(c, 0))) for c in columns]


def encode(df: DataFrame, plan: list[Encoding], target: str, order: str) -> DataFrame:
    """The table with its categorical columns encoded as planned; the columns themselves are dropped."""
    out = df
    for e in plan:
        if e.kind in ("one_hot", "one_hot_drop_first"):
            out = one_hot(out, e.column, e.kind == "one_hot_drop_first")
        elif e.kind == "frequency":
            out = frequency_encoded(out, e.column)
        elif e.kind == "ordered_target":
            out = ordered_target_encoded(out, e.column, target, order)
        else:
            out = target_encoded(out, e.column, target, M_ESTIMATE if e.kind == "m_estimate" else 10.0)
        out = out.drop(e.column)
    return out


def text_method(rows: int, mean_length: float) -> tuple[str, int]:
    """Hashing for large tables, counts for short texts, else TF-IDF; and the number of features."""
    if rows > 10_000:
        return "hashing", 1 << 18
    if mean_length <= 30:
        return "counts", 100
    return "tf_idf", 500 if mean_length <= 300 else 1000


def text_features(column: str, method: str, size: int) -> Pipeline:
    """A Spark ML pipeline from a column of texts to ``{column}_vector``."""
    words = RegexTokenizer(inputCol=column, outputCol=f"{column}__words", pattern=r"\W+")
    if method == "hashing":
        return Pipeline(stages=[words, HashingTF(inputCol=f"{column}__words", outputCol=f"{column}_vector", numFeatures=size)])
    counts = CountVectorizer(inputCol=f"{column}__words", outputCol=f"{column}_vector" if method == "counts" else f"{column}__counts", vocabSize=size)
    return Pipeline(stages=[words, counts] if method == "counts" else [words, counts, IDF(inputCol=f"{column}__counts", outputCol=f"{column}_vector")])


def boolean_number(c: Column) -> Column:
    """1.0, 0.0 or null of true and false words and values."""
    return boolean_of(c.cast("string")).cast("double")


def feature_type(kinds: dict[str, str]) -> str:
    """numeric, categorical or text if all features are that, else mixed."""
    found = set(kinds.values())
    return found.pop() if len(found) == 1 else "mixed"


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day, weekday (Monday 0), and sine and cosine of the month."""
    d, turn = F.col(column), F.month(column) * (2 * 3.141592653589793 / 12)
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "weekday": F.weekday(d), "month_sin": F.bround(F.sin(turn), 6), "month_cos": F.bround(F.cos(turn), 6)}
    return df.select("*", *[v.alias(f"{column}_{k}") for k, v in parts.items()])


def time_parts(df: DataFrame, column: str) -> DataFrame:
    """Hour, minute, second, and sine and cosine of the hour."""
    t, turn = F.col(column), F.hour(column) * (2 * 3.141592653589793 / 24)
    parts = {"hour": F.hour(t), "minute": F.minute(t), "second": F.second(t).cast("int"), "hour_sin": F.bround(F.sin(turn), 6), "hour_cos": F.bround(F.cos(turn), 6)}
    return df.select("*", *[v.alias(f"{column}_{k}") for k, v in parts.items()])


def scaled(df: DataFrame, column: str, how: str) -> DataFrame:
    """z_score (population deviation), min_max, robust (median, quartiles) or decimal; a constant column becomes 0."""
    c = F.col(column).cast("double")
    q = exact_quantile_columns(df, {"c": c})["c"] if how == "robust" else F.array(*[F.lit(None).cast("double")] * 3)
    shift, width = {
        "z_score": (F.avg(c), F.stddev_pop(c)),
        "min_max": (F.min(c), F.max(c) - F.min(c)),
        "robust": (q[1], q[2] - q[0]),
        "decimal": (F.lit(0.0), F.pow(F.lit(10.0), F.ceil(F.log10(F.max(F.abs(c)) + 1e-12)))),
    }[how]
    facts = F.broadcast(df.agg(shift.alias("__a"), width.alias("__b")))  # one row
    return df.join(facts).withColumn(f"{column}_scaled", F.coalesce((c - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0)), F.when(c.isNotNull(), 0.0))).drop("__a", "__b")


def scaler_for(low: float, high: float, mean: float, std: float, skew: float, iqr: float) -> str:
    """Scaler by the column's statistics."""
    if low >= 0 and high <= 1:
        return "none"
    if abs(skew) > 2:
        return "robust"
    if abs(high) > 1e6:
        return "decimal"
    if iqr > std:
        return "robust"
    return "z_score" if std > abs(mean) else "min_max"


def mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mutual information (nats) of discrete features with a discrete target, from one pass of grouped counts."""
    pairs = df.where(F.col(target).isNotNull()).select(
        F.col(target).cast("string").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("x")) for f in features])).alias("p"),
    )
    joint = pairs.groupBy("p.feature", F.coalesce("p.x", F.lit("")).alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))
    of = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))  # noqa: E731  windows over distinct pairs, not rows
    n, nx, ny = of(), of("x"), of("y")
    terms = joint.select("feature", (F.col("n") / n * F.log(F.col("n") * n / (nx * ny))).alias("t"))
    return terms.groupBy("feature").agg(F.bround(F.sum("t"), 8).alias("mi"))


def binned(df: DataFrame, column: str, bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """Continuous values to bins of equal counts, for mutual information; ``accuracy`` asks for approximate quantiles."""
    marks = tuple(i / bins for i in range(1, bins))
    if accuracy:
        edges = F.broadcast(df.agg(F.percentile_approx(column, F.array(*map(F.lit, marks)), accuracy).alias("__q")))  # one row
        rows = df.join(edges)
    else:
        rows = df.withColumn("__q", exact_quantile_columns(df, {column: F.col(column)}, marks)[column])
    return rows.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.size(F.filter("__q", lambda q: q < F.col(column))))).drop("__q")


def ranked_features(df: DataFrame, features: list[str], target: str, bins: int = 10, least: float = 0.01, most: int = 10) -> DataFrame:
    """Features by mutual information with the target, as shares of the largest: at most ``most`` of at least ``least``, one at any rate.

    Numbers of more than twenty distinct values, and such a target, are cut
    into bins of equal counts first.
    """
    numbers = {c for c, t in df.dtypes if t in {"int", "bigint", "smallint", "tinyint", "float", "double"} or t.startswith("decimal")}
    wide = {r["column_name"] for r in profile_columns(df, [*features, target]).collect() if r["unique_count"] > 20} & numbers
    out = df
    for c in sorted(wide):
        out = binned(out, c, bins).drop(c).withColumnRenamed(f"{c}_bin", c)
    scores = mutual_information(out, features, target)
    top = F.max("mi").over(Window.partitionBy())  # a row a feature
    ranked = scores.select("feature", F.bround(F.coalesce(F.col("mi") / F.nullif(top, F.lit(0.0)), F.lit(0.0)), 6).alias("score"))
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "feature"))
    return ranked.withColumn("rank", nth).where((F.col("rank") == 1) | ((F.col("score") >= least) & (F.col("rank") <= most)))


def split(df: DataFrame, key: str, label: str | None = None, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test for ``share`` of the rows, reproducibly by a hash of the key.

    With a label the rows are stratified to a count: of each label the
    ceil(share * n) rows of least hash, if the rarest label has two rows and
    both parts can hold every label; else, and without a label, rows are cut at
    the hash's share and nothing is shuffled.
    """
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    if label is not None:
        classes = df.groupBy(F.col(label).alias("l")).count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("k"), F.sum("count").alias("n")).first()
        if classes["n"] and classes["least"] >= 2 and math.floor(share * classes["n"]) >= classes["k"] and math.floor((1 - share) * classes["n"]) >= classes["k"]:
            # the place of the cut by label; within a label rows are counted by the hash's upper bits first, so no label meets in one task
            rows = df.withColumn("__h", hashed).withColumn("__b", F.shiftright("__h", 54))
            sizes = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
            by = Window.partitionBy("__l")
            sizes = sizes.withColumn("__before", F.sum("__n").over(by.orderBy("__of")) - F.col("__n")).withColumn("__want", F.ceil(share * F.sum("__n").over(by)))
            joined = rows.join(sizes.drop("__n"), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__of")))
            nth = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) + F.col("__before")
            return joined.withColumn("is_test", nth <= F.col("__want")).drop("__h", "__b", "__l", "__of", "__before", "__want")
        hashed = F.xxhash64(F.col(key), F.lit(seed), F.col(label))
    return df.withColumn("is_test", F.pmod(hashed, F.lit(1_000_000)) / 1_000_000 < share)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def task_for(df: DataFrame, target: str) -> str:
    """classification for at most 20 distinct values or non-numbers, else regression."""
    if df.select(target).where(F.col(target).isNotNull()).distinct().limit(21).count() <= 20:
        return "classification"
    kind = dict(df.dtypes)[target]
    return "regression" if kind in {"int", "bigint", "smallint", "tinyint", "float", "double"} or kind.startswith("decimal") else "classification"


def sum_columns(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])

"""Inclusion dependencies: which columns' values all occur in which other columns, told from the values of all columns in one grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns in one bitmap.
BITS = 63


def _token(name: str, kind: T.DataType) -> Column | None:
    """A value as a string that equal values of kindred types share; None for types that aren't compared."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit("n"), c.cast("string"))
    if isinstance(kind, T.DecimalType):
        return F.concat(F.lit("n"), F.regexp_replace(c.cast("string"), r"\.0+$|(\.\d*?)0+$", "$1"))
    if isinstance(kind, T.FractionalType):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.concat(F.lit("n"), F.when(whole, c.cast("decimal(18,0)").cast("string")).otherwise(c.cast("string")))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("d"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return F.concat(F.lit("b" if isinstance(kind, T.BooleanType) else "s"), c.cast("string"))
    return None


def inclusion_dependencies(tables: dict[str, DataFrame]) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, child_values, parent_values, parent_is_key.

    A pair is given if every non-null value of the child column (which has some)
    is a value of the parent column; ``*_values`` count different values, and
    the parent is a key if none of its values repeats.  Foreign keys are pairs
    whose parent is a key; names play no part.

    All values of all columns are grouped once, each to a bitmap of the columns
    that have it; then a column's parents are the bits that the bitmaps of all its
    values share.  Rows are combined to different values before they are
    exchanged, and bitmaps to different bitmaps before columns meet them, so the
    work is linear in values and columns, and the result has a row per pair of
    columns at most.  Numbers are compared as numbers, dates with timestamps,
    strings as they are; nested and binary columns take no part.
    """
    columns = [(t, f.name, token) for t, df in tables.items() for f in df.schema.fields if (token := _token(f.name, f.dataType)) is not None]
    if not columns:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, child_values long, parent_values long, parent_is_key boolean")
    ids = {(t, c): i for i, (t, c, _) in enumerate(columns)}
    words = [f"w{i}" for i in range(-(-len(columns) // BITS))]

    def exploded(table: str, df: DataFrame) -> DataFrame:
        own = [F.struct(F.lit(ids[t, c]).alias("id"), token.alias("v")) for t, c, token in columns if t == table]
        return df.select(F.explode(F.array(*own)).alias("x")).select("x.*").where("v is not null")

    held = [exploded(t, df) for t, df in tables.items() if any(x[0] == t for x in columns)]
    long = reduce(DataFrame.unionByName, held).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    bit = lambda i: F.when(F.floor(F.col("id") / BITS) == i, F.expr(f"shiftleft(1L, cast(id % {BITS} as int))")).otherwise(F.lit(0).cast("long"))
    by_value = long.groupBy("v").agg(*[F.bit_or(bit(i)).alias(w) for i, w in enumerate(words)], F.collect_set(F.when(F.col("n") > 1, F.col("id"))).alias("repeats"))
    maps = by_value.groupBy(*words, "repeats").agg(F.count(F.lit(1)).alias("values"))
    has = lambda i: F.col(words[i // BITS]).bitwiseAND(F.lit(1 << i % BITS)) != 0
    own = F.filter(F.array(*[F.when(has(i), F.lit(i)) for i in range(len(columns))]), lambda x: x.isNotNull())
    each = maps.select("*", F.explode(own).alias("id"))
    shared = each.groupBy("id").agg(F.sum("values").alias("values"), F.max(F.array_contains("repeats", F.col("id"))).alias("repeats"), *[F.bit_and(w).alias(w) for w in words])
    names = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c, _ in columns])
    facts = shared.select(F.col("id").alias("parent"), F.col("values").alias("parent_values"), (~F.col("repeats")).alias("parent_is_key"))
    pairs = shared.select("id", F.col("values").alias("child_values"), F.explode(own).alias("parent")).where("id <> parent").join(F.broadcast(facts), "parent")  # a row a column
    name = lambda i: F.element_at(names, F.col(i) + 1)
    return pairs.select(
        name("id")["table"].alias("child_table"), name("id")["column"].alias("child_column"), name("parent")["table"].alias("parent_table"), name("parent")["column"].alias("parent_column"),
        "child_values", "parent_values", "parent_is_key",
    )


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """The inclusion dependencies between different tables whose parent is a key of more than one value."""
    return inclusion_dependencies(tables).where("parent_is_key and child_table <> parent_table and parent_values > 1")

"""Row and column cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tokens that stand for a missing value, compared as they are after trimming.
MISSING_TOKENS = ("UNKNOWN", "ERROR", "N/A", "NULL", "", "nan", "NaN", "NA", "None", "NONE", "#", "%", "&", "^", "@", "!", ")", "(", "*", "~", "unknown", "Unknown")
#: Symbols that are stripped from strings.
SYMBOLS = r"""[|~()\[\]{}"'`!?+]"""


def tokens_to_null(c: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """Null for missing-value tokens and for strings of special characters alone."""
    bare = F.trim(c)
    return F.when(bare.isin(*tokens) | bare.rlike(r"^[^A-Za-z0-9\u0080-￿]+$"), None).otherwise(c)


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c, SYMBOLS, "")


def clean_text(c: Column) -> Column:
    """En dash to hyphen, no control or non-ASCII characters, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(c, "–", "-"), r"[^\x20-\x7e]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def to_number(c: Column) -> Column:
    """Numbers of strings, null for others (Spark's own cast would take ``5d``)."""
    return F.when(is_number(c), F.trim(c).cast("double"))


def majority_kind(df: DataFrame, column: str) -> str:
    """numeric or text, whichever more non-null values are; ties are numeric."""
    n = is_number(F.col(column)).cast("int")
    row = df.where(F.col(column).isNotNull()).agg(F.sum(n).alias("a"), F.sum(1 - n).alias("b")).first()
    return "numeric" if (row["a"] or 0) >= (row["b"] or 0) else "text"


def clean_mixed(df: DataFrame, column: str) -> DataFrame:
    """Blank the minority kind of a column of numbers and texts."""
    number = is_number(F.col(column))
    keep = number if majority_kind(df, column) == "numeric" else ~number
    return df.withColumn(column, F.when(keep, F.col(column)).when(F.col(column).isNotNull(), ""))


def blank_leftovers(c: Column) -> Column:
    """Numbers stay, other strings become empty: what a numeric normalisation left over in a mixed column."""
    return F.when(is_number(c), c).when(c.isNotNull(), "")


def forced_numeric(c: Column, kind: str, is_float: bool) -> Column:
    """Whole numbers for integers, two digits for floats; other numeric kinds by what the column is."""
    number = to_number(c.cast("string"))
    return number.cast("long") if kind == "integer" or (kind != "float" and not is_float) else F.bround(number, 2)


def mixed_kinds(df: DataFrame) -> DataFrame:
    """By column: its non-null values, how many are numbers, true or false words, dates, and whether kinds are mixed."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in df.columns])).alias("p")).select("p.*")
    kind = F.when(is_number(F.col("v")), "number").when(F.lower("v").isin("true", "false"), "boolean").when(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}"), "date").otherwise("text")
    counted = pairs.where("v is not null").select("column_name", kind.alias("kind"))
    out = counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("number", "boolean", "date", "text")]
    )
    several = sum((F.col(f"n_{k}") > 0).cast("int") for k in ("number", "boolean", "date", "text"))
    return out.withColumn("mixed", several > 1)


def drop_sparse_rows(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Rows with less than ``share`` of their values missing."""
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns])
    return df.where(nulls / len(df.columns) < share)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def null_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: (1 - row[f"c{i}"] / row["n"]) if row["n"] else 1.0 for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Without the columns of which at least ``share`` is missing; one aggregate decides."""
    return df.drop(*[c for c, s in null_shares(df).items() if s >= share])


def drop_unnamed_columns(df: DataFrame, filled: float = 0.1) -> DataFrame:
    shares = null_shares(df)
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed") and 1 - shares[c] < filled])


def keep_first(df: DataFrame, order: str, subset: list[str] | None = None) -> DataFrame:
    """Without repeated rows; of equal rows the first by ``order`` stays."""
    keys = subset or [c for c in df.columns if c != order]
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy(order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def repeated_columns(df: DataFrame, order: str) -> list[tuple[str, str]]:
    """(kept, dropped) pairs of columns with equal data.

    One aggregate takes a digest of each column (exclusive or of hashes of the
    row's key and value); candidates of equal digest are then compared exactly,
    also in one aggregate.
    """
    columns = [c for c in df.columns if c != order]
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__NA__"))
    digests = df.agg(*[F.bit_xor(F.xxhash64(order, value(c))).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    by_digest: dict = {}
    for i, c in enumerate(columns):
        by_digest.setdefault(digests[f"d{i}"], []).append(c)
    pairs = [(g[0], c) for g in by_digest.values() for c in g[1:]]
    if not pairs:
        return []
    same = df.agg(*[F.bool_and(F.col(f"`{a}`").cast("string").eqNullSafe(F.col(f"`{b}`").cast("string"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if same[f"p{i}"]]


def drop_repeated_columns(df: DataFrame, order: str) -> DataFrame:
    return df.drop(*[b for _, b in repeated_columns(df, order)])

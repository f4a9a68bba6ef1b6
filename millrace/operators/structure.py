"""Structural types of columns, and key constraints across tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbers, places
from millrace.operators.joins import KEY_NAME, shared_columns

_IDENTIFIERS = {"email", "url", "network_addresses", "file_path", "files", "version"}
_TEMPORAL = {"datetime", "timestamp", "year", "month", "day", "week", "quarter", "fiscal_year"}
_NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass(frozen=True)
class Column:
    """What the structural rules look at, for one column; ``rows`` are all its rows, nulls too."""

    name: str
    dtype: str
    rows: int
    distinct: int
    booleans: bool
    id_share: float
    mean_length: float
    evenly_spaced: bool
    low: float | None = None
    high: float | None = None


def column_facts(df: DataFrame) -> list[Column]:
    """Facts of all columns from one unpivoted grouping by value: no Expand, and no column's values in one task."""
    types = dict(df.dtypes)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in df.columns])).alias("p")).select("p.*")
    v = F.col("v")
    number = F.nullif(F.regexp_extract(v, r"(\d{1,15})$", 1), F.lit("")).cast("double")
    whole = F.when(v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), v.cast("double"))
    seen, n = v.isNotNull(), F.col("n")
    by_value = pairs.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    facts = by_value.groupBy("c").agg(
        F.sum("n").alias("rows"), F.sum(F.when(seen, n).otherwise(0)).alias("known"), F.count("v").alias("distinct"),
        F.bool_and(F.lower(v).isin(*places.TRUE_WORDS, *places.FALSE_WORDS)).alias("booleans"),
        (F.sum(F.when(numbers.id_like(v), n).otherwise(0)) / F.sum(F.when(seen, n))).alias("ids"),
        (F.sum(F.length(v) * n) / F.sum(F.when(seen, n))).alias("length"),
        (F.max(number) - F.min(number) + 1).alias("span"), F.sum(F.when(number.isNotNull(), n).otherwise(0)).alias("numbered"),
        F.min(F.regexp_extract(v, r"^(.*?)\d*$", 1)).alias("p0"), F.max(F.regexp_extract(v, r"^(.*?)\d*$", 1)).alias("p1"),
        F.min(whole).alias("low"), F.max(whole).alias("high"),
    )
    found = {r["c"]: r for r in facts.collect()}  # a row a column
    out = []
    for c in df.columns:
        r = found.get(c)
        if r is None or not r["known"]:
            out.append(Column(c, types[c], r["rows"] if r else 0, 0, False, 0.0, 0.0, False))
            continue
        sequence = r["p0"] == r["p1"] and r["numbered"] == r["known"] == r["distinct"] and r["span"] == r["known"]
        numeric = types[c] in _NUMERIC_TYPES
        out.append(Column(c, types[c], r["rows"], r["distinct"], bool(r["booleans"]), r["ids"] or 0.0, r["length"] or 0.0, bool(sequence), r["low"] if numeric else None, r["high"] if numeric else None))
    return out


def structural_type(c: Column, semantic: str | None = None) -> str:
    """identifier, categorical, numeric, datetime, date, time, text or unknown, by the first rule that holds."""
    ratio = c.distinct / c.rows if c.rows else 0.0
    if semantic in {"time", "date"}:
        return semantic
    if semantic in _IDENTIFIERS:
        return "identifier"
    if c.distinct and c.distinct <= 2 and c.booleans:
        return "categorical"
    if KEY_NAME.match(c.name) and ratio > 0.95:
        return "identifier"
    if c.evenly_spaced and ratio >= 0.9:
        return "identifier"
    if semantic in _TEMPORAL or c.dtype.startswith("timestamp"):
        return "datetime"
    if c.dtype == "date":
        return "date"
    if c.dtype in _NUMERIC_TYPES or c.dtype.startswith("decimal"):
        if c.low is not None and c.high is not None and 1000 <= c.low and c.high <= 2100:
            return "numeric"
        return "categorical" if c.distinct <= 20 and ratio <= 0.2 else "numeric"
    if c.id_share > 0.7 and ratio > 0.95:
        return "identifier"
    if c.dtype == "string" and c.rows:
        if c.distinct <= 50 and ratio <= 0.5:
            return "categorical"
        return "text" if c.mean_length > 30 or ratio > 0.9 else "categorical"
    return "unknown"


def structural_types(df: DataFrame, semantic: dict[str, str] | None = None) -> list[tuple[str, str]]:
    return [(c.name, structural_type(c, (semantic or {}).get(c.name))) for c in column_facts(df)]


def constraints(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(kind, table, column): primary keys (identifiers), unique keys (a value a row) and foreign keys (shared names)."""
    out = []
    shared = set(shared_columns(tables))
    for name, df in tables.items():
        for c in column_facts(df):
            if structural_type(c) == "identifier":
                out.append(("primary", name, c.name))
            if c.rows and c.distinct == c.rows:  # so without nulls
                out.append(("unique", name, c.name))
            if c.name in shared:
                out.append(("foreign", name, c.name))
    return out

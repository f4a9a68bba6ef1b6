"""Columns that hold numbers and other strings: the majority stays, and strings that are numbers with a unit are converted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.units import MEASURES, converted
from millrace.operators.detect import units_in_strings
from millrace.operators.rows import is_number


@dataclass(frozen=True)
class MixedPlan:
    """What becomes of a column: which kind stays, and of numbers the type and unit of the strings that are converted, if there is one."""

    column: str
    keep: str
    kind: str | None = None
    unit: str | None = None


def bare(c: Column) -> Column:
    """A string without commas and blanks, which numbers may have."""
    return F.regexp_replace(c, "[, ]", "")


def amount(c: Column, kind: str | None, unit: str | None) -> Column:
    """A plain number as it is, a string with a unit converted to ``unit``; null for others."""
    plain = F.when(is_number(bare(c)), bare(c).cast("double"))
    if kind in MEASURES:
        return F.coalesce(plain, converted(c, MEASURES[kind], unit))
    if kind == "currency":
        return F.coalesce(plain, numbers.money_amount(c))
    return F.coalesce(plain, numbers.percentage(c)) if kind == "percentage" else plain


def plan_mixed(df: DataFrame, column: str) -> MixedPlan | None:
    """One aggregate counts the kinds (None: the column isn't mixed); numbers win ties.  Where numbers stay, the strings are looked at for units."""
    c = F.col(f"`{column}`").cast("string")
    number = is_number(bare(c))
    row = df.agg(F.count_if(c.isNotNull() & number).alias("numbers"), F.count_if(c.isNotNull() & ~number).alias("strings")).first()
    if not row["numbers"] or not row["strings"]:
        return None
    if row["numbers"] < row["strings"]:
        return MixedPlan(column, "text")
    return MixedPlan(column, "numeric", *(units_in_strings(df, column) or ()))


def apply_mixed(c: Column, plan: MixedPlan) -> Column:
    """The column as strings: what stays as it is, converted amounts as numbers, an empty string for the rest; nulls stay."""
    text = c.cast("string")
    if plan.keep == "text":
        return F.when(is_number(bare(text)), "").otherwise(text)
    kept = F.when(is_number(bare(text)), text)
    made = amount(text, plan.kind, plan.unit).cast("string") if plan.kind else F.lit(None).cast("string")
    return F.when(text.isNotNull(), F.coalesce(kept, made, F.lit("")))


def clean_mixed(df: DataFrame, column: str) -> tuple[DataFrame, MixedPlan | None]:
    """The table with a mixed column cleaned, and what was done."""
    plan = plan_mixed(df, column)
    return (df.withColumn(column, apply_mixed(F.col(f"`{column}`"), plan)) if plan else df), plan

"""Imputation of a table: one pass decides a fill for every column with nulls, then the fills are applied in order.

Statistics of all columns come from a few aggregates and one profile; values that
fill are constants of the plan, so applying them is a projection.  Only fills by
group, by neighbours and of sequences join or sort.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import asdict, dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.temporal import date_of, seconds_of_day
from millrace.operators import impute, times
from millrace.operators.profile import profile_columns
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.rows import to_number, tokens_to_null

NUMERIC = ("integer", "float", "currency", "salary", "percentage", "number_systems", "distance", "weight", "volume", "area", "speed", "temperature", "pressure", "energy", "power", "capacity", "density", "angle", "latitude", "longitude")
CALENDAR = ("year", "month", "day", "week", "quarter")
DATES = ("date", "datetime", "timestamp")
#: From this share of nulls on a fill is flagged, where the rules ask for a flag.
FLAG_FROM = 0.25


@dataclass(frozen=True)
class Fill:
    """How one column's nulls are filled: a method, its constant or group, and whether a column ``{column}_missing`` tells where."""

    column: str
    method: str
    value: object = None
    by: str | None = None
    flag: bool = False


def to_json(plan: list[Fill]) -> str:
    return json.dumps([asdict(f) for f in plan], default=str)


def grouping_for(df: DataFrame, column: str, candidates: list[str]) -> str | None:
    """The first categorical column of fewer than ten levels whose groups differ in the mean and are narrow.

    Narrow: the mean variance within groups is below 0.7 of the column's own.
    """
    return groupings(df, [column], candidates)[column]


def groupings(df: DataFrame, columns: list[str], candidates: list[str]) -> dict[str, str | None]:
    """grouping_for() of all columns in one grouping: each row goes once to each candidate's level, and the levels, fewer than ten a candidate, are collected."""
    if not columns or not candidates:
        return dict.fromkeys(columns)
    v = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    whole_table = F.struct(F.lit(-1).alias("g"), F.lit("").alias("level"))
    levels = F.array(whole_table, *[F.struct(F.lit(i).alias("g"), F.col(f"`{g}`").cast("string").alias("level")) for i, g in enumerate(candidates)])
    rows = df.select(F.explode(levels).alias("e"), *v).where("e.level is not null").groupBy("e.g", "e.level")
    sums = [f(f"v{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    found = rows.agg(*sums).collect()
    out: dict[str, str | None] = {}
    for i, c in enumerate(columns):
        whole = next((r[f"v{i}"] for r in found if r["g"] == -1), None)
        out[c] = None
        for j, g in enumerate(candidates):
            held = [r for r in found if r["g"] == j and r[f"n{i}"]]
            within = [r[f"v{i}"] for r in held if r[f"v{i}"] is not None]
            if 1 < len(held) < 10 and len({r[f"m{i}"] for r in held}) > 1 and within and whole and sum(within) / len(within) / whole < 0.7:
                out[c] = g
                break
    return out


def generic_method(null_share: float, distinct: int, rows: int, kind: str, skew: float | None, outliers: float, whole: bool) -> str:
    """Fallback rules: mode for few whole values and for words that repeat, mean for even numbers, else median or ``Unknown``."""
    if kind in ("boolean", "category"):
        return "mode"
    if kind == "numeric":
        if whole and distinct <= 10:
            return "mode"
        return "mean" if abs(skew or 0.0) < 0.5 and outliers <= 0.05 and null_share < 0.15 else "median"
    return "mode" if rows and distinct / rows < 0.5 else "unknown"


def _facts(df: DataFrame, numeric: list[str]) -> dict[str, dict]:
    """Per numeric column: skewness, coefficient of variation, mean, median, quartiles and whether all values are whole; one aggregate, and one selection for all."""
    if not numeric:
        return {}
    exprs = []
    for i, c in enumerate(numeric):
        x = F.col(f"`{c}`").cast("double")
        exprs += [F.struct(F.skewness(x).alias("skew"), (F.stddev_samp(x) / F.nullif(F.avg(x), F.lit(0.0))).alias("cv"), F.avg(x).alias("mean"), F.bool_and(x % 1 == 0).alias("whole")).alias(f"f{i}")]
    row = df.agg(*exprs).first()
    q = exact_quantiles(df, {c: F.col(f"`{c}`").cast("double") for c in numeric})
    return {c: row[f"f{i}"].asDict() | {"q": q[c] if q[c][0] is not None else None} for i, c in enumerate(numeric)}


def _outliers(df: DataFrame, facts: dict[str, dict]) -> dict[str, float]:
    """Share of rows beyond 1.5 interquartile ranges, for all columns in one aggregate."""
    known = [c for c, f in facts.items() if f["q"]]
    if not known:
        return {}
    exprs = []
    for i, c in enumerate(known):
        low, _, high = facts[c]["q"]
        x, reach = F.col(f"`{c}`").cast("double"), 1.5 * (high - low)
        exprs.append(F.avg(F.coalesce((x < low - reach) | (x > high + reach), F.lit(False)).cast("int")).alias(f"o{i}"))
    row = df.agg(*exprs).first()
    return {c: row[f"o{i}"] for i, c in enumerate(known)}


def _mode(df: DataFrame, column: str):
    """The most frequent value, the smallest of equals; counted by value first."""
    c = F.col(f"`{column}`")
    row = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").first()
    return row["v"] if row else None


#: Confidence in a semantic type from which the rules for numbers follow it.
SURE = 0.8


def decide(df: DataFrame, kinds: dict[str, str], confidence: dict[str, float] | None = None) -> list[Fill]:
    """A fill for each column with nulls, in the order in which they are applied.

    ``kinds`` are semantic types by column; where ``confidence`` in one is below
    0.8 a column of numbers goes by the fallback rules.  Empty columns are dropped;
    sequences are continued; numbers, dates, durations and calendar parts go by
    their rules, and all others by the fallback rules.
    """
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in df.columns]).first()
    rows, filled = counts[0], dict(zip(df.columns, counts[1:], strict=True))
    share = {c: (rows - n) / rows for c, n in filled.items() if rows}
    open_ = [c for c in df.columns if share.get(c, 0) > 0]
    asked = [c for c in df.columns if c in open_ or types[c] == "string"]  # of no other column the different values matter
    unique = {r["column_name"]: r["unique_count"] for r in profile_columns(df, asked).collect()} if asked and rows else dict.fromkeys(asked, 0)
    numeric = [c for c in open_ if types[c] in {"tinyint", "smallint", "int", "bigint", "float", "double"} or types[c].startswith("decimal")]
    facts = _facts(df, numeric)
    outliers = _outliers(df, facts)
    groups = [c for c in df.columns if types[c] == "string" and 1 < unique[c] < 10]
    dated = next((c for c in df.columns if types[c] in {"date", "timestamp", "timestamp_ntz"} and share.get(c, 0) == 0), None)
    counted = {c for c in open_ if types[c] in {"string", "int", "bigint"} and kinds.get(c, "text") not in (*CALENDAR, *DATES, "time", "duration", "boolean") and unique[c] == filled[c] > 0}
    running = impute.sequences(df, sorted(counted))
    by_column = groupings(df, numeric, groups)
    plan = []
    for c in open_:
        kind, distinct = kinds.get(c, "text"), unique[c]
        if not distinct:
            plan.append(Fill(c, "drop"))
            continue
        method, flag = None, False
        if any(running.get(c, ())):
            method = "sequence" if running[c][0] else "text_sequence"
        if method is None and kind == "time":
            plain = _time_value(df, c)
            features = [x for x in df.columns if types[x] in {"tinyint", "smallint", "int", "bigint", "float", "double"} or types[x].startswith("decimal")]
            model = times.fit_times(df, c, features, levels_of(df, groups), seconds_of_day(F.lit(plain))) if types[c] == "string" else None
            plan.append(Fill(c, "time_model" if model else "time", model or plain))
            continue
        if method is None and kind in (*CALENDAR, *DATES, "duration"):
            group = "calendar" if kind in CALENDAR else "duration" if kind == "duration" else "date"
            method = impute.temporal_method(share[c], group, distinct, dated is not None)
            flag = share[c] > FLAG_FROM and method not in ("drop", "derive")
            if method == "derive":
                plan.append(Fill(c, "derive", kind, dated))
                continue
        if method is None and c in facts and kind in NUMERIC and (confidence or {}).get(c, 1.0) >= SURE:
            f = facts[c]
            method = impute.numeric_method(impute.Facts(share[c], distinct, f["skew"], f["cv"]))
            flag = share[c] > FLAG_FROM and method != "drop"
        if method is None:
            general = "boolean" if kind == "boolean" or types[c] == "boolean" else "numeric" if c in facts else "text"
            f = facts.get(c, {})
            method = generic_method(share[c], distinct, rows, general, f.get("skew"), outliers.get(c, 0.0), bool(f.get("whole")))
        by = by_column.get(c) if method in ("mean", "median") else None
        value = None
        if by:
            method = "group_median"
        elif method == "mean":
            value = facts[c]["mean"]
        elif method == "median" and c in facts:
            value = facts[c]["q"][1]
        elif method in ("mode", "median"):
            method, value = "mode", _mode(df, c)
        elif method == "unknown":
            value = "Unknown"
        plan.append(Fill(c, method, value, by, flag))
    return plan


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of columns that have fewer than ten, in one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def _time_value(df: DataFrame, column: str) -> str:
    """The median time of day where more than five are known, else midnight; different values are counted, then seconds, of which a day has 86,400."""
    values = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).select(seconds_of_day(F.col("v")).alias("s"), "n")
    counts = sorted((s, n) for s, n in values.groupBy("s").agg(F.sum("n")).collect() if s is not None)  # a condition would go before the first grouping, to each row
    ends = list(accumulate(n for _, n in counts))
    if not ends or ends[-1] <= 5:
        return "00:00:00"
    low, high = (counts[bisect_right(ends, rank)][0] for rank in ((ends[-1] - 1) // 2, ends[-1] // 2))
    median = (low + high) // 2
    return f"{median // 3600:02d}:{median % 3600 // 60:02d}:{median % 60:02d}"


def _constant(df: DataFrame, column: str, value) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)


def apply(df: DataFrame, plan: list[Fill], order: str) -> DataFrame:
    """The table with its nulls filled; flags tell where.  ``order`` is the order of the rows for neighbours and sequences."""
    flags = {f"{f.column}_missing": F.col(f"`{f.column}`").isNull() for f in plan if f.flag}
    out = df.withColumns(flags) if flags else df
    # models of times read the columns as they are before the fills
    told = lambda f: times.predicted_time(f.value) if f.method == "time_model" else _constant(df, f.column, f.value)
    constants = {f.column: F.coalesce(F.col(f"`{f.column}`"), told(f)) for f in plan if f.value is not None and f.method != "derive"}
    out = out.withColumns(constants) if constants else out
    for f in plan:
        if f.method == "drop":
            out = out.drop(f.column)
        elif f.method == "derive":
            part = impute.calendar_part(str(f.value), F.col(f"`{f.by}`")).cast(df.schema[f.column].dataType)
            out = out.withColumn(f.column, F.coalesce(F.col(f"`{f.column}`"), part))
        elif f.method == "group_median":
            out = impute.fill_group_median(out, f.column, f.by).withColumn(f.column, F.col(f"`{f.column}`").cast(df.schema[f.column].dataType))
        elif f.method == "neighbours":
            out = impute.fill_from_neighbours(out, f.column, order)
        elif f.method == "sequence":
            out = impute.fill_sequence(out, f.column, order)
        elif f.method == "text_sequence":
            out = impute.fill_text_sequence(out, f.column, order)
    return out


def valid_values(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Tokens for missing values become null, numeric kinds numbers, and dates dates (a day beyond its month's end is moved to it)."""
    types = dict(df.dtypes)

    def value(c: str) -> Column:
        x = F.col(f"`{c}`")
        if types[c] != "string":
            return x
        x = tokens_to_null(x)
        if kinds.get(c) in NUMERIC:
            return to_number(x)
        return repaired_date(x) if kinds.get(c) == "date" else x

    return df.select(*[value(c).alias(c) for c in df.columns])


def repaired_date(c: Column) -> Column:
    """Date of a string; of year, month and a day that the month doesn't have, the month's last day."""
    shape = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$"
    y, m, d = (F.nullif(F.regexp_extract(c, shape, i), F.lit("")).cast("int") for i in (1, 2, 3))
    fits = m.between(1, 12) & d.between(1, 31)
    return F.coalesce(date_of(c), F.when(fits, impute.clamped_date(y, F.when(fits, m), d)))


def impute_table(df: DataFrame, kinds: dict[str, str], order: str) -> DataFrame:
    """All steps: valid values, a plan from them, and the plan applied."""
    ready = valid_values(df, kinds)
    return apply(ready, decide(ready, kinds), order)

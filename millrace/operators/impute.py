"""Missing values: fill values, decisions from statistics, and order-dependent fills.

Order-dependent fills run within ranges of the order (see ordered.py), so that
neither a global order nor a large group is one task's.  Rows of equal order
follow ``ties``, by default all other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ordered import with_known
from millrace.operators.quantiles import exact_quantile_columns, group_quantiles


def fill_with(df: DataFrame, column: str, how: str, source: DataFrame | None = None) -> DataFrame:
    """Fill with mean, median or mode (the smallest of tied values) of the column, or of ``source``'s; one small aggregate decides the value."""
    c = F.col(f"`{column}`")
    if how == "mode":  # counts by value first: no task holds all distinct values
        counts = (source or df).where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        fill = counts.agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v")))["v"].alias("__fill"))
    else:
        rows = source or df
        fill = rows.agg(F.avg(c).alias("__fill")) if how == "mean" else rows.sparkSession.range(1).select(exact_quantile_columns(rows, {"v": c}, (0.5,))["v"][0].alias("__fill"))
    fill = F.broadcast(fill)  # one row
    return df.join(fill).withColumn(column, F.coalesce(c, F.col("__fill"))).drop("__fill")


def fill_group_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """Fill with the median of the row's group, else of the table.

    Medians are one row per group and are joined; a group of any size is ranked
    in ranges of its values (see quantiles.py).
    """
    c = F.col(f"`{column}`")
    medians = group_quantiles(df.select(F.col(f"`{group}`").alias("__g"), c.alias("__v")), ["__g"], F.col("__v"), (0.5,))
    whole = exact_quantile_columns(df, {"v": c}, (0.5,))["v"][0]
    joined = df.join(medians.select("__g", F.col("q")[0].alias("__m")), F.col(f"`{group}`").eqNullSafe(F.col("__g")), "left")
    return joined.withColumn(column, F.coalesce(c, "__m", whole)).drop("__g", "__m")


_KNOWN = ("__r", "__a", "__b")


def fill_from_neighbours(df: DataFrame, column: str, order: str, partition: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Forward fill, then backward fill; in groups without any known value the table's mode."""
    out = with_known(df, column, order, partition, ties).withColumn(column, F.coalesce(F.col("__a.v"), F.col("__b.v"))).drop(*_KNOWN)
    return fill_with(out, column, "mode", df) if partition else out


def interpolate(df: DataFrame, column: str, order: str, partition: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Linear by row number between known values; beyond them the nearest."""
    both = with_known(df, column, order, partition, ties)
    step = (F.col("__r") - F.col("__a.r")) / F.nullif(F.col("__b.r") - F.col("__a.r"), F.lit(0))
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * step
    return both.withColumn(column, F.coalesce(F.col(f"`{column}`").cast("double"), between, F.col("__a.v"), F.col("__b.v"))).drop(*_KNOWN)


def _unused(rows: DataFrame, used: Column, source: DataFrame, home: Column | None = None) -> DataFrame:
    """The rows, __want being null where a row of the source (of equal ``home``) uses that number; rows that want none are spread by their numbers."""
    home = F.lit(None) if home is None else home
    found = source.select(used.alias("__used"), home.alias("__of")).where("__used is not null").distinct().withColumn("__asks", F.lit(True))
    same = (F.col("__one") == F.col("__used")) & F.col("__home").eqNullSafe(F.col("__of")) & (F.col("__want").isNotNull() == F.col("__asks"))
    out = rows.withColumns({"__one": F.coalesce("__want", "__r"), "__home": home}).join(found, same, "left")
    return out.withColumn("__want", F.when(F.col("__used").isNull(), F.col("__want"))).drop("__one", "__home", "__used", "__of", "__asks")


def fill_sequence(df: DataFrame, column: str, order: str, partition: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Missing numbers of a running sequence: the value before plus the distance, where that number is nowhere used."""
    c = F.col(f"`{column}`")
    rows = with_known(df, column, order, partition, ties)
    rows = rows.withColumn("__want", F.when(c.isNull(), F.col("__a.v") + F.col("__r") - F.col("__a.r")))
    return _unused(rows, c, df).withColumn(column, F.coalesce(c, "__want")).drop(*_KNOWN, "__want")


def _fill_rounds(df: DataFrame, column: str, size: int, order: str, partition: list[str] | None, ties: list[str] | None) -> DataFrame:
    """fill_sequence() of numbers below ``size``, behind the last of which a group may go on from 0.

    It does where a number is by ``size`` (or a multiple) less than the one before
    tells.  The first such place fixes the group's course, which all numbers are
    led back to by whole rounds, so that a number is free on a round where its
    group doesn't use it, however often it is used on others.
    """
    c, r, course, by = F.col(f"`{column}`"), F.col("__r"), F.col("__course"), partition or []
    rows = with_known(df, column, order, by, ties, earlier=True)
    told = F.col("__p.v") + r - F.col("__p.r")
    rounds = rows.where((told > c) & ((told - c) % size == 0))
    courses = rounds.groupBy(*[F.col(f"`{b}`").alias(f"__g{i}") for i, b in enumerate(by)]).agg(F.min_by(c - r, r).alias("__course"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__g{i}"))
    rows = (rows.join(courses, same, "left") if by else rows.join(F.broadcast(courses))).drop(*[f"__g{i}" for i in range(len(by))])

    def running(v: Column, at: Column) -> Column:
        behind = at + course - v + size // 2
        return F.when(course.isNull(), v).otherwise(v + behind - F.pmod(behind, F.lit(size)))

    rows = rows.withColumn("__want", F.when(c.isNull(), running(F.col("__a.v"), F.col("__a.r")) + r - F.col("__a.r")))
    home = F.when(course.isNotNull(), F.struct(*[F.col(f"`{b}`") for b in by])) if by else None
    out = _unused(rows, running(c, r), rows, home)
    free = F.when(course.isNull(), F.col("__want")).otherwise(F.pmod("__want", F.lit(size)))
    return out.withColumn(column, F.coalesce(c, free)).drop(*_KNOWN, "__p", "__want", "__course")


_NUMBERED = r"^(.*?)(\d+)$"


def fill_text_sequence(df: DataFrame, column: str, order: str, partition: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Missing members of a sequence of prefixed, zero-padded numbers such as EMP003.

    Where the sequence goes on from EMP000 behind EMP999, missing members do too;
    else numbers beyond the last become longer.  One aggregate tells prefix and
    width, and whether numbers come near enough to the last one for that.
    """
    c = F.col(f"`{column}`")
    digits = F.when(c.rlike(_NUMBERED), F.regexp_extract(c, _NUMBERED, 2))
    prefix = F.mode(F.when(c.rlike(_NUMBERED), F.regexp_extract(c, _NUMBERED, 1)), True)
    facts = df.agg(prefix.alias("prefix"), F.max(F.length(digits)).alias("width"), F.max(digits.cast("long")).alias("last"), F.count_if(digits.isNull()).alias("missing")).first()
    if facts["width"] is None:
        return df
    rows, size = df.withColumn("__number", digits.cast("long")), 10 ** facts["width"]
    if facts["width"] <= 18 and facts["last"] + facts["missing"] + 1 >= size:
        filled = _fill_rounds(rows, "__number", size, order, partition, ties)
    else:
        filled = fill_sequence(rows, "__number", order, partition, ties)
    number = F.col("__number").cast("string")
    text = F.concat(F.lit(facts["prefix"]), F.lpad(number, F.greatest(F.lit(facts["width"]), F.length(number)), F.lit("0")))
    return filled.withColumn(column, F.coalesce(c, text)).drop("__number")


def sequence_facts(df: DataFrame, column: str) -> DataFrame:
    """One row: whether a column is a running number (at least half of its range is there) or a numbered text.

    A numbered text has digits at its end in four of five values, one prefix,
    and at least half of the range of its numbers.
    """
    return _sequences(df, [column]).select(F.col("s0.numeric_sequence").alias("numeric_sequence"), F.col("s0.text_sequence").alias("text_sequence"))


def sequences(df: DataFrame, columns: list[str]) -> dict[str, tuple[bool, bool]]:
    """sequence_facts() of any number of columns in one aggregate."""
    row = _sequences(df, columns).first() if columns else None
    return {c: (row[f"s{i}"]["numeric_sequence"], row[f"s{i}"]["text_sequence"]) for i, c in enumerate(columns)}


def _sequences(df: DataFrame, columns: list[str]) -> DataFrame:
    parts, facts, told = [], [], []
    for i, column in enumerate(columns):
        s = F.trim(F.col(f"`{column}`").cast("string"))
        number = F.when(s.rlike(r"^-?\d{1,15}$"), s.cast("long"))
        tail = F.when(s.rlike(_NUMBERED) & ~s.rlike(r"^-?\d+$"), F.nullif(F.substring(F.regexp_extract(s, _NUMBERED, 2), -15, 15), F.lit("")).cast("long"))
        parts.append(F.struct(s.alias("s"), number.alias("x"), tail.alias("t"), F.when(tail.isNotNull(), F.regexp_extract(s, _NUMBERED, 1)).alias("p")).alias(f"c{i}"))
        of = lambda k, i=i: F.col(f"c{i}.{k}")
        facts += [
            F.count(of("s")).alias(f"n{i}"), F.count(of("x")).alias(f"nx{i}"), F.min(of("x")).alias(f"lx{i}"), F.max(of("x")).alias(f"hx{i}"),
            F.count(of("t")).alias(f"nt{i}"), F.min(of("t")).alias(f"lt{i}"), F.max(of("t")).alias(f"ht{i}"), F.min(of("p")).alias(f"p0{i}"), F.max(of("p")).alias(f"p1{i}"),
        ]
        a = lambda k, i=i: F.col(f"{k}{i}")
        dense = lambda n, low, high, a=a: F.coalesce(a(n) >= 0.5 * (a(high) - a(low) + 1), F.lit(False))
        numeric = (a("n") > 0) & (a("nx") == a("n")) & dense("nx", "lx", "hx")
        text = (a("nt") > 0) & (a("nt") >= 0.8 * a("n")) & (a("p0") == a("p1")) & dense("nt", "lt", "ht")
        told.append(F.struct(F.coalesce(numeric, F.lit(False)).alias("numeric_sequence"), F.coalesce(text, F.lit(False)).alias("text_sequence")).alias(f"s{i}"))
    return df.select(*parts).agg(*facts).select(*told)


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """The date, with a day beyond the month's end moved to it."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)


def calendar_part(part: str, d: Column) -> Column:
    return {"month": F.month, "day": F.dayofmonth, "week": F.weekofyear, "quarter": F.quarter, "year": F.year}[part](d)


@dataclass(frozen=True)
class Facts:
    """What a fill decision rests on."""

    null_share: float
    distinct: int
    skew: float | None = None
    cv: float | None = None


def numeric_facts(df: DataFrame, column: str) -> Facts:
    c = F.col(column)
    r = df.agg(F.avg(c.isNull().cast("double")).alias("s"), F.count_distinct(c).alias("d"), F.skewness(c).alias("k"), (F.stddev_samp(c) / F.avg(c)).alias("v")).first()
    return Facts(r["s"] or 0.0, r["d"], r["k"], r["v"])


def numeric_method(f: Facts) -> str:
    """Rules by share of nulls (percent), distinct values and population skewness."""
    p = 100 * f.null_share
    if p == 0:
        return "none"
    if f.distinct <= 2:
        return "mode"
    if p <= 5 and f.distinct > 5:
        return "median"
    if 5 < p <= 25:
        if f.distinct <= 10:
            return "mode"
        return "median" if f.distinct < 3 or abs(f.skew or 0) > 0.75 else "mean"
    if 25 < p <= 60:
        return "median" if f.distinct > 10 else "mode"
    if p > 60:
        return "drop" if (f.cv or 0) <= 0.2 else "median"
    return "median"


def temporal_method(null_share: float, kind: str, distinct: int, has_datetime: bool = False) -> str:
    """Rules for date-like, duration and calendar columns."""
    p = 100 * null_share
    if p == 0:
        return "none"
    if kind == "calendar" and has_datetime:
        return "derive"
    if p <= 5:
        return {"date": "neighbours", "duration": "median"}.get(kind, "mode")
    if p <= 60:
        return {"calendar": "mode", "duration": "median"}.get(kind, "neighbours")
    return "drop" if distinct <= 2 else "mode"


def impute_numeric(df: DataFrame, column: str, flag: bool = False) -> DataFrame:
    """Decide by the rules and fill; ``flag`` adds ``{column}_missing``."""
    method = numeric_method(numeric_facts(df, column))
    if method == "drop":
        return df.drop(column)
    out = df.withColumn(f"{column}_missing", F.col(column).isNull()) if flag else df
    return out if method == "none" else fill_with(out, column, method)


def date_gap_variation(df: DataFrame, column: str) -> DataFrame:
    """Days between following distinct dates: their number, coefficient of variation, and whether dates run evenly."""
    days = df.select(F.to_date(column).alias("d")).where("d is not null").distinct()
    gaps = days.select(F.datediff("d", F.lag("d").over(Window.orderBy("d"))).alias("gap")).where("gap is not null")
    out = gaps.agg(F.count("gap").alias("n"), (F.stddev_samp("gap") / F.avg("gap")).alias("cv"))
    return out.select("n", F.bround("cv", 6).alias("cv"), F.coalesce((F.col("n") >= 2) & (F.col("cv") < 1), F.lit(False)).alias("sequential"))

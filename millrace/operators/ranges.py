"""Columns that hold several values in one string: ranges, year ranges, coordinates, money and pay with their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbers, places
from millrace.functions.temporal import date_of

#: An affix longer than this is text and not a unit.
LONGEST_AFFIX = 4
_PART = r"([^\d\s-]{0,12}?)\s*(\d+(?:\.\d+)?)\s*([^\d\s-]{0,12}(?: [^\d\s-]{1,12})?)"
_RANGE = rf"(?i)^\s*{_PART}\s*(?:-|–|\bto\b)\s*{_PART}\s*$"


def range_affixes(c: Column) -> Column:
    """low and high of a range as strings, with the affixes of one end given to the other; text that is no unit goes to ``text``.

    A prefix of the first number and a postfix of the second hold for both:
    ``2-5k`` is 2k and 5k, ``$2-3`` is $2 and $3, ``2-6 rs`` is 2 rs and 6 rs.
    """
    g = [None, *[F.regexp_extract(c, _RANGE, i) for i in range(1, 7)]]
    own = lambda x: F.when(F.length(F.trim(x)) <= LONGEST_AFFIX, F.trim(x)).otherwise("")
    first = lambda *x: F.coalesce(*[F.nullif(own(y), F.lit("")) for y in x], F.lit(""))
    before = (first(g[1], g[4]), first(g[4], g[1]))
    behind = (first(g[3], g[6]), first(g[6], g[3]))
    blank = lambda x: F.when(F.length(x) > 1, F.concat(F.lit(" "), x)).otherwise(x)  # noqa: E731  a unit of letters stands apart
    text = F.nullif(F.trim(F.concat_ws(" ", *[F.when(F.length(F.trim(x)) > LONGEST_AFFIX, F.trim(x)) for x in (g[1], g[3], g[4], g[6])])), F.lit(""))
    ends = [F.concat(b, n, blank(a)) for b, n, a in zip(before, (g[2], g[5]), behind, strict=True)]
    return F.when(c.rlike(_RANGE), F.struct(ends[0].alias("low"), ends[1].alias("high"), text.alias("text")))


def components(c: Column) -> Column:
    """start_year, end_year, value_min, value_max, value and text of a string, by the first form that fits.

    The forms are a year range, ``a - b`` and ``a to b`` (with suffixes k, m, b),
    a number with suffix, and a number with text before or behind it.
    """
    years, span = numbers.year_range(c), numbers.value_range(c)
    single = numbers.suffixed(c)
    with_text = r"^\s*([^\d]*?)\s*(\d+(?:\.\d+)?[kmbKMB]?\+?)(?![\w.])\s*([^\d]*)$"
    value = F.when(years.isNull() & span.isNull(), F.coalesce(single, numbers.suffixed(F.regexp_extract(c, with_text, 2))))
    text = F.when(value.isNotNull() & single.isNull(), F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.regexp_extract(c, with_text, 1), F.lit("")), F.nullif(F.regexp_extract(c, with_text, 3), F.lit("")))), F.lit("")))
    plain = F.when(years.isNull(), span)
    return F.struct(
        years["start_year"].alias("start_year"), years["end_year"].alias("end_year"), plain["value_min"].alias("value_min"), plain["value_max"].alias("value_max"), value.alias("value"), text.alias("text")
    )


def _replaced(df: DataFrame, column: str, new: dict[str, Column]) -> DataFrame:
    """The table with a column replaced by others, at its place."""
    out = []
    for c in df.columns:
        out += [v.alias(n) for n, v in new.items()] if c == column else [F.col(f"`{c}`")]
    return df.select(*out)


def split_components(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """A column's components as columns ``{column}_{part}``, of the parts that any value has; kept as it is where under ``share`` of the values has numbers."""
    c = F.col(f"`{column}`")
    parts = ("start_year", "end_year", "value_min", "value_max", "value", "text")
    made = components(c)
    numeric = F.coalesce(made["start_year"].cast("double"), made["value_min"], made["value"]).isNotNull()
    row = df.where(c.isNotNull()).agg(F.avg(numeric.cast("int")).alias("share"), *[F.count(made[p]).alias(p) for p in parts]).first()
    if (row["share"] or 0.0) < share:
        return df
    return _replaced(df, column, {f"{column}_{p}": made[p] for p in parts if row[p]})


def split_ranges(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """A column of strict ranges as ``{column}_min`` and ``{column}_max``; kept where under ``share`` are ranges or as many are dates."""
    c = F.col(f"`{column}`")
    years, span = numbers.year_range(c), numbers.value_range(c)
    low = F.coalesce(years["start_year"].cast("double"), span["value_min"])
    high = F.coalesce(years["end_year"].cast("double"), span["value_max"])
    row = df.where(c.isNotNull()).agg(F.avg(low.isNotNull().cast("int")).alias("ranges"), F.avg(date_of(c).isNotNull().cast("int")).alias("dates")).first()
    if (row["ranges"] or 0.0) < share or (row["dates"] or 0.0) >= share:
        return df
    return _replaced(df, column, {f"{column}_min": low, f"{column}_max": high})


def split_coordinates(df: DataFrame, column: str) -> DataFrame:
    """``{column}_latitude`` and ``{column}_longitude`` in place of a column of pairs."""
    pair = places.geo_pair(F.col(f"`{column}`"))
    return _replaced(df, column, {f"{column}_{part}": pair[part] for part in ("latitude", "longitude")})


def split_money(df: DataFrame, column: str) -> DataFrame:
    """Amounts named after the one currency, or, where there are several, with a column of codes beside them."""
    c = F.col(f"`{column}`")
    code = numbers.currency_of(c)
    row = df.agg(F.min(code).alias("a"), F.max(code).alias("b")).first()
    if row["a"] is None or row["a"] == row["b"]:
        return _replaced(df, column, {f"{column}_({row['a']})" if row["a"] else column: numbers.money_amount(c)})
    return _replaced(df, column, {column: numbers.money_amount(c), f"{column}_(currency_type)": code})


def pay_scenario(df: DataFrame, column: str) -> str:
    """uniform, mixed_time, mixed_currency, mixed_both, or has_hourly_weekly where pay by the hour, day or week occurs."""
    parts = numbers.pay_parts(F.col(f"`{column}`"))
    p = df.select(parts["currency"].alias("c"), parts["per_year"].alias("t")).where("t is not null")
    r = p.agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    if r["t1"] is not None and r["t1"] > 12:
        return "has_hourly_weekly"
    currencies, times = r["c0"] != r["c1"], r["t0"] != r["t1"]
    return "mixed_both" if currencies and times else "mixed_currency" if currencies else "mixed_time" if times else "uniform"


def split_pay(df: DataFrame, column: str) -> DataFrame:
    """Pay by its scenario: in INR a year where units differ by currency and time or pay is by the hour, else amounts with what differs beside them."""
    c = F.col(f"`{column}`")
    parts, scenario = numbers.pay_parts(c), pay_scenario(df, column)
    if scenario in ("has_hourly_weekly", "mixed_both"):
        return _replaced(df, column, {f"{column}_(INR_per_year)": numbers.yearly_pay_inr(c)})
    amount = F.bround(parts["amount"], 2)
    if scenario == "mixed_currency":
        return _replaced(df, column, {column: amount, f"{column}_currency": parts["currency"]})
    if scenario == "mixed_time":
        names = {2080.0: "hour", 260.0: "day", 52.0: "week", 12.0: "month", 1.0: "year"}
        unit = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[parts["per_year"]]
        return _replaced(df, column, {column: amount, f"{column}_time_unit": unit})
    return _replaced(df, column, {column: amount})

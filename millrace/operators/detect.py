"""Semantic types: one aggregate scores every column against every type, rules choose."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import numbers, places, temporal
from millrace.functions.units import MEASURES, dominant_unit
from millrace.operators.rows import is_number


def _not_null(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: f(c).isNotNull()


#: Tests of single values by type, in order of preference where scores tie.
TESTS: dict[str, Callable[[Column], Column]] = {
    "date": lambda c: temporal.date_of(c).isNotNull() & ~is_number(c) | c.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])([0-2]\d|3[01])$"),
    "time": lambda c: temporal.time_of(c).isNotNull() & (c.rlike(":") | ~is_number(c)),
    "datetime": lambda c: c.rlike(r"\d\s*[:]\s*\d{2}") & temporal.datetime_of(c).isNotNull(),
    "timestamp": _not_null(temporal.valid_timestamp),
    "year": _not_null(temporal.year_of),
    "month": _not_null(temporal.month_name),
    "day": lambda c: c.rlike(r"^[A-Za-z]{3,9}$") & temporal.day_name(c).isNotNull(),
    "week": _not_null(lambda c: temporal.week_label(c, 2000)),
    "quarter": _not_null(lambda c: temporal.quarter_label(c, 2000)),
    "fiscal_year": _not_null(temporal.fiscal_year),
    "duration": lambda c: temporal.duration_seconds(c).isNotNull() & ~is_number(c),
    "currency": _not_null(numbers.currency_of),
    "salary": numbers.is_pay,
    "number_systems": _not_null(numbers.numeral),
    "percentage": _not_null(numbers.percentage),
    "ratio": _not_null(numbers.ratio),
    "integer": lambda c: c.rlike(r"^[+-]?\d{1,3}(,\d{3})+$|^[+-]?\d+$"),
    "float": lambda c: c.rlike(r"^[+-]?(\d+\.\d+|\.\d+)$"),
    **{k: (lambda c, m=m: c.rlike(m.pattern())) for k, m in MEASURES.items()},
    "latitude": lambda c: places.latitude(c).isNotNull() & c.rlike(r"(?i)[ns°.]"),
    "longitude": lambda c: places.longitude(c).isNotNull() & c.rlike(r"(?i)[ew°.]"),
    "geo_coordinate": _not_null(places.geo_pair),
    "timezone": lambda c: places.is_a("timezone", c),
    "boolean": lambda c: F.lower(c).isin(*places.TRUE_WORDS, *places.FALSE_WORDS),
    "gender": _not_null(places.gender_of),
    "email": lambda c: places.is_a("email", c),
    "url": lambda c: places.is_a("url", c),
    "network_addresses": lambda c: places.is_a("ipv4", c) | places.is_a("ipv6", c) | places.is_a("mac", c),
    "file_path": lambda c: places.is_a("path", c),
    "files": lambda c: places.is_a("file", c),
    "version": lambda c: places.is_a("version", c) & ~is_number(c),
    "varchar": lambda c: (F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) > 0.6 * F.length(c)) & c.rlike("[A-Za-z]") & c.rlike(r"\d") & ~places.is_a("timezone", c),
    "text": lambda c: c.rlike(r"^[\p{L}\s.,;:!?'\"()&-]+$"),
}

#: Words in a column's name that force a type when no test is sure.
KEYWORDS = {r"income|salary|revenue|expense|price|amount|amt|budget": "currency", r"discount": "percentage", r"fiscal.*year": "fiscal_year"}


#: Types are told from all rows; a number asks for a look at that many values of each column.
SAMPLE = None


def _values(df: DataFrame, columns: list[str], sample: int | None) -> DataFrame:
    """column_name, v and n: the different non-null values of each column and how often they occur.

    With a sample these are a column's first ``sample`` non-null values in the
    order of the rows' numbers, so that neither leading nulls nor the order of
    partitions change what is looked at.
    """
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`").cast("string")).alias("v"))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.explode(F.array(*map(pair, columns))).alias("p"))
    rows = rows.select("__row", "p.*").where("v is not null and v <> ''")
    if sample:
        nth = F.row_number().over(Window.partitionBy("column_name").orderBy("__row"))
        rows = rows.withColumn("__nth", nth).where(F.col("__nth") <= sample)
    return rows.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))


#: Tests that look at digits, each with what a value must look like to pass: a test of its shape, in which every digit is 0.
POSSIBLE: dict[str, Callable[[Column], Column]] = {
    "date": lambda s: temporal.date_shape(s) | (s == "00000000"),
    "time": lambda s: s.rlike(temporal.TIME) | F.lower(s).isin(*temporal.CLOCK_WORDS),
    "datetime": lambda s: s.rlike(r"0\s*[:]\s*00"),
    "timestamp": lambda s: s.rlike(r"^0{10}|^0000-00-00[T ]00:00"),
    "year": lambda s: s.rlike(r"[A-Za-z]") & s.rlike("00"),
    "week": lambda s: s.rlike(r"(?i)w(eek)?\s*0{1,2}$"),
    "quarter": lambda s: s.rlike(r"(?i)q(uarter)?\s*0$"),
    "number_systems": lambda s: s.rlike(r"(?i)^\s*0[xbo]") | numbers.numeral(s).isNotNull(),
    **{k: (lambda s, m=m: s.rlike(m.shape_pattern())) for k, m in MEASURES.items() if m.shape_pattern() != m.pattern()},
    "latitude": lambda s: s.rlike(r"(?i)[ns°.]") & (s.rlike(places.DEGREES) | s.rlike(places.DMS)),
    "longitude": lambda s: s.rlike(r"(?i)[ew°.]") & (s.rlike(places.DEGREES) | s.rlike(places.DMS)),
    "geo_coordinate": lambda s: s.rlike("[,;|]") & s.rlike("0") & ~s.rlike("[A-DF-MO-RT-VX-Za-df-mo-rt-vx-z$%@/]"),
    "boolean": lambda s: F.lower(s).isin("0", *places.TRUE_WORDS, *places.FALSE_WORDS),
    "network_addresses": lambda s: s.rlike(r"^0{1,3}(\.0{1,3}){3}(/0{1,2})?$") | places.is_a("ipv6", s) | places.is_a("mac", s),
    "files": lambda s: s.rlike(r"(?i)\.mp0$") | places.is_a("file", s),
}


def shape(v: Column) -> Column:
    """A value with every digit as 0."""
    return F.translate(v, "123456789", "0" * 9)


def evidence(df: DataFrame, columns: list[str] | None = None, sample: int | None = SAMPLE) -> list[dict]:
    """For each column with values: column_name, one score by type (share of non-null values that pass its test), and the facts that rules look at.

    Different values are grouped by shape: tests that don't look at digits are
    run once a shape, on one value of it.  Of the others a shape tells whether a
    value could pass, so a second look, if there is any, takes only columns and
    tests of such shapes, each different value once.  A column of numbers, money
    or measurements has a few shapes, however many values it has; a column of
    free text has as many as values.
    """
    values = _values(df, columns or df.columns, sample)
    v, low = F.col("v"), F.lower("v")
    pair = r"^(\d{1,9}):(\d{1,9})$"
    left, right = (F.nullif(F.regexp_extract(v, pair, i), F.lit("")).cast("int") for i in (1, 2))
    beyond = (right > 59) | (left > 23)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    facts = {
        "numbers": count(is_number(v)), "grouped_numbers": count(is_number(F.regexp_replace(v, "[, ]", ""))), "fractions": count(is_number(v) & ~v.rlike(r"^[+-]?\d+(\.0*)?$")), "bare_year": count(v.rlike(r"^(19\d\d|20\d\d|2100)$")),
        "ratio_like": count(v.rlike(pair) & beyond | v.rlike(r"^\d+/\w+$")), "time_like": count(v.rlike(pair) & ~beyond), "mean_length": F.sum(F.length(v) * F.col("n")),
    }
    flags = {"true_side": (F.max, places.TRUE_WORDS), "false_side": (F.max, places.FALSE_WORDS), "only_boolean": (F.min, (*places.TRUE_WORDS, *places.FALSE_WORDS))}
    of_shape = [F.sum("n").alias("n"), F.min("v").alias("v"), *[f.alias(k) for k, f in facts.items()], *[f(low.isin(*words)).alias(k) for k, (f, words) in flags.items()]]
    shapes = values.groupBy("column_name", shape(v).alias("shape")).agg(*of_shape)
    settled = [k for k in TESTS if k not in POSSIBLE]
    tested = shapes.select("column_name", "n", *facts, *flags, *[TESTS[k](v).cast("int").alias(k) for k in settled], *[POSSIBLE[k](shape(v)).alias(f"{k}?") for k in POSSIBLE])
    share = lambda k: F.sum(F.col(k) * F.col("n")) / F.sum("n")
    rows = tested.groupBy("column_name").agg(
        F.sum("n").alias("n"), *[share(k).alias(k) for k in settled], *[(F.sum(k) / F.sum("n")).alias(k) for k in facts],
        *[f(k).alias(k) for k, (f, _) in flags.items()], *[F.max(F.coalesce(f"{k}?", F.lit(False))).alias(f"{k}?") for k in POSSIBLE],
    ).collect()  # a row a column
    found = {r["column_name"]: {k: x for k, x in r.asDict().items() if not k.endswith("?")} | dict.fromkeys(POSSIBLE, 0.0) for r in rows}
    open_ = {k: [r["column_name"] for r in rows if r[f"{k}?"]] for k in POSSIBLE}
    open_ = {k: c for k, c in open_.items() if c}
    if open_:
        wanted = sorted({c for columns_ in open_.values() for c in columns_})
        again = _values(df, wanted, sample)
        passed = [F.sum(F.when(F.col("column_name").isin(c) & POSSIBLE[k](shape(v)) & TESTS[k](v), F.col("n")).otherwise(0)).alias(k) for k, c in open_.items()]
        for r in again.groupBy("column_name").agg(*passed).collect():
            found[r["column_name"]] |= {k: r[k] / found[r["column_name"]]["n"] for k in open_}
    return list(found.values())


def _table(df: DataFrame, rows: list[dict], names: tuple[str, ...]) -> DataFrame:
    kind = lambda k: "boolean" if k in ("true_side", "false_side", "only_boolean") else "double"
    return df.sparkSession.createDataFrame([tuple(r[k] for k in ("column_name", *names)) for r in rows], ", ".join(["column_name string", *[f"`{k}` {kind(k)}" for k in names]]))


def scores(df: DataFrame, columns: list[str] | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """column_name and one score by type: share of non-null values that pass the type's test."""
    return _table(df, evidence(df, columns, sample), tuple(TESTS))


#: Types that hold a measure, in the order in which they are preferred to a general type.
GENERAL = ("varchar", "text")
TEMPORAL, MONEY_TYPES = ("timestamp", "datetime", "date", "time"), ("currency", "salary")


def of_equal_rank(row: dict[str, float], kinds) -> str:
    """The best type by score; of equals the first in order."""
    order = list(TESTS)
    return max(kinds, key=lambda k: (row.get(k) or 0.0, -order.index(k)))


def overridden(best: str, row: dict[str, float], facts: dict[str, float]) -> tuple[str, float] | None:
    """Type and confidence where a rule beats the best score.

    ``facts`` are shares of a column's values: ``bare_year`` (four digits from
    1900 to 2100), ``ratio_like`` and ``time_like`` (of forms a:b, those beyond
    the clock and those within it), and the flags ``true_side``, ``false_side`` and
    ``only_boolean`` (all values are true or false words).
    """
    score = lambda k: row.get(k) or 0.0
    if facts.get("year_named") and facts.get("bare_year", 0) > 0.7:
        return "year", facts["bare_year"]
    if score("ratio") > 0.5 and facts.get("ratio_like", 0) > facts.get("time_like", 0):
        return "ratio", score("ratio")
    if facts.get("only_boolean") and facts.get("true_side") and facts.get("false_side"):
        return "boolean", max(score("boolean"), 0.9)
    if best in GENERAL:
        for kind in (*MEASURES, "salary"):
            if score(kind) >= 0.6:
                return kind, score(kind)
    if best in ("integer", *GENERAL) and score("number_systems") >= 0.6 and score("number_systems") > score("integer"):
        return "number_systems", score("number_systems")
    return None


def is_mixed(row: dict[str, float]) -> bool:
    """Incompatible forms in one column: dates beside money, or several temporal forms of which none is in four of five values."""
    if (row.get("number_systems") or 0) >= 0.6:
        return False
    often = {k for k in TESTS if (row.get(k) or 0) > 0.2}
    temporal_ = [k for k in TEMPORAL if k in often]
    if temporal_ and often & set(MONEY_TYPES):
        return True
    return len(temporal_) > 1 and max(row[k] for k in temporal_) < 0.8


def basic_type(facts: dict[str, float]) -> str:
    """integer or float where over four of five values are numbers, else varchar or text by mean length."""
    if facts.get("numbers", 0) > 0.8:
        return "float" if facts.get("fractions", 0) > 0 else "integer"
    return "varchar" if facts.get("mean_length") is not None and facts["mean_length"] < 100 else "text"


def choose(name: str, row: dict[str, float], facts: dict[str, float] | None = None) -> tuple[str, float]:
    """Type and confidence of a column from its scores and facts.

    Mixed columns are ``mixed``, whatever else fits; then the best score, the
    first of equals, unless a rule overrides it; below one half the basic type
    with confidence 0.  A column is boolean only if all its values are true or
    false words.  Below 0.6, a word in the column's name forces a type.
    """
    facts = facts or {}
    if not facts.get("only_boolean"):
        row = row | {"boolean": 0.0}
    best = of_equal_rank(row, TESTS)
    score = row.get(best) or 0.0
    found = ("mixed", 0.0) if is_mixed(row) else overridden(best, row, {**facts, "year_named": "year" in name.lower()})
    if found is None:
        if best == "number_systems" and (row.get("integer") or 0) + (row.get("float") or 0) >= score:
            best = of_equal_rank(row, ("integer", "float"))
        found = (best, score) if score >= 0.5 else (basic_type(facts) if facts else "text", 0.0)
    if found[1] < 0.6 and found[0] != "mixed":
        for words, kind in KEYWORDS.items():
            if re.search(words, name, re.IGNORECASE):
                return kind, 0.6
    return found


#: Facts of a column besides its scores.
FACTS = ("numbers", "grouped_numbers", "fractions", "bare_year", "ratio_like", "time_like", "mean_length", "true_side", "false_side", "only_boolean")


def column_facts(df: DataFrame, columns: list[str] | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """column_name and the shares and flags that the rules of choose() look at."""
    return _table(df, evidence(df, columns, sample), FACTS)


def semantic_types(df: DataFrame, sample: int | None = SAMPLE) -> dict[str, tuple[str, float]]:
    """Type and confidence of every column; columns without a value are text."""
    rows = {r["column_name"]: r for r in evidence(df, sample=sample)}
    found = {c: choose(c, row, row) for c, row in rows.items()}
    return {c: found.get(c, ("text", 0.0)) for c in df.columns}


def units_in_strings(df: DataFrame, column: str) -> tuple[str, str] | None:
    """Kind and unit of the strings among a column's numbers: the one measure that half of them are of.

    Null where two measures tie, or where a type without units fits as well.
    """
    c = F.trim(F.col(f"`{column}`").cast("string"))
    strings = df.select(c.alias(column)).where(F.col(f"`{column}`").isNotNull() & ~is_number(F.col(f"`{column}`")))
    rows = evidence(strings)
    if not rows:
        return None
    row = rows[0]
    with_units = {k: row.get(k) or 0.0 for k in (*MEASURES, "currency", "percentage")}
    best = max(with_units.values())
    tied = [k for k, x in with_units.items() if x == best]
    others = max((row.get(k) or 0.0 for k in TESTS if k not in with_units and k not in GENERAL), default=0.0)
    if best < 0.5 or len(tied) > 1 or others >= best:
        return None
    kind = tied[0]
    unit = "%" if kind == "percentage" else _vote(strings, numbers.currency_of(F.col(f"`{column}`"))) if kind == "currency" else dominant_unit(strings, column, MEASURES[kind])
    return kind, unit


def _vote(df: DataFrame, c: Column) -> str | None:
    row = df.select(c.alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").first()
    return row["v"] if row else None

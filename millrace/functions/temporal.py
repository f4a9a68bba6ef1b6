"""Dates, times, durations and calendar parts in strings.  Days come first in ambiguous dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.units import _lookup

# Names, day-first formats in order of trial, and clock words.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTH_NAMES = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Shapes of dates, each with the one format that reads it: a value is told by its shape and parsed once.
DATE_SHAPES = (
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"), (r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$", "MMMM d yyyy"), (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yy"), (r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"), (r"^[A-Z][a-z]{3,} \d{4}$", "MMMM yyyy"),
)
CLOCK_WORDS = {"noon": "12:00", "midnight": "00:00", "morning": "09:00", "afternoon": "15:00", "evening": "18:00", "night": "21:00"}


def _tidy(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), r"(?i)(\d)(?:st|nd|rd|th)\b|[,\s]+", "$1 ")
    return F.trim(F.initcap(F.regexp_replace(t, " +", " ")))


def date_of(c: Column) -> Column:
    """Date of a string in any of the known forms; null for others and for days that don't exist.

    The tidied string is bound once, by a one-element array: inlined, it would be
    worked out anew for each shape.
    """

    def parsed(t: Column) -> Column:
        out = F.when(~t.rlike(r"^(?:\d|[A-Z][a-z]{2,8} \d)") | (F.length(t) > 30), F.lit(None).cast("date"))
        for shape, form in DATE_SHAPES:
            out = out.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form)).cast("date"))
        return out

    return F.transform(F.array(_tidy(c)), parsed)[0]


def date_shape(c: Column) -> Column:
    """Whether a string has the shape of a date, whatever its digits."""

    def shaped(t: Column) -> Column:
        return (F.length(t) <= 30) & t.rlike("|".join(f"(?:{shape})" for shape, _ in DATE_SHAPES))

    return F.transform(F.array(_tidy(c)), shaped)[0]


def date_text(c: Column) -> Column:
    return F.date_format(date_of(c), "dd-MM-yyyy")


TIME = r"(?i)^\s*(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))?\s*(?:([ap])\.?m\.?)?\s*$"


def time_of(c: Column) -> Column:
    """24-hour HH:mm of times, with or without seconds and AM or PM, and of clock words."""
    part = lambda i: F.nullif(F.regexp_extract(c, TIME, i), F.lit("")).cast("int")
    hour, minute, second, half = part(1), part(2), part(3), F.lower(F.regexp_extract(c, TIME, 4))
    of_day = F.when(half == "", F.when(minute.isNotNull() & (hour < 24), hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    good = (F.coalesce(minute, F.lit(0)) < 60) & (F.coalesce(second, F.lit(0)) < 60) & of_day.isNotNull()
    clock = F.when(good, F.format_string("%02d:%02d", of_day, F.coalesce(minute, F.lit(0))))
    return F.when(c.rlike(TIME), clock).otherwise(_lookup(CLOCK_WORDS, F.lower(F.trim(c))))


def seconds_of_day(c: Column) -> Column:
    """Seconds since midnight of HH:mm or HH:mm:ss; null beyond 23:59:59."""
    shape = r"^([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?$"
    at = F.instr(c, ":")  # two digits follow, and two more behind another colon or none
    hour, minute, second = F.substring_index(c, ":", 1), F.substr(c, at + 1, F.lit(2)), F.nullif(F.substr(c, at + 4, F.lit(2)), F.lit(""))
    return F.when(c.rlike(shape), hour.cast("int") * 3600 + minute.cast("int") * 60 + F.coalesce(second.cast("int"), F.lit(0)))


def time_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def datetime_of(c: Column) -> Column:
    """Timestamp of a date followed by a time, or of a date alone; null where either part is no such thing."""
    shape = r"(?i)^\s*(.*?\d{2,4}.*?)[\sT]+(\d{1,2}(?::\d{1,2}){1,2}\s*(?:[ap]\.?m\.?)?)\s*$"
    timed = c.rlike(shape)
    date, clock = date_of(F.when(timed, F.regexp_extract(c, shape, 1)).otherwise(c)), F.when(timed, F.regexp_extract(c, shape, 2))
    minutes = F.when(timed, time_of(clock)).otherwise("00:00")
    seconds = F.coalesce(F.nullif(F.regexp_extract(clock, r":\d{1,2}:(\d{1,2})", 1), F.lit("")).cast("int"), F.lit(0))
    hour, minute = F.substring(minutes, 1, 2).cast("int"), F.substring(minutes, 4, 2).cast("int")
    return F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + hour * 3600 + minute * 60 + seconds)


def datetime_text(c: Column) -> Column:
    return F.date_format(datetime_of(c), "dd-MM-yyyy HH:mm:ss")


def valid_timestamp(c: Column) -> Column:
    """The string if it is an epoch of 10, 13 or 16 digits or an ISO timestamp."""
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
    return F.when(c.rlike(r"^\d{10}(\d{3}(\d{3})?)?$") | (c.rlike(iso) & F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()), c)


def duration_seconds(c: Column) -> Column:
    """Seconds of ``90m``, ``1h 30m``, ``2 days``, ``1:30``, ``1:30:05`` and ISO ``PT1H30M``; months 30 and years 365 days."""
    t = F.lower(F.trim(c))
    unit = {"year": r"y|yrs?|years?", "month": r"mos?|months?", "week": r"w|wks?|weeks?", "day": r"d|days?", "hour": r"h|hrs?|hours?", "minute": r"m|mins?|minutes?", "second": r"s|secs?|seconds?"}
    size = {"year": 31536000, "month": 2592000, "week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}
    term = lambda u: F.coalesce(F.nullif(F.regexp_extract(t, rf"(\d+(?:\.\d+)?)\s*(?:{unit[u]})(?![a-z])", 1), F.lit("")).cast("double"), F.lit(0.0)) * size[u]
    words = "|".join(unit.values())
    compound = t.rlike(rf"^(\d+(\.\d+)?\s*({words})[\s,]*)+$")
    clock = r"^(\d{1,3}):(\d{2})(?::(\d{2}))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, clock, i), F.lit("")).cast("int"), F.lit(0))
    iso = r"^p(?:(\d+)d)?t?(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$"
    piece = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, iso, i), F.lit("")).cast("int"), F.lit(0))
    return (
        F.when(compound, reduce(lambda a, b: a + b, map(term, unit)))
        .when(t.rlike(clock), (part(1) * 3600 + part(2) * 60 + part(3)).cast("double"))
        .when(t.rlike(iso) & (F.length(t) > 1), (piece(1) * 86400 + piece(2) * 3600 + piece(3) * 60 + piece(4)).cast("double"))
    )


def in_units(seconds: Column, unit: str) -> Column:
    size = {"ms": 0.001, "secs": 1, "mins": 60, "hrs": 3600, "days": 86400, "weeks": 604800, "months": 2592000, "years": 31536000}[unit]
    return (seconds / size).cast("long")


def year_of(c: Column) -> Column:
    """Year of decorated forms (``Year 2025``, ``2025 AD``, ``Y2025``, ``FY25``) within 1900 to 2100; two digits turn at 50."""
    digits = F.regexp_extract(c, r"^(?:Year\s*|Y|FY\s*)?'?(\d{4}|\d{2})(?:\s*(?:AD|CE))?$", 1)
    short = digits.cast("int") + F.when(digits.cast("int") < 50, 2000).otherwise(1900)
    year = F.when(F.length(digits) == 2, short).when(F.length(digits) == 4, digits.cast("int"))
    return F.when(c.rlike(r"[A-Za-z]") & year.between(1900, 2100), year)


def month_name(c: Column) -> Column:
    n = _lookup(MONTHS, F.lower(F.substring(F.trim(c), 1, 3)))
    return F.when(n.isNotNull() & F.trim(c).rlike(r"^[A-Za-z]{3,9}\.?$"), F.element_at(F.array(*map(F.lit, MONTH_NAMES)), n))


def day_name(c: Column) -> Column:
    key = F.lower(F.substring(F.trim(c), 1, 3))
    return _lookup({d[:3].lower(): d for d in DAYS}, key)


def week_label(c: Column, year: int) -> Column:
    """yyyy-Wnn of ``W5``, ``Week 5`` and ``2024-W05``; ``year`` stands in where there is none."""
    shape = r"(?i)^(?:(\d{4})[-\s]?)?w(?:eek)?\s*(\d{1,2})$"
    y, w = F.nullif(F.regexp_extract(c, shape, 1), F.lit("")), F.regexp_extract(c, shape, 2)
    return F.when(c.rlike(shape) & F.nullif(w, F.lit("")).cast("int").between(1, 53), F.concat(F.coalesce(y, F.lit(str(year))), F.lit("-W"), F.lpad(w, 2, "0")))


def quarter_label(c: Column, year: int) -> Column:
    shape = r"(?i)^(?:(\d{4})[-\s]?)?q(?:uarter)?\s*([1-4])$"
    y = F.nullif(F.regexp_extract(c, shape, 1), F.lit(""))
    return F.when(c.rlike(shape), F.concat(F.coalesce(y, F.lit(str(year))), F.lit("-Q"), F.regexp_extract(c, shape, 2)))


def fiscal_year(c: Column) -> Column:
    """FY-yyyy of ``FY2024``, ``FY 24``, ``FY2023-24``: the first year named."""
    y = F.regexp_extract(c, r"(?i)^(?:fy|fiscal year)[\s-]*(\d{4}|\d{2})(?:[-/]\d{2,4})?$", 1)
    full = F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < 50, "20").otherwise("19"), y)).when(F.length(y) == 4, y)
    return F.concat(F.lit("FY-"), full)

"""Money, percentages, ratios and numerals in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.units import _lookup

# Currency signs and codes, multipliers, pay periods in a year, and rates to INR.
SIGNS = {"R$": "BRL", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "₨": "INR", "Rs": "INR", "৳": "BDT", "฿": "THB", "₱": "PHP", "₫": "VND", "₪": "ILS", "₦": "NGN", "Rp": "IDR", "kr": "SEK", "₺": "TRY"}
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "AUD", "CAD", "CHF", "KRW", "RUB", "BDT", "THB", "PHP", "VND", "ILS", "NGN", "BRL", "IDR", "SEK", "NOK", "DKK", "ISK", "CNY", "NZD", "SGD", "HKD", "ZAR", "MXN", "AED", "SAR")
MULTIPLIERS = {"cr": 1e7, "crore": 1e7, "lakh": 1e5, "lac": 1e5, "l": 1e5, "k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
PERIODS = {"hour": 2080.0, "hr": 2080.0, "h": 2080.0, "day": 260.0, "daily": 260.0, "week": 52.0, "weekly": 52.0, "wk": 52.0, "month": 12.0, "monthly": 12.0, "mo": 12.0, "year": 1.0, "yearly": 1.0, "yr": 1.0, "annum": 1.0, "annual": 1.0, "annually": 1.0, "pa": 1.0}
RATES_TO_INR = {"USD": 83.12, "EUR": 91.23, "GBP": 105.45, "INR": 1.0, "JPY": 0.56, "CNY": 11.52, "AUD": 55.23, "CAD": 61.45}
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

_SIGN = "(" + "|".join(x.replace("$", r"\$") for x in SIGNS) + ")"
_CODE = f"({'|'.join(CODES)})"
_AMOUNT = r"(\d[\d.,]*)"
_SCALE = r"(?:\s*(crore|cr|lakh|lac|thousand|million|mn|billion|bn|k|m|b)\b)?"
MONEY = rf"(?i)^\s*(?:(?:save|discount|off)\s+)?[-(]?\s*(?:{_SIGN}\.?|{_CODE})?\s*{_AMOUNT}{_SCALE}\s*(?:{_SIGN}|{_CODE})?\s*\)?\s*$"
#: What all money strings look like at a glance; it spares the pattern above most other strings.
_GLANCE = r"^[^\d]{0,16}\d[\d.,]*[^\d]{0,16}$"
_BY_SIGN = {k.lower(): v for k, v in SIGNS.items()}


def plain_number(text: Column) -> Column:
    """Number of digits with separators, European or American by shape.

    The later of dot and comma is the decimal sign if both occur; a lone comma
    is one if other than three digits follow it.
    """
    european = text.rlike(r"^\d{1,3}(\.\d{3}){2,}(,\d+)?$|^\d+,\d{1,2}$|^\d{1,3}\.\d{3},\d+$")
    eu = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    us = F.replace(text, F.lit(","), F.lit(""))
    return F.when(text.rlike(r"^\d+(\.\d*)?$") & ~text.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), text.cast("double")).when(european, eu.cast("double")).when(us.rlike(r"^\d+(\.\d*)?$"), us.cast("double"))


def is_money(c: Column) -> Column:
    return c.rlike(_GLANCE) & c.rlike(MONEY)


def currency_of(c: Column) -> Column:
    """ISO code of a money string, by sign or code before or behind the amount; ``R$`` is tried before ``$``."""
    marks = F.regexp_replace(c, r"(?i)[\d.,\s()-]|save|discount|off", "")
    code = F.nullif(F.regexp_extract(F.upper(marks), _CODE, 1), F.lit(""))
    sign = F.nullif(F.lower(F.regexp_extract(marks, rf"(?i){_SIGN}", 1)), F.lit(""))
    return F.when(is_money(c), F.coalesce(code, _lookup(_BY_SIGN, sign)))


def money_amount(c: Column) -> Column:
    """Amount of a money string with its multiplier; negative with a minus or in brackets."""
    scale = F.nullif(F.lower(F.regexp_extract(c, rf"(?i){_AMOUNT}{_SCALE}", 2)), F.lit(""))
    value = plain_number(F.regexp_extract(c, _AMOUNT, 1)) * F.coalesce(_lookup(MULTIPLIERS, scale), F.lit(1.0))
    return F.when(is_money(c), F.when(c.rlike(r"^\s*[-(]"), -value).otherwise(value))


_PERIOD = "(" + "|".join(sorted(PERIODS, key=len, reverse=True)) + ")"
_PAY_AMOUNT = rf"(?:{_SIGN}|{_CODE})?\s*{_AMOUNT}{_SCALE}(?:\s*(?:-|–|to)\s*(?:{_SIGN}|{_CODE})?\s*{_AMOUNT}{_SCALE})?\s*(?:{_CODE})?"
_PAY = rf"(?i)^\s*{_PAY_AMOUNT}\s*(?:/|per|an?|-)?\s*{_PERIOD}\s*$"
_PAY_BEFORE = rf"(?i)^\s*{_PERIOD}\s*:?\s*{_PAY_AMOUNT}\s*$"
_LPA = r"(?i)^\s*(?:₹|inr|rs\.?)?\s*(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*(?:lpa|lakhs?\s+(?:per\s+annum|pa))\s*$"


def is_pay(c: Column) -> Column:
    return c.rlike(_PAY) | c.rlike(_PAY_BEFORE) | c.rlike(_LPA)


def pay_parts(c: Column) -> Column:
    """amount (the middle of a range), currency (ISO code) and per_year (periods in a year) of pay strings; null for others."""
    return F.transform(F.array(c), _pay_parts)[0]  # bound once, as its parts are asked for several times


def _pay_parts(c: Column) -> Column:
    after = c.rlike(_PAY)
    known = after | c.rlike(_PAY_BEFORE)

    def group(i: int) -> Column:
        return F.nullif(F.when(after, F.regexp_extract(c, _PAY, i)).otherwise(F.regexp_extract(c, _PAY_BEFORE, i + 1)), F.lit(""))

    def number(i: int, scale: Column) -> Column:
        return plain_number(group(i)) * F.coalesce(_lookup(MULTIPLIERS, F.lower(scale)), F.lit(1.0))

    high_scale = group(8)
    low = number(3, F.coalesce(group(4), high_scale))  # a multiplier behind the second number holds for both
    high = number(7, high_scale)
    period = F.lower(F.when(after, F.regexp_extract(c, _PAY, 10)).otherwise(F.regexp_extract(c, _PAY_BEFORE, 1)))
    code = F.coalesce(F.upper(group(2)), _lookup(_BY_SIGN, F.lower(group(1))), F.upper(group(9)))
    part = lambda i: F.nullif(F.regexp_extract(c, _LPA, i), F.lit("")).cast("double") * 1e5
    made = lambda amount, currency, per: F.struct(amount.alias("amount"), currency.alias("currency"), per.alias("per_year"))
    return F.when(c.rlike(_LPA), made((part(1) + F.coalesce(part(2), part(1))) / 2, F.lit("INR"), F.lit(1.0))).when(
        known, made((low + F.coalesce(high, low)) / 2, code, _lookup(PERIODS, period))
    )


def yearly_pay(c: Column) -> Column:
    """Pay per year, in its own currency, of strings such as ``$50k/year``, ``annual 50k``, ``10-20 per hour`` or ``8 LPA``."""
    parts = pay_parts(c)
    return parts["amount"] * parts["per_year"]


def yearly_pay_inr(c: Column) -> Column:
    """Pay per year in INR by the fixed rates; without a currency the amount as it is."""
    parts = pay_parts(c)
    return F.bround(parts["amount"] * parts["per_year"] * F.coalesce(_lookup(RATES_TO_INR, parts["currency"]), F.when(parts["currency"].isNull(), 1.0)), 2)


def percentage(c: Column, digits: int = 4) -> Column:
    """``45%``, ``45 percent`` and ``45 pct`` as a share."""
    shape = r"(?i)^\s*([+-]?\d+(?:\.\d+)?)\s*(?:%|percent|pct)\s*$"
    return F.when(c.rlike(shape), F.bround(F.regexp_extract(c, shape, 1).cast("double") / 100, digits))


def ratio(c: Column) -> Column:
    """``a:b`` of ``a : b`` and ``a/b``."""
    shape = r"^\s*(\d+(?:\.\d+)?)\s*[:/]\s*(\d+(?:\.\d+)?)\s*$"
    return F.when(c.rlike(shape), F.concat(F.regexp_extract(c, shape, 1), F.lit(":"), F.regexp_extract(c, shape, 2)))


def integer(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[,\s]", "")
    return F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), bare.cast("double").cast("long"))


def decimal(c: Column, digits: int = 2) -> Column:
    bare = F.regexp_replace(c, r"[,\s]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.bround(bare.cast("double"), digits))


def roman(c: Column) -> Column:
    """Value of a roman numeral: each sign counts, less twice what stands before a greater one."""
    up = F.upper(F.trim(c))
    value = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
    signs = F.transform(F.split(up, ""), lambda s: F.coalesce(_lookup(value, s), F.lit(0)))
    fold = F.aggregate(
        signs,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), F.when(v == 0, a["last"]).otherwise(v).alias("last")),
    )["sum"]
    return F.when(up.rlike(r"^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), fold)


def numeral(c: Column) -> Column:
    """Hexadecimal, binary, octal, scientific, worded and roman numbers as a long."""
    t = F.lower(F.trim(c))
    word = r"^(one|two|three|four|five|six|seven|eight|nine|ten|\d+(?:\.\d+)?)\s+(thousand|lakh|million|crore|billion)$"
    head = F.regexp_extract(t, word, 1)
    worded = F.coalesce(_lookup(WORDS, head).cast("double"), F.when(head.rlike(r"^\d"), head.cast("double"))) * _lookup(MULTIPLIERS, F.regexp_extract(t, word, 2))
    out = (
        F.when(t.rlike(r"^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 10).cast("long"))
        .when(t.rlike(r"^0b[01]+$"), F.conv(F.substring(t, 3, 64), 2, 10).cast("long"))
        .when(t.rlike(r"^0o[0-7]+$"), F.conv(F.substring(t, 3, 64), 8, 10).cast("long"))
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?e[+-]?\d+$"), t.cast("double").cast("long"))
        .when(t.rlike(word), worded.cast("long"))
    )
    return F.coalesce(out, roman(c).cast("long"))


def suffixed(c: Column) -> Column:
    """``10+``, ``1.5k+``, ``5K``, ``2.5M`` and ``3b`` as numbers."""
    shape = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([kmb]?)\+?\s*$"
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).cast("double") * F.coalesce(_lookup(MULTIPLIERS, F.nullif(F.lower(F.regexp_extract(c, shape, 2)), F.lit(""))), F.lit(1.0)))


def value_range(c: Column) -> Column:
    """value_min and value_max of ``a - b``, ``a to b`` and ``a-b``, with suffixes."""
    shape = r"(?i)^\s*(\d+(?:\.\d+)?[kmb]?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?[kmb]?)\s*$"
    a, b = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    unit = F.regexp_extract(b, r"(?i)([kmb])$", 1)  # a suffix behind the second number holds for both
    a = F.when(a.rlike(r"\d$"), F.concat(a, unit)).otherwise(a)
    return F.when(c.rlike(shape), F.struct(suffixed(a).alias("value_min"), suffixed(b).alias("value_max")))


def year_range(c: Column) -> Column:
    """Start and end of ``2024-25`` and ``1999-00``: two digits take the century, or the next where they would fall."""
    shape = r"^\s*(\d{4})\s*[-–/]\s*(\d{2}|\d{4})\s*$"
    start, end = F.regexp_extract(c, shape, 1).cast("int"), F.regexp_extract(c, shape, 2)
    short = (F.floor(start / 100) * 100 + end.cast("int")).cast("int")
    full = F.when(F.length(end) == 4, end.cast("int")).when(short < start, short + 100).otherwise(short)
    return F.when(c.rlike(shape), F.struct(start.alias("start_year"), full.alias("end_year")))


def signature(c: Column) -> Column:
    """Format of a value: lower case, numbers as <N>."""
    return F.regexp_replace(F.lower(c), r"\d+(\.\d+)?", "<N>")


def id_like(c: Column) -> Column:
    """Letters and digits together, without blanks: CUST-001, 22HP1A1201."""
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9#_./-]*$") & c.rlike("[A-Za-z]") & c.rlike(r"\d")

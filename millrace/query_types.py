"""Registered queries of the string types: values are built from a table's own numbers and dates in many forms.

The SQL never sees the strings: it computes what each form stands for from the
columns that the string was built from, so both sides are independent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers, places, temporal
from millrace.functions.units import MEASURES, converted, unit_of
from millrace.operators import ranges, rows
from millrace.queries import query, read

#: The columns that forms are built from: k (key), n (key mod 1000), p (price), d (date), h and m (an hour and a minute).
_SPARK = "o_orderkey AS k, cast(o_orderkey % 1000 AS int) AS n, o_totalprice AS p, o_orderdate AS d, cast(o_orderkey % 24 AS int) AS h, cast(o_orderkey % 60 AS int) AS m"
_DUCK = "SELECT o_orderkey AS k, (o_orderkey % 1000)::INT AS n, o_totalprice AS p, o_orderdate AS d, (o_orderkey % 24)::INT AS h, (o_orderkey % 60)::INT AS m FROM orders"
#: Forms that every type must answer with null.
_NONE = (("'~'", "NULL"), ("''", "NULL"), ("'   '", "NULL"), ("cast(NULL AS string)", "NULL"))


def forms_query(name: str, kind: str, forms: list[tuple[str, str]], f, none: bool = True) -> None:
    """Row k has form k mod the number of forms: (Spark's expression of the string, SQL's of the value it stands for)."""
    every = [*forms, *(_NONE if none else ())]
    strings = " ".join(f"WHEN {i} THEN {s}" for i, (s, _) in enumerate(every))
    values = " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(every))

    @query(f"SELECT k, CAST(CASE k % {len(every)} {values} END AS {kind}) AS v FROM ({_DUCK})", name)
    def run(spark, sf_dir):
        t = read(spark, sf_dir, "orders").selectExpr(*_split(_SPARK))
        return t.select("k", F.expr(f"CASE k % {len(every)} {strings} END").alias("s")).select("k", f(F.col("s")).alias("v"))


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.replace("AS k,", "AS k;").replace("AS n,", "AS n;").replace("AS p,", "AS p;").replace("AS d,", "AS d;").replace("AS h,", "AS h;").split(";")]


_CLOCK12 = "format_string('%d:%02d %s', CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END, m, CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END)"
_HM = "lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0')"
_DMY = "strftime(d, '%d-%m-%Y')"
_YEAR = "(1950 + n % 100)"

for _name, _kind, _forms, _f in (
    ("currency_norm", "DOUBLE", [
        ("concat('$', format_number(p, 2))", "round(p, 2)"), ("concat('€', translate(format_number(p, 2), ',.', '.,'))", "round(p, 2)"), ("concat('Rs ', n)", "n"), ("concat(n, ' USD')", "n"), ("concat('R$ ', n)", "n"),
        ("concat('(', n + 1, ')')", "-(n + 1)"), ("concat('USD ', n + 1, 'k')", "(n + 1) * 1000"), ("concat(n + 1, '.5 cr')", "(n + 1.5) * 1e7"), ("concat('Save $', n, '.25')", "n + 0.25"), ("concat('kr ', n)", "n"), ("concat('Rp', n)", "n"), ("concat('₨ ', n)", "n"), ("concat(n, ' days')", "NULL"),
    ], numbers.money_amount),
    ("currency_mixed", "VARCHAR", [
        ("concat('$', n)", "'USD'"), ("concat('€', n, ',50')", "'EUR'"), ("concat('R$ ', n)", "'BRL'"), ("concat(n, ' inr')", "'INR'"), ("concat('¥', n)", "'JPY'"), ("cast(n AS string)", "NULL"), ("concat('Rp', n)", "'IDR'"),
        ("concat('৳', n)", "'BDT'"), ("concat(n, ' ₹')", "'INR'"), ("concat('CHF ', n)", "'CHF'"), ("concat(n, ' kg')", "NULL"),
    ], numbers.currency_of),
    ("percentage_norm", "DOUBLE", [("concat(n, '%')", "round_even(n / 100.0::DOUBLE, 4)"), ("concat(n, '.5 percent')", "round_even((n + 0.5) / 100.0::DOUBLE, 4)"), ("concat('-', n + 1, ' pct')", "round_even(-(n + 1) / 100.0::DOUBLE, 4)"), ("cast(n AS string)", "NULL")], numbers.percentage),
    ("salary_uniform", "DOUBLE", [
        ("concat(n + 1, ' LPA')", "(n + 1) * 100000"), ("concat('$', n + 1, 'k/year')", "(n + 1) * 1000"), ("concat(n + 1, ' per hour')", "(n + 1) * 2080"), ("concat('annual ', n + 1, 'k')", "(n + 1) * 1000"),
        ("concat(n + 1, '-', n + 3, ' per month')", "(n + 2) * 12"), ("concat('€', n + 1, ' weekly')", "(n + 1) * 52"), ("concat(n + 1, ' per mile')", "NULL"),
    ], numbers.yearly_pay),
    ("numsys_norm", "BIGINT", [
        ("concat('0x', hex(n))", "n"), ("concat('0b', bin(n))", "n"), ("concat('0o', conv(n, 10, 8))", "n"), ("concat(n, 'e3')", "n * 1000"), ("concat(n + 1, ' lakh')", "(n + 1) * 100000"), ("'two million'", "2000000"),
        ("element_at(array('I', 'IV', 'IX', 'XIV', 'XL', 'XC', 'CD', 'MCMXC'), cast(k % 8 AS int) + 1)", "[1, 4, 9, 14, 40, 90, 400, 1990][k % 8 + 1]"), ("'IIII'", "NULL"),
    ], numbers.numeral),
    ("ratio_norm", "VARCHAR", [("concat(n, ':', n + 1)", "n || ':' || (n + 1)"), ("concat(n, ' / ', n + 2)", "n || ':' || (n + 2)"), ("concat(n, ':')", "NULL")], numbers.ratio),
    ("integer_norm", "BIGINT", [("format_number(k * 1000, 0)", "k * 1000"), ("concat(n + 1, ' 000')", "(n + 1) * 1000"), ("concat('-', n + 1, '.9')", "-(n + 1)"), ("concat(n, 'x')", "NULL")], numbers.integer),
    ("float_norm", "DOUBLE", [("concat(n, '.567')", "round_even(n + 0.567, 2)"), ("concat('.', n % 9 + 1)", "(n % 9 + 1) / 10.0::DOUBLE"), ("format_number(p, 2)", "round(p, 2)"), ("concat(n, '..5')", "NULL")], numbers.decimal),
    ("numeric_suffix", "DOUBLE", [("concat(n, '+')", "n"), ("concat(n, '.5k+')", "(n + 0.5) * 1000"), ("concat(n, 'K')", "n * 1000"), ("concat(n, 'M')", "n * 1e6"), ("concat(n, 'b+')", "n * 1e9"), ("'k'", "NULL")], numbers.suffixed),
    ("date_norm", "VARCHAR", [
        ("date_format(d, 'dd-MM-yyyy')", _DMY), ("date_format(d, 'd/M/yyyy')", _DMY), ("date_format(d, 'yyyy-MM-dd')", _DMY), ("date_format(d, 'MMMM d, yyyy')", _DMY), ("concat(day(d), 'th ', lower(date_format(d, 'MMM yyyy')))", _DMY),
        ("date_format(d, 'yyyyMMdd')", _DMY), ("concat(' ', date_format(d, 'dd.MM.yyyy'), ' ')", _DMY), ("date_format(d, 'd-MMM-yyyy')", _DMY), ("date_format(d, 'yyyy/M/d')", _DMY), ("date_format(d, 'MMM yyyy')", "strftime(date_trunc('month', d), '%d-%m-%Y')"),
        ("'31-02-2020'", "NULL"), ("concat(n, '-', n)", "NULL"),
    ], temporal.date_text),
    ("time_norm", "VARCHAR", [("format_string('%d:%02d', h, m)", _HM), (_CLOCK12, _HM), ("format_string('%02d:%02d:%02d', h, m, m)", _HM), ("'noon'", "'12:00'"), ("' Midnight'", "'00:00'"), ("concat(h % 12 + 1, ' p.m.')", "lpad((CASE WHEN h % 12 = 11 THEN 12 ELSE h % 12 + 13 END)::VARCHAR, 2, '0') || ':00'"), ("concat(h + 24, ':00')", "NULL"), ("concat(h, ':', m + 60)", "NULL")], temporal.time_of),
    ("datetime_norm", "VARCHAR", [
        (f"concat(date_format(d, 'dd/MM/yyyy'), ' ', {_CLOCK12})", f"{_DMY} || ' ' || {_HM} || ':00'"), (f"concat(date_format(d, 'd MMM yyyy'), ' ', {_CLOCK12})", f"{_DMY} || ' ' || {_HM} || ':00'"),
        ("concat(date_format(d, 'yyyy-MM-dd'), 'T', format_string('%02d:%02d:%02d', h, m, m))", f"{_DMY} || ' ' || {_HM} || ':' || lpad(m::VARCHAR, 2, '0')"), ("date_format(d, 'yyyy-MM-dd')", f"{_DMY} || ' 00:00:00'"), ("'31 feb 2026 4:16 PM'", "NULL"), ("concat('15 aug 2026 ', h + 24, ':00')", "NULL"),
    ], temporal.datetime_text),
    ("timestamp_valid", "VARCHAR", [("cast(1600000000 + k AS string)", "(1600000000 + k)::VARCHAR"), ("cast(1600000000000 + k AS string)", "(1600000000000 + k)::VARCHAR"), ("concat(date_format(d, 'yyyy-MM-dd'), 'T10:20:30Z')", "strftime(d, '%Y-%m-%d') || 'T10:20:30Z'"), ("'2024-13-31T10:20'", "NULL"), ("cast(n AS string)", "NULL")], temporal.valid_timestamp),
    ("duration_norm", "DOUBLE", [("concat(n, 'm')", "n * 60"), ("concat(h, 'h ', m, 'm')", "h * 3600 + m * 60"), ("concat(n, ' days')", "n * 86400"), ("format_string('%d:%02d:%02d', h, m, m)", "h * 3600 + m * 61"), ("concat('PT', h, 'H', m, 'M')", "h * 3600 + m * 60"), ("concat(n, ' weeks')", "n * 604800"), ("concat(n, ' parsecs')", "NULL")], temporal.duration_seconds),
    ("year_norm", "INTEGER", [(f"concat('Year ', {_YEAR})", _YEAR), (f"concat({_YEAR}, ' AD')", _YEAR), (f"concat('Y', {_YEAR})", _YEAR), ("concat('FY ', lpad(n % 100, 2, '0'))", "CASE WHEN n % 100 < 50 THEN 2000 ELSE 1900 END + n % 100"), (f"cast({_YEAR} AS string)", "NULL"), ("'Year 3000'", "NULL")], temporal.year_of),
    ("month_norm", "VARCHAR", [("date_format(d, 'MMMM')", "strftime(d, '%b')"), ("lower(date_format(d, 'MMM'))", "strftime(d, '%b')"), ("'Xyz'", "NULL")], temporal.month_name),
    ("day_norm", "VARCHAR", [("date_format(d, 'EEEE')", "dayname(d)"), ("lower(date_format(d, 'E'))", "dayname(d)"), ("'xyz'", "NULL")], temporal.day_name),
    ("week_norm", "VARCHAR", [("concat('W', m)", "CASE WHEN m BETWEEN 1 AND 53 THEN '2024-W' || lpad(m::VARCHAR, 2, '0') END"), ("concat('Week ', m)", "CASE WHEN m BETWEEN 1 AND 53 THEN '2024-W' || lpad(m::VARCHAR, 2, '0') END"), ("concat('2023-W', m)", "CASE WHEN m BETWEEN 1 AND 53 THEN '2023-W' || lpad(m::VARCHAR, 2, '0') END")], lambda c: temporal.week_label(c, 2024)),
    ("quarter_norm", "VARCHAR", [("concat('Q', h % 6)", "CASE WHEN h % 6 BETWEEN 1 AND 4 THEN '2024-Q' || h % 6 END"), ("concat('2023-Q', h % 6)", "CASE WHEN h % 6 BETWEEN 1 AND 4 THEN '2023-Q' || h % 6 END"), ("concat('Quarter ', h % 6)", "CASE WHEN h % 6 BETWEEN 1 AND 4 THEN '2024-Q' || h % 6 END")], lambda c: temporal.quarter_label(c, 2024)),
    ("fiscal_norm", "VARCHAR", [(f"concat('FY', {_YEAR})", f"'FY-' || {_YEAR}"), ("concat('FY ', lpad(n % 100, 2, '0'))", "'FY-' || (CASE WHEN n % 100 < 50 THEN 2000 ELSE 1900 END + n % 100)"), (f"concat('fy', {_YEAR}, '-', right(cast({_YEAR} + 1 AS string), 2))", f"'FY-' || {_YEAR}"), (f"cast({_YEAR} AS string)", "NULL")], temporal.fiscal_year),
    ("lat_norm", "DOUBLE", [("concat(h, '.25')", "h + 0.25"), ("concat(m, '.5 S')", "-(m + 0.5)"), ("concat(h, ' ', m, ' 30 N')", "round_even(h + m / 60.0::DOUBLE + 30 / 3600.0::DOUBLE, 6)"), ("cast(h + 91 AS string)", "NULL")], places.latitude),
    ("lon_norm", "DOUBLE", [("concat('-', h, '.25')", "-(h + 0.25)"), ("concat(m + 100, '.5 E')", "m + 100.5"), ("concat(h, ' ', m, ' 30 W')", "round_even(-(h + m / 60.0::DOUBLE + 30 / 3600.0::DOUBLE), 6)"), ("cast(h + 181 AS string)", "NULL")], places.longitude),
    ("gender_norm", "VARCHAR", [("'M'", "'male'"), ("' Woman'", "'female'"), ("'non-binary'", "'other'"), ("'TRANS'", "'transgender'"), ("cast(n AS string)", "NULL")], places.gender_of),
    ("boolean_norm", "BOOLEAN", [("'Yes'", "true"), ("'off'", "false"), ("' TRUE '", "true"), ("'0'", "false"), ("cast(n + 2 AS string)", "NULL")], places.boolean_of),
    ("email_lower", "VARCHAR", [("concat('A', n, '.B@Example.com')", "'a' || n || '.b@example.com'"), ("concat('a', n, '@b')", "NULL"), ("concat('a@', n, '.org')", "'a@' || n || '.org'")], places.email_of),
    ("network_norm", "VARCHAR", [
        ("concat('10.0.', h, '.', m)", "'10.0.' || h || '.' || m"), ("concat('256.1.', h, '.1')", "NULL"), ("concat('10.0.0.0/', h)", "'10.0.0.0/' || h"), ("concat('fe80::', hex(n))", "'fe80::' || upper(format('{:x}', n))"), ("concat('2001:db8::', h, ':', m)", "'2001:db8::' || h || ':' || m"),
        ("format_string('00:1A:2B:3C:4D:%02d', m)", "'00:1A:2B:3C:4D:' || lpad(m::VARCHAR, 2, '0')"), ("format_string('001A.2B3C.4D%02d', m)", "'001A.2B3C.4D' || lpad(m::VARCHAR, 2, '0')"), ("concat('1.2.', n)", "NULL"),
    ], places.network_address),
    ("path_norm", "VARCHAR", [("concat('/usr/local/', n)", "'/usr/local/' || n"), ("concat('C:/x/', n)", "'C:/x/' || n"), ("concat('./', n, '.txt')", "'./' || n || '.txt'"), ("concat('../', n)", "'../' || n"), ("concat('%TEMP%/', n)", "'%TEMP%/' || n"), ("concat('hello ', n)", "NULL")], lambda c: places.kept_if("path", c)),
    ("url_norm", "VARCHAR", [("concat('https://a.org/', n)", "'https://a.org/' || n"), ("concat('www.a', n, '.com')", "'www.a' || n || '.com'"), ("concat('a', n, '.example.com/x')", "'a' || n || '.example.com/x'"), ("concat('localhost:', n)", "'localhost:' || n"), ("concat('a ', n, '.com')", "NULL")], lambda c: places.kept_if("url", c)),
    ("file_norm", "VARCHAR", [("concat('data', n, '.csv')", "'data' || n || '.csv'"), ("concat('a/', n, '.csv')", "NULL"), ("concat(n, '.zzz')", "NULL")], lambda c: places.kept_if("file", c)),
    ("version_norm", "VARCHAR", [("concat('1.2.', n)", "'1.2.' || n"), ("concat('v2.', n, '-rc1')", "'v2.' || n || '-rc1'"), ("concat('v', n)", "NULL")], lambda c: places.kept_if("version", c)),
    ("timezone_norm", "VARCHAR", [("concat('UTC+', lpad(h % 13, 2, '0'), ':30')", "'UTC+' || lpad((h % 13)::VARCHAR, 2, '0') || ':30'"), ("'Europe/Paris'", "'Europe/Paris'"), ("'utc'", "NULL")], lambda c: places.kept_if("timezone", c)),
    ("clean_value", "VARCHAR", [("concat('a–', n, '  b')", "'a-' || n || ' b'"), ("concat(' x\t', n, ' ')", "'x ' || n"), ("concat('é', n)", "n::VARCHAR")], rows.clean_text),
):
    forms_query(_name, _kind, _forms, _f, _name != "clean_value")

forms_query("format_signature", "VARCHAR", [("concat(n, '-', n + 1, '% Off')", "'<N>-<N>% off'"), ("concat(n, '.5 or above')", "'<N> or above'"), ("'none'", "'none'")], numbers.signature, False)


# Forms with several values: every part of a struct is a column

_PARTS = {
    "geo_split": (places.geo_pair, {"latitude": "DOUBLE", "longitude": "DOUBLE"}, [("concat(h, '.5, -', m, '.25')", "h + 0.5", "-(m + 0.25)"), ("concat('(', h, '; ', m, ')')", "h", "m"), ("concat(h + 91, ',', m)", "NULL", "NULL"), ("concat(h, '.5')", "NULL", "NULL")]),
    "year_range_norm": (numbers.year_range, {"start_year": "INTEGER", "end_year": "INTEGER"}, [(f"concat({_YEAR}, '-', right(cast({_YEAR} + 1 AS string), 2))", _YEAR, f"{_YEAR} + 1"), (f"concat({_YEAR}, '/', {_YEAR} + 7)", _YEAR, f"{_YEAR} + 7"), ("concat(n, '-', n)", "NULL", "NULL")]),
    "range_split": (numbers.value_range, {"value_min": "DOUBLE", "value_max": "DOUBLE"}, [("concat(n, '-', n + 5, 'k')", "n * 1000", "(n + 5) * 1000"), ("concat(n, ' to ', n + 1)", "n", "n + 1"), ("concat(n, '.5k - ', n + 1, 'k')", "(n + 0.5) * 1000", "(n + 1) * 1000"), ("cast(n AS string)", "NULL", "NULL")]),
    "range_affixes": (ranges.range_affixes, {"low": "VARCHAR", "high": "VARCHAR", "text": "VARCHAR"}, [
        ("concat(n, '-', n + 5, 'k')", "n || 'k'", "(n + 5) || 'k'", "NULL"), ("concat('$', n, '-', n + 3)", "'$' || n", "'$' || (n + 3)", "NULL"), ("concat(n, '-', n + 6, ' rs')", "n || ' rs'", "(n + 6) || ' rs'", "NULL"), ("concat(n, ' to ', n + 1, ' persons')", "n::VARCHAR", "(n + 1)::VARCHAR", "'persons'"), ("'none'", "NULL", "NULL", "NULL"),
    ]),
    "components": (ranges.components, {"start_year": "INTEGER", "end_year": "INTEGER", "value_min": "DOUBLE", "value_max": "DOUBLE", "value": "DOUBLE", "text": "VARCHAR"}, [
        (f"concat({_YEAR}, '-', right(cast({_YEAR} + 1 AS string), 2))", _YEAR, f"{_YEAR} + 1", "NULL", "NULL", "NULL", "NULL"), ("concat(n, ' to ', n + 1, 'k')", "NULL", "NULL", "n * 1000", "(n + 1) * 1000", "NULL", "NULL"), ("concat(n, '.5k+')", "NULL", "NULL", "NULL", "NULL", "(n + 0.5) * 1000", "NULL"),
        ("concat(n, ' or above')", "NULL", "NULL", "NULL", "NULL", "n", "'or above'"), ("concat('about ', n)", "NULL", "NULL", "NULL", "NULL", "n", "'about'"), ("'none'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"),
    ]),
    "pay_parts": (numbers.pay_parts, {"amount": "DOUBLE", "currency": "VARCHAR", "per_year": "DOUBLE"}, [("concat('$', n + 1, ' per hour')", "n + 1", "'USD'", "2080"), ("concat('EUR ', n + 1, '-', n + 3, 'k/year')", "(n + 2) * 1000", "'EUR'", "1"), ("concat(n + 1, ' LPA')", "(n + 1) * 100000", "'INR'", "1"), ("concat(n + 1, ' monthly')", "n + 1", "NULL", "12"), ("cast(n AS string)", "NULL", "NULL", "NULL")]),
}


def _parts_query(name: str, f, parts: dict[str, str], forms: list[tuple]) -> None:
    every = [*forms, *[(s, *["NULL"] * len(parts)) for s, _ in _NONE]]
    strings = " ".join(f"WHEN {i} THEN {form[0]}" for i, form in enumerate(every))
    values = ", ".join(f"CAST(CASE k % {len(every)} " + " ".join(f"WHEN {i} THEN {form[j + 1]}" for i, form in enumerate(every)) + f" END AS {t}) AS {p}" for j, (p, t) in enumerate(parts.items()))

    @query(f"SELECT k, {values} FROM ({_DUCK})", name)
    def run(spark, sf_dir):
        t = read(spark, sf_dir, "orders").selectExpr(*_split(_SPARK)).select("k", F.expr(f"CASE k % {len(every)} {strings} END").alias("s"))
        return t.select("k", f(F.col("s")).alias("r")).select("k", *[F.col(f"r.{p}").alias(p) for p in parts])


for _name, (_f, _parts, _forms) in _PARTS.items():
    _parts_query(_name, _f, _parts, _forms)


# Units: line numbers pick a unit; the SQL has the factors of the definitions as literals

_UNITS = {
    "distance": ("km", 1, {"km": "q", "m": "q / 1000", "mi": "q * 1.609344", "ft": "q * 0.0003048", "nmi": "q * 1.852"}),
    "weight": ("kg", 2, {"kg": "q", "lb": "q * 0.45359237", "oz": "q * 0.028349523125", "g": "q / 1000"}),
    "volume": ("l", 2, {"l": "q", "ml": "q / 1000", "gal": "q * 3.785411784", "m3": "q * 1000"}),
    "area": ("m2", 2, {"m2": "q", "ft2": "q * 0.09290304", "acre": "q * 4046.8564224", "ha": "q * 10000"}),
    "speed": ("km/h", 1, {"km/h": "q", "m/s": "q * 3.6", "mph": "q * 1.609344", "knot": "q * 1.852"}),
    "temperature": ("C", 1, {"C": "q", "F": "(q - 32) * (5 / 9::DOUBLE)", "K": "q - 273.15"}),
    "pressure": ("kPa", 2, {"kPa": "q", "bar": "q * 100", "psi": "q * 6.894757293168", "atm": "q * 101.325"}),
    "energy": ("kJ", 2, {"kJ": "q", "kcal": "q * 4.184", "Wh": "q * 3.6", "J": "q / 1000"}),
    "power": ("kW", 2, {"kW": "q", "W": "q / 1000", "hp": "q * 0.745699871582", "MW": "q * 1000"}),
    "capacity": ("GB", 2, {"GB": "q", "TB": "q * 1024", "MB": "q / 1000"}),
    "density": ("kg/m3", 2, {"kg/m3": "q", "g/cm3": "q * 1000", "lb/ft3": "q * 16.018463374"}),
    "angle": ("deg", 2, {"deg": "q", "rad": "q * 57.29577951308232", "grad": "q * 0.9"}),
}


def _unit_query(kind: str, target: str, digits: int, values: dict[str, str]) -> None:
    units = list(values)
    n = len(units) + 2  # a value without a unit, and none at all
    cases = " ".join(f"WHEN {i} THEN round_even({e}, {digits})" for i, e in enumerate(values.values()))
    names = " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(units))
    row = "SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber)::BIGINT AS r, l_quantity + 0.34 AS q FROM lineitem"

    @query(f"SELECT l_orderkey, l_linenumber, CASE r % {n} {names} END AS unit, CASE r % {n} {cases} END::DOUBLE AS v FROM ({row})", f"{kind}_norm")
    def run(spark, sf_dir):
        r = (F.col("l_orderkey") + F.col("l_linenumber")) % n
        q = (F.col("l_quantity") + 0.34).cast("string")
        text = F.when(r < len(units), F.concat(q, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), (F.least(r, F.lit(len(units) - 1)) + 1).cast("int")))).when(r == len(units), q)
        t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("s"))
        m = MEASURES[kind]
        return t.select("l_orderkey", "l_linenumber", unit_of(F.col("s"), m).alias("unit"), converted(F.col("s"), m, target).alias("v"))


for _kind, (_target, _digits, _values) in _UNITS.items():
    _unit_query(_kind, _target, _digits, _values)

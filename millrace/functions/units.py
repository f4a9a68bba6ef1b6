"""Measurements with units: recognition, and conversion of a column to its dominant unit."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"([+-]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+))"


@dataclass(frozen=True)
class Measure:
    """Units of one quantity: spellings (lower case) and factors to the base unit; ``offsets`` are added before the factor."""

    name: str
    spellings: dict[str, str]
    factors: dict[str, float]
    digits: int = 2
    offsets: dict[str, float] | None = None
    #: Units that only convert among themselves, by the name of their family.
    families: dict[str, str] | None = None

    def pattern(self) -> str:
        words = "|".join(_escaped(s) for s in sorted(self.spellings, key=lambda s: (-len(s), s)))
        return rf"(?i)^\s*{NUMBER}\s*({words})\s*$"

    def shape_pattern(self) -> str:
        """The pattern for values whose digits are all 0."""
        words = "|".join(_escaped(re.sub(r"\d", "0", s)) for s in sorted(self.spellings, key=lambda s: (-len(s), s)))
        return rf"(?i)^\s*{NUMBER}\s*({words})\s*$"


def _escaped(s: str) -> str:
    return "".join("\\" + c if c in "^$.|?*+()[]{}/" else c for c in s)


def _units(table: str) -> dict[str, str]:
    """Spellings by unit, one unit a line: ``unit: spelling, spelling``; the unit's own lower case is one."""
    found = {}
    for line in table.strip().splitlines():
        unit, _, words = line.strip().partition(":")
        for w in [unit.lower(), *filter(None, (x.strip() for x in words.split(",")))]:
            found[w] = unit
    return found


# Units, spellings and factors to the base unit of each quantity.
MEASURES = {
    m.name: m
    for m in (
        Measure(
            "distance",
            _units("""km: kms, kilometer, kilometers, kilometre, kilometres
            m: meter, meters, metre, metres
            dm: decimeter, decimeters
            cm: centimeter, centimeters, centimetre, centimetres
            mm: millimeter, millimeters
            um: micrometer, micrometers, micron, microns
            mi: mile, miles
            yd: yard, yards
            ft: foot, feet
            in: inch, inches
            nmi: nautical mile, nautical miles"""),
            {"km": 1000.0, "m": 1.0, "dm": 0.1, "cm": 0.01, "mm": 0.001, "um": 1e-6, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "nmi": 1852.0},
            1,
        ),
        Measure(
            "weight",
            _units("""kg: kgs, kilogram, kilograms
            g: gram, grams, gm
            mg: milligram, milligrams
            ug: microgram, micrograms
            ton: tons, tonne, tonnes
            lb: lbs, pound, pounds
            oz: ounce, ounces
            st: stone, stones"""),
            {"kg": 1.0, "g": 0.001, "mg": 1e-6, "ug": 1e-9, "ton": 1000.0, "lb": 0.45359237, "oz": 0.028349523125, "st": 6.35029318},
        ),
        Measure(
            "volume",
            _units("""l: liter, liters, litre, litres
            ml: milliliter, milliliters
            cl: centiliter
            dl: deciliter
            m3: cubic meter, cubic meters
            cm3: cc, cubic centimeter
            gal: gallon, gallons
            qt: quart, quarts
            pt: pint, pints
            fl oz: fluid ounce, fluid ounces
            cup: cups
            ft3: cubic foot, cubic feet
            tbsp: tablespoon, tablespoons
            tsp: teaspoon, teaspoons"""),
            {"l": 1.0, "ml": 0.001, "cl": 0.01, "dl": 0.1, "m3": 1000.0, "cm3": 0.001, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "fl oz": 0.0295735295625, "cup": 0.2365882365, "ft3": 28.316846592, "tbsp": 0.01478676478125, "tsp": 0.00492892159375},
        ),
        Measure(
            "area",
            _units("""km2: sq km, square kilometer, square kilometers
            m2: sq m, sqm, square meter, square meters
            cm2: sq cm
            mm2: sq mm
            ha: hectare, hectares
            mi2: sq mi, square mile, square miles
            acre: acres
            ft2: sq ft, sqft, square foot, square feet
            in2: sq in
            yd2: sq yd"""),
            {"km2": 1e6, "m2": 1.0, "cm2": 1e-4, "mm2": 1e-6, "ha": 1e4, "mi2": 2589988.110336, "acre": 4046.8564224, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736},
        ),
        Measure(
            "speed",
            _units("""km/h: kmh, kph, kmph
            m/s: mps
            cm/s:
            mph: mi/h
            ft/s: fps
            in/s:
            knot: knots, kn, kt
            mach:"""),
            {"km/h": 1.0, "m/s": 3.6, "cm/s": 0.036, "mph": 1.609344, "ft/s": 1.09728, "in/s": 0.09144, "knot": 1.852, "mach": 1234.8},
            1,
        ),
        Measure(
            "temperature",
            _units("""C: celsius, °c, degrees c
            F: fahrenheit, °f, degrees f
            K: kelvin
            R: rankine, °r"""),
            {"C": 1.0, "F": 5 / 9, "K": 1.0, "R": 5 / 9},
            1,
            {"C": 0.0, "F": -32.0, "K": -273.15, "R": -491.67},
        ),
        Measure(
            "pressure",
            _units("""Pa: pascal, pascals
            kPa: kilopascal
            MPa: megapascal
            bar: bars
            psi:
            atm: atmosphere, atmospheres
            mmHg: torr"""),
            {"Pa": 1.0, "kPa": 1000.0, "MPa": 1e6, "bar": 1e5, "psi": 6894.757293168, "atm": 101325.0, "mmHg": 133.322387415},
        ),
        Measure(
            "energy",
            _units("""J: joule, joules
            kJ: kilojoule, kilojoules
            MJ: megajoule
            cal: calorie, calories
            kcal: kilocalorie, kilocalories
            Wh: watt hour
            kWh: kilowatt hour
            eV: electronvolt"""),
            {"J": 1.0, "kJ": 1000.0, "MJ": 1e6, "cal": 4.184, "kcal": 4184.0, "Wh": 3600.0, "kWh": 3.6e6, "eV": 1.602176634e-19},
        ),
        Measure(
            "power",
            _units("""W: watt, watts
            kW: kilowatt, kilowatts
            MW: megawatt, megawatts
            GW: gigawatt
            hp: horsepower"""),
            {"W": 1.0, "kW": 1000.0, "MW": 1e6, "GW": 1e9, "hp": 745.699871582},
        ),
        Measure(
            "capacity",
            _units("TB: terabyte, terabytes\nGB: gigabyte, gigabytes\nMB: megabyte, megabytes\nKB: kilobyte, kilobytes")
            | {f"{u.lower()} {word}": u for u in ("TB", "GB", "MB", "KB") for word in ("ram", "rom", "storage", "disk", "memory", "ssd", "hdd")}
            | _units("""L: liter, liters, litre, litres
            kl: kiloliter, kiloliters, kilolitre, kilolitres
            ml: milliliter, milliliters, millilitre, millilitres
            gal: gallon, gallons
            qt: quart, quarts
            pt: pint, pints
            cup: cups"""),
            {"TB": 1024.0, "GB": 1.0, "MB": 0.001, "KB": 1e-6, "L": 1.0, "kl": 1000.0, "ml": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588},
            families=dict.fromkeys(("TB", "GB", "MB", "KB"), "storage") | dict.fromkeys(("L", "kl", "ml", "gal", "qt", "pt", "cup"), "liquid"),
        ),
        Measure("density", _units("kg/m3:\ng/cm3: g/cc\ng/ml:\nlb/ft3:"), {"kg/m3": 1.0, "g/cm3": 1000.0, "g/ml": 1000.0, "lb/ft3": 16.018463374}),
        Measure("angle", _units("deg: degree, degrees, °\nrad: radian, radians\ngrad: gradian, gradians"), {"deg": 1.0, "rad": 57.29577951308232, "grad": 0.9}),
    )
}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def unit_of(value: Column, measure: Measure) -> Column:
    """Canonical unit of a value such as ``12.5 km``; null if it is none."""
    return _lookup(measure.spellings, F.nullif(F.lower(F.regexp_extract(value, measure.pattern(), 2)), F.lit("")))


def amount_of(value: Column, measure: Measure) -> Column:
    number = F.nullif(F.regexp_extract(value, measure.pattern(), 1), F.lit(""))
    return F.replace(number, F.lit(","), F.lit("")).cast("double")


def converted(value: Column, measure: Measure, target: Column | str) -> Column:
    """The value in ``target`` unit, rounded half-even to the measure's digits; null if it is no measurement."""
    unit, amount = unit_of(value, measure), amount_of(value, measure)
    if isinstance(target, str):  # the unit's factor, and then one product: the unit is looked up once
        by, behind = measure.factors[target], (measure.offsets or {}).get(target, 0.0)
        if measure.offsets:
            steps = {u: F.struct(F.lit(o).alias("before"), F.lit(measure.factors[u]).alias("by")) for u, o in measure.offsets.items()}
            step = F.create_map(*[x for u, v in steps.items() for x in (F.lit(u), v)])[unit]
            out = F.when(unit == target, amount).otherwise((amount + step["before"]) * step["by"] / by - behind)
        else:
            out = F.when(unit == target, amount).otherwise(amount * _lookup(measure.factors, unit) / by)
        if measure.families:
            out = F.when(_lookup(measure.families, unit) == measure.families[target], out)
        return F.bround(out, measure.digits)
    if measure.offsets:
        base = (amount + _lookup(measure.offsets, unit)) * _lookup(measure.factors, unit)
        out = base / _lookup(measure.factors, target) - _lookup(measure.offsets, target)
    else:
        out = amount * _lookup(measure.factors, unit) / _lookup(measure.factors, target)
    return F.when(unit == target, F.bround(amount, measure.digits)).otherwise(F.bround(out, measure.digits))


def match_share(value: Column, measure: Measure) -> Column:
    """Aggregate: share of non-null values that are measurements of this kind."""
    return F.avg(F.when(value.isNotNull(), value.rlike(measure.pattern()).cast("int")))


def dominant_unit(df: DataFrame, column: str, measure: Measure, order: str | None = None) -> str | None:
    """The most frequent unit of a column; ties go to the unit seen first by ``order``, else by name."""
    first = F.min(order) if order else F.min("unit")
    votes = df.select(unit_of(F.col(column), measure).alias("unit"), *([order] if order else [])).where("unit is not null")
    row = votes.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").first()
    return row["unit"] if row else None


def normalised(df: DataFrame, column: str, measure: Measure, order: str | None = None) -> tuple[DataFrame, str | None]:
    """The table with the column converted to its dominant unit and named after it, and that unit."""
    unit = dominant_unit(df, column, measure, order)
    if unit is None:
        return df, None
    return df.withColumn(column, converted(F.col(column), measure, unit)).withColumnRenamed(column, f"{column}_({unit})"), unit

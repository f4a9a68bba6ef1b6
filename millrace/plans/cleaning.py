"""Two-phase cleaning: decide from small aggregates, then apply as one lazy select."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numbers, places, temporal
from millrace.functions.units import MEASURES, converted, dominant_unit
from millrace.operators import detect, mixed, rows


@dataclass(frozen=True)
class ColumnPlan:
    """How one column is normalised: its type, the unit or code if it has one, and its name afterwards."""

    source: str
    kind: str
    unit: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class CleaningPlan:
    """Columns to normalise and columns to drop; a document that can be stored and applied again."""

    columns: tuple[ColumnPlan, ...] = field(default_factory=tuple)
    dropped: tuple[str, ...] = field(default_factory=tuple)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> CleaningPlan:
        raw = json.loads(text)
        return CleaningPlan(tuple(ColumnPlan(**c) for c in raw["columns"]), tuple(raw["dropped"]))


SIMPLE = {
    "date": temporal.date_of, "time": temporal.time_of, "datetime": temporal.datetime_of, "timestamp": temporal.valid_timestamp, "year": temporal.year_of, "month": temporal.month_name, "day": temporal.day_name,
    "fiscal_year": temporal.fiscal_year, "duration": temporal.duration_seconds, "currency": numbers.money_amount, "salary": numbers.yearly_pay, "number_systems": numbers.numeral,
    "percentage": numbers.percentage, "ratio": numbers.ratio, "integer": numbers.integer, "float": numbers.decimal, "latitude": places.latitude, "longitude": places.longitude,
    "gender": places.gender_of, "email": places.email_of, "boolean": places.boolean_of, "network_addresses": places.network_address,
    "timezone": lambda c: places.kept_if("timezone", c), "url": lambda c: places.kept_if("url", c), "file_path": lambda c: places.kept_if("path", c), "files": lambda c: places.kept_if("file", c), "version": lambda c: places.kept_if("version", c),
}
#: Prefix of the kind of columns that hold plain numbers beside numbers with a unit.
NUMBERS_AND = "numbers and "
#: Kinds whose forms may lack a year; the plan names the one that stands in.
WITH_YEAR = {"week": temporal.week_label, "quarter": temporal.quarter_label}


def decide(df: DataFrame, sample: int | None = detect.SAMPLE, sparse: float = 0.7, year: int = 2000) -> CleaningPlan:
    """Passes for the types and the nulls, and one small vote for each column with units.

    ``year`` stands in for weeks and quarters without one.  A column of which at
    least half are plain numbers, and whose other strings are numbers with a
    unit, becomes numbers in that unit.
    """
    dropped = tuple(c for c, s in rows.null_shares(df).items() if s >= sparse)
    evidence = {r["column_name"]: r for r in detect.evidence(df.drop(*dropped), sample=sample)}
    found = {c: detect.choose(c, row, row) for c, row in evidence.items()}
    plans = []
    for c in df.columns:
        if c in dropped:
            continue
        kind = found.get(c, ("text", 0.0))[0]
        with_units = detect.units_in_strings(df, c) if 0.5 <= evidence.get(c, {}).get("grouped_numbers", 0.0) < 1 else None
        if with_units:
            of, unit = with_units
            plans.append(ColumnPlan(c, f"{NUMBERS_AND}{of}", unit, f"{c}_percentage" if of == "percentage" else f"{c}_({unit})"))
        elif kind in MEASURES:
            unit = dominant_unit(df, c, MEASURES[kind])
            plans.append(ColumnPlan(c, kind, unit, f"{c}_({unit})"))
        elif kind == "currency":
            code = df.select(F.mode(numbers.currency_of(F.col(f"`{c}`")), True)).first()[0]
            plans.append(ColumnPlan(c, kind, code, f"{c}_({code})" if code else c))
        elif kind in WITH_YEAR:
            plans.append(ColumnPlan(c, kind, str(year)))
        elif kind == "geo_coordinate":
            plans += [ColumnPlan(c, kind, part, f"{c}_{part}") for part in ("latitude", "longitude")]
        else:
            plans.append(ColumnPlan(c, kind, None, f"{c}_percentage" if kind == "percentage" else c))
    return CleaningPlan(tuple(plans), dropped)


def _value(c: Column, p: ColumnPlan) -> Column:
    if p.kind.startswith(NUMBERS_AND):
        return mixed.amount(c, p.kind.removeprefix(NUMBERS_AND), p.unit)
    if p.kind in MEASURES and p.unit:
        return converted(c, MEASURES[p.kind], p.unit)
    if p.kind in WITH_YEAR and p.unit:
        return WITH_YEAR[p.kind](c, int(p.unit))
    if p.kind == "geo_coordinate" and p.unit:
        return places.geo_pair(c)[p.unit]
    return SIMPLE[p.kind](c) if p.kind in SIMPLE else c


def apply(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """The plan as one projection; it holds no action and no aggregate, so it also runs on streams."""
    return df.select(*[_value(rows.tokens_to_null(F.col(f"`{p.source}`").cast("string")), p).alias(p.target or p.source) for p in plan.columns])

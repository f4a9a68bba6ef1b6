"""Checks and coercion of what is given to a model: names, types, bounds, categories; and what reports hold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.places import boolean_of
from millrace.operators.rows import to_number
from millrace.operators.structure import structural_types


def project(df: DataFrame, features: list[str]) -> DataFrame:
    """The features in order; missing ones are an error that names them."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in features])


def same_columns(tables: dict[str, DataFrame]) -> bool:
    """Whether all tables have the same set of columns."""
    return len({frozenset(t.columns) for t in tables.values()}) <= 1


def missing_and_extra(given: list[str], wanted: list[str]) -> tuple[list[str], list[str]]:
    return [c for c in wanted if c not in given], [c for c in given if c not in wanted]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """The columns of one kind: number, string, boolean or date."""
    kinds = {"number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "string": ("string",), "boolean": ("boolean",), "date": ("date", "timestamp")}[kind]
    return df.select(*[F.col(f"`{c}`") for c, t in df.dtypes if t.startswith(kinds)])


def drop_identifiers(df: DataFrame) -> DataFrame:
    """Without the columns that are identifiers by their structure."""
    return df.drop(*[c for c, k in structural_types(df) if k == "identifier"])


def resolved_types(artefact: dict[str, str], profile: dict[str, str], structural: dict[str, str], columns: list[str]) -> dict[str, str]:
    """A type for each column: of the model's artefact, else of the profile, else by structure, else text."""
    return {c: artefact.get(c) or profile.get(c) or structural.get(c) or "text" for c in columns}


def coerced(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns as their kinds: numbers, whole numbers, booleans (1.0 and 0.0), dates and trimmed strings; what doesn't fit is null."""

    def value(c: str) -> Column:
        x, kind = F.col(f"`{c}`").cast("string"), kinds.get(c)
        if kind in ("numeric", "float"):
            return to_number(x)
        if kind == "integer":
            return to_number(x).cast("long")
        if kind == "boolean":
            return boolean_of(x).cast("double")
        if kind in ("date", "datetime"):
            return F.try_to_timestamp(x)
        return F.nullif(F.trim(x), F.lit("")) if kind else F.col(f"`{c}`")

    return df.select(*[value(c).alias(c) for c in df.columns])


def warnings(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows with ``warnings``: numbers beyond what training saw, and values that it never saw.

    ``stats`` has a row a feature (overview.training_stats), so its bounds are constants here.
    """
    found = []
    for r in stats.collect():  # a row a feature
        c = F.col(f"`{r['feature']}`")
        if r["feature"] not in df.columns:
            continue
        if r["kind"] == "numeric":
            x = c.cast("double")
            found += [F.when(x < r["min"], F.lit(f"{r['feature']} below {r['min']:g}")), F.when(x > r["max"], F.lit(f"{r['feature']} above {r['max']:g}"))]
        else:
            found.append(F.when(c.isNotNull() & ~c.cast("string").isin(*r["options"]), F.concat(F.lit(f"{r['feature']} unseen: "), c.cast("string"))))
    return df.withColumn("warnings", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def canonical(c: Column, known: list[str]) -> Column:
    """The training's spelling of a value: the same string, else the same but for case and blanks, else the same number; else as it is."""
    s = F.trim(c.cast("string"))
    exact, folded, numeric = ({} for _ in range(3))
    for k in known:
        exact[k] = k
        folded.setdefault(k.strip().lower(), k)
        if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", k.strip()):
            numeric.setdefault(float(k), k)

    def look(pairs: dict, key: Column) -> Column:
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key] if pairs else F.lit(None).cast("string")

    return F.coalesce(look(exact, c.cast("string")), look(folded, F.lower(s)), look(numeric, to_number(s)), c.cast("string"))


def options_of(name: str) -> list[str]:
    """Options in a column's name: ``smoker_(yes/no)`` gives yes and no."""
    m = re.search(r"_?\(([^()]+/[^()]+)\)\s*$", name)
    return [x.strip() for x in m.group(1).split("/") if x.strip()] if m else []


def enforced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the types that metadata name; strings that aren't numbers become null, others stay."""

    def value(c: str) -> Column:
        x, t = F.col(f"`{c}`"), types.get(c)
        if t in ("int", "bigint", "float", "double"):
            return to_number(x.cast("string")).cast(t)
        return x.cast(t) if t else x

    return df.select(*[value(c).alias(c) for c in df.columns])


def normalised_report(report: dict, names: dict[str, tuple[str, ...]]) -> dict:
    """Figures of a report under one name each: the first of its spellings that is there, zeros included."""
    flat = {**report, **(report.get("metrics") or {})}
    return {k: next((flat[n] for n in (k, *spellings) if flat.get(n) is not None), None) for k, spellings in names.items()}

"""Times of day filled by a model: a time is a point on a circle, whose sine and cosine are regressed on the other columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.temporal import seconds_of_day, time_text

DAY = 86_400
#: Terms of a model at most (their products are sums of one aggregate), and known times that a fit needs.
MOST_TERMS, LEAST_KNOWN = 30, 50


def _terms(model: dict) -> list[Column]:
    """One, standardised numbers (the mean where null), and indicators of categories but the first."""
    out = [F.lit(1.0)]
    for c, (mean, width) in model["numbers"].items():
        x = F.col(f"`{c}`").cast("double")
        out.append((F.when(F.isnan(x), None).otherwise(x) - mean) / width)
    out = [F.coalesce(t, F.lit(0.0)) for t in out]
    return out + [F.coalesce((F.col(f"`{c}`").cast("string") == level).cast("double"), F.lit(0.0)) for c, levels in model["levels"].items() for level in levels[1:]]


def _turn(angle: Column) -> Column:
    """The smaller way round between two angles, from their difference."""
    return F.abs(F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi)


def _angle(model: dict) -> Column:
    terms = _terms(model)
    said = lambda k: sum((t * w for t, w in zip(terms[1:], model[k][1:], strict=True)), F.lit(model[k][0]))
    return F.atan2(said("sin"), said("cos"))


def predicted_time(model: dict) -> Column:
    """HH:mm:ss that a fitted model tells for a row, to the second."""
    seconds = F.round(F.pmod(_angle(model), F.lit(2 * math.pi)) * (DAY / (2 * math.pi)))
    return time_text(F.pmod(seconds, F.lit(float(DAY))))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of these expressions, each evaluated once a row; Spark would evaluate them anew wherever they are used."""
    return df.select(F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("e")).select("e.*")


def fit_times(df: DataFrame, column: str, numbers: list[str], categories: dict[str, list[str]], otherwise: Column) -> dict | None:
    """A model of the column's times, as a document, or None where it is no nearer than ``otherwise`` (seconds of the day).

    One aggregate standardises, one sums the products of all terms, for four
    fifths of the known rows and for the rest; least squares are solved on those
    sums.  The model of the first part is held against ``otherwise`` by the mean
    way round the clock on the rest; the one that is given is fitted to all.
    """
    numbers = [c for c in numbers if c != column][: MOST_TERMS - 1]
    if not numbers and not categories:
        return None
    read = {c: F.col(f"`{c}`") for c in (*numbers, *categories) if c != column}
    read_at = _once(df, __at=F.col(f"`{column}`"), **read)
    known = _once(read_at, __seconds=seconds_of_day(F.col("__at")), **read).where("__seconds is not null")
    seconds = F.col("__seconds")
    x = [F.col(f"`{c}`").cast("double") for c in numbers]
    x = [F.when(~F.isnan(v), v) for v in x]
    facts = known.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(f"f{i}") for i, v in enumerate(x)]).first()
    if facts["n"] < LEAST_KNOWN:
        return None
    model: dict = {"numbers": {}, "levels": {}}
    for i, c in enumerate(numbers):
        if facts[f"f{i}"]["s"]:
            model["numbers"][c] = [facts[f"f{i}"]["m"], facts[f"f{i}"]["s"]]
    for c, levels in categories.items():
        if c != column and 1 + len(model["numbers"]) + sum(len(v) - 1 for v in model["levels"].values()) + len(levels) - 1 <= MOST_TERMS:
            model["levels"][c] = sorted(levels)
    angle = seconds * (2 * math.pi / DAY)
    k = len(_terms(model))
    if k < 2:
        return None
    own = [F.col(f"`{c}`").cast("string") for c in (*model["numbers"], *model["levels"])]
    held = (F.pmod(F.xxhash64(*own, seconds), F.lit(5)) == 0).alias("held")
    rows = _once(known, held=held, t=F.array(*_terms(model), F.sin(angle), F.cos(angle)))
    products = [F.sum(F.get("t", F.lit(i)) * F.get("t", F.lit(j))).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k + 2)]
    parts = {r["held"]: r for r in rows.groupBy("held").agg(*products).collect()}

    def solved(which: list[bool]) -> dict:
        total = lambda i, j: sum(parts[h][f"p{min(i, j)}_{max(i, j)}"] for h in which if h in parts)
        a = np.array([[total(i, j) for j in range(k)] for i in range(k)])
        return {name: np.linalg.lstsq(a, np.array([total(i, at) for i in range(k)]), rcond=None)[0].tolist() for name, at in (("sin", k), ("cos", k + 1))}

    if set(parts) != {True, False}:
        return None
    tried = model | solved([False])
    way = known.where(held).agg(F.avg(_turn(_angle(tried) - angle)).alias("model"), F.avg(_turn(otherwise * (2 * math.pi / DAY) - angle)).alias("plain")).first()
    return model | solved([True, False]) if way["model"] < way["plain"] else None

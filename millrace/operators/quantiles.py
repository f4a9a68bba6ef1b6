"""Exact quantiles without any task that holds a column's values.

Whole columns: radix selection.  A double becomes a 64-bit whole number of the
same order, and each pass counts, for all columns and quantiles together, how
many rows fall into each of up to 65,536 even parts of the intervals that still
hold a wanted rank, and the least and greatest number in each.  A pass leaves one
part per rank, cut down to what lies in it, so a part of one value is settled;
passes end as soon as few rows are left.  Batches are counted in numpy, next to
the rows; what is exchanged are counts of parts.

Groups: distinct values are counted by group, their ranks are running sums along
the order (see ordered.py), and the values at the wanted ranks are kept.

Both interpolate linearly, as percentile() and median() do.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ordered import with_running

QUARTILES = (0.25, 0.5, 0.75)
#: Parts that a pass cuts an interval into, and all intervals together, at most.
PARTS, ALL_PARTS = 1 << 16, 1 << 18
#: Rows left in all intervals together that are ranked at once, and rows counted at once.
FEW, CHUNK = 100_000, 1 << 16

_INFINITE, _LARGEST = 2047 << 52, 1 << 52


def sort_key(c: Column) -> Column:
    """A long of the same order as the double: its bits, negated below zero; both zeros are 0, NaN is the greatest."""
    x = c.cast("double")
    a = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("int")
    ratio = a / F.pow(F.lit(2.0), guess)  # exact; the logarithm may be one off at powers of two
    exponent = guess + F.when(ratio >= 2, 1).when((ratio < 1) & (guess > -1022), -1).otherwise(0)
    mantissa = a / F.pow(F.lit(2.0), exponent)
    normal = (exponent + 1022).cast("long") * _LARGEST + (mantissa * float(_LARGEST)).cast("long")
    bits = F.when(F.isnan(x), F.lit(_INFINITE + 1)).when(a == float("inf"), F.lit(_INFINITE)).when(a == 0, F.lit(0)).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def _value(key: int) -> float:
    """The double of a key."""
    if key == _INFINITE + 1:
        return math.nan
    return math.copysign(struct.unpack(">d", struct.pack(">q", abs(key)))[0], key)


def _interpolated(low: float, high: float, position: float) -> float:
    below, above = math.floor(position), math.ceil(position)
    return low if below == above or low == high else (above - position) * low + (position - below) * high


@dataclass
class _Interval:
    """Keys of a column from ``low`` to ``high``, of one sign: the rows there and before it in the column, and the ranks in the column (from 0) that are wanted there."""

    column: int
    low: int
    high: int
    rows: int = 0
    before: int = 0
    ranks: tuple[int, ...] = ()

    def width(self, parts: int) -> int:
        """Keys of a part."""
        return -(-(self.high - self.low + 1) // parts)


_COUNTED = "i int, part long, n long, low long, high long"


def _counter(columns: list[int], intervals: list[_Interval], widths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of each part of the intervals, its least and its greatest key, in a task; batches hold the columns as doubles.

    All that the tasks need is inside, so that workers need not have this package.
    """
    own = [[(i, v.low, v.high, w) for i, (v, w) in enumerate(zip(intervals, widths, strict=True)) if v.column == c] for c in columns]

    def keys_of(x: np.ndarray) -> np.ndarray:
        """sort_key() of an array."""
        bits = (x + 0.0).view(np.int64)
        return np.where(np.isnan(x), _INFINITE + 1, np.where(bits < 0, -(bits & ((1 << 63) - 1)), bits))

    def merged(found: list[np.ndarray]) -> np.ndarray:
        all_ = np.concatenate(found, axis=1)
        part, n, low, high = all_[:, np.argsort(all_[0], kind="stable")]
        at = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
        return np.stack([part[at], np.add.reduceat(n, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def add(chunk: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(chunk)
            for k, of in enumerate(own):
                keys = np.sort(keys_of(table.column(k).drop_null().to_numpy()))
                for i, low, high, width in of:
                    inside = keys[np.searchsorted(keys, low) : np.searchsorted(keys, high, "right")]
                    if not len(inside):
                        continue
                    part = (inside - low) // width
                    at = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
                    n = np.diff(at, append=len(part))
                    found = held.setdefault(i, [])
                    found.append(np.stack([part[at], n, inside[at], inside[at + n - 1]]))
                    if sum(f.shape[1] for f in found[1:]) > max(CHUNK, found[0].shape[1]):
                        held[i] = [merged(found)]

        chunk, rows = [], 0
        for b in batches:
            chunk.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                add(chunk)
                chunk, rows = [], 0
        if rows:
            add(chunk)
        for i, found in held.items():
            counts = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(counts.shape[1], i, np.int32)), *map(pa.array, counts)], names=["i", "part", "n", "low", "high"])

    return count


def _wanted(shares: tuple[float, ...], n: int) -> set[int]:
    return {f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)}


def _pass(doubles: DataFrame, intervals: list[_Interval], shares: tuple[float, ...], first: bool, by_key: bool) -> list:
    """Parts (or, ``by_key``, single keys) of the intervals that hold a wanted rank: number of the interval, rows in it, before it in the column and of the column (in the first pass), least and greatest key."""
    columns = sorted({v.column for v in intervals})
    widths = [1 if by_key else v.width(max(16, min(PARTS, ALL_PARTS // len(intervals)))) for v in intervals]
    rows = doubles.select(*[f"x{c}" for c in columns])
    counts = rows.mapInArrow(_counter(columns, intervals, widths), _COUNTED).groupBy("i", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    facts = doubles.sparkSession.createDataFrame([(i, v.column, v.before, list(v.ranks)) for i, v in enumerate(intervals)], "i int, column int, start long, ranks array<long>")
    counts = counts.join(F.broadcast(facts), "i")
    whole = Window.partitionBy("column" if first else "i")
    counts = counts.withColumns({
        "before": F.col("start") + F.coalesce(F.sum("n").over(whole.orderBy("i", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("n").over(whole),
    })
    if first:
        counts = counts.withColumn("ranks", F.array(*[f(F.lit(float(q)) * (F.col("total") - 1)) for q in shares for f in (F.floor, F.ceil)]))
    held = F.exists("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return counts.where(held).select("i", "n", "before", "total", "low", "high").collect()


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: tuple[float, ...] = QUARTILES) -> dict[str, list[float | None]]:
    """The quantiles of each expression over its non-null values; None where there are none.

    The first pass counts all keys and tells the numbers of rows, the next ones
    select.  The driver sees one interval per wanted rank.
    """
    columns = list(values)
    doubles = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values.values())])
    sizes: dict[int, int] = {}
    keys: dict[tuple[int, int], int] = {}
    intervals = [_Interval(i, low, high) for i in range(len(columns)) for low, high in ((-_INFINITE, -1), (0, _INFINITE + 1))]  # apart, so that no difference of keys overflows
    first = True
    while intervals:
        after = []
        for r in _pass(doubles, intervals, shares, first, not first and sum(v.rows for v in intervals) <= FEW):
            v = intervals[r["i"]]
            if first:
                sizes[v.column] = r["total"]
            end = r["before"] + r["n"]
            ranks = [k for k in (_wanted(shares, r["total"]) if first else v.ranks) if r["before"] <= k < end]
            known = {k: r["low"] if k == r["before"] else r["high"] for k in ranks if r["low"] == r["high"] or k in (r["before"], end - 1)}
            keys.update({(v.column, k): key for k, key in known.items()})
            if left := tuple(k for k in ranks if k not in known):
                after.append(_Interval(v.column, r["low"], r["high"], r["n"], r["before"], left))
        intervals, first = after, False
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        places = [q * (sizes[i] - 1) for q in shares] if i in sizes else []
        out[c] = [_interpolated(_value(keys[i, math.floor(p)]), _value(keys[i, math.ceil(p)]), p) for p in places] or [None] * len(shares)
    return out


def exact_quantile_columns(df: DataFrame, values: dict[str, Column], shares: tuple[float, ...] = QUARTILES) -> dict[str, Column]:
    """The quantiles as constant array columns."""
    found = exact_quantiles(df, values, shares)
    return {c: F.array(*[F.lit(v).cast("double") for v in q]) for c, q in found.items()}


def group_quantiles(df: DataFrame, by: list[str], value: Column, shares: tuple[float, ...] = QUARTILES) -> DataFrame:
    """The group's columns, n, lo, hi and q (the quantiles) of non-null values, for groups that have any; a group of any size is spread over ranges of its values."""
    names = [F.col(f"`{b}`") for b in by]
    counts = df.select(*names, value.cast("double").alias("__x")).where("__x is not null").groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*[n.alias(f"__b{i}") for i, n in enumerate(names)]).agg(F.sum("__n").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & n.eqNullSafe(F.col(f"__b{i}"))
    ranked = with_running(counts, {"__before": F.col("__n")}, "__x", by, ties=[]).join(totals, same)
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    ends = {f"__{k}{i}": F.max(F.when(holds(f(place(q))), F.col("__x"))) for i, q in enumerate(shares) for k, f in (("f", F.floor), ("c", F.ceil))}
    wanted = F.lit(False)
    for q in shares:
        wanted = wanted | holds(F.floor(place(q))) | holds(F.ceil(place(q)))
    one = ranked.where(wanted).groupBy(*names, "n", "lo", "hi").agg(*[e.alias(k) for k, e in ends.items()])

    def quantile(i: int, q: float) -> Column:
        low, high, p = F.col(f"__f{i}"), F.col(f"__c{i}"), place(q)
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return one.select(*names, "n", "lo", "hi", F.array(*[quantile(i, q) for i, q in enumerate(shares)]).alias("q"))

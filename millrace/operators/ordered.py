"""Work along an order, as a partitioning by ranges of it.

Rows are dealt to ranges of (group, order, tie-breakers), whose bounds come from
an evenly drawn sample, so a global order, a large group and many rows of equal
order are all spread.  Windows run within (group, range); what a group carries
from one range to the next is one row, and only groups that reach over a bound
carry anything: at most two rows per range.

Rows of equal order follow the tie-breakers, by default all other columns in the
order of the table, so results don't depend on how the rows are partitioned.
Rows equal in everything can stand in for each other.  Nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Sampled rows per range, and in all; ranges are never more than a tenth of the sample.
PER_RANGE, MOST_SAMPLED = 20, 200_000


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def tie_breakers(df: DataFrame, order: str, by: list[str], ties: list[str] | None) -> list[str]:
    """Columns that tell rows of equal order apart."""
    if ties is not None:
        return ties
    return [f.name for f in df.schema.fields if f.name not in (order, *by) and not isinstance(f.dataType, (T.MapType, T.VariantType))]


def _place(marks: Column, key: Column, most: int) -> Column:
    """How many of the sorted marks are at most ``key``: a binary search."""

    def step(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["low"] + a["high"], 1)
        right = F.coalesce((a["low"] < a["high"]) & (F.get(marks, middle) <= key), F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(a["low"]).alias("low"), F.when(right, a["high"]).otherwise(F.least(a["high"], middle)).alias("high"))

    steps = F.array_repeat(F.lit(0), most.bit_length() + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(marks).alias("high")), step, lambda a: a["low"])


def with_range(df: DataFrame, order: str, by: list[str] | None = None, ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds __range, the number of the row's range of (by, order, ties); as many ranges as shuffle partitions, unless told."""
    n = min(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_SAMPLED // 10)
    keys = [*(by or []), order, *tie_breakers(df, order, by or [], ties)]
    key = F.struct(*[_name(k).alias(f"k{i}") for i, k in enumerate(keys)])
    if n < 2:
        return df.withColumn("__range", F.lit(0))
    # the rows of least hash: as good as random, and the same ones whenever they are looked for
    sample = df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(min(PER_RANGE * n, MOST_SAMPLED))
    sample = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    at = F.sequence(F.lit(1), F.lit(n - 1))
    marks = F.filter(F.transform(at, lambda i: F.get("keys", F.floor(i * F.size("keys") / n).cast("int"))), lambda k: k.isNotNull())
    one_row = F.broadcast(sample.select(marks.alias("__marks")))
    return df.withColumn("__key", key).join(one_row).withColumn("__range", _place(F.col("__marks"), F.col("__key"), n)).drop("__marks", "__key")


def _windows(df: DataFrame, order: str, by: list[str], ties: list[str] | None, descending: bool) -> WindowSpec:
    sorts = [_name(k).desc() if descending else _name(k).asc() for k in (order, *tie_breakers(df, order, by, ties))]
    return Window.partitionBy(*map(_name, by), "__range").orderBy(*sorts)


def _to_here(window: WindowSpec, end: int = 0) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, end)


class _Carry:
    """What groups carry from range to range."""

    def __init__(self, rows: DataFrame, by: list[str], *summary: Column, descending: bool = False):
        self.by, self.names = by, [f"__g{i}" for i in range(len(by))]
        keys = [_name(b).alias(n) for b, n in zip(by, self.names, strict=True)]
        self.parts = rows.groupBy(*keys, F.col("__range").alias("__of")).agg(*summary)
        first, then = (F.desc("__of"), F.asc("__of")) if descending else (F.asc("__of"), F.desc("__of"))
        self.before = _to_here(Window.partitionBy(*self.names).orderBy(first), -1)
        self.behind = _to_here(Window.partitionBy(*self.names).orderBy(then), -1)

    def join(self, rows: DataFrame, **carried: Column) -> DataFrame:
        """The rows with what is carried into their range; null where a group is in one range only."""
        several = F.count(F.lit(1)).over(Window.partitionBy(*self.names)) > 1
        parts = self.parts.withColumns({**carried, "__several": several}).where("__several").select(*self.names, "__of", *carried)
        at = F.col("__range") == F.col("__of")
        for b, n in zip(self.by, self.names, strict=True):
            at = at & _name(b).eqNullSafe(F.col(n))
        return rows.join(F.broadcast(parts), at, "left").drop("__of", *self.names)  # two rows a range at most


def with_known(df: DataFrame, column: str, order: str, by: list[str] | None = None, ties: list[str] | None = None, ranges: int | None = None, earlier: bool = False) -> DataFrame:
    """Adds __r (row number in the group), __a and __b: the known value at or before, and at or behind a row, each with its row number; if ``earlier``, __p too, the one before the row."""
    by, c = by or [], _name(column)
    rows = with_range(df, order, by, ties, ranges)
    rows = rows.withColumn("__n", F.row_number().over(_windows(df, order, by, ties, False)).cast("long"))
    rows = rows.withColumn("__k", F.when(c.isNotNull(), F.struct(F.col("__n").alias("r"), c.alias("v"))))
    carry = _Carry(rows, by, F.count(F.lit(1)).alias("__size"), F.min("__k").alias("__first"), F.max("__k").alias("__last"))
    start = F.coalesce(F.sum("__size").over(carry.before), F.lit(0))
    moved = lambda k, s: F.when(k.isNotNull(), F.struct((k["r"] + s).alias("r"), k["v"].alias("v")))
    carry.parts = carry.parts.withColumn("__start", start)
    forward = Window.partitionBy(*map(_name, by), "__range").orderBy("__n")
    backward = Window.partitionBy(*map(_name, by), "__range").orderBy(F.desc("__n"))  # the same order, turned round
    local = rows.withColumn("__la", F.last("__k", True).over(_to_here(forward))).withColumn("__lb", F.last("__k", True).over(_to_here(backward)))
    local = local.withColumn("__lp", F.last("__k", True).over(_to_here(forward, -1))) if earlier else local
    out = carry.join(
        local,
        __start=F.col("__start"),
        __before=F.last(moved(F.col("__last"), F.col("__start")), True).over(carry.before),
        __behind=F.last(moved(F.col("__first"), F.col("__start")), True).over(carry.behind),
    )
    at = F.coalesce("__start", F.lit(0))
    before = {"__p": F.coalesce(moved(F.col("__lp"), at), "__before")} if earlier else {}
    return out.withColumns(
        {"__r": F.col("__n") + at, "__a": F.coalesce(moved(F.col("__la"), at), "__before"), "__b": F.coalesce(moved(F.col("__lb"), at), "__behind"), **before}
    ).drop("__range", "__n", "__k", "__la", "__lb", "__lp", "__start", "__before", "__behind")


def with_running(
    df: DataFrame, sums: dict[str, Column], order: str, by: list[str] | None = None, ties: list[str] | None = None, descending: bool = False, ranges: int | None = None
) -> DataFrame:
    """Adds, by name, the sums of values over the group's earlier rows (later ones, if descending); 0 where there are none."""
    by = by or []
    rows = with_range(df, order, by, ties, ranges).withColumns({f"__v{i}": v for i, v in enumerate(sums.values())})
    carry = _Carry(rows, by, *[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sums))], descending=descending)
    earlier = _to_here(_windows(df, order, by, ties, descending), -1)
    local = rows.withColumns({f"__w{i}": F.sum(f"__v{i}").over(earlier) for i in range(len(sums))})
    out = carry.join(local, **{f"__c{i}": F.sum(f"__s{i}").over(carry.before) for i in range(len(sums))})
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({name: zero(f"__w{i}") + zero(f"__c{i}") for i, name in enumerate(sums)})
    return out.drop("__range", *[f"__{k}{i}" for k in "vwc" for i in range(len(sums))])


def with_numbers(df: DataFrame, order: str, by: list[str] | None = None, ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds __r, the row's number in its group, from 1."""
    return with_running(df, {"__r": F.lit(1).cast("long")}, order, by, ties, ranges=ranges).withColumn("__r", F.col("__r") + 1)

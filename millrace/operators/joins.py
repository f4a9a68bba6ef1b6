"""Planned joins, key discovery, and unions of files."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_NAME = re.compile(r"(?i)^(?:.*_)?(?:id|no|num|number|key|code|pk|idx)$")
HOW = {"inner", "left", "right", "outer"}


@dataclass(frozen=True)
class Join:
    """One step of a join plan over named tables; its result can be named in later steps."""

    left: str
    right: str
    on: tuple[str, ...]
    how: str = "inner"
    result: str | None = None


#: Keys that the sketch of a side follows, and candidates for hot keys at most.
TRACKED, MOST_HOT = 10_000, 256


def hot_keys(left: DataFrame, right: DataFrame, keys: list[Column], share: float) -> tuple[list[int], list[int]]:
    """Hashes of keys (null ones too) that hold more than ``share`` of the left or the right side; each key is hot on the side where it has more rows.

    A sketch of bounded size proposes candidates, which are then counted exactly.
    """
    of_key = F.xxhash64(*[k.isNull() for k in keys], *keys)
    counts: list[dict[int, int]] = []
    limits: list[float] = []
    proposed: set[int] = set()
    for side in (left, right):
        row = side.select(of_key.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {MOST_HOT}, {TRACKED})").alias("top")).first()
        limits.append(share * row["n"])
        proposed |= {t["item"] for t in row["top"] or [] if t["count"] >= limits[-1]}
    for side in (left, right):
        rows = side.select(of_key.alias("h")).where(F.col("h").isin(*proposed)).groupBy("h").count().collect() if proposed else []
        counts.append({r["h"]: r["count"] for r in rows})
    a, b = counts
    hot_left = [h for h, n in a.items() if n > limits[0] and n >= b.get(h, 0)]
    return hot_left, [h for h, n in b.items() if n > limits[1] and n > a.get(h, 0)]


def _spread(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with __salt to join on as well, and __copy on rows that stand in for others.

    Rows of a key that is hot on one side are dealt to salts there, and their
    partners on the other side are repeated for each salt.
    """
    named = lambda df, keys: df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    names = [F.col(f"k{i}") for i in range(len(left_keys))]
    hot = hot_keys(named(left, left_keys), named(right, right_keys), names, 1 / (2 * salts))

    def salted(df: DataFrame, keys: list[Column], own: list[int], other: list[int]) -> DataFrame:
        h = F.xxhash64(*[k.isNull() for k in keys], *keys)
        none, all_ = F.array(F.lit(0)), F.sequence(F.lit(0), F.lit(salts - 1))
        row = F.xxhash64(F.lit("place"), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
        any_ = F.pmod(row, F.lit(salts)).cast("int")  # by the row's values, so that a task that runs again deals as before; equal rows stay together
        copied = h.isin(*other) if other else F.lit(False)
        places = F.when(copied, all_).when(h.isin(*own) if own else F.lit(False), F.array(any_)).otherwise(none)
        return df.select("*", F.explode(places).alias("__salt"), copied.alias("__copy"))

    return salted(left, left_keys, *hot), salted(right, right_keys, hot[1], hot[0])


def join_tables(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join on same-named columns in which null keys match; other clashes get _x and _y.

    Keys missing on either side are left out of the condition.  The physical
    join is Spark's choice.

    With ``salts``, keys that hold more than 1 / (2 * salts) of a side, null
    keys too, are spread: their rows are dealt to that many places and their
    partners are repeated there.  It costs two looks at the keys of each side,
    and serves joins that Spark can't split by itself, full ones above all.  The
    result has the same rows: a repeated row that finds no partner at its place
    has one elsewhere, for the key is known to be on the other side.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    keys = [k for k in on if k in left.columns and k in right.columns]
    if not keys:
        raise ValueError("no key column is on both sides")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select(*[F.col(f"`{c}`").alias(f"l.{c}") for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"r.{c}") for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(f"`l.{k}`").eqNullSafe(F.col(f"`r.{k}`")) for k in keys])
    if salts and salts > 1:
        a, b = _spread(a, b, [F.col(f"`l.{k}`") for k in keys], [F.col(f"`r.{k}`") for k in keys], salts)
        a, b = (x.withColumnsRenamed({"__salt": f"__salt_{s}", "__copy": f"__copy_{s}"}) for x, s in ((a, "l"), (b, "r")))
        both = a.join(b, cond & (F.col("__salt_l") == F.col("__salt_r")), how)
        alone_l, alone_r = F.col("__copy_r").isNull() & F.col("__copy_l"), F.col("__copy_l").isNull() & F.col("__copy_r")
        both = both.where(~F.coalesce(alone_l | alone_r, F.lit(False)))
    else:
        both = a.join(b, cond, how)
    out = [F.coalesce(F.col(f"`l.{c}`"), F.col(f"`r.{c}`")).alias(c) if c in keys else F.col(f"`l.{c}`").alias(f"{c}_x" if c in clash else c) for c in left.columns]
    out += [F.col(f"`r.{c}`").alias(f"{c}_y" if c in clash else c) for c in right.columns if c not in keys]
    return both.select(*out)


def run_plan(plan: list[Join], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the plan; steps that name unknown tables or share no key are skipped, unknown kinds of join are errors."""
    wrong = sorted({s.how for s in plan} - HOW)
    if wrong:
        raise ValueError(f"how must be one of {sorted(HOW)}, not {', '.join(wrong)}")
    known = dict(tables)
    for step in plan:
        if step.left in known and step.right in known:
            left, right = known[step.left], known[step.right]
            keys = [k for k in step.on if k in left.columns and k in right.columns]
            if keys:
                known[step.result or f"{step.left}_{step.right}"] = join_tables(left, right, keys, step.how)
    return known


def shared_columns(tables: dict[str, DataFrame]) -> list[str]:
    """Columns that two or more tables have: candidates for foreign keys."""
    seen = Counter(c for t in tables.values() for c in dict.fromkeys(t.columns))
    return sorted(c for c, n in seen.items() if n > 1)


def common_keys(tables: dict[str, DataFrame]) -> list[str]:
    """Columns that all tables have and whose names look like keys."""
    sets = [set(t.columns) for t in tables.values()]
    return sorted(c for c in set.intersection(*sets) if KEY_NAME.match(c)) if sets else []


def merge_on_keys(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left-deep inner join of all tables; of columns that repeat the first table's stays."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        extra = [c for c in b.columns if c in keys or c not in a.columns]
        return join_tables(a, b.select(*[F.col(f"`{c}`") for c in extra]), keys)

    return reduce(add, tables.values())


def concat_files(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, with the table's name as ``filename``; other columns are an error."""
    if len({frozenset(t.columns) for t in tables.values()}) > 1:
        raise ValueError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn("filename", F.lit(n)) for n, t in tables.items()])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Non-null key values of ``child`` that ``parent`` lacks: the inclusion test of a foreign key."""
    keys = child.select(F.col(child_key).alias("k")).where("k is not null").distinct()
    return keys.join(parent.select(F.col(parent_key).alias("p")), F.col("k") == F.col("p"), "left_anti")

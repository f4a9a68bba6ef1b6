import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import features, impute, metrics, ordered

SCHEMA = "g string, o int, k long, v double"


def made(n=400, seed=1):
    """Groups of very different sizes, null groups and orders, many equal orders, groups without any value."""
    r = random.Random(seed)
    group = lambda: r.choice(["hot"] * 12 + ["a", "b", None])
    rows = [(group(), r.choice([None, *range(6)]), k, r.randrange(1000) / 8 if r.random() < 0.3 else None) for k in range(n)]
    return rows + [("empty", i % 2, n + i, None) for i in range(5)] + [("one", None, 2 * n, 7.0)]


def by_hand(rows):
    low = lambda x: (x is not None, x or 0)
    groups = {}
    for row in sorted(rows, key=lambda x: (low(x[1]), x[2])):
        groups.setdefault(row[0], []).append(row)
    out = {}
    for group in groups.values():
        known = [(i + 1, x[3]) for i, x in enumerate(group) if x[3] is not None]
        for i, x in enumerate(group, 1):
            a, b = [k for k in known if k[0] <= i][-1:], [k for k in known if k[0] >= i][:1]
            out[x[2]] = (i, a[0] if a else None, b[0] if b else None)
    return out


@pytest.mark.parametrize(("partitions", "ranges"), [(1, 1), (3, 2), (7, 7), (5, 60), (2, 1000)])
def test_known_neighbours(spark, partitions, ranges):
    rows = made()
    t = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    out = ordered.with_known(t, "v", "o", ["g"], ranges=ranges)
    assert {r.k: (r["__r"], r["__a"] and tuple(r["__a"]), r["__b"] and tuple(r["__b"])) for r in out.collect()} == by_hand(rows)
    assert out.columns == ["g", "o", "k", "v", "__r", "__a", "__b"]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rows = made(seed=4)
    t = spark.createDataFrame(rows, SCHEMA).repartition(6)
    low = lambda x: (x is not None, x or 0)
    want, sums = {}, {}
    for x in sorted(rows, key=lambda x: (low(x[1]), x[2]), reverse=descending):
        want[x[2]] = sums.get(x[0], 0)
        sums[x[0]] = want[x[2]] + x[2]
    got = ordered.with_running(t, {"s": F.col("k")}, "o", ["g"], ["k"], descending, ranges=9)
    assert {r.k: r.s for r in got.collect()} == want


def test_ranges_are_even_whatever_the_order_holds(spark):
    """A third of the rows has one order, another third one group: no range holds much more than its share."""
    t = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("o"), F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("k"))
    for by in ([], ["g"]):
        sizes = [r["count"] for r in ordered.with_range(t, "o", by, ["k"], ranges=30).groupBy("__range").count().collect()]
        assert len(sizes) == 30 and max(sizes) < 2.5 * 2000


def test_fills_with_tied_orders_are_the_same_for_all_partitions(spark):
    rows, seen = made(seed=8), []
    for partitions in (3, 7):
        t = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        filled = [impute.fill_from_neighbours(t, "v", "o", ["g"]), impute.interpolate(t, "v", "o"), features.ordered_target_encoded(t, "g", "v", "o"), metrics.evenly_spaced(t, "o", 50)]
        seen.append([sorted((r[2], *map(str, r)) for r in f.collect()) for f in filled])
    assert seen[0] == seen[1]
    assert all(row[4] != "None" for row in seen[0][0]) and all(row[4] != "None" for row in seen[0][1])


def test_empty_tables_and_equal_rows(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert ordered.with_known(t, "v", "o").count() == 0 and ordered.with_numbers(t, "o", ["g"]).count() == 0
    same = spark.createDataFrame([("a", 1, 1, None)] * 30 + [("a", 1, 1, 2.0)] * 3, SCHEMA).repartition(7)
    assert {r.v for r in impute.fill_from_neighbours(same, "v", "o", ["g"]).collect()} == {2.0}
    assert sorted(r["__r"] for r in ordered.with_numbers(same, "o").collect()) == list(range(1, 34))

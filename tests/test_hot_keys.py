import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import inclusion, joins


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("salts", [2, 7])
def test_spread_joins_have_the_same_rows(spark, how, salts):
    """Keys hot on the left, on the right, on both, null keys, and hot keys without a partner."""
    r = random.Random(3)
    left = [(r.choice(["a"] * 20 + ["both"] * 9 + ["alone_l"] * 9 + [None] * 12 + [f"k{i}" for i in range(40)]), r.choice([None, 1, 2]), i) for i in range(900)]
    right = [(k, n, i) for i, (k, n) in enumerate([("a", 1), ("a", None), (None, 1), (None, None), *[("both", 2)] * 30, *[("alone_r", 1)] * 60, *[("k1", 1)] * 80, *[(f"k{i}", 2) for i in range(30, 60)]])]
    a, b = spark.createDataFrame(left, "k string, n int, v int").repartition(3), spark.createDataFrame(right, "k string, n int, w int").repartition(2)
    key = lambda x: tuple(map(str, x))
    for on in (["k"], ["k", "n"]):
        plain, spread = (sorted(map(tuple, joins.join_tables(a, b, on, how, salts=s).collect()), key=key) for s in (None, salts))
        assert plain == spread and len(plain) > 100


def test_largest_task_is_near_the_median(spark):
    """Half of the left side has the null key, in a full join, which Spark doesn't split."""
    n = 40_000
    left = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    right = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), (F.col("id") * 2).alias("w"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sizes = lambda salts: sorted(r["count"] for r in joins.join_tables(left, right, ["k"], "outer", salts).groupBy(F.spark_partition_id()).count().collect())
        spread, plain = sizes(64), sizes(None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(spread) and plain[-1] > 3 * plain[len(plain) // 2]
    assert len(spread) == 8 and spread[-1] <= 2 * spread[4]


def test_inclusion_against_sets(spark):
    r = random.Random(8)
    tables = {
        "a": [(i, r.randint(0, 5), r.choice(["x", "y", None]), float(i % 4), None) for i in range(50)],
        "b": [(i * 2, r.randint(0, 30), r.choice(["x", "y", "z"]), i / 2, None) for i in range(30)],
    }
    frames = {t: spark.createDataFrame(rows, "id long, n int, s string, x double, e string").repartition(3) for t, rows in tables.items()}
    frames["wide"] = spark.createDataFrame([tuple(range(i, i + 70)) for i in range(3)], ", ".join(f"c{i} int" for i in range(70)))
    values = {(t, c): [row[c] for row in f.collect() if row[c] is not None] for t, f in frames.items() for c in f.columns}
    plain = lambda v: v if isinstance(v, str) else float(v)
    sets = {k: {plain(v) for v in vs} for k, vs in values.items()}
    want = {(*x, *y, len(sets[x]), len(sets[y]), len(values[y]) == len(sets[y])) for x in sets for y in sets if x != y and sets[x] and sets[x] <= sets[y]}
    got = {tuple(row) for row in inclusion.inclusion_dependencies(frames).collect()}
    assert got == want and len(want) > 20
    assert all(row.parent_is_key and row.child_table != row.parent_table for row in inclusion.foreign_keys(frames).collect())

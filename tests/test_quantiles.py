import math
import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def spark_percentiles(t, c):
    return t.agg(F.percentile(c, F.array(*map(F.lit, SHARES))).alias("q")).first().q


@pytest.mark.parametrize("few", [quantiles.FEW, 0, 40])
def test_equal_to_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(2)
    rows = [(r.gauss(0, 1), r.randint(-5, 5) * 1.0, 10 ** r.uniform(-300, 300) * r.choice([1, -1]), r.choice([None, 5e-324, -5e-324, 0.0, -0.0, 2.0**-1022, 1.7e308]), r.randrange(10**15)) for _ in range(3000)]
    t = spark.createDataFrame(rows, "a double, b double, c double, d double, e long").repartition(5)
    got = quantiles.exact_quantiles(t, {c: F.col(c) for c in "abcde"}, SHARES)
    for c in "abcde":
        assert got[c] == spark_percentiles(t, c), c


def test_keys_keep_the_order(spark):
    r = random.Random(1)
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    values += [s * 2.0**e * f for e in range(-1074, 1023, 3) for s in (1, -1) for f in (1, 1 + 2**-52, 2 - 2**-52) if abs(2.0**e * f) > 0] + [r.gauss(0, 1e5) for _ in range(2000)]
    t = spark.createDataFrame([(v,) for v in values], "x double").select("x", quantiles.sort_key(F.col("x")).alias("k"))
    got = sorted((x.k, x.x) for x in t.collect())
    assert all(quantiles._value(k) == x or math.isnan(x) for k, x in got)
    plain = [x for _, x in got if not math.isnan(x)]
    assert plain == sorted(plain) and math.isnan(got[-1][1])


def test_no_values_and_one(spark):
    t = spark.createDataFrame([(None, 3.0), (None, None)], "a double, b double")
    assert quantiles.exact_quantiles(t, {"a": F.col("a"), "b": F.col("b")}) == {"a": [None] * 3, "b": [3.0] * 3}
    assert quantiles.exact_quantiles(t.limit(0), {"a": F.col("a")}, (0.5,)) == {"a": [None]}
    assert quantiles.group_quantiles(t, ["a"], F.col("a")).collect() == []


def test_groups(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([1, 2]), r.choice([None, r.gauss(0, 5), float(r.randint(0, 3))])) for _ in range(3000)]
    t = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    key = lambda x: (str(x.g), x.h)
    got = sorted(quantiles.group_quantiles(t, ["g", "h"], F.col("v"), SHARES).collect(), key=key)
    want = sorted(t.where("v is not null").groupBy("g", "h").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=key)
    assert [(x.g, x.h, x.n, x.lo, x.hi, x.q) for x in got] == [(x.g, x.h, x.n, x.lo, x.hi, x.q) for x in want]


def test_ten_million_distinct_values(spark):
    """Every value is different; a pass groups into at most 65,536 parts per interval, whatever the number of values."""
    n = 10_000_000
    t = spark.range(0, n, 1, 8).select((F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 4 - 1e6).alias("x"))
    values = quantiles.exact_quantiles(t, {"x": F.col("x")}, (0.25, 0.5, 0.9))["x"]
    assert values == pytest.approx([(q * (n - 1)) / 4 - 1e6 for q in (0.25, 0.5, 0.9)], rel=1e-12)


@pytest.mark.parametrize("value", ["id % 11 / 100", "id * 7919 % 86400", "(id * 7919 % 1000003) / 100 - 2000"])
def test_few_passes_settle_common_columns(spark, monkeypatch, value):
    """However many rows are left in an interval, one of a single value is settled."""
    passes, once = [], quantiles._pass
    monkeypatch.setattr(quantiles, "_pass", lambda *a: passes.append(1) or once(*a))
    monkeypatch.setattr(quantiles, "FEW", 0)
    t = spark.range(0, 300_000, 1, 3).selectExpr(f"cast({value} as double) as x")
    got = quantiles.exact_quantiles(t, {"x": F.col("x")}, SHARES)["x"]
    assert got == spark_percentiles(t, "x") and len(passes) <= 3


def test_odd_values(spark):
    rows = [(x, None) for x in (math.nan, math.inf, -0.0, -5e-324, -math.inf)] + [(None, None)] * 3 + [(None, 7.0)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "a double, b double").repartition(3), {"a": F.col("a"), "b": F.col("b")}, (0.0, 0.25, 0.5, 0.75, 1.0))
    assert got["a"][:4] == [-math.inf, -5e-324, 0.0, math.inf] and math.isnan(got["a"][4]) and got["b"] == [7.0] * 5


def test_many_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 0)
    monkeypatch.setattr(quantiles, "ALL_PARTS", 500)
    monkeypatch.setattr(quantiles, "CHUNK", 100)
    t = spark.range(0, 2000, 1, 3).select(*[(F.sin(F.col("id") * (i + 1)) * 10.0 ** (i - 10)).alias(f"c{i}") for i in range(20)])
    got = quantiles.exact_quantiles(t, {c: F.col(c) for c in t.columns}, SHARES)
    want = t.agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in t.columns]).first()
    assert got == want.asDict()


def test_workers_need_not_have_this_package(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, None, 3.0])], names=["x0"])
    given = cloudpickle.dumps((quantiles._counter([0], [quantiles._Interval(0, 0, quantiles._INFINITE + 1)], [1 << 50]), batch))
    told = subprocess.run([sys.executable, "-c", "import sys; from pyspark import cloudpickle; f, b = cloudpickle.loads(sys.stdin.buffer.read()); print(sum(sum(x.column('n').to_pylist()) for x in f([b])))"], input=given, capture_output=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert told.stdout.split() == [b"2"]

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.functions.temporal import seconds_of_day, time_text
from millrace.operators import times
from millrace.plans import imputation


def made(spark, follow=True):
    """Times around midnight that follow a number and a category; some numbers are missing."""
    r = random.Random(4)
    rows = []
    for i in range(600):
        x, c = r.uniform(-1, 1), r.choice("pqr")
        s = (3600 * x + {"p": -4000, "q": 0, "r": 5000}[c] + r.gauss(0, 300)) % 86400 if follow else r.uniform(0, 86400)
        rows.append((i, x if i % 20 else None, c, int(s), i % 5 == 0))
    t = spark.createDataFrame(rows, "i int, x double, c string, s int, gone boolean")
    return t.withColumn("at", F.when(~F.col("gone"), time_text(F.col("s"))))


def test_against_numpy_and_the_median(spark):
    t = made(spark)
    model = times.fit_times(t, "at", ["x"], {"c": ["p", "q", "r"]}, F.lit(43_200))
    rows = [r for r in t.collect() if not r.gone]
    mean, width = np.mean([r.x for r in rows if r.x is not None]), np.std([r.x for r in rows if r.x is not None])
    a = np.array([[1, 0 if r.x is None else (r.x - mean) / width, r.c == "q", r.c == "r"] for r in rows], float)
    angle = np.array([r.s for r in rows]) * 2 * math.pi / 86400
    for k, y in (("sin", np.sin(angle)), ("cos", np.cos(angle))):
        assert np.allclose(model[k], np.linalg.lstsq(a, y, rcond=None)[0])
    plan = imputation.decide(t.select("i", "x", "c", "at"), {"i": "integer", "x": "float", "c": "category", "at": "time"})
    assert [f.method for f in plan if f.column == "at"] == ["time_model"]
    filled = imputation.apply(t, [f for f in plan if f.column == "at"], "i").where("gone").select("s", F.expr("cast(substr(at, 1, 2) as int) * 3600 + cast(substr(at, 4, 2) as int) * 60 + cast(substr(at, 7, 2) as int)").alias("said")).collect()
    way = lambda a, b: min((a - b) % 86400, (b - a) % 86400)
    known = sorted(r.s for r in rows)
    median = known[len(known) // 2]
    assert np.mean([way(r.s, r.said) for r in filled]) < 0.25 * np.mean([way(r.s, median) for r in filled])


def test_the_median_stays_where_nothing_is_to_be_learnt(spark):
    t = made(spark, follow=False)
    median = sorted(r.s for r in t.where("not gone").collect())[240]
    assert times.fit_times(t.withColumn("at", F.when(F.col("s") > 0, "08:00:00")), "at", ["x"], {}, F.lit(28_800)) is None
    assert times.fit_times(t.limit(30), "at", ["x"], {}, F.lit(median)) is None
    assert times.fit_times(t, "at", [], {}, F.lit(median)) is None


def test_times_are_read_once_a_pass_and_only_open_columns_profiled(spark, monkeypatch):
    """Making the times is counted; the numbers, of which none is missing, are not asked for their different values."""
    made_, asked, profile = spark.sparkContext.accumulator(0), [], imputation.profile_columns

    @F.udf("string")
    def clock(i):
        made_.add(1)
        return None if i % 5 == 0 else f"{i % 24:02d}:{i % 60:02d}:00"

    t = spark.range(0, 1000, 1, 2).select(F.col("id").alias("k"), clock("id").alias("at"))
    monkeypatch.setattr(imputation, "profile_columns", lambda df, columns=None: asked.append(columns) or profile(df, columns))
    plan = imputation.decide(t, {"at": "time"})
    known = sorted((i % 24) * 3600 + (i % 60) * 60 for i in range(1000) if i % 5)
    middle = (known[399] + known[400]) // 2
    assert [(f.column, f.method, f.value) for f in plan] == [("at", "time", f"{middle // 3600:02d}:{middle % 3600 // 60:02d}:{middle % 60:02d}")]
    assert asked == [["at"]]
    assert made_.value <= 6 * 1000  # nulls, different values, median, and three aggregates of the model


def test_seconds_of_odd_times(spark):
    texts = ["7:05", "07:05:09", "23:59:59", "24:00", "12:60", "1:2", "12:30:", "12:30:5", "12:30:45:00", " 12:30", "12:30\n", "12:30:45\n", "", ":", "a12:30", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(seconds_of_day(F.col("t")).alias("s")).collect()]
    assert got == [25500, 25509, 86399, None, None, None, None, None, None, None, 45000, 45045, None, None, None, None]


def test_median_of_few_and_many_times(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "at string")
    assert imputation._time_value(t("8:00", "9:00", "9:00", "10:00", "x", None), "at") == "00:00:00"
    assert imputation._time_value(t("8:00", "9:00", "09:00:00", "9:00:01", "10:00", "x", "11:00", None), "at") == "09:00:00"
    assert imputation._time_value(t("8:00", "9:00", "9:00", "9:00:05", "9:02", "10:00", "11:00", "12:00"), "at") == "09:01:02"

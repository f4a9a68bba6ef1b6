import random

from pyspark.sql import functions as F

from millrace.operators import detect, mixed
from millrace.plans import cleaning

VALUES = """12/05/2020|45/13/2020|2020-01-31|2020-02-31|3 Jan 2020|3rd January 2020|Jan 2020|20200131|99999999|5 Foo 2020|1st May 1999|12.05.99|7:05|25:61|7:05 pm|noon|13:00 pm|2020-01-31 10:20:30|31/12/1999 7:05 PM|2020-13-31 10:20|
1583020800|1583020800000|2020-01-31T10:20:30Z|2020-99-31T10:20:30Z|Year 2025|2025 AD|Y2025|FY25|FY 1850|'99|jan|March|monday|Tue|W5|Week 60|2024-W05|Q3|Q7|2024-Q1|FY2023-24|90m|1h 30m|1:30:05|PT1H30M|$5|€ 1.234,50|5 USD|-$3k|
Save $5|$50k/year|8 LPA|annual 50k|0x1F|1x2f|0b101|0b102|0o17|0o19|1e5|two thousand|3 lakh|XIV|45%|7 percent|3:4|99/100|1,234|-5|5|1|0|2|3.14|.5|12 kg|3.5 lb|1,000 g|7 km|5 m2|5 m3|9 ft2|4 kg/m3|3 g/cm3|2 gal|20 °C|5 GB|
45.5|-91.2|95.5 N|45° 30' 15" N|181.5|179.9 W|12.5, 77.6|95.0, 12.0|45.0;10.0|1.2.3.4|256.1.1.1|10.0.0.1/8|::1|fe80::1|00:1a:2b:3c:4d:5e|a@b.co|x9@mail2.org|http://a.b/c1|www.x1.com|example3.com|/usr/lib9/x|C:\\a1\\b|report1.csv|
song.mp3|song.mp4|song.mp5|v1.2.3|1.2-beta2|UTC+5|Asia/Tokyo|true|No|on|maybe|male|F|AB123|A-1-b|hello world, you|x|?!|10 storage|5 l|2 qt|64 GB storage|one|ten crore|5.0e-3 W|3 psi|88 mph|1 hp|1 kWh|7 rad"""


def test_shapes_decide_as_values_do(spark):
    """No test that needs a shape it can't have; and what is told by shape doesn't depend on digits."""
    r = random.Random(1)
    values = [v.strip() for v in VALUES.replace("\n", "").split("|") if v.strip()]
    values += ["".join(r.choice("0123456789") if c.isdigit() else c for c in v) for v in values for _ in range(4)]
    t = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "v string").repartition(4)
    v, s = F.col("v"), detect.shape(F.col("v"))
    checks = {k: F.coalesce(f(v), F.lit(False)) & ~F.coalesce(detect.POSSIBLE[k](s), F.lit(False)) if k in detect.POSSIBLE else ~F.coalesce(f(v), F.lit(False)).eqNullSafe(F.coalesce(f(s), F.lit(False))) for k, f in detect.TESTS.items()}
    names = list(checks)
    for i in range(0, len(names), 9):
        for row in t.select("v", *[checks[k].alias(k) for k in names[i : i + 9]]).collect():
            assert not any(row[1:]), (row.v, [k for k, x in row.asDict().items() if x is True])


def test_a_rating_stays_a_number(spark):
    i = F.col("id")
    t = spark.range(200).select(F.when(i % 10 == 0, "2").otherwise((i % 2).cast("string")).alias("rating"), F.when(i % 2 == 0, "Yes").otherwise("no").alias("open"))
    plan = cleaning.decide(t)
    assert [c.kind for c in plan.columns] == ["integer", "boolean"]
    assert cleaning.apply(t, plan).where("rating = 2").count() == 20


def test_strings_with_units_among_numbers(spark):
    rows = [("5",), ("1,200",), ("7.5",), ("14 kg",), ("11 lb",), ("3 kg",), ("n/a",), (None,), ("9",), ("6",)]
    t = spark.createDataFrame(rows, "w string")
    out, plan = mixed.clean_mixed(t, "w")
    assert (plan.keep, plan.kind, plan.unit) == ("numeric", "weight", "kg")
    assert [r.w for r in out.collect()] == ["5", "1,200", "7.5", "14.0", "4.99", "3.0", "", None, "9", "6"]
    assert [r.w for r in mixed.clean_mixed(spark.createDataFrame([("a",), ("b",), ("1",)], "w string"), "w")[0].collect()] == ["a", "b", ""]
    assert mixed.clean_mixed(spark.createDataFrame([("1",), ("2",), (None,)], "w string"), "w")[1] is None
    money = mixed.clean_mixed(spark.createDataFrame([("0",), ("0",), ("$5",), ("$2",), ("0",)], "w string"), "w")
    assert [r.w for r in money[0].collect()] == ["0", "0", "5.0", "2.0", "0"] and money[1].unit == "USD"
    decided = cleaning.decide(t)
    assert decided.columns[0].target == "w_(kg)" and [r[0] for r in cleaning.apply(t, decided).collect()] == [5.0, 1200.0, 7.5, 14.0, 4.99, 3.0, None, None, 9.0, 6.0]


def test_scores_are_the_shares_that_pass(spark):
    """Scores by shape equal the tests' shares over all values, for columns of every kind in one table."""
    r = random.Random(2)
    values = [v.strip() for v in VALUES.replace("\n", "").split("|") if v.strip()]
    columns = {f"c{i}": [r.choice(values[8 * i : 8 * i + 8]) for _ in range(40)] for i in range(len(values) // 8)}
    t = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns)).repartition(3)
    found = {row["column_name"]: row for row in detect.evidence(t)}
    for kinds in (["date", "time", "datetime", "timestamp"], ["week", "quarter", "year", "boolean", "number_systems"], ["volume", "density", "latitude", "network_addresses", "files", "weight", "currency"]):
        plain = t.agg(*[F.avg(F.coalesce(detect.TESTS[k](F.col(c)), F.lit(False)).cast("int")).alias(f"{c}|{k}") for c in columns for k in kinds]).first()
        for c in columns:
            for k in kinds:
                assert abs(found[c][k] - plain[f"{c}|{k}"]) < 1e-9, (c, k)

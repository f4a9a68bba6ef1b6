import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import impute


def numbered(spark, n, size, first=0, gone=9):
    """Code i % size of rows first to first + n, some of them missing (never the first)."""
    width = len(str(size - 1))
    t = spark.range(first, first + n, 1, 5).withColumn("want", F.concat(F.lit("EMP"), F.lpad((F.col("id") % size).cast("string"), width, "0")))
    return t.withColumn("code", F.when((F.col("id") % gone != 0) | (F.col("id") == first), F.col("want")))


@pytest.mark.parametrize("first", [0, 95])
@pytest.mark.parametrize("n", [99, 120, 450])
def test_numbers_that_run_round(spark, n, first):
    t = numbered(spark, n, 100, first)
    got = impute.fill_text_sequence(t, "code", "id", ties=[]).collect()
    assert len(got) == n and [(r.id, r.code) for r in got if r.code != r.want] == []


def test_groups_run_round_each_by_itself(spark):
    parts = [numbered(spark, 250, 100).withColumn("g", F.lit("a")), numbered(spark, 180, 100, 37).withColumn("g", F.lit(None)), numbered(spark, 30, 1000, 0).withColumn("g", F.lit("b"))]
    short = [F.concat(F.lit("EMP"), F.substring(c, 5, 2)).alias(c) for c in ("want", "code")]  # the third group's numbers have a digit more, which is cut
    t = parts[0].union(parts[1]).union(parts[2].select("id", *short, "g"))
    got = impute.fill_text_sequence(t, "code", "id", ["g"], ties=[]).collect()
    assert len(got) == 460 and [(r.g, r.id, r.code, r.want) for r in got if r.code != r.want] == []


def test_a_number_used_on_its_round_stays_missing(spark):
    rows = [(i, f"A{i % 10}") for i in range(24)]
    rows[13], rows[15], rows[18] = (13, None), (15, "A3"), (18, None)  # A3 of the second round is elsewhere
    t = spark.createDataFrame(rows, "i int, code string").repartition(3)
    got = {r.i: r.code for r in impute.fill_text_sequence(t, "code", "i", ties=[]).collect()}
    assert got == {i: c for i, c in rows} | {18: "A8"}


def test_numbers_that_don_t_run_round_become_longer(spark):
    t = spark.createDataFrame([(1, "A97"), (2, "A98"), (3, "A99"), (4, None), (5, None)], "i int, code string")
    assert [r.code for r in impute.fill_text_sequence(t, "code", "i").orderBy("i").collect()] == ["A97", "A98", "A99", "A100", "A101"]
    empty = t.where("i > 3")
    assert [r.code for r in impute.fill_text_sequence(empty, "code", "i").collect()] == [None, None]


def test_query_beyond_the_last_number(spark, tmp_path):
    spark.range(99_950, 200_050).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, queries.QUERIES["seq_text"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.ORACLE["seq_text"]).fetchall())

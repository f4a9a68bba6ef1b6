import pytest
from pyspark.sql import functions as F

from millrace.functions import temporal
from millrace.functions.units import MEASURES, dominant_unit, match_share, normalised
from millrace.operators import detect, features, impute, joins, metrics, rows, stats, structure
from millrace.plans import cleaning
from millrace.sources import readers


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x, y"\n2,"say ""hi"""\n,\n', encoding="utf-8")
    got = [tuple(r) for r in readers.read_table(spark, str(path)).collect()]
    assert got == [("1", "x, y"), ("2", 'say "hi"')]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.bin")
    t = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0)], "a double, b double")
    assert readers.whole_floats_to_long(t).dtypes == [("a", "bigint"), ("b", "double")]
    readers.write_table(t, str(tmp_path / "out.parquet"))
    assert readers.read_table(spark, str(tmp_path / "out.parquet")).count() == 2
    assert readers.distinct_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_database_names_are_checked(spark):
    options = readers.database_options("postgresql", "h", "d", "u", "p")
    assert options["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        readers.read_database(spark, options, "users; drop table x", ["users"])


def test_units(spark):
    t = spark.createDataFrame([(1, "5 kg"), (2, "11 lb"), (3, "1,000 g"), (4, "2kg"), (5, None), (6, "n/a")], "i int, w string")
    m = MEASURES["weight"]
    assert dominant_unit(t, "w", m, "i") == "kg"
    out, unit = normalised(t, "w", m, "i")
    assert unit == "kg" and out.columns == ["i", "w_(kg)"]
    assert [r[1] for r in out.orderBy("i").collect()] == [5.0, 4.99, 1.0, 2.0, None, None]
    assert t.agg(match_share(F.col("w"), m)).first()[0] == pytest.approx(0.8)


@pytest.mark.parametrize("seconds", [0, 59, 3600, 86399])
def test_times_round_trip(spark, seconds):
    text = temporal.time_text(F.lit(seconds))
    assert spark.range(1).select(temporal.seconds_of_day(text)).first()[0] == seconds


def test_null_keys_and_clashes(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    b = spark.createDataFrame([(None, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, joins.join_tables(a, b, ["k"]).collect())) == [(None, "q", "x")]
    outer = joins.join_tables(a, b, ["k", "absent"], "outer")
    assert outer.columns == ["k", "v_x", "v_y"] and outer.count() == 3
    with pytest.raises(ValueError):
        joins.join_tables(a, b, ["absent"])
    assert set(joins.run_plan([joins.Join("a", "nobody", ("k",)), joins.Join("a", "b", ("k",), result="ab")], {"a": a, "b": b})) == {"a", "b", "ab"}


def test_histogram_of_a_constant(spark):
    t = spark.createDataFrame([(3.0,)] * 5 + [(None,)], "x double")
    got = stats.histogram(t, "x", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 5, 0] and got[0].left == 2.5 and got[3].right == 3.5


def test_thresholds_of_sparse_rows(spark):
    t = spark.createDataFrame([tuple([1] * (10 - n) + [None] * n) for n in range(11)], ", ".join(f"c{i} int" for i in range(10)))
    assert rows.drop_sparse_rows(t).count() == 7


def test_first_of_equal_rows_stays(spark):
    t = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "i int, v string").repartition(3)
    assert sorted(tuple(r) for r in rows.keep_first(t, "i").collect()) == [(1, "a"), (2, None)]


def test_impute_rules():
    f = impute.Facts
    assert impute.numeric_method(f(0.0, 9)) == "none"
    assert impute.numeric_method(f(0.5, 2)) == "mode"
    assert impute.numeric_method(f(0.05, 6)) == "median"
    assert impute.numeric_method(f(0.25, 11, 0.8)) == "median"
    assert impute.numeric_method(f(0.25, 11, 0.75)) == "mean"
    assert impute.numeric_method(f(0.6, 11)) == "median"
    assert impute.numeric_method(f(0.61, 11, cv=0.1)) == "drop"
    assert impute.temporal_method(0.1, "calendar", 5, True) == "derive"
    assert impute.temporal_method(0.7, "date", 2) == "drop"


@pytest.mark.parametrize("parts", [1, 16])
def test_fills_do_not_depend_on_partitions(spark, parts):
    t = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(1, 30)], "i int, v double").repartition(parts)
    filled = [r.v for r in impute.fill_from_neighbours(t, "v", "i").orderBy("i").collect()]
    assert filled[:4] == [3.0, 3.0, 3.0, 3.0] and filled[-1] == 27.0
    line = [r.v for r in impute.interpolate(t, "v", "i").orderBy("i").collect()]
    assert line[2:27] == [float(i) for i in range(3, 28)]
    sequence = spark.createDataFrame([(i, None if i in (3, 7) else i) for i in range(1, 10)], "i int, v int").repartition(parts)
    assert [r.v for r in impute.fill_sequence(sequence, "v", "i").orderBy("i").collect()] == list(range(1, 10))


def test_target_rules(spark):
    t = spark.createDataFrame([(1, None), (5, "a"), (9, "b")], "x int, s string")
    rules = [{"column": "x", "op": ">", "value": 4}, {"column": "s", "op": "!=", "value": "a", "output": 7}]
    assert [r[0] for r in t.orderBy("x").select(features.target_by_rules(rules)).collect()] == [7, 1, 7]
    with pytest.raises(ValueError):
        features.target_by_expression(t, "reflect('java.lang.System', 'exit')")


def test_encoders_and_scalers():
    assert [features.encoding_for(n) for n in (2, 10, 100, 200, 500, 501)] == ["one_hot_drop_first", "one_hot", "target", "frequency", "m_estimate", "ordered_target"]
    assert features.scaler_for(0, 1, 0, 0, 9, 0) == "none" and features.scaler_for(-5, 5, 0.1, 2, 0.1, 1) == "z_score"


def test_constant_column_scales_to_zero(spark):
    t = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [r.x_scaled for r in features.scaled(t, "x", "z_score").orderBy(F.desc("x")).collect()] == [0.0, 0.0, None]


def test_auc_counts_ties_half(spark):
    t = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(t, "y", "s").first()[0] == pytest.approx(0.875)


def test_structural_types(spark):
    t = spark.createDataFrame([(i, f"EMP{i:03d}", i % 2 == 0, ["x", "y"][i % 2], float(i * i), 1990 + i % 20) for i in range(100)], "n long, code string, flag boolean, kind string, v double, year int")
    assert dict(structure.structural_types(t)) == {"n": "identifier", "code": "identifier", "flag": "categorical", "kind": "categorical", "v": "numeric", "year": "numeric"}


def test_cleaning_plan_is_a_document(spark):
    t = spark.createDataFrame([("5 kg", "$3", "1/2/2020", None), ("7 lb", "$4", "3/2/2020", None), ("8 kg", "n/a", "bad", None)], "w string, c string, d string, e string")
    plan = cleaning.decide(t)
    assert plan.dropped == ("e",) and cleaning.CleaningPlan.from_json(plan.to_json()) == plan
    out = cleaning.apply(t, plan)
    assert out.columns == ["w_(kg)", "c_(USD)", "d"]
    assert [tuple(map(str, r)) for r in out.collect()] == [("5.0", "3.0", "2020-02-01"), ("3.18", "4.0", "2020-02-03"), ("8.0", "None", "None")]


def test_plan_runs_on_a_stream(spark, tmp_path):
    from millrace.streaming import events

    t = spark.createDataFrame([("5 kg",), ("7 lb",)], "w string")
    t.write.parquet(str(tmp_path / "in"))
    stream = events.cleaned(events.stream_files(spark, str(tmp_path / "in"), t.schema), cleaning.decide(t))
    q = stream.writeStream.format("memory").queryName("cleaned_weights").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("cleaned_weights").collect()) == [3.18, 5.0]


def test_types_are_told_from_all_rows(spark):
    """A head of nulls or of another form than most rows decides nothing."""
    i = F.col("id")
    t = spark.range(400).coalesce(1).select(F.when(i >= 150, F.lit("12 kg")).alias("late"), F.when(i < 150, i.cast("string")).otherwise("12 kg").alias("mixed"))
    assert {c: kind for c, (kind, _) in detect.semantic_types(t).items()} == {"late": "weight", "mixed": "weight"}
    plan = cleaning.decide(t)
    assert [c.kind for c in plan.columns] == ["weight", "weight"]
    assert cleaning.apply(t, plan).where("`mixed_(kg)` is not null").count() >= 250

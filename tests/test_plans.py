import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers, places, temporal
from millrace.operators import charts, detect, features, impute, inputs, joins, metrics, models, ranges, rows
from millrace.plans import cleaning, imputation, steps
from millrace.sources import readers


def values(spark, f, texts):
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", f(F.col("s")).alias("v"))
    return [r.v for r in out.orderBy("i").collect()]


def test_fills_cross_ranges_and_groups(spark):
    """Against a plain pass over the rows, with groups, leading and trailing gaps, and a group without any value."""
    known = {(g, i): (None if g == "none" or (i * 7 + len(g)) % 5 < 2 else float(i * i % 11)) for g in ("a", "bb", "none") for i in range(40)}
    df = spark.createDataFrame([(g, i, v) for (g, i), v in known.items()], "g string, i int, v double").repartition(5)
    got = {(r.g, r.i): r.v for r in impute.interpolate(df, "v", "i", ["g"]).collect()}
    filled = {(r.g, r.i): r.v for r in impute.fill_from_neighbours(df, "v", "i", ["g"]).collect()}
    counts = {}
    for v in known.values():
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    mode = min(counts, key=lambda v: (-counts[v], v))
    for g in ("a", "bb", "none"):
        at = [i for i in range(40) if known[g, i] is not None]
        for i in range(40):
            a, b = max((x for x in at if x <= i), default=None), min((x for x in at if x >= i), default=None)
            if not at:
                want, near = None, mode
            elif a is None or b is None:
                want = near = known[g, a if b is None else b]
            else:
                want = known[g, a] + (known[g, b] - known[g, a]) * ((i - a) / (b - a) if b > a else 0)
                near = known[g, a]
            assert got[g, i] == (pytest.approx(want) if want is not None else None)
            assert filled[g, i] == near


def test_ranges_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", None)], "o string, v int")
    assert [r.v for r in impute.fill_from_neighbours(df, "v", "o").orderBy("o").collect()] == [2, 2, 2]
    assert impute.interpolate(df.limit(0), "v", "o").count() == 0


def test_numeric_types_follow_the_rules():
    choose = detect.choose
    assert choose("x", {"time": 1.0, "ratio": 1.0}, {"ratio_like": 0.6, "time_like": 0.4}) == ("ratio", 1.0)
    assert choose("x", {"time": 1.0, "ratio": 1.0}, {"ratio_like": 0.4, "time_like": 0.6})[0] == "time"
    assert choose("x", {"boolean": 1.0, "integer": 1.0}, {"true_side": True, "false_side": True, "only_boolean": True}) == ("boolean", 1.0)
    assert choose("x", {"boolean": 0.9, "integer": 1.0}, {"true_side": True, "false_side": True, "only_boolean": False}) == ("integer", 1.0)
    assert choose("x", {"boolean": 1.0, "integer": 1.0}, {"true_side": True, "false_side": False})[0] == "integer"
    assert choose("x", {"varchar": 0.9, "weight": 0.6}, {}) == ("weight", 0.6)
    assert choose("x", {"integer": 0.5, "number_systems": 0.7}, {}) == ("number_systems", 0.7)
    assert choose("x", {"date": 0.5, "currency": 0.5}, {}) == ("mixed", 0.0)
    assert choose("x", {"date": 0.5, "datetime": 0.4}, {}) == ("mixed", 0.0)
    assert choose("total_amount", {"integer": 0.55}, {}) == ("currency", 0.6)
    assert choose("x", {}, {"numbers": 0.9, "fractions": 0.1}) == ("float", 0.0)
    assert choose("x", {}, {"numbers": 0.0, "mean_length": 20.0}) == ("varchar", 0.0)
    assert choose("x", {}, {"numbers": 0.0, "mean_length": 200.0}) == ("text", 0.0)


def test_leading_nulls_do_not_hide_a_type(spark):
    rows_ = [(None,)] * 150 + [(f"{d:02d}-05-2021",) for d in range(1, 29)]
    df = spark.createDataFrame(rows_, "d string").coalesce(1)
    assert detect.semantic_types(df, sample=100)["d"][0] == "date" and detect.semantic_types(df)["d"][0] == "date"


def test_money_and_pay(spark):
    texts = ["Rs 500", "Rp1,000", "kr 50", "₨ 5", "৳7", "Save $1.23", "annual 50k", "$10-20 per hour", "10 kg", None]
    assert values(spark, numbers.money_amount, texts) == [500, 1000, 50, 5, 7, 1.23, None, None, None, None]
    assert values(spark, numbers.currency_of, texts) == ["INR", "IDR", "SEK", "INR", "BDT", "USD", None, None, None, None]
    assert values(spark, numbers.yearly_pay, texts) == [None] * 6 + [50000, 31200, None, None]


def test_addresses(spark):
    nets = ["fe80::1", "::1", "001a.2b3c.4d5e", "001A2B3C4D5E", "1.2.3", "2001:db8:0:0:0:0:0:1", ":::"]
    assert [v is not None for v in values(spark, places.network_address, nets)] == [True, True, True, True, False, True, False]
    paths = ["./x", "../x", "%TEMP%\\x", "C:/x", "x"]
    assert [v is not None for v in values(spark, lambda c: places.kept_if("path", c), paths)] == [True, True, True, True, False]


def test_times_and_dates_that_do_not_exist(spark):
    assert values(spark, temporal.time_of, ["25:00", "13:00 PM", "12 am", "12 pm", "7:5", "x"]) == [None, None, "00:00", "12:00", "07:05", None]
    assert values(spark, temporal.date_text, ["29-02-2023", "29-02-2024", "2-Jan-2020", "jan 2020", "99999999"]) == [None, "29-02-2024", "02-01-2020", "01-01-2020", None]


def test_cleaning_applies_every_kind(spark):
    df = spark.createDataFrame([("W5", "Q1", "yes", "10.0.0.1", "51.5, -0.1", "UTC"), ("Week 7", "2023-Q2", "no", "10.0.0.2", "10.5, 20.5", "GMT")], "w string, q string, b string, a string, g string, z string")
    plan = cleaning.CleaningPlan.from_json(cleaning.decide(df, year=2024).to_json())
    r = cleaning.apply(df, plan).first().asDict()
    assert r == {"w": "2024-W05", "q": "2024-Q1", "b": True, "a": "10.0.0.1", "g_latitude": 51.5, "g_longitude": -0.1, "z": "UTC"}


def test_scaler_and_split(spark):
    assert features.scaler_for(-3e6, -2e6, -2.5e6, 1e5, 0.0, 1e4) == "decimal"
    df = spark.createDataFrame([(i, "rare" if i < 3 else f"c{i % 2}") for i in range(101)], "i int, c string")
    parts = {(r.c, r.is_test): r["count"] for r in features.split(df, "i", "c").groupBy("c", "is_test").count().collect()}
    assert parts[("rare", True)] == 1 and parts[("c0", True)] == 10 and parts[("c1", True)] == 10
    with pytest.raises(ValueError, match="more than 5"):
        features.one_hot(df.withColumn("s", F.col("i").cast("string")), "s", most=5)


def test_tokens_of_the_reference_list(spark):
    assert values(spark, rows.tokens_to_null, ["ERROR", "missing", "inf", "unknown", "??", "not available", " N/A "]) == [None, "missing", "inf", None, None, "not available", None]


def test_join_plans_reject_unknown_kinds(spark):
    t = spark.createDataFrame([(1, 2)], "id int, v int")
    with pytest.raises(ValueError, match="how"):
        joins.run_plan([joins.Join("a", "b", ("id",), how="cross")], {"a": t, "b": t})
    assert set(joins.run_plan([joins.Join("a", "c", ("id",)), joins.Join("a", "b", ("x",))], {"a": t, "b": t})) == {"a", "b"}


def test_components_and_ranges(spark):
    df = spark.createDataFrame([("10-20",), ("12-05-2020",), (None,)], "s string")
    assert ranges.split_ranges(df, "s").columns == ["s"]  # as many dates as ranges
    assert ranges.split_money(spark.createDataFrame([("$5",), ("$7",)], "c string"), "c").columns == ["c_(USD)"]
    assert ranges.pay_scenario(spark.createDataFrame([("$5/year",), ("$7 per month",)], "c string"), "c") == "mixed_time"


def test_imputation_rules():
    g = imputation.generic_method
    assert g(0.1, 2, 100, "boolean", None, 0.0, False) == "mode" and g(0.1, 8, 100, "numeric", 0.0, 0.0, True) == "mode"
    assert g(0.1, 80, 100, "numeric", 0.1, 0.01, False) == "mean" and g(0.2, 80, 100, "numeric", 0.1, 0.01, False) == "median" and g(0.1, 80, 100, "numeric", 0.9, 0.01, False) == "median"
    assert g(0.1, 80, 100, "text", None, 0.0, False) == "unknown" and g(0.1, 20, 100, "text", None, 0.0, False) == "mode"


def test_empty_columns_go_and_dates_are_filled_from_neighbours(spark):
    df = spark.createDataFrame([(i, None, f"2021-01-{i + 1:02d}" if i % 25 else None) for i in range(28)], "i int, e string, d string")
    out = imputation.impute_table(df, {"d": "date"}, "i")
    assert out.columns == ["i", "d"] and out.where("d is null").count() == 0


def test_inputs(spark):
    t = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError, match="z"):
        inputs.project(t, ["x", "z"])
    assert inputs.options_of("smoker_(yes/no)") == ["yes", "no"] and inputs.options_of("plain") == []
    assert inputs.resolved_types({"x": "a"}, {"x": "b", "y": "c"}, {"z": "d"}, ["x", "y", "z", "w"]) == {"x": "a", "y": "c", "z": "d", "w": "text"}
    assert inputs.normalised_report({"acc": 0.0, "metrics": {"f1_score": 0.5}}, {"accuracy": ("acc",), "f1": ("f1_score",)}) == {"accuracy": 0.0, "f1": 0.5}
    assert inputs.select_kind(t, "number").columns == ["x"] and dict(inputs.enforced(t, {"x": "double"}).dtypes)["x"] == "double"
    assert inputs.same_columns({"a": t, "b": t.select("y", "x")}) and inputs.missing_and_extra(["x"], ["y"]) == (["y"], ["x"])


def test_files(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name;n\ncaf\u00e9;1\nb;2\n".encode("latin-1"))
    (tmp_path / "win.csv").write_bytes("name,n,n\n\u20ac5,1,2\n".encode("cp1252"))
    (tmp_path / "quoted.csv").write_text('name,n\n"a\nb",1\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "latin.csv")).orderBy("n").collect()] == [("caf\u00e9", "1"), ("b", "2")]
    win = readers.read_csv(spark, str(tmp_path / "win.csv"))
    assert win.columns == ["name", "n", "n.1"] and win.first().name == "\u20ac5"
    assert readers.read_csv(spark, str(tmp_path / "quoted.csv"), multi_line=True).first().name == "a\nb"
    assert readers.is_upload("a.csv") and not readers.is_upload("a.exe") and not readers.is_upload("../a.csv")
    folder = str(tmp_path)
    readers.write_document(spark, f"{folder}/doc", {"a": 1, "b": 2})
    assert readers.patch_document(spark, f"{folder}/doc", {"a": 5, "b": None}) == {"a": 5} == readers.read_document(spark, f"{folder}/doc")
    assert readers.list_folders(spark, folder) == ["doc"] and readers.delete(spark, folder, "doc") and readers.list_folders(spark, folder) == []
    with pytest.raises(ValueError, match="out of"):
        readers.delete(spark, folder, "../x")


def test_steps():
    with pytest.raises(ValueError, match="unknown"):
        steps.run(None, ["nothing"])
    _, log = steps.run(None, [], strict=False)
    assert log == []


def test_models_are_ranked_tuned_voted_and_stored(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), "ab"[i % 2], int(i % 10 > 4)) for i in range(400)], "i int, x double, z double, c string, y int")
    a, b = df.where("i % 4 <> 0"), df.where("i % 4 = 0")
    ranked = models.ranked_models(a, b, "y", ["x", "z"], ["c"], ["logistic_regression", "decision_tree"], "classification")
    assert ranked[0][1] >= ranked[1][1] >= 0.9
    hard = models.vote([m for _, _, m in ranked], b, "i", "classification", how="hard")
    assert hard.join(b, "i").where("prediction = y").count() / b.count() > 0.9
    models.save(ranked[0][2], f"{tmp_path}/m")
    again = models.predict(models.load(f"{tmp_path}/m"), b, ["i"])
    assert again.count() == b.count() and set(again.columns) == {"i", "prediction", "confidence"}
    found = models.tune(df, "y", ["x", "z"], [], "decision_tree", "classification", trials=2)
    assert found.bestModel.transform(df.withColumn("label", F.col("y").cast("double"))).where("prediction = y").count() > 380
    scaled = models.PopulationScaler(inputCols=["x"], outputCols=["s"]).fit(df).transform(df).agg(F.stddev_pop("s").alias("d"), F.avg("s").alias("m")).first()
    assert scaled.d == pytest.approx(1) and scaled.m == pytest.approx(0, abs=1e-12)


def test_lookup_charts(spark):
    t = spark.createDataFrame([(f"n{i}", i) for i in range(30)], "name string, v int")
    plan = charts.planned_charts(t, [("name", "text"), ("v", "numeric")], {"name": 30, "v": 30})
    assert charts.Chart("bar", "name") in plan
    assert [(r.x, r.y) for r in charts.chart_data(t, charts.Chart("bar", "name")).orderBy("y").collect()][-1] == ("n29", 29.0)


def test_evenly_spaced(spark):
    t = spark.range(1000).repartition(7)
    got = sorted(r.id for r in metrics.evenly_spaced(t, "id", 10).collect())
    assert len(got) == 10 and {b - a for a, b in zip(got, got[1:], strict=False)} == {100}
    assert metrics.evenly_spaced(spark.range(5), "id", 10).count() == 5

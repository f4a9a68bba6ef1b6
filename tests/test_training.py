import math
import random
from statistics import mean

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.operators import metrics, models, sketches
from millrace.operators.search import Sampler, Span, best, search
from millrace.plans import steps, training

SPACE = {"x": Span(-5, 5), "rate": Span(1e-4, 1, log=True), "depth": Span(1, 12, whole=True), "kind": ("a", "b", "c")}


def surface(p):
    return -((p["x"] - 1.7) ** 2) - (math.log10(p["rate"]) + 2) ** 2 - 0.1 * abs(p["depth"] - 7) - {"a": 1.0, "b": 0.0, "c": 2.0}[p["kind"]]


def test_search_beats_random_points_and_reruns_agree():
    class Random(Sampler):
        STARTUP = 10**9

    run = lambda sampler, seed: best(search(SPACE, lambda p: [surface(p)], 60, seed, sampler(SPACE, seed))).score
    adaptive, at_random = [run(Sampler, s) for s in range(12)], [run(Random, s) for s in range(12)]
    assert mean(adaptive) > mean(at_random) + 0.2
    one, two = (search(SPACE, lambda p: [surface(p)], 30, 7) for _ in range(2))
    assert [t.params for t in one] == [t.params for t in two]


def test_bad_trials_run_fewer_folds():
    asked = []

    def folds(p):
        for i in range(4):
            asked.append(i)
            yield surface(p) + 0.01 * i

    trials = search(SPACE, folds, 40, 1)
    assert any(t.pruned for t in trials[5:]) and not any(t.pruned for t in trials[:5])
    assert len(asked) < 4 * 40 and all(len(t.scores) == 4 for t in trials if not t.pruned)
    assert best(trials).score == max(t.score for t in trials if not t.pruned)


@pytest.fixture(scope="module")
def three_classes(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        a, b = r.uniform(-3, 3), r.uniform(-3, 3)
        y = int(a * a + b * b > 3) + int(a * a + b * b > 8)
        rows.append((i, a, b, y, f"2024-{i % 12 + 1:02d}-01", "ring words of class {} here".format("inner middle outer".split()[y]) if r.random() < 0.3 else "no word to tell it"))
    return spark.createDataFrame(rows, "i int, a double, b double, y int, d string, t string").withColumn("d", F.to_date("d"))


def test_boosting_follows_its_weights(spark, three_classes):
    """The says and the vote against numpy over the trees' own predictions; better than one tree."""
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(three_classes).withColumn("label", F.col("y").cast("double"))
    fitted = models.BoostedTrees(rounds=8, maxDepth=2).fit(df)
    trees, out = fitted.stages[:-1], df
    for t in trees:
        out = t.transform(out)
    got = out.select("label", *[t.getPredictionCol() for t in trees]).toPandas().to_numpy()
    y, said = got[:, 0], got[:, 1:]
    w, votes = np.ones(len(y)), np.zeros((len(y), 3))
    for i in range(len(trees)):
        miss = said[:, i] != y
        say = models.boosting_say((w * miss).sum() / w.sum(), 3)
        votes[np.arange(len(y)), said[:, i].astype(int)] += say
        w = w * np.exp(say * miss)
    done = fitted.transform(df).select("prediction", "label").toPandas()
    assert (done.prediction.to_numpy() == votes.argmax(1)).all()
    one = models.estimator("decision_tree", "classification", {"maxDepth": 2}).fit(df).transform(df)
    assert (done.prediction == done.label).mean() > one.where("prediction = label").count() / 900 + 0.05


def test_table_to_report(spark, three_classes):
    trained = [training.train_table(three_classes, "y", "i", ["decision_tree", "logistic_regression"], trials=1) for _ in range(2)]
    a, b = trained
    assert a.report == b.report and a.task == "classification" and a.report["classes"] == 3
    assert a.report["features"]["text"] == ["t"] and "d_month" in a.report["features"]["numeric"]
    assert a.models[0][1] > 0.75 and a.models[0][1] >= a.models[-1][1] and a.report["metrics"]["accuracy"] == pytest.approx(a.models[0][1])
    said = a.predict(three_classes, ["i", "y"])
    assert said.where("prediction = y").count() > 700 and a.vote(three_classes, "i").count() == 900


def test_candidates():
    assert models.candidates_for("classification", 500, "text", 3) == ["logistic_regression", "linear_svc", "naive_bayes"]
    assert "boosted_trees" in models.candidates_for("classification", 500, "mixed", 3) and "gradient_boosting" in models.candidates_for("classification", 500, "mixed", 2)
    for task, table in (("classification", models.CLASSIFIERS), ("regression", models.REGRESSORS)):
        assert set(table) <= set(models.SEARCH) | {"random_forest"}
        for kinds in ("numeric", "categorical", "text", "temporal", "mixed"):
            for rows in (10, 5_000, 10**6):
                assert set(models.candidates_for(task, rows, kinds, 4)) <= set(table)


def test_metrics_of_several_classes(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), [round(r.random(), 2) for _ in range(3)]) for _ in range(300)]
    got = metrics.multiclass_metrics(spark.createDataFrame(rows, "y int, p array<double>"), "y", "p").first()
    roc = []
    for c in range(3):
        pos, neg = [p[c] for y, p in rows if y == c], [p[c] for y, p in rows if y != c]
        roc.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert got.roc_auc_macro == pytest.approx(mean(roc), abs=1e-7)
    assert got.log_loss == pytest.approx(-mean(math.log(max(p[y], 1e-15)) for y, p in rows), abs=1e-7)
    with pytest.raises(Exception, match="0 or 1"):
        metrics.roc_auc(spark.createDataFrame([(2, 0.5), (1, 0.2)], "y int, s double"), "y", "s").collect()


def test_sketches_of_parts_merge(spark):
    t = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000 / 4).alias("x"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("s"))
    parts = sketches.sketched(t, by=["day"])
    assert parts.count() == 14
    whole, put_together = ({r.column_name: r for r in sketches.estimates(s, (0.1, 0.5, 0.9)).collect()} for s in (sketches.sketched(t.drop("day")), sketches.merged(parts)))
    for got in (whole, put_together):
        assert (got["x"].rows, got["x"].nulls, got["x"].low, got["x"].high) == (60_000, 0, 0.0, 4999.75)
        assert abs(got["x"].unique_count - 20_000) < 0.05 * 20_000 and got["s"].unique_count == pytest.approx(32, abs=1)
        assert [q / 5000 for q in got["x"].quantiles] == pytest.approx([0.1, 0.5, 0.9], abs=0.01)
        assert got["s"].null_share == pytest.approx(0.2) and got["s"].quantiles is None
        assert {v["count"] for v in got["s"].top_values if v["item"] is not None} == {1500}
    assert sketches.merged(parts.where("day < 3").unionByName(parts.where("day >= 3")), ["day"]).count() == 14
    empty = sketches.estimates(sketches.sketched(t.select("x").where("x < 0"))).collect()
    assert empty == []


def test_steps_are_observed(spark):
    t = spark.createDataFrame([(1, None), (1, None), (None, None), (2, "a")], "a int, b string")
    out, log = steps.run(t, ["drop_empty_rows", "drop_repeated_rows"])
    assert out.count() == 2
    assert [(r.step, r.rows, r.nulls) for r in steps.log_table(spark, log, after_action=True).orderBy("nth").collect()] == [("drop_empty_rows", 3, 2), ("drop_repeated_rows", 2, 1)]

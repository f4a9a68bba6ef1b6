"""Training, voting and batch prediction with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.features import text_features
from millrace.operators.search import Space, Span, Trial, best, search

CLASSIFIERS = {
    "logistic_regression": lambda: LogisticRegression(maxIter=30),
    "random_forest": lambda: RandomForestClassifier(numTrees=40, seed=42),
    "decision_tree": lambda: DecisionTreeClassifier(seed=42),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
    "gradient_boosting": lambda: OneVsRest(classifier=GBTClassifier(maxIter=20, seed=42)),
    "linear_svc": lambda: OneVsRest(classifier=LinearSVC(maxIter=30)),
    "boosted_trees": lambda: BoostedTrees(rounds=10),
}
REGRESSORS = {
    "linear": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "random_forest": lambda: RandomForestRegressor(numTrees=40, seed=42),
    "decision_tree": lambda: DecisionTreeRegressor(seed=42),
    "gradient_boosting": lambda: GBTRegressor(maxIter=20, seed=42),
}


def candidates_for(task: str, rows: int, kinds: str = "mixed", classes: int = 2) -> list[str]:
    """Model names by task, number of rows (below 1,000, below 10,000, more), kind of the features and number of classes.

    ``kinds`` is numeric, categorical, text, temporal or mixed.  Linear models
    suit numbers and words, trees categories and dates; the more rows, the fewer
    slow models; naive Bayes serves few numbers and words.
    """
    size = 0 if rows < 1_000 else 1 if rows < 10_000 else 2
    if task != "classification":
        linear = ["linear", "ridge", *(["lasso", "elastic_net"] if size == 0 or kinds == "text" else [])]
        trees = ["random_forest", *(["decision_tree"] if size < 2 else []), *(["gradient_boosting"] if size < 2 or kinds == "temporal" else [])]
        return {"text": linear, "temporal": trees, "categorical": [*linear[:2], *trees]}.get(kinds, [*linear, *trees])
    boosting = "boosted_trees" if classes > 2 or size == 2 else "gradient_boosting"
    if kinds == "text":
        return ["logistic_regression", "linear_svc", "naive_bayes"]
    if kinds == "temporal":
        return ["random_forest", boosting, *(["logistic_regression", "decision_tree"] if size == 0 else [])]
    if kinds == "categorical":
        return ["logistic_regression", *(["decision_tree", boosting] if size == 0 else ["random_forest", boosting])]
    if kinds == "numeric":
        return ["logistic_regression", "linear_svc", *(["decision_tree", "naive_bayes"] if size == 0 else ["random_forest"]), boosting]
    return ["random_forest", "logistic_regression", boosting]


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Centres columns and divides them by their population deviations (Spark's own scaler takes the sample's); one aggregate for all."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        columns = self.getInputCols()
        c = [F.col(f"`{x}`").cast("double") for x in columns]
        r = dataset.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(c)]).first()
        made = ", ".join(f"(`{x}` - {(r[f'm{i}'] or 0.0)!r}D) / {(r[f's{i}'] or 1.0)!r}D AS `{y}`" for i, (x, y) in enumerate(zip(columns, self.getOutputCols(), strict=True)))
        return SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting of small trees for any number of classes, by weights of rows.

    Each round fits a tree to weighted rows.  With K classes and the weighted
    share e of its misses, the tree's say is ln((1 - e) / e) + ln(K - 1), and the
    rows that it misses weigh exp(say) times as much from then on; rounds end when
    a tree is no better than a guess, or misses nothing.  Weights are expressions
    over the trees so far, so no table of weights is kept.  The fitted model is a
    pipeline of trees and a vote in SQL.
    """

    rounds = Param(Params._dummy(), "rounds", "trees at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rounds: int = 20, maxDepth: int = 3, seed: int = 42):
        super().__init__()
        self._setDefault(rounds=20, maxDepth=3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        rows = dataset.select(F.col(features), F.col(label).cast("double").alias(label)).persist()
        classes = int(rows.agg(F.max(label)).first()[0] or 0) + 1
        trees, says, weighted = [], [], rows.withColumn("__w", F.lit(1.0))
        for i in range(self.getOrDefault(self.rounds)):
            tree = DecisionTreeClassifier(
                featuresCol=features, labelCol=label, weightCol="__w", maxDepth=self.getOrDefault(self.maxDepth), seed=self.getSeed() + i, predictionCol=f"__t{i}", rawPredictionCol=f"__r{i}", probabilityCol=f"__p{i}"
            ).fit(weighted)
            missed = tree.transform(weighted).withColumn("__miss", (F.col(f"__t{i}") != F.col(label)).cast("double"))
            error = missed.agg(F.sum(F.col("__w") * F.col("__miss")) / F.sum("__w")).first()[0] or 0.0
            say = boosting_say(error, classes)
            if say <= 0 and trees:
                break
            trees.append(tree)
            says.append(max(say, 1e-6))
            if error <= 0 or say <= 0:
                break
            weighted = missed.select(features, label, (F.col("__w") * F.exp(F.col("__miss") * say)).alias("__w"))
        rows.unpersist()
        votes = ", ".join(" + ".join(f"IF(__t{i} = {c}, {say!r}D, 0D)" for i, say in enumerate(says)) for c in range(classes))
        made = ", ".join(f"__{k}{i}" for i in range(len(trees)) for k in "trp")
        vote = SQLTransformer(statement=f"SELECT * EXCEPT (__votes), CAST(array_position(__votes, array_max(__votes)) - 1 AS DOUBLE) AS {self.getPredictionCol()} FROM (SELECT * EXCEPT ({made}), array({votes}) AS __votes FROM __THIS__)")
        return PipelineModel(stages=[*trees, vote])


def boosting_say(error: float, classes: int) -> float:
    """Weight of a tree's vote by its weighted share of misses; zero or less where it is no better than a guess."""
    error = min(max(error, 1e-10), 1 - 1e-10)
    return math.log((1 - error) / error) + math.log(max(1, classes - 1))


def preprocessing(numeric: list[str], categorical: list[str], text: tuple[tuple[str, str, int], ...] = ()) -> list:
    """Mean imputation and scaling of numbers, indexed one-hot categories with a place for unseen ones, and vectors of texts (column, method, size)."""
    stages = []
    if numeric:
        stages += [
            Imputer(inputCols=numeric, outputCols=[f"{c}__f" for c in numeric]),
            PopulationScaler(inputCols=[f"{c}__f" for c in numeric], outputCols=[f"{c}__s" for c in numeric]),
            VectorAssembler(inputCols=[f"{c}__s" for c in numeric], outputCol="__scaled"),
        ]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__h" for c in categorical], handleInvalid="keep"),
        ]
    stages += [text_features(*t) for t in text]
    inputs = (["__scaled"] if numeric else []) + [f"{c}__h" for c in categorical] + [f"{c}_vector" for c, _, _ in text]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def train(df: DataFrame, label: str, numeric: list[str], categorical: list[str], model: str, task: str) -> PipelineModel:
    table = CLASSIFIERS if task == "classification" else REGRESSORS
    rows = df.withColumn("label", F.col(label).cast("double")).where("label is not null")
    return Pipeline(stages=[*preprocessing(numeric, categorical), table[model]()]).fit(rows)


#: What a search may set, by model; those of a classifier within one-against-the-rest are its own.
SEARCH: dict[str, Space] = {
    "logistic_regression": {"regParam": Span(1e-5, 10, log=True), "elasticNetParam": Span(0, 1)},
    "random_forest": {"numTrees": Span(20, 100, whole=True), "maxDepth": Span(2, 12, whole=True), "minInstancesPerNode": Span(1, 10, whole=True)},
    "decision_tree": {"maxDepth": Span(2, 14, whole=True), "minInstancesPerNode": Span(1, 20, whole=True)},
    "naive_bayes": {"smoothing": Span(0.01, 10, log=True)},
    "gradient_boosting": {"maxIter": Span(10, 60, whole=True), "maxDepth": Span(2, 7, whole=True), "stepSize": Span(0.01, 0.3, log=True)},
    "linear_svc": {"regParam": Span(1e-5, 10, log=True)},
    "boosted_trees": {"rounds": Span(5, 40, whole=True), "maxDepth": Span(1, 6, whole=True)},
    "linear": {"regParam": Span(1e-6, 1, log=True)},
    "ridge": {"regParam": Span(1e-4, 100, log=True)},
    "lasso": {"regParam": Span(1e-5, 10, log=True)},
    "elastic_net": {"regParam": Span(1e-5, 10, log=True), "elasticNetParam": Span(0, 1)},
}


def trials_for(rows: int, models: int) -> int:
    """Trials for each model: 60, 120 or 180 by the number of rows, shared among the models, within 8 and 40."""
    total = 60 if rows <= 1_000 else 120 if rows <= 10_000 else 180
    return min(40, max(8, total // max(1, models)))


def judge_for(task: str):
    return MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2")


def estimator(model: str, task: str, params: dict | None = None) -> Estimator:
    """A registered model with parameters set."""
    made = (CLASSIFIERS if task == "classification" else REGRESSORS)[model]()
    (made.getClassifier() if isinstance(made, OneVsRest) else made)._set(**(params or {}))
    return made


@dataclass
class Tuned:
    """The best trial of a search, all of them, and the model fitted to all rows with its parameters."""

    params: dict
    score: float
    trials: list[Trial]
    bestModel: PipelineModel


def tune(df: DataFrame, label: str, numeric: list[str], categorical: list[str], model: str, task: str, trials: int = 8, folds: int = 3, seed: int = 42, text: tuple[tuple[str, str, int], ...] = ()) -> Tuned:
    """An adaptive search over a model's parameters, judged by folds; bad trials end before the last fold (see search.py).

    Rows belong to folds by a hash of their values.  Imputation, scaling and
    encoding are fitted to a fold's training rows alone, once, and serve all
    trials.
    """
    rows = df.withColumn("label", F.col(label).cast("double")).where("label is not null")
    place = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in (*numeric, *categorical, *[t[0] for t in text])], "label"), F.lit(folds))
    dealt, ready = rows.withColumn("__fold", place), []
    for i in range(folds):
        fitted = Pipeline(stages=preprocessing(numeric, categorical, text)).fit(dealt.where(F.col("__fold") != i))
        ready.append(fitted.transform(dealt).select("features", "label", (F.col("__fold") == i).alias("held")).persist())
    judge = judge_for(task)

    def scores(params: dict) -> Iterator[float]:
        for part in ready:
            yield judge.evaluate(estimator(model, task, params).fit(part.where("not held")).transform(part.where("held")))

    found = search(SEARCH[model], scores, trials, seed)
    for part in ready:
        part.unpersist()
    top = best(found)
    fitted = Pipeline(stages=[*preprocessing(numeric, categorical, text), estimator(model, task, top.params)]).fit(rows)
    return Tuned(top.params, top.score, found, fitted)


def ranked_models(train_rows: DataFrame, test_rows: DataFrame, label: str, numeric: list[str], categorical: list[str], names: list[str], task: str) -> list[tuple[str, float, PipelineModel]]:
    """Models trained on one part and judged on the other, best first; equal scores by name."""
    judge = judge_for(task)
    test = test_rows.withColumn("label", F.col(label).cast("double")).where("label is not null")
    found = []
    for name in names:
        model = train(train_rows, label, numeric, categorical, name, task)
        found.append((name, judge.evaluate(model.transform(test)), model))
    return sorted(found, key=lambda x: (-x[1], x[0]))


def top_k_for(rows: int) -> int:
    """Models that vote: three, four or five by the number of rows."""
    return 3 if rows < 1_000 else 4 if rows < 10_000 else 5


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report(name: str, task: str, features: list[str], rows: int, scores: DataFrame) -> dict:
    """What is kept of a trained model: its name, task, features, rows and figures (one row)."""
    return {"model": name, "task": task, "features": features, "rows": rows, "metrics": scores.first().asDict()}


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """prediction, and the confidence in it where the model gives probabilities."""
    out = model.transform(df)
    columns = [*keep, "prediction"]
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
        columns.append("confidence")
    return out.select(*columns)


def vote(models: list[PipelineModel], df: DataFrame, key: str, task: str, how: str = "soft") -> DataFrame:
    """Mean probabilities (soft), the most frequent class (hard; the smallest of equals) or, for numbers, the mean; all models in one plan."""
    out = df
    task = "hard" if task == "classification" and how == "hard" else task
    for i, m in enumerate(models):
        done = m.transform(out)
        value = vector_to_array("probability") if task == "classification" else F.col("prediction")
        out = done.select(*[F.col(f"`{c}`") for c in out.columns], value.alias(f"__m{i}"))
    names = [F.col(f"__m{i}") for i in range(len(models))]
    if task == "hard":
        said = F.array(*names)
        counted = F.transform(said, lambda p: F.struct(F.size(F.filter(said, lambda q: q == p)).alias("n"), (-p).alias("p")))
        best = F.array_max(counted)
        return out.select(key, (-best["p"]).alias("prediction"), (best["n"] / len(models)).alias("confidence"))
    if task != "classification":
        return out.select(key, (sum(names[1:], names[0]) / len(models)).alias("prediction"))
    mean = names[0]
    for n in names[1:]:
        mean = F.zip_with(mean, n, lambda a, b: a + b)
    best = F.array_max(mean)
    return out.select(key, (F.array_position(mean, best) - 1).cast("double").alias("prediction"), (best / len(models)).alias("confidence"))

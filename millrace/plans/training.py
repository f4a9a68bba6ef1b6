"""From a table to ranked, tuned and reported models in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import features, metrics, models

#: Strings of more words than this, on average, are texts; of more different values than MOST_CATEGORIES they are left out.
TEXT_WORDS, MOST_CATEGORIES = 3.0, 1000


@dataclass(frozen=True)
class Inputs:
    """Feature columns by how they are prepared; ``left_out`` names those that no model takes, and why."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    text: tuple[tuple[str, str, int], ...] = ()
    dates: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    booleans: tuple[str, ...] = ()
    left_out: dict[str, str] = field(default_factory=dict)

    def kinds(self) -> str:
        """numeric, categorical, text or temporal if all features are that, else mixed."""
        found = {k for k, c in (("numeric", self.numeric or self.booleans), ("categorical", self.categorical), ("text", self.text), ("temporal", self.dates or self.times)) if c}
        return found.pop() if len(found) == 1 else "mixed"


def inputs_of(df: DataFrame, label: str, key: str) -> Inputs:
    """How each column is prepared, from its type and, for strings, one aggregate over all of them."""
    found: dict[str, list] = {k: [] for k in ("numeric", "categorical", "text", "dates", "times", "booleans")}
    left_out: dict[str, str] = {}
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (label, key)]
    facts = {}
    if strings:
        words = lambda c: F.size(F.split(F.trim(F.col(f"`{c}`")), r"\s+"))
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.approx_count_distinct(f"`{c}`").alias("k"), F.avg(words(c)).alias("w"), F.avg(F.length(f"`{c}`")).alias("l")).alias(f"f{i}") for i, c in enumerate(strings)]).first()
        facts = {c: (row["n"], row[f"f{i}"]) for i, c in enumerate(strings)}
    for f in df.schema.fields:
        if f.name in (label, key):
            continue
        if isinstance(f.dataType, T.NumericType):
            found["numeric"].append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            found["booleans"].append(f.name)
        elif isinstance(f.dataType, T.DateType):
            found["dates"].append(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            found["times"].append(f.name)
        elif f.name in facts:
            n, fact = facts[f.name]
            if not fact["k"]:
                left_out[f.name] = "no values"
            elif (fact["w"] or 0) > TEXT_WORDS:
                found["text"].append((f.name, *features.text_method(n, fact["l"])))
            elif fact["k"] <= MOST_CATEGORIES:
                found["categorical"].append(f.name)
            else:
                left_out[f.name] = "too many different values"
        else:
            left_out[f.name] = f"type {f.dataType.simpleString()}"
    return Inputs(*(tuple(found[k]) for k in ("numeric", "categorical", "text", "dates", "times", "booleans")), left_out)


def prepared(df: DataFrame, inputs: Inputs) -> tuple[DataFrame, list[str], list[str]]:
    """The table with parts of dates and times and booleans as numbers, and its numeric and categorical features."""
    before, out = set(df.columns), df
    for c in (*inputs.dates, *inputs.times):
        out = features.date_parts(out, c)
    for c in inputs.times:
        out = features.time_parts(out, c)
    out = out.withColumns({f"{c}__flag": F.col(f"`{c}`").cast("double") for c in inputs.booleans})
    if inputs.text:
        out = out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c, _, _ in inputs.text})
    return out, [*inputs.numeric, *[c for c in out.columns if c not in before]], list(inputs.categorical)


@dataclass
class Trained:
    """Models best first (name, score on the test rows, tuned model), the plan of inputs, and the report."""

    models: list[tuple[str, float, models.Tuned]]
    inputs: Inputs
    task: str
    report: dict

    @property
    def best(self) -> PipelineModel:
        return self.models[0][2].bestModel

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return models.predict(self.best, prepared(df, self.inputs)[0], keep)

    def vote(self, df: DataFrame, key: str, k: int | None = None) -> DataFrame:
        """The ensemble's word: the most frequent class, or the mean."""
        chosen = [m.bestModel for _, _, m in self.models[: k or models.top_k_for(self.report["rows"])]]
        return models.vote(chosen, prepared(df, self.inputs)[0], key, self.task, how="hard")


def train_table(df: DataFrame, label: str, key: str, names: list[str] | None = None, trials: int | None = None, seed: int = 42) -> Trained:
    """Split, candidates by task, size and kind of features, a tuned search for each, ranking on held-out rows, and a report.

    Labels of classes are numbers from 0.  Rows without a label are left out.
    Whatever is fitted (imputation, scaling, vocabularies, encoders, parameters)
    sees training rows only.  With the same rows and seed the result is the same.
    """
    rows = df.where(F.col(f"`{label}`").isNotNull())
    n = rows.count()
    task = features.task_for(rows, label)
    inputs = inputs_of(rows, label, key)
    ready, numeric, categorical = prepared(rows, inputs)
    dealt = features.split(ready, key, label if task == "classification" else None, seed=seed).persist()
    train, test = dealt.where("not is_test"), dealt.where("is_test").withColumn("label", F.col(f"`{label}`").cast("double"))
    classes = rows.select(label).distinct().count() if task == "classification" else 0
    names = names or models.candidates_for(task, n, inputs.kinds(), classes)
    judge, found = models.judge_for(task), []
    for name in names:
        tuned = models.tune(train, label, numeric, categorical, name, task, trials or models.trials_for(n, len(names)), seed=seed, text=inputs.text)
        found.append((name, judge.evaluate(tuned.bestModel.transform(test)), tuned))
    found.sort(key=lambda x: (-x[1], x[0]))
    said = found[0][2].bestModel.transform(test)
    scores = (metrics.classification_metrics(said, "label", "prediction") if task == "classification" else metrics.regression_metrics(said, "label", "prediction")).first().asDict()
    if "probability" in said.columns:
        scores |= metrics.multiclass_metrics(said.withColumn("__p", vector_to_array("probability")), "label", "__p").first().asDict()
    ranking = [{"model": name, "score": score, "validation": t.score, "params": t.params, "trials": len(t.trials), "pruned": sum(x.pruned for x in t.trials)} for name, score, t in found]
    report = {"task": task, "rows": n, "classes": classes, "features": {"numeric": numeric, "categorical": categorical, "text": [c for c, _, _ in inputs.text], "left_out": inputs.left_out}, "ranking": ranking, "metrics": scores}
    dealt.unpersist()
    return Trained(found, inputs, task, report)

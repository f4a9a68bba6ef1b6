"""Model metrics from grouped counts and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ordered import with_numbers, with_running
from millrace.operators.quantiles import exact_quantile_columns
from millrace.operators.stats import histogram


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """By class: support, precision, recall, f1, f2, jaccard and specificity, from the confusion counts."""
    return _classes(confusion(df, label, prediction)).select("class", F.col("t").cast("long").alias("support"), *[F.bround(c, 8).alias(c) for c in ("precision", "recall", "f1", "f2", "jaccard", "specificity")])


def _classes(m: DataFrame) -> DataFrame:
    """A row a class: t (true), hit, said (predicted), n (all) and its scores."""
    by_label = m.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    by_prediction = m.groupBy(F.col("prediction").alias("p")).agg(F.sum("n").alias("said"))
    rows = by_label.join(by_prediction, F.col("c") == F.col("p"), "outer").select(F.coalesce("c", "p").alias("class"), *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("t", "hit", "said")])
    rows = rows.withColumn("n", F.sum("t").over(Window.partitionBy()))  # over classes, not rows
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    hit, t, said, n = (F.col(x) for x in ("hit", "t", "said", "n"))
    rows = rows.withColumn("precision", part(hit, said)).withColumn("recall", part(hit, t))
    f = lambda b: part((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall"))
    return rows.withColumn("f1", f(1)).withColumn("f2", f(2)).withColumn("jaccard", part(hit, t + said - hit)).withColumn("specificity", part(n - t - said + hit, n - t))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro, weighted and micro scores, F2, Jaccard, specificity, Matthews, kappa, from the confusion counts."""
    rows = _classes(confusion(df, label, prediction))
    t, hit, said = F.col("t"), F.col("hit"), F.col("said")
    a = rows.agg(
        F.sum("t").alias("n"), F.sum("hit").alias("hit"), F.sum(t * said).alias("ts"), F.sum(t * t).alias("tt"), F.sum(said * said).alias("ss"), F.sum("said").alias("said"),
        *[F.avg(x).alias(f"{x}_macro") for x in ("precision", "recall", "f1", "f2", "jaccard", "specificity")],
        *[(F.sum(F.col(x) * t) / F.sum("t")).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")],
        F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"),
    )
    n, hit, ts = F.col("n"), F.col("hit"), F.col("ts")
    mcc = (n * hit - ts) / F.nullif(F.sqrt(n * n - F.col("ss")) * F.sqrt(n * n - F.col("tt")), F.lit(0.0))
    kappa = (hit / n - ts / (n * n)) / F.nullif(1 - ts / (n * n), F.lit(0.0))
    micro_p, micro_r = hit / F.nullif("said", F.lit(0.0)), hit / n
    values = {"accuracy": hit / n, "hamming_loss": 1 - hit / n, "mcc": F.coalesce(mcc, F.lit(0.0)), "kappa": F.coalesce(kappa, F.lit(0.0))}
    values |= {"precision_micro": micro_p, "recall_micro": micro_r, "f1_micro": 2 * micro_p * micro_r / F.nullif(micro_p + micro_r, F.lit(0.0))}
    values |= {c: F.col(c) for c in a.columns if c.endswith(("_macro", "_weighted")) or c == "balanced_accuracy"}
    return a.select(*[F.bround(v, 8).alias(k) for k, v in values.items()])


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2, errors, explained variance, percentage errors and residuals' moments, in one aggregate, and the median error by selection."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.select(y.alias("y"), p.alias("p"), (y - p).alias("e")).where("y is not null and p is not null")
    e, ae = F.col("e"), F.abs("e")
    a = rows.agg(
        F.avg(ae).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("r2"), (1 - F.var_pop("e") / F.var_pop("y")).alias("explained_variance"),
        F.avg(F.when(F.col("y") != 0, ae / F.abs("y"))).alias("mape"), F.avg(2 * ae / F.nullif(F.abs("y") + F.abs("p"), F.lit(0.0))).alias("smape"),
        F.avg("e").alias("residual_mean"), F.stddev_pop("e").alias("residual_std"),
    )
    a = a.withColumn("median_ae", exact_quantile_columns(rows, {"e": ae}, (0.5,))["e"][0])
    return a.select(*[F.bround(c, 6).alias(c) for c in a.columns])


def regression_extras(df: DataFrame, label: str, prediction: str, features: int) -> DataFrame:
    """R2 adjusted for the number of features, and the root mean squared log error (null where a value is below zero)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.select(y.alias("y"), p.alias("p")).where("y is not null and p is not null")
    log = F.when((F.col("y") >= 0) & (F.col("p") >= 0), F.pow(F.log1p("p") - F.log1p("y"), 2))
    a = rows.agg(
        F.count("y").alias("n"), (1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        F.when(F.count(log) == F.count("y"), F.sqrt(F.avg(log))).alias("rmsle"),
    )
    adjusted = F.when(F.col("n") > features + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - features - 1))
    return a.select(F.bround(adjusted, 6).alias("adjusted_r2"), F.bround("rmsle", 6).alias("rmsle"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 20) -> DataFrame:
    return histogram(df.select((F.col(label) - F.col(prediction)).alias("residual")), "residual", bins)


def evenly_spaced(df: DataFrame, order: str, n: int = 200, ties: list[str] | None = None) -> DataFrame:
    """``n`` rows at even steps of the order (all, if fewer): rows are numbered within ranges of the order, not in one task."""
    numbered = with_numbers(df, order, ties=ties)
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__total")))  # one row
    place = F.col("__r") - 1
    step = F.greatest(F.col("__total").cast("double"), F.lit(float(n)))
    chosen = F.floor((place + 1) * n / step) > F.floor(place * n / step)
    return numbered.join(total).where(chosen).drop("__r", "__total")


def _binary(label: str) -> Column:
    """The label as 0 or 1; another one is an error."""
    c = F.col(label)
    return F.when(c.isNull() | c.cast("double").isin(0.0, 1.0), c.cast("long")).otherwise(F.raise_error(F.concat(F.lit("the label must be 0 or 1, not "), c.cast("string"))).cast("long"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """s, pos, neg, and how many of each stand at greater scores (pos_above, neg_above).

    Sums run within ranges of the distinct scores.
    """
    hit = _binary(label)
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    return with_running(by, {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, "s", ties=[], descending=True)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts by distinct score, ties counted half."""
    a = _by_score(df, label, score).agg(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(F.bround(F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 8).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve: precision at each distinct score, weighted by the recall it adds."""
    rows = _by_score(df, label, score)
    found, said = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    a = rows.agg(F.sum(F.col("pos") * found / said).alias("a"), F.sum("pos").alias("p"))
    return a.select(F.bround(F.col("a") / F.nullif("p", F.lit(0)), 8).alias("pr_auc"))


def log_loss(df: DataFrame, label: str, probability: str, least: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood of a binary label."""
    p = F.least(F.greatest(F.col(probability).cast("double"), F.lit(least)), F.lit(1 - least))
    loss = -F.log(F.when(_binary(label) == 1, p).otherwise(1 - p))
    return df.where(F.col(label).isNotNull()).agg(F.bround(F.avg(loss), 8).alias("log_loss"))


def multiclass_metrics(df: DataFrame, label: str, probabilities: str, least: float = 1e-15) -> DataFrame:
    """Metrics of an array of probabilities by class, whose place is the label: log_loss, and the areas under the ROC and the
    precision-recall curve of each class against the others, as plain means (macro) and weighted by the classes' rows.

    Classes that have no row, or all rows, take no part in the means.  One row
    per row and class is counted by score; sums run along the scores of all
    classes at once.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(probabilities).alias("p"))
    own = F.least(F.greatest(F.get("p", F.col("y")), F.lit(least)), F.lit(1 - least))
    loss = rows.agg(F.bround(F.avg(-F.log(own)), 8).alias("log_loss"))
    each = rows.select("y", F.posexplode("p").alias("c", "s"))
    by = each.groupBy("c", "s").agg(F.count_if(F.col("y") == F.col("c")).alias("pos"), F.count_if(F.col("y") != F.col("c")).alias("neg"))
    ranked = with_running(by, {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, "s", ["c"], ties=[], descending=True)
    found, said = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    classes = ranked.groupBy("c").agg(
        F.sum("pos").alias("n"), F.sum("neg").alias("rest"), F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * found / said).alias("a")
    )
    classes = classes.where("n > 0 and rest > 0").select("n", (F.col("u") / (F.col("n") * F.col("rest"))).alias("roc"), (F.col("a") / F.col("n")).alias("pr"))
    means = [F.bround(F.avg(k), 8).alias(f"{k}_auc_macro") for k in ("roc", "pr")] + [F.bround(F.sum(F.col(k) * F.col("n")) / F.sum("n"), 8).alias(f"{k}_auc_weighted") for k in ("roc", "pr")]
    return classes.agg(*means).join(F.broadcast(loss))  # one row each


def top_k_accuracy(df: DataFrame, label: str, probabilities: str, k: int = 3) -> DataFrame:
    """Share of rows whose label, an index, is among the ``k`` greatest of an array of probabilities (the first of equals)."""
    own = F.get(probabilities, F.col(label).cast("int"))
    place = F.size(F.filter(F.transform(probabilities, lambda x, i: F.struct(x.alias("p"), i.alias("i"))), lambda x: (x["p"] > own) | ((x["p"] == own) & (x["i"] < F.col(label)))))
    return df.where(F.col(label).isNotNull()).agg(F.bround(F.avg((place < k).cast("int")), 8).alias("top_k_accuracy"))

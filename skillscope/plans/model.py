"""Expertise model and its evaluation (C9; M1-M14, A11, A12, D1).

The reference collects the training set to one process and fits there.  Here
the fit is Newton's method over aggregates of the training rows; scoring,
metrics, the confusion matrix and the correlation matrix are lazy DataFrame
expressions and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FIXED_INTERCEPT, FIXED_WEIGHTS, HOLDOUT_FRACTION, LOGISTIC_C
from ..operators.ranking import RankSpec, ordinal, rank_columns
from ..operators.sampling import hash_split
from ..session import materialize

# Model inputs in the reference's order; the user-level kernel score is
# named UserKernelScore here (Q23).
FEATURES = ["NumFollowers", "TotalMedals", "KernelsCreated", "UserKernelScore", "Ranked"]


def category_index(df: DataFrame, col: str) -> DataFrame:
    """(value, index, n) of the distinct non-null values of a column: index 0 is
    the most frequent, ties by value.  The order comes from the distributed
    ranker, so there may be any number of categories."""
    counts = df.filter(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("_order", F.struct((-F.col("n")).alias("n"), "value"))
    return ordinal(counts, "_order", "_place").select("value", (F.col("_place") - 1).cast("int").alias("index"), "n")


def encode_categorical(df: DataFrame, col: str, index: DataFrame | None = None) -> DataFrame:
    """Adds ``<col>_index`` (see :func:`category_index`; null for a null
    or unknown value) and ``<col>_vector``, the one-hot vector in sparse form:
    (size, indices, values) with one entry, or none for a null.  No column for a
    category, so it serves any number of them.  ``index``: that of the training rows."""
    index = index if index is not None else category_index(df, col)
    size = index.agg(F.count(F.lit(1)).cast("int")).scalar()
    place = F.col(f"`{col}_index`")
    held = df.join(index.select(F.col("value").alias("_value"), F.col("index").alias(f"{col}_index")),
                   F.col(f"`{col}`") == F.col("_value"), "left").drop("_value")
    return held.withColumn(f"{col}_vector", F.struct(
        size.alias("size"), F.array_compact(F.array(place)).alias("indices"),
        F.when(place.isNotNull(), F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values")))


def one_hot(df: DataFrame, col: str, categories: list | None = None) -> DataFrame:
    """A string column becomes one named 0/1 column per category
    (``<col>_<category>``; a null has 0 in all of them): the readable form for a
    handful of categories, which are looked up if they are not given.
    :func:`encode_categorical` is the form for any number of them."""
    if categories is None:
        categories = sorted(r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).collect())
    keep = [F.col(c) for c in df.columns if c != col]
    return df.select(*keep, *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in categories])


def assemble(df: DataFrame, features=FEATURES) -> DataFrame:
    """M1: the feature vector."""
    cast = df.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    vec = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features", handleInvalid="keep")
    return vec.transform(cast).drop(*[f"_f_{c}" for c in features])


def holdout_split(df: DataFrame, fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    """Deterministic 80/20 split by user hash (column ``is_holdout``)."""
    return hash_split(df, "UserId", fraction)


@dataclass(frozen=True)
class LogisticModel:
    """A fitted model: one weight a feature, and the intercept."""
    intercept: float
    weights: tuple


def _moments(features) -> list[str]:
    """SQL aggregates of one Newton round over the columns x1..xn (x0 = 1), y and z (the linear predictor): the summed
    loss, the gradient, and the upper half of the Gram matrix weighted by p (1 - p)."""
    n = len(features) + 1
    p = "(1 / (1 + exp(-z)))"
    # log(1 + exp(z)) - y z, written so that neither sign overflows
    loss = "sum(greatest(z, 0.0D) + log1p(exp(-abs(z))) - y * z) AS loss"
    gradient = [f"sum(({p} - y) * x{i}) AS g{i}" for i in range(n)]
    gram = [f"sum({p} * (1 - {p}) * x{i} * x{j}) AS h{i}_{j}" for i in range(n) for j in range(i, n)]
    return [loss, *gradient, *gram]


def fit(train: DataFrame, label: str = "Expert", c: float = LOGISTIC_C, features=FEATURES, rounds: int = 50,
        tolerance: float = 1e-10) -> LogisticModel:
    """M4: L2 logistic regression of the reference's library default: minimise
    0.5 * |w|^2 + C * (summed log loss), the intercept free.

    Newton's method.  A round is one aggregate over the training rows (loss,
    gradient and weighted Gram matrix, a few dozen sums whatever their number); the
    step, halved until the objective falls, is solved on the driver from these
    sums.  Rows with a null feature or label are left out; without rows all
    weights are 0."""
    cols = [F.lit(1.0).alias("x0"), *[F.col(f).cast("double").alias(f"x{i + 1}") for i, f in enumerate(features)]]
    # written once: every round reads the training rows
    data = materialize(train.select(*cols, F.col(label).cast("double").alias("y")).dropna())
    n = len(features) + 1
    ridge = np.diag([0.0] + [1.0] * (n - 1))
    sums = _moments(features)

    def state(w):
        z = " + ".join(f"{float(v)!r}D * x{i}" for i, v in enumerate(w))
        r = data.selectExpr("*", f"{z} AS z").selectExpr(*sums).first()
        gram = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                gram[i, j] = gram[j, i] = r[f"h{i}_{j}"] or 0.0
        gradient = np.array([r[f"g{i}"] or 0.0 for i in range(n)])
        return 0.5 * w @ ridge @ w + c * (r["loss"] or 0.0), c * gradient + ridge @ w, c * gram + ridge

    w = np.zeros(n)
    value, gradient, hessian = state(w)
    for _ in range(rounds):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if not np.abs(step).max() > tolerance * max(1.0, np.abs(w).max()):
            break
        for _ in range(40):
            after = state(w - step)
            if after[0] <= value + 1e-12 * abs(value):
                break
            step = step / 2
        w, (value, gradient, hessian) = w - step, after
    return LogisticModel(float(w[0]), tuple(float(v) for v in w[1:]))


def score(model: LogisticModel, df: DataFrame, features=FEATURES) -> DataFrame:
    """M5: hard prediction and class-1 probability for every row (row-aligned
    by construction, Q3)."""
    return linear_score(df, model.intercept, model.weights, features)


def coefficients(model: LogisticModel, spark, features=FEATURES) -> DataFrame:
    """M6: intercept and coefficients as a small DataFrame."""
    rows = [("intercept", model.intercept), *zip(features, model.weights)]
    return spark.createDataFrame(rows, "term string, weight double")


def linear_score(df: DataFrame, intercept: float = FIXED_INTERCEPT, weights=FIXED_WEIGHTS,
                 features=FEATURES) -> DataFrame:
    """Probability 1/(1+exp(-(b + w.x))) with given weights, and the 0.5
    threshold prediction; the SQL-checkable half of M5."""
    z = F.lit(float(intercept))
    for f, w in zip(features, weights):
        z = z + F.lit(float(w)) * F.col(f).cast("double")
    p = 1.0 / (1.0 + F.exp(-z))
    return df.withColumn("ExpertiseScore", p).withColumn("ExpertisePred", F.when(p > 0.5, 1).otherwise(0))


def binary_metrics(pred: DataFrame, label: str = "Expert", predicted: str = "ExpertisePred") -> DataFrame:
    """M7-M10 and the hard-label AUC (Q9, = (TPR + TNR) / 2) in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    tp = F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0))
    fp = F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0))
    fn = F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0))
    tn = F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0))
    g = pred.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"),
                 tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tpr = F.col("tp") / (F.col("tp") + F.col("fn"))
    tnr = F.col("tn") / (F.col("tn") + F.col("fp"))
    return g.select("mse", "accuracy",
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
                    .alias("precision"),
                    F.when(F.col("tp") + F.col("fn") > 0, tpr).otherwise(0.0).alias("recall"),
                    ((tpr + tnr) / 2).alias("auc_hard"))


def roc_auc(pred: DataFrame, label: str = "Expert", score_col: str = "ExpertiseScore") -> DataFrame:
    """ROC AUC from scores by the rank-sum (Mann-Whitney) statistic,
    with tied scores given their average rank; ranks come from the
    distributed ranker (no single-partition sort)."""
    ranked = rank_columns(pred.select(F.col(label).cast("int").alias("y"), F.col(score_col).alias("s")),
                          [RankSpec("s", "pct", "average_pct")])
    n = F.count(F.lit(1))
    g = ranked.agg(n.alias("n"), F.sum("y").alias("n1"),
                   F.sum(F.when(F.col("y") == 1, F.col("pct"))).alias("pct_sum"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    rank_sum = F.col("pct_sum") * F.col("n")
    return g.select(((rank_sum - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def confusion(pred: DataFrame, label: str = "Expert", predicted: str = "ExpertisePred") -> DataFrame:
    """The 2x2 counts (absent cells are 0)."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    cells = [F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).cast("long").alias(f"n_{a}{b}")
             for a in (0, 1) for b in (0, 1)]
    g = pred.agg(*cells)
    entries = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"n_{a}{b}").alias("n"))
               for a in (0, 1) for b in (0, 1)]
    return g.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregation, long
    format (a, b, corr), a < b in the given column order."""
    pairs = list(combinations(cols, 2))
    g = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                 for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
               for i, (a, b) in enumerate(pairs)]
    return g.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

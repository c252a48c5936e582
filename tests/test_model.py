"""The fitted model against Newton iterations written here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locations import SF_SMALL
from skillscope import catalog
from skillscope.plans import cohorts as co
from skillscope.plans import model as mo


def newton(x, y, c=1.0):
    """Maximum of the penalised likelihood: intercept free, 0.5 * |w|^2 + c * log loss."""
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + ridge, c * x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_fit_scores_and_metrics(spark):
    train = mo.holdout_split(co.model_inputs(catalog._cohorts(spark, SF_SMALL)["train"]))
    rows = train.filter("is_holdout = 0").select(*mo.FEATURES, "Expert").collect()
    data = np.array([[float(v) for v in r] for r in rows])
    want = newton(data[:, :-1], data[:, -1])
    got = {r.term: r.weight for r in catalog.m_coefficients(spark, SF_SMALL).collect()}
    assert [got[k] for k in ["intercept", *mo.FEATURES]] == pytest.approx(want.tolist(), abs=1e-5)

    scored = catalog.m_logistic_fit_score(spark, SF_SMALL).collect()
    users = {r.UserId: [float(r[f]) for f in mo.FEATURES] for r in catalog._population(spark, SF_SMALL).collect()}
    assert len(scored) == len(users)
    for r in scored:
        p = 1 / (1 + np.exp(-(want[0] + np.dot(want[1:], users[r.UserId]))))
        assert r.ExpertiseScore == pytest.approx(p, abs=1e-5)

    m = catalog.m_fitted_metrics(spark, SF_SMALL).first()
    assert m.accuracy == pytest.approx(1 - m.mse) and 0.5 <= m.auc <= 1
    top = catalog.c_fitted_search(spark, SF_SMALL)
    assert top.columns[:3] == ["Rank", "Name", "Expertise Score"] and top.filter(F.col("Expertise Score").isNull()).isEmpty()


def test_fit_of_odd_rows(spark):
    """Separable, one-sided, constant, null and no rows: the penalised optimum, or zero weights."""
    schema = "a double, b double, y int"

    def fit(rows):
        return mo.fit(spark.createDataFrame(rows, schema), "y", features=["a", "b"])

    rows = [(float(i), 1000.0, int(i > 5)) for i in range(12)] + [(None, 1.0, 1), (1.0, 2.0, None)]
    got = fit(rows)
    data = np.array([r for r in rows if None not in r], float)
    want = newton(data[:, :2] - [0, 1000], data[:, 2])     # a constant column only shifts the intercept
    assert got.weights[0] == pytest.approx(want[1], abs=1e-4)
    z = [got.intercept + got.weights[0] * a + got.weights[1] * b for a, b, _ in data.tolist()]
    assert [x > 0 for x in z] == [y == 1 for y in data[:, 2]]
    assert fit([]) == mo.LogisticModel(0.0, (0.0, 0.0))


def test_fifty_thousand_categories(spark):
    n = 50_000
    df = spark.range(3 * n).selectExpr("id", "CASE WHEN id < 2 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 50000) END AS cat")
    out = mo.encode_categorical(df, "cat")
    assert out.columns == ["id", "cat", "cat_index", "cat_vector"]
    facts = out.selectExpr("max(cat_vector.size) AS size", "max(cat_index) AS top", "count(DISTINCT cat_index) AS k",
                           "sum(size(cat_vector.indices)) AS hot", "max(IF(cat = 'hot', cat_index, 0)) AS first",
                           "bool_and(get(cat_vector.indices, 0) <=> cat_index) AS same").first()
    assert tuple(facts) == (n + 1, n, n + 1, 3 * n - 2, 0, True)
    index = mo.category_index(df, "cat").orderBy("index").limit(3).collect()
    assert [r["value"] for r in index][0] == "hot" and index[1]["n"] >= index[2]["n"]
    unknown = spark.createDataFrame([(1, "new"), (2, None), (3, "hot")], "id long, cat string")
    held = mo.encode_categorical(unknown, "cat", mo.category_index(df, "cat")).orderBy("id").collect()
    assert [r["cat_index"] for r in held] == [None, None, 0] and [len(r["cat_vector"]["values"]) for r in held] == [0, 0, 1]

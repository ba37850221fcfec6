"""Models against row-level numpy computations."""

import numpy as np
import pytest

from facetframe.errors import ValidationError
from facetframe.operators import design
from facetframe.operators import regression as R
from facetframe.schema import INDEX, Column, TableSchema

ORDER = ("low", "mid", "high")
SCHEMA = TableSchema.of(
    Column("y", "continuous"), Column("a", "boolean"), Column("b", "boolean"), Column("hit", "boolean"),
    Column("level", "ordered-categorical", category_order=ORDER, categories=ORDER), Column("kind", "categorical"),
)
GROUPS = [{"name": n, "filter": {"type": "is_true", "target": n}} for n in "ab"]
KINDS = [{"name": k, "filter": {"type": "equal_to", "target": "kind", "value": k}} for k in "uvw"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 900
    a, b = rng.random(n) < 0.4, rng.random(n) < 0.5
    y = 2 + 1.5 * a - b + rng.normal(size=n) * (1 + a)
    hit = rng.random(n) < 1 / (1 + np.exp(-(0.3 + a - 0.5 * b)))
    level = np.digitize(a - 0.7 * b + rng.logistic(size=n), [-0.5, 1.0])
    kind = rng.integers(0, 3, n)
    return a, b, y, hit, level, kind


@pytest.fixture(scope="module")
def df(spark, data):
    a, b, y, hit, level, kind = data
    rows = [(i, float(y[i]), bool(a[i]), bool(b[i]), bool(hit[i]), ORDER[level[i]], "uvw"[kind[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, f"`{INDEX}` long, y double, a boolean, b boolean, hit boolean, level string, kind string").cache()


@pytest.fixture(params=["driver", "tasks"])
def where(request, monkeypatch):
    """Sums over the pattern table on the driver, and inside Spark tasks."""
    if request.param == "tasks":
        monkeypatch.setattr(design, "LOCAL_PATTERNS", 1)
    return request.param


def values(model, column="value"):
    return [r[column] for r in model.coefficients.collect()]


def design_of(data):
    return np.column_stack([np.ones(len(data[0])), data[0], data[1]]).astype(float)


def test_linear_hc3(df, data, where):
    x, y = design_of(data), data[2]
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    cov = inverse @ (x.T @ (x * ((e / (1 - h)) ** 2)[:, None])) @ inverse
    model = R.linear_regression(df, SCHEMA, GROUPS, "y", "relative_to_baseline")
    assert values(model) == pytest.approx(beta)
    assert values(model, "std_err") == pytest.approx(np.sqrt(np.diag(cov)))
    n, q = x.shape
    fit = model.fit_evaluation.first()
    assert fit["f_statistic"] == pytest.approx(beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:]) / 2)
    assert fit["rmse"] == pytest.approx(np.sqrt(e @ e / (n - q)))
    assert fit["r_squared"] == pytest.approx(1 - (e @ e / (n - q)) / (y.var() * n / (n - 1)))


def test_linear_standardized(df, data):
    x, y = design_of(data), data[2]
    z = (y - y.mean()) / y.std()
    model = R.linear_regression(df, SCHEMA, GROUPS, "y", "relative_to_baseline", standardized=True)
    assert values(model) == pytest.approx(np.linalg.lstsq(x, z, rcond=None)[0])


def test_logistic_solves_the_score_equations(df, data, where):
    x, hit = design_of(data), data[3].astype(float)
    model = R.logistic_regression(df, SCHEMA, GROUPS, "hit", "relative_to_baseline")
    p = 1 / (1 + np.exp(-x @ model.theta))
    assert x.T @ (hit - p) == pytest.approx(np.zeros(3), abs=1e-5)
    bread = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
    meat = x.T @ (x * ((hit - p) ** 2)[:, None])
    assert values(model, "std_err") == pytest.approx(np.sqrt(np.diag(bread @ meat @ bread)))
    effects = [r["value"] for r in model.marginal_effects.collect()]
    for j in (1, 2):
        on, off = x.copy(), x.copy()
        on[:, j], off[:, j] = 1, 0
        change = (1 / (1 + np.exp(-on @ model.theta)) - 1 / (1 + np.exp(-off @ model.theta))).mean()
        assert effects[j - 1] == pytest.approx(change)


def test_logistic_penalty_meets_the_subgradient_condition(df, data):
    x, hit, alpha = design_of(data), data[3].astype(float), 25.0
    theta = R.logistic_regression(df, SCHEMA, GROUPS, "hit", "relative_to_baseline", penalty=alpha).theta
    gradient = x.T @ (hit - 1 / (1 + np.exp(-x @ theta)))
    for g, t in zip(gradient, theta):
        if t == 0:
            assert abs(g) <= alpha + 1e-4
        else:
            assert g == pytest.approx(alpha * np.sign(t), abs=1e-3)


def test_multinomial_score_equations(df, data, where):
    x, level = design_of(data), data[4]
    model = R.multinomial_regression(df, SCHEMA, GROUPS, "level", "relative_to_baseline", reference_level="mid")
    assert model.levels == ["mid", "low", "high"]
    eta = np.column_stack([np.zeros(len(x)), x @ model.theta.reshape(2, 3).T])
    p = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    y = np.array([{1: 0, 0: 1, 2: 2}[v] for v in level])
    hit = np.eye(3)[y]
    assert x.T @ (hit - p) == pytest.approx(np.zeros((3, 3)), abs=1e-4)
    effects = {(r["level"], r["variable"]): r["value"] for r in model.marginal_effects.collect()}
    for variable in "ab":
        assert sum(effects[level, variable] for level in ORDER) == pytest.approx(0, abs=1e-9)


def test_ordinal_maximum(df, data, where):
    x, level = design_of(data)[:, 1:], data[4]
    model = R.ordinal_regression(df, SCHEMA, GROUPS, "level", "relative_to_baseline")

    def log_likelihood(theta):
        cuts = np.concatenate([[-np.inf], theta[2:], [np.inf]])
        eta = x @ theta[:2]
        cdf = lambda v: 1 / (1 + np.exp(-v))
        return np.log(cdf(cuts[level + 1] - eta) - cdf(cuts[level] - eta)).sum()

    best = log_likelihood(model.theta)
    assert model.fit["log_likelihood"] == pytest.approx(best)
    for j in range(4):
        for step in (-1e-3, 1e-3):
            moved = model.theta.copy()
            moved[j] += step
            assert log_likelihood(moved) < best
    probabilities = [r["prediction"] for r in model.predictions.collect() if r["variable"] == "Baseline"]
    assert sum(probabilities) == pytest.approx(1)


def test_grand_mean_coefficients_sum_to_zero(df):
    for fit, target in ((R.linear_regression, "y"), (R.logistic_regression, "hit")):
        model = fit(df, SCHEMA, KINDS, target, "grand_mean_deviation", "v")
        rows = model.coefficients.collect()
        assert [r["variable"] for r in rows] == ["Baseline", "u", "v", "w"]
        assert sum(r["value"] for r in rows[1:]) == pytest.approx(0, abs=1e-9)
    effects = R.logistic_regression(df, SCHEMA, KINDS, "hit", "grand_mean_deviation").marginal_effects.collect()
    assert [r["variable"] for r in effects] == ["u", "v", "w"]
    assert effects[2]["ci_low"] < effects[2]["value"] < effects[2]["ci_high"]


def test_score_matches_profiles(df):
    model = R.ordinal_regression(df, SCHEMA, GROUPS, "level", "relative_to_baseline")
    row = R.score(df.filter("a AND NOT b"), SCHEMA, model).first()
    profile = {r["level"]: r for r in model.predictions.filter("variable = 'a'").collect()}
    assert row["latent"] == pytest.approx(profile["low"]["latent"])
    assert {e["level"]: e["p"] for e in row["probabilities"]} == pytest.approx({k: v["prediction"] for k, v in profile.items()})


def test_requests_that_cannot_be_identified(df):
    with pytest.raises(ValidationError):  # overlapping groups have no reference
        R.linear_regression(df, SCHEMA, GROUPS, "y", "relative_to_reference", "a")
    with pytest.raises(ValidationError):  # exclusive groups have no baseline
        R.linear_regression(df, SCHEMA, KINDS, "y", "relative_to_baseline")
    with pytest.raises(ValidationError):  # a constant mask
        always = {"name": "all", "filter": {"type": "not_empty", "target": "y"}}
        R.linear_regression(df, SCHEMA, [GROUPS[0], always], "y", "relative_to_baseline")
    with pytest.raises(ValidationError):  # two levels only
        R.ordinal_regression(df, SCHEMA, GROUPS, KINDS[:2], "relative_to_baseline")
    with pytest.raises(ValidationError):  # levels that overlap
        R.multinomial_regression(df, SCHEMA, KINDS, [*GROUPS, KINDS[0]], "relative_to_reference", "u")
    with pytest.raises(ValidationError):
        R.linear_regression(df, SCHEMA, [{**GROUPS[0], "name": "const"}, GROUPS[1]], "y", "relative_to_baseline")


def test_constrained_rows(df, data):
    model = R.linear_regression(df, SCHEMA, KINDS[:2], "y", "relative_to_reference", "u", constrain=True)
    assert model.sample_size == int((data[5] < 2).sum())

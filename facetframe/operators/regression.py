"""Linear, logistic, multinomial and ordinal regression on group membership.

The distributed step is the design-pattern table (see ``design``). Coefficients
come from Newton steps whose gradients and information matrices are sums over
that table, the robust covariances likewise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import ValidationError
from ..filters import to_column
from ..functions import distributions as D
from ..schema import TableSchema
from .design import GRAND_MEAN, Coding, PatternTable, design_table, summarize
from .groups import Patterns

_COEFFICIENT = (
    "level string, variable string, value double, std_err double, statistic double, p_value double, "
    "ci_low double, ci_high double"
)
_PRECISION = {"year": "yyyy", "month": "MM yyyy", "date": "dd MM yyyy"}


@dataclass
class Model:
    """A fitted model. The frames are small: one row per coefficient, level or variable."""

    kind: str
    spark: SparkSession
    coding: Coding
    groups: list
    theta: np.ndarray
    covariance: np.ndarray
    levels: list[str]
    level_sizes: list[int]
    sample_size: int
    fit: dict[str, float]
    variables: list[tuple]
    coefficient_rows: list[tuple] = field(default_factory=list)
    effect_rows: list[tuple] = field(default_factory=list)
    prediction_rows: list[tuple] = field(default_factory=list)
    threshold_rows: list[tuple] = field(default_factory=list)

    @property
    def coefficients(self) -> DataFrame:
        frame = self.spark.createDataFrame(self.coefficient_rows, _COEFFICIENT)
        if self.kind == "linear":
            return frame.drop("level")
        return frame.withColumns({
            "odds_ratio": F.exp("value"), "odds_ci_low": F.exp("ci_low"), "odds_ci_high": F.exp("ci_high"),
        })

    @property
    def marginal_effects(self) -> DataFrame:
        return self.spark.createDataFrame(self.effect_rows, _COEFFICIENT)

    @property
    def fit_evaluation(self) -> DataFrame:
        names = list(self.fit)
        return self.spark.createDataFrame(
            [tuple(float(self.fit[n]) if math.isfinite(self.fit[n]) else None for n in names)], ", ".join(f"{n} double" for n in names)
        )

    @property
    def independent_variables(self) -> DataFrame:
        return self.spark.createDataFrame(self.variables, "name string, sample_size long, vif double")

    @property
    def level_info(self) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.levels, self.level_sizes)), "level string, sample_size long")

    @property
    def thresholds(self) -> DataFrame:
        return self.spark.createDataFrame(self.threshold_rows, "from_level string, to_level string, value double")

    @property
    def predictions(self) -> DataFrame:
        """Per profile (baseline and each variable) and level: the prediction."""
        return self.spark.createDataFrame(
            self.prediction_rows,
            "variable string, level string, prediction double, cumulative double, latent double",
        )


def _row(level, name, value, variance) -> tuple:
    if not (variance > 0 and math.isfinite(variance)):
        return (level, name, float(value), None, None, None, None, None)
    se = math.sqrt(variance)
    z = value / se
    return (
        level, name, float(value), se, float(z), D.normal_two_sided(z),
        float(value - D.Z975 * se), float(value + D.Z975 * se),
    )


def _coefficient_rows(coding: Coding, theta, covariance, level=None, intercept=True) -> list[tuple]:
    """Rows in group order; effect coding gets its omitted group back as minus the sum."""
    names = (["Baseline"] if intercept else []) + coding.variables
    rows = [_row(level, n, theta[i], covariance[i, i]) for i, n in enumerate(names)]
    if coding.interpretation == GRAND_MEAN:
        weights = -np.ones(len(names))
        if intercept:
            weights[0] = 0.0
        omitted = _row(level, coding.reference, weights @ theta, weights @ covariance @ weights)
        rows.insert(coding.names.index(coding.reference) + (1 if intercept else 0), omitted)
    return rows


def _effect_rows(coding: Coding, effects, covariance, level=None) -> list[tuple]:
    rows = [_row(level, n, effects[i], covariance[i, i]) for i, n in enumerate(coding.variables)]
    if coding.interpretation == GRAND_MEAN:
        weights = -np.ones(len(effects))
        omitted = _row(level, coding.reference, weights @ effects, weights @ covariance @ weights)
        rows.insert(coding.names.index(coding.reference), omitted)
    return rows


def _slope(function, theta, step=1e-5):
    """Central differences of a vector function of the parameters."""
    columns = []
    for j in range(len(theta)):
        h = np.zeros(len(theta))
        h[j] = step
        columns.append((function(theta + h) - function(theta - h)) / (2 * step))
    return np.array(columns).T


def _softmax(eta: np.ndarray) -> np.ndarray:
    """Probabilities of J levels from the J-1 predictors of the non-reference levels."""
    full = np.hstack([np.zeros((len(eta), 1)), eta])
    full = np.exp(full - full.max(axis=1, keepdims=True))
    return full / full.sum(axis=1, keepdims=True)


def _logit_terms(theta, x, y, n, levels):
    """Log-likelihood, score, information and the squared scores of a (multinomial) logit."""
    q = x.shape[1]
    p = _softmax(x @ theta.reshape(levels - 1, q).T)
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1.0
    log_likelihood = float((n * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    residual = (hit - p)[:, 1:]
    scores = (residual[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    information = np.zeros((len(theta), len(theta)))
    for a in range(levels - 1):
        for b in range(levels - 1):
            w = n * p[:, a + 1] * ((a == b) - p[:, b + 1])
            information[a * q:(a + 1) * q, b * q:(b + 1) * q] = x.T @ (x * w[:, None])
    return log_likelihood, scores.T @ n, information, scores.T @ (scores * n[:, None])


def _ordinal_terms(theta, x, y, n, levels):
    """The same four sums for proportional odds; the last levels-1 parameters are the cut points."""
    q = x.shape[1]
    eta = x @ theta[:q]
    cuts = theta[q:]
    sigmoid = lambda v: 1.0 / (1.0 + np.exp(-np.clip(v, -700, 700)))
    upper_in, lower_in = y < levels - 1, y > 0
    fu = np.where(upper_in, sigmoid(cuts[np.minimum(y, levels - 2)] - eta), 1.0)
    fl = np.where(lower_in, sigmoid(cuts[np.maximum(y - 1, 0)] - eta), 0.0)
    p = np.maximum(fu - fl, 1e-300)
    du, dl = fu * (1 - fu), fl * (1 - fl)
    su, sl = du * (1 - 2 * fu), dl * (1 - 2 * fl)
    # Directions in which the upper and the lower argument move.
    gu = np.zeros((len(x), len(theta)))
    gl = np.zeros((len(x), len(theta)))
    gu[:, :q] = gl[:, :q] = -x
    at = np.arange(len(x))
    gu[at[upper_in], q + y[upper_in]] = 1.0
    gl[at[lower_in], q + y[lower_in] - 1] = 1.0
    scores = (du[:, None] * gu - dl[:, None] * gl) / p[:, None]
    curve = gu.T @ (gu * (n * su / p)[:, None]) - gl.T @ (gl * (n * sl / p)[:, None])
    squares = scores.T @ (scores * n[:, None])
    return float((n * np.log(p)).sum()), scores.T @ n, squares - curve, squares


def _maximize(total, theta, iterations=100):
    """Damped Newton. ``total(theta)`` gives log-likelihood, score, information, squared scores."""
    value, score, information, squares = total(theta)
    converged = False
    for _ in range(iterations):
        if np.abs(score).max() < 1e-8 * max(1.0, abs(value)) ** 0.5:
            converged = True
            break
        step = np.linalg.lstsq(information, score, rcond=None)[0]
        size, moved = 1.0, False
        while size > 1e-8:
            candidate = total(theta + size * step)
            if np.isfinite(candidate[0]) and candidate[0] >= value - 1e-12 * abs(value):
                moved = True
                break
            size /= 2
        if not moved:
            converged = True
            break
        done = np.abs(size * step).max() < 1e-10 * max(1.0, np.abs(theta).max())
        theta = theta + size * step
        value, score, information, squares = candidate
        if done:
            converged = True
            break
    return theta, value, information, squares, converged


def _maximize_penalized(total, theta, alpha, iterations=500):
    """Log-likelihood minus alpha * |theta|_1, by coordinate descent on each Newton quadratic."""
    converged = False
    for _ in range(iterations):
        value, score, information, squares = total(theta)
        target = theta.copy()
        for _ in range(200):
            before = target.copy()
            for j in range(len(theta)):
                h = max(information[j, j], 1e-12)
                pull = score[j] - information[j] @ (target - theta) + h * target[j]
                target[j] = math.copysign(max(abs(pull) - alpha, 0.0), pull) / h
            if np.abs(target - before).max() < 1e-12:
                break
        goal = value - alpha * np.abs(theta).sum()
        size = 1.0
        while size > 1e-6:
            candidate = theta + size * (target - theta)
            if total(candidate)[0] - alpha * np.abs(candidate).sum() >= goal - 1e-12 * abs(goal):
                break
            size /= 2
        change = np.abs(size * (target - theta)).max()
        theta = theta + size * (target - theta)
        if change < 1e-9:
            converged = True
            break
    value, _, information, squares = total(theta)
    return theta, value, information, squares, converged


def _sums(table: PatternTable, coding: Coding, terms, levels: list[str], size: int):
    """Bind a model's row function to the table; the four sums travel as one vector."""
    index = {name: i for i, name in enumerate(levels)}

    def total(theta):
        def batch(bits, rows):
            keep = rows["level"].isin(index).to_numpy()
            y = rows["level"][keep].map(index).to_numpy(dtype=int)
            value, score, information, squares = terms(
                theta, coding.matrix(bits[keep]), y, rows["n"][keep].to_numpy(dtype=float), len(levels)
            )
            return np.concatenate([[value], score, information.ravel(), squares.ravel()])

        v = table.sum(batch)
        m = size * size
        return v[0], v[1:1 + size], v[1 + size:1 + size + m].reshape(size, size), v[1 + size + m:].reshape(size, size)

    return total


def _prepare(df, schema, groups, target, types, interpretation, reference, constrain, intercept):
    patterns = Patterns(groups, schema)
    coding = Coding([g.name for g in patterns.groups], interpretation, reference, intercept)
    table = PatternTable(design_table(df, schema, groups, target, constrain, types), patterns)
    size, info = summarize(table, coding)
    return patterns.groups, coding, table, size, info


def _level_sizes(table: PatternTable, schema: TableSchema, target) -> list[tuple[str, int]]:
    """Levels that occur, in level order, with their row counts."""
    if table.local is not None:
        rows = table.local.groupby(["level", "position"], as_index=False)["n"].sum()
        rows["position"] = [tuple(p) if hasattr(p, "__iter__") and not isinstance(p, str) else p for p in rows["position"]]
        found = sorted(((r.position, r.level, r.n) for r in rows.itertuples()), key=lambda r: r[0])
    else:
        frame = table.frame.groupBy("level", "position").agg(F.sum("n").alias("n")).orderBy("position")
        found = [(r["position"], r["level"], r["n"]) for r in frame.collect()]
    if isinstance(target, (list, tuple)) and any(p == -1 for p, _, _ in found):
        raise ValidationError("the levels of the target must be mutually exclusive")
    return [(level, int(n)) for _, level, n in found]


def level_names(schema: TableSchema, target, levels: list[str]) -> list[str]:
    """Calendar levels are shown in the precision of their column."""
    if not isinstance(target, str):
        return levels
    column = schema.get(target)
    if column.type != S.TEMPORAL or column.temporal_precision not in _PRECISION:
        return levels
    cut = {"year": lambda d: d[:4], "month": lambda d: f"{d[5:7]} {d[:4]}", "date": lambda d: f"{d[8:10]} {d[5:7]} {d[:4]}"}
    return [cut[column.temporal_precision](level) for level in levels]


def _likelihood_fit(value, null, parameters, model_dof, residual_dof, n, converged) -> dict[str, float]:
    ratio = 2 * (value - null)
    return {
        "converged": float(converged),
        "p_value": D.chi2_upper(ratio, model_dof) if model_dof > 0 else float("nan"),
        "model_dof": model_dof, "residual_dof": residual_dof,
        "pseudo_r_squared": 1 - value / null if null else float("nan"),
        "log_likelihood_ratio": ratio,
        "likelihood_ratio": math.exp(ratio / 2) if ratio < 1400 else float("nan"),
        "log_likelihood": value, "log_likelihood_null": null,
        "aic": -2 * value + 2 * parameters, "bic": -2 * value + math.log(n) * parameters,
    }


def linear_regression(
    df: DataFrame, schema: TableSchema, groups, target: str, interpretation: str, reference: str | None = None,
    constrain: bool = False, standardized: bool = False,
) -> Model:
    """Least squares with HC3 standard errors."""
    schema.get(target, (S.CONTINUOUS,))
    groups, coding, table, n, info = _prepare(
        df, schema, groups, target, (S.CONTINUOUS,), interpretation, reference, constrain, True
    )
    q = len(coding.variables) + 1
    first = table.sum(lambda bits, r: [(r["n"] * r["mean"]).sum()])
    center = first[0] / n

    def normal_equations(bits, rows):
        x, w = coding.matrix(bits), rows["n"].to_numpy(dtype=float)
        y = rows["mean"].to_numpy(dtype=float) - center
        return np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ (w * y), [(rows["m2"] + w * y * y).sum()]])

    v = table.sum(normal_equations)
    gram, xy, total_squares = v[:q * q].reshape(q, q), v[q * q:q * q + q], v[-1]
    scale = math.sqrt(total_squares / n) if standardized else 1.0
    inverse = np.linalg.inv(gram)
    beta = inverse @ xy

    def residuals(bits, rows):
        x, w = coding.matrix(bits), rows["n"].to_numpy(dtype=float)
        gap = rows["mean"].to_numpy(dtype=float) - center - x @ beta
        squared = rows["m2"].to_numpy(dtype=float) + w * gap * gap
        leverage = np.einsum("ij,jk,ik->i", x, inverse, x)
        weight = squared / np.maximum(1 - leverage, 1e-300) ** 2
        return np.concatenate([[squared.sum()], (x.T @ (x * weight[:, None])).ravel()])

    v = table.sum(residuals)
    rss, meat = v[0], v[1:].reshape(q, q)
    covariance = inverse @ meat @ inverse / scale**2
    rss, total_squares = rss / scale**2, total_squares / scale**2
    beta = beta / scale
    if not standardized:
        beta[0] += center
    dof = n - q
    wald = beta[1:] @ np.linalg.solve(covariance[1:, 1:], beta[1:]) / (q - 1) if q > 1 else float("nan")
    log_likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    fit = {
        "converged": 1.0, "f_statistic": wald, "model_dof": q - 1, "residual_dof": dof,
        "p_value": D.f_upper(wald, q - 1, dof) if q > 1 else float("nan"),
        "r_squared": 1 - (n - 1) / dof * (rss / total_squares), "rmse": math.sqrt(rss / dof),
        "log_likelihood": log_likelihood, "aic": -2 * log_likelihood + 2 * q,
        "bic": -2 * log_likelihood + math.log(n) * q,
    }
    names, x = coding.profiles()
    return Model(
        "linear", df.sparkSession, coding, groups, beta, covariance, [], [], n, fit, info,
        _coefficient_rows(coding, beta, covariance),
        prediction_rows=[(name, None, float(m), None, None) for name, m in zip(names, x @ beta)],
    )


def _null_log_likelihood(sizes: list[int]) -> float:
    n = sum(sizes)
    return sum(s * math.log(s / n) for s in sizes if s)


def _penalized_covariance(theta, information):
    """Inverse information of the coefficients that are not zero; undefined for the others."""
    live = np.abs(theta) > 1e-10
    covariance = np.full((len(theta), len(theta)), np.nan)
    covariance[np.ix_(live, live)] = np.linalg.inv(information[np.ix_(live, live)])
    return covariance


def _fit_logit(table, coding, levels, penalty):
    size = (len(coding.variables) + 1) * (len(levels) - 1)
    total = _sums(table, coding, _logit_terms, levels, size)
    if penalty is not None:
        theta, value, information, _, converged = _maximize_penalized(total, np.zeros(size), float(penalty))
        return theta, value, _penalized_covariance(theta, information), converged
    theta, value, information, squares, converged = _maximize(total, np.zeros(size))
    inverse = np.linalg.pinv(information)
    return theta, value, inverse @ squares @ inverse, converged


def _margins(table, coding, levels: int, n: int, discrete: bool):
    """Average marginal effects as a function of the parameters, level by level."""
    q = len(coding.variables) + 1

    def at(theta):
        b = theta.reshape(levels - 1, q)

        def batch(bits, rows):
            x, w = coding.matrix(bits), rows["n"].to_numpy(dtype=float)
            out = []
            if discrete:
                for j in range(1, q):
                    on, off = x.copy(), x.copy()
                    on[:, j], off[:, j] = 1.0, 0.0
                    out.append(w @ (_softmax(on @ b.T) - _softmax(off @ b.T)))
            else:
                p = _softmax(x @ b.T)
                full = np.vstack([np.zeros((1, q)), b])
                for j in range(1, q):
                    out.append(w @ (p * (full[:, j][None, :] - (p @ full[:, j])[:, None])))
            return np.array(out).T.ravel() / n  # level-major

        return table.sum(batch)

    return at


def logistic_regression(
    df: DataFrame, schema: TableSchema, groups, target, interpretation: str, reference: str | None = None,
    constrain: bool = False, penalty: float | None = None,
) -> Model:
    """Binary logit with HC0 standard errors; an L1 ``penalty`` covers the constant too."""
    groups, coding, table, n, info = _prepare(
        df, schema, groups, target, (S.BOOLEAN,), interpretation, reference, constrain, True
    )
    found = dict(_level_sizes(table, schema, target))
    sizes = [found.get("False", 0), found.get("True", 0)]
    levels = ["False", "True"]
    theta, value, covariance, converged = _fit_logit(table, coding, levels, penalty)
    q = len(theta)
    fit = _likelihood_fit(value, _null_log_likelihood(sizes), q, q - 1, n - q, n, converged)
    # Dummies change from 0 to 1; effect-coded columns have no such pair and get the derivative.
    margins = _margins(table, coding, 2, n, discrete=coding.interpretation != GRAND_MEAN)
    effects = margins(theta)[q - 1:]
    slope = _slope(margins, theta)[q - 1:]
    effect_covariance = slope @ np.nan_to_num(covariance) @ slope.T
    names, x = coding.profiles()
    probabilities = 1 / (1 + np.exp(-(x @ theta)))
    return Model(
        "logistic", df.sparkSession, coding, groups, theta, covariance, ["True", "False"], sizes[::-1], n, fit, info,
        _coefficient_rows(coding, theta, covariance),
        _effect_rows(coding, effects, effect_covariance),
        [(name, "True", float(p), None, None) for name, p in zip(names, probabilities)],
    )


def multinomial_regression(
    df: DataFrame, schema: TableSchema, groups, target, interpretation: str, reference: str | None = None,
    constrain: bool = False, reference_level: str | None = None, penalty: float | None = None,
) -> Model:
    """Multinomial logit against a reference level (by default the first), HC0 standard errors."""
    types = tuple(t for t in S.CATEGORICAL_FAMILY if t != S.BOOLEAN)
    groups, coding, table, n, info = _prepare(df, schema, groups, target, types, interpretation, reference, constrain, True)
    found = _level_sizes(table, schema, target)
    levels = [level for level, _ in found]
    if len(levels) < 3:
        raise ValidationError("a multinomial model needs at least three levels")
    first = reference_level or levels[0]
    if first not in levels:
        raise ValidationError(f"{first!r} is not a level of the target")
    levels = [first] + [level for level in levels if level != first]
    counts = dict(found)
    sizes = [counts[level] for level in levels]
    theta, value, covariance, converged = _fit_logit(table, coding, levels, penalty)
    shown = level_names(schema, target, levels)
    q, free = len(coding.variables) + 1, len(levels) - 1
    fit = _likelihood_fit(
        value, _null_log_likelihood(sizes), q * free, (q - 1) * free, n - q * free, n, converged
    )
    coefficients, effects_out = [], []
    for f in range(free):
        part = slice(f * q, (f + 1) * q)
        coefficients += _coefficient_rows(coding, theta[part], covariance[part, part], shown[f + 1])
    margins = _margins(table, coding, len(levels), n, discrete=False)
    effects, slope = margins(theta), _slope(margins, theta)
    effect_covariance = slope @ np.nan_to_num(covariance) @ slope.T
    for f in range(len(levels)):
        part = slice(f * (q - 1), (f + 1) * (q - 1))
        effects_out += _effect_rows(coding, effects[part], effect_covariance[part, part], shown[f])
    names, x = coding.profiles()
    p = _softmax(x @ theta.reshape(free, q).T)
    predictions = [
        (name, level, float(p[r, c]), None, None) for r, name in enumerate(names) for c, level in enumerate(shown)
    ]
    return Model(
        "multinomial", df.sparkSession, coding, groups, theta, covariance, shown, sizes, n, fit, info,
        coefficients, effects_out, predictions,
    )


def ordinal_regression(
    df: DataFrame, schema: TableSchema, groups, target, interpretation: str, reference: str | None = None,
    constrain: bool = False,
) -> Model:
    """Proportional odds without an intercept, HC0 standard errors."""
    groups, coding, table, n, info = _prepare(
        df, schema, groups, target, S.ORDERED_CATEGORICAL_FAMILY, interpretation, reference, constrain, False
    )
    found = _level_sizes(table, schema, target)
    levels, sizes = [level for level, _ in found], [size for _, size in found]
    if len(levels) < 3:
        raise ValidationError("an ordinal model needs at least three levels")
    q = len(coding.variables)
    share = np.cumsum(sizes)[:-1] / n
    start = np.concatenate([np.zeros(q), np.log(share / (1 - share))])
    total = _sums(table, coding, _ordinal_terms, levels, len(start))

    def ordered(theta):
        # Cut points that change places have no likelihood; the line search backs off.
        if np.any(np.diff(theta[q:]) <= 0):
            return -np.inf, None, None, None
        return total(theta)

    theta, value, information, squares, converged = _maximize(ordered, start)
    inverse = np.linalg.pinv(information)
    covariance = inverse @ squares @ inverse
    parameters = len(theta)
    fit = _likelihood_fit(value, _null_log_likelihood(sizes), parameters, q, n - parameters, n, converged)
    shown = level_names(schema, target, levels)
    names, x = coding.profiles()
    latent = x @ theta[:q]
    cumulative = 1 / (1 + np.exp(-(theta[q:][None, :] - latent[:, None])))
    cumulative = np.hstack([cumulative, np.ones((len(x), 1))])
    p = np.diff(np.hstack([np.zeros((len(x), 1)), cumulative]), axis=1)
    predictions = [
        (name, level, float(p[r, c]), float(cumulative[r, c]), float(latent[r]))
        for r, name in enumerate(names) for c, level in enumerate(shown)
    ]
    thresholds = [(shown[i], shown[i + 1], float(t)) for i, t in enumerate(theta[q:])]
    return Model(
        "ordinal", df.sparkSession, coding, groups, theta, covariance, shown, sizes, n, fit, info,
        _coefficient_rows(coding, theta[:q], covariance[:q, :q], intercept=False),
        [], predictions, thresholds,
    )


def _linear_predictor(model: Model, schema: TableSchema, weights: np.ndarray) -> SparkColumn:
    masks = {g.name: to_column(g.filter, schema).cast("double") for g in model.groups}
    names = model.coding.variables
    total, offset = (F.lit(float(weights[0])), 1) if model.coding.intercept else (F.lit(0.0), 0)
    for j, name in enumerate(names):
        value = masks[name]
        if model.coding.interpretation == GRAND_MEAN:
            value = value - masks[model.coding.reference]
        total = total + F.lit(float(weights[j + offset])) * value
    return total


def score(df: DataFrame, schema: TableSchema, model: Model) -> DataFrame:
    """Add the model's prediction to every row, as plain column arithmetic.

    ``prediction`` for linear and logistic models; ``probabilities`` by level for
    the others, plus ``cumulative`` and ``latent`` for ordinal models.
    """
    if model.kind in ("linear", "logistic"):
        eta = _linear_predictor(model, schema, model.theta)
        return df.withColumn("prediction", eta if model.kind == "linear" else 1 / (1 + F.exp(-eta)))
    q = len(model.coding.variables) + (1 if model.coding.intercept else 0)
    if model.kind == "multinomial":
        parts = model.theta.reshape(-1, q)
        exponents = [F.lit(1.0)] + [F.exp(_linear_predictor(model, schema, w)) for w in parts]
        total = sum(exponents[1:], exponents[0])
        entries = [F.struct(F.lit(level).alias("level"), (e / total).alias("p")) for level, e in zip(model.levels, exponents)]
        return df.withColumn("probabilities", F.array(*entries))
    out = df.withColumn("latent", _linear_predictor(model, schema, model.theta[:q]))
    steps = [1 / (1 + F.exp(F.col("latent") - F.lit(float(t)))) for t in model.theta[q:]] + [F.lit(1.0)]
    entries = [
        F.struct(F.lit(level).alias("level"), (c - (steps[i - 1] if i else F.lit(0.0))).alias("p"), c.alias("cumulative"))
        for i, (level, c) in enumerate(zip(model.levels, steps))
    ]
    return out.withColumn("probabilities", F.array(*entries))

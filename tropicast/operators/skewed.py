"""Skewed-Gaussian forecast models: location, scale and shape of many keys at once.

A key (lead, fold, segment, member) has a location and a log scale that are linear in the features
and a shape that is constant (or linear too). All keys take damped Newton steps together, from loss, gradient and
Hessian summed per key, and one small solve per key and round. Density: 2 / w * phi(z) * Phi(shape * z) with z = (y - location) / w, whose
negative logarithm, less a constant, is the score ``verify.nll_skewed``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nonneg
from ..session import cut, drop
from .folds import DECADES
from .learners import cross_products, linear, member_rows, solve, sum_arrays, with_fold

KEYS = ("lead", "fold", "segment", "member")
_erfc = np.frompyfunc(math.erfc, 1, 1)
# skewness of the most skewed density, (4 - pi) / 2 * (2 / (pi - 2)) ** 1.5, is 0.9953
STEEPEST = 0.95
# a round tries these multiples of the damping and keeps the best
FACTORS = (1.0, 30.0, 1000.0)


def log_cdf(t: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal distribution function."""
    far = t < -30.0
    near = np.where(far, 0.0, t)
    body = np.log(0.5 * _erfc(-near / math.sqrt(2.0)).astype(float))
    t = np.where(far, t, -30.0)
    return np.where(far, -0.5 * t * t - np.log(-t) - 0.5 * math.log(2.0 * math.pi) + np.log1p(-1.0 / (t * t)), body)


def _design(x: np.ndarray, varies: bool) -> np.ndarray:
    ones = np.ones((len(x), 1))
    return np.hstack([ones, x]) if varies else ones


def derivatives(theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, scale_varies: bool, shape_varies: bool,
                floor: float = 0.0):
    """Weighted loss, gradient and Hessian of the negative log-likelihood at one ``theta``.

    Half of (floor / scale) ** 2 is added per row, without which equal labels would draw the scale to zero.
    """
    a, b, c = _design(x, True), _design(x, scale_varies), _design(x, shape_varies)
    p, q = a.shape[1], a.shape[1] + b.shape[1]
    spread = np.exp(np.clip(b @ theta[p:q], -30.0, 30.0))
    shape = c @ theta[q:]
    z = (y - a @ theta[:p]) / spread
    t = shape * z
    log_phi = log_cdf(t)
    mills = np.exp(-0.5 * t * t - 0.5 * math.log(2.0 * math.pi) - log_phi)
    bend = mills * (t + mills)  # minus the derivative of the Mills ratio
    least = (floor / spread) ** 2
    loss = np.log(spread) + 0.5 * z * z - log_phi + 0.5 * least
    by_z, by_zz = z - shape * mills, 1.0 + shape * shape * bend
    by_shape, by_shape2, by_zs = -z * mills, z * z * bend, -mills + t * bend
    first = [-by_z / spread, 1.0 - z * by_z - least, by_shape]
    second = {(0, 0): by_zz / spread ** 2, (0, 1): (z * by_zz + by_z) / spread, (0, 2): -by_zs / spread,
              (1, 1): z * by_z + z * z * by_zz + 2.0 * least, (1, 2): -z * by_zs, (2, 2): by_shape2}
    blocks = (a, b, c)
    gradient = np.concatenate([block.T @ (w * f) for block, f in zip(blocks, first)])
    rows = [[blocks[i].T @ ((w * second[min(i, j), max(i, j)])[:, None] * blocks[j]) for j in range(3)] for i in range(3)]
    return float(w @ loss), gradient, np.block(rows)


def _start(coef, moments, scale_varies: bool, shape_varies: bool, floor: float) -> np.ndarray:
    """Location by least squares, scale and shape from the first three moments of its residuals."""
    n, s1, s2, s3 = moments
    mean = s1 / n
    var = max(s2 / n - mean * mean, floor * floor)
    skew = np.clip((s3 / n - 3.0 * mean * s2 / n + 2.0 * mean ** 3) / var ** 1.5, -STEEPEST, STEEPEST)
    location, scale, shape = from_moments(mean, var, skew)
    coef = np.array(coef, dtype=float)
    coef[0] += location
    rest = len(coef) - 1
    return np.concatenate([coef, [math.log(scale)], np.zeros(rest * scale_varies), [shape], np.zeros(rest * shape_varies)])


def from_moments(mean: float, var: float, skew: float) -> tuple[float, float, float]:
    """Location, scale and shape of the density with these moments."""
    part = abs(skew) ** (2.0 / 3.0)
    delta = math.copysign(math.sqrt(math.pi / 2.0 * part / (part + ((4.0 - math.pi) / 2.0) ** (2.0 / 3.0))), skew)
    delta = min(max(delta, -0.995), 0.995)
    scale = math.sqrt(var / (1.0 - 2.0 * delta * delta / math.pi))
    return mean - scale * delta * math.sqrt(2.0 / math.pi), scale, delta / math.sqrt(1.0 - delta * delta)


def _steps(theta, d, damping: float, penalty: np.ndarray) -> tuple[list, float, float]:
    """Next trials, one per factor of the damping, the gain that the first promises, and the largest slope in standard errors."""
    size = len(theta)
    g = np.asarray(d[2:2 + size]) + penalty * theta
    h = np.asarray(d[2 + size:]).reshape(size, size) + np.diag(penalty)
    scale = np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-12))
    values, basis = np.linalg.eigh((h + h.T) / 2.0 / np.outer(scale, scale))
    # directions of no or negative curvature are climbed down too
    curve = np.maximum(np.abs(values), 1e-8)
    slope = basis.T @ (g / scale)
    trials = [theta - basis @ (slope / (curve + damping * f)) / scale for f in FACTORS]
    return trials, float(0.5 * slope @ (slope / (curve + damping))), float(np.abs(g / scale).max())


class _Form:
    """Which outputs follow the features, and the penalties of a parameter vector."""

    def __init__(self, ridge, scale_ridge, shape_ridge, scale_varies, shape_varies, floor, tol):
        self.ridges = (ridge, scale_ridge, shape_ridge)
        self.scale_varies, self.shape_varies, self.floor, self.tol = scale_varies, shape_varies, floor, tol

    def sums(self, theta, x, y, w) -> np.ndarray:
        """Rows, loss, gradient and flattened Hessian."""
        loss, g, h = derivatives(np.asarray(theta, dtype=float), x, y, w, self.scale_varies, self.shape_varies, self.floor)
        return np.concatenate([[w.sum(), loss], g, h.ravel()])

    def penalties(self, size: int) -> np.ndarray:
        p = (size - (not self.scale_varies) - (not self.shape_varies)) // (1 + self.scale_varies + self.shape_varies)
        penalty = np.full(size, self.ridges[0])
        penalty[p:] = self.ridges[1]
        penalty[[0, p]] = 0.0  # intercepts of location and log scale
        penalty[p + (p if self.scale_varies else 1):] = self.ridges[2]
        return penalty

    def start(self, coef, moments) -> tuple:
        theta = _start(coef, moments, self.scale_varies, self.shape_varies, self.floor).tolist()
        return theta, [0.0], math.inf, 1e-3, [theta], False

    def advance(self, theta, d, loss: float, damping: float, trials: list, found: np.ndarray) -> tuple:
        """The state after a round: best trial taken if it is no worse, next trials, and whether the key is settled."""
        theta, trials = np.asarray(theta, dtype=float), [np.asarray(t, dtype=float) for t in trials]
        penalty = self.penalties(len(theta))
        rates = [f[1] + 0.5 * float(penalty @ (t * t)) if np.isfinite(f).all() else math.inf for f, t in zip(found, trials)]
        best = int(np.argmin(rates))
        if rates[best] <= loss + 1e-13 * abs(rates[best]):
            theta, d, loss = trials[best], found[best], rates[best]
            damping = max(damping * FACTORS[best] / 8.0, 1e-10)
        else:
            damping *= FACTORS[-1] * 8.0
        ahead, promise, slope = _steps(theta, np.asarray(d, dtype=float), damping, penalty)
        settled = slope < self.tol or promise < 1e-13 * max(abs(loss), 1.0) or damping > 1e12
        return theta.tolist(), np.asarray(d, dtype=float).tolist(), loss, damping, [t.tolist() for t in ahead], bool(settled)


STATE = "theta array<double>, d array<double>, loss double, damping double, trial array<array<double>>, settled boolean"
STATE_COLUMNS = ["theta", "d", "loss", "damping", "trial", "settled"]


def _arrays(pdf: pd.DataFrame) -> tuple:
    return np.array(list(pdf["x"]), dtype=float), pdf["y"].to_numpy(float), pdf["w"].to_numpy(float)


def _within_tasks(rows: DataFrame, state: DataFrame, keys: list, schema: str, form: _Form, max_rounds: int) -> DataFrame:
    """All rounds of a key in one task, which holds its rows."""
    def climb(key, left, right):
        state = [right[c].iloc[0] for c in STATE_COLUMNS]
        x, y, w = _arrays(left)
        for _ in range(max_rounds):
            found = np.array([form.sums(t, x, y, w) for t in state[4]])
            state = form.advance(*state[:5], found)
            if state[5]:
                break
        return pd.DataFrame([(*key, *state)], columns=[*keys, *STATE_COLUMNS])

    return cut(rows.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(climb, schema))


def _over_rows(rows: DataFrame, state: DataFrame, keys: list, schema: str, form: _Form, max_rounds: int) -> DataFrame:
    """A round is a pass over the rows of all open keys, however many rows a key has."""
    names = schema.removesuffix(f", {STATE}")

    def partial(batches):
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(keys, dropna=False):
                sums = [form.sums(t, *_arrays(part)) for t in part["trial"].iloc[0]]
                out.append((*key, np.concatenate(sums).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "new"])

    def advance(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                old = [r[c] for c in STATE_COLUMNS]
                if not r["settled"]:
                    old = form.advance(*old[:5], np.asarray(r["new"], dtype=float).reshape(len(r["trial"]), -1))
                out.append((*[r[k] for k in keys], *old))
            yield pd.DataFrame(out, columns=[*keys, *STATE_COLUMNS])

    for _ in range(max_rounds):
        open_ = state.where("not settled")
        if open_.isEmpty():
            break
        joined = rows.join(open_.select(*keys, "trial"), keys)
        sums = sum_arrays(joined.mapInPandas(partial, f"{names}, new array<double>"), keys, "new")
        before, state = state, cut(state.join(sums, keys, "left").mapInPandas(advance, schema))
        drop(before)
    return state


def fit(rows: DataFrame, keys=KEYS, ridge: float = 1.0, scale_ridge: float = 5.0, shape_ridge: float = 0.05,
        scale_varies: bool = True, shape_varies: bool = False, floor: float = 1e-3, tol: float = 1e-3, max_rounds: int = 200,
        task_rows: int = 20_000) -> DataFrame:
    """``keys, coef, coef_scale, coef_shape, loss, n``: models of rows ``keys, x, y, w``.

    ``ridge`` penalises the slopes of the location, ``scale_ridge`` those of the log scale and ``shape_ridge`` the shape, whose
    likelihood alone can rise for ever on few rows; scales stay above about ``floor``. Rows without a label are left out; a key
    is settled when no slope exceeds ``tol`` standard errors; keys still open after ``max_rounds`` raise. Where no
    key has more than ``task_rows`` rows a task takes all rounds of its keys; else each round is a pass over the rows. The steps are
    the same.
    """
    keys = list(keys)
    form = _Form(ridge, scale_ridge, shape_ridge, scale_varies, shape_varies, floor, tol)
    rows = cut(rows.where(F.col("y").isNotNull()).select(*keys, "x", "y", "w"))
    first = solve(cross_products(rows, keys, weight="w"), ridge=max(ridge, 1e-9))
    e, w = F.col("y") - linear(), F.col("w")
    moments = F.array(F.sum(w), F.sum(w * e), F.sum(w * e * e), F.sum(w * e * e * e)).alias("moments")
    begin = cut(rows.join(first, keys).groupBy(*keys).agg(F.first("coef").alias("coef"), moments, F.count(F.lit(1)).alias("rows")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + f", {STATE}"

    def place(batches):
        for pdf in batches:
            states = [(*[r[k] for k in keys], *form.start(r["coef"], r["moments"])) for r in pdf.to_dict("records")]
            yield pd.DataFrame(states, columns=[*keys, *STATE_COLUMNS])

    state = cut(begin.drop("rows").mapInPandas(place, schema))
    largest = begin.agg(F.max("rows")).first()[0] or 0
    climb = _within_tasks if largest <= task_rows else _over_rows
    state = climb(rows, state, keys, schema, form, max_rounds)
    if not state.where("not settled").isEmpty():
        raise ValueError(f"skewed models still open after {max_rounds} rounds")
    drop(rows)
    size = F.size("theta") - int(not scale_varies) - int(not shape_varies)
    out = state.withColumn("_p", F.floor(size / (1 + scale_varies + shape_varies)).cast("int"))
    p, zeros = F.col("_p"), F.array_repeat(F.lit(0.0), F.col("_p") - 1)
    scale = F.slice("theta", p + 1, p) if scale_varies else F.concat(F.slice("theta", p + 1, F.lit(1)), zeros)
    at = p + (p if scale_varies else 1) + 1
    shape = F.slice("theta", at, p) if shape_varies else F.concat(F.slice("theta", at, F.lit(1)), zeros)
    return out.select(*keys, F.slice("theta", F.lit(1), p).alias("coef"), scale.alias("coef_scale"), shape.alias("coef_shape"),
                      "loss", F.get("d", F.lit(0)).alias("n"))


def ensemble(features: DataFrame, n_segments: int = 5, n_members: int = 1, edges=DECADES, **options) -> DataFrame:
    """Models per lead and held-out decade, ``n_members`` for every segment left out."""
    return fit(member_rows(features, n_segments, n_members, edges), KEYS, **options)


def _outputs() -> list[Column]:
    return [linear().alias("location"), F.exp(linear(coef="coef_scale")).alias("scale"), linear(coef="coef_shape").alias("shape")]


def predict(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, fold, m, target_season, segment, member, y, location, scale, shape`` from models that did not see the decade."""
    rows = with_fold(features, edges).join(models, ["lead", "fold"])
    return rows.select("lead", "fold", F.col("m_target").alias("m"), "target_season", "segment", "member", "y", *_outputs())


def moments(location="location", scale="scale", shape="shape") -> tuple[Column, Column, Column]:
    """Mean, variance and third central moment of a skewed Gaussian."""
    w, a = F.col(scale), F.col(shape)
    b = a / F.sqrt(1.0 + a * a) * math.sqrt(2.0 / math.pi)
    return F.col(location) + w * b, w * w * (1.0 - b * b), w * w * w * b * b * b * ((4.0 - math.pi) / 2.0)


def mixture(members: DataFrame, keys=("lead", "m", "target_season")) -> DataFrame:
    """``keys, mean, std, location, scale, shape``: the skewed Gaussian with the moments of the mixture of members.

    A mixture more skewed than any skewed Gaussian gets the most skewed one. NULL if a member has a NULL output.
    """
    mean, var, third = moments()
    rows = members.withColumns({"_a": mean, "_b": var + mean * mean, "_c": third + 3.0 * mean * var + mean * mean * mean})
    table = rows.groupBy(*keys).agg(F.avg("_a").alias("mean"), F.avg("_b").alias("_b"), F.avg("_c").alias("_c"),
                                    (F.count(F.lit(1)) == F.count("_c")).alias("_full"))
    m = F.when(F.col("_full"), F.col("mean"))
    var = nonneg(F.col("_b") - m * m)
    table = table.withColumns({"mean": m, "_var": var}).withColumn("_skew", F.try_divide(
        F.col("_c") - 3.0 * m * F.col("_b") + 2.0 * m * m * m, F.pow("_var", F.lit(1.5))))
    part = F.pow(F.least(F.abs("_skew"), F.lit(STEEPEST)), F.lit(2.0 / 3.0))
    delta = F.signum("_skew") * F.sqrt(math.pi / 2.0 * part / (part + ((4.0 - math.pi) / 2.0) ** (2.0 / 3.0)))
    table = table.withColumn("_d", F.greatest(F.least(delta, F.lit(0.995)), F.lit(-0.995)))
    d = F.col("_d")
    table = table.withColumn("scale", F.sqrt(F.col("_var") / (1.0 - 2.0 / math.pi * d * d)))
    return table.select(*keys, "mean", F.sqrt("_var").alias("std"), (m - F.col("scale") * d * math.sqrt(2.0 / math.pi)).alias("location"),
                        "scale", (d / F.sqrt(1.0 - d * d)).alias("shape"))

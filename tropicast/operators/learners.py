"""Forecast models over feature tables.

Hundreds of small models (lead x fold x member x setting) are fitted in one job: a task
turns each batch of rows into cross products per model key, the products are summed, and
each model is solved from its own small matrix. Held-out models come from totals minus
the held-out part.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import uniform
from ..session import cut
from .folds import DECADES, fold_of, segments, train_folds


# cross products --------------------------------------------------------------------------

def cross_products(df: DataFrame, keys: list, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """``keys, g``: flattened sums of z zT with z = (1, x, y), weighted if asked.

    Partial sums per Arrow batch inside the tasks, then element-wise sums per key.
    """
    columns = [*keys, x, y] + ([weight] if weight else [])
    rows = df.where(F.col(y).isNotNull()).select(*columns)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([np.ones(len(pdf)), np.array(list(pdf[x]), dtype=float), pdf[y].to_numpy(float)])
            zw = z * pdf[weight].to_numpy(float)[:, None] if weight else z
            out = []
            for key, index in pdf.groupby(keys, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                out.append((*key, (zw[index].T @ z[index]).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*keys, "g"])

    parts = rows.mapInPandas(partial, f"{key_schema}, g array<double>")
    return sum_arrays(parts, keys, "g")


def sum_arrays(df: DataFrame, keys: list, column: str) -> DataFrame:
    """Element-wise sum of equally long arrays per key."""
    flat = df.select(*keys, F.posexplode(column).alias("_pos", "_v"))
    sums = flat.groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda s: s["_v"]).alias(column))


def others(df: DataFrame, part: str, keys: list, column: str = "g") -> DataFrame:
    """Sums of all other parts of a key: its total minus the own sums."""
    total = sum_arrays(df, keys, column).withColumnRenamed(column, "_total")
    joined = df.join(total, keys)
    left = F.zip_with("_total", column, lambda a, b: a - b)
    return joined.where(F.col(part).isNotNull()).withColumn(column, left).drop("_total")


# solvers (one small matrix per row) ------------------------------------------------------

def _unpack(g):
    g = np.asarray(g, dtype=float)
    size = int(round(np.sqrt(len(g))))
    return g.reshape(size, size)


def _least_squares(g, ridge: float):
    a = _unpack(g)
    p = a.shape[0] - 1
    m = a[:p, :p].copy()
    m[np.arange(1, p), np.arange(1, p)] += ridge
    return np.linalg.lstsq(m, a[:p, p], rcond=None)[0]


def _lasso(g, alpha: float, tol: float = 1e-10, rounds: int = 100_000):
    """Minimise |y - b0 - Xb|^2 / (2n) + alpha |b|_1 by coordinate descent on the products."""
    a = _unpack(g)
    n = a[0, 0]
    mean_x, mean_y = a[0, 1:-1] / n, a[0, -1] / n
    c = a[1:-1, 1:-1] / n - np.outer(mean_x, mean_x)
    d = a[1:-1, -1] / n - mean_x * mean_y
    b = np.zeros(len(d))
    for _ in range(rounds):
        shift = 0.0
        for j in range(len(b)):
            if c[j, j] <= 0:
                continue
            rho = d[j] - c[j] @ b + c[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / c[j, j]
            shift = max(shift, abs(new - b[j]))
            b[j] = new
        if shift < tol:
            return np.concatenate([[mean_y - mean_x @ b], b])
    raise ValueError(f"the coefficients still move after {rounds} rounds")


def solve(df: DataFrame, ridge: float = 0.0, alpha: str | None = None, column: str = "g") -> DataFrame:
    """Replace the products by ``coef`` (intercept first); ``alpha`` names a Lasso penalty column."""

    @F.pandas_udf("array<double>")
    def least_squares(g: pd.Series) -> pd.Series:
        return g.map(lambda v: _least_squares(v, ridge).tolist())

    @F.pandas_udf("array<double>")
    def lasso(g: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([_lasso(v, w).tolist() for v, w in zip(g, a)])

    fitted = least_squares(column) if alpha is None else lasso(F.col(column), F.col(alpha).cast("double"))
    return df.withColumn("coef", fitted).drop(column)


def linear(x="x", coef="coef") -> Column:
    """Intercept plus dot product."""
    x, coef = F.col(x) if isinstance(x, str) else x, F.col(coef) if isinstance(coef, str) else coef
    products = F.zip_with(x, F.slice(coef, F.lit(2), F.size(coef) - 1), lambda a, b: a * b)
    return F.get(coef, F.lit(0)) + F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


# models ----------------------------------------------------------------------------------

def with_fold(features: DataFrame, edges=DECADES) -> DataFrame:
    return features.withColumn("fold", fold_of(F.floor(F.col("m_target") / 12), edges))


def lasso_models(features: DataFrame, alphas, edges=DECADES) -> DataFrame:
    """``lead, fold, alpha, coef``: fitted on every decade but the fold."""
    products = cut(cross_products(with_fold(features, edges), ["lead", "fold"]))
    train = others(products, "fold", ["lead"])
    grid = train.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return solve(grid, alpha="alpha")


def lasso_validation(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, alpha, fold, loss``: squared error on the held-out decade."""
    rows = with_fold(features, edges).join(models, ["lead", "fold"])
    e = F.col("y") - linear()
    return rows.groupBy("lead", "alpha", "fold").agg(F.avg(e * e).alias("loss"))


def training_rows(features: DataFrame, n_segments: int, edges=DECADES) -> DataFrame:
    """Rows once per fold they train, with the segment that holds them out."""
    rows = with_fold(features, edges).withColumnRenamed("fold", "_own")
    rows = rows.withColumn("fold", F.explode(train_folds("_own", edges))).drop("_own")
    return segments(rows, n_segments, ("lead", "fold"))


def with_members(rows: DataFrame, n_members: int, seed: int = 0) -> DataFrame:
    """Rows once per member, with the weight ``w`` the member gives them.

    Member 0 weighs all rows alike; the others draw exponential weights from the fold, the member and the
    month (a Bayesian bootstrap), so members of one segment differ although their fit is exact.
    """
    rows = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(n_members - 1))))
    drawn = -F.log(1.0 - uniform("fold", "member", "m", seed=seed))
    return rows.withColumn("w", F.when(F.col("member") == 0, F.lit(1.0)).otherwise(drawn))


def member_rows(features: DataFrame, n_segments: int, n_members: int = 1, edges=DECADES, seed: int = 0) -> DataFrame:
    """Rows once per (fold, segment, member) they train: all but those of the segment left out."""
    rows = training_rows(features, n_segments, edges).withColumnRenamed("segment", "_own")
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1))))
    rows = rows.where(F.col("_own").isNull() | (F.col("_own") != F.col("segment"))).drop("_own")
    return with_members(rows, n_members, seed)


def mean_ensemble(features: DataFrame, n_segments: int = 5, ridge: float = 1.0, edges=DECADES, n_members: int = 1,
                  seed: int = 0) -> DataFrame:
    """``lead, fold, segment, member, coef``: ``n_members`` for every held-out segment.

    A member's weights do not depend on the segment, so its products are totals minus the segment's.
    """
    rows = with_members(training_rows(features, n_segments, edges), n_members, seed)
    products = cut(cross_products(rows, ["lead", "fold", "segment", "member"], weight="w"))
    return solve(others(products, "segment", ["lead", "fold", "member"]), ridge=ridge)


def gaussian_ensemble(features: DataFrame, n_segments: int = 5, ridge: float = 1.0, edges=DECADES, n_members: int = 1,
                      seed: int = 0) -> DataFrame:
    """``lead, fold, segment, member, coef, coef_std``: mean, then log squared residual on the same rows.

    The log of a squared standard normal has mean -1.2704, which is added back when the
    second model is turned into a spread.
    """
    keys = ["lead", "fold", "segment", "member"]
    means = cut(mean_ensemble(features, n_segments, ridge, edges, n_members, seed))
    held = member_rows(features, n_segments, n_members, edges, seed).join(means, keys)
    e = F.col("y") - linear()
    logs = held.select(*keys, "x", F.log(e * e + 1e-6).alias("y"), "w")
    spread = solve(cross_products(logs, keys, weight="w"), ridge=ridge)
    spread = spread.withColumnRenamed("coef", "coef_std")
    return means.join(spread, keys)


LOG_CHI2_MEAN = -1.2703628454614782  # mean of log of a chi-square with one degree


def predict_members(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, m_target, target_season, segment, mean[, std]`` from models that did not see the decade."""
    rows = with_fold(features, edges).join(models, ["lead", "fold"])
    out = [linear().alias("mean")]
    if "coef_std" in models.columns:
        out.append(F.exp(0.5 * (linear(coef="coef_std") - LOG_CHI2_MEAN)).alias("std"))
    return rows.select("lead", "fold", F.col("m_target").alias("m"), "target_season", "segment", "member", "y", *out)


def hindcast(features: DataFrame, models: DataFrame, edges=DECADES, first: str | None = None) -> DataFrame:
    """Each target month predicted by the model that did not see its decade.

    Raises if the hindcast does not begin at ``first``.
    """
    rows = with_fold(features, edges).join(models, ["lead", "fold"])
    out = rows.select("lead", "fold", F.col("m_target").alias("m"), "target_season", "y", "y_persistence",
                      linear().alias("mean"), *[c for c in ("alpha",) if c in models.columns])
    if first is not None:
        begin = out.agg(F.min("target_season")).first()[0]
        if str(begin) != first:
            raise ValueError(f"the hindcast starts at {begin} instead of {first}")
    return out


def quantile_models(features: DataFrame, quantiles, edges=DECADES, ridge: float = 1e-6, eps: float = 1e-3,
                    tol: float = 1e-3, max_rounds: int = 200) -> DataFrame:
    """``lead, fold, q, coef``: linear quantile regression by reweighted least squares.

    All open keys iterate together, and a round is one aggregation. A key leaves the rounds
    when its own pinball loss settles to ``tol``; keys still open after ``max_rounds`` raise.
    """
    rows = with_fold(features, edges).withColumnRenamed("fold", "_own")
    rows = rows.withColumn("fold", F.explode(train_folds("_own", edges)))
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    keys = ["lead", "fold", "q"]
    rows = cut(rows.select(*keys, "x", "y"))
    return reweighted(rows, keys, lambda products: solve(products, ridge=ridge), eps, tol, max_rounds)


def reweighted(rows: DataFrame, keys: list, fit, eps: float, tol: float, max_rounds: int) -> DataFrame:
    """``keys, coef``: least pinball loss of (``keys, q, x, y``) rows by rounds of weighted squares.

    ``fit`` replaces the products of each key by its coefficients.
    """
    start = fit(cross_products(rows, keys))
    open_ = cut(start.select(*keys, "coef", F.lit(None).cast("double").alias("loss")))
    done = open_.where("false").select(*keys, "coef")
    for _ in range(max_rounds):
        e = F.col("y") - linear()
        side = F.when(e >= 0, F.col("q")).otherwise(1.0 - F.col("q"))
        weighted = rows.join(open_.select(*keys, "coef"), keys)
        weighted = weighted.withColumn("w", side / F.greatest(F.abs(e), F.lit(eps)))
        products = cross_products(weighted, keys, weight="w").join(open_.withColumnRenamed("loss", "_before"), keys)
        moved = fit(products.withColumn("loss", _weighted_loss()("g", "coef")).drop("coef"))
        settled = F.abs(F.col("_before") - F.col("loss")) <= tol * F.abs("_before")
        models = cut(moved.select(*keys, "coef", "loss", F.coalesce(settled, F.lit(False)).alias("_settled")))
        done = done.unionByName(models.where("_settled").select(*keys, "coef"))
        open_ = models.where("not _settled").drop("_settled")
        if open_.isEmpty():
            return done
    raise ValueError(f"quantile models still open after {max_rounds} rounds")


def _weighted_loss():
    """Weighted squared error of the coefficients a round began with, from its products.

    With the weights of that round it equals the pinball loss, so no extra pass is needed.
    """

    @F.pandas_udf("double")
    def loss(g: pd.Series, coef: pd.Series) -> pd.Series:
        v = [np.append(-np.asarray(c, dtype=float), 1.0) for c in coef]
        return pd.Series([float(a @ _unpack(m) @ a) for a, m in zip(v, g)])

    return loss


def predict_quantiles(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """Joint quantile forecast per row, rearranged so that the quantiles do not cross."""
    rows = with_fold(features, edges).join(models, ["lead", "fold"])
    out = rows.groupBy("lead", F.col("m_target").alias("m"), "target_season", "y").agg(
        F.array_sort(F.collect_list("q")).alias("q"), F.array_sort(F.collect_list(linear())).alias("forecast")
    )
    return out


def relevance(models: DataFrame, n_features: int, keep: float = 0.3, keys=("lead",)) -> DataFrame:
    """Summed absolute weight per feature over members, those above ``keep`` of the largest.

    Feature positions run lag by lag, so position = lag * n_features + variable.
    """
    keys = list(keys)
    weights = models.select(*keys, F.posexplode(F.slice("coef", F.lit(2), F.size("coef") - 1)).alias("pos", "w"))
    total = weights.groupBy(*keys, "pos").agg(F.sum(F.abs("w")).alias("weight"))
    top = total.groupBy(*keys).agg(F.max("weight").alias("_top"))
    rows = total.join(top, keys).where(F.col("weight") > keep * F.col("_top"))
    return rows.select(*keys, (F.col("pos") % n_features).alias("variable"),
                       F.floor(F.col("pos") / n_features).cast("int").alias("lag"), "weight")


def interval_classifier(features: DataFrame, low: float = -5.0, step: float = 0.25, count: int = 41, max_iter: int = 50,
                        reg: float = 0.01):
    """Multinomial classifier of the interval a label falls in; returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from ..functions.stats import interval_class

    rows = features.where("y is not null").select(
        array_to_vector("x").alias("features"), interval_class("y", low, step, count - 1).cast("double").alias("label")
    )
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(rows)


def classify(model, features: DataFrame) -> DataFrame:
    """``lead, m, target_season, class, prob`` rows of a fitted classifier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(features.withColumn("features", array_to_vector("x")))
    probs = scored.select("lead", F.col("m_target").alias("m"), "target_season", "y",
                          F.posexplode(vector_to_array("probability")).alias("class", "prob"))
    return probs


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _multinomial(x: np.ndarray, label: np.ndarray, count: int, reg: float, tol: float = 1e-6, rounds: int = 100_000):
    """Penalised multinomial coefficients (classes by 1 + features) by accelerated gradient steps."""
    z = np.column_stack([np.ones(len(x)), x])
    target = np.eye(count)[label]
    step = 1.0 / (np.linalg.eigvalsh(z.T @ z / len(z))[-1] / 2.0 + reg)
    momentum = (1.0 - np.sqrt(step * reg)) / (1.0 + np.sqrt(step * reg))
    w = ahead = np.zeros((count, z.shape[1]))
    for _ in range(rounds):
        slope = (_softmax(z @ ahead.T) - target).T @ z / len(z) + reg * ahead
        before, w = w, ahead - step * slope
        if np.abs(slope).max() < tol:
            return w
        ahead = w + momentum * (w - before)
    raise ValueError(f"the classifier still moves after {rounds} rounds")


def interval_models(features: DataFrame, low: float = -5.0, step: float = 0.25, count: int = 42, reg: float = 0.01,
                    edges=DECADES) -> DataFrame:
    """``lead, fold, coef``: interval classifiers fitted on every decade but the fold.

    A group is one label per month of the training decades, so its size is bounded by the calendar.
    """
    from ..functions.stats import interval_class

    rows = with_fold(features, edges).where("y is not null").withColumnRenamed("fold", "_own")
    rows = rows.withColumn("fold", F.explode(train_folds("_own", edges)))
    rows = rows.select("lead", "fold", "x", interval_class("y", low, step, count - 2).alias("label"))

    def fit_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = _multinomial(np.array(list(pdf["x"]), dtype=float), pdf["label"].to_numpy(int), count, reg)
        return pd.DataFrame([(*key, w.tolist())], columns=["lead", "fold", "coef"])

    return rows.groupBy("lead", "fold").applyInPandas(fit_one, "lead int, fold int, coef array<array<double>>")


def interval_hindcast(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, m, target_season, y, class, prob`` from the classifier that did not see the decade."""
    rows = with_fold(features, edges).join(models, ["lead", "fold"])

    @F.pandas_udf("array<double>")
    def probabilities(x: pd.Series, coef: pd.Series) -> pd.Series:
        return pd.Series([_softmax(np.array([np.stack(c) @ np.append(1.0, v)]))[0] for v, c in zip(x, coef)])

    return rows.select("lead", F.col("m_target").alias("m"), "target_season", "y",
                       F.posexplode(probabilities("x", "coef")).alias("class", "prob"))


def field_forecast(field: DataFrame, lead, k: int = 3, shift: int = 3, ridge: float = 1.0, cell=("lat", "lon")) -> DataFrame:
    """``cell, lead, m, value``: forecast through a few patterns (encode, regress the amplitudes, decode).

    ``lead`` is one lead or a list; all are fitted together.

    Amplitudes are one short row per month; the field itself meets them in joins on month
    and cell only.
    """
    from . import eof

    fitted = eof.fit(eof.detrended(field, cell), k, cell)
    pc = cut(eof.wide_projection(fitted.project(), k))
    names = [f"pca{j}" for j in range(1, k + 1)]
    x = pc.select("m", F.array(*names).alias("x"))
    leads = F.explode(F.lit([lead] if isinstance(lead, int) else list(lead)))
    later = pc.withColumn("lead", leads).select("lead", (F.col("m") - F.col("lead") - shift).alias("m"), F.explode(F.array(*[
        F.struct(F.lit(j).alias("mode"), F.col(n).alias("y")) for j, n in enumerate(names, 1)
    ])).alias("_t")).select("lead", "m", "_t.mode", "_t.y")
    models = cut(solve(cross_products(x.join(later, "m"), ["lead", "mode"]), ridge=ridge))
    modes = F.explode(F.sequence(F.lit(1), F.lit(k)))
    ahead = x.withColumn("mode", modes).join(models, "mode").select(
        "lead", (F.col("m") + F.col("lead") + shift).alias("m"), "mode", linear().alias("amplitude")
    )
    map_ = ahead.join(fitted.patterns, "mode").groupBy(*cell, "lead", "m").agg(
        F.sum(F.col("amplitude") * F.col("loading")).alias("value")
    )
    return map_


def field_hindcast(field: DataFrame, leads, k: int = 3, shift: int = 3, ridge: float = 1.0, cell=("lat", "lon"), edges=DECADES) -> DataFrame:
    """``cell, fold, lead, m, value``: the months of each decade forecast by a model that has seen none of them.

    Trend, patterns and the regression of the amplitudes come from the other decades; a regression row is left out
    when either of its months lies in the decade. The patterns of all decades advance in the same passes, amplitudes are a short
    row per month, and a cell meets the forecasts of a decade (leads by months, bounded by the calendar) as one array.
    """
    from . import eof

    folds = {lo: (12 * lo, 12 * hi) for lo, hi in zip(edges[:-1], edges[1:])}
    fitted = eof.fit(field, k, cell, detrend=True, folds=folds)
    names = [f"pca{j}" for j in range(1, k + 1)]
    pc = cut(eof.wide_projection(fitted.project(), k).withColumn("x", F.array(*names)).select("fold", "m", "x"))
    ends = F.create_map(*[F.lit(y) for pair in zip(edges[:-1], edges[1:]) for y in pair])

    def outside(m):
        year = F.floor(m / 12)
        return (year < F.col("fold")) | (year >= ends[F.col("fold")])

    lead = F.explode(F.lit(list(leads)).cast("array<int>")).alias("lead")
    source = pc.select("fold", lead, "m", "x").withColumn("later", F.col("m") + F.col("lead") + shift)
    target = pc.select("fold", F.col("m").alias("later"), F.posexplode("x").alias("mode", "y"))
    train = source.join(target, ["fold", "later"]).where(outside(F.col("m")) & outside(F.col("later")))
    models = cut(solve(cross_products(train, ["fold", "lead", "mode"]), ridge=ridge))
    ahead = source.where(~outside(F.col("later"))).join(models, ["fold", "lead"])
    amplitudes = ahead.groupBy("fold", "lead", "later").agg(F.array_sort(F.collect_list(F.struct("mode", linear().alias("a")))).alias("a"))
    per_fold = amplitudes.groupBy("fold").agg(F.collect_list(F.struct("lead", F.col("later").alias("m"), F.col("a.a").alias("a"))).alias("f"))
    rows = fitted.signed().join(per_fold, "fold").select(*cell, "fold", "loadings", "intercept", "slope", F.explode("f").alias("f"))
    decoded = F.aggregate(F.zip_with("loadings", F.col("f.a"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    trend = F.col("intercept") + F.col("slope") * (F.col("f.m") - fitted.packed.first)
    return rows.select(*cell, "fold", "f.lead", "f.m", (decoded + trend).alias("value"))


# the model contract ----------------------------------------------------------------------

class _ForecastParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    ridge = Param(Params._dummy(), "ridge", "quadratic penalty", TypeConverters.toFloat)
    labelCols = Param(Params._dummy(), "labelCols", "label columns, one per output (labelCol alone if empty)", TypeConverters.toListString)
    outputNames = Param(Params._dummy(), "outputNames", "names of the outputs", TypeConverters.toListString)
    ranges = Param(Params._dummy(), "ranges", "search ranges by argument, as JSON", TypeConverters.toString)
    nIter = Param(Params._dummy(), "nIter", "candidates of a search", TypeConverters.toInt)
    nSegments = Param(Params._dummy(), "nSegments", "blocks left out in turn to rate a candidate", TypeConverters.toInt)
    orderCol = Param(Params._dummy(), "orderCol", "column the blocks are contiguous in", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the search", TypeConverters.toInt)
    coefficients = Param(Params._dummy(), "coefficients", "fitted, intercept first, output by output", TypeConverters.toListFloat)
    meanValLoss = Param(Params._dummy(), "meanValLoss", "mean squared error on the blocks left out", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(ridge=1.0, labelCols=[], outputNames=["mean"], ranges="{}", nIter=10, nSegments=5, orderCol="m", seed=0,
                         featuresCol="x", labelCol="y", predictionCol="mean", meanValLoss=float("nan"))

    @property
    def labels(self) -> list:
        return self.getOrDefault("labelCols") or [self.getLabelCol()]

    @property
    def n_outputs(self) -> int:
        return len(self.getOrDefault("outputNames"))

    @property
    def output_names(self) -> list:
        return self.getOrDefault("outputNames")


class LinearForecast(Estimator, _ForecastParams):
    """Estimator with named outputs, all from one solve; any feature table with an array column works.

    A tuple or list as ``ridge`` (low, high[, kind]) is a search range: ``nIter`` random candidates are rated on ``nSegments``
    contiguous blocks left out in turn, and the best is fitted to all rows. Rows without all labels are left out.
    """

    @keyword_only
    def __init__(self, ridge=1.0, featuresCol: str = "x", labelCol: str = "y", labelCols: list | None = None,
                 outputNames: list | None = None, nIter: int = 10, nSegments: int = 5, orderCol: str = "m", seed: int = 0):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if isinstance(given.get("ridge"), (tuple, list)):
            given["ranges"] = json.dumps({"ridge": list(given.pop("ridge"))})
        self._set(**given)
        if len(self.labels) != self.n_outputs:
            raise ValueError(f"{len(self.labels)} labels for {self.n_outputs} outputs")

    def _fit(self, dataset: DataFrame) -> "LinearForecastModel":
        from . import search, tuning

        labels, outputs = [F.col(c).cast("double") for c in self.labels], self.n_outputs
        complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in labels])
        rows = dataset.where(complete).withColumn("_all", F.lit(0))
        # the labels before the last ride with the features: their products are in the same matrix
        z = F.concat(F.col(self.getFeaturesCol()).cast("array<double>"), F.array(*labels[:-1]).cast("array<double>"))
        space = {k: tuple(v) for k, v in json.loads(self.getOrDefault("ranges")).items()}
        if space:
            rows = segments(rows, self.getOrDefault("nSegments"), ("_all",), self.getOrDefault("orderCol"))
        else:
            rows = rows.withColumn("segment", F.lit(None).cast("int"))
        products = cut(cross_products(rows.select("_all", "segment", z.alias("_z"), labels[-1].alias("_y")), ["_all", "segment"], "_z", "_y"))
        model = LinearForecastModel()
        for name in ("featuresCol", "labelCol", "labelCols", "outputNames", "orderCol"):
            model._set(**{name: self.getOrDefault(name)})
        whole = sum_arrays(products, ["_all"], "g").select("_all", F.col("g").alias("train"), F.lit(None).cast("array<double>").alias("held"))
        chosen = dataset.sparkSession.createDataFrame([(0, self.getOrDefault("ridge"))], "_all int, ridge double")
        if space:
            candidates = cut(search.random_candidates(chosen.select("_all"), space, self.getOrDefault("nIter"), self.getOrDefault("seed")))
            rated = tuning.solved(tuning.split_products(products, "segment", ["_all"]), candidates, outputs)
            losses = rated.groupBy("candidate").agg(F.avg("loss").alias("loss"))
            best = search.best_candidate(losses)
            chosen = candidates.join(best, "candidate")
            model._set(meanValLoss=best.first()["loss"])
        row = tuning.solved(whole, chosen, outputs).select("ridge", "coef").first()
        model._set(coefficients=list(row["coef"]), ridge=row["ridge"])
        return model


class LinearForecastModel(Model, _ForecastParams):
    def __init__(self):
        super().__init__()

    @property
    def mean_val_loss(self) -> float:
        """Mean squared error of the chosen candidate on the blocks left out; NaN without a search."""
        return self.getOrDefault("meanValLoss")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values, names = self.getOrDefault("coefficients"), self.output_names
        size = len(values) // len(names)
        coefs = [F.lit(values[i * size:(i + 1) * size]) for i in range(len(names))]
        return dataset.withColumns({n: linear(self.getFeaturesCol(), c) for n, c in zip(names, coefs, strict=True)})

    def predict(self, dataset: DataFrame) -> DataFrame:
        return self.transform(dataset)

    def evaluate(self, dataset: DataFrame) -> dict:
        """Root mean squared error of each output over the rows that have its label."""
        scored = self.transform(dataset)
        errors = [F.sqrt(F.avg((F.col(label) - F.col(name)) ** 2)).alias(name) for label, name in zip(self.labels, self.output_names, strict=True)]
        return scored.agg(*errors).first().asDict()

"""Joint quantile regression: a median and increments that are never negative.

The quantile nearest one half is linear in the inputs. Between neighbouring quantiles lies an increment
with weights of at least zero on 1 and on the positive and negative parts of the inputs, so quantiles
cannot cross, on rows outside the training data neither. All quantiles of a key are one pinball problem,
solved by reweighted squares under these bounds; a round is one aggregation for all keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .folds import DECADES, train_folds
from .learners import _unpack, linear, reweighted, with_fold


def _middle(quantiles) -> int:
    return min(range(len(quantiles)), key=lambda i: abs(quantiles[i] - 0.5))


def _ordered(quantiles) -> list[float]:
    levels = sorted({float(q) for q in quantiles})
    if not levels or levels[0] <= 0 or levels[-1] >= 1:
        raise ValueError("quantiles lie between 0 and 1")
    return levels


def _parts(x: Column) -> Column:
    """1, positive parts and negative parts of the inputs: what increments are made of."""
    return F.concat(F.array(F.lit(1.0)), F.transform(x, lambda v: F.greatest(v, F.lit(0.0))),
                    F.transform(x, lambda v: F.greatest(-v, F.lit(0.0))))


def _times(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda v: v * factor)


def _design(x: Column, q: Column, levels: list[float]) -> Column:
    """Inputs of a row at level q: x for the median, then the parts of each gap between the median and q."""
    middle, blocks = _middle(levels), [x]
    for gap in range(len(levels) - 1):
        if gap >= middle:
            sign = F.when(q >= levels[gap + 1], 1.0).otherwise(0.0)
        else:
            sign = F.when(q <= levels[gap], -1.0).otherwise(0.0)
        blocks.append(_times(_parts(x), sign))
    return F.concat(*blocks)


def bounded_least_squares(g, free: int, ridge: float, rounds: int = 1000) -> np.ndarray:
    """Least squares from products, coefficients from position ``free`` on at least zero (active set)."""
    a = _unpack(g)
    p = a.shape[0] - 1
    m, c = a[:p, :p].copy(), a[:p, p]
    scale = max(1.0, float(np.abs(m).max()))
    m[np.arange(1, p), np.arange(1, p)] += ridge * scale
    bounded = np.arange(p) >= free
    b, held = np.zeros(p), bounded.copy()
    for _ in range(rounds):
        s = np.zeros(p)
        s[~held] = np.linalg.lstsq(m[np.ix_(~held, ~held)], c[~held], rcond=None)[0]
        low = ~held & bounded & (s <= 0)
        if low.any():
            # as far as the first bound on the way, whose coefficient is then held there
            drop = b[low] - s[low]
            step = np.divide(b[low], drop, out=np.zeros_like(drop), where=drop > 0)
            first = np.flatnonzero(low)[step.argmin()]
            b = b + step.min() * (s - b)
            b[first] = 0.0
            held[first] = True
            continue
        b = s
        gain = np.where(held, c - m @ b, -np.inf)
        if not held.any() or gain.max() <= 1e-9 * scale:
            return b
        held[gain.argmax()] = False
    raise ValueError(f"the coefficients still move after {rounds} rounds")


def joint_models(features: DataFrame, quantiles, edges=DECADES, ridge: float = 1e-9, eps: float = 1e-3,
                 tol: float = 1e-3, max_rounds: int = 200) -> DataFrame:
    """``lead, fold, coef``: all quantiles of a key in one fit on every decade but the fold.

    ``coef`` holds the median's intercept and weights, then those of each gap between neighbouring
    quantiles, from the lowest. Inputs should be centred, as increments bend at zero. Rows without y
    take no part; keys still open after ``max_rounds`` raise.
    """
    levels = _ordered(quantiles)
    rows = with_fold(features, edges).withColumnRenamed("fold", "_own")
    rows = rows.withColumn("fold", F.explode(train_folds("_own", edges))).where(F.col("y").isNotNull())
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in levels])))
    rows = cut(rows.select("lead", "fold", "q", _design(F.col("x"), F.col("q"), levels).alias("x"), "y"))
    gaps = len(levels) - 1

    @F.pandas_udf("array<double>")
    def bounded(g: pd.Series) -> pd.Series:
        # 1 + p + gaps (1 + 2 p) coefficients and y in each product
        def free(v):
            size = int(round(np.sqrt(len(v)))) - 1
            return 1 + (size - 1 - gaps) // (1 + 2 * gaps)

        return g.map(lambda v: bounded_least_squares(v, free(v), ridge).tolist())

    return reweighted(rows, ["lead", "fold"], lambda g: g.withColumn("coef", bounded("g")).drop("g"), eps, tol, max_rounds)


def predict_joint(features: DataFrame, models: DataFrame, quantiles, edges=DECADES) -> DataFrame:
    """``lead, m, target_season, y, q, forecast``: each month by the model that did not see its decade.

    The increments are added one after the other from the median, so ``forecast`` rises with ``q`` as it is.
    """
    levels = _ordered(quantiles)
    middle = _middle(levels)
    p = F.size("x")
    rows = with_fold(features, edges).join(models, ["lead", "fold"])

    def increment(gap: int) -> Column:
        weights = F.slice("coef", 2 + p + gap * (1 + 2 * p), 1 + 2 * p)
        terms = F.zip_with(_parts(F.col("x")), weights, lambda v, w: v * w)
        return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)

    rows = rows.withColumn("_gaps", F.array(*[increment(i) for i in range(len(levels) - 1)]))
    rows = rows.withColumn("_median", linear(coef=F.slice("coef", F.lit(1), p + 1)))

    def summed(gaps, sign: float) -> Column:
        out = F.col("_median")
        for gap in gaps:
            out = out + sign * F.get("_gaps", F.lit(gap))
        return out

    forecast = [summed(range(middle - 1, k - 1, -1), -1.0) if k < middle else summed(range(middle, k), 1.0)
                for k in range(len(levels))]
    return rows.select("lead", F.col("m_target").alias("m"), "target_season", "y",
                       F.array(*[F.lit(q) for q in levels]).alias("q"), F.array(*forecast).alias("forecast"))

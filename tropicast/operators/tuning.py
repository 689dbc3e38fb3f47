"""Search around trained learners: every candidate is solved from one table of cross products.

The rows are read once, into products per (lead, fold, segment). What a candidate trains on is a total
less a part, its inputs are a submatrix, and its loss on the part left out is a quadratic form of that
part's products; so neither candidates, folds nor generations read the rows again. Candidates meet the products
in a join on their keys, a product matrix being as small as the features are few.

A candidate may have ``inputs`` (positions in ``x``, all if missing) and ``ridge`` (0 if missing).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import search
from .ensemble import plain_mean
from .folds import DECADES
from .learners import _unpack, cross_products, predict_members, sum_arrays, training_rows, with_fold


def split_products(products: DataFrame, part: str, keys: list) -> DataFrame:
    """``keys, part, train, held``: products of all other parts of a key and of the part itself."""
    total = sum_arrays(products, keys, "g").withColumnRenamed("g", "_total")
    rows = products.where(F.col(part).isNotNull()).join(total, keys)
    return rows.select(*keys, part, F.zip_with("_total", "g", lambda a, b: a - b).alias("train"), F.col("g").alias("held"))


def fold_products(features: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, fold, train, held`` with the decades as parts."""
    products = cut(cross_products(with_fold(features, edges), ["lead", "fold"]))
    return cut(split_products(products, "fold", ["lead"]))


def segment_products(features: DataFrame, n_segments: int = 5, edges=DECADES) -> DataFrame:
    """``lead, fold, segment, train, held``: within the training years of each decade, the segments as parts."""
    rows = training_rows(features, n_segments, edges)
    products = cut(cross_products(rows, ["lead", "fold", "segment"]))
    return cut(split_products(products, "segment", ["lead", "fold"]))


def _coefficients(train, inputs, ridge: float, outputs: int) -> np.ndarray:
    """Least squares on some inputs, the others' coefficients 0; one column per output, all from one solve."""
    g = _unpack(train)
    p = len(g) - 1 - outputs
    chosen = sorted({int(i) for i in inputs}) if inputs is not None else list(range(p))
    if any(not 0 <= i < p for i in chosen):
        raise ValueError(f"inputs {chosen} of {p} features")
    at = [0, *[1 + i for i in chosen]]
    m = g[np.ix_(at, at)].copy()
    m[np.arange(1, len(at)), np.arange(1, len(at))] += ridge
    coef = np.zeros((p + 1, outputs))
    coef[at] = np.linalg.lstsq(m, g[at, p + 1:], rcond=None)[0]
    return coef


def _squared_error(held, coef: np.ndarray) -> float:
    """Squared error of the coefficients over the rows behind the products, mean over rows and outputs."""
    g = _unpack(held)
    v = np.vstack([-coef, np.eye(coef.shape[1])])
    return float(np.trace(v.T @ g @ v) / coef.shape[1] / g[0, 0])


def solved(products: DataFrame, candidates: DataFrame, outputs: int = 1) -> DataFrame:
    """Candidates with ``coef`` and ``loss`` (mean squared error on the part left out) for each product row they meet.

    They meet on the columns that both have. With several ``outputs`` the last entries of the products are the labels, and
    ``coef`` holds the coefficients of one output after the other.
    """
    shared = [c for c in candidates.columns if c in products.columns]
    rows = products.join(candidates, shared)
    inputs = F.col("inputs") if "inputs" in candidates.columns else F.lit(None).cast("array<int>")
    ridge = F.col("ridge").cast("double") if "ridge" in candidates.columns else F.lit(0.0)

    @F.pandas_udf("coef array<double>, loss double")
    def both(train: pd.Series, held: pd.Series, chosen: pd.Series, penalty: pd.Series) -> pd.DataFrame:
        coefs = [_coefficients(t, c, r, outputs) for t, c, r in zip(train, chosen, penalty)]
        losses = [_squared_error(h, c) if h is not None else None for h, c in zip(held, coefs)]
        return pd.DataFrame({"coef": [c.T.ravel().tolist() for c in coefs], "loss": pd.Series(losses, dtype="float64")})

    out = rows.withColumn("_s", both("train", "held", inputs, ridge))
    keep = [c for c in out.columns if c not in ("train", "held", "_s")]
    return out.select(*keep, "_s.coef", "_s.loss")


def random_search(features: DataFrame, space: dict, n_iter: int, n_segments: int = 5, edges=DECADES, seed: int = 0):
    """Random candidates per lead and fold, rated on the segments left out; returns (history, models).

    ``history``: ``lead, fold, candidate``, the drawn values and ``loss``, the mean over the segments.
    ``models``: ``lead, fold, segment, member, candidate, coef``, the members of the best candidate of each lead and fold,
    fitted again from the products.
    """
    products = segment_products(features, n_segments, edges)
    keys = products.select("lead", "fold").distinct()
    candidates = cut(search.random_candidates(keys, space, n_iter, seed))
    losses = solved(products, candidates).groupBy("lead", "fold", "candidate").agg(F.avg("loss").alias("loss"))
    history = cut(candidates.join(losses, ["lead", "fold", "candidate"]))
    best = search.best_candidate(history, ("lead", "fold")).select("lead", "fold", "candidate")
    chosen = candidates.join(best, ["lead", "fold", "candidate"])
    models = solved(products, chosen).select("lead", "fold", "segment", F.lit(0).alias("member"), "candidate", "coef")
    return history, cut(models)


def ensemble_hindcast(features: DataFrame, models: DataFrame, edges=DECADES) -> DataFrame:
    """``lead, fold, m, target_season, y, mean``: mean of the members that did not see the decade."""
    members = predict_members(features, models, edges)
    return plain_mean(members, ["mean"], ("lead", "fold", "m", "target_season", "y"))


# evolution -------------------------------------------------------------------------------

def fitness(products: DataFrame, population: DataFrame) -> DataFrame:
    """``population`` with ``score``: mean loss over the folds of its lead."""
    columns = population.columns
    return solved(products, population).groupBy(*columns).agg(F.avg("loss").alias("score"))


def evolve(products: DataFrame, space: dict, inputs, n_survivors: int, n_offspring: int, n_new: int, generations: int,
           strength: float = 0.02, seed: int = 0) -> DataFrame:
    """``lead, id, score`` and the genes of the last generation, one population per lead, all advancing together.

    ``inputs`` is the column of feature positions that the genes stand for.
    """
    size, genes = n_survivors + n_offspring + n_new, list(space)
    keys = products.select("lead").distinct()

    def rated(population: DataFrame) -> DataFrame:
        named = population.withColumn("inputs_", inputs)
        plain = named.select("lead", "id", F.col("inputs_").alias("inputs"), *(["ridge"] if "ridge" in genes else []))
        scored = fitness(products, plain).select("lead", "id", "score")
        return cut(population.join(scored, ["lead", "id"]))

    first = search.random_candidates(keys, space, size, seed).withColumnRenamed("candidate", "id")
    population = rated(first)
    for generation in range(1, generations + 1):
        bred = search.breed(population, space, n_survivors, n_offspring, n_new, ("lead",), strength, seed + generation)
        start = {"clone": 0, "offspring": n_survivors, "new": n_survivors + n_offspring}
        offset = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in start.items()])
        population = rated(bred.select("lead", (F.lit(generation * size) + offset + F.col("i")).alias("id"), *genes))
    return population

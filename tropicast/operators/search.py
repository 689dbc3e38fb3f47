"""Hyper-parameter search: random candidates, scoring, evolutionary steps.

A search space maps a name to ``(low, high[, kind])``: kind ``linear`` (default; integer
bounds give integers, tuples give one integer per entry), ``log`` (100 log-spaced values)
or ``exp`` (``(base, (low, high), "exp")``, integer powers); ``([choices], m)`` draws m
different entries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import pick, uniform

LOG_VALUES = 100


def _is_choice(spec) -> bool:
    return isinstance(spec[0], list)


def gene(name: str, spec, *identity, seed: int = 0) -> Column:
    """One random value of a search dimension."""
    ids = (*identity, F.lit(name))
    if _is_choice(spec):
        items, m = spec
        ranked = F.array_sort(F.array(*[
            F.struct(uniform(*ids, F.lit(i), seed=seed).alias("u"), F.lit(v).alias("v")) for i, v in enumerate(items)
        ]))
        return F.transform(F.slice(ranked, 1, m), lambda s: s["v"])
    kind = spec[2] if len(spec) > 2 else "linear"
    if kind == "exp":
        base, (low, high) = spec[0], spec[1]
        return F.pow(F.lit(float(base)), F.lit(low) + pick(high - low + 1, *ids, seed=seed))
    low, high = spec[0], spec[1]
    if kind == "log":
        a, b = math.log10(low), math.log10(high)
        k = pick(LOG_VALUES, *ids, seed=seed)
        return F.pow(F.lit(10.0), F.lit(a) + k * ((b - a) / (LOG_VALUES - 1)))
    if isinstance(low, tuple):
        return F.array(*[
            F.lit(lo) + pick(hi - lo + 1, *ids, F.lit(i), seed=seed) for i, (lo, hi) in enumerate(zip(low, high))
        ])
    if isinstance(low, int) and isinstance(high, int):
        return F.lit(low) + pick(high - low + 1, *ids, seed=seed)
    return F.lit(float(low)) + uniform(*ids, seed=seed) * (float(high) - float(low))


def random_candidates(keys: DataFrame, space: dict, n_iter: int, seed: int = 0) -> DataFrame:
    """``n_iter`` candidates per key row: ``candidate`` and one column per dimension."""
    rows = keys.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    ids = [*keys.columns, "candidate"]
    return rows.select("*", *[gene(n, s, *ids, seed=seed).alias(n) for n, s in space.items()])


def score_candidates(losses: DataFrame, keys=()) -> DataFrame:
    """History: mean validation loss per candidate over its folds."""
    return losses.groupBy(*keys, "candidate").agg(F.avg("loss").alias("loss"))


def best_candidate(history: DataFrame, keys=()) -> DataFrame:
    """Candidate of lowest loss (the first of equal ones)."""
    best = F.min_by(F.struct("candidate", "loss"), F.struct("loss", "candidate"))
    return history.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.candidate", "_b.loss")


def survivors(population: DataFrame, k: int) -> DataFrame:
    """The k individuals of lowest score, with ``rank`` from 0."""
    best = population.orderBy("score", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")) - 1)


def mutate(name: str, spec, value: Column, *identity, strength: float = 0.02, seed: int = 0) -> Column:
    """A gene moved within +-strength of its range and clamped; a list swaps one entry."""
    ids = (*identity, F.lit(name))
    if _is_choice(spec):
        items, m = spec
        fresh = F.filter(F.array(*[F.lit(v) for v in items]), lambda v: ~F.array_contains(value, v))
        new = F.get(fresh, pick(F.greatest(F.size(fresh), F.lit(1)), *ids, F.lit("new"), seed=seed))
        at = pick(m, *ids, F.lit("at"), seed=seed)
        return F.when(F.size(fresh) > 0, F.transform(value, lambda v, i: F.when(i == at, new).otherwise(v))).otherwise(value)
    low, high = spec[0], spec[1]
    moved = value + (high - low) * strength * (2.0 * uniform(*ids, seed=seed) - 1.0)
    if isinstance(low, int):
        moved = moved.cast("int")
    return F.least(F.greatest(moved, F.lit(low)), F.lit(high))


def breed(population: DataFrame, space: dict, n_survivors: int, n_offspring: int, n_new: int, keys=(),
          strength: float = 0.02, seed: int = 0) -> DataFrame:
    """``keys, kind, i`` and genes: mutated clones of the survivors, mutated gene-wise offspring and random newcomers.

    ``population`` has ``keys, id, score`` and one column per gene. Every gene of a child names the rank of the survivor it
    comes from and finds it in a join on key and rank, so survivors are rows, however many there are.
    """
    keys, genes = list(keys), list(space)
    order = Window.partitionBy(*keys).orderBy("score", "id") if keys else Window.orderBy("score", "id")
    best = population.withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < n_survivors)
    counts = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n")) for kind, n in
                      (("clone", n_survivors), ("offspring", n_offspring), ("new", n_new)) if n])
    rows = counts.select(*keys, "_n", F.explode(kinds).alias("k"))
    rows = rows.select(*keys, "_n", "k.kind", F.explode(F.sequence(F.lit(0), F.col("k.n") - 1)).alias("i"))
    ids = [*keys, "kind", "i"]
    wanted = rows.where("kind <> 'new'").withColumn("_gene", F.explode(F.array(*[F.lit(g) for g in genes])))
    drawn = pick(F.col("_n"), *ids, "_gene", F.lit("parent"), seed=seed)
    wanted = wanted.withColumn("_rank", F.when(F.col("kind") == "clone", F.col("i")).otherwise(drawn))
    found = wanted.join(best.select(*keys, "_rank", *genes), [*keys, "_rank"])
    parents = found.groupBy(*ids).agg(*[F.max(F.when(F.col("_gene") == g, F.col(g))).alias(g) for g in genes])
    children = parents.select(*ids, *[mutate(n, s, F.col(n), *ids, strength=strength, seed=seed).alias(n) for n, s in space.items()])
    fresh = rows.where("kind = 'new'").select(*ids, *[gene(n, s, *ids, seed=seed).alias(n) for n, s in space.items()])
    return children.unionByName(fresh)


def next_generation(population: DataFrame, space: dict, n_survivors: int, n_offspring: int, n_new: int,
                    strength: float = 0.02, seed: int = 0) -> DataFrame:
    """One population without keys: see ``breed``."""
    return breed(population, space, n_survivors, n_offspring, n_new, (), strength, seed)

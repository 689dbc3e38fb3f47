"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are rows labelled good; unlabelled are all texts of the training
split, whatever their label. The share of good texts among the unlabelled (the class prior) is estimated
from a first model that only tells trusted from unlabelled: the smallest ratio, over thresholds, of
the unlabelled to the positive rows above it. The second model minimises
``prior * risk(positives as good) + max(0, risk(unlabelled as bad) - prior * risk(positives as bad))``
with the logistic loss; a step in which the second term is negative goes back along its gradient.

A text is described by bounded shares and logarithms of its characters, words and lines, which all cover the
whole text. The fit takes at most ``bound`` positives and ``bound`` unlabelled rows, those with
the lowest hash of their id; scoring is a plain map over all rows.

Defined results: a NULL or empty text is scored like any other; a NULL doc_id counts as training split
and joins no label; repeated labels of a document count once each; with no positives or no
unlabelled rows every score is 1 (nothing is known against a text); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

BOUND = 12_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
_PUNCTUATION = [ord(c) for c in "#$%&*|!<>{}[]=+~^\\/_@"]
_MARKS = [ord(c) for c in ".,;:?'\"-()"]


def describe(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * 22
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    count = max(1, len(words))
    tally = Counter(words)
    top = tally.most_common(3)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / count
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = raw.split(b"\n")
    alone = sum(not w.isalnum() and w.isascii() and len(w) == 1 for w in words) / count
    return [
        np.log1p(n), np.log1p(count), np.log1p(len(lines)),
        float(seen[97:123].sum()), float(seen[65:91].sum()), float(seen[48:58].sum()), float(seen[128:].sum()),
        float(seen[_PUNCTUATION].sum()), float(seen[_MARKS].sum()), float(seen[33]), float(seen[124]), float(seen[[9, 10, 13, 32]].sum()),
        len(tally) / count, float(np.log(count)) * len(tally) / count, top[0][1] / count if top else 0.0,
        sum(c for _, c in top) / count, repeats, float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        len(set(lines)) / len(lines), alone,
    ]


def _described(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([describe(t) for t in batch])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """One hidden layer over standardised features."""

    def __init__(self, features: np.ndarray, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
        d = features.shape[1]
        self.parts = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]
        self.steps = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(z @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.standard(x)))

    def step(self, z: np.ndarray, pull: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """One step against the gradient, given the derivative of the risk by each margin."""
        w, b, v, _ = self.parts
        h = np.tanh(z @ w + b)
        back = np.outer(pull, v) * (1 - h * h)
        grads = [z.T @ back + decay * w, back.sum(0), h.T @ pull + decay * v, np.array([pull.sum()])]
        self.steps += 1
        for i, g in enumerate(grads):
            m, s = self.moments[i]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            fix = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
            self.parts[i] = self.parts[i] - rate * fix * m / (np.sqrt(s) + 1e-8)


def _batches(n_p: int, n_u: int, steps: int, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    for _ in range(steps):
        yield rng.integers(0, n_p, min(size, n_p)), rng.integers(0, n_u, min(size, n_u))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1000, tail: float = 0.1) -> float:
    """Share of positives among the unlabelled: the smallest ratio of rows above a threshold.

    The first half of the rows trains the model that ranks them, the second half is counted; only
    thresholds that leave at least ``tail`` of the positives above them are looked at.
    """
    p, u = positive[::2], unlabelled[::2]
    model = Model(np.concatenate([p, u]), hidden=12)
    zp, zu = model.standard(p), model.standard(u)
    for i, j in _batches(len(p), len(u), steps, 256, 1):
        a, b = _sigmoid(model.margin(zp[i])), _sigmoid(model.margin(zu[j]))
        model.step(np.concatenate([zp[i], zu[j]]), np.concatenate([(a - 1) / len(i), b / len(j)]), 3e-3)
    held_p, held_u = (positive[1::2], unlabelled[1::2]) if min(len(positive), len(unlabelled)) > 1 else (positive, unlabelled)
    sp, su = np.sort(model.score(held_p)), np.sort(model.score(held_u))
    cuts = np.quantile(sp, np.linspace(0, 1 - tail, 200))
    above_p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
    spread = np.sqrt(np.maximum(above_u * (1 - above_u), 1e-6) / len(su))
    return float(np.clip(((above_u + spread) / above_p).min(), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2500, size: int = 256) -> Model:
    """Minimise the non-negative unbiased risk."""
    model = Model(np.concatenate([positive, unlabelled]))
    zp, zu = model.standard(positive), model.standard(unlabelled)
    for t, (i, j) in enumerate(_batches(len(zp), len(zu), steps, size, 2)):
        mp, mu = model.margin(zp[i]), model.margin(zu[j])
        as_good, as_bad, bad_u = _sigmoid(mp) - 1, _sigmoid(mp), _sigmoid(mu)
        negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        z = np.concatenate([zp[i], zu[j]])
        rate = 4e-3 * (1 - t / steps) + 1e-4
        if negative >= 0:
            pull = np.concatenate([prior * (as_good - as_bad) / len(i), bad_u / len(j)])
        else:
            pull = -np.concatenate([-prior * as_bad / len(i), bad_u / len(j)])
        model.step(z, pull, rate)
    return model


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model | None:
    """Train on at most about ``bound`` trusted positives and ``bound`` unlabelled rows of the training split."""
    fold = remainder("doc_id", FOLDS)
    inside = docs.where(F.coalesce(fold != HELD_OUT, F.lit(True))).select("doc_id", "text")
    trusted = labels.where((F.col("quality") == 1) & (remainder("doc_id", FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("_p"))
    turn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    other = F.pmod(F.xxhash64(F.lit("rest"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    n_p, n_u = trusted.count(), inside.count()
    # the ids of the sample, at most about ``bound`` of each kind
    chosen_p = trusted.where(F.pmod(F.xxhash64(F.lit("fit"), "_p"), F.lit(1 << 40)) / float(1 << 40) < bound / max(n_p, 1))
    unlabelled = inside.where(other < bound / max(n_u, 1)).withColumn("kind", F.lit(0))
    positive = inside.where(turn < bound / max(n_p, 1)).join(chosen_p.distinct(), F.col("doc_id") == F.col("_p"), "left_semi")
    both = unlabelled.unionByName(positive.withColumn("kind", F.lit(1)))
    rows = both.select("doc_id", "kind", F.pandas_udf(_described, "array<double>")("text").alias("x")).toPandas()
    if rows.empty or rows["kind"].nunique() < 2:
        return None
    rows = rows.sort_values(["kind", "doc_id"], ignore_index=True)
    x, kind = np.stack(rows["x"].to_numpy()), rows["kind"].to_numpy()
    order = np.random.default_rng(0).permutation(len(x))
    x, kind = x[order], kind[order]
    return train(x[kind == 1], x[kind == 0], estimate_prior(x[kind == 1], x[kind == 0]))


def with_score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``score`` to every row."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            if model is None:
                yield pd.Series(np.ones(len(batch)))
            elif len(batch):
                yield pd.Series(model.score(np.array([describe(t) for t in batch])))
            else:
                yield pd.Series(dtype="float64")
    return docs.withColumn("score", F.pandas_udf(run, "double")("text"))


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts, with their own columns."""
    scored = with_score(docs.withColumnRenamed("score", "_own_score") if "score" in docs.columns else docs, fit(docs, labels))
    kept = scored.where(F.col("score") >= THRESHOLD).drop("score")
    return (kept.withColumnRenamed("_own_score", "score") if "score" in docs.columns else kept).select(*docs.columns)

"""Empirical orthogonal functions of gridded fields.

A cell's whole series is packed once into one array over the time axis, so a pass over the field is a scan
of a row per cell: no join, and one shuffle, of the partial sums. The patterns come from a block Krylov
iteration on the times: a pass multiplies a block of vectors over the months by the matrix of products between
months, as sums over cells inside the tasks, and only blocks of months by a few columns reach the driver. Cells stay
distributed, whatever their number; the time axis is a calendar. Axes of up to ``ONE_PASS`` months take a
single pass, since the block then spans all months; longer ones end when the residuals are small, or at the latest when the
blocks span all there is, so a fit always ends.

Several ``folds`` (months left out) advance in the same passes: each has its own trend, means and patterns,
taken from its other months alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .learners import sum_arrays

ONE_PASS = 447  # block elements stay below 200 000
BLOCK_ELEMENTS = 200_000
BASIS = 600  # columns after which the iteration begins anew from its best vectors


@dataclass
class Packed:
    """A row per cell: ``values``, its series from month ``first`` on, gaps as 0."""

    table: DataFrame
    first: int
    length: int
    cell: tuple


def pack(df: DataFrame, cell=("lat", "lon")) -> Packed:
    """Months-by-cells matrix of ``cell, m, value``; missing values count as 0."""
    cell = tuple(cell)
    sparse = cut(df.groupBy(*cell).agg(F.collect_list(F.struct("m", "value")).alias("s")))
    ends = sparse.agg(F.min(F.array_min("s.m")).alias("a"), F.max(F.array_max("s.m")).alias("b")).first()
    first, length = (0, 0) if ends["a"] is None else (int(ends["a"]), int(ends["b"]) - int(ends["a"]) + 1)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sparse.select(*cell).schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(cell))
            flat, n = lists.flatten(), batch.num_rows
            m = np.asarray(flat.field("m")) - first
            value = np.asarray(flat.field("value").cast(pa.float64()).fill_null(0.0))
            row = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
            full = np.zeros((n, length))
            full[row, m] = np.nan_to_num(value, posinf=np.inf, neginf=-np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cell)], _lists(full)], [*cell, "values"])

    return Packed(cut(sparse.mapInArrow(fill, f"{names}, values array<double>")), first, length, cell)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def _residuals(v: np.ndarray, mask: np.ndarray, detrend: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All months less the line (or the mean) of the months in ``mask``; its intercepts and slopes."""
    t = np.arange(v.shape[1], dtype=float)
    seen = max(int(mask.sum()), 1)
    centre, mean = t[mask].sum() / seen, v[:, mask].sum(axis=1) / seen
    spread = ((t[mask] - centre) ** 2).sum()
    slope = v[:, mask] @ (t[mask] - centre) / spread if detrend and spread > 0 else np.zeros(len(v))
    intercept = mean - slope * centre
    return v - intercept[:, None] - slope[:, None] * t, intercept, slope


def detrended(df: DataFrame, cell=("lat", "lon")) -> DataFrame:
    """Full months-by-cells matrix: missing values 0, then linear detrending per cell."""
    packed, cell = pack(df, cell), list(cell)
    length = packed.length
    kind = df.schema["m"].dataType.simpleString()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.table.select(*cell).schema)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, _, _ = _residuals(_matrix(batch, length), np.ones(length, bool), True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(rest)], [*cell, "values"])

    rows = packed.table.mapInArrow(lines, f"{names}, values array<double>").select(*cell, F.posexplode("values").alias("_t", "value"))
    return rows.select(*cell, (F.col("_t") + packed.first).cast(kind).alias("m"), "value")


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, length)


class _Fold:
    """The driver's side of one fold: orthonormal vectors over the months and their products with the matrix."""

    def __init__(self, mask: np.ndarray, k: int):
        self.mask, self.k, self.done = mask, k, not mask.any()
        self.q = self.gq = np.zeros((len(mask), 0))
        self.values, self.vectors, self.total = np.zeros(0), np.zeros((len(mask), 0)), None

    def start(self, width: int) -> np.ndarray:
        """Random vectors over the months of the fold; all of them where there is room."""
        rows = np.flatnonzero(self.mask)
        self.block = np.zeros((len(self.mask), min(width, len(rows))))
        if len(rows) <= width:
            self.block[rows, np.arange(len(rows))] = 1.0
        else:
            self.block[rows] = np.linalg.qr(np.random.default_rng(29).normal(size=(len(rows), width)))[0]
        return self.block

    def add(self, product: np.ndarray, tol: float) -> None:
        """Take in the products of the block; find the leading pairs, and the next block or the end."""
        before = self.values[:self.k]
        self.q, self.gq = np.hstack([self.q, self.block]), np.hstack([self.gq, product])
        inner = self.q.T @ self.gq
        values, basis = np.linalg.eigh((inner + inner.T) / 2.0)
        values, basis = values[::-1], basis[:, ::-1]
        k = min(self.k, len(values))
        self.values, self.vectors = np.maximum(values[:k], 0.0), self.q @ basis[:, :k]
        top = max(values[0], 0.0)
        rest = np.linalg.norm(self.gq @ basis[:, :k] - self.vectors * values[:k], axis=0)
        still = len(before) == k and (self.values - before <= 1e-14 * top).all()
        if top <= 0 or (rest <= tol * top).all() or still or self.q.shape[1] >= self.mask.sum():
            self.done = True
            return
        if self.q.shape[1] + self.block.shape[1] > max(BASIS, 3 * self.block.shape[1]):
            keep = basis[:, :k + self.block.shape[1]]
            self.q, self.gq = self.q @ keep, self.gq @ keep
        fresh = product
        for _ in range(2):
            fresh = fresh - self.q @ (self.q.T @ fresh)
        left, size, _ = np.linalg.svd(fresh, full_matrices=False)
        self.block = left[:, size > 1e-11 * top]
        self.block = self.block - self.q @ (self.q.T @ self.block)
        if not self.block.shape[1]:
            self.done = True
            return
        self.block = np.linalg.qr(self.block)[0]


def _sums(packed: Packed, blocks: dict, detrend: bool, masked: bool, raw: bool = False) -> DataFrame:
    """``fold, j, v``: sums over the cells of residuals (rows of months) times what the fold's months give in column j.

    Column -1 holds the sum of squares of the fold's months. ``masked`` keeps to the months of the fold; ``raw`` puts the values in
    place of the residuals.
    """
    length = packed.length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(w.shape) for f, (w, _) in blocks.items()}
        square, some = dict.fromkeys(blocks, 0.0), False
        for batch in batches:
            if not batch.num_rows:
                continue
            v, some = _matrix(batch, length), True
            for f, (w, mask) in blocks.items():
                rest, _, _ = _residuals(v, mask, detrend)
                own = np.where(mask, rest, 0.0)
                total[f] += (own if masked else v if raw else rest).T @ (own @ w)
                square[f] += float((own * own).sum())
        if some:
            for f, sums in total.items():
                rows = [*sums.T.tolist(), [square[f]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(rows), pa.int32()), pa.array([*range(len(rows) - 1), -1], pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                    ["fold", "j", "v"])

    parts = packed.table.select("values").mapInArrow(task, "fold int, j int, v array<double>")
    return sum_arrays(parts, ["fold", "j"], "v")


class Eof:
    """A fitted decomposition: its patterns, amplitudes and explained variance, for each fold."""

    def __init__(self, packed: Packed, folds: dict, detrend: bool, single: bool):
        self.packed, self.cell, self.folds = packed, list(packed.cell), folds
        self._detrend, self._single = detrend, single
        self.basis, self._signs = self._loadings()
        ratios = {f: [float(v) / s.total if s.total else None for v in s.values] for f, s in folds.items()}
        for f, s in folds.items():
            ratios[f] += [0.0 if s.total else None] * (s.k - len(ratios[f]))
        self.explained = next(iter(ratios.values())) if single else ratios

    def _weights(self) -> dict:
        """Vectors that turn a cell's months into its loadings; 0 for modes beyond the rank."""
        out = {}
        for f, s in self.folds.items():
            top = max(float(s.values[0]) if len(s.values) else 0.0, 1e-300)
            scale = np.array([1.0 / np.sqrt(v) if v > 1e-12 * top else 0.0 for v in s.values])
            weights = np.zeros((self.packed.length, s.k))
            weights[:, :len(scale)] = s.vectors * scale
            out[f] = (weights, s.mask)
        return out

    def _loadings(self) -> tuple[DataFrame, dict]:
        """``cell, fold, loadings, intercept, slope`` and the signs that make each largest loading positive."""
        weights, length, detrend = self._weights(), self.packed.length, self._detrend
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.packed.table.select(*self.cell).schema)
        cell = self.cell
        own = len(cell)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch, length)
                for f, (w, mask) in weights.items():
                    rest, intercept, slope = _residuals(v, mask, detrend)
                    loadings = np.where(mask, rest, 0.0) @ w
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:own], pa.array([f] * len(v), pa.int32()), _lists(loadings), pa.array(intercept), pa.array(slope)],
                        [*cell, "fold", "loadings", "intercept", "slope"])

        schema = f"{names}, fold int, loadings array<double>, intercept double, slope double"
        basis = cut(self.packed.table.mapInArrow(task, schema))
        largest = basis.select("fold", F.posexplode("loadings").alias("j", "x")).groupBy("fold", "j").agg(F.max_by("x", F.abs("x")).alias("x"))
        signs = {f: np.ones(s.k) for f, s in self.folds.items()}
        for r in largest.collect():
            signs[r["fold"]][r["j"]] = -1.0 if r["x"] < 0 else 1.0
        return basis, signs

    def signed(self) -> DataFrame:
        """``cell, fold, loadings, intercept, slope`` with the signs of the patterns."""
        rows = [(f, s.tolist()) for f, s in self._signs.items()]
        signs = self.basis.sparkSession.createDataFrame(rows, "fold int, _signs array<double>")
        joined = self.basis.join(signs, "fold")
        return joined.withColumn("loadings", F.zip_with("loadings", "_signs", lambda a, b: a * b)).drop("_signs")

    @property
    def patterns(self) -> DataFrame:
        """``cell, mode, loading`` (and ``fold``), unit vectors over the cells."""
        keys = [*self.cell] if self._single else [*self.cell, "fold"]
        rows = self.signed().select(*keys, F.posexplode("loadings").alias("_j", "loading"))
        return rows.select(*keys, (F.col("_j") + 1).alias("mode"), "loading")

    def project(self, matrix: DataFrame | None = None) -> DataFrame:
        """Amplitudes ``mode, m, value`` (and ``fold``) of a matrix (its own by default, all months), not centred again."""
        keys = ["mode", "m"] if self._single else ["fold", "mode", "m"]
        if matrix is not None:
            rows = matrix.join(self.patterns, self.cell)
            return rows.groupBy(*keys).agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
        blocks = {f: (w * self._signs[f], mask) for f, (w, mask) in self._weights().items()}
        sums = _sums(self.packed, blocks, self._detrend, masked=False, raw=not self._detrend).where("j >= 0")
        rows = sums.select("fold", (F.col("j") + 1).alias("mode"), F.posexplode("v").alias("_t", "value"))
        return rows.withColumn("m", (F.col("_t") + self.packed.first).cast("int")).select(*keys, "value")

    def explained_variance(self) -> DataFrame:
        spark = self.basis.sparkSession
        if self._single:
            return spark.createDataFrame(list(enumerate(self.explained, 1)), "mode int, ratio double")
        rows = [(f, j, v) for f, ratios in self.explained.items() for j, v in enumerate(ratios, 1)]
        return spark.createDataFrame(rows, "fold int, mode int, ratio double")


def fit(field: DataFrame | Packed, k: int = 3, cell=("lat", "lon"), detrend: bool = False, folds: dict | None = None, tol: float = 1e-8) -> Eof:
    """Leading ``k`` patterns of ``cell, m, value`` (missing values 0), unit vectors over the cells.

    Each cell's mean, or its linear trend with ``detrend``, is taken out first. ``folds`` maps a number to the months
    (first, end) it leaves out. A fold ends when the residual of each pattern is below ``tol`` of the largest eigenvalue. Signs are fixed
    so that the loading of largest magnitude is positive; a mode beyond the rank has zero loadings. An empty field has no patterns.
    """
    packed = field if isinstance(field, Packed) else pack(field, cell)
    months = packed.first + np.arange(packed.length)
    left_out = {0: None} if folds is None else folds
    states = {f: _Fold(np.ones(packed.length, bool) if out is None else ~((months >= out[0]) & (months < out[1])), k) for f, out in left_out.items()}
    width = max(k + 8, min(packed.length, BLOCK_ELEMENTS // max(packed.length, 1)))
    for s in states.values():
        if not s.done:
            s.start(width)
    while not all(s.done for s in states.values()):
        open_ = {f: s for f, s in states.items() if not s.done}
        found = {(r["fold"], r["j"]): r["v"] for r in _sums(packed, {f: (s.block, s.mask) for f, s in open_.items()}, detrend, masked=True).collect()}
        for f, s in open_.items():
            s.total = found[f, -1][0]
            s.add(np.array([found[f, j] for j in range(s.block.shape[1])]).T, tol)
    return Eof(packed, states, detrend, folds is None)


def pattern_map(eof: Eof, field: DataFrame, mode: int = 1) -> DataFrame:
    """One pattern as a map; cells missing at the last time are masked."""
    cell = list(eof.cell)
    last = field.agg(F.max("m")).scalar()
    alive = field.withColumn("_last", last).where((F.col("m") == F.col("_last")) & F.col("value").isNotNull())
    rows = eof.patterns.where(F.col("mode") == mode)
    marked = rows.join(alive.select(*cell, F.lit(True).alias("_on")), cell, "left")
    return marked.select(*cell, F.when(F.col("_on"), F.col("loading")).alias("loading"))


def wide_projection(pc: DataFrame, k: int = 3) -> DataFrame:
    """``m, pca1 .. pcak`` table (with ``fold`` where the amplitudes have one)."""
    picks = [F.max(F.when(F.col("mode") == j, F.col("value"))).alias(f"pca{j}") for j in range(1, k + 1)]
    return pc.groupBy(*[c for c in ("fold", "m") if c in pc.columns]).agg(*picks)

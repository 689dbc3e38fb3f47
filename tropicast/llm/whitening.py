"""Embedding whitening from exact variances: cross-covariances by polarisation.

Entries become integers (``levels``), so all sums are exact. A first pass counts the vectors and
sums every dimension. A second pass centres each value at the whole part of its dimension's mean and
adds up the squares of every dimension and of the sum of every two dimensions, as integers of any size; the
fractions of the means are put right exactly afterwards. The variance of a sum less the two variances is
twice the covariance, so the d (d + 1) / 2 sums of squares hold the whole covariance matrix. It alone
reaches the driver, as d (d + 1) / 2 + d numbers whatever the number of rows, and its
eigenvectors travel with the tasks of the third pass, which whitens.

Defined results: a vector that is NULL, holds a NULL, NaN or infinite entry or one of 2**47 or more (whose
level a double cannot tell from its neighbours), or is shorter than the longest vector, is dropped; equal vectors count as often as they occur; a NULL id is kept; other
columns are ignored; directions without variance (fewer independent vectors than dimensions, constant dimensions) have NULL
``whitened`` and stay out of ``identity_error``; a deviation beyond the range of a long is NULL; an empty table, or one of
empty vectors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK = 1024
SAFE = 1 << 62
EXACT = "decimal(38,0)"


def complete(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has only finite entries with levels that are longs."""
    ends = float(1 << 53)
    fine = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < ends, F.lit(False)))
    return vectors.where(F.col(column).isNotNull() & fine)


def levels(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of every entry, as integers."""
    return np.floor(SCALE * entries.astype(np.float64)).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the vectors of ``size`` entries, and which rows those are."""
    whole = np.asarray(column.value_lengths()) == size
    flat = column.filter(pa.array(whole)).flatten()
    return levels(np.asarray(flat).reshape(-1, size)), np.flatnonzero(whole)


def _column_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the columns of an integer matrix."""
    if not values.size:
        return [0] * values.shape[1]
    largest = max(abs(int(values.min())), abs(int(values.max())))
    if largest * len(values) < SAFE:
        return values.sum(axis=0).tolist()
    return [int(s) for s in values.astype(object).sum(axis=0)]


def _square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the squares of the columns of an integer matrix."""
    if not values.size:
        return [0] * values.shape[1]
    largest = max(abs(int(values.min())), abs(int(values.max())))
    if largest * largest * len(values) < SAFE:
        return np.einsum("ij,ij->j", values, values).tolist()
    wide = values.astype(object)
    return [int(s) for s in (wide * wide).sum(axis=0)]


def _totals(vectors: DataFrame, column: str, size: int, width: int, sums) -> tuple[int, list[int]]:
    """Rows, and exact totals of the ``width`` sums that ``sums`` makes of a block of levels.

    A task adds up its own blocks and hands on one row a sum.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * width
        for batch in batches:
            x, _ = _matrix(batch.column(0), size)
            rows += len(x)
            for at in range(0, len(x), BLOCK):
                total = [a + b for a, b in zip(total, sums(x[at:at + BLOCK]), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, width), pa.int32()), pa.array([Decimal(t) for t in (rows, *total)], pa.decimal128(38, 0))], ["at", "part"])

    parts = vectors.select(column).mapInArrow(task, f"at int, part {EXACT}")
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


@dataclass
class Whitening:
    """Means, covariance and components of the fitted vectors."""

    size: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  # falling eigenvalues
    components: np.ndarray  # a unit eigenvector a row
    usable: int  # components with variance

    @property
    def explained(self) -> np.ndarray:
        """Share of every component in the whole variance; NaN where there is none."""
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.full(len(self.values), np.nan)


def covariances(vectors: DataFrame, column: str, size: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums of the dimensions, and the covariance matrix (divisor n), each entry rounded once."""
    n, sums = _totals(vectors, column, size, size, _column_sums)
    if not n:
        return 0, sums, np.zeros((size, size))
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    left, right = np.triu_indices(size, 1)

    def squares(x: np.ndarray) -> list[int]:
        y = x - whole
        return _square_sums(y) + _square_sums(y[:, left] + y[:, right])

    _, total = _totals(vectors, column, size, size + len(left), squares)
    # n * n * variance of every dimension and of every sum of two
    spread = [n * q - r * r for q, r in zip(total[:size], rest, strict=True)]
    matrix = np.zeros((size, size))
    for i, s in enumerate(spread):
        matrix[i, i] = s / (n * n)
    for i, j, q in zip(left.tolist(), right.tolist(), total[size:], strict=True):
        both = n * q - (rest[i] + rest[j]) ** 2
        matrix[i, j] = matrix[j, i] = (both - spread[i] - spread[j]) / (2 * n * n)
    return n, sums, matrix


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """Components of the complete vectors of the table."""
    rows = complete(vectors, column)
    size = rows.agg(F.max(F.size(column))).first()[0] or 0
    n, sums, matrix = covariances(rows, column, size) if size else (0, [], np.zeros((0, 0)))
    values, unit = np.linalg.eigh(matrix) if size else (np.zeros(0), np.zeros((0, 0)))
    values, unit = values[::-1].copy(), unit[:, ::-1].T.copy()
    floor = size * np.finfo(float).eps * float(values[0]) if size else 0.0
    return Whitening(size, n, sums, matrix, values, unit, int((values > max(floor, 0.0)).sum()))


def _deviations(y: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sum over the dimensions of (n x - S) ** 2; None beyond a long."""
    rough = ((n * y.astype(np.float64) - np.array(rest, np.float64)) ** 2).sum(axis=1)
    if not len(y) or rough.max() < 2.0 ** 60 and n < 1 << 31:
        w = n * y - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", w, w).tolist()
    out = []
    for row, about in zip(y.tolist(), rough.tolist(), strict=True):
        exact = sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) if about < 2.0 ** 64 else SAFE * 2
        out.append(exact if exact < SAFE * 2 else None)
    return out


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Every complete row with ``deviation`` and ``whitened`` (up to ``count`` components, NULL without variance)."""
    size, n, shown = model.size, model.n, min(count, model.size)
    base = np.array([s // n for s in model.sums], dtype=np.int64) if n else np.zeros(0, np.int64)
    rest = [s % n for s in model.sums] if n else []
    used = min(shown, model.usable)
    turn = (model.components[:used] / np.sqrt(model.values[:used])[:, None]).T
    others = [c for c in vectors.columns if c not in (column, "deviation", "whitened")]
    rows = complete(vectors, column).where(F.size(column) == size).select(*others, column)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, _ = _matrix(part.column(len(others)), size)
                y = x - base
                white = np.full((len(x), shown), np.nan)
                white[:, :used] = (y - np.array(rest, np.float64) / n) @ turn
                flat = pa.array(white.ravel(), mask=np.tile(np.arange(shown) >= used, len(x)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * shown), flat)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(others)], pa.array(_deviations(y, rest, n), pa.int64()), lists], [*others, "deviation", "whitened"])

    return rows.mapInArrow(task, f"{names}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, used: int, n: int) -> float | None:
    """Largest absolute entry of the covariance of the first ``used`` whitened components less the identity, over all rows."""
    if not used or not n:
        return None
    up = np.triu_indices(used)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, some = np.zeros(used), np.zeros((used, used)), False
        for batch in batches:
            lists = batch.column(0)
            if len(lists):
                z = np.asarray(lists.flatten().fill_null(0.0)).reshape(len(lists), -1)[:, :used]
                first, second, some = first + z.sum(axis=0), second + z.T @ z, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(used + len(up[0])), pa.int32()), pa.array([*first, *second[up]])], ["at", "part"])

    parts = whitened.select("whitened").mapInArrow(task, "at int, part double")
    total = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    # the whitened values are centred: their means are rounding errors
    mean = np.array([total[i] for i in range(used)]) / n
    second = np.array([total[used + k] for k in range(len(up[0]))]) / n
    return float(np.abs(second - mean[up[0]] * mean[up[1]] - (up[0] == up[1])).max())


def op11_whitening(embeddings: DataFrame) -> DataFrame:
    """Whitened value of every complete vector on each of the first 32 components."""
    source = embeddings.select("vec_id", "embedding")
    model = fit(source)
    if not model.size:
        empty = "vec_id, 0 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error"
        return source.where("false").selectExpr(*empty.split(", "))
    table = cut(whiten(source, model))
    error = identity_error(table, min(COMPONENTS, model.usable), model.n)
    shares = F.lit([float(v) for v in model.explained[:COMPONENTS]])
    rows = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.nanvl(F.get(shares, F.col("at")), F.lit(None).cast("double")).alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))

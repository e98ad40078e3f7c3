"""Embedding whitening by shifted CholeskyQR of the centred vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
# Entries beyond this would not be exact whole numbers.
LARGEST = float(1 << 40)
ROWS = 4096
_UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """What a fit holds: ``n`` vectors, their sums, and the components.

    ``axes`` has a unit component in each column; ``values`` are their eigenvalues and ``trace`` is
    the sum of all. ``covariance`` is that of the vectors' coordinates on these axes, as measured.
    """

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    covariance: np.ndarray

    def identity_error(self, most: int) -> float:
        """Largest absolute entry of the covariance of ``most`` whitened coordinates minus the identity."""
        scale = np.sqrt(self.values[:most])
        size = len(scale)
        return float(np.abs(self.covariance[:size, :size] / np.outer(scale, scale) - np.eye(size)).max(initial=0.0))


def usable(vectors: pa.ListArray) -> np.ndarray:
    """Which vectors are neither null nor hold null or non-finite entries."""
    sizes = np.diff(vectors.offsets.to_numpy())
    good = vectors.is_valid().to_numpy(zero_copy_only=False)
    values = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
    entries = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.cumsum(np.r_[0, ~np.isfinite(entries)])
    ends = np.cumsum(sizes)
    return good & (bad[ends] == bad[ends - sizes])


def whole_numbers(vectors: pa.ListArray) -> np.ndarray:
    """The vectors, all of one length and usable, as whole numbers, one in each row."""
    entries = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(SCALE * entries)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise OverflowError("an entry is too large to be made a whole number exactly")
    return (scaled.astype(np.int64) + OFFSET).reshape(len(vectors), -1)


def _lists(column: pa.Array) -> pa.ListArray:
    return column.cast(pa.list_(column.type.value_type)) if pa.types.is_large_list(column.type) else column


def _of_length(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The usable rows of a batch with vectors of this length."""
    vectors = _lists(batch.column("vector"))
    fit = usable(vectors) & (np.diff(vectors.offsets.to_numpy()) == length)
    return batch.filter(pa.array(fit))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length and dimension: how many usable vectors, and their sum."""
    totals: dict[int, list] = {}
    for batch in batches:
        vectors = _lists(batch.column("vector"))
        sizes, good = np.diff(vectors.offsets.to_numpy()), usable(vectors)
        for length in np.unique(sizes[good & (sizes > 0)]):
            x = whole_numbers(vectors.filter(pa.array(good & (sizes == length))))
            n, sums = totals.get(int(length), (0, np.zeros(length, np.int64)))
            totals[int(length)] = (n + len(x), sums + x.sum(axis=0))
    for length, (n, sums) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(length, length)), pa.array(np.arange(length)), pa.array(np.full(length, n)), pa.array(sums)],
            ["length", "dim", "n", "total"],
        )


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exactly."""
    if n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 62:
        raise OverflowError("too many vectors for exact 64-bit deviations")
    return n * x - sums


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular factor, by substitution."""
    out = rows.copy()
    for j in range(factor.shape[0]):
        if j:
            out[:, j] -= out[:, :j] @ factor[:j, j]
        out[:, j] /= factor[j, j]
    return out


def _gram(n: int, sums: np.ndarray, factors: list[np.ndarray], axes: np.ndarray | None):
    """The partition's share of the Gram matrix (and of the sums) of the rows after these factors."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(sums)
        total, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            fit = _of_length(batch, len(sums))
            for start in range(0, fit.num_rows, ROWS):
                rows = centred(whole_numbers(_lists(fit.slice(start, ROWS).column("vector"))), n, sums) / n
                for factor in factors:
                    rows = solved(rows, factor)
                if axes is not None:
                    rows = rows @ axes
                total += rows.T @ rows
                first += rows.sum(axis=0)
        low, high = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[low, np.full(size, -1)]), pa.array(np.r_[high, np.arange(size)]), pa.array(np.r_[total[low, high], first])],
            ["low", "high", "value"],
        )

    return gram


def _distributed_gram(vectors: DataFrame, *args) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of all rows; entries are added up in Spark, and d * d of them come here."""
    parts = vectors.mapInArrow(_gram(*args), "low long, high long, value double")
    cells = parts.groupBy("low", "high").agg(F.sum("value").alias("value")).toArrow()
    low, high, value = (cells[c].to_numpy() for c in ("low", "high", "value"))
    size = int(high.max()) + 1
    gram, first = np.zeros((size, size)), np.zeros(size)
    first[high[low < 0]] = value[low < 0]
    inside = low >= 0
    gram[low[inside], high[inside]] = gram[high[inside], low[inside]] = value[inside]
    return gram, first


def fit_whitening(table: DataFrame, vector_col: str = "embedding", passes: int = 3) -> Whitening | None:
    """Fit on all vectors of ``table``; ``None`` if it has no usable one.

    Entries become whole numbers first, so that sums and centred rows are exact. Each pass
    adds up the Gram matrix of the rows in the tasks, d * d numbers a partition, and takes its
    Cholesky factor; rows of the next pass are solved by the factors so far. The first pass
    shifts the matrix so that its factor exists however badly conditioned the rows are; those that
    follow bring the rows to orthogonality. The singular vectors of the factors' product are the
    components. Directions in which the rows do not differ, to double precision, are no
    components: there are fewer then.
    """
    vectors = table.select(F.col(vector_col).alias("vector"))
    of_dims = vectors.mapInArrow(_sums, "length long, dim long, n long, total long")
    of_dims = of_dims.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    of_lengths = of_dims.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("sums"))
    best = of_lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return None
    n, sums = best["n"], np.array([s["total"] for s in best["sums"]], np.int64)
    d = len(sums)

    factors: list[np.ndarray] = []
    product = np.eye(d)
    for step in range(passes):
        gram, _ = _distributed_gram(vectors, n, sums, factors, None)
        largest = float(np.linalg.norm(gram, 2))
        if largest == 0:
            return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros((0, 0)))
        shift = 11 * (n * d + d * (d + 1)) * _UNIT * largest
        if step:
            # Only directions without any variance are left with nothing here; a trace of a
            # shift lets the factor exist and leaves all others as they are.
            shift = d * _UNIT * largest if np.linalg.eigvalsh(gram)[0] < 0.25 * largest else 0.0
        factor = np.linalg.cholesky(gram + min(shift, largest) * np.eye(d)).T
        factors.append(factor)
        product = factor @ product
    _, singular, axes = np.linalg.svd(product)
    # A direction of no variance holds what the shifts left there; measured on the rows it is nothing.
    gram, first = _distributed_gram(vectors, n, sums, [], axes.T)
    real = np.diag(gram) > (d * 64 * _UNIT) ** 2 * float(np.diag(gram).max())
    covariance = gram / n - np.outer(first / n, first / n)
    values = singular[real] ** 2 / n
    return Whitening(n, sums, axes.T[:, real], values, float(np.trace(gram)) / n, covariance[np.ix_(real, real)])


def whiten(table: DataFrame, fit: Whitening | None, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of all usable vectors, a row for each vector and component.

    Returns ``vec_id, component, n, deviation, whitened, explained``: components are numbered from
    1 by falling eigenvalue, ``most`` of them at most; ``deviation`` is the squared length of n * x - sums, as
    a whole number (an error is raised if it needs more than 64 bits). Rows whose vector is null,
    holds null or non-finite entries, or has another length than most vectors (on a tie, than the
    longer ones) are left out; so are all rows if no direction has any variance. Null ids stay,
    repeated rows stay repeated, long vectors are read whole, other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    if fit is None or not fit.axes.shape[1]:
        return table.sparkSession.createDataFrame([], schema)
    axes, values = fit.axes[:, :most], fit.values[:most]
    scale, explained, count = np.sqrt(values), values / fit.trace, len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit_rows = _of_length(batch, len(fit.sums))
            for start in range(0, fit_rows.num_rows, ROWS):
                part = fit_rows.slice(start, ROWS)
                exact = centred(whole_numbers(_lists(part.column("vector"))), fit.n, fit.sums)
                widest = int(np.abs(exact).max(initial=0))
                if widest * widest * len(fit.sums) >= 1 << 63:
                    squares = [sum(v * v for v in row) for row in exact.tolist()]
                else:
                    squares = (exact * exact).sum(axis=1)
                out = (exact / fit.n) @ axes / scale
                at = np.repeat(np.arange(part.num_rows), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(len(at), fit.n)),
                        pa.array(squares, pa.int64()).take(pa.array(at)),
                        pa.array(out.ravel()),
                        pa.array(np.tile(explained, part.num_rows)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.mapInArrow(project, schema)

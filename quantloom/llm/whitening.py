"""Whitening of embeddings by a singular value decomposition of the centred, distinct vectors.

The entries of a vector become whole numbers first, so that the sums, the centring and the squared
deviations are exact.  MLlib's RowMatrix.computeSVD works on the centred rows where they lie; its
singular values s are those of the rows, so s^2 / n is a component's variance.  The total
variance does not come from it but from the exact deviations.

Only n, the sums of each dimension and the d x d matrix of directions reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

COMPONENTS = 16
STEPS = 64
SHIFT = 1_000_000
#: Entries from here on are beyond exact whole numbers and make a vector unfit, as non-finite ones do.
LARGEST = float(1 << 40)
MOST_LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x = floor(64 c) + 1000000 of the fit vectors of the most frequent length (ties: the longer)."""
    c = F.col(vector_col)
    fit = rows.filter(c.isNotNull() & (F.size(c) > 0)).select(F.col(id_col).alias("id"), c.cast("array<double>").alias("c"))
    fit = fit.filter(F.forall("c", lambda v: F.coalesce(F.abs(v) < F.lit(LARGEST), F.lit(False))))  # false for NaN too
    common = fit.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.transform("c", lambda v: F.floor(v * F.lit(float(STEPS))) + F.lit(SHIFT))
    return fit.filter(F.size("c") == F.lit(common["d"] if common else 0)).select("id", whole.alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sizes(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            dims = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([dims, pa.array([n, *total.tolist()], pa.int64())], ["dim", "total"])

    added = fit.mapInArrow(sums, "dim int, total long").groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim").collect()
    return (added[0]["total"], [r["total"] for r in added[1:]]) if added else (0, [])


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as long or, where that does not hold it, as Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        return n * x - np.array(sums)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(scaled: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = max(abs(int(scaled.max(initial=0))), abs(int(scaled.min(initial=0))))
    if most * most * max(scaled.shape[1], 1) > MOST_LONG:
        scaled = scaled.astype(object)
    return (scaled * scaled).sum(axis=1).tolist()


def directions(fit: DataFrame, n: int, sums: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance, by falling eigenvalue.

    The sign is such that the entry of largest absolute value is positive.  Values that rounding alone may have
    made, below d * 2^-50 of the largest, are none: constant or dependent dimensions give fewer components.
    """
    d = len(sums)
    held = F.array(*(F.lit(s) for s in sums))
    centred = F.transform("x", lambda v, i: (F.lit(n) * v - F.get(held, i)).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row")
    found = RowMatrix(rows, numRows=n, numCols=d).computeSVD(d, computeU=False, rCond=(d * 2.0**-50) ** 0.5)
    values = np.square(found.s.toArray()) / n
    v = found.V.toArray()
    keep = [k for k in np.argsort(-values, kind="stable")[:wanted] if values[k] > 0]
    v, values = v[:, keep], values[keep]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]) if len(keep) else np.ones(0)
    return v * signs, values


def trace_and_identity_error(fit: DataFrame, n: int, sums: list[int], onto: np.ndarray) -> tuple[float, float]:
    """The covariance's trace from exact deviations, and how far the whitened fit list's covariance is from the identity."""
    k = onto.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, first = 0, np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                scaled = scaled_deviations(matrix_of(batch.column(0)), n, sums)
                total += sum(squares(scaled))
                w = (scaled / n).astype(float) @ onto
                gram, first = gram + w.T @ w, first + w.sum(axis=0)
        part = [float(Fraction(total, n**3)), *first, *gram.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(part, pa.float64())], ["place", "part"])

    added = fit.mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).orderBy("place").collect()
    part = np.array([r["part"] for r in added])
    mean = part[1 : k + 1] / n
    covariance = part[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)
    return float(part[0]), float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Returns for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Left out: vectors that are null or empty, hold a null or non-finite entry or one of 2^40 or more, or have
    another length than most.  The fit list has each distinct vector once, so copies weigh nothing; rows with
    a repeated or null id are rows like any other.  Fewer components than asked for are given where the vectors
    span fewer dimensions; an empty table, or vectors that are all equal, give no rows.  A deviation
    beyond a long is null.  Other columns are ignored.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole_vectors(rows, id_col, vector_col)
    fit = materialise(vectors.select("x").distinct())
    n, sums = sizes(fit)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    axes, values = directions(fit, n, sums, components)
    onto = axes / np.sqrt(values)
    trace, error = trace_and_identity_error(fit, n, sums, onto)
    k = len(values)
    explained = (values / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m and k:
                scaled = scaled_deviations(matrix_of(batch.column(1)), n, sums)
                whitened = (scaled / n).astype(float) @ onto
                deviation = [s if s <= MOST_LONG else None for s in squares(scaled)]
                row = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(row)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(np.array(explained), m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema)

"""The largest eigenpairs of symmetric matrices of any size, by block Krylov subspaces.

The matrix stays a table of elements and each vector's entries a row for each row of the matrix: A times
a block of vectors is one join and one aggregate.  New blocks are made orthogonal to all earlier ones by
sums of products over the rows, twice.  What A does within the subspace is a small matrix, whose eigenvectors combine
the basis into the best approximations that it holds; from these the search begins again until A q = lambda q
to the tolerance.  Only such small matrices, of the basis's width, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.matrix import SYMMETRY, TAGGED, shapes, without_unsound
from quantloom.schemas import MATRIX, conform, same
from quantloom.storage import discard, materialise

BLOCK, STEPS, RESTARTS = 4, 10, 30
TOLERANCE = 1e-9
#: Directions that a new block adds below this share of its size are rounding.
SMALL = 1e-10


def columns_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """left' right, summed over all rows of two columns of arrays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a, b = (columns_of(batch.column(k), batch.num_rows) for k in (0, 1))
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(total.ravel())], ["i", "j", "v"])

    found = rows.select(left, right).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max(r["i"] for r in found) + 1, max(r["j"] for r in found) + 1))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return out


def combined(rows: DataFrame, weights: dict[str, np.ndarray], into: str, keep: tuple[str, ...]) -> DataFrame:
    """The rows with the sum of their arrays, each times a small matrix, as a column."""
    names = list(weights)
    schema = "RowNumber int, " + ", ".join(f"{k} array<double>" for k in (*keep, into))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                out = sum(columns_of(batch.column(1 + len(keep) + k), n) @ weights[name] for k, name in enumerate(names))
                made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(1 + k) for k in range(len(keep))), made], ["RowNumber", *keep, into])

    return rows.select("RowNumber", *keep, *(F.col(c).alias(f"__{c}") for c in names)).mapInArrow(run, schema)


def orthonormal(rows: DataFrame, basis: str | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows with column y made orthonormal, also to the basis (not written yet); C and R with y = basis C + new R."""
    c_all, r_all = None, None
    for _ in range(2):
        found = products(rows.withColumn("all", F.concat(basis, "y") if basis else F.col("y")), "all", "y")
        c, square = found[: -found.shape[1]], found[-found.shape[1] :]
        values, vectors = np.linalg.eigh(square - c.T @ c)
        keep = values > SMALL * max(values.max(), 0.0, SMALL * np.trace(square))
        if not keep.any():
            return rows, c if c_all is None else c_all + c @ r_all, np.zeros((0, len(square if r_all is None else r_all[0])))
        root = np.sqrt(values[keep])
        t, r = vectors[:, keep] / root, root[:, None] * vectors[:, keep].T
        weights = {"y": t} | ({basis: -c @ t} if basis else {})
        rows = combined(rows, weights, "y", (basis,) if basis else ())
        c_all, r_all = (c, r) if c_all is None else (c_all + c @ r_all, r @ r_all)
    return rows, c_all, r_all


def eigenpairs(elements: DataFrame, n: int, count: int, tolerance: float, block: int, steps: int, restarts: int) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues by falling magnitude, and rows (RowNumber, q) with the entries of their eigenvectors."""
    width = min(max(block, count), n)
    start = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.pmod(F.xxhash64("RowNumber", k), F.lit(1 << 20)) / float(1 << 19) - 1.0)
    rows = materialise(elements.select("RowNumber").distinct().select("RowNumber", start.alias("y")))
    e = elements.select("RowNumber", "ColumnNumber", "Value")
    for turn in range(restarts):
        first, _, r = orthonormal(rows, None)
        basis = materialise(first.select("RowNumber", F.col("y").alias("q"), F.col("y").alias("last")))
        discard(rows)
        sizes, h = [len(r)], np.zeros((0, 0))
        for _ in range(steps):
            x = basis.select(F.col("RowNumber").alias("of"), "last")
            ax = e.join(x, e["ColumnNumber"] == x["of"]).groupBy("RowNumber").agg(*(F.sum(F.col("Value") * F.get("last", F.lit(k))).alias(f"y{k}") for k in range(sizes[-1])))
            ax = ax.select(F.col("RowNumber").alias("of"), F.array(*(f"y{k}" for k in range(sizes[-1]))).alias("y"))
            both = materialise(basis.join(ax, basis["RowNumber"] == ax["of"]).select("RowNumber", "q", "y"))
            made, c, r = orthonormal(both, "q")
            at = sum(sizes)
            grown = np.zeros((at, at))
            grown[: len(h), : len(h)] = h
            grown[:, at - sizes[-1] :] = c
            grown[at - sizes[-1] :, :] = c.T
            h = grown
            if not len(r):  # the subspace is invariant
                break
            before, basis = basis, materialise(made.select("RowNumber", F.concat("q", "y").alias("q"), F.col("y").alias("last")))
            discard(before)
            discard(both)
            sizes.append(len(r))
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        best = np.argsort(-np.abs(values), kind="stable")[: max(width, count)]
        values, vectors = values[best], vectors[:, best]
        of_last = sizes[-2] if len(r) else sizes[-1]
        left = np.linalg.norm(r @ vectors[-of_last:, :count], axis=0).max(initial=0.0) if len(r) else 0.0
        whole = np.zeros((sum(sizes), len(best)))
        whole[: len(vectors)] = vectors
        rows = materialise(combined(basis, {"q": whole}, "y", ()))
        discard(basis)
        if left <= tolerance * np.abs(values).max(initial=1e-300) or turn == restarts - 1:
            break
    if left > tolerance * np.abs(values).max(initial=1e-300):
        return np.zeros(0), rows
    return values[:count], rows


def largest_eigenpairs(m: DataFrame, count: int = 1, on_invalid: str = "batch", tolerance: float = TOLERANCE, block: int = BLOCK, steps: int = STEPS, restarts: int = RESTARTS) -> DataFrame:
    """Rows tagged 'Q Matrix' (unit eigenvectors in columns, the largest component positive) and 'Eigenvalue' of the count of largest magnitude.

    For symmetric matrices too large for a task, so few: they are solved one after another.  One that is not square or not
    symmetric is unsound; one that does not converge has no rows.  Of equal eigenvalues those vectors are given that the
    subspace holds.  A null id is an id like any other; an empty table gives an empty table.
    """
    m = conform(m, MATRIX)
    found = shapes(m).filter("not valid or n_rows != n_columns").select("MatrixID")
    turned = m.toDF("id", "c", "r", "v")
    lopsided = m.join(turned, same(m["MatrixID"], turned["id"]) & (m["RowNumber"] == turned["r"]) & (m["ColumnNumber"] == turned["c"]))
    bad = found.unionByName(lopsided.filter(F.abs(F.col("Value") - F.col("v")) > SYMMETRY).select("MatrixID"))
    sound = materialise(without_unsound(m, bad, on_invalid))
    out = sound.sparkSession.createDataFrame([], TAGGED)
    for of in sound.groupBy("MatrixID").agg(F.max("RowNumber").alias("n")).toLocalIterator():
        key = F.lit(of["MatrixID"]).cast("int").alias("MatrixID")
        values, rows = eigenpairs(sound.filter(F.col("MatrixID").eqNullSafe(F.lit(of["MatrixID"]))), of["n"], min(count, of["n"]), tolerance, block, steps, restarts)
        if not len(values):
            continue
        each = rows.select("RowNumber", F.posexplode(F.slice("y", 1, len(values))).alias("k", "v"))
        signs = each.groupBy(F.col("k").alias("of")).agg(F.max_by("v", F.struct(F.abs("v"), -F.col("RowNumber"))).alias("top"))
        vectors = each.join(F.broadcast(signs), F.col("k") == F.col("of"))  # a row for each pair asked for
        vectors = vectors.select(key, F.lit("Q Matrix").alias("Result"), "RowNumber", (F.col("k") + 1).alias("ColumnNumber"), (F.col("v") * F.signum("top")).alias("Value"))
        scalars = sound.sparkSession.createDataFrame([(of["MatrixID"], "Eigenvalue", k + 1, 1, float(v)) for k, v in enumerate(values)], TAGGED)
        out = out.unionByName(vectors).unionByName(scalars)
    return out

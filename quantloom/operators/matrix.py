"""Batches of matrices held as tables of elements (MatrixID, RowNumber, ColumnNumber, Value).

Products, transposes and distances are joins and aggregates, covariances and correlations come from what
each task's rows add up to, so a matrix may be larger than a task.  Factorisations need a matrix as a whole: each is one call of a numpy
kernel, and matrices are spread over tasks by their id.

A batch with an unsound matrix gives no rows at all (``on_invalid="batch"``), or only that matrix
is left out (``"group"``).  Soundness is a scalar subquery of the plan: nothing is collected.
A null id is an id like any other.  Empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.schemas import MATRIX, conform, same
from quantloom.storage import materialise

ELEMENT = "MatrixID int, RowNumber int, ColumnNumber int, Value double"
TAGGED = "MatrixID int, Result string, RowNumber int, ColumnNumber int, Value double"
TINY = 1e-10
CHECK = 1e-6
SYMMETRY = 1e-4
#: Rows of a matrix in a block: a task compares those of two blocks.
ROWS = 4096

Element = tuple[int, int, float]


def shapes(m: DataFrame, no_zero_rows: bool = False, no_zero_columns: bool = False) -> DataFrame:
    """MatrixID, n_rows, n_columns, valid of each matrix.

    Sound means: rows and columns are numbered 1 to n without gaps, each element is there once and
    not null; on request no row or no column is all zero.
    """
    by_row = m.groupBy("MatrixID", "RowNumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("ColumnNumber").alias("distinct"),
        F.count("Value").alias("values"),
        F.min("ColumnNumber").alias("low"),
        F.max("ColumnNumber").alias("high"),
        F.max(F.col("Value") != 0).alias("nonzero"),
    )
    whole = by_row.groupBy("MatrixID").agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"),
        F.max("high").alias("n_columns"),
        (
            (F.coalesce(F.min("RowNumber"), F.lit(0)) == 1)
            & (F.max("RowNumber") == F.count(F.lit(1)))
            & (F.count("RowNumber") == F.count(F.lit(1)))
            & (F.coalesce(F.min("low"), F.lit(0)) == 1)
            & (F.max("high") == F.min("high"))
            & F.every((F.col("n") == F.col("high")) & (F.col("distinct") == F.col("n")) & (F.col("values") == F.col("n")))
            & (F.lit(not no_zero_rows) | F.every(F.coalesce(F.col("nonzero"), F.lit(False))))
        ).alias("sound"),
    )
    sound = F.coalesce(F.col("sound"), F.lit(False))
    if not no_zero_columns:
        return whole.select("MatrixID", "n_rows", "n_columns", sound.alias("valid"))
    zero = m.groupBy("MatrixID", "ColumnNumber").agg(F.max(F.col("Value") != 0).alias("nonzero")).filter("not nonzero")
    marked = zero.select(F.col("MatrixID").alias("id"), F.lit(True).alias("marked")).distinct()
    joined = whole.join(marked, same(whole["MatrixID"], marked["id"]), "left")
    return joined.select("MatrixID", "n_rows", "n_columns", (sound & F.col("marked").isNull()).alias("valid"))


def integrity_check(m: DataFrame, no_zero_rows: bool = False, no_zero_columns: bool = False) -> DataFrame:
    """One row: IsValid, 1 if all matrices are sound (also for no matrix at all), else 0."""
    bad = F.count_if(~F.col("valid"))
    return shapes(conform(m, MATRIX), no_zero_rows, no_zero_columns).agg((bad == 0).cast("int").alias("IsValid"))


def without_unsound(m: DataFrame, bad: DataFrame, on_invalid: str) -> DataFrame:
    """m less the matrices in bad (MatrixID), or nothing if bad has a row."""
    if on_invalid == "group":
        return m.join(bad.select(F.col("MatrixID").alias("__bad")).distinct(), same(m["MatrixID"], F.col("__bad")), "left_anti")
    if on_invalid != "batch":
        raise ValueError("on_invalid is 'batch' or 'group'")
    return m.filter(bad.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)


def checked(m: DataFrame, on_invalid: str, wrong: str = "false") -> DataFrame:
    """Matrices in shape; ``wrong`` is one more condition on n_rows and n_columns that makes one unsound."""
    m = conform(m, MATRIX)
    return without_unsound(m, shapes(m).filter(f"not valid or {wrong}"), on_invalid)


def dense(group: pd.DataFrame) -> np.ndarray:
    a = np.zeros((int(group["RowNumber"].max()), int(group["ColumnNumber"].max())))
    a[group["RowNumber"].to_numpy() - 1, group["ColumnNumber"].to_numpy() - 1] = group["Value"].to_numpy()
    return a


def elements(a: np.ndarray) -> Iterable[Element]:
    return [(i + 1, j + 1, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]


def by_matrix(m: DataFrame, kernel: Callable[[np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that a kernel gives for each matrix, after the id."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(kernel(dense(group))), columns=names[1:])
        out.insert(0, "MatrixID", pd.Series([key[0]] * len(out), dtype="Int32"))
        return out

    return m.groupBy("MatrixID").applyInPandas(run, schema)


def product(left: DataFrame, right: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Products of the matrices of equal ids; ids of one side alone are left out.

    A pair whose sizes do not fit is unsound.
    """
    left, right = conform(left, MATRIX), conform(right, MATRIX)
    a, b = shapes(left), shapes(right).toDF("id", "rows", "columns", "fine")
    pairs = a.join(b, same(a["MatrixID"], b["id"]))
    unfit = pairs.filter("n_columns != rows").select("MatrixID")
    bad = unfit.unionByName(a.filter("not valid").select("MatrixID")).unionByName(b.filter("not fine").select(F.col("id").alias("MatrixID")))
    left = without_unsound(left, bad, on_invalid)
    r = right.toDF("id", "k", "ColumnNumber_R", "Value_R")
    joined = left.join(r, same(left["MatrixID"], r["id"]) & (left["ColumnNumber"] == r["k"]))
    return joined.groupBy("MatrixID", "RowNumber", F.col("ColumnNumber_R").alias("ColumnNumber")).agg(F.sum(F.col("Value") * F.col("Value_R")).alias("Value"))


def transpose(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    return checked(m, on_invalid).select("MatrixID", F.col("ColumnNumber").alias("RowNumber"), F.col("RowNumber").alias("ColumnNumber"), "Value")


CELL = "MatrixID int, c1 int, c2 int, n long, m1 double, m2 double, s11 double, s22 double, s12 double, low int, high int, bad boolean"


def row_moments(batches: Iterator[pa.RecordBatch], first_column: int, least_columns: int) -> Iterator[pa.RecordBatch]:
    """What the rows of a task add up to: for each matrix and pair of columns a CELL.

    Values are taken relative to the first row seen, so that columns that do not vary have no spread, not
    even by rounding.
    """
    held: dict[int | None, list] = {}  # id -> [n, mean, centred products, lowest and highest row, bad]

    def cells() -> pa.RecordBatch:
        out: list[tuple] = []
        for key, (n, mean, products, low, high, bad) in held.items():
            spread = np.diag(products)
            for i, j in zip(*np.triu_indices(len(mean)), strict=True):
                out.append((key, i + first_column, j + first_column, n, mean[i], mean[j], spread[i], spread[j], products[i, j], low, high, bad))
            if not len(mean):
                out.append((key, None, None, n, None, None, None, None, None, low, high, True))
        held.clear()
        parts = list(zip(*out, strict=True)) or [[]] * 12
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5, pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, kinds, strict=True)], [c.split()[0] for c in CELL.split(", ")])

    for batch in batches:
        by_id: dict[int | None, list] = {}
        for key, row, columns, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_id.setdefault(key, []).append((row, columns, values))
        for key, rows in by_id.items():
            p = len(rows[0][1])
            whole = list(range(first_column, first_column + p))
            sound = p >= least_columns and all(row is not None and columns == whole and None not in values for row, columns, values in rows)
            numbers = [row for row, _, _ in rows if row is not None]
            low, high = (min(numbers), max(numbers)) if numbers else (None, None)
            if not sound:
                new = [len(rows), np.zeros(0), np.zeros((0, 0)), low, high, True]
            else:
                v = np.array([values for _, _, values in rows])
                away = v - v[0]
                middle = away.mean(axis=0)
                new = [len(rows), v[0] + middle, (away - middle).T @ (away - middle), low, high, False]
            old = held.get(key)
            if old is None:
                held[key] = new
            elif old[5] or new[5] or len(old[1]) != len(new[1]):
                held[key] = [old[0] + new[0], np.zeros(0), np.zeros((0, 0)), low, high, True]
            else:
                n, gap = old[0] + new[0], new[1] - old[1]
                held[key] = [n, old[1] + gap * (new[0] / n), old[2] + new[2] + np.outer(gap, gap) * (old[0] * new[0] / n), min(old[3], low), max(old[4], high), False]
        if sum(h[2].size for h in held.values()) > 1 << 20:
            yield cells()
    yield cells()


def moments(m: DataFrame, on_invalid: str, first_column: int = 1, least_columns: int = 1) -> DataFrame:
    """MatrixID, c1 <= c2, and of the two columns: n, means m1 and m2, centred squares s11 and s22 and products s12.

    The elements are shuffled once, into rows; what travels on is a row for each pair of columns of each task.  Unsound
    matrices are left out, or empty the result, as everywhere; soundness comes out of the same pass.
    """
    pairs = F.sort_array(F.collect_list(F.struct("ColumnNumber", F.col("Value").alias("v"), F.col("Value").isNull().alias("null"))))
    rows = m.groupBy("MatrixID", "RowNumber").agg(pairs.alias("e")).select("MatrixID", "RowNumber", F.col("e.ColumnNumber").alias("columns"), F.col("e.v").alias("values"))
    cells = rows.mapInArrow(lambda batches: row_moments(batches, first_column, least_columns), CELL)
    numbers = ("n", "m1", "m2", "s11", "s22", "s12")

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap_1, gap_2, weight = b["m1"] - a["m1"], b["m2"] - a["m2"], a["n"] * (b["n"] / n)
        values = (n, a["m1"] + gap_1 * (b["n"] / n), a["m2"] + gap_2 * (b["n"] / n), a["s11"] + b["s11"] + gap_1 * gap_1 * weight, a["s22"] + b["s22"] + gap_2 * gap_2 * weight, a["s12"] + b["s12"] + gap_1 * gap_2 * weight)
        return F.struct(*(v.alias(c) for v, c in zip(values, numbers, strict=True)))

    grouped = cells.groupBy("MatrixID", "c1", "c2").agg(F.collect_list(F.struct(*numbers)).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"))
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), merged)
    found = materialise(grouped.withColumn("whole", whole).select("MatrixID", "c1", "c2", "whole.*", "low", "high", "bad"))
    of_id = found.groupBy("MatrixID").agg(F.max("bad").alias("bad"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    unsound = of_id.filter("bad or least != most or not (low <=> 1) or not (high <=> most)").select("MatrixID")
    return without_unsound(found, unsound, on_invalid).drop("low", "high", "bad")


def mirrored(upper: DataFrame, name: str) -> DataFrame:
    """A symmetric matrix from its upper half (MatrixID, c1, c2 and the value)."""
    places = F.when(F.col("c1") == F.col("c2"), F.array(F.struct("c1", "c2"))).otherwise(
        F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    )
    each = upper.select("MatrixID", F.explode(places).alias("p"), name)
    return each.select("MatrixID", F.col("p.c1").alias("RowNumber"), F.col("p.c2").alias("ColumnNumber"), F.col(name).alias("Value"))


def covariance(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Sample covariances of the columns; rows are observations, a single one gives NULL."""
    cells = moments(conform(m, MATRIX), on_invalid)
    return mirrored(cells.withColumn("v", F.try_divide("s12", (F.col("n") - 1).cast("double"))), "v")


def correlation(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Correlations of the columns; 0 with a column that does not vary."""
    cells = moments(conform(m, MATRIX), on_invalid)
    return mirrored(cells.withColumn("v", F.coalesce(F.try_divide("s12", F.sqrt("s11") * F.sqrt("s22")), F.lit(0.0))), "v")


def minkowski(p: float | None, first: DataFrame, second: DataFrame) -> DataFrame:
    """OrderValue, MatrixID, RowNumber_1, RowNumber_2, Distance of all rows of one side from all of the other.

    No order is the largest difference.  There are no rows for orders up to 1e-9, or unless both sides
    have the same ids and widths.
    """
    first, second = conform(first, MATRIX), conform(second, MATRIX)
    a, b = shapes(first), shapes(second).toDF("id", "rows", "columns", "fine")
    # a row for each matrix, read three times
    ids = materialise(a.join(b, same(a["MatrixID"], b["id"]), "full"))
    unlike = ids.filter("rows is null or n_rows is null or n_columns != columns or not valid or not fine")
    if p is not None and p <= 1e-9:
        first, p = first.limit(0), 1.0
    sizes = ids.select(F.coalesce("MatrixID", "id").alias("of"), F.ceil(F.col("n_rows") / ROWS).alias("blocks_1"), F.ceil(F.col("rows") / ROWS).alias("blocks_2"))

    def row_arrays(m: DataFrame, k: int) -> DataFrame:
        """id_k, RowNumber_k, v_k (its values by column), its block, and each block of the other side that it meets."""
        rows = m.groupBy("MatrixID", "RowNumber").agg(F.array_sort(F.collect_list(F.struct("ColumnNumber", "Value"))).alias("v"))
        met = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{3 - k}") - 1)).alias(f"block_{3 - k}")
        own = F.floor((F.col("RowNumber") - 1) / ROWS).alias(f"block_{k}")
        values = F.transform("v", lambda e: e["Value"]).alias(f"v{k}")
        return rows.join(sizes, same(F.col("MatrixID"), F.col("of"))).select(F.col("MatrixID").alias(f"id_{k}"), F.col("RowNumber").alias(f"RowNumber_{k}"), values, own, met)

    left = row_arrays(without_unsound(first, unlike, "batch"), 1).withColumnsRenamed({"block_1": "b1", "block_2": "b2"})
    right = row_arrays(second, 2)
    pairs = left.join(right, same(left["id_1"], right["id_2"]) & (F.col("b1") == F.col("block_1")) & (F.col("b2") == F.col("block_2")))
    gaps = F.zip_with("v1", "v2", lambda x, y: F.abs(x - y))
    if p is None:
        distance = F.array_max(gaps)
    elif p == 2:
        distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))
    else:
        distance = F.pow(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + F.pow(gap, F.lit(float(p)))), F.lit(1.0 / p))
    return pairs.select(F.lit(p).cast("double").alias("OrderValue"), F.col("id_1").alias("MatrixID"), "RowNumber_1", "RowNumber_2", distance.alias("Distance"))


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Q, R and the number of reflections; each maps a column to the positive axis and is skipped where it is there."""
    n = len(a)
    q, r, count = np.eye(n), a.astype(float).copy(), 0
    for k in range(n - 1):
        v = -r[k:, k]
        v[0] += np.linalg.norm(r[k:, k])
        size = np.linalg.norm(v)
        if size < TINY:
            continue
        v, count = v / size, count + 1
        r[k:] -= 2 * np.outer(v, v @ r[k:])
        q[:, k:] -= 2 * np.outer(q[:, k:] @ v, v)
    return q, np.triu(r), count


def qr_factorization(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Rows tagged 'Q Matrix', 'R Matrix' and 'Determinant' of square matrices that pass Q Q' = I and Q R = A."""

    def kernel(a: np.ndarray) -> Iterable[tuple]:
        q, r, count = householder(a)
        if np.abs(q @ q.T - np.eye(len(a))).max() > CHECK:
            return
        if np.abs(q @ r - a).max() <= CHECK:
            yield from (("Q Matrix", *e) for e in elements(q))
            yield from (("R Matrix", *e) for e in elements(r))
        diagonal = np.diag(r)
        det = 0.0 if (np.abs(diagonal) <= TINY).any() else float((-1) ** count * np.prod(diagonal))
        yield "Determinant", None, None, det

    return by_matrix(checked(m, on_invalid, "n_rows != n_columns"), kernel, TAGGED)


def rounded_determinant(a: np.ndarray) -> float:
    return float(a[0, 0]) if a.shape == (1, 1) else round(float(np.linalg.det(a)), 12) + 0.0


def determinant(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """MatrixID, Determinant, to 12 decimals."""
    return by_matrix(checked(m, on_invalid, "n_rows != n_columns"), lambda a: [(rounded_determinant(a),)], "MatrixID int, Determinant double")


def adjugate(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Transposed cofactors, also of singular matrices; [1] for a single element."""

    def kernel(a: np.ndarray) -> Iterable[Element]:
        n = len(a)
        if n == 1:
            return [(1, 1, 1.0)]
        rest = [np.delete(np.arange(n), k) for k in range(n)]
        out = np.empty((n, n))
        for i in range(n):
            minors = np.stack([a[np.ix_(rest[i], rest[j])] for j in range(n)])
            out[:, i] = np.linalg.det(minors) * (-1.0) ** (i + np.arange(n))
        return elements(out)

    return by_matrix(checked(m, on_invalid, "n_rows != n_columns"), kernel, ELEMENT)


def inverse(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Inverses; a matrix whose determinant is 0 to 12 decimals has none and no rows."""
    kernel = lambda a: elements(np.linalg.inv(a)) if rounded_determinant(a) else []
    return by_matrix(checked(m, on_invalid, "n_rows != n_columns"), kernel, ELEMENT)


def echelon(a: np.ndarray) -> np.ndarray:
    """Elimination with the pivot of column k in row k (largest magnitude, first of equals); a zero pivot column stays."""
    a = a.astype(float).copy()
    for k in range(min(a.shape)):
        best = k + int(np.argmax(np.abs(a[k:, k])))
        if a[best, k] == 0:
            continue
        a[[k, best]] = a[[best, k]]
        a[k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k])
        a[k + 1 :, k] = 0.0
    return a


def row_echelon(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    return by_matrix(checked(m, on_invalid), lambda a: elements(echelon(a)), ELEMENT)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling magnitude and unit eigenvectors whose largest component is positive."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def eigendecomposition(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Rows tagged 'Q Matrix' (eigenvectors in columns) and 'Eigenvalue' (row i, column 1) of symmetric matrices."""
    m = conform(m, MATRIX)
    found = shapes(m).filter("not valid or n_rows != n_columns").select("MatrixID")
    turned = m.toDF("id", "c", "r", "v")
    lopsided = m.join(turned, same(m["MatrixID"], turned["id"]) & (m["RowNumber"] == turned["r"]) & (m["ColumnNumber"] == turned["c"]))
    lopsided = lopsided.filter(F.abs(F.col("Value") - F.col("v")) > SYMMETRY).select("MatrixID")

    def kernel(a: np.ndarray) -> Iterable[tuple]:
        values, vectors = eigen(a)
        yield from (("Q Matrix", *e) for e in elements(vectors))
        yield from (("Eigenvalue", i + 1, 1, float(x)) for i, x in enumerate(values))

    return by_matrix(without_unsound(m, found.unionByName(lopsided), on_invalid), kernel, TAGGED)


def unique_solution(augmented: np.ndarray) -> np.ndarray | None:
    """The solution of [A | b] if there is exactly one."""
    a, b = augmented[:, :-1], augmented[:, -1]
    n = a.shape[1]
    if n == 0 or len(a) < n or np.linalg.matrix_rank(a) < n:
        return None
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    return x if np.allclose(a @ x, b, rtol=1e-8, atol=1e-8 * max(1.0, float(np.abs(b).max()))) else None


def linear_system(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """MatrixID, ColumnNumber, Value: the solution of each augmented matrix; none unless it is unique."""

    def kernel(a: np.ndarray) -> Iterable[tuple[int, float]]:
        x = unique_solution(a)
        return [] if x is None else [(j + 1, float(v)) for j, v in enumerate(x)]

    return by_matrix(checked(m, on_invalid), kernel, "MatrixID int, ColumnNumber int, Value double")


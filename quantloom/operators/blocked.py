"""Echelon forms, determinants, systems and inverses of matrices larger than a task, by elimination in blocks.

A matrix is a table of square blocks.  Each step takes one column of blocks, the panel.  Its pivots come out of a
tournament: every block of rows puts forward the rows that elimination would pick from it, groups of candidates
meet, and so on until those of the whole panel are left.  Rows stay where they lie and are marked as pivots.  The
pivot rows of each column of blocks meet in one block, and one join takes them, with the multipliers, to the
blocks of the remaining columns.  What meets in a task are three blocks, or sixteen blocks of candidates; what
reaches the driver is one block of pivot rows a step.

Pivots of a tournament are as good as the largest of each column, but other ones, so an echelon form differs from
``matrix.row_echelon`` (reduced forms, determinants, solutions and inverses do not).  An element counts as
zero up to ``tolerance`` times the largest of its matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.matrix import ELEMENT, checked, shapes
from quantloom.schemas import MATRIX, conform
from quantloom.storage import discard, materialise

#: Rows and columns of a block: half a megabyte.
BLOCK = 256
#: Sets of candidates that meet in one task of a tournament.
FAN_IN = 16
TOLERANCE = 1e-12


class Reduced(NamedTuple):
    """A matrix in echelon form: marks (g, pivot) and blocks (g, j, v) of rows where they lay before."""

    blocks: list[DataFrame]
    marks: DataFrame
    rank: int
    leading: int  # columns 1 to this one all hold a pivot
    sign: float
    log_size: float


def numbers(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, width)


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(part.split() for part in schema.split(", ")), strict=True)
    parts = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(p, kinds[t]) for p, t in zip(parts, types, strict=True)], list(names))


def in_blocks(m: DataFrame, block: int) -> DataFrame:
    """g, j, v: the block of rows, the block of columns, the elements row by row."""

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows, columns = part["RowNumber"].to_numpy() - 1 - key[0] * block, part["ColumnNumber"].to_numpy() - 1 - key[1] * block
        a = np.zeros((rows.max() + 1, columns.max() + 1))
        a[rows, columns] = part["Value"].to_numpy()
        return pd.DataFrame({"g": [key[0]], "j": [key[1]], "v": [a.tobytes()]})

    at = (F.floor((F.col(c) - 1) / block).cast("int").alias(k) for c, k in (("RowNumber", "g"), ("ColumnNumber", "j")))
    return m.groupBy(*at).applyInPandas(packed, "g int, j int, v binary")


def pivots_of(a: np.ndarray, tiny: float) -> tuple[list[int], list[int]]:
    """Rows and columns of the pivots that elimination picks: the largest of each column, the first of equals."""
    a, order, r, columns = a.copy(), np.arange(len(a)), 0, []
    for c in range(a.shape[1]):
        if r == len(a):
            break
        best = r + int(np.argmax(np.abs(a[r:, c])))
        if abs(a[best, c]) <= tiny:
            continue
        a[[r, best]], order[[r, best]] = a[[best, r]], order[[best, r]]
        a[r + 1 :, c:] -= np.outer(a[r + 1 :, c] / a[r, c], a[r, c:])
        columns.append(c)
        r += 1
    return order[:r].tolist(), columns


def candidates(rows: np.ndarray, a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    best, _ = pivots_of(a, tiny)
    return rows[best], a[best]


def tournament(panel: DataFrame, groups: int, block: int, width: int, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (from 0) and panel entries of the pivot rows among those that are none yet (panel: g, pivot, v)."""
    schema = "g int, rows binary, v binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, pivot, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = numbers(v, width)
                free = np.arange(len(a)) if pivot is None else np.flatnonzero(np.frombuffer(pivot, np.int32) == 0)
                rows, a = candidates(g * block + free, a[free], tiny)
                out.append((g, rows.astype(np.int64).tobytes(), a.tobytes()))
            yield record_batch(out, schema)

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("g")
        rows = np.concatenate([np.frombuffer(r, np.int64) for r in part["rows"]])
        rows, a = candidates(rows, np.concatenate([numbers(v, width) for v in part["v"]]), tiny)
        return pd.DataFrame({"g": [key[0]], "rows": [rows.astype(np.int64).tobytes()], "v": [a.tobytes()]})

    met = panel.select("g", "pivot", "v").mapInArrow(first, schema)
    while True:
        met = met.select(F.floor(F.col("g") / FAN_IN).cast("int").alias("to"), "g", "rows", "v").groupBy("to").applyInPandas(merged, schema)
        groups = -(-groups // FAN_IN)
        if groups == 1:
            break
    (won,) = met.collect()  # one block at most
    return np.frombuffer(won["rows"], np.int64), numbers(won["v"], width)


def multipliers(panel: DataFrame, rows: np.ndarray, top: np.ndarray, columns: list[int], done: int, block: int, reduced: bool) -> DataFrame:
    """g, pivot (marks with the new ones), keep, l, v (the panel after this step), inversions (moves that bring the new pivots up).

    A block a of these rows becomes keep * a - l p, where p are the pivot rows of its columns.
    """
    r, width = top.shape
    square = top[:, columns]
    lower = np.eye(r)  # of square = lower times upper; rows are in the order of their pivots already
    upper = square.copy()
    for k in range(r):
        lower[k + 1 :, k] = upper[k + 1 :, k] / upper[k, k]
        upper[k + 1 :] -= np.outer(lower[k + 1 :, k], upper[k])
    schema = "g int, pivot binary, keep binary, l binary, v binary, inversions long"
    own = np.linalg.inv(square) if reduced else np.linalg.inv(lower)  # what makes pivot rows of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, pivot, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = numbers(v, width)
                marks = np.zeros(len(a), np.int32) if pivot is None else np.frombuffer(pivot, np.int32).copy()
                free = np.flatnonzero(marks == 0) + g * block
                mine = np.flatnonzero((rows >= g * block) & (rows < g * block + len(a)))
                new = rows[mine] - g * block
                moved = (free[:, None] < rows[None, :]).sum() - sum(int((rows[mine[mine < k]] < rows[k]).sum()) for k in range(r))
                pass_over = np.zeros(len(a), bool) if reduced else marks > 0
                marks[new] = done + 1 + mine
                ell = np.linalg.solve(square.T, a[:, columns].T).T
                ell[pass_over] = 0.0
                ell[new] = -own[mine]
                keep = np.ones(len(a))
                keep[new] = 0.0
                after = keep[:, None] * a - ell @ top
                # what is zero or one by construction
                changed = np.flatnonzero(~pass_over)
                after[np.ix_(changed, columns)] = np.where(marks[changed, None] > done, after[np.ix_(changed, columns)], 0.0)
                after[marks == 0] = 0.0
                for row, k in zip(new, mine, strict=True):
                    after[row, : columns[k]] = 0.0
                    if reduced:
                        after[row, columns] = np.eye(r)[k]
                out.append((g, marks.tobytes(), keep.tobytes(), np.ascontiguousarray(ell).tobytes(), after.tobytes(), int(moved)))
            yield record_batch(out, schema)

    return panel.select("g", "pivot", "v").mapInArrow(run, schema)


def pivot_rows(rest: DataFrame, rows: np.ndarray, block: int, n_columns: int) -> DataFrame:
    """to, p: the pivot rows of each column of blocks, in the order of their pivots."""

    def width(j: int) -> int:
        return min(block, n_columns - j * block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, j, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.flatnonzero(rows // block == g)
                out.append((j, mine.astype(np.int64).tobytes(), numbers(v, width(j))[rows[mine] - g * block].tobytes()))
            yield record_batch(out, "j int, places binary, v binary")

    def gathered(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        p = np.empty((len(rows), width(key[0])))
        for places, v in zip(part["places"], part["v"], strict=True):
            p[np.frombuffer(places, np.int64)] = numbers(v, p.shape[1])
        return pd.DataFrame({"to": [key[0]], "p": [p.tobytes()]})

    holders = np.unique(rows // block).tolist()  # one for each row of a block at most
    own = rest.filter(F.col("g").isin(holders)).select("g", "j", "v")
    return own.mapInArrow(cut, "j int, places binary, v binary").groupBy("j").applyInPandas(gathered, "to int, p binary")


def updated(rest: DataFrame, step: DataFrame, tops: DataFrame, r: int) -> DataFrame:
    """The remaining blocks after a step: keep * v - l p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, j, v, keep, ell, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, keep = np.frombuffer(p).reshape(r, -1), np.frombuffer(keep)
                out.append((g, j, (keep[:, None] * numbers(v, p.shape[1]) - numbers(ell, r) @ p).tobytes()))
            yield record_batch(out, "g int, j int, v binary")

    by_row = step.select(F.col("g").alias("of"), "keep", "l")
    joined = rest.join(by_row, F.col("g") == F.col("of")).join(tops, F.col("j") == F.col("to"))
    return joined.select("g", "j", "v", "keep", "l", "p").mapInArrow(run, "g int, j int, v binary")


def eliminated(m: DataFrame, n_rows: int, n_columns: int, block: int, tolerance: float, reduced: bool) -> Reduced:
    """One sound matrix in (reduced) echelon form."""
    tiny = tolerance * m.agg(F.max(F.abs("Value"))).first()[0]
    source = rest = materialise(in_blocks(m, block))
    held = False  # whether the result reads blocks of the source
    marks = rest.select("g").distinct().select("g", F.lit(None).cast("binary").alias("pivot"))
    blocks, steps = [], []
    rank, leading, sign, log_size = 0, 0, 1.0, 0.0
    for j in range(-(-n_columns // block)):
        if rank == n_rows:
            blocks.append(rest)
            break
        width = min(block, n_columns - j * block)
        panel = rest.filter(F.col("j") == j).join(marks, "g").select("g", "pivot", "v")
        rows, top = tournament(panel, -(-n_rows // block), block, width, tiny)
        own, columns = pivots_of(top, tiny)
        if not columns:  # what is left in the panel counts as zero
            blocks.append(rest.filter(F.col("j") == j))
            rest, held = rest.filter(F.col("j") > j), True
            continue
        rows, top = rows[own], top[own]
        step = materialise(multipliers(panel, rows, top, columns, rank, block, reduced))
        after = rest.filter(F.col("j") > j)
        if (j + 1) * block < n_columns:
            after = materialise(updated(after, step, pivot_rows(after, rows, block, n_columns), len(rows)))
            if not held:
                discard(source)
            source, held = after, False
        rest = after
        marks = step.select("g", "pivot")
        steps.append(step)
        blocks.append(step.select("g", F.lit(j).alias("j"), "v"))
        s, log = np.linalg.slogdet(top[:, columns])
        sign, log_size, rank = sign * s, log_size + log, rank + len(columns)
        if leading == j * block:
            leading += next((k for k, c in enumerate(columns) if c != k), len(columns))
    if steps:
        moves = steps[0].select("inversions")
        for step in steps[1:]:
            moves = moves.unionByName(step.select("inversions"))
        sign *= (-1.0) ** (moves.agg(F.sum("inversions")).first()[0] % 2)
    return Reduced(blocks, marks, rank, leading, float(sign), float(log_size))


def elements_of(found: Reduced, key: int | None, n_rows: int, n_columns: int, block: int) -> DataFrame:
    """The echelon form as elements: pivot rows in their order, then rows of zeros."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, v, pivot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pivot is None:
                    continue
                at = np.frombuffer(pivot, np.int32)
                a = numbers(v, min(block, n_columns - j * block))[at > 0]
                r = np.repeat(at[at > 0], a.shape[1])
                c = np.tile(np.arange(a.shape[1], dtype=np.int32) + j * block + 1, len(a))
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c.astype(np.int32)), pa.array(a.ravel() + 0.0)], ["RowNumber", "ColumnNumber", "Value"])

    spark = found.marks.sparkSession
    whole = found.blocks[0].select("g", "j", "v")
    for more in found.blocks[1:]:
        whole = whole.unionByName(more.select("g", "j", "v"))
    rows = whole.join(found.marks, "g").select("j", "v", "pivot").mapInArrow(unpacked, "RowNumber int, ColumnNumber int, Value double")
    zeros = spark.range(found.rank + 1, n_rows + 1).select(F.col("id").cast("int").alias("RowNumber"), F.explode(F.sequence(F.lit(1), F.lit(n_columns))).alias("ColumnNumber"), F.lit(0.0).alias("Value"))
    return rows.unionByName(zeros).select(F.lit(key).cast("int").alias("MatrixID"), "RowNumber", "ColumnNumber", "Value")


def each(m: DataFrame, on_invalid: str, wrong: str, block: int, tolerance: float, reduced: bool) -> Iterator[tuple[int | None, int, int, Reduced]]:
    """Id, rows, columns and echelon form of each sound matrix, one after another: large ones are few."""
    sound = materialise(checked(m, on_invalid, wrong))
    for of in shapes(sound).toLocalIterator():
        own = sound.filter(F.col("MatrixID").eqNullSafe(F.lit(of["MatrixID"])))
        yield of["MatrixID"], of["n_rows"], of["n_columns"], eliminated(own, of["n_rows"], of["n_columns"], block, tolerance, reduced)


def together(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def row_echelon(m: DataFrame, on_invalid: str = "batch", reduced: bool = False, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """Echelon forms (MatrixID, RowNumber, ColumnNumber, Value); reduced ones have 1 as pivots, and 0 above and below them.

    An unsound matrix empties the result, or is left out (``"group"``).  A null id is an id like any other; an empty
    table gives an empty table; other columns are ignored; rows beyond the rank are zero.
    """
    parts = [elements_of(found, key, rows, columns, block) for key, rows, columns, found in each(m, on_invalid, "false", block, tolerance, reduced)]
    return together(m.sparkSession, parts, ELEMENT)


def determinant(m: DataFrame, on_invalid: str = "batch", block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """MatrixID, Sign, LogDeterminant (natural, of the magnitude), Determinant of square matrices; a singular one has sign 0, no logarithm, determinant 0.

    Determinants beyond the range of a double are infinite or zero; their logarithms are right.  Odd cases are as in row_echelon.
    """
    schema = "MatrixID int, Sign double, LogDeterminant double"
    rows = []
    for key, n, _, found in each(m, on_invalid, "n_rows != n_columns", block, tolerance, False):
        rows.append((key, found.sign, found.log_size) if found.rank == n else (key, 0.0, None))
    out = m.sparkSession.createDataFrame(rows, schema)  # a row for each matrix
    return out.withColumn("Determinant", F.coalesce(F.col("Sign") * F.exp("LogDeterminant"), F.lit(0.0)))


def linear_system(m: DataFrame, on_invalid: str = "batch", block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """MatrixID, ColumnNumber, Value: the solution of each augmented matrix [A | b]; none unless there is exactly one.

    Equations in excess must agree within the tolerance.  Odd cases are as in row_echelon.
    """
    parts = []
    for key, rows, columns, found in each(m, on_invalid, "false", block, tolerance, True):
        if columns > 1 and found.rank == found.leading == columns - 1:
            x = elements_of(found, key, rows, columns, block).filter((F.col("ColumnNumber") == columns) & (F.col("RowNumber") < columns))
            parts.append(x.select("MatrixID", F.col("RowNumber").alias("ColumnNumber"), "Value"))
    return together(m.sparkSession, parts, "MatrixID int, ColumnNumber int, Value double")


def inverse(m: DataFrame, on_invalid: str = "batch", block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """Inverses of square matrices, from the reduced form of [A | I]; a singular one has none.  Odd cases are as in row_echelon."""
    sound = materialise(checked(m, on_invalid, "n_rows != n_columns"))
    sizes = sound.groupBy("MatrixID").agg(F.max("RowNumber").alias("n"))
    rows = sizes.select("MatrixID", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("RowNumber"))
    unit = rows.select("MatrixID", "RowNumber", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("c"), "n")
    unit = unit.select("MatrixID", "RowNumber", (F.col("c") + F.col("n")).alias("ColumnNumber"), (F.col("c") == F.col("RowNumber")).cast("double").alias("Value"))
    parts = []
    for key, n, columns, found in each(sound.unionByName(unit), on_invalid, "false", block, tolerance, True):
        if found.leading >= n:
            x = elements_of(found, key, n, columns, block).filter(F.col("ColumnNumber") > n)
            parts.append(x.select("MatrixID", "RowNumber", (F.col("ColumnNumber") - n).alias("ColumnNumber"), "Value"))
    return together(m.sparkSession, parts, ELEMENT)

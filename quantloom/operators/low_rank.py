"""Systems and determinants of matrices of independent square blocks plus a product of tall factors: B + U V'.

Such a matrix has as many elements as the square of its rows, but B, U and V hold it in a few for each row.  What is
eliminated is the bordered matrix [B U; V' -I], whose solution is the same: the blocks of B do not meet, so each is
eliminated in its own task, all at once, and what each leaves over adds up to the border I + V' B^-1 U, of as many rows as U
and V have columns.  That one goes through ``blocked``.  The work grows with the rows; no task holds more than a
block and the border, and the driver nothing of B, U or V.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import blocked
from quantloom.operators.matrix import without_unsound
from quantloom.schemas import MATRIX, conform, same
from quantloom.storage import materialise

BLOCK = 128
TOLERANCE = 1e-12
BODY, LEFT, RIGHT, GIVEN = range(4)


def reduced_blocks(m: DataFrame, left: DataFrame, right: DataFrame, given: DataFrame | None, on_invalid: str, block: int) -> DataFrame:
    """MatrixID, g, k, n, sign, log_size of each block of B, z (B^-1 [U b]) and border (V' B^-1 [U b]), both row by row."""
    left, right = conform(left, MATRIX), conform(right, MATRIX)
    parts = [(conform(m, MATRIX), BODY), (left, LEFT), (right, RIGHT)]
    if given is not None:
        parts.append((conform(given.withColumn("ColumnNumber", F.lit(1)), MATRIX), GIVEN))
    whole = parts[0][0].withColumn("kind", F.lit(BODY))
    for part, kind in parts[1:]:
        whole = whole.unionByName(part.withColumn("kind", F.lit(kind)))
    widths = left.unionByName(right).groupBy(F.col("MatrixID").alias("of")).agg(F.max("ColumnNumber").alias("k"))
    placed = whole.join(F.broadcast(widths), same(F.col("MatrixID"), F.col("of")), "left")
    placed = placed.select("MatrixID", F.coalesce(F.floor((F.col("RowNumber") - 1) / block).cast("int"), F.lit(-1)).alias("g"), F.coalesce("k", F.lit(0)).alias("k"), "kind", "RowNumber", "ColumnNumber", "Value")
    schema = "MatrixID int, g int, k int, n int, sound boolean, sign double, log_size double, z array<double>, border array<double>"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        g, k = int(key[1]), int(part["k"].iloc[0])
        n, sound, sign, log_size, z, border = 0, False, 1.0, 0.0, np.zeros(0), np.zeros(0)
        named = g >= 0 and not part[["ColumnNumber", "Value"]].isna().any(axis=None) and not part.duplicated(["kind", "RowNumber", "ColumnNumber"]).any()
        if named:
            kinds, values = part["kind"].to_numpy(), part["Value"].to_numpy()
            rows, columns = part["RowNumber"].to_numpy().astype(int) - 1 - g * block, part["ColumnNumber"].to_numpy().astype(int) - 1
            own = columns - np.where(kinds == BODY, g * block, 0)
            body = kinds == BODY
            n = int(rows[body].max(initial=-1)) + 1
            if n and (rows < n).all() and (own >= 0).all() and (own[body] < n).all():
                a, sides, v = np.zeros((n, n)), np.zeros((n, k + 1)), np.zeros((n, k))
                a[rows[body], own[body]] = values[body]
                for to, kind, shift in ((sides, LEFT, 0), (v, RIGHT, 0), (sides, GIVEN, k)):
                    mine = kinds == kind
                    to[rows[mine], own[mine] + shift] = values[mine]
                sign, log_size = map(float, np.linalg.slogdet(a))
                if sign and np.linalg.norm(a, 1) * np.linalg.norm(np.linalg.inv(a), 1) * TOLERANCE < 1:
                    sound, z = True, np.linalg.solve(a, sides)
                    border = v.T @ z
        out = pd.DataFrame({"g": [g], "k": [k], "n": [n], "sound": [sound], "sign": [sign], "log_size": [log_size], "z": [z.ravel()], "border": [border.ravel()]})
        out.insert(0, "MatrixID", pd.Series([key[0]], dtype="Int32"))
        return out

    found = materialise(placed.groupBy("MatrixID", "g").applyInPandas(run, schema))
    gaps = F.sum("n") != F.max(F.col("g") * block + F.col("n"))
    bad = found.groupBy("MatrixID").agg((~F.every("sound") | gaps).alias("bad")).filter("bad").select("MatrixID")
    return without_unsound(found, bad, on_invalid)


def borders(found: DataFrame) -> DataFrame:
    """Elements of [I + V' B^-1 U | V' B^-1 b] of each matrix."""
    placed = found.select("MatrixID", "k", F.posexplode("border").alias("place", "x")).groupBy("MatrixID", "k", "place").agg(F.sum("x").alias("x"))
    width = F.col("k") + 1
    row, column = F.floor(F.col("place") / width).cast("int"), F.col("place") % width
    return materialise(placed.select("MatrixID", "k", (row + 1).alias("RowNumber"), (column + 1).alias("ColumnNumber"), (F.col("x") + (row == column).cast("double")).alias("Value")))


def linear_system(m: DataFrame, left: DataFrame, right: DataFrame, given: DataFrame, on_invalid: str = "batch", block: int = BLOCK) -> DataFrame:
    """MatrixID, ColumnNumber, Value: the solution x of (B + U V') x = b for each matrix; none unless there is exactly one.

    m holds the elements of B, left those of U, right those of V (a row for each row of B), given b (MatrixID, RowNumber,
    Value); elements that are missing are 0.  Blocks are of rows and columns 1 to `block`, and so on.  A matrix is unsound if an element is null,
    there twice or outside its block, if rows are missing or if a block is singular by itself (``blocked`` takes those).  It empties
    the result, or is left out (``"group"``).  A null id is an id like any other; an empty table of B gives an empty table.
    """
    found = reduced_blocks(m, left, right, given, on_invalid, block)
    solved = blocked.linear_system(borders(found))
    y = solved.groupBy(F.col("MatrixID").alias("of")).agg(F.sort_array(F.collect_list(F.struct("ColumnNumber", "Value"))).alias("y"))
    met = found.join(F.broadcast(y), same(F.col("MatrixID"), F.col("of")), "left").filter("k = 0 or y is not null")
    pieces = met.select("MatrixID", (F.col("g") * block).alias("before"), "k", "z", F.coalesce("y.Value", F.array().cast("array<double>")).alias("y"))
    width = F.col("k") + 1
    at = lambda i, j: F.get("z", i * width + j)
    value = lambda i: F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0.0), lambda total, j: total + F.when(j == F.col("k"), at(i, j)).otherwise(-at(i, j) * F.get("y", j)))
    rows = pieces.select("MatrixID", "before", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("z") / width).cast("int") - 1), value)).alias("i", "Value"))
    return rows.select("MatrixID", (F.col("before") + F.col("i") + 1).cast("int").alias("ColumnNumber"), "Value")


def determinant(m: DataFrame, left: DataFrame, right: DataFrame, on_invalid: str = "batch", block: int = BLOCK) -> DataFrame:
    """MatrixID, Sign, LogDeterminant (natural, of the magnitude) of B + U V'; a singular one has sign 0 and no logarithm.  Odd cases are as in linear_system."""
    found = reduced_blocks(m, left, right, None, on_invalid, block)
    flips = F.when(F.count_if(F.col("sign") < 0) % 2 == 0, 1.0).otherwise(-1.0).alias("own_sign")
    blocks = found.groupBy(F.col("MatrixID").alias("of"), "k").agg(flips, F.sum("log_size").alias("own_log"))
    of_border = blocked.determinant(borders(found).filter("ColumnNumber <= k")).drop("Determinant")
    both = blocks.join(of_border, same(F.col("of"), F.col("MatrixID")), "left")
    sign = F.when(F.col("k") == 0, F.col("own_sign")).otherwise(F.col("own_sign") * F.col("Sign"))
    log = F.when(F.col("k") == 0, F.col("own_log")).otherwise(F.col("own_log") + F.col("LogDeterminant"))
    return both.select(F.col("of").alias("MatrixID"), (sign + 0.0).alias("Sign"), log.alias("LogDeterminant"))

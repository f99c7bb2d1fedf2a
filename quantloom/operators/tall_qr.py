"""QR factorisation of matrices with any number of rows, by a tree of small ones.

Each block of rows is factorised where it is.  The triangles of some blocks, one above the other,
are factorised again, and so on until one is left: that is R.  On the way each triangle keeps its
slice of the small Q.  Down the tree, a block's slice times what its parent passes down is
what it passes on; at the bottom, a block's own Q times that is its part of Q.  No task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.matrix import checked, without_unsound
from quantloom.schemas import same
from quantloom.storage import materialise

ROWS = 4096
#: Values of blocks that are not full which a task holds.
MOST_HELD = 1 << 22
#: Triangles that are factorised together; a task holds so many, of the square of the columns each.
FAN = 32
NODE = "MatrixID int, node long, n int, r array<double>"
SLICE = "MatrixID int, node long, q array<double>"


def upper(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R, both with as many columns as a, also of fewer rows."""
    n = a.shape[1]
    q, r = np.linalg.qr(np.vstack([a, np.zeros((max(n - len(a), 0), n))]))
    return q[: len(a)], r


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows in blocks as they lie, so that none moves: MatrixID, place (distinct), n, m (rows), sound, keys and a as bytes, r."""
    schema = "MatrixID int, place long, n int, m long, sound boolean, keys binary, a binary, r array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: dict[tuple[int | None, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple[int | None, int], int] = {}

        def block(of: tuple[int | None, int]) -> pa.RecordBatch:
            nonlocal count
            keys, a = (np.concatenate(x) for x in zip(*held.pop(of), strict=True))
            del sizes[of]
            sound = bool(np.isfinite(a).all()) and of[1] > 0
            r = upper(a)[1].ravel() if sound else np.zeros(0)
            count += 1
            row = [of[0]], [(task << 33) + count], [of[1]], [len(a)], [sound], [keys.tobytes()], [a.tobytes()], [r]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            ids, keys, v = batch.columns
            lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
            values = np.asarray(v.flatten().fill_null(np.nan))
            ends = np.cumsum(lengths)
            shapes = pd.DataFrame({"id": ids.to_pandas().astype("Int32"), "n": lengths})
            keys = keys.fill_null(-1).to_numpy()
            for (key, n), at in shapes.groupby(["id", "n"], dropna=False).indices.items():
                of = (None if pd.isna(key) else int(key), int(n))
                a = values[(ends[at] - n)[:, None] + np.arange(n)]
                for begin in range(0, len(at), ROWS):
                    held.setdefault(of, []).append((keys[at[begin : begin + ROWS]], a[begin : begin + ROWS]))
                    sizes[of] = sizes.get(of, 0) + len(held[of][-1][0])
                    if sizes[of] >= ROWS:
                        yield block(of)
            if sum(size * of[1] for of, size in sizes.items()) > MOST_HELD:
                for of in list(held):
                    yield block(of)
        for of in list(held):
            yield block(of)

    return rows.select("MatrixID", F.col("RowKey").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, schema)


def joined(nodes: DataFrame) -> DataFrame:
    """A level up: of each FAN nodes their triangle, and each one's slice of Q as `slices`."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        n = int(part["n"].iloc[0])
        q, r = upper(np.vstack([np.reshape(x, (n, n)) for x in part["r"]]))
        slices = [{"node": int(k), "q": q[i * n : (i + 1) * n].ravel().tolist()} for i, k in enumerate(part["node"])]
        return pd.DataFrame({"MatrixID": pd.Series([key[0]], dtype="Int32"), "node": [key[1]], "n": [n], "r": [r.ravel()], "slices": [slices]})

    return nodes.groupBy("MatrixID", F.floor(F.col("node") / FAN).alias("node")).applyInPandas(run, f"{NODE}, slices array<struct<node: bigint, q: array<double>>>")


def of_rows(rows: DataFrame, on_invalid: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Q as rows (MatrixID, RowKey, v) and R as elements of the matrices whose rows come as (MatrixID, RowKey, v: their values as an array).

    Rows stay in the task that reads them, in blocks, which are written once; RowKey only names them, and should be a long
    that is distinct in a matrix.  A matrix is unsound if rows differ in length or hold a null or what is not finite, or if it has
    fewer rows than columns: it empties the results, or is left out (``"group"``).  R has no negative diagonal.
    """
    blocks = materialise(in_blocks(rows))
    wrong = (F.min("n") != F.max("n")) | ~F.every("sound") | (F.sum("m") < F.max("n"))
    bad = blocks.groupBy("MatrixID").agg(wrong.alias("wrong")).filter("wrong").select("MatrixID")
    blocks = without_unsound(blocks, bad, on_invalid)
    numbers = F.row_number().over(Window.partitionBy("MatrixID").orderBy("place")).cast("long") - 1  # of blocks: few
    top = materialise(blocks.select("MatrixID", "place", "n", "r").withColumn("node", numbers))
    named = top.select("MatrixID", "place", "node")
    top = top.drop("place")
    levels: list[DataFrame] = []
    while not top.filter("node > 0").isEmpty():
        above = materialise(joined(top))
        levels.append(above.select("MatrixID", F.explode("slices").alias("s")).select("MatrixID", "s.*"))
        top = above.drop("slices")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the last triangle, the signs that make its diagonal positive, as a matrix to pass down, and the triangle with them."""
        for part in batches:
            out = []
            for n, r in zip(part["n"], part["r"], strict=True):
                r = np.reshape(r, (n, n))
                signs = np.where(np.diag(r) < 0, -1.0, 1.0)
                out.append((np.diag(signs).ravel(), (signs[:, None] * r).ravel()))
            yield part.assign(q=[q for q, _ in out], r=[r for _, r in out])[["MatrixID", "node", "q", "n", "r"]]

    root = materialise(top.mapInPandas(signed, f"{SLICE}, n int, r array<double>"))
    down = root.select("MatrixID", "node", "q")

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            q = [(np.reshape(a, (-1, int(len(a) ** 0.5))) @ np.reshape(b, (-1, int(len(b) ** 0.5)))).ravel() for a, b in zip(part["q"], part["passed"], strict=True)]
            yield part.assign(q=q)[["MatrixID", "node", "q"]]

    for below in reversed(levels):
        passed = down.select(F.col("MatrixID").alias("of"), F.col("node").alias("parent"), F.col("q").alias("passed"))
        met = below.join(passed, below["MatrixID"].eqNullSafe(passed["of"]) & (F.floor(below["node"] / FAN) == passed["parent"]))
        down = materialise(met.select("MatrixID", "node", "q", "passed").mapInPandas(times, SLICE))

    def part_of_q(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, keys, a, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, a = np.frombuffer(keys, np.int64), np.frombuffer(a).reshape(-1, n)
                values = (upper(a)[0] @ np.reshape(q, (n, n))).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.int32()), pa.array(keys), lists], ["MatrixID", "RowKey", "v"])

    passed = named.join(down.withColumnRenamed("MatrixID", "of").withColumnRenamed("node", "at"), same(F.col("MatrixID"), F.col("of")) & (F.col("node") == F.col("at")))
    passed = materialise(passed.select("of", F.col("place").alias("at"), "q"))
    met = blocks.join(passed, same(blocks["MatrixID"], passed["of"]) & (blocks["place"] == passed["at"]))
    found = met.select("MatrixID", "n", "keys", "a", "q").mapInArrow(part_of_q, "MatrixID int, RowKey long, v array<double>")
    places = root.select("MatrixID", "n", F.posexplode("r").alias("k", "Value"))
    of_r = places.select("MatrixID", (F.floor(F.col("k") / F.col("n")) + 1).cast("int").alias("RowNumber"), (F.col("k") % F.col("n") + 1).cast("int").alias("ColumnNumber"), (F.col("Value") + 0.0).alias("Value"))
    return found, of_r


def tall_qr(m: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """Rows tagged 'Q Matrix' (rows as the matrix has, orthonormal columns) and 'R Matrix' (square, its diagonal not negative).

    A matrix has at least as many rows as columns, else it is unsound.  R is unique where the columns do not
    depend on each other.  A null id is an id like any other, empty tables give an empty table.  Where rows are
    at hand as such, of_rows() spares their exchange as elements.
    """
    m = checked(m, on_invalid, "n_rows < n_columns")
    arrays = m.groupBy("MatrixID", "RowNumber").agg(F.sort_array(F.collect_list(F.struct("ColumnNumber", "Value"))).alias("e"))
    q, r = of_rows(arrays.select("MatrixID", F.col("RowNumber").alias("RowKey"), F.col("e.Value").alias("v")), on_invalid)
    elements = q.select("MatrixID", F.lit("Q Matrix").alias("Result"), F.col("RowKey").cast("int").alias("RowNumber"), F.posexplode("v").alias("k", "Value"))
    elements = elements.select("MatrixID", "Result", "RowNumber", (F.col("k") + 1).alias("ColumnNumber"), "Value")
    return elements.unionByName(r.select("MatrixID", F.lit("R Matrix").alias("Result"), "RowNumber", "ColumnNumber", "Value"))

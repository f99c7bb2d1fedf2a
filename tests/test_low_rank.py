"""Blocks plus a product of factors against numpy and against elimination of the whole matrix, and a matrix that is too large as n^2 elements."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import blocked, low_rank
from quantloom.operators.matrix import ELEMENT


def made(spark, seed, n, k, block, key=1):
    r = np.random.default_rng(seed)
    b = np.zeros((n, n))
    for at in range(0, n, block):
        own = slice(at, min(at + block, n))
        b[own, own] = r.normal(size=b[own, own].shape)
    u, v, right = r.normal(size=(n, k)), r.normal(size=(n, k)), r.normal(size=n)
    rows = lambda a: [(key, i + 1, j + 1, float(a[i, j])) for i, j in np.argwhere(a).tolist()]
    return b + u @ v.T, right, [spark.createDataFrame(rows(a), ELEMENT) for a in (b, u, v, right[:, None])]


@pytest.mark.parametrize("n, k, block, key", [(7, 1, 3, 1), (8, 3, 4, None), (5, 2, 9, 2), (6, 4, 1, 3)])
def test_against_numpy_and_the_whole_matrix(spark, n, k, block, key):
    a, right, (b, u, v, given) = made(spark, n + k, n, k, block, key)
    got = {(r["MatrixID"], r["ColumnNumber"]): r["Value"] for r in low_rank.linear_system(b, u, v, given, block=block).collect()}
    assert got == {(key, j + 1): pytest.approx(x, rel=1e-8) for j, x in enumerate(np.linalg.solve(a, right))}
    whole = spark.createDataFrame([(key, i + 1, j + 1, float(a[i, j])) for i in range(n) for j in range(n)], ELEMENT)
    (ours,), (theirs,) = low_rank.determinant(b, u, v, block=block).collect(), blocked.determinant(whole, block=2).collect()
    assert (ours["MatrixID"], ours["Sign"]) == (key, theirs["Sign"]) and ours["LogDeterminant"] == pytest.approx(theirs["LogDeterminant"], abs=1e-8)


def test_odd_cases(spark):
    e = lambda rows: spark.createDataFrame(rows, ELEMENT)
    one = e([(1, 1, 1, 1.0), (1, 2, 1, 1.0)])
    unit = e([(1, 1, 1, 1.0), (1, 2, 2, 1.0)])
    assert [r["Value"] for r in low_rank.linear_system(unit, one, e([]), one).collect()] == [1.0, 1.0]  # V is zero
    assert [r["Value"] for r in low_rank.linear_system(unit, e([]), e([]), one).collect()] == [1.0, 1.0]  # no border
    assert [tuple(r) for r in low_rank.determinant(unit, e([]), e([])).collect()] == [(1, 1.0, 0.0)]
    minus = e([(1, 1, 1, -1.0)])
    assert low_rank.linear_system(unit, one, minus, one).count() == 0  # I - (1 1)'(1 0) is singular
    assert [tuple(r) for r in low_rank.determinant(unit, one, minus).collect()] == [(1, 0.0, None)]
    for wrong in ([(1, 1, 1, 1.0), (1, 3, 3, 1.0)], [(1, 1, 1, 1.0), (1, 2, 2, None)], [(1, 1, 1, 1.0), (1, 1, 1, 1.0), (1, 2, 2, 1.0)], [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 1, 2, 1.0)], [(1, 1, 1, 1.0), (1, 2, 2, 0.0)], [(1, None, 1, 1.0)]):
        assert low_rank.linear_system(e(wrong), one, one, one, block=1).count() == 0
        other = unit.withColumn("MatrixID", F.lit(2)).unionByName(e(wrong))
        factors = one.unionByName(one.withColumn("MatrixID", F.lit(2)))
        assert {r["MatrixID"] for r in low_rank.linear_system(other, factors, factors, factors, "group", block=1).collect()} == {2}
    assert low_rank.linear_system(e([]), e([]), e([]), e([])).count() == 0


def test_forty_thousand_unknowns(spark):
    """1.6e9 elements as a whole: elimination of all of them does not end here."""
    n = spark.range(1, 40_001).select(F.lit(1).alias("MatrixID"), F.col("id").cast("int").alias("RowNumber"))
    one = n.select("*", F.lit(1).alias("ColumnNumber"), F.lit(1.0).alias("Value"))
    x = low_rank.linear_system(n.select("*", F.col("RowNumber").alias("ColumnNumber"), F.lit(2.0).alias("Value")), one, one, one)
    assert x.agg(F.count("*"), F.min("Value") * 40_002, F.max("Value") * 40_002).first() == (40_000, pytest.approx(1.0), pytest.approx(1.0))

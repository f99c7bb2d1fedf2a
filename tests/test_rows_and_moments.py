"""Tall QR of rows where they lie, and least squares of moments, against numpy; neither exchanges the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import sql
from quantloom.operators import tall_qr


def test_qr_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tall_qr, "ROWS", 7)
    r = np.random.default_rng(5)
    a = {1: r.normal(size=(700, 3)), None: r.normal(size=(40, 5)), 3: r.normal(size=(2, 2))}
    rows = [(k, i, v.tolist()) for k, x in a.items() for i, v in enumerate(x)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    q, of_r = tall_qr.of_rows(spark.createDataFrame(rows, "MatrixID int, RowKey long, v array<double>").repartition(3))
    got, triangles = q.collect(), of_r.collect()
    for k, x in a.items():
        ours = np.array([g["v"] for g in sorted((g for g in got if g["MatrixID"] == k), key=lambda g: g["RowKey"])])
        t = np.zeros((x.shape[1],) * 2)
        for e in triangles:
            if e["MatrixID"] == k:
                t[e["RowNumber"] - 1, e["ColumnNumber"] - 1] = e["Value"]
        assert np.allclose(ours @ t, x) and np.allclose(ours.T @ ours, np.eye(x.shape[1])) and np.allclose(t, np.triu(t)) and (np.diag(t) >= 0).all()


@pytest.mark.parametrize("wrong", [[[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]], [[1.0, 2.0]], [[1.0, float("nan")], [2.0, 1.0]], [None, [1.0]]])
def test_unsound_rows(spark, wrong):
    rows = [(1, i, v) for i, v in enumerate(wrong)] + [(2, 0, [3.0, 0.0]), (2, 1, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "MatrixID int, RowKey long, v array<double>")
    assert [x.count() for x in tall_qr.of_rows(df)] == [0, 0]
    assert [{r["MatrixID"] for r in x.collect()} for x in tall_qr.of_rows(df, "group")] == [{2}, {2}]
    assert [x.count() for x in tall_qr.of_rows(df.limit(0))] == [0, 0]


def test_least_squares_of_moments(spark):
    sql.register(spark)
    df = spark.range(200).select((F.col("id") % 3).cast("int").alias("g"), F.when(F.col("id") % 7 > 0, F.sin("id") + 1e6).alias("y"), F.cos(F.col("id") * 2).alias("x"), F.when(F.col("id") % 5 > 0, F.sqrt("id")).alias("z"))
    df = df.unionByName(spark.createDataFrame([(8, None, 1.0, 2.0), (9, 1.0, 1.0, 1.0), (9, 2.0, 1.0, 1.0), (None, 1.0, 1.0, 0.0), (None, 2.0, 2.0, 1.0), (None, 5.0, 2.0, 3.0)], df.schema))
    df.createOrReplaceTempView("fitted")
    by_rows = spark.sql("SELECT * FROM least_squares(TABLE(SELECT g, y, x, z FROM fitted) PARTITION BY g)")
    by_moments = spark.sql(f"SELECT * FROM least_squares_of_moments(TABLE(SELECT g, {sql.moments('y', 'x', 'z')} FROM fitted GROUP BY g) PARTITION BY g)")
    theirs = {r[0]: r for r in by_rows.collect()}
    ours = {r[0]: r for r in by_moments.collect()}
    assert ours.keys() == theirs.keys() == {0, 1, 2, 8, 9, None}
    for k, r in ours.items():
        assert r[1] == theirs[k][1] and (r[2] is None) == (theirs[k][2] is None)
        if r[2] is not None:
            assert r[2] == pytest.approx(theirs[k][2], rel=1e-9) and r[3] == pytest.approx(theirs[k][3], rel=1e-6)

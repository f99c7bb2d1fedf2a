"""Blocked elimination against numpy: small blocks, exchanged rows, ranks short of full, unsound and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators import blocked, matrix


def table(spark, matrices):
    return spark.createDataFrame([(k, i, j, float(v)) for k, a in matrices.items() for i, row in enumerate(a, 1) for j, v in enumerate(row, 1)], matrix.ELEMENT)


def arrays(df, shapes):
    out = {k: np.full(shape, np.nan) for k, shape in shapes.items()}
    for r in df.collect():
        at = (r["RowNumber"] - 1, r["ColumnNumber"] - 1)
        assert np.isnan(out[r["MatrixID"]][at])
        out[r["MatrixID"]][at] = r["Value"]
    return out


def reduced_form(a):
    a, r = a.astype(float).copy(), 0
    for c in range(a.shape[1]):
        if r == len(a):
            break
        best = r + int(np.argmax(np.abs(a[r:, c])))
        if abs(a[best, c]) < 1e-9:
            a[r:, c] = 0
            continue
        a[[r, best]] = a[[best, r]]
        a[r] /= a[r, c]
        others = np.arange(len(a)) != r
        a[others] -= np.outer(a[others, c], a[r])
        r += 1
    return a


RNG = np.random.default_rng(3)
FULL = RNG.normal(size=(11, 11))
SHORT = RNG.normal(size=(10, 3)) @ RNG.normal(size=(3, 12))
GAPS = np.array([[0, 0, 2, 1, 0, 3, 4], [0, 0, 4, 2, 0, 6, 9], [0, 0, 0, 0, 5, 1, 1], [0, 0, 2, 1, 5, 4, 5]])


def test_echelon_forms(spark):
    block, matrices = 4, {1: FULL, None: SHORT, 3: GAPS, 4: np.zeros((5, 4))}
    shapes = {k: m.shape for k, m in matrices.items()}
    m = table(spark, matrices)
    reduced = arrays(blocked.row_echelon(m, reduced=True, block=block), shapes)
    plain = arrays(blocked.row_echelon(m, block=block), shapes)
    for k, a in matrices.items():
        assert np.allclose(reduced[k], reduced_form(a), atol=1e-8)
        assert np.allclose(reduced_form(plain[k]), reduced_form(a), atol=1e-8)
        leads = [int(np.flatnonzero(row)[0]) if row.any() else a.shape[1] + i for i, row in enumerate(plain[k])]
        assert leads == sorted(set(leads))


def test_tournament_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(blocked, "FAN_IN", 2)
    a = RNG.normal(size=(9, 9)) * np.exp(RNG.normal(size=(9, 1)) * 4)
    out = blocked.determinant(table(spark, {1: a}), block=2).first()
    sign, log = np.linalg.slogdet(a)
    assert out["Sign"] == sign and out["LogDeterminant"] == pytest.approx(log)


def test_determinants(spark):
    exchanged = np.eye(9)[RNG.permutation(9)] @ np.triu(RNG.normal(size=(9, 9)))
    matrices = {2: exchanged, 3: SHORT[:5, :5], None: np.eye(6)[::-1], 5: np.eye(7) * 1e-50}
    out = {r["MatrixID"]: r for r in blocked.determinant(table(spark, matrices), block=5).collect()}
    for k in (2, None):
        assert out[k]["Determinant"] == pytest.approx(np.linalg.det(matrices[k]), rel=1e-9)
    assert (out[3]["Sign"], out[3]["LogDeterminant"], out[3]["Determinant"]) == (0.0, None, 0.0)
    assert out[5]["LogDeterminant"] == pytest.approx(7 * np.log(1e-50)) and out[5]["Determinant"] == 0.0


def test_systems_and_inverses(spark):
    a, b = FULL[:7, :7], RNG.normal(size=(7, 1))
    tall = np.vstack([a, a[:2] * 2])
    systems = {
        1: np.hstack([a, b]),
        2: np.hstack([tall, np.vstack([b, b[:2] * 2])]),  # equations in excess that agree
        3: np.hstack([tall, np.vstack([b, b[:2]])]),  # and that do not
        4: np.hstack([SHORT[:7, :5], b]),  # no solution
        5: np.hstack([np.ones((2, 2)), np.ones((2, 1))]),  # many
        6: np.array([[3.0]]),  # no unknown
    }
    got = {}
    for r in blocked.linear_system(table(spark, systems), block=5).collect():
        got.setdefault(r["MatrixID"], {})[r["ColumnNumber"]] = r["Value"]
    want = np.linalg.solve(a, b).ravel()
    assert set(got) == {1, 2}
    for k in got:
        assert [got[k][c] for c in range(1, 8)] == pytest.approx(want, abs=1e-8)
    found = blocked.inverse(table(spark, {1: a, None: np.eye(5)[::-1] * 2, 3: SHORT[:5, :5]}), block=5)
    out = arrays(found, {1: (7, 7), None: (5, 5)})
    assert np.allclose(out[1] @ a, np.eye(7), atol=1e-8) and np.allclose(out[None], np.eye(5)[::-1] / 2)


def test_unsound_empty_and_other_columns(spark):
    hole = table(spark, {1: [[1, 2], [3, 4]]}).filter("RowNumber + ColumnNumber < 4")
    both = hole.unionByName(table(spark, {2: [[2, 1], [1, 2]]})).selectExpr("*", "1 AS g", "'x' AS v")
    assert blocked.row_echelon(both).count() == blocked.row_echelon(both.limit(0)).count() == blocked.inverse(both.limit(0)).count() == 0
    assert blocked.determinant(both).count() == blocked.linear_system(both.limit(0)).count() == 0
    assert [tuple(r) for r in blocked.determinant(both, on_invalid="group").select("MatrixID", "Sign").collect()] == [(2, 1.0)]
    wide = table(spark, {1: [[1, 2, 3]]})
    assert blocked.determinant(wide).count() == blocked.inverse(wide).count() == 0

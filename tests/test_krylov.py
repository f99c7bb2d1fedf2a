"""The largest eigenpairs against numpy: many restarts, invariant subspaces, equal and negative eigenvalues, unsound matrices."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators import krylov, matrix


def table(spark, matrices):
    return spark.createDataFrame([(k, i, j, float(v)) for k, a in matrices.items() for i, row in enumerate(a, 1) for j, v in enumerate(row, 1)], matrix.ELEMENT)


def test_largest_eigenpairs(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    matrices = {1: a, None: np.ones((5, 5)), 3: np.diag([2.0, -7.0]), 4: np.array([[4.0]])}
    found = krylov.largest_eigenpairs(table(spark, matrices), 2, tolerance=1e-8, block=3, steps=4).collect()
    for key, m in matrices.items():
        values = {r["RowNumber"]: r["Value"] for r in found if r["MatrixID"] == key and r["Result"] == "Eigenvalue"}
        want = sorted(np.linalg.eigvalsh(m), key=lambda v: -abs(v))[:2]
        assert [values[k] for k in sorted(values)] == pytest.approx(want, abs=1e-6)
        q = np.zeros((len(m), len(values)))
        for r in found:
            if r["MatrixID"] == key and r["Result"] == "Q Matrix":
                q[r["RowNumber"] - 1, r["ColumnNumber"] - 1] = r["Value"]
        assert np.allclose(q.T @ q, np.eye(len(values)), atol=1e-8)
        assert np.abs(m @ q - q * [values[k] for k in sorted(values)]).max() < 1e-6 * np.abs(m).max() * len(m)
        assert (q[np.abs(q).argmax(axis=0), range(q.shape[1])] > 0).all()


def test_unsound_and_empty(spark):
    lopsided = table(spark, {1: [[1, 2], [3, 4]]})
    assert krylov.largest_eigenpairs(lopsided).count() == krylov.largest_eigenpairs(lopsided.limit(0)).count() == 0
    both = lopsided.unionByName(table(spark, {2: [[2, 1], [1, 2]]}))
    assert krylov.largest_eigenpairs(both).count() == 0
    assert {r["MatrixID"] for r in krylov.largest_eigenpairs(both, on_invalid="group").collect()} == {2}

"""Covariances and what rests on them: merged over many tasks, large means, columns that do not vary, unsound matrices."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators import matrix, regression

ELEMENT = matrix.ELEMENT


def table(spark, matrices: dict, parts: int = 6):
    rows = [(key, i, j, None if v is None else float(v)) for key, a in matrices.items() for i, row in enumerate(a, 1) for j, v in enumerate(row, 1)]
    return spark.createDataFrame(rows, ELEMENT).repartition(parts)


def read(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["MatrixID"], {})[r["RowNumber"], r["ColumnNumber"]] = r["Value"]
    return out


def test_many_tasks_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + [1e8, -5.0, 0.0]
    a = np.column_stack([a, np.full(500, 0.1)])
    b = rng.normal(size=(7, 2))
    m = table(spark, {1: a, None: b})
    cov, corr = read(matrix.covariance(m)), read(matrix.correlation(m))
    for key, x in ((1, a), (None, b)):
        want = np.cov(x.T)
        assert all(cov[key][i + 1, j + 1] == pytest.approx(want[i, j], rel=1e-6, abs=1e-9) for i in range(x.shape[1]) for j in range(x.shape[1]))
    assert [corr[1][4, j] for j in (1, 2, 3, 4)] == [0.0] * 4 and cov[1][4, 4] == 0.0  # by no rounding either
    assert corr[None][1, 2] == pytest.approx(np.corrcoef(b.T)[0, 1])
    y = table(spark, {1: (a[:, 1:3] @ [2.0, -3.0])[:, None], None: b[:, :1]})
    beta = {(r["MatrixID"], r["ResultID"]): r["Value"] for r in regression.multiple_linear_regression(table(spark, {1: a[:, 1:3], None: b}), y).collect()}
    assert [beta[1, k] for k in (1, 2, 0)] == pytest.approx([2, -3, 1]) and beta[None, 1] == pytest.approx(1) and beta[None, 2] == pytest.approx(0, abs=1e-9)


UNSOUND = {
    "a null": [(9, 1, 1, 1.0), (9, 1, 2, None)],
    "a gap in a row": [(9, 1, 1, 1.0), (9, 1, 3, 1.0)],
    "a missing row": [(9, 1, 1, 1.0), (9, 3, 1, 1.0)],
    "an element twice": [(9, 1, 1, 1.0), (9, 1, 1, 1.0)],
    "rows of two lengths": [(9, 1, 1, 1.0), (9, 2, 1, 1.0), (9, 2, 2, 1.0)],
    "no row number": [(9, None, 1, 1.0)],
    "no column number": [(9, 1, None, 1.0)],
}


@pytest.mark.parametrize("kind", sorted(UNSOUND))
def test_unsound_matrices(spark, kind):
    good = table(spark, {1: [[1, 2], [3, 5], [4, 1]]})
    m = good.unionByName(spark.createDataFrame(UNSOUND[kind], ELEMENT)).repartition(3)
    assert matrix.covariance(m).count() == 0
    assert set(read(matrix.covariance(m, on_invalid="group"))) == {1}


def test_regression_needs_both_sides(spark):
    x, y = table(spark, {1: [[1, 2], [3, 5], [4, 1]]}), table(spark, {1: [[1], [2], [3]]})
    run = regression.multiple_linear_regression
    assert run(x, y).count() == 3
    assert run(x, y.unionByName(table(spark, {2: [[1]]}))).count() == 0  # a y without its x
    assert run(x.unionByName(table(spark, {2: [[1]]})), y).count() == 0
    assert run(x.unionByName(table(spark, {2: [[1]]})), y, on_invalid="group").count() == 3
    assert run(x, table(spark, {1: [[1, 1], [2, 2], [3, 3]]})).count() == 0  # y of two columns
    assert run(x.limit(0), y.limit(0)).count() == matrix.covariance(x.limit(0)).count() == 0


def test_elements_are_shuffled_once(spark, monkeypatch):
    """The job behind a covariance: one exchange of elements, one of a row for each pair of columns."""
    plans = []
    real = matrix.materialise
    monkeypatch.setattr(matrix, "materialise", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a, **k))[1])
    matrix.covariance(table(spark, {1: [[1, 2], [3, 5], [4, 1]]}, 3)).count()
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 2 and "Join" not in plans[0]

"""The power-series solver: known optima, the same whole and by rows, statuses, and the series against the trajectory."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.operators.affine_scaling import next_right_side, optimise, power_series_optimization, slack_series

O, C, B = "ProblemID int, VariableID int, Value double", "ProblemID int, ConstraintID int, VariableID int, Value double", "ProblemID int, ConstraintID int, Value double"
BOX = ([[1, 0], [0, 1], [-1, 0], [0, -1]], [4, 5, 0, 0], [1, 1])
FOUR = ([[-1, 1], [-1, -1], [0, -1], [1, -2]], [1, -2, 0, 4], [-2, -1])


def tables(spark, problems):
    o, c, b = [], [], []
    for key, (a, right, goal) in problems.items():
        o += [(key, j, float(v)) for j, v in enumerate(goal, 1)]
        c += [(key, i, j, float(v)) for i, row in enumerate(a, 1) for j, v in enumerate(row, 1) if v]
        b += [(key, i, float(v)) for i, v in enumerate(right, 1)]
    return spark.createDataFrame(o, O), spark.createDataFrame(c, C), spark.createDataFrame(b, B)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["ProblemID"], {"status": r["Status"]})[r["VariableID"]] = r["Value"]
    return out


def test_known_optima_and_statuses(spark):
    problems = {
        1: FOUR, None: FOUR, 2: ([[-1, 0], [0, -1]], [0, 0], [1, 1]), 3: ([[1, 0], [-1, 0], [0, 1]], [1, -2, 1], [1, 1]),
        4: ([[1, 1], [2, 2]], [1, 1], [1, 1]), 5: ([[1]], [7], [3]), 7: BOX, 8: (BOX[0], BOX[1], [0, 0]), 9: ([[1]], [-7], [3]),
    }
    got = found(power_series_optimization(*tables(spark, problems), feasibility_tolerance=1e-9))
    for key in (1, None):
        assert got[key]["status"] == "Optimal" and [got[key][k] for k in (1, 2)] == pytest.approx([0.5, 1.5], abs=1e-6)
    assert {k: v["status"] for k, v in got.items() if k not in (1, None)} == {2: "NotUnique", 3: "Infeasible", 4: "NotUnique", 5: "Optimal", 7: "Optimal", 8: "NotUnique", 9: "Optimal"}
    assert (got[5][1], got[9][1]) == (pytest.approx(7), pytest.approx(-7)) and [got[7][k] for k in (1, 2)] == pytest.approx([4, 5], abs=1e-6) and got[2][1] is None


def test_defaults_are_approximate_and_rows_may_lie_anywhere(spark):
    args = tables(spark, {1: FOUR})
    whole = found(power_series_optimization(*args))[1]
    by_rows = found(power_series_optimization(*args, gathered=3))[1]
    assert whole[None] == pytest.approx(-2.5, abs=1e-3)
    assert [by_rows[k] for k in (1, 2, None)] == pytest.approx([whole[k] for k in (1, 2, None)], abs=1e-6)


def test_random_problems_against_all_vertices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a = np.vstack([rng.normal(size=(8, 2)), [[1, 0], [-1, 0], [0, 1], [0, -1]]])
        b, c = np.concatenate([rng.normal(size=8) + 1.5, np.full(4, 10.0)]), rng.normal(size=2)
        best = -np.inf
        for i in range(len(a)):
            for j in range(i):
                if abs(np.linalg.det(a[[i, j]])) > 1e-9:
                    x = np.linalg.solve(a[[i, j]], b[[i, j]])
                    if (a @ x <= b + 1e-9).all():
                        best = max(best, float(c @ x))
        x, status = optimise(c, lambda f, how: f(a, b), 0.7, 3, 1000.0, 1e-10, 777)
        if np.isinf(best):
            assert status == "Infeasible"
        else:
            assert status == "Optimal" and float(c @ x) == pytest.approx(best, abs=1e-5) and (a @ x <= b + 1e-9).all()


def test_series_follows_its_trajectory():
    """A'/v(t) = A'/v(0) + c t holds to the order of the series."""
    a, b, c = np.array(FOUR[0], float), np.array([2.0, 1.0, 3.0, 5.0]), np.array(FOUR[2], float)
    series = [np.array([0.3, 0.2])]
    v0 = b - a @ series[0]
    n = (a / v0[:, None]).T @ (a / v0[:, None])
    series.append(np.linalg.solve(n, c))
    for _ in range(4):
        series.append(np.linalg.solve(n, a.T @ next_right_side(slack_series(a, b, series))))
    gaps = []
    for t in (0.02, 0.01):
        v = b - a @ sum(term * t**k for k, term in enumerate(series))
        gaps.append(np.abs(a.T @ (1 / v) - a.T @ (1 / v0) - c * t).max())
    assert gaps[1] < gaps[0] / 50  # sixth order: 64


def test_odd_tables(spark):
    o, c, b = tables(spark, {1: BOX})
    assert power_series_optimization(o.limit(0), c.limit(0), b.limit(0)).count() == 0
    assert found(power_series_optimization(o, c.limit(0), b.limit(0)))[1]["status"] == "NotUnique"
    extra = c.selectExpr("*", "1 as id", "2 as a", "3 as b", "4 as n"), b.selectExpr("*", "1 as id", "2 as of", "3 as i", "4 as values")
    twice = extra[0].unionByName(extra[0].selectExpr("ProblemID", "ConstraintID", "VariableID", "CAST(NULL AS DOUBLE) AS Value", "id", "a", "b", "n"))
    got = found(power_series_optimization(o.withColumn("names", o["Value"]), twice, extra[1]))[1]
    assert got["status"] == "Optimal" and got[None] == pytest.approx(9, abs=1e-2)
    for wrong in ({"safety_factor": 1.0}, {"taylor_order": 0}, {"mu_for_big_m": 0}, {"feasibility_tolerance": 1.0}, {"max_iterations": 3}):
        with pytest.raises(ValueError):
            power_series_optimization(o, c, b, **wrong)

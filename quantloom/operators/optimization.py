"""Linear optimisation: many small problems at once, each solved by one numpy kernel.

Constraints are brought to one form as tables (signs of rows, equalities apart); a problem is then
solved by a primal-dual interior-point method.  Equalities are solved for first and the search goes
on in the null space that they leave, so they need no opposing inequalities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS = 777
GAP = 1e-9

OPTIMAL, INFEASIBLE, UNBOUNDED, NOT_CONVERGED = "Optimal", "Infeasible", "NotUnique", "NotConverged"


def interior_point(c: np.ndarray, a: np.ndarray, b: np.ndarray, max_iterations: int = MAX_ITERATIONS) -> tuple[np.ndarray, str]:
    """max c'x subject to a x <= b, x free."""
    m, n = a.shape
    if n == 0:
        return np.empty(0), OPTIMAL if (b >= -1e-7).all() else INFEASIBLE
    if m == 0 or np.linalg.matrix_rank(a) < n:
        return np.zeros(n), UNBOUNDED
    size = np.maximum(np.linalg.norm(a, axis=1), 1e-12)
    a, b = a / size[:, None], b / size
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    s = np.maximum(b - a @ x, 1.0)
    z = np.ones(m)
    for _ in range(max_iterations):
        short, off, mu = b - a @ x - s, c - a.T @ z, s @ z / m
        scale = 1 + np.abs(b).max() + np.abs(c).max()
        if max(np.abs(short).max(), np.abs(off).max()) < 1e-8 * scale and mu < GAP * (1 + abs(c @ x)):
            return x, OPTIMAL
        if z.max() > 1e12 or np.abs(x).max() > 1e12:
            break
        d = z / s
        normal = (a.T * d) @ a + 1e-14 * np.eye(n)

        def direction(rc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dx = np.linalg.solve(normal, off - a.T @ ((rc - z * short) / s))  # noqa: B023
            ds = short - a @ dx  # noqa: B023
            return dx, ds, (rc - z * ds) / s  # noqa: B023

        def longest(v: np.ndarray, dv: np.ndarray) -> float:
            falling = dv < 0
            return min(1.0, float((-v[falling] / dv[falling]).min())) if falling.any() else 1.0

        try:
            dx, ds, dz = direction(-s * z)
            ahead = (s + longest(s, ds) * ds) @ (z + longest(z, dz) * dz) / m
            dx, ds, dz = direction((ahead / mu) ** 3 * mu - s * z - ds * dz)
        except np.linalg.LinAlgError:
            return x, NOT_CONVERGED
        p, q = 0.995 * longest(s, ds), 0.995 * longest(z, dz)
        x, s, z = x + p * dx, s + p * ds, z + q * dz
    feasible = (a @ x <= b + 1e-6 * (1 + np.abs(b))).all()
    return x, UNBOUNDED if feasible else INFEASIBLE


def solve(c: np.ndarray, a: np.ndarray, b: np.ndarray, equal: np.ndarray, max_iterations: int) -> tuple[np.ndarray, str]:
    """The same with equalities in the marked rows."""
    e, f = a[equal], b[equal]
    if not len(e):
        return interior_point(c, a, b, max_iterations)
    base = np.linalg.lstsq(e, f, rcond=None)[0]
    if not np.allclose(e @ base, f, atol=1e-8 * (1 + np.abs(f).max())):
        return base, INFEASIBLE
    _, values, rows = np.linalg.svd(e)
    rank = int((values > 1e-10 * values.max()).sum()) if len(values) else 0
    free = rows[rank:].T
    a, b = a[~equal], b[~equal]
    y, status = interior_point(free.T @ c, a @ free, b - a @ base, max_iterations)
    return base + free @ y, status


def linear_optimization(objective: DataFrame, coefficients: DataFrame, bounds: DataFrame, direction: str = "Maximize", max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """ProblemID, VariableID, Value, Status of each problem; the row without a VariableID is the objective's value.

    objective has ProblemID, VariableID, Value; coefficients ProblemID, ConstraintID, VariableID,
    Value; bounds ProblemID, ConstraintID, Symbol (-1: at most, 0: equal, 1: at least), Value.
    Variables are free.  A coefficient that is missing is 0, a null problem is a problem like any
    other.  Values are NULL unless the status is 'Optimal'; 'NotUnique' problems are unbounded or
    leave a variable open.  An empty table gives an empty table.
    """
    if direction not in ("Maximize", "Minimize"):
        raise ValueError("direction is 'Maximize' or 'Minimize'")
    up = 1.0 if direction == "Maximize" else -1.0
    flip = F.when(F.col("Symbol") > 0, -1.0).otherwise(1.0)
    right = bounds.select("ProblemID", F.col("ConstraintID").alias("i"), F.lit(None).cast("int").alias("j"), (flip * F.col("Value")).alias("v"), F.col("Symbol").cast("int").alias("symbol"))
    signs = bounds.select(F.col("ProblemID").alias("id"), F.col("ConstraintID").alias("of"), flip.alias("flip"))
    left = coefficients.join(signs, coefficients["ProblemID"].eqNullSafe(signs["id"]) & (coefficients["ConstraintID"] == signs["of"]))
    left = left.select("ProblemID", F.col("ConstraintID").alias("i"), F.col("VariableID").alias("j"), (F.col("flip") * F.col("Value")).alias("v"), F.lit(None).cast("int").alias("symbol"))
    goal = objective.select("ProblemID", F.lit(None).cast("int").alias("i"), F.col("VariableID").alias("j"), (F.lit(up) * F.col("Value")).alias("v"), F.lit(None).cast("int").alias("symbol"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        goal = part[part["i"].isna()]
        variables = np.sort(part["j"].dropna().unique()).astype(int)
        right = part[part["j"].isna()].sort_values("i")
        rows = right["i"].to_numpy(int)
        c = np.zeros(len(variables))
        np.add.at(c, np.searchsorted(variables, goal["j"].to_numpy(int)), goal["v"].to_numpy())
        a = np.zeros((len(rows), len(variables)))
        body = part[part["i"].notna() & part["j"].notna()]
        np.add.at(a, (np.searchsorted(rows, body["i"].to_numpy(int)), np.searchsorted(variables, body["j"].to_numpy(int))), body["v"].to_numpy())
        x, status = solve(c, a, right["v"].to_numpy(float), right["symbol"].to_numpy(int) == 0, max_iterations)
        values = [*x, up * (c @ x)] if status == OPTIMAL else [None] * (len(variables) + 1)
        out = pd.DataFrame({"VariableID": pd.Series([*variables, None], dtype="Int32"), "Value": values, "Status": status})
        out.insert(0, "ProblemID", pd.Series([key[0]] * len(out), dtype="Int32"))
        return out

    problem = goal.unionByName(left).unionByName(right)
    return problem.groupBy("ProblemID").applyInPandas(run, "ProblemID int, VariableID int, Value double, Status string")


def linear_optimization_at_most(objective: DataFrame, coefficients: DataFrame, bounds: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """The same for maximisation under bounds from above only (bounds without a Symbol)."""
    return linear_optimization(objective, coefficients, bounds.withColumn("Symbol", F.lit(-1)), "Maximize", max_iterations)

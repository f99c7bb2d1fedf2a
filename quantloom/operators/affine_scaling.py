"""Linear optimisation by affine scaling with power series: problems of any number of constraints.

Maximise c'x under A x <= b.  With slacks v = b - A x, the trajectory from an inner point obeys
A' / v(t) = A' / v(0) + c t.  Its power series follows order by order: each order's term solves a system with one
matrix N = A' D^-2 A, and the right sides come from the terms before it.  Both are sums over the
constraints, and how far a step may go is a minimum over them, so a problem with many constraints is
a few aggregates a step over its rows where they lie.  Only x, with one number a variable, and N reach the
driver.  Problems of up to `gathered` constraints are solved whole, by the same steps, in a task each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.optimization import INFEASIBLE, NOT_CONVERGED, OPTIMAL, UNBOUNDED
from quantloom.schemas import same
from quantloom.storage import materialise

GATHERED = 1 << 16
#: Steps that are tried, as multiples of the one that the first order alone allows.
TRIED = 2.0 ** (np.arange(-8, 21) / 4)

#: A part of a step over constraints a x <= b: numbers that add up, or of which the least counts, over all constraints.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Works a part out for a problem's constraints, wherever they are; "sum" or "min".
Work = Callable[[Part, str], np.ndarray]


def with_artificial(a: np.ndarray, artificial: bool) -> np.ndarray:
    return np.column_stack([a, np.full(len(a), -1.0)]) if artificial else a


def slack_series(a: np.ndarray, b: np.ndarray, x: list[np.ndarray]) -> list[np.ndarray]:
    """Terms of the slacks from those of x."""
    return [b - a @ x[0], *(-(a @ term) for term in x[1:])]


def next_right_side(v: list[np.ndarray]) -> np.ndarray:
    """r / v(0) of the next order, with 1 / v by powers of t: r is what earlier terms of v (1 / v) = 1 leave over."""
    inverse = [1 / v[0]]
    for k in range(1, len(v)):
        inverse.append(-sum(v[j] * inverse[k - j] for j in range(1, k + 1)) / v[0])
    k = len(v)
    return sum(v[j] * inverse[k - j] for j in range(1, k)) / v[0]


def solve(n: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """n x = right for a symmetric matrix of uneven scale, None if it is singular."""
    scale = 1 / np.sqrt(np.maximum(np.diag(n), 1e-300))
    try:
        found = np.linalg.solve(n * np.outer(scale, scale), right * scale) * scale
    except np.linalg.LinAlgError:
        return None
    return found if np.isfinite(found).all() else None


class Search:
    """One phase of one problem, from an inner point."""

    def __init__(self, c: np.ndarray, artificial: bool, work: Work, safety: float, order: int, tolerance: float, most: int):
        self.c, self.artificial, self.work = c, artificial, work
        self.safety, self.order, self.tolerance, self.most = safety, order, tolerance, most

    def terms(self, x: np.ndarray) -> tuple[list[np.ndarray], float] | None:
        """The power series of the trajectory from x, and the longest step that its first order allows."""
        art, size, series = self.artificial, len(x), [x]

        def normal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a = with_artificial(a, art)
            scaled = a / (b - a @ x)[:, None]
            return (scaled.T @ scaled).ravel()

        n = self.work(normal, "sum").reshape(size, size)
        first = solve(n, self.c)
        if first is None:
            return None
        series.append(first)

        def longest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            v0, v1 = slack_series(with_artificial(a, art), b, series[:2])
            return np.array([np.min(-v0[v1 < 0] / v1[v1 < 0], initial=np.inf)])

        step = float(self.work(longest, "min")[0])
        for _ in range(2, self.order + 1):

            def right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                a = with_artificial(a, art)
                return a.T @ next_right_side(slack_series(a, b, series))

            more = solve(n, self.work(right, "sum"))
            if more is None:
                break
            series.append(more)
        return series, step

    def move(self, series: list[np.ndarray], step: float) -> np.ndarray:
        """The best of the points that keep all slacks positive, at a safe part of the steps tried."""
        art = self.artificial
        ts = np.concatenate([step * TRIED, self.safety * step * TRIED])

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            v = slack_series(with_artificial(a, art), b, series)
            return np.array([np.min(sum(term * t**k for k, term in enumerate(v)) / v[0], initial=np.inf) for t in ts])

        inside = (self.work(least, "min") > 1e-9).reshape(2, -1).all(axis=0)
        reached = int(np.argmin(inside)) if not inside.all() else len(inside)
        points = [series[0] + self.safety * step * series[1]]
        points += [sum(term * t**k for k, term in enumerate(series)) for t in ts[len(TRIED) :][:reached]]
        return max(points, key=lambda p: float(self.c @ p))

    def run(self, x: np.ndarray) -> tuple[np.ndarray, str]:
        """Where the objective no longer rises by more than the tolerance, or the artificial variable is negative."""
        value = float(self.c @ x)
        for _ in range(self.most):
            if self.artificial and x[-1] < 0:
                return x, OPTIMAL
            found = self.terms(x)
            if found is None:
                return x, NOT_CONVERGED
            series, step = found
            if not np.isfinite(step):  # no constraint ends the way
                if self.artificial and series[1][-1] < 0:
                    return x + (x[-1] + 1.0) / -series[1][-1] * series[1], OPTIMAL
                return x, UNBOUNDED
            x = self.move(series, step)
            if np.abs(x).max() > 1e13:
                return x, UNBOUNDED
            before, value = value, float(self.c @ x)
            if abs(value - before) / max(abs(before), 1.0) < self.tolerance:
                return x, OPTIMAL if not self.artificial or x[-1] <= 0 else INFEASIBLE
        return x, NOT_CONVERGED


def optimise(c: np.ndarray, work: Work, safety: float, order: int, mu: float, tolerance: float, most: int) -> tuple[np.ndarray, str]:
    """Both phases: an inner point by an artificial variable that costs much, then the optimum from there."""
    n = len(c)

    def sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([[b @ b, np.square(a @ c).sum(), len(b)], (a.T @ a).ravel()])

    start = work(sizes, "sum")
    gram = start[3:].reshape(n, n)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    if not c.any() or np.linalg.matrix_rank(gram * np.outer(scale, scale), tol=1e-10, hermitian=True) < n:
        return np.zeros(n), UNBOUNDED
    x = c * np.sqrt(start[0] / start[1]) if start[1] > 0 else np.zeros(n)
    if not x.any():
        x = c / np.linalg.norm(c)
    lowest = float(work(lambda a, b: np.array([(b - a @ x).min(initial=np.inf)]), "min")[0])
    if lowest <= 0:
        away = -2 * lowest if lowest < 0 else 1.0
        cost = mu * max(abs(float(c @ x)), np.abs(c).max()) / away

        def bounded(part: Part, how: str) -> np.ndarray:
            """With one more constraint, that the artificial variable is not below -away: so two or more rows fix n + 1 variables."""
            parts = work(part, how), part(np.zeros((1, n)), np.array([away]))
            return sum(parts) if how == "sum" else np.minimum(*parts)

        x, status = Search(np.append(c, -cost), True, bounded, safety, order, tolerance, most).run(np.append(x, away))
        if status != OPTIMAL or x[-1] >= 0:
            return x[:-1], INFEASIBLE if status == OPTIMAL else status
        x = x[:-1]
    return Search(c, False, work, safety, order, tolerance, most).run(x)


def constraint_rows(coefficients: DataFrame, bounds: DataFrame, variables: DataFrame) -> DataFrame:
    """id, a (by the problem's variables in order), b of the constraints that can bind; coefficients that are missing are 0.

    Of constraints with equal left sides that of the least bound implies the others, so it alone stays: the feasible points are the same.
    """
    place = F.when(F.col("ConstraintID").isNotNull() & F.col("VariableID").isNotNull() & F.col("Value").isNotNull(), F.struct("VariableID", F.col("Value").cast("double").alias("Value")))
    body = coefficients.select("ProblemID", "ConstraintID", place.alias("place"), F.lit(None).cast("double").alias("b"))
    right = bounds.select("ProblemID", "ConstraintID", F.lit(None).cast(body.schema["place"].dataType).alias("place"), F.col("Value").cast("double").alias("b"))
    # one exchange brings a constraint's coefficients and its bound together
    met = body.unionByName(right).groupBy(F.col("ProblemID").alias("of"), "ConstraintID").agg(F.collect_list("place").alias("places"), F.min("b").alias("b"))
    placed = met.filter("b is not null").join(variables, same(F.col("of"), F.col("id")))
    value = lambda name: F.aggregate(F.filter("places", lambda p: p["VariableID"] == name), F.lit(0.0), lambda total, p: total + p["Value"])
    return placed.select("id", F.transform("names", value).alias("a"), "b").groupBy("id", "a").agg(F.min("b").alias("b"))


def over_rows(rows: DataFrame, problem: int | None) -> Work:
    """Works parts out where the rows of one problem lie: a few numbers from each task are combined."""
    mine = rows.filter(F.col("id").eqNullSafe(F.lit(problem))).select("a", "b")

    def work(part: Part, how: str) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    b = batch.column(1).to_numpy()
                    a = batch.column(0).flatten().to_numpy().reshape(len(b), -1)
                    new = part(a, b)
                    total = new if total is None else total + new if how == "sum" else np.minimum(total, new)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["place", "v"])

        found = mine.mapInArrow(partial, "place int, v double").groupBy("place").agg((F.sum if how == "sum" else F.min)("v").alias("v")).collect()
        return np.array([v for _, v in sorted(map(tuple, found))])

    return work


def power_series_optimization(
    objective: DataFrame,
    coefficients: DataFrame,
    bounds: DataFrame,
    safety_factor: float = 0.7,
    taylor_order: int = 3,
    mu_for_big_m: float = 1000.0,
    feasibility_tolerance: float = 1e-4,
    max_iterations: int = 777,
    gathered: int = GATHERED,
) -> DataFrame:
    """ProblemID, VariableID, Value, Status: the maximum of each problem under bounds from above; the row without a VariableID is its value.

    objective has ProblemID, VariableID, Value; coefficients ProblemID, ConstraintID, VariableID, Value; bounds
    ProblemID, ConstraintID, Value.  Variables are free.  Approximate: a search ends when a step
    changes the objective by less than the tolerance.  Values are NULL unless the status is 'Optimal'; 'NotUnique'
    problems are unbounded, have no objective or leave a variable open.  Coefficients of one place add up, a null
    coefficient is 0, a null bound is none, constraints without a coefficient read 0 <= b.  A null problem is one like
    any other; problems without constraints are 'NotUnique'; empty tables give an empty table.
    """
    if not 1e-6 <= safety_factor <= 0.999999:
        raise ValueError("the safety factor lies between 0 and 1")
    if taylor_order < 1 or mu_for_big_m < 1e-3 or not 1e-14 <= feasibility_tolerance <= 0.0999 or not 20 <= max_iterations <= 20_000_000:
        raise ValueError("the order is 1 or more, mu large, the tolerance between 0 and 0.1, iterations between 20 and 20 million")
    options = (safety_factor, taylor_order, mu_for_big_m, feasibility_tolerance, max_iterations)
    bounds = bounds.select("ProblemID", "ConstraintID", "Value").filter("Value is not null")
    coefficients = coefficients.select("ProblemID", "ConstraintID", "VariableID", "Value")
    goal = objective.select("ProblemID", "VariableID", "Value")
    named = goal.unionByName(coefficients.select("ProblemID", "VariableID", F.lit(0.0).alias("Value"))).filter("VariableID is not null")
    each = named.groupBy("ProblemID", "VariableID").agg(F.sum("Value").alias("c"))
    problems = each.groupBy(F.col("ProblemID").cast("int").alias("id")).agg(F.sort_array(F.collect_list(F.struct("VariableID", F.coalesce("c", F.lit(0.0)).alias("c")))).alias("goal"))
    problems = materialise(problems.select("id", F.transform("goal", lambda g: g["VariableID"]).alias("names"), F.transform("goal", lambda g: g["c"]).alias("c")))
    rows = materialise(constraint_rows(coefficients, bounds, problems.select("id", "names")))
    counts = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    schema = "ProblemID int, VariableID int, Value double, Status string"

    def answer(problem: int | None, names: list[int], c: np.ndarray, x: np.ndarray, status: str) -> list[tuple]:
        values = [*map(float, x), float(c @ x)] if status == OPTIMAL else [None] * (len(names) + 1)
        return [(problem, name, value, status) for name, value in zip([*map(int, names), None], values, strict=True)]

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        held = part[part["b"].notna()]
        names, c = part["names"].iloc[0], np.asarray(part["c"].iloc[0], dtype=float)
        a, b = np.array(held["a"].tolist(), dtype=float).reshape(len(held), len(c)), held["b"].to_numpy(float)
        x, status = optimise(c, lambda f, how: f(a, b), *options) if len(held) else (np.zeros(len(c)), UNBOUNDED)
        out = pd.DataFrame(answer(None, list(names), c, x, status), columns=["ProblemID", "VariableID", "Value", "Status"])
        return out.assign(ProblemID=pd.Series([key[0]] * len(out), dtype="Int32"), VariableID=out["VariableID"].astype("Int32"))

    sized = problems.join(counts.withColumnRenamed("id", "of"), same(F.col("id"), F.col("of")), "left")
    small = sized.filter(F.coalesce("n", F.lit(0)) <= gathered).select("id", "names", "c")
    body = rows.withColumnRenamed("id", "of")
    gathered_rows = small.join(body, same(small["id"], body["of"]), "left").select("id", "names", "c", "a", "b")
    out = gathered_rows.groupBy("id").applyInPandas(whole, schema)
    # each has more constraints than `gathered`, so there are few
    large = sized.filter(F.col("n") > gathered).select("id", "names", "c").toLocalIterator()
    found: list[tuple] = []
    for r in large:
        c = np.array(r["c"])
        x, status = optimise(c, over_rows(rows, r["id"]), *options)
        found += answer(r["id"], r["names"], c, x, status)
    return out.unionByName(rows.sparkSession.createDataFrame(found, schema)) if found else out

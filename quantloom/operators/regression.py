"""Regression and principal components.

Sums over rows are aggregates; only the small systems that they add up to go to numpy, one for
each list or matrix, so no group of rows is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.matrix import eigen, mirrored, moments, shapes, without_unsound
from quantloom.schemas import MATRIX, PAIRS, conform, same
from quantloom.storage import discard, materialise

MAX_STEPS = 100
LIKELIHOOD_STEP = 1e-6
LENGTH_STEP = 1e-5
START = 0.05
BUCKETS = 3


def simple_linear_regression(pairs: DataFrame) -> DataFrame:
    """Counts, Slope, Y_Intercept, R_Squared, MeanSquaredError and MeanAbsoluteError of each list.

    NULL where x does not vary, R_Squared also where y does not.  Sums are centred on the means of
    the list, which come from a first aggregate, so large values lose no digits.
    """
    p = conform(pairs, PAIRS)
    # Spark's moments are centred and merged pair by pair
    lines = p.groupBy(F.col("ListID").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("NumberOfInputPairs"),
        F.count_distinct("X_Value").cast("int").alias("Distinct_X_Values"),
        F.count_distinct("Y_Value").cast("int").alias("Distinct_Y_Values"),
        F.avg("X_Value").alias("mx"),
        F.avg("Y_Value").alias("my"),
        F.covar_pop("X_Value", "Y_Value").alias("sxy"),
        F.var_pop("X_Value").alias("sxx"),
        F.var_pop("Y_Value").alias("syy"),
    )
    slope = F.try_divide("sxy", "sxx")
    lines = lines.withColumn("Slope", slope).withColumn("Y_Intercept", F.col("my") - F.col("Slope") * F.col("mx"))
    lines = lines.withColumn("R_Squared", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    # a table of known size: few lines are broadcast, so that the pairs stay where they are; many are joined with splits
    lines = materialise(lines.drop("mx", "my", "sxy", "sxx", "syy"))
    fitted = p.join(lines, same(p["ListID"], lines["id"]))
    error = F.col("Y_Value") - (F.col("Slope") * F.col("X_Value") + F.col("Y_Intercept"))
    of_list = [c for c in lines.columns if c != "id"]
    errors = [F.avg(error * error).alias("MeanSquaredError"), F.avg(F.abs(error)).alias("MeanAbsoluteError")]
    return fitted.groupBy(F.col("id").alias("ListID")).agg(*(F.any_value(c).alias(c) for c in of_list), *errors)


def multiple_linear_regression(x: DataFrame, y: DataFrame, on_invalid: str = "batch") -> DataFrame:
    """MatrixID, ResultID, Value: coefficient of each column of x, and R squared (not centred) as ResultID 0.

    There is no implicit intercept.  y has one column and the rows of x.  Matrices whose columns
    depend on each other give no rows.
    """
    # y is column 0 of one matrix with x; a second column of it would be column -2
    of_y = conform(y, MATRIX).withColumn("ColumnNumber", F.when(F.col("ColumnNumber") == 1, 0).otherwise(-F.col("ColumnNumber")))
    of_x = conform(x, MATRIX).withColumn("ColumnNumber", F.when(F.col("ColumnNumber") > 0, F.col("ColumnNumber")))
    cells = moments(of_x.unionByName(of_y), on_invalid, first_column=0, least_columns=2)
    gram = cells.select("MatrixID", "c1", "c2", (F.col("s12") + F.col("n") * F.col("m1") * F.col("m2")).alias("v"))

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["c2"].max())
        s = np.zeros((n + 1, n + 1))
        s[part["c1"], part["c2"]] = part["v"]
        s[part["c2"], part["c1"]] = part["v"]
        g, t, yy = s[1:, 1:], s[1:, 0], s[0, 0]
        scale = np.sqrt(np.diag(g)) if n else np.empty(0)
        if n == 0 or (scale == 0).any():
            return pd.DataFrame({"MatrixID": [], "ResultID": [], "Value": []})
        scaled = g / np.outer(scale, scale)
        if np.linalg.cond(scaled) > 1e13:
            return pd.DataFrame({"MatrixID": [], "ResultID": [], "Value": []})
        beta = np.linalg.solve(scaled, t / scale) / scale
        values = [*beta, beta @ g @ beta / yy if yy else np.nan]
        out = pd.DataFrame({"ResultID": [*range(1, n + 1), 0], "Value": [None if np.isnan(v) else float(v) for v in values]})
        out.insert(0, "MatrixID", pd.Series([key[0]] * len(out), dtype="Int32"))
        return out

    return gram.groupBy("MatrixID").applyInPandas(solve, "MatrixID int, ResultID int, Value double")


def logistic_regression(x: DataFrame, y: DataFrame, normalize: bool = False, on_invalid: str = "batch", max_steps: int = MAX_STEPS) -> DataFrame:
    """MatrixID, Result 'Coefficient Vector', RowNumber, Value, Iterations, StopReason of each matrix.

    Newton steps from 0.05 for all coefficients until the log-likelihood rises by less than 1e-6 and
    the vector moves by less than 1e-5; no implicit intercept; y lies in [0, 1], else the matrix is
    unsound.  ``normalize`` divides columns by their largest value where that is positive.  Each step
    is one aggregate of gradients and Hessians over all matrices; only these go to numpy.
    """
    x, y = conform(x, MATRIX), conform(y, MATRIX)
    a, b = shapes(x), shapes(y).toDF("id", "rows", "columns", "fine")
    outside = y.filter("Value < 0 or Value > 1").select("MatrixID").distinct()
    both = a.join(b, same(a["MatrixID"], b["id"]), "full").filter("rows is null or n_rows is null or columns != 1 or n_rows != rows or not valid or not fine")
    bad = both.select(F.coalesce("MatrixID", "id").alias("MatrixID")).unionByName(outside)
    x = without_unsound(x, bad, on_invalid)
    if normalize:
        top = x.groupBy(F.col("MatrixID").alias("id"), F.col("ColumnNumber").alias("c")).agg(F.max("Value").alias("top"))
        top = materialise(top.withColumn("top", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)))
        x = x.join(top, same(x["MatrixID"], top["id"]) & (x["ColumnNumber"] == top["c"])).select("MatrixID", "RowNumber", "ColumnNumber", (F.col("Value") / F.col("top")).alias("Value"))
    wide = x.groupBy("MatrixID", "RowNumber").agg(F.sort_array(F.collect_list(F.struct("ColumnNumber", "Value"))).alias("c"))
    ys = y.select(F.col("MatrixID").alias("id"), F.col("RowNumber").alias("row"), F.col("Value").alias("y"))
    rows = wide.join(ys, same(wide["MatrixID"], ys["id"]) & (wide["RowNumber"] == ys["row"])).select("MatrixID", F.col("c.Value").alias("x"), "y")
    rows = materialise(rows)
    state_schema = "MatrixID int, theta array<double>, likelihood double, done boolean, steps int, reason string"
    first = rows.groupBy("MatrixID").agg(F.first(F.size("x")).alias("n"))
    state = materialise(first.select("MatrixID", F.array_repeat(F.lit(START), F.col("n")).alias("theta"), F.lit(None).cast("double").alias("likelihood"), F.lit(False).alias("done"), F.lit(0).alias("steps"), F.lit(None).cast("string").alias("reason")))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Log-likelihood, gradient and Hessian of the rows of a batch as one array of numbers for each matrix."""
        for batch in batches:
            for _, part in batch.groupby("MatrixID", dropna=False):
                xs, t = np.stack(part["x"].to_list()), np.asarray(part["theta"].iloc[0])
                z, target = xs @ t, part["y"].to_numpy()
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                likelihood = -(target * np.logaddexp(0, -z) + (1 - target) * np.logaddexp(0, z)).sum()
                hessian = (xs * (p * (1 - p))[:, None]).T @ xs
                sums = np.concatenate([[likelihood], xs.T @ (target - p), hessian.ravel()])
                yield pd.DataFrame({"MatrixID": pd.Series([part["MatrixID"].iloc[0]] * len(sums)).astype("Int32"), "k": np.arange(len(sums), dtype=np.int32), "v": sums})

    def step(key: tuple, sums: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        old = held.iloc[0]
        theta, n = np.asarray(old["theta"]), len(old["theta"])
        v = sums.sort_values("k")["v"].to_numpy()
        likelihood, gradient, hessian = v[0], v[1 : n + 1], v[n + 1 :].reshape(n, n)
        out = {"theta": theta, "likelihood": likelihood, "done": False, "steps": int(old["steps"]), "reason": None}
        try:
            if np.linalg.matrix_rank(hessian) < n:
                raise np.linalg.LinAlgError
            move = np.linalg.solve(hessian, gradient)
            rise = np.inf if pd.isna(old["likelihood"]) else likelihood - old["likelihood"]
            if 0 <= rise < LIKELIHOOD_STEP and np.linalg.norm(move) < LENGTH_STEP:
                out |= {"done": True, "reason": "Converged"}
            else:
                out |= {"theta": theta + move, "steps": out["steps"] + 1}
        except np.linalg.LinAlgError:
            out |= {"done": True, "reason": "FailedToSetNextGuess"}
        return pd.DataFrame([{"MatrixID": key[0], **out}])

    for _ in range(max_steps):
        open_ones = state.filter("not done")
        if open_ones.isEmpty():
            break
        now = open_ones.select(F.col("MatrixID").alias("id"), "theta")
        joined = rows.join(now, same(rows["MatrixID"], now["id"])).select("MatrixID", "x", "y", "theta")
        sums = joined.mapInPandas(partial, "MatrixID int, k int, v double").groupBy("MatrixID", "k").agg(F.sum("v").alias("v"))
        moved = sums.groupBy("MatrixID").cogroup(open_ones.groupBy("MatrixID")).applyInPandas(step, state_schema)
        later = materialise(moved.unionByName(state.filter("done")))
        discard(state)
        state = later
    reason = F.coalesce("reason", F.lit("MaximumIterations"))
    out = state.filter("not (reason <=> 'FailedToSetNextGuess')").select("MatrixID", F.posexplode("theta").alias("k", "Value"), "steps", reason.alias("StopReason"))
    out = out.select("MatrixID", F.lit("Coefficient Vector").alias("Result"), (F.col("k") + 1).alias("RowNumber"), "Value", F.col("steps").alias("Iterations"), "StopReason")
    if normalize:
        out = out.join(top, same(out["MatrixID"], top["id"]) & (out["RowNumber"] == top["c"])).withColumn("Value", F.col("Value") / F.col("top")).drop("id", "c", "top")
    return out


def principal_components(m: DataFrame, normalize: bool = True, on_invalid: str = "batch", compat: bool = False) -> DataFrame:
    """Rows tagged 'Incremental Variance' (row i: share of the i-th component) and 'Loading Vector' (row i: its direction).

    ``normalize`` takes columns as z-scores (population deviation; a column that does not vary becomes
    0).  ``compat`` maps the loadings of normalised columns by deviation and mean, as values.
    """
    cells = moments(conform(m, MATRIX), on_invalid).filter("n > 1")
    z = F.coalesce(F.try_divide("s12", F.sqrt("s11") * F.sqrt("s22")), F.lit(0.0)) * F.col("n")
    cov = mirrored(cells.withColumn("v", (z if normalize else F.col("s12")) / (F.col("n") - 1)), "v")
    names = ["MatrixID", "Result", "RowNumber", "ColumnNumber", "Value"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["RowNumber"].max())
        a = np.zeros((n, n))
        a[part["RowNumber"] - 1, part["ColumnNumber"] - 1] = part["Value"]
        values, vectors = eigen(a)
        total = values.sum()
        rows: Iterable[tuple] = [("Incremental Variance", i + 1, 1, float(v / total) if total else 0.0) for i, v in enumerate(values)]
        rows += [("Loading Vector", i + 1, j + 1, float(vectors[j, i])) for i in range(n) for j in range(n)]
        out = pd.DataFrame(rows, columns=names[1:])
        out.insert(0, "MatrixID", pd.Series([key[0]] * len(out), dtype="Int32"))
        return out

    found = cov.groupBy("MatrixID").applyInPandas(run, "MatrixID int, Result string, RowNumber int, ColumnNumber int, Value double")
    if not (normalize and compat):
        return found
    stats = cells.filter("c1 = c2").select(F.col("MatrixID").alias("id"), F.col("c1").alias("c"), F.col("m1").alias("mean"), F.sqrt(F.col("s11") / F.col("n")).alias("dev"))
    scaled = found.join(stats, same(found["MatrixID"], stats["id"]) & (found["ColumnNumber"] == stats["c"]) & (found["Result"] == "Loading Vector"), "left")
    return scaled.select(*names[:4], F.when(F.col("dev").isNotNull(), F.col("Value") * F.col("dev") + F.col("mean")).otherwise(F.col("Value")).alias("Value"))

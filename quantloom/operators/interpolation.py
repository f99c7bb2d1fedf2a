"""Interpolation of lists of points, and local regression.

Pairs with one x are averaged first, so what follows works on distinct knots.  Segments come from a
scan over the knots of a list; points find theirs in one scan over knots and points together (an
as-of join), never by comparing all pairs.  Scans run in ranges of lists, so one list may hold all rows.  Spline systems are solved in chunks of
bounded size: a knot's influence falls by half or more with each knot between, so a margin of 64
knots leaves nothing of a double's 53 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.scans import last_at_or_before, numbered, running_sums, with_next
from quantloom.schemas import PAIRS, POINTS, conform, same
from quantloom.sources.lookups import EXTRAPOLATION_METHODS, INTERPOLATION_METHODS, KERNELS
from quantloom.storage import materialise

CHUNK = 4096
MARGIN = 64
NATURAL, NOT_A_KNOT = "Natural", "Not-A-Knot"
SPLINES = {NATURAL: 3, NOT_A_KNOT: 4}
CUBIC = "ListID int, Min_X_Value double, Max_X_Value double, A_Coefficient double, B_Coefficient double, C_Coefficient double, D_Coefficient double"


def knots(pairs: DataFrame) -> DataFrame:
    """Distinct x of each list with the mean of y; pairs with a null are left out."""
    p = conform(pairs, PAIRS).dropna(subset=["X_Value", "Y_Value"])
    return p.groupBy("ListID", "X_Value").agg(F.avg("Y_Value").alias("Y_Value"))


def piecewise_linear(pairs: DataFrame) -> DataFrame:
    """ListID, Min_X_Value, Max_X_Value, Slope, Y_Intercept between neighbouring knots; lists of one knot have none."""
    k = with_next(knots(pairs), "X_Value", "Y_Value")
    slope = (F.col("y2") - F.col("Y_Value")) / (F.col("x2") - F.col("X_Value"))
    k = k.withColumn("Slope", slope)
    return k.select("ListID", F.col("X_Value").alias("Min_X_Value"), F.col("x2").alias("Max_X_Value"), "Slope", (F.col("Y_Value") - F.col("Slope") * F.col("X_Value")).alias("Y_Intercept"))


def curvatures(x: np.ndarray, y: np.ndarray, left_knot: bool, right_knot: bool) -> np.ndarray:
    """Second derivatives at the knots; an end is natural (0) or has the third derivative of its neighbour."""
    h, n = np.diff(x), len(x)
    d = 6 * np.diff(np.diff(y) / h)
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    if left_knot:
        mid[0] += h[0] * (1 + h[0] / h[1])
        high[0] -= h[0] * h[0] / h[1]
    if right_knot:
        mid[-1] += h[-1] * (1 + h[-1] / h[-2])
        low[-1] -= h[-1] * h[-1] / h[-2]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        d[i] -= f * d[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (d[i] - (high[i] * m[i + 2] if i < n - 3 else 0.0)) / mid[i]
    if left_knot:
        m[0] = m[1] + h[0] / h[1] * (m[1] - m[2])
    if right_knot:
        m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    return m


def cubic_spline(pairs: DataFrame, spline_type: str | None = NATURAL, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """ListID, Min_X_Value, Max_X_Value and A to D of A t^3 + B t^2 + C t + D with t = x - Min_X_Value.

    No type is 'Natural'; an unknown one gives no rows, as do lists of fewer than 3 knots (4 for
    'Not-A-Knot').
    """
    kind = next((k for k in SPLINES if k.lower() == (spline_type or NATURAL).lower()), None)
    least = SPLINES.get(kind, 0)
    k = numbered(knots(pairs if kind else pairs.limit(0)), "X_Value").filter(F.col("n") >= least)
    own, at = F.floor(F.col("r") / chunk), F.col("r") % chunk
    shared = F.array(own, F.when(at <= margin, own - 1), F.when(at >= chunk - margin, own + 1))
    parts = k.withColumn("chunk", F.explode(F.filter(shared, lambda c: c.isNotNull() & (c >= 0))))

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        r, x, y = (part[c].to_numpy() for c in ("r", "X_Value", "Y_Value"))
        not_knot = kind == NOT_A_KNOT
        keep = (r[:-1] // chunk == key[1]) if len(r) > 1 else np.empty(0, bool)
        if not keep.any():
            return pd.DataFrame({c.split()[0]: [] for c in CUBIC.split(", ")})
        m = curvatures(x, y, not_knot and r[0] == 0, not_knot and r[-1] == part["n"].iloc[0] - 1) if len(x) > 2 else np.zeros(len(x))
        h = np.diff(x)
        a, b = np.diff(m) / (6 * h), m[:-1] / 2
        c = np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6
        out = pd.DataFrame({"Min_X_Value": x[:-1], "Max_X_Value": x[1:], "A_Coefficient": a, "B_Coefficient": b, "C_Coefficient": c, "D_Coefficient": y[:-1]})[keep]
        out.insert(0, "ListID", pd.Series([key[0]] * len(out), dtype="Int32", index=out.index))
        return out

    return parts.groupBy("ListID", "chunk").applyInPandas(solve, CUBIC)


def polynomial_at(t: Column, a: str, b: str, c: str, d: str) -> Column:
    return ((F.col(a) * t + F.col(b)) * t + F.col(c)) * t + F.col(d)


def evaluated(points: DataFrame, segments: DataFrame, tangent: bool, flat: bool) -> DataFrame:
    """Values on cubic segments inside, and on the ends' levels or lines outside."""
    t = F.col("Max_X_Value") - F.col("Min_X_Value")
    cubic = ("A_Coefficient", "B_Coefficient", "C_Coefficient", "D_Coefficient")
    at_end = polynomial_at(t, *cubic)
    if tangent:  # slopes of the spline at its ends
        s0, s1 = F.col("C_Coefficient"), (3 * F.col("A_Coefficient") * t + 2 * F.col("B_Coefficient")) * t + F.col("C_Coefficient")
    else:  # of the lines through the first two and the last two knots
        s0 = s1 = (at_end - F.col("D_Coefficient")) / t
    first = F.min_by(F.struct(F.col("Min_X_Value").alias("x"), F.col("D_Coefficient").alias("y"), s0.alias("s")), F.col("Min_X_Value"))
    last = F.max_by(F.struct(F.col("Max_X_Value").alias("x"), at_end.alias("y"), s1.alias("s")), F.col("Min_X_Value"))
    ends = segments.groupBy("ListID").agg(F.struct(first.alias("first"), last.alias("last")).alias("whole"))
    begun = segments.select("ListID", F.col("Min_X_Value").alias("x"), F.struct("Min_X_Value", *cubic).alias("knot"))
    placed = last_at_or_before(conform(points, POINTS).filter("X_Value is not null"), begun, ends)
    x = F.col("X_Value")
    inside = polynomial_at(x - F.col("knot.Min_X_Value"), *(f"knot.{c}" for c in cubic))
    outside = lambda end: F.col(f"whole.{end}.y") + (F.lit(0.0) if flat else F.col(f"whole.{end}.s") * (x - F.col(f"whole.{end}.x")))
    y = F.when(x < F.col("whole.first.x"), outside("first")).when(x > F.col("whole.last.x"), outside("last")).otherwise(inside)
    return placed.select("ListID", "X_Value", y.alias("Interpolated_Y_Value"))


def interpolate(pairs: DataFrame, points: DataFrame, method: str, extrapolation: str | None = "F") -> DataFrame:
    """ListID, X_Value, Interpolated_Y_Value by 'PL', 'CSN' or 'CSNAK'; outside the knots 'F' (level) or 'L' (line).

    Lines continue those through the first two and last two knots.  No extrapolation is 'F'.  Lists
    with too few knots, and unknown methods, give no rows; points with a null x are left out.
    """
    codes = {m[0]: m[3] for m in INTERPOLATION_METHODS}
    method, extrapolation = (method or "").upper(), (extrapolation or "F").upper()
    if method not in codes or extrapolation not in {m[0] for m in EXTRAPOLATION_METHODS}:
        points, method = points.limit(0), "PL"
    if method == "PL":
        line = piecewise_linear(pairs)
        level = (F.col("Slope") * F.col("Min_X_Value") + F.col("Y_Intercept")).alias("D_Coefficient")
        segments = line.select("ListID", "Min_X_Value", "Max_X_Value", F.lit(0.0).alias("A_Coefficient"), F.lit(0.0).alias("B_Coefficient"), F.col("Slope").alias("C_Coefficient"), level)
    else:
        segments = cubic_spline(pairs, NATURAL if method == "CSN" else NOT_A_KNOT)
    return evaluated(points, materialise(segments), False, extrapolation == "F")


def interpolate_natural_spline(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The natural spline at points, continued outside the knots along its tangents."""
    return evaluated(points, materialise(cubic_spline(pairs, NATURAL)), True, False)


def kernel_polynomial(name: str, left: bool) -> np.ndarray:
    """Coefficients by rising power of a kernel on one side of 0; the cosine by its series, to 1e-12 on [-1, 1]."""
    one, u = np.polynomial.Polynomial([1.0]), np.polynomial.Polynomial([0.0, 1.0])
    away = -u if left else u  # |u|
    bodies = {
        "uniform": 0.5 * one,
        "triangular": one - away,
        "parabolic": 0.75 * (one - u**2),
        "quartic": 15 / 16 * (one - u**2) ** 2,
        "triweight": 35 / 32 * (one - u**2) ** 3,
        "tricube": 70 / 81 * (one - away**3) ** 3,
        "cosine": math.pi / 4 * sum(((-1) ** k / math.factorial(2 * k) * (math.pi / 2 * u) ** (2 * k) for k in range(1, 10)), one),
    }
    return bodies[name.lower()].coef


def moved_moments(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums of (t - by)^k, k = 0, 1, ..., from sums of t^k, a row each: by the binomial theorem."""
    out = np.zeros_like(moments)
    for k in range(moments.shape[1]):
        for j in range(k + 1):
            out[:, k] += math.comb(k, j) * (-by) ** (k - j) * moments[:, j]
    return out


def local_polynomial_regression(pairs: DataFrame, kernel_name: str, radius: float, order: int, compat: bool = False) -> DataFrame:
    """ListID, X_Value, Y_Value: at each x the value of the polynomial that fits its neighbours best.

    Neighbours lie nearer than the radius and weigh by the kernel, which is a polynomial on either side.  So
    all that is needed of them are sums of powers, and those are differences of running sums: within buckets
    of the radius's width, about the bucket's middle, up to x and to either end of its neighbourhood.  Costs grow
    with the rows, however dense they are.  A repeated x in a list, an unknown kernel, a radius that is not
    positive or a negative order gives no rows; points with too few neighbours to fix a polynomial have
    none.  ``compat`` sums all coefficients.
    """
    p = conform(pairs, PAIRS).dropna(subset=["X_Value", "Y_Value"])
    known = (kernel_name or "").lower() in {k[0].lower() for k in KERNELS}
    if not known or not radius or radius <= 0 or order is None or order < 0:
        p, radius, order, kernel_name = p.limit(0), 1.0, 1, KERNELS[0][0]
    twice = p.groupBy("ListID", "X_Value").count().filter("count > 1")
    p = p.filter(twice.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    left, right = kernel_polynomial(kernel_name, True), kernel_polynomial(kernel_name, False)
    n_x, n_y = len(left) + 2 * order, len(left) + order
    names = [f"m{k}" for k in range(n_x)] + [f"y{k}" for k in range(n_y)]
    bucket = F.floor(F.col("X_Value") / radius)
    in_bucket = p.select(F.struct("ListID", bucket.alias("b")).alias("ListID"), F.col("X_Value").alias("x"), F.col("Y_Value").alias("y"))
    t = F.col("x") / radius - F.col("ListID.b") - 0.5
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(t, F.lit(float(k)))
    terms = {f"m{k}": power(k) for k in range(n_x)} | {f"y{k}": power(k) * F.col("y") for k in range(n_y)}
    summed = running_sums(in_bucket.withColumns(terms).drop("y"), "x", names)
    totals = F.array(*(f"total_{c}" for c in names)).alias("total")
    sums = materialise(summed.select("ListID", "x", F.array(*names).alias("sum"), totals))
    # before its first point a bucket has sums of nothing
    nothing = sums.groupBy("ListID").agg(F.first("total").alias("total")).select("ListID", F.lit(-math.inf).alias("x"), F.array_repeat(F.lit(0.0), len(names)).alias("sum"), "total")
    knots_of = sums.unionByName(nothing).select("ListID", "x", F.struct("sum", "total").alias("knot"))
    beside = lambda side: F.struct(F.struct(F.col("ListID.ListID").alias("ListID"), (F.col("ListID.b") + side).alias("b")).alias("ListID"), (F.col("x") + side * radius).alias("X_Value"), F.lit(side).alias("side"))
    asked = sums.select("x", F.col("ListID").alias("own"), "sum", "total", F.explode(F.array(beside(-1), beside(1))).alias("q")).select("q.*", F.col("x").alias("x0"), F.when(F.col("q.side") < 0, F.struct("sum", "total")).alias("mine"))
    found = last_at_or_before(asked, knots_of, also=("x0", "side", "mine"), below="side > 0")
    # the neighbours before in the bucket before, in its own bucket up to x and beyond, and those in the bucket behind
    each = found.groupBy(F.col("ListID.ListID").alias("ListID"), "x0").agg(
        F.max(F.when(F.col("side") < 0, F.col("ListID.b") + 1)).alias("b"),
        F.first(F.when(F.col("side") < 0, F.col("mine")), ignorenulls=True).alias("mine"),
        F.first(F.when(F.col("side") < 0, F.col("knot")), ignorenulls=True).alias("before"),
        F.first(F.when(F.col("side") > 0, F.col("knot.sum")), ignorenulls=True).alias("behind"),
    )
    none = F.array_repeat(F.lit(0.0), len(names))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    parts = each.select(
        "ListID", "x0", (F.col("x0") / radius - F.col("b") - 0.5).alias("t"),
        F.coalesce(minus(F.col("before.total"), F.col("before.sum")), none).alias("p0"), F.col("mine.sum").alias("p1"), minus(F.col("mine.total"), F.col("mine.sum")).alias("p2"), F.coalesce("behind", none).alias("p3"),
    )

    @F.pandas_udf("array<double>")
    def solve(t: pd.Series, *sums: pd.Series) -> pd.Series:
        here = t.to_numpy()
        s, r, count = np.zeros((len(t), 2 * order + 1)), np.zeros((len(t), order + 1)), np.zeros(len(t))
        for part, shift, w in zip(sums, (1.0, 0.0, 0.0, -1.0), (left, left, right, right), strict=True):
            m = np.stack(part.to_list())
            count += m[:, 0]
            of_x, of_y = moved_moments(m[:, :n_x], here + shift), moved_moments(m[:, n_x:], here + shift)
            for k, c in enumerate(w):
                s += c * of_x[:, k : k + 2 * order + 1]
                r += c * of_y[:, k : k + order + 1]
        place = np.add.outer(np.arange(order + 1), np.arange(order + 1))
        a = s[:, place]
        # distinct x fix a polynomial if they are enough; rounding leaves no more than this of a matrix that they do not fix
        fixed = (count > order) & (np.linalg.matrix_rank(a, hermitian=True) == order + 1)
        out: list = [None] * len(a)
        for k, beta in zip(np.flatnonzero(fixed), np.linalg.solve(a[fixed], r[fixed][..., None])[..., 0], strict=True):
            out[k] = beta
        return pd.Series(out)

    fit = parts.select("ListID", "x0", solve("t", "p0", "p1", "p2", "p3").alias("beta")).filter("beta is not null")
    total = sum((F.get("beta", F.lit(k)) / radius**k for k in range(1, order + 1)), F.get("beta", F.lit(0)))
    return fit.select("ListID", F.col("x0").alias("X_Value"), (total if compat else F.get("beta", F.lit(0))).alias("Y_Value"))

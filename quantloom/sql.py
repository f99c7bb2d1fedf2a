"""The library from SQL: functions of a session, table functions over rows, and routines over views.

``register(spark)`` creates temporary functions.  Those of one row are SQL functions, which Catalyst
inlines: nothing of them is left in a plan but expressions.  ``LATERAL stock_option(...)`` prices each
row of a table.  Functions of a table take ``TABLE(t) PARTITION BY id ORDER BY ...`` and read the
rows of an id as a stream.  What works on whole tables by joins and aggregates is not a function but a
routine: ``call(spark, "covariance", "result", m="observations")`` reads views and makes the view `result`.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from quantloom.functions.scalar import ERF_COEFFICIENTS, NEWTON_STEPS
from quantloom.operators import blocked, interpolation, krylov, low_rank, matrix, optimization, polynomial, regression, tall_qr, yields
from quantloom.sources import calendar, catalogue

PRICE_COLUMNS = "OptionFairValue DOUBLE, Delta DOUBLE, Gamma DOUBLE, Vega DOUBLE, Theta DOUBLE, Rho DOUBLE"
DISCOUNTED = f"{PRICE_COLUMNS}, DiscountFactor_RiskFreeRate DOUBLE"
ERF_TAIL = f"aggregate(array({', '.join(f'{c}D' for c in reversed(ERF_COEFFICIENTS))}), 0.0D, (total, c) -> total * t + c)"

#: Of a Black price: sign s, forward f, strike k, volatility v, rate r, years t (null unless positive), discount df, scale.
BLACK_STEPS = """
  SELECT scale * price AS OptionFairValue, s * df * n1 AS Delta, try_divide(df * pdf, f * v * sqrt(t)) AS Gamma, df * f * sqrt(t) * pdf AS Vega,
    -f * v * df * pdf / (2 * sqrt(t)) + r * price AS Theta, -t * price AS Rho{more}
  FROM (SELECT *, s * (f * n1 - k * n2) * df AS price
  FROM (SELECT *, normal_cdf(s * d1) AS n1, normal_cdf(s * (d1 - root)) AS n2, normal_density(d1) AS pdf
  FROM (SELECT *, (ln(try_divide(f, k)) + v * v / 2 * t) / root AS d1
  FROM (SELECT *, nullif(v, 0) * sqrt(t) AS root FROM ({inputs})))))"""
#: The normal volatility of a lognormal one x, whatever the name of x; a lambda can call no SQL function.
NORMAL_VOLATILITY = """
  CASE WHEN abs((f - k) / k) < 0.001D THEN {x} * sqrt(f * k) * (1 + l * l / 24) / (1 + {x} * {x} * t / 24 + pow({x} * {x} * t, 2) / 5760)
    ELSE {x} * try_divide(f - k, l) / (1 + (1 - l * l / 120) * {x} * {x} * t / 24 + pow({x} * {x} * t, 2) / 5760) END"""
RATE_INPUTS = """
  SELECT *, CASE WHEN t IS NOT NULL THEN all_df END AS df
  FROM (SELECT *, CASE WHEN starts > 0 AND ends > 0 THEN starts END AS t, exp(-r * ends) AS all_df, notional * (ends - starts) AS scale
  FROM (SELECT option_sign(call_or_put) AS s, forward AS f, strike AS k, volatility AS v, rate AS r, notional,
    datediff(start_date, valuation) / 365.0D AS starts, (datediff(end_date, valuation) + 1) / 365.0D AS ends))"""
RATE_ARGUMENTS = "call_or_put STRING, notional DOUBLE, start_date DATE, end_date DATE, valuation DATE, forward DOUBLE, strike DOUBLE, volatility DOUBLE, rate DOUBLE"

#: name and arguments, result, body; later ones use earlier ones.
FUNCTIONS = (
    ("gaussian_error(x DOUBLE)", "DOUBLE", f"""
      SELECT CASE WHEN x = 0 THEN 0.0D ELSE signum(x) * (1 - t * exp(-x * x + {ERF_TAIL})) END FROM (SELECT 1 / (1 + 0.5D * abs(x)) AS t)"""),
    ("normal_cdf(bound DOUBLE, mean DOUBLE DEFAULT 0.0D, deviation DOUBLE DEFAULT 1.0D)", "DOUBLE", "0.5D * (1 + gaussian_error(try_divide(bound - mean, deviation * sqrt(2.0D))))"),
    ("normal_density(d DOUBLE)", "DOUBLE", "exp(-d * d / 2) / sqrt(2 * pi())"),
    ("standard_logistic(x DOUBLE)", "DOUBLE", "1 / (1 + exp(-x))"),
    ("kernel_function(u DOUBLE, name STRING)", "DOUBLE", """
      CASE WHEN u IS NULL OR lower(name) NOT IN ('uniform', 'triangular', 'parabolic', 'quartic', 'triweight', 'tricube', 'cosine') THEN NULL
        WHEN lower(name) = 'uniform' AND abs(u) <= 1 THEN 0.5D WHEN name IS NOT NULL AND abs(u) >= 1 THEN 0.0D
        ELSE CASE lower(name) WHEN 'triangular' THEN 1 - abs(u) WHEN 'parabolic' THEN 0.75D * (1 - u * u) WHEN 'quartic' THEN 15 / 16.0D * pow(1 - u * u, 2)
          WHEN 'triweight' THEN 35 / 32.0D * pow(1 - u * u, 3) WHEN 'tricube' THEN 70 / 81.0D * pow(1 - abs(u * u * u), 3) WHEN 'cosine' THEN pi() / 4 * cos(pi() / 2 * u) END END"""),
    ("debug_info(message STRING, nest_level INT DEFAULT 2, at TIMESTAMP DEFAULT current_timestamp())", "STRING",
     "concat(date_format(at, 'yyyy-MM-dd HH:mm:ss'), ' :: ', repeat('    ', least(greatest(nest_level - 2, 0), 10)), coalesce(message, ''))"),
    ("easter_sunday(y INT)", "DATE", """
      SELECT date_add(make_date(y, 3, 1), CAST(27 + i - (y + y div 4 + i + 2 - c + c div 4) % 7 AS INT))
      FROM (SELECT c, h - h div 28 * (1 - h div 28 * (29 div (h + 1)) * ((21 - g) div 11)) AS i
      FROM (SELECT g, c, (c - c div 4 - (8 * c + 13) div 25 + 19 * g + 15) % 30 AS h FROM (SELECT y % 19 AS g, y div 100 AS c)))"""),
    ("lognormal_to_normal_volatility(v DOUBLE, f DOUBLE, k DOUBLE, t DOUBLE)", "DOUBLE",
     f"SELECT CASE WHEN v >= 0 AND f > 0 AND k > 0 AND t > 0 THEN {NORMAL_VOLATILITY.format(x='v')} END FROM (SELECT ln(try_divide(f, k)) AS l)"),
    ("normal_to_lognormal_volatility(v DOUBLE, f DOUBLE, k DOUBLE, t DOUBLE)", "DOUBLE", f"""
      SELECT CASE WHEN v >= 0 AND f > 0 AND k > 0 AND t > 0 THEN coalesce(
        aggregate(sequence(1, {NEWTON_STEPS}), named_struct('v', v, 'c', c, 'a', a, 'b', t * t / 5760, 'x', try_divide(v, c), 'last', CAST(NULL AS DOUBLE)),
          (s, i) -> named_struct('v', s.v, 'c', s.c, 'a', s.a, 'b', s.b,
            'x', CASE WHEN 2 * s.v * s.x * (s.a + 2 * s.b * s.x * s.x) < s.c THEN
              s.x - try_divide(s.v * (1 + s.x * s.x * (s.a + s.b * s.x * s.x)) - s.c * s.x, 2 * s.v * s.x * (s.a + 2 * s.b * s.x * s.x) - s.c) END, 'last', s.x),
          s -> CASE WHEN s.a >= 0 AND s.x <= 64 AND abs(s.x - s.last) <= 1e-14D * s.x THEN s.x END),
        CASE WHEN high IS NOT NULL THEN
        aggregate(sequence(1, 60), named_struct('lo', 0.0D, 'hi', high, 'mid', high / 2),
          (s, i) -> named_struct('lo', CASE WHEN {NORMAL_VOLATILITY.format(x="s.mid")} < v THEN s.mid ELSE s.lo END, 'hi', CASE WHEN {NORMAL_VOLATILITY.format(x="s.mid")} < v THEN s.hi ELSE s.mid END,
            'mid', CASE WHEN {NORMAL_VOLATILITY.format(x="s.mid")} < v THEN (s.mid + s.hi) / 2 ELSE (s.lo + s.mid) / 2 END), s -> s.mid) END) END
      FROM (SELECT *, get(filter(transform(sequence(-10, 6), e -> pow(2.0D, e)), x -> {NORMAL_VOLATILITY.format(x="x")} >= v), 0) AS high,
        CASE WHEN abs((f - k) / k) < 0.001D THEN sqrt(f * k) * (1 + l * l / 24) ELSE try_divide(f - k, l) END AS c,
        CASE WHEN abs((f - k) / k) < 0.001D THEN t / 24 ELSE (1 - l * l / 120) * t / 24 END AS a FROM (SELECT ln(try_divide(f, k)) AS l))"""),
    ("option_sign(kind STRING)", "DOUBLE", "CASE WHEN lower(kind) IN ('call', 'c') THEN 1.0D WHEN lower(kind) IN ('put', 'p') THEN -1.0D END"),
    ("polynomial_value(x DOUBLE, coefficients ARRAY<DOUBLE>, exponents ARRAY<DOUBLE>)", "DOUBLE", """
      CASE WHEN exists(exponents, e -> (x = 0 AND e < 0) OR (x < 0 AND e <> floor(e))) THEN NULL
        ELSE aggregate(zip_with(coefficients, exponents, (c, e) -> CASE WHEN c = 0 THEN 0.0D WHEN e = 0 THEN c ELSE c * pow(x, e) END), 0.0D, (a, b) -> a + b) END"""),
    ("stock_option(call_or_put STRING, years DOUBLE, price DOUBLE, strike DOUBLE, volatility DOUBLE, rate DOUBLE, dividend_yield DOUBLE DEFAULT 0.0D)", f"TABLE({DISCOUNTED})", """
      SELECT s * (f * dm * n1 - k * df * n2), s * dm * n1, dm * pdf / (f * sd), dm * f * sqrt(t) * pdf,
        -dm * f * v * pdf / (2 * sqrt(t)) + s * (q * f * dm * n1 - r * k * df * n2), s * k * t * df * n2, all_df
      FROM (SELECT *, normal_cdf(s * d1) AS n1, normal_cdf(s * (d1 - sd)) AS n2, normal_density(d1) AS pdf
      FROM (SELECT *, (ln(try_divide(f, k)) + (r - q + v * v / 2) * t) / sd AS d1
      FROM (SELECT *, exp(-q * t) AS dm, v * sqrt(t) AS sd, CASE WHEN t IS NOT NULL THEN all_df END AS df
      FROM (SELECT option_sign(call_or_put) AS s, price AS f, strike AS k, volatility AS v, rate AS r, exp(-rate * years) AS all_df,
        CASE WHEN years > 0 AND price > 0 AND strike > 0 AND volatility > 0 THEN years END AS t, CASE WHEN coalesce(dividend_yield, 0) >= 0 THEN coalesce(dividend_yield, 0) END AS q))))"""),
    ("bond_option(call_or_put STRING, notional DOUBLE, valuation DATE, expiration DATE, settlement DATE, forward DOUBLE, strike DOUBLE, volatility DOUBLE, rate DOUBLE)", f"TABLE({PRICE_COLUMNS})",
     BLACK_STEPS.format(more="", inputs="""
      SELECT option_sign(call_or_put) AS s, forward AS f, strike AS k, volatility AS v, rate AS r, notional / 100 AS scale, CASE WHEN expires > 0 THEN expires END AS t,
        exp(-rate * CASE WHEN settled >= expires THEN settled ELSE expires END) AS df
      FROM (SELECT datediff(expiration, valuation) / 365.0D AS expires, datediff(settlement, valuation) / 365.0D AS settled)""")),
    (f"rate_option_lognormal({RATE_ARGUMENTS})", f"TABLE({DISCOUNTED})", BLACK_STEPS.format(more=", all_df", inputs=RATE_INPUTS)),
    (f"rate_option_normal({RATE_ARGUMENTS})", f"TABLE({DISCOUNTED})", f"""
      SELECT scale * price, s * df * n1, try_divide(df * pdf, v * sqrt(t)), df * sqrt(t) * pdf, r * price - df * v * pdf / (2 * sqrt(t)), -t * price, all_df
      FROM (SELECT *, df * (s * (f - k) * n1 + v * sqrt(t) * pdf) AS price
      FROM (SELECT *, normal_cdf(s * d1) AS n1, normal_density(d1) AS pdf FROM (SELECT *, (f - k) / (nullif(v, 0) * sqrt(t)) AS d1 FROM ({RATE_INPUTS}))))"""),
    ("calendar_days(first_day DATE, last_day DATE)", "TABLE(CalendarDate DATE, YearNumber INT, MonthNumber SMALLINT, DayNumber INT, DayInYear INT, DaysAfterSunday SMALLINT)", """
      SELECT d, year(d), CAST(month(d) AS SMALLINT), dayofmonth(d), dayofyear(d), CAST(dayofweek(d) - 1 AS SMALLINT)
      FROM explode(CASE WHEN first_day <= last_day THEN sequence(first_day, last_day) END) AS day(d)"""),
)


class PiecewiseLinear:
    """Segments of one list: pairs in order of x come by one at a time, and only the last knot is held.

    Takes (ListID, X_Value, Y_Value) PARTITION BY ListID ORDER BY X_Value; pairs with one x count as their mean.
    """

    def __init__(self) -> None:
        self.list, self.before, self.x, self.total, self.n = None, None, None, 0.0, 0

    def segment(self) -> Iterator[tuple]:
        if self.n:
            x, y = self.x, self.total / self.n
            if self.before:
                x1, y1 = self.before
                slope = (y - y1) / (x - x1)
                yield self.list, x1, x, slope, y1 - slope * x1
            self.before = x, y

    def eval(self, row: Any) -> Iterator[tuple]:
        self.list, x, y = row[0], row[1], row[2]
        if x is None or y is None:
            return
        if x != self.x:
            yield from self.segment()
            self.x, self.total, self.n = x, 0.0, 0
        self.total, self.n = self.total + y, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self.segment()


def best_fit(key: int | None, n: int, means: np.ndarray, centred: np.ndarray) -> tuple:
    """id, rows, intercept and slopes from the means and covariances of y, x1, x2, ...; null unless they are unique."""
    spread = np.sqrt(np.diag(centred)[1:].clip(0))
    if (spread == 0).any() or np.linalg.matrix_rank(centred[1:, 1:] / np.outer(spread, spread), tol=1e-10, hermitian=True) < len(spread):
        return key, n, None, None
    slopes = np.linalg.solve(centred[1:, 1:], centred[1:, 0])
    return key, n, float(means[0] - slopes @ means[1:]), slopes.tolist()


class LeastSquares:
    """Line, or plane, of best fit through rows (id, y, x1, x2, ...): the sums of products are all that is held.

    Takes them PARTITION BY the id.  Sums are about the first row's values, so large values lose no digits.  Rows with a
    null are left out.  Gives id, the number of rows, the intercept and the slopes; null unless they are unique.  An id is one task's:
    for ids of many rows, take least_squares_of_moments.
    """

    def __init__(self) -> None:
        self.key, self.origin, self.gram = None, None, None

    def eval(self, row: Any) -> None:
        key, *values = row
        self.key = key
        if any(v is None for v in values):
            return
        v = np.array(values, dtype=float)
        if self.origin is None:
            self.origin, self.gram = v, np.zeros((len(v) + 1, len(v) + 1))
        v = np.concatenate([[1.0], v - self.origin])
        self.gram += np.outer(v, v)

    def terminate(self) -> Iterator[tuple]:
        if self.gram is None:
            yield self.key, 0, None, None
            return
        n = self.gram[0, 0]
        mean = self.gram[0, 1:] / n
        yield best_fit(self.key, int(n), self.origin + mean, self.gram[1:, 1:] / n - np.outer(mean, mean))


class LeastSquaresOfMoments:
    """The same of rows (id, n, means, covariances, as moments() gives them), one for each id: those of an id of any size add up in all tasks."""

    def eval(self, row: Any) -> Iterator[tuple]:
        key, n, means, covariances = row[0], row[1], row[2], row[3]
        if not n:
            yield key, 0, None, None
            return
        centred = np.empty((len(means), len(means)))
        above = np.triu_indices(len(means))
        centred[above] = centred.T[above] = covariances
        yield best_fit(key, n, np.array(means), centred)


def moments(*values: str) -> str:
    """SQL aggregates n, means and covariances (upper triangle by rows) of expressions y, x1, x2, ...; rows with a null are left out."""
    whole = f"FILTER (WHERE {' AND '.join(f'({v}) IS NOT NULL' for v in values)})"
    pairs = ((a, b) for i, a in enumerate(values) for b in values[i:])
    return f"""count(*) {whole} AS n, array({', '.join(f'avg(CAST({v} AS DOUBLE)) {whole}' for v in values)}) AS means,
      array({', '.join(f'covar_pop({a}, {b}) {whole}' for a, b in pairs)}) AS covariances"""


class OneMatrix:
    """A matrix from its elements (MatrixID, RowNumber, ColumnNumber, Value) PARTITION BY MatrixID; unsound ones give no rows."""

    def __init__(self) -> None:
        self.id, self.cells, self.count = None, {}, 0

    def eval(self, row: Any) -> None:
        self.id = row[0]
        self.cells[row[1], row[2]] = row[3]
        self.count += 1

    def matrix(self) -> np.ndarray | None:
        places = list(self.cells)
        if not places or any(x is None for p in places for x in p) or any(v is None for v in self.cells.values()):
            return None
        n, m = (max(p[k] for p in places) for k in (0, 1))
        if min(x for p in places for x in p) < 1 or self.count != len(places) or self.count != n * m:
            return None
        a = np.empty((n, m))
        for (i, j), v in self.cells.items():
            a[i - 1, j - 1] = v
        return a

    def results(self, a: np.ndarray) -> Iterable[tuple]:
        raise NotImplementedError

    def terminate(self) -> Iterator[tuple]:
        a = self.matrix()
        for row in () if a is None else self.results(a):
            yield self.id, *row


class Determinant(OneMatrix):
    def results(self, a: np.ndarray) -> Iterable[tuple]:
        return [(matrix.rounded_determinant(a),)] if a.shape[0] == a.shape[1] else []


class Inverse(OneMatrix):
    def results(self, a: np.ndarray) -> Iterable[tuple]:
        return matrix.elements(np.linalg.inv(a)) if a.shape[0] == a.shape[1] and matrix.rounded_determinant(a) else []


class RowEchelon(OneMatrix):
    def results(self, a: np.ndarray) -> Iterable[tuple]:
        return matrix.elements(matrix.echelon(a))


class LinearSystem(OneMatrix):
    def results(self, a: np.ndarray) -> Iterable[tuple]:
        x = matrix.unique_solution(a)
        return [] if x is None else [(j + 1, float(v)) for j, v in enumerate(x)]


TABLE_FUNCTIONS = {
    "piecewise_linear": (PiecewiseLinear, "ListID int, Min_X_Value double, Max_X_Value double, Slope double, Y_Intercept double"),
    "least_squares": (LeastSquares, "ListID int, NumberOfRows bigint, Intercept double, Slopes array<double>"),
    "least_squares_of_moments": (LeastSquaresOfMoments, "ListID int, NumberOfRows bigint, Intercept double, Slopes array<double>"),
    "matrix_determinant": (Determinant, "MatrixID int, Determinant double"),
    "matrix_inverse": (Inverse, matrix.ELEMENT),
    "matrix_row_echelon": (RowEchelon, matrix.ELEMENT),
    "linear_system": (LinearSystem, "MatrixID int, ColumnNumber int, Value double"),
}

#: Routines over whole tables: their parameters that are tables take names of views.
ROUTINES = {
    f.__name__: f
    for f in (
        matrix.integrity_check, matrix.product, matrix.transpose, matrix.qr_factorization, matrix.determinant, matrix.adjugate, matrix.inverse, matrix.row_echelon,
        matrix.eigendecomposition, matrix.covariance, matrix.correlation, matrix.linear_system, matrix.minkowski,
        regression.simple_linear_regression, regression.multiple_linear_regression, regression.logistic_regression, regression.principal_components,
        interpolation.piecewise_linear, interpolation.cubic_spline, interpolation.interpolate, interpolation.interpolate_natural_spline, interpolation.local_polynomial_regression,
        polynomial.derivative, polynomial.evaluate, optimization.linear_optimization, optimization.linear_optimization_at_most,
        yields.yield_to_maturity, yields.yield_to_maturity_small_batches, calendar.calendar_discrepancies, calendar.extend_calendar, catalogue.upsert_databases,
        krylov.largest_eigenpairs, tall_qr.tall_qr,
    )
} | {f"blocked_{f.__name__}": f for f in (blocked.row_echelon, blocked.determinant, blocked.linear_system, blocked.inverse)} | {f"low_rank_{f.__name__}": f for f in (low_rank.linear_system, low_rank.determinant)}


def register(spark: SparkSession) -> None:
    """Create the temporary functions of this session; again is no error."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body if result.startswith('TABLE') or not body.lstrip().startswith('SELECT') else f'({body})'}")
    for name, (kind, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=schema))


def call(spark: SparkSession, routine: str, into: str | None = None, /, **arguments: Any) -> DataFrame:
    """Run a routine by name, its tables being names of views (or DataFrames); `into` names a view made of the result.

    An unknown routine or argument is an error, as is a view that is not there.
    """
    if routine not in ROUTINES:
        raise ValueError(f"no routine {routine}; there are {', '.join(sorted(ROUTINES))}")
    parameters = inspect.signature(ROUTINES[routine]).parameters
    tables = {n for n, p in parameters.items() if "DataFrame" in str(p.annotation)}
    given = {n: spark.table(v) if n in tables and isinstance(v, str) else v for n, v in arguments.items()}
    out = ROUTINES[routine](**given)
    if into:
        out.createOrReplaceTempView(into)
    return out

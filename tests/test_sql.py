"""The SQL functions against the column functions, the table functions against the routines, and calls on views."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quantloom import sql
from quantloom.functions import options, scalar
from quantloom.operators import interpolation, matrix


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    sql.register(spark)  # again is no error
    return spark


def same(left, right):
    a, b = left.collect(), right.collect()
    assert len(a) == len(b)
    for p, q in zip(a, b, strict=True):
        for x, y in zip(p, q, strict=True):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12), (p, q)


def test_scalar_functions(session):
    d = session.range(-8, 9).select((F.col("id") / 4).alias("x"), (F.col("id") + 2000).cast("int").alias("y"))
    d.createOrReplaceTempView("d")
    x = F.col("x")
    same(
        session.sql("SELECT gaussian_error(x), normal_cdf(x), normal_cdf(x, 1, 0), normal_cdf(x, 0.5D, 2), standard_logistic(x), easter_sunday(y) FROM d"),
        d.select(scalar.gaussian_error(x), scalar.normal_cdf(x), scalar.normal_cdf(x, 1, 0), scalar.normal_cdf(x, 0.5, 2), scalar.logistic(x), scalar.easter_sunday(F.col("y"))),
    )
    for name in ("Uniform", "triangular", "parabolic", "quartic", "triweight", "tricube", "cosine", "odd", None):
        same(session.sql(f"SELECT kernel_function(x, {'NULL' if name is None else repr(name)}) FROM d"), d.select(scalar.kernel(x, F.lit(name))))
    said = session.sql("SELECT debug_info('x', 4, TIMESTAMP'2020-01-02 03:04:05') AS a, debug_info(NULL, 99) AS b").first()
    assert said["a"] == "2020-01-02 03:04:05 ::         x" and said["b"].endswith(" :: " + " " * 40)


def test_volatilities_and_polynomials(session):
    v = session.sql("SELECT * FROM VALUES (0.75D,0.009D,0.0087D,0.249D),(0.2D,1D,1D,1D),(0D,1D,2D,1D),(-1D,1D,1D,1D),(0.3D,0D,1D,1D),(0.3D,2D,1D,NULL),(0.006598D,0.009D,0.0087D,0.249D) t(v,f,k,t)")
    v.createOrReplaceTempView("v")
    c = [F.col(n) for n in "vfkt"]
    same(
        session.sql("SELECT lognormal_to_normal_volatility(v, f, k, t), normal_to_lognormal_volatility(v, f, k, t) FROM v"),
        v.select(scalar.lognormal_to_normal_volatility(*c), scalar.normal_to_lognormal_volatility(*c)),
    )
    assert tuple(session.sql("SELECT polynomial_value(2, array(1D,2D,3D), array(0D,1D,2D)), polynomial_value(0, array(1D), array(-1D)), polynomial_value(-1, array(1D), array(0.5D))").first()) == (17.0, None, None)


def test_options_price_each_row_in_one_projection(session):
    o = session.sql(
        """SELECT *, DATE'2020-01-01' AS valued, date_add(DATE'2020-01-01', int(n)) AS first, date_add(DATE'2020-01-01', int(n) + 20) AS last
        FROM VALUES ('Call',1D,55.5D,60D,0.15D,0.005D,0.01D,100),('p',2D,55.5D,60D,0.2D,0.005D,NULL,300),('x',1D,1D,1D,1D,0.1D,0D,3),('C',-1D,1D,1D,1D,0.1D,0D,-40),('PUT',1D,1D,1D,0D,0.1D,0D,50),('C',1D,1D,1D,0.4D,0.1D,-2D,70),
        (NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL) t(kind,t,s,k,v,r,q,n)"""
    )
    o.createOrReplaceTempView("o")
    found = [*options.GREEKS, "DiscountFactor_RiskFreeRate"]
    stock = session.sql("SELECT p.* FROM o, LATERAL stock_option(kind, t, s, k, v, r, q) p")
    same(stock, options.stock_option_price(o, "kind", "t", "s", "k", "v", "r", "q").select(*found))
    assert "Join" not in stock._jdf.queryExecution().optimizedPlan().toString()
    same(session.sql("SELECT p.* FROM o, LATERAL bond_option(kind, 1000, valued, first, last, s, k, v, r) p"), options.bond_option_price(o, "kind", 1000.0, "valued", "first", "last", "s", "k", "v", "r").select(*options.GREEKS))
    for kind, f in (("lognormal", options.rate_option_price_lognormal), ("normal", options.rate_option_price_normal)):
        same(session.sql(f"SELECT p.* FROM o, LATERAL rate_option_{kind}(kind, 1000, first, last, valued, s, k, v, r) p"), f(o, "kind", 1000.0, "first", "last", "valued", "s", "k", "v", "r").select(*found))


def test_calendar_days(session):
    days = session.sql("SELECT * FROM calendar_days(DATE'2016-12-30', DATE'2017-01-02')").collect()
    assert [(r["DayInYear"], r["DaysAfterSunday"]) for r in days] == [(365, 5), (366, 6), (1, 0), (2, 1)]
    assert session.sql("SELECT * FROM calendar_days(DATE'2017-12-30', DATE'2017-01-02')").count() == 0
    assert session.sql("SELECT * FROM calendar_days(NULL, DATE'2017-01-02')").count() == 0


PAIRS = [(1, 3.0, 12.0), (1, 1.0, 5.0), (1, 2.0, 7.0), (1, 3.0, 14.0), (None, 1.0, 1.0), (None, 2.0, None), (None, 4.0, 3.0), (None, None, 3.0), (2, 1.0, 1.0)]


def test_piecewise_linear_streams_what_the_routine_gives(session):
    pairs = session.createDataFrame(PAIRS, "ListID int, X_Value double, Y_Value double")
    pairs.createOrReplaceTempView("pairs")
    key = lambda r: (r["ListID"] is None, r["ListID"], r["Min_X_Value"])
    got = sorted(session.sql("SELECT * FROM piecewise_linear(TABLE(pairs) PARTITION BY ListID ORDER BY X_Value)").collect(), key=key)
    want = sorted(interpolation.piecewise_linear(pairs).collect(), key=key)
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) if r["ListID"] else tuple(r) for r in want]


def test_least_squares_holds_digits_and_finds_dependence(session):
    rows = "SELECT int(id % 3) AS l, 3D + 2 * (1e9D + id) AS y, 1e9D + id AS x, CASE WHEN id % 3 = 1 THEN 2D * id ELSE double(id * id) END AS z FROM range(30)"
    got = {r["ListID"]: r for r in session.sql(f"SELECT * FROM least_squares(TABLE({rows}) PARTITION BY l)").collect()}
    assert got[0]["NumberOfRows"] == 10 and got[0]["Slopes"] == pytest.approx([2.0, 0.0], abs=1e-6)
    assert got[1]["Slopes"] is None and got[1]["Intercept"] is None  # z is a line in x
    assert session.sql("SELECT * FROM least_squares(TABLE(SELECT 1 AS l, CAST(NULL AS DOUBLE) AS y, 1D AS x) PARTITION BY l)").first()["NumberOfRows"] == 0


def test_matrices_by_table_functions(session):
    rows = [(1, 1, 1, 5.0), (1, 1, 2, 3.0), (1, 2, 1, 2.0), (1, 2, 2, 7.0), (None, 1, 1, 4.0), (2, 1, 1, 1.0), (2, 1, 1, 1.0), (3, 1, 2, 1.0), (4, 1, 1, None)]
    session.createDataFrame(rows, matrix.ELEMENT).createOrReplaceTempView("m")
    run = lambda f: {tuple(r) for r in session.sql(f"SELECT * FROM {f}(TABLE(m) PARTITION BY MatrixID)").collect()}
    assert run("matrix_determinant") == {(1, 29.0), (None, 4.0)}
    assert {k: round(v, 9) for *k, v in run("matrix_inverse") for k in [tuple(k)]} == {(1, 1, 1): 0.24137931, (1, 1, 2): -0.103448276, (1, 2, 1): -0.068965517, (1, 2, 2): 0.172413793, (None, 1, 1): 0.25}
    assert run("matrix_row_echelon") >= {(1, 1, 1, 5.0), (1, 2, 1, 0.0), (1, 2, 2, 5.8)}
    assert run("linear_system") == set()  # two rows that disagree, and one without an unknown


def test_call_reads_views_and_names_its_result(session):
    rows = [(7, i, j, float((i == j) * 1)) for i in (1, 2, 3) for j in (1, 2, 3)]
    session.createDataFrame(rows, matrix.ELEMENT).createOrReplaceTempView("unit")
    sql.call(session, "covariance", "spread", m="unit")
    assert {round(r[0], 9) for r in session.sql("SELECT Value FROM spread WHERE RowNumber = ColumnNumber").collect()} == {round(1 / 3, 9)}
    assert sql.call(session, "product", left="unit", right="unit").count() == 9
    with pytest.raises(ValueError):
        sql.call(session, "no_such_routine")


def test_blocked_routines_by_name(spark):
    spark.createDataFrame([(1, 1, 1, 0.0), (1, 1, 2, 2.0), (1, 1, 3, 6.0), (1, 2, 1, 4.0), (1, 2, 2, 1.0), (1, 2, 3, 5.0)], "MatrixID int, RowNumber int, ColumnNumber int, Value double").createOrReplaceTempView("augmented")
    sql.call(spark, "blocked_linear_system", "solution", m="augmented", block=1)
    assert [r["Value"] for r in spark.sql("SELECT Value FROM solution ORDER BY ColumnNumber").collect()] == [0.5, 3.0]

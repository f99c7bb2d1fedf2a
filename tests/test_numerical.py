"""Goldens from first principles, algebraic properties and edge cases of the numerical operators."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import options, scalar
from quantloom.operators import interpolation, matrix, optimization, polynomial, regression, yields
from quantloom.schemas import CASHFLOWS, MATRIX, PAIRS, POINTS, POLYNOMIAL, PRICES, ddl
from quantloom.sources import calendar, catalogue, lookups
from quantloom.streaming import audit


def table(spark, rows, shape):
    return spark.createDataFrame(rows, ddl(shape))


def matrices(spark, **by_id):
    """m1=[[..]], none=[[..]]: elements of the matrices; ``none`` has a null id."""
    rows = [(None if k == "none" else int(k[1:]), i + 1, j + 1, float(v)) for k, a in by_id.items() for i, row in enumerate(a) for j, v in enumerate(row)]
    return table(spark, rows, MATRIX)


def back(df, key=None, tag=None):
    rows = [r for r in df.collect() if r["MatrixID"] == key and (tag is None or r["Result"] == tag)]
    a = np.zeros((max(r["RowNumber"] for r in rows), max(r["ColumnNumber"] for r in rows)))
    for r in rows:
        a[r["RowNumber"] - 1, r["ColumnNumber"] - 1] = r["Value"]
    return a


A2 = [[5.4, 7.2], [3.1, 6.9]]
A3 = [[5.4, 7.2, 7.2], [3.1, 6.9, 6.9], [4.8, 2.7, 1.8]]


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scalars(spark):
    assert one(spark, scalar.gaussian_error(1.0), scalar.gaussian_error(-1.0), scalar.gaussian_error(0.0)) == pytest.approx([0.8427007877600067, -0.8427007877600067, 0.0], abs=1e-15)
    assert one(spark, scalar.normal_cdf(3.0, 4.0, 5.0), scalar.normal_cdf(5.0, -1.0, 19.0)) == pytest.approx([0.42074030433970544, 0.6239188362318795], abs=1e-14)
    assert one(spark, scalar.normal_cdf(1.0, 0.0, 0.0), scalar.gaussian_error(F.lit(None).cast("double"))) == [None, None]
    assert one(spark, scalar.logistic(0.0), scalar.logistic(-1000.0)) == [0.5, 0.0]
    assert one(spark, scalar.kernel(1.0, "UNIFORM"), scalar.kernel(1.0, "Cosine"), scalar.kernel(0.0, "nothing")) == [0.5, 0.0, None]
    years = spark.createDataFrame([(y,) for y in (2015, 2016, 2017, 2018, 2019, 2020, 2021, 2022, 2777)], "y int")
    found = [str(r[0]) for r in years.select(scalar.easter_sunday(F.col("y"))).collect()]
    assert found == ["2015-04-05", "2016-03-27", "2017-04-16", "2018-04-01", "2019-04-21", "2020-04-12", "2021-04-04", "2022-04-17", "2777-04-17"]
    normal, back_again, none = one(
        spark, scalar.lognormal_to_normal_volatility(0.75, 0.009, 0.0087, 0.249), scalar.normal_to_lognormal_volatility(0.006598334784765573, 0.009, 0.0087, 0.249), scalar.lognormal_to_normal_volatility(-1.0, 1.0, 1.0, 1.0)
    )
    assert normal == pytest.approx(0.006598334784765573, rel=1e-12) and back_again == pytest.approx(0.75, abs=1e-6) and none is None
    line = one(spark, scalar.debug_info(None, 50, F.lit("2020-01-02 03:04:05").cast("timestamp")))[0]
    assert line == "2020-01-02 03:04:05 :: " + " " * 40


def test_option_prices(spark):
    rows = [("Call", 0.15), ("P", 0.15), ("call", 0.20), ("Put", 0.20), ("Put", -1.0), ("x", 0.2)]
    df = spark.createDataFrame(rows, "CallOrPut string, Volatility double")
    found = options.stock_option_price(df, "CallOrPut", 2.0, 55.5, 60.0, "Volatility", 0.005).collect()
    assert [r["OptionFairValue"] for r in found[:4]] == pytest.approx([3.1473353533, 7.0503253782, 4.6939677405, 8.5969577654], abs=1e-9)
    assert found[4]["OptionFairValue"] is None and found[5]["Delta"] is None
    assert found[0]["Delta"] - found[1]["Delta"] == pytest.approx(1.0, abs=1e-6)  # put-call parity
    quirk = options.stock_option_price(df, "CallOrPut", 2.0, 55.5, 60.0, "Volatility", 0.005, compat=True).collect()
    assert quirk[1]["Delta"] == pytest.approx(-found[1]["Delta"])


def test_integrity(spark):
    full = matrices(spark, m1=[[9, 6, 3], [8, 5, 2], [7, 4, 1]])
    valid = lambda m, *a: matrix.integrity_check(m, *a).first()[0]
    assert valid(full) == 1
    assert valid(full.filter("not (RowNumber = 1 and ColumnNumber = 2)")) == 0
    assert valid(full.limit(0)) == 1
    assert valid(full.unionByName(full)) == 0
    zeros = matrices(spark, none=[[0, 0], [0, 1]])
    assert [valid(zeros), valid(zeros, True), valid(zeros, False, True)] == [1, 0, 0]


def test_determinant_adjugate_inverse(spark):
    m = matrices(spark, m1=[[5.4]], m2=A2, none=A3, m4=[[1, 2], [2, 4]])
    found = {r[0]: r[1] for r in matrix.determinant(m).collect()}
    assert found == pytest.approx({1: 5.4, 2: 14.94, None: -13.446, 4: 0.0})
    adj, inv = matrix.adjugate(m), matrix.inverse(m)
    assert back(adj) @ np.array(A3) == pytest.approx(-13.446 * np.eye(3))
    assert back(adj, 4) == pytest.approx(np.array([[4, -2], [-2, 1]]))
    assert back(inv) @ np.array(A3) == pytest.approx(np.eye(3), abs=1e-12)
    assert back(inv, 2) == pytest.approx(np.array([[0.4618473896, -0.4819277108], [-0.2074966533, 0.3614457831]]), abs=1e-9)
    assert inv.filter("MatrixID = 4").count() == 0


def test_one_unsound_matrix_empties_the_batch_or_is_left_out(spark):
    m = matrices(spark, m1=A2, none=A3).filter("not (MatrixID <=> 1 and RowNumber = 1 and ColumnNumber = 2)")
    for f in (matrix.transpose, matrix.determinant, matrix.row_echelon, matrix.covariance):
        assert f(m).count() == 0
        assert {r["MatrixID"] for r in f(m, on_invalid="group").collect()} == {None}


def test_product_and_transpose(spark):
    a, b = matrices(spark, none=A3, m2=A2, m7=[[1]]), matrices(spark, none=np.eye(3) * 2, m2=A2, m8=[[1]])
    found = matrix.product(a, b)
    assert back(found) == pytest.approx(2 * np.array(A3)) and back(found, 2) == pytest.approx(np.array(A2) @ A2)
    assert {r["MatrixID"] for r in found.collect()} == {None, 2}
    assert matrix.product(matrices(spark, m1=A3), matrices(spark, m1=A2)).count() == 0
    assert back(matrix.transpose(a)) == pytest.approx(np.array(A3).T)


def test_qr(spark):
    v = np.vander(np.arange(1, 6), increasing=True)
    found = matrix.qr_factorization(matrices(spark, none=v))
    q, r = back(found, None, "Q Matrix"), back(found, None, "R Matrix")
    assert q @ q.T == pytest.approx(np.eye(5), abs=1e-9) and q @ r == pytest.approx(v, abs=1e-8)
    assert np.abs(np.diag(r)) == pytest.approx([2.2360679775, 3.1622776602, 3.7416573868, 3.7947331922, 2.8685486624])
    assert found.filter("Result = 'Determinant'").first()["Value"] == pytest.approx(288)


def test_eigen(spark):
    found = matrix.eigendecomposition(matrices(spark, none=np.ones((5, 5))))
    assert [r["Value"] for r in found.filter("Result = 'Eigenvalue'").orderBy("RowNumber").collect()] == pytest.approx([5, 0, 0, 0, 0], abs=1e-9)
    assert matrix.eigendecomposition(matrices(spark, m1=A2)).count() == 0


def test_linear_systems(spark):
    m = matrices(spark, none=[[5, 3, 8], [2, 7, 4]], m2=[[1, 1, 1], [2, 2, 2]], m3=[[1, 1, 1], [1, 1, 2]], m4=[[1, 0, 1], [0, 1, 2], [1, 1, 3]])
    found = {(r[0], r[1]): r[2] for r in matrix.linear_system(m).collect()}
    assert found == pytest.approx({(None, 1): 1.5172413793, (None, 2): 0.1379310345, (4, 1): 1.0, (4, 2): 2.0})


def test_covariance_and_correlation(spark):
    eye = matrices(spark, none=np.eye(3), m1=[[1, 2]], m2=[[1, 5], [1, 7]])
    cov, cor = matrix.covariance(eye), matrix.correlation(eye)
    assert back(cov) == pytest.approx(np.full((3, 3), -1 / 6) + np.eye(3) / 2)
    assert back(cor) == pytest.approx(np.full((3, 3), -0.5) + 1.5 * np.eye(3))
    assert cov.filter("MatrixID = 1 and Value is not null").count() == 0
    assert back(cor, 2) == pytest.approx(np.array([[0, 0], [0, 1]]))


def test_minkowski(spark):
    one_, two = matrices(spark, none=[[5, 3, 8], [2, 7, 4]]), matrices(spark, none=[[7, 7, 7], [3, 3, 3], [2, 0, 4]])
    found = [r["Distance"] for r in matrix.minkowski(2, one_, two).orderBy("RowNumber_1", "RowNumber_2").collect()]
    assert found == pytest.approx([4.582575695, 5.3851648071, 5.8309518948, 5.8309518948, 4.2426406871, 7.0])
    assert [r["Distance"] for r in matrix.minkowski(None, one_, two).orderBy("RowNumber_1", "RowNumber_2").collect()] == [4, 5, 4, 5, 4, 7]
    assert matrix.minkowski(0, one_, two).count() == 0
    assert matrix.minkowski(2, one_, matrices(spark, m1=[[1, 2, 3]])).count() == 0


def test_simple_regression(spark):
    lists = {1: [1] * 5, None: [1.11, 1.99, 3.12, 3.98, 5.13], 3: [1.41, 5.41, 1.41, 5.41, 5.41]}
    rows = [(k, float(x + 1), float(y)) for k, ys in lists.items() for x, y in enumerate(ys)]
    found = {r["ListID"]: r for r in regression.simple_linear_regression(table(spark, [*rows, (9, 1.0, 2.0)], PAIRS)).collect()}
    r = found[None]
    assert [r["Slope"], r["Y_Intercept"], r["R_Squared"], r["MeanSquaredError"], r["MeanAbsoluteError"]] == pytest.approx([1.003, 0.057, 0.9978149437, 0.004406, 0.0648])
    assert found[1]["R_Squared"] is None and found[1]["Slope"] == 0 and found[9]["Slope"] is None
    r = found[3]
    assert [r["Slope"], r["Y_Intercept"], r["R_Squared"], r["MeanSquaredError"], r["MeanAbsoluteError"]] == pytest.approx([0.8, 1.41, 1 / 3, 2.56, 1.28])


def test_multiple_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3))
    beta = np.array([2, -3, 5.56])
    found = {r["ResultID"]: r["Value"] for r in regression.multiple_linear_regression(matrices(spark, none=x), matrices(spark, none=(x @ beta)[:, None])).collect()}
    assert found == pytest.approx({1: 2, 2: -3, 3: 5.56, 0: 1.0})
    twin = np.column_stack([x[:, 0], x[:, 0]])
    assert regression.multiple_linear_regression(matrices(spark, m1=twin), matrices(spark, m1=x[:, :1])).count() == 0


def test_logistic_regression(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(400, 2)), np.ones(400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.5]))).astype(float)
    found = regression.logistic_regression(matrices(spark, none=x), matrices(spark, none=y[:, None])).orderBy("RowNumber").collect()
    theta = np.array([r["Value"] for r in found])
    p = 1 / (1 + np.exp(-x @ theta))
    assert np.abs(x.T @ (y - p)).max() < 1e-3  # the gradient vanishes
    scaled = regression.logistic_regression(matrices(spark, none=x), matrices(spark, none=y[:, None]), normalize=True).orderBy("RowNumber").collect()
    assert [r["Value"] for r in scaled] == pytest.approx(list(theta), abs=1e-3)
    assert regression.logistic_regression(matrices(spark, none=x), matrices(spark, none=2 * y[:, None])).count() == 0


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3)) @ np.diag([3, 1, 0.2])
    found = regression.principal_components(matrices(spark, none=x), normalize=False)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["Value"] for r in found.filter("Result = 'Incremental Variance'").orderBy("RowNumber").collect()] == pytest.approx(list(values / values.sum()))
    loadings = back(found, None, "Loading Vector")
    assert loadings @ loadings.T == pytest.approx(np.eye(3), abs=1e-9)


KNOTS = [(None, x, y) for x, y in ((1.0, 5.0), (2.0, 7.0), (3.0, 11.0), (3.0, 13.0), (5.0, 15.0), (7.0, 19.0))]
AT = [0.5, 1.0, 1.5, 1.75, 2.5, 4.33, 6.19, 7.5]


def values_at(df):
    return [r["Interpolated_Y_Value"] for r in df.orderBy("X_Value").collect()]


def test_interpolation(spark):
    pairs, points = table(spark, [*KNOTS, (1, 1.0, 1.0)], PAIRS), table(spark, [(k, x) for k in (None, 1) for x in AT], POINTS)
    assert values_at(interpolation.interpolate(pairs, points, "pl", None)) == pytest.approx([5, 5, 6, 6.5, 9.5, 13.995, 17.38, 19])
    assert values_at(interpolation.interpolate_natural_spline(pairs, points)) == pytest.approx([4.4791666667, 5, 5.640625, 6.185546875, 9.453125, 14.5845183437, 17.0132159688, 20.2708333333])
    assert values_at(interpolation.interpolate(pairs, points, "CSN", "L"))[-1] == pytest.approx(20)
    assert interpolation.interpolate(pairs, points, "other", "F").count() == 0


def test_splines_are_smooth_and_chunks_change_nothing(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.uniform(0.1, 2, 700))
    pairs = table(spark, [(None, float(a), float(b)) for a, b in zip(x, rng.normal(size=700), strict=True)], PAIRS)
    for kind in ("Natural", "Not-A-Knot"):
        whole = interpolation.cubic_spline(pairs, kind).orderBy("Min_X_Value").toPandas()
        parts = interpolation.cubic_spline(pairs, kind, chunk=200).orderBy("Min_X_Value").toPandas()
        assert len(whole) == len(parts) == 699
        names = ["A_Coefficient", "B_Coefficient", "C_Coefficient", "D_Coefficient"]
        assert np.abs(whole[names].to_numpy() - parts[names].to_numpy()).max() < 1e-9
        a, b, c, d = whole[names].to_numpy().T
        h = (whole["Max_X_Value"] - whole["Min_X_Value"]).to_numpy()
        assert (((a * h + b) * h + c) * h + d)[:-1] == pytest.approx(d[1:], abs=1e-9)
        assert ((3 * a * h + 2 * b) * h + c)[:-1] == pytest.approx(c[1:], abs=1e-8)
        assert (3 * a * h + b)[:-1] == pytest.approx(b[1:], abs=1e-8)
        if kind == "Not-A-Knot":
            assert [a[0], a[-1]] == pytest.approx([a[1], a[-2]])
        else:
            assert b[0] == pytest.approx(0, abs=1e-12)


def test_local_regression(spark):
    ys = [1, 3, 5, 6, 5, 3, 2, 1, 3]
    pairs = table(spark, [(None, float(k + 1), float(y)) for k, y in enumerate(ys)], PAIRS)
    found = [r["Y_Value"] for r in interpolation.local_polynomial_regression(pairs, "Parabolic", 4.0, 2).orderBy("X_Value").collect()]
    assert found == pytest.approx([0.9598163, 3.35159141, 5.0931677, 5.51298701, 4.87012987, 3.23809524, 1.95341615, 1.588453, 2.87944891], abs=1e-7)
    quirk = [r["Y_Value"] for r in interpolation.local_polynomial_regression(pairs, "Parabolic", 4.0, 2, compat=True).orderBy("X_Value").collect()]
    assert quirk[0] == pytest.approx(3.12858783, abs=1e-7) and quirk[-1] == pytest.approx(5.99885189, abs=1e-7)
    assert interpolation.local_polynomial_regression(pairs.unionByName(pairs), "Parabolic", 4.0, 2).count() == 0
    assert interpolation.local_polynomial_regression(pairs, "none", 4.0, 2).count() == 0


def test_polynomials(spark):
    p = table(spark, [(None, 1.0, 0.0), (None, 2.0, 1.0), (None, 3.0, 2.0), (1, 4.0, 0.0), (2, 1.0, -1.0), (3, 1.0, 0.5)], POLYNOMIAL)
    found = sorted((str(r[0]), r[1], r[2]) for r in polynomial.derivative(p.filter("PolynomialID is null or PolynomialID = 1")).collect())
    assert found == [("1", 0.0, 0.0), ("None", 2.0, 0.0), ("None", 6.0, 1.0)]
    at = table(spark, [(k, x) for k in (None, 2, 3) for x in (-1.0, 0.0, 1.0, 2.0)], POINTS)
    values = {(r[0], r[1]): r[2] for r in polynomial.evaluate(p, at).collect()}
    assert [values[None, x] for x in (0.0, 1.0, 2.0)] == [1, 6, 17]
    assert (2, 0.0) not in values and (3, -1.0) not in values and values[2, 2.0] == 0.5


def test_yields(spark):
    flows = table(spark, [(None, date(2016, 9, 1), 100.0), (None, date(2016, 12, 1), 100.0), (None, date(2017, 3, 1), 4100.0), (1, date(2016, 1, 1), 1.0)], CASHFLOWS)
    prices = table(spark, [(1, None, date(2016, 5, 29), 4000.0), (2, None, date(2016, 9, 1), 4000.0), (3, 1, date(2016, 5, 29), 1.0)], PRICES)
    found = {r[0]: r for r in yields.yield_to_maturity(flows, prices).collect()}
    assert set(found) == {1, 2}
    assert found[1]["YieldToMaturity"] == pytest.approx(0.1033526993632794, abs=1e-10)
    assert found[2]["Price"] == 3900.0
    assert yields.yield_to_maturity_small_batches(flows, prices, max_batch_size=1).count() == 2


def lp(spark, c, a, b, symbols, direction="Maximize"):
    goal = spark.createDataFrame([(None, j + 1, float(v)) for j, v in enumerate(c)], "ProblemID int, VariableID int, Value double")
    left = spark.createDataFrame([(None, i + 1, j + 1, float(v)) for i, row in enumerate(a) for j, v in enumerate(row)], "ProblemID int, ConstraintID int, VariableID int, Value double")
    right = spark.createDataFrame([(None, i + 1, s, float(v)) for i, (v, s) in enumerate(zip(b, symbols, strict=True))], "ProblemID int, ConstraintID int, Symbol int, Value double")
    return {r["VariableID"]: (r["Value"], r["Status"]) for r in optimization.linear_optimization(goal, left, right, direction).collect()}


def test_linear_optimization(spark):
    found = lp(spark, [-2, -1], [[-1, 1], [-1, -1], [0, -1], [1, -2]], [1, -2, 0, 4], [-1] * 4)
    assert [found[k][0] for k in (1, 2, None)] == pytest.approx([0.5, 1.5, -2.5], abs=1e-5)
    found = lp(spark, [-2, -1], [[-1, 1], [1, -2], [1, 1], [0, 1]], [1, 4, 2, 0], [-1, -1, 0, 1])
    assert [found[k][0] for k in (1, 2, None)] == pytest.approx([0.5, 1.5, -2.5], abs=1e-5)
    found = lp(spark, [2, 1], [[1, -1], [1, 1], [0, 1]], [-1, 2, 0], [1, 1, 1], "Minimize")
    assert found[None][0] == pytest.approx(2.5, abs=1e-5)  # at (0.5, 1.5)
    assert lp(spark, [1], [[1], [-1]], [1, -2], [-1, -1])[None][1] == "Infeasible"
    assert lp(spark, [1], [[-1]], [0], [-1])[None][1] == "NotUnique"


def test_calendar(spark):
    days = calendar.calendar(spark, date(2016, 1, 1), date(2016, 12, 31))
    assert days.count() == 366 and days.orderBy(F.desc("CalendarDate")).first()["DayInYear"] == 366
    assert calendar.calendar(spark, date(2000, 1, 2), date(2000, 1, 2)).first()["DaysAfterSunday"] == 0
    for bad in ((None, date(2000, 1, 1)), (date(2000, 1, 2), date(2000, 1, 1)), (date(1, 1, 1), date(2999, 1, 1))):
        with pytest.raises(ValueError):
            calendar.calendar(spark, *bad)
    assert calendar.extend_calendar(days, date(2016, 12, 30), date(2017, 1, 2)).count() == 2
    with pytest.raises(ValueError):
        calendar.extend_calendar(days.withColumn("DayNumber", F.lit(1)), date(2016, 1, 1), date(2016, 1, 2))
    named = lookups.calendar_view(days).filter("CalendarDate = DATE '2016-12-31'").first()
    assert (named["Month_Name"], named["Weekday_OneLetterAbbreviation"]) == ("December", "S")


def test_holidays(spark):
    found = {(r["Name"], r["CalendarDate"].year): r for r in calendar.holidays(spark, 2021, 2022).collect()}
    assert len(found) == 22
    assert found["Christmas", 2021]["CalendarDate"] == date(2021, 12, 27) and found["Boxing Day", 2021]["Note"] == "Recognized on following Tuesday."
    assert found["Victoria Day", 2022]["CalendarDate"] == date(2022, 5, 23) and found["Good Friday", 2022]["CalendarDate"] == date(2022, 4, 15)


def test_catalogue(spark):
    tables = {name: catalogue.empty_table(spark, name) for name in catalogue.SCHEMAS} | {"TupleStructureType": catalogue.tuple_structure_types(spark)}
    for name in catalogue.SCHEMAS:
        assert catalogue.view(tables, name).count() == (3 if name == "TupleStructureType" else 0)

    def add(name, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {tables[name].schema[k].dataType.simpleString()}" for k in values))
        tables[name] = tables[name].unionByName(row, allowMissingColumns=True)

    add("ScopedDatabase", ID=1, DatabaseName="d")
    add("DatabaseSchema", ID=2, ScopedDatabaseID=1, SchemaName="s", RecordIsActive=True)
    add("TupleStructure", ID=3, DatabaseSchemaID=2, ObjectName="t", TupleStructureTypeID=2, RecordIsActive=True)
    add("TupleStructureColumn", ID=4, TupleStructureID=3, ColumnName="c", RecordIsActive=True, OrdinalNumber=1)
    add("TupleStructureColumn", ID=5, TupleStructureID=3, ColumnName="gone", RecordIsActive=False, OrdinalNumber=2)
    row = catalogue.view(tables, "TupleStructureColumn").collect()
    assert [(r["DatabaseName"], r["SchemaName"], r["ObjectName"], r["ColumnName"], r["TupleStructureType_CodeName"]) for r in row] == [("d", "s", "t", "c", "V")]
    new = spark.createDataFrame([("D", False, "p", None), ("e", True, None, None)], "DatabaseName string, KeepingRecordsSynchronized boolean, PurposeOrMeaning_Description string, TechnicalNotes string")
    with pytest.raises(ValueError):
        catalogue.upsert_databases(tables["ScopedDatabase"], new)
    after = {r["ID"]: r for r in catalogue.upsert_databases(tables["ScopedDatabase"], new, overwrite=True).collect()}
    assert after[1]["DatabaseName"] == "d" and after[1]["KeepingRecordsSynchronized"] is False and after[2]["DatabaseName"] == "e"


def test_upsert_numbers_many_rows_in_ranges(spark):
    shape = "DatabaseName string, KeepingRecordsSynchronized boolean, PurposeOrMeaning_Description string, TechnicalNotes string"
    stored = spark.createDataFrame([(7, "a", True, None, None)], "ID int, " + shape)
    new = spark.createDataFrame([(f"n{k:04d}", True, None, None) for k in range(1000)], shape)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart
    try:
        out = catalogue.upsert_databases(stored, new)
        rows = {r["DatabaseName"]: r["ID"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == {"a": 7} | {f"n{k:04d}": 8 + k for k in range(1000)}
    assert "windowspecdefinition(__part" in out._jdf.queryExecution().analyzed().toString()


def event(kind, database, user):
    inner = f"<EventType>{kind}</EventType>" + (f"<DatabaseName>{database}</DatabaseName>" if database else "") + "<TSQLCommand><SetOptions A='1'/><CommandText>a &lt; b</CommandText></TSQLCommand>"
    return f"<EVENT_INSTANCE>{inner}</EVENT_INSTANCE>", user, datetime(2024, 1, 5)


def test_audit(spark, tmp_path):
    rows = [event("ALTER_INDEX", "x", "NT service\\sqlagent"), event("CREATE_TABLE", None, "me"), event("DROP", "z_DDLEventAudit", "me"), ("<broken", "me", datetime(2024, 1, 5)), (None, "me", None)]
    schema = "EventXML string, UserName string, LogTimestamp timestamp"
    feed = spark.createDataFrame(rows, schema)
    audit.append_events(feed, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 and log.filter("EventType = 'ALTER_INDEX'").first()["TSQLCommand"] == "a < b"
    kept, summary = audit.purge(log, date(2024, 1, 5))
    assert kept.count() == 2 and summary.first()["PurgedRecordCount"] == 1
    assert audit.purge(log, date(2024, 1, 4))[0].count() == 3
    assert not audit.purge_log(log, str(tmp_path / "k"), str(tmp_path / "s"), last=date(2024, 1, 4))
    assert audit.purge_log(log, str(tmp_path / "k"), str(tmp_path / "s"), last=date(2024, 1, 5))
    feed.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    audit.stream_events(stream, str(tmp_path / "streamed"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "streamed")).count() == 3

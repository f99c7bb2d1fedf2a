"""Constraints of equal left sides: the least bound alone stays, and the optimum is the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantloom.operators.affine_scaling import constraint_rows, power_series_optimization


def test_equal_left_sides_leave_one(spark):
    n = spark.range(20_000).select(F.lit(1).alias("ProblemID"), F.col("id").alias("ConstraintID"), (F.col("id") % 4).alias("side"), (5.0 + F.col("id") % 1000).alias("Value"))
    # x <= 5, y <= 6, -x <= 7, -y <= 8 and looser ones; a coefficient in two parts, and one that is null; a bound alone reads 0 <= 9
    body = n.select("ProblemID", "ConstraintID", (F.col("side") % 2 + 1).cast("int").alias("VariableID"), F.when(F.col("side") < 2, 0.25).otherwise(-1.0).alias("Value"))
    body = body.unionByName(body.filter("Value > 0").withColumn("Value", F.lit(0.75))).unionByName(body.withColumns({"VariableID": 3 - F.col("VariableID"), "Value": F.lit(None).cast("double")}))
    goal = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "ProblemID int, VariableID int, Value double")
    names = goal.groupBy(F.col("ProblemID").alias("id")).agg(F.sort_array(F.collect_list("VariableID")).alias("names"))
    bounds = n.drop("side").unionByName(spark.createDataFrame([(1, None, 9.0), (1, 77_777, None)], "ProblemID int, ConstraintID long, Value double"))
    rows = {(tuple(r["a"]), r["b"]) for r in constraint_rows(body, bounds, names).collect()}
    assert rows == {((1.0, 0.0), 5.0), ((0.0, 1.0), 6.0), ((-1.0, 0.0), 7.0), ((0.0, -1.0), 8.0), ((0.0, 0.0), 9.0)}
    got = {r["VariableID"]: r["Value"] for r in power_series_optimization(goal, body, bounds, feasibility_tolerance=1e-10).collect()}
    assert got == {1: pytest.approx(5, abs=1e-6), 2: pytest.approx(6, abs=1e-6), None: pytest.approx(17, abs=1e-6)}

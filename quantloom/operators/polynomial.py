"""Polynomials as tables of terms (PolynomialID, Coefficient, Exponent); exponents may be any real numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.schemas import POINTS, POLYNOMIAL, conform, same


def derivative(terms: DataFrame) -> DataFrame:
    """The terms of the derivatives; that of a constant polynomial is the one term (0, 0)."""
    t = conform(terms, POLYNOMIAL)
    moving = (F.col("Coefficient") != 0) & (F.col("Exponent") != 0)
    constant = t.groupBy("PolynomialID").agg(F.max(F.coalesce(moving, F.lit(False))).alias("moves")).filter("not moves")
    found = t.filter(moving).select("PolynomialID", (F.col("Coefficient") * F.col("Exponent")).alias("Coefficient"), (F.col("Exponent") - 1).alias("Exponent"))
    return found.unionByName(constant.select("PolynomialID", F.lit(0.0).alias("Coefficient"), F.lit(0.0).alias("Exponent")))


def evaluate(terms: DataFrame, values: DataFrame) -> DataFrame:
    """PolynomialID, VariableValue, FunctionValue at the points (ListID, X_Value) of each polynomial's id.

    There is no value at 0 with a negative exponent, nor below 0 with a fractional one.
    """
    t, v = conform(terms, POLYNOMIAL), conform(values, POINTS).filter("X_Value is not null").distinct()
    fractional = F.col("Exponent") != F.floor("Exponent")
    x, c, e = F.col("X_Value"), F.col("Coefficient"), F.col("Exponent")
    term = F.when(c == 0, 0.0).when(e == 0, c).when((x == 0) | (fractional & (x < 0)), 0.0).otherwise(c * F.pow(x, e))
    joined = t.join(v, same(t["PolynomialID"], v["ListID"]))
    sums = joined.groupBy("PolynomialID", "X_Value").agg(F.sum(term).alias("FunctionValue"), F.max(e < 0).alias("negative"), F.max(fractional).alias("fractional"))
    kept = sums.filter(~((x == 0) & F.col("negative")) & ~((x < 0) & F.col("fractional")))
    return kept.select("PolynomialID", x.alias("VariableValue"), "FunctionValue")

"""Shapes of the tables that the numerical operators take, and how a table is brought into shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row for each element of each matrix of a batch; a null id is an id like any other.
MATRIX = {"MatrixID": "int", "RowNumber": "int", "ColumnNumber": "int", "Value": "double"}
PAIRS = {"ListID": "int", "X_Value": "double", "Y_Value": "double"}
POINTS = {"ListID": "int", "X_Value": "double"}
POLYNOMIAL = {"PolynomialID": "int", "Coefficient": "double", "Exponent": "double"}
CASHFLOWS = {"CashflowSeriesID": "int", "CashflowDate": "date", "Amount": "double"}
PRICES = {"ID": "int", "CashflowSeriesID": "int", "EffectiveDate": "date", "Price": "double"}


def ddl(shape: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in shape.items())


def conform(df: DataFrame, shape: dict[str, str]) -> DataFrame:
    """The columns of a shape, cast; other columns are left out."""
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in shape.items()))


def same(left: Column, right: Column) -> Column:
    """Equality of ids, null being equal to null; Spark plans it as an equi-join."""
    return left.eqNullSafe(right)

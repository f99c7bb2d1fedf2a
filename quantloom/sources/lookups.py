"""Small constant tables, and the calendar joined to the names of months and weekdays."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (name, abbreviation, number), (name, abbreviation, letter, days after Sunday).
MONTHS = (
    ("January", "JAN", 1), ("February", "FEB", 2), ("March", "MAR", 3), ("April", "APR", 4), ("May", "MAY", 5), ("June", "JUN", 6),
    ("July", "JUL", 7), ("August", "AUG", 8), ("September", "SEP", 9), ("October", "OCT", 10), ("November", "NOV", 11), ("December", "DEC", 12),
)
WEEKDAYS = (
    ("Sunday", "SUN", "U", 0), ("Monday", "MON", "M", 1), ("Tuesday", "TUE", "T", 2), ("Wednesday", "WED", "W", 3),
    ("Thursday", "THU", "R", 4), ("Friday", "FRI", "F", 5), ("Saturday", "SAT", "S", 6),
)
# Fixed values: (short name, note).
KERNELS = (
    ("Uniform", "K(u) = 1/2 for |u| <= 1"),
    ("Triangular", "K(u) = (1-|u|) for |u| <= 1"),
    ("Parabolic", "K(u) = (3/4)*(1-u^2) for |u| <= 1  (also called Epanechnikov)"),
    ("Quartic", "K(u) = (15/16)*(1-u^2)^2 for |u| <= 1"),
    ("Triweight", "K(u) = (35/32)*(1-u^2)^3 for |u| <= 1"),
    ("Tricube", "K(u) = (70/81)*(1-|u|^3)^3 for |u| <= 1"),
    ("Cosine", "K(u) = (Pi/4)*cos(u(Pi/2)) for |u| <= 1"),
)
# Fixed values: (short name, long name, description, fewest pairs).
INTERPOLATION_METHODS = (
    ("PL", "Piecewise Linear", "Continuous function composed of linear pieces between input points.", 2),
    (
        "CSN", "Natural Cubic Spline",
        "Continuous, twice-differentiable function with continous second derivative, composed of cubic polynomial pieces between input points, with zero second derivative at first and last input points.", 3,
    ),
    (
        "CSNAK", "Not-A-Knot Cubic Spline",
        "Continuous, twice-differentiable function with continous second derivative, composed of cubic polynomial pieces between input points, with matching left-and-right third derivatives at second and second-last input points.", 4,
    ),
)
EXTRAPOLATION_METHODS = (
    ("L", "Linear", "Linear extrapolation from first and last pairs of input points.", 2),
    ("F", "Flat", "Constant extrapolation of first and last input points.", 1),
)
METHOD = "ID int, ShortName string, LongName string, Description string, MinimumInputPairCount int"


def numbered(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(rows, 1)], schema)


def alphabet_letters(spark: SparkSession) -> DataFrame:
    rows = tuple((u, low, k, u in "AEIOU") for k, (u, low) in enumerate(zip(ascii_uppercase, ascii_lowercase, strict=True), 1))
    return numbered(spark, rows, "ID int, Uppercase string, Lowercase string, Number int, IsVowel boolean")


def months(spark: SparkSession) -> DataFrame:
    return numbered(spark, MONTHS, "ID int, Name string, ThreeLetterAbbreviation string, Number int")


def weekdays(spark: SparkSession) -> DataFrame:
    return numbered(spark, WEEKDAYS, "ID int, Name string, ThreeLetterAbbreviation string, OneLetterAbbreviation string, DaysAfterSunday int")


def kernel_functions(spark: SparkSession) -> DataFrame:
    return numbered(spark, KERNELS, "ID int, ShortName string, Note string")


def interpolation_methods(spark: SparkSession) -> DataFrame:
    return numbered(spark, INTERPOLATION_METHODS, METHOD)


def extrapolation_methods(spark: SparkSession) -> DataFrame:
    return numbered(spark, EXTRAPOLATION_METHODS, METHOD)


def calendar_view(days: DataFrame) -> DataFrame:
    """A calendar with the names and abbreviations of month and weekday; both tables are constants of a few rows."""
    spark = days.sparkSession
    m = months(spark).select(F.col("Number").alias("__m"), F.col("Name").alias("Month_Name"), F.col("ThreeLetterAbbreviation").alias("Month_ThreeLetterAbbreviation"))
    w = weekdays(spark).select(
        F.col("DaysAfterSunday").alias("__w"), F.col("Name").alias("Weekday_Name"), F.col("ThreeLetterAbbreviation").alias("Weekday_ThreeLetterAbbreviation"), F.col("OneLetterAbbreviation").alias("Weekday_OneLetterAbbreviation")
    )
    joined = days.join(F.broadcast(m), F.col("MonthNumber") == F.col("__m")).join(F.broadcast(w), F.col("DaysAfterSunday") == F.col("__w"))
    return joined.drop("__m", "__w")

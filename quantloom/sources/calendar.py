"""Calendar days and holidays, generated where they are needed.

Days come from ``spark.range``, so they are made on the executors.  Holidays are date arithmetic on
a row for each year and rule; nothing is looked up day by day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalar import easter_sunday
from quantloom.schemas import same

MAX_DAYS = 200_000
COLUMNS = ("CalendarDate", "YearNumber", "MonthNumber", "DayNumber", "DayInYear", "DaysAfterSunday")

STATUTORY, CIVIC, REMEMBRANCE = "Ontario Statutory", "Civic Holiday", "Remembrance Day"
ON_MONDAY, ON_TUESDAY = "Recognized on following Monday.", "Recognized on following Tuesday."
# Holidays of a fixed day (name, month, day, moved to Monday from a weekend, calendar)
# and holidays on the n-th Monday of a month (name, month, n, calendar).
FIXED = (
    ("New Year's Day", 1, 1, False, STATUTORY),
    ("Canada Day", 7, 1, True, STATUTORY),
    ("Remembrance Day", 11, 11, True, REMEMBRANCE),
    ("Christmas", 12, 25, True, STATUTORY),
    ("Boxing Day", 12, 26, True, STATUTORY),
)
MONDAYS = (
    ("Family Day", 2, 3, STATUTORY),
    ("Civic/Provincial Day", 8, 1, CIVIC),
    ("Labour Day", 9, 1, STATUTORY),
    ("Thanksgiving Day", 10, 2, STATUTORY),
)


def calendar(spark: SparkSession, first: date, last: date, max_days: int = MAX_DAYS) -> DataFrame:
    """A row for each day from first to last, both included."""
    if first is None or last is None or first > last:
        raise ValueError("both dates are needed, the first not after the last")
    days = (last - first).days + 1
    if days > max_days:
        raise ValueError(f"{days} days are more than {max_days}")
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    return described(spark.range(days).select(day.alias("CalendarDate")))


def described(days: DataFrame) -> DataFrame:
    """CalendarDate with its year, month, day, day in the year and days after Sunday."""
    d = F.col("CalendarDate")
    return days.select(
        d,
        F.year(d).alias("YearNumber"),
        F.month(d).cast("short").alias("MonthNumber"),
        F.dayofmonth(d).alias("DayNumber"),
        F.dayofyear(d).alias("DayInYear"),
        (F.dayofweek(d) - 1).cast("short").alias("DaysAfterSunday"),
    )


def calendar_discrepancies(stored: DataFrame) -> DataFrame:
    """Rows of a stored calendar that disagree with what their date says, or whose date repeats or is null."""
    right = described(stored.select("CalendarDate").distinct())
    wrong = stored.select(*COLUMNS).join(right, list(COLUMNS), "left_anti")
    twice = stored.groupBy("CalendarDate").count().filter("count > 1")
    return wrong.unionByName(stored.select(*COLUMNS).join(twice, same(stored["CalendarDate"], twice["CalendarDate"]), "left_semi")).distinct()


def extend_calendar(stored: DataFrame, first: date, last: date) -> DataFrame:
    """Days of a range that a stored calendar lacks; fails if the stored one is wrong somewhere."""
    if not calendar_discrepancies(stored).isEmpty():
        raise ValueError("the stored calendar has rows that are wrong")
    return calendar(stored.sparkSession, first, last).join(stored, "CalendarDate", "left_anti")


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """CalendarDate, Name, Note, HolidayCalendar_Name of all holidays, in order of date and calendar.

    A Christmas on a weekend moves to Monday and takes Boxing Day to Tuesday.
    """
    if first_year is None or last_year is None or first_year > last_year:
        raise ValueError("both years are needed, the first not after the last")
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")

    def on(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    def rule(day: Column, name: str, calendar_name: str, note: Column | None = None) -> Column:
        return F.struct(
            day.alias("CalendarDate"), F.lit(name).alias("Name"), (F.lit(None) if note is None else note).cast("string").alias("Note"), F.lit(calendar_name).alias("HolidayCalendar_Name")
        )

    weekend = lambda d: F.dayofweek(d).isin(1, 7)
    christmas_moves = weekend(on(12, 25))
    rules = []
    for name, month, day, moves, calendar_name in FIXED:
        own = on(month, day)
        moved, note = own, F.lit(None).cast("string")
        if moves:
            moved = F.when(weekend(own), F.next_day(own, "Mon")).otherwise(own)
            note = F.when(weekend(own), ON_MONDAY)
        if name == "Boxing Day":
            moved = F.when(christmas_moves, F.date_add(F.next_day(on(12, 25), "Mon"), 1)).otherwise(moved)
            note = F.when(christmas_moves, ON_TUESDAY).otherwise(note)
        rules.append(rule(moved, name, calendar_name, note))
    for name, month, n, calendar_name in MONDAYS:
        rules.append(rule(F.date_add(F.next_day(F.date_sub(on(month, 1), 1), "Mon"), 7 * (n - 1)), name, calendar_name))
    rules.append(rule(F.date_sub(easter_sunday(y), 2), "Good Friday", STATUTORY))
    rules.append(rule(F.next_day(on(5, 17), "Mon"), "Victoria Day", STATUTORY))
    found = years.select(F.explode(F.array(*rules)).alias("h")).select("h.*")
    return found.orderBy("CalendarDate", "HolidayCalendar_Name")

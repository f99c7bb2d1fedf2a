"""Scans of lists in order, in which no list has to fit into a task.

The rows of all lists are dealt out by ranges of (ListID, X_Value, tie-break), so a long list lies in many
partitions and a short one in one.  A scan runs within each partition; what it needs of a list's
other partitions (the knot that comes next, the last knot before, how many rows came before) is a row for
each list and partition, of which a list has at most as many as there are partitions.  Those rows join the
scan as rows of their own, before or behind the others, so the scan needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.storage import materialise

PART = "__part"
ROLE = "__role"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows in a table, with the number of the range that each lies in.

    Written, since ranges come from a sample: every later step must see the same ones.  The partition that a
    row comes from is the last part of the order, so rows of one place may lie in several ranges; a task that is
    run again deals its rows out as before.
    """
    salted = df.withColumn("__salt", F.spark_partition_id())
    return materialise(salted.repartitionByRange("ListID", *order, "__salt").drop("__salt").withColumn(PART, F.spark_partition_id()))


def scan_window(*order: str) -> Window:
    return Window.partitionBy("ListID", PART).orderBy(*order)


def by_list(parts: DataFrame, *carried: str) -> DataFrame:
    """ListID and its parts (part and what is carried of it) in order."""
    return parts.groupBy("ListID").agg(F.sort_array(F.collect_list(F.struct(PART, *carried))).alias("parts"))


def each_part(lists: DataFrame, made: Column, *also: str) -> DataFrame:
    """ListID, what `made` (an array of structs, one for each part) holds, and other columns of the list."""
    return lists.select("ListID", F.explode(made).alias("__e"), *also).select("ListID", "__e.*", *also)


def with_next(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The rows (ListID, x, y; x distinct in a list) that have a follower in their list, with its values as x2 and y2."""
    base = ranged(rows.select("ListID", x, y), x)
    firsts = by_list(base.groupBy("ListID", PART).agg(F.min(F.struct(x, y)).alias("first")), "first")
    # the first row of each later part stands behind the rows of the part before
    behind = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p, k: F.struct(F.get("parts", k)[PART].alias(PART), p["first"].alias("first")))
    borrowed = each_part(firsts, behind).select("ListID", F.col(f"first.{x}").alias(x), F.col(f"first.{y}").alias(y), PART, F.lit(1).alias(ROLE))
    w = scan_window(x, ROLE)
    both = base.withColumn(ROLE, F.lit(0)).unionByName(borrowed)
    return both.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w)).filter(f"{ROLE} = 0 and x2 is not null").drop(ROLE, PART)


def numbered(rows: DataFrame, x: str) -> DataFrame:
    """The rows with their number r (from 0, by x, distinct in a list) in their list and the list's number of rows n."""
    base = ranged(rows, x)
    counts = by_list(base.groupBy("ListID", PART).agg(F.count(F.lit(1)).alias("m")), "m")
    before = F.transform("parts", lambda p, k: F.struct(p[PART].alias(PART), F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0).cast("long"), lambda total, q: total + q["m"]).alias("before")))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda all_of, q: all_of + q["m"]).alias("n")
    heads = each_part(counts.select("ListID", "parts", total), before, "n").withColumn(ROLE, F.lit(0))
    w = scan_window(ROLE, x)
    both = base.withColumn(ROLE, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    start = F.first("before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    size = F.first("n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("r", F.row_number().over(w) - 2 + start).withColumn("n", size).filter(f"{ROLE} = 1").drop(ROLE, PART, "before")


def running_sums(rows: DataFrame, x: str, values: list[str]) -> DataFrame:
    """The rows with the sums of the values over their list up to them, and over all of it as total_...: each x is once in a list."""
    base = ranged(rows, x)
    sums = [F.sum(v).alias(v) for v in values]
    parts = by_list(base.groupBy("ListID", PART).agg(*sums), *values)
    zeros = F.struct(*(F.lit(0.0).alias(v) for v in values))

    def added(some: Column) -> Column:
        return F.aggregate(some, zeros, lambda total, p: F.struct(*((total[v] + p[v]).alias(v) for v in values)))

    before = F.transform("parts", lambda p, k: F.struct(p[PART].alias(PART), added(F.slice("parts", F.lit(1), k)).alias("__before")))
    heads = each_part(parts.select("ListID", "parts", added(F.col("parts")).alias("__total")), before, "__total")
    heads = heads.select("ListID", PART, "__total", F.lit(0).alias(ROLE), "__before.*")
    w = scan_window(ROLE, x).rowsBetween(Window.unboundedPreceding, 0)
    both = base.withColumn(ROLE, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    summed = both.withColumns({v: F.sum(v).over(w) for v in values} | {"__total": F.first("__total", ignorenulls=True).over(w)}).filter(f"{ROLE} = 1")
    return summed.withColumns({f"total_{v}": F.col(f"__total.{v}") for v in values}).drop(ROLE, PART, "__total")


def last_at_or_before(points: DataFrame, knots: DataFrame, of_list: DataFrame | None = None, also: tuple[str, ...] = (), below: str = "false") -> DataFrame:
    """ListID, X_Value and the columns `also` of every point with `knot`, the last of its list's knots (ListID, x, knot) at or before it, or null.

    Points of which `below` holds take the last knot before them alone.

    Given `of_list` (ListID, whole), a row for each list, points also get their list's `whole`, and lists without one go.
    """
    k = knots.select("ListID", F.col("x").alias("X_Value"), "knot", F.lit(1).alias(ROLE))
    role = F.when(F.expr(below), 0).otherwise(2).alias(ROLE)
    p = points.select("ListID", "X_Value", F.lit(None).cast(k.schema["knot"].dataType).alias("knot"), role, F.struct(F.lit(1), *also).alias("__also"))
    base = ranged(k.unionByName(p, allowMissingColumns=True), "X_Value", ROLE)
    latest = F.max(F.when(F.col(ROLE) == 1, F.struct("X_Value", "knot"))).alias("latest")
    lists = by_list(base.groupBy("ListID", PART).agg(latest), "latest")
    columns: tuple[str, ...] = ("knot",)
    if of_list is not None:
        of = of_list.select(F.col("ListID").alias("__of"), "whole")
        lists = lists.join(of, lists["ListID"].eqNullSafe(of["__of"])).drop("__of")
        columns = ("knot", "whole")
    # a part begins with the last knot of all parts before it
    begin = F.transform("parts", lambda p, i: F.struct(p[PART].alias(PART), F.array_max(F.transform(F.slice("parts", F.lit(1), i), lambda q: q["latest"]))["knot"].alias("knot")))
    heads = each_part(lists, begin, *columns[1:]).withColumn(ROLE, F.lit(-1))
    w = scan_window("__place", "X_Value", ROLE).rowsBetween(Window.unboundedPreceding, 0)
    both = base.unionByName(heads, allowMissingColumns=True).withColumn("__place", F.col(ROLE) >= 0)
    found = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).filter("__also is not null")
    if of_list is not None:
        found = found.filter("whole is not null")
    return found.select("ListID", "X_Value", *(F.col(f"__also.{c}").alias(c) for c in also), *columns)

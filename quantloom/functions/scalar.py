"""Scalar functions as Column expressions: no Python runs on the executors.

All take Columns (numbers are taken as literals) and give NULL for NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the exponent in the rational approximation of erf, by rising power of t.
ERF_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)
#: Newton's steps for a volatility before it is halved out.
NEWTON_STEPS = 6


def number(x: Column | float | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("double")


def horner(t: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * t + F.lit(c)
    return total


def debug_info(message: Column | str | None, nest_level: int = 2, at: Column | None = None) -> Column:
    """A log line: time, '::', four spaces for each level of nesting beyond 2 (ten at most), message."""
    said = message if isinstance(message, Column) else F.lit(message)
    depth = min(max(nest_level - 2, 0), 10)
    when = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
    return F.concat(when, F.lit(" :: " + "    " * depth), F.coalesce(said.cast("string"), F.lit("")))


def gaussian_error(x: Column | float) -> Column:
    """erf(x) with an error of 1.2e-7 at most."""
    x = number(x)
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    tail = t * F.exp(-x * x + horner(t, ERF_COEFFICIENTS))
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (1.0 - tail))


def normal_cdf(bound: Column | float, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    """Normal cumulative distribution; a deviation of 0 gives NULL."""
    z = F.try_divide(number(bound) - number(mean), number(deviation) * math.sqrt(2.0))
    return 0.5 * (1.0 + gaussian_error(z))


def logistic(x: Column | float) -> Column:
    return 1.0 / (1.0 + F.exp(-number(x)))


def kernel(u: Column | float, name: Column | str) -> Column:
    """A kernel on [-1, 1] by its name in any case; NULL for an unknown name.

    The uniform kernel holds at -1 and 1, the others are 0 there.
    """
    u = number(u)
    name = F.lower(name if isinstance(name, Column) else F.lit(name))
    inside = 1.0 - u * u
    cubic = 1.0 - F.abs(u * u * u)
    bodies = {
        "triangular": 1.0 - F.abs(u),
        "parabolic": 0.75 * inside,
        "quartic": 15.0 / 16.0 * inside * inside,
        "triweight": 35.0 / 32.0 * inside * inside * inside,
        "tricube": 70.0 / 81.0 * cubic * cubic * cubic,
        "cosine": math.pi / 4 * F.cos(u * (math.pi / 2)),
    }
    out = F.when(u.isNull() | name.isNull(), None).when(name == "uniform", F.when(F.abs(u) <= 1, 0.5).otherwise(0.0))
    for key, body in bodies.items():
        out = out.when(name == key, F.when(F.abs(u) < 1, body).otherwise(0.0))
    return out.otherwise(F.lit(None).cast("double"))


def quotient(a: Column, b: int | Column) -> Column:
    """Whole quotient of integers that are not negative."""
    return F.floor(a / b).cast("int")


def easter_sunday(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar, by Oudin's integer algorithm."""
    y = year.cast("int")
    golden, century = y % 19, quotient(y, 100)
    moon = (century - quotient(century, 4) - quotient(8 * century + 13, 25) + 19 * golden + 15) % 30
    late = quotient(moon, 28)
    full = moon - late * (1 - late * quotient(F.lit(29), moon + 1) * quotient(21 - golden, 11))
    weekday = (y + quotient(y, 4) + full + 2 - century + quotient(century, 4)) % 7
    return F.date_add(F.make_date(y, F.lit(3), F.lit(1)), (27 + full - weekday).cast("int"))


def lognormal_to_normal_volatility(volatility: Column | float, forward: Column | float, strike: Column | float, years: Column | float) -> Column:
    """Normal volatility that gives the price of a lognormal one; NULL outside its domain."""
    v, f, k, t = map(number, (volatility, forward, strike, years))
    log = F.ln(F.try_divide(f, k))
    v2t = v * v * t
    away = v * F.try_divide(f - k, log) / (1.0 + (1.0 - log * log / 120.0) * v2t / 24.0 + v2t * v2t / 5760.0)
    near = v * F.sqrt(f * k) * (1.0 + log * log / 24.0) / (1.0 + v2t / 24.0 + v2t * v2t / 5760.0)
    at_the_money = F.abs(F.try_divide(f - k, k)) < 0.001
    return F.when((v >= 0) & (f > 0) & (k > 0) & (t > 0), F.when(at_the_money, near).otherwise(away))


def normal_to_lognormal_volatility(volatility: Column | float, forward: Column | float, strike: Column | float, years: Column | float, steps: int = 60) -> Column:
    """The smallest lognormal volatility with the given normal one; NULL if there is none up to 2**6.

    The normal volatility of x is c x / (1 + a x^2 + b x^4).  Newton's steps from v / c, where the denominator is still 1, rise to the
    smallest root and meet it in a few steps.  Where they have not (near the largest normal volatility, or a < 0), it is halved out.
    """
    v, f, k, t = map(number, (volatility, forward, strike, years))
    log = F.ln(F.try_divide(f, k))
    at_the_money = F.abs(F.try_divide(f - k, k)) < 0.001
    c = F.when(at_the_money, F.sqrt(f * k) * (1.0 + log * log / 24.0)).otherwise(F.try_divide(f - k, log))
    a = F.when(at_the_money, t / 24.0).otherwise((1.0 - log * log / 120.0) * t / 24.0)
    first = F.struct(v.alias("v"), c.alias("c"), a.alias("a"), (t * t / 5760.0).alias("b"), F.try_divide(v, c).alias("x"), F.lit(None).cast("double").alias("last"))

    def nearer(s: Column, _: Column) -> Column:
        x, x2 = s["x"], s["x"] * s["x"]
        over = s["v"] * (1.0 + x2 * (s["a"] + s["b"] * x2)) - s["c"] * x
        slope = 2.0 * s["v"] * x * (s["a"] + 2.0 * s["b"] * x2) - s["c"]
        return F.struct(s["v"].alias("v"), s["c"].alias("c"), s["a"].alias("a"), s["b"].alias("b"), F.when(slope < 0, x - F.try_divide(over, slope)).alias("x"), x.alias("last"))

    met = lambda s: F.when((s["a"] >= 0) & (s["x"] <= 64.0) & (F.abs(s["x"] - s["last"]) <= 1e-14 * s["x"]), s["x"])
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), first, nearer, met)

    of = lambda x: lognormal_to_normal_volatility(x, f, k, t)
    bounds = F.filter(F.transform(F.sequence(F.lit(-10), F.lit(6)), lambda e: F.pow(F.lit(2.0), e)), lambda x: of(x) >= v)
    high = F.get(bounds, F.lit(0))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        below = of(middle) < v
        return F.struct(F.when(below, middle).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), high.alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((v >= 0) & (f > 0) & (k > 0) & (t > 0), F.coalesce(newton, F.when(high.isNotNull(), found)))

"""Option prices and Greeks as columns added to a DataFrame.

Every pricer takes names of columns or Columns, works in one projection and keeps all columns of
its input; result columns replace any of the same name.  Calls and puts differ by a sign: with
s = 1 for a call and -1 for a put, a Black price is s (F N(s d1) - K N(s d2)) times the discount.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import normal_cdf, number

Arg = Column | str | float | None
DAYS_A_YEAR = 365.0
GREEKS = ("OptionFairValue", "Delta", "Gamma", "Vega", "Theta", "Rho")


def value(x: Arg) -> Column:
    return F.col(x).cast("double") if isinstance(x, str) else number(x)


def date(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("date")


def sign(kind: Column | str) -> Column:
    """1 for Call or C, -1 for Put or P, in any case; else NULL."""
    kind = F.lower(F.col(kind) if isinstance(kind, str) else kind)
    return F.when(kind.isin("call", "c"), 1.0).when(kind.isin("put", "p"), -1.0)


def density(d: Column) -> Column:
    return F.exp(-d * d / 2.0) / math.sqrt(2 * math.pi)


def staged(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Adds columns step by step and drops those that only later steps need (``__...``)."""
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*(name for step in steps for name in step if name.startswith("__")))


c = F.col


def stock_option_price(df: DataFrame, call_or_put: Arg = "CallOrPut", time_to_expiry: Arg = "TimeToExpiry", price: Arg = "CurrentPrice", strike: Arg = "StrikePrice", volatility: Arg = "Volatility", rate: Arg = "RiskFreeRate", dividend_yield: Arg = None, compat: bool = False) -> DataFrame:
    """Black-Scholes value, Greeks and DiscountFactor_RiskFreeRate.

    Time, price, strike and volatility must be positive, else the results are NULL; no dividend
    yield is one of 0, a negative one gives NULL.  ``compat`` gives a put's Delta without its sign.
    """
    t, s, k, v, r, q = map(value, (time_to_expiry, price, strike, volatility, rate, dividend_yield))
    q = F.when(F.coalesce(q, F.lit(0.0)) >= 0, F.coalesce(q, F.lit(0.0)))
    ok = (v > 0) & (t > 0) & (s > 0) & (k > 0)
    inner = {"__s": sign(call_or_put), "__q": q, "__df": F.exp(-r * t), "__dm": F.exp(-q * t), "__sd": F.when(ok, v * F.sqrt(t))}
    d1 = {"__d1": (F.ln(F.try_divide(s, k)) + (r - c("__q") + v * v / 2.0) * t) / c("__sd")}
    tails = {"__n1": normal_cdf(c("__s") * c("__d1")), "__n2": normal_cdf(c("__s") * (c("__d1") - c("__sd"))), "__pdf": density(c("__d1"))}
    delta = c("__dm") * c("__n1")
    results = {
        "OptionFairValue": c("__s") * (s * c("__dm") * c("__n1") - k * c("__df") * c("__n2")),
        "Delta": F.when(c("__s").isNotNull(), delta) if compat else c("__s") * delta,
        "Gamma": c("__dm") * c("__pdf") / (s * c("__sd")),
        "Vega": c("__dm") * s * F.sqrt(t) * c("__pdf"),
        "Theta": -c("__dm") * s * v * c("__pdf") / (2.0 * F.sqrt(t)) + c("__s") * (c("__q") * s * c("__dm") * c("__n1") - r * k * c("__df") * c("__n2")),
        "Rho": c("__s") * k * t * c("__df") * c("__n2"),
        "DiscountFactor_RiskFreeRate": c("__df"),
    }
    return staged(df, inner, d1, tails, {name: F.when(ok, x) if name != "DiscountFactor_RiskFreeRate" else x for name, x in results.items()})


def black_steps(f: Column, k: Column, v: Column, r: Column, scale: Column) -> list[dict[str, Column]]:
    """Steps of a Black-76 price from __s, __t (time to expiry, NULL unless positive) and __df."""
    root = F.when((F.coalesce(v, F.lit(0.0)) != 0), v * F.sqrt(c("__t")))
    d1 = {"__d1": (F.ln(F.try_divide(f, k)) + v * v / 2.0 * c("__t")) / root}
    tails = {"__n1": normal_cdf(c("__s") * c("__d1")), "__n2": normal_cdf(c("__s") * (c("__d1") - root)), "__pdf": density(c("__d1"))}
    undiscounted = {"__price": c("__s") * (f * c("__n1") - k * c("__n2")) * c("__df")}
    results = {
        "OptionFairValue": scale * c("__price"),
        "Delta": c("__s") * c("__df") * c("__n1"),
        "Gamma": F.try_divide(c("__df") * c("__pdf"), f * v * F.sqrt(c("__t"))),
        "Vega": c("__df") * f * F.sqrt(c("__t")) * c("__pdf"),
        "Theta": -f * v * c("__df") * c("__pdf") / (2.0 * F.sqrt(c("__t"))) + r * c("__price"),
        "Rho": -c("__t") * c("__price"),
    }
    return [d1, tails, undiscounted, results]


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def bond_option_price(df: DataFrame, call_or_put: Arg = "CallOrPut", notional: Arg = "Notional", valuation: Arg = "ValuationDate", expiration: Arg = "ExpirationDate", settlement: Arg = "SettlementDate", forward: Arg = "ForwardPrice", strike: Arg = "StrikePrice", volatility: Arg = "PriceVolatility", rate: Arg = "RiskFreeRate") -> DataFrame:
    """Lognormal bond option: value for the notional (prices are per 100), Greeks per unit.

    Discounting runs to the later of settlement and expiration.  NULL unless expiration is after
    valuation and the volatility is not 0.
    """
    n, f, k, v, r = map(value, (notional, forward, strike, volatility, rate))
    expiry = F.datediff(date(expiration), date(valuation)) / DAYS_A_YEAR
    settled = F.datediff(date(settlement), date(valuation)) / DAYS_A_YEAR
    inner = {"__s": sign(call_or_put), "__t": positive(expiry), "__df": F.exp(-r * F.when(settled >= expiry, settled).otherwise(expiry))}
    return staged(df, inner, *black_steps(f, k, v, r, n / 100.0))


def rate_times(call_or_put: Arg, start: Arg, end: Arg, valuation: Arg, r: Column) -> list[dict[str, Column]]:
    """Signs, times to start and to the day after the end, and the discount to the end."""
    starts = F.datediff(date(start), date(valuation)) / DAYS_A_YEAR
    ends = (F.datediff(date(end), date(valuation)) + 1) / DAYS_A_YEAR
    both = (starts > 0) & (ends > 0)
    return [
        {"__s": sign(call_or_put), "__t": F.when(both, starts), "__accrual": ends - starts, "__all_df": F.exp(-r * ends)},
        {"__df": F.when(c("__t").isNotNull(), c("__all_df"))},
    ]


def rate_option_price_lognormal(df: DataFrame, call_or_put: Arg = "CallOrPut", notional: Arg = "Notional", start: Arg = "StartDate", end: Arg = "EndDate", valuation: Arg = "ValuationDate", forward: Arg = "ForwardRate", strike: Arg = "StrikeRate", volatility: Arg = "YieldVolatility", rate: Arg = "RiskFreeRate") -> DataFrame:
    """Black-76 caplet or floorlet: value for notional and accrual (days, both ends counted, over 365), Greeks per unit."""
    n, f, k, v, r = map(value, (notional, forward, strike, volatility, rate))
    times = rate_times(call_or_put, start, end, valuation, r)
    return staged(df, *times, *black_steps(f, k, v, r, n * c("__accrual")), {"DiscountFactor_RiskFreeRate": c("__all_df")})


def rate_option_price_normal(df: DataFrame, call_or_put: Arg = "CallOrPut", notional: Arg = "Notional", start: Arg = "StartDate", end: Arg = "EndDate", valuation: Arg = "ValuationDate", forward: Arg = "ForwardRate", strike: Arg = "StrikeRate", volatility: Arg = "YieldVolatility", rate: Arg = "RiskFreeRate") -> DataFrame:
    """The same under normally distributed rates; rates may be negative."""
    n, f, k, v, r = map(value, (notional, forward, strike, volatility, rate))
    root = F.sqrt(c("__t"))
    steps = [
        {"__d1": F.when(F.coalesce(v, F.lit(0.0)) != 0, (f - k) / (v * root))},
        {"__n1": normal_cdf(c("__s") * c("__d1")), "__pdf": density(c("__d1"))},
        {"__price": c("__df") * (c("__s") * (f - k) * c("__n1") + v * root * c("__pdf"))},
        {
            "OptionFairValue": n * c("__accrual") * c("__price"),
            "Delta": c("__s") * c("__df") * c("__n1"),
            "Gamma": F.try_divide(c("__df") * c("__pdf"), v * root),
            "Vega": c("__df") * root * c("__pdf"),
            "Theta": r * c("__price") - c("__df") * v * c("__pdf") / (2.0 * root),
            "Rho": -c("__t") * c("__price"),
            "DiscountFactor_RiskFreeRate": c("__all_df"),
        },
    ]
    return staged(df, *rate_times(call_or_put, start, end, valuation, r), *steps)

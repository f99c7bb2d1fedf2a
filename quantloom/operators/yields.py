"""Yields to maturity of cash-flow series.

A series is folded into one array (its days are unique, so it is bounded), prices are joined to it, and
the prices of a batch take their steps together, on arrays padded to one length.  Many prices of one series therefore spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.schemas import CASHFLOWS, PRICES, conform, same

MAX_ITERATIONS = 500
START = 0.025
TOLERANCE = 1e-13
DAYS_A_YEAR = 365.25
#: Cash flows, padding included, that take steps together.
CELLS = 1 << 20


def roots(years: np.ndarray, amounts: np.ndarray, price: np.ndarray, max_iterations: int = MAX_ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y with sum amounts (1 + y)^-years = price, iterations, error, of all rows together; a row is a price, padded by amounts of 0.

    Newton steps, kept inside a bracket once there is one.  Rows that are done rest; NaN where there is no finite value.
    """
    m = len(price)
    x, low, high = np.full(m, 1 + START), np.full(m, np.nan), np.full(m, np.nan)
    best, best_x, steps = np.full(m, np.inf), np.full(m, np.nan), np.zeros(m, dtype=np.int32)
    at = np.arange(m)  # rows that still move
    for k in range(1, max_iterations + 1):
        if not len(at):
            break
        now, t, cash = x[at], years[at], amounts[at]
        with np.errstate(all="ignore"):
            paid = cash * now[:, None] ** -t
            f = paid.sum(axis=1) - price[at]
            slope = -(paid * t).sum(axis=1) / now
        steps[at] = k
        finite = np.isfinite(f)
        best[at[~finite]], best_x[at[~finite]] = np.nan, np.nan
        closer = finite & (np.abs(f) < best[at])
        best[at[closer]], best_x[at[closer]] = np.abs(f[closer]), now[closer]
        falls = slope < 0
        low[at[falls & (f > 0)]], high[at[falls & (f <= 0)]] = now[falls & (f > 0)], now[falls & (f <= 0)]
        lo, hi = low[at], high[at]
        with np.errstate(all="ignore"):
            ahead = np.where(slope != 0, now - f / slope, now / 2)
        between = np.where(np.isnan(lo), now / 2, np.where(np.isnan(hi), now * 2, (lo + hi) / 2))
        ahead = np.where((ahead <= 0) | (ahead < lo) | (ahead > hi), between, ahead)  # NaN bounds hold nothing back
        moves = finite & (np.abs(f) > TOLERANCE * np.maximum(1.0, np.abs(price[at]))) & (ahead != now) & ~(hi - lo <= 1e-16 * hi)
        x[at[moves]] = ahead[moves]
        at = at[moves]
    return best_x - 1, steps, best


def padded(arrays: list[np.ndarray], length: int) -> np.ndarray:
    out = np.zeros((len(arrays), length))
    for row, values in zip(out, arrays, strict=True):
        row[: len(values)] = values
    return out


def yield_to_maturity(cashflows: DataFrame, prices: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """CashflowSeriesPriceID, CashflowSeriesID, EffectiveDate, Price, YieldToMaturity, Iterations, FinalError.

    A cash flow counts from the day before its date, in years of 365.25 days.  Those of the effective
    date itself are taken off the price, and that price is returned.  Prices without a later cash
    flow have no row.  A null series is a series like any other; null dates, amounts or prices leave
    their row out; of a series' repeated dates the amounts add up.
    """
    flows = conform(cashflows, CASHFLOWS).filter("CashflowDate is not null and Amount is not null")
    daily = flows.groupBy("CashflowSeriesID", "CashflowDate").agg(F.sum("Amount").alias("Amount"))
    series = daily.groupBy(F.col("CashflowSeriesID").alias("__series")).agg(F.sort_array(F.collect_list(F.struct("CashflowDate", "Amount"))).alias("flows"))
    p = conform(prices, PRICES).filter("EffectiveDate is not null and Price is not null")
    joined = p.join(series, same(p["CashflowSeriesID"], series["__series"]))
    later = F.filter("flows", lambda f: f["CashflowDate"] > F.col("EffectiveDate"))
    today = F.filter("flows", lambda f: f["CashflowDate"] == F.col("EffectiveDate"))
    paid = F.aggregate(today, F.lit(0.0), lambda total, f: total + f["Amount"])
    each = joined.select(
        F.col("ID").alias("CashflowSeriesPriceID"),
        "CashflowSeriesID",
        "EffectiveDate",
        (F.col("Price") - paid).alias("Price"),
        F.transform(later, lambda f: (F.datediff(f["CashflowDate"], F.col("EffectiveDate")) - 1) / DAYS_A_YEAR).alias("years"),
        F.transform(later, lambda f: f["Amount"]).alias("amounts"),
    ).filter(F.size("years") > 0)

    @F.pandas_udf("YieldToMaturity double, Iterations int, FinalError double")
    def solved(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for years, amounts, price in parts:
            sizes = years.map(len).to_numpy()
            order = np.argsort(sizes, kind="stable")  # rows of like length together
            out = pd.DataFrame({"YieldToMaturity": np.zeros(len(sizes)), "Iterations": np.zeros(len(sizes), dtype=np.int32), "FinalError": np.zeros(len(sizes))})
            at = 0
            while at < len(order):
                n = max(1, CELLS // int(sizes[order[min(at + CELLS // max(int(sizes[order[at]]), 1), len(order)) - 1]]))
                some = order[at : at + n]
                length = int(sizes[some[-1]])
                found = roots(padded(list(years.iloc[some]), length), padded(list(amounts.iloc[some]), length), price.iloc[some].to_numpy(float), max_iterations)
                for name, values in zip(out.columns, found, strict=True):
                    out.loc[some, name] = values
                at += n
            yield out

    out = each.withColumn("s", solved("years", "amounts", "Price"))
    return out.select("CashflowSeriesPriceID", "CashflowSeriesID", "EffectiveDate", "Price", "s.YieldToMaturity", "s.Iterations", "s.FinalError")


def yield_to_maturity_small_batches(cashflows: DataFrame, prices: DataFrame, max_iterations: int = MAX_ITERATIONS, max_batch_size: int = 1500) -> DataFrame:
    """The same rows; Spark's partitions take the place of batches, so the size has no effect."""
    return yield_to_maturity(cashflows, prices, max_iterations)

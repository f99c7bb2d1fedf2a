"""Tall QR against numpy, batched yields against a loop, and the purge of a log's days."""

from __future__ import annotations

import os
from datetime import date, datetime

import numpy as np
import pytest

from quantloom.operators import matrix, tall_qr, yields
from quantloom.streaming import audit


def test_tall_qr_over_a_tree_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(tall_qr, "ROWS", 7)
    monkeypatch.setattr(tall_qr, "FAN", 3)
    rng = np.random.default_rng(2)
    a = {1: rng.normal(size=(200, 3)) * [1, 1e3, 1e-3], None: rng.normal(size=(4, 4)), 2: np.array([[3.0], [4.0]]), 3: np.column_stack([np.arange(30.0), 2 * np.arange(30.0)])}
    rows = [(k, i, j, float(v)) for k, m in a.items() for i, row in enumerate(m, 1) for j, v in enumerate(row, 1)]
    df = spark.createDataFrame(rows, matrix.ELEMENT)
    parts = {(k, t): np.zeros(m.shape if t == "Q Matrix" else (m.shape[1],) * 2) for k, m in a.items() for t in ("Q Matrix", "R Matrix")}
    for r in tall_qr.tall_qr(df).collect():
        parts[r["MatrixID"], r["Result"]][r["RowNumber"] - 1, r["ColumnNumber"] - 1] = r["Value"]
    for k, m in a.items():
        q, r = parts[k, "Q Matrix"], parts[k, "R Matrix"]
        assert np.allclose(q @ r, m, atol=1e-9 * np.abs(m).max()) and np.allclose(np.tril(r, -1), 0) and (np.diag(r) >= 0).all()
        if k != 3:  # columns of 3 depend on each other
            assert np.allclose(q.T @ q, np.eye(m.shape[1]), atol=1e-10)
    wide = spark.createDataFrame([(9, 1, 1, 1.0), (9, 1, 2, 1.0)], matrix.ELEMENT)
    assert tall_qr.tall_qr(df.unionByName(wide)).count() == 0 and tall_qr.tall_qr(df.limit(0)).count() == 0
    assert tall_qr.tall_qr(wide.unionByName(df.filter("MatrixID = 2")), on_invalid="group").count() == 3


def one_root(years, amounts, price, most=500):
    """The same steps for one price, one after another."""
    x, low, high, best = 1.025, None, None, (np.inf, None)
    for k in range(1, most + 1):
        with np.errstate(all="ignore"):
            powers = x ** -np.asarray(years)
            f, slope = float(np.dot(amounts, powers) - price), float(-np.dot(np.asarray(amounts) * years, powers) / x)
        if not np.isfinite(f):
            return None, k, None
        if abs(f) < best[0]:
            best = abs(f), x
        if abs(f) <= 1e-13 * max(1.0, abs(price)):
            break
        if slope < 0:
            low, high = (x, high) if f > 0 else (low, x)
        ahead = x - f / slope if slope else x / 2
        if ahead <= 0 or (low is not None and ahead < low) or (high is not None and ahead > high):
            ahead = (low + high) / 2 if low is not None and high is not None else x * 2 if low is not None else x / 2
        if ahead == x or (low is not None and high is not None and high - low <= 1e-16 * high):
            break
        x = ahead
    return best[1] - 1, k, best[0]


def test_batched_yields_take_the_steps_of_single_ones():
    rng = np.random.default_rng(4)
    series = [(np.sort(rng.uniform(0.01, 30, n)), rng.uniform(1, 100, n)) for n in rng.integers(1, 40, 300)]
    price = np.array([a.sum() * f for (_, a), f in zip(series, rng.choice([0.05, 0.5, 0.9, 1.0, 1.5, 20.0], 300), strict=True)])
    price[:3] = -5.0, 0.0, 1e9
    length = max(len(t) for t, _ in series)
    found = yields.roots(yields.padded([t for t, _ in series], length), yields.padded([a for _, a in series], length), price)
    for k, ((t, a), p) in enumerate(zip(series, price, strict=True)):
        y, steps, error = one_root(t, a, p)
        if y is None:
            assert np.isnan(found[0][k])
        elif error <= 1e-10 * max(1.0, abs(p)):
            assert found[0][k] == pytest.approx(y, rel=1e-9, abs=1e-9) and abs(int(found[1][k]) - steps) <= 3
    assert np.isfinite(found[0][3:]).mean() > 0.9


def test_series_of_unlike_length_share_a_batch(spark, monkeypatch):
    monkeypatch.setattr(yields, "CELLS", 10)
    flows = [(s, date(2020 + k // 12, k % 12 + 1, 1), 10.0 + s) for s in range(1, 8) for k in range(s * 3)]
    prices = [(s * 10 + k, s, date(2019, 6, 1), (10.0 + s) * s * 3 * f) for s in range(1, 8) for k, f in enumerate((0.8, 0.95))]
    c = spark.createDataFrame(flows, "CashflowSeriesID int, CashflowDate date, Amount double")
    p = spark.createDataFrame(prices, "ID int, CashflowSeriesID int, EffectiveDate date, Price double").coalesce(1)
    got = yields.yield_to_maturity(c, p).collect()
    assert len(got) == 14
    for r in got:
        s = r["CashflowSeriesID"]
        t = [((d - date(2019, 6, 1)).days - 1) / yields.DAYS_A_YEAR for k, d, _ in flows if k == s]
        assert sum((10.0 + s) * (1 + r["YieldToMaturity"]) ** -x for x in t) == pytest.approx(r["Price"], rel=1e-9)


def test_a_purge_leaves_other_days_alone(spark, tmp_path):
    path, summary = str(tmp_path / "log"), str(tmp_path / "summary")
    rows = [(datetime(2024, 1, d, 3), kind, "NT SERVICE\\SQLAgent" if agent else "me") for d in range(1, 7) for kind, agent in (("ALTER_INDEX", True), ("CREATE_TABLE", True), ("ALTER_INDEX", False)) if d != 3 or agent and kind == "ALTER_INDEX"]
    feed = spark.createDataFrame([(f"<EVENT_INSTANCE><EventType>{k}</EventType></EVENT_INSTANCE>", u, t) for t, k, u in rows], "EventXML string, UserName string, LogTimestamp timestamp")
    audit.append_events(feed, path)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if "EventDate" in d}
    before = files()
    assert audit.purge_days(spark, path, summary, last=date(2024, 1, 4), first=date(2024, 1, 2)) == [date(2024, 1, k) for k in (2, 3, 4)]
    after = files()
    for day in (1, 5, 6):
        of = lambda all_files: {k: v for k, v in all_files.items() if f"2024-01-0{day}" in k}  # noqa: B023, E731
        assert of(before) == of(after) and of(before)
    log = spark.read.parquet(path)
    assert log.count() == len(rows) - 3 and log.filter("EventDate = '2024-01-03'").count() == 0
    assert not os.path.exists(f"{path}/EventDate=2024-01-03")
    assert {r["PurgedRecordCount"] for r in spark.read.parquet(summary).collect()} == {1}
    assert audit.purge_days(spark, path, summary, last=date(2024, 1, 4), first=date(2024, 1, 2)) == [] and files() == after
    assert spark.read.parquet(summary).count() == 3
    log.drop("EventDate").write.parquet(str(tmp_path / "flat"))
    with pytest.raises(ValueError):
        audit.purge_days(spark, str(tmp_path / "flat"), summary)

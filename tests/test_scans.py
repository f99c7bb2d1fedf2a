"""Scans over ranges of lists: one list in many partitions, lists within one, ties and nulls, against plain loops."""

from __future__ import annotations

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import interpolation, scans

PAIRS, POINTS = "ListID int, X_Value double, Y_Value double", "ListID int, X_Value double"


@pytest.fixture
def narrow(spark):
    """Many partitions for few rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def lists(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(1, float(x), rng.uniform(-5, 5)) for x in rng.sample(range(10_000), 700)]
    return rows + [(k, float(x), rng.uniform(-5, 5)) for k in (None, 2, 3) for x in rng.sample(range(50), 9)] + [(4, 1.0, 2.0), (5, None, 1.0), (5, 2.0, None)]


def test_one_list_lies_in_many_parts_and_finds_its_followers(narrow):
    rows = [r for r in lists(1) if None not in r[1:]]
    df = narrow.createDataFrame(rows, PAIRS)
    parts = scans.ranged(df, "X_Value").filter("ListID = 1").groupBy(scans.PART).count().collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < 300
    want = set()
    for key in {r[0] for r in rows}:
        of = sorted(r for r in rows if r[0] == key)
        want |= {(*a, *b[1:]) for a, b in zip(of, of[1:], strict=False)}
    assert {tuple(r) for r in scans.with_next(df, "X_Value", "Y_Value").select("ListID", "X_Value", "Y_Value", "x2", "y2").collect()} == want
    numbers = {(r["ListID"], r["X_Value"]): (r["r"], r["n"]) for r in scans.numbered(df, "X_Value").collect()}
    for key in {r[0] for r in rows}:
        of = sorted(r[1] for r in rows if r[0] == key)
        assert [numbers[key, x] for x in of] == [(k, len(of)) for k in range(len(of))]


def test_points_find_the_last_knot_of_any_earlier_part(narrow):
    rng = random.Random(2)
    knots = [(1, float(x)) for x in (-100, 3, 5000, 5001)] + [(None, 7.0), (2, 1.0)]
    points = [(rng.choice([1, 1, 1, None, 3]), float(rng.randint(-200, 9000))) for _ in range(900)] + [(1, 5000.0)] * 50 + [(None, 7.0), (2, 0.5)]
    found = scans.last_at_or_before(
        narrow.createDataFrame(points, POINTS).repartition(5), narrow.createDataFrame(knots, "ListID int, x double").withColumn("knot", F.struct("x"))
    ).collect()
    assert len(found) == len(points)
    for r in found:
        of = sorted(x for k, x in knots if k == r["ListID"])
        at = bisect.bisect_right(of, r["X_Value"])
        assert (r["knot"]["x"] if r["knot"] else None) == (of[at - 1] if at else None)


def test_interpolation_of_a_long_list(narrow):
    rows = [r for r in lists(3) if None not in r[1:]]
    pairs = narrow.createDataFrame(rows, PAIRS)
    rng = random.Random(4)
    points = [(rng.choice([1, 1, None, 2, 4]), rng.uniform(-100, 10_100)) for _ in range(500)]
    got = sorted(map(tuple, interpolation.interpolate(pairs, narrow.createDataFrame(points, POINTS), "PL", "F").collect()), key=str)
    want = []
    for key, x in points:
        of = sorted((a, b) for k, a, b in rows if k == key)
        if len(of) > 1:
            want.append((key, x, float(np.interp(x, *zip(*of, strict=True)))))
    want.sort(key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    plan = interpolation.interpolate(pairs, narrow.createDataFrame(points, POINTS), "CSN", "L")._jdf.queryExecution().executedPlan().toString()
    assert all(scans.PART in line for line in plan.splitlines() if "hashpartitioning(ListID" in line and "Window" in line)


def test_splines_of_lists_in_parts_are_those_of_lists_whole(narrow, spark):
    pairs = narrow.createDataFrame(lists(5), PAIRS)
    got = sorted(map(tuple, interpolation.cubic_spline(pairs, chunk=64, margin=40).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    want = sorted(map(tuple, interpolation.cubic_spline(pairs).collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-8)


def test_scans_of_empty_tables(narrow):
    empty = narrow.createDataFrame([], PAIRS)
    assert scans.with_next(empty, "X_Value", "Y_Value").count() == scans.numbered(empty, "X_Value").count() == 0
    assert interpolation.interpolate(empty, narrow.createDataFrame([(1, 1.0)], POINTS), "CSN").count() == 0


KERNEL_OF = {
    "Uniform": lambda u: 0.5 + 0 * u, "Triangular": lambda u: 1 - abs(u), "Parabolic": lambda u: 0.75 * (1 - u * u), "Quartic": lambda u: 15 / 16 * (1 - u * u) ** 2,
    "Triweight": lambda u: 35 / 32 * (1 - u * u) ** 3, "Tricube": lambda u: 70 / 81 * (1 - abs(u) ** 3) ** 3, "Cosine": lambda u: np.pi / 4 * np.cos(np.pi / 2 * u),
}


@pytest.mark.parametrize("kernel", ["Tricube", "Cosine", "Uniform"])
def test_moving_moments_are_the_sums_over_all_neighbours(narrow, kernel):
    rng = np.random.default_rng(3)
    x = np.unique(np.round(np.concatenate([1e4 + rng.uniform(0, 6, 300), 1e4 + 3 + rng.uniform(0, 0.5, 300), [1e4 + 20, 1e4 + 21.3, 1e4 + 21.9]]), 6))
    y = np.sin(x) + rng.normal(size=len(x))
    df = narrow.createDataFrame([(7, float(a), float(b)) for a, b in zip(x, y, strict=True)], PAIRS)
    got = {r["X_Value"]: r["Y_Value"] for r in interpolation.local_polynomial_regression(df, kernel, 1.25, 2).collect()}
    want = {}
    for at in x:
        u = (x - at) / 1.25
        near = abs(u) < 1
        if near.sum() >= 3:
            w, v = KERNEL_OF[kernel](u[near]), np.vander(u[near], 3, increasing=True)
            want[at] = np.linalg.solve((v.T * w) @ v, (v.T * w) @ y[near])[0]
    assert set(got) == set(want) and len(want) < len(x)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6

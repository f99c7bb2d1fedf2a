"""Normal to lognormal volatility: Newton's steps against halving, also where only halving ends, and the plan's work."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantloom import sql
from quantloom.functions import scalar


def test_newton_and_halving_agree(spark):
    sql.register(spark)
    rows = [(x, f, k, t) for x in (0.0, 1e-6, 0.01, 0.2, 0.75, 1.5, 3.0, 8.0) for f, k in ((1.0, 1.0), (1.0, 1.0005), (0.009, 0.0087), (100.0, 40.0), (1.0, 1e6)) for t in (0.01, 1.0, 9.0)]
    rows += [(None, 1.0, 1.0, 1.0), (0.2, -1.0, 1.0, 1.0), (0.2, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, f double, k double, t double")
    df = df.withColumn("v", scalar.lognormal_to_normal_volatility(*map(F.col, "xfkt")))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scalar, "NEWTON_STEPS", 1)  # one step meets a root only where the denominator is 1
        halved = df.select(scalar.normal_to_lognormal_volatility(*map(F.col, "vfkt")))
    got = df.select("x", "f", "k", "t", "v", scalar.normal_to_lognormal_volatility(*map(F.col, "vfkt")).alias("y"), F.expr("normal_to_lognormal_volatility(v, f, k, t)").alias("z")).collect()
    for r, (h,) in zip(got, halved.collect(), strict=True):
        assert (r["y"] is None) == (r["z"] is None)
        if h is not None:
            assert r["y"] == pytest.approx(h, rel=1e-7, abs=1e-12) and r["z"] == pytest.approx(h, rel=1e-7, abs=1e-12)
        if r["y"] is not None:  # the smallest of the volatilities with this normal one
            assert r["y"] <= r["x"] * (1 + 1e-6) + 1e-12
    assert got[-1]["y"] is None and got[-2]["y"] is None and got[-3]["y"] is None


def test_newton_alone_gives_the_usual_range(spark):
    """Without the halving (no power of two is tried, no step made) the usual volatilities are still found: they do not pay for 60 steps."""
    df = spark.range(1, 200).select((0.1 + F.col("id") / 300).alias("x"), (F.col("id") * 1.0).alias("f"), (F.col("id") * (0.8 + F.col("id") % 5 / 10)).alias("k"), (F.col("id") / 100).alias("t"))
    v = df.withColumn("v", scalar.lognormal_to_normal_volatility(*map(F.col, "xfkt")))
    out = v.select("x", scalar.normal_to_lognormal_volatility(*map(F.col, "vfkt"), steps=1).alias("y")).collect()
    assert all(r["y"] == pytest.approx(r["x"], rel=1e-12) for r in out)

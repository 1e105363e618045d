"""p-values of the stationarity tests at published quantiles and by simulation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import series as ts

SHARES = (0.01, 0.05, 0.10)


@pytest.mark.parametrize("trend", ["none", "constant", "trend"])
def test_dickey_fuller(spark, trend):
    stats = list(ts.DF_CRITICAL[trend]) + [-25.0, -1.0, 0.0, 5.0]
    rows = spark.createDataFrame([(float(x),) for x in stats], "s double").select("s", ts._df_surface(F.col("s"), trend).alias("p")).collect()
    got = {r.s: r.p for r in rows}
    for x, p in zip(ts.DF_CRITICAL[trend], SHARES):
        assert got[x] == pytest.approx(p, abs=0.005)
    assert got[-25.0] == 0 and got[-1.0] < got[0.0] < got[5.0] <= 1


@pytest.mark.parametrize("trend", ["constant", "trend"])
def test_kpss(trend):
    # the published points come from a simulation; that of 5 percent with a trend has 0.0523 here
    assert ts.kpss_tail(np.array(ts.KPSS_CRITICAL[trend]), trend) == pytest.approx(SHARES, abs=0.005)
    rng, n = np.random.default_rng(0), 400
    z = np.stack([np.ones(n), np.arange(n)])[:1 if trend == "constant" else 2]
    e = rng.normal(size=(4000, n))
    e -= e @ z.T @ np.linalg.inv(z @ z.T) @ z
    limit = (np.cumsum(e, axis=1) ** 2).sum(1) / n ** 2 / e.var(axis=1)
    for q in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert ts.kpss_tail(np.quantile(limit, q), trend) == pytest.approx(1 - q, abs=0.03)
    p = ts.kpss_tail(np.array([0.0, 0.005, 0.05, 0.2, 1.0, 5.0]), trend)
    assert (np.diff(p) <= 1e-9).all() and p[0] > 0.99 and p[-1] < 1e-6


def test_option(spark):
    x = np.random.default_rng(2).normal(size=200)
    rows = [(k, i * 3600, float(v), i + 1) for k, vs in {"noise": x, "walk": np.cumsum(x)}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double, seq long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for test, rejected in (("ADF", "noise"), ("PP", "noise"), ("KPSS", "walk")):
        p = {r.series_id: r for r in ts.stationarity_test(df, test, 2, p_values="asymptotic").collect()}
        assert p[rejected].p_value < 0.01
        # the p-value and the verdict by the critical value agree
        assert all((r.p_value < 0.05) == ((r.verdict == "Stationary") == (test != "KPSS")) for r in p.values())
    with pytest.raises(ValueError):
        ts.stationarity_test(df, p_values="other")

"""ARIMA by conditional sums of squares, against the plain recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import arima
from cairn.plans.innovations import _block, _Filter, _weights


def simulated(n, phi, theta, seed):
    e, x = np.random.default_rng(seed).normal(size=n + 50), np.zeros(n + 50)
    for t in range(1, n + 50):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    return x[50:] + 7


def innovations(x, c, ar, ma):
    """e by its definition; ``ar`` and ``ma`` map lags to coefficients."""
    first, e = max(ar, default=0), np.zeros(len(x))
    for t in range(first, len(x)):
        e[t] = x[t] - c - sum(v * x[t - k] for k, v in ar.items()) - sum(v * e[t - k] for k, v in ma.items() if t - k >= first)
    return e[first:]


def frame(spark, series):
    rows = [(k, i * 3600, float(v), i + 1) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, t long, value double, seq long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.fixture
def bound(spark, request):
    spark.conf.set("spark.cairn.taskRows", request.param)
    yield
    spark.conf.unset("spark.cairn.taskRows")


@pytest.mark.parametrize("theta", [{1: 0.5}, {1: -0.4, 2: 0.3}, {3: 0.6}, {70: 0.5}, {}])
def test_filter(theta):
    x, got, lags = np.random.default_rng(2).normal(size=(500, 3)), [], np.zeros((max(theta, default=0), 3))
    for part in np.array_split(x, [1, 5, 200, 333]):
        out, lags = _Filter(theta)(part, lags)
        got.append(out)
    for c in range(3):
        assert np.allclose(np.concatenate(got)[:, c], innovations(x[:, c], 0, {}, theta))


def test_blocks_chain_to_the_whole():
    rng = np.random.default_rng(4)
    x, z, ma, beta = rng.normal(size=700), rng.normal(size=(700, 2)), [1, 3], np.array([0.2, 0.5, -0.1, 0.4, 0.2])
    whole, _ = _block(x, z, beta, ma)
    starts, total = np.zeros((3, 6)), 0
    for at in np.split(np.arange(700), [1, 2, 100, 450]):
        gram, last = _block(x[at], z[at], beta, ma)
        w = _weights(starts, ma, 5)
        total, starts = total + w.T @ gram @ w, last @ w
    assert np.allclose(total, whole[:6, :6])
    step = 1e-6
    def e(b):
        y, out = x - b[0] - z @ b[1:3], np.zeros(700)
        for t in range(700):
            out[t] = y[t] - (b[3] * out[t - 1] if t >= 1 else 0) - (b[4] * out[t - 3] if t >= 3 else 0)
        return out
    slopes = np.array([(e(beta + step * u) - e(beta - step * u)) / (2 * step) for u in np.eye(5)])
    assert np.allclose(whole[0, 0], (e(beta) ** 2).sum()) and np.allclose(whole[0, 1:6], slopes @ e(beta), atol=1e-4) and np.allclose(whole[1:6, 1:6], slopes @ slopes.T, rtol=1e-5)


@pytest.mark.parametrize("order, bound", [((0, 0, 1), "2000000"), ((1, 0, 1), "90"), ((2, 0, 2), "200")], indirect=["bound"])
def test_least_sum_of_squares(spark, bound, order):
    series = {"a": simulated(500, 0.5, 0.7, 1), "b": simulated(400, 0.0, -0.9, 2), "c": simulated(300, 0.8, 0.2, 3)}
    df, (p, _, q) = frame(spark, series), order

    def numbers(method):
        out = {k: {} for k in series}
        for r in arima.arima_estimate(df, order, fit_method=method).collect():
            out[r["series_id"]][r["name"]] = r["value"]
        return out

    def squares(x, m):
        ar, ma = ({k: m[f"{n}({k})"] for k in range(1, top + 1)} for n, top in (("AR", p), ("MA", q)))
        return innovations(x, m["Intercept"], ar, ma)

    best, start = numbers("CSS"), numbers("HR")
    fitted = {}
    for r in arima.arima_fitted(df, order, fit_method="CSS").collect():
        fitted.setdefault(r["series_id"], {})[r["seq"]] = r["residual"]
    ahead = {}
    for r in arima.arima_forecast(df, order, periods=4, fit_method="CSS").collect():
        ahead.setdefault(r["series_id"], {})[r["step"]] = r["forecast_value"]
    for k, x in series.items():
        e = squares(x, best[k])
        assert np.isclose((e ** 2).mean(), best[k]["Sigma2"], rtol=1e-7) and (e ** 2).sum() <= (squares(x, start[k]) ** 2).sum() * (1 + 1e-9)
        assert np.allclose([fitted[k][i + 1 + p] for i in range(len(e))], e, atol=1e-8)
        for name in [n for n in best[k] if "(" in n]:
            for move in (-0.01, 0.01):
                assert (squares(x, {**best[k], name: best[k][name] + move}) ** 2).sum() >= (e ** 2).sum() * (1 - 1e-7)
        x, e = list(x), list(e)
        for step in range(1, 5):
            v = best[k]["Intercept"] + sum(best[k][f"AR({j})"] * x[-j] for j in range(1, p + 1)) + sum(best[k][f"MA({j})"] * e[-j] for j in range(1, q + 1))
            assert np.isclose(ahead[k][step], v)
            x.append(v), e.append(0.0)


def test_no_rows_and_unknown_method(spark):
    df = frame(spark, {"a": [1.0, 2.0]}).filter("false")
    assert arima.arima_estimate(df, (1, 0, 1), fit_method="CSS").count() == 0
    with pytest.raises(ValueError):
        arima.arima_estimate(df, (1, 0, 1), fit_method="ML")

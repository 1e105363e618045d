"""Cross-validation by sums against refits of each fold in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import selection as ms, validation as vd


def frame(spark, series):
    rows = [(k, float(v), i + 1) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, value double, seq long")


def features(x, model, h, period):
    """Target offset and feature rows by their definition, nan where a lag is missing."""
    n, season = len(x), period * -(-h // period)
    lag = lambda k: np.concatenate([np.full(min(k, n), np.nan), x[:max(n - k, 0)]])
    one = np.ones(n)
    if model == "seasonal_ar":
        return 0 * x, [one, lag(h), lag(season + h)]
    if model == "ar2":
        return 0 * x, [one, lag(h), lag(h + 1)]
    if model == "ari2":
        return lag(h), [one, lag(h) - lag(h + 1), lag(h + 1) - lag(h + 2)]
    if model == "holt":
        level, slope, out = x[0], 0.0, np.full(n, np.nan)
        for t in range(n):
            if t > 0 and t + h - 1 < n:
                out[t + h - 1] = level + h * slope
            e = x[t] - level - slope
            level, slope = level + slope + 0.3 * e, slope + 0.03 * e
        return out, None
    raise ValueError(model)


def fold_parts(n, method, folds, size, windows):
    at = np.arange(1, n + 1)
    for f in range(1, folds + 1):
        cut = n - size * (folds + 1 - f)
        if method == "blocked":
            test = (at - 1) * folds // n + 1 == f
            yield f, ~test, test
        else:
            low = -np.inf if method == "rolling" else cut - windows * size
            yield f, (at > low) & (at <= cut), (at > cut) & (at <= cut + size)


def plain(x, model, method, h, folds=4, size=10, windows=3, period=6):
    x = x - x.mean()
    offset, z = features(x, model, h, period)
    z = np.array(z).T if z is not None else np.zeros((len(x), 0))
    ok = ~np.isnan(offset) & ~np.isnan(z).any(1)
    for f, train, test in fold_parts(len(x), method, folds, size, windows):
        train, test = train & ok, test & ok
        coef = np.linalg.lstsq(z[train], (x - offset)[train], rcond=None)[0]
        e = x - offset - z @ coef
        yield f, (train.sum(), np.sqrt((e[train] ** 2).mean()), test.sum(), np.sqrt((e[test] ** 2).mean()), np.abs(e[test]).mean())


@pytest.mark.parametrize("method, h, bound", [("rolling", 1, "2000000"), ("sliding", 3, "17"), ("blocked", 7, "30")])
def test_same_as_refits(spark, method, h, bound):
    rng = np.random.default_rng(h)
    series = {"a": 50 + np.cumsum(rng.normal(size=120)), None: 3 * np.sin(np.arange(90)) + rng.normal(size=90)}
    models = ("ar2", "ari2", "seasonal_ar", "holt")
    spark.conf.set("spark.cairn.taskRows", bound)
    try:
        got = vd.cross_validate_models(frame(spark, series), models, method, 4, 10, h, 3, 6).collect()
    finally:
        spark.conf.unset("spark.cairn.taskRows")
    got = {(r.series_id, r.model, r.fold): r for r in got}
    assert len(got) == 2 * len(models) * 4
    for k, x in series.items():
        for m in models:
            for f, want in plain(x, m, method, h):
                r = got[k, m, f]
                assert (r.train_n, r.train_rmse, r.test_n, r.test_rmse, r.test_mae) == pytest.approx(want, rel=1e-7), (k, m, f)
                assert r.gap == pytest.approx(want[3] - want[1]) and r.overfit == int(want[3] > 1.5 * want[1])


def test_short_and_empty_series(spark):
    series = {"short": [1.0, 5.0, 2.0, 4.0], "twelve": [1.0, 2.0] * 6, "one": [3.0], "flat": [2.0] * 60}
    got = vd.cross_validate_models(frame(spark, series), folds=3, test_size=10, period=4).collect()
    assert {r.series_id for r in got} == {"twelve", "flat"}
    assert {(r.model, r.train_n) for r in got if r.series_id == "twelve"} == {("mean", 2), ("naive", 1)}
    assert all(abs(r.test_rmse) < 1e-9 for r in got if r.series_id == "flat") and all(r.train_n > 0 and r.test_n > 0 for r in got)
    assert vd.cross_validate_models(frame(spark, series).limit(0)).count() == 0
    for bad in ({"models": ("arx",)}, {"method": "other"}):
        with pytest.raises(ValueError):
            vd.cross_validate_models(frame(spark, series), **bad)


def test_the_model_that_made_the_data_wins(spark):
    rng, x = np.random.default_rng(1), np.zeros(2000)
    for t in range(2, 2000):
        x[t] = 0.5 * x[t - 1] - 0.6 * x[t - 2] + rng.normal()
    df = frame(spark, {"a": x})
    scores = {r.model: r for r in vd.cv_scores(vd.cross_validate_models(df, ("mean", "naive", "linear_trend", "ar1", "ar2", "ses"), folds=5, test_size=100)).collect()}
    assert scores["ar2"].cv_rmse_rank == scores["ar2"].cv_mae_rank == 1 and 0.95 < scores["ar2"].cv_rmse < 1.05
    both = vd.select_by_cv(ms.candidate_forecasts(df, ("naive", "linear_trend", "ses")), vd.cross_validate_models(df, ("naive", "linear_trend", "ses", "ar2")))
    assert {r.model for r in both.collect()} == {"naive", "linear_trend", "ses"}

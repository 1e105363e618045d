"""Cross-validation of series models by sums.

The rows of a series fall into buckets, and the training part of a fold is a set of
buckets. A linear model needs nothing but the cross products of each bucket: those of a
fold are sums over its buckets, so all refits of all models and folds come from one pass
over the rows, and a second pass takes the errors of the test parts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.expr import all_of, flag
from cairn.operators.selection import S, _state_space, minmax_score, model_metrics
from cairn.operators.series import centred
from cairn.plans.lineage import written
from cairn.plans.linear import dot, solve_row, unpack
from cairn.plans.ordered import attach, null_safe_join, sliding
from cairn.plans.recurrence import affine_scan

__all__ = ["cross_validate_models", "cv_scores", "select_by_cv"]

SMOOTHING = {"ses": ("alpha",), "holt": ("alpha", "beta"), "holt_winters_add": ("alpha", "beta", "gamma", "period")}


def _model(name: str, h: int, period: int):
    """(lags, offset, features) of a linear model; (lags, offset, None) of one that
    is not fitted. Column ``lK`` is the value K rows back, ``u`` the scaled position."""
    season = period * -(-h // period)
    p = re.fullmatch(r"(ari?)([1-9]\d*)", name)
    lag = lambda k: F.col(f"l{k}")
    if name == "mean":
        return [], F.lit(0.0), [F.lit(1.0)]
    if name == "linear_trend":
        return [], F.lit(0.0), [F.lit(1.0), F.col("u")]
    if name == "naive":
        return [h], lag(h), None
    if name == "seasonal_naive":
        return [season], lag(season), None
    if name == "seasonal_ar":
        return [h, season + h], F.lit(0.0), [F.lit(1.0), lag(h), lag(season + h)]
    if name in SMOOTHING:
        return [], F.col(f"f_{name}"), None
    if p:
        ks = list(range(h, h + int(p[2])))
        if p[1] == "ar":
            return ks, F.lit(0.0), [F.lit(1.0), *map(lag, ks)]
        return [*ks, ks[-1] + 1], lag(h), [F.lit(1.0), *[lag(k) - lag(k + 1) for k in ks]]
    raise ValueError(name)


def _folds(method: str, folds: int, test_size: int, windows: int):
    """Bucket of a row, whether it takes part, and the folds a bucket trains."""
    b, p = F.col("bucket"), F.col("n") - test_size * folds
    late = F.ceil((F.col("seq") - p) / F.lit(test_size)).cast("int")
    upto = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi))
    if method == "rolling":
        return F.greatest(late, F.lit(0)), F.lit(True), upto(b + 1, F.lit(folds))
    if method == "sliding":
        return late, b > -windows, upto(F.greatest(b + 1, F.lit(1)), F.least(b + windows, F.lit(folds)))
    if method == "blocked":
        return (F.floor((F.col("seq") - 1) * folds / F.col("n")) + 1).cast("int"), F.lit(True), F.array_remove(F.sequence(F.lit(1), F.lit(folds)), b)
    raise ValueError(method)


def _smoothed(df, name, h, params):
    """Forecasts of a smoothing model from the state ``h`` rows before."""
    A, g, start, out = _state_space(*[params[p] for p in SMOOTHING[name]])
    ahead = out @ np.linalg.matrix_power(A + np.outer(g, out), h - 1)
    r = affine_scan(df, S, A, g, start, before=ahead).select(*S, "seq", F.when(F.col("seq") > 1, F.col("__before")).alias("__f"))
    return sliding(r, S, lambda w: {f"f_{name}": F.lag("__f", h - 1).over(w)}, before=h - 1).drop("__f") if h > 1 else r.withColumnRenamed("__f", f"f_{name}")


def cross_validate_models(df: DataFrame, models=("mean", "naive", "seasonal_naive", "linear_trend", "ar1", "ari1"), method="rolling", folds=5, test_size=24,
                          step_ahead=1, windows=4, period=24, alpha=0.3, beta=0.1, gamma=0.1) -> DataFrame:
    """Errors of the named models by fold: (series_id, model, fold, train_n, train_rmse,
    test_n, test_rmse, test_mae, gap, overfit). A row is forecast from the rows at least
    ``step_ahead`` before it.

    Models: mean, linear_trend, arP (P values), ariP (P differences, for the change over
    ``step_ahead`` rows), seasonal_ar (the last value and the one a period before it) are fitted
    anew for each fold by least squares, directly for the step; naive, seasonal_naive
    and the smoothing models ses, holt, holt_winters_add with given weights have no
    parameter to fit.

    Methods: ``rolling`` trains on all rows before the test part, ``sliding`` on the last
    ``windows`` times ``test_size`` of them; the test parts are the last ``folds`` times
    ``test_size`` rows. ``blocked`` tests each of ``folds`` equal parts and trains on all
    other rows, later ones too. Rows without all lags take no part; a fold without test rows,
    or with no more training rows than the model has coefficients, has no row."""
    specs = {m: _model(m, step_ahead, period) for m in models}
    bucket, used, trains = _folds(method, folds, test_size, windows)
    rows = centred(df, name="__c", keep_n=True).withColumnRenamed("__n", "n")
    rows = rows.select(*S, "seq", F.col("n").cast("bigint").alias("n"), F.col("__c").alias("value"))
    smooth = [m for m in models if m in SMOOTHING]
    if smooth:
        rows = written(rows)
    lags = sorted({k for ks, *_ in specs.values() for k in ks})
    base = sliding(rows, S, lambda w: {f"l{k}": F.lag("value", k).over(w) for k in lags}, before=max(lags)) if lags else rows
    for m in smooth:
        params = {"alpha": alpha, "beta": beta, "gamma": gamma, "period": period}
        base = null_safe_join(base, _smoothed(rows.select(*S, "seq", "value"), m, step_ahead, params), S + ["seq"], "left")
    base = base.withColumns({"u": F.col("seq") / F.col("n"), "bucket": bucket}).filter(used)
    y, fits = F.col("value"), {m: s for m, s in specs.items() if s[2] is not None}
    columns = {}
    for m, (_, offset, xs) in specs.items():
        if xs is None:
            e = y - offset
            columns[m] = {"n": F.count(e), "g0": F.sum(e * e)}
        else:
            z = [*xs, y - offset]
            ok = all_of([c.isNotNull() for c in z])
            pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
            columns[m] = {"n": F.count(F.when(ok, 1)), **{f"g{k}": F.sum(F.when(ok, z[i] * z[j])) for k, (i, j) in enumerate(pairs)}}
    place = {m: i for i, m in enumerate(models)}
    base = written(base)
    parts = base.groupBy(*S, "n", "bucket").agg(*[c.alias(f"{k}_{place[m]}") for m, cs in columns.items() for k, c in cs.items()])
    train = parts.withColumn("fold", F.explode(trains)).groupBy(*S, "n", "fold").agg(
        *[F.sum(f"{k}_{place[m]}").alias(f"{k}_{place[m]}") for m, cs in columns.items() for k in cs])

    @F.pandas_udf("struct<coef:array<double>,sse:double>")
    def solve(sums: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for z, c in zip(sums, n):
            k = int((np.sqrt(8 * len(z) + 1) - 1) / 2)
            coef, _, sse, _ = solve_row(unpack(z, k), c, 0.0) if c >= k else (None, None, None, None)
            out.append((coef, sse))
        return pd.DataFrame(out, columns=["coef", "sse"])

    for m, i in place.items():
        if m in fits:
            sums = F.array(*[F.coalesce(F.col(f"{k}_{i}"), F.lit(0.0)) for k in columns[m] if k != "n"])
            train = train.withColumn(f"s_{i}", solve(sums, F.col(f"n_{i}").cast("double")))
        else:
            train = train.withColumn(f"s_{i}", F.struct(F.lit(None).cast("array<double>").alias("coef"), F.when(F.col(f"n_{i}") > 0, F.col(f"g0_{i}")).alias("sse")))
    train = written(train.select(*S, "n", "fold", *[f"{c}_{i}" for i in place.values() for c in ("n", "s")]))
    test = attach(base.filter(F.col("bucket") >= 1).withColumnRenamed("bucket", "fold").drop("n"), train, S + ["fold"], "n")
    sums = []
    for m, (_, offset, xs) in specs.items():
        i = place[m]
        e = y - offset
        if xs is not None:
            e = F.when(F.col(f"s_{i}.coef").isNotNull(), e - dot(f"s_{i}.coef", xs))
        sums += [F.count(e).alias(f"c_{i}"), F.sum(e * e).alias(f"e_{i}"), F.sum(F.abs(e)).alias(f"a_{i}")]
    errors = null_safe_join(test.groupBy(*S, "fold").agg(*sums), train, S + ["fold"])
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"n_{i}").alias("train_n"), F.col(f"s_{i}.sse").alias("sse"), F.col(f"c_{i}").alias("test_n"),
                              F.col(f"e_{i}").alias("e"), F.col(f"a_{i}").alias("a")) for m, i in place.items()])
    out = errors.select(*S, "fold", F.explode(each).alias("r")).select(*S, "fold", "r.*").filter("sse IS NOT NULL AND test_n > 0")
    out = out.select(*S, "model", "fold", "train_n", F.sqrt(F.col("sse") / F.col("train_n")).alias("train_rmse"), "test_n",
                     F.sqrt(F.col("e") / F.col("test_n")).alias("test_rmse"), (F.col("a") / F.col("test_n")).alias("test_mae"))
    return out.withColumns({"gap": F.col("test_rmse") - F.col("train_rmse"), "overfit": flag(F.col("test_rmse") > 1.5 * F.col("train_rmse"))})


def cv_scores(cv: DataFrame) -> DataFrame:
    """Errors over all test rows of a model, spread over the folds, and ranks in
    the series by either error (equal ones by name)."""
    n = F.sum("test_n")
    g = cv.groupBy(*S, "model").agg(
        F.count(F.lit(1)).alias("folds"), F.sqrt(F.sum(F.col("test_n") * F.pow("test_rmse", 2)) / n).alias("cv_rmse"), (F.sum(F.col("test_n") * F.col("test_mae")) / n).alias("cv_mae"),
        F.avg("gap").alias("mean_gap"), F.sum("overfit").alias("overfit_folds"), (1 - F.stddev("test_rmse") / F.nullif(F.avg("test_rmse"), F.lit(0.0))).alias("stability"))
    w = Window.partitionBy(*S)  # one row per model
    return g.withColumns({f"{c}_rank": F.row_number().over(w.orderBy(F.round(c, 9), "model")) for c in ("cv_rmse", "cv_mae")})


CV_WEIGHTS = {"aic": -0.25, "bic": -0.2, "cv_rmse": -0.3, "cv_mae": -0.15, "adjusted_r2": 0.1}


def select_by_cv(fitted: DataFrame, cv: DataFrame, weights=None) -> DataFrame:
    """Models by in-sample criteria (``model_metrics`` of ``fitted``) and errors of
    cross-validation together: composite score and rank in the series. A model
    must be in both."""
    both = null_safe_join(model_metrics(fitted), cv_scores(cv).select(*S, "model", "cv_rmse", "cv_mae"), S + ["model"])
    return minmax_score(both, weights or CV_WEIGHTS, S, name="composite")

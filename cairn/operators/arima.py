"""ARIMA models for many series by the Hannan-Rissanen method, refined by
conditional sums of squares if ``fit_method`` is CSS.

Estimation HR is conditional least squares, all from aggregated cross products:
(1) a long autoregression gives residuals, (2) the series is regressed on
its own lags and the lags of those residuals. For pure AR models step 2 alone
is exact conditional least squares. CSS goes on from there by Gauss-Newton steps
to the least sum of squares of the model's own innovations. AIC = n ln(sigma2) + 2k and BIC are
conditional likewise. No series is gathered into one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_gt, normal_cdf, pct, rnd, tally
from cairn.operators import series as ts
from cairn.plans.innovations import css_fit, css_innovations
from cairn.plans.linear import cross_products, dot, ols, solve_row, unpack
from cairn.plans.ordered import attach, null_safe_join, sequence, sliding
from cairn.plans.lineage import cut_lineage, written

S = ["series_id"]


def _difference(df, d, seasonal):
    _, D, _, m = seasonal
    w = ts.diff(df, d, D, m or 1, name="w", reseq=True)
    return w.withColumnRenamed("value", "y").withColumnRenamed("w", "value")


def _lagged(p, q, seasonal):
    """Names and lags of the regressors."""
    P, _, Q, m = seasonal
    ar = [(f"AR({k})", k) for k in range(1, p + 1)] + [(f"SAR({k})", k * m) for k in range(1, P + 1)]
    ma = [(f"MA({k})", k) for k in range(1, q + 1)] + [(f"SMA({k})", k * m) for k in range(1, Q + 1)]
    return ar, ma


def _regressors(df, p, d, q, seasonal, long_order=None):
    """Centred (differenced) series with its lags and residual lags."""
    ar, ma = _lagged(p, q, seasonal)
    rows = _difference(df, d, seasonal)
    mean = rows.groupBy(*S).agg(F.avg("value").alias("mu"), F.max("seq").alias("__n"))
    rows = attach(rows, mean, S, "__n", keep_length=True).withColumn("x", F.col("value") - F.col("mu"))
    reach = max([k for _, k in ar], default=0)
    if ma:
        long = long_order or max(10, max(k for _, k in ma) + p + 2)
        rows = sliding(rows, S, lambda w: {f"__a{k}": F.lag("x", k).over(w) for k in range(1, long + 1)}, before=long)
        xs = [F.lit(1.0)] + [F.col(f"__a{k}") for k in range(1, long + 1)]
        fit = null_safe_join(ols(rows, S, F.col("x"), xs).select(*S, F.col("coef").alias("__c")), mean.select(*S, "__n"), S)
        rows = attach(rows.drop("__n"), fit, S, "__n", keep_length=True)
        rows = rows.withColumn("e", F.col("x") - dot("__c", xs)).drop("__c", *[f"__a{k}" for k in range(1, long + 1)])
        reach = max(reach, max(k for _, k in ma))
    def lags(w):
        return {**{n: F.lag("x", k).over(w) for n, k in ar}, **{n: F.lag("e", k).over(w) for n, k in ma}}
    if ar or ma:
        rows = sliding(rows, S, lags, before=reach)
    return rows, [n for n, _ in ar + ma]


def _estimate(df, order, seasonal, fit_method="HR"):
    p, d, q = order
    if fit_method not in ("HR", "CSS"):
        raise ValueError(f"fit_method {fit_method!r} is neither HR nor CSS")
    rows, names = _regressors(df, p, d, q, seasonal)
    xs = [F.lit(1.0)] + [F.col(f"`{n}`") for n in names]
    fit = ols(rows, S, F.col("x"), xs)
    if fit_method == "CSS":
        rows = written(rows)
        ar, ma = _lagged(p, q, seasonal)
        fit = css_fit(rows, S, ols(rows, S, F.col("x"), xs).select(*S, "coef"), "x", [n for n, _ in ar], [k for _, k in ma])
    return rows, names, xs, fit


def arima_fitted(df: DataFrame, order=(1, 0, 0), seasonal=(0, 0, 0, 0), fit_method="HR") -> DataFrame:
    """(series_id, ts, seq, fitted_value, residual) on the original scale."""
    rows, names, xs, fit = _estimate(df, order, seasonal, fit_method)
    if fit_method == "CSS":
        ar, ma = _lagged(order[0], order[2], seasonal)
        e = css_innovations(rows, S, fit, "x", [n for n, _ in ar], [k for _, k in ma], "residual")
        out = null_safe_join(rows, e, S + ["seq"])
        reach = order[1] + seasonal[1] * seasonal[3]
        return out.select(*S, "ts", (F.col("seq") + reach).alias("seq"), F.col("y").alias("value"), (F.col("y") - F.col("residual")).alias("fitted_value"), "residual")
    length = rows.groupBy(*S).agg(F.max("seq").alias("__n"))
    fit = null_safe_join(fit.select(*S, F.col("coef").alias("__c")), length, S)
    out = attach(rows.drop("__n"), fit, S, "__n").withColumn("residual", F.col("x") - dot("__c", xs))
    out = out.filter(F.col("residual").isNotNull())
    reach = order[1] + seasonal[1] * seasonal[3]
    return out.select(*S, "ts", (F.col("seq") + reach).alias("seq"), F.col("y").alias("value"),
                      (F.col("y") - F.col("residual")).alias("fitted_value"), "residual")


def arima_estimate(df: DataFrame, order=(1, 0, 0), seasonal=(0, 0, 0, 0), fit_method="HR") -> DataFrame:
    """Long rows (series_id, result_type, name, value, std_error): the
    coefficients and the fit statistics of each series."""
    rows, names, xs, fit = _estimate(df, order, seasonal, fit_method)
    mu = rows.groupBy(*S).agg(F.first("mu").alias("mu"))
    f = null_safe_join(fit, mu, S)
    ar_at = [i + 2 for i, n in enumerate(names) if "AR(" in n]
    share = F.lit(1.0)
    for i in ar_at:
        share = share - F.element_at("coef", i)
    icept = F.element_at("coef", 1) + F.col("mu") * share
    n, k = F.col("n"), len(names) + 1
    s2 = F.col("sse") / n
    stats = {"Sigma2": s2, "AIC": n * F.ln(s2) + 2 * k, "BIC": n * F.ln(s2) + F.ln(n) * k,
             "LogLikelihood": -n / 2.0 * (F.ln(2 * math.pi * s2) + 1.0), "RMSE": F.sqrt(s2), "N": n.cast("double")}
    cell = lambda kind, name, v, se=None: F.struct(F.lit(kind).alias("result_type"), F.lit(name).alias("name"), v.alias("value"),
                                                   (F.lit(None).cast("double") if se is None else se).alias("std_error"))
    cells = [cell("Coefficients", "Intercept", icept, F.element_at("se", 1))]
    cells += [cell("Coefficients", m, F.element_at("coef", i + 2), F.element_at("se", i + 2)) for i, m in enumerate(names)]
    cells += [cell("FitStatistics", m, v) for m, v in stats.items()]
    return f.select(*S, F.explode(F.array(*cells)).alias("c")).select(*S, "c.*")


def arima_forecast(df: DataFrame, order=(1, 0, 0), seasonal=(0, 0, 0, 0), periods=12, confidence=0.95, fit_method="HR") -> DataFrame:
    """Forecasts with bounds. Only the last few values and residuals of each
    series reach the recursion, which runs on one row per series."""
    p, d, q = order
    P, D, Q, m = seasonal
    rows, names, xs, fit = _estimate(df, order, seasonal, fit_method)
    ar, ma = _lagged(p, q, seasonal)
    n_ar = max([k for _, k in ar], default=0)
    n_ma = max([k for _, k in ma], default=0)
    w = np.array([1.0])
    for _ in range(d):
        w = np.convolve(w, [1.0, -1.0])
    for _ in range(D):
        w = np.convolve(w, [1.0] + [0.0] * (m - 1) + [-1.0])
    keep = max(n_ar, n_ma, len(w) - 1, 1)
    eps = F.col("x") - dot("__c", xs)
    length = rows.groupBy(*S).agg(F.max("seq").alias("__n"))
    tail = attach(rows.drop("__n"), null_safe_join(fit.select(*S, F.col("coef").alias("__c")), length, S), S, "__n", keep_length=True)
    tail = tail.filter(F.col("seq") > F.col("__n") - keep).withColumn("eps", F.coalesce(eps, F.lit(0.0)))
    last = tail.groupBy(*S).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "eps", "y"))).alias("t"), F.first("mu").alias("mu"))
    one = null_safe_join(last, fit, S)
    if fit_method == "HR":
        one = one.withColumn("tail", F.transform("t", lambda r: r["eps"]))
    # differencing consumed rows: the last undifferenced values are the y of the tail
    lags_ar, lags_ma, z = [k for _, k in ar], [k for _, k in ma], ts.Z[confidence]

    @F.pandas_udf("array<struct<step:int,f:double,se:double>>")
    def project(t: pd.Series, mu: pd.Series, coef: pd.Series, sse: pd.Series, n: pd.Series, tail: pd.Series) -> pd.Series:
        out = []
        for rows_, m_, c, s, k, end in zip(t, mu, coef, sse, n, tail):
            x, e = [r["x"] for r in rows_], list(end)
            y = [r["y"] for r in rows_]
            phi, theta = dict(zip(lags_ar, c[1:])), dict(zip(lags_ma, c[1 + len(lags_ar):]))
            # psi weights of the integrated process
            full = np.zeros(n_ar + 1)
            full[0] = 1.0
            for lag, v in phi.items():
                full[lag] -= v
            poly = np.convolve(full, w)
            psi = [1.0]
            for j in range(1, periods):
                v = theta.get(j, 0.0) - sum(poly[i] * psi[j - i] for i in range(1, min(j, len(poly) - 1) + 1))
                psi.append(v)
            sd, res = math.sqrt(s / k), []
            for h in range(1, periods + 1):
                v = c[0] + sum(a * x[-lag] for lag, a in phi.items()) + sum(b * e[-lag] for lag, b in theta.items())
                x.append(v)
                e.append(0.0)
                level = v + m_ - sum(w[i] * y[-i] for i in range(1, len(w)))
                y.append(level)
                res.append({"step": h, "f": level, "se": sd * math.sqrt(sum(u * u for u in psi[:h]))})
            out.append(res)
        return pd.Series(out)

    f = one.select(*S, F.explode(project("t", "mu", "coef", "sse", "n", "tail")).alias("f"))
    return f.select(*S, "f.step", F.col("f.f").alias("forecast_value"), (F.col("f.f") - z * F.col("f.se")).alias("lower_bound"),
                    (F.col("f.f") + z * F.col("f.se")).alias("upper_bound"))


def arima_grid(df: DataFrame, max_p=3, max_q=2, d=0) -> DataFrame:
    """All (p, d, q) up to the maxima from one matrix of cross products per
    series: every order is a sub-system of the largest one."""
    rows, names = _regressors(df, max_p, d, max_q, (0, 0, 0, 0))
    xs = [F.lit(1.0)] + [F.col(f"`{n}`") for n in names]
    k = len(xs) + 1
    orders = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]

    @F.pandas_udf("array<struct<p:int,q:int,aic:double,bic:double,sigma2:double>>")
    def solve(zz: pd.Series, n: pd.Series, sy: pd.Series) -> pd.Series:
        out = []
        for z, c, s in zip(zz, n, sy):
            m, line = unpack(z, k), []
            for p, q in orders:
                use = [0] + list(range(1, p + 1)) + list(range(1 + max_p, 1 + max_p + q))
                _, _, sse, _ = solve_row(m, c, s, use)
                v = math.log(max(sse, 1e-300) / c)
                line.append({"p": p, "q": q, "aic": c * v + 2 * len(use), "bic": c * v + math.log(c) * len(use), "sigma2": sse / c})
            out.append(line)
        return pd.Series(out)

    g = cross_products(rows, S, F.col("x"), xs).select(*S, "n", F.explode(solve("zz", "n", "__sy")).alias("r"))
    g = g.select(*S, F.col("r.p").alias("p"), F.lit(d).alias("d"), F.col("r.q").alias("q"), "n", F.col("r.aic").alias("aic"),
                 F.col("r.bic").alias("bic"), F.col("r.sigma2").alias("sigma2"))
    w = Window.partitionBy(*S)  # one row per order
    g = g.withColumn("aic_rank", F.row_number().over(w.orderBy("aic", "p", "q"))).withColumn("delta_aic", F.col("aic") - F.min("aic").over(w))
    return g.withColumn("evidence", band("delta_aic", [(2, "Substantial support"), (10, "Considerably less support")], "No support"))


def coefficient_report(model: DataFrame) -> DataFrame:
    """t statistic, approximate p-value and significance stars."""
    c = model.filter("result_type = 'Coefficients'").withColumn("t_statistic", F.col("value") / F.nullif(F.col("std_error"), F.lit(0.0)))
    t = F.abs("t_statistic")
    return c.select(*S, "name", "value", "std_error", "t_statistic", (2.0 * (1.0 - normal_cdf(t))).alias("p_value"), band_gt(t, [
        (2.576, "Highly significant (99% confidence) ***"), (1.96, "Significant (95% confidence) **"),
        (1.645, "Marginally significant (90% confidence) *")], "Not significant").alias("significance_level"))


def residual_report(fitted: DataFrame, lags=(1, 2, 3, 4, 5, 6, 12, 24)) -> DataFrame:
    rows = sequence(fitted.select(*S, "ts", F.col("residual").alias("value")), S, ["ts"])
    rows = sliding(rows, S, lambda w: {f"l{k}": F.lag("value", k).over(w) for k in lags}, before=max(lags))
    a = rows.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"),
                             *[F.corr("value", f"l{k}").alias(f"r{k}") for k in lags])
    a = a.withColumn("centring", F.when(F.abs("mean") < 0.001 * F.col("sd"), "Excellent - residuals well-centered at zero")
                     .when(F.abs("mean") < 0.01 * F.col("sd"), "Good - minimal bias in residuals").otherwise("Warning - residuals may be biased"))
    out = a.select(*S, "n", "mean", "sd", "centring", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("autocorrelation")) for k in lags])).alias("c"))
    out = out.select(*S, "n", "mean", "sd", "centring", "c.*")
    return out.withColumn("assessment", band(F.abs("autocorrelation"), [(0.1, "Excellent"), (0.2, "Good")], "Warning"))


def series_workflow(prepared: DataFrame, order=(1, 0, 1), period=24, periods=12) -> DataFrame:
    """Test, correlate, decompose, estimate, check and forecast; long rows
    (series_id, stage, item, value). The base is cut once and reused."""
    base = cut_lineage(prepared)
    long = lambda df, stage, item, value: df.select(*S, F.lit(stage).alias("stage"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    parts = [
        long(ts.stationarity_test(base, "ADF", 1), "stationarity", "verdict", "statistic"),
        long(ts.acf(base, 10), "acf", "lag", "acf_value"), long(ts.pacf(base, 10), "pacf", "lag", "pacf_value"),
        long(ts.seasonal_decompose(base, period).groupBy(*S).agg(F.lit("residual_sd").alias("item"), F.stddev("residual").alias("value")), "decompose", "item", "value"),
        long(arima_estimate(base, order), "estimate", "name", "value")]
    fitted = arima_fitted(base, order)
    res = sequence(fitted.select(*S, "ts", F.col("residual").alias("value")), S, ["ts"])
    parts += [long(ts.portmanteau(res, 10), "residual_test", "max_lag", "q_statistic"),
              long(ts.forecast_accuracy(fitted), "accuracy", "accuracy_band", "rmse"),
              long(arima_forecast(base, order, periods=periods), "forecast", "step", "forecast_value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prep_workflow(raw: DataFrame) -> DataFrame:
    """Number, fill, derive features, split, forecast the test part by the
    mean of the training part, and measure."""
    rows = ts.fill(sequence(raw, S, ["ts"]), "linear").withColumn("value", F.col("filled")).drop("filled")
    f = ts.lag_features(cut_lineage(rows))
    base = f.groupBy(*S).agg(F.avg(F.when(F.col("split") == "train", F.col("value"))).alias("fitted_value"), F.max("seq").alias("__n"))
    test = attach(f, base, S, "__n").filter("split = 'test'")
    return ts.forecast_accuracy(test)

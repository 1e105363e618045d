"""Model preparation and selection for series: splits, folds, candidate
forecasts, scores and estimates. Folds and origins are columns, so every
configuration is part of one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_gt, exact_share, flag, rnd, tally
from cairn.operators import arima as ar, series as ts
from cairn.operators.relational import rolling
from cairn.plans.lineage import cut_lineage
from cairn.plans.linear import ols
from cairn.plans.ordered import attach, null_safe_join, running, sliding
from cairn.plans.recurrence import affine_scan

S = ["series_id"]


def with_length(df: DataFrame) -> DataFrame:
    return attach(df, df.groupBy(*S).agg(F.max("seq").alias("n")), S, "n", keep_length=True)


# ---- splits and folds -----------------------------------------------------

def time_split(df: DataFrame, train=0.6, validation=0.2) -> DataFrame:
    """Role by position; the rest after train and validation is test."""
    r = with_length(df)
    (a, b), (c, d) = exact_share(train), exact_share(validation)
    p, n = F.col("seq"), F.col("n")
    role = F.when(p * b <= n * a, "train").when(p * (b * d) <= n * (a * d + b * c), "validation").otherwise("test")
    return r.withColumn("role", role).drop("n")


def kfold_blocks(df: DataFrame, k=5) -> DataFrame:
    """k contiguous folds of equal length."""
    r = with_length(df)
    return r.withColumn("fold", (F.floor((F.col("seq") - 1) * k / F.col("n")) + 1).cast("int")).drop("n")


def blocked_folds(df: DataFrame, blocks=25, folds=5) -> DataFrame:
    """Contiguous blocks dealt to the folds in turn; series shorter than
    ``blocks`` get blocks of one row."""
    r = with_length(df)
    size = F.greatest(F.floor(F.col("n") / blocks), F.lit(1))
    block = F.least(F.floor((F.col("seq") - 1) / size), F.lit(blocks - 1))
    return r.withColumns({"block": (block + 1).cast("int"), "fold": (block % folds + 1).cast("int")}).drop("n")


def rolling_origin(df: DataFrame, horizon=24, origins=5) -> DataFrame:
    """Rows (origin, role): train up to the origin, test the next ``horizon``
    rows; the last origin leaves exactly one horizon."""
    r = with_length(df).withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(origins))))
    cut = F.col("n") - F.lit(horizon) * (F.lit(origins + 1) - F.col("origin"))
    r = r.withColumn("cut", cut).filter((F.col("cut") > 0) & (F.col("seq") <= F.col("cut") + horizon))
    return r.withColumn("role", F.when(F.col("seq") <= F.col("cut"), "train").otherwise("test")).drop("cut", "n")


def moving_window(df: DataFrame, train: int, test: int, step: int, expanding: bool) -> DataFrame:
    """Expanding or sliding training windows, each followed by a test part."""
    r = with_length(df)
    last = F.floor((F.col("n") - train - test) / F.lit(step))
    r = r.filter(last >= 0).withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cut = F.lit(train) + F.col("window_no") * step
    start = F.lit(0) if expanding else cut - train
    p = F.col("seq")
    r = r.withColumns({"cut": cut, "start": start}).filter((p > F.col("start")) & (p <= F.col("cut") + test))
    return r.withColumn("role", F.when(p <= F.col("cut"), "train").otherwise("test")).drop("cut", "start", "n")


# ---- candidate forecasts --------------------------------------------------

def _recursive(df, A, g, start, h, name):
    out = affine_scan(df, S, A, g, start, before=h)
    return out.select(*S, "seq", "value", F.lit(name).alias("model"), F.when(F.col("seq") > 1, F.col("__before")).alias("fitted_value"))


def _state_space(alpha, beta=None, gamma=None, period=None):
    """Error-correction form of the smoothing family: F - g h, g, h, start."""
    import numpy as np
    m = period or 0
    dim = 1 + (beta is not None) + m
    Fm, g, h, start = np.zeros((dim, dim)), np.zeros(dim), np.zeros(dim), np.zeros(dim)
    Fm[0, 0] = h[0] = start[0] = 1.0
    g[0] = alpha
    if beta is not None:
        Fm[0, 1] = Fm[1, 1] = h[1] = 1.0
        g[1] = alpha * beta
    if m:
        o = dim - m
        h[o] = 1.0
        for i in range(m - 1):
            Fm[o + i, o + i + 1] = 1.0
        Fm[dim - 1, o] = 1.0
        g[dim - 1] = gamma
    return Fm - np.outer(g, h), g, start, h


PARAMS = {"naive": 1, "seasonal_naive": 1, "moving_average": 1, "linear_trend": 2, "ses": 2, "holt": 4, "holt_winters_add": 5, "holt_winters_mult": 5,
          "ar1": 2, "arima_111": 3, "sarima": 3}


def candidate_forecasts(df: DataFrame, models=("naive", "seasonal_naive", "moving_average", "linear_trend"), period=24, window=5,
                        alpha=0.3, beta=0.1, gamma=0.1) -> DataFrame:
    """One-step forecasts (series_id, seq, value, model, fitted_value) of the
    named models: naive, seasonal_naive, moving_average, linear_trend, ses,
    holt, holt_winters_add, holt_winters_mult (on logarithms), ar1,
    arima_111, sarima."""
    parts = []
    simple = [m for m in models if m in ("naive", "seasonal_naive", "moving_average")]
    if simple:
        def build(w):
            return {"naive": F.lag("value", 1).over(w), "seasonal_naive": F.lag("value", period).over(w),
                    "moving_average": F.avg("value").over(w.rowsBetween(-window, -1))}
        r = sliding(df, S, build, before=max(period, window))
        parts.append(r.select(*S, "seq", "value", *simple).unpivot([*S, "seq", "value"], simple, "model", "fitted_value"))
    if "linear_trend" in models:
        fit = df.groupBy(*S).agg(F.regr_slope("value", "seq").alias("b"), F.regr_intercept("value", "seq").alias("a"), F.max("seq").alias("n"))
        r = attach(df, fit, S, "n")
        parts.append(r.select(*S, "seq", "value", F.lit("linear_trend").alias("model"), (F.col("a") + F.col("b") * F.col("seq")).alias("fitted_value")))
    for name, args in (("ses", (alpha,)), ("holt", (alpha, beta)), ("holt_winters_add", (alpha, beta, gamma, period))):
        if name in models:
            parts.append(_recursive(df, *_state_space(*args), name))
    if "holt_winters_mult" in models:
        A, g, start, h = _state_space(alpha, beta, gamma, period)
        logs = df.filter("value > 0").withColumn("value", F.ln("value"))
        r = _recursive(logs, A, g, start, h, "holt_winters_mult")
        parts.append(r.withColumns({"value": F.exp("value"), "fitted_value": F.exp("fitted_value")}))
    for name, order, seasonal in (("ar1", (1, 0, 0), (0, 0, 0, 0)), ("arima_111", (1, 1, 1), (0, 0, 0, 0)), ("sarima", (1, 0, 0), (1, 0, 0, period))):
        if name in models:
            f = ar.arima_fitted(df, order, seasonal)
            parts.append(f.select(*S, "seq", "value", F.lit(name).alias("model"), "fitted_value"))
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("fitted_value").isNotNull())


def model_metrics(fitted: DataFrame) -> DataFrame:
    """RMSE, MAE, adjusted R2, AIC and BIC per series and model."""
    e = F.col("value") - F.col("fitted_value")
    k = F.create_map(*[v for m, c in PARAMS.items() for v in (F.lit(m), F.lit(c))])[F.col("model")]
    g = fitted.groupBy(*S, "model").agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("value").alias("__v")).withColumn("k", k)
    n, m = F.col("n"), F.col("mse")
    r2 = 1 - m / F.nullif(F.col("__v"), F.lit(0.0))
    return g.withColumns({"rmse": F.sqrt(m), "aic": n * F.ln(m) + 2 * F.col("k"), "bic": n * F.ln(m) + F.ln(n) * F.col("k"),
                          "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - F.col("k") - 1)}).drop("__v", "mse")


def minmax_score(df: DataFrame, weights: dict, by=(), ids=("model",), name="score") -> DataFrame:
    """Scale every metric to 0..1 within the group, weight, add and rank.
    A negative weight marks a metric where less is better. The input has one
    row per configuration."""
    w = Window.partitionBy(*by)
    total = F.lit(0.0)
    for c, k in weights.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        z = F.coalesce((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0 if k > 0 else 0.0))
        total = total + (z * k if k > 0 else (1.0 - z) * -k)
    out = df.withColumn(name, total)
    return out.withColumn(f"{name}_rank", F.row_number().over(w.orderBy(F.desc(F.round(name, 9)), *ids)))


SELECTION_WEIGHTS = {"aic": -0.3, "bic": -0.25, "rmse": -0.25, "mae": -0.1, "adjusted_r2": 0.1}


def model_selection(fitted: DataFrame) -> DataFrame:
    """Ranks of the models of each series by every criterion and by the
    composite score; consensus is the number of criteria a model wins."""
    m = minmax_score(model_metrics(fitted), SELECTION_WEIGHTS, S, name="composite")
    w = Window.partitionBy(*S)  # one row per model
    ranks = {f"{c}_rank": F.row_number().over(w.orderBy(F.round(c, 9).desc() if c == "adjusted_r2" else F.round(c, 9).asc(), "model")) for c in ("aic", "bic", "rmse", "mae", "adjusted_r2")}
    m = m.withColumns(ranks)
    return m.withColumn("consensus", sum((flag(F.col(c) == 1) for c in ranks), F.lit(0)))


def selection_stability(selected: DataFrame) -> DataFrame:
    """Spread of a model's ranks over the criteria and over the series."""
    ranks = ["aic_rank", "bic_rank", "rmse_rank", "mae_rank", "adjusted_r2_rank"]
    long = selected.unpivot([*S, "model"], ranks, "criterion", "rank")
    g = long.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.stddev("rank").alias("rank_sd"), tally(F.col("rank") == 1).alias("wins"))
    return g.withColumn("stability", band(F.round("rank_sd", 9), [(0.5, "Very stable"), (1.0, "Stable")], "Unstable"))


def overfitting_risk(selected: DataFrame) -> DataFrame:
    r = F.col("k") / F.col("n")
    return selected.select(*S, "model", r.alias("parameter_ratio"), band_gt(r, [(0.1, "High risk"), (0.05, "Moderate risk")], "Low risk").alias("overfitting_risk"))


def ts_cross_validate(df: DataFrame, folds=5, test_size=24, window=24) -> DataFrame:
    """Rolling-origin errors of three baselines (mean, last value, moving
    average of the training part), train error beside test error, overfit
    flag; all folds in one job keyed by (series, origin)."""
    r = rolling_origin(df, test_size, folds)
    tr = F.col("role") == "train"
    ends = r.filter(tr).groupBy(*S, "origin").agg(F.max("seq").alias("__c"))
    base = r.groupBy(*S, "origin").agg(F.avg(F.when(tr, F.col("value"))).alias("mean"), F.max_by(F.when(tr, F.col("value")), F.when(tr, F.col("seq"))).alias("last"))
    j = null_safe_join(null_safe_join(r, ends, S + ["origin"]), base, S + ["origin"])
    ma = j.groupBy(*S, "origin").agg(F.avg(F.when(tr & (F.col("seq") > F.col("__c") - window), F.col("value"))).alias("moving_average"))
    j = null_safe_join(j, ma, S + ["origin"])
    long = j.unpivot([*S, "origin", "role", "seq", "value"], ["mean", "last", "moving_average"], "model", "fitted_value")
    e2 = F.pow(F.col("value") - F.col("fitted_value"), 2)
    g = long.groupBy(*S, "model", "origin").agg(F.sqrt(F.avg(F.when(F.col("role") == "train", e2))).alias("train_rmse"), F.sqrt(F.avg(F.when(F.col("role") == "test", e2))).alias("test_rmse"))
    gap = F.col("test_rmse") - F.col("train_rmse")
    return g.withColumns({"gap": gap, "overfit": flag(F.col("test_rmse") > 1.5 * F.col("train_rmse"))})


def cv_stability(cv: DataFrame) -> DataFrame:
    g = cv.groupBy(*S, "model").agg(F.count(F.lit(1)).alias("folds"), F.avg("test_rmse").alias("mean_test_rmse"), F.stddev("test_rmse").alias("sd_test_rmse"), F.avg("gap").alias("mean_gap"), F.sum("overfit").alias("overfit_folds"))
    return g.withColumn("stability", 1.0 - F.col("sd_test_rmse") / F.nullif(F.col("mean_test_rmse"), F.lit(0.0)))


# ---- characteristics and estimates ----------------------------------------

def ts_characteristics(df: DataFrame) -> DataFrame:
    r = sliding(df, S, lambda w: {"__l1": F.lag("value", 1).over(w), "__l12": F.lag("value", 12).over(w)}, before=12)
    g = r.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std_dev"), F.corr("value", "seq").alias("trend_correlation"),
                          F.corr("value", "__l1").alias("lag1_correlation"), F.corr("value", "__l12").alias("lag12_correlation"),
                          F.stddev(F.col("value") - F.col("__l1")).alias("difference_sd"))
    return g.withColumns({"trend": F.when(F.abs("trend_correlation") > 0.5, "Trending").otherwise("No clear trend"),
                          "seasonality": F.when(F.abs("lag12_correlation") > 0.5, "Seasonal").otherwise("No clear seasonality")})


def model_features(df: DataFrame) -> DataFrame:
    def build(w):
        return {"ma5": F.avg("value").over(w.rowsBetween(-4, 0)), "ma10": F.avg("value").over(w.rowsBetween(-9, 0)), "diff1": F.col("value") - F.lag("value", 1).over(w),
                "diff12": F.col("value") - F.lag("value", 12).over(w)}
    return sliding(df, S, build, before=12).withColumn("trend", F.col("seq"))


def parameter_estimate(df: DataFrame, method="ols", ridge=1.0, prior_mean=0.0, prior_precision=1.0) -> DataFrame:
    """(series_id, parameter, estimate). ols and ridge: line in time (ridge
    shrinks the slope of the centred line); moments: mean, variance and AR(1)
    by the lag-1 autocorrelation; bayes: posterior mean and deviation of the
    level under a normal prior with the sample variance as known."""
    if method in ("ols", "mle"):
        g = df.groupBy(*S).agg(F.regr_intercept("value", "seq").alias("intercept"), F.regr_slope("value", "seq").alias("slope"),
                               F.sqrt((F.regr_syy("value", "seq") - F.regr_slope("value", "seq") * F.regr_sxy("value", "seq")) / F.count(F.lit(1))).alias("sigma"))
        names = ["intercept", "slope", "sigma"]
    elif method == "ridge":
        b = F.regr_sxy("value", "seq") / (F.regr_sxx("value", "seq") + ridge)
        g = df.groupBy(*S).agg((F.avg("value") - b * F.avg("seq")).alias("intercept"), b.alias("slope"))
        names = ["intercept", "slope"]
    elif method == "moments":
        p = ts.lag_products(df, 1)
        m = df.groupBy(*S).agg(F.avg("value").alias("mean"), F.variance("value").alias("variance"))
        g = null_safe_join(m, p.select(*S, (F.element_at("ck", 1) / F.nullif(F.col("c0"), F.lit(0.0))).alias("ar1")), S)
        names = ["mean", "variance", "ar1"]
    elif method == "bayes":
        a = df.groupBy(*S).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.variance("value").alias("v"))
        prec = prior_precision + F.col("n") / F.col("v")
        g = a.withColumns({"posterior_mean": (prior_precision * prior_mean + F.col("n") / F.col("v") * F.col("m")) / prec, "posterior_sd": F.sqrt(1.0 / prec)})
        names = ["posterior_mean", "posterior_sd"]
    else:
        raise ValueError(method)
    return g.select(*S, *names).unpivot(S, names, "parameter", "estimate")


def gradient_estimate(df: DataFrame, max_iter=100) -> DataFrame:
    """Pooled line in time by the iterative (gradient) solver of spark.ml."""
    from cairn.operators.models import linear_regression
    d = df.select(F.col("seq").cast("double").alias("seq"), "value")
    return linear_regression(d, "value", ["seq"], strength=1e-12)[1]


def component_strength(df: DataFrame, period=24) -> DataFrame:
    """Strength of trend and season: 1 - Var(residual)/Var(component + residual)."""
    d = ts.seasonal_decompose(df, period)
    t, s, r = F.col("trend"), F.col("seasonal"), F.col("residual")
    on = lambda e: F.when(r.isNotNull(), e)
    g = d.groupBy(*S).agg(F.var_pop(r).alias("vr"), F.var_pop(on(t + r)).alias("vt"), F.var_pop(on(s + r)).alias("vs"), F.avg("value").alias("level"))
    z = lambda c: F.greatest(F.lit(0.0), 1 - F.col("vr") / F.nullif(F.col(c), F.lit(0.0)))
    return g.select(*S, "level", z("vt").alias("trend_strength"), z("vs").alias("seasonal_strength"))


def confidence_interval(df: DataFrame) -> DataFrame:
    g = df.groupBy(*S).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.withColumns({"std_error": se, **{f"{side}_{int(c * 100)}": F.col("mean") + sign * ts.Z[c] * se for c in (0.95, 0.99) for side, sign in (("lower", -1), ("upper", 1))}})


def estimation_report(df: DataFrame) -> DataFrame:
    """Line fitted on the first 80%: errors on both parts, their gap, AIC and
    BIC, and the width of the slope's 95% interval."""
    r = time_split(df, 0.8, 0.0)
    fit = ols(r.filter("role = 'train'"), S, F.col("value"), [F.lit(1.0), F.col("seq").cast("double")]).withColumnRenamed("n", "n_train")
    n = df.groupBy(*S).agg(F.max("seq").alias("__n"))
    j = attach(r, null_safe_join(fit, n, S), S, "__n")
    e = F.pow(F.col("value") - F.element_at("coef", 1) - F.element_at("coef", 2) * F.col("seq"), 2)
    g = j.groupBy(*S).agg(F.sqrt(F.avg(F.when(F.col("role") == "train", e))).alias("train_rmse"), F.sqrt(F.avg(F.when(F.col("role") == "test", e))).alias("test_rmse"),
                          F.max("n_train").alias("n"), F.max(F.element_at("coef", 2)).alias("slope"), F.max(F.element_at("se", 2)).alias("slope_se"), F.max("sse").alias("sse"))
    k = 2
    return g.withColumns({"generalization_gap": F.col("test_rmse") - F.col("train_rmse"), "aic": F.col("n") * F.ln(F.col("sse") / F.col("n")) + 2 * k,
                          "bic": F.col("n") * F.ln(F.col("sse") / F.col("n")) + k * F.ln("n"), "slope_ci_width": 2 * ts.Z[0.95] * F.col("slope_se"),
                          "gap_assessment": band(F.col("test_rmse") / F.col("train_rmse"), [(1.1, "Good generalization"), (1.5, "Acceptable")], "Overfitting")}).drop("sse")

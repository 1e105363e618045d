"""Time series: preparation, diagnostics, decomposition, smoothing.

Operators take (series_id, ts, value, seq) as made by ``series_prepare`` and
work on all series at once. ``seq`` is the dense position, which lets frames
and sums run over blocks of positions (see ``cairn.plans.ordered``)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_ge, band_gt, band_le, exact_share, flag, normal_cdf, pct, rnd, tally
from cairn.operators.relational import ntile, rolling, rolling_median
from cairn.plans.lineage import cut_lineage, written
from cairn.plans.linear import dot, ols
from cairn.plans.ordered import attach, null_safe_join, running, sequence, share, sliding, with_stats
from cairn.plans.recurrence import affine_scan, gain_scan
from cairn.plans.segments import optimal_cuts

S = ["series_id"]
Z = {0.90: 1.644853626951473, 0.95: 1.959963984540054, 0.99: 2.575829303548901}


# ---- preparation ----------------------------------------------------------

def hourly_means(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")) \
                 .agg(F.avg("value").alias("value"))


def series_prepare(df: DataFrame, ts="ts", value="value", series="series_id", tiebreak=None) -> DataFrame:
    """(series_id, ts, value, seq): complete rows in time order."""
    order = ["ts"] + ([tiebreak] if tiebreak else [])
    rows = df.select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"),
                     F.col(value).cast("double").alias("value"), *([tiebreak] if tiebreak else [])).dropna()
    return sequence(rows, S, order).drop(*([tiebreak] if tiebreak else []))


def gaps(df: DataFrame) -> DataFrame:
    """Seconds since the previous row of the series."""
    return sliding(df, S, lambda w: {
        "gap": (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6}, before=1)


def regularity(df: DataFrame) -> DataFrame:
    g = gaps(df).filter(F.col("gap").isNotNull())
    out = g.groupBy(*S).agg(
        F.count(F.lit(1)).alias("total_periods"), F.countDistinct("gap").alias("distinct_intervals"),
        F.min("gap").alias("min_interval"), F.max("gap").alias("max_interval"), F.avg("gap").alias("avg_interval"))
    return out.withColumn("regularity_status", band_le("distinct_intervals", [
        (1, "Regular intervals"), (3, "Nearly regular - acceptable")], "Irregular intervals - preprocessing recommended"))


def sampling_rate(df: DataFrame) -> DataFrame:
    g = gaps(df).groupBy(*S).agg(F.avg("gap").alias("sampling_interval_sec"), F.stddev("gap").alias("sd"))
    out = g.withColumns({"sampling_rate_hz": 1.0 / F.col("sampling_interval_sec"),
                         "nyquist_hz": 0.5 / F.col("sampling_interval_sec"),
                         "irregularity_pct": F.col("sd") / F.col("sampling_interval_sec") * 100.0})
    return out.withColumn("sampling_quality", band("irregularity_pct", [
        (1.0, "Uniform - Excellent for filtering"), (5.0, "Nearly uniform - Good for filtering")],
        "Irregular - Resample before filtering")).drop("sd")


def data_validate(df: DataFrame, step_seconds=3600.0, factor=1.5) -> DataFrame:
    """Real gaps against the expected step, repeated stamps, missing values.
    Takes raw (series_id, ts, value) rows; value may be null."""
    stamps = df.groupBy(*S, "ts").agg(F.count(F.lit(1)).alias("k"))
    g = gaps(sequence(stamps, S, ["ts"]))
    wide = F.col("gap") > step_seconds * factor
    a = g.groupBy(*S).agg(
        tally(wide).alias("total_gaps"), F.avg(F.when(wide, F.col("gap") / 3600.0)).alias("avg_gap_hours"),
        F.max(F.when(wide, F.col("gap") / 3600.0)).alias("max_gap_hours"), tally(F.col("k") > 1).alias("duplicate_stamps"),
        F.sum(F.when(wide, F.round(F.col("gap") / step_seconds) - 1).otherwise(0)).cast("bigint").alias("missing_stamps"))
    n = F.count(F.lit(1))
    b = df.groupBy(*S).agg(n.alias("total_rows"), (n - F.count("value")).alias("null_count"),
                           rnd(pct(n - F.count("value"), n), 4).alias("missing_pct"))
    return null_safe_join(b, a, S)


def fill(df: DataFrame, method="linear", period=24) -> DataFrame:
    """Fill null values; ``seq`` numbers all rows. Methods: forward (locf),
    backward, linear (by time), mean, seasonal (mean of the same phase)."""
    v = F.col("value")
    known = F.when(v.isNotNull(), F.struct("value", "ts"))
    if method in ("forward", "locf"):
        out = running(df, S, lasts={"__p": v})
        return out.withColumn("filled", F.col("__p")).drop("__p")
    if method in ("backward", "linear"):
        n = df.groupBy(*S).agg(F.max("seq").alias("__n"))
        rows = running(df, S, lasts={"__p": known})
        rows = attach(rows, n, S, "__n", keep_length=True).withColumn("__r", F.col("__n") - F.col("seq") + 1)
        rows = running(rows, S, lasts={"__q": known}, seq="__r")
        if method == "backward":
            return rows.withColumn("filled", F.col("__q.value")).drop("__p", "__q", "__n", "__r")
        t = lambda c: F.unix_micros(c)
        part = (t("ts") - t("__p.ts")) / F.nullif(t("__q.ts") - t("__p.ts"), F.lit(0))
        line = F.col("__p.value") + (F.col("__q.value") - F.col("__p.value")) * part
        return rows.withColumn("filled", F.coalesce(v, line, F.col("__p.value"), F.col("__q.value"))) \
                   .drop("__p", "__q", "__n", "__r")
    if method == "mean":
        m = df.groupBy(*S).agg(F.avg("value").alias("__m"), F.max("seq").alias("__n"))
        return attach(df, m, S, "__n").withColumn("filled", F.coalesce(v, F.col("__m"))).drop("__m")
    if method == "seasonal":
        return phase_values(df, "value", period, "__m").withColumn("filled", F.coalesce(v, F.col("__m"))).drop("__m")
    raise ValueError(method)


def phase_values(df: DataFrame, column: str, period: int, name: str, centred=None) -> DataFrame:
    """Mean of the column over rows of the same phase, beside each row. The
    means of one series form an array of ``period`` entries. ``centred``:
    None, 'additive' or 'multiplicative' normalises them."""
    phase = ((F.col("seq") - 1) % period).cast("int")
    means = df.groupBy(*S, phase.alias("__ph")).agg(F.avg(column).alias("__mean"), F.max("seq").alias("__n"))
    table = means.groupBy(*S).agg(F.map_from_entries(F.collect_list(F.struct("__ph", "__mean"))).alias("__map"),
                                  F.max("__n").alias("__n"), F.avg("__mean").alias("__centre"))
    out = attach(df, table, S, "__n")
    v = F.try_element_at("__map", phase)
    if centred == "additive":
        v = v - F.col("__centre")
    elif centred == "multiplicative":
        v = v / F.col("__centre")
    return out.withColumn(name, v).drop("__map", "__centre")


def holiday_flag(ts) -> Column:
    """1 in the last days of December (20th to 31st)."""
    return flag((F.month(ts) == 12) & F.dayofmonth(ts).between(20, 31))


def calendar_features(df: DataFrame, ts="ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t),
                           "day_of_week": F.dayofweek(t), "is_weekend": flag(F.dayofweek(t).isin(1, 7)),
                           "is_holiday": holiday_flag(t)})


def mark_outliers(df: DataFrame, column="value", sigmas=3.0) -> DataFrame:
    st = df.groupBy(*S).agg(F.avg(column).alias("__m"), F.stddev(column).alias("__s"), F.max("seq").alias("__n"))
    out = attach(df, st, S, "__n")
    return out.withColumn("is_outlier", flag(F.abs(F.col(column) - F.col("__m")) > sigmas * F.col("__s"))).drop("__m", "__s")


# Weights of the preparation score.
PREP_WEIGHTS = {"completeness": 0.30, "consistency": 0.20, "outlier": 0.25, "continuity": 0.25}


def prep_quality(df: DataFrame, column="filled", sigmas=3.0) -> DataFrame:
    """Scores in 0..1 of a prepared series: completeness, consistency (stamps
    without repeats), outlier control, continuity 1/(1+sd |change|/sd)."""
    rows = mark_outliers(df, column, sigmas)
    rows = sliding(rows, S, lambda w: {"__d": F.abs(F.col(column) - F.lag(column).over(w)),
                                       "__same": flag(F.col("ts") == F.lag("ts").over(w))}, before=1)
    n = F.count(F.lit(1))
    out = rows.groupBy(*S).agg(
        (F.count(column) / n).alias("completeness"), (1.0 - F.sum("__same") / n).alias("consistency"),
        (1.0 - F.sum("is_outlier") / n).alias("outlier"),
        (1.0 / (1.0 + F.coalesce(F.stddev("__d") / F.nullif(F.stddev(column), F.lit(0.0)), F.lit(0.0)))).alias("continuity"))
    score = sum((F.col(k) * w for k, w in PREP_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("total_quality_score", score)


def prep_tune(df: DataFrame, methods=("forward", "backward", "linear", "mean", "seasonal"), sigmas=(2.0, 3.0)) -> DataFrame:
    """Every (fill method, outlier limit) really applied and scored."""
    parts = None
    for m in methods:
        filled = fill(df, m)
        for s in sigmas:
            q = prep_quality(filled, "filled", s).select(F.lit(m).alias("fill_method"), F.lit(s).alias("outlier_threshold"), "*")
            parts = q if parts is None else parts.unionByName(q)
    w = Window.partitionBy(*S).orderBy(F.desc(F.round("total_quality_score", 9)), "fill_method", "outlier_threshold")
    return parts.withColumn("quality_rank", F.row_number().over(w))  # one row per configuration


READINESS = [(100, "EXCELLENT - Sufficient data for robust analysis"), (50, "GOOD - Adequate data for analysis"),
             (30, "ACCEPTABLE - Minimum data available")]  # fixed values


def series_summary(df: DataFrame) -> DataFrame:
    rows = mark_outliers(df)
    out = rows.groupBy(*S).agg(
        F.count(F.lit(1)).alias("n_observations"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"), F.stddev("value").alias("std_dev"), F.sum("is_outlier").alias("potential_outliers"),
        tally(F.col("value").isNull()).alias("null_count"))
    n = F.col("n_observations")
    return out.withColumns({
        "coefficient_of_variation": F.col("std_dev") / F.nullif(F.col("mean_value"), F.lit(0.0)),
        "data_sufficiency": band_ge(n, READINESS, "WARNING - Short time series may affect analysis quality"),
        "readiness": F.when(n >= 30, "READY").otherwise("PROCEED WITH CAUTION")})


# ---- correlation structure ------------------------------------------------

def centred(df: DataFrame, column="value", name="__x", keep_n=False) -> DataFrame:
    m = df.groupBy(*S).agg(F.avg(column).alias("__m"), F.max("seq").alias("__n"))
    return attach(df, m, S, "__n", keep_length=keep_n).withColumn(name, F.col(column) - F.col("__m")).drop("__m")


def lag_products(df: DataFrame, max_lag: int, column="value") -> DataFrame:
    """Per series: n, sum of squares and an array of sums of x_t x_{t-k}."""
    rows = sliding(centred(df, column), S, lambda w: {f"__l{k}": F.lag("__x", k).over(w) for k in range(1, max_lag + 1)},
                   before=max_lag)
    return rows.groupBy(*S).agg(
        F.count("__x").alias("n"), F.sum(F.col("__x") * F.col("__x")).alias("c0"),
        F.array(*[F.sum(F.col("__x") * F.col(f"__l{k}")) for k in range(1, max_lag + 1)]).alias("ck"))


def acf(df: DataFrame, max_lag=20, confidence=0.95, normalisation="biased", column="value") -> DataFrame:
    """(series_id, lag, acf_value, lower_bound, upper_bound). ``biased`` is
    the usual estimator; ``pairs`` divides by pair count and sample variance.
    Bounds are those of white noise, z/sqrt(n)."""
    p = lag_products(df, max_lag, column)
    rows = p.select(*S, "n", "c0", F.posexplode("ck").alias("__i", "c")).withColumn("lag", F.col("__i") + 1)
    if normalisation == "pairs":
        r = (F.col("c") / (F.col("n") - F.col("lag"))) / F.nullif(F.col("c0") / (F.col("n") - 1), F.lit(0.0))
    else:
        r = F.col("c") / F.nullif(F.col("c0"), F.lit(0.0))
    lim = F.lit(Z[confidence]) / F.sqrt("n")
    return rows.select(*S, "lag", "n", r.alias("acf_value"), (-lim).alias("lower_bound"), lim.alias("upper_bound"))


def pacf(df: DataFrame, max_lag=20, confidence=0.95, column="value") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on the
    autocorrelations, an array of ``max_lag`` numbers per series."""
    @F.pandas_udf("array<double>")
    def levinson(ck: pd.Series, c0: pd.Series) -> pd.Series:
        out = []
        for c, z in zip(ck, c0):
            if not z:
                out.append([None] * len(c))
                continue
            r, phi, res = np.asarray(c, float) / z, np.zeros(0), []
            for k in range(len(r)):
                den = 1.0 - phi @ r[:k]
                a = (r[k] - phi @ r[:k][::-1]) / den if den else np.nan
                phi = np.append(phi - a * phi[::-1], a)
                res.append(float(a))
            out.append(res)
        return pd.Series(out)

    p = lag_products(df, max_lag, column)
    rows = p.select(*S, "n", F.posexplode(levinson("ck", "c0")).alias("__i", "pacf_value"))
    lim = F.lit(Z[confidence]) / F.sqrt("n")
    return rows.select(*S, (F.col("__i") + 1).alias("lag"), "pacf_value", (-lim).alias("lower_bound"), lim.alias("upper_bound"))


def diff(df: DataFrame, order=1, seasonal=0, period=1, column="value", name="diff_value", reseq=False) -> DataFrame:
    """Ordinary differences ``order`` times and seasonal ones ``seasonal``
    times, as one weighted sum of lags (binomial weights)."""
    w = np.array([1.0])
    for _ in range(order):
        w = np.convolve(w, [1.0, -1.0])
    for _ in range(seasonal):
        w = np.convolve(w, [1.0] + [0.0] * (period - 1) + [-1.0])
    reach = len(w) - 1
    def build(win):
        e = F.lit(0.0)
        for k, c in enumerate(w):
            if c:
                e = e + F.lit(float(c)) * (F.lag(column, k).over(win) if k else F.col(column))
        return {name: e}
    out = sliding(df, S, build, before=reach)
    if reseq:  # the first ``reach`` rows of each series have no difference
        out = out.filter(F.col("seq") > reach).withColumn("seq", F.col("seq") - reach)
    return out


# Published asymptotic critical values at 1, 5 and 10 percent.
DF_CRITICAL = {"none": (-2.58, -1.95, -1.62), "constant": (-3.43, -2.86, -2.57), "trend": (-3.96, -3.41, -3.12)}
KPSS_CRITICAL = {"constant": (0.739, 0.463, 0.347), "trend": (0.216, 0.146, 0.119)}


def _p_between(stat: Column, crit, upper: bool) -> Column:
    """p interpolated between the 1, 5 and 10 percent points, held outside."""
    (c1, c5, c10), s = crit, stat
    lin = lambda a, pa, b, pb: pa + (s - a) * ((pb - pa) / (b - a))
    beyond = (lambda c: s >= c) if upper else (lambda c: s <= c)
    return F.when(beyond(c1), 0.01).when(beyond(c5), lin(c1, 0.01, c5, 0.05)) \
            .when(beyond(c10), lin(c5, 0.05, c10, 0.10)).otherwise(0.10)


# MacKinnon's (1994) response surfaces of the Dickey-Fuller t, whose p-value
# is the normal CDF of a polynomial: least value, bound between the two, greatest value, coefficients below, above.
DF_SURFACE = {
    "none": (-19.04, -1.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "constant": (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "trend": (-16.18, -2.89, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285))}


def _df_surface(stat: Column, trend: str) -> Column:
    least, bound, most, below, above = DF_SURFACE[trend]
    poly = lambda cs: sum((F.lit(c) * F.pow(stat, F.lit(float(i))) for i, c in enumerate(cs)), F.lit(0.0))
    return F.when(stat < least, 0.0).when(stat > most, 1.0).when(stat <= bound, normal_cdf(poly(below))).otherwise(normal_cdf(poly(above)))


def kpss_tail(x, trend="constant", terms=12, points=64) -> np.ndarray:
    """The chance that the limit of the KPSS statistic is above ``x``, by Smirnov's
    formula for sums of weighted squares: an integral between each odd zero of the
    characteristic function and the next one. With a trend the zeros are 2 pi j and
    the roots of tan(s/2) = s/2."""
    if trend == "constant":
        zeros = np.pi * np.arange(1, 2 * terms + 1)
        size = lambda s: np.abs(np.sin(s) / s)
    else:
        lo, hi = np.pi * np.arange(1, terms + 1), np.pi * (np.arange(1, terms + 1) + 0.5)
        for _ in range(60):
            mid = (lo + hi) / 2
            low = np.sin(mid) / mid - np.cos(mid)
            left = low * (-1.0) ** np.arange(1, terms + 1) < 0
            lo, hi = np.where(left, mid, lo), np.where(left, hi, mid)
        zeros = np.sort(np.concatenate([2 * np.pi * np.arange(1, terms + 1), lo + hi]))
        size = lambda s: np.abs(12 * (2 - 2 * np.cos(s) - s * np.sin(s)) / s ** 4)
    a, b = zeros[0::2, None], zeros[1::2, None]
    s = (a + b) / 2 + (b - a) / 2 * np.cos((np.arange(points) + 0.5) * np.pi / points)
    weight = 2 / s * np.sqrt((s - a) * (b - s) / size(s)) * np.where(np.arange(terms) % 2, -1.0, 1.0)[:, None] / points
    x = np.maximum(np.asarray(x, float), 0.005)  # the terms suffice from here on; below, the chance is 1 to 1e-4
    return np.clip((weight.ravel() * np.exp(-np.multiply.outer(x, s.ravel() ** 2) / 2)).sum(-1), 0, 1)


def stationarity_test(df: DataFrame, test="ADF", lags=1, trend="constant", confidence=0.95, p_values="table") -> DataFrame:
    """ADF, PP (unit root is the null) or KPSS (stationarity is the null),
    statistic per series with p-value and verdict. ``p_values``: ``table``
    interpolates between the 1, 5 and 10 percent points and holds outside;
    ``asymptotic`` is good at any statistic (response surfaces for ADF and PP, the
    limit's own distribution for KPSS)."""
    if p_values not in ("table", "asymptotic"):
        raise ValueError(p_values)
    level = {0.99: 0, 0.95: 1, 0.90: 2}[confidence]
    if test == "KPSS":
        x = [F.lit(1.0)] + ([F.col("seq").cast("double")] if trend == "trend" else [])
        fit = ols(df, S, F.col("value"), x).withColumnRenamed("n", "__n")
        e = attach(df, fit.select(*S, "__n", "coef"), S, "__n").withColumn("e", F.col("value") - dot("coef", x))
        e = running(e.drop("coef"), S, {"cum": "e"})
        e = sliding(e, S, lambda w: {f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)}, before=lags)
        n = F.count(F.lit(1))
        lrv = F.sum(F.col("e") * F.col("e")) / n
        for k in range(1, lags + 1):
            lrv = lrv + 2.0 * (1.0 - k / (lags + 1.0)) * F.sum(F.col("e") * F.col(f"e{k}")) / n
        out = e.groupBy(*S).agg(n.alias("n"), (F.sum(F.col("cum") * F.col("cum")) / (n * n) / lrv).alias("statistic"))
        crit, upper = KPSS_CRITICAL[trend], True
    else:
        k = lags if test == "ADF" else 0
        rows = diff(df, 1, name="d")
        rows = sliding(rows, S, lambda w: {"x1": F.lag("value").over(w), **{f"d{i}": F.lag("d", i).over(w) for i in range(1, k + 1)}},
                       before=max(k, 1))
        x = [F.col("x1")] + ([F.lit(1.0)] if trend != "none" else []) + ([F.col("seq").cast("double")] if trend == "trend" else [])
        fit = ols(rows, S, F.col("d"), x + [F.col(f"d{i}") for i in range(1, k + 1)])
        t = F.element_at("coef", 1) / F.element_at("se", 1)
        if test == "ADF":
            out = fit.select(*S, "n", t.alias("statistic"))
        elif test == "PP":
            length = df.groupBy(*S).agg(F.max("seq").alias("__n"))
            per = null_safe_join(fit, length, S)
            e = attach(rows, per.select(*S, "__n", "coef"), S, "__n").withColumn("e", F.col("d") - dot("coef", x))
            e = sliding(e.drop("coef"), S, lambda w: {f"e{j}": F.lag("e", j).over(w) for j in range(1, lags + 1)}, before=lags)
            g = e.groupBy(*S).agg(F.sum(F.col("e") * F.col("e")).alias("g0"),
                                  *[F.sum(F.col("e") * F.col(f"e{j}")).alias(f"g{j}") for j in range(1, lags + 1)])
            g = null_safe_join(fit, g, S)
            g0 = F.col("g0") / F.col("n")
            lam = g0
            for j in range(1, lags + 1):
                lam = lam + 2.0 * (1.0 - j / (lags + 1.0)) * F.col(f"g{j}") / F.col("n")
            s = F.sqrt(F.col("sse") / (F.col("n") - len(x)))
            z = F.sqrt(g0 / lam) * t - 0.5 * (lam - g0) / F.sqrt(lam) * (F.col("n") * F.element_at("se", 1) / s)
            out = g.select(*S, "n", z.alias("statistic"))
        else:
            raise ValueError(test)
        crit, upper = DF_CRITICAL[trend], False
    s, c = F.col("statistic"), F.lit(crit[level])
    reject = (s > c) if upper else (s < c)
    stationary = ~reject if upper else reject
    p = _p_between(s, crit, upper)
    if p_values == "asymptotic":
        tail = F.pandas_udf(lambda x: pd.Series(kpss_tail(x, trend)).where(x.notna()), "double")
        p = tail("statistic") if upper else _df_surface(s, trend)
    return out.select(*S, F.lit(test).alias("test"), "n", "statistic", c.alias("critical_value"),
                      p.alias("p_value"),
                      F.when(stationary, "Stationary").otherwise("Non-stationary").alias("verdict"))


def rolling_stationarity(df: DataFrame) -> DataFrame:
    r = rolling(rolling(df, S, {"m12": F.avg("value"), "s12": F.stddev("value")}, 11), S,
                {"m24": F.avg("value"), "s24": F.stddev("value")}, 23)
    out = r.groupBy(*S).agg(F.stddev("m12").alias("mean_variability_12"), F.stddev("s12").alias("std_variability_12"),
                            F.stddev("m24").alias("mean_variability_24"), F.stddev("s24").alias("std_variability_24"),
                            (F.stddev("m12") / F.nullif(F.avg("m12"), F.lit(0.0))).alias("__r"))
    return out.withColumn("stationarity_recommendation", band("__r", [
        (0.1, "Likely stationary - d=0 may be sufficient"), (0.3, "Moderately non-stationary - d=1 recommended")],
        "Non-stationary - d=1 or d=2 required")).drop("__r")


SEASONS = {7: "Weekly seasonality detected (period=7)", 12: "Monthly seasonality detected (period=12)",
           24: "Bi-annual seasonality detected (period=24)", 30: "Monthly seasonality detected (period=30)"}  # fixed values


def seasonality_detect(df: DataFrame, limit=0.5) -> DataFrame:
    rows = sliding(df, S, lambda w: {f"l{k}": F.lag("value", k).over(w) for k in SEASONS}, before=max(SEASONS))
    out = rows.groupBy(*S).agg(*[F.corr("value", f"l{k}").alias(f"correlation_lag{k}") for k in SEASONS])
    label = None
    for k, text in SEASONS.items():
        hit = F.abs(F.col(f"correlation_lag{k}")) > limit
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return out.withColumn("seasonal_assessment", label.otherwise("No strong seasonal pattern detected"))


def centred_average(df: DataFrame, period: int, column="value", name="trend") -> DataFrame:
    """Moving average of one full period; even periods use half weights at
    both ends. Null where the window does not fit."""
    half = period // 2
    full = 2 * half + 1
    aggs = {"__s": F.sum(column), "__c": F.count(column)}
    out = rolling(df, S, aggs, half, half)
    if period % 2:
        return out.withColumn(name, F.when(F.col("__c") == full, F.col("__s") / period)).drop("__s", "__c")
    out = sliding(out, S, lambda w: {"__a": F.lag(column, half).over(w), "__b": F.lead(column, half).over(w)}, half, half)
    v = (F.col("__s") - 0.5 * (F.col("__a") + F.col("__b"))) / period
    return out.withColumn(name, F.when(F.col("__c") == full, v)).drop("__s", "__c", "__a", "__b")


def seasonal_decompose(df: DataFrame, period: int, model="additive", extrapolate_edges=False) -> DataFrame:
    """trend (centred moving average), seasonal (normalised phase means of
    the detrended series), residual."""
    rows = centred_average(df, period)
    if extrapolate_edges:  # hold the nearest trend value at both ends
        n = rows.groupBy(*S).agg(F.max("seq").alias("__n"),
                                 F.min_by("trend", F.when(F.col("trend").isNotNull(), F.col("seq"))).alias("__a"),
                                 F.max_by("trend", F.when(F.col("trend").isNotNull(), F.col("seq"))).alias("__b"))
        rows = attach(rows, n, S, "__n", keep_length=True)
        edge = F.when(F.col("seq") <= period // 2, F.col("__a")).otherwise(F.col("__b"))
        rows = rows.withColumn("trend", F.coalesce("trend", edge)).drop("__a", "__b", "__n")
    mult = model == "multiplicative"
    rows = rows.withColumn("__d", F.col("value") / F.col("trend") if mult else F.col("value") - F.col("trend"))
    rows = phase_values(rows, "__d", period, "seasonal", model).drop("__d")
    res = F.col("value") / (F.col("trend") * F.col("seasonal")) if mult else F.col("value") - F.col("trend") - F.col("seasonal")
    return rows.withColumn("residual", res)


def chi_square_quantile(p: float, df: int) -> float:
    """Quantile by bisection on the series of the lower incomplete gamma."""
    def cdf(x):
        a, z = df / 2.0, x / 2.0
        term = total = 1.0 / a
        for i in range(1, 2000):
            term *= z / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def portmanteau(df: DataFrame, lags=20, test="LJUNG_BOX", df_adjust=0, confidence=0.95, column="value") -> DataFrame:
    """Ljung-Box or Box-Pierce statistic at every lag with the chi-square
    critical value of its degrees of freedom."""
    a = acf(df, lags, column=column)
    r2 = F.col("acf_value") * F.col("acf_value")
    part = F.col("n") * (F.col("n") + 2) * r2 / F.nullif(F.col("n") - F.col("lag"), F.lit(0)) if test == "LJUNG_BOX" else F.col("n") * r2
    w = Window.partitionBy(*S).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)  # at most ``lags`` rows
    dof = F.col("lag") - df_adjust
    table = F.array(*[F.lit(round(chi_square_quantile(confidence, d), 3)) for d in range(1, lags + 1)])
    out = a.withColumn("q_statistic", F.sum(part).over(w)).withColumn("df", dof) \
           .withColumn("critical_value", F.when(dof >= 1, F.try_element_at(table, dof)))
    q, c = F.col("q_statistic"), F.col("critical_value")
    return out.select(*S, F.col("lag").alias("max_lag"), "n", "q_statistic", "df", "critical_value",
                      F.when(q > c, "Reject H0: Residuals are NOT white noise")
                      .when(q <= c, "Fail to Reject H0: Residuals consistent with white noise")
                      .otherwise("Unable to determine").alias("test_result"))


def residuals(actual: DataFrame, fitted: DataFrame) -> DataFrame:
    """Actual minus fitted on (series_id, ts), numbered in time order."""
    j = null_safe_join(actual.select(*S, "ts", "value"), fitted.select(*S, "ts", "fitted_value"), S + ["ts"])
    return series_prepare(j.withColumn("value", F.col("value") - F.col("fitted_value")))


def residual_diagnostics(df: DataFrame) -> DataFrame:
    st = df.groupBy(*S).agg(F.avg("value").alias("__m"), F.stddev("value").alias("__s"), F.max("seq").alias("__n"))
    out = attach(running(df, S, {"cumsum_residual": "value"}), st, S, "__n")
    return out.withColumns({"residual": F.col("value"), "squared_residual": F.col("value") * F.col("value"),
                            "standardized_residual": (F.col("value") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))}).drop("__m", "__s")


def residual_statistics(df: DataFrame) -> DataFrame:
    v = F.col("value")
    rows = sliding(df, S, lambda w: {"__l": F.lag("value").over(w)}, before=1)
    out = rows.groupBy(*S).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std_dev"), F.min(v).alias("min_residual"),
                               F.max(v).alias("max_residual"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
                               F.corr("value", "__l").alias("lag1_correlation"))
    return out.withColumn("mean_check", F.when(F.abs("mean") < 0.01 * F.col("std_dev"), "Good (Mean near 0)").otherwise("Warning (Mean != 0)"))


# ---- forecasts without a model --------------------------------------------

def movavg_forecast(df: DataFrame, window=5, periods=3, weighting="uniform") -> DataFrame:
    """The weighted mean of the last ``window`` values, held for ``periods``
    steps. Weights: uniform, linear (1..w, newest largest) or exponential
    (halving with age)."""
    n = df.groupBy(*S).agg(F.max("seq").alias("__n"))
    last = attach(df, n, S, "__n", keep_length=True).withColumn("age", F.col("__n") - F.col("seq")).filter(F.col("age") < window)
    w = {"uniform": F.lit(1.0), "linear": F.lit(float(window)) - F.col("age"), "exponential": F.pow(F.lit(0.5), F.col("age"))}[weighting]
    f = last.groupBy(*S).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("forecast_value"), F.max("__n").alias("__n"))
    return f.select(*S, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"), "forecast_value")


# ---- smoothing ------------------------------------------------------------

def kernel(method: str, window: int, bandwidth=1.0, poly_order=2):
    """Weights at offsets -h..h."""
    h = window // 2
    i = np.arange(-h, h + 1)
    if method == "simple_ma":
        return np.ones(2 * h + 1)
    if method == "weighted_ma":
        return (h + 1 - np.abs(i)).astype(float)
    if method == "gaussian":
        return np.exp(-0.5 * (i / bandwidth) ** 2)
    if method == "savitzky_golay":
        return np.linalg.pinv(np.vander(i.astype(float), poly_order + 1, increasing=True))[0]
    raise ValueError(method)


def weighted_frame(df: DataFrame, weights, name: str, column="value", renormalise=True, keys=S) -> DataFrame:
    """Sum of weights[i]*x at offsets -h..h. At the ends either the weights
    of the present rows are renormalised or the raw value is kept."""
    h = len(weights) // 2
    def build(w):
        num, den, cnt = F.lit(0.0), F.lit(0.0), F.lit(0)
        for k in range(-h, h + 1):
            c = float(weights[k + h])
            v = F.col(column) if k == 0 else (F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w))
            num = num + F.coalesce(v * c, F.lit(0.0))
            den = den + F.when(v.isNotNull(), c).otherwise(0.0)
            cnt = cnt + F.when(v.isNotNull(), 1).otherwise(0)
        return {name: num / den if renormalise else F.when(cnt == 2 * h + 1, num).otherwise(F.col(column))}
    return sliding(df, keys, build, h, h)


def smooth(df: DataFrame, method="simple_ma", window=5, bandwidth=1.0, poly_order=2, alpha=0.3, noise_ratio=0.1,
           name="smoothed") -> DataFrame:
    """simple_ma, weighted_ma (triangular), gaussian, savitzky_golay, median,
    lowess (tricube local line on the window), exponential, kalman (local level
    model: the gain follows its own recursion from the state/observation noise
    ratio, starting at the first value)."""
    h = window // 2
    if method in ("simple_ma", "weighted_ma", "gaussian"):
        return weighted_frame(df, kernel(method, window, bandwidth), name)
    if method == "savitzky_golay":
        return weighted_frame(df, kernel(method, window, poly_order=poly_order), name, renormalise=False)
    if method == "median":
        return rolling_median(df, S, h, h, name=name)
    if method == "lowess":
        def build(w):
            sw = sx = sy = sxx = sxy = F.lit(0.0)
            for k in range(-h, h + 1):
                c = (1 - (abs(k) / (h + 1.0)) ** 3) ** 3
                v = F.col("value") if k == 0 else (F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w))
                on = F.when(v.isNotNull(), c).otherwise(0.0)
                z = F.coalesce(v, F.lit(0.0))
                sw, sx, sy, sxx, sxy = sw + on, sx + on * k, sy + on * z, sxx + on * (k * k), sxy + on * z * k
            det = sw * sxx - sx * sx
            return {name: F.when(det == 0, sy / sw).otherwise((sxx * sy - sx * sxy) / F.nullif(det, F.lit(0.0)))}
        return sliding(df, S, build, h, h)
    if method == "kalman":
        gains = [1.0]
        while len(gains) < 2 or gains[-1] != gains[-2]:  # it settles at its limit
            p = gains[-1] + noise_ratio
            gains.append(p / (p + 1.0))
            if len(gains) > 2 and gains[-1] in gains[-3:-1]:
                break
        return gain_scan(df, S, gains, name)
    if method != "exponential":
        raise ValueError(method)
    out = affine_scan(df, S, [[1 - alpha]], [alpha], [1.0])
    return out.withColumn(name, F.col("__after")).drop("__before", "__after", "__state")


# Weights of the smoothing score.
SMOOTH_WEIGHTS = {"smoothness": 0.30, "noise_reduction": 0.25, "peak_preservation": 0.20, "trend_preservation": 0.15, "feature_retention": 0.10}


def smooth_quality(df: DataFrame, trend_window=25) -> DataFrame:
    """Scores of (value, smoothed), all computed from the series: roughness
    is the sd of first differences; a peak is a local maximum kept by the
    smoothed line; trend is the correlation with a wide moving average."""
    h = trend_window // 2
    rows = rolling(df, S, {"__wide": F.avg("value")}, h, h)
    def around(w):
        d = lambda c: F.col(c) - F.lag(c).over(w)
        top = lambda c: flag((F.col(c) > F.lag(c).over(w)) & (F.col(c) > F.lead(c).over(w)))
        return {"__d": d("value"), "__e": d("smoothed"), "__pk": top("value"), "__qk": top("smoothed")}
    rows = sliding(rows, S, around, 1, 1)
    a = rows.groupBy(*S).agg(
        F.stddev("__d").alias("original_roughness"), F.stddev("__e").alias("smoothed_roughness"),
        F.var_samp("value").alias("__v"), F.var_samp(F.col("value") - F.col("smoothed")).alias("__r"),
        F.avg(F.pow(F.col("value") - F.col("smoothed"), 2)).alias("mse"),
        (F.sum(F.col("__pk") * F.col("__qk")) / F.nullif(F.sum("__pk"), F.lit(0))).alias("peak_preservation"),
        F.corr("smoothed", "__wide").alias("trend_preservation"), F.corr("smoothed", "value").alias("feature_retention"))
    a = a.withColumns({
        "smoothness": 1.0 - F.col("smoothed_roughness") / F.nullif(F.col("original_roughness"), F.lit(0.0)),
        "noise_reduction": F.col("__r") / F.nullif(F.col("__v"), F.lit(0.0))}).drop("__v", "__r")
    return a.withColumn("quality_score", sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in SMOOTH_WEIGHTS.items()), F.lit(0.0)))


def smooth_tune(df: DataFrame, grid=(("simple_ma", 3), ("simple_ma", 5), ("simple_ma", 9), ("weighted_ma", 5), ("weighted_ma", 9),
                                     ("gaussian", 5), ("savitzky_golay", 7), ("median", 5))) -> DataFrame:
    parts = None
    for m, w in grid:
        q = smooth_quality(smooth(df, m, w)).select(F.lit(m).alias("smoothing_method"), F.lit(w).alias("window_size"), "*")
        parts = q if parts is None else parts.unionByName(q)
    w = Window.partitionBy(*S).orderBy(F.desc(F.round("quality_score", 9)), "smoothing_method", "window_size")
    return parts.withColumn("quality_rank", F.row_number().over(w))  # one row per configuration


def signal_outliers(df: DataFrame) -> DataFrame:
    """z-score, 2 and 3 sigma flags, capped value and the value with 3 sigma
    outliers replaced by the median of 11 rows."""
    st = df.groupBy(*S).agg(F.avg("value").alias("__mean"), F.stddev("value").alias("__sd"), F.max("seq").alias("__n"))
    rows = rolling_median(attach(df, st, S, "__n"), S, 5, 5, name="__med")
    m, s, v = F.col("__mean"), F.col("__sd"), F.col("value")
    z = (v - m) / F.nullif(s, F.lit(0.0))
    far = F.abs(z) > 3
    return rows.withColumns({
        "z_score": z, "is_outlier_3sigma": flag(far), "is_outlier_2sigma": flag(F.abs(z) > 2),
        "signal_capped": F.when(far & (v > m), m + 3 * s).when(far & (v < m), m - 3 * s).otherwise(v),
        "signal_replaced": F.when(far, F.col("__med")).otherwise(v)}).drop("__mean", "__sd", "__med")


def noise_level(df: DataFrame) -> DataFrame:
    rows = sliding(df, S, lambda w: {"__d": F.col("value") - F.lag("value").over(w)}, before=1)
    out = rows.groupBy(*S).agg(
        F.count(F.lit(1)).alias("total_samples"), (F.avg("value") / F.nullif(F.stddev("value"), F.lit(0.0))).alias("snr_estimate"),
        F.avg(F.abs("__d")).alias("avg_abs_change"), F.stddev("__d").alias("std_change"), F.max(F.abs("__d")).alias("max_abs_change"))
    r = F.col("std_change") / F.nullif(F.col("avg_abs_change"), F.lit(0.0))
    return out.withColumns({
        "noise_level": band_gt(r, [(2, "High Noise"), (1, "Moderate Noise")], "Low Noise"),
        "adaptive_window": band("total_samples", [(100, 3), (500, 5), (1000, 10)], 20)})


# ---- change points --------------------------------------------------------

def change_point(df: DataFrame, min_segment=10, penalty=None, max_points=1, method="binary") -> DataFrame:
    """Changes of the mean (series_id, point_no, change_seq, change_ts, gain),
    where rows up to change_seq lie left of the change and the cost of a cutting
    is the summed squared error of its segments around their means.

    ``binary``: binary segmentation from prefix sums. Each round takes the best
    split of each series, up to ``max_points`` rounds; it counts if the cost falls
    by more than ``penalty`` (0 if not given).
    ``optimal``: the cutting with the least cost plus ``penalty`` per change, of
    all cuttings whose segments have ``min_segment`` rows (``optimal_cuts``).
    Points are numbered in time and ``max_points`` is not used; gain is what the
    change saves between its two neighbours. Without a penalty it is
    2 v ln n with v half the mean squared first difference.
    ``cusum``: the place where the sum of deviations from the mean is farthest
    from zero, with its test (``cusum_test``)."""
    if method == "optimal":
        return _optimal_change_points(df, min_segment, penalty)
    if method == "cusum":
        return cusum_test(df)
    if method != "binary":
        raise ValueError(method)
    penalty = penalty or 0.0
    rows = centred(df)
    rows = running(rows, S, {"c1": "__x", "c2": F.col("__x") * F.col("__x")}).select(*S, "ts", "seq", "c1", "c2")
    if max_points > 1:
        rows = cut_lineage(rows)
    zero = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0.0).alias("c1"), F.lit(0.0).alias("c2"))
    at = F.struct(F.col("seq").alias("p"), "c1", "c2")
    cuts = rows.groupBy(*S).agg(F.max("seq").alias("__n"), F.array(zero, F.max_by(at, "seq")).alias("cuts"))
    found = None
    for k in range(1, max_points + 1):
        r = attach(rows, cuts, S, "__n", keep_length=True)
        lo = F.array_max(F.filter("cuts", lambda c: c["p"] < F.col("seq")))
        hi = F.array_min(F.filter("cuts", lambda c: c["p"] >= F.col("seq")))
        r = r.withColumns({"lo": lo, "hi": hi})
        nl, nr = F.col("seq") - F.col("lo.p"), F.col("hi.p") - F.col("seq")
        sse = lambda n, a, b: (b - a * a / n)
        left = sse(nl, F.col("c1") - F.col("lo.c1"), F.col("c2") - F.col("lo.c2"))
        right = sse(nr, F.col("hi.c1") - F.col("c1"), F.col("hi.c2") - F.col("c2"))
        whole = sse(nl + nr, F.col("hi.c1") - F.col("lo.c1"), F.col("hi.c2") - F.col("lo.c2"))
        r = r.filter((nl >= min_segment) & (nr >= min_segment)).withColumn("gain", whole - left - right)
        best = r.groupBy(*S).agg(F.max_by(F.struct("ts", "gain", at.alias("at")), F.struct("gain", -F.col("seq"))).alias("b")) \
                .filter(F.col("b.gain") > penalty)
        if max_points > 1:
            best = cut_lineage(best)
        step = best.select(*S, F.lit(k).alias("point_no"), F.col("b.at.p").alias("change_seq"), F.col("b.ts").alias("change_ts"),
                           F.col("b.gain").alias("gain"))
        found = step if found is None else found.unionByName(step)
        if k < max_points:
            cuts = null_safe_join(cuts, best, S, "left").withColumn(
                "cuts", F.when(F.col("b").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.col("b.at")))).drop("b")
    return found


def _optimal_change_points(df, min_segment, penalty):
    m = df.groupBy(*S).agg(F.avg("value").alias("__m"), F.max("seq").alias("n"))
    rows = written(attach(df, m, S, "n").select(*S, "ts", "seq", (F.col("value") - F.col("__m")).alias("x")))
    ends = [F.max("seq").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    if penalty is None:
        steps = sliding(rows, S, lambda w: {"__d": F.col("x") - F.lag("x").over(w)}, before=1)
        limits = steps.groupBy(*S).agg(*ends, F.coalesce(F.avg(F.col("__d") * F.col("__d")), F.lit(0.0)).alias("__v"))
        limits = limits.withColumn("penalty", F.col("__v") * F.ln("n")).drop("__v")
    else:
        limits = rows.groupBy(*S).agg(*ends).withColumn("penalty", F.lit(float(penalty)))
    cuts = sequence(optimal_cuts(rows, S, "x", written(limits), min_segment).withColumnRenamed("seq", "change_seq"), S, ["change_seq"], "point_no")
    zero = lambda c, w: F.coalesce(F.lag(c).over(w), F.lit(0))
    near = sliding(cuts, S, lambda w: {**{f"b_{c}": zero(c, w) for c in ("change_seq", "c1", "c2")}, **{f"a_{c}": F.lead(c).over(w) for c in ("change_seq", "c1", "c2")}}, 1, 1, "point_no")
    sse = lambda lo, hi: F.col(f"{hi}c2") - F.col(f"{lo}c2") - F.pow(F.col(f"{hi}c1") - F.col(f"{lo}c1"), 2) / (F.col(f"{hi}change_seq") - F.col(f"{lo}change_seq"))
    out = near.filter(F.col("a_change_seq").isNotNull()).withColumn("gain", sse("b_", "a_") - sse("b_", "") - sse("", "a_"))
    at = rows.select(*S, F.col("seq").alias("change_seq"), F.col("ts").alias("change_ts"))
    return null_safe_join(out, at, S + ["change_seq"]).select(*S, F.col("point_no").cast("int").alias("point_no"), "change_seq", "change_ts", "gain")


def cusum_test(df: DataFrame) -> DataFrame:
    """One row per series: the row after which the sum of deviations from the mean
    is farthest from zero (the first such row), what a cut there saves (``gain``),
    the distance over sd sqrt(n), and the chance of so large a value in a series
    without a change (the distribution of the largest distance of a Brownian
    bridge). Series without spread have no row."""
    rows = running(centred(df), S, {"c1": "__x"}).select(*S, "ts", "seq", "c1")
    total = df.groupBy(*S).agg(F.max("seq").alias("n"), F.stddev("value").alias("sd"))
    far = rows.groupBy(*S).agg(F.max_by(F.struct("seq", "ts", "c1"), F.struct(F.round(F.abs("c1"), 9), -F.col("seq"))).alias("b"))
    out = null_safe_join(far, total.filter("sd > 0"), S)
    k, n, d = F.col("b.seq"), F.col("n"), F.abs("b.c1")
    z = d / (F.col("sd") * F.sqrt(n))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * z * z))
    p = F.least(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)), F.lit(1.0))
    return out.select(*S, F.lit(1).alias("point_no"), k.alias("change_seq"), F.col("b.ts").alias("change_ts"),
                      F.when(k < n, d * d / k + d * d / (n - k)).otherwise(0.0).alias("gain"), z.alias("statistic"), F.when(z < 0.1, 1.0).otherwise(p).alias("p_value"))


# ---- reports --------------------------------------------------------------

def series_plot_data(df: DataFrame, points=100, kind="actual") -> DataFrame:
    """Long plot rows with at most ``points`` buckets per series, each with
    first, last, min and max."""
    n = df.groupBy(*S).agg(F.max("seq").alias("__n"))
    rows = attach(df, n, S, "__n", keep_length=True)
    bucket = F.floor((F.col("seq") - 1) * points / F.greatest(F.col("__n"), F.lit(points))).cast("int")
    b = rows.groupBy(*S, bucket.alias("bucket")).agg(
        F.min("ts").alias("ts"), F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"),
        F.min("value").alias("low"), F.max("value").alias("high"))
    return b.unpivot(["series_id", "bucket", "ts"], ["first", "last", "low", "high"], "part", "value") \
            .withColumn("series_type", F.lit(kind))


def forecast_accuracy(df: DataFrame, actual="value", predicted="fitted_value") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    out = rows.groupBy(*S).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.abs(F.nullif(F.col(actual), F.lit(0.0)))) * 100.0).alias("mape"), F.avg(e).alias("bias"),
        (1.0 - F.sum(e * e) / F.nullif(F.count(F.lit(1)) * F.var_pop(actual), F.lit(0.0))).alias("r2"))
    return out.withColumn("accuracy_band", band("mape", [(10, "Excellent"), (20, "Good"), (50, "Acceptable")], "Poor"))


def result_bands(df: DataFrame, value="value") -> DataFrame:
    """Rows of any result by distance from the mean in standard deviations."""
    r = with_stats(df, [F.avg(value).alias("__m"), F.stddev(value).alias("__s")])
    v, m, s = F.col(value), F.col("__m"), F.col("__s")
    cat = F.when(v > m + 2 * s, "High outlier").when(v < m - 2 * s, "Low outlier").when(v > m + s, "Above average") \
           .when(v < m - s, "Below average").otherwise("Normal range")
    out = r.groupBy(cat.alias("distribution_category")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.min(v), 4).alias("min_value"), rnd(F.max(v), 4).alias("max_value"), rnd(F.avg(v), 4).alias("avg_value"))
    return share(out, "n", "percentage")


def result_deciles(df: DataFrame, order=("ts", "series_id"), value="value") -> DataFrame:
    return ntile(df, [], list(order), 10, "time_decile").groupBy("time_decile").agg(
        F.count(F.lit(1)).alias("observations"), rnd(F.min(value), 4).alias("min_value"), rnd(F.max(value), 4).alias("max_value"),
        rnd(F.avg(value), 4).alias("avg_value"), rnd(F.stddev(value), 4).alias("std_dev"))


def result_overview(df: DataFrame, source: DataFrame, value="value") -> DataFrame:
    n = F.count(F.lit(1))
    a = df.agg(n.alias("total_results"), F.count(value).alias("valid_results"), rnd(F.avg(value), 4).alias("result_avg"),
               rnd(F.stddev(value), 4).alias("result_std"), pct(F.count(value), n).alias("c"))
    b = source.agg(n.alias("input_observations"), rnd(F.avg("value"), 4).alias("input_avg"), rnd(F.stddev("value"), 4).alias("input_std"))
    return a.crossJoin(b).withColumn("quality_assessment", band_ge("c", [
        (95, "Excellent - High completeness (>=95%)"), (80, "Good - Acceptable completeness (>=80%)")],
        "Warning - Low completeness (<80%)")).withColumn("completeness_pct", rnd("c", 4)).drop("c")


def config_compare(configs: dict, value="value") -> DataFrame:
    """Statistics of several result tables side by side; the first one with
    most valid rows is recommended."""
    parts = None
    for name, df in configs.items():
        p = df.agg(F.lit(name).alias("config_name"), F.count(F.lit(1)).alias("result_count"), F.count(value).alias("valid_results"),
                   rnd(F.min(value), 4).alias("min_value"), rnd(F.max(value), 4).alias("max_value"), rnd(F.avg(value), 4).alias("avg_value"),
                   rnd(F.stddev(value), 4).alias("std_dev"))
        parts = p if parts is None else parts.unionByName(p)
    w = Window.partitionBy().orderBy(F.desc("valid_results"), "config_name")  # one row per configuration
    return parts.withColumn("recommended", flag(F.row_number().over(w) == 1))


def prep_report(df: DataFrame, column="filled") -> DataFrame:
    """Quality of a prepared series: completeness 0.40, outliers 0.30,
    continuity 0.30, raw against prepared moments, readiness."""
    rows = mark_outliers(df, column)
    n = F.count(F.lit(1))
    a = rows.groupBy(*S).agg(
        n.alias("n"), pct(F.count(column), n).alias("completeness_score"), (100.0 - pct(F.sum("is_outlier"), n)).alias("outlier_score"),
        pct(F.countDistinct("seq"), F.max("seq") - F.min("seq") + 1).alias("continuity_score"),
        F.avg("value").alias("raw_mean"), F.avg(column).alias("prepared_mean"), F.stddev("value").alias("raw_std"),
        F.stddev(column).alias("prepared_std"), F.skewness("value").alias("raw_skewness"), F.skewness(column).alias("prepared_skewness"),
        (n - F.count("value")).alias("original_nulls"), (n - F.count(column)).alias("remaining_nulls"))
    score = F.col("completeness_score") * 0.40 + F.col("outlier_score") * 0.30 + F.col("continuity_score") * 0.30
    ready = (F.col("n") >= 100) & (F.col("completeness_score") >= 95) & (F.col("outlier_score") >= 90) & (F.col("prepared_std") > 0)
    return a.withColumn("overall_quality_score", score).withColumn(
        "overall_readiness", F.when(ready, "READY FOR MODELING").otherwise("NEEDS REVIEW"))


def value_bins(df: DataFrame, width=10.0, value="value") -> DataFrame:
    return share(df.groupBy((F.floor(F.col(value) / width) * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n")), "n", "percentage")


def lag_features(df: DataFrame, train=0.70, validation=0.85) -> DataFrame:
    """Lags 1/7/30, 7-row mean, 30-row volatility, first difference, month,
    day of week, and the split by position."""
    def build(w):
        lag = lambda k: F.lag("value", k).over(w)
        return {"lag1": lag(1), "lag7": lag(7), "lag30": lag(30), "ma7": F.avg("value").over(w.rowsBetween(-6, 0)),
                "volatility30": F.stddev("value").over(w.rowsBetween(-29, 0)), "diff1": F.col("value") - lag(1)}
    n = df.groupBy(*S).agg(F.max("seq").alias("__n"))
    rows = attach(sliding(df, S, build, before=30), n, S, "__n", keep_length=True)
    upto = lambda share: F.col("seq") * share[1] <= F.col("__n") * share[0]
    part = F.when(upto(exact_share(train)), "train").when(upto(exact_share(validation)), "validation").otherwise("test")
    return rows.withColumns({"month": F.month("ts"), "day_of_week": F.dayofweek("ts"), "split": part}).drop("__n")


def series_quality(df: DataFrame) -> DataFrame:
    """Missing, length band, regularity, outliers, trend strength."""
    rows = rolling(mark_outliers(df), S, {"__ma": F.avg("value")}, 5, 5)
    n = F.count(F.lit(1))
    a = rows.groupBy(*S).agg(n.alias("n_observations"), (n - F.count("value")).alias("missing_values"), F.sum("is_outlier").alias("n_outliers"),
                             rnd(pct(F.sum("is_outlier"), n), 4).alias("outlier_pct"), F.stddev("__ma").alias("__t"),
                             F.stddev(F.col("value") - F.col("__ma")).alias("__d"))
    g = gaps(df).filter(F.col("gap").isNotNull()).groupBy(*S).agg(F.countDistinct("gap").alias("n_distinct_intervals"))
    out = null_safe_join(a, g, S, "left")
    return out.withColumns({
        "length_status": band_ge("n_observations", [(50, "PASS - Sufficient data"), (30, "WARNING - Short series")], "FAIL - Insufficient data (<30)"),
        "gap_status": F.when(F.col("n_distinct_intervals") <= 2, "PASS - Regular intervals").otherwise("WARNING - Irregular intervals"),
        "outlier_status": F.when(F.col("outlier_pct") < 5, "PASS - Few outliers").otherwise("WARNING - Many outliers (>5%)"),
        "trend_assessment": F.when(F.col("__t") > F.col("__d"), "Strong trend present").otherwise("Weak or no trend")}).drop("__t", "__d")

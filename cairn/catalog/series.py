"""Queries of the time-series operators."""

from functools import reduce

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.catalog.relational import HOURLY
from cairn.functions.expr import rnd
from cairn.operators import arima as ar, series as ts
from cairn.plans.ordered import attach, sequence

H = "WITH " + HOURLY
W = "(PARTITION BY series_id ORDER BY seq)"


def hours(t):
    return ts.series_prepare(ts.hourly_means(t.events))


def days(t):
    """Daily totals per order status."""
    d = t.orders.groupBy(F.col("o_orderstatus").alias("series_id"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return ts.series_prepare(d)


D = """WITH daily AS (SELECT o_orderstatus AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1,2),
ser AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS seq FROM daily)"""


def gappy(t):
    """Hourly means without hours divisible by 17 and null where divisible by 13."""
    h = ts.hourly_means(t.events).filter(F.hour("ts") % 17 != 0)
    return h.withColumn("value", F.when(F.hour("ts") % 13 != 0, F.col("value")))


GAPPY = """WITH h0 AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1,2),
gap AS (SELECT series_id, ts, CASE WHEN hour(ts) % 13 <> 0 THEN value END AS value FROM h0 WHERE hour(ts) % 17 <> 0),
ser AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS seq FROM gap)"""


def numbered(t):
    return sequence(gappy(t), ["series_id"], ["ts"])


def r(df, places, *cols):
    """Keep all columns, rounding the named ones."""
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ts01_series_prepare", H + " SELECT series_id, epoch_us(ts) AS us, seq, round(value,9) AS value FROM ser")
def _(t):
    return hours(t).select("series_id", F.unix_micros("ts").alias("us"), "seq", rnd("value", 9).alias("value"))


_GAP = ", g AS (SELECT *, (epoch_us(ts)-epoch_us(lag(ts) OVER " + W + "))/1e6 AS gap FROM ser)"


@query("ts02_regularity", H + _GAP + """ SELECT series_id, count(*) AS total_periods, count(DISTINCT gap) AS distinct_intervals, min(gap) AS min_interval, max(gap) AS max_interval, round(avg(gap),6) AS avg_interval,
 CASE WHEN count(DISTINCT gap) <= 1 THEN 'Regular intervals' WHEN count(DISTINCT gap) <= 3 THEN 'Nearly regular - acceptable' ELSE 'Irregular intervals - preprocessing recommended' END AS regularity_status FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def _(t):
    return r(ts.regularity(hours(t)), 6, "avg_interval")


@query("ts02_sampling_rate", H + _GAP + """ SELECT series_id, round(avg(gap),6) AS sampling_interval_sec, round(1/avg(gap),12) AS sampling_rate_hz, round(0.5/avg(gap),12) AS nyquist_hz, round(stddev(gap)/avg(gap)*100,6) AS irregularity_pct,
 CASE WHEN stddev(gap)/avg(gap)*100 < 1 THEN 'Uniform - Excellent for filtering' WHEN stddev(gap)/avg(gap)*100 < 5 THEN 'Nearly uniform - Good for filtering' ELSE 'Irregular - Resample before filtering' END AS sampling_quality FROM g GROUP BY 1""")
def _(t):
    return r(r(ts.sampling_rate(hours(t)), 6, "sampling_interval_sec", "irregularity_pct"), 12, "sampling_rate_hz", "nyquist_hz")


@query("ts03_data_validate", GAPPY + """, g AS (SELECT *, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)))/1e6 AS gap FROM gap),
 a AS (SELECT series_id, count(*) FILTER (gap>5400) AS total_gaps, round(avg(gap/3600.0) FILTER (gap>5400),6) AS avg_gap_hours, max(gap/3600.0) FILTER (gap>5400) AS max_gap_hours,
  sum(CASE WHEN gap>5400 THEN round(gap/3600)-1 ELSE 0 END)::BIGINT AS missing_stamps, count(*) AS total_rows, count(*)-count(value) AS null_count, round(100.0*(count(*)-count(value))/count(*),4) AS missing_pct FROM g GROUP BY 1)
 SELECT *, 0 AS duplicate_stamps FROM a""")
def _(t):
    return r(ts.data_validate(gappy(t)), 6, "avg_gap_hours")


@query("ts03_irregular_stamps", """WITH d AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
SELECT user_id::VARCHAR AS series_id, count(*) FILTER (u-p > 86400000000*1.5) AS total_gaps FROM d GROUP BY 1""")
def _(t):
    e = t.events.select(F.col("user_id").cast("string").alias("series_id"), "ts", "value")
    return ts.data_validate(e, 86400.0).select("series_id", "total_gaps")


def _fill(method, sql):
    @query(f"ts04_fill_{method}", GAPPY + sql)
    def _(t):
        return ts.fill(numbered(t), method).select("series_id", "seq", rnd("filled", 9).alias("filled"))


_fill("forward", " SELECT series_id, seq, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING),9) AS filled FROM ser")
_fill("backward", " SELECT series_id, seq, round(first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),9) AS filled FROM ser")
_fill("linear", """, x AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS pt,
 first_value(value IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f AS nt FROM ser
 WINDOW b AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT series_id, seq, round(coalesce(value, pv+(nv-pv)*((epoch_us(ts)-pt)/nullif(nt-pt,0)), pv, nv),9) AS filled FROM x""")
_fill("mean", " SELECT series_id, seq, round(coalesce(value, avg(value) OVER (PARTITION BY series_id)),9) AS filled FROM ser")
_fill("seasonal", " SELECT series_id, seq, round(coalesce(value, avg(value) OVER (PARTITION BY series_id, (seq-1)%24)),9) AS filled FROM ser")


@query("ts05_calendar_features", H + """ SELECT series_id, seq, year(ts)::INT AS year, quarter(ts)::INT AS quarter, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, (dayofweek(ts)+1)::INT AS day_of_week,
 (dayofweek(ts) IN (0,6))::INT AS is_weekend, (month(ts)=12 AND day(ts) BETWEEN 20 AND 31)::INT AS is_holiday FROM ser""")
def _(t):
    return ts.calendar_features(hours(t)).drop("ts", "value")


def _prep_sql(src, sig):
    return f"""m AS (SELECT *, avg(v) OVER (PARTITION BY series_id) AS mm, stddev(v) OVER (PARTITION BY series_id) AS ss, abs(v-lag(v) OVER {W}) AS d FROM {src}),
 q AS (SELECT series_id, count(v)/count(*) AS completeness, 1.0::DOUBLE AS consistency, 1-sum((abs(v-mm)>{sig}*ss)::INT)/count(*) AS outlier, 1/(1+coalesce(stddev(d)/nullif(stddev(v),0),0)) AS continuity FROM m GROUP BY 1)"""


@query("ts06_prep_quality", GAPPY + ", fl AS (SELECT *, coalesce(value, avg(value) OVER (PARTITION BY series_id)) AS v FROM ser), " + _prep_sql("fl", 3) + """
 SELECT series_id, round(completeness,8) AS completeness, round(consistency,8) AS consistency, round(outlier,8) AS outlier, round(continuity,8) AS continuity, round(completeness*0.3+consistency*0.2+outlier*0.25+continuity*0.25,8) AS total_quality_score FROM q""")
def _(t):
    return r(ts.prep_quality(ts.fill(numbered(t), "mean")), 8, "completeness", "consistency", "outlier", "continuity", "total_quality_score")


@query("ts06_prep_tune")
def _(t):
    return ts.prep_tune(numbered(t))


@query("ts07_series_summary", H + """, s AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m, stddev(value) OVER (PARTITION BY series_id) AS sd FROM ser)
 SELECT series_id, count(*) AS n_observations, round(min(value),6) AS min_value, round(max(value),6) AS max_value, round(avg(value),8) AS mean_value, round(stddev(value),8) AS std_dev, sum((abs(value-m)>3*sd)::INT)::BIGINT AS potential_outliers,
 count(*) FILTER (value IS NULL) AS null_count, round(stddev(value)/avg(value),8) AS coefficient_of_variation, CASE WHEN count(*)>=100 THEN 'EXCELLENT - Sufficient data for robust analysis' WHEN count(*)>=50 THEN 'GOOD - Adequate data for analysis'
 WHEN count(*)>=30 THEN 'ACCEPTABLE - Minimum data available' ELSE 'WARNING - Short time series may affect analysis quality' END AS data_sufficiency, CASE WHEN count(*)>=30 THEN 'READY' ELSE 'PROCEED WITH CAUTION' END AS readiness FROM s GROUP BY 1""")
def _(t):
    return r(r(ts.series_summary(hours(t)), 8, "mean_value", "std_dev", "coefficient_of_variation"), 6, "min_value", "max_value")


_ACF = """, c AS (SELECT series_id, seq, value - avg(value) OVER (PARTITION BY series_id) AS x FROM ser), z AS (SELECT series_id, sum(x*x) AS c0, count(*) AS n FROM c GROUP BY 1),
 k AS (SELECT a.series_id, (a.seq-b.seq)::INT AS lag, sum(a.x*b.x) AS c FROM c a JOIN c b ON a.series_id=b.series_id AND a.seq-b.seq BETWEEN 1 AND 20 GROUP BY 1,2),
 acf AS (SELECT k.series_id, lag, n, c, c0, c/c0 AS r FROM k JOIN z USING (series_id))"""


@query("ts08_acf", H + _ACF + " SELECT series_id, lag, n, round(r,9) AS acf_value, round(-1.959963984540054/sqrt(n),9) AS lower_bound, round(1.959963984540054/sqrt(n),9) AS upper_bound FROM acf")
def _(t):
    return r(ts.acf(hours(t)), 9, "acf_value", "lower_bound", "upper_bound")


@query("ts08_acf_pairs", H + _ACF + " SELECT series_id, lag, n, round((c/(n-lag))/(c0/(n-1)),9) AS acf_value FROM acf")
def _(t):
    return r(ts.acf(hours(t), normalisation="pairs"), 9, "acf_value").drop("lower_bound", "upper_bound")


@query("ts09_pacf", H + _ACF + """, p AS (SELECT series_id, max(n) AS n, max(r) FILTER (lag=1) AS a, max(r) FILTER (lag=2) AS b, max(r) FILTER (lag=3) AS c FROM acf GROUP BY 1),
 u AS (SELECT series_id, n, unnest([1,2,3]) AS lag, unnest([a, (b-a*a)/(1-a*a), (c - 2*a*b + a*b*b + a*a*a - a*a*c) / (1 - 2*a*a - b*b + 2*a*a*b)]) AS v FROM p)
 SELECT series_id, lag, round(v,8) AS pacf_value, round(-1.959963984540054/sqrt(n),9) AS lower_bound, round(1.959963984540054/sqrt(n),9) AS upper_bound FROM u""")
def _(t):
    return r(r(ts.pacf(hours(t), 3), 8, "pacf_value"), 9, "lower_bound", "upper_bound")


# Durbin and Levinson's recursion on lists
_DL = H.replace("WITH ", "WITH RECURSIVE ", 1) + _ACF + """, r AS (SELECT series_id, max(n) AS n, list(r ORDER BY lag) AS r FROM acf GROUP BY 1),
 d AS (SELECT series_id, n, r, 1 AS k, [r[1]] AS phi FROM r
 UNION ALL SELECT series_id, n, r, k+1, list_append([phi[j]-p*phi[k+1-j] for j in range(1,k+1)], p) FROM (SELECT *, (r[k+1]-list_sum([phi[j]*r[k+1-j] for j in range(1,k+1)]))/(1-list_sum([phi[j]*r[j] for j in range(1,k+1)])) AS p FROM d WHERE k<20))
 SELECT series_id, k AS lag, round(phi[k],8) AS pacf_value, round(-1.959963984540054/sqrt(n),9) AS lower_bound, round(1.959963984540054/sqrt(n),9) AS upper_bound FROM d"""


@query("ts09_pacf_20", _DL)
def _(t):
    return r(r(ts.pacf(hours(t), 20), 8, "pacf_value"), 9, "lower_bound", "upper_bound")


@query("ts10_diff", H + f", d AS (SELECT *, value - 2*lag(value,1) OVER {W} + lag(value,2) OVER {W} AS d2 FROM ser) SELECT series_id, seq, round(d2 - lag(d2,24) OVER {W},8) AS diff_value FROM d")
def _(t):
    return ts.diff(hours(t), 2, 1, 24).select("series_id", "seq", rnd("diff_value", 8).alias("diff_value"))


_PV = lambda s, c1, c5, c10, op: f"CASE WHEN {s} {op} {c1} THEN 0.01 WHEN {s} {op} {c5} THEN 0.01+({s}-({c1}))*0.04/(({c5})-({c1})) WHEN {s} {op} {c10} THEN 0.05+({s}-({c5}))*0.05/(({c10})-({c5})) ELSE 0.1 END"


@query("ts11_stationarity_kpss", H + """, e AS (SELECT series_id, seq, value-avg(value) OVER (PARTITION BY series_id) AS e FROM ser),
 s AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c, lag(e,1) OVER (PARTITION BY series_id ORDER BY seq) AS e1, lag(e,2) OVER (PARTITION BY series_id ORDER BY seq) AS e2 FROM e),
 q AS (SELECT series_id, count(*) AS n, sum(c*c)/(count(*)*count(*))/(sum(e*e)/count(*) + 2*(2.0/3)*sum(e*e1)/count(*) + 2*(1.0/3)*sum(e*e2)/count(*)) AS st FROM s GROUP BY 1)
 SELECT series_id, 'KPSS' AS test, n, round(st,7) AS statistic, 0.463 AS critical_value, round(""".replace("0.463 AS", "0.463::DOUBLE AS") + _PV("st", .739, .463, .347, ">=") + ",7) AS p_value, CASE WHEN st>0.463 THEN 'Non-stationary' ELSE 'Stationary' END AS verdict FROM q")
def _(t):
    return r(ts.stationarity_test(hours(t), "KPSS", lags=2), 7, "statistic", "p_value")


@query("ts11_stationarity_adf0", H + f""", d AS (SELECT series_id, value-lag(value) OVER {W} AS y, lag(value) OVER {W} AS x FROM ser), f AS (SELECT * FROM d WHERE y IS NOT NULL),
 q AS (SELECT series_id, count(*) AS n, regr_slope(y,x) AS b, regr_sxx(y,x) AS sxx, regr_syy(y,x)-regr_slope(y,x)*regr_sxy(y,x) AS sse FROM f GROUP BY 1), s AS (SELECT *, b/sqrt(sse/(n-2)/sxx) AS st FROM q)
 SELECT series_id, 'ADF' AS test, n, round(st,6) AS statistic, (-2.86)::DOUBLE AS critical_value, round(""" + _PV("st", -3.43, -2.86, -2.57, "<=") + ",6) AS p_value, CASE WHEN st < -2.86 THEN 'Stationary' ELSE 'Non-stationary' END AS verdict FROM s")
def _(t):
    return r(ts.stationarity_test(hours(t), "ADF", lags=0), 6, "statistic", "p_value")


@query("ts11_stationarity_adf4")
def _(t):
    return ts.stationarity_test(hours(t), "ADF", lags=4)


@query("ts11_stationarity_pp")
def _(t):
    return ts.stationarity_test(hours(t), "PP", lags=4)


@query("ts11_p_values")
def _(t):
    h = hours(t)
    tests = [ts.stationarity_test(h, test, lags=2, trend=trend, p_values="asymptotic").withColumn("trend", F.lit(trend))
             for test in ("ADF", "PP", "KPSS") for trend in ("constant", "trend")]
    return reduce(lambda a, b: a.unionByName(b), tests)


@query("ts12_rolling_stationarity", H + """, q AS (SELECT *, avg(value) OVER a AS m12, stddev(value) OVER a AS s12, avg(value) OVER b AS m24, stddev(value) OVER b AS s24 FROM ser
 WINDOW a AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
 SELECT series_id, round(stddev(m12),7) AS mean_variability_12, round(stddev(s12),7) AS std_variability_12, round(stddev(m24),7) AS mean_variability_24, round(stddev(s24),7) AS std_variability_24,
 CASE WHEN stddev(m12)/avg(m12)<0.1 THEN 'Likely stationary - d=0 may be sufficient' WHEN stddev(m12)/avg(m12)<0.3 THEN 'Moderately non-stationary - d=1 recommended' ELSE 'Non-stationary - d=1 or d=2 required' END AS stationarity_recommendation FROM q GROUP BY 1""")
def _(t):
    return r(ts.rolling_stationarity(hours(t)), 7, "mean_variability_12", "std_variability_12", "mean_variability_24", "std_variability_24")


@query("ts13_seasonality_detect", H + f""", q AS (SELECT series_id, value, lag(value,7) OVER {W} AS a, lag(value,12) OVER {W} AS b, lag(value,24) OVER {W} AS c, lag(value,30) OVER {W} AS d FROM ser), z AS (SELECT series_id, corr(value,a) AS a, corr(value,b) AS b, corr(value,c) AS c, corr(value,d) AS d FROM q GROUP BY 1)
 SELECT series_id, round(a,8) AS correlation_lag7, round(b,8) AS correlation_lag12, round(c,8) AS correlation_lag24, round(d,8) AS correlation_lag30, CASE WHEN abs(a)>.5 THEN 'Weekly seasonality detected (period=7)' WHEN abs(b)>.5 THEN 'Monthly seasonality detected (period=12)'
 WHEN abs(c)>.5 THEN 'Bi-annual seasonality detected (period=24)' WHEN abs(d)>.5 THEN 'Monthly seasonality detected (period=30)' ELSE 'No strong seasonal pattern detected' END AS seasonal_assessment FROM z""")
def _(t):
    return r(ts.seasonality_detect(hours(t)), 8, *[f"correlation_lag{k}" for k in (7, 12, 24, 30)])


def _decomp(op, inv, centre):
    return H + f""", a AS (SELECT *, CASE WHEN count(value) OVER w = 25 THEN (sum(value) OVER w - 0.5*(lag(value,12) OVER v + lead(value,12) OVER v))/24 END AS trend FROM ser
 WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), v AS (PARTITION BY series_id ORDER BY seq)),
 p AS (SELECT series_id, (seq-1)%24 AS ph, avg(value {op} trend) AS s FROM a GROUP BY 1,2), c AS (SELECT series_id, ph, s {op} avg(s) OVER (PARTITION BY series_id) AS seasonal FROM p)
 SELECT a.series_id, seq, round(trend,8) AS trend, round(seasonal,8) AS seasonal, round(value {op} (trend {inv} seasonal),8) AS residual FROM a JOIN c ON a.series_id=c.series_id AND (seq-1)%24=ph"""


@query("ts14_seasonal_decompose", _decomp("-", "+", ""))
def _(t):
    return r(ts.seasonal_decompose(hours(t), 24), 8, "trend", "seasonal", "residual").drop("ts", "value")


@query("ts14_seasonal_decompose_mult", _decomp("/", "*", ""))
def _(t):
    return r(ts.seasonal_decompose(hours(t), 24, "multiplicative"), 8, "trend", "seasonal", "residual").drop("ts", "value")


# Published 0.95 chi-square points of 1 to 20 degrees of freedom, for the oracle.
CHI95_PUBLISHED = "[3.841,5.991,7.815,9.488,11.070,12.592,14.067,15.507,16.919,18.307,19.675,21.026,22.362,23.685,24.996,26.296,27.587,28.869,30.144,31.410]"


def _port(part):
    return H + _ACF + f""", q AS (SELECT series_id, lag AS max_lag, n, sum({part}) OVER (PARTITION BY series_id ORDER BY lag) AS q, lag AS df, ({CHI95_PUBLISHED}::DOUBLE[])[lag] AS critical_value FROM acf)
 SELECT series_id, max_lag, n, round(q,7) AS q_statistic, df, critical_value, CASE WHEN q>critical_value THEN 'Reject H0: Residuals are NOT white noise' ELSE 'Fail to Reject H0: Residuals consistent with white noise' END AS test_result FROM q"""


@query("ts15_portmanteau_ljung_box", _port("n*(n+2)*r*r/(n-lag)"))
def _(t):
    return r(ts.portmanteau(hours(t)), 7, "q_statistic")


@query("ts15_portmanteau_box_pierce", _port("n*r*r"))
def _(t):
    return r(ts.portmanteau(hours(t), test="BOX_PIERCE"), 7, "q_statistic")


def _resid(t):
    """Residuals of a forecast by the value of the same series a day earlier."""
    from cairn.plans.ordered import sliding
    f = sliding(hours(t), ["series_id"], lambda w: {"fitted_value": F.lag("value", 24).over(w)}, before=24)
    return ts.residuals(hours(t), f.filter("fitted_value is not null"))


_RES = H + f", rs AS (SELECT series_id, seq-24 AS seq, value - lag(value,24) OVER {W} AS e FROM ser), e AS (SELECT * FROM rs WHERE e IS NOT NULL)"


@query("ts16_residual_diagnostics", _RES + """ SELECT series_id, seq, round(e,8) AS residual, round(e*e,6) AS squared_residual, round((e-avg(e) OVER (PARTITION BY series_id))/stddev(e) OVER (PARTITION BY series_id),8) AS standardized_residual,
 round(sum(e) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING),7) AS cumsum_residual FROM e""")
def _(t):
    d = ts.residual_diagnostics(_resid(t))
    return r(r(r(d, 8, "residual", "standardized_residual"), 6, "squared_residual"), 7, "cumsum_residual").drop("ts", "value")


@query("ts16_residual_statistics", _RES + f""", x AS (SELECT *, lag(e) OVER {W} AS l, avg(e) OVER (PARTITION BY series_id) AS m, stddev_pop(e) OVER (PARTITION BY series_id) AS s FROM e)
 SELECT series_id, count(*) AS n, round(avg(e),7) AS mean, round(stddev(e),7) AS std_dev, round(min(e),7) AS min_residual, round(max(e),7) AS max_residual, round(avg(pow((e-m)/s,3)),6) AS skewness, round(avg(pow((e-m)/s,4))-3,6) AS kurtosis, round(corr(e,l),7) AS lag1_correlation,
 CASE WHEN abs(avg(e))<0.01*stddev(e) THEN 'Good (Mean near 0)' ELSE 'Warning (Mean != 0)' END AS mean_check FROM x GROUP BY 1""")
def _(t):
    return r(r(ts.residual_statistics(_resid(t)), 7, "mean", "std_dev", "min_residual", "max_residual", "lag1_correlation"), 6, "skewness", "kurtosis")


@query("ts17_arima_ar1", H + f""", d AS (SELECT series_id, value-avg(value) OVER (PARTITION BY series_id) AS y, lag(value) OVER {W} - avg(value) OVER (PARTITION BY series_id) AS x FROM ser), f AS (SELECT * FROM d WHERE x IS NOT NULL),
 q AS (SELECT series_id, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, (regr_syy(y,x)-regr_slope(y,x)*regr_sxy(y,x))/count(*) AS s2 FROM f GROUP BY 1), m AS (SELECT series_id, avg(value) AS mu FROM ser GROUP BY 1),
 o AS (SELECT series_id, unnest(['AR(1)','Intercept','Sigma2']) AS name, unnest([b, a+mu*(1-b), s2]) AS v FROM q JOIN m USING (series_id)) SELECT series_id, name, round(v,6) AS value FROM o""")
def _(t):
    m = ar.arima_estimate(hours(t), (1, 0, 0))
    return m.filter("name in ('AR(1)', 'Intercept', 'Sigma2')").select("series_id", "name", rnd("value", 6).alias("value"))


@query("ts17_arima_estimate")
def _(t):
    return ar.arima_estimate(hours(t), (2, 1, 1))


@query("ts17_arima_residuals")
def _(t):
    return ar.arima_fitted(hours(t), (1, 0, 1))


@query("ts17_sarima_estimate")
def _(t):
    return ar.arima_estimate(hours(t), (1, 0, 0), (1, 1, 0, 24))


@query("ts17_arima_css_ar1", H + f""", d AS (SELECT series_id, value-avg(value) OVER (PARTITION BY series_id) AS y, lag(value) OVER {W} - avg(value) OVER (PARTITION BY series_id) AS x FROM ser), f AS (SELECT * FROM d WHERE x IS NOT NULL),
 q AS (SELECT series_id, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, (regr_syy(y,x)-regr_slope(y,x)*regr_sxy(y,x))/count(*) AS s2 FROM f GROUP BY 1), m AS (SELECT series_id, avg(value) AS mu FROM ser GROUP BY 1),
 o AS (SELECT series_id, unnest(['AR(1)','Intercept','Sigma2']) AS name, unnest([b, a+mu*(1-b), s2]) AS v FROM q JOIN m USING (series_id)) SELECT series_id, name, round(v,6) AS value FROM o""")
def _(t):
    m = ar.arima_estimate(hours(t), (1, 0, 0), fit_method="CSS")
    return m.filter("name in ('AR(1)', 'Intercept', 'Sigma2')").select("series_id", "name", rnd("value", 6).alias("value"))


@query("ts17_arima_css")
def _(t):
    return ar.arima_estimate(hours(t), (1, 0, 1), fit_method="CSS")


@query("ts17_arima_css_residuals")
def _(t):
    return ar.arima_fitted(hours(t), (0, 1, 1), fit_method="CSS")


@query("ts18_arima_forecast_css")
def _(t):
    return ar.arima_forecast(hours(t), (1, 0, 1), periods=12, fit_method="CSS")


@query("ts18_arima_forecast_ar1", H + f""", d AS (SELECT series_id, seq, value, lag(value) OVER {W} AS x FROM ser), f AS (SELECT * FROM d WHERE x IS NOT NULL),
 q AS (SELECT series_id, regr_slope(value,x) AS b, regr_intercept(value,x) AS a, sqrt((regr_syy(value,x)-regr_slope(value,x)*regr_sxy(value,x))/count(*)) AS s, arg_max(value, seq) AS l FROM f GROUP BY 1), h AS (SELECT unnest(range(1,6)) AS step)
 SELECT series_id, step::INT AS step, round(pow(b,step)*l + a*(1-pow(b,step))/(1-b),6) AS forecast_value, round(pow(b,step)*l + a*(1-pow(b,step))/(1-b) - 1.959963984540054*s*sqrt((1-pow(b,2*step))/(1-b*b)),6) AS lower_bound,
 round(pow(b,step)*l + a*(1-pow(b,step))/(1-b) + 1.959963984540054*s*sqrt((1-pow(b,2*step))/(1-b*b)),6) AS upper_bound FROM q CROSS JOIN h""")
def _(t):
    return r(ar.arima_forecast(hours(t), (1, 0, 0), periods=5), 6, "forecast_value", "lower_bound", "upper_bound")


@query("ts18_arima_forecast")
def _(t):
    return ar.arima_forecast(hours(t), (2, 1, 1), periods=12)


@query("ts18_sarima_forecast")
def _(t):
    return ar.arima_forecast(hours(t), (1, 0, 0), (1, 1, 0, 24), periods=24)


def _mavg(kind, w):
    return H + f""", a AS (SELECT *, max(seq) OVER (PARTITION BY series_id) - seq AS age FROM ser), f AS (SELECT series_id, sum(value*{w})/sum({w}) AS v FROM a WHERE age < 5 GROUP BY 1)
 SELECT series_id, unnest([1,2,3]) AS step, round(v,8) AS forecast_value FROM f"""


for _kind, _w in {"uniform": "1.0", "linear": "(5.0-age)", "exponential": "pow(0.5, age)"}.items():
    @query(f"ts19_movavg_{_kind}", _mavg(_kind, _w))
    def _(t, kind=_kind):
        return r(ts.movavg_forecast(hours(t), 5, 3, kind), 8, "forecast_value")


def _frame(weights, renorm=True):
    h = len(weights) // 2
    term = lambda k: f"lag(value,{-k}) OVER w" if k < 0 else (f"lead(value,{k}) OVER w" if k else "value")
    num = "+".join(f"coalesce({float(c)!r}*{term(k)},0)" for k, c in zip(range(-h, h + 1), weights))
    den = "+".join(f"CASE WHEN {term(k)} IS NOT NULL THEN {float(c)!r}::DOUBLE ELSE 0 END" for k, c in zip(range(-h, h + 1), weights))
    e = f"({num})/({den})" if renorm else f"CASE WHEN lag(value,{h}) OVER w IS NOT NULL AND lead(value,{h}) OVER w IS NOT NULL THEN {num} ELSE value END"
    return H + f" SELECT series_id, seq, round({e},8) AS smoothed FROM ser WINDOW w AS {W}"


def _smooth(key, sql, *args, **kw):
    @query(key, sql)
    def _(t):
        return ts.smooth(hours(t), *args, **kw).select("series_id", "seq", rnd("smoothed", 8).alias("smoothed"))


_smooth("ts20_smooth_simple_ma", _frame([1, 1, 1, 1, 1]), "simple_ma", 5)
_smooth("ts20_smooth_weighted_ma", _frame([1, 2, 3, 2, 1]), "weighted_ma", 5)
_smooth("ts20_smooth_gaussian", _frame([__import__("math").exp(-0.5 * i * i) for i in range(-2, 3)]), "gaussian", 5)
_smooth("ts20_smooth_savitzky_golay", _frame([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35], False), "savitzky_golay", 5)
_smooth("ts20_smooth_median", H + " SELECT series_id, seq, round(median(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),8) AS smoothed FROM ser", "median", 5)
_smooth("ts20_smooth_exponential", "WITH RECURSIVE " + HOURLY + """, e AS (SELECT series_id, seq, value AS s FROM ser WHERE seq=1 UNION ALL SELECT ser.series_id, ser.seq, 0.7*e.s + 0.3*ser.value FROM e JOIN ser ON ser.series_id=e.series_id AND ser.seq=e.seq+1)
 SELECT series_id, seq, round(s,8) AS smoothed FROM e""", "exponential", alpha=0.3)
_smooth("ts20_smooth_lowess", H + """, n AS (SELECT a.series_id, a.seq, (b.seq-a.seq) AS k, b.value AS v, pow(1-pow(abs(b.seq-a.seq)/4.0,3),3) AS w FROM ser a JOIN ser b ON a.series_id=b.series_id AND b.seq BETWEEN a.seq-3 AND a.seq+3),
 q AS (SELECT series_id, seq, sum(w) AS sw, sum(w*k) AS sx, sum(w*v) AS sy, sum(w*k*k) AS sxx, sum(w*k*v) AS sxy FROM n GROUP BY 1,2) SELECT series_id, seq, round((sxx*sy-sx*sxy)/(sw*sxx-sx*sx),8) AS smoothed FROM q""", "lowess", 7)
_smooth("ts20_smooth_kalman", "WITH RECURSIVE " + HOURLY + """, e AS (SELECT series_id, seq, value AS s, 1.0::DOUBLE AS k FROM ser WHERE seq=1
 UNION ALL SELECT x.series_id, x.seq, e.s + (e.k+0.1)/(e.k+1.1)*(x.value-e.s), (e.k+0.1)/(e.k+1.1) FROM e JOIN ser x ON x.series_id=e.series_id AND x.seq=e.seq+1)
 SELECT series_id, seq, round(s,8) AS smoothed FROM e""", "kalman")


@query("ts21_smooth_quality", H + f""", s AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm, avg(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS wide FROM ser),
 d AS (SELECT *, value-lag(value) OVER {W} AS d, sm-lag(sm) OVER {W} AS e, coalesce((value>lag(value) OVER {W} AND value>lead(value) OVER {W})::INT,0) AS pk, coalesce((sm>lag(sm) OVER {W} AND sm>lead(sm) OVER {W})::INT,0) AS qk FROM s)
 SELECT series_id, round(1-stddev(e)/stddev(d),7) AS smoothness, round(var_samp(value-sm)/var_samp(value),7) AS noise_reduction, round(sum(pk*qk)/sum(pk),7) AS peak_preservation, round(corr(sm,wide),7) AS trend_preservation, round(corr(sm,value),7) AS feature_retention,
 round(0.3*(1-stddev(e)/stddev(d))+0.25*var_samp(value-sm)/var_samp(value)+0.2*sum(pk*qk)/sum(pk)+0.15*corr(sm,wide)+0.1*corr(sm,value),7) AS quality_score FROM d GROUP BY 1""")
def _(t):
    q = ts.smooth_quality(ts.smooth(hours(t), "simple_ma", 5))
    return r(q.drop("original_roughness", "smoothed_roughness", "mse"), 7, *ts.SMOOTH_WEIGHTS, "quality_score")


@query("ts21_smooth_tune")
def _(t):
    return ts.smooth_tune(hours(t))


@query("ts22_signal_outliers", H + """, q AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m, stddev(value) OVER (PARTITION BY series_id) AS s, median(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS md FROM ser), z AS (SELECT *, (value-m)/s AS z FROM q)
 SELECT series_id, seq, round(z,8) AS z_score, (abs(z)>3)::INT AS is_outlier_3sigma, (abs(z)>2)::INT AS is_outlier_2sigma, round(CASE WHEN z>3 THEN m+3*s WHEN z<-3 THEN m-3*s ELSE value END,8) AS signal_capped, round(CASE WHEN abs(z)>3 THEN md ELSE value END,8) AS signal_replaced FROM z""")
def _(t):
    return r(ts.signal_outliers(hours(t)), 8, "z_score", "signal_capped", "signal_replaced").drop("ts", "value")


@query("ts23_noise_level", H + f""", d AS (SELECT *, value-lag(value) OVER {W} AS d FROM ser)
 SELECT series_id, count(*) AS total_samples, round(avg(value)/stddev(value),8) AS snr_estimate, round(avg(abs(d)),8) AS avg_abs_change, round(stddev(d),8) AS std_change, round(max(abs(d)),8) AS max_abs_change,
 CASE WHEN stddev(d)/avg(abs(d))>2 THEN 'High Noise' WHEN stddev(d)/avg(abs(d))>1 THEN 'Moderate Noise' ELSE 'Low Noise' END AS noise_level, CASE WHEN count(*)<100 THEN 3 WHEN count(*)<500 THEN 5 WHEN count(*)<1000 THEN 10 ELSE 20 END AS adaptive_window FROM d GROUP BY 1""")
def _(t):
    return r(ts.noise_level(hours(t)), 8, "snr_estimate", "avg_abs_change", "std_change", "max_abs_change")


@query("ts24_change_point", H + f""", c AS (SELECT *, value-avg(value) OVER (PARTITION BY series_id) AS x FROM ser), p AS (SELECT *, sum(x) OVER a AS s1, sum(x*x) OVER a AS s2, sum(x) OVER b AS t1, sum(x*x) OVER b AS t2, count(*) OVER b AS n FROM c
 WINDOW a AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY series_id)), g AS (SELECT *, (t2-t1*t1/n) - (s2-s1*s1/seq) - ((t2-s2)-(t1-s1)*(t1-s1)/(n-seq)) AS gain FROM p WHERE seq>=10 AND n-seq>=10)
 SELECT series_id, 1 AS point_no, seq AS change_seq, epoch_us(ts) AS change_us, round(gain,5) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, seq)=1""")
def _(t):
    return ts.change_point(hours(t)).select("series_id", "point_no", "change_seq", F.unix_micros("change_ts").alias("change_us"), rnd("gain", 5).alias("gain"))


@query("ts24_change_point_multi")
def _(t):
    return ts.change_point(days(t), min_segment=30, max_points=3)


# the full search: least cost of the first t rows over all starts of the last segment
_CUT = D.replace("WITH", "WITH RECURSIVE", 1) + """, zs AS (SELECT series_id, seq, ts, (value-avg(value) OVER w)/stddev(value) OVER w AS x FROM ser WINDOW w AS (PARTITION BY series_id)),
 ps AS (SELECT *, sum(x) OVER w AS c1, sum(x*x) OVER w AS c2 FROM zs WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 pre AS (SELECT series_id, count(*) AS n, list_prepend(0.0, list(c1 ORDER BY seq)) AS a, list_prepend(0.0, list(c2 ORDER BY seq)) AS b FROM ps GROUP BY 1),
 dp AS (SELECT series_id, 0::BIGINT AS t, [-6.0::DOUBLE] AS f, [0::BIGINT] AS back FROM pre UNION ALL
  SELECT series_id, t+1, list_append(f, list_min(c)), list_append(back, list_position(c, list_min(c))-1) FROM (SELECT dp.series_id, t, f, back,
   list_transform(range(0, greatest(t+1-10,0)+1), lambda s: CASE WHEN t+1<10 THEN 'inf'::DOUBLE ELSE f[s+1]+6+(b[t+2]-b[s+1])-(a[t+2]-a[s+1])**2/(t+1-s) END) AS c FROM dp JOIN pre USING (series_id) WHERE t<n)),
 walk AS (SELECT series_id, back, back[t+1] AS s FROM dp JOIN pre USING (series_id) WHERE t=n UNION ALL SELECT series_id, back, back[s+1] FROM walk WHERE s>0),
 cut AS (SELECT series_id, s, lag(s,1,0) OVER w AS lo, coalesce(lead(s) OVER w, n) AS hi, a, b, row_number() OVER w AS point_no FROM walk JOIN pre USING (series_id) WHERE s>0 WINDOW w AS (PARTITION BY series_id ORDER BY s))
 SELECT cut.series_id, point_no::INT AS point_no, s AS change_seq, epoch_us(ts) AS change_us, round((a[s+1]-a[lo+1])**2/(s-lo)+(a[hi+1]-a[s+1])**2/(hi-s)-(a[hi+1]-a[lo+1])**2/(hi-lo),5) AS gain FROM cut JOIN ser ON cut.series_id=ser.series_id AND s=seq"""


@query("ts24_change_point_optimal", _CUT)
def _(t):
    d = days(t)
    m = d.groupBy("series_id").agg(F.avg("value").alias("m"), F.stddev("value").alias("sd"), F.max("seq").alias("n"))
    z = attach(d, m, ["series_id"], "n").withColumn("value", (F.col("value") - F.col("m")) / F.col("sd")).drop("m", "sd")
    c = ts.change_point(z, min_segment=10, penalty=6, method="optimal")
    return r(c.withColumn("change_us", F.unix_micros("change_ts")).drop("change_ts"), 5, "gain")


@query("ts24_change_point_cusum", H + f""", c AS (SELECT *, value-avg(value) OVER (PARTITION BY series_id) AS x FROM ser), p AS (SELECT *, sum(x) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c1, count(*) OVER (PARTITION BY series_id) AS n, stddev(value) OVER (PARTITION BY series_id) AS sd FROM c),
 b AS (SELECT *, abs(c1)/(sd*sqrt(n)) AS z FROM p WHERE sd>0 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(abs(c1),9) DESC, seq)=1)
 SELECT series_id, 1 AS point_no, seq AS change_seq, epoch_us(ts) AS change_us, round(CASE WHEN seq<n THEN c1*c1/seq+c1*c1/(n-seq) ELSE 0 END,5) AS gain, round(z,7) AS statistic,
 round(CASE WHEN z<0.1 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1,101), lambda j: CASE WHEN j%2=1 THEN 2.0 ELSE -2.0 END*exp(-2.0*j*j*z*z))),0),1) END,6) AS p_value FROM b""")
def _(t):
    c = ts.change_point(hours(t), method="cusum")
    return r(r(r(c.withColumn("change_us", F.unix_micros("change_ts")).drop("change_ts"), 5, "gain"), 7, "statistic"), 6, "p_value")


@query("ts25_series_plot_data", H + """, b AS (SELECT *, floor((seq-1)*100/greatest(max(seq) OVER (PARTITION BY series_id),100))::INT AS bucket FROM ser),
 g AS (SELECT series_id, bucket, epoch_us(min(ts)) AS us, arg_min(value,seq) AS "first", arg_max(value,seq) AS "last", min(value) AS low, max(value) AS high FROM b GROUP BY 1,2)
 SELECT series_id, bucket, us, part, round(value,8) AS value, 'actual' AS series_type FROM (UNPIVOT g ON "first", "last", low, high INTO NAME part VALUE value)""")
def _(t):
    p = ts.series_plot_data(hours(t))
    return p.select("series_id", "bucket", F.unix_micros("ts").alias("us"), "part", rnd("value", 8).alias("value"), "series_type")


@query("ts26_forecast_accuracy", H + f""", f AS (SELECT series_id, value AS y, lag(value,24) OVER {W} AS p FROM ser)
 SELECT series_id, count(*) AS n, round(sqrt(avg((y-p)*(y-p))),7) AS rmse, round(avg(abs(y-p)),7) AS mae, round(avg(abs(y-p)/abs(y))*100,6) AS mape, round(avg(y-p),7) AS bias, round(1-sum((y-p)*(y-p))/(count(*)*var_pop(y)),7) AS r2,
 CASE WHEN avg(abs(y-p)/abs(y))*100<10 THEN 'Excellent' WHEN avg(abs(y-p)/abs(y))*100<20 THEN 'Good' WHEN avg(abs(y-p)/abs(y))*100<50 THEN 'Acceptable' ELSE 'Poor' END AS accuracy_band FROM f WHERE p IS NOT NULL GROUP BY 1""")
def _(t):
    from cairn.plans.ordered import sliding
    f = sliding(hours(t), ["series_id"], lambda w: {"fitted_value": F.lag("value", 24).over(w)}, before=24)
    return r(r(ts.forecast_accuracy(f), 7, "rmse", "mae", "bias", "r2"), 6, "mape")


@query("ts27_arima_coefficients")
def _(t):
    return ar.coefficient_report(ar.arima_estimate(hours(t), (2, 0, 1)))


@query("ts27_arima_residual_checks")
def _(t):
    return ar.residual_report(ar.arima_fitted(hours(t), (2, 0, 1)))


@query("ts28_arima_grid")
def _(t):
    return ar.arima_grid(hours(t), max_p=3, max_q=2)


@query("ts29_result_bands", H + """, z AS (SELECT value, avg(value) OVER () AS m, stddev(value) OVER () AS s FROM ser), c AS (SELECT value, CASE WHEN value>m+2*s THEN 'High outlier' WHEN value<m-2*s THEN 'Low outlier' WHEN value>m+s THEN 'Above average' WHEN value<m-s THEN 'Below average' ELSE 'Normal range' END AS distribution_category FROM z)
 SELECT distribution_category, count(*) AS n, round(min(value),4) AS min_value, round(max(value),4) AS max_value, round(avg(value),4) AS avg_value, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM c GROUP BY 1""")
def _(t):
    return ts.result_bands(hours(t))


@query("ts29_result_deciles", H + """, z AS (SELECT value, ntile(10) OVER (ORDER BY ts, series_id) AS time_decile FROM ser) SELECT time_decile, count(*) AS observations, round(min(value),4) AS min_value, round(max(value),4) AS max_value, round(avg(value),4) AS avg_value, round(stddev(value),4) AS std_dev FROM z GROUP BY 1""")
def _(t):
    return ts.result_deciles(hours(t))


@query("ts29_result_overview", GAPPY + """ SELECT count(*) AS total_results, count(value) AS valid_results, round(avg(value),4) AS result_avg, round(stddev(value),4) AS result_std, (SELECT count(*) FROM h0) AS input_observations, (SELECT round(avg(value),4) FROM h0) AS input_avg,
 (SELECT round(stddev(value),4) FROM h0) AS input_std, round(100.0*count(value)/count(*),4) AS completeness_pct, CASE WHEN 100.0*count(value)/count(*)>=95 THEN 'Excellent - High completeness (>=95%)' WHEN 100.0*count(value)/count(*)>=80 THEN 'Good - Acceptable completeness (>=80%)' ELSE 'Warning - Low completeness (<80%)' END AS quality_assessment FROM ser""")
def _(t):
    return ts.result_overview(numbered(t), hours(t))


@query("ts30_config_compare", H + f""", a AS (SELECT 'lag 1' AS config_name, value-lag(value,1) OVER {W} AS v FROM ser UNION ALL SELECT 'lag 12', value-lag(value,12) OVER {W} FROM ser UNION ALL SELECT 'lag 24', value-lag(value,24) OVER {W} FROM ser),
 g AS (SELECT config_name, count(*) AS result_count, count(v) AS valid_results, round(min(v),4) AS min_value, round(max(v),4) AS max_value, round(avg(v),4) AS avg_value, round(stddev(v),4) AS std_dev FROM a GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY valid_results DESC, config_name)=1)::INT AS recommended FROM g""")
def _(t):
    return ts.config_compare({f"lag {k}": ts.diff(hours(t), 0, 1, k) for k in (1, 12, 24)}, "diff_value")


@query("ts31_series_workflow")
def _(t):
    return ar.series_workflow(hours(t))


@query("ts32_prep_report", GAPPY + """, f AS (SELECT *, coalesce(value, avg(value) OVER (PARTITION BY series_id)) AS v FROM ser), z AS (SELECT *, avg(v) OVER w AS m, stddev(v) OVER w AS s FROM f WINDOW w AS (PARTITION BY series_id)),
 q AS (SELECT series_id, count(*) AS n, 100.0*count(v)/count(*) AS c, 100.0-100.0*sum((abs(v-m)>3*s)::INT)/count(*) AS o, 100.0*count(DISTINCT seq)/(max(seq)-min(seq)+1) AS k, avg(value) AS raw_mean, avg(v) AS prepared_mean, stddev(value) AS raw_std, stddev(v) AS prepared_std,
  count(*)-count(value) AS original_nulls, count(*)-count(v) AS remaining_nulls FROM z GROUP BY 1)
 SELECT series_id, n, round(c,6) AS completeness_score, round(o,6) AS outlier_score, round(k,6) AS continuity_score, round(raw_mean,6) AS raw_mean, round(prepared_mean,6) AS prepared_mean, round(raw_std,6) AS raw_std, round(prepared_std,6) AS prepared_std, original_nulls, remaining_nulls,
 round(c*.4+o*.3+k*.3,6) AS overall_quality_score, CASE WHEN n>=100 AND c>=95 AND o>=90 AND prepared_std>0 THEN 'READY FOR MODELING' ELSE 'NEEDS REVIEW' END AS overall_readiness FROM q""")
def _(t):
    p = ts.prep_report(ts.fill(numbered(t), "mean")).drop("raw_skewness", "prepared_skewness")
    return r(p, 6, "completeness_score", "outlier_score", "continuity_score", "raw_mean", "prepared_mean", "raw_std", "prepared_std", "overall_quality_score")


@query("ts32_value_bins", H + " SELECT floor(value/10.0)*10.0 AS bin_start, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM ser GROUP BY 1")
def _(t):
    return ts.value_bins(hours(t))


@query("ts33_lag_features", H + f""" SELECT series_id, seq, round(lag(value,1) OVER w,8) AS lag1, round(lag(value,7) OVER w,8) AS lag7, round(lag(value,30) OVER w,8) AS lag30, round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),9) AS ma7,
 round(stddev(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),7) AS volatility30, round(value-lag(value,1) OVER w,8) AS diff1, month(ts)::INT AS month, (dayofweek(ts)+1)::INT AS day_of_week,
 CASE WHEN seq*100 <= 70*max(seq) OVER (PARTITION BY series_id) THEN 'train' WHEN seq*100 <= 85*max(seq) OVER (PARTITION BY series_id) THEN 'validation' ELSE 'test' END AS split FROM ser WINDOW w AS {W}""")
def _(t):
    return r(r(r(ts.lag_features(hours(t)), 8, "lag1", "lag7", "lag30", "diff1"), 9, "ma7"), 7, "volatility30").drop("ts", "value")


@query("ts34_prep_workflow")
def _(t):
    return ar.prep_workflow(gappy(t))


@query("ts35_series_quality", H + _GAP + """, z AS (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m, stddev(value) OVER (PARTITION BY series_id) AS s, avg(value) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ma FROM g)
 SELECT series_id, count(*) AS n_observations, count(*)-count(value) AS missing_values, sum((abs(value-m)>3*s)::INT)::BIGINT AS n_outliers, round(100.0*sum((abs(value-m)>3*s)::INT)/count(*),4) AS outlier_pct, count(DISTINCT gap) AS n_distinct_intervals,
 CASE WHEN count(*)>=50 THEN 'PASS - Sufficient data' WHEN count(*)>=30 THEN 'WARNING - Short series' ELSE 'FAIL - Insufficient data (<30)' END AS length_status, CASE WHEN count(DISTINCT gap)<=2 THEN 'PASS - Regular intervals' ELSE 'WARNING - Irregular intervals' END AS gap_status,
 CASE WHEN 100.0*sum((abs(value-m)>3*s)::INT)/count(*)<5 THEN 'PASS - Few outliers' ELSE 'WARNING - Many outliers (>5%)' END AS outlier_status, CASE WHEN stddev(ma)>stddev(value-ma) THEN 'Strong trend present' ELSE 'Weak or no trend' END AS trend_assessment FROM z GROUP BY 1""")
def _(t):
    return ts.series_quality(hours(t))

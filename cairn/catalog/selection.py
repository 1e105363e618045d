"""Queries of series model preparation and selection."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.catalog.relational import HOURLY
from cairn.catalog.series import hours
from cairn.functions.expr import rnd
from cairn.operators import selection as ms, validation as vd

H = "WITH " + HOURLY + ", s AS (SELECT *, max(seq) OVER (PARTITION BY series_id) AS n FROM ser)"
W = "(PARTITION BY series_id ORDER BY seq)"


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ms01_time_split", H + " SELECT series_id, seq, CASE WHEN seq*10<=n*6 THEN 'train' WHEN seq*10<=n*8 THEN 'validation' ELSE 'test' END AS role FROM s")
def _(t):
    return ms.time_split(hours(t)).select("series_id", "seq", "role")


@query("ms02_kfold_blocks", H + " SELECT series_id, seq, (floor((seq-1)*5/n)+1)::INT AS fold FROM s")
def _(t):
    return ms.kfold_blocks(hours(t)).select("series_id", "seq", "fold")


@query("ms03_blocked_folds", H + ", b AS (SELECT series_id, seq, least((seq-1)//greatest(n//25,1),24) AS b FROM s) SELECT series_id, seq, (b+1)::INT AS block, (b%5+1)::INT AS fold FROM b")
def _(t):
    return ms.blocked_folds(hours(t)).select("series_id", "seq", "block", "fold")


@query("ms04_rolling_origin", H + ", o AS (SELECT series_id, seq, value, k AS origin, n-24*(6-k) AS cut FROM s, (SELECT unnest([1,2,3,4,5]) AS k)) SELECT series_id, origin, CASE WHEN seq<=cut THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(avg(value),8) AS mean, min(seq) AS first_seq, max(seq) AS last_seq FROM o WHERE seq<=cut+24 GROUP BY 1,2,3")
def _(t):
    return _windows(ms.rolling_origin(hours(t)), "origin")


def _windows(df, key):
    return df.groupBy("series_id", key, "role").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 8).alias("mean"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _mw(start):
    return H + f", o AS (SELECT series_id, seq, value, n, k AS window_no, 200+k*100 AS cut FROM s, (SELECT unnest(range(0,20)) AS k) WHERE 200+k*100+50<=n) SELECT series_id, window_no, CASE WHEN seq<=cut THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(avg(value),8) AS mean, min(seq) AS first_seq, max(seq) AS last_seq FROM o WHERE seq>{start} AND seq<=cut+50 GROUP BY 1,2,3"


@query("ms05_expanding_window", _mw("0"))
def _(t):
    return _windows(ms.moving_window(hours(t), 200, 50, 100, True), "window_no")


@query("ms05_sliding_window", _mw("cut-200"))
def _(t):
    return _windows(ms.moving_window(hours(t), 200, 50, 100, False), "window_no")


_CV = H + """, o AS (SELECT series_id, seq, value, k AS origin, n-24*(6-k) AS cut FROM s, (SELECT unnest([1,2,3,4,5]) AS k)), b AS (SELECT series_id, origin, avg(value) FILTER (seq<=cut) AS mean, arg_max(value,seq) FILTER (seq<=cut) AS "last", avg(value) FILTER (seq<=cut AND seq>cut-24) AS moving_average FROM o GROUP BY 1,2),
 l AS (UNPIVOT b ON mean, "last", moving_average INTO NAME model VALUE f), cv AS (SELECT o.series_id, model, o.origin, sqrt(avg(pow(value-f,2)) FILTER (seq<=cut)) AS train_rmse, sqrt(avg(pow(value-f,2)) FILTER (seq>cut AND seq<=cut+24)) AS test_rmse FROM o JOIN l ON o.series_id=l.series_id AND o.origin=l.origin GROUP BY 1,2,3)"""


@query("ms06_ts_cross_validate", _CV + " SELECT series_id, model, origin, round(train_rmse,7) AS train_rmse, round(test_rmse,7) AS test_rmse, round(test_rmse-train_rmse,7) AS gap, (test_rmse>1.5*train_rmse)::INT AS overfit FROM cv")
def _(t):
    return r(ms.ts_cross_validate(hours(t)), 7, "train_rmse", "test_rmse", "gap")


@query("ms06_cv_stability", _CV + " SELECT series_id, model, count(*) AS folds, round(avg(test_rmse),7) AS mean_test_rmse, round(stddev(test_rmse),7) AS sd_test_rmse, round(avg(test_rmse-train_rmse),7) AS mean_gap, sum((test_rmse>1.5*train_rmse)::INT)::BIGINT AS overfit_folds, round(1-stddev(test_rmse)/avg(test_rmse),7) AS stability FROM cv GROUP BY 1,2")
def _(t):
    return r(ms.cv_stability(ms.ts_cross_validate(hours(t))), 7, "mean_test_rmse", "sd_test_rmse", "mean_gap", "stability")


_MODELS = {"mean": ("0", None), "naive": ("lh", None), "seasonal_naive": ("ls", None), "linear_trend": ("0", "seq/n"), "ar1": ("0", "lh"), "ari1": ("lh", "lh-lg")}


def _cv_models(h, bucket, train):
    """Each model is a line in one feature, fitted by the built-in regression per fold."""
    rows = " UNION ALL ".join(f"SELECT series_id, seq, bucket, '{m}' AS model, ({o})::DOUBLE AS o, ({x or 0})::DOUBLE AS x, (value-({o}))::DOUBLE AS y FROM q" for m, (o, x) in _MODELS.items())
    flat = "model IN ('mean','naive','seasonal_naive')"
    return H + f""", q AS (SELECT *, {bucket} AS bucket, lag(value,{h}) OVER w AS lh, lag(value,{h + 1}) OVER w AS lg, lag(value,24) OVER w AS ls FROM s WINDOW w AS {W}),
 l AS (SELECT * FROM ({rows}) WHERE o IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), f AS (SELECT unnest(range(1,6))::INT AS fold),
 fit AS (SELECT series_id, model, fold, count(*) AS train_n, CASE WHEN model IN ('naive','seasonal_naive') THEN 0 WHEN model='mean' THEN avg(y) ELSE regr_intercept(y,x) END AS a, CASE WHEN {flat} THEN 0 ELSE regr_slope(y,x) END AS b FROM l, f WHERE {train} GROUP BY 1,2,3),
 tr AS (SELECT l.series_id, l.model, fit.fold, any_value(train_n) AS train_n, sqrt(avg(pow(y-a-b*x,2))) AS train_rmse FROM l JOIN fit ON l.series_id=fit.series_id AND l.model=fit.model WHERE {train} GROUP BY 1,2,3),
 te AS (SELECT l.series_id, l.model, fit.fold, count(*) AS test_n, sqrt(avg(pow(y-a-b*x,2))) AS test_rmse, avg(abs(y-a-b*x)) AS test_mae FROM l JOIN fit ON l.series_id=fit.series_id AND l.model=fit.model AND bucket=fold GROUP BY 1,2,3),
 cv AS (SELECT *, test_rmse-train_rmse AS gap, (test_rmse>1.5*train_rmse)::INT AS overfit FROM tr JOIN te USING (series_id, model, fold))"""


_LATE = "ceil((seq-(n-120))/24.0)::INT"
_CVM = {"rolling": (1, f"greatest({_LATE},0)", "bucket<fold"), "sliding": (3, _LATE, "bucket<fold AND bucket>=fold-4"), "blocked": (2, "(floor((seq-1)*5/n)+1)::INT", "bucket<>fold")}
for _k, (_h, _b, _w) in _CVM.items():
    @query(f"ms06_cross_validate_{_k}", _cv_models(_h, _b, _w) + " SELECT series_id, model, fold, train_n, round(train_rmse,6) AS train_rmse, test_n, round(test_rmse,6) AS test_rmse, round(test_mae,6) AS test_mae, round(gap,6) AS gap, overfit FROM cv")
    def _(t, k=_k, h=_h):
        return r(vd.cross_validate_models(hours(t), method=k, step_ahead=h), 6, "train_rmse", "test_rmse", "test_mae", "gap")


@query("ms06_cross_validate_smoothing")
def _(t):
    return vd.cross_validate_models(hours(t), ("ses", "holt", "holt_winters_add", "ar2", "ari2", "seasonal_ar"), step_ahead=6)


@query("ms06_cv_scores", _cv_models(*_CVM["rolling"]) + """, g AS (SELECT series_id, model, count(*) AS folds, sqrt(sum(test_n*test_rmse*test_rmse)/sum(test_n)) AS cv_rmse, sum(test_n*test_mae)/sum(test_n) AS cv_mae, avg(gap) AS mean_gap, sum(overfit)::BIGINT AS overfit_folds, 1-stddev(test_rmse)/avg(test_rmse) AS stability FROM cv GROUP BY 1,2)
 SELECT series_id, model, folds, round(cv_rmse,6) AS cv_rmse, round(cv_mae,6) AS cv_mae, round(mean_gap,6) AS mean_gap, overfit_folds, round(stability,6) AS stability, row_number() OVER (PARTITION BY series_id ORDER BY round(cv_rmse,9), model) AS cv_rmse_rank, row_number() OVER (PARTITION BY series_id ORDER BY round(cv_mae,9), model) AS cv_mae_rank FROM g""")
def _(t):
    return r(vd.cv_scores(vd.cross_validate_models(hours(t))), 6, "cv_rmse", "cv_mae", "mean_gap", "stability")


_MM = """m AS (SELECT p_brand AS model, avg(p_retailprice) AS price, stddev(p_retailprice) AS spread, count(*)::DOUBLE AS n FROM part GROUP BY 1), z AS (SELECT *, (price-min(price) OVER ())/(max(price) OVER ()-min(price) OVER ()) AS a, (spread-min(spread) OVER ())/(max(spread) OVER ()-min(spread) OVER ()) AS b, (n-min(n) OVER ())/(max(n) OVER ()-min(n) OVER ()) AS c FROM m),
 sc AS (SELECT model, (1-a)*0.5+(1-b)*0.3+c*0.2 AS s FROM z)"""


@query("ms07_minmax_score", f"WITH {_MM} SELECT model, round(s,8) AS score, row_number() OVER (ORDER BY round(s,9) DESC, model) AS score_rank FROM sc")
def _(t):
    m = t.part.groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("price"), F.stddev("p_retailprice").alias("spread"), F.count(F.lit(1)).cast("double").alias("n"))
    return r(ms.minmax_score(m, {"price": -0.5, "spread": -0.3, "n": 0.2}).select("model", "score", "score_rank"), 8, "score")


_CF = H + f""", ln AS (SELECT series_id, regr_slope(value,seq) AS b, regr_intercept(value,seq) AS a FROM ser GROUP BY 1), c0 AS (SELECT s.series_id, seq, value, lag(value,1) OVER w AS naive, lag(value,24) OVER w AS seasonal_naive, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS moving_average, a+b*seq AS linear_trend FROM s JOIN ln ON s.series_id=ln.series_id WINDOW w AS (PARTITION BY s.series_id ORDER BY seq)),
 cf AS (UNPIVOT c0 ON naive, seasonal_naive, moving_average, linear_trend INTO NAME model VALUE f)"""


@query("ms08_candidate_forecasts", _CF + " SELECT series_id, seq, model, round(f,8) AS fitted_value FROM cf")
def _(t):
    return r(ms.candidate_forecasts(hours(t)), 8, "fitted_value").drop("value")


@query("ms08_candidate_smoothing")
def _(t):
    return ms.candidate_forecasts(hours(t), ("ses", "holt", "holt_winters_add", "holt_winters_mult"))


@query("ms08_candidate_arima")
def _(t):
    return ms.candidate_forecasts(hours(t), ("ar1", "arima_111", "sarima"))


_SEL = _CF + """, mt AS (SELECT series_id, model, count(*) AS n, avg(pow(value-f,2)) AS mse, avg(abs(value-f)) AS mae, var_pop(value) AS v, CASE WHEN model='linear_trend' THEN 2 ELSE 1 END AS k FROM cf GROUP BY 1,2),
 me AS (SELECT *, sqrt(mse) AS rmse, n*ln(mse)+2*k AS aic, n*ln(mse)+ln(n)*k AS bic, 1-(mse/v)*(n-1)/(n-k-1) AS adjusted_r2 FROM mt)"""


@query("ms09_model_metrics", _SEL + " SELECT series_id, model, n, k, round(rmse,7) AS rmse, round(mae,7) AS mae, round(aic,5) AS aic, round(bic,5) AS bic, round(adjusted_r2,7) AS adjusted_r2 FROM me")
def _(t):
    return r(r(ms.model_metrics(ms.candidate_forecasts(hours(t))), 7, "rmse", "mae", "adjusted_r2"), 5, "aic", "bic")


_RK = ", ".join(f"row_number() OVER (PARTITION BY series_id ORDER BY round({c},9) {'DESC' if c == 'adjusted_r2' else ''}, model) AS {c}_rank" for c in ("aic", "bic", "rmse", "mae", "adjusted_r2"))


@query("ms09_model_selection", _SEL + f", rk AS (SELECT *, {_RK} FROM me) SELECT series_id, model, aic_rank, bic_rank, rmse_rank, mae_rank, adjusted_r2_rank, (aic_rank=1)::INT+(bic_rank=1)::INT+(rmse_rank=1)::INT+(mae_rank=1)::INT+(adjusted_r2_rank=1)::INT AS consensus FROM rk")
def _(t):
    s = ms.model_selection(ms.candidate_forecasts(hours(t)))
    return s.select("series_id", "model", "aic_rank", "bic_rank", "rmse_rank", "mae_rank", "adjusted_r2_rank", "consensus")


_CVS = _cv_models(*_CVM["rolling"]) + _SEL[len(H):] + """, g AS (SELECT series_id, model, sqrt(sum(test_n*test_rmse*test_rmse)/sum(test_n)) AS cv_rmse, sum(test_n*test_mae)/sum(test_n) AS cv_mae FROM cv GROUP BY 1,2), b AS (SELECT * FROM me JOIN g USING (series_id, model)),
 z AS (SELECT *, """ + "+".join(f"{w}*coalesce(({top}-{c})/nullif(max({c}) OVER p-min({c}) OVER p,0),{fall})" if w != 0.1 else f"{w}*coalesce(({c}-min({c}) OVER p)/nullif(max({c}) OVER p-min({c}) OVER p,0),1)"
                               for c, w, top, fall in (("aic", 0.25, "max(aic) OVER p", 1), ("bic", 0.2, "max(bic) OVER p", 1), ("cv_rmse", 0.3, "max(cv_rmse) OVER p", 1), ("cv_mae", 0.15, "max(cv_mae) OVER p", 1), ("adjusted_r2", 0.1, "", 1))) + """ AS composite FROM b WINDOW p AS (PARTITION BY series_id))
 SELECT series_id, model, round(cv_rmse,6) AS cv_rmse, round(cv_mae,6) AS cv_mae, round(composite,6) AS composite, row_number() OVER (PARTITION BY series_id ORDER BY round(composite,9) DESC, model) AS composite_rank FROM z"""


@query("ms09_select_by_cv", _CVS)
def _(t):
    h = hours(t)
    s = vd.select_by_cv(ms.candidate_forecasts(h), vd.cross_validate_models(h))
    return r(s.select("series_id", "model", "cv_rmse", "cv_mae", "composite", "composite_rank"), 6, "cv_rmse", "cv_mae", "composite")


@query("ms10_selection_stability", _SEL + f", rk AS (SELECT *, {_RK} FROM me), l AS (UNPIVOT (SELECT series_id, model, aic_rank, bic_rank, rmse_rank, mae_rank, adjusted_r2_rank FROM rk) ON aic_rank, bic_rank, rmse_rank, mae_rank, adjusted_r2_rank INTO NAME criterion VALUE rank) SELECT model, round(avg(rank),8) AS mean_rank, round(stddev(rank),8) AS rank_sd, count(*) FILTER (rank=1) AS wins, CASE WHEN round(stddev(rank),9)<.5 THEN 'Very stable' WHEN round(stddev(rank),9)<1 THEN 'Stable' ELSE 'Unstable' END AS stability FROM l GROUP BY 1")
def _(t):
    return r(ms.selection_stability(ms.model_selection(ms.candidate_forecasts(hours(t)))), 8, "mean_rank", "rank_sd")


@query("ms10_overfitting_risk", _SEL + " SELECT series_id, model, round(k/n,9) AS parameter_ratio, CASE WHEN k/n>.1 THEN 'High risk' WHEN k/n>.05 THEN 'Moderate risk' ELSE 'Low risk' END AS overfitting_risk FROM me")
def _(t):
    return r(ms.overfitting_risk(ms.model_selection(ms.candidate_forecasts(hours(t)))), 9, "parameter_ratio")


@query("ms11_ts_characteristics", H + f", q AS (SELECT *, lag(value,1) OVER {W} AS a, lag(value,12) OVER {W} AS b FROM ser) SELECT series_id, count(*) AS n, round(avg(value),8) AS mean, round(stddev(value),8) AS std_dev, round(corr(value,seq),8) AS trend_correlation, round(corr(value,a),8) AS lag1_correlation, round(corr(value,b),8) AS lag12_correlation, round(stddev(value-a),8) AS difference_sd, CASE WHEN abs(corr(value,seq))>.5 THEN 'Trending' ELSE 'No clear trend' END AS trend, CASE WHEN abs(corr(value,b))>.5 THEN 'Seasonal' ELSE 'No clear seasonality' END AS seasonality FROM q GROUP BY 1")
def _(t):
    return r(ms.ts_characteristics(hours(t)), 8, "mean", "std_dev", "trend_correlation", "lag1_correlation", "lag12_correlation", "difference_sd")


@query("ms11_model_features", H + f" SELECT series_id, seq, seq AS trend, round(avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),9) AS ma5, round(avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),9) AS ma10, round(value-lag(value,1) OVER w,9) AS diff1, round(value-lag(value,12) OVER w,9) AS diff12 FROM ser WINDOW w AS {W}")
def _(t):
    return r(ms.model_features(hours(t)), 9, "ma5", "ma10", "diff1", "diff12").drop("ts", "value")


def _pe(cte, names, exprs):
    return H + cte + f" SELECT series_id, unnest([{','.join(repr(n) for n in names)}]) AS parameter, unnest([{','.join(f'round({e},7)' for e in exprs)}]) AS estimate FROM q"


_PE = {
    "ols": _pe(", q AS (SELECT series_id, regr_intercept(value,seq) AS a, regr_slope(value,seq) AS b, sqrt((regr_syy(value,seq)-regr_slope(value,seq)*regr_sxy(value,seq))/count(*)) AS c FROM ser GROUP BY 1)", ["intercept", "slope", "sigma"], "abc"),
    "ridge": _pe(", q AS (SELECT series_id, avg(value)-regr_sxy(value,seq)/(regr_sxx(value,seq)+1)*avg(seq) AS a, regr_sxy(value,seq)/(regr_sxx(value,seq)+1) AS b FROM ser GROUP BY 1)", ["intercept", "slope"], "ab"),
    "moments": _pe(f", c AS (SELECT series_id, seq, value, value-avg(value) OVER (PARTITION BY series_id) AS x FROM ser), l AS (SELECT *, lag(x) OVER {W} AS p FROM c), q AS (SELECT series_id, avg(value) AS a, variance(value) AS b, sum(x*p)/sum(x*x) AS c FROM l GROUP BY 1)", ["mean", "variance", "ar1"], "abc"),
    "bayes": _pe(", m AS (SELECT series_id, count(*) AS n, avg(value) AS m, variance(value) AS v FROM ser GROUP BY 1), q AS (SELECT series_id, (n/v*m)/(1+n/v) AS a, sqrt(1/(1+n/v)) AS b FROM m)", ["posterior_mean", "posterior_sd"], "ab")}
for _k, _e in _PE.items():
    @query(f"ms12_parameter_{_k}", _e)
    def _(t, k=_k):
        return r(ms.parameter_estimate(hours(t), k), 7, "estimate")


@query("ms12_parameter_gradient")
def _(t):
    return ms.gradient_estimate(hours(t))


@query("ms12_component_strength")
def _(t):
    return ms.component_strength(hours(t))


@query("ms13_confidence_interval", H + ", q AS (SELECT series_id, count(*) AS n, avg(value) AS m, stddev(value) AS s FROM ser GROUP BY 1) SELECT series_id, n, round(m,8) AS mean, round(s,8) AS sd, round(s/sqrt(n),8) AS std_error, round(m-1.959963984540054*s/sqrt(n),8) AS lower_95, round(m+1.959963984540054*s/sqrt(n),8) AS upper_95, round(m-2.575829303548901*s/sqrt(n),8) AS lower_99, round(m+2.575829303548901*s/sqrt(n),8) AS upper_99 FROM q")
def _(t):
    return r(ms.confidence_interval(hours(t)), 8, "mean", "sd", "std_error", "lower_95", "upper_95", "lower_99", "upper_99")


@query("ms14_estimation_report", H + """, f AS (SELECT series_id, regr_slope(value,seq) AS b, regr_intercept(value,seq) AS a, count(*) AS nt, regr_sxx(value,seq) AS sxx, regr_syy(value,seq)-regr_slope(value,seq)*regr_sxy(value,seq) AS sse FROM s WHERE seq<=floor(n*0.8::DOUBLE) GROUP BY 1),
 g AS (SELECT s.series_id, sqrt(avg(pow(value-a-b*seq,2)) FILTER (seq<=floor(n*0.8::DOUBLE))) AS tr, sqrt(avg(pow(value-a-b*seq,2)) FILTER (seq>floor(n*0.8::DOUBLE))) AS te FROM s JOIN f ON s.series_id=f.series_id GROUP BY 1)
 SELECT g.series_id, round(tr,6) AS train_rmse, round(te,6) AS test_rmse, nt AS n, round(b,8) AS slope, round(sqrt(sse/(nt-2)/sxx),8) AS slope_se, round(te-tr,6) AS generalization_gap, round(nt*ln(sse/nt)+4,4) AS aic, round(nt*ln(sse/nt)+2*ln(nt),4) AS bic, round(2*1.959963984540054*sqrt(sse/(nt-2)/sxx),8) AS slope_ci_width, CASE WHEN te/tr<1.1 THEN 'Good generalization' WHEN te/tr<1.5 THEN 'Acceptable' ELSE 'Overfitting' END AS gap_assessment FROM g JOIN f ON g.series_id=f.series_id""")
def _(t):
    return r(r(r(ms.estimation_report(hours(t)), 6, "train_rmse", "test_rmse", "generalization_gap"), 8, "slope", "slope_se", "slope_ci_width"), 4, "aic", "bic")

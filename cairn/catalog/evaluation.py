"""Queries of the evaluation operators; predictions are fixed formulas."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.catalog.relational import scratch
from cairn.functions.expr import band, rnd
from cairn.operators import evaluate as ev
from cairn.sources import tables as io

A, P = "actual", "predicted"
IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def reg(t):
    q = F.col("l_quantity")
    return t.lineitem.select(*IDS, F.col("l_extendedprice").alias("actual"), (q * 1500.0).alias("predicted"), (q * 1400.0 + 2000.0).alias("model_b"), (q * 1200.0 + 9000.0).alias("model_c"))


R = "WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice AS actual, l_quantity*1500.0 AS predicted, l_quantity*1400.0+2000.0 AS model_b, l_quantity*1200.0+9000.0 AS model_c FROM lineitem), e AS (SELECT *, predicted-actual AS e FROM p)"


def cls(t):
    v = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("actual"), band(v, [(100000, "F"), (200000, "O"), (300000, "P")], "X").alias("predicted"),
                           F.when(F.col("o_orderpriority") < "3", "F").otherwise("O").alias("other"), F.least(F.lit(1.0), v / 400000.0).alias("confidence"))


C = "WITH c AS (SELECT o_orderkey, o_orderstatus AS actual, CASE WHEN o_totalprice<100000 THEN 'F' WHEN o_totalprice<200000 THEN 'O' WHEN o_totalprice<300000 THEN 'P' ELSE 'X' END AS predicted, CASE WHEN o_orderpriority<'3' THEN 'F' ELSE 'O' END AS other, least(1.0, o_totalprice/400000.0) AS confidence FROM orders)"


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ev01_regression_metrics", R + ", m AS (SELECT avg(e*e) AS MSE, sqrt(avg(e*e)) AS RMSE, avg(abs(e)) AS MAE, avg(abs(e/actual))*100 AS MAPE, 1-sum(e*e)/(count(*)*var_pop(actual)) AS R2 FROM e) SELECT metric_name, round(metric_value,5) AS metric_value FROM (UNPIVOT m ON MSE, RMSE, MAE, MAPE, R2 INTO NAME metric_name VALUE metric_value)")
def _(t):
    return r(ev.regression_metrics(reg(t), A, P), 5, "metric_value")


@query("ev01_regression_summary", R + ", m AS (SELECT count(*) AS observations, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, 1-sum(e*e)/(count(*)*var_pop(actual)) AS r2, corr(actual,predicted) AS c, avg(e) AS b FROM e) SELECT observations, round(rmse,5) AS rmse, round(mae,5) AS mae, round(r2,8) AS r_squared, round(c,8) AS correlation, round(b,5) AS mean_bias, CASE WHEN r2>.9 THEN 'Excellent' WHEN r2>.7 THEN 'Good' WHEN r2>.5 THEN 'Moderate' WHEN r2>.3 THEN 'Weak' ELSE 'Poor' END AS model_quality, CASE WHEN abs(b)/mae<.1 THEN 'Unbiased' WHEN b>0 THEN 'Positive bias (over-prediction)' ELSE 'Negative bias (under-prediction)' END AS bias_assessment FROM m")
def _(t):
    return r(r(ev.regression_summary(reg(t), A, P), 5, "rmse", "mae", "mean_bias"), 8, "r_squared", "correlation")


@query("ev02_baseline_compare", R + ", b AS (SELECT avg(actual) AS m, quantile_cont(actual,.5) AS d FROM p), s AS (SELECT sqrt(avg(e*e)) AS model_rmse, sqrt(avg(pow(m-actual,2))) AS mean_baseline_rmse, sqrt(avg(pow(d-actual,2))) AS median_baseline_rmse, avg(abs(e)) AS model_mae, avg(abs(m-actual)) AS mean_baseline_mae, avg(abs(d-actual)) AS median_baseline_mae FROM e, b) SELECT round(model_rmse,5) AS model_rmse, round(mean_baseline_rmse,5) AS mean_baseline_rmse, round(median_baseline_rmse,5) AS median_baseline_rmse, round(model_mae,5) AS model_mae, round(mean_baseline_mae,5) AS mean_baseline_mae, round(median_baseline_mae,5) AS median_baseline_mae, CASE WHEN model_rmse<mean_baseline_rmse AND model_rmse<median_baseline_rmse THEN 'Model outperforms both baselines' WHEN model_rmse<mean_baseline_rmse THEN 'Model outperforms mean baseline' ELSE 'Model does not beat baselines - investigate' END AS performance_assessment FROM s")
def _(t):
    d = ev.baseline_compare(reg(t), A, P)
    return r(d, 5, *d.columns[:6])


@query("ev03_residual_stats", R + " SELECT count(*) AS n_observations, round(avg(e),5) AS mean_residual, round(stddev(e),5) AS std_residual, round(min(e),5) AS min_residual, round(max(e),5) AS max_residual, round(quantile_cont(e,.25),5) AS q1_residual, round(quantile_cont(e,.5),5) AS median_residual, round(quantile_cont(e,.75),5) AS q3_residual FROM e")
def _(t):
    d = ev.residual_stats(reg(t), A, P)
    return r(d, 5, *d.columns[1:])


_SD = R + ", z AS (SELECT *, e/(SELECT stddev(e) FROM e) AS z FROM e)"


@query("ev03_residual_outliers", _SD + " SELECT " + ", ".join(IDS) + ", round(z,8) AS standardized_residual, CASE WHEN abs(z)>3 THEN 'Extreme outlier (>3 sd)' ELSE 'Moderate outlier (>2 sd)' END AS outlier_status FROM z WHERE abs(z)>2")
def _(t):
    return r(ev.residual_outliers(reg(t), A, P, IDS), 8, "standardized_residual")


@query("ev04_residual_histogram", _SD + " SELECT CASE WHEN z<-3 THEN '< -3 SD' WHEN z<-2 THEN '-3 to -2 SD' WHEN z<-1 THEN '-2 to -1 SD' WHEN z<0 THEN '-1 to 0 SD' WHEN z<1 THEN '0 to 1 SD' WHEN z<2 THEN '1 to 2 SD' WHEN z<3 THEN '2 to 3 SD' ELSE '> 3 SD' END AS residual_bin, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM z GROUP BY 1")
def _(t):
    return ev.residual_histogram(reg(t), A, P)


_EQ = "count(*) AS n_observations, round(avg(actual),4) AS avg_actual, round(avg(predicted),4) AS avg_predicted, round(sqrt(avg(e*e)),5) AS rmse, round(avg(abs(e)),5) AS mae, round(corr(actual,predicted),7) AS correlation, round(avg(e/actual)*100,6) AS mean_percentage_error"


def _eq(df):
    return r(r(r(df, 4, "avg_actual", "avg_predicted"), 5, "rmse", "mae"), 7, "correlation").withColumn("mean_percentage_error", rnd("mean_percentage_error", 6))


@query("ev05_error_by_prediction", R + f", q AS (SELECT quantile_cont(predicted,.25) AS a, quantile_cont(predicted,.5) AS b, quantile_cont(predicted,.75) AS c FROM p) SELECT CASE WHEN predicted<=a THEN 1 WHEN predicted<=b THEN 2 WHEN predicted<=c THEN 3 ELSE 4 END AS quantile_band, {_EQ} FROM e, q GROUP BY 1")
def _(t):
    return _eq(ev.error_by_quantile(reg(t), A, P))


@query("ev05_error_by_actual", R + f", q AS (SELECT quantile_cont(actual,.2) AS a, quantile_cont(actual,.4) AS b, quantile_cont(actual,.6) AS c, quantile_cont(actual,.8) AS d FROM p) SELECT CASE WHEN actual<=a THEN 1 WHEN actual<=b THEN 2 WHEN actual<=c THEN 3 WHEN actual<=d THEN 4 ELSE 5 END AS quantile_band, {_EQ} FROM e, q GROUP BY 1")
def _(t):
    return _eq(ev.error_by_quantile(reg(t), A, P, "actual", 5))


@query("ev06_worst_predictions", R + " SELECT " + ", ".join(IDS) + ", round(actual,4) AS actual, round(predicted,4) AS predicted, round(abs(e),5) AS absolute_error, round(abs(e/actual)*100,6) AS percentage_error, CASE WHEN e>0 THEN 'Over-prediction' ELSE 'Under-prediction' END AS error_direction FROM e ORDER BY abs(e) DESC, " + ", ".join(IDS) + " LIMIT 20")
def _(t):
    return r(r(r(ev.worst_predictions(reg(t), A, P, IDS), 4, "actual", "predicted"), 5, "absolute_error"), 6, "percentage_error")


@query("ev06_bias_split", R + " SELECT CASE WHEN e>0 THEN 'Over-predictions' WHEN e<0 THEN 'Under-predictions' ELSE 'Exact predictions' END AS prediction_bias, count(*) AS n, round(avg(abs(e)),5) AS avg_absolute_error, round(avg(e),5) AS avg_signed_error, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM e GROUP BY 1")
def _(t):
    return r(ev.bias_split(reg(t), A, P), 5, "avg_absolute_error", "avg_signed_error")


@query("ev07_homoscedasticity", R + ", d AS (SELECT *, ntile(10) OVER (ORDER BY predicted, " + ", ".join(IDS) + ") AS decile FROM e), g AS (SELECT decile, count(*) AS n_observations, avg(predicted) AS ap, avg(e) AS ae, stddev(e) AS se, avg(e*e) AS qe FROM d GROUP BY 1) SELECT decile, n_observations, round(ap,7) AS avg_predicted, round(ae,7) AS avg_residual, round(se,6) AS std_residual, round(qe,2) AS avg_squared_error, CASE WHEN decile=1 THEN 'Baseline' WHEN se>1.5*(SELECT se FROM g WHERE decile=1) THEN 'Higher variance' ELSE 'Similar variance' END AS variance_assessment, CASE WHEN abs(ae)<se/sqrt(n_observations) THEN 'PASS' ELSE 'WARNING - Possible Non-Linearity' END AS linearity_check FROM g")
def _(t):
    return r(r(r(ev.homoscedasticity(reg(t), A, P, IDS), 7, "avg_predicted", "avg_residual"), 6, "std_residual"), 2, "avg_squared_error")


@query("ev07_variance_halves", R + ", m AS (SELECT quantile_cont(predicted,.5) AS m FROM p), v AS (SELECT variance(e) FILTER (predicted<=m) AS a, variance(e) FILTER (predicted>m) AS b FROM e, m) SELECT round(a,2) AS lower_variance, round(b,2) AS upper_variance, round(greatest(a,b)/least(a,b),6) AS variance_ratio, CASE WHEN greatest(a,b)/least(a,b)<2 THEN 'PASS - Homoscedastic' WHEN greatest(a,b)/least(a,b)<4 THEN 'WARNING - Possible Heteroscedasticity' ELSE 'FAIL - Heteroscedastic' END AS homoscedasticity_check FROM v")
def _(t):
    return r(r(ev.variance_halves(reg(t), A, P), 2, "lower_variance", "upper_variance"), 6, "variance_ratio")


@query("ev07_normality", R + ", s AS (SELECT avg(e) AS m, stddev(e) AS s FROM e), k AS (SELECT avg(pow((e-m)/s,3)) AS a, avg(pow((e-m)/s,4))-3 AS b FROM e, s) SELECT round(a,7) AS skewness, round(b,7) AS excess_kurtosis, CASE WHEN abs(a)<.5 THEN 'PASS - Near Normal' WHEN abs(a)<1 THEN 'WARNING - Moderate Skew' ELSE 'FAIL - High Skew' END AS normality_check_skew, CASE WHEN abs(b)<1 THEN 'PASS - Near Normal' WHEN abs(b)<2 THEN 'WARNING - Moderate Kurtosis' ELSE 'FAIL - High Kurtosis' END AS normality_check_kurtosis FROM k")
def _(t):
    return r(ev.normality(reg(t), A, P), 7, "skewness", "excess_kurtosis")


_M3 = " UNION ALL ".join(f"SELECT '{c}' AS model_name, sqrt(avg(pow({c}-actual,2))) AS rmse, avg(abs({c}-actual)) AS mae, 1-sum(pow({c}-actual,2))/(count(*)*var_pop(actual)) AS r2 FROM p" for c in ("predicted", "model_b", "model_c"))


@query("ev08_model_compare", R + f", m AS ({_M3}), k AS (SELECT *, rank() OVER (ORDER BY rmse) AS rmse_rank, rank() OVER (ORDER BY mae) AS mae_rank, rank() OVER (ORDER BY r2 DESC) AS r_squared_rank FROM m) SELECT model_name, round(rmse,5) AS rmse, round(mae,5) AS mae, round(r2,8) AS r_squared, rmse_rank, mae_rank, r_squared_rank, rmse_rank+mae_rank+r_squared_rank AS combined_rank FROM k")
def _(t):
    return r(r(ev.model_compare(reg(t), A, [P, "model_b", "model_c"]), 5, "rmse", "mae"), 8, "r_squared")


@query("ev09_paired_loss_test", R + ", d AS (SELECT pow(predicted-actual,2) AS a, pow(model_b-actual,2) AS b FROM p), s AS (SELECT avg(a) AS a, avg(b) AS b, avg(a-b) AS m, stddev(a-b) AS s, count(*) AS n FROM d) SELECT round(a,3) AS model1_avg_mse, round(b,3) AS model2_avg_mse, round(m,3) AS avg_mse_difference, round(s,3) AS std_mse_difference, n AS n_samples, round(m/(s/sqrt(n)),6) AS t_statistic, CASE WHEN abs(m/(s/sqrt(n)))>2.576 THEN 'Significantly different (p<0.01)' WHEN abs(m/(s/sqrt(n)))>1.96 THEN 'Significantly different (p<0.05)' ELSE 'No significant difference (p>=0.05)' END AS significance_interpretation FROM s")
def _(t):
    return r(r(ev.paired_loss_test(reg(t), A, P, "model_b"), 3, "model1_avg_mse", "model2_avg_mse", "avg_mse_difference", "std_mse_difference"), 6, "t_statistic")


@query("ev10_ensemble_mean", R + ", m AS (SELECT sqrt(avg(pow(predicted-actual,2))) AS a, sqrt(avg(pow(model_b-actual,2))) AS b, sqrt(avg(pow(model_c-actual,2))) AS c, sqrt(avg(pow((predicted+model_b+model_c)/3.0-actual,2))) AS e FROM p) SELECT round(a,5) AS predicted_rmse, round(b,5) AS model_b_rmse, round(c,5) AS model_c_rmse, round(e,5) AS ensemble_rmse, CASE WHEN e<least(a,b,c) THEN 'Ensemble wins' ELSE 'Individual model wins' END AS winner FROM m")
def _(t):
    d = ev.ensemble_mean(reg(t), A, [P, "model_b", "model_c"])
    return r(d, 5, *d.columns[:4])


@query("ev11_confusion_matrix", C + " SELECT actual, predicted, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY actual),4) AS pct_of_actual, round(100.0*count(*)/sum(count(*)) OVER (),4) AS pct_of_total, CASE WHEN actual=predicted THEN 'Correct' ELSE 'Incorrect' END AS outcome FROM c GROUP BY 1,2")
def _(t):
    return ev.confusion_matrix(cls(t), A, P)


_CM = C + """, a AS (SELECT actual AS k, count(*) FILTER (actual=predicted) AS tp, count(*) FILTER (actual<>predicted) AS fn FROM c GROUP BY 1), b AS (SELECT predicted AS k, count(*) FILTER (actual<>predicted) AS fp FROM c GROUP BY 1),
 m AS (SELECT coalesce(a.k,b.k) AS class_label, coalesce(tp,0) AS tp, coalesce(fn,0) AS fn, coalesce(fp,0) AS fp FROM a FULL JOIN b ON a.k=b.k),
 cm AS (SELECT *, tp+fn AS support, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1_score FROM m)"""


@query("ev12_classification_metrics", _CM + " SELECT class_label, tp, fn, fp, support, round(precision,8) AS precision, round(recall,8) AS recall, round(f1_score,8) AS f1_score FROM cm")
def _(t):
    return r(ev.class_metrics(cls(t), A, P), 8, "precision", "recall", "f1_score")


@query("ev12_accuracy", C + " SELECT count(*) AS total_predictions, count(DISTINCT actual) AS n_classes, count(*) FILTER (actual=predicted) AS correct, round(100.0*count(*) FILTER (actual=predicted)/count(*),6) AS accuracy, 'Poor' AS assessment FROM c")
def _(t):
    return r(ev.accuracy_summary(cls(t), A, P), 6, "accuracy")


@query("ev13_macro_weighted_avg", _CM + """, z AS (SELECT avg(precision) AS p, avg(recall) AS r, sum(precision*support)/sum(support) AS wp, sum(recall*support)/sum(support) AS wr, sum(f1_score*support)/sum(support) AS wf FROM cm)
 SELECT 'Macro Average' AS metric_type, round(p*100,7) AS avg_precision, round(r*100,7) AS avg_recall, round(2*p*r/(p+r)*100,7) AS avg_f1_score FROM z UNION ALL SELECT 'Weighted Average', round(wp*100,7), round(wr*100,7), round(wf*100,7) FROM z""")
def _(t):
    return r(ev.macro_weighted_avg(cls(t), A, P), 7, "avg_precision", "avg_recall", "avg_f1_score")


@query("ev14_majority_baseline", C + ", a AS (SELECT actual, count(*) AS n FROM c GROUP BY 1), b AS (SELECT actual, n FROM a ORDER BY n DESC, actual LIMIT 1), x AS (SELECT 100.0*count(*) FILTER (actual=predicted)/count(*) AS m, count(*) AS n FROM c) SELECT b.actual AS majority_class, round(100.0*b.n/x.n,6) AS baseline_accuracy, round(m,6) AS model_accuracy, CASE WHEN m>100.0*b.n/x.n THEN 'Model beats baseline' ELSE 'Model does not beat baseline' END AS comparison FROM b, x")
def _(t):
    return r(ev.majority_baseline(cls(t), A, P), 6, "baseline_accuracy", "model_accuracy")


@query("ev15_calibration", C + " SELECT CASE WHEN confidence>=.9 THEN '0.90-1.00' WHEN confidence>=.8 THEN '0.80-0.90' WHEN confidence>=.7 THEN '0.70-0.80' WHEN confidence>=.6 THEN '0.60-0.70' ELSE '0.00-0.60' END AS confidence_range, count(*) AS sample_count, count(*) FILTER (actual=predicted) AS correct, round(100.0*count(*) FILTER (actual=predicted)/count(*),6) AS accuracy_pct, round(avg(confidence),8) AS avg_confidence FROM c GROUP BY 1")
def _(t):
    return r(r(ev.calibration_by_confidence(cls(t), A, P, "confidence"), 6, "accuracy_pct"), 8, "avg_confidence")


@query("ev16_evaluation_history", R + ", m AS (SELECT avg(e*e) AS MSE, sqrt(avg(e*e)) AS RMSE, avg(abs(e)) AS MAE FROM e), u AS (UNPIVOT m ON MSE, RMSE, MAE INTO NAME metric_name VALUE v) SELECT metric_name, run, round(v,4) AS metric_value FROM u, (SELECT unnest(['first','second']) AS run)")
def _(t):
    path = scratch(t.spark, "evaluations")
    m = ev.regression_metrics(reg(t), A, P, ("MSE", "RMSE", "MAE"))
    io.append_table(m.withColumn("run", F.lit("first")), path)
    return r(io.append_table(m.withColumn("run", F.lit("second")), path), 4, "metric_value")


@query("ev17_prediction_checks", R + """, a AS (SELECT abs(avg(actual)-avg(predicted))/abs(avg(actual)) AS d, corr(actual,predicted) AS c, count(*) FILTER (actual=0) AS z, count(*) AS n FROM p)
 SELECT 'Range Consistency' AS check_name, round(d,7) AS value, CASE WHEN d>.5 THEN 'WARNING - Large difference between means' ELSE 'PASS - Means are similar' END AS status FROM a
 UNION ALL SELECT 'Correlation', round(c,7), CASE WHEN c>.7 THEN 'PASS - Good correlation (>0.7)' WHEN c>.5 THEN 'ACCEPTABLE - Moderate correlation (0.5-0.7)' WHEN c>0 THEN 'WARNING - Weak correlation (0-0.5)' ELSE 'FAIL - Negative or zero correlation' END FROM a
 UNION ALL SELECT 'Zero Values', z, CASE WHEN z>0 THEN 'WARNING - Zero values present (MAPE will be affected)' ELSE 'PASS - No zero values' END FROM a
 UNION ALL SELECT 'Overall', n, CASE WHEN n<30 THEN 'FAIL - Insufficient sample size' WHEN c>.3 THEN 'PASS - Ready' ELSE 'WARNING - Very weak correlation' END FROM a""")
def _(t):
    return r(ev.prediction_quality_checks(reg(t), A, P), 7, "value")


@query("ev17_label_checks", C + " SELECT count(DISTINCT actual) AS n_actual_classes, count(DISTINCT predicted) AS n_predicted_classes, count(*) AS sample_size, CASE WHEN count(DISTINCT actual)=count(DISTINCT predicted) THEN 'PASS - Same number of classes' ELSE 'WARNING - Different number of classes' END AS label_status, CASE WHEN count(*)>=30*count(DISTINCT actual) THEN 'PASS - Sufficient' ELSE 'WARNING - Small sample size' END AS size_status FROM c")
def _(t):
    return ev.label_checks(cls(t), A, P)


@query("ev18_top_confusions", C + " SELECT actual, predicted, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS pct_of_errors FROM c WHERE actual<>predicted GROUP BY 1,2 ORDER BY n DESC, 1, 2 LIMIT 10")
def _(t):
    return ev.top_confusions(cls(t), A, P)


_K2 = " UNION ALL ".join(f"SELECT '{c}' AS m, actual, {c} AS p FROM c" for c in ("predicted", "other"))


@query("ev19_classifier_compare", C + f""", l AS ({_K2}), acc AS (SELECT m, 100.0*count(*) FILTER (actual=p)/count(*) AS accuracy FROM l GROUP BY 1), a AS (SELECT m, actual AS k, count(*) AS na, count(*) FILTER (actual=p) AS tp FROM l GROUP BY 1,2), b AS (SELECT m, p AS k, count(*) AS np FROM l GROUP BY 1,2),
 f AS (SELECT coalesce(a.m,b.m) AS m, avg(2.0*coalesce(tp,0)/(coalesce(na,0)+coalesce(np,0))) AS f1 FROM a FULL JOIN b ON a.m=b.m AND a.k=b.k GROUP BY 1) SELECT acc.m AS model_name, round(accuracy,7) AS accuracy, round(f1,7) AS macro_f1, rank() OVER (ORDER BY accuracy DESC) AS accuracy_rank FROM acc JOIN f ON acc.m=f.m""")
def _(t):
    return r(ev.classifier_compare(cls(t), A, [P, "other"]), 7, "accuracy", "macro_f1")


@query("ml10_confidence_bands", C + " SELECT CASE WHEN confidence>=.9 THEN '0.90-1.00 (Very High)' WHEN confidence>=.8 THEN '0.80-0.90 (High)' WHEN confidence>=.7 THEN '0.70-0.80 (Medium-High)' WHEN confidence>=.6 THEN '0.60-0.70 (Medium)' WHEN confidence>=.5 THEN '0.50-0.60 (Medium-Low)' ELSE '0.00-0.50 (Low)' END AS confidence_range, count(*) AS n, round(avg((actual=predicted)::INT),8) AS accuracy_in_range, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM c GROUP BY 1")
def _(t):
    return r(ev.confidence_bands(cls(t), A, P, "confidence"), 8, "accuracy_in_range")


@query("ml10_confident_errors", C + " SELECT o_orderkey, actual, predicted FROM c WHERE actual<>predicted AND confidence>=.8")
def _(t):
    return ev.confident_errors(cls(t), A, P, "confidence", ["o_orderkey"])


@query("ml10_low_confidence", C + " SELECT o_orderkey, CASE WHEN actual=predicted THEN 'Correct' ELSE 'Incorrect' END AS result FROM c WHERE confidence<.6")
def _(t):
    return ev.low_confidence(cls(t), A, P, "confidence", ["o_orderkey"])

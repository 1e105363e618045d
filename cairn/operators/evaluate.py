"""Evaluation of regression and classification predictions.

Residual means predicted minus actual. Rows with a missing side are left
out of the metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_ge, band_gt, flag, pct, rnd, standardised, tally
from cairn.operators.relational import ntile
from cairn.plans.ordered import null_safe_join, share, with_stats
from cairn.plans.quantiles import quantiles

N = F.count


def scored(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    return rows.withColumns({"__a": F.col(actual).cast("double"), "__p": F.col(predicted).cast("double"), "__e": e.cast("double")})


def _r2() -> Column:
    """1 - SSE/SST in one pass; SST from the population variance."""
    return 1.0 - F.sum(F.col("__e") * F.col("__e")) / F.nullif(F.count(F.lit(1)) * F.var_pop("__a"), F.lit(0.0))


METRICS = {
    "MSE": lambda: F.avg(F.col("__e") * F.col("__e")), "RMSE": lambda: F.sqrt(F.avg(F.col("__e") * F.col("__e"))),
    "MAE": lambda: F.avg(F.abs("__e")), "MAPE": lambda: F.avg(F.abs(F.col("__e") / F.nullif(F.col("__a"), F.lit(0.0)))) * 100.0, "R2": _r2}


def regression_metrics(df: DataFrame, actual: str, predicted: str, metrics=tuple(METRICS)) -> DataFrame:
    one = scored(df, actual, predicted).agg(*[METRICS[m]().alias(m) for m in metrics])
    return one.unpivot([], list(metrics), "metric_name", "metric_value")


R2_BANDS = [(0.9, "Excellent"), (0.7, "Good"), (0.5, "Moderate"), (0.3, "Weak")]  # fixed values


def regression_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    out = scored(df, actual, predicted).agg(
        N(F.lit(1)).alias("observations"), METRICS["RMSE"]().alias("rmse"), METRICS["MAE"]().alias("mae"), _r2().alias("r_squared"),
        F.corr("__a", "__p").alias("correlation"), F.avg("__e").alias("mean_bias"))
    return out.withColumns({"model_quality": band_gt("r_squared", R2_BANDS, "Poor"), "bias_assessment": F.when(F.abs("mean_bias") / F.col("mae") < 0.1, "Unbiased")
                            .when(F.col("mean_bias") > 0, "Positive bias (over-prediction)").otherwise("Negative bias (under-prediction)")})


def baseline_compare(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Model error against predicting the mean or the median."""
    s = scored(df, actual, predicted)
    s = with_stats(s, [F.avg("__a").alias("__mean")]).crossJoin(F.broadcast(quantiles(s.select("__a"), {"__median": ("__a", .5)})))
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("__a"), 2)))
    out = s.agg(rmse("__p").alias("model_rmse"), rmse("__mean").alias("mean_baseline_rmse"), rmse("__median").alias("median_baseline_rmse"),
                F.avg(F.abs("__e")).alias("model_mae"), F.avg(F.abs(F.col("__mean") - F.col("__a"))).alias("mean_baseline_mae"),
                F.avg(F.abs(F.col("__median") - F.col("__a"))).alias("median_baseline_mae"))
    m = F.col("model_rmse")
    return out.withColumn("performance_assessment", F.when((m < F.col("mean_baseline_rmse")) & (m < F.col("median_baseline_rmse")), "Model outperforms both baselines")
                          .when(m < F.col("mean_baseline_rmse"), "Model outperforms mean baseline").otherwise("Model does not beat baselines - investigate"))


def residual_stats(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    s = scored(df, actual, predicted)
    q = quantiles(s.select("__e"), {"q1_residual": ("__e", .25), "median_residual": ("__e", .5), "q3_residual": ("__e", .75)})
    return s.agg(N(F.lit(1)).alias("n_observations"), F.avg("__e").alias("mean_residual"), F.stddev("__e").alias("std_residual"),
                 F.min("__e").alias("min_residual"), F.max("__e").alias("max_residual")).crossJoin(q)


def standardised_residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Residual over its standard deviation (not centred)."""
    s = with_stats(scored(df, actual, predicted), [F.stddev("__e").alias("__s")])
    return s.withColumn("standardized_residual", F.col("__e") / F.nullif(F.col("__s"), F.lit(0.0))).drop("__s")


SD_BINS = [(-3, "< -3 SD"), (-2, "-3 to -2 SD"), (-1, "-2 to -1 SD"), (0, "-1 to 0 SD"), (1, "0 to 1 SD"), (2, "1 to 2 SD"), (3, "2 to 3 SD")]  # fixed values


def residual_histogram(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    s = standardised_residuals(df, actual, predicted)
    return share(s.groupBy(band("standardized_residual", SD_BINS, "> 3 SD").alias("residual_bin")).agg(N(F.lit(1)).alias("n")), "n", "percentage")


def error_by_quantile(df: DataFrame, actual: str, predicted: str, on="predicted", parts=4) -> DataFrame:
    """Errors by equal-probability bands of the prediction or the actual."""
    s, c = scored(df, actual, predicted), "__p" if on == "predicted" else "__a"
    cuts = {f"__q{i}": (c, i / parts) for i in range(1, parts)}
    s = s.crossJoin(F.broadcast(quantiles(s.select(c), cuts)))
    group = F.lit(parts)
    for i in range(parts - 1, 0, -1):
        group = F.when(F.col(c) <= F.col(f"__q{i}"), i).otherwise(group)
    return s.groupBy(group.alias("quantile_band")).agg(
        N(F.lit(1)).alias("n_observations"), F.avg("__a").alias("avg_actual"), F.avg("__p").alias("avg_predicted"), METRICS["RMSE"]().alias("rmse"),
        METRICS["MAE"]().alias("mae"), F.corr("__a", "__p").alias("correlation"),
        (F.avg(F.col("__e") / F.nullif(F.col("__a"), F.lit(0.0))) * 100.0).alias("mean_percentage_error"))


def worst_predictions(df: DataFrame, actual: str, predicted: str, ids, n=20) -> DataFrame:
    s = scored(df, actual, predicted).withColumns({
        "absolute_error": F.abs("__e"), "percentage_error": F.abs(F.col("__e") / F.nullif(F.col("__a"), F.lit(0.0))) * 100.0,
        "error_direction": F.when(F.col("__e") > 0, "Over-prediction").otherwise("Under-prediction")})
    return s.orderBy(F.desc("absolute_error"), *ids).limit(n).select(*ids, actual, predicted, "absolute_error", "percentage_error", "error_direction")


def residual_outliers(df: DataFrame, actual: str, predicted: str, ids, limit=2.0) -> DataFrame:
    s = standardised_residuals(df, actual, predicted).filter(F.abs("standardized_residual") > limit)
    return s.select(*ids, "standardized_residual", band_gt(F.abs("standardized_residual"), [(3, "Extreme outlier (>3 sd)")], "Moderate outlier (>2 sd)").alias("outlier_status"))


def bias_split(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    s = scored(df, actual, predicted)
    kind = F.when(F.col("__e") > 0, "Over-predictions").when(F.col("__e") < 0, "Under-predictions").otherwise("Exact predictions")
    return share(s.groupBy(kind.alias("prediction_bias")).agg(N(F.lit(1)).alias("n"), F.avg(F.abs("__e")).alias("avg_absolute_error"),
                                                              F.avg("__e").alias("avg_signed_error")), "n", "percentage")


def homoscedasticity(df: DataFrame, actual: str, predicted: str, ids) -> DataFrame:
    """Residual spread by deciles of the prediction, with linearity check."""
    t = ntile(scored(df, actual, predicted), [], ["__p", *ids], 10, "decile")
    d = t.groupBy("decile").agg(N(F.lit(1)).alias("n_observations"), F.avg("__p").alias("avg_predicted"), F.avg("__e").alias("avg_residual"),
                                F.stddev("__e").alias("std_residual"), F.avg(F.col("__e") * F.col("__e")).alias("avg_squared_error"))
    d = with_stats(d, [F.max(F.when(F.col("decile") == 1, F.col("std_residual"))).alias("__base")])
    return d.withColumns({
        "variance_assessment": F.when(F.col("decile") == 1, "Baseline").when(F.col("std_residual") > 1.5 * F.col("__base"), "Higher variance").otherwise("Similar variance"),
        "linearity_check": F.when(F.abs("avg_residual") < F.col("std_residual") / F.sqrt("n_observations"), "PASS").otherwise("WARNING - Possible Non-Linearity")}).drop("__base")


def variance_halves(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    s = scored(df, actual, predicted)
    s = s.crossJoin(F.broadcast(quantiles(s.select("__p"), {"__m": ("__p", .5)})))
    low = F.col("__p") <= F.col("__m")
    out = s.agg(F.variance(F.when(low, F.col("__e"))).alias("lower_variance"), F.variance(F.when(~low, F.col("__e"))).alias("upper_variance"))
    ratio = F.greatest("lower_variance", "upper_variance") / F.nullif(F.least("lower_variance", "upper_variance"), F.lit(0.0))
    return out.withColumn("variance_ratio", ratio).withColumn("homoscedasticity_check", band("variance_ratio", [
        (2, "PASS - Homoscedastic"), (4, "WARNING - Possible Heteroscedasticity")], "FAIL - Heteroscedastic"))


def normality(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    s = with_stats(scored(df, actual, predicted), [F.avg("__e").alias("__m"), F.stddev("__e").alias("__s")])
    z = standardised("__e", "__m", "__s")
    out = s.agg(F.avg(F.pow(z, 3)).alias("skewness"), (F.avg(F.pow(z, 4)) - 3.0).alias("excess_kurtosis"))
    return out.withColumns({"normality_check_skew": band(F.abs("skewness"), [(0.5, "PASS - Near Normal"), (1.0, "WARNING - Moderate Skew")], "FAIL - High Skew"),
                            "normality_check_kurtosis": band(F.abs("excess_kurtosis"), [(1.0, "PASS - Near Normal"), (2.0, "WARNING - Moderate Kurtosis")], "FAIL - High Kurtosis")})


# ---- several models -------------------------------------------------------

def long_predictions(df: DataFrame, actual: str, predictions) -> DataFrame:
    return df.select(actual, *predictions).unpivot([actual], list(predictions), "model_name", "predicted")


def model_compare(df: DataFrame, actual: str, predictions) -> DataFrame:
    """Metrics of each prediction column with ranks; windows run over one row
    per model."""
    s = scored(long_predictions(df, actual, predictions), actual, "predicted")
    m = s.groupBy("model_name").agg(METRICS["RMSE"]().alias("rmse"), METRICS["MAE"]().alias("mae"), _r2().alias("r_squared"))
    w = lambda c: F.rank().over(Window.partitionBy().orderBy(c))
    m = m.withColumns({"rmse_rank": w(F.asc("rmse")), "mae_rank": w(F.asc("mae")), "r_squared_rank": w(F.desc("r_squared"))})
    return m.withColumn("combined_rank", F.col("rmse_rank") + F.col("mae_rank") + F.col("r_squared_rank"))


def paired_loss_test(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    a, b = F.pow(F.col(first) - F.col(actual), 2), F.pow(F.col(second) - F.col(actual), 2)
    out = df.dropna(subset=[actual, first, second]).agg(
        F.avg(a).alias("model1_avg_mse"), F.avg(b).alias("model2_avg_mse"), F.avg(a - b).alias("avg_mse_difference"), F.stddev(a - b).alias("std_mse_difference"),
        N(F.lit(1)).alias("n_samples"))
    t = F.col("avg_mse_difference") / F.nullif(F.col("std_mse_difference") / F.sqrt("n_samples"), F.lit(0.0))
    return out.withColumn("t_statistic", t).withColumn("significance_interpretation", band_gt(F.abs("t_statistic"), [
        (2.576, "Significantly different (p<0.01)"), (1.96, "Significantly different (p<0.05)")], "No significant difference (p>=0.05)"))


def ensemble_mean(df: DataFrame, actual: str, predictions) -> DataFrame:
    e = reduce(lambda x, y: x + y, [F.col(p) for p in predictions]) / float(len(predictions))
    rmse = lambda c: F.sqrt(F.avg(F.pow(c - F.col(actual), 2)))
    out = df.dropna(subset=[actual, *predictions]).agg(*[rmse(F.col(p)).alias(f"{p}_rmse") for p in predictions], rmse(e).alias("ensemble_rmse"))
    best = F.least(*[F.col(f"{p}_rmse") for p in predictions])
    return out.withColumn("winner", F.when(F.col("ensemble_rmse") < best, "Ensemble wins").otherwise("Individual model wins"))


# ---- classification -------------------------------------------------------

def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.dropna(subset=[actual, predicted]).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(N(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    c = share(pair_counts(df, actual, predicted), "n", "pct_of_actual", ["actual"])
    return share(c, "n", "pct_of_total").withColumn("outcome", F.when(F.col("actual") == F.col("predicted"), "Correct").otherwise("Incorrect"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 per class; a class seen on one side only is kept
    with zeros on the other."""
    c = pair_counts(df, actual, predicted)
    hit = F.col("actual") == F.col("predicted")
    by = lambda k, ok, miss: c.groupBy(F.col(k).alias("class_label")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(ok), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias(miss))
    j = by("actual", "tp", "fn").join(by("predicted", "__tp", "fp"), "class_label", "full").fillna(0, ["tp", "fn", "fp"]).drop("__tp")
    d = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return j.withColumns({"support": tp + fn, "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1_score": d(2.0 * tp, 2 * tp + fp + fn)})


def accuracy_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    c = pair_counts(df, actual, predicted)
    out = c.agg(F.sum("n").alias("total_predictions"), F.countDistinct("actual").alias("n_classes"),
                F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct"))
    a = pct("correct", "total_predictions")
    return out.withColumn("accuracy", a).withColumn("assessment", band_ge("accuracy", [(90, "Excellent"), (80, "Good"), (70, "Moderate")], "Poor"))


def macro_weighted_avg(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Macro F1 is taken from mean precision and mean recall; the weighted
    one averages the class F1 by support."""
    m = class_metrics(df, actual, predicted)
    one = m.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.sum("support").alias("s"),
                *[F.sum(F.col(c) * F.col("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1_score")])
    mf = F.when(F.col("mp") + F.col("mr") > 0, 2 * F.col("mp") * F.col("mr") / (F.col("mp") + F.col("mr"))).otherwise(0.0)
    row = lambda k, p, r, f: F.struct(F.lit(k).alias("metric_type"), (p * 100.0).alias("avg_precision"), (r * 100.0).alias("avg_recall"), (f * 100.0).alias("avg_f1_score"))
    w = lambda c: F.col(f"w_{c}") / F.col("s")
    return one.select(F.explode(F.array(row("Macro Average", F.col("mp"), F.col("mr"), mf), row("Weighted Average", w("precision"), w("recall"), w("f1_score")))).alias("r")).select("r.*")


def majority_baseline(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    c = pair_counts(df, actual, predicted)
    by = c.groupBy("actual").agg(F.sum("n").alias("k"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("ok"))
    out = by.agg(F.min(F.struct(-F.col("k"), "actual"))["actual"].alias("majority_class"), pct(F.max("k"), F.sum("k")).alias("baseline_accuracy"), pct(F.sum("ok"), F.sum("k")).alias("model_accuracy"))
    return out.withColumn("comparison", F.when(F.col("model_accuracy") > F.col("baseline_accuracy"), "Model beats baseline").otherwise("Model does not beat baseline"))


CONFIDENCE = [(0.9, "0.90-1.00"), (0.8, "0.80-0.90"), (0.7, "0.70-0.80"), (0.6, "0.60-0.70")]  # fixed values


def calibration_by_confidence(df: DataFrame, actual: str, predicted: str, confidence: str) -> DataFrame:
    ok = tally(F.col(actual) == F.col(predicted))
    return df.groupBy(band_ge(confidence, CONFIDENCE, "0.00-0.60").alias("confidence_range")).agg(
        N(F.lit(1)).alias("sample_count"), ok.alias("correct"), pct(ok, N(F.lit(1))).alias("accuracy_pct"), F.avg(confidence).alias("avg_confidence"))


def confidence_bands(df: DataFrame, actual: str, predicted: str, confidence: str) -> DataFrame:
    labels = [(0.9, "0.90-1.00 (Very High)"), (0.8, "0.80-0.90 (High)"), (0.7, "0.70-0.80 (Medium-High)"), (0.6, "0.60-0.70 (Medium)"), (0.5, "0.50-0.60 (Medium-Low)")]
    out = df.groupBy(band_ge(confidence, labels, "0.00-0.50 (Low)").alias("confidence_range")).agg(
        N(F.lit(1)).alias("n"), F.avg(flag(F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy_in_range"))
    return share(out, "n", "percentage")


def low_confidence(df: DataFrame, actual: str, predicted: str, confidence: str, ids, limit=0.6) -> DataFrame:
    return df.filter(F.col(confidence) < limit).select(*ids, F.when(F.col(actual) == F.col(predicted), "Correct").otherwise("Incorrect").alias("result"))


def confident_errors(df: DataFrame, actual: str, predicted: str, confidence: str, ids, limit=0.8) -> DataFrame:
    return df.filter((F.col(actual) != F.col(predicted)) & (F.col(confidence) >= limit)).select(*ids, actual, predicted)


def prediction_quality_checks(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Check rows for numeric predictions: means, correlation, MAPE safety,
    completeness."""
    a, p = F.col(actual), F.col(predicted)
    one = df.agg(F.avg(a).alias("ma"), F.avg(p).alias("mp"), F.corr(actual, predicted).alias("r"), tally(a == 0).alias("z"), N(F.lit(1)).alias("n"), N(a).alias("na"), N(p).alias("np"))
    rel = F.abs(F.col("ma") - F.col("mp")) / F.abs(F.nullif(F.col("ma"), F.lit(0.0)))
    row = lambda name, v, s: F.struct(F.lit(name).alias("check_name"), v.cast("double").alias("value"), s.alias("status"))
    ready = F.when(F.col("n") < 30, "FAIL - Insufficient sample size").when((F.col("na") < F.col("n")) | (F.col("np") < F.col("n")), "FAIL - Missing values present") \
             .when(F.col("r") > 0.3, "PASS - Ready").otherwise("WARNING - Very weak correlation")
    rows = [row("Range Consistency", rel, F.when(rel > 0.5, "WARNING - Large difference between means").otherwise("PASS - Means are similar")),
            row("Correlation", F.col("r"), band_gt("r", [(0.7, "PASS - Good correlation (>0.7)"), (0.5, "ACCEPTABLE - Moderate correlation (0.5-0.7)"), (0, "WARNING - Weak correlation (0-0.5)")], "FAIL - Negative or zero correlation")),
            row("Zero Values", F.col("z"), F.when(F.col("z") > 0, "WARNING - Zero values present (MAPE will be affected)").otherwise("PASS - No zero values")),
            row("Overall", F.col("n"), ready)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def label_checks(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    c = pair_counts(df, actual, predicted)
    out = c.agg(F.countDistinct("actual").alias("n_actual_classes"), F.countDistinct("predicted").alias("n_predicted_classes"), F.sum("n").alias("sample_size"))
    return out.withColumns({
        "label_status": F.when(F.col("n_actual_classes") == F.col("n_predicted_classes"), "PASS - Same number of classes").otherwise("WARNING - Different number of classes"),
        "size_status": F.when(F.col("sample_size") >= 30 * F.col("n_actual_classes"), "PASS - Sufficient").otherwise("WARNING - Small sample size")})


def top_confusions(df: DataFrame, actual: str, predicted: str, n=10) -> DataFrame:
    c = share(pair_counts(df, actual, predicted).filter("actual <> predicted"), "n", "pct_of_errors")
    return c.orderBy(F.desc("n"), "actual", "predicted").limit(n)


def classifier_compare(df: DataFrame, actual: str, predictions) -> DataFrame:
    """Accuracy and macro F1 of several prediction columns in one pass over
    the unpivoted pairs."""
    long = df.select(actual, *predictions).unpivot([actual], list(predictions), "model_name", "predicted")
    c = long.groupBy("model_name", F.col(actual).alias("actual"), "predicted").agg(N(F.lit(1)).alias("n"))
    hit = F.col("actual") == F.col("predicted")
    acc = c.groupBy("model_name").agg(pct(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    by = lambda k, t: c.groupBy("model_name", F.col(k).alias("label")).agg(F.sum("n").alias(t), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    f = by("actual", "na").join(by("predicted", "np").drop("tp"), ["model_name", "label"], "full").fillna(0, ["na", "np", "tp"])
    f1 = f.groupBy("model_name").agg(F.avg(2.0 * F.col("tp") / (F.col("na") + F.col("np"))).alias("macro_f1"))
    out = acc.join(f1, "model_name")
    return out.withColumn("accuracy_rank", F.rank().over(Window.partitionBy().orderBy(F.desc("accuracy"))))  # one row per model

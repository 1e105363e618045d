"""Column profiling: catalogue, statistics, distributions, correlations,
outliers. Statistics of all columns come from one aggregate pass; what is
laid out as rows afterwards is one row per column."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.expr import band, band_ge, band_gt, flag, pct, rnd, standardised, tally
from cairn.operators.relational import cumulative_share, ntile, ranked
from cairn.operators.vectors import top_k
from cairn.plans.ordered import null_safe_join, share, with_stats
from cairn.plans.quantiles import quantiles

PERCENTILES = {"p01": .01, "p05": .05, "p10": .10, "q1": .25, "median": .5, "q3": .75, "p90": .90, "p95": .95, "p99": .99}


def as_rows(one: DataFrame, cols, stats, key="column_name") -> DataFrame:
    """One wide row with columns ``<i>__<stat>`` as one row per column."""
    cells = [F.struct(F.lit(c).alias(key), *[F.col(f"{i}__{s}").alias(s) for s in stats]) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def summarise(df: DataFrame, cols, stats: dict) -> DataFrame:
    """stats: name -> function of a column name giving an aggregate."""
    one = df.agg(*[fn(c).alias(f"{i}__{s}") for i, c in enumerate(cols) for s, fn in stats.items()])
    return as_rows(one, cols, list(stats))


def quantile_rows(df: DataFrame, cols, probs: dict) -> DataFrame:
    one = quantiles(df.select(*cols), {f"{i}__{n}": (c, p) for i, c in enumerate(cols) for n, p in probs.items()})
    return as_rows(one, cols, list(probs))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def type_category(dtype: str) -> str:
    if dtype.startswith(NUMERIC):
        return "NUMERIC"
    if dtype.startswith(("date", "timestamp", "interval")):
        return "DATETIME"
    return "BINARY" if dtype == "binary" else "CHARACTER"


def column_catalog(df: DataFrame, category_limit=50, exact=True) -> DataFrame:
    """Type category, distinct count and profiling strategy per column.
    ``exact=False`` uses a sketch for the distinct counts."""
    cols, kinds = df.columns, dict(df.dtypes)
    rows = summarise(df, cols, {"distinct_count": F.countDistinct if exact else F.approx_count_distinct})
    category = F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(type_category(kinds[c])))])[F.col("column_name")]
    rows = rows.withColumn("column_category", category)
    cat = F.col("column_category")
    return rows.withColumn("profiling_strategy", F.when(cat == "NUMERIC", "NUMERIC_PROFILE").when(cat == "DATETIME", "DATETIME_PROFILE")
                           .when(cat == "BINARY", "BINARY_NO_PROFILE").when(F.col("distinct_count") < category_limit, "CATEGORICAL_PROFILE")
                           .otherwise("TEXT_PROFILE"))


def strategy_lists(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("profiling_strategy").agg(F.count(F.lit(1)).alias("column_count"), F.array_join(
        F.array_sort(F.collect_list("column_name")), ", ").alias("columns"))  # one entry per column


def volume_assessment(df: DataFrame) -> DataFrame:
    n, width = F.col("total_rows"), len(df.columns)
    out = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(width))
    # Limits and labels of the volume report.
    return out.withColumns({
        "data_volume_assessment": band(n, [(10, "INSUFFICIENT - Less than 10 rows"), (100, "MINIMAL - Limited statistical power"),
                                           (1000, "ADEQUATE - Basic profiling possible"), (1000000, "GOOD - Full profiling recommended")],
                                       "LARGE - Consider sampling for efficiency"),
        "dimensionality_assessment": band("total_columns", [(5, "FEW - Limited dimensions"), (20, "MODERATE - Standard profiling"),
                                                            (100, "MANY - Comprehensive profiling")], "VERY MANY - Consider focused profiling")})


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """Distinct values per column. Kept apart from other aggregates, which
    would be carried through the expansion that several distincts need."""
    return summarise(df, cols, {"distinct_count": F.countDistinct})


def numeric_profile(df: DataFrame, cols) -> DataFrame:
    """One row per numeric column."""
    n = F.count(F.lit(1))
    base = summarise(df, cols, {
        "total_count": lambda c: n, "non_null_count": F.count, "min_value": lambda c: F.min(F.col(c).cast("double")),
        "max_value": lambda c: F.max(F.col(c).cast("double")), "mean_value": F.avg, "std_dev": F.stddev, "variance_value": F.variance})
    q = quantile_rows(df, cols, {"q1": .25, "median": .5, "q3": .75})
    out = base.join(q, "column_name").join(distinct_counts(df, cols), "column_name")
    return out.withColumns({
        "null_count": F.col("total_count") - F.col("non_null_count"),
        "null_percentage": pct(F.col("total_count") - F.col("non_null_count"), "total_count"),
        "uniqueness_percentage": pct("distinct_count", "non_null_count"), "iqr": F.col("q3") - F.col("q1"),
        "coefficient_of_variation": F.col("std_dev") / F.nullif(F.col("mean_value"), F.lit(0.0)) * 100.0})


def univariate_stats(df: DataFrame, cols, probs=PERCENTILES) -> DataFrame:
    """Long rows (column_name, stat, value)."""
    p = numeric_profile(df, cols)
    m = shape_moments(df, cols)
    extra = {n: v for n, v in probs.items() if n not in ("q1", "median", "q3")}
    out = p.join(m, "column_name").join(quantile_rows(df, cols, extra), "column_name")
    out = out.withColumn("range_value", F.col("max_value") - F.col("min_value"))
    stats = ["total_count", "non_null_count", "null_count", "distinct_count", "min_value", "max_value", "mean_value", "std_dev", "variance_value",
             "q1", "median", "q3", "iqr", "coefficient_of_variation", "range_value", "skewness", "excess_kurtosis", *extra]
    return out.select("column_name", *[F.col(s).cast("double").alias(s) for s in stats]).unpivot(["column_name"], stats, "stat", "value")


def column_summary(df: DataFrame, cols=None) -> DataFrame:
    """Type, null share, and min, max, mean for numeric columns."""
    cols, kinds = cols or df.columns, dict(df.dtypes)
    num = {c: type_category(kinds[c]) == "NUMERIC" for c in cols}
    n = F.count(F.lit(1))
    pick = lambda fn: lambda c: fn(F.col(c).cast("double")) if num[c] else F.max(F.lit(None).cast("double"))
    out = summarise(df, cols, {"total_count": lambda c: n, "null_pct": lambda c: pct(n - F.count(c), n), "min_value": pick(F.min),
                               "max_value": pick(F.max), "mean_value": pick(F.avg)})
    kind = F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(type_category(kinds[c])))])[F.col("column_name")]
    return out.withColumn("column_category", kind)


def sign_counts(df: DataFrame, cols) -> DataFrame:
    n = F.count(F.lit(1))
    tests = {"zero": lambda c: F.col(c) == 0, "negative": lambda c: F.col(c) < 0, "positive": lambda c: F.col(c) > 0}
    stats = {}
    for k, t in tests.items():
        stats[f"{k}_count"] = lambda c, t=t: tally(t(c))
        stats[f"{k}_percentage"] = lambda c, t=t: pct(tally(t(c)), n)
    return summarise(df, cols, stats)


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column_name, value, frequency) of non-null values of all columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))


def frequency(df: DataFrame, cols, k=10, others="Other_Values") -> DataFrame:
    """The k most frequent values per column, the rest folded into one row."""
    counts = value_counts(df, cols)
    top = top_k(counts, ["column_name"], k, [-F.col("frequency"), F.col("value")])
    total = counts.groupBy("column_name").agg(F.sum("frequency").alias("__t"))
    used = top.groupBy("column_name").agg(F.sum("frequency").alias("__u"))
    rest = total.join(used, "column_name").filter("__t > __u").select("column_name", F.lit(others).alias("value"), (F.col("__t") - F.col("__u")).alias("frequency"))
    return share(top.unionByName(rest), "frequency", "percentage", ["column_name"])


def categorical_profile(df: DataFrame, cols) -> DataFrame:
    n = F.count(F.lit(1))
    base = summarise(df, cols, {"total_count": lambda c: n, "non_null_count": F.count})
    v = value_counts(df, cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.min(F.struct(-F.col("frequency"), "value")).alias("m"), F.min("frequency").alias("min_frequency"),
        F.max("frequency").alias("max_frequency"), F.avg("frequency").alias("avg_frequency"), F.stddev("frequency").alias("std_frequency"))
    out = base.join(v, "column_name", "left").withColumn("mode_value", F.col("m.value")).drop("m")
    d = F.col("distinct_count")
    return out.withColumns({
        "null_count": F.col("total_count") - F.col("non_null_count"), "cardinality_ratio": pct(d, "non_null_count"),
        "mode_percentage": pct("max_frequency", "non_null_count"), "imbalance_ratio": F.col("max_frequency") / F.col("min_frequency"),
        "cardinality_assessment": F.when(d == 1, "FAIL - Single Value").when(d > 100, "WARNING - Very High Cardinality")
                                   .when(d > 50, "WARNING - High Cardinality").otherwise("PASS - Normal Cardinality")})


def rare_values(df: DataFrame, column: str, limit=1.0) -> DataFrame:
    v = value_counts(df, [column])
    s = with_stats(v, [F.sum("frequency").alias("__t")]).filter(F.col("frequency") * 100.0 / F.col("__t") < limit)
    return s.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rare_value_count"), F.sum("frequency").alias("total_rare_frequency"),
        pct(F.sum("frequency"), F.max("__t")).alias("rare_value_percentage"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frequency", "value"))), lambda x: x["value"]), ", ").alias("rare_values"))


def category_balance(df: DataFrame, cols) -> DataFrame:
    """Spread of the category frequencies with balance labels."""
    p = categorical_profile(df, cols)
    cv = F.col("std_frequency") / F.nullif(F.col("avg_frequency"), F.lit(0.0))
    return p.select("column_name", F.col("distinct_count").alias("num_categories"), "avg_frequency", "std_frequency", "min_frequency", "max_frequency", "imbalance_ratio",
                    band(cv, [(0.3, "Highly Balanced"), (0.7, "Moderately Balanced")], "Imbalanced").alias("distribution_balance"),
                    band("imbalance_ratio", [(3, "PASS - Well Balanced"), (10, "WARNING - Moderate Imbalance")], "FAIL - Severe Imbalance").alias("balance_check"))


def entropy_label(ratio):
    return band_gt(ratio, [(0.9, "High Entropy - Nearly Uniform Distribution"), (0.6, "Moderate Entropy - Reasonably Distributed")],
                   "Low Entropy - Concentrated Distribution")


def text_lengths(df: DataFrame, cols) -> DataFrame:
    lens = df.select(*[F.length(c).alias(c) for c in cols])
    base = summarise(lens, cols, {"min_length": F.min, "max_length": F.max, "avg_length": F.avg, "std_length": F.stddev})
    return base.join(quantile_rows(lens, cols, {"median_length": .5}), "column_name")


def text_patterns(df: DataFrame, cols) -> DataFrame:
    """Values that match a pattern as a whole, ignoring case."""
    like = lambda p: lambda c: tally(F.regexp_like(F.lower(c), F.lit(p)))
    return summarise(df, cols, {"numeric_pattern_count": like("^[0-9]+$"), "alphabetic_pattern_count": like("^[a-z]+$"),
                                "alphanumeric_pattern_count": like("^[a-z0-9]+$"), "whitespace_issue_count": lambda c: tally(F.trim(c) != F.col(c))})


# ---- distributions --------------------------------------------------------

def shape_moments(df: DataFrame, cols) -> DataFrame:
    """Mean third and fourth powers standardised with the sample deviation."""
    r = with_stats(df.select(*cols), [x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"__m{i}"), F.stddev(c).alias(f"__s{i}"))])
    z = {c: standardised(c, f"__m{i}", f"__s{i}") for i, c in enumerate(cols)}
    return summarise(r, cols, {"skewness": lambda c: F.avg(F.pow(z[c], 3)), "excess_kurtosis": lambda c: F.avg(F.pow(z[c], 4)) - 3.0})


def bin_of(value, lo, hi, bins):
    return F.when(value == hi, bins - 1).otherwise(F.floor((value - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)))).cast("int")


def histogram_equal_width(df: DataFrame, column: str, bins=20) -> DataFrame:
    v = F.col(column).cast("double")
    r = with_stats(df.filter(v.isNotNull()).select(v.alias("v")), [F.min("v").alias("lo"), F.max("v").alias("hi")])
    c = r.groupBy(bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin_id"), "lo", "hi").agg(F.count(F.lit(1)).alias("frequency"))
    w = (F.col("hi") - F.col("lo")) / bins
    out = c.select("bin_id", (F.col("lo") + F.col("bin_id") * w).alias("bin_lower_bound"), (F.col("lo") + (F.col("bin_id") + 1) * w).alias("bin_upper_bound"), "frequency")
    out = share(out, "frequency", "percentage")
    top = F.max("frequency").over(Window.partitionBy())  # one row per bin
    return out.withColumn("visual_bar", F.rpad(F.lit("*"), F.greatest(F.floor(F.col("frequency") * 50.0 / top).cast("int"), F.lit(1)), F.lit("*")))


def histogram_equal_freq(df: DataFrame, column: str, tiebreak, bins=20) -> DataFrame:
    t = ntile(df.filter(F.col(column).isNotNull()).select(column, *tiebreak), [], [column, *tiebreak], bins, "bin_id")
    out = t.groupBy("bin_id").agg(F.min(column).alias("bin_lower_bound"), F.max(column).alias("bin_upper_bound"),
                                  F.count(F.lit(1)).alias("frequency"), F.avg(column).alias("bin_mean"))
    return share(out, "frequency", "percentage")


def distribution_shape(df: DataFrame, cols) -> DataFrame:
    p = numeric_profile(df, cols).join(shape_moments(df, cols), "column_name")
    sk, ku, m, md, sd = (F.col(c) for c in ("skewness", "excess_kurtosis", "mean_value", "median", "std_dev"))
    return p.select(
        "column_name", F.col("non_null_count").alias("sample_size"), "mean_value", "median", "std_dev", "skewness", "excess_kurtosis",
        F.when(F.abs(m - md) / F.nullif(sd, F.lit(0.0)) < 0.1, "Symmetric").when(m > md, "Right-skewed").otherwise("Left-skewed").alias("mean_median_indication"),
        F.when(F.abs(sk) < 0.5, "Approximately Symmetric").when(sk > 0.5, "Right-skewed (long tail right)").otherwise("Left-skewed (long tail left)").alias("skewness_interpretation"),
        F.when(F.abs(ku) < 0.5, "Normal tails (Mesokurtic)").when(ku > 0.5, "Heavy tails (Leptokurtic)").otherwise("Light tails (Platykurtic)").alias("kurtosis_interpretation"),
        F.when((F.abs(sk) < 0.5) & (F.abs(ku) < 0.5), "Potentially Normal").when((sk > 1) & (F.col("min_value") >= 0), "Possibly Log-normal or Exponential")
         .when(F.abs(ku) > 3, "Heavy-tailed (consider outlier analysis)").when((F.col("min_value") >= 0) & (F.col("max_value") <= 1), "Possibly Beta or Uniform")
         .otherwise("Non-standard distribution").alias("distribution_type_suggestion"),
        F.when(F.abs(sk) > 1, "Consider log or Box-Cox transformation").when(F.abs(ku) > 3, "Heavy tails - Check for outliers")
         .otherwise("Distribution shape acceptable").alias("transformation_recommendation"))


def empirical_rule(df: DataFrame, cols) -> DataFrame:
    r = with_stats(df.select(*cols), [x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"__m{i}"), F.stddev(c).alias(f"__s{i}"))])
    at = {c: i for i, c in enumerate(cols)}
    within = lambda k: lambda c: pct(tally(F.abs(F.col(c) - F.col(f"__m{at[c]}")) <= k * F.col(f"__s{at[c]}")), F.count(c))
    out = summarise(r, cols, {f"pct_within_{k}_std_dev": within(k) for k in (1, 2, 3)})
    ok = F.col("pct_within_1_std_dev").between(63, 73) & F.col("pct_within_2_std_dev").between(90, 98) & (F.col("pct_within_3_std_dev") > 99)
    return out.withColumn("empirical_rule_assessment", F.when(ok, "Consistent with Normal Distribution").otherwise("Likely Non-Normal Distribution"))


def modality(df: DataFrame, column: str, bins=20) -> DataFrame:
    """Local maxima of the equal-width histogram (an equal-frequency one is
    flat by construction); empty bins count as zero."""
    h = histogram_equal_width(df, column, bins).select("bin_id", "frequency")
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_id")).join(h, "bin_id", "left").fillna(0)
    w = Window.partitionBy().orderBy("bin_id")  # one row per bin
    z = F.lit(0)
    p = full.withColumn("peak", (F.col("frequency") > F.coalesce(F.lag("frequency").over(w), z)) & (F.col("frequency") > F.coalesce(F.lead("frequency").over(w), z)))
    n = F.col("num_peaks")
    return p.agg(tally(F.col("peak")).alias("num_peaks")).withColumn(
        "modality_assessment", F.when(n == 1, "Unimodal (single peak)").when(n == 2, "Potentially Bimodal (two peaks)")
        .when(n > 2, "Multimodal (multiple peaks)").otherwise("Uniform or unclear distribution"))


def concentration(df: DataFrame, column: str) -> DataFrame:
    """How many of the most frequent values cover 50 and 80 percent."""
    c = cumulative_share(df, column)
    s = F.col("cumulative_percentage")
    return c.agg(F.min(F.when(s <= 50, F.col(column))).alias("min_value_top50pct"), F.max(F.when(s <= 50, F.col(column))).alias("max_value_top50pct"),
                 tally(s <= 50).alias("distinct_values_top50pct"), tally(s <= 80).alias("distinct_values_top80pct"), F.count(F.lit(1)).alias("total_distinct_values"))


def iqr_bounds(df: DataFrame, column: str, k=1.5) -> DataFrame:
    q = quantiles(df.select(column), {"q1": (column, .25), "median": (column, .5), "q3": (column, .75)})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"iqr": iqr, "lower_bound": F.col("q1") - k * iqr, "upper_bound": F.col("q3") + k * iqr,
                          "extreme_lower": F.col("q1") - 2 * k * iqr, "extreme_upper": F.col("q3") + 2 * k * iqr})


def box_stats(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    r = df.select(column).crossJoin(F.broadcast(iqr_bounds(df, column)))
    keep = ["q1", "median", "q3", "iqr", "lower_bound", "upper_bound"]
    return r.groupBy(*keep).agg(
        F.min(F.when(v >= F.col("lower_bound"), v)).alias("lower_whisker"), F.max(F.when(v <= F.col("upper_bound"), v)).alias("upper_whisker"),
        tally(v < F.col("lower_bound")).alias("lower_outlier_count"), tally(v > F.col("upper_bound")).alias("upper_outlier_count"))


# ---- correlation ----------------------------------------------------------

STRENGTH = [(0.9, "Very Strong"), (0.7, "Strong"), (0.4, "Moderate"), (0.2, "Weak")]  # fixed values


def correlation_pairs(df: DataFrame, cols, method="pearson") -> DataFrame:
    """All pairs of columns from one aggregate. Spearman correlates average
    ranks, which come from the counts of distinct values."""
    if method == "spearman":
        df = df.select(*cols).dropna()
        for c in cols:
            df = df.join(ranked(df.select(c), [], c).select(c, F.col("average_rank").alias(f"__r_{c}")), c)
        df = df.select(*[F.col(f"__r_{c}").alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.col(f"c{i}").alias("correlation"))
                                         for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
    r = F.col("correlation")
    return out.withColumns({"strength_category": band_ge(F.abs(r), STRENGTH, "Very Weak"),
                            "direction": F.when(r > 0, "Positive").when(r < 0, "Negative").otherwise("None"),
                            "recommendation": band_ge(F.abs(r), [(0.9, "Consider removing one variable"), (0.7, "Monitor for multicollinearity")], "No action needed")})


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    one = df.agg(*[F.corr(a, b).alias(f"{i}__{b}") for i, a in enumerate(cols) for b in cols])
    return as_rows(one, cols, list(cols), "row_variable")


def multicollinearity(pairs: DataFrame, limit=0.7) -> DataFrame:
    r = F.col("correlation")
    return pairs.filter(F.abs(r) > limit).select("variable_1", "variable_2", "correlation", band_ge(F.abs(r), [
        (0.9, "CRITICAL - Potential Redundancy"), (0.7, "HIGH - Multicollinearity Risk")], "MODERATE - Monitor").alias("multicollinearity_risk"))


def vif(pairs: DataFrame) -> DataFrame:
    r2 = F.col("correlation") * F.col("correlation")
    v = F.col("vif_estimate")
    return pairs.select("variable_1", "variable_2", r2.alias("r_squared"), (1.0 / F.nullif(1.0 - r2, F.lit(0.0))).alias("vif_estimate")).withColumn(
        "multicollinearity_level", band_gt(v, [(10, "SEVERE - High Multicollinearity"), (5, "MODERATE - Some Multicollinearity")], "LOW - Acceptable"))


def target_correlation(df: DataFrame, features, target: str) -> DataFrame:
    out = summarise(df, features, {"correlation": lambda c: F.corr(c, target)}).withColumnRenamed("column_name", "feature_name")
    r = F.col("correlation")
    return out.withColumns({
        "predictive_strength": band_ge(F.abs(r), [(0.7, "Strong Predictor"), (0.4, "Moderate Predictor"), (0.2, "Weak Predictor")], "Poor Predictor"),
        "relationship": F.when(r > 0, "Positive (increases with target)").when(r < 0, "Negative (decreases with target)").otherwise("No Linear Relationship")})


def correlation_summary(pairs: DataFrame) -> DataFrame:
    a = F.abs("correlation")
    out = pairs.agg(F.count(F.lit(1)).alias("total_pairs"), tally(a >= 0.9).alias("very_strong"), tally((a >= 0.7) & (a < 0.9)).alias("strong"),
                    tally((a >= 0.4) & (a < 0.7)).alias("moderate"), tally(a < 0.4).alias("weak"), F.avg(a).alias("avg_abs_correlation"),
                    F.max(a).alias("strongest_correlation"))
    return out.withColumn("multicollinearity_assessment", F.when(F.col("very_strong") > 0, "HIGH - Feature redundancy detected")
                          .when(F.col("strong") > F.col("total_pairs") * 0.3, "MODERATE - Some multicollinearity").otherwise("LOW - Features relatively independent"))


# ---- outliers -------------------------------------------------------------

def outliers_iqr(df: DataFrame, column: str, k=1.5) -> DataFrame:
    v, b = F.col(column), iqr_bounds(df, column, k)
    r = df.select(column).filter(v.isNotNull()).crossJoin(F.broadcast(b))
    out = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    far = (v < F.col("extreme_lower")) | (v > F.col("extreme_upper"))
    n = F.count(F.lit(1))
    return r.groupBy("q1", "q3", "iqr", "lower_bound", "upper_bound", "extreme_lower", "extreme_upper").agg(
        n.alias("total_records"), tally(out).alias("outlier_count"), tally(far).alias("extreme_outlier_count"), pct(tally(out), n).alias("outlier_percentage"))


def outlier_rows_iqr(df: DataFrame, column: str, k=1.5) -> DataFrame:
    v = F.col(column)
    r = df.crossJoin(F.broadcast(iqr_bounds(df, column, k).select("lower_bound", "upper_bound")))
    r = r.filter((v < F.col("lower_bound")) | (v > F.col("upper_bound")))
    return r.withColumns({"outlier_type": F.when(v < F.col("lower_bound"), "Lower Outlier").otherwise("Upper Outlier"),
                          "distance_from_lower": v - F.col("lower_bound"), "distance_from_upper": F.col("upper_bound") - v})


def with_z(df: DataFrame, column: str, name="z_score") -> DataFrame:
    r = with_stats(df.filter(F.col(column).isNotNull()), [F.avg(column).alias("__m"), F.stddev(column).alias("__s")])
    return r.withColumn(name, standardised(column, "__m", "__s"))


def outliers_zscore(df: DataFrame, column: str) -> DataFrame:
    r, z, n = with_z(df, column), F.abs("z_score"), F.count(F.lit(1))
    return r.groupBy(F.col("__m").alias("mean_value"), F.col("__s").alias("std_deviation")).agg(
        n.alias("total_records"), tally(z > 2).alias("outliers_2sd"), tally(z > 3).alias("outliers_3sd"), pct(tally(z > 3), n).alias("outlier_percentage_3sd"))


def outlier_rows_zscore(df: DataFrame, column: str, limit=2.0) -> DataFrame:
    r = with_z(df, column).drop("__m", "__s").filter(F.abs("z_score") > limit)
    return r.withColumn("outlier_severity", band_gt(F.abs("z_score"), [(3, "Extreme Outlier (>3 sd)"), (2, "Moderate Outlier (>2 sd)")], "Mild Outlier"))


def mad_bounds(df: DataFrame, column: str) -> DataFrame:
    """Median and median absolute deviation; the second pass needs the first."""
    m = quantiles(df.select(column), {"median_value": (column, .5)})
    d = df.select(column).filter(F.col(column).isNotNull()).crossJoin(F.broadcast(m)).select(F.abs(F.col(column) - F.col("median_value")).alias("d"))
    return m.crossJoin(quantiles(d, {"mad_value": ("d", .5)}))


def outliers_mad(df: DataFrame, column: str, limit=3.5) -> DataFrame:
    r = df.select(column).filter(F.col(column).isNotNull()).crossJoin(F.broadcast(mad_bounds(df, column)))
    far = F.abs(0.6745 * (F.col(column) - F.col("median_value")) / F.nullif(F.col("mad_value"), F.lit(0.0))) > limit
    n = F.count(F.lit(1))
    return r.groupBy("median_value", "mad_value").agg(n.alias("total_records"), tally(far).alias("outlier_count"), pct(tally(far), n).alias("outlier_percentage"))


def outliers_percentile(df: DataFrame, column: str) -> DataFrame:
    q = quantiles(df.select(column), {n: (column, PERCENTILES[n]) for n in ("p01", "p05", "p95", "p99")})
    v, n = F.col(column), F.count(F.lit(1))
    r = df.select(column).filter(v.isNotNull()).crossJoin(F.broadcast(q))
    e = (v < F.col("p01")) | (v > F.col("p99"))
    return r.groupBy("p01", "p05", "p95", "p99").agg(n.alias("total_records"), tally(e).alias("extreme_outliers_1pct"),
                                                    tally((v < F.col("p05")) | (v > F.col("p95"))).alias("outliers_5pct"), pct(tally(e), n).alias("outlier_percentage_1pct"))


def outliers_multivariate(df: DataFrame, cols, limit=3.0) -> DataFrame:
    r = with_stats(df.dropna(subset=list(cols)), [x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"__m{i}"), F.stddev(c).alias(f"__s{i}"))])
    norm = F.sqrt(sum((F.pow(standardised(c, f"__m{i}", f"__s{i}"), 2) for i, c in enumerate(cols)), F.lit(0.0)))
    r = r.withColumn("euclidean_distance", norm).drop(*[f"__{k}{i}" for k in "ms" for i in range(len(cols))]).filter(F.col("euclidean_distance") > limit)
    return r.withColumn("outlier_classification", band_gt("euclidean_distance", [(5, "Extreme Multivariate Outlier")], "Moderate Multivariate Outlier"))


def outlier_impact(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    r = df.select(column).filter(v.isNotNull()).crossJoin(F.broadcast(iqr_bounds(df, column).select("lower_bound", "upper_bound")))
    inside = F.when((v >= F.col("lower_bound")) & (v <= F.col("upper_bound")), v)
    out = r.agg(F.count(v).alias("total_records"), F.count(inside).alias("n_without_outliers"), F.avg(v).alias("mean_with_outliers"),
                F.avg(inside).alias("mean_without_outliers"), F.stddev(v).alias("std_with_outliers"), F.stddev(inside).alias("std_without_outliers"))
    change = lambda a, b: (F.col(a) - F.col(b)) * 100.0 / F.nullif(F.col(b), F.lit(0.0))
    return out.withColumns({"outlier_count": F.col("total_records") - F.col("n_without_outliers"),
                            "mean_pct_change": change("mean_with_outliers", "mean_without_outliers"),
                            "std_pct_change": change("std_with_outliers", "std_without_outliers")})


def outlier_profile(df: DataFrame, column: str) -> DataFrame:
    """One row per record outside the IQR or the 3 sd limits, IQR first."""
    v = F.col(column)
    b = iqr_bounds(df, column).select("lower_bound", "upper_bound").crossJoin(df.agg(F.avg(column).alias("__m"), F.stddev(column).alias("__s")))
    r = df.filter(v.isNotNull()).crossJoin(F.broadcast(b))
    kind = F.when(v < F.col("lower_bound"), "Lower Outlier (IQR)").when(v > F.col("upper_bound"), "Upper Outlier (IQR)") \
            .when(v < F.col("__m") - 3 * F.col("__s"), "Lower Outlier (Z-score)").when(v > F.col("__m") + 3 * F.col("__s"), "Upper Outlier (Z-score)")
    return r.withColumn("outlier_type", kind).filter(F.col("outlier_type").isNotNull()).drop("__m", "__s")


def outlier_severity(df: DataFrame, column: str) -> DataFrame:
    o = outlier_profile(df, column).agg(F.count(F.lit(1)).alias("total_outliers"), F.countDistinct("outlier_type").alias("outlier_types_detected"),
                                        F.min(column).alias("min_outlier_value"), F.max(column).alias("max_outlier_value"))
    n = df.agg(F.count(column).alias("total_records"))
    out = o.crossJoin(n).withColumn("outlier_percentage", pct("total_outliers", "total_records"))
    return out.withColumn("outlier_severity", band("outlier_percentage", [(5, "LOW - Few outliers detected"), (10, "MODERATE - Some outliers present")], "HIGH - Many outliers detected"))

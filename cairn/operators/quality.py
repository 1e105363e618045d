"""Data quality: scores per column, table roll-ups, gates and issue lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_ge, band_le, pct, rnd, tally
from cairn.operators import profiling as pr
from cairn.operators.profiling import as_rows, summarise

# Score and label bands of the quality report.
COMPLETENESS = [(0, 100), (5, 95), (10, 85), (20, 70), (50, 50)]
UNIQUENESS = [(95, 100), (80, 90), (50, 70), (20, 50)]
WEIGHTS = {"completeness_score": 0.30, "uniqueness_score": 0.25, "validity_score": 0.25, "consistency_score": 0.20}
GRADES = [(90, "EXCELLENT"), (70, "GOOD"), (50, "FAIR")]


def completeness(df: DataFrame, cols=None) -> DataFrame:
    cols, n = cols or df.columns, F.count(F.lit(1))
    out = summarise(df, cols, {"total_count": lambda c: n, "non_null_count": F.count, "null_percentage": lambda c: pct(n - F.count(c), n)})
    p = F.col("null_percentage")
    return out.withColumns({"completeness_score": band_le(p, COMPLETENESS, 25),
                            "completeness_rating": band_le(p, [(0, "EXCELLENT - Complete"), (5, "GOOD - Highly Complete"), (20, "FAIR - Moderately Complete")],
                                                           "POOR - Significant Missing Data")})


def uniqueness(df: DataFrame, cols=None, exact=True) -> DataFrame:
    cols = cols or df.columns
    d = F.countDistinct if exact else F.approx_count_distinct
    out = summarise(df, cols, {"total_records": F.count, "distinct_values": d})
    out = out.withColumn("uniqueness_ratio", pct("distinct_values", "total_records"))
    u = F.col("uniqueness_ratio")
    return out.withColumns({"duplicate_values": F.col("total_records") - F.col("distinct_values"), "uniqueness_score": band_ge(u, UNIQUENESS, 30),
                            "uniqueness_rating": band_ge(u, [(95, "EXCELLENT - Highly Unique"), (50, "GOOD - Moderate Uniqueness")], "POOR - Low Uniqueness")})


def validity_range(df: DataFrame, ranges: dict) -> DataFrame:
    """ranges: column -> (min, max)."""
    bad = lambda c: (F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1])
    out = summarise(df, list(ranges), {"total_values": lambda c: F.count(F.lit(1)), "non_null_values": F.count,
                                       "out_of_range_count": lambda c: tally(bad(c))})
    out = out.withColumn("invalid_percentage", pct("out_of_range_count", "non_null_values"))
    none, p = F.col("out_of_range_count") == 0, F.col("invalid_percentage")
    return out.withColumns({"validity_score": F.when(none, 100).when(p < 5, 90).otherwise(60),
                            "validity_rating": F.when(none, "EXCELLENT - All Valid").when(p < 10, "GOOD - Mostly Valid").otherwise("POOR - Many Invalid Values")})


def format_consistency(df: DataFrame, cols) -> DataFrame:
    n = lambda c: F.length(c)
    out = summarise(df, cols, {
        "total_values": F.count, "distinct_length_count": lambda c: F.countDistinct(n(c)), "min_length": lambda c: F.min(n(c)), "max_length": lambda c: F.max(n(c)),
        "length_std_dev": lambda c: F.stddev(n(c)), "avg_length": lambda c: F.avg(n(c)), "whitespace_issue_count": lambda c: tally(F.trim(c) != F.col(c)),
        "mixed_case_count": lambda c: tally((F.col(c) != F.upper(c)) & (F.col(c) != F.lower(c)))})
    cv = F.col("length_std_dev") / F.nullif(F.col("avg_length"), F.lit(0.0))
    return out.withColumns({"format_consistency": band(cv, [(0.2, "HIGH - Consistent Format"), (0.5, "MODERATE - Some Variation")], "LOW - Inconsistent Format"),
                            "consistency_score": band(cv, [(0.2, 100), (0.5, 75)], 50)}).drop("avg_length")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    out = g.agg(tally(F.col("k") > 1).alias("duplicate_key_count"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("total_duplicate_rows"),
                F.sum("k").alias("total_rows"))
    p = pct("total_duplicate_rows", "total_rows")
    return out.withColumns({"duplicate_percentage": p, "uniqueness_score": F.when(F.col("duplicate_key_count") == 0, 100).when(p < 1, 95).when(p < 5, 80).otherwise(50)})


def referential_integrity(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without parent. Keys are counted first, so a key that
    fills a third of the child table crosses the join as one row."""
    f = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    p = parent.select(F.col(pk).alias("k")).distinct().withColumn("hit", F.lit(1))
    j = f.join(p, "k", "left")
    out = j.agg(F.sum("n").alias("total_fk_values"), F.count(F.lit(1)).alias("distinct_fk_values"),
                F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("orphaned_records"))
    o = pct("orphaned_records", "total_fk_values")
    return out.withColumns({"orphan_percentage": o, "integrity_score": F.when(F.col("orphaned_records") == 0, 100).when(o < 1, 90).otherwise(60)})


def temporal_validity(df: DataFrame, column: str, today: str) -> DataFrame:
    d, now, old = F.col(column), F.lit(today).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")
    bad = (d > now) | (d < old)
    out = df.agg(F.count(F.lit(1)).alias("total_values"), F.date_diff(F.max(d), F.min(d)).alias("date_range_days"), tally(d > now).alias("future_date_count"),
                 tally(d < old).alias("ancient_date_count"), (F.count(F.lit(1)) - F.count(d)).alias("null_count"), tally(bad).alias("__b"), F.count(d).alias("__n"))
    p = pct("__b", "__n")
    return out.withColumn("temporal_validity_score", F.when(F.col("__b") == 0, 100).when(p < 5, 85).otherwise(60)).drop("__b", "__n")


def quality_scorecard(df: DataFrame, cols, ranges: dict | None = None) -> DataFrame:
    """Four measured scores per column, their weighted sum and grade. Columns
    without a range count as valid, non-text columns as consistent."""
    kinds, ranges = dict(df.dtypes), ranges or {}
    out = completeness(df, cols).select("column_name", "completeness_score").join(uniqueness(df, cols).select("column_name", "uniqueness_score"), "column_name")
    texts = [c for c in cols if kinds[c] == "string"]
    for part, name, default in ((validity_range(df, ranges) if ranges else None, "validity_score", 100),
                                (format_consistency(df, texts) if texts else None, "consistency_score", 100)):
        out = out.withColumn(name, F.lit(default)) if part is None else \
            out.join(part.select("column_name", name), "column_name", "left").fillna(default, [name])
    total = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()])
    return out.withColumn("overall_quality_score", F.round(total, 4)).withColumn("quality_grade", band_ge("overall_quality_score", GRADES, "POOR"))


def table_quality(card: DataFrame) -> DataFrame:
    q = F.col("overall_quality_score")
    out = card.agg(
        F.count(F.lit(1)).alias("total_columns_assessed"), rnd(F.avg("completeness_score"), 4).alias("avg_completeness"), rnd(F.avg("uniqueness_score"), 4).alias("avg_uniqueness"),
        rnd(F.avg("validity_score"), 4).alias("avg_validity"), rnd(F.avg("consistency_score"), 4).alias("avg_consistency"), rnd(F.avg(q), 4).alias("overall_table_quality_score"),
        rnd(F.min(q), 4).alias("worst_column_score"), rnd(F.max(q), 4).alias("best_column_score"), tally(q >= 90).alias("excellent_columns"),
        tally((q >= 70) & (q < 90)).alias("good_columns"), tally((q >= 50) & (q < 70)).alias("fair_columns"), tally(q < 50).alias("poor_columns"))
    return out.withColumn("table_quality_assessment", band_ge("overall_table_quality_score", [
        (90, "EXCELLENT - High Quality Data"), (70, "GOOD - Acceptable Quality"), (50, "FAIR - Needs Improvement")], "POOR - Significant Issues"))


def profile_report(df: DataFrame, cols, numeric, ranges=None) -> DataFrame:
    """Sections of the profile as (section_order, section, metric, value)."""
    card = quality_scorecard(df, cols, ranges)
    pairs = pr.correlation_pairs(df, numeric)
    out = None
    for i, c in enumerate(numeric):
        o = pr.outlier_profile(df, c).agg(F.count(F.lit(1)).cast("double").alias("value"))
        part = o.select(F.lit(4).alias("section_order"), F.lit("Outlier Detection").alias("section"), F.lit(c).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    sec = lambda d, k, s, m: d.select(F.lit(k).alias("section_order"), F.lit(s).alias("section"), F.lit(m).alias("metric"), "value")
    out = out.unionByName(sec(card.agg(rnd(F.avg("overall_quality_score"), 4).alias("value")), 1, "Executive Summary", "overall_quality_score"))
    out = out.unionByName(sec(df.agg(F.count(F.lit(1)).cast("double").alias("value")), 1, "Executive Summary", "total_rows"))
    out = out.unionByName(sec(card.agg(tally(F.col("overall_quality_score") < 80).cast("double").alias("value")), 2, "Data Quality Issues", "columns_with_issues"))
    return out.unionByName(sec(pairs.agg(tally(F.abs("correlation") > 0.7).cast("double").alias("value")), 3, "Correlation Findings", "highly_correlated_pairs"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    from cairn.plans.ordered import share
    c = share(df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count")), "class_count", "class_percentage")
    return c.withColumn("balance_status", band("class_percentage", [(5, "WARNING - Severely underrepresented"), (10, "CAUTION - Underrepresented")], "OK"))


def imbalance_ratio(df: DataFrame, label: str, bands=((3, "PASS - Balanced"), (10, "WARNING - Moderate imbalance"))) -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = c.agg(F.max("n").alias("majority"), F.min("n").alias("minority"), F.count(F.lit(1)).alias("classes"))
    return out.withColumn("ratio", F.col("majority") / F.col("minority")).withColumn("imbalance_status", band("ratio", list(bands), "FAIL - Severe imbalance"))


def sample_adequacy(df: DataFrame, features: int) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("sample_size")).withColumn("feature_count", F.lit(features))
    out = out.withColumn("samples_per_feature", F.col("sample_size") / F.col("feature_count"))
    return out.withColumn("adequacy", band_ge("samples_per_feature", [(20, "PASS - Adequate samples"), (10, "WARNING - Borderline sample size")], "FAIL - Too few samples"))


def count_target_check(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target)
    out = df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.variance(y).alias("variance"), tally(y < 0).alias("negative_values"), tally(y != F.floor(y)).alias("non_integer_values"))
    r = F.col("variance") / F.nullif(F.col("mean"), F.lit(0.0))
    return out.withColumn("dispersion_ratio", r).withColumn("count_status", F.when((F.col("negative_values") > 0) | (F.col("non_integer_values") > 0), "FAIL - Not a count")
                          .when(r > 1.5, "WARNING - Overdispersed").otherwise("PASS - Suitable for Poisson"))


def overall_gate(checks: dict, df: DataFrame) -> DataFrame:
    """checks: name -> aggregate condition. PASS when all hold."""
    one = df.agg(*[c.alias(n) for n, c in checks.items()])
    failed = sum((F.when(F.col(n), 0).otherwise(1) for n in checks), F.lit(0))
    return one.withColumn("failed_checks", failed).withColumn("overall_status", F.when(F.col("failed_checks") == 0, "PASS").otherwise("REVIEW"))


def rule_violations(df: DataFrame, rules: dict) -> DataFrame:
    """rules: name -> condition that must hold; a null condition is no violation."""
    n = F.count(F.lit(1))
    names = list(rules)
    one = df.agg(*[x for i, r in enumerate(names) for x in (tally(~rules[r]).alias(f"{i}__violations"), n.alias(f"{i}__rows"))])
    out = as_rows(one, names, ["violations", "rows"], "rule")
    return out.withColumn("violation_pct", pct("violations", "rows"))


def separation_check(df: DataFrame, features, target: str) -> DataFrame:
    """Do the ranges of a feature overlap between the two classes?"""
    y = F.col(target)
    at = lambda fn, k: lambda c: fn(F.when(y == k, F.col(c))).cast("double")
    out = summarise(df, features, {"min_0": at(F.min, 0), "max_0": at(F.max, 0), "min_1": at(F.min, 1), "max_1": at(F.max, 1)})
    apart = (F.col("max_0") < F.col("min_1")) | (F.col("max_1") < F.col("min_0"))
    return out.withColumn("separation_status", F.when(apart, "WARNING - Complete separation").otherwise("PASS - Overlapping ranges"))


# Score column, limit, issue, priority.
ISSUES = [("completeness_score", 80, "Missing Data", "HIGH"), ("uniqueness_score", 70, "Low Uniqueness", "MEDIUM"),
          ("validity_score", 80, "Invalid Values", "HIGH"), ("consistency_score", 70, "Inconsistent Format", "MEDIUM")]


def quality_issues(card: DataFrame, n=20) -> DataFrame:
    """The n most severe issues; severity is the missing score."""
    cells = [F.when(F.col(c) < lim, F.struct(F.lit(t).alias("issue_type"), (100 - F.col(c)).cast("double").alias("severity"), F.lit(p).alias("priority"))) for c, lim, t, p in ISSUES]
    rows = card.select("column_name", F.explode(F.array_compact(F.array(*cells))).alias("i")).select("column_name", "i.*")
    top = rows.orderBy(F.desc("severity"), "column_name", "issue_type").limit(n)
    return top.withColumn("issue_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("severity"), "column_name", "issue_type")))  # n rows


def column_priority(card: DataFrame, limit=85) -> DataFrame:
    return card.filter(F.col("overall_quality_score") < limit).select("column_name", "overall_quality_score", band("overall_quality_score", [
        (50, "CRITICAL - Immediate Action Required"), (70, "HIGH - Should Address Soon"), (85, "MEDIUM - Monitor")], "LOW - Acceptable").alias("priority"))


def recommendations(card: DataFrame, categorical: DataFrame, moments: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per advice that applies to at least one column."""
    rows = [(card.filter("completeness_score < 80"), "Data Completeness", "HIGH"), (categorical.filter("distinct_count > 50"), "Categorical Variables", "MEDIUM"),
            (moments.filter(F.abs("skewness") > 1), "Data Transformation", "MEDIUM"), (pairs.filter(F.abs("correlation") > 0.9), "Feature Selection", "HIGH")]
    out = None
    for d, cat, pri in rows:
        p = d.agg(F.lit(cat).alias("recommendation_category"), F.lit(pri).alias("priority"), F.count(F.lit(1)).alias("affected_columns")).filter("affected_columns > 0")
        out = p if out is None else out.unionByName(p)
    return out


def metric_thresholds(df: DataFrame, metrics) -> DataFrame:
    """metrics: (name, aggregate, threshold, 'min' or 'max')."""
    one = df.agg(*[a.cast("double").alias(f"m{i}") for i, (_, a, _, _) in enumerate(metrics)])
    def cell(i, name, limit, side):
        v = F.col(f"m{i}")
        ok = v >= limit if side == "min" else v <= limit
        return F.struct(F.lit(name).alias("metric"), v.alias("value"), F.lit(float(limit)).alias("threshold"),
                        F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.when(ok, "None").otherwise("Investigate").alias("alert"))
    return one.select(F.explode(F.array(*[cell(i, m[0], m[2], m[3]) for i, m in enumerate(metrics)])).alias("r")).select("r.*")

"""Reports on a log table of runs: (function_name, start_time, duration,
status, error_message, n_rows, application). Times relative to "now" take it
as a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.expr import band, band_gt, flag, pct, rnd, tally
from cairn.operators.relational import rolling
from cairn.plans.ordered import sequence, share, sliding, with_stats



def n_rows():
    return F.count(F.lit(1))


def failed():
    return F.col("status") != "completed"


SPEED = [(10, "Fast"), (60, "Moderate"), (300, "Slow")]  # fixed values, seconds


def run_log_summary(log: DataFrame) -> DataFrame:
    d = F.col("duration")
    out = log.groupBy("function_name").agg(n_rows().alias("runs"), tally(failed()).alias("failures"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"),
                                           (F.sum(d) * 1000.0 / F.nullif(F.sum("n_rows"), F.lit(0))).alias("seconds_per_1000_rows"))
    return out.withColumns({"failure_pct": pct("failures", "runs"), "speed_band": band("avg_duration", SPEED, "Very slow")})


def run_alerts(log: DataFrame, now: str, factor=2.0) -> DataFrame:
    """Longest run of the last day against twice the 30-day average, and
    failures of the last seven days."""
    age = F.date_diff(F.lit(now).cast("timestamp"), F.col("start_time"))
    d = F.col("duration")
    out = log.groupBy("function_name").agg(F.max(F.when(age.between(0, 1), d)).alias("recent_max"), F.avg(F.when(age.between(0, 30), d)).alias("avg_30d"),
                                           tally(age.between(0, 7) & failed()).alias("failures_7d"))
    return out.withColumns({"duration_alert": F.when(F.col("recent_max") > factor * F.col("avg_30d"), "REGRESSION").otherwise("OK"),
                            "failure_alert": F.when(F.col("failures_7d") > 0, "FAILURES").otherwise("OK")})


def skew_report(df: DataFrame, keys, partitions=8) -> DataFrame:
    """Rows per hash partition of the keys, largest over mean."""
    c = df.groupBy(F.pmod(F.hash(*keys), F.lit(partitions)).alias("p")).agg(n_rows().alias("rows"))
    out = c.agg(n_rows().alias("partitions_used"), F.max("rows").alias("max_rows"), F.min("rows").alias("min_rows"), (F.sum("rows") / partitions).alias("avg_rows"))
    return out.withColumn("skew", F.col("max_rows") / F.col("avg_rows")).withColumn("skew_band", band("skew", [(1.1, "Excellent"), (1.5, "Good")], "Skewed"))


def slow_queries(log: DataFrame, n=10, id_col="execution_id") -> DataFrame:
    """The n longest runs with their share of all run time."""
    r = with_stats(log, [F.sum("duration").alias("__t")])
    return r.orderBy(F.desc("duration"), id_col).limit(n).select(id_col, "function_name", "duration", pct("duration", "__t").alias("share_pct"))


def workload_summary(log: DataFrame, baseline: DataFrame, by="application") -> DataFrame:
    """Count, share and mean duration per workload against a baseline log."""
    a = share(log.groupBy(by).agg(n_rows().alias("queries"), F.avg("duration").alias("avg_duration")), "queries", "share_pct")
    b = baseline.groupBy(by).agg(F.avg("duration").alias("baseline_duration"))
    j = a.join(b, by, "left")
    return j.withColumn("change_pct", (F.col("avg_duration") / F.col("baseline_duration") - 1.0) * 100.0)


def delay_stats(log: DataFrame, by="application", wait="wait_seconds") -> DataFrame:
    w = F.col(wait)
    return log.groupBy(by).agg(n_rows().alias("queries"), tally(w > 0).alias("delayed"), F.sum(w).alias("total_wait"), F.avg(F.when(w > 0, w)).alias("avg_wait"), F.max(w).alias("max_wait")) \
              .withColumn("delayed_pct", pct("delayed", "queries"))


def duration_trend(log: DataFrame, unit="week") -> DataFrame:
    """Mean duration per period against the period before. One row per
    function and period remains before the window."""
    g = log.groupBy("function_name", F.date_trunc(unit, "start_time").alias("period")).agg(n_rows().alias("runs"), F.avg("duration").alias("avg_duration"))
    w = Window.partitionBy("function_name").orderBy("period")
    prev = F.lag("avg_duration").over(w)
    return g.withColumn("previous_avg", prev).withColumn("change_pct", (F.col("avg_duration") - F.col("previous_avg")) * 100.0 / F.col("previous_avg")) \
            .withColumn("trend", F.when(F.col("change_pct") > 10, "Slower").when(F.col("change_pct") < -10, "Faster").otherwise("Stable"))


def error_breakdown(log: DataFrame) -> DataFrame:
    e = log.filter(failed())
    return share(e.groupBy("error_message").agg(n_rows().alias("occurrences"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"),
                                                F.countDistinct("function_name").alias("functions")), "occurrences", "percentage")


def rejection_rate(log: DataFrame) -> DataFrame:
    return log.agg(n_rows().alias("runs"), tally(failed()).alias("rejected"), pct(tally(failed()), n_rows()).alias("rejection_pct"))


def daily_trend(log: DataFrame) -> DataFrame:
    """Runs and mean duration per function and day with a 7-day mean."""
    g = log.groupBy("function_name", F.to_date("start_time").alias("day")).agg(n_rows().alias("runs"), F.avg("duration").alias("avg_duration"))
    w = Window.partitionBy("function_name").orderBy("day").rowsBetween(-6, 0)  # one row per day
    return g.withColumn("moving_avg_7d", F.avg("avg_duration").over(w))


def degradation(log: DataFrame, last=10, factor=1.5, id_col="execution_id") -> DataFrame:
    """Mean of each function's last runs against 1.5 times its overall mean."""
    from cairn.operators.vectors import top_k
    recent = top_k(log.select("function_name", "start_time", id_col, "duration"), ["function_name"], last, [F.desc("start_time"), F.desc(id_col)])
    a = recent.groupBy("function_name").agg(F.avg("duration").alias("recent_avg"))
    b = log.groupBy("function_name").agg(F.avg("duration").alias("overall_avg"))
    return a.join(b, "function_name").withColumn("status", F.when(F.col("recent_avg") > factor * F.col("overall_avg"), "DEGRADED").otherwise("OK"))


def resource_use(log: DataFrame) -> DataFrame:
    return log.groupBy("function_name").agg(F.avg("cpu_seconds").alias("avg_cpu"), F.avg("io_mb").alias("avg_io_mb"), F.max("io_mb").alias("max_io_mb"),
                                            (F.sum("cpu_seconds") / F.nullif(F.sum("duration"), F.lit(0.0))).alias("cpu_elapsed_ratio")) \
              .withColumn("io_alert", F.when(F.col("max_io_mb") > 5000, "HIGH").otherwise("OK"))

"""Queries of the run-log operators; the events table serves as the log."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.functions.expr import rnd
from cairn.operators import runlog as rl

NOW = "2024-01-31 00:00:00"


def log(t):
    i, v = F.col("event_id"), F.col("value")
    return t.events.select(
        i.alias("execution_id"), F.col("event_type").alias("function_name"), F.col("ts").alias("start_time"), v.alias("duration"),
        F.when(i % 9 == 0, "error").otherwise("completed").alias("status"), F.concat(F.lit("code "), (i % 4).cast("string")).alias("error_message"), (i % 1000 + 1).alias("n_rows"),
        F.concat(F.lit("app "), (F.col("user_id") % 5).cast("string")).alias("application"), F.when(i % 3 == 0, v / 10.0).otherwise(0.0).alias("wait_seconds"),
        (v * 0.6).alias("cpu_seconds"), (v * 12.5).alias("io_mb"))


L = """WITH log AS (SELECT event_id AS execution_id, event_type AS function_name, ts AS start_time, value AS duration, CASE WHEN event_id%9=0 THEN 'error' ELSE 'completed' END AS status, 'code ' || (event_id%4) AS error_message, event_id%1000+1 AS n_rows,
 'app ' || (user_id%5) AS application, CASE WHEN event_id%3=0 THEN value/10.0 ELSE 0 END AS wait_seconds, value*0.6 AS cpu_seconds, value*12.5 AS io_mb FROM events)"""


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("log01_run_log_summary", L + " SELECT function_name, count(*) AS runs, count(*) FILTER (status<>'completed') AS failures, round(avg(duration),7) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, round(sum(duration)*1000/sum(n_rows),7) AS seconds_per_1000_rows, round(100.0*count(*) FILTER (status<>'completed')/count(*),4) AS failure_pct, CASE WHEN avg(duration)<10 THEN 'Fast' WHEN avg(duration)<60 THEN 'Moderate' WHEN avg(duration)<300 THEN 'Slow' ELSE 'Very slow' END AS speed_band FROM log GROUP BY 1")
def _(t):
    return r(r(rl.run_log_summary(log(t)), 7, "avg_duration", "seconds_per_1000_rows"), 4, "failure_pct")


@query("log02_run_alerts", L + ", a AS (SELECT *, (DATE '2024-01-31' - start_time::DATE) AS age FROM log), b AS (SELECT function_name, max(duration) FILTER (age BETWEEN 0 AND 1) AS recent_max, avg(duration) FILTER (age BETWEEN 0 AND 30) AS m, count(*) FILTER (age BETWEEN 0 AND 7 AND status<>'completed') AS failures_7d FROM a GROUP BY 1) SELECT function_name, recent_max, round(m,7) AS avg_30d, failures_7d, CASE WHEN recent_max>2*m THEN 'REGRESSION' ELSE 'OK' END AS duration_alert, CASE WHEN failures_7d>0 THEN 'FAILURES' ELSE 'OK' END AS failure_alert FROM b")
def _(t):
    return r(rl.run_alerts(log(t), NOW), 7, "avg_30d")


@query("log03_skew_report")
def _(t):
    return rl.skew_report(t.lineitem, ["l_orderkey"])


@query("log04_slow_queries", L + " SELECT execution_id, function_name, duration, round(100.0*duration/(SELECT sum(duration) FROM log),7) AS share_pct FROM log ORDER BY duration DESC, execution_id LIMIT 10")
def _(t):
    return r(rl.slow_queries(log(t)), 7, "share_pct")


@query("log05_workload_summary", L + ", a AS (SELECT application, count(*) AS queries, avg(duration) AS d FROM log WHERE start_time >= TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT application, avg(duration) AS d FROM log WHERE start_time < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT a.application, queries, round(a.d,7) AS avg_duration, round(100.0*queries/sum(queries) OVER (),4) AS share_pct, round(b.d,7) AS baseline_duration, round((a.d/b.d-1)*100,7) AS change_pct FROM a LEFT JOIN b ON a.application=b.application")
def _(t):
    cut = F.lit("2024-01-15").cast("timestamp")
    w = rl.workload_summary(log(t).filter(F.col("start_time") >= cut), log(t).filter(F.col("start_time") < cut))
    return r(w, 7, "avg_duration", "baseline_duration", "change_pct")


@query("log06_delay_stats", L + " SELECT application, count(*) AS queries, count(*) FILTER (wait_seconds>0) AS delayed, round(sum(wait_seconds),5) AS total_wait, round(avg(wait_seconds) FILTER (wait_seconds>0),7) AS avg_wait, round(max(wait_seconds),6) AS max_wait, round(100.0*count(*) FILTER (wait_seconds>0)/count(*),4) AS delayed_pct FROM log GROUP BY 1")
def _(t):
    return r(r(r(r(rl.delay_stats(log(t)), 5, "total_wait"), 7, "avg_wait"), 6, "max_wait"), 4, "delayed_pct")


@query("log07_duration_trend", L + ", g AS (SELECT function_name, date_trunc('week', start_time) AS p, count(*) AS runs, avg(duration) AS d FROM log GROUP BY 1,2), q AS (SELECT *, lag(d) OVER (PARTITION BY function_name ORDER BY p) AS pd FROM g) SELECT function_name, strftime(p,'%Y-%m-%d') AS period, runs, round(d,7) AS avg_duration, round(pd,7) AS previous_avg, round((d-pd)*100/pd,7) AS change_pct, CASE WHEN (d-pd)*100/pd>10 THEN 'Slower' WHEN (d-pd)*100/pd<-10 THEN 'Faster' ELSE 'Stable' END AS trend FROM q")
def _(t):
    d = rl.duration_trend(log(t)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    return r(d, 7, "avg_duration", "previous_avg", "change_pct")


@query("log08_error_breakdown", L + " SELECT error_message, count(*) AS occurrences, epoch_us(min(start_time)) AS first_us, epoch_us(max(start_time)) AS last_us, count(DISTINCT function_name) AS functions, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM log WHERE status<>'completed' GROUP BY 1")
def _(t):
    e = rl.error_breakdown(log(t))
    return e.select("error_message", "occurrences", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "functions", "percentage")


@query("log08_rejection_rate", L + " SELECT count(*) AS runs, count(*) FILTER (status<>'completed') AS rejected, round(100.0*count(*) FILTER (status<>'completed')/count(*),6) AS rejection_pct FROM log")
def _(t):
    return r(rl.rejection_rate(log(t)), 6, "rejection_pct")


@query("log09_daily_trend", L + ", g AS (SELECT function_name, start_time::DATE AS d, count(*) AS runs, avg(duration) AS a FROM log GROUP BY 1,2) SELECT function_name, strftime(d,'%Y-%m-%d') AS day, runs, round(a,8) AS avg_duration, round(avg(a) OVER (PARTITION BY function_name ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),8) AS moving_avg_7d FROM g")
def _(t):
    return r(rl.daily_trend(log(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd")), 8, "avg_duration", "moving_avg_7d")


@query("log09_degradation", L + ", k AS (SELECT *, row_number() OVER (PARTITION BY function_name ORDER BY start_time DESC, execution_id DESC) AS k FROM log), a AS (SELECT function_name, avg(duration) FILTER (k<=10) AS r, avg(duration) AS o FROM k GROUP BY 1) SELECT function_name, round(r,7) AS recent_avg, round(o,7) AS overall_avg, CASE WHEN r>1.5*o THEN 'DEGRADED' ELSE 'OK' END AS status FROM a")
def _(t):
    return r(rl.degradation(log(t)), 7, "recent_avg", "overall_avg")


@query("log10_resource_use", L + " SELECT function_name, round(avg(cpu_seconds),7) AS avg_cpu, round(avg(io_mb),6) AS avg_io_mb, round(max(io_mb),4) AS max_io_mb, round(sum(cpu_seconds)/sum(duration),7) AS cpu_elapsed_ratio, CASE WHEN max(io_mb)>5000 THEN 'HIGH' ELSE 'OK' END AS io_alert FROM log GROUP BY 1")
def _(t):
    return r(r(r(rl.resource_use(log(t)), 7, "avg_cpu", "cpu_elapsed_ratio"), 6, "avg_io_mb"), 4, "max_io_mb")

"""Event analytics: cleaning, sessions, transitions and session reports.

Users may be of any size: positions, gaps and session numbers come from the
skew-safe helpers of ``cairn.plans.ordered``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.expr import band_le, flag, pct, rnd, tally
from cairn.plans.ordered import block_of, running, sequence, share, sliding
from cairn.plans.quantiles import quantiles

# Bands of the session and gap reports, in seconds.
DURATION_BANDS = [(0, "0 sec (Single Event)"), (60, "0-1 min"), (300, "1-5 min"), (600, "5-10 min"),
                  (1800, "10-30 min"), (3600, "30-60 min")]
GAP_BANDS = [(60, "0-1 min"), (300, "1-5 min"), (600, "5-10 min"), (1800, "10-30 min"),
             (3600, "30-60 min"), (7200, "1-2 hours")]
ENGAGEMENT_BANDS = [(1, "Single Session"), (3, "Low Engagement (2-3)"), (10, "Medium Engagement (4-10)"),
                    (30, "High Engagement (11-30)")]
SESSION_GAP_BANDS = [(3600, "0-1 hour"), (86400, "1-24 hours"), (259200, "1-3 days"),
                     (604800, "3-7 days"), (2592000, "1-4 weeks")]
LENGTH_BANDS = [(2, "1-2 events"), (5, "3-5 events"), (10, "6-10 events"), (20, "11-20 events")]
QUALITY_BANDS = [(80, "Excellent"), (60, "Good"), (40, "Fair")]


def seconds(later, earlier) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def clean_events(df: DataFrame, user="user_id", ts="ts", event_type="event_type", event_id="event_id") -> DataFrame:
    """Complete events, duplicates removed, with a per-user sequence number
    and the seconds since the previous event."""
    rows = df.select(user, ts, event_type, event_id).dropna().dropDuplicates()
    rows = sequence(rows, [user], [ts, event_id], "event_sequence_number")
    return sliding(rows, [user], lambda w: {
        "seconds_since_prev_event": seconds(F.col(ts), F.lag(ts).over(w))}, before=1, seq="event_sequence_number")


def sessionize(df: DataFrame, user="user_id", ts="ts", timeout=1800, tiebreak="event_id",
               click_lag: str | None = None) -> DataFrame:
    """Session number per user: a new session starts at a user's first event
    and wherever the gap to the previous event exceeds ``timeout`` seconds.
    ``position`` is the place within the session; ``click_lag`` names an
    optional column with the gap in seconds."""
    rows = sequence(df.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()), [user], [ts, tiebreak])
    gap = click_lag or "__gap"
    rows = sliding(rows, [user], lambda w: {gap: seconds(F.col(ts), F.lag(ts).over(w))}, before=1)
    opens = F.col(gap).isNull() | (F.col(gap) > timeout)
    rows = running(rows, [user], sums={"session_id": flag(opens)}, lasts={"__start": F.when(opens, F.col("seq"))})
    rows = rows.withColumn("session_id", F.col("session_id").cast("bigint")) \
               .withColumn("position", F.col("seq") - F.col("__start") + 1)
    return rows.drop("__start", "seq", "__gap")


def session_durations(sessions: DataFrame, user="user_id", ts="ts", event_type="event_type") -> DataFrame:
    """One row per session: events, types, start, end, seconds, minutes."""
    out = sessions.groupBy(user, "session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct(event_type).alias("distinct_event_types"),
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    secs = seconds(F.col("session_end"), F.col("session_start"))
    return out.withColumns({"session_duration_seconds": secs, "session_duration_minutes": secs / 60.0})


def shares(df: DataFrame, label: Column, name: str, aggs: dict, count="n") -> DataFrame:
    """Counts per band with the share of the total. The window runs over the
    few bands, not over the data."""
    from pyspark.sql import Window
    out = df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias(count),
                                            *[a.alias(n) for n, a in aggs.items()])
    return out.withColumn("percentage", rnd(pct(F.col(count), F.sum(count).over(Window.partitionBy())), 4))


def duration_bands(durations: DataFrame) -> DataFrame:
    s = F.col("session_duration_seconds")
    return shares(durations, band_le(s, DURATION_BANDS, "> 1 hour"), "duration_range",
                  {"avg_events_in_range": rnd(F.avg("event_count"), 4)}, "session_count")


def gap_distribution(clean: DataFrame) -> DataFrame:
    g = clean.filter(F.col("seconds_since_prev_event").isNotNull())
    return shares(g, band_le("seconds_since_prev_event", GAP_BANDS, "> 2 hours"), "time_gap_range",
                  {"avg_gap_seconds": rnd(F.avg("seconds_since_prev_event"), 3)}, "gap_count")


def gap_percentiles(clean: DataFrame) -> DataFrame:
    c = "seconds_since_prev_event"
    g = clean.filter(F.col(c).isNotNull()).select(c)
    q = quantiles(g, {"q1_seconds": (c, .25), "median_seconds": (c, .5), "q3_seconds": (c, .75),
                      "p90_seconds": (c, .9), "p95_seconds": (c, .95)})
    m = g.agg(rnd(F.avg(c), 3).alias("avg_seconds"), rnd(F.stddev(c), 3).alias("stddev_seconds"),
              F.min(c).alias("min_seconds"), F.max(c).alias("max_seconds"))
    return m.crossJoin(q).select(*m.columns, *[rnd(n, 3).alias(n) for n in q.columns])


def user_session_stats(durations: DataFrame, user="user_id") -> DataFrame:
    return durations.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("event_count").alias("total_events"),
        F.avg("event_count").alias("avg_events_per_session"),
        F.avg("session_duration_seconds").alias("avg_session_duration_seconds"),
        F.min("session_start").alias("first_session_start"), F.max("session_end").alias("last_session_end"))


def engagement_segments(users: DataFrame) -> DataFrame:
    return shares(users, band_le("total_sessions", ENGAGEMENT_BANDS, "Power Users (>30)"), "engagement_segment",
                  {"avg_sessions": rnd(F.avg("total_sessions"), 4),
                   "avg_total_events": rnd(F.avg("total_events"), 4)}, "user_count")


def repeat_users(users: DataFrame) -> DataFrame:
    n = F.col("total_sessions")
    return users.agg(tally(n == 1).alias("one_time_users"), tally(n.between(2, 5)).alias("moderate_users"),
                     tally(n > 5).alias("engaged_users"),
                     rnd(pct(tally(n > 1), F.count(F.lit(1))), 4).alias("repeat_user_pct"))


def inter_session_gaps(durations: DataFrame, user="user_id") -> DataFrame:
    """Bands of the time from one session's end to the next one's start."""
    rows = sliding(durations.withColumnRenamed("session_id", "seq"), [user], lambda w: {
        "gap_seconds": seconds(F.col("session_start"), F.lag("session_end").over(w))}, before=1)
    rows = rows.filter(F.col("gap_seconds").isNotNull())
    return shares(rows, band_le("gap_seconds", SESSION_GAP_BANDS, "> 1 month"), "gap_range",
                  {"avg_gap_hours": rnd(F.avg("gap_seconds") / 3600.0, 4)}, "gap_count")


def session_openers(sessions: DataFrame, top=20, user="user_id", event_type="event_type") -> DataFrame:
    """The most frequent first three events of sessions."""
    at = lambda k: F.max(F.when(F.col("position") == k, F.col(event_type)))
    first = sessions.filter(F.col("position") <= 3).groupBy(user, "session_id").agg(
        at(1).alias("first_event"), at(2).alias("second_event"), at(3).alias("third_event"))
    names = ["first_event", "second_event", "third_event"]
    counts = share(first.groupBy(*names).agg(F.count(F.lit(1)).alias("session_count")), "session_count", "percentage")
    return counts.orderBy(F.desc("session_count"), *names).limit(top)


def session_goals(sessions: DataFrame, goal: str, user="user_id", event_type="event_type") -> DataFrame:
    return sessions.groupBy(user, "session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max(flag(F.col(event_type) == goal)).alias("has_conversion"))


def session_conversion(sessions: DataFrame, goal: str, **cols) -> DataFrame:
    s = session_goals(sessions, goal, **cols)
    return shares(s, F.when(F.col("has_conversion") == 1, "Converted").otherwise("Not Converted"),
                  "conversion_status", {"avg_events_per_session": rnd(F.avg("event_count"), 4)}, "session_count")


def conversion_by_length(sessions: DataFrame, goal: str, **cols) -> DataFrame:
    s = session_goals(sessions, goal, **cols)
    n, hit = F.count(F.lit(1)), F.sum("has_conversion")
    return s.groupBy(band_le("event_count", LENGTH_BANDS, "20+ events").alias("session_length_category")).agg(
        n.alias("session_count"), hit.alias("conversions"), rnd(pct(hit, n), 4).alias("conversion_rate_pct"))


def session_quality_score(durations: DataFrame, long_session=7200) -> DataFrame:
    """0-100: 40 for sessions of several events, 30 for sessions that are not
    overlong, 30 fixed."""
    n = F.count(F.lit(1))
    single = tally(F.col("event_count") == 1) / n
    longer = tally(F.col("session_duration_seconds") > long_session) / n
    out = durations.agg(((1 - single) * 40.0 + (1 - longer) * 30.0 + 30.0).alias("quality_score"))
    q = F.col("quality_score")
    from cairn.functions.expr import band_ge
    return out.select(rnd(q, 4).alias("quality_score"),
                      band_ge(q, QUALITY_BANDS, "Poor - Review Parameters").alias("quality_rating"))


def bounce_rate(durations: DataFrame) -> DataFrame:
    n, b = F.count(F.lit(1)), tally(F.col("event_count") == 1)
    return durations.agg(b.alias("bounced_sessions"), n.alias("total_sessions"),
                         rnd(pct(b, n), 4).alias("bounce_rate_pct"))


def sessions_by_hour(durations: DataFrame) -> DataFrame:
    return durations.groupBy(F.hour("session_start").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("sessions_started"), rnd(F.avg("event_count"), 4).alias("avg_events"),
        rnd(F.avg("session_duration_minutes"), 4).alias("avg_duration_min"))


def longest_sessions(durations: DataFrame, n=20, user="user_id") -> DataFrame:
    return durations.orderBy(F.desc("event_count"), F.desc("session_duration_seconds"), user, "session_id").limit(n)


def event_path(sessions: DataFrame, user="user_id", event_type="event_type", separator=" -> ") -> DataFrame:
    """Event names of each session in order, as one string. Pieces are built
    per block of positions and then joined, so no task sorts a whole session;
    the string itself is bounded by Spark's cell size."""
    keys = [user, "session_id"]
    pieces = sessions.withColumn("__b", block_of(sessions, "position")).groupBy(*keys, "__b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(event_type).alias("e")))),
                                 lambda s: s["e"]), separator).alias("p"))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("__b", "p"))), lambda s: s["p"]), separator).alias("event_sequence"))


def transitions(df: DataFrame, keys, event_type="event_type", seq="seq") -> DataFrame:
    """Counts of (current, next) with the share of each current state."""
    rows = sliding(df, keys, lambda w: {"next_state": F.lead(event_type).over(w)}, after=1, seq=seq)
    counts = rows.filter(F.col("next_state").isNotNull()) \
                 .groupBy(F.col(event_type).alias("current_state"), "next_state") \
                 .agg(F.count(F.lit(1)).alias("transition_count"))
    return share(counts, "transition_count", "transition_pct", by=["current_state"])


def timeout_compare(df: DataFrame, timeouts=(900, 1800, 3600), user="user_id", ts="ts",
                    tiebreak="event_id") -> DataFrame:
    """Sessions under several timeouts from one pass: the gap is computed once
    and the timeouts are columns. Average duration uses that a session's
    length is the sum of its inner gaps."""
    rows = sequence(df, [user], [ts, tiebreak])
    rows = sliding(rows, [user], lambda w: {"g": seconds(F.col(ts), F.lag(ts).over(w))}, before=1)
    g, aggs = F.col("g"), [F.count(F.lit(1)).alias("events")]
    for t in timeouts:
        aggs += [tally(g.isNull() | (g > t)).alias(f"n{t}"), F.sum(F.when(g <= t, g)).alias(f"d{t}")]
    one = rows.agg(*aggs)
    fields = ", ".join(f"{t}, n{t}, d{t}" for t in timeouts)
    out = one.selectExpr("events", f"stack({len(timeouts)}, {fields}) AS (timeout_seconds, total_sessions, inside)")
    return out.select(
        F.col("timeout_seconds").cast("bigint").alias("timeout_seconds"), "total_sessions",
        rnd(F.col("events") / F.col("total_sessions"), 4).alias("avg_events_per_session"),
        rnd(F.coalesce(F.col("inside"), F.lit(0.0)) / F.col("total_sessions") / 60.0, 4).alias("avg_session_duration_min"))


def timeout_recommendation(compared: DataFrame) -> DataFrame:
    """Shorter timeout if lengthening it merges many sessions, longer one if
    doubling it splits more (rules over 15, 30 and 60 minutes)."""
    at = lambda t: F.max(F.when(F.col("timeout_seconds") == t, F.col("total_sessions")))
    one = compared.agg(at(900).alias("a"), at(1800).alias("b"), at(3600).alias("c"))
    return one.select(F.when(F.col("b") < F.col("a") * 0.7, "15-minute timeout recommended - High user activity")
                      .when(F.col("c") > F.col("b") * 1.3, "60-minute timeout recommended - Longer sessions")
                      .otherwise("30-minute timeout recommended - Standard behavior").alias("recommendation"))


def session_transitions(sessions: DataFrame, n=20, user="user_id", event_type="event_type") -> DataFrame:
    """Most frequent event pairs inside sessions, share of all pairs."""
    rows = sliding(sessions, [user, "session_id"], lambda w: {"b": F.lead(event_type).over(w)}, after=1, seq="position")
    c = rows.filter(F.col("b").isNotNull()).groupBy(F.col(event_type).alias("event_type_1"),
                                                    F.col("b").alias("event_type_2")) \
            .agg(F.count(F.lit(1)).alias("occurrence_count"))
    return share(c, "occurrence_count", "percentage").orderBy(F.desc("occurrence_count"), "event_type_1", "event_type_2").limit(n)


def event_quality(df: DataFrame, user="user_id", ts="ts", event_type="event_type", event_id="event_id",
                  converted: Column | None = None) -> DataFrame:
    """Check rows (check_name, metric, value, status) on an event table:
    completeness, duplicates, arrival order, users, variety, conversions."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (user, ts, event_type)])
    base = df.agg(
        F.count(F.lit(1)).alias("total"), tally(missing).alias("missing"),
        F.countDistinct(user).alias("users"), F.countDistinct(event_type).alias("types"),
        F.countDistinct(F.to_date(ts)).alias("dates"), tally(F.lit(False) if converted is None else converted).alias("conv"))
    dups = df.groupBy(user, ts, event_type).count().filter("count > 1").agg(F.count(F.lit(1)).alias("dups"))
    arrival = sequence(df, [user], [event_id])
    order = sliding(arrival, [user], lambda w: {"p": F.lag(ts).over(w)}, before=1) \
        .agg(tally(F.col("p").isNotNull() & (F.col(ts) < F.col("p"))).alias("ooo"))
    one = base.crossJoin(dups).crossJoin(order)
    d = lambda e: F.col(e).cast("double") if isinstance(e, str) else e
    rows = [("Completeness", "missing_events", d("missing"), F.when(F.col("missing") == 0, "PASS").otherwise("FAIL")),
            ("Duplicates", "duplicate_combinations", d("dups"), F.when(F.col("dups") == 0, "PASS").otherwise("WARNING")),
            ("Ordering", "out_of_order_pct", rnd(pct("ooo", "total"), 4), F.when(F.col("ooo") == 0, "PASS").otherwise("WARNING")),
            ("Coverage", "distinct_dates", d("dates"), F.when(F.col("dates") > 1, "PASS").otherwise("FAIL")),
            ("Users", "events_per_user", rnd(F.col("total") / F.nullif(F.col("users"), F.lit(0)), 4),
             F.when(F.col("users") > 0, "PASS").otherwise("FAIL")),
            ("Variety", "event_types", d("types"), F.when(F.col("types") >= 2, "PASS").otherwise("FAIL")),
            ("Conversion", "conversions_per_100_users", rnd(pct("conv", "users"), 4), F.lit("INFO"))]
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(a).alias("check_name"), F.lit(b).alias("metric"), v.alias("value"), s.alias("status"))
        for a, b, v, s in rows])).alias("r")).select("r.*")

"""Queries of the event operators."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.operators import events as ev, paths as pa

T = 21600


def _cte(timeout=T):
    return f"""WITH g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))/1e6 AS d FROM events),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {timeout} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM g),
sp AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS position FROM s),
dur AS (SELECT user_id, session_id, count(*) AS event_count, count(DISTINCT event_type) AS distinct_event_types,
  min(ts) AS session_start, max(ts) AS session_end, (epoch_us(max(ts))-epoch_us(min(ts)))/1e6 AS secs FROM s GROUP BY 1,2),
usr AS (SELECT user_id, count(*) AS total_sessions, sum(event_count) AS total_events FROM dur GROUP BY 1)
"""


def _case(col, bands, rest):
    return "CASE " + " ".join(f"WHEN {col} <= {lim} THEN '{lab}'" for lim, lab in bands) + f" ELSE '{rest}' END"


def _ses(t, timeout=T):
    return ev.sessionize(t.events, timeout=timeout)


def _dur(t):
    return ev.session_durations(_ses(t))


@query("evt01_sessionize", _cte() + "SELECT event_id, user_id, session_id, position, round(d, 3) AS gap_seconds FROM sp")
def _(t):
    s = ev.sessionize(t.events, timeout=T, click_lag="gap_seconds")
    return s.select("event_id", "user_id", "session_id", "position", F.round("gap_seconds", 3).alias("gap_seconds"))


@query("evt01_sessionize_1800", _cte(1800) + "SELECT count(*) AS events, sum((position = 1)::INT)::BIGINT AS sessions, max(session_id) AS most FROM sp")
def _(t):
    s = ev.sessionize(t.events)
    return s.agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("position") == 1).cast("int")).alias("sessions"),
                 F.max("session_id").alias("most"))


@query("evt02_clean_events", """SELECT user_id, event_id, row_number() OVER w AS event_sequence_number,
 round((epoch_us(ts) - lag(epoch_us(ts)) OVER w)/1e6, 3) AS seconds_since_prev_event
 FROM (SELECT DISTINCT user_id, ts, event_type, event_id FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    return ev.clean_events(t.events).select("user_id", "event_id", "event_sequence_number", F.round(
        "seconds_since_prev_event", 3).alias("seconds_since_prev_event"))


@query("evt03_gap_distribution", _cte() + f"""SELECT {_case('d', ev.GAP_BANDS, '> 2 hours')} AS time_gap_range, count(*) AS gap_count,
 round(avg(d),3) AS avg_gap_seconds, round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percentage FROM g WHERE d IS NOT NULL GROUP BY 1""")
def _(t):
    return ev.gap_distribution(ev.clean_events(t.events))


@query("evt03_gap_percentiles", _cte() + """SELECT round(avg(d),3) AS avg_seconds, round(stddev(d),3) AS stddev_seconds, min(d) AS min_seconds, max(d) AS max_seconds,
 round(quantile_cont(d,.25),3) AS q1_seconds, round(quantile_cont(d,.5),3) AS median_seconds, round(quantile_cont(d,.75),3) AS q3_seconds,
 round(quantile_cont(d,.9),3) AS p90_seconds, round(quantile_cont(d,.95),3) AS p95_seconds FROM g WHERE d IS NOT NULL""")
def _(t):
    return ev.gap_percentiles(ev.clean_events(t.events))


@query("evt04_session_durations", _cte() + f"""SELECT {_case('secs', ev.DURATION_BANDS, '> 1 hour')} AS duration_range, count(*) AS session_count,
 round(avg(event_count),4) AS avg_events_in_range, round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percentage FROM dur GROUP BY 1""")
def _(t):
    return ev.duration_bands(_dur(t))


@query("evt04_session_rows", _cte() + """SELECT user_id, session_id, event_count, distinct_event_types, epoch_us(session_start) AS start_us,
 round(secs/60.0, 4) AS session_duration_minutes FROM dur""")
def _(t):
    return _dur(t).select("user_id", "session_id", "event_count", "distinct_event_types",
                          F.unix_micros("session_start").alias("start_us"),
                          F.round("session_duration_minutes", 4).alias("session_duration_minutes"))


@query("evt05_engagement_segments", _cte() + f"""SELECT {_case('total_sessions', ev.ENGAGEMENT_BANDS, 'Power Users (>30)')} AS engagement_segment,
 count(*) AS user_count, round(avg(total_sessions),4) AS avg_sessions, round(avg(total_events),4) AS avg_total_events,
 round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percentage FROM usr GROUP BY 1""")
def _(t):
    return ev.engagement_segments(ev.user_session_stats(_dur(t)))


@query("evt05_repeat_users", _cte() + """SELECT count(*) FILTER (total_sessions=1) AS one_time_users, count(*) FILTER (total_sessions BETWEEN 2 AND 5) AS moderate_users,
 count(*) FILTER (total_sessions>5) AS engaged_users, round(100.0*count(*) FILTER (total_sessions>1)/count(*),4) AS repeat_user_pct FROM usr""")
def _(t):
    return ev.repeat_users(ev.user_session_stats(_dur(t)))


@query("evt06_inter_session_gaps", _cte() + f""", gaps AS (SELECT (epoch_us(session_start) - lag(epoch_us(session_end)) OVER (PARTITION BY user_id ORDER BY session_id))/1e6 AS g FROM dur)
SELECT {_case('g', ev.SESSION_GAP_BANDS, '> 1 month')} AS gap_range, count(*) AS gap_count, round(avg(g)/3600.0,4) AS avg_gap_hours,
 round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percentage FROM gaps WHERE g IS NOT NULL GROUP BY 1""")
def _(t):
    return ev.inter_session_gaps(_dur(t))


@query("evt07_session_openers", _cte() + """, f AS (SELECT user_id, session_id, max(event_type) FILTER (position=1) AS first_event,
 max(event_type) FILTER (position=2) AS second_event, max(event_type) FILTER (position=3) AS third_event FROM sp WHERE position<=3 GROUP BY 1,2)
SELECT first_event, second_event, third_event, count(*) AS session_count, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage
FROM f GROUP BY 1,2,3 ORDER BY session_count DESC, first_event NULLS FIRST, second_event NULLS FIRST, third_event NULLS FIRST LIMIT 20""")
def _(t):
    return ev.session_openers(_ses(t))


@query("evt08_session_conversion", _cte() + """, c AS (SELECT user_id, session_id, count(*) AS n, max((event_type='purchase')::INT) AS h FROM s GROUP BY 1,2)
SELECT CASE WHEN h=1 THEN 'Converted' ELSE 'Not Converted' END AS conversion_status, count(*) AS session_count,
 round(avg(n),4) AS avg_events_per_session, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM c GROUP BY 1""")
def _(t):
    return ev.session_conversion(_ses(t), "purchase")


@query("evt08_conversion_by_length", _cte() + f""", c AS (SELECT user_id, session_id, count(*) AS n, max((event_type='purchase')::INT) AS h FROM s GROUP BY 1,2)
SELECT {_case('n', ev.LENGTH_BANDS, '20+ events')} AS session_length_category, count(*) AS session_count, sum(h)::BIGINT AS conversions,
 round(100.0*sum(h)/count(*),4) AS conversion_rate_pct FROM c GROUP BY 1""")
def _(t):
    return ev.conversion_by_length(_ses(t), "purchase")


@query("evt09_session_quality_score", _cte() + """, q AS (SELECT (1-count(*) FILTER (event_count=1)/count(*))*40.0
 + (1-count(*) FILTER (secs>7200)/count(*))*30.0 + 30.0 AS v FROM dur)
SELECT round(v,4) AS quality_score, CASE WHEN v>=80 THEN 'Excellent' WHEN v>=60 THEN 'Good' WHEN v>=40 THEN 'Fair' ELSE 'Poor - Review Parameters' END AS quality_rating FROM q""")
def _(t):
    return ev.session_quality_score(_dur(t))


@query("evt10_bounce_rate", _cte() + """SELECT count(*) FILTER (event_count=1) AS bounced_sessions, count(*) AS total_sessions,
 round(100.0*count(*) FILTER (event_count=1)/count(*),4) AS bounce_rate_pct FROM dur""")
def _(t):
    return ev.bounce_rate(_dur(t))


@query("evt10_sessions_by_hour", _cte() + """SELECT hour(session_start)::INT AS hour_of_day, count(*) AS sessions_started,
 round(avg(event_count),4) AS avg_events, round(avg(secs)/60.0,4) AS avg_duration_min FROM dur GROUP BY 1""")
def _(t):
    return ev.sessions_by_hour(_dur(t))


@query("evt10_longest_sessions", _cte() + """SELECT user_id, session_id, event_count, distinct_event_types, round(secs/60.0,4) AS minutes FROM dur
 ORDER BY event_count DESC, secs DESC, user_id, session_id LIMIT 20""")
def _(t):
    return ev.longest_sessions(_dur(t)).select("user_id", "session_id", "event_count", "distinct_event_types",
                                               F.round("session_duration_minutes", 4).alias("minutes"))


@query("evt11_event_path", _cte() + """SELECT user_id, session_id, string_agg(event_type, ' -> ' ORDER BY position) AS event_sequence FROM sp GROUP BY 1,2""")
def _(t):
    return ev.event_path(_ses(t))


@query("evt12_transitions", """WITH n AS (SELECT event_type AS current_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events)
SELECT current_state, next_state, count(*) AS transition_count, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY current_state),4) AS transition_pct
FROM n WHERE next_state IS NOT NULL GROUP BY 1,2""")
def _(t):
    return ev.transitions(ev.clean_events(t.events), ["user_id"], seq="event_sequence_number")


@query("evt12_session_transitions", _cte() + """, n AS (SELECT event_type AS event_type_1, lead(event_type) OVER (PARTITION BY user_id, session_id ORDER BY position) AS event_type_2 FROM sp)
SELECT event_type_1, event_type_2, count(*) AS occurrence_count, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage
FROM n WHERE event_type_2 IS NOT NULL GROUP BY 1,2 ORDER BY occurrence_count DESC, 1, 2 LIMIT 20""")
def _(t):
    return ev.session_transitions(_ses(t))


_TC = """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))/1e6 AS d FROM events),
 k AS (SELECT unnest([900, 1800, 3600]) AS t),
 x AS (SELECT t::BIGINT AS timeout_seconds, count(*) FILTER (d IS NULL OR d > t) AS total_sessions, count(*) AS n, coalesce(sum(d) FILTER (d <= t), 0) AS inside FROM g CROSS JOIN k GROUP BY 1)
"""


@query("evt13_timeout_compare", _TC + """SELECT timeout_seconds, total_sessions, round(n/total_sessions,4) AS avg_events_per_session,
 round(inside/total_sessions/60.0,4) AS avg_session_duration_min FROM x""")
def _(t):
    return ev.timeout_compare(t.events)


@query("evt13_timeout_recommendation", _TC + """, y AS (SELECT max(total_sessions) FILTER (timeout_seconds=900) AS a, max(total_sessions) FILTER (timeout_seconds=1800) AS b,
 max(total_sessions) FILTER (timeout_seconds=3600) AS c FROM x)
SELECT CASE WHEN b < a*0.7 THEN '15-minute timeout recommended - High user activity' WHEN c > b*1.3 THEN '60-minute timeout recommended - Longer sessions'
 ELSE '30-minute timeout recommended - Standard behavior' END AS recommendation FROM y""")
def _(t):
    return ev.timeout_recommendation(ev.timeout_compare(t.events))



def _symbols():
    e = F.col("event_type")
    return [("A", e == "view"), ("B", e == "click"), ("C", e == "purchase")]


RESULT = {"path_start": ("first", "ts", "A"), "path_end": ("last", "ts", "C"), "event_count_in_path": ("count", None, None),
          "total_value": ("sum", "value", None), "path": ("path", None, None)}


def _paths(t, mode="NONOVERLAPPING", pattern="A.B*.C", results=RESULT):
    return pa.npath(t.events, "user_id", "ts", _symbols(), pattern, mode, results)


# In an A.B*.C match every event but the last is an A followed by Bs, so a match is a C whose preceding unbroken B stretch follows an A.
_NP = """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' ELSE '-' END AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT *, max(seq) FILTER (s <> 'B') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  sum(value) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM e),
m AS (SELECT c.user_id, a.ts AS path_start, c.ts AS path_end, c.seq - a.seq + 1 AS event_count_in_path,
  c.cum - a.cum + a.value AS total_value, 'A' || repeat('B', (c.seq - a.seq - 1)::INT) || 'C' AS path
 FROM l c JOIN l a ON a.user_id = c.user_id AND a.seq = c.p WHERE c.s = 'C' AND a.s = 'A')
"""


@query("evt14_npath", _NP + "SELECT user_id, epoch_us(path_start) AS start_us, epoch_us(path_end) AS end_us, event_count_in_path, round(total_value,3) AS total_value, path FROM m")
def _(t):
    return _paths(t).select("user_id", F.unix_micros("path_start").alias("start_us"), F.unix_micros("path_end").alias("end_us"),
                            "event_count_in_path", F.round("total_value", 3).alias("total_value"), "path")


@query("evt14_npath_modes", """WITH e AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' ELSE '-' END, '' ORDER BY ts, event_id) AS txt FROM events GROUP BY 1),
n AS (SELECT unnest(regexp_extract_all(txt, '[AB]+C', 0)) AS m FROM e),
o AS (SELECT regexp_extract(substr(txt, i::INT), '^([AB]+C)', 1) AS m FROM e, unnest(range(1, length(txt)+1)) AS r(i))
SELECT 'NONOVERLAPPING' AS mode, count(*) AS paths_found, round(avg(length(m)),4) AS avg_events FROM n
UNION ALL SELECT 'OVERLAPPING', count(*), round(avg(length(m)),4) FROM o WHERE m <> ''""")
def _(t):
    def one(mode):
        return _paths(t, mode, "(A|B)+.C", {"event_count_in_path": ("count", None, None)}).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("paths_found"),
                                               F.round(F.avg("event_count_in_path"), 4).alias("avg_events"))
    return one("NONOVERLAPPING").unionByName(one("OVERLAPPING"))


@query("evt15_path_coverage", _NP + """SELECT count(*) AS total_paths_found, count(DISTINCT user_id) AS entities_with_pattern,
 round(avg(event_count_in_path),4) AS avg_events_per_path, round(avg(total_value),4) AS avg_path_value,
 count(*) FILTER (event_count_in_path>=3) AS meaningful_paths, count(*) FILTER (event_count_in_path<3) AS short_paths,
 round(100.0*count(*) FILTER (event_count_in_path>=3)/count(*),4) AS quality_score_pct, (SELECT count(DISTINCT user_id) FROM events) AS total_entities,
 round(100.0*count(DISTINCT user_id)/(SELECT count(DISTINCT user_id) FROM events),4) AS coverage_pct FROM m""")
def _(t):
    return pa.path_coverage(_paths(t), t.events, "user_id")


@query("evt15_path_durations", _NP + f"""SELECT {_case('(epoch_us(path_end)-epoch_us(path_start))/1e6', pa.PATH_BANDS, '> 1 hour')} AS duration_range,
 count(*) AS path_count, round(avg(total_value),4) AS avg_value, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM m GROUP BY 1""")
def _(t):
    return pa.path_durations(_paths(t))


@query("evt15_paths_by_hour", _NP + "SELECT hour(path_start)::INT AS hour, count(*) AS paths_started FROM m GROUP BY 1")
def _(t):
    return pa.paths_by_hour(_paths(t))


@query("evt15_repeat_paths", _NP + "SELECT user_id, count(*) AS pattern_match_count, round(sum(total_value),3) AS total_value FROM m GROUP BY 1 HAVING count(*)>1")
def _(t):
    return pa.repeat_paths(_paths(t), "user_id")


def _touch(t):
    return t.events.select("user_id", "ts", "event_id", F.col("event_type").alias("channel"),
                           F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("conversion_flag"),
                           F.col("value").alias("conversion_value"))


_AT = """WITH e AS (SELECT user_id, ts, event_id, event_type AS channel, (event_type='purchase')::INT AS f, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
j AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS journey FROM e),
w AS (SELECT j.*, c.value AS stake, (epoch_us(c.ts)-epoch_us(j.ts))/1e6/86400.0 AS age_days FROM j JOIN (SELECT * FROM j WHERE f=1) c ON c.user_id=j.user_id AND c.journey=j.journey),
p AS (SELECT *, count(*) OVER (PARTITION BY user_id, journey) AS n, row_number() OVER (PARTITION BY user_id, journey ORDER BY seq) AS pos,
  pow(2.0, -age_days/7.0) AS dw, sum(pow(2.0, -age_days/7.0)) OVER (PARTITION BY user_id, journey) AS ds FROM w WHERE age_days <= 30),
a AS (SELECT *, stake*(pos=1)::INT AS FIRST_TOUCH, stake*(pos=n)::INT AS LAST_TOUCH, stake/n AS LINEAR,
  stake*CASE WHEN n=1 THEN 1.0 WHEN n=2 THEN 0.5 WHEN pos=1 OR pos=n THEN 0.4 ELSE 0.2/(n-2) END AS U_SHAPED, stake*dw/ds AS TIME_DECAY FROM p),
lg AS (UNPIVOT a ON FIRST_TOUCH, LAST_TOUCH, LINEAR, U_SHAPED, TIME_DECAY INTO NAME model VALUE credit)
"""


@query("evt16_attribution", _AT + """SELECT user_id, journey, pos AS position, n AS touches, channel, round(FIRST_TOUCH,8) AS FIRST_TOUCH, round(LAST_TOUCH,8) AS LAST_TOUCH,
 round(LINEAR,8) AS LINEAR, round(U_SHAPED,8) AS U_SHAPED, round(TIME_DECAY,8) AS TIME_DECAY FROM a""")
def _(t):
    return pa.attribution(_touch(t)).select("user_id", "journey", "position", "touches", "channel",
                                            *[F.round(m, 8).alias(m) for m in pa.MODELS])


@query("evt17_channel_credit", _AT + """SELECT model, channel, count(*) AS touchpoint_count, count(DISTINCT user_id) AS unique_customers, round(sum(credit),3) AS total_credit,
 round(avg(credit),4) AS avg_credit_per_touchpoint, round(100.0*sum(credit)/sum(sum(credit)) OVER (PARTITION BY model),4) AS credit_share_pct FROM lg GROUP BY 1,2""")
def _(t):
    return pa.channel_credit(pa.attribution_long(pa.attribution(_touch(t))))


@query("evt17_position_credit", _AT + """SELECT model, CASE WHEN pos=1 THEN 'First Touch' WHEN pos=n THEN 'Last Touch' ELSE 'Mid-Journey' END AS position_type,
 round(sum(credit),3) AS total_credit, count(*) AS touchpoint_count FROM lg GROUP BY 1,2""")
def _(t):
    return pa.position_credit(pa.attribution_long(pa.attribution(_touch(t))))


@query("evt17_path_length", _AT + """SELECT n AS path_length, count(*) AS conversions, round(sum(stake),3) AS total_conversion_value, round(avg(stake),4) AS avg_conversion_value FROM a WHERE pos=n GROUP BY 1""")
def _(t):
    return pa.path_length(pa.attribution(_touch(t)))


@query("evt17_journey_duration", _AT + f"""SELECT {_case('age_days', pa.JOURNEY_BANDS, '> 30 days')} AS journey_duration, count(*) AS journeys, round(avg(stake),4) AS avg_value,
 round(avg(n),4) AS avg_touches, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM a WHERE pos=1 GROUP BY 1""")
def _(t):
    return pa.journey_duration(pa.attribution(_touch(t)))


@query("evt17_attribution_coverage", _AT + """SELECT count(DISTINCT channel) AS channels_receiving_credit, round(sum(LINEAR),3) AS total_credits_assigned, count(*) AS touchpoints_with_credit,
 (SELECT count(DISTINCT channel) FROM e) AS total_channels, (SELECT count(*) FROM e) AS total_touchpoints, (SELECT round(sum(value) FILTER (f=1),3) FROM e) AS total_conversion_value,
 round(100.0*count(*)/(SELECT count(*) FROM e),4) AS credit_coverage_pct FROM a""")
def _(t):
    return pa.attribution_coverage(pa.attribution(_touch(t)), _touch(t))


@query("evt18_attribution_compare", _AT + """SELECT channel, round(sum(FIRST_TOUCH),3) AS FIRST_TOUCH, round(sum(LAST_TOUCH),3) AS LAST_TOUCH, round(sum(LINEAR),3) AS LINEAR,
 round(sum(U_SHAPED),3) AS U_SHAPED, round(sum(TIME_DECAY),3) AS TIME_DECAY FROM a GROUP BY 1""")
def _(t):
    return pa.attribution(_touch(t)).groupBy("channel").agg(*[F.round(F.sum(m), 3).alias(m) for m in pa.MODELS])


@query("evt19_event_quality", """WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
b AS (SELECT count(*) AS total, count(*) FILTER (user_id IS NULL OR ts IS NULL OR event_type IS NULL) AS missing, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types,
 count(DISTINCT ts::DATE) AS dates, count(*) FILTER (event_type='purchase') AS conv, count(*) FILTER (ts < p) AS ooo,
 (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id, ts, event_type HAVING count(*)>1)) AS dups FROM o)
SELECT 'Completeness' AS check_name, 'missing_events' AS metric, missing::DOUBLE AS value, CASE WHEN missing=0 THEN 'PASS' ELSE 'FAIL' END AS status FROM b
UNION ALL SELECT 'Duplicates','duplicate_combinations', dups, CASE WHEN dups=0 THEN 'PASS' ELSE 'WARNING' END FROM b
UNION ALL SELECT 'Ordering','out_of_order_pct', round(100.0*ooo/total,4), CASE WHEN ooo=0 THEN 'PASS' ELSE 'WARNING' END FROM b
UNION ALL SELECT 'Coverage','distinct_dates', dates, CASE WHEN dates>1 THEN 'PASS' ELSE 'FAIL' END FROM b
UNION ALL SELECT 'Users','events_per_user', round(total/users,4), 'PASS' FROM b
UNION ALL SELECT 'Variety','event_types', types, CASE WHEN types>=2 THEN 'PASS' ELSE 'FAIL' END FROM b
UNION ALL SELECT 'Conversion','conversions_per_100_users', round(100.0*conv/users,4), 'INFO' FROM b""")
def _(t):
    return ev.event_quality(t.events, converted=F.col("event_type") == "purchase")

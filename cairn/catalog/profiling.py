"""Queries of the profiling and quality operators."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.functions.expr import rnd
from cairn.operators import profiling as pr, quality as ql, relational as rel

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(cols, sql):
    """The statement once per column ({c}), united."""
    return " UNION ALL ".join(sql.replace("{c}", c) for c in cols)


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


KINDS = {"p_partkey": "NUMERIC", "p_name": "CHARACTER", "p_brand": "CHARACTER", "p_type": "CHARACTER", "p_size": "NUMERIC", "p_retailprice": "NUMERIC"}
_CAT = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, '{k}' AS column_category FROM part" for c, k in KINDS.items())
_CAT = f"WITH k AS ({_CAT}), c AS (SELECT *, CASE WHEN column_category='NUMERIC' THEN 'NUMERIC_PROFILE' WHEN distinct_count<50 THEN 'CATEGORICAL_PROFILE' ELSE 'TEXT_PROFILE' END AS profiling_strategy FROM k)"


@query("dq01_column_catalog", _CAT + " SELECT * FROM c")
def _(t):
    return pr.column_catalog(t.part)


@query("dq01_strategy_lists", _CAT + " SELECT profiling_strategy, count(*) AS column_count, string_agg(column_name, ', ' ORDER BY column_name) AS columns FROM c GROUP BY 1")
def _(t):
    return pr.strategy_lists(pr.column_catalog(t.part))


@query("dq02_volume_assessment", """SELECT count(*) AS total_rows, 11 AS total_columns, CASE WHEN count(*)<10 THEN 'INSUFFICIENT - Less than 10 rows' WHEN count(*)<100 THEN 'MINIMAL - Limited statistical power' WHEN count(*)<1000 THEN 'ADEQUATE - Basic profiling possible'
 WHEN count(*)<1000000 THEN 'GOOD - Full profiling recommended' ELSE 'LARGE - Consider sampling for efficiency' END AS data_volume_assessment, 'MODERATE - Standard profiling' AS dimensionality_assessment FROM lineitem""")
def _(t):
    return pr.volume_assessment(t.lineitem)


_NUMERIC = """SELECT '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, min({c}) AS min_value, max({c}) AS max_value, avg({c}) AS mean_value, stddev({c}) AS std_dev, variance({c}) AS variance_value,
 quantile_cont({c},.25) AS q1, quantile_cont({c},.5) AS median, quantile_cont({c},.75) AS q3, count(*)-count({c}) AS null_count, 100.0*(count(*)-count({c}))/count(*) AS null_percentage, 100.0*count(DISTINCT {c})/count({c}) AS uniqueness_percentage,
 stddev({c})/avg({c})*100 AS coefficient_of_variation FROM lineitem"""


@query("dq03_univariate_stats", f"WITH b AS ({each(NUM, _NUMERIC)}), m AS (" + each(NUM, "SELECT '{c}' AS column_name, avg(pow(({c}-m)/s,3)) AS skewness, avg(pow(({c}-m)/s,4))-3 AS excess_kurtosis FROM lineitem, (SELECT avg({c}) AS m, stddev({c}) AS s FROM lineitem)") + """),
 p AS (""" + each(NUM, "SELECT '{c}' AS column_name, " + ", ".join(f"quantile_cont({{c}},{v}) AS {n}" for n, v in pr.PERCENTILES.items() if n not in ("q1", "median", "q3")) + " FROM lineitem") + """),
 w AS (SELECT column_name, total_count::DOUBLE AS total_count, non_null_count::DOUBLE AS non_null_count, null_count::DOUBLE AS null_count, distinct_count::DOUBLE AS distinct_count, min_value, max_value, mean_value, std_dev, variance_value, q1, median, q3, q3-q1 AS iqr, coefficient_of_variation, max_value-min_value AS range_value,
  skewness, excess_kurtosis, p01, p05, p10, p90, p95, p99 FROM b JOIN m USING (column_name) JOIN p USING (column_name))
 SELECT column_name, stat, round(value,4) AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE column_name) INTO NAME stat VALUE value)""")
def _(t):
    return r(pr.univariate_stats(t.lineitem, NUM), 4, "value")


@query("dq04_numeric_profile", f"""SELECT column_name, total_count, non_null_count, distinct_count, min_value, max_value, round(mean_value,9) AS mean_value, round(std_dev,5) AS std_dev, round(variance_value,3) AS variance_value, round(q1,5) AS q1, round(median,5) AS median, round(q3,5) AS q3,
 null_count, round(null_percentage,4) AS null_percentage, round(uniqueness_percentage,4) AS uniqueness_percentage, round(q3-q1,5) AS iqr, round(coefficient_of_variation,9) AS coefficient_of_variation FROM ({each(NUM, _NUMERIC)})""")
def _(t):
    p = pr.numeric_profile(t.lineitem, NUM)
    p = r(p, 5, "std_dev", "q1", "median", "q3", "iqr")
    return r(r(r(p, 9, "mean_value", "coefficient_of_variation"), 4, "null_percentage", "uniqueness_percentage"), 3, "variance_value")


@query("dq05_column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_count, round(100.0*(count(*)-count({c}))/count(*),4) AS null_pct, " +
    (f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}),6) AS mean_value" if k == "NUMERIC" else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value") +
    f", '{k}' AS column_category FROM part" for c, k in KINDS.items()))
def _(t):
    return r(r(pr.column_summary(t.part), 6, "mean_value"), 4, "null_pct")


@query("dq06_sign_counts", "SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal=0) AS zero_count, round(100.0*count(*) FILTER (c_acctbal=0)/count(*),4) AS zero_percentage, count(*) FILTER (c_acctbal<0) AS negative_count, round(100.0*count(*) FILTER (c_acctbal<0)/count(*),4) AS negative_percentage, count(*) FILTER (c_acctbal>0) AS positive_count, round(100.0*count(*) FILTER (c_acctbal>0)/count(*),4) AS positive_percentage FROM customer")
def _(t):
    return r(pr.sign_counts(t.customer, ["c_acctbal"]), 4, "zero_percentage", "negative_percentage", "positive_percentage")


CATS = ["p_brand", "p_type", "p_size"]


@query("dq07_frequency", "WITH v AS (" + each(CATS, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS f FROM part GROUP BY 2") + """), k AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY f DESC, value) AS rn FROM v),
 u AS (SELECT column_name, CASE WHEN rn<=10 THEN value ELSE 'Other_Values' END AS value, sum(f)::BIGINT AS frequency FROM k GROUP BY 1,2) SELECT *, round(100.0*frequency/sum(frequency) OVER (PARTITION BY column_name),4) AS percentage FROM u""")
def _(t):
    return pr.frequency(t.part, CATS)


_CP = "WITH v AS (" + each(CATS, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS f FROM part GROUP BY 2") + """), a AS (SELECT column_name, sum(f)::BIGINT AS total_count, sum(f)::BIGINT AS non_null_count, count(*) AS distinct_count, min(f) AS min_frequency, max(f) AS max_frequency, avg(f) AS avg_frequency, stddev(f) AS std_frequency,
 (arg_min(value, (-f, value))) AS mode_value FROM v GROUP BY 1)"""


@query("dq08_categorical_profile", _CP + """ SELECT column_name, total_count, non_null_count, distinct_count, min_frequency, max_frequency, round(avg_frequency,6) AS avg_frequency, round(std_frequency,6) AS std_frequency, mode_value, 0 AS null_count, round(100.0*distinct_count/non_null_count,4) AS cardinality_ratio,
 round(100.0*max_frequency/non_null_count,4) AS mode_percentage, round(max_frequency/min_frequency,6) AS imbalance_ratio, CASE WHEN distinct_count=1 THEN 'FAIL - Single Value' WHEN distinct_count>100 THEN 'WARNING - Very High Cardinality' WHEN distinct_count>50 THEN 'WARNING - High Cardinality' ELSE 'PASS - Normal Cardinality' END AS cardinality_assessment FROM a""")
def _(t):
    return r(r(pr.categorical_profile(t.part, CATS), 6, "avg_frequency", "std_frequency", "imbalance_ratio"), 4, "cardinality_ratio", "mode_percentage")


@query("dq09_rare_values", """WITH x AS (SELECT (n_chars // 500)::VARCHAR AS value FROM documents), c AS (SELECT value, count(*) AS f FROM x GROUP BY 1)
 SELECT 'bucket' AS column_name, count(*) AS rare_value_count, sum(f)::BIGINT AS total_rare_frequency, round(100.0*sum(f)/(SELECT count(*) FROM documents),4) AS rare_value_percentage, string_agg(value, ', ' ORDER BY f, value) AS rare_values FROM c WHERE 100.0*f/(SELECT count(*) FROM documents) < 1""")
def _(t):
    d = t.documents.select(F.floor(F.col("n_chars") / 500).cast("string").alias("bucket"))
    return r(pr.rare_values(d, "bucket"), 4, "rare_value_percentage")


@query("dq10_category_balance", _CP + """ SELECT column_name, distinct_count AS num_categories, round(avg_frequency,6) AS avg_frequency, round(std_frequency,6) AS std_frequency, min_frequency, max_frequency, round(max_frequency/min_frequency,6) AS imbalance_ratio,
 CASE WHEN std_frequency/avg_frequency<.3 THEN 'Highly Balanced' WHEN std_frequency/avg_frequency<.7 THEN 'Moderately Balanced' ELSE 'Imbalanced' END AS distribution_balance, CASE WHEN max_frequency/min_frequency<3 THEN 'PASS - Well Balanced' WHEN max_frequency/min_frequency<10 THEN 'WARNING - Moderate Imbalance' ELSE 'FAIL - Severe Imbalance' END AS balance_check FROM a""")
def _(t):
    return r(pr.category_balance(t.part, CATS), 6, "avg_frequency", "std_frequency", "imbalance_ratio")


@query("dq11_entropy", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n/sum(n) OVER () AS p FROM c), e AS (SELECT -sum(p*log2(p)) AS e, log2(count(*)) AS m FROM p)
SELECT round(e,8) AS entropy, round(m,8) AS max_entropy, round(e/m,8) AS normalized_entropy, CASE WHEN e/m>.9 THEN 'High Entropy - Nearly Uniform Distribution' WHEN e/m>.6 THEN 'Moderate Entropy - Reasonably Distributed' ELSE 'Low Entropy - Concentrated Distribution' END AS entropy_interpretation FROM e""")
def _(t):
    e = rel.entropy(t.documents, "lang").withColumn("entropy_interpretation", pr.entropy_label("normalized_entropy"))
    return r(e, 8, "entropy", "max_entropy", "normalized_entropy")


@query("dq12_text_lengths", each(["text", "lang", "source"], "SELECT '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})),6) AS avg_length, round(stddev(length({c})),5) AS std_length, quantile_cont(length({c}),.5) AS median_length FROM documents"))
def _(t):
    return r(r(pr.text_lengths(t.documents, ["text", "lang", "source"]), 6, "avg_length"), 5, "std_length")


@query("dq12_text_patterns", each(["p_brand", "p_type", "p_name"], "SELECT '{c}' AS column_name, count(*) FILTER (regexp_full_match(lower({c}),'[0-9]+')) AS numeric_pattern_count, count(*) FILTER (regexp_full_match(lower({c}),'[a-z]+')) AS alphabetic_pattern_count, count(*) FILTER (regexp_full_match(lower({c}),'[a-z0-9]+')) AS alphanumeric_pattern_count, count(*) FILTER (trim({c})<>{c}) AS whitespace_issue_count FROM part"))
def _(t):
    return pr.text_patterns(t.part, ["p_brand", "p_type", "p_name"])


_HIST = """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CASE WHEN l_extendedprice=hi THEN 19 ELSE floor((l_extendedprice-lo)/((hi-lo)/20))::INT END AS bin_id, lo, (hi-lo)/20 AS w FROM lineitem, s),
 h AS (SELECT bin_id, lo+bin_id*w AS lb, lo+(bin_id+1)*w AS ub, count(*) AS frequency FROM b GROUP BY 1,2,3)"""


@query("dq13_histogram_equal_width", _HIST + " SELECT bin_id, round(lb,4) AS bin_lower_bound, round(ub,4) AS bin_upper_bound, frequency, round(100.0*frequency/sum(frequency) OVER (),4) AS percentage, repeat('*', greatest(floor(frequency*50.0/max(frequency) OVER ())::INT,1)) AS visual_bar FROM h")
def _(t):
    return r(pr.histogram_equal_width(t.lineitem, "l_extendedprice"), 4, "bin_lower_bound", "bin_upper_bound")


@query("dq14_histogram_equal_freq", "WITH b AS (SELECT o_totalprice AS v, ntile(20) OVER (ORDER BY o_totalprice, o_orderkey) AS bin_id FROM orders) SELECT bin_id, min(v) AS bin_lower_bound, max(v) AS bin_upper_bound, count(*) AS frequency, round(avg(v),4) AS bin_mean, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM b GROUP BY 1")
def _(t):
    return r(pr.histogram_equal_freq(t.orders, "o_totalprice", ["o_orderkey"]), 4, "bin_mean")


@query("dq15_distribution_shape", "WITH m AS (" + each(NUM, "SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS m, quantile_cont({c},.5) AS md, stddev({c}) AS s, min({c}) AS lo, max({c}) AS hi FROM lineitem") + "), k AS (" +
       each(NUM, "SELECT '{c}' AS column_name, avg(pow(({c}-a)/b,3)) AS sk, avg(pow(({c}-a)/b,4))-3 AS ku FROM lineitem, (SELECT avg({c}) AS a, stddev({c}) AS b FROM lineitem)") + """)
 SELECT column_name, n AS sample_size, round(m,5) AS mean_value, round(md,5) AS median, round(s,5) AS std_dev, round(sk,6) AS skewness, round(ku,6) AS excess_kurtosis, CASE WHEN abs(m-md)/s<.1 THEN 'Symmetric' WHEN m>md THEN 'Right-skewed' ELSE 'Left-skewed' END AS mean_median_indication,
 CASE WHEN abs(sk)<.5 THEN 'Approximately Symmetric' WHEN sk>.5 THEN 'Right-skewed (long tail right)' ELSE 'Left-skewed (long tail left)' END AS skewness_interpretation, CASE WHEN abs(ku)<.5 THEN 'Normal tails (Mesokurtic)' WHEN ku>.5 THEN 'Heavy tails (Leptokurtic)' ELSE 'Light tails (Platykurtic)' END AS kurtosis_interpretation,
 CASE WHEN abs(sk)<.5 AND abs(ku)<.5 THEN 'Potentially Normal' WHEN sk>1 AND lo>=0 THEN 'Possibly Log-normal or Exponential' WHEN abs(ku)>3 THEN 'Heavy-tailed (consider outlier analysis)' WHEN lo>=0 AND hi<=1 THEN 'Possibly Beta or Uniform' ELSE 'Non-standard distribution' END AS distribution_type_suggestion,
 CASE WHEN abs(sk)>1 THEN 'Consider log or Box-Cox transformation' WHEN abs(ku)>3 THEN 'Heavy tails - Check for outliers' ELSE 'Distribution shape acceptable' END AS transformation_recommendation FROM m JOIN k USING (column_name)""")
def _(t):
    return r(r(pr.distribution_shape(t.lineitem, NUM), 5, "mean_value", "median", "std_dev"), 6, "skewness", "excess_kurtosis")


@query("dq16_empirical_rule", "WITH e AS (" + each(NUM, "SELECT '{c}' AS column_name, 100.0*count(*) FILTER (abs({c}-m)<=s)/count({c}) AS a, 100.0*count(*) FILTER (abs({c}-m)<=2*s)/count({c}) AS b, 100.0*count(*) FILTER (abs({c}-m)<=3*s)/count({c}) AS d FROM lineitem, (SELECT avg({c}) AS m, stddev({c}) AS s FROM lineitem)") +
       ") SELECT column_name, round(a,4) AS pct_within_1_std_dev, round(b,4) AS pct_within_2_std_dev, round(d,4) AS pct_within_3_std_dev, CASE WHEN a BETWEEN 63 AND 73 AND b BETWEEN 90 AND 98 AND d>99 THEN 'Consistent with Normal Distribution' ELSE 'Likely Non-Normal Distribution' END AS empirical_rule_assessment FROM e")
def _(t):
    return r(pr.empirical_rule(t.lineitem, NUM), 4, *[f"pct_within_{k}_std_dev" for k in (1, 2, 3)])


@query("dq17_modality", _HIST + """, f AS (SELECT b.range AS bin_id, coalesce(frequency,0) AS f FROM range(20) b LEFT JOIN h ON h.bin_id=b.range), p AS (SELECT f > coalesce(lag(f) OVER (ORDER BY bin_id),0) AND f > coalesce(lead(f) OVER (ORDER BY bin_id),0) AS k FROM f), n AS (SELECT count(*) FILTER (k) AS num_peaks FROM p)
 SELECT num_peaks, CASE WHEN num_peaks=1 THEN 'Unimodal (single peak)' WHEN num_peaks=2 THEN 'Potentially Bimodal (two peaks)' WHEN num_peaks>2 THEN 'Multimodal (multiple peaks)' ELSE 'Uniform or unclear distribution' END AS modality_assessment FROM n""")
def _(t):
    return pr.modality(t.lineitem, "l_extendedprice")


@query("dq18_concentration", """WITH c AS (SELECT p_size AS v, count(*) AS f FROM part GROUP BY 1), k AS (SELECT v, round(100.0*sum(f) OVER (ORDER BY f DESC, v ROWS UNBOUNDED PRECEDING)/sum(f) OVER (),4) AS s FROM c)
 SELECT min(v) FILTER (s<=50) AS min_value_top50pct, max(v) FILTER (s<=50) AS max_value_top50pct, count(*) FILTER (s<=50) AS distinct_values_top50pct, count(*) FILTER (s<=80) AS distinct_values_top80pct, count(*) AS total_distinct_values FROM k""")
def _(t):
    return pr.concentration(t.part, "p_size")


def _iqr(table, c):
    return f"WITH q AS (SELECT quantile_cont({c},.25) AS q1, quantile_cont({c},.5) AS median, quantile_cont({c},.75) AS q3 FROM {table}), b AS (SELECT *, q3-q1 AS iqr, q1-1.5*(q3-q1) AS lower_bound, q3+1.5*(q3-q1) AS upper_bound, q1-3*(q3-q1) AS extreme_lower, q3+3*(q3-q1) AS extreme_upper FROM q)"


@query("dq19_box_stats", _iqr("events", "value") + """ SELECT round(q1,6) AS q1, round(median,6) AS median, round(q3,6) AS q3, round(iqr,6) AS iqr, round(lower_bound,6) AS lower_bound, round(upper_bound,6) AS upper_bound, min(value) FILTER (value>=lower_bound) AS lower_whisker, max(value) FILTER (value<=upper_bound) AS upper_whisker,
 count(*) FILTER (value<lower_bound) AS lower_outlier_count, count(*) FILTER (value>upper_bound) AS upper_outlier_count FROM events, b GROUP BY 1,2,3,4,5,6""")
def _(t):
    return r(pr.box_stats(t.events, "value"), 6, "q1", "median", "q3", "iqr", "lower_bound", "upper_bound")


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
_PAIR = " UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a},{b}) AS correlation FROM lineitem" for a, b in PAIRS)
_LAB = """CASE WHEN abs(correlation)>=.9 THEN 'Very Strong' WHEN abs(correlation)>=.7 THEN 'Strong' WHEN abs(correlation)>=.4 THEN 'Moderate' WHEN abs(correlation)>=.2 THEN 'Weak' ELSE 'Very Weak' END AS strength_category,
 CASE WHEN correlation>0 THEN 'Positive' WHEN correlation<0 THEN 'Negative' ELSE 'None' END AS direction, CASE WHEN abs(correlation)>=.9 THEN 'Consider removing one variable' WHEN abs(correlation)>=.7 THEN 'Monitor for multicollinearity' ELSE 'No action needed' END AS recommendation"""


@query("dq20_correlation_pairs", f"SELECT variable_1, variable_2, round(correlation,8) AS correlation, {_LAB} FROM ({_PAIR})")
def _(t):
    return r(pr.correlation_pairs(t.lineitem, NUM), 8, "correlation")


@query("dq20_correlation_spearman", f"WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c})-1)/2.0 AS {c}" for c in ["p_size", "p_retailprice", "p_partkey"]) +
       " FROM part), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a},{b}) AS correlation FROM k" for a, b in [("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey")]) + f") SELECT variable_1, variable_2, round(correlation,8) AS correlation, {_LAB} FROM c")
def _(t):
    return r(pr.correlation_pairs(t.part, ["p_size", "p_retailprice", "p_partkey"], "spearman"), 8, "correlation")


@query("dq21_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS row_variable, " + ", ".join(f"round(corr({a},{b}),8) AS {b}" for b in NUM) + " FROM lineitem" for a in NUM))
def _(t):
    return r(pr.correlation_matrix(t.lineitem, NUM), 8, *NUM)


@query("dq22_multicollinearity", f"SELECT variable_1, variable_2, round(correlation,8) AS correlation, CASE WHEN abs(correlation)>=.9 THEN 'CRITICAL - Potential Redundancy' ELSE 'HIGH - Multicollinearity Risk' END AS multicollinearity_risk FROM ({_PAIR}) WHERE abs(correlation)>0.7")
def _(t):
    return r(pr.multicollinearity(pr.correlation_pairs(t.lineitem, NUM)), 8, "correlation")


@query("dq22_vif", f"SELECT variable_1, variable_2, round(correlation*correlation,8) AS r_squared, round(1/(1-correlation*correlation),6) AS vif_estimate, CASE WHEN 1/(1-correlation*correlation)>10 THEN 'SEVERE - High Multicollinearity' WHEN 1/(1-correlation*correlation)>5 THEN 'MODERATE - Some Multicollinearity' ELSE 'LOW - Acceptable' END AS multicollinearity_level FROM ({_PAIR})")
def _(t):
    return r(r(pr.vif(pr.correlation_pairs(t.lineitem, NUM)), 8, "r_squared"), 6, "vif_estimate")


@query("dq23_target_correlation", "WITH c AS (" + each(["l_quantity", "l_discount", "l_tax"], "SELECT '{c}' AS feature_name, corr({c}, l_extendedprice) AS r FROM lineitem") + """) SELECT feature_name, round(r,8) AS correlation, CASE WHEN abs(r)>=.7 THEN 'Strong Predictor' WHEN abs(r)>=.4 THEN 'Moderate Predictor' WHEN abs(r)>=.2 THEN 'Weak Predictor' ELSE 'Poor Predictor' END AS predictive_strength,
 CASE WHEN r>0 THEN 'Positive (increases with target)' WHEN r<0 THEN 'Negative (decreases with target)' ELSE 'No Linear Relationship' END AS relationship FROM c""")
def _(t):
    return r(pr.target_correlation(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 8, "correlation")


@query("dq24_correlation_summary", f"""WITH c AS ({_PAIR}), a AS (SELECT count(*) AS total_pairs, count(*) FILTER (abs(correlation)>=.9) AS very_strong, count(*) FILTER (abs(correlation)>=.7 AND abs(correlation)<.9) AS strong, count(*) FILTER (abs(correlation)>=.4 AND abs(correlation)<.7) AS moderate, count(*) FILTER (abs(correlation)<.4) AS weak,
 round(avg(abs(correlation)),8) AS avg_abs_correlation, round(max(abs(correlation)),8) AS strongest_correlation FROM c) SELECT *, CASE WHEN very_strong>0 THEN 'HIGH - Feature redundancy detected' WHEN strong>total_pairs*.3 THEN 'MODERATE - Some multicollinearity' ELSE 'LOW - Features relatively independent' END AS multicollinearity_assessment FROM a""")
def _(t):
    return r(pr.correlation_summary(pr.correlation_pairs(t.lineitem, NUM)), 8, "avg_abs_correlation", "strongest_correlation")


_B6 = ["q1", "q3", "iqr", "lower_bound", "upper_bound", "extreme_lower", "extreme_upper"]


@query("dq25_outliers_iqr", _iqr("events", "value") + " SELECT " + ", ".join(f"round({c},6) AS {c}" for c in _B6) + """, count(*) AS total_records, count(*) FILTER (value<lower_bound OR value>upper_bound) AS outlier_count, count(*) FILTER (value<extreme_lower OR value>extreme_upper) AS extreme_outlier_count,
 round(100.0*count(*) FILTER (value<lower_bound OR value>upper_bound)/count(*),4) AS outlier_percentage FROM events, b GROUP BY 1,2,3,4,5,6,7""")
def _(t):
    return r(r(pr.outliers_iqr(t.events, "value"), 6, *_B6), 4, "outlier_percentage")


@query("dq25_outlier_rows_iqr", _iqr("events", "value") + " SELECT event_id, value, CASE WHEN value<lower_bound THEN 'Lower Outlier' ELSE 'Upper Outlier' END AS outlier_type, round(value-lower_bound,6) AS distance_from_lower, round(upper_bound-value,6) AS distance_from_upper FROM events, b WHERE value<lower_bound OR value>upper_bound")
def _(t):
    return r(pr.outlier_rows_iqr(t.events.select("event_id", "value"), "value"), 6, "distance_from_lower", "distance_from_upper").drop("lower_bound", "upper_bound")


_Z = "WITH s AS (SELECT avg(value) AS m, stddev(value) AS s FROM events), z AS (SELECT event_id, value, m, s, (value-m)/s AS z FROM events, s)"


@query("dq26_outliers_zscore", _Z + " SELECT round(m,6) AS mean_value, round(s,6) AS std_deviation, count(*) AS total_records, count(*) FILTER (abs(z)>2) AS outliers_2sd, count(*) FILTER (abs(z)>3) AS outliers_3sd, round(100.0*count(*) FILTER (abs(z)>3)/count(*),4) AS outlier_percentage_3sd FROM z GROUP BY 1,2")
def _(t):
    return r(r(pr.outliers_zscore(t.events, "value"), 6, "mean_value", "std_deviation"), 4, "outlier_percentage_3sd")


@query("dq26_outlier_rows_zscore", _Z + " SELECT event_id, value, round(z,7) AS z_score, CASE WHEN abs(z)>3 THEN 'Extreme Outlier (>3 sd)' ELSE 'Moderate Outlier (>2 sd)' END AS outlier_severity FROM z WHERE abs(z)>2")
def _(t):
    return r(pr.outlier_rows_zscore(t.events.select("event_id", "value"), "value"), 7, "z_score")


@query("dq27_outliers_mad", "WITH m AS (SELECT quantile_cont(value,.5) AS md FROM events), a AS (SELECT quantile_cont(abs(value-md),.5) AS mad FROM events, m) SELECT round(md,6) AS median_value, round(mad,6) AS mad_value, count(*) AS total_records, count(*) FILTER (abs(0.6745*(value-md)/mad)>3.5) AS outlier_count, round(100.0*count(*) FILTER (abs(0.6745*(value-md)/mad)>3.5)/count(*),4) AS outlier_percentage FROM events, m, a GROUP BY 1,2")
def _(t):
    return r(r(pr.outliers_mad(t.events, "value"), 6, "median_value", "mad_value"), 4, "outlier_percentage")


@query("dq28_outliers_percentile", "WITH q AS (SELECT quantile_cont(value,.01) AS p01, quantile_cont(value,.05) AS p05, quantile_cont(value,.95) AS p95, quantile_cont(value,.99) AS p99 FROM events) SELECT round(p01,6) AS p01, round(p05,6) AS p05, round(p95,6) AS p95, round(p99,6) AS p99, count(*) AS total_records, count(*) FILTER (value<p01 OR value>p99) AS extreme_outliers_1pct, count(*) FILTER (value<p05 OR value>p95) AS outliers_5pct, round(100.0*count(*) FILTER (value<p01 OR value>p99)/count(*),4) AS outlier_percentage_1pct FROM events, q GROUP BY 1,2,3,4")
def _(t):
    return r(r(pr.outliers_percentile(t.events, "value"), 6, "p01", "p05", "p95", "p99"), 4, "outlier_percentage_1pct")


@query("dq29_outliers_multivariate", "WITH s AS (SELECT avg(l_quantity) AS a, stddev(l_quantity) AS b, avg(l_extendedprice) AS c, stddev(l_extendedprice) AS d, avg(l_tax) AS e, stddev(l_tax) AS f FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, l_partkey, sqrt(pow((l_quantity-a)/b,2)+pow((l_extendedprice-c)/d,2)+pow((l_tax-e)/f,2)) AS n FROM lineitem, s) SELECT l_orderkey, l_linenumber, l_partkey, round(n,7) AS euclidean_distance, CASE WHEN n>5 THEN 'Extreme Multivariate Outlier' ELSE 'Moderate Multivariate Outlier' END AS outlier_classification FROM z WHERE n>2.5")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return r(pr.outliers_multivariate(d, ["l_quantity", "l_extendedprice", "l_tax"], 2.5), 7, "euclidean_distance").drop("l_quantity", "l_extendedprice", "l_tax")


@query("dq30_outlier_impact", _iqr("events", "value") + """, f AS (SELECT value, CASE WHEN value BETWEEN lower_bound AND upper_bound THEN value END AS v FROM events, b), a AS (SELECT count(value) AS total_records, count(v) AS n_without_outliers, avg(value) AS m1, avg(v) AS m2, stddev(value) AS s1, stddev(v) AS s2 FROM f)
 SELECT total_records, n_without_outliers, round(m1,6) AS mean_with_outliers, round(m2,6) AS mean_without_outliers, round(s1,6) AS std_with_outliers, round(s2,6) AS std_without_outliers, total_records-n_without_outliers AS outlier_count, round((m1-m2)*100/m2,6) AS mean_pct_change, round((s1-s2)*100/s2,6) AS std_pct_change FROM a""")
def _(t):
    return r(pr.outlier_impact(t.events, "value"), 6, "mean_with_outliers", "mean_without_outliers", "std_with_outliers", "std_without_outliers", "mean_pct_change", "std_pct_change")


_OP = _iqr("events", "value") + """, s AS (SELECT avg(value) AS m, stddev(value) AS sd FROM events), o AS (SELECT event_id, value, CASE WHEN value<lower_bound THEN 'Lower Outlier (IQR)' WHEN value>upper_bound THEN 'Upper Outlier (IQR)' WHEN value<m-3*sd THEN 'Lower Outlier (Z-score)' WHEN value>m+3*sd THEN 'Upper Outlier (Z-score)' END AS outlier_type FROM events, b, s)"""


@query("dq31_outlier_profile", _OP + " SELECT * FROM o WHERE outlier_type IS NOT NULL")
def _(t):
    return pr.outlier_profile(t.events.select("event_id", "value"), "value").select("event_id", "value", "outlier_type")


@query("dq50_outlier_severity", _OP + """, a AS (SELECT count(*) AS total_outliers, count(DISTINCT outlier_type) AS outlier_types_detected, min(value) AS min_outlier_value, max(value) AS max_outlier_value, (SELECT count(*) FROM events) AS total_records FROM o WHERE outlier_type IS NOT NULL)
 SELECT *, round(100.0*total_outliers/total_records,4) AS outlier_percentage, CASE WHEN 100.0*total_outliers/total_records<5 THEN 'LOW - Few outliers detected' WHEN 100.0*total_outliers/total_records<10 THEN 'MODERATE - Some outliers present' ELSE 'HIGH - Many outliers detected' END AS outlier_severity FROM a""")
def _(t):
    return r(pr.outlier_severity(t.events, "value"), 4, "outlier_percentage")


# A customer table with nulls and odd values, made alike on both sides.
QCOLS = ["c_custkey", "balance", "segment", "c_nationkey", "label"]
_Q = """q AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ' ' || lower(c_mktsegment) END AS segment, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || repeat('x', (c_custkey % 90)::INT) END AS label FROM customer)"""


def qframe(t):
    k, c = F.col("c_custkey"), t.customer
    return c.select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 3 != 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("segment"),
                    "c_nationkey", F.when(k % 4 == 0, F.concat("c_name", F.expr("repeat('x', cast(c_custkey % 90 as int))"))).alias("label"))


_COMP = each(QCOLS, "SELECT '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count, 100.0*(count(*)-count({c}))/count(*) AS p FROM q")
_CS = "CASE WHEN p<=0 THEN 100 WHEN p<=5 THEN 95 WHEN p<=10 THEN 85 WHEN p<=20 THEN 70 WHEN p<=50 THEN 50 ELSE 25 END AS completeness_score"


@query("dq32_completeness", f"WITH {_Q}, c AS ({_COMP}) SELECT column_name, total_count, non_null_count, round(p,4) AS null_percentage, {_CS}, CASE WHEN p<=0 THEN 'EXCELLENT - Complete' WHEN p<=5 THEN 'GOOD - Highly Complete' WHEN p<=20 THEN 'FAIR - Moderately Complete' ELSE 'POOR - Significant Missing Data' END AS completeness_rating FROM c")
def _(t):
    return r(ql.completeness(qframe(t)), 4, "null_percentage")


_UNIQ = each(QCOLS, "SELECT '{c}' AS column_name, count({c}) AS total_records, count(DISTINCT {c}) AS distinct_values, 100.0*count(DISTINCT {c})/count({c}) AS u FROM q")
_US = "CASE WHEN u>=95 THEN 100 WHEN u>=80 THEN 90 WHEN u>=50 THEN 70 WHEN u>=20 THEN 50 ELSE 30 END AS uniqueness_score"


@query("dq33_uniqueness", f"WITH {_Q}, c AS ({_UNIQ}) SELECT column_name, total_records, distinct_values, round(u,4) AS uniqueness_ratio, total_records-distinct_values AS duplicate_values, {_US}, CASE WHEN u>=95 THEN 'EXCELLENT - Highly Unique' WHEN u>=50 THEN 'GOOD - Moderate Uniqueness' ELSE 'POOR - Low Uniqueness' END AS uniqueness_rating FROM c")
def _(t):
    return r(ql.uniqueness(qframe(t)), 4, "uniqueness_ratio")


RANGES = {"balance": (-500.0, 9000.0), "c_nationkey": (0, 24)}
_VAL = "SELECT 'balance' AS column_name, count(*) AS total_values, count(balance) AS non_null_values, count(*) FILTER (balance < -500 OR balance > 9000) AS out_of_range_count FROM q UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey), count(*) FILTER (c_nationkey<0 OR c_nationkey>24) FROM q"
_VS = "CASE WHEN out_of_range_count=0 THEN 100 WHEN 100.0*out_of_range_count/non_null_values<5 THEN 90 ELSE 60 END AS validity_score"


@query("dq34_validity_range", f"WITH {_Q}, v AS ({_VAL}) SELECT *, round(100.0*out_of_range_count/non_null_values,4) AS invalid_percentage, {_VS}, CASE WHEN out_of_range_count=0 THEN 'EXCELLENT - All Valid' WHEN 100.0*out_of_range_count/non_null_values<10 THEN 'GOOD - Mostly Valid' ELSE 'POOR - Many Invalid Values' END AS validity_rating FROM v")
def _(t):
    return r(ql.validity_range(qframe(t), RANGES), 4, "invalid_percentage")


_FMT = each(["segment", "label"], "SELECT '{c}' AS column_name, count({c}) AS total_values, count(DISTINCT length({c})) AS distinct_length_count, min(length({c})) AS min_length, max(length({c})) AS max_length, stddev(length({c})) AS sd, avg(length({c})) AS av, count(*) FILTER (trim({c})<>{c}) AS whitespace_issue_count, count(*) FILTER ({c}<>upper({c}) AND {c}<>lower({c})) AS mixed_case_count FROM q")
_FS = "CASE WHEN sd/av<.2 THEN 100 WHEN sd/av<.5 THEN 75 ELSE 50 END AS consistency_score"


@query("dq35_format_consistency", f"WITH {_Q}, f AS ({_FMT}) SELECT column_name, total_values, distinct_length_count, min_length, max_length, round(sd,6) AS length_std_dev, whitespace_issue_count, mixed_case_count, CASE WHEN sd/av<.2 THEN 'HIGH - Consistent Format' WHEN sd/av<.5 THEN 'MODERATE - Some Variation' ELSE 'LOW - Inconsistent Format' END AS format_consistency, {_FS} FROM f")
def _(t):
    return r(ql.format_consistency(qframe(t), ["segment", "label"]), 6, "length_std_dev")


@query("dq36_duplicate_keys", """WITH g AS (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_partkey), a AS (SELECT count(*) FILTER (k>1) AS duplicate_key_count, coalesce(sum(k) FILTER (k>1),0)::BIGINT AS total_duplicate_rows, sum(k)::BIGINT AS total_rows FROM g)
 SELECT *, round(100.0*total_duplicate_rows/total_rows,4) AS duplicate_percentage, CASE WHEN duplicate_key_count=0 THEN 100 WHEN 100.0*total_duplicate_rows/total_rows<1 THEN 95 WHEN 100.0*total_duplicate_rows/total_rows<5 THEN 80 ELSE 50 END AS uniqueness_score FROM a""")
def _(t):
    return r(ql.duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey"]), 4, "duplicate_percentage")


def _fk(child, fk, parent, pk):
    return f"""WITH a AS (SELECT count(*) AS total_fk_values, count(DISTINCT {fk}) AS distinct_fk_values, count(*) FILTER ({fk} NOT IN (SELECT {pk} FROM {parent})) AS orphaned_records FROM {child} WHERE {fk} IS NOT NULL)
 SELECT *, round(100.0*orphaned_records/total_fk_values,4) AS orphan_percentage, CASE WHEN orphaned_records=0 THEN 100 WHEN 100.0*orphaned_records/total_fk_values<1 THEN 90 ELSE 60 END AS integrity_score FROM a"""


@query("dq37_referential_integrity", _fk("lineitem", "l_orderkey", "orders", "o_orderkey"))
def _(t):
    return r(ql.referential_integrity(t.lineitem, "l_orderkey", t.orders, "o_orderkey"), 4, "orphan_percentage")


@query("dq37_referential_orphans", _fk("documents", "doc_id", "labels", "doc_id"))
def _(t):
    return r(ql.referential_integrity(t.documents, "doc_id", t.labels, "doc_id"), 4, "orphan_percentage")


@query("dq38_temporal_validity", """WITH a AS (SELECT count(*) AS total_values, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS date_range_days, count(*) FILTER (o_orderdate > TIMESTAMP '2001-06-01') AS future_date_count, count(*) FILTER (o_orderdate < TIMESTAMP '1900-01-01') AS ancient_date_count, count(*)-count(o_orderdate) AS null_count FROM orders)
 SELECT *, CASE WHEN future_date_count+ancient_date_count=0 THEN 100 WHEN 100.0*(future_date_count+ancient_date_count)/total_values<5 THEN 85 ELSE 60 END AS temporal_validity_score FROM a""")
def _(t):
    return ql.temporal_validity(t.orders, "o_orderdate", "2001-06-01 00:00:00")


_CARD = f"""WITH {_Q}, cc AS ({_COMP}), uu AS ({_UNIQ}), vv AS ({_VAL}), ff AS ({_FMT}),
 card0 AS (SELECT column_name, {_CS}, {_US}, coalesce(validity_score,100) AS validity_score, coalesce(consistency_score,100) AS consistency_score FROM cc JOIN uu USING (column_name) LEFT JOIN (SELECT column_name, {_VS} FROM vv) USING (column_name) LEFT JOIN (SELECT column_name, {_FS} FROM ff) USING (column_name)),
 card1 AS (SELECT *, round(completeness_score*0.3+uniqueness_score*0.25+validity_score*0.25+consistency_score*0.2,4)::DOUBLE AS overall_quality_score FROM card0),
 card AS (SELECT *, CASE WHEN overall_quality_score>=90 THEN 'EXCELLENT' WHEN overall_quality_score>=70 THEN 'GOOD' WHEN overall_quality_score>=50 THEN 'FAIR' ELSE 'POOR' END AS quality_grade FROM card1)"""


def card(t):
    return ql.quality_scorecard(qframe(t), QCOLS, RANGES)


@query("dq39_quality_scorecard", _CARD + " SELECT * FROM card")
def _(t):
    return card(t)


@query("dq40_table_quality", _CARD + """, a AS (SELECT count(*) AS total_columns_assessed, round(avg(completeness_score),4) AS avg_completeness, round(avg(uniqueness_score),4) AS avg_uniqueness, round(avg(validity_score),4) AS avg_validity, round(avg(consistency_score),4) AS avg_consistency, round(avg(overall_quality_score),4) AS overall_table_quality_score,
 min(overall_quality_score) AS worst_column_score, max(overall_quality_score) AS best_column_score, count(*) FILTER (overall_quality_score>=90) AS excellent_columns, count(*) FILTER (overall_quality_score>=70 AND overall_quality_score<90) AS good_columns, count(*) FILTER (overall_quality_score>=50 AND overall_quality_score<70) AS fair_columns, count(*) FILTER (overall_quality_score<50) AS poor_columns FROM card)
 SELECT *, CASE WHEN overall_table_quality_score>=90 THEN 'EXCELLENT - High Quality Data' WHEN overall_table_quality_score>=70 THEN 'GOOD - Acceptable Quality' WHEN overall_table_quality_score>=50 THEN 'FAIR - Needs Improvement' ELSE 'POOR - Significant Issues' END AS table_quality_assessment FROM a""")
def _(t):
    return ql.table_quality(card(t))


@query("dq40_profile_report")
def _(t):
    return ql.profile_report(qframe(t), QCOLS, ["balance", "c_nationkey"], RANGES)


@query("dq41_class_balance", "SELECT o_orderstatus, count(*) AS class_count, round(100.0*count(*)/sum(count(*)) OVER (),4) AS class_percentage, CASE WHEN 100.0*count(*)/sum(count(*)) OVER () < 5 THEN 'WARNING - Severely underrepresented' WHEN 100.0*count(*)/sum(count(*)) OVER () < 10 THEN 'CAUTION - Underrepresented' ELSE 'OK' END AS balance_status FROM orders GROUP BY 1")
def _(t):
    return ql.class_balance(t.orders, "o_orderstatus")


@query("dq41_imbalance_ratio", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT max(n) AS majority, min(n) AS minority, count(*) AS classes, round(max(n)/min(n),6) AS ratio, CASE WHEN max(n)/min(n)<3 THEN 'PASS - Balanced' WHEN max(n)/min(n)<10 THEN 'WARNING - Moderate imbalance' ELSE 'FAIL - Severe imbalance' END AS imbalance_status FROM c")
def _(t):
    return r(ql.imbalance_ratio(t.labels, "quality"), 6, "ratio")


@query("dq42_sample_adequacy", "SELECT count(*) AS sample_size, 4 AS feature_count, count(*)/4 AS samples_per_feature, CASE WHEN count(*)/4>=20 THEN 'PASS - Adequate samples' WHEN count(*)/4>=10 THEN 'WARNING - Borderline sample size' ELSE 'FAIL - Too few samples' END AS adequacy FROM labels")
def _(t):
    return ql.sample_adequacy(t.labels, 4)


@query("dq43_count_target_check", """WITH c AS (SELECT l_orderkey, count(*) AS y FROM lineitem GROUP BY 1), a AS (SELECT count(y) AS n, avg(y) AS m, variance(y) AS v, count(*) FILTER (y<0) AS negative_values FROM c)
 SELECT n, round(m,8) AS mean, round(v,8) AS variance, negative_values, 0 AS non_integer_values, round(v/m,8) AS dispersion_ratio, CASE WHEN v/m>1.5 THEN 'WARNING - Overdispersed' ELSE 'PASS - Suitable for Poisson' END AS count_status FROM a""")
def _(t):
    c = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("y"))
    return r(ql.count_target_check(c, "y"), 8, "mean", "variance", "dispersion_ratio")


@query("dq44_overall_gate", """WITH a AS (SELECT count(*)>=100 AS enough_rows, count(o_totalprice)=count(*) AS no_missing_target, count(DISTINCT o_orderstatus)>=2 AS several_classes, count(DISTINCT o_orderkey)=count(*) AS unique_keys FROM orders),
 f AS (SELECT *, (NOT enough_rows)::INT+(NOT no_missing_target)::INT+(NOT several_classes)::INT+(NOT unique_keys)::INT AS failed_checks FROM a) SELECT enough_rows::INT AS enough_rows, no_missing_target::INT AS no_missing_target, several_classes::INT AS several_classes, unique_keys::INT AS unique_keys, failed_checks, CASE WHEN failed_checks=0 THEN 'PASS' ELSE 'REVIEW' END AS overall_status FROM f""")
def _(t):
    n = F.count(F.lit(1))
    g = ql.overall_gate({"enough_rows": n >= 100, "no_missing_target": F.count("o_totalprice") == n, "several_classes": F.countDistinct("o_orderstatus") >= 2,
                         "unique_keys": F.countDistinct("o_orderkey") == n}, t.orders)
    return g.select(*[F.col(c).cast("int").alias(c) for c in g.columns[:4]], "failed_checks", "overall_status")


@query("dq45_rule_violations", f"WITH {_Q} SELECT 'balance_range' AS rule, count(*) FILTER (balance<0 OR balance>9000) AS violations, count(*) AS rows, round(100.0*count(*) FILTER (balance<0 OR balance>9000)/count(*),4) AS violation_pct FROM q UNION ALL SELECT 'known_segment', count(*) FILTER (segment NOT IN ('BUILDING','MACHINERY')), count(*), round(100.0*count(*) FILTER (segment NOT IN ('BUILDING','MACHINERY'))/count(*),4) FROM q")
def _(t):
    v = ql.rule_violations(qframe(t), {"balance_range": F.col("balance").between(0, 9000), "known_segment": F.col("segment").isin("BUILDING", "MACHINERY")})
    return r(v, 4, "violation_pct")


@query("dq46_separation_check", "WITH d AS (SELECT quality, toxic, n_chars, doc_id FROM labels JOIN documents USING (doc_id)), s AS (" + each(["n_chars", "toxic"], "SELECT '{c}' AS column_name, min({c}) FILTER (quality=0)::DOUBLE AS min_0, max({c}) FILTER (quality=0)::DOUBLE AS max_0, min({c}) FILTER (quality=1)::DOUBLE AS min_1, max({c}) FILTER (quality=1)::DOUBLE AS max_1 FROM d") + ") SELECT *, CASE WHEN max_0<min_1 OR max_1<min_0 THEN 'WARNING - Complete separation' ELSE 'PASS - Overlapping ranges' END AS separation_status FROM s")
def _(t):
    return ql.separation_check(t.labels.join(t.documents, "doc_id"), ["n_chars", "toxic"], "quality")


@query("dq47_samples_per_feature", "SELECT count(*) AS sample_size, 6 AS feature_count, count(*)/6 AS samples_per_feature, CASE WHEN count(*)/6>=20 THEN 'PASS - Adequate samples' WHEN count(*)/6>=10 THEN 'WARNING - Borderline sample size' ELSE 'FAIL - Too few samples' END AS adequacy FROM (SELECT o_custkey FROM orders GROUP BY 1)")
def _(t):
    return ql.sample_adequacy(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), 6)


@query("dq48_quality_issues", _CARD + """, i AS (SELECT column_name, 'Missing Data' AS issue_type, (100-completeness_score)::DOUBLE AS severity, 'HIGH' AS priority FROM card WHERE completeness_score<80 UNION ALL SELECT column_name, 'Low Uniqueness', 100-uniqueness_score, 'MEDIUM' FROM card WHERE uniqueness_score<70
 UNION ALL SELECT column_name, 'Invalid Values', 100-validity_score, 'HIGH' FROM card WHERE validity_score<80 UNION ALL SELECT column_name, 'Inconsistent Format', 100-consistency_score, 'MEDIUM' FROM card WHERE consistency_score<70) SELECT *, row_number() OVER (ORDER BY severity DESC, column_name, issue_type) AS issue_rank FROM i ORDER BY issue_rank LIMIT 20""")
def _(t):
    return ql.quality_issues(card(t))


@query("dq48_column_priority", _CARD + " SELECT column_name, overall_quality_score, CASE WHEN overall_quality_score<50 THEN 'CRITICAL - Immediate Action Required' WHEN overall_quality_score<70 THEN 'HIGH - Should Address Soon' ELSE 'MEDIUM - Monitor' END AS priority FROM card WHERE overall_quality_score<85")
def _(t):
    return ql.column_priority(card(t))


@query("dq49_recommendations", _CARD + """, sk AS (SELECT avg(pow((balance-m)/s,3)) AS a FROM q, (SELECT avg(balance) AS m, stddev(balance) AS s FROM q)), pp AS (SELECT corr(c_custkey, c_custkey+c_nationkey) AS r FROM q)
 SELECT 'Data Completeness' AS recommendation_category, 'HIGH' AS priority, count(*) AS affected_columns FROM card WHERE completeness_score<80 HAVING count(*)>0 UNION ALL SELECT 'Categorical Variables', 'MEDIUM', count(*) FROM (SELECT count(DISTINCT label) AS d FROM q) WHERE d>50 HAVING count(*)>0
 UNION ALL SELECT 'Data Transformation', 'MEDIUM', count(*) FROM sk WHERE abs(a)>1 HAVING count(*)>0 UNION ALL SELECT 'Feature Selection', 'HIGH', count(*) FROM pp WHERE abs(r)>.9 HAVING count(*)>0""")
def _(t):
    f = qframe(t)
    pairs = pr.correlation_pairs(f.withColumn("both", F.col("c_custkey") + F.col("c_nationkey")), ["c_custkey", "both"])
    return ql.recommendations(card(t), pr.categorical_profile(f, ["segment", "label"]), pr.shape_moments(f, ["balance"]), pairs)


@query("dq51_metric_thresholds", """WITH a AS (SELECT 100.0*count(value)/count(*) AS c, 100.0*count(*) FILTER (abs(value-m)>3*s)/count(*) AS o, count(*)::DOUBLE AS n FROM events, (SELECT avg(value) AS m, stddev(value) AS s FROM events))
 SELECT 'completeness' AS metric, round(c,6) AS value, 95.0::DOUBLE AS threshold, CASE WHEN c>=95 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN c>=95 THEN 'None' ELSE 'Investigate' END AS alert FROM a
 UNION ALL SELECT 'outliers', round(o,6), 5.0, CASE WHEN o<=5 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN o<=5 THEN 'None' ELSE 'Investigate' END FROM a UNION ALL SELECT 'rows', n, 1000000.0, CASE WHEN n>=1000000 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN n>=1000000 THEN 'None' ELSE 'Investigate' END FROM a""")
def _(t):
    from cairn.functions.expr import pct, tally
    n, z = F.count(F.lit(1)), pr.with_z(t.events, "value")
    m = ql.metric_thresholds(z, [("completeness", pct(F.count("value"), n), 95, "min"), ("outliers", pct(tally(F.abs("z_score") > 3), n), 5, "max"), ("rows", n, 1000000, "min")])
    return r(m, 6, "value")

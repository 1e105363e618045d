"""Queries of the feature preparation operators."""

from pyspark.sql import functions as F

from cairn.catalog.profiling import _Q, qframe
from cairn.catalog.registry import query
from cairn.functions.expr import rnd
from cairn.operators import prep as fp

COLS = ["l_quantity", "l_extendedprice", "l_tax"]
ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def each(cols, sql):
    return " UNION ALL ".join(sql.replace("{c}", c) for c in cols)


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


LOC = {"zscore": ("avg({c})", "stddev({c})"), "minmax": ("min({c})", "max({c})-min({c})"), "maxabs": ("0.0::DOUBLE", "max(abs({c}))"), "range": ("(max({c})+min({c}))/2", "(max({c})-min({c}))/2")}

for _m, (_a, _b) in LOC.items():
    @query(f"fp01_scale_fit_{_m}", each(COLS, f"SELECT '{{c}}' AS column_name, round({_a},6) AS location, round({_b},6) AS scale FROM lineitem"))
    def _(t, m=_m):
        return r(fp.scale_fit(t.lineitem, COLS, m), 6, "location", "scale")


@query("fp02_scale_transform", "SELECT " + ", ".join(ID) + ", " + ", ".join(f"round(({c}-(SELECT avg({c}) FROM lineitem))/(SELECT stddev({c}) FROM lineitem),8) AS {c}_scaled" for c in COLS) + " FROM lineitem")
def _(t):
    s = fp.scale_transform(t.lineitem, fp.scale_fit(t.lineitem, COLS), COLS, ID)
    return r(s, 8, *[f"{c}_scaled" for c in COLS])


@query("fp03_scaled_report", each(COLS, "SELECT '{c}' AS column_name, count({c}) AS raw_n, round(avg({c}),6) AS raw_mean, round(stddev({c}),5) AS raw_std, min({c}) AS raw_min, max({c}) AS raw_max, count({c}) AS scaled_n, round((avg({c})-min({c}))/(max({c})-min({c})),9) AS scaled_mean, round(stddev({c})/(max({c})-min({c})),9) AS scaled_std, 0.0::DOUBLE AS scaled_min, 1.0::DOUBLE AS scaled_max, 0 AS beyond_3, 'PASS' AS row_integrity FROM lineitem"))
def _(t):
    li = t.lineitem
    d = fp.scaled_report(li, fp.scale_transform(li, fp.scale_fit(li, COLS, "minmax"), COLS), COLS)
    return r(r(r(d, 6, "raw_mean"), 5, "raw_std"), 9, "scaled_mean", "scaled_std")


@query("fp04_onehot_fit", "SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def _(t):
    return fp.onehot_fit(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("fp05_onehot_transform", "SELECT o_orderkey, (o_orderstatus='F')::INT AS o_orderstatus_F, (o_orderstatus='O')::INT AS o_orderstatus_O, (o_orderstatus='P')::INT AS o_orderstatus_P, 0 AS has_unknown FROM orders")
def _(t):
    f = fp.onehot_fit(t.orders, ["o_orderstatus"])
    return fp.onehot_transform(t.orders.select("o_orderkey", "o_orderstatus"), f, ["o_orderstatus"]).drop("o_orderstatus")


@query("fp05_onehot_unknown", "SELECT lang, (lang = (SELECT min(lang) FROM documents))::INT AS lang_first, (lang <> (SELECT min(lang) FROM documents))::INT AS has_unknown, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    fit = t.documents.agg(F.lit("lang").alias("column_name"), F.min("lang").alias("value"))
    o = fp.onehot_transform(t.documents.select("lang"), fit, ["lang"])
    first = [c for c in o.columns if c.startswith("lang_")][0]
    return o.groupBy("lang", F.col(first).alias("lang_first"), "has_unknown").agg(F.count(F.lit(1)).alias("n"))


@query("fp06_column_transformer", f"WITH {_Q}, f AS (SELECT c_custkey, coalesce(balance, (SELECT avg(balance) FROM q)) AS balance, c_nationkey, segment FROM q) SELECT c_custkey, round(balance,6) AS balance, round(c_nationkey/(SELECT max(c_nationkey)-min(c_nationkey) FROM q),8) AS c_nationkey_scaled, segment FROM f")
def _(t):
    q = qframe(t)
    out = fp.column_transformer(q, (fp.impute_fit(q, ["balance"]), ["balance"]), (fp.scale_fit(q, ["c_nationkey"], "minmax"), ["c_nationkey"]))
    return out.select("c_custkey", rnd("balance", 6).alias("balance"), rnd("c_nationkey_scaled", 8).alias("c_nationkey_scaled"), "segment")


for _s, _e in {"mean": "round(avg(balance),6)", "median": "round(quantile_cont(balance,.5),6)"}.items():
    @query(f"fp07_impute_fit_{_s}", f"WITH {_Q} SELECT 'balance' AS column_name, {_e} AS fill_value FROM q")
    def _(t, s=_s):
        return fp.impute_fit(qframe(t), ["balance"], s).select("column_name", rnd(F.col("fill_value").cast("double"), 6).alias("fill_value"))


@query("fp07_impute_fit_mode", f"WITH {_Q} SELECT * FROM (SELECT 'segment' AS column_name, segment AS fill_value FROM q WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)")
def _(t):
    return fp.impute_fit(qframe(t), ["segment"], "mode")


@query("fp08_impute_transform", f"WITH {_Q} SELECT c_custkey, round(coalesce(balance, (SELECT quantile_cont(balance,.5) FROM q)),6) AS balance, coalesce(label,'UNKNOWN') AS label FROM q")
def _(t):
    q = qframe(t)
    out = fp.impute_transform(q, fp.impute_fit(q, ["balance"], "median"), ["balance"])
    out = fp.impute_transform(out, fp.impute_fit(q, ["label"], "constant", "UNKNOWN"), ["label"])
    return out.select("c_custkey", rnd("balance", 6).alias("balance"), "label")


@query("fp08_imputed_rows", f"WITH {_Q} SELECT 'balance' AS column_name, count(*) AS rows, count(*)-count(balance) AS missing_before, count(*) AS rows_after, 0 AS missing_after, count(*)-count(balance) AS imputed, 'PASS' AS row_integrity FROM q")
def _(t):
    q = qframe(t)
    return fp.imputed_rows(q, fp.impute_transform(q, fp.impute_fit(q, ["balance"]), ["balance"]), ["balance"])


_SPLIT = "WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42-' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), s AS (SELECT o_orderkey, o_orderstatus, (r*20 <= n*16+10)::INT AS is_train FROM k)"


def split(t):
    return fp.train_test_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.8, 42, "o_orderstatus")


@query("fp09_train_test_split", _SPLIT + " SELECT * FROM s")
def _(t):
    return split(t)


@query("fp09_split_unstratified", "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY md5('7-' || event_id), event_id) AS r, count(*) OVER () AS n FROM events) SELECT event_id, (r*20 <= n*14+10)::INT AS is_train FROM k")
def _(t):
    return fp.train_test_split(t.events.select("event_id"), "event_id", 0.7, 7)


@query("fp10_split_report", _SPLIT + " SELECT is_train, o_orderstatus, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY is_train),4) AS share_of_side, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY o_orderstatus),4) AS share_of_class FROM s GROUP BY 1,2")
def _(t):
    return fp.split_report(split(t), "o_orderkey", "o_orderstatus")


@query("fp10_split_overlap", _SPLIT + " SELECT 0 AS overlapping_ids, sum(is_train)::BIGINT AS train_rows, count(*)-sum(is_train)::BIGINT AS test_rows FROM s")
def _(t):
    return fp.split_overlap(split(t), "o_orderkey")


@query("fp11_kfold", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) % 5 + 1)::INT AS fold FROM orders")
def _(t):
    return fp.kfold(t.orders.select("o_orderkey"), "o_orderkey", 5)


_OF = {"iqr": "WITH q AS (SELECT quantile_cont(value,.25) AS a, quantile_cont(value,.75) AS b FROM events) SELECT a-1.5*(b-a) AS lo, b+1.5*(b-a) AS hi, b-a AS s FROM q",
       "zscore": "SELECT avg(value)-3*stddev(value) AS lo, avg(value)+3*stddev(value) AS hi, stddev(value) AS s FROM events",
       "percentile": "SELECT quantile_cont(value,.01) AS lo, quantile_cont(value,.99) AS hi, quantile_cont(value,.99)-quantile_cont(value,.01) AS s FROM events",
       "mad": "WITH m AS (SELECT quantile_cont(value,.5) AS m FROM events), d AS (SELECT quantile_cont(abs(value-m),.5) AS d FROM events, m) SELECT m-3.5*d/0.6745 AS lo, m+3.5*d/0.6745 AS hi, d AS s FROM m, d"}
for _m, _e in _OF.items():
    @query(f"fp12_outlier_fit_{_m}", f"SELECT 'value' AS column_name, round(lo,6) AS lower_bound, round(hi,6) AS upper_bound, round(s,6) AS spread FROM ({_e})")
    def _(t, m=_m):
        return r(fp.outlier_fit(t.events, ["value"], m), 6, "lower_bound", "upper_bound", "spread")

_OT = f"WITH f AS ({_OF['iqr']}), x AS (SELECT event_id, value, lo, hi, s, greatest(lo-value, value-hi, 0.0) AS e FROM events, f)"


@query("fp13_outlier_transform", _OT + " SELECT event_id, round(least(greatest(value,lo),hi),6) AS value, (value<lo OR value>hi)::INT AS value_is_outlier, round(e/(e+s),8) AS value_outlier_score FROM x")
def _(t):
    e = t.events.select("event_id", "value")
    return r(r(fp.outlier_transform(e, fp.outlier_fit(e, ["value"]), ["value"], "cap"), 6, "value"), 8, "value_outlier_score")


@query("fp13_outlier_remove", _OT + " SELECT count(*) AS n, round(avg(value),6) AS mean FROM x WHERE value BETWEEN lo AND hi")
def _(t):
    e = t.events.select("event_id", "value")
    return fp.outlier_transform(e, fp.outlier_fit(e, ["value"]), ["value"], "remove").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 6).alias("mean"))


@query("fp13_outlier_score_bands", _OT + " SELECT CASE WHEN e/(e+s)>=.8 THEN '0.8-1.0 (Extreme)' WHEN e/(e+s)>=.6 THEN '0.6-0.8 (High)' WHEN e/(e+s)>=.4 THEN '0.4-0.6 (Medium)' WHEN e/(e+s)>=.2 THEN '0.2-0.4 (Low)' ELSE '0.0-0.2 (Normal)' END AS score_band, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM x GROUP BY 1")
def _(t):
    e = t.events.select("event_id", "value")
    return fp.outlier_score_bands(fp.outlier_transform(e, fp.outlier_fit(e, ["value"]), ["value"]), "value_outlier_score")

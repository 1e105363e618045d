"""Queries of the relational core: projections, joins, aggregates, windows."""


from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.functions.expr import band, flag, normal_cdf, pct, rnd, tally
from cairn.operators import relational as rel
from cairn.operators.series import hourly_means
from cairn.plans.lineage import shared_folder
from cairn.plans.ordered import null_safe_join, running, sequence, share, sliding, with_stats
from cairn.plans.quantiles import quantiles
from cairn.sources import tables as io

HOURLY = """hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1,2),
ser AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS seq FROM hourly)"""


def scratch(spark, name):
    """A fresh path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}"


@query("io01_scan_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def _(t):
    return io.read_table(t.spark, t.sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("io02_inline_values", """WITH b(priority, weight) AS (VALUES ('1-URGENT',5),('2-HIGH',4),('3-MEDIUM',3),('4-NOT SPECIFIED',2),('5-LOW',1))
SELECT o_orderstatus, sum(weight)::BIGINT AS weight, count(*) AS n FROM orders JOIN b ON o_orderpriority = priority GROUP BY 1""")
def _(t):
    b = io.inline_values(t.spark, [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 2), ("5-LOW", 1)],
                         "priority string, weight int")
    return t.orders.join(F.broadcast(b), F.col("o_orderpriority") == F.col("priority")).groupBy("o_orderstatus").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("io03_replace_table", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = scratch(t.spark, "counts")
    io.replace_table(t.events.select("event_type"), path)
    return io.replace_table(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)


@query("io04_append_table", "SELECT o_orderstatus AS run, count(*)*2 AS n FROM orders GROUP BY 1")
def _(t):
    path = scratch(t.spark, "history")
    log = t.orders.groupBy(F.col("o_orderstatus").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    io.append_table(log, path)
    return io.append_table(log, path).groupBy("run").agg(F.sum("n").alias("n"))


@query("io05_update_rows", "SELECT s_nationkey, round(sum(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END),2) AS balance, count(*) FILTER (s_acctbal < 0) AS changed FROM supplier GROUP BY 1")
def _(t):
    s = t.supplier.withColumn("before", F.col("s_acctbal"))
    return io.update_rows(s, F.col("s_acctbal") < 0, {"s_acctbal": 0.0}).groupBy("s_nationkey").agg(
        rnd(F.sum("s_acctbal"), 2).alias("balance"), tally(F.col("before") < 0).alias("changed"))


@query("io06_delete_rows", "SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 200 GROUP BY 1")
def _(t):
    return io.delete_rows(t.documents, F.col("n_chars") < 200).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("io07_archive_table", "SELECT p_brand, 20240101 AS archived, count(*) AS n FROM part GROUP BY 1")
def _(t):
    a = io.archive_table(t.part, scratch(t.spark, "archive"), "2024-01-01 00:00:00")
    return a.groupBy("p_brand", F.date_format("archived_date", "yyyyMMdd").cast("int").alias("archived")).agg(F.count(F.lit(1)).alias("n"))


@query("io08_export_ordered", "SELECT c_custkey, round(c_acctbal,2) AS c_acctbal FROM customer")
def _(t):
    path = scratch(t.spark, "export")
    io.export_ordered(t.customer.select("c_custkey", rnd("c_acctbal", 2).alias("c_acctbal")), path, ["c_custkey"])
    return t.spark.read.parquet(path)


@query("io09_sample_rows", "SELECT event_id, user_id FROM events ORDER BY md5('42-' || event_id), event_id LIMIT 100")
def _(t):
    return io.sample_rows(t.events, 100, "event_id").select("event_id", "user_id")


@query("pf01_project_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, round(l_extendedprice*(1-l_discount),4) AS net FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"),
                             rnd(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("pf02_predicates", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND l_discount IS NOT NULL
 AND l_returnflag IN ('A','R') AND l_linestatus <> 'X' AND l_linestatus LIKE '%' GROUP BY 1,2""")
def _(t):
    return t.lineitem.filter(F.col("l_quantity").between(5, 30) & F.col("l_discount").isNotNull() & F.col("l_returnflag").isin("A", "R")
                             & (F.col("l_linestatus") != "X") & F.col("l_linestatus").like("%")).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("pf03_banding", """SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS price_band,
 CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS state, count(*) AS n FROM orders GROUP BY 1,2""")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy(band("o_totalprice", [(50000, "low"), (200000, "mid")], "high").alias("price_band"),
                            F.when(s == "F", "finished").when(s == "O", "open").otherwise("pending").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("pf04_scalar_subquery", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1")
def _(t):
    return with_stats(t.orders, [F.avg("o_totalprice").alias("m")]).filter("o_totalprice > m").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = """s AS (SELECT o_orderstatus AS actual, CASE WHEN o_totalprice < 100000 THEN 'F' WHEN o_totalprice < 200000 THEN 'O' ELSE 'P' END AS predicted FROM orders)"""


@query("pf05_correlated_subquery", "WITH " + _LABELLED + """ SELECT actual, count(*) FILTER (actual=predicted) AS true_positives,
 (SELECT count(*) FROM s x WHERE x.predicted = s.actual AND x.actual <> s.actual) AS false_positives FROM s GROUP BY actual""")
def _(t):
    s = t.orders.select(F.col("o_orderstatus").alias("actual"), band("o_totalprice", [(100000, "F"), (200000, "O")], "P").alias("predicted"))
    pairs = s.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("actual") == F.col("predicted")
    a = pairs.groupBy("actual").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("true_positives"))
    p = pairs.groupBy(F.col("predicted").alias("actual")).agg(F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("false_positives"))
    return null_safe_join(a, p, ["actual"], "left").fillna(0, ["false_positives"])


@query("pf06_qualify", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@query("pf07_cte_chain", """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), b AS (SELECT c_nationkey, avg(total) AS m FROM a JOIN customer ON o_custkey=c_custkey GROUP BY 1),
 c AS (SELECT n_name, m FROM b JOIN nation ON c_nationkey=n_nationkey) SELECT n_name, round(m,6) AS avg_total FROM c""")
def _(t):
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    b = a.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.avg("total").alias("m"))
    return b.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", rnd("m", 6).alias("avg_total"))


@query("pf08_anti_semi", """SELECT 'with orders' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)
 UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    one = lambda how, kind: t.customer.join(t.orders, on, how).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("left_semi", "with orders").unionByName(one("left_anti", "without"))


@query("pf09_unpivot_series", """WITH u AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME series VALUE value)
SELECT series, count(*) AS n, round(sum(value),2) AS total FROM u GROUP BY 1""")
def _(t):
    u = t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"], "series", "value")
    return u.groupBy("series").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 2).alias("total"))


@query("pf10_pivot_by_position", """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, max(event_type) FILTER (k=1) AS first_event, max(event_type) FILTER (k=2) AS second_event, max(event_type) FILTER (k=3) AS third_event FROM p WHERE k<=3 GROUP BY 1""")
def _(t):
    return rel.positions_to_columns(t.events, ["user_id"], ["ts", "event_id"], "event_type", ["first_event", "second_event", "third_event"])


@query("jn01_inner_join", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity),2) AS qty FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("qty"))


@query("jn02_left_join", "SELECT c_mktsegment, count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM customer LEFT JOIN orders ON c_custkey=o_custkey GROUP BY 1")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), tally(F.col("o_orderkey").isNull()).alias("unmatched"))


@query("jn03_one_row_stats", "SELECT l_returnflag, round(avg((l_quantity-m)/s),6) AS mean_z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev(l_quantity) AS s FROM lineitem) GROUP BY 1")
def _(t):
    z = with_stats(t.lineitem, [F.avg("l_quantity").alias("m"), F.stddev("l_quantity").alias("s")])
    return z.groupBy("l_returnflag").agg(rnd(F.avg((F.col("l_quantity") - F.col("m")) / F.col("s")), 6).alias("mean_z"))


def _series(t):
    return sequence(hourly_means(t.events), ["series_id"], ["ts"])


@query("jn04_lag_band_join", "WITH " + HOURLY + " SELECT a.series_id, (a.seq-b.seq)::INT AS lag, count(*) AS n_pairs, round(avg(a.value*b.value),4) AS mean_product FROM ser a JOIN ser b ON a.series_id=b.series_id AND a.seq>b.seq AND a.seq-b.seq<=20 GROUP BY 1,2")
def _(t):
    return rel.lag_pairs(_series(t), ["series_id"], 20).groupBy("series_id", "lag").agg(
        F.count(F.lit(1)).alias("n_pairs"), rnd(F.avg(F.col("value") * F.col("lagged")), 4).alias("mean_product"))


@query("jn05_pairs", """WITH c AS (SELECT label, d, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS d FROM embeddings) GROUP BY 1,2)
SELECT a.label AS label_1, b.label AS label_2, round(sqrt(sum((a.v-b.v)*(a.v-b.v))),5) AS distance FROM c a JOIN c b ON a.d=b.d AND a.label<b.label GROUP BY 1,2""")
def _(t):
    from cairn.operators.cluster import centroid_pairs, centroids
    return centroid_pairs(centroids(t.embeddings, "label", "embedding"), "label")


@query("jn06_band_expression_join", """WITH b AS (SELECT *, CASE WHEN l_quantity<=10 THEN 'small' WHEN l_quantity<=30 THEN 'medium' ELSE 'large' END AS bandname FROM lineitem),
 m AS (SELECT bandname, avg(l_extendedprice) AS m FROM b GROUP BY 1) SELECT b.l_returnflag, b.bandname, count(*) FILTER (l_extendedprice>m) AS above FROM b JOIN m ON b.bandname=m.bandname GROUP BY 1,2""")
def _(t):
    q = F.col("l_quantity")
    b = t.lineitem.withColumn("bandname", F.when(q <= 10, "small").when(q <= 30, "medium").otherwise("large"))
    return with_stats(b, [F.avg("l_extendedprice").alias("m")], ["bandname"]).groupBy("l_returnflag", "bandname").agg(
        tally(F.col("l_extendedprice") > F.col("m")).alias("above"))


@query("jn07_negated_key_join", """WITH p AS (SELECT round(c_acctbal)::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1) SELECT a.k, a.n, b.n AS mirror_n FROM p a JOIN p b ON a.k=-b.k""")
def _(t):
    p = t.customer.groupBy(F.round("c_acctbal").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(p.select((-F.col("k")).alias("k"), F.col("n").alias("mirror_n")), "k")


@query("jn08_nearest_match", """WITH x AS (SELECT c_nationkey, arg_max(c_acctbal, c_custkey)*2 AS wanted FROM customer GROUP BY 1),
 r AS (SELECT c.c_nationkey, c.c_custkey, c.c_acctbal, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY abs(c.c_acctbal-wanted), c.c_custkey DESC) AS k FROM customer c JOIN x ON c.c_nationkey=x.c_nationkey WHERE abs(c.c_acctbal-wanted) <= 0.1*abs(wanted))
SELECT c_nationkey, c_custkey, c_acctbal FROM r WHERE k=1""")
def _(t):
    c = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    target = c.groupBy("c_nationkey").agg((F.max_by("c_acctbal", "c_custkey") * 2).alias("wanted"))
    return rel.nearest_match(c, ["c_nationkey"], target, "c_acctbal", "wanted", F.col("c_custkey"), 0.1).drop("wanted")


@query("jn09_broadcast_dimension", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def _(t):
    # region and nation are fixed-size lookup tables
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("jn10_term_join", """WITH k AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark), w AS (SELECT * FROM k WHERE term<>''),
 d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents)
SELECT item_id, count(DISTINCT term) AS shared_terms, count(*) AS hits FROM w JOIN d USING (term) GROUP BY 1""")
def _(t):
    words = lambda df, i: df.select(i, F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).filter("term <> ''")
    d = words(t.documents, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    k = words(t.benchmark, "item_id").distinct()
    return k.join(d, "term").groupBy("item_id").agg(F.count(F.lit(1)).alias("shared_terms"), F.sum("n").alias("hits"))


@query("jn11_expanding_join", "WITH " + HOURLY + " SELECT t.series_id, t.seq, round(avg(h.value),9) AS expanding_mean FROM ser t LEFT JOIN ser h ON h.series_id=t.series_id AND h.ts<=t.ts GROUP BY 1,2")
def _(t):
    return rel.expanding_mean(_series(t), ["series_id"]).select("series_id", "seq", rnd("expanding_mean", 9).alias("expanding_mean"))


@query("ag01_basic", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice),2) AS total, round(avg(l_quantity),6) AS mean, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"),
                                                  rnd(F.avg("l_quantity"), 6).alias("mean"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


@query("ag02_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("ag03_spread", "SELECT event_type, round(stddev(value),6) AS sd, round(var_samp(value),4) AS var FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(rnd(F.stddev("value"), 6).alias("sd"), rnd(F.var_samp("value"), 4).alias("var"))


@query("ag04_percentiles", "SELECT event_type, round(quantile_cont(value,0.1),6) AS p10, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90 FROM events GROUP BY 1")
def _(t):
    q = quantiles(t.events, {"p10": ("value", .1), "p50": ("value", .5), "p90": ("value", .9)}, ["event_type"])
    return q.select("event_type", *[rnd(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("ag05_percentile_beside_rows", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > m) AS above_median FROM orders, (SELECT quantile_cont(o_totalprice,0.5) AS m FROM orders) GROUP BY 1")
def _(t):
    m = quantiles(t.orders, {"m": ("o_totalprice", .5)})
    return t.orders.crossJoin(F.broadcast(m)).groupBy("o_orderstatus").agg(tally(F.col("o_totalprice") > F.col("m")).alias("above_median"))


@query("ag06_shape", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, round(avg(pow((value-m)/s,3)),5) AS skewness, round(kurtosis_pop(value),5) AS kurtosis FROM events JOIN s USING (event_type) GROUP BY 1""")
def _(t):
    return t.events.groupBy("event_type").agg(rnd(F.skewness("value"), 5).alias("skewness"), rnd(F.kurtosis("value"), 5).alias("kurtosis"))


@query("ag07_standardised_moments", """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev(l_extendedprice) AS s FROM lineitem)
SELECT round(avg(pow((l_extendedprice-m)/s,3)),6) AS skewness, round(avg(pow((l_extendedprice-m)/s,4))-3,6) AS excess_kurtosis FROM lineitem, s""")
def _(t):
    from cairn.operators.profiling import shape_moments
    return shape_moments(t.lineitem, ["l_extendedprice"]).select(rnd("skewness", 6).alias("skewness"), rnd("excess_kurtosis", 6).alias("excess_kurtosis"))


@query("ag08_regression_aggregates", """SELECT l_returnflag, round(corr(l_extendedprice,l_quantity),8) AS corr, round(covar_pop(l_extendedprice,l_quantity),3) AS cov_pop, round(covar_samp(l_extendedprice,l_quantity),3) AS cov_samp,
 round(regr_slope(l_extendedprice,l_quantity),5) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(regr_r2(l_extendedprice,l_quantity),8) AS r2 FROM lineitem GROUP BY 1""")
def _(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(rnd(F.corr(y, x), 8).alias("corr"), rnd(F.covar_pop(y, x), 3).alias("cov_pop"), rnd(F.covar_samp(y, x), 3).alias("cov_samp"),
                                                  rnd(F.regr_slope(y, x), 5).alias("slope"), rnd(F.regr_intercept(y, x), 4).alias("intercept"), rnd(F.regr_r2(y, x), 8).alias("r2"))


@query("ag09_mode", """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2)
SELECT o_orderstatus, o_orderpriority AS mode_value, n AS mode_frequency FROM c QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority)=1""")
def _(t):
    return rel.mode(t.orders, "o_orderpriority", ["o_orderstatus"])


@query("ag10_list_aggregation", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS items FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def _(t):
    return rel.ordered_list(t.nation, ["n_regionkey"], "n_name")


@query("ag11_cumulative_share", """WITH c AS (SELECT p_type, count(*) AS frequency FROM part GROUP BY 1)
SELECT p_type, frequency, round(100.0*frequency/sum(frequency) OVER (),4) AS percentage, row_number() OVER w AS position, round(100.0*sum(frequency) OVER (w ROWS UNBOUNDED PRECEDING)/sum(frequency) OVER (),4) AS cumulative_percentage FROM c WINDOW w AS (ORDER BY frequency DESC, p_type)""")
def _(t):
    return rel.cumulative_share(t.part, "p_type")


@query("ag12_conditional", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS f, round(sum(CASE WHEN o_orderstatus='O' THEN o_totalprice ELSE 0 END),2) AS open_total FROM orders GROUP BY 1")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("f"), rnd(F.sum(F.when(s == "O", F.col("o_totalprice")).otherwise(0.0)), 2).alias("open_total"))


@query("ag13_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("ag14_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return t.events.select("event_type", "user_id").dropDuplicates()


@query("ag15_entropy", """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), p AS (SELECT n/sum(n) OVER () AS p FROM c)
SELECT round(-sum(p*log2(p)),8) AS entropy, round(log2(count(*)),8) AS max_entropy, round(-sum(p*log2(p))/log2(count(*)),8) AS normalized_entropy FROM p""")
def _(t):
    e = rel.entropy(t.part, "p_brand")
    return e.select(*[rnd(c, 8).alias(c) for c in e.columns])


@query("ag16_group_by_expression", "SELECT year(o_orderdate)::INT AS y, (o_totalprice > 100000)::INT AS big, count(*) AS n FROM orders GROUP BY 1,2")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), flag(F.col("o_totalprice") > 100000).alias("big")).agg(F.count(F.lit(1)).alias("n"))


@query("ag17_having_without_group", "SELECT 'negative balance' AS issue, count(*) AS affected FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0")
def _(t):
    return t.customer.filter("c_acctbal < 0").agg(F.lit("negative balance").alias("issue"), F.count(F.lit(1)).alias("affected")).filter("affected > 0")


@query("wn01_row_number", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def _(t):
    return sequence(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "seq")


@query("wn01_row_number_global", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem")
def _(t):
    return sequence(t.lineitem, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "seq")


@query("wn02_rank", """SELECT p_brand, p_size, count(*) AS n, (sum(count(*)) OVER (PARTITION BY p_brand ORDER BY p_size) - count(*) + 1)::BIGINT AS rank,
 dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense_rank FROM part GROUP BY 1,2""")
def _(t):
    return rel.ranked(t.part, ["p_brand"], "p_size").drop("average_rank")


@query("wn03_ntile", "SELECT tile, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS tile FROM orders) GROUP BY 1")
def _(t):
    return rel.ntile(t.orders, [], ["o_totalprice", "o_orderkey"], 10).groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


def _ser_sql(cols):
    return "WITH " + HOURLY + f" SELECT series_id, seq, {cols} FROM ser WINDOW w AS (PARTITION BY series_id ORDER BY seq)"


def _win(t, build, before=0, after=0):
    return sliding(_series(t), ["series_id"], build, before, after).drop("ts", "value")


@query("wn04_lag_lead", _ser_sql("round(lag(value,1) OVER w,9) AS lag1, round(lag(value,12) OVER w,9) AS lag12, round(lead(value,2) OVER w,9) AS lead2"))
def _(t):
    return _win(t, lambda w: {"lag1": rnd(F.lag("value", 1).over(w), 9), "lag12": rnd(F.lag("value", 12).over(w), 9), "lead2": rnd(F.lead("value", 2).over(w), 9)}, 12, 2)


@query("wn05_first_last_value", "WITH " + HOURLY + " SELECT series_id, seq, round(value - first_value(value) OVER w,9) AS from_first, round(value - last_value(value) OVER w,9) AS from_last FROM ser WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    from cairn.plans.ordered import attach
    s = _series(t)
    ends = s.groupBy("series_id").agg(F.min_by("value", "seq").alias("f"), F.max_by("value", "seq").alias("l"), F.max("seq").alias("n"))
    return attach(s, ends, ["series_id"], "n").select("series_id", "seq", rnd(F.col("value") - F.col("f"), 9).alias("from_first"), rnd(F.col("value") - F.col("l"), 9).alias("from_last"))


@query("wn06_last_known_value", "WITH " + HOURLY + ", g AS (SELECT *, CASE WHEN hour(ts) % 13 = 0 THEN NULL ELSE value END AS v FROM ser) SELECT series_id, seq, round(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING),9) AS filled FROM g")
def _(t):
    s = _series(t).withColumn("v", F.when(F.hour("ts") % 13 != 0, F.col("value")))
    return running(s, ["series_id"], lasts={"filled": "v"}).select("series_id", "seq", rnd("filled", 9).alias("filled"))


@query("wn07_running_sum", _ser_sql("round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING),8) AS total"))
def _(t):
    return running(_series(t), ["series_id"], {"total": "value"}).select("series_id", "seq", rnd("total", 8).alias("total"))


@query("wn08_trailing_frame", _ser_sql("round(avg(value) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),9) AS ma12, round(stddev(value) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),5) AS sd12"))
def _(t):
    r = rel.rolling(_series(t), ["series_id"], {"ma12": F.avg("value"), "sd12": F.stddev("value")}, 11)
    return r.select("series_id", "seq", rnd("ma12", 9).alias("ma12"), rnd("sd12", 5).alias("sd12"))


@query("wn09_centred_frame", _ser_sql("round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),9) AS ma7, round(stddev(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),5) AS sd7"))
def _(t):
    r = rel.rolling(_series(t), ["series_id"], {"ma7": F.avg("value"), "sd7": F.stddev("value")}, 3, 3)
    return r.select("series_id", "seq", rnd("ma7", 9).alias("ma7"), rnd("sd7", 5).alias("sd7"))


@query("wn10_rolling_median", _ser_sql("round(median(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),9) AS median"))
def _(t):
    return rel.rolling_median(_series(t), ["series_id"], 2, 2).select("series_id", "seq", rnd("median", 9).alias("median"))


@query("wn11_whole_set_aggregate", "SELECT l_linestatus, round(sum(abs(d)),6) AS dev FROM (SELECT l_linestatus, l_quantity - avg(l_quantity) OVER () AS d FROM lineitem) GROUP BY 1")
def _(t):
    return with_stats(t.lineitem, [F.avg("l_quantity").alias("m")]).groupBy("l_linestatus").agg(rnd(F.sum(F.abs(F.col("l_quantity") - F.col("m"))), 6).alias("dev"))


@query("wn12_partition_share", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY l_returnflag),4) AS share FROM lineitem GROUP BY 1,2")
def _(t):
    return share(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), "n", "share", ["l_returnflag"])


@query("sl01_order_by_case", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, n DESC, 1")
def _(t):
    c = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.when(F.col("o_orderpriority").like("1%"), 0).otherwise(1), F.desc("n"), "o_orderpriority")


@query("sl02_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("sl03_top_k_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 3")
def _(t):
    from cairn.operators.vectors import top_k
    return top_k(t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], 3, [-F.col("s_acctbal"), F.col("s_suppkey")])


@query("so01_union_all", "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def _(t):
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


@query("sf01_math", """SELECT p_partkey, round(abs(p_size-25),6) AS a, round(pow(p_size,1.5),5) AS p, round(sqrt(p_retailprice),6) AS s, round(exp(p_size/50.0),6) AS e, round(ln(p_retailprice),6) AS l, round(log(2,p_retailprice),6) AS l2,
 floor(p_retailprice/7)::BIGINT AS f, ceil(p_retailprice/7)::BIGINT AS c, p_size % 7 AS m, sign(p_size-25)::INT AS sg, least(p_size, 20) AS ls FROM part""")
def _(t):
    z, r = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", rnd(F.abs(z - 25), 6).alias("a"), rnd(F.pow(z, F.lit(1.5)), 5).alias("p"), rnd(F.sqrt(r), 6).alias("s"), rnd(F.exp(z / 50.0), 6).alias("e"),
                         rnd(F.ln(r), 6).alias("l"), rnd(F.log(2.0, r), 6).alias("l2"), F.floor(r / 7).alias("f"), F.ceil(r / 7).alias("c"), (z % 7).alias("m"), F.sign(z - 25).cast("int").alias("sg"), F.least(z, F.lit(20)).alias("ls"))


@query("sf02_trig", "SELECT p_partkey, round(cos(p_size),8) AS c, round(sin(p_size),8) AS s, round(atan2(p_size-25, p_retailprice),10) AS a FROM part")
def _(t):
    z = F.col("p_size")
    return t.part.select("p_partkey", rnd(F.cos(z), 8).alias("c"), rnd(F.sin(z), 8).alias("s"), rnd(F.atan2(z - 25, F.col("p_retailprice")), 10).alias("a"))


@query("sf03_null_handling", "SELECT p_partkey, coalesce(nullif(p_size % 5, 0), -1) AS a, nullif(p_size % 3, 0) AS b FROM part")
def _(t):
    z = F.col("p_size")
    return t.part.select("p_partkey", F.coalesce(F.nullif(z % 5, F.lit(0)), F.lit(-1)).alias("a"), F.nullifzero(z % 3).alias("b"))


@query("sf04_strings", "SELECT c_custkey, lower(trim(c_mktsegment)) AS seg, upper(c_name) AS nm, length(c_name) AS n, replace(c_name,'#','-') AS r, c_mktsegment || '/' || c_nationkey AS k, rpad('*', (c_nationkey+1)::INT, '*') AS bar FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lower(F.trim("c_mktsegment")).alias("seg"), F.upper("c_name").alias("nm"), F.length("c_name").alias("n"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("r"),
                             F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("k"), F.rpad(F.lit("*"), F.col("c_nationkey") + 1, F.lit("*")).alias("bar"))


@query("sf05_word_count", "SELECT doc_id, length(text) - length(replace(text,' ','')) + 1 AS words FROM documents")
def _(t):
    from cairn.operators.text import word_count
    return t.documents.select("doc_id", word_count("text").alias("words"))


@query("sf06_regex_flags", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9#]+')::INT AS simple, regexp_full_match(p_type, '[A-Z]+')::INT AS upper_only FROM part")
def _(t):
    return t.part.select("p_partkey", flag(F.regexp_like("p_brand", F.lit("^[A-Za-z0-9#]+$"))).alias("simple"), flag(F.regexp_like("p_type", F.lit("^[A-Z]+$"))).alias("upper_only"))


@query("sf07_calendar", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, (dayofweek(o_orderdate)+1)::INT AS dow, (dayofweek(o_orderdate) IN (0,6))::INT AS weekend FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.hour(d).alias("h"), F.dayofweek(d).alias("dow"), flag(F.dayofweek(d).isin(1, 7)).alias("weekend"))


@query("sf08_time_difference", "SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_us(l_shipdate)-epoch_us(o_orderdate))/1e6,3) AS secs, round((epoch_us(l_shipdate)-epoch_us(o_orderdate))/3.6e9,6) AS hours FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def _(t):
    s = (F.unix_micros("l_shipdate") - F.unix_micros("o_orderdate"))
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", rnd(s / 1e6, 3).alias("secs"), rnd(s / 3.6e9, 6).alias("hours"))


@query("sf09_holiday_flag", "SELECT year(o_orderdate)::INT AS y, count(*) FILTER (month(o_orderdate)=12 AND day(o_orderdate) BETWEEN 20 AND 31) AS holiday_orders FROM orders GROUP BY 1")
def _(t):
    from cairn.operators.series import holiday_flag
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.sum(holiday_flag("o_orderdate")).alias("holiday_orders"))


@query("sf10_normal_cdf", """WITH z AS (SELECT l_linestatus, (l_quantity-m)/s AS z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev(l_quantity) AS s FROM lineitem)),
 k AS (SELECT *, 1.0/(1.0+0.3275911*abs(z)/sqrt(2.0)) AS t FROM z),
 h AS (SELECT *, 0.5*((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-z*z/2.0) AS h FROM k)
SELECT l_linestatus, round(avg(CASE WHEN z>=0 THEN 1-h ELSE h END),7) AS mean_cdf FROM h GROUP BY 1""")
def _(t):
    s = with_stats(t.lineitem, [F.avg("l_quantity").alias("m"), F.stddev("l_quantity").alias("s")])
    return s.groupBy("l_linestatus").agg(rnd(F.avg(normal_cdf((F.col("l_quantity") - F.col("m")) / F.col("s"))), 7).alias("mean_cdf"))

"""Queries of the models and clusters."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.functions.expr import rnd
from cairn.operators import cluster as cl, models as ml

FEATS = ["o_totalprice", "items", "quantity"]
TEXT = ["n_chars", "toxic", "words"]


def orders(t):
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    return t.orders.join(li, "o_orderkey").select("o_orderkey", "o_orderstatus", *FEATS, "price")


def texts(t):
    d = t.labels.join(t.documents, "doc_id")
    return d.select("doc_id", "quality", "toxic", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("words"))


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ml01_linear_regression", "SELECT unnest(['(Intercept)','l_quantity']) AS feature, unnest([round(regr_intercept(l_extendedprice,l_quantity),4), round(regr_slope(l_extendedprice,l_quantity),4)]) AS coefficient FROM lineitem")
def _(t):
    return r(ml.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity"])[1], 4, "coefficient")


@query("ml01_linear_regression_multi", """WITH li AS (SELECT l_orderkey, count(*)::DOUBLE AS items, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1), o AS (SELECT items, quantity, price FROM orders JOIN li ON l_orderkey=o_orderkey),
 s AS (SELECT avg(items) AS ma, avg(quantity) AS mb, avg(price) AS my, covar_pop(items,items) AS aa, covar_pop(quantity,quantity) AS bb, covar_pop(items,quantity) AS ab, covar_pop(price,items) AS ya, covar_pop(price,quantity) AS yb FROM o),
 c AS (SELECT *, (ya*bb-yb*ab)/(aa*bb-ab*ab) AS ca, (yb*aa-ya*ab)/(aa*bb-ab*ab) AS cb FROM s)
 SELECT unnest(['(Intercept)','items','quantity']) AS feature, unnest([round(my-ca*ma-cb*mb,3), round(ca,3), round(cb,3)]) AS coefficient FROM c""")
def _(t):
    return r(ml.linear_regression(orders(t), "price", ["items", "quantity"])[1], 3, "coefficient")


@query("ml02_glm_poisson")
def _(t):
    return ml.glm(orders(t), "items", ["quantity"], "poisson", "log")[1]


@query("ml02_glm_gamma_statistics")
def _(t):
    return ml.glm(orders(t).filter("price > 0"), "price", ["quantity"], "gamma", "log")[2]


@query("ml02_elastic_net")
def _(t):
    return ml.linear_regression(orders(t), "price", FEATS, elastic=0.5, strength=0.1)[1]


@query("ml03_logistic_binary")
def _(t):
    return ml.logistic_regression(texts(t), "quality", TEXT)[2]


@query("ml03_logistic_multinomial")
def _(t):
    return ml.logistic_regression(orders(t), "o_orderstatus", FEATS)[2]


def _tree(t):
    m, labels = ml.decision_tree(orders(t), "o_orderstatus", FEATS, max_depth=5)
    return ml.tree_nodes(m, FEATS, labels, t.spark)


@query("ml04_decision_tree")
def _(t):
    return _tree(t)


@query("ml05_random_forest")
def _(t):
    train, rest = ml.held_out(orders(t), "o_orderkey")
    m, labels = ml.random_forest(train, "o_orderstatus", FEATS, trees=10, max_depth=6)
    return ml.predict(rest, m, FEATS, ["o_orderkey", "o_orderstatus"], labels)


@query("ml06_decision_forest")
def _(t):
    train, rest = ml.held_out(orders(t), "o_orderkey")
    m, _ = ml.decision_forest(train, "price", ["items", "quantity"], max_depth=6, regression=True)
    return ml.predict(rest, m, ["items", "quantity"], ["o_orderkey", "price"])


@query("ml07_svm")
def _(t):
    train, rest = ml.held_out(texts(t), "doc_id")
    m, labels = ml.svm(train, "quality", TEXT)
    return ml.predict(rest, m, TEXT, ["doc_id", "quality"], labels)


_NB = """WITH li AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus AS k, o_totalprice AS a, items AS b, quantity AS c FROM orders JOIN li ON l_orderkey=o_orderkey),
 g AS (SELECT k, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM o GROUP BY 1), m AS (SELECT k, ln((n+1)/((SELECT count(*) FROM o)+3)) AS p, ln((a+1)/(a+b+c+3)) AS pa, ln((b+1)/(a+b+c+3)) AS pb, ln((c+1)/(a+b+c+3)) AS pc FROM g)"""


@query("ml08_naive_bayes", _NB + " SELECT k AS class_label, unnest(['(prior)','o_totalprice','items','quantity']) AS feature, unnest([round(p,9),round(pa,9),round(pb,9),round(pc,9)]) AS log_prob FROM m")
def _(t):
    return r(ml.naive_bayes(orders(t), "o_orderstatus", FEATS), 9, "log_prob")


@query("ml08_naive_bayes_predict", _NB + ", s AS (SELECT o_orderkey, m.k, p+o.a*pa+o.b*pb+o.c*pc AS s FROM o, m) SELECT o_orderkey, k AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC, k DESC)=1")
def _(t):
    o = orders(t)
    return ml.naive_bayes_predict(o, ml.naive_bayes(o, "o_orderstatus", FEATS), FEATS, ["o_orderkey"]).drop("confidence")


@query("ml09_predict_tree")
def _(t):
    train, rest = ml.held_out(orders(t), "o_orderkey")
    m, labels = ml.decision_tree(train, "o_orderstatus", FEATS, max_depth=4)
    return ml.predict(rest, m, FEATS, ["o_orderkey", "o_orderstatus"], labels)


@query("ml09_predict_linear", "WITH f AS (SELECT regr_slope(l_extendedprice,l_quantity) AS b, regr_intercept(l_extendedprice,l_quantity) AS a FROM lineitem) SELECT l_linestatus, count(*) AS n, round(avg(a+b*l_quantity),5) AS mean_prediction FROM lineitem, f GROUP BY 1")
def _(t):
    m, _ = ml.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity"])
    p = ml.predict(t.lineitem, m, ["l_quantity"], ["l_linestatus"])
    return p.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("prediction"), 5).alias("mean_prediction"))


for _k, _f in {"ml11_tree_structure": ml.tree_structure, "ml11_leaf_quality": ml.leaf_quality, "ml12_feature_importance": ml.feature_importance,
               "ml13_split_cooccurrence": ml.split_cooccurrence, "ml13_tree_complexity": ml.tree_complexity}.items():
    @query(_k)
    def _(t, f=_f):
        return f(_tree(t))


@query("ml14_coefficient_report")
def _(t):
    return ml.coefficient_report(ml.glm(orders(t), "price", FEATS)[1])


@query("ml15_grid_tune")
def _(t):
    def train(rows, **setting):
        m, labels = ml.decision_tree(rows, "o_orderstatus", FEATS, min_split=2, **setting)
        return lambda d: ml.predict(d, m, FEATS, ["o_orderkey", "o_orderstatus"], labels)
    return ml.grid_tune(orders(t), "o_orderkey", {"max_depth": (3, 5), "min_node": (5, 20)}, train, lambda p: ml.accuracy(p, "o_orderstatus"), folds=2)


_ORD = "WITH li AS (SELECT l_orderkey, count(*)::DOUBLE AS items, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, items, quantity, price, row_number() OVER (ORDER BY o_orderkey) % 5 + 1 AS fold FROM orders JOIN li ON l_orderkey=o_orderkey)"


@query("ml16_cross_validate", _ORD + """, s AS (SELECT f.i AS fold, count(*) AS n, avg(items) AS ma, avg(quantity) AS mb, avg(price) AS my, covar_pop(items,items) AS aa, covar_pop(quantity,quantity) AS bb, covar_pop(items,quantity) AS ab, covar_pop(price,items) AS ya, covar_pop(price,quantity) AS yb
 FROM o, range(1,6) f(i) WHERE o.fold<>f.i GROUP BY 1), c AS (SELECT *, (ya*bb-yb*ab)/(aa*bb-ab*ab) AS ca, (yb*aa-ya*ab)/(aa*bb-ab*ab) AS cb FROM s),
 e AS (SELECT o.fold, price, my+ca*(items-ma)+cb*(quantity-mb)-price AS e FROM o JOIN c ON c.fold=o.fold)
 SELECT fold::INT AS fold, count(*) AS n, round(sqrt(avg(e*e)),4) AS rmse, round(avg(abs(e)),4) AS mae, round(1-sum(e*e)/(count(*)*var_pop(price)),7) AS r2 FROM e GROUP BY 1""")
def _(t):
    return r(r(ml.cross_validate(orders(t), "o_orderkey", "price", ["items", "quantity"]), 4, "rmse", "mae"), 7, "r2")


@query("cl01_kmeans")
def _(t):
    return cl.kmeans(t.embeddings, "vec_id", "embedding")


_CENT = """WITH v AS (SELECT vec_id, label, generate_subscripts(embedding,1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, d, avg(v) AS v FROM v GROUP BY 1,2), p AS (SELECT vec_id, c.label AS k, sqrt(sum(pow(v.v-c.v,2))) AS dist FROM v JOIN c ON v.d=c.d GROUP BY 1,2),
 b AS (SELECT vec_id, k, dist FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k)=1)"""


def assigned(t):
    return cl.kmeans_predict(t.embeddings, cl.centroids(t.embeddings, "label", "embedding"), "vec_id", "label", "embedding")


@query("cl02_kmeans_predict", _CENT + " SELECT vec_id, k AS cluster_id, round(dist,7) AS distance_to_centroid FROM b")
def _(t):
    return r(assigned(t), 7, "distance_to_centroid")


@query("cl03_hierarchical")
def _(t):
    return cl.hierarchical_clustering(t.embeddings, "vec_id", "embedding")


# two rounds of splits at the mean of each node's widest dimension; nodes are numbered as in a heap
_SPLIT = """m{i} AS (SELECT node, d, m FROM (SELECT node, d, avg(v) AS m, var_samp(v) AS s FROM r{i} GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, d)=1),
 r{j} AS (SELECT r.vec_id, r.d, r.v, 2*r.node+(x.v>m.m)::INT AS node FROM r{i} r JOIN m{i} m ON r.node=m.node JOIN r{i} x ON x.vec_id=r.vec_id AND x.d=m.d)"""
_NESTED = "WITH r0 AS (SELECT vec_id, generate_subscripts(embedding,1) AS d, unnest(embedding)::DOUBLE AS v, 1 AS node FROM embeddings), " + ", ".join(
    _SPLIT.format(i=i, j=i + 1) for i in range(2)) + """, l AS (SELECT 2 AS level, * FROM r1 UNION ALL SELECT 4, * FROM r2), c AS (SELECT level, node, d, avg(v) AS m FROM l GROUP BY 1,2,3)
 SELECT level, (l.node-level)::INT AS cluster_id, CASE WHEN level=4 THEN (l.node//2-2)::INT END AS parent_id, vec_id::VARCHAR AS id, round(sqrt(sum(pow(v-m,2))),6) AS distance_to_centroid FROM l JOIN c USING (level, node, d) GROUP BY ALL"""


@query("cl03_nested_levels", _NESTED)
def _(t):
    h = cl.hierarchical_clustering(t.embeddings, "vec_id", "embedding", (2, 4), max_iter=0).filter("result_type = 'assignment'")
    return r(h.select("level", "cluster_id", "parent_id", "id", "distance_to_centroid"), 6, "distance_to_centroid")


@query("cl03_cluster_tree")
def _(t):
    return cl.cluster_tree(t.embeddings, "vec_id", "embedding")


@query("cl04_cluster_report", _CENT + " SELECT k AS cluster_id, count(*) AS cluster_size, round(sum(dist*dist),6) AS wcss, round(sum(dist),6) AS sum_distance, round(max(dist),7) AS max_distance, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM b GROUP BY 1")
def _(t):
    return r(r(cl.cluster_report(assigned(t)), 6, "wcss", "sum_distance"), 7, "max_distance")


@query("cl04_cluster_balance", _CENT + ", g AS (SELECT k, count(*) AS n, sum(dist*dist) AS w FROM b GROUP BY 1) SELECT count(*) AS clusters, round(max(n)/min(n),8) AS imbalance_ratio, round(sum(w),6) AS wcss, CASE WHEN max(n)/min(n)<=3 THEN 'Balanced' WHEN max(n)/min(n)<=10 THEN 'Moderate Imbalance' ELSE 'Severe Imbalance' END AS balance_status FROM g")
def _(t):
    return r(r(cl.cluster_balance(assigned(t)), 8, "imbalance_ratio"), 6, "wcss")

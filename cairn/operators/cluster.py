"""Clustering: models, assignment to given centroids, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.plans.lineage import written


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster; summed per dimension, so a large cluster is
    pre-aggregated on the map side."""
    long = df.select(cluster, F.posexplode(vector).alias("d", "v"))
    means = long.groupBy(cluster, "d").agg(F.avg("v").alias("v"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("centroid"))


def centroid_pairs(cents: DataFrame, cluster: str) -> DataFrame:
    """Distances between all cluster centres. The table has one row per
    cluster, at most the k of the model."""
    from cairn.functions.expr import rnd
    rows = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("id"), F.col("centroid").alias("c")))).alias("all"))
    a = rows.select("all", F.explode("all").alias("a"))
    p = a.select("a", F.explode(F.filter("all", lambda b: b["id"] > F.col("a.id"))).alias("b"))
    dist = F.sqrt(F.aggregate(F.zip_with("a.c", "b.c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return p.select(F.col("a.id").alias(f"{cluster}_1"), F.col("b.id").alias(f"{cluster}_2"), rnd(dist, 5).alias("distance"))


def vectors(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def _tables(df, model, id_col):
    """Centroid and assignment rows with the distance to the centroid."""
    spark = df.sparkSession
    cents = [[float(x) for x in c] for c in model.clusterCenters()]
    cent = spark.createDataFrame([(i, c) for i, c in enumerate(cents)], "cluster_id int, centroid array<double>")
    a = model.transform(df).select(id_col, "features", F.col("prediction").alias("cluster_id"))
    from pyspark.ml.functions import vector_to_array
    a = a.join(F.broadcast(cent), "cluster_id")  # k rows
    d = F.aggregate(F.zip_with(vector_to_array("features"), "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    rows = a.select(F.lit("assignment").alias("result_type"), "cluster_id", F.col(id_col).cast("string").alias("id"), F.lit(None).cast("array<double>").alias("features"), F.sqrt(d).alias("distance_to_centroid"))
    return rows.unionByName(cent.select(F.lit("centroid").alias("result_type"), "cluster_id", F.lit(None).cast("string").alias("id"), F.col("centroid").alias("features"), F.lit(None).cast("double").alias("distance_to_centroid")))


def kmeans(df: DataFrame, id_col: str, vector: str, k=8, max_iter=100, tol=0.001, seed=42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    d = vectors(df, vector)
    return _tables(d, KMeans(k=k, maxIter=max_iter, tol=tol, seed=seed).fit(d), id_col)


def _halves(rows: DataFrame, rules: dict) -> dict:
    """(node, side) -> size, mean, variance of the rows of the nodes that have a
    rule; ``rules`` has the weights and the bound of each. One pass for all nodes."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    table = rows.sparkSession.createDataFrame([(n, w, b) for n, (w, b) in rules.items()], "node int, w array<double>, b double")
    r = rows.join(F.broadcast(table), "node")  # at most one row per leaf
    out = r.groupBy("node", (_dot("w", "x") > F.col("b")).alias("side")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s"))
    return {(o["node"], o["side"]): (o["s"]["count"], o["s"]["mean"].toArray(), o["s"]["variance"].toArray()) for o in out.collect()}


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _spread(half) -> float:
    n, _, variance = half
    return float(variance.sum() * (n - 1)) if n > 1 else 0.0


def split_tree(df: DataFrame, id_col: str, vector: str, leaves=8, max_iter=20, tol=0.001) -> tuple[DataFrame, list[dict]]:
    """A tree of splits from the top, and the rows (__id, x, node) at its leaves.

    A node is split at the mean of its widest dimension (the first of equal ones); up to
    ``max_iter`` steps of two means follow, as long as one lowers the squared error by
    more than the share ``tol``. All leaves are split side by side; if that would make
    too many, those with the largest squared error (the oldest of equal ones). Nodes of
    equal vectors stay whole, so there may be fewer leaves; rows without a vector take no
    part. The driver holds the nodes only. A node (dict) has node, parent, left, right,
    size, sse, centroid, order (the number of its split) and height, what the split saves:
    n1 n2 / (n1 + n2) times the squared distance of the halves' centroids."""
    x = F.transform(vector, lambda v: v.cast("double"))
    rows = written(df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("__id"), x.alias("x"), F.lit(1).alias("node")))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return rows, []
    whole = _halves(rows, {1: ([0.0] * width, 0.0)})[1, False]
    nodes, stats, splits = [], {}, 0

    def add(parent, half):
        nodes.append({"node": len(nodes) + 1, "parent": parent, "left": None, "right": None, "size": half[0], "sse": _spread(half),
                      "centroid": half[1].tolist(), "order": None, "height": None})
        stats[len(nodes)] = half
        return len(nodes)

    add(None, whole)
    open_ = [1]
    while open_ and splits + 1 < leaves:
        chosen = sorted((n for n in open_ if nodes[n - 1]["sse"] > 0), key=lambda n: (-nodes[n - 1]["sse"], n))[:leaves - 1 - splits]
        rules, kept, going = {}, {}, set(chosen)
        for n in chosen:
            _, mean, variance = stats[n]
            j = int(variance.argmax())
            rules[n] = ([float(i == j) for i in range(width)], float(mean[j]))
        for _ in range(max_iter + 1):
            if not going:
                break
            halves = _halves(rows, {n: rules[n] for n in going})
            for n in sorted(going):
                pair = halves.get((n, False)), halves.get((n, True))
                if None in pair:
                    going.discard(n)
                    continue
                now = _spread(pair[0]) + _spread(pair[1])
                before = sum(map(_spread, kept[n][1])) if n in kept else None
                if before is not None and now > before:
                    going.discard(n)
                    continue
                kept[n] = rules[n], pair
                if before is not None and before - now <= tol * before:
                    going.discard(n)
                (_, lo, _), (_, hi, _) = pair
                rules[n] = ((hi - lo).tolist(), float((hi @ hi - lo @ lo) / 2))
        open_, moves = [], []
        for n in chosen:
            if n in kept:
                (w, b), pair = kept[n]
                splits += 1
                gap = pair[1][1] - pair[0][1]
                nodes[n - 1] |= {"left": add(n, pair[0]), "right": add(n, pair[1]), "order": splits,
                                 "height": float(gap @ gap * pair[0][0] * pair[1][0] / (pair[0][0] + pair[1][0]))}
                moves.append((n, w, b, nodes[n - 1]["left"], nodes[n - 1]["right"]))
                open_ += [nodes[n - 1]["left"], nodes[n - 1]["right"]]
        if moves:
            table = rows.sparkSession.createDataFrame(moves, "node int, w array<double>, b double, lo int, hi int")
            to = F.when(F.col("w").isNull(), F.col("node")).when(_dot("w", "x") > F.col("b"), F.col("hi")).otherwise(F.col("lo"))
            rows = written(rows.join(F.broadcast(table), "node", "left").select("__id", "x", to.alias("node")))
    return rows, nodes


def _cut(nodes: list[dict], k: int) -> list[tuple[int, list[int]]]:
    """The clusters of the first k - 1 splits, from left to right, each with the nodes
    that are leaves of the tree below it."""
    by = {n["node"]: n for n in nodes}

    def below(n, last):
        node = by[n]
        if node["order"] is None or node["order"] > last:
            return [n]
        return below(node["left"], last) + below(node["right"], last)

    return [(n, below(n, len(nodes))) for n in below(1, k - 1)] if nodes else []


def hierarchical_clustering(df: DataFrame, id_col: str, vector: str, levels=(2, 4, 8), max_iter=20, tol=0.001) -> DataFrame:
    """Clusters of each level out of one tree (``split_tree``): a level of k has the
    clusters of the first k - 1 splits, so each lies in one cluster of the level before,
    ``parent_id``. Rows as of ``kmeans`` by ``level``; centroid rows have the number of
    their rows, and in ``height`` what the split that made them saves."""
    levels = sorted(levels)
    rows, nodes = split_tree(df, id_col, vector, max(levels), max_iter, tol)
    by, table, above = {n["node"]: n for n in nodes}, [], {}
    for k in levels:
        place = {}
        for i, (n, ends) in enumerate(_cut(nodes, k)):
            up = by.get(by[n]["parent"])
            table += [(k, i, above.get(ends[0]), e, e == ends[0], by[n]["centroid"], by[n]["size"], up and up["height"]) for e in ends]
            place |= {e: i for e in ends}
        above = place
    at = df.sparkSession.createDataFrame(table, "level int, cluster_id int, parent_id int, node int, first boolean, centroid array<double>, size bigint, height double")
    a = rows.join(F.broadcast(at), "node")  # levels times leaves
    d = F.aggregate(F.zip_with("x", "centroid", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    assigned = a.select("level", F.lit("assignment").alias("result_type"), "cluster_id", "parent_id", F.col("__id").cast("string").alias("id"),
                        null("features", "array<double>"), F.sqrt(d).alias("distance_to_centroid"), null("size", "bigint"), null("height", "double"))
    return assigned.unionByName(at.filter("first").select("level", F.lit("centroid").alias("result_type"), "cluster_id", "parent_id", null("id", "string"),
                                                          F.col("centroid").alias("features"), null("distance_to_centroid", "double"), "size", "height"))


def cluster_tree(df: DataFrame, id_col: str, vector: str, leaves=8, max_iter=20, tol=0.001) -> DataFrame:
    """The nodes of ``split_tree``: node, parent, left, right, size, sse, order, height."""
    nodes = split_tree(df, id_col, vector, leaves, max_iter, tol)[1]
    names = ["node", "parent", "left", "right", "size", "sse", "order", "height"]
    return df.sparkSession.createDataFrame([tuple(n[c] for c in names) for n in nodes],
                                           "node int, parent int, left int, right int, size bigint, sse double, `order` int, height double")


def kmeans_predict(df: DataFrame, cents: DataFrame, id_col: str, cluster: str, vector: str) -> DataFrame:
    """Nearest of the given centroids (k rows, carried as one array); ties go
    to the smaller cluster."""
    one = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("k"), F.col("centroid").alias("c")))).alias("__c"))
    r = df.crossJoin(F.broadcast(one))
    d = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector), c["c"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))
    best = F.array_min(F.transform("__c", lambda c: F.struct(d(c).alias("d"), c["k"].alias("k"))))
    return r.select(id_col, best.alias("b")).select(id_col, F.col("b.k").alias("cluster_id"), F.col("b.d").alias("distance_to_centroid"))


def cluster_report(assigned: DataFrame) -> DataFrame:
    from cairn.plans.ordered import share
    d = F.col("distance_to_centroid")
    g = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.sum(d * d).alias("wcss"), F.sum(d).alias("sum_distance"), F.max(d).alias("max_distance"))
    return share(g, "cluster_size", "percentage")


def cluster_balance(assigned: DataFrame) -> DataFrame:
    g = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("distance_to_centroid", 2)).alias("w"))
    out = g.agg(F.count(F.lit(1)).alias("clusters"), (F.max("n") / F.min("n")).alias("imbalance_ratio"), F.sum("w").alias("wcss"))
    r = F.col("imbalance_ratio")
    return out.withColumn("balance_status", F.when(r <= 3, "Balanced").when(r <= 10, "Moderate Imbalance").otherwise("Severe Imbalance"))

"""Supervised models on spark.ml, with results as tables.

Training loops run in spark.ml over partitioned data; only model parameters
reach the driver, whose size does not grow with the rows."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import all_of, band, band_ge, band_gt, flag, normal_cdf, pct, rnd, tally
from cairn.operators.prep import kfold, train_test_split
from cairn.plans.linear import dot, ols


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def index_target(df: DataFrame, target: str):
    """Numeric ``label`` with labels in sorted order, and those labels."""
    m = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df.withColumn(target, F.col(target).cast("string")))
    return m.transform(df.withColumn(target, F.col(target).cast("string"))), list(m.labels)


def rows(spark, data, schema) -> DataFrame:
    """A table of model parameters."""
    return spark.createDataFrame([tuple(r) for r in data], schema)


def linear_regression(df: DataFrame, target: str, features, intercept=True, elastic=0.0, strength=0.0):
    """Model and (feature, coefficient) rows; normal equations unless an
    elastic net asks for the iterative solver."""
    d = assemble(df, features)
    m = LinearRegression(labelCol=target, fitIntercept=intercept, solver="normal" if strength == 0 else "l-bfgs", elasticNetParam=elastic, regParam=strength).fit(d)
    out = ([("(Intercept)", float(m.intercept))] if intercept else []) + [(f, float(c)) for f, c in zip(features, m.coefficients)]
    return m, rows(df.sparkSession, out, "feature string, coefficient double")


def glm(df: DataFrame, target: str, features, family="gaussian", link=None, max_iter=25, tol=1e-6, strength=0.0):
    """Model, coefficient rows (estimate, std_error, z_score, p_value) and
    fit statistics (deviance, null deviance, aic, dispersion)."""
    d = assemble(df, features)
    args = dict(labelCol=target, family=family, maxIter=max_iter, tol=tol, regParam=strength)
    m = GeneralizedLinearRegression(**args, **({"link": link} if link else {})).fit(d)
    s = m.summary
    names = list(features) + ["(Intercept)"]
    est = [float(c) for c in m.coefficients] + [float(m.intercept)]
    coef = rows(df.sparkSession, zip(names, est, map(float, s.coefficientStandardErrors), map(float, s.tValues), map(float, s.pValues)),
                "feature string, estimate double, std_error double, z_score double, p_value double")
    fit = rows(df.sparkSession, [("deviance", float(s.deviance)), ("null_deviance", float(s.nullDeviance)), ("aic", float(s.aic)), ("dispersion", float(s.dispersion))],
               "statistic string, value double")
    return m, coef, fit


def coefficient_report(coef: DataFrame) -> DataFrame:
    """Rank by size, sign, significance stars; one row per feature."""
    p = F.col("p_value")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")
    w = Window.partitionBy().orderBy(F.desc(F.abs("estimate")))
    return coef.withColumns({"importance_rank": F.row_number().over(w), "effect": F.when(F.col("estimate") > 0, "Positive").when(F.col("estimate") < 0, "Negative").otherwise("None"),
                             "significance": stars})


def logistic_regression(df: DataFrame, target: str, features, max_iter=100, tol=1e-4):
    d, labels = index_target(df, target)
    m = LogisticRegression(maxIter=max_iter, tol=tol).fit(assemble(d, features))
    mat, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    names = labels if len(b) == len(labels) else labels[1:]
    out = [(n, f, float(c)) for n, line in zip(names, mat) for f, c in zip(features, line)] + [(n, "(Intercept)", float(v)) for n, v in zip(names, b)]
    return m, labels, rows(df.sparkSession, out, "class_label string, feature string, coefficient double")


def decision_tree(df: DataFrame, target: str, features, max_depth=10, min_split=20, min_node=10, splits=10, measure="gini", seed=42):
    """Model, labels."""
    d, labels = index_target(df, target)
    return DecisionTreeClassifier(**_tree_settings(max_depth, min_split, min_node, splits, measure, seed)).fit(assemble(d, features)), labels


def _tree_settings(max_depth, min_split, min_node, splits, measure, seed) -> dict:
    """A split needs ``min_node`` rows on each side; the minimal rows of a node
    to be split have no own setting, so half of ``min_split`` is required on each
    side if that is more. ``splits`` are the candidate splits of a feature."""
    return dict(maxDepth=max_depth, minInstancesPerNode=max(min_node, min_split // 2), maxBins=splits + 1, impurity=measure, seed=seed)


def random_forest(df: DataFrame, target: str, features, trees=20, max_depth=10, min_split=20, min_node=10, splits=10, measure="gini", share=1.0, seed=42):
    """Model, labels; each tree sees ``share`` of the rows, each split the square
    root of the number of features."""
    d, labels = index_target(df, target)
    args = _tree_settings(max_depth, min_split, min_node, splits, measure, seed)
    return RandomForestClassifier(numTrees=trees, subsamplingRate=share, featureSubsetStrategy="sqrt", **args).fit(assemble(d, features)), labels


def decision_forest(df: DataFrame, target: str, features, trees=10, max_depth=10, min_split=20, min_node=10, splits=10, measure=None, share=1.0, seed=42, regression=False):
    """Bagged trees that see all features at every split; ``measure`` is gini or
    entropy for classes, variance for numbers."""
    args = dict(numTrees=trees, subsamplingRate=share, featureSubsetStrategy="all",
                **_tree_settings(max_depth, min_split, min_node, splits, measure or ("variance" if regression else "gini"), seed))
    if regression:
        return RandomForestRegressor(labelCol=target, **args).fit(assemble(df, features)), None
    d, labels = index_target(df, target)
    return RandomForestClassifier(**args).fit(assemble(d, features)), labels


def held_out(df: DataFrame, id_col: str, train=0.8, seed=42) -> tuple[DataFrame, DataFrame]:
    """The rows with ``is_train`` 1 and those with 0."""
    d = train_test_split(df, id_col, train, seed)
    return d.filter("is_train = 1").drop("is_train"), d.filter("is_train = 0").drop("is_train")


def svm(df: DataFrame, target: str, features, cost=1.0, max_iter=1000, tol=1e-4):
    """Linear SVM; one against the rest for more than two classes."""
    d, labels = index_target(df, target)
    d = assemble(d, features)
    est = LinearSVC(maxIter=max_iter, tol=tol, regParam=1.0 / (d.count() * cost))
    return (est if len(labels) <= 2 else OneVsRest(classifier=est)).fit(d), labels


def naive_bayes(df: DataFrame, target: str, features, laplace=1.0) -> DataFrame:
    """Multinomial model by plain aggregation: (class_label, feature,
    log_prob) with the log prior in the row of feature '(prior)'."""
    d = df.dropna(subset=[target, *features])
    g = d.groupBy(F.col(target).cast("string").alias("class_label")).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f).alias(f"__s_{f}") for f in features])
    t = g.agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__classes"))
    g = g.crossJoin(F.broadcast(t))  # one row per class
    total = sum((F.col(f"__s_{f}") for f in features), F.lit(0.0)) + laplace * len(features)
    cells = [F.struct(F.lit("(prior)").alias("feature"), F.ln((F.col("__n") + laplace) / (F.col("__total") + laplace * F.col("__classes"))).alias("log_prob"))]
    cells += [F.struct(F.lit(f).alias("feature"), F.ln((F.col(f"__s_{f}") + laplace) / total).alias("log_prob")) for f in features]
    return g.select("class_label", F.explode(F.array(*cells)).alias("c")).select("class_label", "c.*")


def naive_bayes_predict(df: DataFrame, model: DataFrame, features, keep) -> DataFrame:
    """The class with the largest log posterior and its probability. The
    model (one row per class) is carried as one array."""
    per = model.groupBy("class_label").agg(F.map_from_entries(F.collect_list(F.struct("feature", "log_prob"))).alias("m"))
    one = per.agg(F.collect_list(F.struct("class_label", "m")).alias("__m"))
    def score(c):
        e = c["m"]["(prior)"]
        for f in features:
            e = e + F.col(f) * c["m"][f]
        return F.struct(e.alias("s"), c["class_label"].alias("k"))
    r = df.crossJoin(F.broadcast(one)).withColumn("__s", F.transform("__m", score)).withColumn("__b", F.array_max("__s"))
    z = F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("__b.s")))
    return r.select(*keep, F.col("__b.k").alias("prediction"), (1.0 / z).alias("confidence"))


def predict(df: DataFrame, model, features, keep, labels=None) -> DataFrame:
    """Prediction and confidence (largest class probability, null where the
    model has none)."""
    out = model.transform(assemble(df, features))
    p = F.col("prediction")
    if labels is not None:
        p = F.element_at(F.array(*[F.lit(x) for x in labels]), p.cast("int") + 1)
    conf = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*keep, p.alias("prediction"), conf.alias("confidence"))


def tree_nodes(model, features, labels, spark) -> DataFrame:
    """Node table of a fitted tree (root is node 1). The tree is walked on
    the driver, where the model already is."""
    out = []
    def walk(node, ident, parent, depth):
        stats = [float(x) for x in node.impurityStats().stats()]
        n = sum(stats)
        best = max(range(len(stats)), key=lambda i: stats[i]) if stats else 0
        leaf = node.subtreeDepth() == 0
        var = val = None
        if not leaf:
            s = node.split()
            var = features[s.featureIndex()]
            val = float(s.threshold()) if hasattr(s, "threshold") else None
        out.append((ident, depth, parent, "Leaf" if leaf else "Split", var, val, None if leaf else "<=", float(node.impurity()),
                    None if leaf else float(node.gain()), int(n), labels[best], stats[best] / n if n else None))
        if not leaf:
            walk(node.leftChild(), 2 * ident, ident, depth + 1)
            walk(node.rightChild(), 2 * ident + 1, ident, depth + 1)
    walk(model._call_java("rootNode"), 1, None, 0)
    return rows(spark, out, "node_id long, depth int, parent_id long, node_type string, split_variable string, split_value double, split_operator string, "
                            "gini_index double, gini_decrease double, sample_count long, predicted_class string, confidence double")


def tree_structure(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("node_count"), tally(F.col("node_type") == "Split").alias("split_nodes"), tally(F.col("node_type") == "Leaf").alias("leaf_nodes"),
                                      F.avg(F.when(F.col("node_type") == "Leaf", F.col("confidence"))).alias("avg_leaf_confidence"))


def leaf_quality(nodes: DataFrame) -> DataFrame:
    leaf = nodes.filter("node_type = 'Leaf'")
    q = band_ge("confidence", [(0.95, "Very High Purity"), (0.85, "High Purity"), (0.70, "Medium Purity")], "Low Purity")
    return leaf.groupBy(q.alias("node_quality")).agg(F.count(F.lit(1)).alias("leaves"), F.sum("sample_count").alias("samples"))


def feature_importance(nodes: DataFrame) -> DataFrame:
    f = nodes.filter("node_type = 'Split'").groupBy(F.col("split_variable").alias("feature_name")).agg(
        F.count(F.lit(1)).alias("split_count"), F.avg("gini_decrease").alias("avg_gini_decrease"), F.sum("gini_decrease").alias("total_gini_decrease"), F.min("depth").alias("first_split_depth"))
    return f.withColumn("importance_rank", F.rank().over(Window.partitionBy().orderBy(F.desc("total_gini_decrease"))))  # one row per feature


def split_cooccurrence(nodes: DataFrame) -> DataFrame:
    """Pairs of variables split at a node and at its child."""
    s = nodes.filter("node_type = 'Split'")
    c = s.select(F.col("parent_id").alias("p"), F.col("split_variable").alias("feature2"))
    return s.join(c, F.col("node_id") == F.col("p")).groupBy(F.col("split_variable").alias("feature1"), "feature2").agg(F.count(F.lit(1)).alias("co_occurrence_count"))


def tree_complexity(nodes: DataFrame) -> DataFrame:
    leaf = F.col("node_type") == "Leaf"
    out = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), tally(leaf).alias("leaf_count"), F.max("depth").alias("tree_depth"),
                    F.avg(F.when(leaf, F.col("sample_count"))).alias("avg_samples_per_leaf"), F.countDistinct("split_variable").alias("features_used"))
    d = F.col("tree_depth")
    return out.withColumn("complexity_assessment", F.when(d <= 5, "Low Complexity").when(d <= 10, "Medium Complexity").when(d <= 15, "High Complexity")
                          .otherwise("Very High Complexity - Risk of Overfitting"))


def grid_tune(df: DataFrame, id_col: str, grid: dict, train_fn, metric, folds=3, higher_is_better=True) -> DataFrame:
    """Cross-validated metric of every setting of any estimator, ranked.

    ``grid`` maps a parameter to its values. ``train_fn(rows, **setting)`` gives a
    function from rows to predictions, ``metric(predictions)`` a one-row table with
    the column ``metric``. Folds go by position of the id."""
    d = kfold(df, id_col, folds).persist()
    data = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        found = [metric(train_fn(d.filter(F.col("fold") != i).drop("fold"), **setting)(d.filter(F.col("fold") == i).drop("fold"))) for i in range(1, folds + 1)]
        got = reduce(DataFrame.unionByName, found).agg(F.avg("metric"), F.stddev("metric")).first()
        data.append((*values, float(got[0]), None if got[1] is None else float(got[1])))
    d.unpersist()
    kind = lambda vs: "double" if any(isinstance(v, float) for v in vs) else "int" if all(isinstance(v, int) for v in vs) else "string"
    out = rows(df.sparkSession, data, ", ".join([f"`{k}` {kind(v)}" for k, v in grid.items()] + ["metric double", "metric_std double"]))
    order = F.desc("metric") if higher_is_better else F.asc("metric")
    return out.withColumn("metric_rank", F.rank().over(Window.partitionBy().orderBy(order)))  # one row per setting


def accuracy(predictions: DataFrame, target: str) -> DataFrame:
    return predictions.agg(F.avg(flag(F.col("prediction") == F.col(target).cast("string"))).alias("metric"))


def cross_validate(df: DataFrame, id_col: str, target: str, features, k=5) -> DataFrame:
    """Per-fold RMSE, MAE and R2 of a linear regression; folds by position. Each
    row stands in the training part of all other folds: one aggregate holds the
    cross products of every fold, whose fits are joined back, one row per fold."""
    d = kfold(df, id_col, k).filter(all_of([F.col(c).isNotNull() for c in [*features, target]]))
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    others = d.withColumn("__of", F.explode(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i != F.col("fold"))))
    fits = ols(others, ["__of"], F.col(target), xs).select(F.col("__of").alias("fold"), "coef")
    p = d.join(F.broadcast(fits), "fold").withColumn("__e", dot("coef", xs) - F.col(target))  # k rows
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg(F.abs("__e")).alias("mae"),
                                 (1 - F.sum(F.col("__e") * F.col("__e")) / (F.count(F.lit(1)) * F.var_pop(target))).alias("r2"))

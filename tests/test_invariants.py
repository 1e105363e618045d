"""Operators without SQL twin: known answers, brute force, edge frames."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import arima, evaluate, events, models, paths, prep, profiling, quality, selection, series, signal, text, vectors
from cairn.plans.lineage import written
from cairn.plans.ordered import running, sequence
from cairn.plans.quantiles import quantiles
from cairn.plans.recurrence import affine_scan
from cairn.plans.skew import split_join


def frame(spark, values, name="s"):
    rows = [(name, i * 3600, float(v) if v is not None else None, i + 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, t long, value double, seq long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def column(df, c, order="seq"):
    return [r[c] for r in df.orderBy(order).collect()]


def simulated(n=3000, phi=0.6, theta=0.0, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 100)
    x = np.zeros(n + 100)
    for t in range(1, n + 100):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    return x[100:] + 10


@pytest.mark.parametrize("bound", ["1000000", "100"])
def test_ar1_and_ma1(spark, bound):
    spark.conf.set("spark.cairn.taskRows", bound)
    try:
        est = {r["name"]: r["value"] for r in arima.arima_estimate(frame(spark, simulated()), (1, 0, 0)).collect()}
        assert abs(est["AR(1)"] - 0.6) < 0.05 and abs(est["Sigma2"] - 1) < 0.1
        est = {r["name"]: r["value"] for r in arima.arima_estimate(frame(spark, simulated(phi=0.0, theta=0.5)), (0, 0, 1)).collect()}
        assert abs(est["MA(1)"] - 0.5) < 0.07
    finally:
        spark.conf.unset("spark.cairn.taskRows")


def test_arima_grid_prefers_ar(spark):
    best = arima.arima_grid(frame(spark, simulated(phi=0.8)), 2, 1).filter("aic_rank = 1").first()
    assert best["p"] >= 1


def test_forecast_of_line_with_differences(spark):
    f = arima.arima_forecast(frame(spark, [2.0 * i + (i % 2) * 0.01 for i in range(200)]), (0, 1, 0), periods=3)
    assert np.allclose(column(f, "forecast_value", "step"), [400.0, 402.0, 404.0], atol=0.1)


def test_stationarity_verdicts(spark):
    walk = np.cumsum(np.random.default_rng(3).normal(size=2000))
    noise = np.random.default_rng(4).normal(size=2000)
    for test in ("ADF", "PP"):
        assert series.stationarity_test(frame(spark, walk), test).first()["verdict"] == "Non-stationary"
        assert series.stationarity_test(frame(spark, noise), test).first()["verdict"] == "Stationary"
    assert series.stationarity_test(frame(spark, walk), "KPSS", 8).first()["verdict"] == "Non-stationary"


def test_pacf_of_ar1(spark):
    p = column(series.pacf(frame(spark, simulated(8000)), 4), "pacf_value", "lag")
    assert abs(p[0] - 0.6) < 0.05 and max(map(abs, p[1:])) < 0.06


def test_change_points_found(spark):
    v = [0.0] * 100 + [5.0] * 100 + [-3.0] * 100
    got = sorted(r["change_seq"] for r in series.change_point(frame(spark, v), max_points=3, penalty=1.0).collect())
    assert got == [100, 200]


def test_chi_square_table():
    assert [round(series.chi_square_quantile(0.95, d), 3) for d in (1, 5, 10, 20)] == [3.841, 11.07, 18.307, 31.41]


@pytest.mark.parametrize("n", [1, 2, 7, 200, 5000])
def test_fft_four_step_matches_numpy(spark, n):
    v = np.random.default_rng(0).normal(size=n)
    got = signal.fft(frame(spark, v)).orderBy("bin").collect()
    want = np.fft.fft(v, 1 << (n - 1).bit_length())
    assert np.allclose([complex(r["real"], r["imag"]) for r in got], want)


def test_fft_round_trip_and_parseval(spark):
    df = frame(spark, np.sin(np.arange(100) * 0.3) + 2)
    spec = signal.fft(df)
    assert signal.parseval_check(df, spec).first()["status"] == "PASS"
    assert signal.reconstruction_error(df, signal.ifft(spec)).first()["max_error"] < 1e-9


def test_known_tones(spark):
    n = np.arange(256)
    v = np.sin(2 * np.pi * 5 * n / 256) + 0.5 * np.sin(2 * np.pi * 20 * n / 256)
    top = column(signal.dominant_frequencies(signal.fft(frame(spark, v)), 2), "bin", "magnitude_rank")
    assert top == [5, 20]


@pytest.mark.parametrize("bound", ["1000000", "7"])
def test_recursions(spark, bound):
    spark.conf.set("spark.cairn.taskRows", bound)
    try:
        v = np.random.default_rng(2).normal(size=60)
        got = column(series.smooth(frame(spark, v), "exponential", alpha=0.3), "smoothed")
        s, want = v[0], []
        for x in v:
            s = 0.7 * s + 0.3 * x
            want.append(s)
        assert np.allclose(got, want)
        fitted = selection.candidate_forecasts(frame(spark, [3.0] * 40), ("holt_winters_add",), period=4)
        assert np.allclose(column(fitted, "fitted_value"), 3.0, atol=1e-6)
    finally:
        spark.conf.unset("spark.cairn.taskRows")


def test_butterworth_passes_dc(spark):
    out = column(signal.butterworth(frame(spark, [1.0] * 200), 0.1), "filtered")
    assert abs(out[-1] - 1.0) < 1e-6


def test_resample_cubic_on_parabola(spark):
    got = signal.resample_cubic(frame(spark, [i * i for i in range(10)]), 1800.0).filter("seq > 3 and seq < 17").orderBy("seq").collect()
    assert np.allclose([r["value"] for r in got], [((r["seq"] - 1) / 2) ** 2 for r in got])


@pytest.mark.parametrize("mode", ["NONOVERLAPPING", "OVERLAPPING"])
@pytest.mark.parametrize("pattern,regex", [("A.B*.C", "AB*C"), ("(A|B)+.C", "[AB]+C"), ("A.B?.A", "AB?A")])
def test_npath_against_regex(spark, mode, pattern, regex):
    rng = np.random.default_rng(5)
    seqs = {u: "".join(rng.choice(list("ABCX"), 60)) for u in range(5)}
    rows = [(u, i, s) for u, t in seqs.items() for i, s in enumerate(t)]
    df = spark.createDataFrame(rows, "u int, event_id int, s string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = sorted((r["u"], r["path"]) for r in paths.npath(df, "u", "ts", [(x, F.col("s") == x) for x in "ABC"], pattern, mode).collect())
    if mode == "NONOVERLAPPING":
        want = [(u, m) for u, t in seqs.items() for m in re.findall(regex, t)]
    else:
        want = [(u, m.group()) for u, t in seqs.items() for i in range(60) if (m := re.match(regex, t[i:]))]
    assert got == sorted(want)


def test_session_gap_equal_to_timeout_stays(spark):
    rows = [(1, 0, 1), (1, 1800, 2), (1, 3601, 3)]
    df = spark.createDataFrame(rows, "user_id int, s long, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["session_id"] for r in events.sessionize(df).orderBy("event_id").collect()] == [1, 1, 2]


def test_attribution_credits_sum_to_value(spark):
    rows = [(1, i, i, "c%d" % (i % 3), int(i in (4, 9)), 100.0) for i in range(12)]
    df = spark.createDataFrame(rows, "user_id int, d int, event_id int, channel string, conversion_flag int, conversion_value double") \
              .withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    got = paths.attribution(df).agg(*[F.sum(m).alias(m) for m in paths.MODELS]).first()
    assert all(abs(got[m] - 200.0) < 1e-9 for m in paths.MODELS)


def test_doc_similarity_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, 12))) for i in range(60)]
    docs += [(60 + i, docs[i][1] + " w1") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    f = text.tfidf_transform(df, text.tfidf_fit(df))
    got = {(r["doc1"], r["doc2"]): r["cosine"] for r in text.doc_similarity(f, threshold=0.4, top=100).collect()}
    vec = {}
    for r in f.filter("tfidf_value > 0").collect():
        vec.setdefault(r["doc_id"], {})[r["term"]] = r["tfidf_value"]
    norm = {d: sum(x * x for x in v.values()) ** 0.5 for d, v in vec.items()}
    want = {}
    for a in vec:
        for b in vec:
            c = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items()) / norm[a] / norm[b]
            if a != b and c >= 0.4:
                want[(a, b)] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    spark.conf.set("spark.cairn.taskRows", "3")  # every prefix term counts as crowded
    try:
        again = {(r["doc1"], r["doc2"]) for r in text.doc_similarity(f, threshold=0.4, top=100).collect()}
    finally:
        spark.conf.unset("spark.cairn.taskRows")
    assert again == got.keys()


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "id int, v array<double>")
    got = vectors.vector_distance(df, df, "id", "v", "cosine", 2).collect()
    assert {(r["target_id"], r["reference_id"]) for r in got} == {(1, 3), (3, 1)}  # a zero vector has no angle
    assert vectors.vector_quality(df, "v").first()["zero_vectors"] == 1


def test_split_join_hot_key(spark, small_tasks):
    rows = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert split_join(rows, table, "k").count() == 300


def test_sequence_with_ties_and_nulls(spark, small_tasks):
    df = spark.range(200).select(F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("x"), "id")
    got = sequence(df, [], ["x", "id"]).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 201))
    assert [r["id"] for r in got] == [r["id"] for r in df.orderBy("x", "id").collect()]


def test_quantiles_of_hot_group(spark, small_tasks):
    df = spark.range(1000).select((F.col("id") % 13).cast("double").alias("v"))
    got = quantiles(df, {"a": ("v", .1), "b": ("v", .5), "c": ("v", .99)}).first()
    want = np.quantile([i % 13 for i in range(1000)], [.1, .5, .99])
    assert np.allclose([got["a"], got["b"], got["c"]], want)


def test_edge_frames(spark):
    empty = spark.createDataFrame([], "series_id string, ts timestamp, value double, seq long")
    for op in (series.series_summary, series.acf, series.noise_level, series.regularity, selection.confidence_interval):
        assert op(empty).count() == 0
    one = frame(spark, [5.0])
    assert series.series_summary(one).first()["n_observations"] == 1
    assert series.lag_features(one).count() == 1
    flat = frame(spark, [2.0] * 40)
    assert series.acf(flat, 3).first()["acf_value"] is None
    for n, ready in ((29, "WARNING"), (30, "ACCEPTABLE"), (49, "ACCEPTABLE"), (50, "GOOD"), (99, "GOOD"), (100, "EXCELLENT")):
        assert series.series_summary(frame(spark, range(n))).first()["data_sufficiency"].startswith(ready)
    assert selection.blocked_folds(frame(spark, range(10))).count() == 10


def test_one_sided_classes_and_zero_actuals(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b")], "actual string, predicted string")
    got = {r["class_label"]: (r["tp"], r["fn"], r["fp"]) for r in evaluate.class_metrics(df, "actual", "predicted").collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 2), "c": (0, 1, 0)}
    reg = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, p double")
    m = {r["metric_name"]: r["metric_value"] for r in evaluate.regression_metrics(reg, "a", "p").collect()}
    assert m["MAPE"] == 50.0 and m["R2"] == 0.0


def test_quality_of_null_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a double, b int")
    got = {r["column_name"]: r["completeness_score"] for r in quality.completeness(df).collect()}
    assert got == {"a": 25, "b": 100}
    assert profiling.numeric_profile(df, ["a", "b"]).count() == 2


def test_onehot_unknown_and_rows(spark):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    fit = prep.onehot_fit(df.filter("c = 'x'"), ["c"])
    assert [(r["c_x"], r["has_unknown"]) for r in prep.onehot_transform(df, fit, ["c"]).orderBy("c").collect()] == [(1, 0), (0, 1)]
    given = prep.onehot_transform(df, fit, ["c"], {"c": ["y", "z"]}).orderBy("c").collect()
    assert [(r["c_y"], r["c_z"], r["has_unknown"]) for r in given] == [(0, 0, 1), (1, 0, 0)]
    long = prep.onehot_rows(df, fit, ["c"], ["c"])
    assert sorted(((r["c"], r["column_name"], r["value"]) for r in long.collect()), key=repr) == [("x", "c", "x"), ("y", "c", None)]


def test_tree_nodes_are_consistent(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 < 10, "lo").otherwise("hi").alias("y"))
    m, labels = models.decision_tree(df, "y", ["x"], max_depth=3, splits=31)
    nodes = models.tree_nodes(m, ["x"], labels, spark)
    root = nodes.filter("node_id = 1").first()
    assert root["sample_count"] == 400 and root["split_variable"] == "x"
    assert nodes.filter("node_type = 'Leaf'").agg(F.sum("sample_count")).first()[0] == 400
    p = models.predict(df, m, ["x"], ["id", "y"], labels)
    assert p.filter("prediction = y").count() == 400


def test_doc_similarity_lists_no_pairs(spark):
    """200 documents share their rarest terms: their 19,900 pairs are compared in tiles, and only the best of each document are rows."""
    rng = np.random.default_rng(8)
    docs = [(i, "shared passage " + " ".join(rng.choice([f"w{k}" for k in range(300)], 6))) for i in range(200)] + [(1000 + i, f"w{i} w{i + 1}") for i in range(299)]
    f = text.tfidf_transform(df := spark.createDataFrame(docs, "doc_id long, text string"), text.tfidf_fit(df))
    got = text.doc_similarity(f, threshold=0.3, top=3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    vec = {}
    for r in f.filter("tfidf_value > 0").collect():
        vec.setdefault(r["doc_id"], {})[r["term"]] = r["tfidf_value"]
    ids, terms = sorted(vec), sorted({t for v in vec.values() for t in v})
    m = np.array([[vec[d].get(t, 0.0) for t in terms] for d in ids])
    m /= np.linalg.norm(m, axis=1)[:, None]
    c = m @ m.T
    np.fill_diagonal(c, 0.0)
    want = {}
    for i, d in enumerate(ids):
        best = [j for j in np.lexsort((ids, -np.round(c[i], 9)))[:3] if c[i, j] >= 0.3]
        want |= {(d, ids[j]): c[i, j] for j in best}
    assert len(want) > 300 and {(r["doc1"], r["doc2"]): round(r["cosine"], 7) for r in got.collect()} == {k: round(v, 7) for k, v in want.items()}


def test_doc_similarity_sends_no_document_per_tile(spark, monkeypatch):
    """Whatever the number of tiles, a document is dealt once, and tiles are paired where they are read."""
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(80)], 12))) for i in range(300)]
    f = text.tfidf_transform(df := spark.createDataFrame(docs, "doc_id long, text string"), text.tfidf_fit(df))
    want = {(r["doc1"], r["doc2"], round(r["cosine"], 9)) for r in text.doc_similarity(f, threshold=0.3, top=4).collect()}
    monkeypatch.setattr(text, "TILE_ENTRIES", 200)
    rows = []
    monkeypatch.setattr(text, "written", lambda table, tidy=False: (rows.append(made := written(table, tidy)), made)[1])
    got = text.doc_similarity(f, threshold=0.3, top=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan
    tiles = rows[-1].select("tile", F.explode("id").alias("id")).collect()
    assert len({t.tile for t in tiles}) > 10 and sorted(t.id for t in tiles) == list(range(300))
    assert len(want) > 100 and {(r["doc1"], r["doc2"], round(r["cosine"], 9)) for r in got.collect()} == want


def test_doc_similarity_of_repeated_terms(spark, monkeypatch):
    """A term that comes twice in a document counts with the sum of its weights, also where it is a common one."""
    rows = [(d, f"t{k}", 1.0) for d in (1, 2) for k in range(9) for _ in range(2)] + [(d, "other", 1.0) for d in (2, 3)]
    monkeypatch.setattr(text, "COMMON", 0.0)
    monkeypatch.setattr(text, "DENSE", 0)
    got = text.doc_similarity(spark.createDataFrame(rows, "doc_id long, term string, tfidf_value double"), threshold=1.5).collect()
    assert {(r["doc1"], r["doc2"], round(r["cosine"], 9)) for r in got} == {(1, 2, round(36 / (18 * 19) ** 0.5, 9)), (2, 1, round(36 / (18 * 19) ** 0.5, 9))}


def test_written_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(5, "n"), tidy=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(name) == kept
    assert table.agg(F.sum("n")).first()[0] == 1000


@pytest.mark.parametrize("rare", [0, 20, 60])
def test_similar_in_a_tile(monkeypatch, rare):
    """Any line between rare and common terms gives the same pairs, and so do short slices."""
    monkeypatch.setattr(text, "CHUNK_SCORES", 50)
    rng = np.random.default_rng(9)
    m = [np.where(rng.random((n, 60)) < 0.1, rng.random((n, 60)), 0.0) for n in (30, 17)]
    m[0][3] = 0.0
    m[1][:5] = m[0][10:15]
    m = [x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None] for x in m]
    sparse = lambda x: (np.concatenate([[0], np.cumsum((x > 0).sum(1))]), np.nonzero(x)[1] + 1, x[x > 0])
    for a, b, same in ((m[0], m[1], False), (m[0], m[0], True)):
        c = a @ b.T
        want = {(i, j): c[i, j] for i, j in np.argwhere(c >= 0.4).tolist() if not (same and i == j)}
        i, j, s = text.similar(sparse(a), sparse(b), rare, 0.4, same)
        got = dict(zip(zip(i.tolist(), j.tolist()), s))
        assert len(got) == len(i) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)

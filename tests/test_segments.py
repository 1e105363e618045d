"""The optimal cutting of series against the full search, and the CUSUM test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import series as ts
from cairn.plans.segments import Search


def full_search(x, penalty, least):
    """Cost and cuts by the plain quadratic programme."""
    n, a, b = len(x), np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(np.square(x))])
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    cost[0] = -penalty
    for t in range(least, n + 1):
        s = np.arange(0, t - least + 1)
        c = cost[s] + penalty + b[t] - b[s] - (a[t] - a[s]) ** 2 / (t - s)
        back[t] = s[c.argmin()]
        cost[t] = c.min()
    cuts, now = [], back[n]
    while now:
        cuts.append(int(now))
        now = back[now]
    return cost[n], cuts[::-1]


def price(x, cuts, penalty):
    parts = np.split(x, cuts)
    return sum(((p - p.mean()) ** 2).sum() for p in parts) + penalty * len(cuts)


def steps(n, cuts, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.normal(0, 4), spread, len(p)) for p in np.split(np.arange(n), cuts)])


def searched(x, penalty, least, ends):
    search, ways = Search(penalty, x.min() - 1e-9, x.max() + 1e-9, least), {}
    for part in np.split(x, ends):
        search = Search.resume(search.state())
        ways.update({s: (out, [int(r) + search.t - len(part) + 1 for r in rows]) for s, out, rows, _ in search.feed(part)} if len(part) else {})
    cuts, now = [], len(x)
    while now:
        now, rows = ways[now]
        cuts += rows
    return sorted(cuts)[:-1]


@pytest.mark.parametrize("seed", range(12))
def test_same_cost_as_the_full_search(seed):
    rng = np.random.default_rng(seed)
    n, least, penalty = int(rng.integers(1, 300)), int(rng.integers(1, 15)), float(rng.choice([0.5, 3, 12, 40]))
    x = steps(n, sorted(rng.integers(0, n, 4)), seed) if seed % 4 else rng.normal(size=n)
    want, cuts = full_search(x, penalty, least)
    got = searched(x, penalty, least, sorted(rng.integers(0, n, 3)))
    if n >= least:
        assert price(x, got, penalty) == pytest.approx(want + 0.0, rel=1e-9, abs=1e-9) and got == cuts
        assert min(len(p) for p in np.split(x, got)) >= least
    else:
        assert got == []


@pytest.mark.parametrize("x", [np.zeros(50), np.repeat([0.0, 1.0], 25), np.tile([0.0, 1.0], 25), np.arange(60.0)])
def test_ties(x):
    want, _ = full_search(x, 1.0, 2)
    assert price(x, searched(x, 1.0, 2, [7, 8, 31]), 1.0) == pytest.approx(want, abs=1e-9)


def test_few_starts_stay_without_a_change():
    search = Search(2 * np.log(5000), -6.0, 6.0, 1)
    search.feed(np.random.default_rng(0).normal(size=5000))
    assert len(search.pieces) < 100


def frame(spark, series):
    rows = [(k, i * 3600, float(v), i + 1) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, t long, value double, seq long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("bound", ["2000000", "40"])
def test_optimal_change_points(spark, bound):
    series = {"a": steps(200, [50, 120, 160], 1), "b": steps(90, [], 2), None: steps(150, [70], 3), "short": np.array([1.0, 9.0, 2.0]), "flat": np.full(60, 5.0)}
    spark.conf.set("spark.cairn.taskRows", bound)
    try:
        found = ts.change_point(frame(spark, series), min_segment=5, penalty=15, method="optimal").collect()
    finally:
        spark.conf.unset("spark.cairn.taskRows")
    for k, x in series.items():
        rows = sorted((r for r in found if r.series_id == k), key=lambda r: r.change_seq)
        cuts = full_search(x - x.mean(), 15, 5)[1]
        assert [r.change_seq for r in rows] == cuts and [r.point_no for r in rows] == list(range(1, len(cuts) + 1))
        for i, row in enumerate(rows):
            lo, hi = ([0] + cuts)[i], (cuts + [len(x)])[i + 1]
            gain = price(x[lo:hi], [], 0) - price(x[lo:hi], [cuts[i] - lo], 0)
            assert row.gain == pytest.approx(gain) and row.change_ts.timestamp() % 3600 == 0
    assert any(r.series_id is None for r in found)


def test_default_penalty_and_empty_input(spark):
    x = steps(300, [100, 200], 7)
    d = np.diff(x)
    got = [r.change_seq for r in ts.change_point(frame(spark, {"a": x}), 5, method="optimal").orderBy("change_seq").collect()]
    assert got == full_search(x - x.mean(), (d * d).mean() * np.log(300), 5)[1]
    assert ts.change_point(frame(spark, {"a": x}).limit(0), method="optimal").count() == 0


def test_cusum(spark):
    rng = np.random.default_rng(5)
    series = {"shift": np.concatenate([rng.normal(0, 1, 80), rng.normal(3, 1, 40)]), "none": rng.normal(size=120), "flat": np.ones(30)}
    rows = {r.series_id: r for r in ts.change_point(frame(spark, series), method="cusum").collect()}
    assert set(rows) == {"shift", "none"}
    assert abs(rows["shift"].change_seq - 80) <= 3 and rows["shift"].p_value < 1e-4 and rows["none"].p_value > 0.01
    x, k = series["shift"], rows["shift"].change_seq
    assert rows["shift"].gain == pytest.approx(price(x, [], 0) - price(x, [k], 0))
    # the 5 % point of the largest distance of a Brownian bridge is 1.358
    assert 2 * sum((-1) ** (j - 1) * np.exp(-2 * (j * 1.358) ** 2) for j in range(1, 9)) == pytest.approx(0.05, abs=1e-3)
    with pytest.raises(ValueError):
        ts.change_point(frame(spark, series), method="other")

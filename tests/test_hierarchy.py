"""Nested clusters: one tree of splits, against a plain version."""

import numpy as np
import pytest

from cairn.operators import cluster as cl


def plain(x, leaves, max_iter, tol):
    """Leaf of each row and (order, height) of the splits."""
    sse = lambda m: float(((x[m] - x[m].mean(0)) ** 2).sum())
    spread = lambda m: sse(m) if len(np.unique(x[m], axis=0)) > 1 else 0.0
    members, parent, heights, open_ = {1: np.arange(len(x))}, {1: None}, {}, [1]
    ends = {1}
    while open_ and len(heights) + 1 < leaves:
        chosen = sorted((n for n in open_ if spread(members[n]) > 0), key=lambda n: (-spread(members[n]), n))[:leaves - 1 - len(heights)]
        open_ = []
        for n in chosen:
            m = members[n]
            j = x[m].var(0).argmax()
            side, low = x[m][:, j] > x[m][:, j].mean(), None
            for _ in range(max_iter):
                before = sse(m[~side]) + sse(m[side])
                lo, hi = x[m[~side]].mean(0), x[m[side]].mean(0)
                new = ((x[m] - hi) ** 2).sum(1) < ((x[m] - lo) ** 2).sum(1)
                now = sse(m[~new]) + sse(m[new])
                side = new
                if before - now <= tol * before:
                    break
            kids = len(members) + 1, len(members) + 2
            members |= {kids[0]: m[~side], kids[1]: m[side]}
            parent |= {k: n for k in kids}
            heights[n] = sse(m) - sse(m[~side]) - sse(m[side])
            ends = ends - {n} | set(kids)
            open_ += kids
    return {int(i): e for e in ends for i in members[e]}, parent, heights


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")


@pytest.mark.parametrize("leaves, max_iter", [(2, 0), (5, 0), (8, 20), (7, 3)])
def test_same_tree_as_the_plain_version(spark, leaves, max_iter):
    rng = np.random.default_rng(leaves)
    x = np.concatenate([rng.normal(c, 0.7, (30, 3)) for c in rng.normal(0, 5, (5, 3))])
    rows, nodes = cl.split_tree(frame(spark, x), "i", "v", leaves, max_iter)
    leaf, parent, heights = plain(x, leaves, max_iter, 0.001)
    assert {r["__id"]: r.node for r in rows.collect()} == leaf
    assert {n["node"]: n["parent"] for n in nodes} == parent
    assert {n["node"]: pytest.approx(n["height"]) for n in nodes if n["height"] is not None} == heights
    assert [n["node"] for n in sorted((n for n in nodes if n["order"]), key=lambda n: n["order"])] == list(heights)


def test_levels_are_nested(spark):
    x = np.random.default_rng(3).normal(size=(200, 4))
    h = cl.hierarchical_clustering(frame(spark, x), "i", "v", (2, 3, 6, 8)).collect()
    at = {(r.level, int(r.id)): r for r in h if r.result_type == "assignment"}
    cents = {(r.level, r.cluster_id): r for r in h if r.result_type == "centroid"}
    assert len(at) == 4 * 200
    for k, before in ((2, None), (3, 2), (6, 3), (8, 6)):
        got = [at[k, i] for i in range(200)]
        assert {r.cluster_id for r in got} == set(range(k))
        for r in got:
            assert r.parent_id == (None if before is None else at[before, int(r.id)].cluster_id)
        for c in range(k):
            m = [i for i in range(200) if at[k, i].cluster_id == c]
            assert cents[k, c].size == len(m) and np.allclose(cents[k, c].features, x[m].mean(0))
            assert np.allclose([at[k, i].distance_to_centroid for i in m], np.linalg.norm(x[m] - x[m].mean(0), axis=1))
    heights = sorted({r.height for (k, _), r in cents.items() if k == 8})
    tree = {r.node: r for r in cl.cluster_tree(frame(spark, x), "i", "v", 8).collect()}
    assert set(np.round(heights, 6)) <= {round(r.height, 6) for r in tree.values() if r.height}
    total = tree[1].sse - sum(r.sse for r in tree.values() if r.left is None)
    assert total == pytest.approx(sum(r.height for r in tree.values() if r.height))


def test_equal_missing_and_no_vectors(spark):
    same = frame(spark, np.ones((20, 2)))
    h = cl.hierarchical_clustering(same, "i", "v").collect()
    assert {r.cluster_id for r in h} == {0} and sum(r.result_type == "centroid" for r in h) == 3
    two = frame(spark, np.repeat([[0.0, 1.0], [4.0, 1.0]], 10, 0)).unionByName(spark.createDataFrame([(99, None)], "i long, v array<double>"))
    h = cl.hierarchical_clustering(two, "i", "v", (2, 4)).collect()
    assert {(r.level, r.cluster_id) for r in h} == {(2, 0), (2, 1), (4, 0), (4, 1)} and all(r.id != "99" for r in h)
    assert cl.hierarchical_clustering(same.limit(0), "i", "v").count() == 0
    assert cl.cluster_tree(same.limit(0), "i", "v").count() == 0


@pytest.mark.parametrize("name", ["x", "node", "level", "centroid"])
def test_any_name_of_the_id(spark, name):
    df = frame(spark, np.array([[0.0], [1.0], [9.0], [10.0]])).withColumnRenamed("i", name)
    h = cl.hierarchical_clustering(df, name, "v", (2,)).filter("result_type = 'assignment'")
    assert {(r.id, r.cluster_id) for r in h.collect()} == {("0", 0), ("1", 0), ("2", 1), ("3", 1)}

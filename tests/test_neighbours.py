"""Indexed nearest vectors against all pairs."""

import numpy as np
import pytest

from cairn.operators.neighbours import compared_pairs, nearest_vectors
from cairn.operators.vectors import vector_distance


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "i long, v array<double>")


def clustered(n, centres, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


def plain(a, b, measure, top, same):
    out = set()
    for i, x in enumerate(a):
        if measure == "cosine":
            d = 1 - b @ x / (np.linalg.norm(b, axis=1) * np.linalg.norm(x))
        else:
            d = np.abs(b - x).sum(1) if measure == "manhattan" else np.sqrt(((b - x) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(b)), np.round(d, 9))) if not (same and i == j)][:top]
        out |= {(i, int(j), round(float(d[j]), 7)) for j in order}
    return out


def rows(df):
    return {(r.target_id, r.reference_id, round(r.distance, 7) + 0.0) for r in df.collect()}


@pytest.mark.parametrize("measure", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("noise", [False, True])
def test_same_as_all_pairs(spark, measure, noise):
    x = np.random.default_rng(1).normal(size=(150, 5)) if noise else clustered(220, 12, 5, 2)
    x[30] = x[90] = x[17]
    df = frame(spark, x)
    got = rows(nearest_vectors(df, df, "i", "v", measure, 4, cells=10, block_rows=16))
    assert got == plain(x, x, measure, 4, True)


def test_two_sides_that_lie_apart(spark):
    a, b = clustered(60, 4, 3, 5) + 20, clustered(130, 6, 3, 6)
    got = rows(nearest_vectors(frame(spark, a), frame(spark, b), "i", "v", top=2, skip_self=False, cells=7, block_rows=8))
    assert got == plain(a, b, "euclidean", 2, False)


def test_few_pairs_where_vectors_cluster(spark):
    x = clustered(1500, 30, 16, 3)
    df = frame(spark, x)
    r = compared_pairs(df, df, "i", "v", cells=64, block_rows=32).first()
    assert r.all_pairs == 1500 ** 2 and r.compared < 0.25 * r.all_pairs


@pytest.mark.parametrize("noise, probes", [(False, 4), (True, 20)])
def test_recall_of_the_approximate_form(spark, noise, probes):
    x = np.random.default_rng(4).normal(size=(800, 8)) if noise else clustered(800, 25, 12, 7, 0.2)
    df = frame(spark, x)
    args = dict(id_col="i", vector="v", top=5, cells=40, block_rows=32, approximate=True, probes=probes)
    got, want = rows(nearest_vectors(df, df, **args)), plain(x, x, "euclidean", 5, True)
    assert len(got & want) / len(want) >= 0.9
    r = compared_pairs(df, df, **args).first()
    assert r.compared < (0.75 if noise else 0.5) * r.all_pairs


def test_few_missing_and_no_vectors(spark):
    df = frame(spark, [[1, 0], None, [0, 0], [float("nan"), 1], [2, 0], []])
    assert {r[:2] for r in rows(nearest_vectors(df, df, "i", "v", "cosine"))} == {(0, 4), (4, 0)}
    assert {r[:2] for r in rows(nearest_vectors(df, df, "i", "v"))} == {(0, 2), (0, 4), (2, 0), (2, 4), (4, 0), (4, 2)}
    assert nearest_vectors(df, df.limit(0), "i", "v").count() == 0 and nearest_vectors(df.limit(0), df, "i", "v").count() == 0


def test_same_rows_as_the_block_product(spark):
    df = frame(spark, clustered(90, 5, 4, 8))
    assert rows(nearest_vectors(df, df, "i", "v", cells=5, block_rows=10)) == rows(vector_distance(df, df, "i", "v"))

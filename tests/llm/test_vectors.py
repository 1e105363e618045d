"""Vector codes and hard negatives, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import op11_codes as codes
from cairn.llm import op12_negatives as neg

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, width, seed, centres=12, spread=40):
    rng = np.random.default_rng(seed)
    c = rng.integers(-2000, 2000, (centres, width))
    return c[rng.integers(0, centres, n)] + rng.integers(-spread, spread, (n, width))


@pytest.mark.parametrize("x", [clustered(3000, 8, 1), np.random.default_rng(2).integers(-900, 900, (1500, 8)), np.repeat(clustered(5, 3, 3), 200, 0), np.zeros((7, 4), int), clustered(1, 4, 4)])
def test_tree_settles_every_point(x):
    tree = codes.BallTree.unpack(codes.BallTree(x.astype(np.int64)).pack())
    assert sorted(tree.order) == list(range(len(x)))
    for a, b, c, r in zip(tree.start, tree.stop, tree.centre, tree.radius):
        assert np.sqrt(((tree.points[a:b] - c) ** 2).sum(1)).max() <= r * (1 + 1e-9) + 1e-9
    assert (tree.sums[0] == x.sum(0)).all()
    for entries in (x[:16].astype(np.int64), np.concatenate([x[:4], x[:4] + 1, x[:4]]).astype(np.int64)):  # with equal entries
        d = ((x[:, None, :] - entries) ** 2).sum(2)
        want = d.argmin(1)
        got, error = codes.nearest(tree, entries)
        assert (got == want).all() and (error == d.min(1)).all()
        sums, counts = codes.owned_sums(tree, entries)
        assert (counts == np.bincount(want, minlength=len(entries))).all()
        assert (sums == np.array([x[want == e].sum(0) for e in range(len(entries))])).all()


def test_inherited_lists_shrink():
    """Share of (point, entry) distances that are computed: few for clusters, half for even noise."""
    for x, most in ((clustered(4000, 8, 5, centres=16), 0.1), (np.random.default_rng(6).integers(-900, 900, (4000, 8)), 0.6)):
        tree = codes.BallTree(x.astype(np.int64))
        _, _, places, mask = codes._settle(tree, x[:16].astype(np.int64))
        assert mask.sum() < most * 16 * len(x)


def naive_codes(rows, parts, entries, rounds, factor):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(factor * np.array(v, np.float32).astype(float)) for _, v, _ in kept]).astype(np.int64)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0], x[i].tolist()))[:entries]
    out, books = [], []
    for p in np.split(x, parts, axis=1):
        b = p[first].copy()
        for r in range(rounds + 1):
            d = ((p[:, None] - b) ** 2).sum(2)
            at = d.argmin(1)
            if r < rounds:
                for e in range(len(b)):
                    if (at == e).any():
                        b[e] = p[at == e].sum(0) // (at == e).sum()
        out.append((at, d.min(1)))
        books.append(b)
    code = ["".join(f"{a[i]:02x}" for a, _ in out) for i in range(len(kept))]
    return sorted((k[0], c, int(sum(d[i] for _, d in out))) for i, (k, c) in enumerate(zip(kept, code))), np.array(books)


def table(spark, n=120, width=16, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(7, rows[7][1], 1), (n, None, 1), (n + 1, [None] + [1.0] * (width - 1), 0), (n + 2, [float("nan")] * width, 0),
             (n + 3, [float("inf")] * width, 2), (n + 4, rows[3][1], None), (n + 5, rows[3][1], None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rows, df = table(spark)
    want, books = naive_codes(rows, 4, 16, 6, 4096.0)
    coded, got = codes.compress(df.withColumn("code", F.lit("x")).repartition(3), parts=4)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == want
    assert (got == books).all()
    total = {}
    for (i, _, e), lab in zip(want, [lab for _, _, lab in sorted((r for r in rows if r[0] <= 119 or r[0] > 123), key=lambda r: (r[0], r[2] is None))]):
        total[lab] = total.get(lab, 0) + e
    found = {(r.label, r.label_error) for r in codes.with_label_error(coded).select("label", "label_error").collect()}
    assert {k for k, _ in found} == {"0", "1", "2", None} and sum(e for _, e in found) == sum(e for _, _, e in want)
    assert dict(found)[None] == total[None]


def test_codes_of_odd_tables(spark):
    few = spark.createDataFrame([(5, [1.0, 2.0, 3.0], 1), (6, [], 1), (7, [0.5], None)], SCHEMA)
    coded, books = codes.compress(few, parts=2)
    assert books.shape == (2, 3, 2) and {r.vec_id: r.error for r in coded.collect()} == {5: 0, 6: 0, 7: 0}
    coded, books = codes.compress(few.filter("false"))
    assert coded.count() == 0 and books.shape[1] == 0 and codes.with_label_error(coded).count() == 0 and len(codes.digest(books)) == 64
    with pytest.raises(ValueError):
        codes.compress(few, entries=300)


def naive_negatives(rows, every, positives, negatives, band, factor):
    kept = [(i, np.floor(factor * np.array(v, np.float32).astype(float)).astype(np.int64), lab) for i, v, lab in rows
            if v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q, lab in kept:
        if i % every:
            continue
        own = sorted(((-int(q @ x), j) for j, x, k in kept if k == lab and j != i))[:positives]
        other = sorted((-int(q @ x), j) for j, x, k in kept if k != lab)
        for s, p in own:
            good = [(-n, j) for n, j in other if band[0] * -s <= 100 * -n <= band[1] * -s][:negatives]
            out += [(i, p, r + 1, j, -s, n) for r, (n, j) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("width", [16, 5, 70])
def test_negatives_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(neg, "BLOCK", 40)
    monkeypatch.setattr(neg, "ANCHORS", 6)
    rows, df = table(spark, n=150, width=width, seed=width)
    got = neg.hard_negatives(df.withColumn("uid", F.lit(1)).withColumn("block", F.lit(2)).repartition(4), every=5)
    assert sorted(map(tuple, got.collect())) == naive_negatives(rows, 5, 5, 3, (50, 95), 256.0)


def test_negatives_with_ties_and_odd_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(0, 60, 5)] + [(i, [0.75, 0.0], 1) for i in range(1, 40)], SCHEMA)
    got = sorted(map(tuple, neg.hard_negatives(same, positives=2, negatives=2).collect()))
    assert got == [(0, 5, 1, 1, 65536, 49152), (0, 5, 2, 2, 65536, 49152), (0, 10, 1, 1, 65536, 49152), (0, 10, 2, 2, 65536, 49152),
                   (50, 0, 1, 1, 65536, 49152), (50, 0, 2, 2, 65536, 49152), (50, 5, 1, 1, 65536, 49152), (50, 5, 2, 2, 65536, 49152)]
    assert neg.hard_negatives(same.filter("label = 0")).count() == 0
    assert neg.hard_negatives(same.filter("false")).count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0], i % 2) for i in range(0, 100, 25)], SCHEMA)
    assert sorted(map(tuple, neg.hard_negatives(zeros).collect())) == [(0, 50, 1, 25, 0, 0), (0, 50, 2, 75, 0, 0), (50, 0, 1, 25, 0, 0), (50, 0, 2, 75, 0, 0)]


def test_blocks_are_paired_without_a_broadcast(spark, monkeypatch):
    """The anchors, once for each block of data, are no table that the driver sends, however small their file is."""
    monkeypatch.setattr(neg, "BLOCK", 40)
    rows, df = table(spark, n=150, width=8, seed=3)
    got = neg.hard_negatives(df, every=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan
    assert sorted(map(tuple, got.collect())) == naive_negatives(rows, 5, 5, 3, (50, 95), 256.0)


@pytest.mark.parametrize("width", [3, 64, 100])
def test_intervals_hold_the_product(width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.integers(-300, 300, (500, width)), np.zeros((2, width), int), rng.integers(-2 ** 27, 2 ** 27, (20, width))]).astype(np.int64)
    r = neg.Rotation(width)
    c = neg.Codes.unpack(neg.Codes(x, r).pack(), len(x))
    for q in (*x[:20], x[500], x[-1]):
        _, low, high = neg.intervals(q, c, r)
        true = x.astype(float) @ q.astype(float)
        assert (low <= true).all() and (true <= high).all()
    # the interval is a good deal shorter than that of the lengths alone
    _, low, high = neg.intervals(x[0], neg.Codes(x[:500], r), r)
    assert width < 64 or (high - low).mean() < 0.4 * 2 * np.sqrt((x[0] ** 2).sum()) * np.sqrt((x[:500] ** 2).sum(1)).mean()


def test_few_rows_are_scored():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(40, 64))
    lab = rng.integers(0, 5, 4000)
    x = np.floor(60 * (c[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 64)))).astype(np.int64)
    ids, r = np.arange(4000), neg.Rotation(64)
    k, seen, of = neg.Codes(x, r), 0, 0
    for i in range(0, 4000, 200):
        best, found = neg.positives_block(x[i], i, lab[i], x, ids, lab, k, r, 5)
        _, more = neg.mine_block(x[i], lab[i], [int(s) for _, s in best], x, ids, lab, k, r, 3, (50, 95))
        seen += found.known.sum() + more.known.sum()
        of += len(x)
    assert seen < 0.3 * of

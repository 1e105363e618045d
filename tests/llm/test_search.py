import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import op10_benchmark
from cairn.llm.op10_benchmark import Tables, decontaminate, words
from cairn.llm.op6_topk import CoverTree, LOWEST, dual_search, top_k


def best(rows, k, every):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_tree_covers():
    x = np.random.default_rng(1).normal(size=(700, 8))
    x[100:160] = x[100]
    t = CoverTree(x)
    seen = []
    for i, kids in enumerate(t.children):
        d = np.sqrt(((x[t.points[i]] - t.centre[i]) ** 2).sum(1))
        assert d.max() <= t.radius[i] + 1e-9
        if kids:
            assert sorted(np.concatenate([t.points[k] for k in kids]).tolist()) == sorted(t.points[i].tolist())
        else:
            seen += t.points[i].tolist()
    assert sorted(seen) == list(range(700))


@pytest.mark.parametrize("seed", [1, 2])
def test_dual_search(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16)) * 800
    x = np.floor(centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 16)) * 60).astype(np.int64)
    q = x[::50]
    got = dual_search(q, np.arange(0, 3000, 50), np.full(len(q), LOWEST), x, np.arange(3000), 10)
    s = q @ x.T
    for i, (scores, ids) in enumerate(got.found):
        s[i, 50 * i] = -(1 << 62)
        order = np.lexsort((np.arange(3000), -s[i]))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == s[i][order].tolist()


def test_top_k_against_all_pairs(spark, monkeypatch):
    import cairn.llm.op6_topk as m

    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.7]) for _ in range(4)]) for i in range(300)]  # many ties
    rows += [(300, None), (302, [1.0, None, 0.0, 0.0]), (304, [float("nan"), 0.0, 0.0, 0.0]), (306, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (310, [1.0, 1.0]), (320, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    for data, queries in ((4096, 1024), (64, 5)):
        monkeypatch.setattr(m, "DATA_BLOCK", data)
        monkeypatch.setattr(m, "QUERY_BLOCK", queries)
        got = sorted(tuple(r) for r in top_k(df, every=10).collect())
        assert got == best([(i, None if v is None else [np.float32(x) if x is not None else None for x in v]) for i, v in rows], 10, 10)
    few = df.filter("vec_id < 4")
    assert sorted(tuple(r) for r in top_k(few, every=2).collect()) == best(rows[:4], 10, 2)
    assert top_k(df.filter("false")).count() == 0


def test_words():
    assert words("Ab-1c É_x\x7f日本。z\x80".encode()) == [w.encode() for w in ("ab", "1c", "É", "x", "日本。z\x80")]
    assert words(None) == words(b"") == words(b" .,") == []


def test_shift_tables():
    t = Tables({tuple(b"a b c d".split()): ["1"], tuple(b"b c d e".split()): ["2"], (b"x",): ["3"], (b"b", b"c"): ["4"]})
    assert sorted(t.search(b"z a b c d e x b".split())) == [(1, 5, ["1"]), (2, 4, ["4"]), (2, 6, ["2"]), (6, 7, ["3"])]
    assert t.by_length[4][0][b"a", b"b"] == 2


@pytest.mark.parametrize("limit", [op10_benchmark.PASS_WINDOWS, 7])
def test_decontaminate_against_brute_force(spark, limit):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, items[3][1].upper()), (21, ""), (22, None), (None, "t1 t2"), (5, "another text with one id here"), (23, "t0 " * 15)]
    docs = []
    for i in range(40):
        x = [rng.choice(vocabulary + ["other"] * 30) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            x += rng.choice(items[:14])[1].split() + ["t0"] * rng.randint(0, 30)
        docs.append((i, ", ".join(x)))
    docs += [(90, None), (91, ""), (1, docs[1][1]), (None, docs[3][1]), (92, "other " * 100_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    df = df.withColumn("_hits", F.lit("mine")).withColumn("_items", F.lit(7))
    got = decontaminate(df, spark.createDataFrame([(*b, 0) for b in items], "item_id long, text string, n int"), pass_windows=limit).collect()
    assert all(r["_hits"] == "mine" and r["_items"] == 7 for r in got)
    mine = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.hits), len(r["items"])) for r in got), key=repr)
    assert mine == sorted((r[:4] for r in op10_benchmark.brute(docs, items)), key=repr)
    none = decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("size(hits) > 0").count() == 0 and none.count() == len(docs)
    assert decontaminate(df.filter("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0

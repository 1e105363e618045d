import os
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import types as T

from cairn.llm import graph, op1_simhash
from cairn.llm.common import append_columns
from cairn.llm.graph import components
from cairn.llm.op1_simhash import anchors, at_words, drop_near_copies, fingerprint, group_links, linked, near_duplicates, shingle_hashes, simhash

WORDS = [f"w{i}" for i in range(400)]


def slow_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")
    words = [w for part in words for w in part.split() if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_definition():
    for t in ["", "One", "one TWO", "a b c", "Été à la mer\tÉté\x0bà la Mer", "x " * 500 + "y z"]:
        assert fingerprint(shingle_hashes(t.encode(), 3)) == slow_fingerprint(t)


@pytest.mark.parametrize("home,visit", [(0, 2), (1, 1), (2, 2)])
def test_anchors_cover(home, visit):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * 2 + rng.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, home + visit, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    at = [set(zip(*(v.tolist() for v in anchors(z.view(np.int64), e)))) for z, e in ((x, home), (y, visit))]
    assert all(any((i, a) in at[1] for a in (a for j, a in at[0] if j == i)) for i in range(0, 300, 7))
    rows, _ = anchors(x.view(np.int64), 0)
    assert rows.tolist() == list(range(300))  # one home each


def test_words_stand_for_anchors(spark):
    """A fingerprint is sent by the words of its anchors in the first block, below a quarter as often as there are anchors, which all come back."""
    x = np.random.default_rng(8).integers(-1 << 63, (1 << 63) - 1, 50)
    sent = at_words(spark.createDataFrame([(int(f),) for f in x], "fp long"), 2).collect()
    want = {(int(x[i]), a) for i, a in zip(*(v.tolist() for v in anchors(x, 2)))}
    got = set()
    for word in {r.word for r in sent}:
        fps = np.array([r.fp for r in sent if r.word == word])
        got |= {(int(fps[i]), a) for i, a in zip(*(v.tolist() for v in anchors(fps, 2, word)))}
    assert got == want and 4 * len(sent) < len(want) and len({tuple(r) for r in sent}) == len(sent)


def test_links_are_all_found(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits, home in ((2, 0), (4, 2)):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        got = [tuple(r) for r in linked(df, bits, home).collect()]
        assert set(got) == want and len(got) == len(want)


def test_group_links_lose_no_link(spark):
    rng = random.Random(11)
    fps = set()
    for _ in range(25):  # chains, of which only neighbours are close
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.add(f)
            f ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5)))
    fps = sorted(fps)
    rng.shuffle(fps)  # nodes in random order
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [tuple(r) for r in group_links(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long"), 4, 2).collect()]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert brute_components(range(len(fps)), got) == brute_components(range(len(fps)), links)
    assert len(got) == len(set(got)) and all(t < s for s, t in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (3, None)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 9: 5, **{i: 200 for i in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    docs = []
    for g in range(12):
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 80, 300]))]
        for _ in range(5):
            w = list(words)
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(w)))
    docs += [(900, None), (901, ""), (902, " \t\n"), (3, "other words here now"), (None, docs[20][1]), (None, "only here and nowhere else"), (950, "x " * 200_000)]
    fps = [(d, slow_fingerprint(t)) for d, t in docs]
    ids = {d for d, _ in docs if d is not None}
    links = [(a, b) for a, x in fps for b, y in fps if a is not None and b is not None and a < b and (x ^ y).bit_count() <= 2]
    root = brute_components(ids, links)
    by_fp = {}
    for d, f in fps:
        if d is not None:
            by_fp[f] = min(by_fp.get(f, d), d)
    want = sorted(((d, f, root[by_fp[f]] if f in by_fp else None) for d, f in fps), key=repr)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component_id string")
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == want


def test_links_and_labels_are_not_broadcast(spark, monkeypatch):
    """Visits of anchors and salted labels are many times the rows of the file by which Spark would size them."""
    plans, real = [], op1_simhash.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(op1_simhash, "cut", cut)
    monkeypatch.setattr(graph, "cut", cut)
    words = [" ".join(f"w{(7 * i + j * j) % 400}" for j in range(60)) for i in range(20)]
    docs = spark.createDataFrame([(i, w + " end" * (i % 2)) for i, w in enumerate(words + words)], "doc_id long, text string")
    near_duplicates(docs).count()
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)
    made = len(plans)
    rows = append_columns(docs, ["text"], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]),
                          lambda b: [list(x) for x in zip(*((i, -i) for i in range(b.num_rows)))])
    op1_simhash.joint_components(rows.select("doc_id", "a", "b"), ["a", "b"], 4, "doc_id").count()
    assert len(plans) > made + 5 and not any("Broadcast" in p for p in plans)


def test_empty_and_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    words = [rng.choice(WORDS) for _ in range(400)]
    near = list(words)
    near[200] = "changed"
    text, other = " ".join(words), " ".join(rng.choice(WORDS) for _ in range(400))
    docs = [(4, text, "a"), (2, text, "b"), (9, " ".join(near), "c"), (7, other, "d"), (8, None, "e"), (3, "", "f"), (None, text, "g"), (None, "lone words of a row", "h")]
    got = drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string, fp string"))
    assert got.columns == ["doc_id", "text", "fp"]
    kept = {r.fp for r in got.collect()}
    assert {"b", "d", "f", "h"} <= kept and not kept & {"a", "e", "g"}


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [2, 64])
def test_no_two_alike_stay_in_a_component(spark, monkeypatch, block):
    import cairn.llm.op1_simhash as m

    rng = random.Random(6)
    docs = []
    for g in range(3):  # variants that all have the same words, in other orders: one fingerprint, little in common
        words = [f"g{g}x{i}" for i in range(120)]
        for _ in range(6):
            rng.shuffle(words)
            w = list(words)
            for _ in range(4):
                docs.append((rng.randrange(10**6), " ".join(w)))
                w = list(words)
                w[5], w[6] = w[6], w[5]
    docs += [(None, docs[3][1]), (None, docs[3][1] + " "), (docs[7][0], docs[7][1])]
    got = [tuple(r) for r in m.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()]
    words = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        group = words.setdefault(t.split()[0][:2], [])
        if not any(k != d and jaccard(t, o) >= 0.8 for k, o in group):
            group.append((d, t))
    assert sorted(got) == sorted(x for group in words.values() for x in group)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_equal_texts_of_the_tables_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = [(r.doc_id, r.fp & (1 << 64) - 1) for r in simhash(docs, "text", 1, distinct=True).select("doc_id", "fp").collect()]
    near = brute_components([d for d, _ in fps], [(a, b) for i, (a, x) in enumerate(fps) for b, y in fps[:i] if (x ^ y).bit_count() <= 4])
    rows = drop_near_copies(docs).collect()
    texts = [r.text for r in rows]
    assert len(set(texts)) == len(texts) < docs.count()
    groups = {}
    for r in rows:
        groups.setdefault(near[r.doc_id], []).append(r.text)
    assert all(jaccard(a, b) < 0.8 for g in groups.values() for i, a in enumerate(g) for b in g[:i])

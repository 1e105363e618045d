import random

import pytest

from cairn.llm import op7_chunks
from cairn.llm.op2_suffix import RunIndex, brute, remove_matches, repeated_windows
from cairn.llm.op7_chunks import boundaries, remove_repeats


def texts(seed, n=30):
    rng = random.Random(seed)
    passages = [bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.randint(60, 400))) for _ in range(5)]
    out = []
    for _ in range(n):
        t = b"".join(rng.choice(passages) if rng.random() < 0.3 else bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 6)))
        out.append(t)
    return out + [b"ab" * 400, b"z" * 500, b"", b"short", out[0], out[0], b"common line of sixty four bytes and a bit more than that, really" * 3]


def longest_other(parts):
    """Longest match of each position with another one, by comparing all."""
    places = [(i, j) for i, t in enumerate(parts) for j in range(len(t))]
    out = {}
    for i, j in places:
        best = 0
        for k, m in places:
            if (i, j) != (k, m):
                n = 0
                while j + n < len(parts[i]) and m + n < len(parts[k]) and parts[i][j + n] == parts[k][m + n]:
                    n += 1
                best = max(best, n)
        out[i, j] = best
    return out


@pytest.mark.parametrize("parts", [[b"banana", b"bandana"], [b"aaaaaaa"], [b"x"], [b"abcabcabcabd", b"cabcab", b"", b"abc", b"abc"]])
def test_matching_statistics(parts):
    index = RunIndex(parts)
    got = index.matching_statistics()
    want = longest_other(parts)
    for (i, j), n in want.items():
        assert got[index.starts[i] + j] == n
    assert len(index.symbols) == len(index.heads) == len(index.tails) == len(index.common) and index.lengths.sum() == index.size


def test_runs_are_few_in_repetitive_text():
    base = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(1000))
    index = RunIndex([base] * 30)
    assert len(index.heads) < index.size / 10


def test_windows_of_weighted_texts():
    assert repeated_windows([(b"abcdef", True), (b"xbcdey", False)], 4) == [[(0, 3)], [(1, 2)]]


@pytest.mark.parametrize("length,shard,wide", [(100, 1 << 20, 1 << 20), (100, 500, 300), (20, 2000, 1 << 20), (200, 1 << 20, 1)])
def test_remove_matches_against_brute_force(spark, length, shard, wide):
    data = texts(length)
    df = spark.createDataFrame([(i, t.decode(), i) for i, t in enumerate(data)] + [(-1, None, 0)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in remove_matches(df, length, shard_bytes=shard, wide_bytes=wide).collect()}
    assert got[-1].n_bytes == 0 and bytes(got[-1].kept) == b""
    for i, (t, (gone, runs)) in enumerate(zip(data, brute(data, length))):
        assert (got[i].n_bytes, len(t) - len(got[i].kept), len(got[i].spans)) == (len(t), gone, runs), i
        assert bytes(got[i].kept) == b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in got[i].spans)], [*(s[0] for s in got[i].spans), len(t)]))


def test_long_text_in_slices(spark, monkeypatch):
    import cairn.llm.op2_suffix as m

    monkeypatch.setattr(m, "SLICE_BYTES", 700)
    data = texts(9, 12)
    seen = [set(), set()]
    for k, size in enumerate((700, 1 << 22)):
        monkeypatch.setattr(m, "SLICE_BYTES", size)
        for doc, start, n, keys, _ in m.segments(data, 100):
            for d, s, c, key in zip(doc.tolist(), start.tolist(), n.tolist(), keys.tolist()):
                seen[k].update((d, s + i, key) for i in range(c))
    assert seen[0] == seen[1] and len(seen[0]) == sum(max(0, len(t) - 99) for t in data)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_matches(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(4000))
    a, b = boundaries([body, b"something put before it" + body])
    assert len(set((b - 23).tolist()) & set(a.tolist())) >= 0.95 * len(a)
    assert a.tolist()[-1] == 4000 and boundaries([b""])[0].tolist() == [] and boundaries([b"a" * 10000])[0].tolist()[-1] == 10000


def test_chunks_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    passages = [" ".join(rng.choice(words) for _ in range(60)) + " é ü" for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) for _ in range(4)]
        docs.append((i * 3, " ".join(parts)))
    docs += [(500, docs[5][1]), (501, passages[0] + " x " + passages[0]), (502, ""), (503, None), (504, "ü" * 5000)]
    want = op7_chunks.brute(docs)
    rows = [(d, t, 1) for d, t in docs] + [(None, passages[1], 2), (None, None, 3)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(r.n for r in got if r.doc_id is None) == [2, 3] and {r.text for r in got if r.doc_id is None} == {passages[1], None}
    for r in got:
        if r.doc_id is not None:
            kept, spans = want[r.doc_id]
            assert (r.text or "").encode() == kept and [tuple(s) for s in r.spans] == spans, r.doc_id
    assert want[500][0] == b"" or len(want[500][0]) < len(docs[5][1])
    assert all(any(p[80:-80].encode() in k for k, _ in want.values()) for p in passages)  # each passage stays somewhere


def test_rows_that_share_an_id(spark):
    t = " ".join(f"token{i}" for i in range(200))
    got = remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text == t) for r in got) == [(1, True), (1, True), (2, False)]


def test_repeated_passages_go_whole(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [some(51) for _ in range(60)]
    docs = [(2 * i + k, f"{some(40)} {k}<{p}>{k} {some(40)}") for i, p in enumerate(passages) for k in (0, 1)]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        assert got[2 * i] == docs[2 * i][1]
        a, b = docs[2 * i + 1][1].split(p)
        assert got[2 * i + 1] == a[:-1] + b[1:] or got[2 * i + 1] == a + b

"""Quality rules, against a plain version."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import op13_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again)


TEXTS = [None, "", " \t\n\x0b\f\r", "one", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a a b", "x y z " * 40, "no\nno\n no\nno ", "\n\na b\n\na b\n", "#$ %& |<> *é ü \U0001F600 x",
         "a b c d e f a b c g h d e f", "w x\u0085y " * 3, "long " * 30000, " ".join(f"w{i % 977}" for i in range(20000)), "\x0cform feed\x0bvertical", "ends with blank "]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, N_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in q.measure(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == naive(t), t and t[:40]


def test_base_rules(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:49]), " ".join(words[:50]), " ".join(words[:26] * 2), " ".join(words[:50] + words[:50] + [f"v{i}" for i in range(100)]),
             " ".join(words[:50] + words[:50] + [f"v{i}" for i in range(99)])]
    df = spark.createDataFrame([(i, t, "a", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.base_failed for r in q.measure(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def cell(v):
    e = max(v.bit_length() - 6, 0)
    return ((v >> e) + 1 << e) - 1


@pytest.fixture
def measured(spark):
    """Enough documents in one source, few in another, few of a language, and null keys."""
    groups = [("en", "hot", 300), ("en", "small", 20), ("de", "x", 30), (None, None, 150), ("de", None, 90)]
    rows = [(n, lang, src, 60, 60 * (4 + (i * 7919 + n) % 5 if lang != "en" else 5 + i % 3), (i % 40 == 0) * 30, 0, 0, False) for n, (lang, src, k) in enumerate(groups) for i in range(k)]
    df = spark.createDataFrame(rows, "g int, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    return df.withColumns({"word_length": F.expr("1000 * word_chars DIV n_words"), "symbol_rate": F.expr("1000 * n_symbols DIV n_words"),
                           "dup_line_rate": F.lit(0).cast("long"), "repeat_rate": F.lit(0).cast("long")})


def test_limits_follow_their_group(spark, measured):
    def fences(rows, m):
        v = sorted(cell(r[m]) for r in rows)
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        reach = q.FENCE * max(q3 - q1, q.MEASURES[m])
        return q1 - reach, q3 + reach

    rows = measured.collect()
    got = {(r.lang, r.source): r for r in q.limits(q.sketch(measured, ["lang", "source"])).collect()}
    level = {("en", "hot"): "source", ("en", "small"): "language", ("de", "x"): "language", (None, None): "source", ("de", None): "language"}
    assert {k: r.limits_from for k, r in got.items()} == level
    for k, r in got.items():
        of = [x for x in rows if level[k] == "source" and (x.lang, x.source) == k or level[k] == "language" and x.lang == k[0]]
        for m in q.MEASURES:
            assert (r[f"{m}_low"], r[f"{m}_high"]) == fences(of, m)


def test_sketches_merge(spark, measured):
    whole = {tuple(r) for r in q.sketch(measured, ["lang"]).collect()}
    parts = q.sketch(measured, ["lang", "source"]).groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in parts.collect()} == whole
    values = [0, 1, 31, 32, 63, 64, 65, 1000, 10 ** 6, 2 ** 40 + 7]
    df = spark.createDataFrame([(v, 0, 0, 0) for v in values], "word_length long, symbol_rate long, dup_line_rate long, repeat_rate long")
    got = {r.cell for r in q.sketch(df, []).filter("measure = 'word_length'").collect()}
    assert got == {cell(v) for v in values} and all(v <= cell(v) <= v * 33 / 32 for v in values)


def test_verdicts(spark, measured):
    out = q.verdicts(measured, q.limits(q.sketch(measured, ["lang", "source"])))
    assert out.count() == measured.count()
    bad = {(r.lang, r.source): r.n for r in out.filter("NOT kept").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert bad == {("en", "hot"): 8, ("en", "small"): 1, ("de", "x"): 1, (None, None): 4, ("de", None): 3}
    assert out.filter("NOT kept AND failed = array('symbol_rate')").count() == 17


def test_filter_of_odd_tables(spark):
    good = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, "en", "s", "mine"), (1, good, "en", "s", "mine"), (2, None, None, None, None), (3, good + " #" * 60, None, "s", "x")],
                               "doc_id long, text string, lang string, source string, kept string")
    out = q.quality_filter(df)
    assert {(r.doc_id, r.kept, r.base_failed) for r in out.collect()} == {(1, True, False), (2, False, True), (3, True, False)} and out.count() == 4
    assert out.filter("text IS NOT NULL").count() == 3
    assert q.quality_filter(df.filter("false")).count() == 0

"""Paths by automata: against a regular expression, for any bound, and without a group that holds a match."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import paths
from cairn.plans import automaton, ordered

PATTERNS = [("A.B*.C", "AB*C"), ("(A|B)+.C", "[AB]+C"), ("A?.B?.A.B*", "A?B?AB*"), ("A*.B.A?.C*", "A*BA?C*"), ("(A|B)*.A.(B|C)+", "[AB]*A[BC]+"),
            ("A", "A"), ("A*", "A*"), ("A.A", "AA"), ("A.B?.A", "AB?A"), ("(A|B|C)+", "[ABC]+")]
RESULTS = {"n": ("count", None, None), "n_b": ("count", None, "B"), "total": ("sum", "x", None), "total_b": ("sum", "x", "B"), "first": ("first", "x", None),
           "first_b": ("first", "x", "B"), "last": ("last", "x", None), "last_b": ("last", "x", "B")}
LISTED = {"path": ("path", None, None), "low": ("min", "x", None), "high_b": ("max", "x", "B")}


def table(spark, texts):
    rows = [(u, i, s, float((i * 7919) % 101) if i % 13 else None) for u, t in texts.items() for i, s in enumerate(t)]
    return spark.createDataFrame(rows, "u string, event_id long, s string, x double").withColumn("ts", F.timestamp_seconds("event_id"))


def spans(regex, text, mode):
    if mode == "NONOVERLAPPING":
        return [m.span() for m in re.finditer(regex, text) if m.group()]
    return [(i, i + m.end()) for i in range(len(text)) if (m := re.match(regex, text[i:])) and m.group()]


def naive(texts, regex, mode, listed):
    out = []
    for u, t in texts.items():
        x = [float((i * 7919) % 101) if i % 13 else None for i in range(len(t))]
        for a, e in spans(regex, t, mode):
            own = [(t[i], x[i]) for i in range(a, e)]
            b = [v for s, v in own if s == "B"]
            known = lambda vs: [v for v in vs if v is not None]
            row = (u, e - a, len(b), sum(known(v for _, v in own), 0.0), sum(known(b), 0.0), own[0][1], b[0] if b else None, own[-1][1], b[-1] if b else None)
            if listed:
                row += (t[a:e], min(known(v for _, v in own), default=None), max(known(b), default=None))
            out.append(row)
    return sorted(out, key=str)


@pytest.fixture
def bound(spark, request):
    spark.conf.set("spark.cairn.taskRows", request.param)
    yield request.param
    spark.conf.unset("spark.cairn.taskRows")


@pytest.mark.parametrize("mode", ["NONOVERLAPPING", "OVERLAPPING"])
@pytest.mark.parametrize("listed", [False, True])
@pytest.mark.parametrize("pattern, regex, bound", [(*p, "7") for p in PATTERNS] + [(*p, "2000000") for p in PATTERNS[:2]], indirect=["bound"])
def test_against_regex(spark, bound, mode, listed, pattern, regex):
    rng = np.random.default_rng(len(pattern))
    texts = {f"u{u}": "".join(rng.choice(list("AABBCX"), n)) for u, n in enumerate([0, 1, 2, 7, 8, 64, 65, 150])}
    texts[None] = "ABBAC"
    texts["long"] = "A" + "B" * 200 + "CAB" + "A" * 90
    results = {**RESULTS, **(LISTED if listed else {})}
    got = paths.npath(table(spark, texts), "u", "ts", [(x, F.col("s") == x) for x in "ABC"], pattern, mode, results)
    assert got.columns == ["u", *results]
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive(texts, regex, mode, listed)


@pytest.mark.parametrize("mode", ["NONOVERLAPPING", "OVERLAPPING"])
def test_no_rows(spark, mode):
    df = table(spark, {"a": "A"}).filter("false")
    for results in (RESULTS, LISTED):
        assert paths.npath(df, "u", "ts", [("A", F.col("s") == "A")], "A+", mode, results).count() == 0


@pytest.mark.parametrize("mode, found", [("NONOVERLAPPING", 1), ("OVERLAPPING", 300_001)])
def test_one_long_match_is_in_no_cell(spark, mode, found):
    """A match of 300,001 events whose rows lie in blocks of 20,000: nothing is collected but blocks."""
    spark.conf.set("spark.cairn.taskRows", "20000")
    try:
        df = spark.range(300_001).select(F.lit("u").alias("u"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 5).cast("double").alias("x"),
                                         F.when(F.col("id") == 300_000, "C").otherwise(F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("s"))
        results = {"n": ("count", None, None), "x": ("sum", "x", None), "begin": ("first", "event_id", None), "end": ("last", "event_id", None)}
        out = paths.npath(df, "u", "ts", [(k, F.col("s") == k) for k in "ABC"], "(A|B)*.C", mode, results)
        assert not re.search(r"collect_list\(struct\(seq", out._jdf.queryExecution().optimizedPlan().toString())
        a = out.agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.max("x").alias("x"), F.min("begin").alias("b"), F.min("end").alias("e")).first()
        assert tuple(a) == (found, 300_001, 600_000.0, 0, 300_000)
    finally:
        spark.conf.unset("spark.cairn.taskRows")


def test_more_states_than_a_function_can_name(spark):
    with pytest.raises(ValueError, match="states"):
        paths.npath(table(spark, {"a": "A"}), "u", "ts", [("A", F.col("s") == "A")], ".".join(["A?"] * 40)).count()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        paths.npath(table(spark, {"a": "A"}), "u", "ts", [("A", F.col("s") == "A")], "A", "BOTH")


@pytest.mark.parametrize("mode", ["NONOVERLAPPING", "OVERLAPPING"])
def test_rows_are_never_broadcast(spark, monkeypatch, mode):
    """Only one row of each block may be sent to all: the rows stand on the left of left joins, or are joined by shuffles."""
    df = spark.range(4000).select((F.col("id") % 40).alias("u"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"),
                                  F.when(F.col("id") % 3 == 0, "C").otherwise("A").alias("s"))
    joins = []

    def planned(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins.extend(re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) .*", plan))
        return df

    for m in (automaton, ordered, paths):
        monkeypatch.setattr(m, "written", lambda df, write=m.written: write(planned(df)))
    got = planned(paths.npath(df, "u", "ts", [(x, F.col("s") == x) for x in "AC"], "A+.C", mode, {"n": ("count", None, None)}))
    assert len(joins) > 2 and not [j for j in joins if "Broadcast" in j and "LeftOuter, BuildRight" not in j and "__part" not in j]
    assert got.count() > 0

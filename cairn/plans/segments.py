"""Optimal cutting of series into segments of constant mean, for series of any length.

The cost of a cutting is the squared error of its segments around their means plus a
penalty per cut. Let F(t) be the least cost of the first t rows. A start s of the
segment that holds row t costs F(s) + penalty + sum (x - m)^2 over the rows after s if
its mean is m, and the difference of two starts does not change with later rows. So a
start is kept only where it is the best one for some m: the line of means is divided
into pieces, each owned by one start, and few starts stay even in a series without a
cut. The result is that of the full search over all cuttings.

A series is worked through block by block, all series side by side. What a block hands
on is its pieces and, for each start that may still be used, the way back to an earlier
block; the best cutting is read off these ways at the end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.plans.lineage import written
from cairn.plans.ordered import block_of, null_safe_join, task_rows

__all__ = ["Search", "optimal_cuts"]


class Search:
    """The search along one series. ``feed`` takes the next values and returns the
    ways (start, exit, rows) that end at a start still in use or at the last row."""

    def __init__(self, penalty: float, low: float, high: float, least: int):
        self.penalty, self.least = penalty, least
        self.t, self.sums = 0, np.zeros(2)
        self.pieces = np.zeros((0, 6))  # low, high, start, F, sum, sum of squares there
        self.low, self.high = low, high
        self.waiting = [(0.0, -penalty, 0.0, 0.0)]  # starts whose segment is still too short

    def state(self) -> list[float]:
        head = [self.penalty, self.low, self.high, self.least, self.t, *self.sums, len(self.pieces)]
        return [*map(float, head), *self.pieces.ravel().tolist(), *[v for w in self.waiting for v in w]]

    @classmethod
    def resume(cls, state) -> "Search":
        state = np.asarray(state, float)
        out = cls(*state[:3], int(state[3]))
        out.t, out.sums, n = int(state[4]), state[5:7].copy(), int(state[7])
        out.pieces = state[8:8 + 6 * n].reshape(n, 6).copy()
        out.waiting = [tuple(w) for w in state[8 + 6 * n:].reshape(-1, 4)]
        return out

    def _enter(self, start, cost, s1, s2):
        """A start joins: it takes the means for which no older one is as cheap."""
        p = self.pieces
        new = (start, cost, s1, s2)
        if not len(p):
            self.pieces = np.array([[self.low, self.high, *new]])
            return
        n, c1, c2 = start - p[:, 2], s1 - p[:, 4], s2 - p[:, 5]
        inside = c1 * c1 - n * (c2 + p[:, 3] - cost)
        root = np.sqrt(np.maximum(inside, 0.0))
        lo, hi = np.maximum(p[:, 0], (c1 - root) / n), np.minimum(p[:, 1], (c1 + root) / n)
        keep = (inside >= 0) & (lo <= hi)
        kept = p[keep]
        kept[:, 0], kept[:, 1] = lo[keep], hi[keep]
        left, right = np.concatenate([[self.low], kept[:, 1]]), np.concatenate([kept[:, 0], [self.high]])
        gap = left < right
        if gap.any():
            own = np.empty((int(gap.sum()), 6))
            own[:, 0], own[:, 1], own[:, 2:] = left[gap], right[gap], new
            kept = np.concatenate([kept, own])
            kept = kept[np.argsort(kept[:, 0], kind="stable")]
        self.pieces = kept

    def feed(self, x: np.ndarray) -> list[tuple]:
        first, back = self.t, np.zeros(len(x), np.int64)
        at = np.empty((len(x), 2))
        for i, v in enumerate(x):
            self.t += 1
            self.sums = self.sums + (v, v * v)
            at[i] = s1, s2 = self.sums
            if self.waiting and self.waiting[0][0] + self.least <= self.t:
                self._enter(*self.waiting.pop(0))
            p = self.pieces
            if not len(p):
                continue
            cost = p[:, 3] + self.penalty + (s2 - p[:, 5]) - (s1 - p[:, 4]) ** 2 / (self.t - p[:, 2])
            best = cost.min()
            back[i] = int(p[cost == best, 2].min())
            self.waiting.append((float(self.t), float(best), float(s1), float(s2)))
        used = {int(s) for s in self.pieces[:, 2]} | {int(w[0]) for w in self.waiting} | {self.t}
        ways = []
        for s in sorted(u for u in used if u > first):
            rows, now = [], s
            while now > first:
                rows.append(now - 1 - first)
                now = int(back[now - 1 - first])
            ways.append((s, now, rows, at[rows]))
        return ways


def optimal_cuts(rows: DataFrame, keys, x: str, limits: DataFrame, least=1) -> DataFrame:
    """(keys, seq, c1, c2): the last row of each segment, the series' last row too, with
    the sums of ``x`` and of its squares up to there. ``rows`` has (keys, seq, x) with
    a dense seq; ``limits`` one row per key (keys, n, penalty, low, high), where x lies
    between low and high. Segments have at least ``least`` rows; a shorter series is
    one segment. Of cuttings of equal cost the one with the earlier starts is taken.

    One job per block of ``spark.cairn.taskRows`` rows of the longest series."""
    keys = list(keys)
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    values = written(rows.select(*keys, "seq", F.col(x).cast("double").alias("x")).withColumn("__block", block_of(rows)))
    wide = (F.col("high") - F.col("low")) * 1e-9
    begin = F.array(F.col("penalty").cast("double"), F.col("low") - wide, F.col("high") + wide)
    state = limits.select(*keys, F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("x"), begin.alias("state"))
    longest = limits.agg(F.max("n")).first()[0] or 0
    size = task_rows(values)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        given = pdf["state"].iloc[0]
        search = Search(*given, least) if len(given) == 3 else Search.resume(given)
        v = pdf["x"].to_numpy(float)[1:]
        ways = search.feed(v) if len(v) else []
        out = pd.DataFrame({"seq": [search.t] + [w[0] for w in ways], "state": [search.state() if len(v) else None] + [None] * len(ways),
                            "exit": pd.array([None] + [w[1] for w in ways], "Int64"),
                            "path": [None] + [[{"seq": int(r), "c1": float(a), "c2": float(b)} for r, (a, b) in zip(np.array(w[2]) + search.t - len(v) + 1, w[3])] for w in ways]})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "seq", "state", "exit", "path"]]

    ways = None
    for b in range(-(-longest // size)):
        part = values.filter(F.col("__block") == b).select(*keys, "seq", "x", F.lit(None).cast("array<double>").alias("state"))
        done = written(part.unionByName(state.filter("state IS NOT NULL")).groupBy(*keys).applyInPandas(
            block, f"{head}, seq bigint, state array<double>, exit bigint, path array<struct<seq:bigint,c1:double,c2:double>>"))
        state = done.filter("state IS NOT NULL").select(*keys, "seq", F.lit(None).cast("double").alias("x"), "state")
        got = done.filter("exit IS NOT NULL").select(*keys, "seq", "exit", "path")
        ways = got if ways is None else ways.unionByName(got)
    if ways is None:
        return values.select(*keys, "seq", F.col("x").alias("c1"), F.col("x").alias("c2")).limit(0)

    @F.pandas_udf("array<bigint>")
    def walk(links: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for line, last in zip(links, n):
            back, now, taken = {r["seq"]: r["exit"] for r in line}, int(last), []
            while now > 0:
                taken.append(now)
                now = int(back[now])
            out.append(taken)
        return pd.Series(out)

    links = ways.groupBy(*keys).agg(F.collect_list(F.struct("seq", "exit")).alias("links"))
    taken = null_safe_join(links, limits.select(*keys, "n"), keys).select(*keys, F.explode(walk("links", "n")).alias("seq"))
    return null_safe_join(ways.drop("exit"), taken, keys + ["seq"]).select(*keys, F.explode("path").alias("p")).select(*keys, "p.*")

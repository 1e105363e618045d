"""Conditional sums of squares of ARMA models, for series of any length.

The innovations e_t = x_t - c - sum phi_k x_{t-k} - sum theta_k e_{t-k} and their
derivatives by the parameters all come from one linear recursion, 1/theta(B). So a
block of a series is reduced to its columns' cross products, where the columns are
the innovations and derivatives from a zero start and the answers to each unit start:
the sums of the whole series follow from the chained block starts. A pass over the
data yields the sum of squares and the normal equations at one set of parameters per
series; what leaves a block does not depend on its length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.plans.lineage import written
from cairn.plans.ordered import attach, block_of, null_safe_join, task_rows

__all__ = ["css_fit", "css_innovations"]

CHUNK, PART = 64, 8192
STATE = "beta array<double>, best array<double>, sse double, n bigint, gram array<double>, step array<double>, damp double, tail array<double>, still boolean, tss double"


class _Filter:
    """e_t = x_t - sum theta_k e_{t-k} over columns, chunk by chunk; ``lags`` holds the
    last values of each column, the latest last."""

    def __init__(self, theta: dict):
        self.q = max(theta, default=0)
        self.size = max(CHUNK, self.q)
        h = np.zeros(self.size)
        for t in range(self.size):
            h[t] = (t == 0) - sum(v * h[t - k] for k, v in theta.items() if t >= k)
        at = np.subtract.outer(np.arange(self.size), np.arange(self.size))
        self.own = np.where(at >= 0, h[np.maximum(at, 0)], 0.0)
        # the answer to the lags is that to the inputs they stand for in the first rows
        first = np.zeros((self.size, self.q))
        for k, v in theta.items():
            for t in range(k):
                first[t, self.q + t - k] = -v
        self.old = self.own @ first

    def __call__(self, x: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, c = x.shape
        if not self.q:
            return x, lags
        parts = -(-n // self.size)
        full = np.zeros((parts * self.size, c))
        full[:n] = x
        out = np.matmul(self.own, full.reshape(parts, self.size, c))
        s = lags
        for b in range(parts):
            out[b] += self.old @ s
            s = out[b, self.size - self.q:]
        out = out.reshape(-1, c)[:n]
        return out, np.vstack([lags, out])[-self.q:]


def _columns(theta_lags, k: int) -> int:
    """Innovations, ``k`` derivatives, the answers to unit lags, and what each MA
    derivative gets from these."""
    q = max(theta_lags, default=0)
    return 1 + k + q + q * len(theta_lags)


def _block(x, z, beta, ma):
    """Cross products of the columns of one block, and the columns' last values."""
    n_ar, q = z.shape[1], max(ma, default=0)
    k, theta = 1 + n_ar + len(ma), dict(zip(ma, beta[1 + n_ar:]))
    f = _Filter(theta)
    # columns that the filter is applied to: e, d/dc, d/dphi; unit lags; then those whose input is an earlier column
    width = 1 + 1 + n_ar + q
    lags, late = np.zeros((q, width)), np.zeros((q, len(ma) * (1 + q)))
    lags[:, width - q:] = np.eye(q)
    gram = np.zeros((_columns(ma, k),) * 2)
    for i in range(0, len(x), PART):
        xi, zi = x[i:i + PART], z[i:i + PART]
        inputs = np.hstack([(xi - beta[0] - zi @ beta[1:1 + n_ar])[:, None], -np.ones((len(xi), 1)), -zi, np.zeros((len(xi), q))])
        before = lags
        main, lags = f(inputs, lags)
        # d/dtheta_k is driven by e_{t-k}, and so by e's own part and by its answer to each lag
        e = np.vstack([before, main])[:, [0, *range(width - q, width)]]
        driven = np.hstack([-e[q - j:len(e) - j] for j in ma]) if ma else np.zeros((len(xi), 0))
        ends, late = f(driven, late)
        own = [j * (1 + q) for j in range(len(ma))]
        rest = [j for j in range(ends.shape[1]) if j not in own]
        cols = np.hstack([main[:, :2 + n_ar], ends[:, own], main[:, width - q:], ends[:, rest]])
        gram += cols.T @ cols
    own = [j * (1 + q) for j in range(len(ma))]
    rest = [j for j in range(late.shape[1]) if j not in own]
    return gram, np.hstack([lags[:, :2 + n_ar], late[:, own], lags[:, width - q:], late[:, rest]])


def _weights(starts, ma, k):
    """How e and its derivatives combine from the columns, for their ``starts`` (lags
    by e and derivatives) at a block's first row."""
    q = max(ma, default=0)
    w = np.zeros((_columns(ma, k), 1 + k))
    w[:1 + k] = np.eye(1 + k)
    w[1 + k:1 + k + q] = starts
    for j in range(len(ma)):
        w[1 + k + q + j * q:1 + k + q + (j + 1) * q, 1 + k - len(ma) + j] = starts[:, 0]
    return w


def _growth(theta, ma) -> float:
    """The factor by which an innovation's trace grows with each row; below one it fades."""
    poly = np.zeros(max(ma, default=0) + 1)
    poly[0] = 1.0
    poly[list(ma)] = theta
    return float(np.abs(np.roots(poly)).max(initial=0.0))


def _complete(rows, keys, x, ar):
    have = rows.filter(F.col(x).isNotNull())
    for c in ar:
        have = have.filter(F.col(f"`{c}`").isNotNull())
    return have.select(*keys, "seq", F.col(x).cast("double").alias("__x"), F.array(*[F.col(f"`{c}`") for c in ar]).cast("array<double>").alias("__z"))


def _head(rows, keys):
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def _arrays(pdf, n_ar):
    pdf = pdf.sort_values("seq")
    return pdf, pdf["__x"].to_numpy(float), np.array(pdf["__z"].tolist(), float).reshape(len(pdf), n_ar)


def css_fit(rows: DataFrame, keys, start: DataFrame, x: str, ar: list, ma: list, max_iter=30, tol=1e-10) -> DataFrame:
    """(keys, n, coef, se, sse, tss, tail): the coefficients (constant, those of the
    lag columns ``ar``, those of the lags ``ma`` of the innovations) with the least
    conditional sum of squares that damped Gauss-Newton steps reach from ``start``
    (keys, coef). Innovations before the first row with all lags are zero.

    A step that does not lower a series' sum of squares is not taken, and the next
    one is shorter, so the result is never above the start's. Models whose innovations
    do not fade are no candidates: a step ends before them, and such a start has the
    coefficient of lag k of the innovations scaled by r^k until it does. Each step is one pass
    over the rows for all series at once. ``tail`` has the last innovations."""
    keys, k, q = list(keys), 1 + len(ar) + len(ma), max(ma, default=0)
    have = written(_complete(rows, keys, x, ar))
    length = have.groupBy(*keys).agg(F.max("seq").alias("__len"))
    head = _head(rows, keys)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, v, z = _arrays(pdf, len(ar))
        with np.errstate(all="ignore"):
            gram, last = _block(v, z, np.asarray(pdf["beta"].iloc[0], float), ma)
        out = pdf[[*keys, "__block"]].iloc[:1].copy()
        out["n"], out["g"], out["l"], out["s"], out["ss"] = len(pdf), [gram.ravel()], [last.ravel()], v.sum(), (v * v).sum()
        return out

    @F.pandas_udf(STATE)
    def advance(parts: pd.Series, beta: pd.Series, best: pd.Series, sse: pd.Series, gram: pd.Series, damp: pd.Series, tail: pd.Series, still: pd.Series) -> pd.DataFrame:
        out = []
        for p, b, top, low, old, d, end, on in zip(parts, beta, best, sse, gram, damp, tail, still):
            b, starts, total = np.asarray(b, float), np.zeros((q, 1 + k)), np.zeros((1 + k, 1 + k))
            with np.errstate(all="ignore"):
                for r in p:
                    w, width = _weights(starts, ma, k), _columns(ma, k)
                    total += w.T @ np.asarray(r["g"], float).reshape(width, width) @ w
                    starts = np.asarray(r["l"], float).reshape(q, width) @ w
            n, s = sum(r["n"] for r in p), sum(r["s"] for r in p)
            now = total[0, 0]
            steady = _growth(b[k - len(ma):], ma) < 1
            better = steady and np.isfinite(total).all() and (low is None or np.isnan(low) or now < low)
            if better:
                on = low is None or np.isnan(low) or low - now > tol * low
                top, low, old, end, d = b, now, total.ravel(), starts[:, 0], min(1.0, 2 * d)
            else:
                d, on = d / 4, d > 1e-4
                if old is None:
                    top = b.copy()
                    top[k - len(ma):] *= (0.95 / max(_growth(b[k - len(ma):], ma), 1.0)) ** np.array(ma, float)
            top, step = np.asarray(top, float), np.zeros(k)
            if old is not None:
                t = np.asarray(old, float).reshape(1 + k, 1 + k)
                step = -np.linalg.lstsq(t[1:, 1:], t[1:, 0], rcond=None)[0]
                while d > 1e-4 and _growth((top + d * step)[k - len(ma):], ma) >= 1:
                    d /= 2
            out.append(((top + d * step).tolist(), top.tolist(), low, n, old, step, d, end, bool(on), sum(r["ss"] for r in p) - s * s / n))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    names = [c.split()[0] for c in STATE.split(", ")]
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")}
    blank |= {"beta": F.col("coef").alias("beta"), "best": F.col("coef").alias("best"), "damp": F.lit(1.0).alias("damp"), "still": F.lit(True).alias("still")}
    state, done = null_safe_join(start, length, keys).select(*keys, "__len", *[blank[c] for c in names]), []
    for _ in range(max_iter + 1):
        asked = attach(have, state.select(*keys, "__len", "beta"), keys, "__len")
        sums = asked.withColumn("__block", block_of(have)).groupBy(*keys, "__block").applyInPandas(
            blocks, f"{head}, __block bigint, n bigint, g array<double>, l array<double>, s double, ss double")
        parts = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "n", "g", "l", "s", "ss"))).alias("parts"))
        state = null_safe_join(parts, state, keys)
        state = written(state.select(*keys, "__len", advance("parts", "beta", "best", "sse", "gram", "damp", "tail", "still").alias("s")).select(*keys, "__len", "s.*"))
        done.append(state.filter(~F.col("still")))
        state = state.filter("still")
        if state.isEmpty():
            break
    out = state
    for d in done:
        out = out.unionByName(d)

    @F.pandas_udf("array<double>")
    def errors(gram: pd.Series, n: pd.Series, sse: pd.Series) -> pd.Series:
        res = []
        for g, c, s in zip(gram, n, sse):
            if g is None:
                res.append(None)
                continue
            inv = np.linalg.pinv(np.asarray(g, float).reshape(1 + k, 1 + k)[1:, 1:])
            res.append(np.sqrt(np.maximum(np.diag(inv), 0) * s / (c - k)).tolist() if c > k else None)
        return pd.Series(res)

    return out.select(*keys, "n", F.col("best").alias("coef"), errors("gram", "n", "sse").alias("se"), "sse", "tss", "tail")


def css_innovations(rows: DataFrame, keys, model: DataFrame, x: str, ar: list, ma: list, name: str) -> DataFrame:
    """(keys, seq, ``name``): the innovations under ``model`` (keys, coef), of the rows
    that have all lags. A block gives each row its value from a zero start and its
    answer to each unit lag; the starts are chained over blocks."""
    keys, q = list(keys), max(ma, default=0)
    have, head = _complete(rows, keys, x, ar), _head(rows, keys)
    length = have.groupBy(*keys).agg(F.max("seq").alias("__len"))
    asked = attach(have, null_safe_join(model.select(*keys, "coef"), length, keys), keys, "__len")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, v, z = _arrays(pdf, len(ar))
        b = np.asarray(pdf["coef"].iloc[0], float)
        f, lags = _Filter(dict(zip(ma, b[1 + len(ar):]))), np.hstack([np.zeros((q, 1)), np.eye(q)])
        inputs = np.hstack([(v - b[0] - z @ b[1:1 + len(ar)])[:, None], np.zeros((len(v), q))])
        got, last = f(inputs, lags)
        out = pdf[[*keys, "__block", "seq"]].copy()
        out["e"], out["r"] = got[:, 0], list(got[:, 1:])
        out["l"] = [None] * (len(out) - 1) + [last.ravel()]
        return out

    part = written(asked.withColumn("__block", block_of(have)).groupBy(*keys, "__block").applyInPandas(
        run, f"{head}, __block bigint, seq bigint, e double, r array<double>, l array<double>"))

    @F.pandas_udf("array<struct<b:bigint,s:array<double>>>")
    def chain(parts: pd.Series) -> pd.Series:
        out = []
        for blocks in parts:
            s, line = np.zeros(q), []
            for p in blocks:
                line.append({"b": p["__block"], "s": s.tolist()})
                m = np.asarray(p["l"], float).reshape(q, 1 + q)
                s = m[:, 0] + m[:, 1:] @ s
            out.append(line)
        return pd.Series(out)

    ends = part.filter("l IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "l"))).alias("p"))
    carry = ends.select(*keys, F.explode(chain("p")).alias("c")).select(*keys, F.col("c.b").alias("__block"), F.col("c.s").alias("__s"))
    full = null_safe_join(part, carry, keys + ["__block"])
    return full.select(*keys, "seq", (F.col("e") + F.aggregate(F.zip_with("r", "__s", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias(name))

"""Least squares per key from aggregated cross products.

The data is reduced to the k(k+1)/2 sums of X'X and X'y by a partial
aggregate; only that small matrix, one row per key, is solved in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.expr import all_of

__all__ = ["cross_products", "ols", "dot", "solve_row"]

FIT = "struct<coef:array<double>,se:array<double>,sse:double,tss:double>"


def cross_products(df: DataFrame, keys, y: Column, xs) -> DataFrame:
    """n and the flat upper triangle of [X y]'[X y] per key; rows with a null
    in any column are left out."""
    cols = list(xs) + [y]
    names = [f"__z{i}" for i in range(len(cols))]
    rows = df.select(*keys, *[c.cast("double").alias(n) for c, n in zip(cols, names)])
    rows = rows.filter(all_of([F.col(n).isNotNull() for n in names]))
    sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("zz"),
                                   F.sum(names[-1]).alias("__sy"))


def unpack(flat, k):
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = flat
    return m + np.triu(m, 1).T


def solve_row(m, n, sy, use=None, ridge=0.0):
    """Coefficients, standard errors, SSE and TSS from one matrix of sums."""
    k = m.shape[0] - 1
    use = list(range(k)) if use is None else list(use)
    a, b, yy = m[np.ix_(use, use)], m[use, k], m[k, k]
    if len(use) == 0:
        return [], [], yy, yy - sy * sy / n
    a = a + ridge * np.eye(len(use))
    try:
        inv = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(a)
    coef = inv @ b
    sse = max(float(yy - 2 * coef @ b + coef @ m[np.ix_(use, use)] @ coef), 0.0)
    dof = n - len(use)
    se = np.sqrt(np.maximum(np.diag(inv) * (sse / dof if dof > 0 else np.nan), 0))
    return coef.tolist(), [None if np.isnan(v) else float(v) for v in se], sse, float(yy - sy * sy / n)


def ols(df: DataFrame, keys, y: Column, xs, ridge=0.0) -> DataFrame:
    """keys, n, coef, se, sse, tss; coefficients in the order of ``xs``
    (give ``F.lit(1.0)`` for an intercept)."""
    k = len(xs) + 1

    @F.pandas_udf(FIT)
    def fit(zz: pd.Series, n: pd.Series, sy: pd.Series) -> pd.DataFrame:
        rows = [solve_row(unpack(z, k), c, s, ridge=ridge) for z, c, s in zip(zz, n, sy)]
        return pd.DataFrame(rows, columns=["coef", "se", "sse", "tss"])

    out = cross_products(df, keys, y, xs).withColumn("f", fit("zz", "n", "__sy"))
    return out.select(*keys, "n", "f.*")


def dot(coef: str, xs) -> Column:
    """Linear predictor from an array column of coefficients."""
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + F.element_at(coef, i + 1) * x
    return total

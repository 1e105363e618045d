"""Linear recursions along a series of any length.

s_t = A s_{t-1} + g x_t is affine in its start state, so each block of
positions is run from a zero state, the block end states are chained (one
small row per block), and each block is run again from its true start."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairn.plans.ordered import block_of, task_rows

__all__ = ["affine_scan", "gain_scan"]


def _run(a, g, x, s):
    before = np.empty((len(x), len(s)))
    for t, v in enumerate(x):
        before[t] = s
        s = a @ s + g * v
    return before, s


def affine_scan(df: DataFrame, keys, A, g, start, before=None, after=None, value="value", seq="seq") -> DataFrame:
    """Adds ``__before`` = before·s_{t-1}, ``__after`` = after·s_t and, on the
    last row of each key, ``__state`` = s_t. The start state is
    ``start`` times the first value of the series."""
    A, g, start = np.atleast_2d(np.asarray(A, float)), np.asarray(g, float), np.asarray(start, float)
    m = len(g)
    before = np.ones(m) if before is None else np.asarray(before, float)
    after = before if after is None else np.asarray(after, float)
    keys = list(keys)
    size = task_rows(df)
    rows = df.withColumn("__block", block_of(df, seq, size)).filter(F.col(value).isNotNull())
    kinds = dict(df.dtypes)
    kdef = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(seq)[value].to_numpy(float)
        _, s = _run(A, g, x, np.zeros(m))
        first = pdf[keys + ["__block"]].iloc[:1].copy()
        first["len"], first["s"], first["x0"] = len(x), [s.tolist()], x[0]
        return first

    tails = rows.select(*keys, "__block", seq, value).groupBy(*keys, "__block").applyInPandas(
        ends, f"{kdef}, __block bigint, len bigint, s array<double>, x0 double")

    @F.pandas_udf("array<struct<b:bigint,c:array<double>>>")
    def chain(parts: pd.Series) -> pd.Series:
        out = []
        for blocks in parts:
            s, line = start * blocks[0]["x0"], []
            for p in blocks:
                line.append({"b": p["__block"], "c": s.tolist()})
                s = np.linalg.matrix_power(A, int(p["len"])) @ s + np.asarray(p["s"], float)
            out.append(line)
        return pd.Series(out)

    carry = tails.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "len", "s", "x0"))).alias("p")) \
                 .select(*keys, F.explode(chain("p")).alias("c")) \
                 .select(*keys, F.col("c.b").alias("__block"), F.col("c.c").alias("__carry"))
    from cairn.plans.ordered import null_safe_join
    joined = null_safe_join(rows, carry, keys + ["__block"])
    cols = [c for c in df.columns]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", __before double, __after double, __state array<double>"

    def outputs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        x = pdf[value].to_numpy(float)
        prior, last = _run(A, g, x, np.asarray(pdf["__carry"].iloc[0], float))
        post = np.vstack([prior[1:], last])
        out = pdf[cols].copy()
        out["__before"], out["__after"] = prior @ before, post @ after
        out["__state"] = [None] * (len(x) - 1) + [last.tolist()]
        return out

    return joined.groupBy(*keys, "__block").applyInPandas(outputs, schema)


CHUNK = 64


def _level(x: np.ndarray, k: np.ndarray, s: float) -> np.ndarray:
    """s_t = s_{t-1} + k_t (x_t - s_{t-1}), some dozens of steps at a time: over
    them the weights left of a state do not underflow."""
    out = np.empty(len(x))
    for i in range(0, len(x), CHUNK):
        g = k[i:i + CHUNK]
        kept = np.cumprod(1.0 - g)
        if kept[-1] > 1e-200:
            out[i:i + CHUNK] = kept * (s + np.cumsum(g * x[i:i + CHUNK] / kept))
        else:
            for j, (v, w) in enumerate(zip(x[i:i + CHUNK], g), i):
                s = s + w * (v - s)
                out[j] = s
        s = out[min(i + CHUNK, len(x)) - 1]
    return out


def gain_scan(df: DataFrame, keys, gains: np.ndarray, name: str, value="value", seq="seq") -> DataFrame:
    """The level s_t = s_{t-1} + K_t (x_t - s_{t-1}) from s_0 = 0, with
    K_t = ``gains[t - 1]`` and the last gain from there on. Rows with a null
    value are left out; a first gain of one starts at the first value. Blocks
    are run from zero, chained by what is left of a state, and shifted."""
    keys, size, gains = list(keys), task_rows(df), np.asarray(gains, float)
    rows = df.withColumn("__block", block_of(df, seq, size)).filter(F.col(value).isNotNull())
    schema = StructType([*rows.schema.fields, StructField("__s", DoubleType()), StructField("__left", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        k = gains[np.minimum(pdf[seq].to_numpy(np.int64) - 1, len(gains) - 1)]
        return pdf.assign(__s=_level(pdf[value].to_numpy(float), k, 0.0), __left=np.cumprod(1.0 - k))

    part = rows.groupBy(*keys, "__block").applyInPandas(run, schema)
    ends = part.groupBy(*keys, "__block").agg(F.max_by("__s", seq).alias("s"), F.max_by("__left", seq).alias("left"))
    line = F.array_sort(F.collect_list(F.struct("__block", "s", "left")))
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<__block:bigint,carry:double>>").alias("out"))
    step = lambda acc, p: F.struct((p["s"] + p["left"] * acc["s"]).alias("s"), F.array_append(acc["out"], F.struct(p["__block"].alias("__block"), acc["s"].alias("carry"))).alias("out"))
    carry = ends.groupBy(*keys).agg(line.alias("p")).select(*keys, F.explode(F.aggregate("p", zero, step)["out"]).alias("c")).select(*keys, "c.*")
    from cairn.plans.ordered import null_safe_join
    out = null_safe_join(part, carry, keys + ["__block"])
    return out.withColumn(name, F.col("__s") + F.col("__left") * F.col("carry")).drop("__s", "__left", "carry", "__block")

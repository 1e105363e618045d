"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.plans.ordered import null_safe_join, running, sequence, task_rows

__all__ = ["quantiles", "quantile_columns"]


def quantiles(df: DataFrame, wanted: dict, by=()) -> DataFrame:
    """One row per group with linear-interpolated percentiles.

    ``wanted`` maps an output name to (column, probability). Groups up to the
    row bound use the built-in ``percentile``, whose buffer holds every
    distinct value of the group. Above it the ranks are found on the sorted
    distinct values, whose running counts are spread over many tasks."""
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    peak = sizes.agg(F.max("n")).first()[0] or 0
    if peak <= task_rows(df):
        # one buffer per column, whatever the number of probabilities
        cols = list(dict.fromkeys(c for c, _ in wanted.values()))
        probs = {c: [p for k, p in wanted.values() if k == c] for c in cols}
        one = df.groupBy(*by).agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs[c]])).alias(f"__q{i}")
                                    for i, c in enumerate(cols)])
        return one.select(*by, *[F.col(f"__q{cols.index(c)}")[probs[c].index(p)].alias(n) for n, (c, p) in wanted.items()])
    out = df.select(*by).distinct() if by else None
    for c in dict.fromkeys(c for c, _ in wanted.values()):
        probs = {n: p for n, (k, p) in wanted.items() if k == c}
        picked = _ranked(df, c, probs, by)
        out = picked if out is None else null_safe_join(out, picked, by, "left" if by else "inner")
    return out


def _ranked(df, column, probs, by):
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")) \
               .agg(F.count(F.lit(1)).alias("__n"))
    rows = running(sequence(counts, by, ["__v"]), by, {"__upto": "__n"})
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__len"))
    from cairn.plans.ordered import attach
    rows = attach(rows, total, by, "__len")
    v, first, last = F.col("__v").cast("double"), F.col("__upto") - F.col("__n"), F.col("__upto") - 1

    def at(rank):
        return F.max(F.when((rank >= first) & (rank <= last), v))

    aggs = []
    for name, p in probs.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"),
                 F.max(place - F.floor(place)).alias(f"__f_{name}")]
    got = rows.groupBy(*by).agg(*aggs)
    return got.select(*by, *[
        (F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
        for n in probs])


def quantile_columns(column: str, names: dict) -> dict:
    return {n: (column, p) for n, p in names.items()}

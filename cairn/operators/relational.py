"""Relational building blocks that need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.expr import col
from cairn.plans.ordered import attach, null_safe_join, running, sequence, share, sliding, with_stats


def positions_to_columns(df: DataFrame, keys, order, value: str, names) -> DataFrame:
    """First, second, ... value of each key as columns."""
    rows = sequence(df, keys, order).filter(F.col("seq") <= len(names))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("seq") == i + 1, F.col(value))).alias(n)
                                     for i, n in enumerate(names)])


def lag_pairs(df: DataFrame, keys, max_lag: int, seq="seq", value="value") -> DataFrame:
    """Pairs (t, t-k) for k = 1..max_lag, as lag columns over one sort
    instead of a band self-join."""
    lags = range(1, max_lag + 1)
    rows = sliding(df, keys, lambda w: {f"__l{k}": F.lag(value, k).over(w) for k in lags}, before=max_lag, seq=seq)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__l{k}").alias("lagged")) for k in lags])
    return rows.select(*keys, seq, value, F.explode(pairs).alias("p")) \
               .select(*keys, seq, value, "p.lag", "p.lagged").filter(F.col("lagged").isNotNull())


def nearest_match(df: DataFrame, keys, target: DataFrame, column: str, wanted: str, rank_by: Column,
                  tolerance: float) -> DataFrame:
    """Per row of ``target`` (one row per key) the row of ``df`` whose
    ``column`` is nearest to ``wanted`` within a relative tolerance; ties go
    to the larger ``rank_by``. A partial aggregate picks it, nothing is sorted."""
    rows = null_safe_join(df, target, keys)
    gap = F.abs(F.col(column) - F.col(wanted))
    rows = rows.filter(gap <= tolerance * F.abs(F.col(wanted)))
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys], wanted), F.struct(-gap, rank_by))
    return rows.groupBy(*keys, F.col(wanted).alias("__w")).agg(best.alias("b")).drop("__w").select(*keys, "b.*")


def expanding_mean(df: DataFrame, keys, value="value", seq="seq", name="expanding_mean") -> DataFrame:
    """Mean of all values up to and including the row."""
    out = running(df, keys, sums={"__s": F.col(value), "__n": F.when(F.col(value).isNotNull(), 1)}, seq=seq)
    return out.withColumn(name, F.col("__s") / F.nullif(F.col("__n"), F.lit(0))).drop("__s", "__n")


def ranked(df: DataFrame, keys, column: str, descending=False) -> DataFrame:
    """Each distinct value of a key with its count and its ``rank``,
    ``dense_rank`` and ``average_rank``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    rows = sequence(counts, keys, [(column, "desc") if descending else column], "dense_rank")
    rows = running(rows, keys, {"__upto": "n"}, seq="dense_rank")
    rows = rows.withColumn("rank", (F.col("__upto") - F.col("n") + 1).cast("bigint"))
    return rows.withColumn("average_rank", F.col("rank") + (F.col("n") - 1) / 2.0).drop("__upto")


def ntile(df: DataFrame, keys, order, buckets: int, name="tile") -> DataFrame:
    """Equal-count buckets numbered from 1, larger buckets first."""
    rows = sequence(df, keys, order, "__seq")
    sizes = rows.groupBy(*keys).agg(F.max("__seq").alias("__n"))
    rows = attach(rows, sizes, keys, "__n", seq="__seq", keep_length=True)
    q, r = F.floor(F.col("__n") / buckets), F.col("__n") % buckets
    head = r * (q + 1)
    tile = F.when(F.col("__seq") <= head, F.ceil(F.col("__seq") / (q + 1))) \
            .otherwise(r + F.ceil((F.col("__seq") - head) / F.nullif(q, F.lit(0))))
    return rows.withColumn(name, tile.cast("bigint")).drop("__seq", "__n")


def rolling(df: DataFrame, keys, exprs: dict, before: int, after: int = 0, seq="seq") -> DataFrame:
    """Aggregates over a moving frame: name -> aggregate column."""
    return sliding(df, keys, lambda w: {n: e.over(w.rowsBetween(-before, after)) for n, e in exprs.items()},
                   before=before, after=after, seq=seq)


def rolling_median(df: DataFrame, keys, before: int, after: int, value="value", seq="seq", name="median") -> DataFrame:
    """Median of the frame; the frame is small, so it is sorted as an array."""
    out = rolling(df, keys, {"__f": F.array_agg(value)}, before, after, seq)
    s, k = F.array_sort("__f"), F.size("__f")
    lo, hi = F.floor((k + 1) / 2).cast("int"), F.ceil((k + 1) / 2).cast("int")
    return out.withColumn("__s", s).withColumn(
        name, F.when(k > 0, (F.element_at("__s", lo) + F.element_at("__s", hi)) / 2.0)).drop("__f", "__s")


def mode(df: DataFrame, column: str, by=()) -> DataFrame:
    """Most frequent value; ties go to the smallest value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    top = with_stats(counts, [F.max("n").alias("__m")], by).filter("n = __m")
    return top.groupBy(*by).agg(F.min(column).alias("mode_value"), F.max("n").alias("mode_frequency"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits, its maximum and their ratio."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("__t")
    rows = with_stats(counts, [F.sum("n").alias("__t")])
    out = rows.agg((-F.sum(p * F.log2(p))).alias("entropy"), F.log2(F.count(F.lit(1)).cast("double")).alias("max_entropy"))
    return out.withColumn("normalized_entropy", F.col("entropy") / F.nullif(F.col("max_entropy"), F.lit(0.0)))


def cumulative_share(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency, share and cumulative share by falling frequency."""
    counts = share(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("frequency")),
                   "frequency", "percentage")
    rows = sequence(counts, [], [("frequency", "desc"), column], "position")
    rows = running(rows, [], {"cumulative": "frequency"}, seq="position")
    rows = with_stats(rows, [F.sum("frequency").alias("__t")])
    out = rows.withColumn("cumulative_percentage", F.round(F.col("cumulative") * 100.0 / F.col("__t"), 4)).drop("__t", "cumulative")
    return out if top is None else out.filter(F.col("position") <= top)


def ordered_list(df: DataFrame, keys, value: str, separator=", ") -> DataFrame:
    """Distinct values of a key as one ordered string."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(value)), separator).alias("items"))

"""Ordered work over keys of any size.

A window over ``partitionBy(key)`` puts a whole key into one task, which
fails when one key holds a large part of the data. The helpers here keep
every window partition below a row bound (``spark.cairn.taskRows``):

* ``sequence``  numbers the rows of each key: one range exchange by key and
  order, places within the parts, and offsets by (part, key).
* ``sliding``   evaluates lag/lead/rolling frames. With a dense position the
  rows of a key fall into equal blocks; rows near a block edge are copied
  into the neighbour block, so no block needs another one.
* ``running``   prefix sums and last-known values: per block, plus a carry
  taken from the (few) block totals.
* ``attach``    joins per-key values back to rows on (key, block), so a hot
  key is spread over as many tasks as it has blocks.

All are exact and give the same result for any bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import col, pct, rnd
from cairn.plans.lineage import written

__all__ = ["task_rows", "sequence", "sliding", "running", "attach", "null_safe_join", "block_join", "block_of", "with_stats", "share"]


def task_rows(df: DataFrame) -> int:
    """Largest number of rows one window partition may hold."""
    return int(df.sparkSession.conf.get("spark.cairn.taskRows", "2000000"))


def null_safe_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on keys where null equals null, keeping one copy of the keys."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def block_join(rows: DataFrame, carry: DataFrame, keys) -> DataFrame:
    """Rows beside the one row that ``carry`` has for each (key, block) of theirs.
    A left join, so that only the carry can be broadcast, and that by the size it
    has when it is made: the rows take far less room in their file, by which Spark
    would choose, than in memory."""
    return null_safe_join(rows, carry, [*keys, "__block"], "left")


def with_stats(df: DataFrame, aggs, by=()) -> DataFrame:
    """Rows beside statistics of their group. Without keys the statistics
    are one row and are broadcast; with keys Spark picks the join and AQE
    splits skewed partitions."""
    by = list(by)
    stats = df.groupBy(*by).agg(*aggs)
    return null_safe_join(df, stats, by, "left" if by else "inner")


def _direction(order) -> list[tuple[str, bool]]:
    """(column, whether it falls) for names and ``(name, "desc")`` pairs."""
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def sequence(df: DataFrame, keys, order, name="seq") -> DataFrame:
    """Dense 1-based position of each row within its key.

    ``order`` must be a total order within the key (end it with a unique
    column); it has column names, or ``(name, "desc")`` for a falling one.

    One form for every size. The rows are dealt by range of (keys, order), so a
    hot key fills as many tasks as it needs, sorted, and written once with their
    place in their part. A key's rows are neighbours: in each part it holds the
    places from its first one on, and rows of the parts before. Those two numbers
    come from a count by (part, key) of the written rows, whose window holds one
    row for each part of a key. What is read twice is the written table, not
    ``df``; writing it is a job of its own."""
    keys, spec = list(keys), _direction(order)
    ways = [F.asc(k) for k in keys] + [F.desc(c) if f else F.asc(c) for c, f in spec]
    ranged = df.repartitionByRange(*ways).sortWithinPartitions(*ways).withColumn("__at", F.monotonically_increasing_id())
    rows = written(ranged).withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)),
                                        "__key": F.struct(*keys) if keys else F.lit(0)})
    held = rows.groupBy("__part", "__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("__part", "__key", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__off"))
    # plain equality on one struct, which holds for nulls as well
    out = rows.join(offsets, ["__part", "__key"])
    return out.withColumn(name, (F.col("__at") + F.col("__off")).cast("bigint")).select(*[c for c in df.columns if c != name], name)


def block_of(df: DataFrame, seq="seq", size: int | None = None) -> Column:
    return F.floor((F.col(seq) - 1) / F.lit(size or task_rows(df))).cast("bigint")


def sliding(df: DataFrame, keys, build, before=0, after=0, seq="seq") -> DataFrame:
    """Columns over a frame of at most ``before`` rows back and ``after``
    rows ahead. ``build(w)`` returns {name: Column} for the window ``w``,
    ordered by position."""
    size = max(task_rows(df), before, after, 1)
    home = block_of(df, seq, size)
    place = (F.col(seq) - 1) % size
    spots = [home]
    if before:
        spots.append(F.when(place >= size - before, home + 1))
    if after:
        spots.append(F.when((place < after) & (home > 0), home - 1))
    rows = df.withColumn("__block", F.explode(F.array_compact(F.array(*spots)))) if len(spots) > 1 \
        else df.withColumn("__block", home)
    w = Window.partitionBy(*keys, "__block").orderBy(seq)
    out = rows.withColumns(build(w))
    if len(spots) > 1:
        out = out.filter(F.col("__block") == home)
    return out.drop("__block")


def running(df: DataFrame, keys, sums=None, lasts=None, seq="seq", inclusive=True) -> DataFrame:
    """Prefix sums (``sums``: name -> expression) and last non-null values so
    far (``lasts``) along the position. ``inclusive=False`` leaves the current
    row out."""
    keys, sums, lasts = list(keys), dict(sums or {}), dict(lasts or {})
    rows = written(df.withColumn("__block", block_of(df, seq))
                   .withColumns({f"__v_{n}": col(e) for n, e in {**sums, **lasts}.items()}))
    upto = Window.partitionBy(*keys, "__block").orderBy(seq) \
                 .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    part = rows.withColumns({
        **{f"__p_{n}": F.sum(f"__v_{n}").over(upto) for n in sums},
        **{f"__p_{n}": F.last(f"__v_{n}", ignorenulls=True).over(upto) for n in lasts}})
    totals = rows.groupBy(*keys, "__block").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(seq))).alias(f"__t_{n}")
          for n in lasts])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__block",
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in lasts])
    out = block_join(part, carry, keys)
    out = out.withColumns({
        **{n: F.coalesce(F.col(f"__p_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums},
        **{n: F.coalesce(F.col(f"__p_{n}"), F.col(f"__c_{n}")) for n in lasts}})
    return out.drop("__block", *[f"__{k}_{n}" for k in "vpc" for n in [*sums, *lasts]])


def attach(df: DataFrame, values: DataFrame, keys, length: str, seq="seq", keep_length=False) -> DataFrame:
    """Per-key values beside every row of the key. ``values`` has one row per
    key and its row count in ``length``; it is repeated once per block."""
    keys = list(keys)
    last = F.floor((F.col(length) - 1) / F.lit(task_rows(df))).cast("bigint")
    wide = values.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)))))
    if not keep_length:
        wide = wide.drop(length)
    rows = df.withColumn("__block", block_of(df, seq))
    return null_safe_join(rows, wide, keys + ["__block"]).drop("__block")


def share(df: DataFrame, value: str, name: str, by=(), places=4) -> DataFrame:
    """Percentage of the total (per group). The total is a separate
    aggregate, so rows are never gathered to form it."""
    out = with_stats(df, [F.sum(value).alias("__total")], by)
    return out.withColumn(name, rnd(pct(value, "__total"), places)).drop("__total")

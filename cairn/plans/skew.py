"""Joins and block products that stay balanced under hot keys."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

__all__ = ["split_join", "spread", "matrix", "parts_for", "side_by_side", "tile_pairs"]


SALTS = 8


PART_CHARS = 1 << 22  # characters of text in one part


def parts_for(df: DataFrame, text: str) -> int:
    """Parts for work that makes many rows of each text: one for each core at least,
    and so many that the rows of a part fit in the memory of a task."""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(chars / PART_CHARS))


def spread(df: DataFrame, text: str) -> DataFrame:
    """Rows dealt over as many parts as their texts need."""
    return df.repartition(parts_for(df, text))


def split_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with a lookup table of one row per key. The rows
    of every key are dealt over a fixed number of parts, the table is repeated
    for each, so a key that most rows have is no task of its own."""
    part = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(SALTS)).cast("int")
    wide = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", part).join(wide, [key, "__salt"]).drop("__salt")


TILE = 1 << 21  # numbers in one tile of vectors


def tile_pairs(left: DataFrame, right: DataFrame, id_col: str, vector: str, kernel, schema: str, tile=TILE) -> DataFrame:
    """Every vector of one side against every one of the other, one task for each pair
    of tiles. Rows are dealt to tiles by a hash of their id, about ``tile`` numbers in
    each, or fewer where that gives too few pairs for the cores. Sides that are the
    same table are compared once for both: a pair of tiles has one order only.

    ``kernel(ids, a, other_ids, b, both)`` gets ids as Arrow arrays and vectors as
    matrices, yields record batches of ``schema`` and reduces (top-k, counts). ``both``
    asks for the results of the second side too; two sides with the same ids in them
    are one tile, or of two tables. What crosses the network is each row once per tile
    of the other side. Rows without a vector take no part."""
    spark, same = left.sparkSession, left.sameSemantics(right)
    kind = "array<float>" if {dict(d.dtypes)[vector] for d in (left, right)} == {"array<float>"} else "array<double>"
    take = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).cast(kind).alias("v")).filter("v IS NOT NULL")
    cores = spark.sparkContext.defaultParallelism

    def tiles(df):
        n, wide = take(df).agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        return max(1, ceil(n * (wide or 1) / tile), min(ceil((6 * cores) ** 0.5), n // 512))

    nl = tiles(left)
    nr = nl if same else tiles(right)
    home = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    upto = lambda lo, hi: F.explode(F.sequence(F.lit(lo) if isinstance(lo, int) else lo, F.lit(hi) if isinstance(hi, int) else hi))
    l = take(left).withColumn("l", home(nl)).withColumn("r", upto(F.col("l") if same else 0, nr - 1))
    r = take(right).withColumn("r", home(nr)).withColumn("l", upto(0, F.col("r") if same else nl - 1))
    # the cells of the grid by number; of the same table, those on and above the diagonal
    cell = F.shiftright(F.col("r") * (F.col("r") + 1), 1) + F.col("l") if same else F.col("l") * nr + F.col("r")
    cells = nr * (nr + 1) // 2 if same else nl * nr
    pick = lambda df, side: df.select(cell.cast("int").alias("cell"), F.lit(side).alias("side"), "id", "v")
    diagonal = {j * (j + 1) // 2 + j for j in range(nr)} if same else set()

    def both_sides(at, l, r):
        yield from kernel(l["id"].combine_chunks(), matrix(l["v"]), r["id"].combine_chunks(), matrix(r["v"]), same and at not in diagonal)

    return side_by_side(pick(l, 0).unionByName(pick(r, 1)), both_sides, schema, cells)


def matrix(vectors) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    v = vectors.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)


def side_by_side(rows: DataFrame, kernel, schema: str, parts: int) -> DataFrame:
    """``kernel(cell, left, right)`` over the rows of each cell: two Arrow tables of
    those of side 0 and 1, where both have rows. The first two columns of ``rows`` are
    the cell, a number from 0, and the side; cells are dealt evenly over ``parts`` tasks."""
    first = rows.columns[0]
    rows = rows.repartitionById(parts, F.pmod(first, F.lit(parts)).cast("int")).sortWithinPartitions(*rows.columns[:2])

    def compared(at, held):
        sides = [[b for s, b in held if s == k] for k in (0, 1)]
        if all(sides):
            yield from kernel(at, *map(pa.Table.from_batches, sides))

    def run(batches):
        at, held = None, []
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                now, side = divmod(int(key[lo]), 2)
                if now != at:
                    yield from compared(at, held)
                    at, held = now, []
                held.append((side, b.slice(lo, hi - lo)))
        yield from compared(at, held)

    return rows.mapInArrow(run, schema)

"""Finite automata along a series of any length.

A letter is a function from states to states, and so is any stretch of
letters. Each block of positions is reduced to its function, the functions of
a key's blocks are composed (one small row per block), and the state of a row
is its function within the block, applied to the state in which the block is
entered. No task sees more than a block, and a block flows through in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cairn.plans.lineage import written
from cairn.plans.ordered import block_join, block_of, task_rows

__all__ = ["end_scan", "state_scan"]

STEPS = 64  # rows of one column of the vectorised scan
FIRST = 48  # a function is a string with a character for each state, from this code on
MOST = 127 - FIRST


def composed(table: np.ndarray, letters: np.ndarray, fresh: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The function from a run's start through each row, as rows of states.
    ``fresh`` marks the first row of a run, ``entry`` is the
    function of the rows before the first one.

    The rows are laid out in columns of ``STEPS``, which advance side by side;
    then each column is composed with what the one before it ends in."""
    n, states = len(letters), table.shape[1]
    cols = -(-n // STEPS)
    steps = table[np.concatenate([letters, np.zeros(cols * STEPS - n, letters.dtype)])].reshape(cols, STEPS, states)
    new = np.concatenate([fresh, np.zeros(cols * STEPS - n, bool)]).reshape(cols, STEPS)
    same, f = np.arange(states, dtype=table.dtype), np.empty_like(steps)
    now = np.broadcast_to(same, (cols, states))
    for j in range(STEPS):
        f[:, j] = now = np.take_along_axis(steps[:, j], np.where(new[:, j, None], same, now).astype(np.intp), 1)
    own = np.cumsum(new, axis=1) > 0  # a run starts in this column, at or before the row
    for c in range(cols):
        f[c] = np.where(own[c][:, None], f[c], f[c][:, entry])
        entry = f[c, -1]
    return f.reshape(-1, states)[:n]


def state_scan(df: DataFrame, keys, letter: Column, table, start: int, name: str, seq="seq", reverse=False, before=False) -> DataFrame:
    """Adds the state that an automaton has reached at each row of a key, the
    row read, or with ``before`` not yet read. It reads by rising position, or
    falling with ``reverse``.

    ``letter`` is a number from 0, ``table[letter][state]`` the next state, and
    ``start`` the state in which a key begins. ``seq`` is the dense position of
    ``sequence``; no row of a key may be missing. An automaton has at most 79
    states. Results are the same for any ``spark.cairn.taskRows``."""
    table = np.asarray(table, np.int64)
    if table.shape[1] > MOST:
        raise ValueError(f"{table.shape[1]} states, at most {MOST}")
    keys, size = list(keys), task_rows(df)
    rows = df.withColumns({"__block": block_of(df, seq, size), "__letter": letter.cast("int")})
    rows = rows.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", F.desc(seq) if reverse else F.asc(seq))
    at, spot = rows.columns.index(seq), rows.columns.index("__letter")
    added = [StructField("__through", StringType()), *([StructField("__upto", StringType())] if before else [])]
    out = StructType([*rows.schema.fields, *added])

    def text(f: np.ndarray) -> pa.Array:
        n, states = f.shape
        ends = np.arange(n + 1, dtype=np.int32) * states
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(f + FIRST, np.uint8)))

    def run(batches):
        entry, closed = np.arange(table.shape[1]), True  # closed: the row before was the last of its block
        for b in batches:
            if not b.num_rows:
                continue
            first = (b.column(at).to_numpy() - 1) % size == 0
            # a block's lowest position opens it, or closes it when the reading falls
            fresh = np.concatenate([[closed], first[:-1]]) if reverse else first
            f = composed(table, b.column(spot).to_numpy(), fresh, entry)
            cols = [*b.columns, text(f)]
            if before:
                cols.append(text(np.where(fresh[:, None], np.arange(f.shape[1]), np.vstack([entry[None], f[:-1]]))))
            entry, closed = f[-1], bool(first[-1])
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    part = written(rows.mapInArrow(run, out))
    last = F.min_by if reverse else F.max_by
    ends = part.groupBy(*keys, "__block").agg(last("__through", seq).alias("f"))
    line = F.sort_array(F.collect_list(F.struct("__block", "f")), asc=not reverse)
    state_at = lambda f, s: F.ascii(F.substring(f, s + 1, F.lit(1))) - FIRST
    zero = F.struct(F.lit(start).alias("s"), F.array().cast("array<struct<__block:bigint,s:int>>").alias("out"))
    step = lambda acc, p: F.struct(state_at(p["f"], acc["s"]).alias("s"),
                                   F.array_append(acc["out"], F.struct(p["__block"].alias("__block"), acc["s"].alias("s"))).alias("out"))
    carry = ends.groupBy(*keys).agg(line.alias("p")).select(*keys, F.explode(F.aggregate("p", zero, step)["out"]).alias("c")) \
                .select(*keys, "c.__block", F.col("c.s").alias("__entry"))
    got = block_join(part, carry, keys)
    return got.withColumn(name, state_at(F.col("__upto" if before else "__through"), F.col("__entry"))) \
              .select(*[c for c in df.columns if c != name], name)


def walked(table: np.ndarray, letters: np.ndarray, seq: np.ndarray, fresh: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """For each row, read by falling position, and each state the position at which
    a walk that comes to the row in that state stops; ``-1 - s`` stands for a walk
    that leaves the run in state ``s``. Laid out as in ``composed``."""
    n, states = len(letters), table.shape[1]
    cols = -(-n // STEPS)
    fill = cols * STEPS - n
    steps = table[np.concatenate([letters, np.zeros(fill, letters.dtype)])].reshape(cols, STEPS, states)
    stop = np.concatenate([seq - 1, np.zeros(fill, np.int64)]).reshape(cols, STEPS, 1)
    new = np.concatenate([fresh, np.zeros(fill, bool)]).reshape(cols, STEPS)
    leave, f = -1 - np.arange(states), np.empty((cols, STEPS, states), np.int64)
    now = np.broadcast_to(leave, (cols, states))
    for j in range(STEPS):
        ahead = np.where(new[:, j, None], leave, now)
        g = steps[:, j]
        f[:, j] = now = np.where(g < 0, stop[:, j], np.take_along_axis(ahead, np.maximum(g, 0), 1))
    own = np.cumsum(new, axis=1) > 0
    for c in range(cols):
        f[c] = np.where(own[c][:, None] | (f[c] >= 0), f[c], entry[np.minimum(-1 - f[c], states - 1) * (f[c] < 0)])
        entry = f[c, -1]
    return f.reshape(-1, states)[:n]


def end_scan(df: DataFrame, keys, letter: Column, table, name: str, seq="seq") -> DataFrame:
    """Adds the position of the last row that a walk starting at each row, in state
    0, still takes: ``table[letter][state]`` is its next state, or negative where
    it does not take the row. A walk that does not take its first row ends at the
    position before it. Walks may be of any length; all of a block's are followed
    at once, from its end, and what leaves a block is looked up in the next one.
    ``seq`` is the dense position of ``sequence``."""
    table = np.asarray(table, np.int64)
    keys, size, states = list(keys), task_rows(df), np.asarray(table).shape[1]
    rows = df.withColumns({"__block": block_of(df, seq, size), "__letter": letter.cast("int")})
    rows = rows.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", F.desc(seq))
    at, spot = rows.columns.index(seq), rows.columns.index("__letter")
    out = StructType([*rows.schema.fields, StructField("__stop", LongType()), StructField("__stops", ArrayType(LongType()))])

    def run(batches):
        entry, closed = -1 - np.arange(states), True
        for b in batches:
            if not b.num_rows:
                continue
            place = b.column(at).to_numpy()
            low = (place - 1) % size == 0
            f = walked(table, b.column(spot).to_numpy(), place, np.concatenate([[closed], low[:-1]]), entry)
            entry, closed = f[-1], bool(low[-1])
            # a block's lowest row tells where walks that enter the block stop
            ends = np.concatenate([[0], np.cumsum(low)]).astype(np.int32) * states
            stops = pa.ListArray.from_arrays(pa.array(ends), pa.array(f[low].reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ascontiguousarray(f[:, 0])), stops], names=out.names)

    part = written(rows.mapInArrow(run, out))
    ends = part.groupBy(*keys, "__block").agg(F.max_by("__stops", F.when(F.size("__stops") > 0, F.lit(1))).alias("f"), F.max(seq).alias("n"))
    zero = F.struct(F.array().cast("array<bigint>").alias("w"), F.array().cast("array<struct<__block:bigint,w:array<bigint>>>").alias("out"))

    def step(acc, p):
        ahead = F.when(F.size(acc["w"]) == 0, F.array_repeat(p["n"], states)).otherwise(acc["w"])
        return F.struct(F.transform(p["f"], lambda x: F.when(x >= 0, x).otherwise(F.get(ahead, (-1 - x).cast("int")))).alias("w"),
                        F.array_append(acc["out"], F.struct(p["__block"].alias("__block"), ahead.alias("w"))).alias("out"))

    carry = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__block", "f", "n")), asc=False).alias("p")) \
                .select(*keys, F.explode(F.aggregate("p", zero, step)["out"]).alias("c")).select(*keys, "c.__block", F.col("c.w").alias("__ahead"))
    got = block_join(part, carry, keys)
    stop = F.when(F.col("__stop") >= 0, F.col("__stop")).otherwise(F.get("__ahead", (-1 - F.col("__stop")).cast("int")))
    return got.withColumn(name, stop).select(*[c for c in df.columns if c != name], name)

"""Exact top-k by inner product, with cover trees on queries and on data.

Data and queries are dealt into blocks of bounded size; each pair of a data block
and a query block is searched by a dual traversal of their trees. A pair of nodes
is pruned when its best possible score, from the centres and covering radii, is
below the worst kth score among the node's queries. That score starts at the
query's kth score over one data block, which all pairs know.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, quoted, read
from cairn.llm.registry import query

__all__ = ["CoverTree", "dual_search", "top_k"]

#: Vectors of a data block, queries of a query block, and vectors that a leaf may hold.
DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 32
#: Sums of products below this are exact in double precision.
EXACT = 2.0 ** 53
LOWEST = -(1 << 63)


class CoverTree:
    """A node has a centre, the radius that covers its points, and children whose
    centres lie further apart than half of its scale and whose points lie within
    half of it from their centre; or, if small, its points."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        self.norm: list[float] = []
        if len(x):
            self._build(np.arange(len(x)))

    def _node(self, c: np.ndarray, far: float, points: np.ndarray) -> int:
        self.centre.append(c)
        self.radius.append(far)
        self.norm.append(float(np.sqrt(c @ c)))
        self.children.append([])
        self.points.append(points)
        return len(self.centre) - 1

    def _build(self, every: np.ndarray) -> None:
        c = self.x[every[0]]
        todo = [(every, np.sqrt(((self.x[every] - c) ** 2).sum(1)), -1)]
        while todo:
            at, d, parent = todo.pop()
            far = float(d.max())
            node = self._node(self.x[at[0]], far, at)
            if parent >= 0:
                self.children[parent].append(node)
            if len(at) <= LEAF or far == 0:
                continue
            half = 2.0 ** np.ceil(np.log2(far)) / 2
            left, dist, alone = at, d, []
            while len(left):
                inside = dist <= half
                if inside.sum() > 1:
                    todo.append((left[inside], dist[inside], node))
                else:
                    alone.append(left[inside][0])
                left = left[~inside]
                if len(left):
                    dist = np.sqrt(((self.x[left] - self.x[left[0]]) ** 2).sum(1))
            for i in range(0, len(alone), LEAF):  # points that cover only themselves share leaves
                part = np.array(alone[i:i + LEAF])
                e = np.sqrt(((self.x[part] - self.x[part[0]]) ** 2).sum(1))
                self.children[node].append(self._node(self.x[part[0]], float(e.max()), part))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products (in 64 bits)."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Best:
    """The k best (score, id) so far of each query, and its kth score; ``floor``
    is a score that the kth best is known to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.kth = k, floor.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floor]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, v = np.concatenate([self.found[i][0], scores]), np.concatenate([self.found[i][1], ids])
        order = np.lexsort((v, -s))[:self.k]
        self.found[i] = s[order], v[order]
        if len(order) == self.k:
            self.kth[i] = max(self.kth[i], s[order[-1]])


def dual_search(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Best:
    best = Best(floor, k)
    if not len(q) or not len(x):
        return best
    a, b = CoverTree(q.astype(np.float64)), CoverTree(x.astype(np.float64))

    def bound(i: int, j: int) -> float:
        u = float(a.centre[i] @ b.centre[j]) + a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
        return u + abs(u) * 1e-9 + 1

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        u, i, j = todo.pop()
        if u < best.kth[a.points[i]].min():
            continue
        if not a.children[i] and not b.children[j]:
            rows, cols = a.points[i], b.points[j]
            s = products(q[rows], x[cols])
            good = (s >= best.kth[rows][:, None]) & (qid[rows][:, None] != xid[cols][None, :])
            for r in np.flatnonzero(good.any(1)):
                best.add(int(rows[r]), s[r][good[r]], xid[cols[good[r]]])
        elif not a.children[i] or (b.children[j] and b.radius[j] >= a.radius[i]):
            todo += sorted((bound(i, c), i, c) for c in b.children[j])
        else:
            todo += sorted((bound(c, j), c, j) for c in a.children[i])
    return best


def unpack(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        w = np.frombuffer(v, np.int64)
        out[i, :len(w)] = w
    return out


def scaled(rows: DataFrame, factor: float) -> DataFrame:
    """(vec_id, width, v): components times ``factor``, rounded down, as bytes of 64-bit integers."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def run(batches):
        for b in batches:
            vs = [np.floor(factor * np.asarray(x.values.to_numpy(), np.float64)).astype(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in vs], pa.int32()), pa.array([v.tobytes() for v in vs], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all rows with another
    id for each row whose id is divisible by ``every``; ties to the smaller id.

    Components are multiplied by ``factor`` and rounded down; scores are 64-bit.
    Vectors that are null or hold a null or non-finite component, and rows without
    id, take no part. A shorter vector counts as if it ended in zeros; an empty one
    scores zero. Each row of a repeated id is a query and a candidate of its own,
    but no candidate for its own id. An empty table gives an empty result.
    """
    e = F.transform(quoted(embedding), lambda x: x.cast("double"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = cut(scaled(vectors.filter(quoted(vec_id).isNotNull() & quoted(embedding).isNotNull() & ~bad).select(quoted(vec_id).cast("long").alias("vec_id"), e.alias("e")), factor))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w"), F.sum(F.expr(f"int(vec_id % {every} = 0)")).alias("q")).first()
    blocks, parts, width = max(1, -(-size.n // DATA_BLOCK)), max(1, -(-(size.q or 0) // QUERY_BLOCK)), size.w or 0
    data = cut(rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.pmod("uid", F.lit(parts)))
    one = data.filter("block = 0").limit(2 * DATA_BLOCK).toPandas()
    known = vectors.sparkSession.sparkContext.broadcast((one["vec_id"].to_numpy(np.int64), unpack(one["v"], width)))
    schema = T.StructType([*asked.schema.fields, T.StructField("floor", T.LongType())])

    def lowest(batches):
        ids, x = known.value
        for p in batches:
            s = products(unpack(p["v"], width), x)
            own = p["vec_id"].to_numpy(np.int64)[:, None] == ids[None, :]
            s[own] = LOWEST
            kth = np.partition(s, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(p), LOWEST)
            yield p.assign(floor=kth)

    asked = cut(asked.mapInPandas(lowest, schema))

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        q, x = unpack(queries["v"], width), unpack(rows["v"], width)
        best = dual_search(q, queries["vec_id"].to_numpy(np.int64), queries["floor"].to_numpy(np.int64), x, rows["vec_id"].to_numpy(np.int64), k)
        n = [len(s) for s, _ in best.found]
        return pd.DataFrame({"uid": np.repeat(queries["uid"].to_numpy(), n), "query_id": np.repeat(queries["vec_id"].to_numpy(), n),
                             "vec_id": np.concatenate([v for _, v in best.found]) if n else [], "score": np.concatenate([s for s, _ in best.found]) if n else []})

    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).groupBy("part", "block")
    right = data.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).groupBy("part", "block")
    found = left.cogroup(right).applyInPandas(search, "uid long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""


@query("op6_topk_cover_tree", SQL)
def op6(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))

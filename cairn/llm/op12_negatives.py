"""Hard negatives: for an anchor and each of its positives, the best rows of another
label whose score lies in a band below the positive's.

Every row has a one-bit code: the signs of its vector under several fixed
rotations, and its alignment with the vector that the signs stand for (the code
vector). A query's rotated components are rounded to a few bits, so its product
with a code vector is a sum of popcounts with a known rounding error. What the
code vector leaves of a row is bounded by Cauchy-Schwarz, which gives an interval
that holds the score for certain. Only rows whose interval can still reach the
best few, or the band, are scored, in whole numbers; so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, quoted, read
from cairn.llm.registry import query

__all__ = ["Codes", "Rotation", "hard_negatives", "intervals", "mine_block", "positives_block"]

#: Rows of a data block, anchors of an anchor block.
BLOCK, ANCHORS = 8192, 256
#: Rotations (bits for each component of a vector) and bits to which a query's components are rounded.
ROTATIONS, QUERY_BITS = 8, 6
#: Scaled components must be smaller, so that scores stay in 64 bits and sums of products are exact in double precision where below 2^53.
LARGEST = 2 ** 28
#: Relative and absolute widening of an interval, above the rounding of double precision.
SLACK, LEAST = 1e-9, 1e-6


class Rotation:
    """Random rotations of one width, stacked; the same wherever they are made."""

    def __init__(self, width: int, rotations: int = ROTATIONS, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.width, self.bits = width, width * rotations
        self.g = np.concatenate([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(rotations)])

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """Rows of bits as 64-bit words."""
        wide = np.zeros((len(bits), -(-self.bits // 64) * 8), np.uint8)
        wide[:, :-(-self.bits // 8)] = np.packbits(bits, axis=1)
        return wide.view(np.uint64)


class Codes:
    """Sign codes of rows, with the alignment (the row's product with its code vector,
    by the code vector's squared length), the code vector's length, and the length
    of what is left of the row."""

    def __init__(self, x: np.ndarray, rotation: Rotation):
        f = x.astype(np.float64)
        signs = f @ rotation.g.T >= 0
        code = np.where(signs, 1.0, -1.0) @ rotation.g
        self.words = np.ascontiguousarray(rotation.pack(signs).T)
        self.ones = signs.sum(1)
        length2 = (code ** 2).sum(1)
        self.align = (f * code).sum(1) / np.maximum(length2, 1e-300)
        self.length = np.sqrt(np.maximum(length2, 1e-300))
        self.norm = np.sqrt((f ** 2).sum(1))
        self.rest = np.sqrt(((f - self.align[:, None] * code) ** 2).sum(1))


    FIELDS = (("ones", np.int64), ("align", np.float64), ("length", np.float64), ("norm", np.float64), ("rest", np.float64))

    def pack(self) -> bytes:
        return b"".join([getattr(self, f).tobytes() for f, _ in self.FIELDS] + [self.words.tobytes()])

    @classmethod
    def unpack(cls, data: bytes, n: int) -> Codes:
        codes = cls.__new__(cls)
        for i, (f, kind) in enumerate(cls.FIELDS):
            setattr(codes, f, np.frombuffer(data, kind, n, 8 * n * i))
        codes.words = np.frombuffer(data, np.uint64, -1, 8 * n * len(cls.FIELDS)).reshape(-1, n)
        return codes


def intervals(q: np.ndarray, codes: Codes, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, low, high) of the inner products of ``q`` with the coded rows;
    the true products lie within."""
    z = rotation.g @ q.astype(np.float64)
    low, step = float(z.min()), max(float(z.max() - z.min()) / (2 ** QUERY_BITS - 1), 1e-300)
    k = np.rint((z - low) / step).astype(np.int64)
    off = float(np.abs(z - low - step * k).sum())
    planes = rotation.pack(((k[None] >> np.arange(QUERY_BITS)[:, None]) & 1).astype(bool))
    inside = np.zeros(codes.words.shape[1], np.int64)
    for b, plane in enumerate(planes):
        inside += np.bitwise_count(codes.words & plane[:, None]).sum(0, dtype=np.int64) << b
    # the product with the signs is twice the sum over the set bits, less the sum over all bits
    g = 2 * (low * codes.ones + step * inside) - (low * rotation.bits + step * int(k.sum()))
    norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    side = np.sqrt(np.maximum(norm ** 2 - (np.maximum(np.abs(g) - off, 0) / codes.length) ** 2, 0))
    reach = np.abs(codes.align) * off + side * codes.rest
    reach += SLACK * norm * codes.norm + LEAST
    estimate = codes.align * g
    return estimate, estimate - reach, estimate + reach


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q)) < 2.0 ** 53:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Found:
    """Scores of the rows looked at, each taken once."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        self.q, self.x = q, x
        self.known, self.score = np.zeros(len(x), bool), np.zeros(len(x), np.int64)

    def take(self, at: np.ndarray) -> np.ndarray:
        new = at[~self.known[at]]
        self.score[new] = _scores(self.q, self.x[new])
        self.known[new] = True
        return self.score[at]


def positives_block(q, qid, qlabel, x, xid, xlabel, codes, rotation, k: int) -> tuple[list, Found | None]:
    """For one anchor: places and scores of the ``k`` best rows of its label in a block, and what was scored."""
    at = np.flatnonzero((xlabel == qlabel) & (xid != qid))
    if not len(at):
        return [], None
    estimate, _, high = intervals(q, codes, rotation)
    found = Found(q, x)
    if len(at) > k:
        likely = at[np.argpartition(-estimate[at], k - 1)[:k]]
        floor = found.take(likely).min()
        at = at[high[at] >= floor]
    s = found.take(at)
    best = _first(s, xid[at], k)
    return list(zip(at[best], s[best])), found


def mine_block(q, qlabel, scores, x, xid, xlabel, codes, rotation, k: int, band: tuple[int, int]) -> tuple[list, Found | None]:
    """For one anchor with its positives' ``scores``: (number of the positive, place, score) of the ``k`` best
    rows of another label in a block with ``band[0] * positive <= 100 * score <= band[1] * positive``."""
    other = np.flatnonzero(xlabel != qlabel)
    if not len(other):
        return [], None
    estimate, low, high = (v[other] for v in intervals(q, codes, rotation))
    found, need = Found(q, x), []
    for p in scores:
        floor, top = band[0] * p, band[1] * p
        within = np.flatnonzero((100 * high >= floor) & (100 * low <= top))
        likely = within[100 * estimate[within] <= top]
        if len(likely) > 4 * k:
            likely = likely[np.argpartition(-estimate[likely], 4 * k - 1)[:4 * k]]
        s = found.take(other[likely])
        s = np.sort(s[(100 * s >= floor) & (100 * s <= top)])
        if len(s) >= k:
            within = within[high[within] >= s[-k]]
        need.append(other[within])
    out = []
    for n, (p, at) in enumerate(zip(scores, need)):
        s = found.take(at)
        good = (100 * s >= band[0] * p) & (100 * s <= band[1] * p)
        at, s = at[good], s[good]
        best = _first(s, xid[at], k)
        out += [(n, j, v) for j, v in zip(at[best], s[best])]
    return out, found


def _rows(vectors: DataFrame, factor: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(uid, vec_id, label, v): scaled components as bytes of 32-bit integers, as a table."""
    e = F.transform(quoted(embedding), lambda x: x.cast("double"))
    good = quoted(vec_id).isNotNull() & quoted(label).isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) * F.lit(factor) < F.lit(float(LARGEST))))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), e.alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.floor(factor * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)).astype(np.int32).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    return cut(rows.filter(quoted("label").isNotNull()).mapInArrow(run, "vec_id bigint, label bigint, v binary")).withColumn("uid", F.monotonically_increasing_id())


def _packed(rows: DataFrame, size: int, rotation: Rotation, coded: bool) -> DataFrame:
    """A table with a row for every ``size`` rows that follow each other by label: their columns as bytes, the
    codes if wanted, and the different labels."""
    schema = "n int, uids binary, ids binary, label_of binary, v binary, codes binary, labels array<bigint>"

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        uids, ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("uid", "vec_id", "label"))
        v = np.zeros((len(ids), rotation.width), np.int32)
        for i, b in enumerate(t.column("v").to_pylist()):
            v[i, :len(b) // 4] = np.frombuffer(b, np.int32)
        made = [len(ids), uids.tobytes(), ids.tobytes(), labels.tobytes(), v.tobytes(), Codes(v, rotation).pack() if coded else None, np.unique(labels).tolist()]
        types = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, types)], names=["n", "uids", "ids", "label_of", "v", "codes", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    near = rows.select("uid", "vec_id", "label", "v").repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id", "uid")
    return cut(near.mapInArrow(run, schema)).withColumn("block", F.monotonically_increasing_id())


def _pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of data. Every task reads some files of
    both tables and pairs their rows, so neither side is shuffled or sent by the driver:
    the anchors, once for each block of data, are far more than their file."""
    return asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).hint("shuffle_replicate_nl").crossJoin(data)


def _unpack(r: dict, side: str, width: int):
    ids, labels = (np.frombuffer(r[side + c], np.int64) for c in ("ids", "label_of"))
    return ids, labels, np.frombuffer(r[side + "v"], np.int32).reshape(len(ids), width).astype(np.int64)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), factor: float = 256.0,
                   vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are multiplied by ``factor`` and rounded down, scores are inner
    products. Anchors are the rows whose id is divisible by ``every``; their
    positives are the ``positives`` best other rows of their label; each brings
    the ``negatives`` best rows of another label whose score is between
    ``band[0]`` and ``band[1]`` percent of the positive's. Ties go to the smaller id.

    Rows with a null id, label or vector, with a null or non-finite component, or
    with a scaled component of 2^28 or more take no part. Labels are whole numbers.
    A shorter vector counts as if it ended in zeros. Each row of a repeated id is
    an anchor and a candidate of its own, but no positive of its own id. An empty
    table, or one label alone, gives no rows.
    """
    rows = _rows(vectors, factor, vec_id, embedding, label)
    width = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4 or 1
    rotation = Rotation(width)
    data = _packed(rows, BLOCK, rotation, True)
    asked = _packed(rows.filter(F.col("vec_id") % every == 0), ANCHORS, rotation, False).drop("codes")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                qid, ql, q = _unpack(r, "q_", width)
                xid, xl, x = _unpack(r, "", width)
                codes, uids = Codes.unpack(r["codes"], r["n"]), np.frombuffer(r["q_uids"], np.int64)
                for i in range(len(qid)):
                    best, _ = positives_block(q[i], qid[i], ql[i], x, xid, xl, codes, rotation, positives)
                    out += [(r["q_block"], int(uids[i]), int(xid[j]), int(s)) for j, s in best]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["part", "uid", "positive_id", "positive_score"]).astype("int64"), preserve_index=False)

    found = _pairs(asked, data).filter(F.arrays_overlap("labels", "q_labels")).mapInArrow(near, "part bigint, uid bigint, positive_id bigint, positive_score bigint")
    first = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = found.withColumn("place", first).filter(F.col("place") <= positives)
    # at most positives x ANCHORS entries for a block
    lists = chosen.groupBy("part").agg(F.collect_list(F.struct("uid", "place", "positive_id", "positive_score")).alias("positives"))
    # merged, since Spark would choose a broadcast by the file of the blocks, which may be far smaller than the blocks
    wanted = cut(asked.join(lists.hint("merge"), F.col("block") == F.col("part")).drop("part"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("uid", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                qid, ql, q = _unpack(r, "q_", width)
                xid, xl, x = _unpack(r, "", width)
                codes, at = Codes.unpack(r["codes"], r["n"]), {int(u): i for i, u in enumerate(np.frombuffer(r["q_uids"], np.int64))}
                of: dict[int, list] = {}
                for p in r["q_positives"]:
                    of.setdefault(p["uid"], []).append(p)
                for uid, ps in of.items():
                    i = at[uid]
                    got, _ = mine_block(q[i], ql[i], [p["positive_score"] for p in ps], x, xid, xl, codes, rotation, negatives, band)
                    out += [(uid, ps[n]["place"], int(qid[i]), ps[n]["positive_id"], ps[n]["positive_score"], int(xid[j]), int(s)) for n, j, s in got]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names).astype("int64"), preserve_index=False)

    mixed = ~((F.size("labels") == 1) & (F.size("q_labels") == 1) & (F.col("labels") == F.col("q_labels")))
    mined = _pairs(wanted, data).filter(mixed).mapInArrow(mine, schema)
    rank = F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_inner_product(a.e, d.e) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


@query("op12_one_bit_negatives", SQL)
def op12(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))

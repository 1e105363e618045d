"""Vector codes: every vector is cut into equal parts, and each part is replaced by
the index of the nearest entry of its position's codebook (product quantization).

The codebooks are fitted by whole-number k-means. Rows lie in blocks; each block
keeps a ball tree for every part position, built middle-out by the anchors
hierarchy, with the sum and count of the points in each ball. In a round, a ball
inherits the entries that can still be nearest to one of its points; an entry that
another one beats all over the ball is dropped, and a ball with one entry left
gives its sum and count at once. Trees are built once and written beside the
points; a round reads them and returns only sums and counts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, quoted, read
from cairn.llm.registry import query

__all__ = ["BallTree", "compress", "digest", "nearest", "owned_sums", "with_label_error"]

#: Vectors of a block, and points that a leaf may hold.
BLOCK, LEAF = 4096, 8
#: Scaled components must be smaller, so that squared distances and sums stay in 64 bits.
LARGEST = 2 ** 25
#: Distances are compared with this relative slack, above the rounding of double precision.
SLACK = 1e-9


class BallTree:
    """Balls over integer points. ``order`` lists the points so that each ball holds
    the slice ``start:stop`` of it; ``points`` are in that order. ``left`` is -1
    for a leaf. Centres are means, radii the true largest distances."""

    FIELDS = (("start", np.int32), ("stop", np.int32), ("left", np.int32), ("right", np.int32), ("radius", np.float64))

    def __init__(self, x: np.ndarray):
        self.order = np.zeros(0, np.int32)
        nodes: list[tuple] = []
        if len(x):
            self.order = self._flatten(x, _middle_out(x, np.arange(len(x))), nodes)
        self.points = x[self.order]
        for i, (name, kind) in enumerate(self.FIELDS):
            setattr(self, name, np.array([n[i] for n in nodes], kind))
        self.sums = np.array([self.points[a:b].sum(0) for a, b in zip(self.start, self.stop)], np.int64).reshape(len(nodes), x.shape[1])
        self._centres()

    def _centres(self) -> None:
        self.centre = self.sums / np.maximum(self.stop - self.start, 1)[:, None]

    def _flatten(self, x: np.ndarray, root, nodes: list) -> np.ndarray:
        """Number the nodes, children after their parent, and lay out the points."""
        order, todo, at = [], [(root, -1, 0)], 0
        while todo:
            (points, children), parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            c = x[points].mean(0)
            # a parent's points are those of its children in the order in which they are visited
            nodes.append([at, at + len(points), -1, -1, float(np.sqrt(((x[points] - c) ** 2).sum(1).max())) * (1 + SLACK)])
            if children:
                todo += [(children[1], me, 1), (children[0], me, 0)]
            else:
                order.append(points)
                at += len(points)
        return np.concatenate(order).astype(np.int32)

    def pack(self) -> bytes:
        head = np.array([len(self.order), len(self.start), self.points.shape[1]], np.int64)
        rest = [getattr(self, n) for n, _ in self.FIELDS] + [self.sums, self.order, self.points.astype(np.int32)]
        return b"".join([head.tobytes(), *(a.tobytes() for a in rest)])

    @classmethod
    def unpack(cls, data: bytes) -> BallTree:
        n, m, w = np.frombuffer(data, np.int64, 3)
        at, tree = 24, cls.__new__(cls)
        for name, kind, shape in [*((f, k, (m,)) for f, k in cls.FIELDS), ("sums", np.int64, (m, w)), ("order", np.int32, (n,)), ("points", np.int32, (n, w))]:
            size = int(np.prod(shape))
            setattr(tree, name, np.frombuffer(data, kind, size, at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        tree.points = tree.points.astype(np.int64)
        tree._centres()
        return tree


def _anchors(x: np.ndarray, k: int) -> list[np.ndarray]:
    """At most ``k`` groups of rows. Each new anchor is the point furthest from the
    anchor with the largest radius; it takes over the points nearer to it, and
    only those further from their anchor than half the way between the anchors
    are looked at."""
    away, owner, anchors = np.sqrt(((x - x[0]) ** 2).sum(1)), np.zeros(len(x), np.int32), [0]
    while len(anchors) < k:
        new = int(away.argmax())
        if away[new] == 0:
            break
        half = np.sqrt(((x[anchors] - x[new]) ** 2).sum(1)) / 2
        at = np.flatnonzero(away >= half[owner] * (1 - SLACK))
        d = np.sqrt(((x[at] - x[new]) ** 2).sum(1))
        mine = d < away[at]
        owner[at[mine]], away[at[mine]] = len(anchors), d[mine]
        anchors.append(new)
    return [g for a in range(len(anchors)) if len(g := np.flatnonzero(owner == a))]


def _middle_out(x: np.ndarray, rows: np.ndarray):
    """(rows, children): anchors in the middle, split further below, and merged above
    by the two balls that fit into the smallest common one."""
    if len(rows) <= LEAF:
        return rows, None
    own = x[rows].astype(np.float64)
    groups = _anchors(own, int(np.ceil(np.sqrt(len(rows)))))
    if len(groups) == 1:  # all points are equal
        return rows, None
    nodes = {i: _middle_out(x, rows[g]) for i, g in enumerate(groups)}
    centre = {i: own[g].mean(0) for i, g in enumerate(groups)}
    radius = {i: float(np.sqrt(((own[g] - centre[i]) ** 2).sum(1).max())) for i, g in enumerate(groups)}

    def fits(i: int, others: list[int]) -> list[tuple]:
        if not others:
            return []
        d = np.sqrt(((np.array([centre[j] for j in others]) - centre[i]) ** 2).sum(1))
        return [((float(e) + radius[i] + radius[j]) / 2, i, j) for e, j in zip(d, others)]

    heap = [f for i in nodes for f in fits(i, [j for j in nodes if j > i])]
    heapq.heapify(heap)
    made = len(groups)
    while len(nodes) > 1:
        _, i, j = heapq.heappop(heap)
        if i not in nodes or j not in nodes:
            continue
        a, b = nodes.pop(i), nodes.pop(j)
        both = np.concatenate([a[0], b[0]])
        centre[made] = x[both].mean(0)
        radius[made] = float(np.sqrt(((x[both] - centre[made]) ** 2).sum(1).max()))
        for f in fits(made, list(nodes)):
            heapq.heappush(heap, f)
        nodes[made] = both, (a, b)
        made += 1
    return next(iter(nodes.values()))


def _settle(tree: BallTree, entries: np.ndarray):
    """Balls that one entry owns, as (nodes, entries), and the points of the other
    leaves, as (places, mask of the entries left)."""
    owned, owner, places, masks = [], [], [], []
    front, left = np.zeros(min(1, len(tree.start)), np.int64), np.ones((1, len(entries)), bool)
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2).astype(np.float64))
    for e in range(1, len(entries)):
        left[0, e] = (apart[e, :e] > 0).all()  # of equal entries the lower index wins every tie
    apart[apart == 0] = np.inf
    while len(front):
        d2 = ((tree.centre[front][:, None, :] - entries[None]) ** 2).sum(2)
        near = np.where(left, d2, np.inf).argmin(1)
        # an entry is dropped if the whole ball lies on the nearest one's side of the plane between them, so no tie is lost
        beyond = (d2 - d2[np.arange(len(front)), near][:, None]) / (2 * apart[near])
        left = left & ~(beyond > tree.radius[front][:, None] * (1 + SLACK) + SLACK * (1 + np.sqrt(d2)))
        sole = left.sum(1) == 1
        owned.append(front[sole])
        owner.append(left[sole].argmax(1))
        leaf = ~sole & (tree.left[front] < 0)
        for node, m in zip(front[leaf], left[leaf]):
            at = np.arange(tree.start[node], tree.stop[node])
            places.append(at)
            masks.append(np.repeat(m[None], len(at), 0))
        on = ~sole & ~leaf
        front, left = np.concatenate([tree.left[front[on]], tree.right[front[on]]]), np.concatenate([left[on], left[on]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(owned or [none]), np.concatenate(owner or [none]),
            np.concatenate(places or [none]), np.concatenate(masks or [np.zeros((0, len(entries)), bool)]))


def _nearest(points: np.ndarray, mask: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each point's mask, ties to the lower index."""
    at, far = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for e in range(len(entries)):
        rows = np.flatnonzero(mask[:, e])
        d = ((points[rows] - entries[e]) ** 2).sum(1)
        nearer = d < far[rows]
        at[rows[nearer]], far[rows[nearer]] = e, d[nearer]
    return at


def owned_sums(tree: BallTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry."""
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nodes, owner, places, mask = _settle(tree, entries)
    np.add.at(sums, owner, tree.sums[nodes])
    np.add.at(counts, owner, (tree.stop - tree.start)[nodes])
    at = _nearest(tree.points[places], mask, entries)
    np.add.at(sums, at, tree.points[places])
    np.add.at(counts, at, 1)
    return sums, counts


def nearest(tree: BallTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance to it, in the order of the rows."""
    code = np.zeros(len(tree.order), np.int64)
    nodes, owner, places, mask = _settle(tree, entries)
    for n, e in zip(nodes, owner):
        code[tree.start[n]:tree.stop[n]] = e
    code[places] = _nearest(tree.points[places], mask, entries)
    back = np.empty_like(code)
    back[tree.order] = code
    error = np.empty_like(code)
    error[tree.order] = ((tree.points - entries[code]) ** 2).sum(1)
    return back, error


def _blocks(rows: DataFrame, parts: int, width: int, factor: float) -> DataFrame:
    """(ids, labels, trees): a row for every ``BLOCK`` vectors, with a packed tree per part."""
    schema = "ids array<bigint>, labels array<string>, trees array<binary>"
    types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary())]

    def block(ids: list, labels: list, x: list) -> pa.RecordBatch:
        v = np.zeros((len(x), width), np.int64)
        for i, row in enumerate(x):
            v[i, :len(row)] = np.floor(factor * row).astype(np.int64)
        trees = [BallTree(p).pack() for p in np.split(v, parts, axis=1)]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((ids, labels, trees), types)], names=["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            x += [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in b.column(2)]
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], labels[:BLOCK], x[:BLOCK])
                ids, labels, x = ids[BLOCK:], labels[BLOCK:], x[BLOCK:]
        if ids:
            yield block(ids, labels, x)

    return rows.mapInArrow(run, schema)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books with each entry replaced by the floor of its parts' mean; unused ones stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for trees in b.column(0).to_pylist():
                for p, t in enumerate(trees):
                    s, n = owned_sums(BallTree.unpack(t), books[p])
                    sums[p] += s
                    counts[p] += n
        p, e = (a.ravel() for a in np.indices(counts.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts.ravel(), pa.int64()),
                                          pa.array(list(sums.reshape(len(p), -1)), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    found = blocks.select("trees").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    per = found.select("part", "entry", "n", F.posexplode("s").alias("d", "s"))
    out = books.copy()
    for r in per.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # as many rows as the books have numbers
        if r.n:
            out[r.part, r.entry, r.d] = r.s // r.n
    return out


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: float = 4096.0, vec_id: str = "vec_id",
             embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as text, code, error) of each vector, and the codebooks as
    whole numbers [part, entry, place].

    Components are multiplied by ``factor`` and rounded down. The codebooks start
    as the parts of the ``entries`` smallest vec_ids (nulls last, repeated ids by
    their vectors; fewer, if there are fewer rows). ``code`` has two hex digits a
    part, ``error`` is the squared distance. Rows whose vector is null or has a
    null or non-finite component are dropped; so are those with a scaled component
    of 2^25 or more. Repeated rows count each time. A shorter vector counts as if
    it ended in zeros, as does the last part. An empty table gives no rows and
    codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    e = F.transform(quoted(embedding), lambda x: x.cast("double"))
    good = quoted(embedding).isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) * F.lit(factor) < F.lit(float(LARGEST))))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("string").alias("label"), e.alias("e"))
    widest = rows.agg(F.max(F.size("e"))).first()[0] or 0
    width = max(1, -(-widest // parts)) * parts
    first = rows.select("vec_id", "e").orderBy(F.asc_nulls_last("vec_id"), "e").limit(entries).collect()
    books = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        books[i, :len(r.e)] = np.floor(factor * np.array(r.e, np.float64)).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    blocks = cut(_blocks(rows, parts, width, factor))
    for _ in range(rounds if first else 0):
        books = _round(blocks, books)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, trees in zip(*(c.to_pylist() for c in b.columns)):
                found = [nearest(BallTree.unpack(t), books[p]) for p, t in enumerate(trees)]
                codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes]),
                                                  pa.array(sum(d for _, d in found))], names=schema.names)

    return blocks.mapInArrow(run, schema), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of ``error`` over its label, nulls together. Sums are taken before
    the shuffle; adaptive execution broadcasts them if they are few, or splits a hot label."""
    total = coded.groupBy(F.col("label").alias("_cairn_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_cairn_label"))).drop("_cairn_label")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 64) -> str:
    w = width // parts

    def dealt(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
  SELECT u.vec_id, u.part, c.entry, CAST(sum((u.v - c.v) * (u.v - c.v)) AS BIGINT) AS d FROM u JOIN c{r} c ON u.part = c.part AND u.place = c.place
  GROUP BY u.vec_id, u.part, c.entry) GROUP BY vec_id, part)"""

    steps = ",".join(f"""{dealt(r)},
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.place, CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE c.v END AS v FROM c{r} c LEFT JOIN (
  SELECT a.part, a.entry, u.place, CAST(sum(u.v) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN u ON a.vec_id = u.vec_id AND a.part = u.part
  GROUP BY a.part, a.entry, u.place) m ON c.part = m.part AND c.entry = m.entry AND c.place = m.place)""" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({4096} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e,
  row_number() OVER (ORDER BY vec_id) - 1 AS place_of FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
u AS MATERIALIZED (SELECT vec_id, (i - 1) // {w} AS part, (i - 1) % {w} AS place, e[i] AS v FROM (SELECT vec_id, e, unnest(range(1, {width} + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, place_of AS entry, place, v FROM u JOIN kept USING (vec_id) WHERE place_of < {entries}),{steps},{dealt(rounds)},
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r JOIN kept USING (vec_id) GROUP BY label)
SELECT r.vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN kept k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h
"""


@query("op11_anchor_codes", _sql())
def op11(spark, sf_dir):
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    return with_label_error(cut(coded)).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

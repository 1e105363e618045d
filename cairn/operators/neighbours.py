"""Nearest vectors by an index of cells and rings, for two large sides.

Reference vectors lie in the cell of their nearest centre, ordered by the distance to
it, in blocks: a block is a ring of a cell. By the triangle inequality a vector t with
its k-th neighbour within u needs a block only if d(t, centre) - u and d(t, centre) + u
meet the ring. Targets are blocked the same way, so the vectors of one block need much
the same rings, and what crosses the network is a block once per block that needs it, or
that it needs: of a table with itself two blocks are compared once for both."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.operators.vectors import id_codes, nearest, top_k, unit_rows
from cairn.plans.lineage import written
from cairn.plans.ordered import sequence
from cairn.plans.skew import matrix, side_by_side

__all__ = ["nearest_vectors", "compared_pairs"]

SLACK = 2e-9  # distances are ranked to nine places
SPAN = 1 << 22  # numbers in one piece of a matrix of distances
TASK_ROWS = 200_000  # rows of blocks in one task
BLOCKS = 48  # blocks of a large table, besides one for each cell; a row is sent once for each block that is compared with its own


def _length(d, measure):
    """The metric distance for a distance of the measure."""
    return np.sqrt(2 * np.maximum(d, 0)) if measure == "cosine" else d


def _metric(a, b, measure):
    """Distances between the rows of two matrices (unit rows for cosine), in the metric
    that the triangle inequality holds for."""
    out = np.empty((len(a), len(b)))
    step = max(1, SPAN // max(b.size, 1))
    for i in range(0, len(a), step):
        d = a[i:i + step, None] - b[None]
        out[i:i + step] = np.abs(d).sum(2) if measure == "manhattan" else np.sqrt((d * d).sum(2))
    return out


def _clean(df, id_col, vector, measure):
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast(kind).alias("v")).filter("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return rows.filter("exists(v, x -> x <> 0)") if measure == "cosine" else rows


def _blocks(rows, centres, measure, kind, size):
    """(cell, block, at, id, v, r): vectors by cell in order of the distance ``r`` to its centre."""
    def place(batches):
        for pdf in batches:
            d = _metric(unit_rows(np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1), measure), centres, measure) if len(pdf) else np.zeros((0, 1))
            pdf["cell"], pdf["r"] = d.argmin(1).astype(np.int32), d.min(1)
            yield pdf

    placed = rows.mapInPandas(place, f"id {kind}, v {dict(rows.dtypes)['v']}, cell int, r double")
    numbered = sequence(placed, ["cell"], ["r", "id"], "at")
    return written(numbered.select("cell", F.floor((F.col("at") - 1) / size).alias("block"), "at", "id", "v", "r"))


def _search(target, reference, id_col, vector, measure, top, skip_self, cells, block_rows, probes):
    """(cell, at, target_id, reference_id, distance, pairs): the best few references of
    each block that a target needs; rows without target count the pairs compared."""
    kind, same = dict(target.dtypes)[id_col], target.sameSemantics(reference)
    t, r = _clean(target, id_col, vector, measure), _clean(reference, id_col, vector, measure)
    # centres: at most ``cells`` rows of the reference, by the hash of their id
    first = r.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    if not first:
        return None
    centres = np.unique(unit_rows(np.array([x["v"] for x in first], float), measure), axis=0)
    size = max(block_rows, -(-max(r.count(), t.count()) // BLOCKS))
    known = _blocks(r, centres, measure, kind, size)
    asked = known if same else _blocks(t, centres, measure, kind, size)
    ring = ["cell", "block"], F.min("r").alias("low"), F.max("r").alias("high")
    rings = known.groupBy(*ring[0]).agg(*ring[1:]).select("cell", *[F.col(c).alias(f"r_{c}") for c in ("block", "low", "high")])
    spans = asked.groupBy(*ring[0]).agg(*ring[1:])
    middle = F.abs(F.col("low") + F.col("high") - F.col("r_low") - F.col("r_high"))
    # the ring of the same cell that lies nearest gives each target its first bound
    home = written(spans.join(rings, "cell").groupBy("cell", "block").agg(F.min_by("r_block", F.struct(middle, "r_block")).alias("r_block"))
                   .withColumn("r_cell", F.col("cell")))
    schema = f"cell int, at bigint, target_id {kind}, reference_id {kind}, distance double, pairs bigint"
    cores = target.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n: max(1, min(n, max(2 * cores, 2 * n * size // TASK_ROWS)))

    def joined(links, l, r, kernel):
        """The kernel over the rows of both blocks of each link; there are few links."""
        links = written(links.withColumn("link", F.row_number().over(Window.orderBy("cell", "block", "r_cell", "r_block")) - 1))
        cols = ["id", "v", "cell", "at", "far"]
        l = l.join(F.broadcast(links), ["cell", "block"]).select("link", F.lit(0).alias("side"), *cols)
        there = links.select(F.col("r_cell").alias("cell"), F.col("r_block").alias("block"), "link")
        r = r.join(F.broadcast(there), ["cell", "block"]).select("link", F.lit(1).alias("side"), *cols)
        return side_by_side(l.unionByName(r), kernel, schema, tasks(links.count()))

    def listed(l, side, at, known_ids):
        """Results of the rows ``at`` of the table ``l``."""
        who, code, d = side.found()
        own = l.take(pa.array(at[who]))
        return pa.RecordBatch.from_arrays([own[c].combine_chunks() for c in ("cell", "at", "id")] + [known_ids.take(pa.array(code)), pa.array(d), pa.nulls(len(d), pa.int64())],
                                          names=["cell", "at", "target_id", "reference_id", "distance", "pairs"])

    def counted(n, batch):
        gone = [pa.nulls(1, f.type) for f in batch.schema]
        return pa.RecordBatch.from_arrays([*gone[:-1], pa.array([n])], names=batch.schema.names)

    def read(l):
        far = l["far"].to_numpy()
        return unit_rows(matrix(l["v"]), measure), int(l["cell"][0].as_py()), np.where(np.isnan(far), np.inf, far)

    def first_pass(_, l, r):
        (a, _, _), (b, _, _) = read(l), read(r)
        (ac, bc), ids = id_codes(l["id"].combine_chunks(), r["id"].combine_chunks())
        out = listed(l, nearest(a, ac, b, bc, measure, top, skip_self)[0], np.arange(len(a)), ids)
        yield out
        yield counted(len(a) * len(b), out)

    none = F.lit(None).cast("double").alias("far")
    begun = written(joined(home, asked.select("*", none), known.select("*", none), first_pass))
    # a target with fewer than ``top`` references in its first ring has no bound yet
    full = begun.filter("at IS NOT NULL").groupBy("cell", "at").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).filter(F.col("n") >= top).drop("n")
    bounds = written(asked.join(full, ["cell", "at"], "left"))

    def needs(batches):
        for pdf in batches:
            for (cell, block), rows in pdf.groupby(["cell", "block"]):
                a = unit_rows(np.array(rows["v"].tolist(), float), measure)
                bound = _length(rows["far"].fillna(np.inf).to_numpy()[:, None] + SLACK, measure) + SLACK
                d = _metric(a, centres, measure)
                slack = 1e-12 * d + SLACK
                lo, hi = d - bound - slack, d + bound + slack
                if probes:
                    out = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) >= probes
                    lo[out], hi[out] = np.inf, -np.inf
                use = lo.min(0) <= hi.max(0)
                yield pd.DataFrame({"cell": cell, "block": block, "r_cell": np.flatnonzero(use).astype(np.int32), "lo": lo.min(0)[use], "hi": hi.max(0)[use]})

    wanted = bounds.select("cell", "block", "v", "far").mapInPandas(needs, "cell int, block bigint, r_cell int, lo double, hi double")
    wanted = wanted.groupBy("cell", "block", "r_cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    meets = (F.col("lo") <= F.col("r_high") + 1e-12 * F.col("r_high")) & (F.col("hi") >= F.col("r_low") - 1e-12 * F.col("r_low"))
    ends = ["cell", "block", "r_cell", "r_block"]
    links = wanted.join(rings.withColumnRenamed("cell", "r_cell"), "r_cell").filter(meets).select(*ends).join(home, ends, "left_anti")
    if same:
        # two blocks of one table are compared once for both
        here, there = F.struct(*ends[:2]), F.struct(F.col("r_cell").alias("cell"), F.col("r_block").alias("block"))
        links = links.select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).distinct() \
                     .select("a.*", F.col("b.cell").alias("r_cell"), F.col("b.block").alias("r_block"))

    def near(a, far, cell, b):
        """The rows of ``a`` that need a block, which lies in ``cell`` and has the rows ``b``."""
        bound = _length(far + SLACK, measure) + SLACK
        d, ring = (_metric(x, centres[cell:cell + 1], measure)[:, 0] for x in (a, b))
        slack = 1e-12 * (d + ring.max()) + SLACK
        use = (d - bound <= ring.max() + slack) & (d + bound >= ring.min() - slack)
        if probes:
            use &= (np.argsort(np.argsort(_metric(a, centres, measure), axis=1, kind="stable"), axis=1) < probes)[:, cell]
        return use

    def second_pass(_, l, r):
        (a, a_cell, a_far), (b, b_cell, b_far) = read(l), read(r)
        (ac, bc), ids = id_codes(l["id"].combine_chunks(), r["id"].combine_chunks())
        p = near(a, a_far, b_cell, b)
        q = near(b, b_far, a_cell, a) if same else np.zeros(len(b), bool)
        n = 0
        for of, other, both in ((p, q, True), (p, ~q, False), (~p, q, None)):
            i, j = np.flatnonzero(of), np.flatnonzero(other)
            if not len(i) or not len(j):
                continue
            n += len(i) * len(j)
            if both is None:
                side, _ = nearest(b[j], bc[j], a[i], ac[i], measure, top, skip_self, limit=b_far[j])
                yield listed(r, side, j, ids)
                continue
            x, y = nearest(a[i], ac[i], b[j], bc[j], measure, top, skip_self, both, a_far[i], b_far[j])
            out = listed(l, x, i, ids)
            yield out
            if both:
                yield listed(r, y, j, ids)
        if n:
            yield counted(n, listed(l, nearest(a[:1], ac[:1], b[:1], bc[:1], measure, 1)[0], np.arange(1), ids))

    rest = joined(links, bounds, bounds if same else known.select("*", none), second_pass)
    return written(begun.unionByName(rest))


def nearest_vectors(target: DataFrame, reference: DataFrame, id_col: str, vector: str, measure="euclidean", top=3, skip_self=True,
                    cells=256, block_rows=1024, approximate=False, probes=16) -> DataFrame:
    """(target_id, reference_id, distance): the ``top`` nearest references of every
    target, ties to the smaller id, the same rows as ``vector_distance``. How many pairs
    are compared depends on the data: few where vectors cluster, all in even noise.

    With ``approximate`` a target looks at the ``probes`` cells with the nearest centres
    only, so a neighbour in another cell is missed; measure the recall before use.
    Centres are ``cells`` references, taken by the hash of their id. Vectors that are
    null, empty, not finite or (cosine) zero take no part; all have one length."""
    found = _search(target, reference, id_col, vector, measure, top, skip_self, cells, block_rows, probes if approximate else 0)
    if found is None:
        kind = dict(target.dtypes)[id_col]
        return target.sparkSession.createDataFrame([], f"target_id {kind}, reference_id {kind}, distance double")
    rows = found.filter("at IS NOT NULL").select("target_id", "reference_id", "distance")
    return top_k(rows, ["target_id"], top, [F.round("distance", 9), F.col("reference_id")])


def compared_pairs(target: DataFrame, reference: DataFrame, id_col: str, vector: str, measure="euclidean", top=3, skip_self=True,
                   cells=256, block_rows=1024, approximate=False, probes=16) -> DataFrame:
    """One row: the pairs that ``nearest_vectors`` compares, and all pairs there are."""
    got = _search(target, reference, id_col, vector, measure, top, skip_self, cells, block_rows, probes if approximate else 0)
    n, m = target.agg(F.count(F.lit(1)).alias("n")), reference.agg(F.count(F.lit(1)).alias("m"))
    every = n.crossJoin(m).select((F.col("n") * F.col("m")).alias("all_pairs"))  # one row each
    if got is None:
        return every.select(F.lit(0).cast("bigint").alias("compared"), "all_pairs")
    return got.agg(F.sum("pairs").alias("compared")).crossJoin(every)

"""Vector distances, normalisation and quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.expr import flag, pct, rnd, tally
from cairn.plans.skew import tile_pairs

MEASURES = ("euclidean", "manhattan", "cosine")


def top_k(df: DataFrame, keys, k: int, order) -> DataFrame:
    """The k first rows of each key. Each key and salt first keeps its own k,
    so a hot key is cut down before it is brought together."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    part = salted.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k).drop("__salt", "__r")
    return part.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= k).drop("__r")


RANKED = 2e-9  # distances are ranked to nine places
ROWS, COLUMNS = 256, 1024  # of one piece of a matrix of distances
LEVELS = 63  # steps of a component for Manhattan distances, so that four fit in a byte
LONGEST = 65535 // LEVELS  # components whose steps fit in two bytes


def unit_rows(m, measure):
    if measure != "cosine":
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, np.nan, n)


def _distances(a, b, measure):
    if measure == "cosine":
        return 1.0 - a @ b.T
    out = np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        d = b - x
        out[i] = np.sqrt((d * d).sum(axis=1)) if measure == "euclidean" else np.abs(d).sum(axis=1)
    return out


def _between(a, b, measure):
    """Distances of the rows of two matrices, one by one."""
    if measure == "cosine":
        return 1.0 - np.einsum("ij,ij->i", a, b)
    d = a - b
    return np.sqrt((d * d).sum(1)) if measure == "euclidean" else np.abs(d).sum(1)


class _Side:
    """The best few so far of each row of one side, and its vectors in single precision
    with the error that this can make."""

    def __init__(self, x, codes, middle, measure, top, limit=None, step=0.0):
        self.x, self.codes, self.top, self.measure = x, codes, top, measure
        with np.errstate(all="ignore"):
            moved = x - middle
            self.f = np.ascontiguousarray(moved, np.float32)
            eps = (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
            size = {"euclidean": (moved * moved).sum(1), "manhattan": np.abs(moved).sum(1), "cosine": np.ones(len(x))}[measure]
            self.err = 2 * eps * size
            self.low = (size * (measure == "euclidean") - self.err + (0.5 if measure == "cosine" else 0)).astype(np.float32)
            if step:
                self._levels(moved, step)
        self.d, self.c = np.full((len(x), top), np.inf), np.full((len(x), top), np.iinfo(np.int64).max)
        self.limit = np.full(len(x), np.inf, np.float32)
        if limit is not None:
            self.limit = self._up(limit)

    def _levels(self, moved, step):
        """Vectors in ``LEVELS`` steps: |p - q| is 2 max(p, q) - p - q, and cut-off ends only bring numbers nearer."""
        half = LEVELS / 2 * step
        ends = np.clip(np.nan_to_num(moved), -half, half)
        q = np.minimum(np.floor((ends + half) / step), LEVELS - 1)
        centre = (q + 0.5) * step - half
        slack = 1e-5 * step * LEVELS * moved.shape[1]
        self.q = q.astype(np.uint8)
        self.low = (-step * q.sum(1) - np.abs(ends - centre).sum(1) - slack).astype(np.float32)
        self.low[~np.isfinite(moved).all(1)] = np.nan
        self.err = np.abs(moved - centre).sum(1) + slack

    def _up(self, d):
        u = d + RANKED
        u = u * u if self.measure == "euclidean" else u
        return (u * (1 + 1e-6) + 1e-30).astype(np.float32)

    def begin(self, rows, s, err):
        """A first limit: the scores ``s`` of some pairs lie below the true ones by at most twice the error."""
        if s.shape[1] >= self.top and np.isinf(self.limit[rows]).any():
            with np.errstate(all="ignore"):
                u = np.partition(s, self.top - 1, axis=1)[:, self.top - 1] + 2 * (self.err[rows] + err)
            u = np.maximum(u, 0)
            self.limit[rows] = np.minimum(self.limit[rows], self._up(np.sqrt(u) if self.measure == "euclidean" else u))

    def merge(self, who, code, d):
        near = d <= self.d[who, -1] + RANKED
        who, code, d = who[near], code[near], d[near]
        rows = np.unique(who)
        w, e, c = np.concatenate([np.repeat(rows, self.top), who]), np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.c[rows].ravel(), code])
        order = np.lexsort((c, np.round(e, 9), w))
        pick = order[np.searchsorted(w[order], rows)[:, None] + np.arange(self.top)]
        self.d[rows], self.c[rows] = e[pick], c[pick]
        self.limit[rows] = np.fmin(self.limit[rows], self._up(self.d[rows, -1]))

    def found(self):
        """(row, code, distance) by row, the best first."""
        who, k = np.nonzero(self.c < np.iinfo(np.int64).max)
        return who, self.c[who, k], self.d[who, k]


def _maxima(x, columns):
    """Sums of the greater steps of each row of ``x`` and each column."""
    shape = len(x), columns.shape[1]
    s, four, one = np.zeros(shape, np.uint16), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    for k in range(0, len(columns), 4):
        np.maximum(x[:, k, None], columns[k], out=four)
        for n in range(k + 1, min(k + 4, len(columns))):
            np.maximum(x[:, n, None], columns[n], out=one)
            np.add(four, one, out=four)
        np.add(s, four, out=s)
    return s


def nearest(a, a_codes, b, b_codes, measure, top, skip_self=True, both=False, limit=None, other_limit=None):
    """The ``top`` nearest rows of ``b`` for each row of ``a``, and with ``both`` the
    other way round: two sides whose ``found`` has (row, code, distance). Rows of the
    same code don't meet if ``skip_self``; ties to nine places go to the smaller code.
    Vectors of a cosine have unit length. ``limit``, and ``other_limit`` for ``b``:
    distances beyond are not wanted.

    A piece of all pairs is scored in single precision, or in steps for Manhattan distances; where a score, less its error,
    is within the limit of its row, the distance is found in double precision."""
    with np.errstate(all="ignore"):
        finite = a[np.isfinite(a).all(1)]
        middle = 0.0 if measure == "cosine" or not len(finite) else finite.mean(0)
        step = 8 * float(np.std(finite - middle)) / LEVELS if measure == "manhattan" and len(finite) and a.shape[1] <= LONGEST else 0.0
        step = step if np.isfinite(step) else 0.0
    l, r = _Side(a, a_codes, middle, measure, top, limit, step), _Side(b, b_codes, middle, measure, top, other_limit, step)
    meet = skip_self and len(np.intersect1d(a_codes, b_codes)) > 0
    columns = np.ascontiguousarray((r.q if step else r.f).T)
    for i in range(0, len(a), ROWS):
        x = (l.q if step else l.f)[i:i + ROWS]
        for j in range(0, len(b), COLUMNS):
            with np.errstate(all="ignore"):
                if step:
                    s = _maxima(x, columns[:, j:j + COLUMNS]) * np.float32(2 * step)
                elif measure == "manhattan":
                    s, t = np.zeros((2, len(x), columns[:, j:j + COLUMNS].shape[1]), np.float32)
                    for k in range(x.shape[1]):
                        np.subtract(x[:, k, None], columns[k, j:j + COLUMNS], out=t)
                        np.abs(t, out=t)
                        s += t
                else:
                    s = x @ columns[:, j:j + COLUMNS]
                    s *= -2 if measure == "euclidean" else -1
                s += l.low[i:i + ROWS, None]
                s += r.low[j:j + COLUMNS]
            if meet:
                s[a_codes[i:i + ROWS, None] == b_codes[None, j:j + COLUMNS]] = np.inf
            here, there = slice(i, i + len(x)), slice(j, j + s.shape[1])
            l.begin(here, s, r.err[there].max())
            away = s > l.limit[here, None]  # false for what is not a number
            if both:
                r.begin(there, s.T, l.err[here].max())
                away &= s > r.limit[there]
            at = np.flatnonzero(~away.ravel())
            for k in range(0, len(at), ROWS * ROWS):
                p, q = np.divmod(at[k:k + ROWS * ROWS], s.shape[1])
                p, q = p + i, q + j
                if meet:
                    other = a_codes[p] != b_codes[q]
                    p, q = p[other], q[other]
                with np.errstate(all="ignore"):
                    d = _between(a[p], b[q], measure)
                good = ~np.isnan(d)
                p, q, d = p[good], q[good], d[good]
                if len(p):
                    l.merge(p, b_codes[q], d)
                    if both:
                        r.merge(q, a_codes[p], d)
    return l, r


def id_codes(*ids):
    """Numbers in the order of the ids for several Arrow arrays of them, nulls last, and the ids by number."""
    every = pa.concat_arrays(ids)
    known = every.unique()
    known = known.take(pc.sort_indices(known))
    codes = pc.index_in(every, known).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(x) for x in ids])[:-1]), known


def vector_distance(target: DataFrame, reference: DataFrame, id_col: str, vector: str, measure="euclidean", top=3,
                    skip_self=True) -> DataFrame:
    """The ``top`` nearest reference vectors of every target vector, exact.
    Tiles are compared in numpy; each keeps its best few per target and the
    survivors are merged. Ties go to the smaller id."""
    kind = dict(target.dtypes)[id_col]
    names = ["target_id", "reference_id", "distance"]

    def kernel(ids, a, others, b, both):
        (ac, bc), known = id_codes(ids, others)
        l, r = nearest(unit_rows(a, measure), ac, unit_rows(b, measure), bc, measure, top, skip_self, both)
        for side, own in ((l, ids), (r, others))[:1 + both]:
            who, code, d = side.found()
            yield pa.RecordBatch.from_arrays([own.take(pa.array(who)), known.take(pa.array(code)), pa.array(d)], names=names)

    found = tile_pairs(target, reference, id_col, vector, kernel, f"target_id {kind}, reference_id {kind}, distance double")
    return top_k(found, ["target_id"], top, [F.round("distance", 9), F.col("reference_id")])


def vector_normalize(df: DataFrame, vector: str, name="normalized") -> DataFrame:
    """Unit length (L2); a zero vector gives nulls."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("__n", F.nullif(norm, F.lit(0.0))).withColumn(name, F.transform(v, lambda x: x / F.col("__n"))).drop("__n")


BINS = [(0.1, "Very close (<0.1)"), (0.5, "Close (0.1-0.5)"), (1.0, "Moderate (0.5-1.0)"), (2.0, "Far (1.0-2.0)")]  # fixed values
LAST_BIN = "Very far (>2.0)"


def distance_stats(df: DataFrame, id_col: str, vector: str, measure="cosine", radius=0.5) -> DataFrame:
    """Per vector over all others: count, mean and minimum distance, squares
    for the deviation, neighbours within the radius, and bin counts. Tiles
    reduce to one partial row per vector, pairs are never listed."""
    kind = dict(df.dtypes)[id_col]
    edges = [-np.inf] + [b for b, _ in BINS] + [np.inf]
    names = ["id", "n", "s", "ss", "lo", "hi", "near", "bins"]

    class Sums:
        def __init__(self, n):
            self.n, self.near, self.upto = np.zeros(n, int), np.zeros(n, int), np.zeros((n, len(edges)), int)
            self.s, self.ss, self.lo, self.hi = np.zeros(n), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)

        def add(self, at, axis, d, ok, below):
            """A piece of the matrix; ``ok`` marks its numbers, or is none if all are."""
            z = d if ok is None else np.where(ok, d, 0.0)
            self.n[at] += d.shape[axis] if ok is None else ok.sum(axis)
            self.s[at] += z.sum(axis)
            self.ss[at] += np.einsum("ij,ij->i" if axis else "ij,ij->j", z, z)
            self.lo[at] = np.minimum(self.lo[at], (d if ok is None else np.where(ok, d, np.inf)).min(axis))
            self.hi[at] = np.maximum(self.hi[at], (d if ok is None else np.where(ok, d, -np.inf)).max(axis))
            for k, x in enumerate(below[:-1]):
                self.upto[at, k] += np.count_nonzero(x, axis)
            self.near[at] += np.count_nonzero(below[-1], axis)

        def batch(self, ids):
            bins = np.diff(self.upto, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bins.shape[1]), pa.array(bins.ravel()))
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, (self.n, self.s, self.ss, self.lo, self.hi, self.near)), lists], names=names)

    def kernel(ids, a, others, b, both):
        (ac, bc), _ = id_codes(ids, others)
        with np.errstate(all="ignore"):
            a, b = unit_rows(a, measure), unit_rows(b, measure)
            clean = np.isfinite(a).all() and np.isfinite(b).all()
            l, r, meet = Sums(len(a)), Sums(len(b)), len(np.intersect1d(ac, bc)) > 0
            for i in range(0, len(a), ROWS):
                for j in range(0, len(b), COLUMNS):
                    here, there = slice(i, i + ROWS), slice(j, j + COLUMNS)
                    d, ok = _distances(a[here], b[there], measure), None
                    if meet:
                        d[ac[here, None] == bc[None, there]] = np.nan
                    if meet or not clean:
                        ok = ~np.isnan(d)
                    below = [d < e for e in [*edges, radius]]
                    l.add(here, 1, d, ok, below)
                    if both:
                        r.add(there, 0, d, ok, below)
        yield l.batch(ids)
        if both:
            yield r.batch(others)

    part = tile_pairs(df, df, id_col, vector, kernel, f"id {kind}, n long, s double, ss double, lo double, hi double, near long, bins array<long>")
    k = len(edges) - 1
    return part.groupBy(F.col("id").alias(id_col)).agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("ss").alias("squares"), F.min("lo").alias("min_distance"), F.max("hi").alias("max_distance"),
        F.sum("near").alias("neighbours"), F.array(*[F.sum(F.col("bins")[i]) for i in range(k)]).alias("bins")) \
        .withColumn("avg_distance", F.col("total") / F.nullif(F.col("n"), F.lit(0)))


def distance_bins(stats: DataFrame) -> DataFrame:
    """Ordered pairs per distance bin."""
    labels = F.array(*[F.lit(lab) for _, lab in BINS], F.lit(LAST_BIN))
    rows = stats.select(F.posexplode("bins").alias("i", "c"))
    return rows.groupBy(F.element_at(labels, F.col("i") + 1).alias("distance_bin")).agg(F.sum("c").alias("pairs")).filter("pairs > 0")


def distance_summary(stats: DataFrame) -> DataFrame:
    n, s = F.sum("n"), F.sum("total")
    return stats.agg(n.alias("n_pairs"), F.min("min_distance").alias("min_distance"), F.max("max_distance").alias("max_distance"), (s / n).alias("avg_distance"),
                     F.sqrt((F.sum("squares") - s * s / n) / (n - 1)).alias("std_distance"), F.avg("min_distance").alias("mean_nn_distance"))


def vector_quality(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("total_vectors"), tally(v.isNull()).alias("null_vectors"), tally(F.exists(vector, lambda x: x.isNull())).alias("vectors_with_null"),
        tally(F.forall(vector, lambda x: x == 0)).alias("zero_vectors"), F.min(F.size(v)).alias("min_dimensions"), F.max(F.size(v)).alias("max_dimensions"))


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    long = df.select(F.posexplode(vector).alias("dimension", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy("dimension").agg(F.avg("v").alias("mean"), F.stddev("v").alias("std_dev"), F.min("v").alias("min"), F.max("v").alias("max"))

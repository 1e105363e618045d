"""Products of tiles of vectors: each pair once, and the best few by scores with errors."""

import numpy as np
import pyarrow as pa
import pytest

from cairn.operators.vectors import nearest, unit_rows, vector_distance
from cairn.plans.skew import tile_pairs


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "i long, v array<float>")


def test_a_table_with_itself_is_compared_once_for_both_sides(spark):
    n = 1500

    def kernel(ids, a, others, b, both):
        yield pa.RecordBatch.from_arrays([pa.array([len(a) * len(b)]), pa.array([both]), pa.array([len(a) + len(b)])], names=["pairs", "both", "rows"])

    df = frame(spark, np.arange(2 * n).reshape(n, 2))
    got = tile_pairs(df, df, "i", "v", kernel, "pairs long, both boolean, rows long", tile=1000).collect()
    # three tiles: three on the diagonal, three above it, which count for both orders
    assert len(got) == 6 and sum(r.pairs * (1 + r.both) for r in got) == n * n
    assert sum(r.rows for r in got) == 4 * n


@pytest.mark.parametrize("measure", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("far", [0, 1e5])
def test_the_best_of_both_sides(measure, far):
    rng = np.random.default_rng(5)
    x = unit_rows(rng.normal(size=(900, 12)) + far * (measure != "cosine"), measure)
    x[7] = x[500] = x[800] = x[3]
    a, b, codes = x[:400], x[400:], np.arange(900)
    l, r = nearest(a, codes[:400], b, codes[400:], measure, 3, both=True)
    d = 1 - a @ b.T if measure == "cosine" else np.abs(a[:, None] - b).sum(2) if measure == "manhattan" else np.sqrt(((a[:, None] - b) ** 2).sum(2))
    for side, m, other in ((l, d, codes[400:]), (r, d.T, codes[:400])):
        want = np.lexsort((np.broadcast_to(other, m.shape), np.round(m, 9)), axis=1)[:, :3]
        assert (side.found()[1].reshape(-1, 3) == other[want]).all()


def test_rows_without_vector_take_no_part(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 3.0]), (None, [0.0, 0.5])], "i long, v array<double>")
    assert {(r.target_id, r.reference_id) for r in vector_distance(df.filter("i IS NOT NULL"), df.filter("i IS NOT NULL"), "i", "v").collect()} == {(1, 3), (3, 1)}

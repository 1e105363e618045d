"""The pipeline's stages on the smallest tables, each against what its own input holds."""

import os

import pytest

import corpus_pipeline
from cairn.llm import op7_chunks, op10_benchmark
from cairn.llm.common import cut

SF = os.environ.get("CAIRN_LLM_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").split()
        sets.append({tuple(x.lower() for x in w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    both = len(sets[0] & sets[1])
    return 1.0 if not sets[0] | sets[1] else both / len(sets[0] | sets[1])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], SF)))
        if name != "packing":
            assert tables[-1].columns == columns and tables[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:5]]
    assert [len(a) >= len(b) for a, b in zip(rows, rows[1:])] == [True] * 4
    gone = set(rows[0]) - set(rows[1])
    assert sum(labels.get(d, 1) for d in gone) >= 0.8 * len(gone)
    for d in set(rows[1]) - set(rows[2]):  # what went has a near copy that stayed, with a smaller id
        assert any(k < d and jaccard(rows[1][d].text, r.text) >= 0.8 for k, r in rows[2].items())
    texts = [r.text for r in rows[2].values()]
    assert len(set(texts)) == len(texts)
    want = op7_chunks.brute([(d, r.text) for d, r in rows[2].items()])
    assert {d: r.text for d, r in rows[3].items()} == {d: k.decode() for d, (k, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows[3].values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in op10_benchmark.brute([(d, r.text) for d, r in rows[3].items()], bench) if r[5]}
    assert set(rows[4]) == set(rows[3]) - hit
    pieces = tables[5].collect()
    assert {r.doc_id for r in pieces} == set(rows[4])
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_nothing_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, None, "en", "s", 0), (6, "", None, None, None)], docs.schema))
    for start in (docs.filter("false"), odd):
        got = start
        for _, stage in corpus_pipeline.STAGES:
            got = cut(stage(spark, got, SF))
        assert got.count() >= 0 and "sequence_id" in got.columns

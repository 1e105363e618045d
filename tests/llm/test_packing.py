import zlib

import numpy as np
import pytest

from cairn.llm.op5_packing import WordEncoder, first_fit_decreasing, pack

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's 1234 o'clock", "", "tab\tand\r\nlines\x0b\x0cand\x1cseparators\x85\xa0　here", "ÀÉÎ İstanbul ΣΑΣ ﬀ é e ́x", "<|endoftext|> and a<|startoftext|>b <|other|>",
         "日本語のテキスト 🙂🙂 ​ zero", "a" * 500, "x " * 3000, "don't we'll I'M", "\x00 nul ﻿ bom"]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers():
    t, mine = reference(), WordEncoder(PATH)
    for text in [*TEXTS, " ".join(TEXTS), *TEXTS]:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def slow_first_fit(sizes, capacity):
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(capacity)
        out[i] = b, capacity - free[b]
        free[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 257])
def test_tournament_tree(n):
    sizes = np.random.default_rng(n).integers(1, 101, n)
    bins, offsets = first_fit_decreasing(sizes, 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == slow_first_fit(sizes.tolist(), 100)


@pytest.mark.parametrize("group_docs", [4000, 3])
def test_pieces(spark, group_docs):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(50, None, 0), (3, "same id", 0), (None, "no id", 0), (60, "word " * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = pack(docs, PATH, 2048, group_docs=group_docs).collect()
    t, left = reference(), {}
    for d, text, _ in rows:
        left.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = next(x for x in left[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32)
        assert 0 < r.length <= 2048 and r.start + r.length <= len(ids)
    assert sum(r.length for r in got) == sum(len(x) for v in left.values() for x in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

import os
import zlib

import numpy as np
import pytest

from cairn.llm.op4_language import PieceModel, fit, held_out, predict
from cairn.llm.op9_toxicity import GRAMMAR, KINDS, compose, negation, reported, targeted
from cairn.llm import op9_toxicity

SF = os.environ.get("CAIRN_SF_DIR", "/root/testdata/sf0.01")
tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = tokenizers.path("piece_bpe_32k.model")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def model():
    rng = np.random.default_rng(1)
    p = rng.random((32000, 2)) + 1e-3
    return PieceModel(["aa", "bb"], np.array([0.5, 0.5]), p / p.sum(0), VOCABULARY)


def all_cuts(m, word):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=VOCABULARY)
    known = {sp.id_to_piece(i): i for i in range(32000) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = "▁" + word
    total = [np.ones(2)]
    for j in range(1, len(s) + 1):
        a = np.zeros(2)
        for i in range(j):
            if s[i:j] in known:
                a += total[i] * m.p[known[s[i:j]]]
            elif j - i == 1:
                a += total[i] * np.prod([m.p[sp.piece_to_id(f"<0x{b:02X}>")] for b in s[i].encode()], axis=0)
        total.append(a)
    return np.log(total[-1])


def test_forward_sums_all_segmentations():
    m = model()
    m.prepare()
    words = sorted(["the", "a", "straße", "international", "q", "日本語", "࿿", "x" * 30, "supercalifragilistic-und-so-weiter"], key=len, reverse=True)
    for w, got in zip(words, m.forward(words)):
        assert np.allclose(got, all_cuts(m, w)), w


def test_words_of_any_length():
    m = model()
    m.prepare()
    long = "abcdefghij" * 300
    got = m.forward([long])[0]
    assert np.isfinite(got).all() and got.max() < -1000
    assert [x for x, _ in m.predict([None, "", "12 34 !?", "abc", long])][:3] == ["und"] * 3
    assert all(0 <= s <= 1 for _, s in m.predict(["abc", long, "日本"]))


def rare(most=1e-14):
    """A model in which most pieces are very rare, as those are that no training text holds."""
    rng = np.random.default_rng(2)
    p = np.where(rng.random((32000, 2)) < 0.02, rng.random((32000, 2)), most * (1 + rng.random((32000, 2))))
    return PieceModel(["aa", "bb"], np.array([0.5, 0.5]), p / p.sum(0), VOCABULARY)


@pytest.mark.parametrize("char", ["\U00010330", "\u1200", "\u05d0", "\u65e5", "\ud55c", "x", "\u00e9"])
def test_rare_scripts_of_any_length(char):
    m = rare()
    m.prepare()
    words = [char * n for n in range(64, 0, -1)] + ["the" * 5 + char * 9 + "the"]
    with np.errstate(all="raise", under="ignore"):
        assert all(0 < s <= 1 for _, s in m.predict(words))
    short = [char * n for n in (4, 3, 2, 1)]  # the plain sum over all cuts does not underflow there
    for w, got in zip(short, m.forward(short)):
        assert np.allclose(got, all_cuts(m, w)), w
    for n in (20, 40, 64):  # a word of characters outside the vocabulary is a product
        if all(char not in s for s in pieces()):
            one, two = m.forward([char * 2, char])[1], m.forward([char * 2, char])[0]
            assert np.allclose(m.forward([char * n])[0], one + (n - 1) * (two - one))


def pieces():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=VOCABULARY)
    return [sp.id_to_piece(i) for i in range(32000) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


def test_query_against_all_segmentations(spark):
    m = rare()
    texts = ["the words of a text", "der die das", "\U00010330\U00010331 der", "a", "日本語 text", "x" * 12 + " le la", "12 34"]
    got = predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m).collect()
    for r in got[:-1]:
        s = np.log(0.5) + sum(all_cuts(m, w) for w in r.text.split())
        assert r.lang_pred == ["aa", "bb"][int(s.argmax())] and np.isclose(r.score, 1 / np.exp(s - s.max()).sum())
    assert (got[-1].lang_pred, got[-1].score) == ("und", 0.0)


@needs_tables
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = predict(docs, fit(docs, VOCABULARY)).withColumn("out", held_out()).select("doc_id", "lang", "lang_pred", "out", "score").collect()
    out = [r for r in got if r.out]
    assert {r.doc_id for r in out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_language_edges(spark):
    rows = [(None, "the words of a text", "en"), (2, None, "en"), (3, "", None), (4, "der die das und", "de"), (6, "the of and to", "en"), (6, "the of and to", "en"), (7, "le la les et", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = fit(docs, VOCABULARY)
    assert set(m.langs) <= {"de", "en"}
    got = predict(docs.selectExpr("*", "1 AS SCORE"), m).collect()
    assert len(got) == len(rows) and "SCORE" not in got[0].asDict()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not r.text)
    none = fit(docs.filter("false"), VOCABULARY)
    assert {r.lang_pred for r in predict(docs, none).collect()} == {"und"}
    assert predict(docs.filter("false"), m).count() == 0


def run(t, symbols):
    state, out = 0, []
    for s in symbols:
        state, o = t.arcs[state, s]
        out.append(o)
    return out


def test_grammar():
    assert run(GRAMMAR, ["insult", "end"]) == ["insult", "plain"]
    assert run(GRAMMAR, ["target", "other", "insult", "end", "insult", "end"]) == ["target", "other", "insult", "targeted", "insult", "plain"]
    assert run(GRAMMAR, ["negation", "other", "insult", "end"])[2] == "denied"
    assert run(GRAMMAR, ["negation", "other", "other", "other", "insult", "end"])[4] == "insult"
    assert run(GRAMMAR, ["negation", "end", "insult"])[2] == "insult"
    assert run(GRAMMAR, ["target", "speech", "other", "threat", "end", "threat"])[3::2] == ["quoted", "threat"]
    a, b = compose(compose(negation(), reported()), targeted()), compose(negation(), compose(reported(), targeted()))
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = [op9_toxicity.SYMBOLS[i] for i in rng.integers(0, len(op9_toxicity.SYMBOLS), 12)]
        assert run(a, s) == run(b, s)
    assert len(KINDS) == 5


def test_clauses_are_scored_not_words():
    m = op9_toxicity.Model({"foozle": 4.0}, {})
    f = m.features
    assert f("you foozle")[KINDS.index("targeted")] > 0 and f("a foozle, you know")[KINDS.index("plain")] > 0
    assert f("he is not a foozle")[KINDS.index("denied")] > 0 and f("she said foozle")[KINDS.index("quoted")] > 0
    assert f("I will kill it")[KINDS.index("threat")] > 0 and not f("nothing of it")[:-1].any() and not f(None)[:-1].any()


def test_denied_and_quoted_words_do_not_count_as_plain():
    f = op9_toxicity.Model({"foozle": 4.0}, {}).features
    assert f("you foozle. you foozle")[-3] > 0 and f("you foozle. you foozle")[-2] == 1
    assert not f("he is not a foozle. she said foozle. never kill it")[-3:-1].any()


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = op9_toxicity.score(docs, op9_toxicity.fit(docs, labels)).join(labels, "doc_id").filter(held_out()).collect()
    hit = sum(r.toxic == r.predicted for r in got)
    assert hit >= 0.93 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some text", 5), (3, "word " * 300_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.filter("false")):
        got = op9_toxicity.score(docs, op9_toxicity.fit(docs, known)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert op9_toxicity.score(docs.filter("false"), op9_toxicity.fit(docs, labels)).count() == 0

"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other,
clause end. Three transducers are composed into one: negation turns the insults in
its reach into denied ones, reported speech turns those of its clause into quoted
ones, and the target transducer tells, at the end of a clause, whether it speaks
of someone. What is scored are the matched clauses of each kind with the weights
of their insults, by a logistic model; a word by itself has no score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, quoted, read
from cairn.llm.op4_language import held_out
from cairn.llm.registry import query

__all__ = ["GRAMMAR", "Model", "Transducer", "compose", "fit", "score"]

#: Labelled rows that the lexicon and the weights are fitted on, at most about, by a hash of the id.
SAMPLE_ROWS = 20_000
#: Lengths of the stems learned beside whole words.
STEMS = (4, 5, 6)
#: A term enters the lexicon with this likelihood ratio (G squared) and this share of toxic documents among those that hold it.
LEAST_RATIO, LEAST_SHARE = 30.0, 0.8
#: Words after a negation that it reaches.
REACH = 3
REJECT = 0.7

# Fixed word lists: threats, words for persons, negations and verbs of speech in English, French, German and Spanish.
THREAT = frozenset("kill hurt shoot stab strangle burn tuer tuerai frapper töten umbringen schlagen matar mataré pegar".split())
TARGET = frozenset("you your yours u he she they them his her their tu toi vous ton ta votre il elle ils du dich dir dein deine ihr euch sie er tú usted ustedes vosotros él ella ellos".split())
NEGATION = frozenset("not never no nor without isn aren wasn don doesn ne pas jamais nicht nie kein keine sin nunca jamás".split())
SPEECH = frozenset("said says say called calls quoted wrote claimed dit disait appelé sagte sagt nannte schrieb dijo dice llamó escribió".split())

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,|\n]")
INSULT, DENIED, QUOTED, THREATENS, PERSON, NOT, SAYS, OTHER, END = "insult", "denied", "quoted", "threat", "target", "negation", "speech", "other", "end"
SYMBOLS = (INSULT, DENIED, QUOTED, THREATENS, PERSON, NOT, SAYS, OTHER, END)
#: What a clause can be: its own kind for each of these holds the weights it matched.
KINDS = ("plain", "targeted", "denied", "quoted", "threat")


@dataclass
class Transducer:
    """A deterministic one: (state, symbol) leads to (state, output); the first state is 0."""

    arcs: dict = field(default_factory=dict)
    states: int = 1


def negation() -> Transducer:
    """State n: the next n words are in a negation's reach."""
    t = Transducer(states=REACH + 1)
    for n in range(REACH + 1):
        for s in SYMBOLS:
            t.arcs[n, s] = (REACH, s) if s == NOT else (0, s) if s == END else (max(n - 1, 0), DENIED if s in (INSULT, THREATENS) and n else s)
    return t


def reported() -> Transducer:
    """State 1: the clause tells what someone said."""
    t = Transducer(states=2)
    for n in (0, 1):
        for s in SYMBOLS:
            t.arcs[n, s] = (0 if s == END else 1 if s == SAYS else n, QUOTED if s in (INSULT, THREATENS) and n else s)
    return t


def targeted() -> Transducer:
    """State 1: the clause speaks of someone; its end says so."""
    t = Transducer(states=2)
    for n in (0, 1):
        for s in SYMBOLS:
            t.arcs[n, s] = (0, KINDS[n]) if s == END else (1 if s == PERSON else n, s)
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Feeds what ``a`` puts out to ``b``; only states that can be reached are kept."""
    number = {(0, 0): 0}
    out, todo = Transducer(), [(0, 0)]
    while todo:
        p, q = todo.pop()
        for s in SYMBOLS:
            p2, mid = a.arcs[p, s]
            q2, last = b.arcs[q, mid]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            out.arcs[number[p, q], s] = number[p2, q2], last
    out.states = len(number)
    return out


GRAMMAR = compose(compose(negation(), reported()), targeted())


class Model:
    """The lexicon with its weights, and the logistic weights of the kinds of clauses."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.weights = np.zeros(len(KINDS) + 3)
        self.memory: dict[str, tuple[str, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def symbol(self, w: str) -> tuple[str, float]:
        got = self.memory.get(w)
        if got is None:
            weight = max(self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS))
            kind = INSULT if weight > 0 else THREATENS if w in THREAT else NOT if w in NEGATION else SAYS if w in SPEECH else PERSON if w in TARGET else OTHER
            got = (END if not w[0].isalpha() else kind), weight or 1.0
            if len(self.memory) > 200_000:
                self.memory.clear()
            if len(w) < 64:
                self.memory[w] = got
        return got

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of one plus the weights of the matched clauses of each kind,
        that of one plus the number of insults and threats that are neither denied nor
        quoted, whether there are several, and a one."""
        total = np.zeros(len(KINDS) + 3)
        total[-1] = 1.0
        words = TOKEN.findall(text.lower()) if text else []
        symbol = self.symbol
        if not any(symbol(w)[0] in (INSULT, THREATENS) for w in set(words)):
            return total
        state, arcs, open_, sums, n = 0, GRAMMAR.arcs, [0.0, 0.0, 0.0, 0.0], np.zeros(len(KINDS)), 0
        for w in [*words, "."]:
            s, weight = symbol(w)
            state, out = arcs[state, s]
            n += out is INSULT or out is THREATENS
            if s is END:
                plain, denied, quoted_, threat = open_
                if plain or denied or quoted_ or threat:
                    sums[KINDS.index(out)] += plain
                    sums[2:] += denied, quoted_, threat
                    open_ = [0.0, 0.0, 0.0, 0.0]
            elif out is INSULT:
                open_[0] += weight
            elif out is DENIED:
                open_[1] += weight
            elif out is QUOTED:
                open_[2] += weight
            elif out is THREATENS:
                open_[3] += weight
        total[:len(KINDS)] = np.log1p(sums)
        total[-3:-1] = np.log1p(n), n > 1
        return total

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.features(text) @ self.weights)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last column, the constant, is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from labelled training rows, those whose id's crc32
    modulo 3 is not 1: about ``sample_rows`` of them, by a hash of the id (all, if
    fewer). Labels other than 0 and 1 and rows without id are left out. Without any
    labelled row the score is one half; with one class only, near it.
    """
    known = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1 << 20, sample_rows * (1 << 20) // max(n, 1)))
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text"))
    rows = cut(rows.join(F.broadcast(known), "id").select("y", "text"))  # the sample's bound is sample_rows
    schema = T.StructType([T.StructField(c, t) for c, t in (("term", T.StringType()), ("stem", T.BooleanType()), ("toxic", T.LongType()), ("clean", T.LongType()))])

    def terms(batches):
        for b in batches:
            total: dict[tuple[str, bool], list[int]] = {}
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w for w in TOKEN.findall((x or "").lower()) if w[0].isalpha()}
                for t in [*((w, False) for w in words), *((w, True) for w in {w[:k] for w in words for k in STEMS if len(w) > k})]:
                    total.setdefault(t, [0, 0])[1 - y] += 1
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([total[k][0] for k in keys], pa.int64()),
                                              pa.array([total[k][1] for k in keys], pa.int64())], names=schema.names)

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    model = Model({}, {})
    if not t + c:
        return model
    p = t / (t + c)
    a, b = F.col("toxic"), F.col("clean")
    share = a / (a + b)
    ratio = 2 * (a * F.log(share / F.lit(p or 1.0)) + F.when(b > 0, b * F.log((1 - share) / F.lit((1 - p) or 1.0))).otherwise(0.0))
    odds = F.log((a + 0.5) / F.lit(t + 1.0)) - F.log((b + 0.5) / F.lit(c + 1.0))
    found = (rows.mapInArrow(terms, schema).groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .filter((a > 0) & (share >= LEAST_SHARE) & (ratio >= LEAST_RATIO) & (odds > 0)).select("term", "stem", odds.alias("w")).collect())
    model.words = {r["term"]: r["w"] for r in found if not r["stem"]}
    model.stems = {r["term"]: r["w"] for r in found if r["stem"]}
    held = docs.sparkSession.sparkContext.broadcast(model)
    shape = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def features(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.features(x).tolist() for x in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=shape.names)

    got = rows.mapInArrow(features, shape).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    x, y = np.array([r["x"] for r in got for _ in range(r["n"])]), np.array([r["y"] for r in got for _ in range(r["n"])], float)
    model.weights = logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if it is 0.7 or more).
    Null and empty texts have the score of a text without matched clauses. Columns
    of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def fn(b: pa.RecordBatch) -> list:
        s = [held.value.score(x) for x in b.column(0).to_pylist()]
        return [s, [int(v >= REJECT) for v in s]]

    return append_columns(docs, [text], made, fn)


@query("op9_toxicity_grammar")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

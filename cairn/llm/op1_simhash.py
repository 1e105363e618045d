"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are dealt to three blocks of a perfect binary Golay
code (23 bits, covering radius 3, 4096 code words; missing bits are zero). The
anchors are the triples of code words, 2**36 of them. Every fingerprint has one
home anchor, within the covering radius of it in each block. Two fingerprints at
``t`` or fewer bits from each other then meet at an anchor if one visits each
anchor within covering radius plus ``t``, the threshold shared out between the
blocks (at most ``t`` over the radii in all): the other's home is among them.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, quoted, read
from cairn.llm.graph import SALTS, components
from cairn.llm.registry import query

__all__ = ["anchors", "drop_near_copies", "fingerprint", "linked", "shingle_hashes", "simhash"]

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Bits of a fingerprint in each block, from the lowest.
BLOCKS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
SEED = 42
#: Documents of a component that are compared with each other in one task, by round.
BLOCK_DOCS = 512
MASK = (1 << 64) - 1
#: Fingerprints of a text that propose near copies.
SEEDS = 3
#: Step between the mixtures, and the shifts and factors of each (those of the SplitMix64 generator).
STEP, MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def shingle_hashes(text: bytes | None, k: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``k`` words, A-Z in lower case, joined by a
    space, repeats included; of fewer words the whole run; of none nothing."""
    words = text.lower().split() if text else []
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-k] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is one if it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i:i + CHUNK], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def word_fingerprints(text: bytes | None, n: int) -> list[int]:
    """``n`` fingerprints of the different words of a text, which come of
    different hashes: the first of XXH64, the others of mixtures of it."""
    h = np.array(list(set(shingle_hashes(text, 1))), np.uint64)
    out = []
    for k in range(n):
        x = h + np.uint64(k * STEP & MASK)
        for shift, odd in (MIX if k else ()):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        out.append(fingerprint(x))
    return out


def simhash(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp", distinct: bool = False) -> DataFrame:
    """``docs`` with the fingerprint as a signed long, of all shingles or of the
    different ones; null and empty texts have zero."""
    made = T.StructType([T.StructField(name, T.LongType())])

    def fn(b: pa.RecordBatch) -> list:
        hashes = (lambda x: list(set(shingle_hashes(x, shingle)))) if distinct else (lambda x: shingle_hashes(x, shingle))
        fps = np.array([fingerprint(hashes(x)) for x in b.column(0).cast(pa.binary()).to_pylist()], np.uint64)
        return [pa.array(fps.view(np.int64))]

    return append_columns(docs, [text], made, fn)


@lru_cache(1)
def cosets() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of the 23 single bits; for each weight over the covering radius
    (0: up to the radius itself), the error patterns by syndrome, padded with -1."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    single = np.array([syndrome(1 << i) for i in range(23)], np.int64)
    out = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        found: list[list[int]] = [[] for _ in range(2048)]
        for w in weights:
            for bits in combinations(range(23), w):
                s = 0
                for i in bits:
                    s ^= int(single[i])
                found[s].append(sum(1 << i for i in bits))
        table = np.full((2048, max(map(len, found))), -1, np.int64)
        for s, x in enumerate(found):
            table[s, :len(x)] = x
        out.append(table)
    return single, out


def near_words(fps: np.ndarray, extra: int, blocks=range(len(BLOCKS))) -> list[list[np.ndarray]]:
    """For each of ``blocks`` the code words near that block of each fingerprint, by
    distance: within the covering radius, then at one and two bits more, as far as
    ``extra`` goes; padded with -1."""
    single, tables = cosets()
    x = fps.view(np.uint64)
    near: list[list[np.ndarray]] = []
    for k in blocks:
        low, n = sum(BLOCKS[:k]), BLOCKS[k]
        v = ((x >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64)
        s = np.zeros(len(v), np.int64)
        for i in range(n):
            s ^= np.where(v >> i & 1, single[i], 0)
        words = []
        for table in tables[:extra + 1]:
            e = table[s]
            words.append(np.where(e >= 0, (v[:, None] ^ e) >> 11, -1))
        near.append(words)
    return near


def anchors(fps: np.ndarray, extra: int, word: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor) for every anchor within the covering radii plus
    ``extra`` (0, 1 or 2) bits in all, or those of them with this ``word`` in the
    first block; with 0, the one home of each."""
    near = near_words(fps, extra)
    if word is not None:
        near[0] = [np.where((w == word).any(1), word, -1)[:, None] for w in near[0]]
    rows, found = [], []
    for a, b, c in product(range(extra + 1), repeat=3):
        if a + b + c <= extra:
            p, q, r = near[0][a][:, :, None, None], near[1][b][:, None, :, None], near[2][c][:, None, None, :]
            good = (p >= 0) & (q >= 0) & (r >= 0)
            found.append(((p << 24) | (q << 12) | r)[good])
            rows.append(np.broadcast_to(np.arange(len(fps))[:, None, None, None], good.shape)[good])
    return np.concatenate(rows), np.concatenate(found)


def at_anchors(fps: DataFrame, extra: int) -> DataFrame:
    """(anchor, fp) rows of a one-column table of fingerprints."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            if len(x):
                rows, found = anchors(x, extra)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(x[rows])], names=["anchor", "fp"])

    return fps.mapInArrow(run, schema)


def at_words(fps: DataFrame, extra: int) -> DataFrame:
    """(word, fp) rows: the words that the anchors of each fingerprint have in the first block."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            if len(x):
                words = np.concatenate(near_words(x, extra, [0])[0], axis=1)
                rows, at = np.nonzero(words >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(words[rows, at]), pa.array(x[rows])], names=["word", "fp"])

    return fps.mapInArrow(run, schema)


def linked(fps: DataFrame, bits: int = 2, home_extra: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``bits`` or fewer
    differing bits; ``fps`` has one column of distinct ones.

    One side goes to the anchors within the covering radius plus ``home_extra``,
    the other to those within it plus the rest of ``bits``; each part is 0 to 2.
    """
    rest = bits - home_extra
    if not (0 <= home_extra <= 2 and 0 <= rest <= 2):
        raise ValueError("bits must be home_extra plus 0, 1 or 2")
    home = visit = at_anchors(fps, home_extra)
    if rest != home_extra:
        visit = at_anchors(fps, rest)
    home, visit = home.select("anchor", F.col("fp").alias("a")), visit.select("anchor", F.col("fp").alias("b"))
    # merged, since Spark sizes both sides by the fingerprints they are made of, and would broadcast the visits
    near = home.join(visit.hint("merge"), "anchor").filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    return near if home_extra == 0 else near.distinct()


def local_roots(values: np.ndarray, bits: int) -> list[int]:
    """For each fingerprint the first place of its component, over all links of
    ``bits`` or fewer differing bits between them."""
    if len(values) == 2:
        return [0, 0 if (int(values[0] ^ values[1]) & MASK).bit_count() <= bits else 1]
    x, root = values.view(np.uint64), np.arange(len(values))
    left = np.arange(len(x))  # not reached so far
    while len(left):
        first, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(x[left] ^ x[todo.pop()]) <= bits
            if near.any():
                root[left[near]] = first
                todo += left[near].tolist()
                left = left[~near]
    return root.tolist()


def group_links(fps: DataFrame, bits: int, extra: int) -> DataFrame:
    """Distinct (s, t), t < s, with the components of all links of at most ``bits``
    bits, which are not listed; ``fps`` has (fp, node).

    At each anchor the components are found among all fingerprints there. Any two
    close fingerprints meet at some anchor, so no link is lost. A fingerprint is sent
    once for each word that its anchors have in the first block (about 22, where there
    are 119 anchors), and the anchors with that word are made where it arrives. There
    each member is joined to the smallest one of its component over all of these
    anchors. Of those of one ``s`` the smallest ``t`` stays, and the other ones are
    joined to that instead, which many members have in common. A task holds the
    fingerprints of one word of 4,096. Nodes are looked up at the end."""
    out = T.StructType([T.StructField("s", T.LongType()), T.StructField("t", T.LongType())])

    def link(batches):
        def pairs(word, fp):
            found = []
            edges = np.flatnonzero(np.diff(word)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(word)]):
                x = fp[lo:hi]
                rows, anchor = anchors(x, extra, int(word[lo]))
                order = np.lexsort((rows, anchor))
                rows, anchor = rows[order], anchor[order]
                ends = np.append(np.flatnonzero(np.diff(anchor)) + 1, len(anchor))
                starts = np.concatenate([[0], ends[:-1]])
                groups = {rows[a:e].tobytes() for a, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist())}
                root = list(range(len(x)))

                def first(i):
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                for members in (np.frombuffer(g, rows.dtype) for g in groups):
                    ids = members.tolist()
                    for i, r in enumerate(local_roots(x[members], bits)):
                        p, q = first(ids[i]), first(ids[r])
                        root[max(p, q)] = min(p, q)
                found += [(x[i], x[r]) for i in range(len(x)) if (r := first(i)) != i]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=out.names)

        held: list[list[np.ndarray]] = []  # batches of the last word so far
        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            if not len(now[0]):
                continue
            if not held or now[0][-1] == held[0][0][-1]:
                held.append(now)
                if len(held) > 1 or now[0][0] == now[0][-1]:
                    continue
                held.pop()
            word, fp = (np.concatenate(c) for c in zip(*held, now))
            last = np.searchsorted(word, word[-1])
            yield pairs(word[:last], fp[:last])
            held = [[c[last:] for c in (word, fp)]]
        if held:
            yield pairs(*(np.concatenate(c) for c in zip(*held)))

    met = at_words(fps.select("fp"), extra).repartition("word").sortWithinPartitions("word", "fp")
    found = met.mapInArrow(link, out).groupBy("s").agg(F.collect_set("t").alias("ts"))
    found = found.select("s", F.array_min("ts").alias("t"), "ts")
    ways = F.concat(F.array(F.struct("s", "t")), F.transform(F.filter("ts", lambda x: x > F.col("t")), lambda x: F.struct(x.alias("s"), F.col("t").alias("t"))))
    pairs = found.select(F.explode(ways).alias("e")).select("e.s", "e.t").distinct()
    for end in ("s", "t"):
        pairs = pairs.join(fps.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")).hint("merge"), end)
    return pairs.select(F.greatest("s_node", "t_node").alias("s"), F.least("s_node", "t_node").alias("t"))


def simhash_components(rows: DataFrame, bits: int = 2, home_extra: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each fingerprint of ``rows`` (``doc_id``, fp), a table read more than once."""
    fps = cut(rows.groupBy("fp").agg(F.min(quoted(doc_id)).cast("long").alias("node")))
    near = cut(linked(fps.filter("node IS NOT NULL").select("fp"), bits, home_extra))
    edges = (near.join(fps.select(F.col("fp").alias("a"), F.col("node").alias("s")).hint("merge"), "a")
             .join(fps.select(F.col("fp").alias("b"), F.col("node").alias("t")).hint("merge"), "b").select("s", "t"))
    return fps.join(components(edges).hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def joint_components(rows: DataFrame, names: list[str], bits: int, doc_id: str) -> DataFrame:
    """(``names[0]``, component_id): components of rows (``doc_id`` and some fingerprints
    each) that are joined by a link of at most ``bits`` bits between any fingerprints of
    one name. A fingerprint's node is the smallest id with it; the nodes of one
    row are joined, once for each different row of fingerprints."""
    both, nodes, edges = cut(rows.groupBy(*names).agg(F.min(quoted(doc_id)).cast("long").alias("node"))), [], []
    for n in names:
        nodes.append(cut(both.groupBy(F.col(n).alias("fp")).agg(F.min("node").alias("node"))))
        edges.append(group_links(nodes[-1].filter("node IS NOT NULL"), bits, bits // 2))
    for n, of in zip(names, nodes):
        edges.append(both.join(of.select(F.col("fp").alias(n), F.col("node").alias("t")).hint("merge"), n).select(F.col("node").alias("s"), "t").filter("s <> t"))
    groups = components(cut(reduce(DataFrame.unionByName, edges).distinct()))
    first = nodes[0].join(groups.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return first.withColumnRenamed("fp", names[0])


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, home_extra: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at
    most ``bits`` differing bits, its own included) of each row.

    Null and empty texts have fingerprint zero and link like others. A row
    without doc_id has a fingerprint and the component of the rows with the same
    one; it links none itself, and has no component if there are no such rows.
    Rows that share a doc_id each have their own fingerprint, and those linked. An
    empty table gives an empty result; other columns are left out.
    """
    rows = cut(simhash(docs.select(quoted(doc_id), quoted(text).cast("string").alias("text")), "text", shingle).drop("text"))
    return rows.join(cut(simhash_components(rows, bits, home_extra, doc_id)), "fp").select(quoted(doc_id), "fp", "component_id")


def greedy(rows: DataFrame, keys: list[str], doc_id: str, text: str, shingle: int, similarity: float, order: str, given: str | None = None) -> DataFrame:
    """Those ``rows`` that are not alike to an earlier one which stayed, within
    ``keys`` and by rising ``order``; rows of one ``doc_id`` don't meet.

    With ``given``, rows that have it true are the ones that stay, and the others
    are compared only with them; the result has only the others."""
    names = rows.columns
    at = [names.index(c) for c in (doc_id, text)]
    where, flag = [names.index(k) for k in keys], names.index(given) if given else None

    def run(batches):
        group, held = None, []  # (id, sorted hashes) of those that stay
        for b in batches:
            ids, texts = b.column(at[0]).to_pylist(), b.column(at[1]).cast(pa.binary()).to_pylist()
            sent = b.column(flag).to_pylist() if given else None
            stay = []
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in where))):
                if key != group:
                    group, held = key, []
                x = np.array(sorted(set(shingle_hashes(texts[i], shingle))), np.uint64)
                if given and sent[i]:
                    held.append((ids[i], x))
                    continue
                if any(alike(x, y, similarity) for k, y in held if k != ids[i]):
                    continue
                stay.append(i)
                if not given:
                    held.append((ids[i], x))
            yield b.take(pa.array(stay, pa.int64()))

    return rows.repartition(*map(quoted, keys)).sortWithinPartitions(*map(quoted, keys), quoted(order)).mapInArrow(run, rows.schema)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, as sorted arrays, is ``similarity`` or more; of two empty ones it is one."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 4, doc_id: str = "doc_id", text: str = "text",
                     block: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` without near copies: in each component of documents (linked by
    at most ``bits`` differing bits in one of ``SEEDS`` fingerprints), by rising id, those documents go whose sets
    of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or
    more with one of smaller id that stays. So no two that stay in a component are
    alike.

    The fingerprints are those of the different words: an edit changes ``shingle``
    shingles but one word, so near copies differ in few of their bits, and the
    shingles decide. Each round takes the ``block`` smallest ids left of each
    component in one task, keeps those not alike among them, and drops what is
    alike to these from the rest, which is dealt over ``SALTS`` parts. So copies
    of one document take one round however many there are; the rounds are the
    documents of a component that are not alike over ``block``, and their work
    grows with the square of those. Two texts without words are alike. Rows
    that share a doc_id are one document; rows without doc_id may go, but make
    none go.
    """
    comp, salt, kept, order = "_cairn_component", "_cairn_salt", "_cairn_kept", "_cairn_order"
    names = [f"_cairn_fp{k}" for k in range(SEEDS)]
    made = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def prints(b: pa.RecordBatch) -> list:
        fps = np.array([word_fingerprints(x, SEEDS) for x in b.column(0).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, SEEDS)
        return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T]

    fp = names[0]
    marked = append_columns(docs, [text], made, prints)
    rows = cut(marked.select(quoted(doc_id), *names))
    groups = cut(joint_components(rows, names, bits, doc_id))
    size = rows.groupBy(fp).agg(F.count(F.lit(1)).alias("n"))
    wide = groups.join(size, fp).groupBy("component_id").agg(F.sum("n").alias("n")).filter("n > 1 AND component_id IS NOT NULL").select("component_id")
    groups = cut(groups.join(cut(wide), "component_id").select(fp, F.col("component_id").alias(comp)))
    full = cut(marked.join(groups, fp, "left").drop(*names))
    stay, left = [full.filter(F.col(comp).isNull())], full.filter(F.col(comp).isNotNull())
    ids = quoted(doc_id)
    while True:
        known = left.filter(ids.isNotNull()).select(comp, ids.alias("id"))
        first = known.withColumn("n", F.row_number().over(Window.partitionBy(comp).orderBy("id"))).filter(F.col("n") <= block)
        first = cut(first.groupBy(comp).agg(F.max("id").alias(order)))
        parts = left.join(first, comp, "left")
        part = F.coalesce(ids <= F.col(order), F.lit(False))
        own = cut(greedy(parts.filter(part).drop(order), [comp], doc_id, text, shingle, similarity, doc_id))
        stay.append(own)
        rest = parts.filter(~part).drop(order)
        more = cut(rest.select(comp).distinct())
        if more.isEmpty():
            break
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        sent = own.join(more, comp).withColumns({salt: salts, kept: F.lit(True), order: F.lit(0)})
        rest = rest.withColumns({salt: F.pmod(F.xxhash64(ids, quoted(text)), F.lit(SALTS)).cast("int"), kept: F.lit(False), order: F.lit(1)})
        left = cut(greedy(sent.unionByName(rest), [comp, salt], doc_id, text, shingle, similarity, order, kept).select(left.columns))
        if left.filter(ids.isNotNull()).isEmpty():
            stay.append(left)
            break
    return reduce(DataFrame.unionByName, [x.select(docs.columns) for x in stay])


@query("op1_simhash_near_duplicates")
def op1(spark, sf_dir):
    rows = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Quality rules whose limits follow the corpus: per language and source, from
mergeable quantile sketches; then a join brings each document its limits.

A sketch is a histogram of whole numbers with 32 cells for every doubling, so a
quantile read from it is at most 1/32 too high, and sketches merge by adding
counts, whatever the order: sources add up to their language and languages to
the corpus. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, quoted, read
from cairn.llm.registry import query

__all__ = ["MEASURES", "limits", "measure", "quality_filter", "sketch", "verdicts"]

#: Measures in thousandths, each with the least spread that its fence assumes.
MEASURES = {"word_length": 250, "symbol_rate": 30, "dup_line_rate": 100, "repeat_rate": 100}
#: A fence lies this many spreads (third quartile less first) outside the quartiles.
FENCE = 3
#: A group with fewer documents takes the limits of its language, a smaller language those of the corpus.
MIN_DOCS = 100
#: Base rules: fewest words, and largest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Parts over which the rows of each language and source are dealt for the join.
SALTS = 16

#: Hashes of the three-word windows of the words ``_cairn_w``, null beyond the end.
_WINDOWS = """CASE WHEN size(_cairn_w) >= 4 THEN
transform(sequence(0, size(_cairn_w) - 3), i -> xxhash64(_cairn_w[i], _cairn_w[i + 1], _cairn_w[i + 2])) ELSE CAST(array() AS ARRAY<BIGINT>) END"""
#: Words in windows that stand twice or more; a text whose hashes all differ has none. Otherwise hash and place are packed into
#: one number (as many low bits as the places need) and sorted; the windows that share the high bits with a neighbour, all repeated
#: ones among them, are sorted by hash and words, so that equal ones are neighbours, and the places they cover are counted.
#: ``transform(array(x), s -> ...)[0]`` names an intermediate result.
_REPEATS = """
CASE WHEN size(_cairn_h) = size(array_distinct(_cairn_h)) THEN 0L ELSE
aggregate(
  transform(array(transform(array(length(bin(size(_cairn_h)))), b ->
    transform(array(sort_array(transform(_cairn_h, (h, i) -> shiftleft(h, b) | CAST(i AS BIGINT)))), s ->
      sort_array(transform(
        filter(s, (x, k) -> (k > 0 AND shiftrightunsigned(s[k - 1], b) = shiftrightunsigned(x, b))
                         OR (k < size(s) - 1 AND shiftrightunsigned(s[k + 1], b) = shiftrightunsigned(x, b))),
        x -> transform(array(CAST(x & (shiftleft(1L, b) - 1) AS INT)), i ->
             struct(_cairn_h[i] AS h, _cairn_w[i] AS a, _cairn_w[i + 1] AS b, _cairn_w[i + 2] AS c, i AS i))[0])))[0])[0]),
    s -> sort_array(transform(filter(s, (x, k) ->
        (k > 0 AND s[k - 1].h = x.h AND s[k - 1].a = x.a AND s[k - 1].b = x.b AND s[k - 1].c = x.c)
        OR (k < size(s) - 1 AND s[k + 1].h = x.h AND s[k + 1].a = x.a AND s[k + 1].b = x.b AND s[k + 1].c = x.c)), x -> x.i)))[0],
  struct(0L AS n, 0 AS upto),
  (acc, i) -> struct(acc.n + i + 3 - greatest(i, acc.upto) AS n, i + 3 AS upto),
  acc -> acc.n) END"""


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed and the ``MEASURES``.

    Words are runs of other bytes than blanks (space, tab to carriage return);
    n_lines counts the lines with a word, n_dup_lines those equal to an earlier
    one. Null and empty texts have no words and fail the base rules; measures of
    a text without words are null. Columns of ``docs`` with such a name are
    replaced.
    """
    blanks = r" \t\n\x0B\f\r"
    got = docs.withColumn("_cairn_t", F.coalesce(quoted(text).cast("string"), F.lit("")))
    # a capture of the work once per row: every later expression reads these columns
    got = got.withColumn("_cairn_w", F.expr(f"filter(split(_cairn_t, '[{blanks}]+'), x -> x <> '')".replace("\\", "\\\\")))
    got = got.withColumn("_cairn_h", F.expr(_WINDOWS))
    got = got.withColumn("_cairn_l", F.expr(f"filter(split(_cairn_t, '\\n'), x -> x rlike '[^{blanks}]')".replace("\\", "\\\\")))
    got = got.withColumns({
        "n_words": F.size("_cairn_w").cast("long"),
        "word_chars": F.expr("CAST(aggregate(_cairn_w, 0L, (n, x) -> n + length(x)) AS BIGINT)"),
        "n_symbols": F.expr("CAST(regexp_count(_cairn_t, '[#*$%&|<>]') AS BIGINT)"),
        "n_lines": F.size("_cairn_l").cast("long"),
        "n_dup_lines": (F.size("_cairn_l") - F.size(F.array_distinct("_cairn_l"))).cast("long"),
        "n_repeat_words": F.expr(_REPEATS).cast("long")}).drop("_cairn_t", "_cairn_w", "_cairn_h", "_cairn_l")
    rate = lambda part, whole: F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} DIV {whole} END")
    return got.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")),
        "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words")})


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """(group columns, measure, cell, n) of all rows with words: how many values of
    each measure lie in each cell. ``cell`` is the largest value that it holds.
    The sketch of a coarser grouping is the sum of its parts' ``n``."""
    values = measured.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("m")).select(*by, "m.*")
    shift = F.expr("greatest(length(bin(v)) - 6, 0)")
    cells = values.filter("v IS NOT NULL").withColumn("e", shift).withColumn("cell", F.expr("shiftleft(shiftright(v, e) + 1, e) - 1"))
    return cells.groupBy(*by, "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """(group columns, docs, fences of each measure): one row a group. A window
    holds the cells of one group and measure, at most some 2,000."""
    of = Window.partitionBy(*by, "measure")
    seen = cells.withColumns({"upto": F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("n").over(of)})
    q = seen.groupBy(*by, "measure").agg(F.max("of").alias("docs"), F.min(F.when(F.expr("4 * upto >= of"), F.col("cell"))).alias("q1"),
                                         F.min(F.when(F.expr("4 * upto >= 3 * of"), F.col("cell"))).alias("q3"))
    aggs = [F.max("docs").alias("docs")]
    for m, least in MEASURES.items():
        reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        aggs += [F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"{m}_low"), F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"{m}_high")]
    return q.groupBy(*by).agg(*aggs)


def limits(cells: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, docs, limits_from, low and high of each measure) from the
    sketches by language and source. Groups of fewer than ``MIN_DOCS`` documents
    take the limits of the merged sketch of their language, or else of all.
    Null is a language and a source of its own."""
    bounds = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    own = _quartiles(cells, [lang, source])
    by_lang = _quartiles(cells.groupBy(lang, "measure", "cell").agg(F.sum("n").alias("n")), [lang])
    of_all = _quartiles(cells.groupBy("measure", "cell").agg(F.sum("n").alias("n")), [])
    by_lang = by_lang.select(F.col(lang).alias("_cairn_lang"), F.col("docs").alias("_cairn_docs"), *[F.col(b).alias(f"_cairn_{b}") for b in bounds])
    of_all = of_all.select(*[F.col(b).alias(f"_cairn_all_{b}") for b in bounds])  # one row
    rows = own.join(by_lang, F.col(lang).eqNullSafe(F.col("_cairn_lang")), "left").crossJoin(F.broadcast(of_all))
    pick = lambda b: F.when(F.col("docs") >= MIN_DOCS, F.col(b)).when(F.col("_cairn_docs") >= MIN_DOCS, F.col(f"_cairn_{b}")).otherwise(F.col(f"_cairn_all_{b}"))
    level = F.when(F.col("docs") >= MIN_DOCS, "source").when(F.col("_cairn_docs") >= MIN_DOCS, "language").otherwise("corpus")
    return rows.select(lang, source, "docs", level.alias("limits_from"), *[pick(b).alias(b) for b in bounds])


def verdicts(measured: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``failed`` (the measures beyond their limits) and ``kept``.

    The rows of each language and source are dealt over ``SALTS`` parts of the
    join, so that a hot source is no task of its own."""
    spread = bounds.select(F.col(lang).alias("_cairn_lang"), F.col(source).alias("_cairn_source"), *[f"{m}_{e}" for m in MEASURES for e in ("low", "high")],
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_cairn_part"))
    rows = measured.withColumn("_cairn_salt", F.pmod(F.xxhash64(*MEASURES, "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    met = rows.join(spread, quoted(lang).eqNullSafe(F.col("_cairn_lang")) & quoted(source).eqNullSafe(F.col("_cairn_source")) & (F.col("_cairn_salt") == F.col("_cairn_part")), "left")
    out = [F.when(~F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]
    met = met.withColumn("failed", F.array_compact(F.array(*out)))
    return met.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*measured.columns, "failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with measures, ``failed``, ``base_failed`` and ``kept``.

    Limits come from all rows with words; a measure fails outside of
    [q1 - 3 s, q3 + 3 s] of its group, s being the spread of the quartiles and at
    least the one in ``MEASURES``. Rows that fail the base rules are not kept.
    Repeated rows count each time; an empty table stays empty.
    """
    measured = cut(measure(docs, text))
    return verdicts(measured, limits(sketch(measured, [lang, source]), lang, source), lang, source)


def _sql() -> str:
    """The same in DuckDB."""
    word = r"[^\x20\x09-\x0D]"
    w3 = "w[i] AS a, w[i + 1] AS b, w[i + 2] AS c"
    cells, fences = [], []
    for m, least in MEASURES.items():
        cells.append(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE {m} IS NOT NULL")
        for end, sign, q in (("low", "-", "q1"), ("high", "+", "q3")):
            fences.append(f"max(CASE WHEN measure = '{m}' THEN {q} {sign} {FENCE} * greatest(q3 - q1, {least}) END) AS {m}_{end}")

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""
{name}_c AS (SELECT {keys}measure, cell, count(*) AS n FROM cells GROUP BY {keys}measure, cell),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM {name}_c),
{name}_q AS (SELECT {keys}measure, max(total) AS docs, min(CASE WHEN 4 * upto >= total THEN cell END) AS q1,
             min(CASE WHEN 4 * upto >= 3 * total THEN cell END) AS q3 FROM {name}_u GROUP BY {keys}measure),
{name} AS (SELECT {keys}max(docs) AS docs, {', '.join(fences)} FROM {name}_q {'GROUP BY ' + by if by else ''})"""

    bound = lambda b: f"CASE WHEN o.docs >= {MIN_DOCS} THEN o.{b} WHEN g.docs >= {MIN_DOCS} THEN g.{b} ELSE a.{b} END"
    good = " AND ".join(f"(m.{m} BETWEEN {bound(m + '_low')} AND {bound(m + '_high')})" for m in MEASURES)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{word}+') AS w,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '{word}')] AS l FROM t),
p AS (SELECT doc_id, {w3}, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM p) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
m AS MATERIALIZED (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
      CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS symbol_rate,
      CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_line_rate, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat_rate FROM b),
v AS ({' UNION ALL '.join(cells)}),
cells AS MATERIALIZED (SELECT lang, source, measure, (((v >> e) + 1) << e) - 1 AS cell FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM v)),
{level('o', 'lang, source')},{level('g', 'lang')},{level('a', '')}
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {good}) AS kept
FROM m LEFT JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang, a
"""


@query("op13_quality_limits", _sql())
def op13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = cut(measure(docs).drop("text"))  # the limits need no texts
    return verdicts(measured, limits(sketch(measured, ["lang", "source"]))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

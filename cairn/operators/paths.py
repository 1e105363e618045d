"""Path patterns over event sequences, and multi-touch attribution."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band_le, flag, pct, rnd, tally
from cairn.operators.events import seconds, shares
from cairn.plans.automaton import end_scan, state_scan
from cairn.plans.lineage import written
from cairn.plans.ordered import null_safe_join, running, sequence

MODELS = ("FIRST_TOUCH", "LAST_TOUCH", "LINEAR", "U_SHAPED", "TIME_DECAY")


def pattern_elements(pattern: str):
    """[(symbols, quantifier)] of a pattern such as ``A.B*.(C|D)+``; the dot
    means "then". Symbols are single letters or digits."""
    out = []
    for part in pattern.replace(" ", "").split("."):
        m = re.fullmatch(r"\(?([A-Za-z0-9](?:\|[A-Za-z0-9])*)\)?([*+?]?)", part)
        if not m:
            raise ValueError(f"unsupported pattern element {part!r}")
        out.append((m.group(1).split("|"), m.group(2)))
    return out


def successors(elements, q: int, symbol: str) -> list[int]:
    """The elements that may take ``symbol`` after one has been taken by element
    ``q`` (from 1; 0 before the first), the earliest first."""
    out = [q] if q and elements[q - 1][1] in ("*", "+") and symbol in elements[q - 1][0] else []
    for k in range(q, len(elements)):
        if symbol in elements[k][0]:
            out.append(k + 1)
        if elements[k][1] not in ("*", "?"):
            break
    return out


def completions(elements, symbols):
    """The automaton that reads a sequence from its end: its state is the set of
    the elements after which the rest of a match can follow from here on, the
    empty rest included. Returns (sets, table by symbol)."""
    m = len(elements)
    done = frozenset(q for q in range(m + 1) if all(r in ("*", "?") for _, r in elements[q:]))
    sets, table = [done], {s: [] for s in symbols}
    for have in sets:
        for s in symbols:
            got = done | {q for q in range(m + 1) if have & set(successors(elements, q, s))}
            if got not in sets:
                sets.append(got)
            table[s].append(sets.index(got))
    return sets, np.array([table[s] for s in symbols])


def takers(elements, symbols, sets):
    """For each (symbol, set after it), as one letter, and each element ``q`` the
    element that takes the symbol, or 0: the earliest from which a match can be
    completed. That is the choice of a greedy search. It gives the longest match
    as well: a thread that took by an earlier element can take all that another
    one can, once both have taken what must be there."""
    return np.array([[next((k for k in successors(elements, q, s) if k in have), 0) for q in range(len(elements) + 1)]
                     for s in symbols for have in sets])


def npath(df: DataFrame, entity: str, ts: str, symbols, pattern: str, mode="NONOVERLAPPING",
          results=None, tiebreak="event_id") -> DataFrame:
    """Matches of a pattern in each entity's ordered events.

    ``symbols`` is [(letter, condition)]; an event takes the first symbol
    whose condition holds, an event without symbol breaks adjacency.
    ``results`` maps an output name to (kind, column, symbol or None), kind
    one of first, last, count, sum, min, max, path.

    NONOVERLAPPING takes the first match, the longest from its start, and goes on
    behind it; OVERLAPPING gives the longest match from each event. A match has at
    least one event.

    Two automata read the ordered events: one from the end notes after which
    elements a match can be completed, one from the start then follows the search
    without ever going back. Both run by block, and blocks are chained by their
    functions, so neither an entity nor a match of any length is held in a group.
    Results of non-overlapping matches are plain aggregates of the rows of each.
    Of overlapping ones, which may share any number of rows, count, sum, first and
    last come from running sums and the rows at both ends; only min, max and path
    list the rows of each match. A path is one cell; the others hold none."""
    if mode not in ("NONOVERLAPPING", "OVERLAPPING"):
        raise ValueError(mode)
    elements = pattern_elements(pattern)
    results = results or {"path_start": ("first", ts, None), "path_end": ("last", ts, None),
                          "event_count_in_path": ("count", None, None), "path": ("path", None, None)}
    letters = [s for s, _ in symbols] + ["-"]
    sym = F.lit(len(symbols))
    for i, (_, cond) in reversed(list(enumerate(symbols))):
        sym = F.when(cond, i).otherwise(sym)
    used = sorted({c for _, c, _ in results.values() if c})
    rows = sequence(df.select(entity, ts, tiebreak, *[F.col(c).alias(f"__v_{c}") for c in used], sym.alias("__s")), [entity], [ts, tiebreak])
    rows = rows.select(entity, "seq", "__s", *[f"__v_{c}" for c in used])
    sets, back = completions(elements, letters)
    rows = state_scan(rows, [entity], F.col("__s"), back, 0, "__rest", reverse=True, before=True)
    took, letter = takers(elements, letters, sets), F.col("__s") * len(sets) + F.col("__rest")
    if mode == "OVERLAPPING":
        return _overlapping(rows, entity, letters, took, letter, results)
    # states: 0 in no match, 2q - 1 a match begun at this row by element q, 2q gone on by it
    m = len(elements)
    table = np.zeros((len(took), 2 * m + 1), int)
    for state in range(2 * m + 1):
        on, begun = took[:, (state + 1) // 2], took[:, 0]
        table[:, state] = np.where((on > 0) & (state > 0), 2 * on, np.where(begun > 0, 2 * begun - 1, 0))
    # with a filter that a null passes, the left join of the scan stays one
    rows = state_scan(rows, [entity], letter, table, 0, "__state").filter("coalesce(__state > 0, true)")
    rows = running(rows, [entity], lasts={"__start": F.when(F.col("__state") % 2 == 1, F.col("seq"))})
    return _gathered(rows, entity, letters, results)


def _gathered(rows, entity, letters, results):
    """Results by (entity, __start) over rows that each belong to one match."""
    text = F.element_at(F.array(*map(F.lit, letters)), F.col("__s") + 1)

    def result(kind, column, symbol):
        here = F.lit(True) if symbol is None else F.coalesce(F.col("__s") == _code(letters, symbol), F.lit(False))
        v, place = F.col(f"__v_{column}"), F.when(here, F.col("seq"))
        if kind == "path":
            listed = F.array_sort(F.collect_list(F.when(here, F.struct("seq", text.alias("s")))))
            return F.array_join(F.transform(listed, lambda e: e["s"]), "")
        return {"first": lambda: F.min_by(v, place), "last": lambda: F.max_by(v, place), "min": lambda: F.min(F.when(here, v)),
                "max": lambda: F.max(F.when(here, v)), "count": lambda: F.count(place),
                "sum": lambda: F.coalesce(F.sum(F.when(here, v.cast("double"))), F.lit(0.0))}[kind]()

    return rows.groupBy(entity, "__start").agg(*[result(*r).alias(n) for n, r in results.items()]).select(entity, *results)


def _overlapping(rows, entity, letters, took, letter, results):
    rows = end_scan(rows, [entity], letter, np.where(took > 0, took, -1), "__end")
    if any(kind in ("min", "max", "path") for kind, _, _ in results.values()):
        spans = rows.filter("__end >= seq").select(entity, F.col("seq").alias("__start"), F.explode(F.sequence("seq", "__end")).alias("seq"))
        return _gathered(null_safe_join(spans, rows.drop("__end").hint("merge"), [entity, "seq"]), entity, letters, results)
    here = lambda symbol: F.lit(True) if symbol is None else F.coalesce(F.col("__s") == _code(letters, symbol), F.lit(False))
    sums, lasts = {}, {}
    for n, (kind, column, symbol) in results.items():
        if kind == "sum":
            sums[f"__upto_{n}"] = F.when(here(symbol), F.coalesce(F.col(f"__v_{column}").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
        elif kind == "last":
            lasts[f"__upto_{n}"] = F.when(here(symbol), F.struct("seq", F.col(f"__v_{column}").alias("v")))
        else:
            sums[f"__upto_{n}"] = here(symbol).cast("bigint")
    rows = written(running(rows, [entity], sums, lasts))
    tail = rows.select(entity, F.col("seq").alias("__end"), *[F.col(f"__upto_{n}").alias(f"__at_{n}") for n in results])
    found = null_safe_join(rows.filter("__end >= seq"), tail.hint("merge"), [entity, "__end"])
    for n, (kind, column, symbol) in results.items():
        if kind == "first" and symbol is not None:
            # the symbol's next event is the one with the next number
            number = F.col(f"__upto_{n}") + F.when(here(symbol), 0).otherwise(1)
            nth = rows.filter(here(symbol)).select(entity, F.col(f"__upto_{n}").alias("__nth"), F.struct("seq", F.col(f"__v_{column}").alias("v")).alias(f"__first_{n}"))
            found = null_safe_join(found.withColumn("__nth", number), nth.hint("merge"), [entity, "__nth"], "left").drop("__nth")

    def result(n, kind, column, symbol):
        v, at, upto = F.col(f"__v_{column}"), F.col(f"__at_{n}"), F.col(f"__upto_{n}")
        if kind == "first":
            return v if symbol is None else F.when(F.col(f"__first_{n}.seq") <= F.col("__end"), F.col(f"__first_{n}.v"))
        if kind == "last":
            return F.when(at["seq"] >= F.col("seq"), at["v"])
        return at - upto + (sums[f"__upto_{n}"])

    return found.select(entity, *[result(n, *r).alias(n) for n, r in results.items()])


def _code(letters, symbol):
    return letters.index(symbol) if symbol in letters else -1


PATH_BANDS = [(300, "0-5 min"), (1800, "5-30 min"), (3600, "30-60 min")]  # fixed values


def path_coverage(paths: DataFrame, events: DataFrame, entity: str) -> DataFrame:
    n, short = F.count(F.lit(1)), tally(F.col("event_count_in_path") < 3)
    a = paths.agg(n.alias("total_paths_found"), F.countDistinct(entity).alias("entities_with_pattern"),
                  rnd(F.avg("event_count_in_path"), 4).alias("avg_events_per_path"),
                  rnd(F.avg("total_value"), 4).alias("avg_path_value"),
                  (n - short).alias("meaningful_paths"), short.alias("short_paths"),
                  rnd(pct(n - short, n), 4).alias("quality_score_pct"))
    b = events.agg(F.countDistinct(entity).alias("total_entities"))
    return a.crossJoin(b).withColumn("coverage_pct", rnd(pct("entities_with_pattern", "total_entities"), 4))


def path_durations(paths: DataFrame) -> DataFrame:
    s = seconds(F.col("path_end"), F.col("path_start"))
    return shares(paths, band_le(s, PATH_BANDS, "> 1 hour"), "duration_range",
                  {"avg_value": rnd(F.avg("total_value"), 4)}, "path_count")


def paths_by_hour(paths: DataFrame) -> DataFrame:
    return paths.groupBy(F.hour("path_start").alias("hour")).agg(F.count(F.lit(1)).alias("paths_started"))


def repeat_paths(paths: DataFrame, entity: str) -> DataFrame:
    return paths.groupBy(entity).agg(F.count(F.lit(1)).alias("pattern_match_count"),
                                     rnd(F.sum("total_value"), 3).alias("total_value")) \
                .filter("pattern_match_count > 1")


def attribution(df: DataFrame, customer="user_id", ts="ts", channel="channel", conv_flag="conversion_flag",
                conv_value="conversion_value", models=MODELS, window_days=30.0, half_life_days=7.0,
                tiebreak="event_id") -> DataFrame:
    """Credit of every touch for the customer's next conversion.

    Rules (ours): the converting row is itself the last touch; a touch counts
    if it lies within ``window_days`` before the conversion; each conversion's
    value is shared out in full. One credit column per model: U_SHAPED gives
    40/20/40 (50/50 for two touches), TIME_DECAY halves every
    ``half_life_days``."""
    rows = sequence(df, [customer], [ts, tiebreak])
    rows = running(rows, [customer], sums={"journey": F.col(conv_flag)}, inclusive=False)
    rows = rows.withColumn("journey", F.col("journey").cast("bigint"))
    key = [customer, "journey"]
    hit = F.col(conv_flag) == 1
    goals = rows.filter(hit).select(*key, F.col(ts).alias("__cts"), F.col(conv_value).alias("value_at_stake"),
                                    F.col("seq").alias("__cseq"))
    rows = null_safe_join(rows, goals, key)
    age = seconds(F.col("__cts"), F.col(ts)) / 86400.0
    rows = rows.withColumn("age_days", age).filter(F.col("age_days") <= window_days) \
               .withColumn("__w", F.pow(F.lit(2.0), -F.col("age_days") / half_life_days))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("touches"), F.sum("__w").alias("__ws"))
    rows = null_safe_join(rows, sizes, key)
    n = F.col("touches")
    rows = rows.withColumn("position", F.col("seq") - F.col("__cseq") + n)
    p = F.col("position")
    share = {
        "FIRST_TOUCH": flag(p == 1).cast("double"), "LAST_TOUCH": flag(p == n).cast("double"), "LINEAR": 1.0 / n,
        "U_SHAPED": F.when(n == 1, 1.0).when(n == 2, 0.5).when((p == 1) | (p == n), 0.4).otherwise(0.2 / (n - 2)),
        "TIME_DECAY": F.col("__w") / F.col("__ws")}
    return rows.select(customer, ts, channel, conv_flag, conv_value, "seq", "journey", "position", "touches", "age_days",
                       "value_at_stake", *[(F.col("value_at_stake") * share[m]).alias(m) for m in models])


def attribution_long(credits: DataFrame, models=MODELS) -> DataFrame:
    ids = [c for c in credits.columns if c not in models]
    return credits.unpivot(ids, list(models), "model", "attribution_credit")


def channel_credit(long: DataFrame, channel="channel", customer="user_id") -> DataFrame:
    c = F.col("attribution_credit")
    out = long.groupBy("model", channel).agg(
        F.count(F.lit(1)).alias("touchpoint_count"), F.sum(c).alias("total"), F.avg(c).alias("mean"),
        F.countDistinct(customer).alias("unique_customers"))
    return out.select("model", channel, "touchpoint_count", "unique_customers", rnd("total", 3).alias("total_credit"),
                      rnd("mean", 4).alias("avg_credit_per_touchpoint"),
                      rnd(pct("total", F.sum("total").over(Window.partitionBy("model"))), 4).alias("credit_share_pct"))


def position_credit(long: DataFrame) -> DataFrame:
    kind = F.when(F.col("position") == 1, "First Touch").when(F.col("position") == F.col("touches"), "Last Touch") \
            .otherwise("Mid-Journey")
    return long.groupBy("model", kind.alias("position_type")).agg(
        rnd(F.sum("attribution_credit"), 3).alias("total_credit"), F.count(F.lit(1)).alias("touchpoint_count"))


def path_length(credits: DataFrame) -> DataFrame:
    last = credits.filter(F.col("position") == F.col("touches"))
    return last.groupBy(F.col("touches").alias("path_length")).agg(
        F.count(F.lit(1)).alias("conversions"), rnd(F.sum("value_at_stake"), 3).alias("total_conversion_value"),
        rnd(F.avg("value_at_stake"), 4).alias("avg_conversion_value"))


JOURNEY_BANDS = [(1, "0-1 day"), (7, "1-7 days"), (30, "7-30 days")]  # fixed values


def journey_duration(credits: DataFrame) -> DataFrame:
    first = credits.filter(F.col("position") == 1)
    return shares(first, band_le("age_days", JOURNEY_BANDS, "> 30 days"), "journey_duration",
                  {"avg_value": rnd(F.avg("value_at_stake"), 4), "avg_touches": rnd(F.avg("touches"), 4)}, "journeys")


def attribution_coverage(credits: DataFrame, events: DataFrame, channel="channel") -> DataFrame:
    a = credits.agg(F.countDistinct(channel).alias("channels_receiving_credit"),
                    rnd(F.sum("LINEAR"), 3).alias("total_credits_assigned"),
                    F.count(F.lit(1)).alias("touchpoints_with_credit"))
    b = events.agg(F.countDistinct(channel).alias("total_channels"), F.count(F.lit(1)).alias("total_touchpoints"),
                   rnd(F.sum(F.when(F.col("conversion_flag") == 1, F.col("conversion_value"))), 3).alias("total_conversion_value"))
    return a.crossJoin(b).withColumn("credit_coverage_pct", rnd(pct("touchpoints_with_credit", "total_touchpoints"), 4))

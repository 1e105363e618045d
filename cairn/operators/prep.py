"""Feature preparation as fit and transform pairs. A fit is a small table,
one row per column (or category); transforms read it once and apply plain
column expressions, so any number of transforms is one pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.functions.expr import band_ge, exact_share, flag, pct, rnd, tally
from cairn.operators import profiling as pr
from cairn.operators.relational import mode
from cairn.plans.ordered import null_safe_join, sequence, share, with_stats
from cairn.plans.quantiles import quantiles


def scale_fit(df: DataFrame, cols, method="zscore") -> DataFrame:
    """(column_name, location, scale). zscore: mean and sample deviation;
    minmax: minimum and range; maxabs: zero and largest magnitude; range:
    midrange and half range (to -1..1)."""
    pairs = {
        "zscore": (F.avg, F.stddev), "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        "maxabs": (lambda c: F.max(F.lit(0.0)), lambda c: F.max(F.abs(c))),
        "range": (lambda c: (F.max(c) + F.min(c)) / 2.0, lambda c: (F.max(c) - F.min(c)) / 2.0)}[method]
    d = lambda fn: lambda c: fn(F.col(c).cast("double"))
    return pr.summarise(df, cols, {"location": d(pairs[0]), "scale": d(pairs[1])})


def _lookup(fit: DataFrame, cols, key="column_name"):
    """The fit table as literals: one row per column, bounded by the schema."""
    rows = {r[key]: r for r in fit.collect()}
    return {c: rows[c] for c in cols}


def scale_transform(df: DataFrame, fit: DataFrame, cols, keep=None) -> DataFrame:
    """Adds ``<col>_scaled``; a zero scale gives null."""
    f = _lookup(fit, cols)
    out = {f"{c}_scaled": (F.col(c) - F.lit(f[c]["location"])) / F.nullif(F.lit(f[c]["scale"]), F.lit(0.0)) for c in cols}
    rows = df.withColumns(out)
    return rows if keep is None else rows.select(*keep, *out)


def scaled_report(df: DataFrame, scaled: DataFrame, cols) -> DataFrame:
    """Before and after per column: mean, deviation, range, row integrity."""
    stats = lambda tag: {f"{tag}_n": F.count, f"{tag}_mean": F.avg, f"{tag}_std": F.stddev, f"{tag}_min": lambda c: F.min(F.col(c).cast("double")), f"{tag}_max": lambda c: F.max(F.col(c).cast("double"))}
    a = pr.summarise(df, cols, stats("raw"))
    b = pr.summarise(scaled.select(*[F.col(f"{c}_scaled").alias(c) for c in cols]), cols, {**stats("scaled"), "beyond_3": lambda c: tally(F.abs(c) > 3)})
    return a.join(b, "column_name").withColumn("row_integrity", F.when(F.col("raw_n") == F.col("scaled_n"), "PASS").otherwise("FAIL"))


def onehot_fit(df: DataFrame, cols) -> DataFrame:
    """(column_name, value) of every category."""
    return pr.value_counts(df, cols).select("column_name", "value")


def onehot_transform(df: DataFrame, fit: DataFrame, cols, categories: dict | None = None) -> DataFrame:
    """One 0/1 column per category in sorted order; a value that is none of
    them gives zeros and sets ``has_unknown``. ``categories`` maps a column to
    its values, else they are those of the fit. Each becomes a column, so their
    number is that of the columns wanted; ``onehot_rows`` takes any number."""
    if categories is None:
        found = fit.filter(F.col("column_name").isin(*cols)).orderBy("column_name", "value").collect()
    else:
        found = [{"column_name": c, "value": v} for c in cols for v in sorted(categories[c])]
    out, unknown = {}, F.lit(False)
    for c in cols:
        values = [r["value"] for r in found if r["column_name"] == c]
        v = F.col(c).cast("string")
        unknown = unknown | (v.isNotNull() & ~v.isin(*values))
        for x in values:
            out[f"{c}_{x}"] = flag(v == x)
    return df.withColumns({**out, "has_unknown": flag(unknown)})


def onehot_rows(df: DataFrame, fit: DataFrame, cols, ids) -> DataFrame:
    """(ids, column_name, value) for each category a row holds, the sparse form
    of ``onehot_transform`` for any number of categories; ``value`` is null where
    the fit does not know it."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("__v")) for c in cols])
    long = df.select(*ids, F.explode(each).alias("__e")).select(*ids, "__e.*").filter("__v IS NOT NULL")
    known = fit.filter(F.col("column_name").isin(*cols)).select("column_name", "value").distinct()
    same = (long["column_name"] == known["column_name"]) & (long["__v"] == known["value"])
    return long.join(known, same, "left").select(*ids, long["column_name"], "value")


def impute_fit(df: DataFrame, cols, strategy="mean", constant=None) -> DataFrame:
    """(column_name, fill_value as string) by mean, median, mode, constant."""
    if strategy == "mean":
        return pr.summarise(df, cols, {"fill_value": lambda c: F.avg(c).cast("string")})
    if strategy == "median":
        return pr.quantile_rows(df, cols, {"m": .5}).select("column_name", F.col("m").cast("string").alias("fill_value"))
    if strategy == "mode":
        v = pr.value_counts(df, cols)
        return v.groupBy("column_name").agg(F.min(F.struct(-F.col("frequency"), "value"))["value"].alias("fill_value"))
    if strategy == "constant":
        return df.sparkSession.createDataFrame([(c, str(constant)) for c in cols], "column_name string, fill_value string")
    raise ValueError(strategy)


def impute_transform(df: DataFrame, fit: DataFrame, cols, suffix="") -> DataFrame:
    f, kinds = _lookup(fit, cols), dict(df.dtypes)
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.col(c), F.lit(f[c]["fill_value"]).cast(kinds[c])) for c in cols})


def imputed_rows(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    a = pr.summarise(before, cols, {"rows": lambda c: F.count(F.lit(1)), "missing_before": lambda c: tally(F.col(c).isNull())})
    b = pr.summarise(after, cols, {"rows_after": lambda c: F.count(F.lit(1)), "missing_after": lambda c: tally(F.col(c).isNull())})
    return a.join(b, "column_name").withColumn("imputed", F.col("missing_before") - F.col("missing_after")) \
            .withColumn("row_integrity", F.when(F.col("rows") == F.col("rows_after"), "PASS").otherwise("FAIL"))


def column_transformer(df: DataFrame, impute=None, scale=None, onehot=None) -> DataFrame:
    """Impute, then scale, then encode with given fits, each a pair (fit
    table, columns). The steps are column expressions of one select."""
    for step, pair in ((impute_transform, impute), (scale_transform, scale), (onehot_transform, onehot)):
        if pair:
            df = step(df, *pair)
    return df


def keyed_hash(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def train_test_split(df: DataFrame, id_col: str, train=0.8, seed=42, stratify: str | None = None) -> DataFrame:
    """``is_train`` by rank of a keyed hash inside each stratum: exact sizes,
    the same rows on every run. The train side has ``train`` of the rows,
    rounded half up in whole numbers."""
    keys = [stratify] if stratify else []
    part, whole = exact_share(train)
    rows = df.withColumn("__h", keyed_hash(id_col, seed))
    rows = sequence(rows, keys, ["__h", id_col], "__r")
    rows = with_stats(rows, [F.count(F.lit(1)).alias("__n")], keys)
    return rows.withColumn("is_train", flag(F.col("__r") * 2 * whole <= 2 * part * F.col("__n") + whole)).drop("__h", "__r", "__n")


def split_report(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Rows and share of each class on both sides."""
    c = df.groupBy("is_train", label).agg(F.count(F.lit(1)).alias("n"))
    return share(share(c, "n", "share_of_side", ["is_train"]), "n", "share_of_class", [label])


def split_overlap(df: DataFrame, id_col: str) -> DataFrame:
    """Ids present on both sides (should be none) and the side sizes."""
    g = df.groupBy(id_col).agg(F.min("is_train").alias("a"), F.max("is_train").alias("b"), F.count(F.lit(1)).alias("k"), F.sum("is_train").alias("t"))
    return g.agg(tally(F.col("a") != F.col("b")).alias("overlapping_ids"), F.sum("t").alias("train_rows"), (F.sum("k") - F.sum("t")).alias("test_rows"))


def kfold(df: DataFrame, id_col: str, k=5) -> DataFrame:
    """Fold 1..k by position in id order, round robin."""
    rows = sequence(df, [], [id_col], "__r")
    return rows.withColumn("fold", (F.col("__r") % k + 1).cast("int")).drop("__r")


def outlier_fit(df: DataFrame, cols, method="iqr", k=None) -> DataFrame:
    """(column_name, lower_bound, upper_bound, spread) by iqr, zscore,
    percentile (1st and 99th) or mad."""
    if method == "iqr":
        q, k = pr.quantile_rows(df, cols, {"a": .25, "b": .75}), k or 1.5
        s = F.col("b") - F.col("a")
        return q.select("column_name", (F.col("a") - k * s).alias("lower_bound"), (F.col("b") + k * s).alias("upper_bound"), s.alias("spread"))
    if method == "zscore":
        q, k = pr.summarise(df, cols, {"a": F.avg, "b": F.stddev}), k or 3.0
        return q.select("column_name", (F.col("a") - k * F.col("b")).alias("lower_bound"), (F.col("a") + k * F.col("b")).alias("upper_bound"), F.col("b").alias("spread"))
    if method == "percentile":
        q = pr.quantile_rows(df, cols, {"a": .01, "b": .99})
        return q.select("column_name", F.col("a").alias("lower_bound"), F.col("b").alias("upper_bound"), (F.col("b") - F.col("a")).alias("spread"))
    if method == "mad":
        out, k = None, k or 3.5
        for c in cols:
            m = pr.mad_bounds(df, c)
            w = k * F.col("mad_value") / 0.6745
            part = m.select(F.lit(c).alias("column_name"), (F.col("median_value") - w).alias("lower_bound"), (F.col("median_value") + w).alias("upper_bound"), F.col("mad_value").alias("spread"))
            out = part if out is None else out.unionByName(part)
        return out
    raise ValueError(method)


def outlier_transform(df: DataFrame, fit: DataFrame, cols, action="flag") -> DataFrame:
    """``<col>_is_outlier`` and ``<col>_outlier_score`` = excess over
    (excess + spread), 0 inside the bounds (ours). Action remove drops the
    rows, cap moves values to the bound, null clears them."""
    f, new, far = _lookup(fit, cols), {}, F.lit(False)
    for c in cols:
        lo, hi, s, v = (*(F.lit(f[c][k]) for k in ("lower_bound", "upper_bound", "spread")), F.col(c))
        out = F.coalesce((v < lo) | (v > hi), F.lit(False))
        excess = F.greatest(lo - v, v - hi, F.lit(0.0))
        new[f"{c}_is_outlier"] = flag(out)
        new[f"{c}_outlier_score"] = F.coalesce(excess / F.nullif(excess + s, F.lit(0.0)), F.lit(0.0))
        far = far | out
        if action == "cap":
            new[c] = F.greatest(F.least(v, hi), lo)
        elif action == "null":
            new[c] = F.when(~out, v)
    rows = df.filter(~far) if action == "remove" else df
    return rows.withColumns(new)


def outlier_score_bands(df: DataFrame, score: str) -> DataFrame:
    b = band_ge(score, [(0.8, "0.8-1.0 (Extreme)"), (0.6, "0.6-0.8 (High)"), (0.4, "0.4-0.6 (Medium)"), (0.2, "0.2-0.4 (Low)")], "0.0-0.2 (Normal)")
    return share(df.groupBy(b.alias("score_band")).agg(F.count(F.lit(1)).alias("n")), "n", "percentage")

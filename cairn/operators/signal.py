"""Signal processing on prepared series (series_id, ts, value, seq).

Spectra are rows (series_id, bin, real, imag, n); frequencies are bin/n
cycles per sample unless a sampling rate is given."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import band, band_gt, flag, pct, rnd, tally
from cairn.operators import series as ts
from cairn.operators.relational import nearest_match, ranked
from cairn.plans.lineage import cut_lineage
from cairn.plans.linear import dot, ols
from cairn.plans.ordered import attach, null_safe_join, running, sequence, sliding
from cairn.plans.quantiles import quantiles
from cairn.plans.recurrence import affine_scan

S = ["series_id"]
TAU = 2.0 * math.pi


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(*S).agg(F.max("seq").alias("n"))


def next_power(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.round(F.log2(n.cast("double")), 9))).cast("bigint")


def signal_prepare(df: DataFrame) -> DataFrame:
    """De-meaned, z-normalised and IQR-cleaned values with transform sizes."""
    q = quantiles(df.select(*S, "value"), {"q1": ("value", .25), "q3": ("value", .75)}, S)
    st = null_safe_join(df.groupBy(*S).agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.max("seq").alias("n")), q, S)
    r = attach(df, st, S, "n", keep_length=True)
    v, w = F.col("value"), 1.5 * (F.col("q3") - F.col("q1"))
    out = r.withColumns({
        "demeaned": v - F.col("m"), "normalized": (v - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)),
        "cleaned": F.greatest(F.least(v, F.col("q3") + w), F.col("q1") - w),
        "size_floor": F.pow(F.lit(2.0), F.floor(F.round(F.log2(F.col("n").cast("double")), 9))).cast("bigint"), "size_ceiling": next_power(F.col("n"))})
    return out.drop("m", "s", "q1", "q3")


# ---- transforms -----------------------------------------------------------

def dft(df: DataFrame, value="value", bins: int | None = None) -> DataFrame:
    """Discrete Fourier transform by definition: a sum of cosines and sines
    per bin. For selected bins or short series; ``fft`` is the fast form."""
    r = attach(df.select(*S, "seq", F.col(value).alias("x")), lengths(df), S, "n", keep_length=True)
    top = F.col("n") - 1 if bins is None else F.least(F.lit(bins - 1), F.col("n") - 1)
    r = r.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), top)))
    a = -TAU * ((F.col("bin") * (F.col("seq") - 1)) % F.col("n")) / F.col("n")
    return r.groupBy(*S, "bin").agg(F.sum(F.col("x") * F.cos(a)).alias("real"), F.sum(F.col("x") * F.sin(a)).alias("imag"), F.max("n").alias("n"))


PIECE = 1024  # an unpadded series up to this length is one piece


def _is_power(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def _four_step(cells: DataFrame, by, inverse=False) -> DataFrame:
    """(by, size, bin, re, im): transforms of the complex samples (by, size, j, re, im);
    missing samples are zero.

    N = n1 n2 samples take n1 transforms over strided samples, a twiddle factor, and n2
    transforms across them; each piece holds about sqrt(N) samples, so no task sees a
    whole series. A size that is not a power of two is one piece."""
    sign, scale = (1.0, F.col("size").cast("double")) if inverse else (-1.0, F.lit(1.0))
    n1 = F.when(_is_power(F.col("size")), F.pow(F.lit(2.0), F.floor(F.round(F.log2(F.col("size").cast("double")), 9) / 2)).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    r = cells.withColumn("n1", n1).withColumns({"j1": F.col("j") % F.col("n1"), "j2": F.floor(F.col("j") / F.col("n1")).cast("int")})
    out_type = "struct<re:array<double>,im:array<double>>"

    def piece(at, re, im, n, real=False):
        x = np.zeros(n, float if real else complex)
        x[at] = re if real else re + 1j * im
        return np.fft.ifft(x) * n if inverse else np.fft.fft(x)

    def frame(done):
        return pd.DataFrame({"re": [y.real for y in done], "im": [y.imag for y in done]})

    @F.pandas_udf(out_type)
    def inner(at: pd.Series, re: pd.Series, im: pd.Series, size: pd.Series, n1: pd.Series, j1: pd.Series) -> pd.DataFrame:
        # real samples take the real transform, at half the work
        return frame([piece(*p, int(s // a), not p[2].any()) * np.exp(sign * 2j * np.pi * j * np.arange(int(s // a)) / s)
                      for *p, s, a, j in zip(at, re, im, size, n1, j1)])

    @F.pandas_udf(out_type)
    def outer(at: pd.Series, re: pd.Series, im: pd.Series, n1: pd.Series) -> pd.DataFrame:
        return frame([piece(*p, int(a)) for *p, a in zip(at, re, im, n1)])

    held = lambda place: F.collect_list(F.struct(F.col(place).alias("at"), "re", "im")).alias("p")
    spread = lambda name: F.posexplode(F.arrays_zip("y.re", "y.im")).alias(name, "z")
    first = r.groupBy(*by, "size", "n1", "j1").agg(held("j2")).select(*by, "size", "n1", "j1", inner("p.at", "p.re", "p.im", "size", "n1", "j1").alias("y"))
    mid = first.select(*by, "size", "n1", F.col("j1").cast("int").alias("j1"), spread("k2")).select(*by, "size", "n1", "j1", F.col("k2").cast("bigint").alias("k2"), "z.re", "z.im")
    last = mid.groupBy(*by, "size", "n1", "k2").agg(held("j1")).select(*by, "size", "n1", "k2", outer("p.at", "p.re", "p.im", "n1").alias("y"))
    far = last.select(*by, "size", "n1", "k2", spread("k1"))
    return far.select(*by, "size", (F.col("k1") * F.floor(F.col("size") / F.col("n1")) + F.col("k2")).cast("bigint").alias("bin"),
                      (F.col("z.re") / scale).alias("re"), (F.col("z.im") / scale).alias("im"))


def _times(re, im, angle):
    """Real and imaginary part of a number turned by ``angle``."""
    return {"re": re * F.cos(angle) - im * F.sin(angle), "im": re * F.sin(angle) + im * F.cos(angle)}


def _chirp_transform(cells: DataFrame, by) -> DataFrame:
    """``_four_step`` for any size N, by Bluestein: jk = (j^2 + k^2 - (k - j)^2) / 2
    makes the transform a convolution with a chirp exp(i pi j^2 / N), which is a
    product of transforms of a power of two from 2N - 1 on. The chirp is laid out and
    transformed once for each different size, from the block numbers of its samples.
    The square is reduced modulo 2N in whole numbers, so the angles are exact."""
    n, j = F.col("n"), F.col("j")
    angle = lambda k: F.lit(math.pi) * ((k * k) % (2 * n)) / n
    rows = cells.withColumnRenamed("size", "n").withColumn("size", next_power(2 * n - 1))
    turned = rows.withColumns(_times(F.col("re"), F.col("im"), -angle(j)))
    sizes = rows.groupBy("n", "size").agg(F.count(F.lit(1)).alias("__c")).drop("__c")
    block = sizes.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / PIECE).cast("bigint")))).repartition("n", "b")
    chirp = block.withColumn("j", F.explode(F.sequence(F.col("b") * PIECE, F.least(F.col("b") * PIECE + (PIECE - 1), n - 1))))
    chirp = chirp.withColumns({"re": F.cos(angle(j)), "im": F.sin(angle(j))})
    both = F.when(j > 0, F.array(j, F.col("size") - j)).otherwise(F.array(j))
    chirp = chirp.withColumn("j", F.explode(both)).select("n", "size", "j", "re", "im")
    filtered = _four_step(chirp, ["n"]).select("n", "bin", F.col("re").alias("cr"), F.col("im").alias("ci"))
    product = _four_step(turned, [*by, "n"]).join(filtered, ["n", "bin"])
    a, b, c, d = (F.col(x) for x in ("re", "im", "cr", "ci"))
    product = product.select(*by, "n", "size", F.col("bin").alias("j"), (a * c - b * d).alias("re"), (a * d + b * c).alias("im"))
    out = _four_step(product, [*by, "n"], inverse=True).filter(F.col("bin") < n)
    return out.withColumns(_times(F.col("re"), F.col("im"), -angle(F.col("bin")))).select(*by, n.alias("size"), "bin", "re", "im")


def _transform(cells: DataFrame, by) -> DataFrame:
    """Transforms of (by, size, j, re, im) for any sizes."""
    whole = _is_power(F.col("size")) | (F.col("size") <= PIECE)
    return _four_step(cells.filter(whole), by).unionByName(_chirp_transform(cells.filter(~whole), by))


def fft(df: DataFrame, value="value", pad=True, size: int | None = None) -> DataFrame:
    """Fast transform of every series, zero padded to a power of two, or to ``size``
    samples (a longer series is cut to them), or unpadded.

    A power of two takes the four-step form, any other length the chirp transform
    over it, so no task holds more than about sqrt(N) samples (an unpadded series
    of at most ``PIECE`` samples is one piece)."""
    n = F.lit(size).cast("bigint") if size else next_power(F.col("n")) if pad else F.col("n")
    ln = lengths(df).withColumn("size", n)
    r = attach(df.select(*S, "seq", F.col(value).cast("double").alias("re")), ln, S, "n")
    r = r.select(*S, "size", (F.col("seq") - 1).alias("j"), F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")).filter("j < size")
    done = _four_step(r, S) if pad and not size else _transform(r, S)
    return done.select(*S, "bin", F.col("re").alias("real"), F.col("im").alias("imag"), F.col("size").alias("n"))


def fft_format(spec: DataFrame, form="COMPLEX", normalize=False) -> DataFrame:
    """COMPLEX, MAGNITUDE, POWER or MAGNITUDE_PHASE columns."""
    k = 1.0 / F.col("n") if normalize else F.lit(1.0)
    re, im = F.col("real") * k, F.col("imag") * k
    cols = {"COMPLEX": {"real": re, "imag": im}, "MAGNITUDE": {"magnitude": F.sqrt(re * re + im * im)}, "POWER": {"power": re * re + im * im},
            "MAGNITUDE_PHASE": {"magnitude": F.sqrt(re * re + im * im), "phase_degrees": F.degrees(F.atan2(im, re))}}[form]
    return spec.select(*S, "bin", "n", *[v.alias(c) for c, v in cols.items()])


def idft(spec: DataFrame) -> DataFrame:
    """Values of a spectrum by definition; missing bins count as zero."""
    r = spec.withColumn("seq", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    a = TAU * ((F.col("bin") * (F.col("seq") - 1)) % F.col("n")) / F.col("n")
    return r.groupBy(*S, "seq").agg((F.sum(F.col("real") * F.cos(a) - F.col("imag") * F.sin(a)) / F.max("n")).alias("value"))


def ifft(spec: DataFrame) -> DataFrame:
    """Fast inverse, the conjugate of the transform of the conjugate; missing bins
    count as zero."""
    r = spec.select(*S, F.col("n").alias("size"), F.col("bin").alias("j"), F.col("real").alias("re"), (-F.col("imag")).alias("im"))
    return _transform(r, S).select(*S, (F.col("bin") + 1).alias("seq"), (F.col("re") / F.col("size")).alias("value"))


# ---- spectrum reports -----------------------------------------------------

def spectrum_polar(spec: DataFrame, rate=1.0) -> DataFrame:
    re, im = F.col("real"), F.col("imag")
    return spec.withColumns({"magnitude": F.sqrt(re * re + im * im), "phase_degrees": F.degrees(F.atan2(im, re)), "power": re * re + im * im,
                             "frequency_hz": F.col("bin") * rate / F.col("n")})


def polar_to_complex(polar: DataFrame) -> DataFrame:
    a = F.radians("phase_degrees")
    return polar.withColumns({"real": F.col("magnitude") * F.cos(a), "imag": F.col("magnitude") * F.sin(a)})


def one_sided(spec: DataFrame, rate=1.0) -> DataFrame:
    """Bins 0..n/2 with magnitude and frequency."""
    return spectrum_polar(spec.filter(F.col("bin") * 2 <= F.col("n")), rate)


def spectrum_filter(spec: DataFrame, drop_dc=False, max_bin=None, low=None, high=None) -> DataFrame:
    """Keep bins (both sides of the symmetric spectrum) by position."""
    b = F.least(F.col("bin"), F.col("n") - F.col("bin"))
    keep = F.lit(True)
    if drop_dc:
        keep = keep & (b > 0)
    if max_bin is not None:
        keep = keep & (b <= max_bin)
    if low is not None:
        keep = keep & (b >= low)
    if high is not None:
        keep = keep & (b <= high)
    return spec.filter(keep)


def energy_removed(spec: DataFrame, kept: DataFrame) -> DataFrame:
    e = F.sum(F.col("real") * F.col("real") + F.col("imag") * F.col("imag"))
    j = null_safe_join(spec.groupBy(*S).agg(e.alias("total_energy")), kept.groupBy(*S).agg(e.alias("kept_energy")), S, "left")
    return j.withColumn("removed_pct", 100.0 - pct(F.coalesce("kept_energy", F.lit(0.0)), "total_energy"))


def spectrum_validate(spec: DataFrame, tolerance=1e-3) -> DataFrame:
    """Bins present, Hermitian symmetry (bin k against n-k), phase jumps."""
    other = spec.select(*S, ((F.col("n") - F.col("bin")) % F.col("n")).alias("bin"), F.col("real").alias("r2"), F.col("imag").alias("i2"))
    j = null_safe_join(spec, other, S + ["bin"], "left")
    ok = (F.abs(F.col("real") - F.col("r2")) < tolerance) & (F.abs(F.col("imag") + F.col("i2")) < tolerance)
    a = j.groupBy(*S).agg(F.count(F.lit(1)).alias("total_bins"), F.max("n").alias("expected_bins"), pct(tally(ok), F.count(F.lit(1))).alias("hermitian_pct"))
    p = one_sided(spec).filter("bin > 0").withColumnRenamed("bin", "seq")
    p = sliding(p, S, lambda w: {"d": F.abs(F.col("phase_degrees") - F.lag("phase_degrees").over(w))}, before=1)
    b = p.groupBy(*S).agg(F.max("d").alias("max_phase_jump"), tally(F.col("d") > 180).alias("phase_wraps"))
    out = null_safe_join(a, b, S, "left").withColumn("completeness_pct", pct("total_bins", "expected_bins"))
    return out.withColumns({"recommended_output": F.when(F.col("hermitian_pct") > 95, "REAL").otherwise("COMPLEX"), "phase_recommendation": band_gt(
        "max_phase_jump", [(180, "Phase unwrapping recommended"), (90, "Monitor phase continuity")], "Phase continuity acceptable")})


# Frequency bands in Hz.
BANDS = [(0.1, "Very Low Frequency (<0.1 Hz)"), (1.0, "Low Frequency (0.1-1 Hz)"), (10.0, "Medium Frequency (1-10 Hz)"),
         (100.0, "High Frequency (10-100 Hz)"), (1000.0, "Very High Frequency (100-1000 Hz)")]


def frequency_band(f="frequency_hz") -> Column:
    return F.when(F.col(f) == 0, "DC Component").otherwise(band(f, BANDS, "Ultra High Frequency (>1000 Hz)"))


def with_rank(pos: DataFrame) -> DataFrame:
    """Magnitude rank (largest first) of each bin in its series."""
    r = sequence(pos, S, [("magnitude", "desc"), "bin"], "magnitude_rank")
    return r


def dominant_frequencies(spec: DataFrame, n=10, rate=1.0) -> DataFrame:
    """The n strongest bins without DC: level, period, share, band and the
    place in the harmonic series of the strongest one."""
    pos = one_sided(spec, rate)
    tot = pos.groupBy(*S).agg(F.sum("magnitude").alias("__t"), F.max_by("frequency_hz", F.when(F.col("bin") > 0, F.struct("magnitude", -F.col("bin")))).alias("__f0"))
    top = with_rank(pos.filter("bin > 0")).filter(F.col("magnitude_rank") <= n)
    j = null_safe_join(top, tot, S)
    h = F.col("frequency_hz") / F.col("__f0")
    return j.select(*S, "magnitude_rank", "bin", "frequency_hz", (1.0 / F.col("frequency_hz")).alias("period_seconds"), "magnitude",
                    (20.0 * F.log10(F.nullif(F.col("magnitude"), F.lit(0.0)))).alias("power_db"), (F.col("magnitude") / F.col("__t") * 100.0).alias("relative_power_pct"),
                    frequency_band().alias("frequency_band"), h.alias("harmonic_number"),
                    F.when(F.abs(h - F.round(h)) < 0.05, "Harmonic").otherwise("Independent").alias("component_type"))


def band_power(spec: DataFrame, rate=1.0) -> DataFrame:
    pos = one_sided(spec, rate).filter("bin > 0")
    g = pos.groupBy(*S, frequency_band().alias("frequency_band")).agg(
        F.count(F.lit(1)).alias("components"), F.min("frequency_hz").alias("start_hz"), F.max("frequency_hz").alias("end_hz"), F.sum("magnitude").alias("total_magnitude"),
        F.avg("magnitude").alias("avg_magnitude"), F.max("magnitude").alias("peak_magnitude"), F.avg("power").alias("avg_energy_density"))
    t = g.groupBy(*S).agg(F.sum("total_magnitude").alias("__t"))
    return null_safe_join(g, t, S).withColumn("power_pct", pct("total_magnitude", "__t")).drop("__t")


def low_frequency_share(spec: DataFrame, max_bin: int) -> DataFrame:
    pos = one_sided(spec).filter("bin > 0")
    return pos.groupBy(*S).agg(pct(F.sum(F.when(F.col("bin") <= max_bin, F.col("power")).otherwise(0.0)), F.sum("power")).alias("low_frequency_pct"))


def cumulative_power(spec: DataFrame, rate=1.0) -> DataFrame:
    pos = one_sided(spec, rate)
    r = running(pos.withColumn("seq", F.col("bin") + 1), S, {"__c": "magnitude"})
    t = pos.groupBy(*S).agg(F.sum("magnitude").alias("__t"), F.count(F.lit(1)).alias("__k"))
    r = attach(r, t, S, "__k")
    return r.withColumn("cumulative_power_pct", pct("__c", "__t")).drop("__c", "__t", "seq")


def spectral_stats(spec: DataFrame, rate=1.0) -> DataFrame:
    """Centroid, spread, 95% roll-off, flatness, 5-95% bandwidth, crest."""
    c = cumulative_power(spec, rate)
    f, m, p = F.col("frequency_hz"), F.col("magnitude"), F.col("bin") > 0
    on = lambda e: F.when(p, e)
    a = c.groupBy(*S).agg(
        (F.sum(on(f * m)) / F.sum(on(m))).alias("spectral_centroid_hz"), (F.sum(on(f * f * m)) / F.sum(on(m))).alias("__q"),
        F.min(F.when(F.col("cumulative_power_pct") >= 95, f)).alias("rolloff95_hz"),
        (F.exp(F.avg(on(F.ln(F.nullif(m, F.lit(0.0)))))) / F.avg(on(m))).alias("spectral_flatness"),
        (F.max(F.when(F.col("cumulative_power_pct").between(5, 95), f)) - F.min(F.when(F.col("cumulative_power_pct").between(5, 95), f))).alias("bandwidth90_hz"),
        (F.max(on(m)) / F.avg(on(m))).alias("peak_to_avg_ratio"))
    a = a.withColumn("spectral_spread_hz", F.sqrt(F.greatest(F.col("__q") - F.pow("spectral_centroid_hz", 2), F.lit(0.0)))).drop("__q")
    return a.withColumn("signal_character", band_gt("spectral_flatness", [(0.8, "Noise-like signal"), (0.5, "Mixed signal (tones + noise)"), (0.2, "Tonal signal with some noise")], "Highly tonal signal"))


def harmonics(spec: DataFrame, rate=1.0, tolerance=0.1) -> DataFrame:
    """Second and third harmonic of the strongest bin: the nearest bin within
    ``tolerance`` of the fundamental, and total harmonic distortion."""
    pos = one_sided(spec, rate).filter("bin > 0").select(*S, "bin", "frequency_hz", "magnitude")
    f0 = pos.groupBy(*S).agg(F.max_by(F.struct("frequency_hz", "magnitude"), F.struct("magnitude", -F.col("bin"))).alias("f"))
    out = f0.select(*S, F.col("f.frequency_hz").alias("fundamental_hz"), F.col("f.magnitude").alias("fundamental_magnitude"))
    for k, name in ((2, "second"), (3, "third")):
        want = out.select(*S, (F.col("fundamental_hz") * k).alias("want"))
        m = nearest_match(pos, S, want, "frequency_hz", "want", -F.col("bin"), tolerance / k)
        out = null_safe_join(out, m.select(*S, F.col("frequency_hz").alias(f"{name}_hz"), F.col("magnitude").alias(f"{name}_magnitude")), S, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    thd = F.sqrt(F.pow(z("second_magnitude"), 2) + F.pow(z("third_magnitude"), 2)) / F.col("fundamental_magnitude") * 100.0
    return out.withColumn("thd_percent", thd).withColumn("harmonic_pattern", F.when(F.col("second_hz").isNotNull() & F.col("third_hz").isNotNull(), "Strong harmonic series detected")
                                                         .when(F.col("second_hz").isNotNull(), "Harmonic series partially present").otherwise("No clear harmonics"))


def snr(spec: DataFrame, top=5) -> DataFrame:
    """Mean level of the strongest bins against that of the weaker half."""
    r = with_rank(one_sided(spec).withColumn("db", 20.0 * F.log10(F.nullif(F.col("magnitude"), F.lit(0.0)))))
    n = r.groupBy(*S).agg(F.max("magnitude_rank").alias("__k"))
    r = attach(r, n, S, "__k", seq="magnitude_rank", keep_length=True)
    a = r.groupBy(*S).agg(F.avg(F.when(F.col("magnitude_rank") <= top, F.col("db"))).alias("signal_power_db"),
                          F.avg(F.when(F.col("magnitude_rank") > F.col("__k") / 2, F.col("db"))).alias("noise_floor_db"), (F.max("db") - F.min("db")).alias("dynamic_range_db"))
    s = F.col("signal_power_db") - F.col("noise_floor_db")
    return a.withColumns({"snr_db": s, "effective_bits": (F.col("dynamic_range_db") - 1.76) / 6.02, "snr_quality": band_gt(
        s, [(40, "Excellent (>40 dB)"), (30, "Very Good (30-40 dB)"), (20, "Good (20-30 dB)"), (10, "Fair (10-20 dB)")], "Poor (<10 dB)")})


def spectral_anomalies(spec: DataFrame, rate=1.0) -> DataFrame:
    """Bins above mean + 2 sd of the magnitude, classified."""
    pos = one_sided(spec, rate)
    st = null_safe_join(pos.groupBy(*S).agg(F.avg("magnitude").alias("__m"), F.stddev("magnitude").alias("__s")),
                        spectral_stats(spec, rate).select(*S, "spectral_centroid_hz", "spectral_spread_hz"), S)
    j = null_safe_join(pos, st, S).filter(F.col("magnitude") > F.col("__m") + 2 * F.col("__s"))
    c, w = F.col("spectral_centroid_hz"), F.col("spectral_spread_hz")
    kind = F.when(F.col("magnitude") > F.col("__m") + 3 * F.col("__s"), "Outlier: Unusually strong component") \
            .when(~F.col("frequency_hz").between(c - w, c + w), "Anomaly: Unexpected frequency peak").otherwise("Normal")
    return j.select(*S, "bin", "frequency_hz", "magnitude", kind.alias("anomaly_type"))


def dc_analysis(spec: DataFrame) -> DataFrame:
    pos = one_sided(spec)
    a = pos.groupBy(*S).agg(F.max(F.when(F.col("bin") == 0, F.col("magnitude"))).alias("dc_magnitude"), F.sum("magnitude").alias("__t"),
                            F.avg(F.when(F.col("bin") > 0, F.col("magnitude"))).alias("__a"))
    d = F.col("dc_magnitude")
    return a.select(*S, "dc_magnitude", (d / F.col("__t") * 100.0).alias("dc_percentage"), F.when(d > 2 * F.col("__a"), "Strong DC bias - Signal has significant mean offset")
                    .when(d > F.col("__a"), "Moderate DC component - Signal has mean offset").otherwise("Minimal DC - Signal well-centered around zero").alias("dc_interpretation"))


def parseval_check(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Energy in time against energy in frequency over n."""
    a = df.groupBy(*S).agg(F.sum(F.col("value") * F.col("value")).alias("time_energy"))
    b = spec.groupBy(*S).agg((F.sum(F.col("real") * F.col("real") + F.col("imag") * F.col("imag")) / F.max("n")).alias("frequency_energy"))
    j = null_safe_join(a, b, S).withColumn("relative_error", F.abs(F.col("time_energy") - F.col("frequency_energy")) / F.col("time_energy"))
    return j.withColumn("status", F.when(F.col("relative_error") < 1e-6, "PASS").otherwise("FAIL"))


def reconstruction_error(df: DataFrame, back: DataFrame) -> DataFrame:
    j = null_safe_join(df.select(*S, "seq", F.col("value").alias("a")), back.select(*S, "seq", F.col("value").alias("b")), S + ["seq"])
    e = F.col("a") - F.col("b")
    return j.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(e)).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rmse"))


# ---- windows, density -----------------------------------------------------

def window_weight(kind: str, k: Column, n, beta=8.6) -> Column:
    """Weight at position k = 0..n-1."""
    n = n if isinstance(n, Column) else F.lit(n)
    x = F.when(n > 1, k / (n - 1)).otherwise(0.5)
    if kind == "rectangular":
        return F.lit(1.0) + 0.0 * x
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(TAU * x)
    if kind == "hanning":
        return 0.5 - 0.5 * F.cos(TAU * x)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(TAU * x) + 0.08 * F.cos(2 * TAU * x)
    if kind == "kaiser":
        def bessel(z):  # power series of I0, innermost term first
            steps = F.sequence(F.lit(30), F.lit(1), F.lit(-1))
            return F.aggregate(steps, F.lit(1.0), lambda acc, i: 1.0 + acc * (z * z / 4.0) / (i * i))
        u = 2.0 * x - 1.0
        return bessel(beta * F.sqrt(F.greatest(1.0 - u * u, F.lit(0.0)))) / float(np.i0(beta))
    raise ValueError(kind)


def window_apply(df: DataFrame, kind="hamming", normalise=False, size: int | None = None, overlap=0.0) -> DataFrame:
    """Multiply by a window over the whole series, or over overlapping
    segments of ``size`` samples (rows then carry segment and offset)."""
    if size is None:
        r = attach(df, lengths(df), S, "n", keep_length=True)
        w = window_weight(kind, F.col("seq") - 1, F.col("n"))
        r = r.withColumn("weight", w)
        if normalise:  # unit mean weight
            s = r.groupBy(*S).agg(F.avg("weight").alias("__w"), F.max("seq").alias("__k"))
            r = attach(r, s, S, "__k").withColumn("weight", F.col("weight") / F.col("__w")).drop("__w")
        return r.withColumn("windowed", F.col("value") * F.col("weight")).drop("n")
    r = segments(df, size, overlap)
    w = window_weight(kind, F.col("offset"), size)
    return r.withColumn("weight", w).withColumn("windowed", F.col("value") * F.col("weight"))


def segments(df: DataFrame, size: int, overlap: float) -> DataFrame:
    """Samples dealt to full overlapping segments: (segment, offset)."""
    step = max(1, int(round(size * (1.0 - overlap))))
    r = attach(df, lengths(df), S, "n", keep_length=True)
    p = F.col("seq") - 1
    first = F.greatest(F.lit(0), F.ceil((p - (size - 1)) / F.lit(float(step)))).cast("bigint")
    last = F.least(F.floor(p / F.lit(float(step))), F.floor((F.col("n") - size) / F.lit(float(step)))).cast("bigint")
    r = r.filter(first <= last).withColumn("segment", F.explode(F.sequence(first, last)))
    return r.withColumn("offset", p - F.col("segment") * step).drop("n")


def spectral_density(df: DataFrame, size=64, overlap=0.5, kind="hanning", detrend="constant", rate=1.0, beta=8.6) -> DataFrame:
    """Welch: remove mean or line, window and transform every segment, average the one-sided
    periodograms. Segments are the unit of work, so one long series is
    spread like many short ones."""
    r = segments(df, size, overlap)
    # symmetric windows of the fixed size, computed once
    k = np.arange(size)
    x = k / (size - 1)
    win = {"rectangular": np.ones(size), "hamming": 0.54 - 0.46 * np.cos(TAU * x), "hanning": 0.5 - 0.5 * np.cos(TAU * x),
           "blackman": 0.42 - 0.5 * np.cos(TAU * x) + 0.08 * np.cos(2 * TAU * x), "kaiser": np.kaiser(size, beta)}
    if kind not in win or detrend not in ("none", "constant", "linear"):
        raise ValueError(f"{kind}, {detrend}")
    win, line = win[kind], k - k.mean()
    line = line / np.sqrt((line ** 2).sum())
    scale = 1.0 / (rate * float((win ** 2).sum()))

    @F.pandas_udf("array<double>")
    def periodogram(p: pd.Series) -> pd.Series:
        m = np.zeros((len(p), size))
        for i, rows in enumerate(p):
            for e in rows:
                m[i, e["offset"]] = e["value"]
        if detrend != "none":
            m = m - m.mean(axis=1, keepdims=True)
        if detrend == "linear":
            m = m - (m @ line)[:, None] * line[None, :]
        y = np.abs(np.fft.rfft(m * win, axis=1)) ** 2 * scale
        y[:, 1:(size + 1) // 2] *= 2.0
        return pd.Series(list(y))

    g = r.groupBy(*S, "segment").agg(F.collect_list(F.struct("offset", "value")).alias("p")).select(*S, periodogram("p").alias("y"))
    return g.select(*S, F.posexplode("y").alias("bin", "v")).groupBy(*S, "bin").agg(
        F.avg("v").alias("density"), F.count(F.lit(1)).alias("segments")).withColumn("frequency_hz", F.col("bin") * rate / size)


def power_spectrum(df: DataFrame, segment=64, overlap_ratio=0.0, kind="rectangular") -> DataFrame:
    return spectral_density(df, segment, overlap_ratio, kind, detrend="none").withColumnRenamed("density", "power")


def leakage_risk(df: DataFrame) -> DataFrame:
    """Jump between both ends against the deviation, and the window that suits."""
    a = df.groupBy(*S).agg(F.min_by("value", "seq").alias("__f"), F.max_by("value", "seq").alias("__l"), F.stddev("value").alias("__s"), F.avg("value").alias("__m"),
                           F.max("value").alias("__x"), F.min("value").alias("__n"), F.count(F.lit(1)).alias("sample_count"))
    r = F.abs(F.col("__f") - F.col("__l")) / F.nullif(F.col("__s"), F.lit(0.0))
    c = F.col("__s") / (F.greatest(F.abs(F.col("__x") - F.col("__m")), F.abs(F.col("__n") - F.col("__m"))) + 0.0001)
    return a.select(*S, "sample_count", r.alias("end_mismatch"), c.alias("spectral_concentration"), band_gt(r, [(1.0, "High leakage risk"), (0.3, "Moderate leakage risk")], "Low leakage risk").alias("leakage_risk"),
                    band_gt(c, [(0.8, "Rectangular"), (0.6, "Hamming"), (0.4, "Hanning")], "Blackman").alias("recommended_window"))


def fft_recommend(df: DataFrame) -> DataFrame:
    g = ts.sampling_rate(df).select(*S, "sampling_rate_hz")
    a = df.groupBy(*S).agg(F.count(F.lit(1)).alias("actual_samples"), F.avg(F.abs("value")).alias("signal_magnitude"), (F.max("value") - F.min("value")).alias("magnitude_range"))
    a = null_safe_join(a, g, S).withColumn("fft_size", next_power(F.col("actual_samples")))
    pad = F.col("fft_size") - F.col("actual_samples")
    return a.withColumns({
        "padding_required": pad, "frequency_resolution_hz": F.col("sampling_rate_hz") / F.col("fft_size"), "max_frequency_hz": F.col("sampling_rate_hz") / 2.0,
        "normalize": F.when((F.col("magnitude_range") > 1000) | (F.col("signal_magnitude") > 100), "TRUE").otherwise("FALSE"),
        "padding_quality": F.when(pad == 0, "Optimal - No padding needed").when(pad < F.col("actual_samples") * 0.1, "Good - Minimal padding")
                            .when(pad < F.col("actual_samples") * 0.5, "Acceptable - Moderate padding").otherwise("Poor - Consider collecting more samples")}).drop("sampling_rate_hz")


# ---- filters, convolution, correlation ------------------------------------

def fir_taps(kind: str, cutoff, rate=1.0, order=20):
    """Hamming-windowed sinc taps (order + 1 of them, unit gain in the pass
    band centre)."""
    order += order % 2
    k = np.arange(order + 1) - order / 2
    low = lambda fc: 2 * fc / rate * np.sinc(2 * fc / rate * k)
    w = 0.54 + 0.46 * np.cos(TAU * k / order)
    delta = (k == 0).astype(float)
    if kind in ("lowpass", "highpass"):
        h = low(cutoff) * w
        h = h / h.sum()
        return h if kind == "lowpass" else delta - h
    a, b = cutoff
    ha, hb = low(a) * w, low(b) * w
    bp = hb / hb.sum() - ha / ha.sum()
    return bp if kind == "bandpass" else delta - bp


def fir_filter(df: DataFrame, kind="lowpass", cutoff=0.1, rate=1.0, order=20, passes="forward", name="filtered") -> DataFrame:
    """Linear-phase FIR as a moving weighted sum centred on the sample; ends
    use the samples that exist. ``zero-phase`` applies it twice."""
    taps = fir_taps(kind, cutoff, rate, order)
    out = convolve(df, taps, "same", name=name)
    return out if passes == "forward" else convolve(out.withColumnRenamed(name, "__once"), taps, "same", name=name, column="__once").drop("__once")


def _section(df: DataFrame, w: float, damping: float, kind: str, column: str, name: str) -> DataFrame:
    """One second-order section by the bilinear transform."""
    q = 1.0 / (1.0 + damping * w + w * w)
    b = np.array([w * w, 2 * w * w, w * w]) * q if kind == "lowpass" else np.array([1.0, -2.0, 1.0]) * q
    a1, a2 = 2 * (w * w - 1) * q, (1 - damping * w + w * w) * q
    # transposed direct form II: y = b0 x + s1
    A, g = [[-a1, 1.0], [-a2, 0.0]], [b[1] - a1 * b[0], b[2] - a2 * b[0]]
    r = affine_scan(df, S, A, g, [0.0, 0.0], before=[1.0, 0.0], value=column)
    return r.withColumn(name, F.col("__before") + float(b[0]) * F.col(column)).drop("__before", "__after", "__state")


def butterworth(df: DataFrame, cutoff=0.1, rate=1.0, kind="lowpass", order=2, name="filtered") -> DataFrame:
    """Recursive Butterworth filter of even order, as second-order sections run
    as linear recursions over blocks. A band takes two cutoffs: a band pass is
    the high pass at the lower one and then the low pass at the upper one, a band
    stop the sum of the low pass at the lower and the high pass at the upper one."""
    if order < 2 or order % 2:
        raise ValueError("order must be even")
    if kind in ("bandpass", "bandstop"):
        low, high = cutoff
        if kind == "bandpass":
            once = butterworth(df, low, rate, "highpass", order, "__once")
            return _sections(once, high, rate, "lowpass", order, "__once", name).drop("__once")
        both = _sections(butterworth(df, low, rate, "lowpass", order, "__low"), high, rate, "highpass", order, "value", "__high")
        return both.withColumn(name, F.col("__low") + F.col("__high")).drop("__low", "__high")
    if kind not in ("lowpass", "highpass"):
        raise ValueError(kind)
    return _sections(df, cutoff, rate, kind, order, "value", name)


def _sections(df: DataFrame, cutoff: float, rate: float, kind: str, order: int, column: str, name: str) -> DataFrame:
    w, at = math.tan(math.pi * cutoff / rate), column
    for k in range(order // 2):
        to = name if k == order // 2 - 1 else f"__section{k}"
        df = _section(df, w, 2.0 * math.sin((2 * k + 1) * math.pi / (2 * order)), kind, at, to)
        df = df if at == column else df.drop(at)
        at = to
    return df


def filter_recommend(df: DataFrame) -> DataFrame:
    rows = sliding(df, S, lambda w: {"__d": F.col("value") - F.lag("value").over(w)}, before=1)
    a = rows.groupBy(*S).agg((F.abs(F.avg("value")) / F.nullif(F.stddev("value"), F.lit(0.0))).alias("dc_ratio"), (F.stddev("__d") / F.nullif(F.stddev("value"), F.lit(0.0))).alias("noise_ratio"))
    a = null_safe_join(a, ts.sampling_rate(df).select(*S, "nyquist_hz"), S)
    return a.withColumns({"recommended_filter": F.when((F.col("dc_ratio") > 1) & (F.col("noise_ratio") > 1), "bandpass").when(F.col("dc_ratio") > 1, "highpass").otherwise("lowpass"),
                          **{f"cutoff_{p}pct_hz": F.col("nyquist_hz") * (p / 100.0) for p in (10, 30, 50)}})


def convolve(df: DataFrame, kernel, edge="same", normalize=False, name="convolved", column="value") -> DataFrame:
    """Convolution with a small kernel. Each sample is spread to the outputs
    it feeds (a map-side explode) and summed; missing samples count as zero.
    ``same`` keeps positions 1..n centred, ``valid`` those with full overlap,
    ``full`` all n + m - 1."""
    k = np.asarray(kernel, float)
    if normalize:
        k = k / k.sum()
    m, h = len(k), (len(k) - 1) // 2
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(k)])
    if edge == "same":
        def build(w):
            e = F.lit(0.0)
            for i, c in enumerate(k):
                o = h - i  # output t takes x[t + h - i]
                v = F.col(column) if o == 0 else (F.lead(column, o).over(w) if o > 0 else F.lag(column, -o).over(w))
                e = e + F.coalesce(v * float(c), F.lit(0.0))
            return {name: e}
        return sliding(df, S, build, m, m)
    r = attach(df.select(*S, "seq", F.col(column).alias("x")), lengths(df), S, "n", keep_length=True)
    r = r.select(*S, "seq", "x", "n", F.explode(cells).alias("k"))
    out = r.groupBy(*S, (F.col("seq") + F.col("k.i")).alias("seq")).agg(F.sum(F.col("x") * F.col("k.c")).alias(name), F.max("n").alias("n"))
    if edge == "valid":
        out = out.filter((F.col("seq") >= m) & (F.col("seq") <= F.col("n"))).withColumn("seq", F.col("seq") - (m - 1))
    return out.drop("n")


def cross_correlate(df: DataFrame, x="x", y="y", max_lag=10, normalize=True) -> DataFrame:
    """Correlation of x_t with y_{t+lag} for lags -L..L."""
    lags = range(-max_lag, max_lag + 1)
    def build(w):
        return {f"__y{i}": (F.col(y) if k == 0 else (F.lead(y, k).over(w) if k > 0 else F.lag(y, -k).over(w))) for i, k in enumerate(lags)}
    r = sliding(df, S, build, max_lag, max_lag)
    fn = (lambda c: F.corr(x, c)) if normalize else (lambda c: F.avg(F.col(x) * F.col(c)))
    one = r.groupBy(*S).agg(*[fn(f"__y{i}").alias(f"c{i}") for i in range(len(lags))])
    return one.select(*S, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{i}").alias("correlation")) for i, k in enumerate(lags)])).alias("r")).select(*S, "r.*")


def delay_at_peak(corr: DataFrame) -> DataFrame:
    return corr.groupBy(*S).agg(F.max_by(F.struct("lag", "correlation"), F.struct(F.round(F.abs("correlation"), 12), -F.abs("lag"), -F.col("lag"))).alias("p")).select(*S, F.col("p.lag").alias("delay"), F.col("p.correlation").alias("peak"))


def detrend(df: DataFrame, kind="linear", order=2, breakpoints=(), name="detrended") -> DataFrame:
    """Remove the mean, a line, or a polynomial in centred time, per segment
    between the given positions."""
    seg = F.lit(0)
    for b in breakpoints:
        seg = seg + flag(F.col("seq") > b)
    r = df.withColumn("segment", seg)
    deg = {"constant": 0, "linear": 1, "polynomial": order}[kind]
    st = r.groupBy(*S, "segment").agg(((F.min("seq") + F.max("seq")) / 2.0).alias("__c"), ((F.max("seq") - F.min("seq")) / 2.0).alias("__h"))
    shape = st.groupBy(*S).agg(F.map_from_entries(F.collect_list(F.struct("segment", F.struct("__c", "__h")))).alias("__m"))
    r = attach(r, null_safe_join(shape, lengths(df), S), S, "n", keep_length=True)
    u = (F.col("seq") - F.try_element_at("__m", F.col("segment"))["__c"]) / F.greatest(F.try_element_at("__m", F.col("segment"))["__h"], F.lit(1.0))
    r = r.withColumn("__u", u).drop("__m")
    xs = [F.pow("__u", i) if i else F.lit(1.0) for i in range(deg + 1)]
    fit = ols(r, S + ["segment"], F.col("value"), xs).select(*S, "segment", "coef")
    table = fit.groupBy(*S).agg(F.map_from_entries(F.collect_list(F.struct("segment", "coef"))).alias("__k"))
    r = attach(r.drop("n"), null_safe_join(table, lengths(df), S), S, "n")
    r = r.withColumn("__b", F.try_element_at("__k", F.col("segment"))).withColumn("trend", dot("__b", xs))
    return r.withColumn(name, F.col("value") - F.col("trend")).drop("__u", "__k", "__b")


def trend_detect(df: DataFrame) -> DataFrame:
    a = df.groupBy(*S).agg(F.regr_slope("value", "seq").alias("slope"), F.regr_r2("value", "seq").alias("r2"))
    return a.withColumn("trend_strength", band_gt("r2", [(0.7, "Strong linear trend"), (0.3, "Moderate linear trend")], "Weak or no linear trend"))


def resample(df: DataFrame, step_seconds: float, interpolation="linear") -> DataFrame:
    """Values on a regular grid from each series' first to its last stamp:
    linear, nearest, previous. Every interval between two samples makes its
    own grid points, so nothing is joined."""
    us = F.unix_micros("ts")
    step = int(step_seconds * 1e6)
    start = df.groupBy(*S).agg(F.min(us).alias("__t0"), F.max("seq").alias("__n"))
    r = attach(df.withColumn("__t", us), start, S, "__n", keep_length=True)
    r = sliding(r, S, lambda w: {"__t1": F.lead("__t").over(w), "__v1": F.lead("value").over(w)}, after=1)
    lo = F.ceil((F.col("__t") - F.col("__t0")) / F.lit(step)).cast("bigint")
    hi = F.when(F.col("__t1").isNull(), lo).otherwise((F.ceil((F.col("__t1") - F.col("__t0")) / F.lit(step)) - 1).cast("bigint"))
    exact_end = F.col("__t1").isNull() & ((F.col("__t") - F.col("__t0")) % step != 0)
    r = r.filter((lo <= hi) & ~exact_end).withColumn("grid", F.explode(F.sequence(lo, hi)))
    g = F.col("__t0") + F.col("grid") * step
    part = (g - F.col("__t")) / F.nullif(F.col("__t1") - F.col("__t"), F.lit(0))
    v = {"linear": F.col("value") + F.coalesce((F.col("__v1") - F.col("value")) * part, F.lit(0.0)), "previous": F.col("value"),
         "nearest": F.when(F.coalesce(part, F.lit(0.0)) > 0.5, F.col("__v1")).otherwise(F.col("value"))}[interpolation]
    return r.select(*S, F.timestamp_micros(g).alias("ts"), (F.col("grid") + 1).alias("seq"), v.alias("value"))


def resample_cubic(df: DataFrame, step_seconds: float) -> DataFrame:
    """Cubic Hermite with slopes from the neighbouring samples (local, so a
    frame of four samples is enough)."""
    us = F.unix_micros("ts")
    step = int(step_seconds * 1e6)
    start = df.groupBy(*S).agg(F.min(us).alias("__t0"), F.max("seq").alias("__n"))
    r = attach(df.withColumn("__t", us), start, S, "__n", keep_length=True)
    nb = lambda w: {f"__{c}{i}": (F.lag(s, -k).over(w) if k < 0 else F.lead(s, k).over(w)) for c, s in (("t", "__t"), ("v", "value")) for i, k in (("m", -1), ("1", 1), ("2", 2))}
    r = sliding(r, S, nb, 1, 2).filter(F.col("__t1").isNotNull())
    lo = F.ceil((F.col("__t") - F.col("__t0")) / F.lit(step)).cast("bigint")
    hi = F.floor((F.col("__t1") - F.col("__t0") - F.when(F.col("__t2").isNull(), 0).otherwise(1)) / F.lit(step)).cast("bigint")
    r = r.filter(lo <= hi).withColumn("grid", F.explode(F.sequence(lo, hi)))
    g = F.col("__t0") + F.col("grid") * step
    h = F.col("__t1") - F.col("__t")
    s = (g - F.col("__t")) / h
    v0, v1 = F.col("value"), F.col("__v1")
    m0 = F.coalesce((v1 - F.col("__vm")) / (F.col("__t1") - F.col("__tm")), (v1 - v0) / h) * h
    m1 = F.coalesce((F.col("__v2") - v0) / (F.col("__t2") - F.col("__t")), (v1 - v0) / h) * h
    v = (2 * s * s * s - 3 * s * s + 1) * v0 + (s * s * s - 2 * s * s + s) * m0 + (3 * s * s - 2 * s * s * s) * v1 + (s * s * s - s * s) * m1
    return r.select(*S, F.timestamp_micros(g).alias("ts"), (F.col("grid") + 1).alias("seq"), v.alias("value"))


def signal_workflow(df: DataFrame, cutoff=0.2) -> DataFrame:
    """Detrend, filter, window, transform, peaks, density, reconstruction;
    long rows (series_id, stage, item, value)."""
    d = detrend(df).select(*S, "ts", "seq", F.col("detrended").alias("value"))
    f = cut_lineage(fir_filter(d, "lowpass", cutoff).select(*S, "ts", "seq", F.col("filtered").alias("value")))
    w = window_apply(f, "hanning").select(*S, "ts", "seq", F.col("windowed").alias("value"))
    w = cut_lineage(w)
    spec = cut_lineage(fft(w))
    long = lambda x, stage, item, value: x.select(*S, F.lit(stage).alias("stage"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    st = spectral_stats(spec)
    parts = [long(dominant_frequencies(spec, 5), "peaks", "magnitude_rank", "frequency_hz"), long(spectral_density(f), "density", "bin", "density"),
             long(st, "centroid", "signal_character", "spectral_centroid_hz"), long(st, "rolloff", "signal_character", "rolloff95_hz"),
             long(reconstruction_error(w, ifft(spec)).withColumn("item", F.lit("max_error")), "reconstruction", "item", "max_error")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

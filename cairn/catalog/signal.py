"""Queries of the signal operators."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.catalog.relational import HOURLY
from cairn.catalog.series import D, days, hours
from cairn.functions.expr import rnd
from cairn.operators import series as ts, signal as sg

H = "WITH " + HOURLY
W = "(PARTITION BY series_id ORDER BY seq)"


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


def months(t):
    """Monthly quantity per return flag: short series, so the definition of
    the transform stays cheap in plain SQL."""
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("value"))
    return ts.series_prepare(m)


M = """WITH mon AS (SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate) AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 1,2),
ser AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS seq, count(*) OVER (PARTITION BY series_id) AS n FROM mon)"""
FT = M + """, k AS (SELECT series_id, n, unnest(range(0, n)) AS bin FROM (SELECT DISTINCT series_id, n FROM ser)),
sp AS (SELECT k.series_id, k.bin, k.n, sum(value*cos(-2*pi()*((bin*(seq-1)) % k.n)/k.n)) AS re, sum(value*sin(-2*pi()*((bin*(seq-1)) % k.n)/k.n)) AS im FROM k JOIN ser USING (series_id) GROUP BY 1,2,3),
pos AS (SELECT *, sqrt(re*re+im*im) AS mag, bin/n AS f FROM sp WHERE bin*2<=n)"""
PAD = M + """, z AS (SELECT DISTINCT series_id, pow(2, ceil(log2(n)))::BIGINT AS n FROM ser), k AS (SELECT series_id, n, unnest(range(0, n)) AS bin FROM z),
sp AS (SELECT k.series_id, k.bin, k.n, sum(value*cos(-2*pi()*((bin*(seq-1)) % k.n)/k.n)) AS re, sum(value*sin(-2*pi()*((bin*(seq-1)) % k.n)/k.n)) AS im FROM k JOIN ser USING (series_id) GROUP BY 1,2,3)"""


@query("sp01_signal_prepare", H + """, s AS (SELECT series_id, avg(value) AS m, stddev(value) AS s, quantile_cont(value,.25) AS a, quantile_cont(value,.75) AS b, count(*) AS n FROM ser GROUP BY 1)
 SELECT series_id, seq, n, round(value-m,8) AS demeaned, round((value-m)/s,8) AS normalized, round(greatest(least(value,b+1.5*(b-a)),a-1.5*(b-a)),8) AS cleaned, pow(2,floor(log2(n)))::BIGINT AS size_floor, pow(2,ceil(log2(n)))::BIGINT AS size_ceiling FROM ser JOIN s USING (series_id)""")
def _(t):
    return r(sg.signal_prepare(hours(t)), 8, "demeaned", "normalized", "cleaned").drop("ts", "value")


@query("sp02_fft", PAD + " SELECT series_id, bin, n, round(re,5) AS real, round(im,5) AS imag FROM sp")
def _(t):
    return r(sg.fft(months(t)), 5, "real", "imag")


@query("sp02_fft_magnitude_phase", FT + " SELECT series_id, bin, n, round(sqrt(re*re+im*im)/n,7) AS magnitude FROM sp")
def _(t):
    return r(sg.fft_format(sg.fft(months(t), pad=False), "MAGNITUDE_PHASE", True), 7, "magnitude").drop("phase_degrees")


@query("sp02_fft_hourly", H + """, z AS (SELECT series_id, pow(2,ceil(log2(max(seq))))::BIGINT AS n FROM ser GROUP BY 1), b AS (SELECT series_id, n, unnest(range(n)) AS bin FROM z)
 SELECT b.series_id, bin, n, round(sum(value*cos(2*pi()*((bin*(seq-1))%n)/n)),4) AS real, round(-sum(value*sin(2*pi()*((bin*(seq-1))%n)/n)),4) AS imag FROM b JOIN ser USING (series_id) GROUP BY 1,2,3""")
def _(t):
    return r(sg.fft(hours(t)), 4, "real", "imag")


def _bins(n, upto):
    """Magnitudes by definition of the first ``n`` samples of the daily series, by pairs of a bin and a sample."""
    return D + f""", z AS (SELECT series_id, {n} AS n FROM ser GROUP BY 1), b AS (SELECT series_id, n, unnest(range(n)) AS bin FROM z),
 sp AS (SELECT b.series_id, bin, n, sum(value*cos(2*pi()*((bin*(seq-1))%n)/n)) AS re, -sum(value*sin(2*pi()*((bin*(seq-1))%n)/n)) AS im FROM b JOIN ser USING (series_id) WHERE {upto} GROUP BY 1,2,3)
 SELECT series_id, bin, n, round(sqrt(re*re+im*im)/n,3) AS magnitude FROM sp"""


@query("sp02_fft_any_length", _bins("max(seq)", "true"))
def _(t):
    return r(sg.fft_format(sg.fft(days(t), pad=False), "MAGNITUDE", True), 3, "magnitude")


@query("sp02_fft_given_size", _bins("1100", "seq <= 1100"))
def _(t):
    return r(sg.fft_format(sg.fft(days(t), size=1100), "MAGNITUDE", True), 3, "magnitude")


@query("sp04_ifft_any_length", D + " SELECT series_id, seq, round(value,3) AS value FROM ser")
def _(t):
    return r(sg.ifft(sg.fft(days(t), pad=False)), 3, "value")


@query("sp03_dfft", FT + " SELECT series_id, bin, n, round(re,5) AS real, round(im,5) AS imag FROM sp")
def _(t):
    return r(sg.dft(months(t)), 5, "real", "imag")


@query("sp04_ifft", M + " SELECT series_id, seq, round(value,5) AS value FROM ser")
def _(t):
    return r(sg.ifft(sg.fft(months(t), pad=False)), 5, "value")


@query("sp04_idfft", M + " SELECT series_id, seq, round(value,5) AS value FROM ser")
def _(t):
    return r(sg.idft(sg.dft(months(t))), 5, "value")


@query("sp05_spectrum_polar", FT + " SELECT series_id, bin, round(mag,5) AS magnitude, round(re*re+im*im,1) AS power, round(f,9) AS frequency_hz FROM pos")
def _(t):
    p = sg.one_sided(sg.dft(months(t)))
    return r(r(r(p, 5, "magnitude"), 1, "power"), 9, "frequency_hz").select("series_id", "bin", "magnitude", "power", "frequency_hz")


@query("sp05_polar_round_trip", FT + " SELECT series_id, bin, round(re,5) AS real, round(im,5) AS imag FROM sp")
def _(t):
    p = sg.polar_to_complex(sg.spectrum_polar(sg.dft(months(t))).drop("real", "imag"))
    return r(p, 5, "real", "imag").select("series_id", "bin", "real", "imag")


@query("sp06_spectrum_filter", FT + ", e AS (SELECT series_id, sum(re*re+im*im) AS t, sum(re*re+im*im) FILTER (least(bin,n-bin) BETWEEN 1 AND 5) AS k FROM sp GROUP BY 1) SELECT series_id, round(k/t*1e6,5) AS kept_ppm, round(100-100.0*k/t,8) AS removed_pct FROM e")
def _(t):
    s = sg.dft(months(t))
    e = sg.energy_removed(s, sg.spectrum_filter(s, drop_dc=True, max_bin=5))
    return e.select("series_id", rnd(F.col("kept_energy") / F.col("total_energy") * 1e6, 5).alias("kept_ppm"), rnd("removed_pct", 8).alias("removed_pct"))


@query("sp07_spectrum_validate", FT + " SELECT series_id, count(*) AS total_bins, max(n) AS expected_bins, 100.0::DOUBLE AS hermitian_pct, 100.0::DOUBLE AS completeness_pct, 'REAL' AS recommended_output FROM sp GROUP BY 1")
def _(t):
    return sg.spectrum_validate(sg.dft(months(t))).drop("max_phase_jump", "phase_wraps", "phase_recommendation")


_BAND = "CASE WHEN f=0 THEN 'DC Component' WHEN f<.1 THEN 'Very Low Frequency (<0.1 Hz)' ELSE 'Low Frequency (0.1-1 Hz)' END"


@query("sp08_dominant_frequencies", FT + f""", t AS (SELECT series_id, sum(mag) AS t, arg_max(f, mag) FILTER (bin>0) AS f0 FROM pos GROUP BY 1), q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mag DESC, bin) AS rk FROM pos WHERE bin>0)
 SELECT q.series_id, rk AS magnitude_rank, bin, round(f,9) AS frequency_hz, round(1/f,8) AS period_seconds, round(mag,4) AS magnitude, round(20*log10(mag),7) AS power_db, round(mag/t*100,8) AS relative_power_pct, {_BAND} AS frequency_band, round(f/f0,8) AS harmonic_number, CASE WHEN abs(f/f0-round(f/f0))<.05 THEN 'Harmonic' ELSE 'Independent' END AS component_type FROM q JOIN t ON q.series_id=t.series_id WHERE rk<=10""")
def _(t):
    d = sg.dominant_frequencies(sg.dft(months(t)))
    return r(r(r(r(d, 9, "frequency_hz"), 8, "period_seconds", "relative_power_pct", "harmonic_number"), 4, "magnitude"), 7, "power_db")


@query("sp09_band_power", FT + f" SELECT series_id, {_BAND} AS frequency_band, count(*) AS components, round(min(f),9) AS start_hz, round(max(f),9) AS end_hz, round(sum(mag),3) AS total_magnitude, round(avg(mag),4) AS avg_magnitude, round(max(mag),4) AS peak_magnitude, round(avg(re*re+im*im),1) AS avg_energy_density, round(100.0*sum(mag)/sum(sum(mag)) OVER (PARTITION BY series_id),7) AS power_pct FROM pos WHERE bin>0 GROUP BY 1,2")
def _(t):
    b = sg.band_power(sg.dft(months(t)))
    return r(r(r(r(r(b, 9, "start_hz", "end_hz"), 3, "total_magnitude"), 4, "avg_magnitude", "peak_magnitude"), 1, "avg_energy_density"), 7, "power_pct")


@query("sp09_low_frequency_share", FT + " SELECT series_id, round(100.0*sum(CASE WHEN bin<=5 THEN re*re+im*im ELSE 0 END)/sum(re*re+im*im),7) AS low_frequency_pct FROM pos WHERE bin>0 GROUP BY 1")
def _(t):
    return r(sg.low_frequency_share(sg.dft(months(t)), 5), 7, "low_frequency_pct")


@query("sp09_cumulative_power", FT + " SELECT series_id, bin, round(100.0*sum(mag) OVER (PARTITION BY series_id ORDER BY bin)/sum(mag) OVER (PARTITION BY series_id),7) AS cumulative_power_pct FROM pos")
def _(t):
    return r(sg.cumulative_power(sg.dft(months(t))), 7, "cumulative_power_pct").select("series_id", "bin", "cumulative_power_pct")


_ST = FT + """, c AS (SELECT *, 100.0*sum(mag) OVER (PARTITION BY series_id ORDER BY bin)/sum(mag) OVER (PARTITION BY series_id) AS cp FROM pos),
 st AS (SELECT series_id, sum(f*mag) FILTER (bin>0)/sum(mag) FILTER (bin>0) AS ce, sum(f*f*mag) FILTER (bin>0)/sum(mag) FILTER (bin>0) AS q, min(f) FILTER (cp>=95) AS ro, exp(avg(ln(mag)) FILTER (bin>0))/avg(mag) FILTER (bin>0) AS fl,
  max(f) FILTER (cp BETWEEN 5 AND 95)-min(f) FILTER (cp BETWEEN 5 AND 95) AS bw, max(mag) FILTER (bin>0)/avg(mag) FILTER (bin>0) AS pk FROM c GROUP BY 1)"""


@query("sp10_spectral_stats", _ST + " SELECT series_id, round(ce,8) AS spectral_centroid_hz, round(sqrt(q-ce*ce),8) AS spectral_spread_hz, round(ro,9) AS rolloff95_hz, round(fl,8) AS spectral_flatness, round(bw,9) AS bandwidth90_hz, round(pk,7) AS peak_to_avg_ratio, CASE WHEN fl>.8 THEN 'Noise-like signal' WHEN fl>.5 THEN 'Mixed signal (tones + noise)' WHEN fl>.2 THEN 'Tonal signal with some noise' ELSE 'Highly tonal signal' END AS signal_character FROM st")
def _(t):
    s = sg.spectral_stats(sg.dft(months(t)))
    return r(r(r(s, 8, "spectral_centroid_hz", "spectral_spread_hz", "spectral_flatness"), 9, "rolloff95_hz", "bandwidth90_hz"), 7, "peak_to_avg_ratio")


_HM = lambda k: f"(SELECT series_id, f, mag FROM (SELECT p.series_id, p.f, p.mag, row_number() OVER (PARTITION BY p.series_id ORDER BY abs(p.f-{k}*f0.f), p.bin) AS rn FROM pos p JOIN f0 ON p.series_id=f0.series_id WHERE p.bin>0 AND abs(p.f-{k}*f0.f)<=0.1*f0.f) WHERE rn=1)"


@query("sp11_harmonics", FT + f""", f0 AS (SELECT series_id, arg_max(f,mag) AS f, max(mag) AS mag FROM pos WHERE bin>0 GROUP BY 1) SELECT f0.series_id, round(f0.f,9) AS fundamental_hz, round(f0.mag,4) AS fundamental_magnitude, round(a.f,9) AS second_hz, round(a.mag,4) AS second_magnitude, round(b.f,9) AS third_hz, round(b.mag,4) AS third_magnitude,
 round(sqrt(pow(coalesce(a.mag,0),2)+pow(coalesce(b.mag,0),2))/f0.mag*100,6) AS thd_percent, CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL THEN 'Strong harmonic series detected' WHEN a.f IS NOT NULL THEN 'Harmonic series partially present' ELSE 'No clear harmonics' END AS harmonic_pattern
 FROM f0 LEFT JOIN {_HM(2)} a ON a.series_id=f0.series_id LEFT JOIN {_HM(3)} b ON b.series_id=f0.series_id""")
def _(t):
    h = sg.harmonics(sg.dft(months(t)))
    return r(r(r(h, 9, "fundamental_hz", "second_hz", "third_hz"), 4, "fundamental_magnitude", "second_magnitude", "third_magnitude"), 6, "thd_percent")


@query("sp12_snr", FT + """, q AS (SELECT series_id, 20*log10(mag) AS db, row_number() OVER (PARTITION BY series_id ORDER BY mag DESC, bin) AS rk, count(*) OVER (PARTITION BY series_id) AS k FROM pos), a AS (SELECT series_id, avg(db) FILTER (rk<=5) AS s, avg(db) FILTER (rk>k/2) AS nf, max(db)-min(db) AS d FROM q GROUP BY 1)
 SELECT series_id, round(s,6) AS signal_power_db, round(nf,6) AS noise_floor_db, round(d,6) AS dynamic_range_db, round(s-nf,6) AS snr_db, round((d-1.76)/6.02,6) AS effective_bits, CASE WHEN s-nf>40 THEN 'Excellent (>40 dB)' WHEN s-nf>30 THEN 'Very Good (30-40 dB)' WHEN s-nf>20 THEN 'Good (20-30 dB)' WHEN s-nf>10 THEN 'Fair (10-20 dB)' ELSE 'Poor (<10 dB)' END AS snr_quality FROM a""")
def _(t):
    return r(sg.snr(sg.dft(months(t))), 6, "signal_power_db", "noise_floor_db", "dynamic_range_db", "snr_db", "effective_bits")


@query("sp13_spectral_anomalies", _ST + ", m AS (SELECT series_id, avg(mag) AS m, stddev(mag) AS s FROM pos GROUP BY 1) SELECT p.series_id, bin, round(f,9) AS frequency_hz, round(mag,4) AS magnitude, CASE WHEN mag>m+3*s THEN 'Outlier: Unusually strong component' WHEN f NOT BETWEEN ce-sqrt(q-ce*ce) AND ce+sqrt(q-ce*ce) THEN 'Anomaly: Unexpected frequency peak' ELSE 'Normal' END AS anomaly_type FROM pos p JOIN m ON p.series_id=m.series_id JOIN st ON p.series_id=st.series_id WHERE mag>m+2*s")
def _(t):
    return r(r(sg.spectral_anomalies(sg.dft(months(t))), 9, "frequency_hz"), 4, "magnitude")


@query("sp13_dc_analysis", FT + ", a AS (SELECT series_id, max(mag) FILTER (bin=0) AS d, sum(mag) AS t, avg(mag) FILTER (bin>0) AS a FROM pos GROUP BY 1) SELECT series_id, round(d,4) AS dc_magnitude, round(d/t*100,7) AS dc_percentage, CASE WHEN d>2*a THEN 'Strong DC bias - Signal has significant mean offset' WHEN d>a THEN 'Moderate DC component - Signal has mean offset' ELSE 'Minimal DC - Signal well-centered around zero' END AS dc_interpretation FROM a")
def _(t):
    return r(r(sg.dc_analysis(sg.dft(months(t))), 4, "dc_magnitude"), 7, "dc_percentage")


@query("sp14_parseval", H + " SELECT series_id, round(sum(value*value),2) AS time_energy, round(sum(value*value),2) AS frequency_energy, 'PASS' AS status FROM ser GROUP BY 1")
def _(t):
    h = hours(t)
    return r(sg.parseval_check(h, sg.fft(h)), 2, "time_energy", "frequency_energy").drop("relative_error")


@query("sp14_reconstruction_error", H + " SELECT series_id, count(*) AS n, 1 AS exact FROM ser GROUP BY 1")
def _(t):
    h = hours(t)
    e = sg.reconstruction_error(h, sg.ifft(sg.fft(h)))
    return e.select("series_id", "n", (F.col("max_error") < 1e-8).cast("int").alias("exact"))


def _i0(z):
    """The Bessel function I0 by its series."""
    return f"list_sum([pow(({z})*({z})/4.0, j)/pow(gamma(j+1), 2) for j in range(0, 40)])"


def _welch(size, step, win, center, line=False):
    x = f"(i/{size - 1}.0)"
    wt = {"hanning": f"(0.5-0.5*cos(2*pi()*{x}))", "rectangular": "1.0::DOUBLE", "kaiser": "(" + _i0(f"8.6*sqrt(greatest(1-(2*{x}-1)*(2*{x}-1),0))") + "/" + _i0("8.6") + ")"}[win]
    part = "OVER (PARTITION BY series_id, g)"
    d = f"v - avg(v) {part}" if center else "v"
    if line:
        d += f" - regr_slope(v, i) {part} * (i - avg(i) {part})"
    return H + f""", n AS (SELECT series_id, max(seq) AS n FROM ser GROUP BY 1), sg AS (SELECT series_id, unnest(range(0, ((n-{size})//{step})+1)) AS g FROM n WHERE n>={size}),
 s AS (SELECT sg.series_id, g, seq-1-g*{step} AS i, value AS v FROM sg JOIN ser ON ser.series_id=sg.series_id AND seq-1 BETWEEN g*{step} AND g*{step}+{size - 1}), c AS (SELECT series_id, g, i, ({d})*1.0 AS v FROM s), w AS (SELECT series_id, g, i, v*{wt} AS v FROM c),
 sc AS (SELECT sum({wt}*{wt}) AS u FROM range({size}) r(i)), k AS (SELECT unnest(range(0,{size // 2 + 1})) AS bin), y AS (SELECT series_id, g, bin, sum(v*cos(2*pi()*((bin*i)%{size})/{size}.0)) AS a, sum(v*sin(2*pi()*((bin*i)%{size})/{size}.0)) AS b FROM w, k GROUP BY 1,2,3)
 SELECT series_id, bin::INT AS bin, round(avg(CASE WHEN bin BETWEEN 1 AND {(size + 1) // 2 - 1} THEN 2 ELSE 1 END*(a*a+b*b)/u),5) AS {'density' if center else 'power'}, count(*) AS segments, round(bin/{size}.0,9) AS frequency_hz FROM y, sc GROUP BY series_id, bin"""


@query("sp15_power_spectrum", _welch(64, 64, "rectangular", False))
def _(t):
    return r(r(sg.power_spectrum(hours(t)), 5, "power"), 9, "frequency_hz")


@query("sp16_spectral_density", _welch(64, 32, "hanning", True))
def _(t):
    return r(r(sg.spectral_density(hours(t)), 5, "density"), 9, "frequency_hz")


@query("sp16_spectral_density_linear", _welch(64, 32, "hanning", True, True))
def _(t):
    return r(r(sg.spectral_density(hours(t), detrend="linear"), 5, "density"), 9, "frequency_hz")


@query("sp16_spectral_density_kaiser", _welch(64, 32, "kaiser", True))
def _(t):
    return r(r(sg.spectral_density(hours(t), kind="kaiser"), 5, "density"), 9, "frequency_hz")


_WX = {"rectangular": "1.0::DOUBLE", "hamming": "0.54-0.46*cos(2*pi()*x)", "hanning": "0.5-0.5*cos(2*pi()*x)", "blackman": "0.42-0.5*cos(2*pi()*x)+0.08*cos(4*pi()*x)"}
for _k, _e in _WX.items():
    @query(f"sp17_window_{_k}", H + f", w AS (SELECT *, (seq-1)/(count(*) OVER (PARTITION BY series_id)-1) AS x FROM ser) SELECT series_id, seq, round({_e},9) AS weight, round(value*({_e}),8) AS windowed FROM w")
    def _(t, k=_k):
        return r(r(sg.window_apply(hours(t), k), 9, "weight"), 8, "windowed").drop("ts", "value")


_KW = _i0("8.6*sqrt(greatest(1-(2*x-1)*(2*x-1),0))") + "/" + _i0("8.6")


@query("sp17_window_kaiser", H + f", w AS (SELECT *, (seq-1)/(count(*) OVER (PARTITION BY series_id)-1) AS x FROM ser), k AS (SELECT series_id, seq, value, {_KW} AS k FROM w), m AS (SELECT *, k/avg(k) OVER (PARTITION BY series_id) AS weight FROM k) SELECT series_id, seq, round(weight,9) AS weight, round(value*weight,7) AS windowed FROM m")
def _(t):
    return r(r(sg.window_apply(hours(t), "kaiser", normalise=True), 9, "weight"), 7, "windowed").drop("ts", "value")


@query("sp18_leakage_risk", H + """, a AS (SELECT series_id, arg_min(value,seq) AS f, arg_max(value,seq) AS l, stddev(value) AS s, avg(value) AS m, max(value) AS x, min(value) AS mn, count(*) AS n FROM ser GROUP BY 1), b AS (SELECT series_id, n, abs(f-l)/s AS e, s/(greatest(abs(x-m),abs(mn-m))+0.0001) AS c FROM a)
 SELECT series_id, n AS sample_count, round(e,8) AS end_mismatch, round(c,8) AS spectral_concentration, CASE WHEN e>1 THEN 'High leakage risk' WHEN e>.3 THEN 'Moderate leakage risk' ELSE 'Low leakage risk' END AS leakage_risk, CASE WHEN c>.8 THEN 'Rectangular' WHEN c>.6 THEN 'Hamming' WHEN c>.4 THEN 'Hanning' ELSE 'Blackman' END AS recommended_window FROM b""")
def _(t):
    return r(sg.leakage_risk(hours(t)), 8, "end_mismatch", "spectral_concentration")


def _conv(taps):
    h = (len(taps) - 1) // 2
    parts = []
    for i, c in enumerate(taps):
        o = h - i
        v = "value" if o == 0 else (f"lead(value,{o}) OVER w" if o > 0 else f"lag(value,{-o}) OVER w")
        parts.append(f"coalesce({v}*({float(c)!r}::DOUBLE),0)")
    return "+".join(parts)


def _fir(kind, cutoff):
    """A moving sum with taps by the formula of a windowed sinc of order 20."""
    sinc = lambda fc: f"(CASE WHEN i=10 THEN 2*{fc} ELSE sin(2*pi()*{fc}*(i-10))/(pi()*(i-10)) END)*(0.54+0.46*cos(2*pi()*(i-10)/20.0))"
    low = lambda name, fc: f"{name} AS (SELECT i, h/sum(h) OVER () AS h FROM (SELECT i, {sinc(fc)} AS h FROM range(21) t(i)))"
    delta = "(CASE WHEN x.i=10 THEN 1 ELSE 0 END)"
    if kind in ("lowpass", "highpass"):
        parts, tap = low("x", cutoff), "x.h" if kind == "lowpass" else f"{delta}-x.h"
        taps = f"SELECT x.i, {tap} AS h FROM x"
    else:
        parts, tap = low("x", cutoff[0]) + ", " + low("y", cutoff[1]), "y.h-x.h" if kind == "bandpass" else f"{delta}-(y.h-x.h)"
        taps = f"SELECT x.i, {tap} AS h FROM x JOIN y USING (i)"
    return H + f", {parts}, tp AS ({taps}) SELECT a.series_id, a.seq, round(sum(tp.h*b.value),7) AS filtered FROM ser a JOIN ser b ON a.series_id=b.series_id AND b.seq BETWEEN a.seq-10 AND a.seq+10 JOIN tp ON tp.i=a.seq-b.seq+10 GROUP BY 1,2"


for _k, _c in {"lowpass": 0.1, "highpass": 0.1, "bandpass": (0.05, 0.2), "bandstop": (0.05, 0.2)}.items():
    @query(f"sp19_filter_{_k}", _fir(_k, _c))
    def _(t, k=_k, c=_c):
        return r(sg.fir_filter(hours(t), k, c), 7, "filtered").drop("ts", "value")


def _biquad(source, to, cutoff, kind, damping="sqrt(2.0)"):
    """One second-order section as a recursion over the positions of a series."""
    b = ("w*w*q", "2*w*w*q", "w*w*q") if kind == "lowpass" else ("q", "-2*q", "q")
    return f""", {to}_c AS (SELECT {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2, 2*(w*w-1)*q AS a1, (1-d*w+w*w)*q AS a2 FROM (SELECT w, d, 1/(1+d*w+w*w) AS q FROM (SELECT tan(pi()*{cutoff}) AS w, {damping} AS d))),
 {to} AS (SELECT series_id, seq, b0*value AS value, (b1-a1*b0)*value AS s1, (b2-a2*b0)*value AS s2 FROM {source}, {to}_c WHERE seq=1
 UNION ALL SELECT x.series_id, x.seq, b0*x.value+y.s1, b1*x.value-a1*(b0*x.value+y.s1)+y.s2, b2*x.value-a2*(b0*x.value+y.s1) FROM {to} y JOIN {source} x ON x.series_id=y.series_id AND x.seq=y.seq+1, {to}_c)"""


_HR = H.replace("WITH ", "WITH RECURSIVE ", 1)
_BW = {"": (0.1, "lowpass", 2, _biquad("ser", "f", 0.1, "lowpass") + " SELECT series_id, seq, round(value,7) AS filtered FROM f"),
       "_highpass": (0.1, "highpass", 2, _biquad("ser", "f", 0.1, "highpass") + " SELECT series_id, seq, round(value,7) AS filtered FROM f"),
       "_bandpass": ((0.05, 0.2), "bandpass", 2, _biquad("ser", "e", 0.05, "highpass") + _biquad("e", "f", 0.2, "lowpass") + " SELECT series_id, seq, round(value,7) AS filtered FROM f"),
       "_bandstop": ((0.05, 0.2), "bandstop", 2, _biquad("ser", "e", 0.05, "lowpass") + _biquad("ser", "f", 0.2, "highpass") + " SELECT series_id, seq, round(e.value+f.value,7) AS filtered FROM e JOIN f USING (series_id, seq)"),
       "_order4": (0.1, "lowpass", 4, _biquad("ser", "e", 0.1, "lowpass", "2*sin(pi()/8)") + _biquad("e", "f", 0.1, "lowpass", "2*sin(3*pi()/8)") + " SELECT series_id, seq, round(value,7) AS filtered FROM f")}
for _k, (_c, _b, _o, _s) in _BW.items():
    @query(f"sp19_filter_butterworth{_k}", _HR + _s)
    def _(t, c=_c, b=_b, o=_o):
        return r(sg.butterworth(hours(t), c, kind=b, order=o), 7, "filtered").drop("ts", "value")


@query("sp20_filter_recommend", H + f""", d AS (SELECT *, value-lag(value) OVER {W} AS d, (epoch_us(ts)-epoch_us(lag(ts) OVER {W}))/1e6 AS g FROM ser), a AS (SELECT series_id, abs(avg(value))/stddev(value) AS dc, stddev(d)/stddev(value) AS nr, 0.5/avg(g) AS ny FROM d GROUP BY 1)
 SELECT series_id, round(dc,8) AS dc_ratio, round(nr,8) AS noise_ratio, round(ny,12) AS nyquist_hz, CASE WHEN dc>1 AND nr>1 THEN 'bandpass' WHEN dc>1 THEN 'highpass' ELSE 'lowpass' END AS recommended_filter, round(ny*.1,12) AS cutoff_10pct_hz, round(ny*.3,12) AS cutoff_30pct_hz, round(ny*.5,12) AS cutoff_50pct_hz FROM a""")
def _(t):
    return r(r(sg.filter_recommend(hours(t)), 8, "dc_ratio", "noise_ratio"), 12, "nyquist_hz", "cutoff_10pct_hz", "cutoff_30pct_hz", "cutoff_50pct_hz")


KERNEL = [0.05, 0.25, 0.4, 0.25, 0.05]


@query("sp21_convolve_same", H + f" SELECT series_id, seq, round({_conv(KERNEL)},8) AS convolved FROM ser WINDOW w AS {W}")
def _(t):
    return r(sg.convolve(hours(t), KERNEL), 8, "convolved").drop("ts", "value")


_CF = H + ", k AS (SELECT unnest([0,1,2]) AS i, unnest([1.0,0.5,-0.25]) AS c), f AS (SELECT series_id, seq+i AS seq, sum(value*c) AS v FROM ser, k GROUP BY 1,2)"


@query("sp21_convolve_full", _CF + " SELECT series_id, seq, round(v,8) AS convolved FROM f")
def _(t):
    return r(sg.convolve(hours(t), [1.0, 0.5, -0.25], "full"), 8, "convolved")


@query("sp21_convolve_valid", _CF + ", n AS (SELECT series_id, max(seq) AS n FROM ser GROUP BY 1) SELECT f.series_id, seq-2 AS seq, round(v,8) AS convolved FROM f JOIN n ON f.series_id=n.series_id WHERE seq BETWEEN 3 AND n")
def _(t):
    return r(sg.convolve(hours(t), [1.0, 0.5, -0.25], "valid"), 8, "convolved")


def pair(t):
    """Every pair of event types, hour by hour."""
    h = ts.hourly_means(t.events)
    x = h.select("ts", F.col("series_id").alias("a"), F.col("value").alias("x"))
    y = h.select("ts", F.col("series_id").alias("b"), F.col("value").alias("y"))
    from cairn.plans.ordered import sequence
    both = x.join(y, "ts").filter("a < b").select(F.concat_ws("-", "a", "b").alias("series_id"), "ts", "x", "y")
    return sequence(both, ["series_id"], ["ts"])


_PAIR = H + ", pr AS (SELECT a.series_id || '-' || b.series_id AS p, a.value AS x, b.value AS y, row_number() OVER (PARTITION BY a.series_id, b.series_id ORDER BY a.ts) AS seq FROM hourly a JOIN hourly b ON a.ts=b.ts AND a.series_id<b.series_id), lg AS (SELECT a.p, (b.seq-a.seq)::INT AS lag, corr(a.x,b.y) AS c FROM pr a JOIN pr b ON a.p=b.p AND b.seq-a.seq BETWEEN -10 AND 10 GROUP BY 1,2)"


@query("sp22_cross_correlate", _PAIR + " SELECT p AS series_id, lag, round(c,8) AS correlation FROM lg")
def _(t):
    return r(sg.cross_correlate(pair(t)), 8, "correlation")


@query("sp22_delay_at_peak", _PAIR + " SELECT p AS series_id, lag AS delay, round(c,8) AS peak FROM lg QUALIFY row_number() OVER (PARTITION BY p ORDER BY round(abs(c),12) DESC, abs(lag), lag) = 1")
def _(t):
    return r(sg.delay_at_peak(sg.cross_correlate(pair(t))), 8, "peak")


@query("sp23_detrend_linear", H + ", f AS (SELECT series_id, regr_slope(value,seq) AS b, regr_intercept(value,seq) AS a FROM ser GROUP BY 1) SELECT series_id, seq, round(a+b*seq,7) AS trend, round(value-a-b*seq,7) AS detrended FROM ser JOIN f USING (series_id)")
def _(t):
    return r(sg.detrend(hours(t)), 7, "trend", "detrended").select("series_id", "seq", "trend", "detrended")


@query("sp23_detrend_breaks", H + ", g AS (SELECT *, (seq>300)::INT AS sg FROM ser), f AS (SELECT series_id, sg, regr_slope(value,seq) AS b, regr_intercept(value,seq) AS a FROM g GROUP BY 1,2) SELECT g.series_id, seq, round(value-a-b*seq,7) AS detrended FROM g JOIN f ON g.series_id=f.series_id AND g.sg=f.sg")
def _(t):
    return r(sg.detrend(hours(t), breakpoints=(300,)), 7, "detrended").select("series_id", "seq", "detrended")


# in centred time the even and the odd powers part, two equations each
@query("sp23_detrend_polynomial", H + """, m AS (SELECT series_id, (min(seq)+max(seq))/2.0 AS c, (max(seq)-min(seq))/2.0 AS h FROM ser GROUP BY 1), u AS (SELECT series_id, seq, value, (seq-c)/h AS u FROM ser JOIN m USING (series_id)),
 s AS (SELECT series_id, count(*) AS n, sum(u*u) AS s2, sum(pow(u,4)) AS s4, sum(pow(u,6)) AS s6, sum(value) AS y0, sum(value*u) AS y1, sum(value*u*u) AS y2, sum(value*pow(u,3)) AS y3 FROM u GROUP BY 1),
 f AS (SELECT series_id, (y0*s4-y2*s2)/(n*s4-s2*s2) AS b0, (n*y2-s2*y0)/(n*s4-s2*s2) AS b2, (y1*s6-y3*s4)/(s2*s6-s4*s4) AS b1, (s2*y3-s4*y1)/(s2*s6-s4*s4) AS b3 FROM s)
 SELECT series_id, seq, round(b0+b1*u+b2*u*u+b3*pow(u,3),6) AS trend, round(value-(b0+b1*u+b2*u*u+b3*pow(u,3)),6) AS detrended FROM u JOIN f USING (series_id)""")
def _(t):
    return r(sg.detrend(hours(t), "polynomial", 3), 6, "trend", "detrended").select("series_id", "seq", "trend", "detrended")


@query("sp23_trend_detect", H + " SELECT series_id, round(regr_slope(value,seq),9) AS slope, round(regr_r2(value,seq),9) AS r2, CASE WHEN regr_r2(value,seq)>.7 THEN 'Strong linear trend' WHEN regr_r2(value,seq)>.3 THEN 'Moderate linear trend' ELSE 'Weak or no linear trend' END AS trend_strength FROM ser GROUP BY 1")
def _(t):
    return r(sg.trend_detect(hours(t)), 9, "slope", "r2")


def _rs(kind):
    v = {"linear": "v0+coalesce((v1-v0)*(g-t0)/nullif(t1-t0,0),0)", "previous": "v0", "nearest": "CASE WHEN coalesce((g-t0)/nullif(t1-t0,0),0)>0.5 THEN v1 ELSE v0 END"}[kind]
    return H + f""", p AS (SELECT series_id, epoch_us(ts) AS t, value AS v FROM ser), b AS (SELECT series_id, min(t) AS lo, max(t) AS hi FROM p GROUP BY 1), gr AS (SELECT series_id, lo, unnest(range(0, (hi-lo)//2700000000+1)) AS k FROM b), q AS (SELECT series_id, k+1 AS seq, lo+k*2700000000 AS g FROM gr),
 iv AS (SELECT series_id, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT q.series_id, q.seq, q.g AS us, round({v},11) AS value FROM q JOIN iv ON iv.series_id=q.series_id AND g>=t0 AND (g<t1 OR t1 IS NULL)"""


for _k in ("linear", "previous", "nearest"):
    @query(f"sp24_resample_{_k}", _rs(_k))
    def _(t, k=_k):
        return sg.resample(hours(t), 2700.0, k).select("series_id", "seq", F.unix_micros("ts").alias("us"), rnd("value", 11).alias("value"))


@query("sp24_resample_cubic", H + f""", q AS (SELECT series_id, epoch_us(ts) AS t, value AS v0, lead(value) OVER {W} AS v1, lag(value) OVER {W} AS vm, lead(value,2) OVER {W} AS v2, lead(epoch_us(ts)) OVER {W} AS t1, lag(epoch_us(ts)) OVER {W} AS tm, lead(epoch_us(ts),2) OVER {W} AS t2, min(epoch_us(ts)) OVER (PARTITION BY series_id) AS t0 FROM ser),
 g AS (SELECT *, unnest(range(ceil((t-t0)/2700000000)::BIGINT, floor((t1-t0-CASE WHEN t2 IS NULL THEN 0 ELSE 1 END)/2700000000)::BIGINT+1)) AS k FROM q WHERE t1 IS NOT NULL),
 s AS (SELECT *, (t0+k*2700000000-t)/(t1-t) AS s, coalesce((v1-vm)/(t1-tm),(v1-v0)/(t1-t))*(t1-t) AS m0, coalesce((v2-v0)/(t2-t),(v1-v0)/(t1-t))*(t1-t) AS m1 FROM g)
 SELECT series_id, k+1 AS seq, (t0+k*2700000000)::BIGINT AS us, round((2*s*s*s-3*s*s+1)*v0+(s*s*s-2*s*s+s)*m0+(3*s*s-2*s*s*s)*v1+(s*s*s-s*s)*m1+1e-10,8) AS value FROM s""")
def _(t):
    return sg.resample_cubic(hours(t), 2700.0).select("series_id", "seq", F.unix_micros("ts").alias("us"), rnd(F.col("value") + 1e-10, 8).alias("value"))  # many values end in a tie


@query("sp25_fft_recommend", H + f""", d AS (SELECT *, (epoch_us(ts)-epoch_us(lag(ts) OVER {W}))/1e6 AS g FROM ser), a AS (SELECT series_id, count(*) AS n, avg(abs(value)) AS m, max(value)-min(value) AS rg, 1/avg(g) AS fs, pow(2,ceil(log2(count(*))))::BIGINT AS sz FROM d GROUP BY 1)
 SELECT series_id, n AS actual_samples, round(m,8) AS signal_magnitude, round(rg,8) AS magnitude_range, sz AS fft_size, sz-n AS padding_required, round(fs/sz,12) AS frequency_resolution_hz, round(fs/2,12) AS max_frequency_hz, CASE WHEN rg>1000 OR m>100 THEN 'TRUE' ELSE 'FALSE' END AS normalize,
 CASE WHEN sz=n THEN 'Optimal - No padding needed' WHEN sz-n<n*.1 THEN 'Good - Minimal padding' WHEN sz-n<n*.5 THEN 'Acceptable - Moderate padding' ELSE 'Poor - Consider collecting more samples' END AS padding_quality FROM a""")
def _(t):
    return r(r(sg.fft_recommend(hours(t)), 8, "signal_magnitude", "magnitude_range"), 12, "frequency_resolution_hz", "max_frequency_hz")


@query("sp26_signal_workflow")
def _(t):
    return sg.signal_workflow(hours(t))

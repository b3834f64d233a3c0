"""Queries of the signal kernels: filters, spectra, peaks, decomposition, ranging, live windows; with SQL where lists and sums can say the same.

The value of a user's events in time order is the signal, as if sampled at a constant rate. Every session has rows, however short it is, except
in `peaks`, where a session without a peak has none. Where a kernel needs more samples than there are, its docstring gives the rule.

In SQL a recursive filter is a fold over a list, its state at the head of the accumulator; a spectrum is a sum over sines and cosines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.functions.scalar import BANDS
from pulsegrid.operators import emg
from pulsegrid.plans.registry import IDX, KEYS, LISTS, Register, indexed
from pulsegrid.plans.row_queries import _scores

POINTS = "session_id long, i long, y double"
REGISTER = Register()
_query = REGISTER.query


# --- SQL of filters and spectra ---


def _list(values) -> str:
    """Numbers as a list of doubles."""
    return "[" + ", ".join(f"{x:.17e}" for x in values) + "]"


def _fold(x: str, b: np.ndarray, a: np.ndarray, start: str) -> str:
    """A list filtered from a state."""
    n = len(b) - 1
    y = f"({b[0]:.17e} * e[1] + s[1])"
    z = ", ".join(f"{b[i]:.17e} * e[1] - {a[i]:.17e} * {y}" + (f" + s[{i + 1}]" if i < n else "") for i in range(1, n + 1))
    return f"list_reduce(list_prepend({start}, list_transform({x}, lambda v: [v])), lambda s, e: [{z}] || s[{n + 1}:] || [{y}])[{n + 1}:]"


def _from_rest(x: str, b: np.ndarray, a: np.ndarray) -> str:
    """A list filtered from the steady state of its first value."""
    return _fold(x, b, a, f"list_transform({_list(dsp.steady_state(b, a))}, lambda z: z * {x}[1])")


def _zero_phase(source: str, name: str, b: np.ndarray, a: np.ndarray) -> str:
    """Tables up to `name`, with the lists x of `source` filtered forward and backward; short ones stay."""
    pad = 3 * max(len(a), len(b))
    left = f"list_transform(list_reverse(x[2:{pad + 1}]), lambda v: 2 * x[1] - v)"
    right = f"list_transform(list_reverse(x[len(x) - {pad} : len(x) - 1]), lambda v: 2 * x[len(x)] - v)"
    return f""", {name}_e AS (SELECT session_id, x, {left} || x || {right} AS e FROM {source} WHERE len(x) > {pad}),
 {name}_f AS (SELECT session_id, x, list_reverse({_from_rest("e", b, a)}) AS f FROM {name}_e),
 {name} AS (SELECT session_id, list_reverse({_from_rest("f", b, a)})[{pad + 1} : {pad} + len(x)] AS x FROM {name}_f
  UNION ALL SELECT session_id, x FROM {source} WHERE len(x) <= {pad})
"""


def _points(source: str, digits: int = 4) -> str:
    return f"SELECT session_id, unnest(range(0, len(x))) AS i, unnest(list_transform(x, lambda v: round(v, {digits}))) AS y FROM {source}"


def _spectrum(source: str, keys: str, fs: float, nfft: str = "n") -> str:
    """Tables up to `spec` (keys, k, f, p): Hann-windowed power densities of the lists `part` of `source`, n values each, without their means."""
    w = "(0.5e0 - 0.5e0 * cos(2 * pi() * j / n))"
    turn = lambda f: f"list_sum(list_transform(range(0, n), lambda j: (part[j + 1] - m) * {w} * {f}(2 * pi() * k * j / {nfft})))"
    return f""", means AS (SELECT *, list_sum(part) / n AS m, list_sum(list_transform(range(0, n), lambda j: {w} * {w})) AS ww FROM {source}),
 bins AS (SELECT *, unnest(range(0, {nfft} // 2 + 1)) AS k FROM means),
 spec AS (SELECT {keys}, n, k, k * (1 / ({nfft} * {1 / fs:.17e})) AS f, CASE WHEN k = 0 OR 2 * k = {nfft} THEN 1 ELSE 2 END * ({turn("cos")} ** 2 + {turn("sin")} ** 2) / ({fs:.17e} * ww) AS p FROM bins)
"""


def _bands(edges: dict[str, tuple[float, float]], keys: str, source: str = "spec") -> str:
    """Tables up to `powers` (keys, band, power, bins): trapezoids over the frequencies in each band, both edges included."""
    rows = ", ".join(f"('{b}', {low:.17e}, {high:.17e})" for b, (low, high) in edges.items())
    return f""", edges(band, low, high) AS (VALUES {rows}),
 inside AS (SELECT {keys}, band, f, p, lag(f) OVER w AS f0, lag(p) OVER w AS p0 FROM {source} JOIN edges ON f >= low AND f <= high WINDOW w AS (PARTITION BY {keys}, band ORDER BY f)),
 powers AS (SELECT {keys}, band, coalesce(sum((p + p0) * (f - f0) / 2), 0) AS power, count(*) AS bins FROM inside GROUP BY ALL)
"""


# --- queries ---


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("value").alias("y"))


def _grouped(spark: SparkSession, sf_dir: str, schema: str, f: Callable[[np.ndarray], pd.DataFrame]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(["ts", "event_id"]).y.to_numpy(float)
        out = f(y)
        out.insert(0, "session_id", pdf.session_id.iloc[0])
        return out

    return _signal(spark, sf_dir).groupBy("session_id").applyInPandas(run, schema)


def _rounded(y: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    x = y * 10.0**digits
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) == 0.5, whole + np.sign(x), np.rint(x)) / 10.0**digits


def _series(y: np.ndarray, digits: int = 4) -> pd.DataFrame:
    return pd.DataFrame({"i": np.arange(len(y)), "y": _rounded(y, digits)})


_BAND_PASS = dsp.butter(4, (0.5, 45.0), 250.0, "band")


@_query(LISTS + _zero_phase("lists", "band", *_BAND_PASS) + _zero_phase("band", "done", *dsp.notch(60.0, 30.0, 250.0)) + _points("done", 1))
def butter_filtfilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-phase band-pass and mains notch; a session that isn't longer than the extension at its ends (27 samples) stays unfiltered."""
    from pulsegrid.operators.eeg import band_pass

    return _grouped(spark, sf_dir, POINTS, lambda y: _series(band_pass(y[:, None])[:, 0], 1))


_EMG_BAND = dsp.butter(4, (15.0, 45.0), 250.0, "band")


@_query(LISTS + f", done AS (SELECT session_id, {_from_rest('x', *_EMG_BAND)} AS x FROM lists) " + _points("done"))
def causal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal band-pass from the steady state of the first sample."""

    def f(y: np.ndarray) -> pd.DataFrame:
        b, a = _EMG_BAND
        return _series(dsp.lfilter(b, a, y[:, None], dsp.steady_state(b, a)[:, None] * y[:1])[0][:, 0])

    return _grouped(spark, sf_dir, POINTS, f)


_CUT = """, cut AS (SELECT session_id, x, least(len(x), 64) AS n FROM lists),
 parts AS (SELECT session_id, n, x[s + 1 : s + n] AS part FROM (SELECT *, unnest(range(0, len(x) - n + 1, greatest(n - n // 2, 1))) AS s FROM cut))
"""


@_query(LISTS + _CUT + _spectrum("parts", "session_id", 250.0) + ", mean AS (SELECT session_id, n, k, f, avg(p) AS p FROM spec GROUP BY ALL)"
        + _bands(dict(BANDS), "session_id, n", "mean") + """, every AS (SELECT session_id, n, band FROM cut, edges)
 SELECT session_id, every.band, CASE WHEN every.n >= 64 OR bins > 1 THEN round(power, 4) END AS power FROM every LEFT JOIN powers USING (session_id, n, band)""")
def welch_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band powers of a power density; a session shorter than a segment is one segment, and its bands that hold under two of its frequencies are null."""

    def f(y: np.ndarray) -> pd.DataFrame:
        if len(y) < 2:
            return pd.DataFrame({"band": list(BANDS), "power": np.nan})
        freqs, p = dsp.welch(y, 250.0, 64)
        seen = {b: len(y) >= 64 or ((freqs >= e[0]) & (freqs <= e[1])).sum() > 1 for b, e in BANDS.items()}
        return pd.DataFrame([(b, round(float(dsp.band_power(freqs, p, *e)), 4) if seen[b] else None) for b, e in BANDS.items()], columns=["band", "power"])

    return _grouped(spark, sf_dir, "session_id long, band string, power double", f)


@_query(LISTS + """, parts AS (SELECT session_id, s, 32 AS n, x[4 * s + 1 : 4 * s + 32] AS part FROM (SELECT *, unnest(range(0, (len(x) - 32) // 4 + 1)) AS s FROM lists WHERE len(x) >= 32))
""" + _spectrum("parts", "session_id, s", 51.2, "64") + """
 SELECT session_id, round((4 * s + 16) / 51.2e0, 6) AS t, round(f, 6) AS f, round(10 * log10(p / CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END + 1e-20), 4) AS db FROM spec WHERE f <= 6
 UNION ALL SELECT session_id, NULL, NULL, NULL FROM lists WHERE len(x) < 32""")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-time spectrum in decibels; a session shorter than a segment (32 samples) has one row of nulls."""

    def f(y: np.ndarray) -> pd.DataFrame:
        if len(y) < 32:
            return pd.DataFrame({"t": [np.nan], "f": [np.nan], "db": [np.nan]})
        t, freqs, db = dsp.spectrogram(y, 51.2, 32, 28, 64, 6.0)
        return pd.DataFrame({"t": np.repeat(np.round(t, 6), len(freqs)), "f": np.tile(np.round(freqs, 6), len(t)), "db": np.round(db.ravel(), 4)})

    return _grouped(spark, sf_dir, "session_id long, t double, f double, db double", f)


_TURN = "list_sum(list_transform(range(0, n), lambda j: x[j + 1] * {f}(2 * pi() * k * j / n)))"


@_query(LISTS + f""", sizes AS (SELECT session_id, x, len(x) AS n, greatest(2, len(x) // 3) AS m FROM lists),
 bins AS (SELECT *, unnest(range(0, m // 2 + 1)) AS k FROM sizes),
 turned AS (SELECT session_id, n, m, k, {_TURN.format(f="cos")} AS re, -{_TURN.format(f="sin")} AS im FROM bins),
 points AS (SELECT *, unnest(range(0, m)) AS i FROM turned)
 SELECT session_id, i, round(sum(CASE WHEN k = 0 THEN re WHEN 2 * k = m AND n > m THEN 2 * re * cos(pi() * i) WHEN 2 * k = m THEN re * cos(pi() * i)
  ELSE 2 * (re * cos(2 * pi() * k * i / m) - im * sin(2 * pi() * k * i / m)) END) / n[1], 4) AS y FROM (SELECT session_id, [n] AS n0, n, m, k, re, im, i FROM points) GROUP BY session_id, i, n""".replace("/ n[1]", "/ n"))
def fft_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourier resampling to a third of the points, two at least."""
    return _grouped(spark, sf_dir, POINTS, lambda y: _series(dsp.resample_fft(y, max(2, len(y) // 3))))


@_query()
def cubic_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic spline to three times the points; through under four points the polynomial of the least degree."""

    def f(y: np.ndarray) -> pd.DataFrame:
        x, at = np.arange(len(y), dtype=float), np.linspace(0, len(y) - 1, 3 * len(y))
        return _series(dsp.cubic_spline(x, y, at) if len(y) > 3 else np.polyval(np.polyfit(x, y, len(y) - 1), at))

    return _grouped(spark, sf_dir, POINTS, f)


@_query(IDX + """, runs AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY i) AS run FROM
  (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY session_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM idx)),
 plateaus AS (SELECT session_id, run, any_value(y) AS y, (min(i) + max(i)) // 2 AS i FROM runs GROUP BY 1, 2),
 tops AS (SELECT session_id, i, y FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM plateaus WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE y > a AND y > b AND y >= 50),
 chosen AS (SELECT session_id, unnest(list_reduce(list_prepend([]::BIGINT[], list([i] ORDER BY y DESC, i DESC)), lambda s, e: CASE WHEN len(list_filter(s, lambda k: abs(k - e[1]) < 4)) > 0 THEN s ELSE s || e END)) AS i FROM tops GROUP BY 1),
 sides AS (SELECT c.session_id, c.i, p.y, coalesce(max(o.i) FILTER (o.i < c.i AND o.y > p.y) + 1, 0) AS a, coalesce(min(o.i) FILTER (o.i > c.i AND o.y > p.y) - 1, max(o.i)) AS b
  FROM chosen c JOIN idx p ON p.session_id = c.session_id AND p.i = c.i JOIN idx o ON o.session_id = c.session_id GROUP BY 1, 2, 3),
 rises AS (SELECT s.session_id, s.i, any_value(s.y) - greatest(min(o.y) FILTER (o.i BETWEEN s.a AND s.i), min(o.y) FILTER (o.i BETWEEN s.i AND s.b)) AS prominence
  FROM sides s JOIN idx o ON o.session_id = s.session_id GROUP BY 1, 2)
 SELECT session_id, i, round(prominence, 6) AS prominence FROM rises WHERE prominence >= 20""")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima by height, distance and prominence; a session without any has no row."""

    def f(y: np.ndarray) -> pd.DataFrame:
        at, rise = dsp.find_peaks(y, height=50, prominence=20, distance=4)
        return pd.DataFrame({"i": at, "prominence": np.round(rise, 6)})

    return _grouped(spark, sf_dir, "session_id long, i long, prominence double", f)


@_query(IDX + """, m AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(y * y, 0.5) OVER w END AS med FROM idx WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 1536 PRECEDING AND 1536 FOLLOWING)),
 d AS (SELECT *, abs(y * y - med) AS dev FROM m),
 e AS (SELECT *, CASE WHEN count(dev) OVER w >= 3 THEN quantile_cont(dev, 0.5) OVER w * 1.4826 END AS mad FROM d WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 1536 PRECEDING AND 1536 FOLLOWING)),
 o AS (SELECT *, coalesce(mad <> 0 AND dev / mad > 4, false) AS out FROM e),
 g AS (SELECT *, max(out) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 256 PRECEDING AND 256 FOLLOWING) AS wide FROM o)
 SELECT session_id, i, wide AND avg(wide::INT) OVER (PARTITION BY session_id) * 100 <= 15 AS masked FROM g""")
def rolling_mad_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefact spans by a long rolling median."""
    from pulsegrid.operators.heart import artefacts

    return _grouped(spark, sf_dir, "session_id long, i long, masked boolean", lambda y: pd.DataFrame({"i": np.arange(len(y)), "masked": artefacts(y)}))


@_query(IDX + """, m AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(y * y, 0.5) OVER w END AS med FROM idx WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
 d AS (SELECT *, abs(y * y - med) AS dev FROM m),
 e AS (SELECT *, CASE WHEN count(dev) OVER w >= 3 THEN quantile_cont(dev, 0.5) OVER w * 1.4826 END AS mad FROM d WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
 o AS (SELECT *, coalesce(mad <> 0 AND dev / mad > 4, false) AS out FROM e),
 g AS (SELECT *, max(out) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM o)
 SELECT session_id, i, wide AND avg(wide::INT) OVER (PARTITION BY session_id) * 100 <= 40 AS masked FROM g""")
def rolling_mad_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefact spans by a rolling median of 15 samples, one sample around each, where they take 40 percent of a session at most."""
    from pulsegrid.operators.heart import artefacts

    found = lambda y: pd.DataFrame({"i": np.arange(len(y)), "masked": artefacts(y, rows=15, guard=1, cap=40)})
    return _grouped(spark, sf_dir, "session_id long, i long, masked boolean", found)


@_query(LISTS + f""", w AS (SELECT {_list(np.hanning(11) / np.hanning(11).sum())} AS w),
 m AS (SELECT session_id, x, CASE WHEN len(x) >= 11 THEN list_reverse(x[2:6]) || x || list_reverse(x[len(x) - 5 : len(x) - 1]) END AS e FROM lists),
 done AS (SELECT session_id, CASE WHEN e IS NULL THEN x ELSE list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(range(1, 12), lambda j: e[i + j - 1] * w[12 - j]))) END AS x FROM m, w)
 """ + _points("done"))
def kernel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing with a Hann window; a session shorter than the window (11 samples) stays as it is."""
    return _grouped(spark, sf_dir, POINTS, lambda y: _series(dsp.kernel_smooth(y, 11) if len(y) >= 11 else y))


@_query(IDX + """, r AS (SELECT session_id, 0.2e0 * stddev_pop(y) AS r, count(*) AS n FROM sig GROUP BY 1),
 v AS (SELECT idx.session_id, i, y AS a, lead(y) OVER w AS b, lead(y, 2) OVER w AS c FROM idx WINDOW w AS (PARTITION BY session_id ORDER BY i)),
 p AS (SELECT s.session_id, count(*) FILTER (abs(s.a - o.a) <= r AND abs(s.b - o.b) <= r) AS b, count(*) FILTER (abs(s.a - o.a) <= r AND abs(s.b - o.b) <= r AND abs(s.c - o.c) <= r) AS a
  FROM v s JOIN v o ON s.session_id = o.session_id AND s.i < o.i JOIN r ON r.session_id = s.session_id WHERE s.c IS NOT NULL AND o.c IS NOT NULL GROUP BY 1)
 SELECT session_id, CASE WHEN n > 3 THEN CASE WHEN a > 0 AND b > 0 THEN round(-ln(a::DOUBLE / b), 6) ELSE 0 END END AS entropy FROM r LEFT JOIN p USING (session_id)""")
def sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregularity of a signal; null under four samples, where there are no two runs to compare."""
    return _grouped(
        spark, sf_dir, "session_id long, entropy double", lambda y: pd.DataFrame({"entropy": [round(dsp.sample_entropy(y), 6) if len(y) > 3 else np.nan]})
    )


@_query()
def cvx_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonic and phasic parts by convex decomposition; `converged` is false where the solver's rounds ended above its tolerance."""

    def f(y: np.ndarray) -> pd.DataFrame:
        d = dsp.decompose_eda((y - y.mean()) / (y.std() + 1e-12), 0.25)
        return pd.DataFrame({"i": np.arange(len(y)), "tonic": np.round(d["tonic"], 4), "phasic": np.round(d["phasic"], 4), "converged": d["converged"]})

    return _grouped(spark, sf_dir, "session_id long, i long, tonic double, phasic double, converged boolean", f)


_EMG_EDGES = {str(j): e for j, e in enumerate(zip(emg.BAND_EDGES, emg.BAND_EDGES[1:]))}


@_query(LISTS + """, parts AS (SELECT session_id, s, 64 AS n, x[32 * s + 1 : 32 * s + 64] AS part FROM (SELECT *, unnest(range(0, (len(x) - 64) // 32 + 1)) AS s FROM lists WHERE len(x) >= 64))
""" + _spectrum("parts", "session_id, s", 250.0) + _bands(_EMG_EDGES, "session_id, s") + """
 SELECT session_id, s AS k, band::BIGINT AS band, round(power, 4) AS power FROM powers UNION ALL SELECT session_id, NULL, NULL, NULL FROM lists WHERE len(x) < 64""")
def emg_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band powers of windows of 64 samples, every 32, of a muscle signal; a session shorter than a window has one row of nulls."""

    def f(y: np.ndarray) -> pd.DataFrame:
        p = emg.band_powers(y, 64, 32)
        if not len(p):
            return pd.DataFrame({"k": [None], "band": [None], "power": [np.nan]})
        return pd.DataFrame({"k": np.repeat(np.arange(len(p)), p.shape[1]), "band": np.tile(np.arange(p.shape[1]), len(p)), "power": np.round(p.ravel(), 4)})

    return _grouped(spark, sf_dir, "session_id long, k long, band long, power double", f)


_LOW, _HIGH, _SLOW = dsp.butter(4, emg.HIGH, emg.RATE, "low"), dsp.butter(4, emg.LOW, emg.RATE, "high"), dsp.butter(2, emg.ENVELOPE, emg.RATE, "low")


@_query(LISTS + _zero_phase("lists", "l1", *_LOW) + _zero_phase("l1", "l2", *_LOW) + _zero_phase("l2", "h1", *_HIGH) + _zero_phase("h1", "h2", *_HIGH)
        + ", a AS (SELECT session_id, list_transform(x, lambda v: abs(v)) AS x FROM h2)" + _zero_phase("a", "e1", *_SLOW) + _zero_phase("e1", "e2", *_SLOW)
        + ", done AS (SELECT session_id, CASE WHEN len(x) > 30 THEN x ELSE list_transform(x, lambda v: NULL::DOUBLE) END AS x FROM e2)" + _points("done"))
def emg_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope of a conditioned muscle signal."""
    return emg.envelopes(indexed(spark, sf_dir), KEYS, "i", ["y"]).select("session_id", "i", F.round("y", 4).alias("y"))


_MEDIAN = "((list_sort({h})[(len({h}) + 1) // 2] + list_sort({h})[len({h}) // 2 + 1]) / 2)"
_NEXT = "CASE WHEN {long} THEN s[1] || list_transform(range(0, {extra} + 1), lambda j: {ibi} / ({extra} + 1)) WHEN {ibi} >= s[4][1] / 1.5 THEN list_append(s[1], {ibi}) ELSE s[1] END"
_BEAT = {"ibi": "((e[1][2] - e[1][1]) / 51.2e0 * 1000)"}
_BEAT["long"] = f"({_BEAT['ibi']} > 1.5 * s[4][1] AND {_BEAT['ibi']} <= 20000)"
_BEAT["extra"] = f"greatest(1, round_even({_BEAT['ibi']} / s[4][1], 0)::BIGINT - 1)"
_HISTORY = _NEXT.format(**_BEAT)


@_query(f""", d AS (SELECT DISTINCT session_id, round_even((t - min(t) OVER (PARTITION BY session_id)) / 86400 * 51.2, 0) AS p FROM sig),
 g AS (SELECT *, lag(p) OVER (PARTITION BY session_id ORDER BY p) AS a FROM d),
 l AS (SELECT session_id, min(p) AS first, list([[a, p]] ORDER BY p) FILTER (a IS NOT NULL) AS steps, list((p - a) / 51.2e0 * 1000) FILTER (a IS NOT NULL) AS gaps FROM g GROUP BY 1),
 o AS (SELECT *, {_MEDIAN.format(h="gaps")} AS overall FROM l),
 done AS (SELECT session_id, first, list_reduce(list_prepend([[]::DOUBLE[], []::DOUBLE[], []::DOUBLE[], [overall], [overall]], steps), lambda s, e: list_transform([[
   {_HISTORY},
   CASE WHEN {_BEAT["long"]} THEN s[2] || list_transform(range(1, {_BEAT["extra"]} + 1), lambda j: round_even(e[1][1] + (e[1][2] - e[1][1]) * j / ({_BEAT["extra"]} + 1), 0)) || [e[1][2]] ELSE list_append(s[2], e[1][2]) END,
   CASE WHEN {_BEAT["long"]} THEN s[3] || list_transform(range(1, {_BEAT["extra"]} + 1), lambda j: 1e0) || [0e0] ELSE list_append(s[3], 0e0) END, s[5]]],
  lambda q: [q[1], q[2], q[3], CASE WHEN len(q[1]) >= 10 THEN [{_MEDIAN.format(h="q[1][-30:]")}] ELSE q[4] END, q[4]])[1]) AS s FROM o WHERE steps IS NOT NULL)
 SELECT session_id, first::BIGINT AS idx, false AS is_synthetic FROM l UNION ALL SELECT session_id, unnest(s[2])::BIGINT, unnest(s[3]) = 1 FROM done""")
def missing_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats with missing ones put in; event times in days serve as beats."""
    from pulsegrid.operators.heart import fill_beats

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf.t.to_numpy(float))
        at = np.unique(np.round((t - t[0]) / 86400 * 51.2).astype(int))
        found, made = fill_beats(at, np.zeros(at[-1] + 2, bool))
        return pd.DataFrame({"session_id": pdf.session_id.iloc[0], "idx": found, "is_synthetic": made})

    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return df.select(F.col("user_id").alias("session_id"), t.alias("t")).groupBy("session_id").applyInPandas(run, "session_id long, idx long, is_synthetic boolean")


@_query()
def multilaterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points recovered from their distances: a third of the frames hear four antennas, a third two, a third one."""
    from pulsegrid.operators.position import positions

    heard = F.slice("every", 1, F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), (F.col("t") % 3 + 1).cast("int")))
    out = positions(_ranged(spark, sf_dir).withColumn("ants", heard), ["session_id"], "t")
    return out.select("session_id", "t", *[F.round(c, 3).alias(c) for c in "xyz"])


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (session_id, t) with the distances of points at a height of 1 to four antennas, `every`."""
    corners = [("a", 0.0, 0.0, 0.0), ("b", 100.0, 0.0, 0.0), ("c", 0.0, 100.0, 5.0), ("d", 100.0, 100.0, 2.0)]
    px, py = F.col("p_size").cast("double"), F.col("p_retailprice") / 25
    ants = F.array(*[
        F.struct(F.lit(n).alias("num"), F.lit(n).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.sqrt((px - x) ** 2 + (py - y) ** 2 + (1 - z) ** 2).alias("dist"))
        for n, x, y, z in corners
    ])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(1).alias("session_id"), F.col("p_partkey").cast("double").alias("t"), ants.alias("every"))


@_query(LISTS + f""", done AS (SELECT session_id, {_from_rest("x", *_EMG_BAND)} AS x FROM lists)
 SELECT session_id::VARCHAR AS device_id, k, 8 * k + 15 AS n_last, round(sqrt(list_sum(list_transform(x[8 * k + 1 : 8 * k + 16], lambda v: v * v)) / 16), 4) AS rms
 FROM (SELECT *, unnest(range(0, (len(x) - 16) // 8 + 1)) AS k FROM done WHERE len(x) >= 16)""")
def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live windows computed over a table; tests compare them with the stream's."""
    from pulsegrid.operators.timeseries import row_index
    from pulsegrid.streaming.live import batch_windows

    rows = row_index(_signal(spark, sf_dir), ["session_id"], ["ts", "event_id"], "n")
    rows = rows.select(F.col("session_id").cast("string").alias("device_id"), "n", "y")
    out = batch_windows(rows, ["y"], size=16, step=8)
    return out.select("device_id", "k", "n_last", F.round(F.col("rms")[0], 4).alias("rms"))


_Z = "((e[{j}] - s[{j}]) / sqrt(s[{v}]))"
_Z1, _Z2 = _Z.format(j=1, v=3), _Z.format(j=2, v=4)
_MOVED = [f"CASE WHEN abs({z}) <= 3.5 THEN s[{j}] + 0.001e0 * (e[{j}] - s[{j}]) ELSE s[{j}] END" for j, z in ((1, _Z1), (2, _Z2))]
_MOVED += [f"CASE WHEN abs({z}) <= 3.5 THEN 0.997e0 * s[{j + 2}] + 0.003e0 * (e[{j}] - s[{j}]) * (e[{j}] - s[{j}]) ELSE s[{j + 2}] END" for j, z in ((1, _Z1), (2, _Z2))]
_RANKS = "((r[greatest(a + 1, (a + b + 1) // 2)] + r[(a + b) // 2 + 1]) / 2)"


@_query(f""", c AS (SELECT session_id, event_id, y AS a, y / 2 + 1 AS b, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM sig),
 l AS (SELECT session_id, list([ln(a + 1e-8), ln(b + 1e-8)] ORDER BY k) AS x FROM c GROUP BY 1),
 d AS (SELECT session_id, list_reduce(list_prepend(x[1] || [1e0, 1e0], x), lambda s, e: [{", ".join(_MOVED)}] || s[5:] || [{_Z1} / (sqrt({_Z1} ** 2 + {_Z2} ** 2) + 1e-8)])[5:] AS f FROM l),
 w AS (SELECT *, sqrt(a * a + b * b) AS energy, list_sort(list(sqrt(a * a + b * b)) OVER (PARTITION BY session_id ORDER BY k ROWS 599 PRECEDING)) AS r FROM c),
 n AS (SELECT *, len(r) AS n, floor(len(r) * 0.02e0)::BIGINT AS a1, floor(len(r) * 0.3e0)::BIGINT AS b1, floor(len(r) * 0.6e0)::BIGINT AS b2 FROM w),
 m AS (SELECT *, list_aggregate(r[a1 + 1 : greatest(a1 + 1, b1)], 'median') AS low, list_aggregate(r[b1 + 1 : greatest(b1 + 1, b2)], 'median') AS high FROM n)
 SELECT m.session_id, event_id, round(f[k], 6) AS first, round(CASE WHEN n < 30 THEN 0.5 ELSE 1 / (1 + exp(-(energy - low) / greatest(high - low, 1e-8))) END, 6) AS energy FROM m JOIN d USING (session_id)""")
def online_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and energy by the running calibrator."""
    from pulsegrid.operators.emotions import calibrate_online

    df = _signal(spark, sf_dir).select("session_id", "event_id", F.col("y").alias("a"), (F.col("y") / 2 + 1).alias("b"))
    out = calibrate_online(df, ["session_id"], "event_id", ["a", "b"])
    return out.select("session_id", "event_id", F.round(F.col("direction")[0], 6).alias("first"), F.round("energy", 6).alias("energy"))


def _model():
    from pulsegrid.operators.emotions import EMOTIONS, Model

    coef = [[float((7 * i + 3 * j) % 5 - 2) for j in range(9)] for i in range(len(EMOTIONS))]
    return Model([1.0, -1.0, 2.0, 0.5, 0.0, 1.0, -0.5, 0.25, 0.1], 0.2, coef, [0.0] * len(EMOTIONS), gate=0.12, cooldown=1)


@_query("""WITH v AS (SELECT vec_id AS k, label AS session_id, list_transform(embedding[1:9], lambda x: x::DOUBLE) AS v FROM embeddings), gates AS (SELECT *, coalesce(v[9] > 0.12, false) AS art FROM v),
 given AS (SELECT *, art OR coalesce(max(art) OVER (PARTITION BY session_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), false) AS gated FROM gates),
 """ + _scores(_model(), "gated", False) + """
 SELECT session_id, k, gated, CASE WHEN quiet THEN 'Neutral' ELSE best END AS label, round(p_active, 6) AS p_active, round(CASE WHEN quiet THEN 1 - p_active ELSE list_max(e) END, 6) AS confidence FROM done""", signal=False)
def emotion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage inference on feature vectors, with gate and cooldown."""
    from pulsegrid.operators.emotions import infer

    x = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("session_id"), F.col("vec_id").alias("k"), x.alias("x"))
    out = infer(df, ["session_id"], ["k"], "x", _model())
    return out.select("session_id", "k", "gated", "label", F.round("p_active", 6).alias("p_active"), F.round("confidence", 6).alias("confidence"))


@_query("""SELECT p_partkey::DOUBLE AS t, round(p_size, 3)::DOUBLE AS x, round(p_retailprice / 25, 3) AS y, 1.0::DOUBLE AS z FROM part""", signal=False)
def ranging_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points recovered from exact distances to four antennas."""
    from pulsegrid.operators.position import solve_three

    out = solve_three(_ranged(spark, sf_dir).withColumn("ants", F.col("every")))
    return out.select("t", *[F.round(F.col(f"pos.{c}"), 3).alias(c) for c in "xyz"])


@_query(IDX + """, c AS (SELECT session_id, i // 16 AS e, count(*) AS n, avg((v IS NULL)::INT) AS f, max(abs(y)) AS p9, max(y) - min(y) AS r9, max(abs(y / 2 - 20)) AS p10, (max(y) - min(y)) / 2 AS r10, list(y ORDER BY i) AS x FROM idx GROUP BY 1, 2),
 parts AS (SELECT session_id, e, 16 AS n, x AS part FROM c WHERE n = 16)
""" + _spectrum("parts", "session_id, e", 100.0) + _bands({"muscle": (30.0, 45.0), "all": (1.0, 45.0)}, "session_id, e") + """,
 share AS (SELECT session_id, e, sum(power) FILTER (band = 'muscle') / (sum(power) FILTER (band = 'all') + 1e-12) AS m FROM powers GROUP BY 1, 2)
 SELECT c.session_id, c.e AS epoch, c.n, CASE WHEN c.n < 16 THEN NULL WHEN f > 0.3 THEN 'nan' WHEN p9 > 150 THEN 'peak_amp' WHEN r9 > 120 THEN 'ptp' WHEN m > 0.35 THEN 'emg_ratio'
  WHEN p10 > 150 THEN 'peak_amp' WHEN r10 > 120 THEN 'ptp' END AS cause FROM c LEFT JOIN share USING (session_id, e)""")
def epoch_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cause that rejects an epoch of 16 samples: missing, peak, peak-to-peak, muscle share; of two channels the first, then the second."""
    from pulsegrid.operators.eeg import Limits, epoch_artefacts

    df = indexed(spark, sf_dir).select("session_id", "i", F.col("y").alias("T9"), (F.col("y") / 2 - 20).alias("T10"), F.col("v").isNull().alias("invalid"))
    return epoch_artefacts(df, KEYS, "i", "invalid", limits=Limits(0.3, 150.0, 120.0, 0.35), size=16, rate=100.0)


_FILLED = "coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id, s ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY session_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@_query(IDX + f""", n AS (SELECT session_id, count(*) AS n FROM idx GROUP BY 1), starts AS (SELECT session_id, unnest(range(0, n - 15, 8)) AS s FROM n WHERE n >= 16),
 members AS (SELECT *, {_FILLED} AS y FROM (SELECT starts.session_id, s, i, v FROM starts JOIN idx ON idx.session_id = starts.session_id AND i BETWEEN s AND s + 15)),
 parts AS (SELECT session_id, s, 16 AS n, list(y ORDER BY i) AS part FROM members GROUP BY 1, 2 HAVING avg((v IS NULL)::INT) <= 0.5)
""" + _spectrum("parts", "session_id, s", 20.0) + _bands({"pulse": (0.5, 4.0), "all": (0.1, 10.0)}, "session_id, s") + """,
 share AS (SELECT session_id, s, sum(power) FILTER (band = 'pulse') / (sum(power) FILTER (band = 'all') + 1e-12) AS q FROM powers GROUP BY 1, 2)
 SELECT idx.session_id, i, round(coalesce(max(q), 0), 6) AS quality FROM idx LEFT JOIN share ON share.session_id = idx.session_id AND i BETWEEN s AND s + 15 GROUP BY 1, 2""")
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sample the best share of pulse power of the windows over it; windows of 16 samples, every 8."""
    from pulsegrid.operators.heart import quality

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf[["session_id", "i"]].assign(quality=np.round(quality(pdf.v.to_numpy(float), 16, 8, 20.0), 6))

    return indexed(spark, sf_dir).select("session_id", "i", "v").groupBy("session_id").applyInPandas(run, "session_id long, i long, quality double")


@_query(IDX + """, w AS (SELECT session_id, i // 8 AS k, count(*) AS c, avg(y) AS p FROM idx GROUP BY 1, 2), l AS (SELECT session_id, list(p ORDER BY k) AS p, sum(c)::BIGINT AS n FROM w GROUP BY 1),
 u AS (SELECT *, len(p) * greatest(1, n // len(p)) AS m FROM l),
 x AS (SELECT *, unnest(range(0, m)) AS i FROM u), places AS (SELECT *, CASE WHEN m = 1 THEN 0e0 ELSE (len(p) - 1) * i / (m - 1)::DOUBLE END AS a FROM x)
 SELECT session_id, i, round(CASE WHEN floor(a) + 2 > len(p) THEN p[len(p)] ELSE p[floor(a)::INT + 1] + (p[floor(a)::INT + 2] - p[floor(a)::INT + 1]) * (a - floor(a)) END, 9) AS y FROM places""")
def emg_upsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of eight samples drawn out linearly to the signal's length."""

    def f(y: np.ndarray) -> pd.DataFrame:
        return _series(emg.upsampled(np.array([y[a : a + 8].mean() for a in range(0, len(y), 8)]), len(y)), 9)

    return _grouped(spark, sf_dir, POINTS, f)


@_query(LISTS + f""", f AS (SELECT session_id, list_transform({_fold("x", *_EMG_BAND, "[" + ", ".join(["0e0"] * 8) + "]")}, lambda v: 20e0 * tanh(v / 20e0)) AS x FROM lists)
 SELECT session_id::VARCHAR AS device_id, k, 4 * k + 19 AS n_last, round(sqrt(list_sum(list_transform(x[4 * k + 1 : 4 * k + 20], lambda v: v * v)) / 20), 4) AS rms
 FROM (SELECT *, unnest(range(0, (len(x) - 20) // 4 + 1)) AS k FROM f WHERE len(x) >= 20)""")
def clipped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live windows of a signal that is filtered from rest and clipped softly."""
    from pulsegrid.streaming.live import batch_windows

    rows = indexed(spark, sf_dir).select(F.col("session_id").cast("string").alias("device_id"), F.col("i").alias("n"), "y")
    out = batch_windows(rows, ["y"], size=20, step=4, rest=False, clip=20.0)
    return out.select("device_id", "k", "n_last", F.round(F.col("rms")[0], 4).alias("rms"))

"""Pulse: signal quality, artefact masks, beats, and heart-rate variability at 2 Hz."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.timeseries import Cols

RATE = 51.2
SQI_ROWS, SQI_STEP, SQI_LEAST = 410, 205, 0.30
MAD_ROWS, MAD_TIMES, GUARD_ROWS, CAP_PERCENT = 3073, 4.0, 256, 15.0
DETECT_RATE = 256.0
IBI_LEAST_MS = 300.0
LOOK_BACK, TICK, LEAST_BEATS = 30.0, 0.5, 10


def refractory(peaks: Column, least: float) -> Column:
    """Ascending peaks without those closer than `least` to the last one kept."""
    none = F.array().cast("array<double>")
    keep = lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) >= least), F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(F.transform(peaks, lambda p: p.cast("double")), none, lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).otherwise(keep(kept, p)))


def quality(x: np.ndarray, rows: int = SQI_ROWS, step: int = SQI_STEP, rate: float = RATE) -> np.ndarray:
    """For each sample the best share of power within 0.5 to 4 Hz (of 0.1 to 10 Hz) of the windows over it; 0 outside any window with half its samples."""
    best = np.zeros(len(x))
    for a in range(0, len(x) - rows + 1, step):
        part = pd.Series(x[a : a + rows])
        if part.isna().mean() > 0.5:
            continue
        f, p = dsp.welch(part.ffill().bfill().to_numpy(), rate, rows)
        best[a : a + rows] = np.maximum(best[a : a + rows], dsp.band_power(f, p, 0.5, 4) / (dsp.band_power(f, p, 0.1, 10) + 1e-12))
    return best


def artefacts(x: np.ndarray, rows: int = MAD_ROWS, guard: int = GUARD_ROWS, cap: float = CAP_PERCENT) -> np.ndarray:
    """Spans of outlying energy, 5 s around each; nothing where they would take more than `cap` percent."""
    energy = pd.Series(x).pow(2)
    roll = lambda s: s.rolling(rows, center=True, min_periods=3).median()
    median = roll(energy)
    mad = roll((energy - median).abs()) * 1.4826
    out = (((energy - median).abs() / mad.where(mad != 0)) > MAD_TIMES).fillna(False).to_numpy()
    wide = pd.Series(out.astype(float)).rolling(2 * guard + 1, center=True, min_periods=1).max().to_numpy() > 0
    return wide if (wide & ~np.isnan(x)).mean() * 100 <= cap else np.zeros(len(x), bool)


def detect(z: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Beats as sample numbers: cubic upsampling to 256 Hz, two-average detection, none within masked spans."""
    filled = pd.Series(z).ffill().bfill().to_numpy()
    if len(filled) < 4 * RATE or np.isnan(filled).any():
        return np.zeros(0, np.int64)
    seconds = len(filled) / RATE
    at = np.linspace(0, seconds, int(seconds * DETECT_RATE))
    up = dsp.cubic_spline(np.linspace(0, seconds, len(filled)), filled, at)
    found = np.round(dsp.pulse_peaks(up, DETECT_RATE) * RATE / DETECT_RATE).astype(np.int64)
    found = np.unique(found[found < len(mask)])
    return found[~mask[found]]


def fill_beats(peaks: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peaks with missing ones put in, and which these are.

    An interval over 1.5 times the usual one, at most 20 s and free of masked samples, is divided evenly. The usual interval is the median of
    the last 30 accepted ones, or of all until ten are accepted; an interval is accepted unless much shorter than usual, and of a divided one
    each part is.
    """
    if len(peaks) < 2:
        return peaks, np.zeros(len(peaks), bool)
    gaps = np.diff(peaks) / RATE * 1000
    overall, history = float(np.median(gaps)), []
    out, made = [int(peaks[0])], [False]
    for a, b, ibi in zip(peaks[:-1], peaks[1:], gaps):
        usual = float(np.median(history[-30:])) if len(history) >= 10 else overall
        if ibi > 1.5 * usual and ibi <= 20_000 and not mask[a : b + 1].any():
            extra = max(1, round(ibi / usual) - 1)
            out += [int(round(a + (b - a) * (j + 1) / (extra + 1))) for j in range(extra)]
            made += [True] * extra
            history += [ibi / (extra + 1)] * (extra + 1)
        elif ibi >= usual / 1.5:
            history.append(ibi)
        out.append(int(b))
        made.append(False)
    return np.array(out), np.array(made)


def variability(peaks: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    """Every half second the measures of the beats in the last 30 s; null with under ten beats or any masked sample there."""
    t = peaks / RATE
    keep: list[float] = []
    for p in t:
        if not keep or (p - keep[-1]) * 1000 >= IBI_LEAST_MS:
            keep.append(p)
    kept = np.array(keep)
    ticks = np.arange(0, t[-1] if len(t) else 0, TICK)
    masked = np.concatenate([[0], np.cumsum(mask)])
    rows = []
    for tick in ticks:
        n = int(np.searchsorted(t, tick, "right") - np.searchsorted(t, tick - LOOK_BACK))
        own = kept[np.searchsorted(kept, tick - LOOK_BACK) : np.searchsorted(kept, tick, "right")]
        a, b = max(0, int((tick - LOOK_BACK) * RATE)), min(len(mask), int(tick * RATE) + 1)
        row = dict.fromkeys(("mean_hr", "mean_nn", "sdnn", "rmssd", "pnn50", "cvsd", "cvnn"), np.nan)
        if len(own) >= LEAST_BEATS and masked[b] == masked[a]:
            nn = np.diff(own) * 1000
            d = np.diff(nn)
            mean, sd, rmssd = nn.mean(), nn.std(ddof=1), np.sqrt((d * d).mean())
            row = {"mean_hr": 60000 / mean, "mean_nn": mean, "sdnn": sd, "rmssd": rmssd, "pnn50": 100 * (np.abs(d) > 50).mean(), "cvsd": rmssd / mean, "cvnn": sd / mean}
        rows.append({"t": tick, **row, "n_beats": n})
    return pd.DataFrame(rows, columns=["t", "mean_hr", "mean_nn", "sdnn", "rmssd", "pnn50", "cvsd", "cvnn", "n_beats"])


METRICS = "t double, mean_hr double, mean_nn double, sdnn double, rmssd double, pnn50 double, cvsd double, cvnn double, n_beats long"


def standardised(x: np.ndarray, use_masks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The rolling z-score of a gridded pulse signal, missing in masked spans, and the mask; without masks only missing samples are masked."""
    missing = np.isnan(x)
    mask = missing | (quality(x) < SQI_LEAST) if use_masks else missing
    mask = mask | artefacts(np.where(mask, np.nan, x)) if use_masks else mask
    clean = pd.Series(np.where(mask, np.nan, x))
    s = clean.rolling(512, center=True, min_periods=3)
    return ((clean - s.mean()) / s.std(ddof=0).replace(0, 1.0)).to_numpy(), mask


def _kinds(df: DataFrame, columns: Cols) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def normalised_pulse(grid: DataFrame, keys: Cols, y: str = "y", use_masks: bool = True) -> DataFrame:
    """(keys, i, z, masked) of a gridded pulse signal (keys, i, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        z, mask = standardised(pdf[y].to_numpy(float), use_masks)
        return pdf[[*keys, "i"]].assign(z=z, masked=mask)

    return grid.select(*keys, "i", y).groupBy(*keys).applyInPandas(run, f"{_kinds(grid, [*keys, 'i'])}, z double, masked boolean")


def heart_dynamics(grid: DataFrame, keys: Cols, y: str = "y", use_masks: bool = True) -> DataFrame:
    """Metric rows of a gridded pulse signal (keys, i, y); without masks as a quick re-fix of the grid uses it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, mask = standardised(pdf.sort_values("i")[y].to_numpy(float), use_masks)
        peaks, _ = fill_beats(detect(z, mask), mask)
        out = variability(peaks, mask)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return grid.select(*keys, "i", y).groupBy(*keys).applyInPandas(run, f"{_kinds(grid, keys)}, {METRICS}")


def resampled_pulse(samples: DataFrame, keys: Cols) -> DataFrame:
    """The raw pulse signal on its regular grid, gaps of 5 s and more left empty."""
    return ts.resample(samples, keys, "t", "y", 1 / RATE, 5.0, 60.0)

"""Electrodermal activity: conductance, artefacts, tonic and phasic parts, responses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.timeseries import Cols

RATE, SOLVER_RATE = 51.2, 4.0
MAD_ROWS, MAD_TIMES, MAD_FLOOR, GUARD_ROWS = 256, 5.0, 0.05, 25
SCR_HEIGHT, SCR_PROMINENCE, SCR_DISTANCE = 0.05, 0.05, 4


def cleaned(df: DataFrame, keys: Cols, y: str, width: float = 10_000) -> DataFrame:
    """Outliers from the rolling median, half a second around each, replaced by interpolation; adds `artefact`."""
    out = ts.mad_outliers(df, keys, ["i"], y, MAD_ROWS, MAD_TIMES, MAD_FLOOR)
    out = out.withColumn("artefact", ts.dilate(keys, ["i"], "outlier", GUARD_ROWS)).drop("median", "mad", "outlier")
    return ts.fill_linear(out.withColumn(y, F.when(~F.col("artefact"), F.col(y))), keys, "i", y, width, both_ends=True)


def components(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tonic and phasic parts at the input's rate, in the input's unit; missing samples stay missing."""
    missing = np.isnan(x)
    if missing.all() or len(x) < 4 * RATE:
        return np.full(len(x), np.nan), np.full(len(x), np.nan)
    filled = pd.Series(x).ffill().bfill().to_numpy()
    n = max(16, round(len(x) * SOLVER_RATE / RATE))
    slow = dsp.resample_fft(filled, n)
    mean, std = slow.mean(), slow.std() + 1e-12
    found = dsp.decompose_eda((slow - mean) / std, 1 / SOLVER_RATE)
    b, a = dsp.butter(3, 0.5, SOLVER_RATE, "low")
    phasic = dsp.filtfilt(b, a, found["phasic"]) if n > 12 else found["phasic"]
    back = [dsp.resample_fft(s, len(x)) for s in (found["tonic"] * std + mean, phasic * std)]
    return tuple(np.where(missing, np.nan, s) for s in back)


def responses(phasic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times (s), amplitudes and prominences of skin conductance responses of a phasic part at 51.2 Hz."""
    slow = dsp.resample_fft(np.nan_to_num(phasic), max(4, round(len(phasic) * SOLVER_RATE / RATE)))
    peaks, rise = dsp.find_peaks(slow, SCR_HEIGHT, SCR_PROMINENCE, SCR_DISTANCE)
    at = np.minimum(np.round(peaks * RATE / SOLVER_RATE).astype(int), len(phasic) - 1)
    ok = ~np.isnan(phasic[at]) if len(at) else np.zeros(0, bool)
    return peaks[ok] / SOLVER_RATE, slow[peaks][ok], rise[ok]


def arousal(grid: DataFrame, keys: Cols, y: str = "y") -> DataFrame:
    """(keys, i, tonic, phasic) of a gridded conductance signal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        tonic, phasic = components(pdf[y].to_numpy(float))
        return pdf[[*keys, "i"]].assign(tonic=tonic, phasic=phasic)

    kinds = ", ".join(f"{k} {grid.schema[k].dataType.simpleString()}" for k in keys)
    return grid.select(*keys, "i", y).groupBy(*keys).applyInPandas(run, f"{kinds}, i {grid.schema['i'].dataType.simpleString()}, tonic double, phasic double")


def scr_events(found: DataFrame, keys: Cols) -> DataFrame:
    """(keys, t, amplitude, prominence) of the responses in the phasic part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, amplitude, prominence = responses(pdf.sort_values("i").phasic.to_numpy(float))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "t": t, "amplitude": amplitude, "prominence": prominence}, index=range(len(t)))

    kinds = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys)
    return found.groupBy(*keys).applyInPandas(run, f"{kinds}, t double, amplitude double, prominence double")

"""Muscle signals: conditioning, envelopes, band powers over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators.timeseries import Cols

RATE, LOW, HIGH, ENVELOPE, WINDOW, STEP = 250.0, 15.0, 45.0, 2.5, 250, 125
#: Edges of the five bands in Hz.
BAND_EDGES = (15.0, 21.0, 27.0, 33.0, 39.0, 45.0)


def conditioned(x: np.ndarray, common_average: bool = False) -> np.ndarray:
    """Low-passed at 45 Hz, then high-passed at 15 Hz, each twice without phase; optionally less the channels' mean first. x: samples by channels."""
    x = x - x.mean(1, keepdims=True) if common_average else x
    for cut, kind in ((HIGH, "low"), (LOW, "high")):
        b, a = dsp.butter(4, cut, RATE, kind)
        x = dsp.filtfilt(b, a, dsp.filtfilt(b, a, x))
    return x


def envelope(x: np.ndarray) -> np.ndarray:
    """The rectified signal, low-passed twice at 2.5 Hz."""
    b, a = dsp.butter(2, ENVELOPE, RATE, "low")
    return dsp.filtfilt(b, a, dsp.filtfilt(b, a, np.abs(x)))


def band_powers(x: np.ndarray, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """Powers of the five bands of each window (a second, every half second): windows by bands."""
    if len(x) < window:
        return np.zeros((0, len(BAND_EDGES) - 1))
    parts = np.lib.stride_tricks.sliding_window_view(x, window)[::step]
    f, p = dsp.welch(parts, RATE, window)
    return np.stack([dsp.band_power(f, p, a, b) for a, b in zip(BAND_EDGES, BAND_EDGES[1:])], 1)


def upsampled(values: np.ndarray, n: int) -> np.ndarray:
    """Window values drawn out linearly to n // len(values) points each."""
    times = max(1, n // max(1, len(values)))
    return np.interp(np.linspace(0, len(values) - 1, len(values) * times), np.arange(len(values)), values) if len(values) else values


def envelopes(df: DataFrame, keys: Cols, i: str, channels: Cols, common_average: bool = False) -> DataFrame:
    """Conditioned channels' envelopes, a session at a time; missing samples count as 0; signals too short for the filters are null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(i)
        x = pdf[channels].fillna(0.0).to_numpy(float)
        y = envelope(conditioned(x, common_average)) if len(x) > 30 else np.full(x.shape, np.nan)
        return pdf.assign(**{c: y[:, j] for j, c in enumerate(channels)})

    clean = df.select(*keys, i, *[F.col(c).cast("double").alias(c) for c in channels])
    return clean.groupBy(*keys).applyInPandas(run, clean.schema)

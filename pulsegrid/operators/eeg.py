"""EEG: filters, epoch artefacts, band powers and cognition indices on the 2 Hz grid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, scalar
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators import timeseries as ts
from pulsegrid.operators.timeseries import Cols

RATE, WINDOW, STEP, SEGMENT, EPOCH = 250.0, 500, 125, 256, 250
WINDOW_MAX_NULL = 0.25
JUDGED = ["T9", "T10"]


@dataclass(frozen=True)
class Limits:
    """What an epoch may have at most: share of invalid samples, amplitude, peak-to-peak (microvolts), share of 30 to 45 Hz in the power of 1 to 45 Hz."""

    null: float = 0.20
    peak: float = 75.0
    ptp: float = 60.0
    muscle: float = 0.30


def hardware_invalid(df: DataFrame, keys: Cols, t: str, channels: Cols, gap: float = 5.0):
    """Whether any channel is missing, or the sample is the first after a gap."""
    after_gap = F.coalesce(F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t)) >= gap, F.lit(False))
    missing = F.lit(False)
    for c in channels:
        missing = missing | F.col(c).isNull()
    return missing | after_gap


def band_pass(x: np.ndarray, low: float = 0.5, high: float = 45.0, mains: float = 60.0) -> np.ndarray:
    """Zero-phase 4th-order band-pass and mains notch of linearly filled columns; too short signals come back as they are."""
    filled = pd.DataFrame(x).interpolate("linear").bfill().fillna(0.0).to_numpy()
    b, a = dsp.butter(4, (low, high), RATE, "band")
    if len(filled) <= 3 * max(len(a), len(b)):
        return filled
    return dsp.filtfilt(*dsp.notch(mains, 30.0, RATE), dsp.filtfilt(b, a, filled))


def filtered(df: DataFrame, keys: Cols, i: str, channels: Cols) -> DataFrame:
    """The channels of each session, filtered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(i)
        y = band_pass(pdf[channels].to_numpy(float))
        return pdf.assign(**{c: y[:, j] for j, c in enumerate(channels)})

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def preprocessed(df: DataFrame, keys: Cols, i: str, channels: Cols, limit: float = 3.0) -> DataFrame:
    """The channels of each session, filtered, without the rows in which any is an outlier; other columns go with their rows."""
    return ts.zscore_rows(filtered(df, keys, i, channels), keys, channels, limit)


def _spectra(x: pd.Series, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which signals there are, and the power densities of all of them at once; signals have equal lengths."""
    given = x.notna().to_numpy()
    if not given.any():
        return given, np.zeros(0), np.zeros((0, 0))
    return given, *dsp.welch(np.stack([np.asarray(v, float) for v in x[given]]), rate, segment)


def epoch_artefacts(
    df: DataFrame, keys: Cols, i: str, invalid: str, channels: Cols = JUDGED, limits: Limits = Limits(), size: int = EPOCH, rate: float = RATE
) -> DataFrame:
    """(keys, epoch, n, cause): of each epoch of `size` samples the first cause that rejects it: for each channel nan, peak_amp, ptp, emg_ratio.

    df holds the filtered channels and whether a sample was invalid before. An incomplete epoch at a session's end is never rejected.
    """
    columns = [F.count("*").alias("n"), F.avg(F.col(invalid).cast("int")).alias("__null")]
    for c in channels:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(c).cast("double").alias("x"))))
        columns += [F.max(F.abs(c)).alias(f"__peak_{c}"), (F.max(c) - F.min(c)).alias(f"__ptp_{c}"), F.transform(ordered, lambda s: s["x"]).alias(f"__x_{c}")]
    found = df.withColumn("epoch", F.floor(F.col(i) / size)).groupBy(*keys, "epoch").agg(*columns)

    @F.pandas_udf("double")
    def muscle(x: pd.Series) -> pd.Series:
        given, f, p = _spectra(x, rate, size)
        out = np.full(len(x), np.nan)
        if given.any():
            out[given] = dsp.band_power(f, p, 30, 45) / (dsp.band_power(f, p, 1, 45) + 1e-12)
        return pd.Series(out)

    cause = F.when(F.col("n") < size, F.lit(None).cast("string"))
    for c in channels:
        found = found.withColumn(f"__muscle_{c}", muscle(F.when(F.col("n") == size, F.col(f"__x_{c}"))))
        cause = cause.when(F.col("__null") > limits.null, "nan").when(F.col(f"__peak_{c}") > limits.peak, "peak_amp")
        cause = cause.when(F.col(f"__ptp_{c}") > limits.ptp, "ptp").when(F.col(f"__muscle_{c}") > limits.muscle, "emg_ratio")
    return found.select(*keys, "epoch", "n", cause.alias("cause"))


def with_rejected(df: DataFrame, keys: Cols, i: str, invalid: str, epochs: DataFrame, size: int = EPOCH) -> DataFrame:
    """df with the samples of rejected epochs marked as invalid too."""
    bad = epochs.select(*keys, "epoch", F.col("cause").isNotNull().alias("__bad"))
    out = df.withColumn("epoch", F.floor(F.col(i) / size)).join(bad, [*keys, "epoch"], "left")
    return out.withColumn(invalid, F.col(invalid) | F.coalesce("__bad", F.lit(False))).drop("epoch", "__bad")


def band_powers(df: DataFrame, keys: Cols, i: str, t: str, channels: Cols, invalid: str) -> DataFrame:
    """(keys, k, t, channel, band, power) of windows of 2 s, every half second; null powers with over a quarter of samples invalid.

    A window's samples meet by arithmetic on their numbers; spectra are computed for whole Arrow batches of windows at once.
    """
    w = ts.count_windows(df, keys, i, WINDOW, STEP).groupBy(*keys, "k")
    lists = [F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(c).alias("x")))).alias(c) for c in channels]
    found = w.agg(F.percentile(t, 0.5).alias(t), (F.avg(F.col(invalid).cast("int")) > WINDOW_MAX_NULL).alias("__bad"), *lists)
    names = list(scalar.BANDS)

    @F.pandas_udf("array<double>")
    def powers(x: pd.Series) -> pd.Series:
        given, f, p = _spectra(x, RATE, SEGMENT)
        out = [None] * len(x)
        if given.any():
            for i, own in zip(np.flatnonzero(given), np.stack([dsp.band_power(f, p, *scalar.BANDS[b]) for b in names], 1).tolist()):
                out[i] = own
        return pd.Series(out, dtype=object)

    parts = []
    for c in channels:
        values = F.transform(c, lambda s: s["x"])
        band = F.posexplode(F.when(F.col("__bad"), F.array(*[F.lit(None).cast("double")] * len(names))).otherwise(powers(values)))
        one = found.select(*keys, "k", t, F.lit(c).alias("channel"), band.alias("__p", "power"))
        parts.append(one.withColumn("band", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__p") + 1)).drop("__p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "k", t, "channel", "band", "power")


def cognition(powers: DataFrame, keys: Cols, t: str) -> DataFrame:
    """(keys, k, t, indices, band means and shares) of each window."""

    def mean(band: str, *channels: str):
        return F.avg(F.when((F.col("band") == band) & F.col("channel").isin(*channels), F.col("power")))

    wide = powers.groupBy(*keys, "k", t).agg(
        *[mean(b, *JUDGED).alias(b) for b in scalar.BANDS],
        *[mean(b, c).alias(f"{c}_{b}") for c in ("AF7", "AF8", "LeftHemi", "RightHemi") for b in ("alpha", "beta", "theta")],
    )
    engaged = {c: F.col(f"{c}_beta") / (F.col(f"{c}_alpha") + F.col(f"{c}_theta") + agg.EPS) for c in ("AF7", "AF8", "LeftHemi", "RightHemi")}
    found = agg.cognition(F.col("beta"), F.col("alpha"), F.col("theta"))
    found |= {"frontal": (engaged["AF7"] + engaged["AF8"]) / 2, "lateralization": agg.lateralization(engaged["LeftHemi"], engaged["RightHemi"])}
    found |= agg.relative(list(scalar.BANDS))
    return wide.select(*keys, "k", t, *scalar.BANDS, *[c.alias(n) for n, c in found.items()])

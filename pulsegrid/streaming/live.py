"""Live windows of filtered muscle activity: the offline numbers, sample by sample, with the filter's state kept for each device."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions import dsp, scalar
from pulsegrid.operators.emotions import Model, scored

WINDOWS = "device_id string, k long, n_last long, rms array<double>"


class WindowState:
    """A causal filter and a ring of the last rows; a window of `size` rows every `step`; values are clipped softly at `clip` between both."""

    def __init__(self, b: np.ndarray, a: np.ndarray, size: int, step: int, rest: bool = True, clip: float | None = None) -> None:
        self.b, self.a, self.size, self.step, self.rest, self.clip = b, a, size, step, rest, clip
        self.zi: np.ndarray | None = None
        self.ring = np.zeros((0, 0))
        self.seen = 0

    def push(self, x: np.ndarray) -> list[tuple[int, int, list[float]]]:
        """Windows that the rows complete: number, number of the last row, RMS of each channel."""
        x = np.nan_to_num(np.asarray(x, float))
        if not len(x):
            return []
        if self.zi is None:
            self.zi = dsp.steady_state(self.b, self.a)[:, None] * x[:1] if self.rest else np.zeros((len(self.a) - 1, x.shape[1]))
            self.ring = np.zeros((0, x.shape[1]))
        y, self.zi = dsp.lfilter(self.b, self.a, x, self.zi)
        y = y if self.clip is None else self.clip * np.tanh(y / self.clip)
        rows = np.concatenate([self.ring, y])
        begin = self.seen - len(self.ring)
        self.seen += len(x)
        first = max(0, -(-(begin) // self.step))
        out = []
        k = first
        while k * self.step + self.size <= self.seen:
            part = rows[k * self.step - begin : k * self.step - begin + self.size]
            if k * self.step + self.size > self.seen - len(x):
                out.append((k, k * self.step + self.size - 1, np.sqrt((part * part).mean(0)).tolist()))
            k += 1
        self.ring = rows[max(0, len(rows) - self.size + 1) :]
        return out

    def dump(self) -> tuple:
        return self.zi.ravel().tolist(), self.ring.ravel().tolist(), self.ring.shape[1], self.seen

    def load(self, zi: list, ring: list, width: int, seen: int) -> None:
        self.zi, self.ring, self.seen = np.array(zi).reshape(-1, width), np.array(ring).reshape(-1, width), seen


def live_windows(
    rows: DataFrame, channels: list[str], low: float = 15.0, high: float = 45.0, fs: float = 250.0, size: int = 250, step: int = 125, order: int = 4,
    rest: bool = True, clip: float | None = None,
) -> DataFrame:
    """Windows of a stream of (device_id, n, channels), n ascending for each device; missing samples count as 0.

    The filter starts from the steady state of the first sample, or with rest=False from zero; clip: a soft limit of filtered values.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = WindowState(*dsp.butter(order, (low, high), fs, "band"), size, step, rest, clip)
        if state.exists:
            own.load(*state.get)
        pdf = pd.concat(list(batches)).sort_values("n")
        found = own.push(pdf[channels].to_numpy(float))
        state.update(own.dump())
        yield pd.DataFrame([(key[0], *w) for w in found], columns=["device_id", "k", "n_last", "rms"])

    kept = "zi array<double>, ring array<double>, width int, seen long"
    return rows.select("device_id", "n", *channels).groupBy("device_id").applyInPandasWithState(run, WINDOWS, kept, "append", GroupStateTimeout.NoTimeout)


def batch_windows(
    rows: DataFrame, channels: list[str], low: float = 15.0, high: float = 45.0, fs: float = 250.0, size: int = 250, step: int = 125, order: int = 4,
    rest: bool = True, clip: float | None = None,
) -> DataFrame:
    """The same windows of a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = WindowState(*dsp.butter(order, (low, high), fs, "band"), size, step, rest, clip)
        found = own.push(pdf.sort_values("n")[channels].to_numpy(float))
        return pd.DataFrame([(pdf.device_id.iloc[0], *w) for w in found], columns=["device_id", "k", "n_last", "rms"])

    return rows.select("device_id", "n", *channels).groupBy("device_id").applyInPandas(run, WINDOWS)


def live_scores(windows: DataFrame, model: Model, fs: float = 250.0) -> DataFrame:
    """Windows of live_windows() with time_sec, features, gated and the model's probabilities, label and confidence, window by window as they come.

    On a stream with a cooldown the windows since the last artefact are kept for each device; else nothing is. Nearest neighbours take no part.
    """
    out = windows.withColumn("time_sec", (F.col("n_last") + 1) / fs).withColumn("features", scalar.l2_with_mean(F.col("rms")))
    mean = F.element_at("features", -1)
    if not model.gated:
        out = out.withColumn("gated", F.lit(False))
    elif not model.cooldown:
        out = out.withColumn("gated", F.coalesce(mean > model.gate, F.lit(False)))
    else:
        out = _cooled(out, model.gate, model.cooldown)
    return scored(out, "features", model)


def _cooled(windows: DataFrame, gate: float, cooldown: int) -> DataFrame:
    """Adds `gated`: an artefact, or one in the `cooldown` windows before."""
    schema = windows.withColumn("gated", F.lit(False)).schema

    def mark(pdf: pd.DataFrame, since: int) -> tuple[pd.DataFrame, int]:
        pdf, gated = pdf.sort_values("k"), []
        for rms in pdf.rms:
            artefact = float(np.mean(rms)) > gate
            gated.append(artefact or since < cooldown)
            since = 0 if artefact else since + 1
        return pdf.assign(gated=gated), since

    if not windows.isStreaming:
        return windows.groupBy("device_id").applyInPandas(lambda pdf: mark(pdf, cooldown)[0], schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, since = mark(pd.concat(list(batches)), state.get[0] if state.exists else cooldown)
        state.update((since,))
        yield out

    return windows.groupBy("device_id").applyInPandasWithState(run, schema, "since int", "append", GroupStateTimeout.NoTimeout)


def live_filter(
    rows: DataFrame, channels: list[str], low: float = 15.0, high: float = 30.0, fs: float = 250.0, order: int = 2, reference: str | None = None
) -> DataFrame:
    """A stream's rows with causally filtered channels, for display; each device's filter starts at rest. reference: half of that channel is subtracted from all first."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b, a = dsp.butter(order, (low, high), fs, "band")
        pdf = pd.concat(list(batches)).sort_values("n")
        before = np.array(state.get[0]).reshape(-1, len(channels)) if state.exists else None
        y, z = dsp.lfilter(b, a, pdf[channels].fillna(0.0).to_numpy(float), before)
        state.update((z.ravel().tolist(),))
        yield pdf.assign(**{c: y[:, j] for j, c in enumerate(channels)})

    half = F.coalesce(F.col(reference).cast("double"), F.lit(0.0)) / 2 if reference else F.lit(0.0)
    clean = rows.select("device_id", "n", *[(F.col(c).cast("double") - half).alias(c) for c in channels])
    return clean.groupBy("device_id").applyInPandasWithState(run, clean.schema, "z array<double>", "append", GroupStateTimeout.NoTimeout)


def scroll_buffer(rows: DataFrame, channels: list[str], kept: int = 1250) -> DataFrame:
    """(device_id, n_last, channels as arrays) of a stream: each device's latest `kept` rows (five seconds of a headset), anew with every batch. For update mode."""
    schema = "device_id string, n_last long, " + ", ".join(f"{c} array<double>" for c in channels)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches)).sort_values("n")
        own = x[channels].to_numpy(float)
        if state.exists:
            own = np.concatenate([np.array(state.get[0], float).reshape(-1, len(channels)), own])
        own = own[-kept:]
        state.update((own.ravel().tolist(),))
        yield pd.DataFrame({"device_id": [key[0]], "n_last": [int(x.n.iloc[-1])], **{c: [own[:, j].tolist()] for j, c in enumerate(channels)}})

    clean = rows.select("device_id", "n", *[F.col(c).cast("double").alias(c) for c in channels])
    return clean.groupBy("device_id").applyInPandasWithState(run, schema, "x array<double>", "update", GroupStateTimeout.NoTimeout)


def recordings(rows: DataFrame, time: str, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Recordings of a stream cut at gaps: (device_id, window, n); rows later than `late` are dropped."""
    return rows.withWatermark(time, late).groupBy("device_id", F.session_window(time, gap)).agg(F.count("*").alias("n"))

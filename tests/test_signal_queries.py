"""Signal queries over sessions of any length."""

import datetime
import math
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.plans import signal_queries

LENGTHS = (1, 2, 3, 4, 5, 10, 11, 27, 28, 31, 32, 64, 300)
GROUPED = (
    "butter_filtfilt", "causal_filter", "welch_bands", "spectrogram", "fft_resample", "cubic_upsample", "peaks", "rolling_mad_long", "kernel_smooth",
    "sample_entropy", "emg_bands", "cvx_decompose",
)


def signal(n):
    return np.round(50 + 45 * np.sin(np.arange(n) * 1.3) + np.random.default_rng(n).normal(size=n), 3)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    start = datetime.datetime(2024, 1, 1)
    rows = [(n, 1000 * n + i, start + datetime.timedelta(seconds=i), float(y)) for n in LENGTHS for i, y in enumerate(signal(n))]
    path = str(tmp_path_factory.mktemp("short"))
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").write.parquet(f"{path}/events.parquet")
    return path


def found(spark, sf, name):
    out = defaultdict(list)
    for r in signal_queries.REGISTER.queries[name](spark, sf).collect():
        out[r.session_id].append(r)
    return out


@pytest.mark.parametrize("name", GROUPED)
def test_every_session_has_rows(spark, sf, name):
    out = found(spark, sf, name)
    if name == "peaks":
        for n in LENGTHS:
            assert sorted(r.i for r in out[n]) == dsp.find_peaks(signal(n), height=50, prominence=20, distance=4)[0].tolist()
        assert out[5] and out[31]
    else:
        assert set(out) == set(LENGTHS)
    least = {"spectrogram": 32, "emg_bands": 64, "sample_entropy": 4, "welch_bands": 64}.get(name, 0)
    for n in LENGTHS:
        values = [v for r in out[n] for v in r]
        assert all(v is None or math.isfinite(v) for v in values if not isinstance(v, str)), n
        if n >= least:
            assert None not in values, n
        elif name != "welch_bands":
            assert len(out[n]) == 1 and set(values[1:]) == {None}, n


def test_decomposition_with_the_solvers_rounds_says_whether_it_converged(spark, sf):
    out = found(spark, sf, "cvx_decompose")
    for n in (5, 64, 300):
        y = signal(n)
        d = dsp.decompose_eda((y - y.mean()) / (y.std() + 1e-12), 0.25)
        rows = sorted(out[n], key=lambda r: r.i)
        assert np.allclose([r.tonic for r in rows], d["tonic"], atol=1e-4) and {r.converged for r in rows} == {d["converged"]}
    assert not dsp.decompose_eda(signal(300), 0.25, rounds=3)["converged"]


def test_short_sessions_by_their_rules(spark, sf):
    series = lambda name, n: [r.y for r in sorted(found(spark, sf, name)[n], key=lambda r: r.i)]
    assert np.allclose(series("butter_filtfilt", 27), signal(27), atol=0.05) and not np.allclose(series("butter_filtfilt", 28), signal(28), atol=1)
    assert np.allclose(series("kernel_smooth", 10), signal(10)) and np.allclose(series("kernel_smooth", 11), dsp.kernel_smooth(signal(11), 11), atol=1e-4)
    a, b = signal(2)
    assert np.allclose(series("cubic_upsample", 2), np.linspace(a, b, 6), atol=1e-4) and np.allclose(series("cubic_upsample", 1), signal(1))
    assert len(series("fft_resample", 1)) == 2 and len(series("fft_resample", 31)) == 10
    powers = {n: {r.band: r.power for r in rows} for n, rows in found(spark, sf, "welch_bands").items()}
    assert set(powers[1].values()) == {None} and None not in powers[64].values() and any(powers[31].values())


def test_preprocessed_rows(spark):
    from pulsegrid.operators import eeg

    x = np.random.default_rng(5).normal(size=(600, 2)) + 3 * np.sin(np.arange(600) / 4)[:, None]
    x[300] = 400
    df = spark.createDataFrame([("s", i, float(a), float(b), i % 7 == 0) for i, (a, b) in enumerate(x)], "session_id string, i long, a double, b double, invalid boolean")
    out = eeg.preprocessed(df, ["session_id"], "i", ["a", "b"]).orderBy("i").toPandas()
    y = eeg.band_pass(x)
    keep = (np.abs((y - y.mean(0)) / y.std(0)) < 3).all(1)
    assert 0 < (~keep).sum() < 60 and out.i.tolist() == np.flatnonzero(keep).tolist() and np.allclose(out[["a", "b"]], y[keep])
    assert out.invalid.tolist() == [i % 7 == 0 for i in np.flatnonzero(keep)]

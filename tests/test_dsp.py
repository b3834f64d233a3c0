"""Signal kernels against closed forms and independent loops."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import eda, heart


def loop_filter(b, a, x, z=None):
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    z = np.zeros(n - 1) if z is None else z.copy()
    out = []
    for u in x:
        y = b[0] * u + z[0]
        z = np.append(z[1:], 0) + b[1:] * u - a[1:] * y
        out.append(y)
    return np.array(out), z


def response(b, a, f, fs):
    w = np.exp(-2j * np.pi * f / fs * np.arange(max(len(a), len(b))))
    return abs((b * w[: len(b)]).sum() / (a * w[: len(a)]).sum())


@pytest.mark.parametrize(("kind", "cut", "passed", "stopped"), [("low", 10.0, 0.0, 60.0), ("high", 10.0, 100.0, 1.0), ("band", (15.0, 45.0), 27.0, 3.0)])
def test_butterworth_gain(kind, cut, passed, stopped):
    b, a = dsp.butter(4, cut, 250.0, kind)
    assert abs(response(b, a, passed, 250) - 1) < 1e-3 and response(b, a, stopped, 250) < 0.01
    for edge in cut if isinstance(cut, tuple) else (cut,):
        assert abs(response(b, a, edge, 250) - 0.5**0.5) < 1e-6
    with pytest.raises(ValueError):
        dsp.butter(4, 130.0, 250.0, "low")


def test_filtering_in_blocks_is_the_recursion():
    b, a = dsp.butter(4, (15.0, 45.0), 250.0, "band")
    x = np.random.default_rng(1).normal(size=700)
    y, z = dsp.lfilter(b, a, x)
    slow, z_slow = loop_filter(b, a, x)
    assert np.allclose(y, slow, atol=1e-9) and np.allclose(z[:, 0], z_slow, atol=1e-9)
    first, z = dsp.lfilter(b, a, x[:333])
    rest, _ = dsp.lfilter(b, a, x[333:], z)
    assert np.allclose(np.concatenate([first, rest]), slow, atol=1e-9)


def test_filtfilt_keeps_constants_and_passes_sines_squared():
    b, a = dsp.butter(2, 5.0, 100.0, "low")
    assert np.allclose(dsp.filtfilt(b, a, np.full(200, 3.0)), 3.0)
    t = np.arange(2000) / 100
    y = dsp.filtfilt(b, a, np.sin(2 * np.pi * 4 * t))
    assert abs(np.abs(y[500:1500]).max() - response(b, a, 4, 100) ** 2) < 1e-2
    with pytest.raises(ValueError):
        dsp.filtfilt(b, a, np.zeros(5))


def test_notch():
    b, a = dsp.notch(60.0, 30.0, 250.0)
    assert response(b, a, 60, 250) < 1e-9 and abs(response(b, a, 20, 250) - 1) < 0.01


def test_welch_finds_the_power_of_a_sine():
    t = np.arange(5000) / 250
    f, p = dsp.welch(3 * np.sin(2 * np.pi * 10 * t), 250.0, 256)
    assert abs(dsp.band_power(f, p, 8, 13) - 4.5) < 0.25 and dsp.band_power(f, p, 30, 50) < 1e-3
    _, two = dsp.welch(np.stack([t, np.sin(t)]), 250.0, 256)
    assert two.shape == (2, 129)


def test_fourier_resampling_and_splines():
    t = np.arange(64) / 64
    x = np.sin(2 * np.pi * 3 * t)
    assert np.allclose(dsp.resample_fft(x, 128)[::2], x) and np.allclose(dsp.resample_fft(dsp.resample_fft(x, 31), 64), x)
    k = np.array([0.0, 1.0, 2.5, 3.0, 5.0, 6.0])
    cubic = lambda s: s**3 - 2 * s**2 + s - 1
    at = np.linspace(0, 6, 50)
    assert np.allclose(dsp.cubic_spline(k, cubic(k), at), cubic(at))


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 0, 5, 4, 6, 0], float)
    at, rise = dsp.find_peaks(x)
    assert at.tolist() == [1, 3, 6, 8, 10] and rise.tolist() == [1, 3, 2, 1, 6]
    assert dsp.find_peaks(x, height=2, distance=3)[0].tolist() == [3, 6, 10] or dsp.find_peaks(x, height=2, distance=3)[0].tolist() == [3, 10]
    assert dsp.find_peaks(x, prominence=2)[0].tolist() == [3, 6, 10]


def pulse(seconds, fs, bpm=66):
    t = np.arange(int(seconds * fs)) / fs
    beats = np.arange(0.5, seconds - 0.5, 60 / bpm)
    return t, beats, sum(np.exp(-(((t - b) / 0.08) ** 2)) for b in beats)


def test_pulse_peaks_and_variability():
    t, beats, x = pulse(120, heart.RATE)
    mask = np.zeros(len(x), bool)
    found = heart.detect(x, mask)
    near = np.abs(found[:, None] / heart.RATE - beats).min(0)
    assert (near < 0.1).mean() > 0.95 and len(found) <= len(beats) + 2
    out = heart.variability(found, mask)
    late = out[out.t > 40]
    assert abs(late.mean_hr.mean() - 66) < 1 and out.mean_hr[:5].isna().all()
    mask[3000:3010] = True
    assert heart.variability(found, mask).mean_hr[(out.t > 60) & (out.t < 85)].isna().all()


def test_variability_closed_form():
    ibis = np.tile([950, 1050], 40) / 1000
    out = heart.variability(np.round(np.cumsum(ibis) * heart.RATE), np.zeros(10_000, bool))
    row = out[out.t == 60].iloc[0]
    assert abs(row.mean_nn - 1000) < 5 and abs(row.rmssd - 100) < 15 and row.pnn50 > 95


def test_missing_beats_are_put_in():
    peaks = np.delete(np.arange(0, 51 * 40, 51), 20)
    filled, made = heart.fill_beats(peaks, np.zeros(3000, bool))
    assert made.sum() == 1 and abs(filled[made][0] - 20 * 51) <= 1
    mask = np.zeros(3000, bool)
    mask[20 * 51] = True
    assert heart.fill_beats(peaks, mask)[1].sum() == 0
    gap = np.concatenate([np.arange(0, 1000, 51), np.arange(3000, 4000, 51)])
    assert heart.fill_beats(gap, np.zeros(5000, bool))[1].sum() == 0  # over 20 s


def test_artefact_cap():
    x = np.sin(np.arange(20_000) / 8)
    x[5000:5003] = 60
    m = heart.artefacts(x)
    assert m[4800:5200].all() and m.mean() < 0.15
    x[::400] = 80
    assert not heart.artefacts(x).any()


def test_decomposition_is_optimal_and_adds_up():
    t = np.arange(480) / 4
    y = 0.01 * t + sum(np.where(t > s, np.exp(-(t - s) / 2) - np.exp(-(t - s) / 0.7), 0) for s in (20, 50, 90))
    y = (y - y.mean()) / y.std()
    d = dsp.decompose_eda(y, 0.25)
    assert d["driver"].min() >= 0 and np.abs(d["phasic"] + d["tonic"] - y).max() < 0.35
    phasic = d["phasic"]
    assert all(phasic[(t > s) & (t < s + 6)].max() > 3 * np.abs(phasic[(t > s - 8) & (t < s - 1)]).max() for s in (20, 50, 90))
    longer = dsp.decompose_eda(y, 0.25, rounds=4000)
    assert np.abs(longer["phasic"] - phasic).max() < 0.05


def test_skin_components_and_responses():
    t = np.arange(int(60 * eda.RATE)) / eda.RATE
    x = 5 + 0.01 * t + np.where(t > 30, 2 * (np.exp(-(t - 30) / 2) - np.exp(-(t - 30) / 0.7)), 0)
    x[:20] = np.nan
    tonic, phasic = eda.components(x)
    assert np.isnan(tonic[:20]).all() and np.nanmax(np.abs(tonic + phasic - x)) < 0.6
    at, amplitude, _ = eda.responses(phasic)
    assert any(abs(a - 31) < 1.5 for a in at) and (amplitude >= eda.SCR_HEIGHT).all()


def test_ranging_and_smoothing_and_entropy():
    c = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 1], [10, 10, 2.0]])
    p = np.array([3.0, 4.0, 1.0])
    assert np.abs(dsp.multilaterate(c, np.linalg.norm(c - p, axis=1)) - p).max() < 1e-3
    assert np.allclose(dsp.kernel_smooth(np.ones(50), 7, "hamming"), 1)
    assert dsp.sample_entropy(np.sin(np.arange(300) / 5)) < dsp.sample_entropy(np.random.default_rng(3).normal(size=300))


def test_long_rolling_median_equals_pandas():
    x = pd.Series(np.random.default_rng(4).normal(size=300))
    assert np.allclose(x.rolling(51, center=True, min_periods=1).median().to_numpy(), [np.median(x[max(0, i - 25) : i + 26]) for i in range(300)])


def test_muscle_signals():
    from pulsegrid.operators import emg

    t = np.arange(2500) / emg.RATE
    x = np.stack([np.sin(2 * np.pi * 30 * t) * (t > 5), np.sin(2 * np.pi * 5 * t)], 1)
    y = emg.envelope(emg.conditioned(x))
    assert y[1900:2300, 0].min() > 0.5 and y[500:2000, 1].max() < 0.02
    p = emg.band_powers(x[:, 0])
    assert p.shape == ((2500 - 250) // 125 + 1, 5) and p[-1].argmax() == 2
    assert np.allclose(emg.upsampled(np.array([0.0, 1.0]), 4), [0, 1 / 3, 2 / 3, 1])


@pytest.mark.parametrize("kind", ["flat", "hanning", "hamming", "bartlett", "blackman"])
@pytest.mark.parametrize(("n", "size"), [(100, 11), (100, 3), (60, 25), (100, 10), (12, 11)])
def test_kernel_smoothing_by_its_definition(n, size, kind):
    x = np.random.default_rng(n).normal(size=n)
    w = np.ones(size) if kind == "flat" else getattr(np, kind)(size)
    reach = (size - 1) // 2
    mirrored = lambda i: x[-i if i < 0 else 2 * (n - 1) - i if i >= n else i]
    expected = [sum(w[size - 1 - j] * mirrored(i + j - reach) for j in range(size)) / w.sum() for i in range(n - (size + 1) % 2)]
    found = dsp.kernel_smooth(x, size, kind)
    assert len(found) == n - (size + 1) % 2 and np.allclose(found, expected)
    assert np.array_equal(dsp.kernel_smooth(x, 2), x)


def test_filled_beats_enter_the_history():
    from pulsegrid.operators.heart import fill_beats

    # 16 gaps of 120 samples are two intervals of 60 each; then 60 is usual, so that 85 isn't a gap, and 95 is one
    steps = [51] * 40 + [120] * 16 + [85, 95]
    peaks = np.concatenate([[10], 10 + np.cumsum(steps)])
    found, made = fill_beats(peaks, np.zeros(peaks[-1] + 2, bool))
    assert made.sum() == 17 and set(peaks) <= set(found) and np.diff(found).max() == 85
    assert made[-2] and not made[-3]


def test_beats_aren_t_filled_over_masks_and_long_gaps():
    from pulsegrid.operators.heart import fill_beats

    peaks = np.concatenate([np.arange(0, 51 * 20, 51), [51 * 19 + 153, 51 * 19 + 153 + 1100, 51 * 19 + 153 + 1100 + 153]])
    mask = np.zeros(peaks[-1] + 2, bool)
    mask[51 * 19 + 70] = True
    found, made = fill_beats(peaks, mask)
    assert made.sum() == 2 and (found[made] > peaks[-2]).all()  # masked; longer than 20 s; two beats are missing


def test_online_calibrator_is_the_plain_one():
    from pulsegrid.operators.emotions import EPS, OnlineCalibrator

    x = np.random.default_rng(3).gamma(2.0, 5.0, (900, 3))
    x[200:210] *= 400
    own = OnlineCalibrator(3)
    mean, var, energies = np.log(x[0] + EPS), np.ones(3), []
    for row in x:
        logs = np.log(row + EPS)
        z = (logs - mean) / np.sqrt(var)
        ok, gap = np.abs(z) <= 3.5, logs - mean
        mean, var = np.where(ok, mean + 0.001 * gap, mean), np.where(ok, 0.997 * var + 0.003 * gap**2, var)
        energies = [*energies, np.sqrt((row**2).sum())][-600:]
        n, s = len(energies), np.sort(energies)
        low, high = np.median(s[int(0.02 * n) : max(int(0.02 * n) + 1, int(0.3 * n))]), np.median(s[int(0.3 * n) : max(int(0.3 * n) + 1, int(0.6 * n))])
        energy = 0.5 if n < 30 else 1 / (1 + np.exp(-(energies[-1] - low) / max(high - low, EPS)))
        direction, found = own.push(row)
        assert np.allclose(direction, z / (np.linalg.norm(z) + EPS)) and np.isclose(found, energy)


def test_splines_are_convolved_boxes():
    box = np.ones(5)
    bell = np.convolve(np.convolve(box, box), np.convolve(box, box))
    basis = dsp._spline_basis(41, 5)
    assert basis.shape == (41, 9) and np.allclose(basis[:, 4][20 - 8 : 20 + 9], bell / bell.max()) and basis[:, 4][:12].max() == 0

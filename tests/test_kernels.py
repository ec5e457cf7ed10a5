"""Numeric kernels against plain definitions."""

import numpy as np
import pytest

from fiberlake.functions import kernels as K


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    h = 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        h = h * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return abs(h)


def test_butterworth_band():
    sos = K.butter_bandpass_sos(0.3, 2.0, 10.4167)
    assert sos.shape == (4, 6)
    assert response(sos, 0.0, 10.4167) < 1e-9 and response(sos, 10.4167 / 2, 10.4167) < 1e-9
    for edge in (0.3, 2.0):
        assert response(sos, edge, 10.4167) == pytest.approx(2**-0.5, rel=1e-6)
    # the analogue centre maps to gain one
    w = np.tan(np.pi * np.array([0.3, 2.0]) / 10.4167)
    centre = np.arctan(np.sqrt(w[0] * w[1])) * 10.4167 / np.pi
    assert response(sos, centre, 10.4167) == pytest.approx(1.0, rel=1e-9)


@pytest.mark.parametrize("low,high,fs", [(0, 1, 10), (2, 1, 10), (1, 6, 10)])
def test_band_must_fit(low, high, fs):
    with pytest.raises(ValueError):
        K.butter_bandpass_sos(low, high, fs)


def test_chunks_equal_whole():
    x = np.random.default_rng(0).normal(size=(5, 240))
    sos = K.butter_bandpass_sos(0.3, 2.0, 10.4167)
    whole, _ = K.sosfilt(sos, x)
    z, parts = None, []
    for at in range(0, 240, 24):
        y, z = K.sosfilt(sos, x[:, at : at + 24], z)
        parts.append(y)
    assert np.abs(np.concatenate(parts, 1) - whole).max() < 1e-12


def test_non_finite_counts_as_zero():
    sos = K.butter_bandpass_sos(0.3, 2.0, 10.4167)
    x = np.ones((1, 50))
    y = x.copy()
    x[0, 7], y[0, 7] = np.nan, 0.0
    assert np.allclose(K.sosfilt(sos, x)[0], K.sosfilt(sos, y)[0])


def test_zero_phase_keeps_a_tone_in_place():
    fs = 10.4167
    t = np.arange(600) / fs
    x = np.sin(2 * np.pi * 0.9 * t)[None]
    y = K.sosfiltfilt(K.butter_bandpass_sos(0.3, 2.0, fs), x)
    assert np.abs(y[0, 150:450] - x[0, 150:450]).max() < 0.02


def test_steady_state_of_each_section():
    sos = K.butter_bandpass_sos(0.3, 2.0, 10.4167)
    y, _ = K.sosfilt(sos, np.ones((1, 30)), K._steady(sos)[:, None, :])
    assert np.ptp(y) < 1e-9


def brute_peaks(x, height=None, prominence=None):
    out = []
    i = 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    if height is not None:
        out = [p for p in out if x[p] >= height]
    if prominence is not None:
        keep = []
        for p in out:
            i, left = p, x[p]
            while i >= 0 and x[i] <= x[p]:
                left = min(left, x[i])
                i -= 1
            i, right = p, x[p]
            while i < len(x) and x[i] <= x[p]:
                right = min(right, x[i])
                i += 1
            if x[p] - max(left, right) >= prominence:
                keep.append(p)
        out = keep
    return out


def test_peaks():
    rng = np.random.default_rng(1)
    for _ in range(100):
        x = rng.integers(0, 6, 40).astype(float)
        assert K.find_peaks(x).tolist() == brute_peaks(x)
        assert K.find_peaks(x, 3).tolist() == brute_peaks(x, 3)
        assert K.find_peaks(x, 2, 1, 2.0).tolist() == brute_peaks(x, 2, 2.0)
    x = np.zeros(30)
    x[[5, 7, 20]] = [3, 5, 4]
    assert K.find_peaks(x, 1, 4).tolist() == [7, 20]


def test_counts_with_fallback():
    seg = np.array([0, 6, 0, 0, 0, 11, 0, 0, 0, 7, 0], float)
    assert K.count_peaks(seg, 5, 10, 10.0) == (3, 2, 1)
    assert K.count_peaks(np.array([1, 2, 6.0]), 5, 10, 10.0) == (1, 1, 0)
    assert K.count_peaks(np.array([1, 2, 12.0]), 5, 10, 10.0) == (1, 0, 1)
    assert K.count_peaks(np.array([1.0, 2.0]), 5, 10, 10.0) == (0, 0, 0)
    assert K.count_peaks(np.array([]), 5, 10, 10.0) == (0, 0, 0)


def test_lag_and_shift():
    rng = np.random.default_rng(2)
    a = rng.normal(size=100)
    assert K.best_lag(a, np.roll(a, 3), 5) == 3
    assert K.best_lag(a, np.roll(a, -2), 5) == -2
    x = np.arange(10.0)
    assert np.allclose(K.shift_linear(x, 1.5)[:8], x[:8] + 1.5)
    assert K.shift_linear(x, 20)[0] == 9


def test_simplify():
    p = np.array([[0, 0], [1, 0.001], [2, 0], [3, 1], [4, 0]], float)
    assert K.simplify(p, 0.01).tolist() == [0, 2, 3, 4]
    assert K.simplify(p[:1], 0.01).tolist() == [0]

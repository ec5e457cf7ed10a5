"""Numeric kernels on arrays: band-pass filters, peaks, shifts, interpolation.

They run inside tasks on one window or one block of channels; Spark deals the work.
"""

from __future__ import annotations

import numpy as np


def butter_bandpass_sos(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections (order x 6) of a Butterworth band-pass.

    The analogue prototype's poles are moved to the band and mapped by the bilinear
    transform; each section pairs a pole with its conjugate, a zero at 1 and one at -1.
    """
    if not 0 < low < high < fs / 2:
        raise ValueError(f"need 0 < {low} < {high} < {fs / 2}")
    warped = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    gain = width**order
    gain = np.real(gain * (2 * fs) ** order / np.prod(2 * fs - poles))
    z = (2 * fs + poles) / (2 * fs - poles)
    z = z[np.imag(z) > 0]
    if len(z) != order:
        raise ValueError("band too wide for conjugate pole pairs")
    z = z[np.argsort(np.abs(z))]
    sos = np.zeros((order, 6))
    sos[:, 0], sos[:, 2], sos[:, 3] = 1, -1, 1
    sos[:, 4], sos[:, 5] = -2 * z.real, np.abs(z) ** 2
    sos[0, :3] *= gain
    return sos


def sosfilt(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter ``x`` (channels x time) causally; state is (sections x channels x 2)."""
    y = np.array(x, np.float64)
    y[~np.isfinite(y)] = 0.0
    state = np.zeros((len(sos), len(y), 2)) if state is None else state.copy()
    for (b0, b1, b2, _, a1, a2), z in zip(sos, state):
        z0, z1 = z[:, 0].copy(), z[:, 1].copy()
        for t in range(y.shape[1]):
            v = y[:, t].copy()
            o = b0 * v + z0
            z0 = b1 * v - a1 * o + z1
            z1 = b2 * v - a2 * o
            y[:, t] = o
        z[:, 0], z[:, 1] = z0, z1
    return y, state


def state_table(sos: np.ndarray, n: int) -> np.ndarray:
    """Row j: the state (sections x 2, flat) that a 1 leaves j steps later; so ``x @ state_table(sos, n)[::-1]`` is the state after x."""
    out, z, y = np.zeros((n, len(sos), 2)), np.zeros((len(sos), 1, 2)), np.ones((1, 1))
    for j in range(n):
        z = sosfilt(sos, y, z)[1]
        out[j], y = z[:, 0], np.zeros((1, 1))
    return out.reshape(n, -1)


def state_step(sos: np.ndarray) -> np.ndarray:
    """What a state (flat, as a row) becomes in one step without input: ``z @ state_step(sos)``."""
    m = 2 * len(sos)
    z = np.eye(m).reshape(m, len(sos), 2).transpose(1, 0, 2)
    return sosfilt(sos, np.zeros((m, 1)), z)[1].transpose(1, 0, 2).reshape(m, m)


def by_section(z: np.ndarray, sections: int) -> np.ndarray:
    """Flat states of channels (rows) as ``sosfilt`` takes them."""
    return z.reshape(len(z), sections, 2).transpose(1, 0, 2)


def padding(sos: np.ndarray) -> int:
    """Samples that the zero-phase filter adds at both ends, if there are as many."""
    return int(3 * (2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())))


def steady(sos: np.ndarray) -> np.ndarray:
    """The flat state for a constant input of 1."""
    return _steady(sos).ravel()


def _steady(sos: np.ndarray) -> np.ndarray:
    """State of each section for a constant input of 1 (sections x 2)."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k, 1] = scale * (b2 - a2 * gain)
        out[k, 0] = scale * (b1 - a1 * gain) + out[k, 1]
        scale *= gain
    return out


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter: forwards and backwards over an odd extension at both ends."""
    x = np.array(x, np.float64)
    x[~np.isfinite(x)] = 0.0
    pad = min(padding(sos), x.shape[1] - 1)
    if pad > 0:
        x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    zi = _steady(sos)[:, None, :]
    y, _ = sosfilt(sos, x, zi * x[None, :, :1])
    y, _ = sosfilt(sos, y[:, ::-1], zi * y[None, :, -1:])
    y = y[:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad > 0 else y


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Strict local maxima (middle of a plateau), then height, distance and prominence, in this order."""
    x = np.asarray(x, np.float64)
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))  # runs of equal values
    stop = np.append(edge[1:], n)
    v = x[edge]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    peaks = (edge[top] + stop[top] - 1) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < distance
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        good = []
        for p in peaks:
            higher = np.flatnonzero(x[:p] > x[p])
            left = x[(higher[-1] if len(higher) else 0) : p + 1].min()
            higher = np.flatnonzero(x[p + 1 :] > x[p])
            right = x[p : p + 1 + (higher[0] if len(higher) else n - p - 1)].min()
            good.append(x[p] - max(left, right) >= prominence)
        peaks = peaks[np.array(good)]
    return peaks


def count_peaks(segment: np.ndarray, detect: float, classify: float, fs: float, gap_s: float = 0.25) -> tuple[int, int, int]:
    """(vehicles, cars, trucks) of one interval's statistic."""
    segment = np.asarray(segment, np.float64)
    if not len(segment) or not np.isfinite(segment).any():
        return 0, 0, 0
    peaks = find_peaks(segment, detect, max(1, int(gap_s * fs)), max(1.0, 0.1 * detect))
    if not len(peaks):
        top = np.nanmax(segment)
        return (1, int(top < classify), int(top >= classify)) if top >= detect else (0, 0, 0)
    trucks = int((segment[peaks] >= classify).sum())
    return len(peaks), len(peaks) - trucks, trucks


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Samples by which ``b`` comes after ``a``: the lag of the largest cross-correlation, the smallest of equal ones."""
    n, best, top = len(a), 0, -np.inf
    for lag in sorted(range(-most, most + 1), key=lambda k: (abs(k), k)):
        x, y = (a[: n - lag], b[lag:]) if lag >= 0 else (a[-lag:], b[: n + lag])
        s = float(x @ y)
        if s > top:
            best, top = lag, s
    return best


def shift_linear(x: np.ndarray, shift: float) -> np.ndarray:
    """x at t + shift, by linear interpolation, held at the ends."""
    n = len(x)
    if n < 2:
        return np.array(x, np.float64)
    at = np.clip(np.arange(n) + shift, 0, n - 1)
    lo = np.minimum(at.astype(np.int64), n - 2)
    return x[lo] + (at - lo) * (x[lo + 1] - x[lo])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that the Douglas-Peucker rule keeps of a polyline (n x 2)."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)

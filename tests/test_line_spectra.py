"""Line-spectral curves against numpy's roots, for all orders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lapwing.operators import line_spectra


def rooted(a: np.ndarray) -> np.ndarray:
    """The angles in (0, pi) of the roots of the symmetric and antisymmetric polynomials, by numpy."""
    full = np.concatenate(([1.0], a, [0.0]))
    angles = np.concatenate([np.angle(np.roots(p)) for p in (full + full[::-1], full - full[::-1])])
    return np.sort(angles[(angles > 1e-5) & (angles < math.pi - 1e-5)])


def stable(rng, order: int) -> np.ndarray:
    a = np.zeros(0)
    for _ in range(order):
        k = rng.uniform(-0.6, 0.6)
        a = np.append(a + k * a[::-1], k)
    return a


def test_frequencies_equal_roots():
    rng = np.random.default_rng(4)
    for order in range(1, 17):
        filters = np.array([stable(rng, order) for _ in range(20)])
        for a, angles in zip(filters, line_spectra.frequencies(filters)):
            assert len(angles) == order and np.allclose(angles, rooted(a), atol=1e-6)
            w = np.linspace(0.1, 3, 9)
            magnitude = 1 / np.abs(1 + np.exp(-1j * np.outer(w, np.arange(1, order + 1))) @ a)
            even, odd = np.prod(4 * (np.cos(angles[::2]) - np.cos(w)[:, None]) ** 2, axis=1), np.prod(4 * (np.cos(angles[1::2]) - np.cos(w)[:, None]) ** 2, axis=1)
            p, q = ((1 - np.cos(w) ** 2) * odd, even / 4) if order % 2 else ((1 - np.cos(w)) / 2 * odd, (1 + np.cos(w)) / 2 * even)
            assert np.allclose(1 / np.sqrt(p + q), magnitude, rtol=1e-6)


def test_curves_by_numpy(spark):
    rng = np.random.default_rng(9)
    n, rate, size, bits, offset = 48, 32_000.0, 40, 6, 32
    rows = [(k, (np.exp(rng.normal(size=n).cumsum() / 3) * 0.01 + 1e-4).tolist()) for k in range(12)]
    rows += [(50, [0.5] * n), (51, [0.0] + [1.0] * (n - 1)), (52, None), (53, [1.0] * (n - 1)), (54, [math.inf] * n)]
    got = line_spectra.fitted_curves(spark.createDataFrame(rows, "frame long, envelope array<double>"), ["frame"], n, rate, size, range(2, 17)).collect()
    assert {r.frame for r in got} == {*range(12), 50}
    places = line_spectra.bark_places(n, rate, size)
    for r in got:
        x = np.log(np.array(r.envelope))
        power = (x - x.min() + 1e-3) ** 2
        held, last = [], None
        for m in range(size):
            here = [power[k] for k in range(n) if places[k] == m]
            last = np.mean(here) if here else last
            held.append(last)
        angles = np.pi * np.arange(size) / size
        edges = np.concatenate(([0], (angles[1:] + angles[:-1]) / 2, [np.pi]))
        lags = np.array([(np.array(held) * np.cos(j * angles) * np.diff(edges)).sum() / np.pi for j in range(r.order + 1)])
        lags[0] *= 1 + 1e-9
        toeplitz = np.array([[lags[abs(i - j)] for j in range(r.order)] for i in range(r.order)])
        a = np.linalg.solve(toeplitz, -lags[1:])
        w = np.pi * np.array(places) / size
        g = 1 / np.abs(1 + np.exp(-1j * np.outer(w, np.arange(1, r.order + 1))) @ a)
        step, shift = 0.11512925 * offset / (2**bits - 1), 0.11512925 * offset
        amplitude = min(63, max(1, round((g * (x + shift) / step).sum() / (g * g).sum())))
        assert r.amplitude == amplitude and np.allclose(r.curve, np.exp(step * amplitude * g - shift), atol=1e-6, rtol=1e-6)


def test_lag_weights_integrate_a_flat_power():
    w = line_spectra.lag_weights(64, 44_100.0, 24, 5)
    assert np.allclose(w.sum(1)[0], 1) and w.shape == (6, 64)


def test_log_error(spark):
    r = spark.range(1).select(line_spectra.log_error(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0))).alias("e")).first().e
    assert math.isclose(r.signal, math.log(2) ** 2) and math.isclose(r.error, math.log(2) ** 2)

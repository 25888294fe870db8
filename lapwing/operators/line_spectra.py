"""Smooth envelopes by line-spectral frequencies: prediction filters to frequencies, curves rendered from these, the choice of an order.

The frequencies are the roots on the unit circle of a filter's symmetric and antisymmetric polynomials. They are isolated by sign
changes on a grid and halved, for a whole Arrow batch of filters at a time; as column expressions the same polynomials, written out over
4,096 cells a filter, took over a hundred times as long. Everything else is column expressions, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit
from lapwing.operators.decode import prediction_filter
from lapwing.operators.scan import worked_out

#: Cells of the grid in which roots are isolated, and halvings of a cell.
CELLS, HALVINGS = 4096, 60
#: Fixed value of the format: the highest order.
MOST_ORDER = 255
#: Filters that are looked up on the grid together.
ROWS = 256
#: Fixed values of the format: the natural logarithm of a decibel, and the least of a root.
DECIBEL, LEAST = 0.11512925, 1.17549435e-38
#: Added to logarithms over their least one, so that no power is zero; and to the first lag, so that filters stay stable.
ABOVE, LOAD = 1e-3, 1e-9
#: Below this a curve counts as this in logarithms.
FAINT = 1e-30


def _bark(hz: float) -> float:
    return 13.1 * math.atan(7.4e-4 * hz) + 2.24 * math.atan(1.85e-8 * hz * hz) + 1e-4 * hz


def bark_places(n: int, rate: float, size: int) -> list[int]:
    """The place of each of n bins on a Bark map of `size` places."""
    top = _bark(rate / 2)
    return [min(math.floor(_bark(rate * k / (2 * n)) * size / top), size - 1) for k in range(n)]


def lag_weights(n: int, rate: float, size: int, lags: int) -> np.ndarray:
    """What each bin's power adds to each lag, up to `lags`: the mean of a place's bins, empty places as the one before, integrated over angles."""
    places = bark_places(n, rate, size)
    held, now = [], places[0]
    for m in range(size):
        now = m if m in places else now
        held.append(now)
    angles = np.pi * np.arange(size) / size
    edges = np.concatenate(([0], (angles[1:] + angles[:-1]) / 2, [np.pi]))
    of = np.cos(np.outer(np.arange(lags + 1), angles)) * np.diff(edges) / np.pi
    out = np.zeros((lags + 1, n))
    for m, h in enumerate(held):
        bins = [k for k, p in enumerate(places) if p == h]
        out[:, bins] += of[:, m : m + 1] / len(bins)
    return out


def _total(a: Column) -> Column:
    return F.aggregate(a, lit(0), lambda s, x: s + x)


def autocorrelation(envelope: Column, n: int, rate: float, size: int, lags: int) -> Column:
    """Lags 0 to `lags` of a positive envelope's shifted squared logarithm on the Bark map."""
    rows = F.array(*[F.array(*map(lit, row)) for row in lag_weights(n, rate, size, lags).tolist()])
    logs = F.transform(envelope, lambda v: F.ln(v))
    power = let(logs, lambda g: let(F.array_min(g), lambda low: F.transform(g, lambda v: (v - low + lit(ABOVE)) * (v - low + lit(ABOVE)))))
    lagged = let(power, lambda p: F.transform(rows, lambda row: _total(F.zip_with(row, p, lambda w, v: w * v))))
    return F.transform(lagged, lambda r, k: F.when(k == 0, r * lit(1 + LOAD)).otherwise(r))


def _reduced(a: np.ndarray) -> list[np.ndarray]:
    """The symmetric and the antisymmetric polynomial of filters a[:, 0..order), lowest first, their known roots at 1 and -1 divided out."""
    full = np.concatenate((np.ones((len(a), 1)), a, np.zeros((len(a), 1))), axis=1)
    plus, minus = full + full[:, ::-1], full - full[:, ::-1]

    def quotient(c: np.ndarray, sign: float) -> np.ndarray:  # by 1 + sign / z
        q = c[:, :-1].copy()
        for k in range(1, q.shape[1]):
            q[:, k] -= sign * q[:, k - 1]
        return q

    if a.shape[1] % 2:
        return [plus, quotient(quotient(minus, -1.0), 1.0)]
    return [quotient(plus, 1.0), quotient(minus, -1.0)]


def frequencies(a: np.ndarray) -> list[np.ndarray | None]:
    """The line-spectral frequencies of each filter, ascending; None where fewer than the order are found.

    A palindrome of degree 2m is a sum of cosines 0 to m of its angle. All filters are looked up on one grid, by a product of matrices;
    cells whose ends differ in sign are halved together.
    """
    order = a.shape[1]
    edges = np.concatenate(([1e-6], math.pi * np.arange(1, CELLS + 1) / (CELLS + 1)))
    row, angle = [], []
    for c in _reduced(a):
        m = c.shape[1] // 2
        series = np.concatenate((c[:, m : m + 1], 2 * c[:, m - 1 :: -1][:, :m]), axis=1) if m else c[:, :1]
        values = series @ np.cos(np.outer(np.arange(m + 1), edges))
        at, cell = np.nonzero((values[:, :-1] == 0) | ((np.sign(values[:, :-1]) != np.sign(values[:, 1:])) & (values[:, 1:] != 0)))
        low, high, up = edges[cell], edges[cell + 1], values[at, cell] > 0
        high = np.where(values[at, cell] == 0, low, high)
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            v = (series[at] * np.cos(middle[:, None] * np.arange(m + 1))).sum(1)
            beyond = (v > 0) != up
            low, high = np.where((v == 0) | ~beyond, middle, low), np.where((v == 0) | beyond, middle, high)
        row.append(at)
        angle.append((low + high) / 2)
    row, angle = np.concatenate(row), np.concatenate(angle)
    by = np.lexsort((angle, row))
    bounds = np.searchsorted(row[by], np.arange(len(a) + 1))
    return [angle[by[i:j]][:order] if j - i >= order else None for i, j in zip(bounds[:-1], bounds[1:])]


def line_spectrum(filters: DataFrame) -> DataFrame:
    """filters (order, a and any other columns) with angles in a's place: null where there are fewer frequencies than the order."""
    at, of = filters.columns.index("a"), filters.columns.index("order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                orders, found = part.column(of).to_numpy(), [None] * part.num_rows
                for order in np.unique(orders).tolist():
                    rows = np.flatnonzero(orders == order)
                    for r, angles in zip(rows.tolist(), frequencies(np.array(part.column(at).take(pa.array(rows)).to_pylist(), np.float64).reshape(len(rows), order))):
                        found[r] = angles
                yield pa.record_batch([pa.array(found, pa.list_(pa.float64())) if c == at else part.column(c) for c in range(part.num_columns)], names)

    names = ["angles" if c == "a" else c for c in filters.columns]
    return filters.mapInArrow(run, ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, filters.schema.fields)))


def curve_weight(angles: Column, order: Column, cosine: Column) -> Column:
    """One over the root of the two products of frequencies at an angle of that cosine."""
    product = lambda first, start: F.aggregate(F.filter(angles, lambda w, j: j % 2 == first), start, lambda p, w: p * 4 * (F.cos(w) - cosine) * (F.cos(w) - cosine))
    odd = order % 2 == 1
    p = product(1, F.when(odd, lit(1) - cosine * cosine).otherwise((lit(1) - cosine) / 2))
    q = product(0, F.when(odd, lit(0.25)).otherwise((lit(1) + cosine) / 2))
    return lit(1) / F.greatest(F.sqrt(F.greatest(p + q, lit(0))), lit(LEAST))


def fitted_curves(envelopes: DataFrame, keys: list[str], n: int, rate: float, size: int, orders: range, bits: int = 6, offset: int = 32) -> DataFrame:
    """(keys, envelope, order, amplitude, curve) of (keys, envelope), a row for each order that can be fitted; amplitude is a whole number of `bits` bits.

    Envelopes are n values above 0; others, and orders whose filter isn't stable, give no row.
    """
    if not 1 <= orders.start < orders.stop <= MOST_ORDER + 1:
        raise ValueError(f"orders from 1 to {MOST_ORDER}")
    positive = (F.size("envelope") == n) & F.forall("envelope", lambda v: F.coalesce((v > 0) & (v < lit(float("inf"))), F.lit(False)))
    rows = worked_out(envelopes.where(positive).select(*keys, "envelope"), "r", autocorrelation(F.col("envelope"), n, rate, size, orders.stop - 1))
    rows = rows.select(*keys, "envelope", "r", F.explode(F.array(*map(F.lit, orders))).alias("order"))
    filters = worked_out(rows, "f", prediction_filter(F.col("r"), F.col("order"))).where("f is not null").select(*keys, "envelope", "order", "f.a")
    spectra = line_spectrum(filters).where("angles is not null")
    cosines = F.array(*[lit(math.cos(math.pi * p / size)) for p in bark_places(n, rate, size)])
    of = worked_out(spectra, "g", F.transform(cosines, lambda c: curve_weight(F.col("angles"), F.col("order"), c)))
    step, shift = DECIBEL * offset / (2**bits - 1), DECIBEL * offset
    fit = _total(F.zip_with("g", "envelope", lambda g, v: g * (F.ln(v) + lit(shift)) / lit(step))) / _total(F.transform("g", lambda g: g * g))
    of = worked_out(of, "amplitude", F.greatest(lit(1), F.least(lit(2**bits - 1), F.round(fit))).cast("int"))
    of = worked_out(of, "curve", F.transform("g", lambda g: F.exp(lit(step) * F.col("amplitude") * g - lit(shift))))
    return of.select(*keys, "envelope", "order", "amplitude", "curve")


def log_error(envelope: Column, curve: Column) -> Column:
    """(signal, error): sums of squares of the envelope's logarithms, and of their differences from the curve's."""
    ln = lambda v: F.ln(F.greatest(v, lit(FAINT)))
    return F.struct(_total(F.transform(envelope, lambda e: ln(e) * ln(e))).alias("signal"), _total(F.zip_with(envelope, curve, lambda e, c: (ln(e) - ln(c)) * (ln(e) - ln(c)))).alias("error"))

"""Models of one series: sine, Fourier and polynomial fits, the choice among them, and their values again.

A fit is (method, coefficients, error, cost): the error is the mean squared error over the variance (over 1 where the
variance is nil), the cost the bytes that the parameters take. Coefficients are
  sine        frequency, amplitude, phase, offset
  fourier     index, magnitude, phase of each term, then the offset
  polynomial  highest degree first
Series are arrays of doubles; a series that can't be fitted gives None. Values that aren't finite are never fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the models: shortest series, terms and energy of a Fourier fit, degree of a polynomial, accepted error and
# ratio, costs, least amplitude, variance of a constant, smallest pivot.
SINE_LEAST, FOURIER_LEAST, POLYNOMIAL_LEAST = 4, 8, 2
TERMS, ENERGY, DEGREE = 20, 0.99, 5
MAX_ERROR, MIN_RATIO = 0.01, 1.5
SINE_COST, TERM_COST, COEFFICIENT_COST, OFFSET_COST, OVERHEAD = 64, 20, 8, 8, 32
FLAT, CONSTANT, PIVOT = 1e-10, 1e-15, 1e-8


@dataclass
class Fit:
    method: str
    coefficients: list[float] = field(default_factory=list)
    error: float = 0.0
    cost: int = 0


Term = tuple[int, float, float]


def relative_error(values: np.ndarray, fitted: np.ndarray) -> float:
    mse, variance = float(np.mean((values - fitted) ** 2)), float(values.var())
    return mse / variance if variance > CONSTANT else mse


def sine(n: int, frequency: float, amplitude: float = 1.0, phase: float = 0.0, offset: float = 0.0) -> np.ndarray:
    return offset + amplitude * np.sin(2 * np.pi * frequency * np.arange(n) / n + phase)


def fourier_series(n: int, terms: Sequence[Term], offset: float = 0.0) -> np.ndarray:
    """Terms outside 0 to n - 1 count for nothing; of two for one bin the later one stays."""
    spectrum = np.zeros(n, complex)
    for k, magnitude, phase in terms:
        if 0 <= k < n:
            spectrum[k] = magnitude * np.exp(1j * phase)
            if 0 < k < n // 2:
                spectrum[n - k] = np.conj(spectrum[k])
    return np.fft.ifft(spectrum).real + offset


def polynomial(n: int, coefficients: Sequence[float]) -> np.ndarray:
    x = np.linspace(0, 1, n)
    return np.polyval(coefficients, x) if len(coefficients) else np.zeros(n)


def fourier_terms(values: np.ndarray, terms: int = TERMS, energy: float = ENERGY) -> tuple[list[Term], float]:
    """The strongest bins below n / 2, until they hold more than `energy` of all; and the mean."""
    x = np.asarray(values, np.float32).astype(float)
    offset = float(x.mean())
    spectrum = np.fft.fft(x - offset)[: len(x) // 2]
    size = np.abs(spectrum)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= FLAT][:terms]
    total = float((size**2).sum())
    if total > 0:
        order = order[: int(np.searchsorted(np.cumsum(size[order] ** 2) / total, energy, "right")) + 1]
    return [(int(k), float(size[k]), float(np.angle(spectrum[k]))) for k in order], offset


def _crossings(centred: np.ndarray) -> float | None:
    """Frequency by the mean gap between changes of sign."""
    at = np.flatnonzero(np.diff(np.signbit(centred)))
    return len(centred) * (len(at) - 1) / (2 * (at[-1] - at[0])) if len(at) >= 2 else None


def _peak(centred: np.ndarray) -> float | None:
    """Frequency of the strongest bin below n / 2."""
    found = fourier_terms(centred, 1, 1.0)[0]
    return float(found[0][0]) if found else None


def fit_sine(values: np.ndarray, variant: str = "peak") -> Fit | None:
    """variant peak: strongest bin, phases at whole degrees; crossings: gaps between changes of sign, 360 phases to 2 pi.

    Each takes the other's frequency where it finds none of its own.
    """
    x = np.asarray(values, float)
    n = len(x)
    if n < SINE_LEAST or not np.isfinite(x).all():
        return None
    offset = float(x.mean())
    centred = x - offset
    amplitude = float(np.ptp(centred)) / 2
    if amplitude < FLAT:
        return None
    first, second = (_peak, _crossings) if variant == "peak" else (_crossings, lambda c: float(np.argmax(np.abs(np.fft.rfft(c)[1:])) + 1))
    frequency = first(centred)
    frequency = second(centred) if frequency is None else frequency
    frequency = 1.0 if frequency is None else frequency
    phases = np.arange(360) * 2 * np.pi / (360 if variant == "peak" else 359)
    t = 2 * np.pi * frequency * np.arange(n) / n
    s, c = np.sin(t), np.cos(t)
    # |x - a sin(t + p)|^2 from five sums, for all phases at once
    a, b = np.cos(phases), np.sin(phases)
    missed = centred @ centred - 2 * amplitude * (centred @ s * a + centred @ c * b) + amplitude**2 * (s @ s * a * a + 2 * (s @ c) * a * b + c @ c * b * b)
    phase = float(phases[int(np.argmin(missed))])
    error = relative_error(x, sine(n, frequency, amplitude, phase, offset))
    return Fit("sine", [frequency, amplitude, phase, offset], error, SINE_COST) if error < MAX_ERROR else None


def fit_fourier(values: np.ndarray, terms: int = TERMS, energy: float = ENERGY) -> Fit | None:
    x = np.asarray(values, float)
    if len(x) < FOURIER_LEAST or not np.isfinite(x).all():
        return None
    found, offset = fourier_terms(x, terms, energy)
    if not found:
        return None
    held = sum(m * m * (2 if k > 0 else 1) for k, m, _ in found) / len(x) ** 2
    if x.var() - held > 2 * MAX_ERROR * x.var() + 1e-6:  # by the energies, well past what is accepted
        return None
    error = relative_error(x, fourier_series(len(x), found, offset))
    cost = TERM_COST * len(found) + OFFSET_COST + OVERHEAD
    return Fit("fourier", [*(v for term in found for v in map(float, term)), offset], error, cost) if error < MAX_ERROR else None


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Solution by elimination with the largest pivots; None below PIVOT or where it isn't finite."""
    m = np.column_stack([np.asarray(a, float), np.asarray(b, float)])
    for i in range(len(m)):
        row = i + int(np.argmax(np.abs(m[i:, i])))
        if not abs(m[row, i]) >= PIVOT:
            return None
        m[[i, row]] = m[[row, i]]
        m[i + 1 :] -= np.outer(m[i + 1 :, i] / m[i, i], m[i])
    out = np.zeros(len(m))
    for i in reversed(range(len(m))):
        out[i] = (m[i, -1] - m[i, i + 1 : -1] @ out[i + 1 :]) / m[i, i]
    return out if np.isfinite(out).all() else None


def _least_squares(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray | None:
    powers = np.vander(x, degree + 1)
    return solve(powers.T @ powers, powers.T @ y)


def fit_polynomial(values: np.ndarray, degree: int = DEGREE, threshold: float = MAX_ERROR, variant: str = "first") -> Fit | None:
    """variant first: the least degree with an error below `threshold`, degree 0 for a constant; best: least error of all."""
    y = np.asarray(values, float)
    n = len(y)
    if n < POLYNOMIAL_LEAST or not np.isfinite(y).all():
        return None
    if variant == "first" and y.var() < CONSTANT:
        return Fit("polynomial", [float(y.mean())], 0.0, COEFFICIENT_COST + OVERHEAD)
    x, top = np.linspace(0, 1, n), min(degree, n - 1)
    if variant == "best":
        return _best_polynomial(x, y, top)
    for d in range(1, top + 1):
        coefficients = _least_squares(x, y, d)
        if coefficients is not None and (error := relative_error(y, np.polyval(coefficients, x))) < threshold:
            return Fit("polynomial", coefficients.tolist(), error, COEFFICIENT_COST * (d + 1) + OVERHEAD)
    return None


def _best_polynomial(x: np.ndarray, y: np.ndarray, top: int) -> Fit:
    """The degree of least error up to `top`, the first below 1e-10 ending the search; one factorisation serves all degrees."""
    powers = np.vander(x, top + 1, increasing=True)
    q, r = np.linalg.qr(powers)
    part, best, chosen = q.T @ y, np.inf, 1
    for d in range(1, top + 1):
        error = relative_error(y, q[:, : d + 1] @ part[: d + 1])
        if error < best:
            best, chosen = error, d
        if error < 1e-10:
            break
    found = np.linalg.solve(r[: chosen + 1, : chosen + 1], part[: chosen + 1])
    return Fit("polynomial", found[::-1].tolist(), best, COEFFICIENT_COST * (chosen + 1) + OVERHEAD)


def candidates(values: np.ndarray, variant: str = "peak") -> list[Fit]:
    """The models that fit, in the order in which the first of equal ratios is taken."""
    crossings = variant == "crossings"
    found = [fit_sine(values, variant), fit_fourier(values), fit_polynomial(values, variant="best" if crossings else "first")]
    return [f for f in found if f is not None and f.error < MAX_ERROR]


def analyse(values: np.ndarray, variant: str = "peak", itemsize: int = 4, max_error: float = MAX_ERROR) -> Fit:
    """The candidate of the best ratio if that is at least MIN_RATIO, else method lzma (cost 0: its payload decides)."""
    found = [f for f in candidates(values, variant) if f.error < max_error]
    best = min(found, key=lambda f: f.cost, default=None)
    return best if best is not None and len(values) * itemsize >= MIN_RATIO * best.cost else Fit("lzma")


def reconstruct(fit: Fit, n: int) -> np.ndarray:
    """n values of a fit; zeros for lzma, whose values lie in a payload."""
    c = fit.coefficients
    make: dict[str, Callable[[], np.ndarray]] = {
        "sine": lambda: sine(n, *c[:4]),
        "fourier": lambda: fourier_series(n, [(int(c[i]), c[i + 1], c[i + 2]) for i in range(0, len(c) - 1, 3)], c[-1]),
        "polynomial": lambda: polynomial(n, c),
        "lzma": lambda: np.zeros(n),
    }
    if fit.method not in make:
        raise ValueError(f"unknown method {fit.method!r}")
    return make[fit.method]()

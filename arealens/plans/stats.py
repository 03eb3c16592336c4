"""Driver-side distribution tails and small-matrix helpers (k x k only)."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided_p(z: float) -> float:
    if z is None or not math.isfinite(z):
        return float("nan") if z is None or math.isnan(z) else 0.0
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_2df_tail(x: float) -> float:
    """P(X > x) for a chi-square with 2 degrees of freedom."""
    return math.exp(-x / 2.0)


def _betacf(a, b, x, itmax=300, eps=3e-16):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F(d1, d2) variable."""
    if f is None or not math.isfinite(f) or f <= 0:
        return 1.0 if (f is not None and f <= 0) else float("nan")
    x = d2 / (d2 + d1 * f)
    return betainc_reg(d2 / 2.0, d1 / 2.0, x)


def psd_pinv(m: np.ndarray, rel_tol: float = 1e-10):
    """Pseudo-inverse and rank of a symmetric PSD matrix via its eigen-decomposition."""
    m = (m + m.T) / 2.0
    w, v = np.linalg.eigh(m)
    top = max(w.max(initial=0.0), 0.0)
    keep = w > rel_tol * top if top > 0 else np.zeros_like(w, dtype=bool)
    inv = (v[:, keep] / w[keep]) @ v[:, keep].T
    return inv, int(keep.sum()), w

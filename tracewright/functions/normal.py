"""Normal distribution functions of one to three dimensions by quadrature, for vectorised functions."""

from __future__ import annotations

import math

import numpy as np

_X, _W = np.polynomial.legendre.leggauss(48)
_T, _WT = (_X + 1) / 2, _W / 2


def phi(x) -> np.ndarray:
    """Distribution function of the standard normal."""
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(np.asarray(x, float))


def bivariate(h, k, rho) -> np.ndarray:
    """``P(X <= h, Y <= k)`` of standard normals with correlation ``rho``: Phi(h) Phi(k) plus the integral of the density over the correlation."""
    h, k, rho = (np.clip(np.asarray(x, float), -38, 38) if i < 2 else np.clip(np.asarray(x, float), -1, 1) for i, x in enumerate((h, k, rho)))
    h, k, rho = np.broadcast_arrays(h, k, rho)
    top = np.arcsin(np.clip(rho, -1 + 1e-15, 1 - 1e-15))
    a = top[..., None] * _T
    s, c2 = np.sin(a), np.cos(a) ** 2
    e = np.exp(-(h[..., None] ** 2 + k[..., None] ** 2 - 2 * h[..., None] * k[..., None] * s) / (2 * np.maximum(c2, 1e-300)))
    p, q = phi(h), phi(k)
    value = p * q + top / (2 * math.pi) * (e * _WT).sum(-1)
    low, high = np.maximum(0, p + q - 1), np.minimum(p, q)
    value = np.where(rho >= 1 - 1e-12, high, np.where(rho <= -1 + 1e-12, low, value))
    return np.clip(value, low, high)


def trivariate(h: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """``P(X0 <= h0, X1 <= h1, X2 <= h2)``, a row for each case; ``rho`` has the correlations 01, 02, 12.

    The path from independence of X0: its two correlations grow from 0 together, the derivative is a density times a
    conditional distribution function.
    """
    h, rho = np.atleast_2d(np.clip(h, -38, 38)).astype(float), np.atleast_2d(rho).astype(float)
    out = phi(h[:, 0]) * bivariate(h[:, 1], h[:, 2], rho[:, 2])
    for t, w in zip(_T, _WT):
        r1, r2, r3 = t * rho[:, 0], t * rho[:, 1], rho[:, 2]
        for x, y, a, b, full in ((1, 2, r1, r2, rho[:, 0]), (2, 1, r2, r1, rho[:, 1])):
            one = np.maximum(1 - a * a, 1e-12)
            density = np.exp(-(h[:, 0] ** 2 + h[:, x] ** 2 - 2 * a * h[:, 0] * h[:, x]) / (2 * one)) / (2 * math.pi * np.sqrt(one))
            mean = ((b - a * r3) * h[:, 0] + (r3 - a * b) * h[:, x]) / one
            var = np.maximum(1 - (b * b + r3 * r3 - 2 * a * b * r3) / one, 1e-12)
            out = out + w * full * density * phi((h[:, y] - mean) / np.sqrt(var))
    return np.clip(out, 0, phi(h).min(1))

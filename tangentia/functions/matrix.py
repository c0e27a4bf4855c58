"""Batched functions of Hermitian matrices.

All take arrays of shape (..., p, p); spectral functions go through one batched
``eigh`` and so hold for Hermitian input only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def herm(a: np.ndarray) -> np.ndarray:
    """Conjugate transpose of the last two axes."""
    return np.conj(np.swapaxes(a, -1, -2))


def transpose(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def sym(a: np.ndarray) -> np.ndarray:
    return (a + transpose(a)) / 2


def skew(a: np.ndarray) -> np.ndarray:
    return (a - transpose(a)) / 2


def hermitian_part(a: np.ndarray) -> np.ndarray:
    return (a + herm(a)) / 2


def trace(a: np.ndarray) -> np.ndarray:
    return np.trace(a, axis1=-2, axis2=-1)


def product(*mats: np.ndarray) -> np.ndarray:
    out = mats[0]
    for m in mats[1:]:
        out = out @ m
    return out


def eye(p: int, *batch: int) -> np.ndarray:
    return np.broadcast_to(np.eye(p), (*batch, p, p)).copy()


def spectral(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of a Hermitian matrix, by its eigenvalues."""
    w, q = np.linalg.eigh(a)
    return (q * f(w)[..., None, :]) @ herm(q)


def sqrtm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.sqrt)


def invsqrtm(a: np.ndarray) -> np.ndarray:
    return spectral(a, lambda w: 1 / np.sqrt(w))


def logm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.log)


def expm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.exp)


def coshm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.cosh)


def sinhm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.sinh)


def powm(a: np.ndarray, alpha: float) -> np.ndarray:
    return spectral(a, lambda w: w**alpha)


def generalized_inverse(a: np.ndarray, least: float = 1e-15) -> np.ndarray:
    """Inverts the eigenvalues above ``least`` in size and leaves the others as they are."""

    def f(w: np.ndarray) -> np.ndarray:
        big = np.abs(w) > least
        return np.where(big, 1 / np.where(big, w, 1), w)

    return spectral(a, f)


def log_det(a: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(a)[1]


def unit_det(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A positive definite matrix scaled to determinant 1, and the scale taken out."""
    c = np.exp(log_det(a) / a.shape[-1])
    return a / c[..., None, None], c


def frobenius(a: np.ndarray) -> np.ndarray:
    return np.sqrt((np.abs(a) ** 2).sum(axis=(-2, -1)))

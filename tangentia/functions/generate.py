"""Random parameters and samples; every draw takes a numpy Generator, so a seed fixes it."""

from __future__ import annotations

import numpy as np

from tangentia.functions.matrix import herm, hermitian_part, sqrtm, unit_det


def stiefel(p: int, k: int, rng: np.random.Generator, complex_valued: bool = False) -> np.ndarray:
    """Haar-distributed orthonormal p x k matrix."""
    z = rng.standard_normal((p, k))
    if complex_valued:
        z = z + 1j * rng.standard_normal((p, k))
    q, r = np.linalg.qr(z)
    d = np.diagonal(r)
    return q * (d / np.abs(d))


def covariance(p: int, rng: np.random.Generator, complex_valued: bool = False, unit_determinant: bool = False) -> np.ndarray:
    """Random covariance with chi-square(1) eigenvalues."""
    q = stiefel(p, p, rng, complex_valued)
    s = hermitian_part((q * rng.chisquare(1, p)) @ herm(q))
    return unit_det(s)[0] if unit_determinant else s


def toeplitz(p: int, rho: float) -> np.ndarray:
    i = np.arange(p)
    return rho ** np.abs(i[:, None] - i[None, :])


def textures(n: int, rng: np.random.Generator, kind: str = "gamma", nu: float = 1.0, least: float | None = None, unit_product: bool = False, tries: int = 100) -> np.ndarray:
    """Textures of mean 1, gamma(nu, 1/nu) or log-normal; values below ``least`` are drawn again, then raised to it."""
    def draw(size: int) -> np.ndarray:
        if kind == "gamma":
            return rng.gamma(nu, 1 / nu, size)
        if kind == "lognormal":
            s2 = np.log1p(1 / nu)
            return rng.lognormal(-s2 / 2, np.sqrt(s2), size)
        raise ValueError("textures are gamma or lognormal")

    tau = draw(n)
    for _ in range(tries if least is not None else 0):
        low = tau < least
        if not low.any():
            break
        tau[low] = draw(int(low.sum()))
    if least is not None:
        tau = np.maximum(tau, least)
    return tau / np.exp(np.log(tau).mean()) if unit_product else tau


def standard(p: int, n: int, rng: np.random.Generator, complex_valued: bool = False) -> np.ndarray:
    z = rng.standard_normal((p, n))
    return (z + 1j * rng.standard_normal((p, n))) / np.sqrt(2) if complex_valued else z


def gaussian(sigma: np.ndarray, n: int, rng: np.random.Generator, mu: np.ndarray | None = None) -> np.ndarray:
    x = sqrtm(sigma) @ standard(len(sigma), n, rng, np.iscomplexobj(sigma))
    return x if mu is None else x + mu[:, None]


def compound(sigma: np.ndarray, tau: np.ndarray, rng: np.random.Generator, mu: np.ndarray | None = None) -> np.ndarray:
    x = np.sqrt(tau) * gaussian(sigma, len(tau), rng)
    return x if mu is None else x + mu[:, None]


def low_rank(tau: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Samples of CN(0, tau_i U U^H + I)."""
    p, k = u.shape
    cplx = np.iscomplexobj(u)
    return np.sqrt(tau) * (u @ standard(k, len(tau), rng, cplx)) + standard(p, len(tau), rng, cplx)

"""Estimators of one sample, a p x N matrix whose columns are observations; those named ``_many`` of a batch (samples, p, N), with the same steps."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np

from tangentia.functions import geometry as geo
from tangentia.functions.matrix import herm, hermitian_part, log_det, unit_det
from tangentia.functions.solvers import descend, descend_many, stochastic

LEAST_TEXTURE = 1e-10


def scm(x: np.ndarray, assume_centered: bool = True) -> np.ndarray:
    """Sample covariance, divisor N in both cases."""
    if not assume_centered:
        x = x - x.mean(axis=-1, keepdims=True)
    return x @ herm(x) / x.shape[-1]


def gaussian(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=-1), scm(x, assume_centered=False)


def _quadratics(x: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return np.real((np.conj(x) * np.linalg.solve(sigma, x)).sum(axis=-2))


def _weighed(x: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Observations over their textures; NaN for one at the centre that has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / tau


def tyler(x: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-4, max_iter: int = 100, normalize: str | None = "det", least: float = LEAST_TEXTURE):
    """Tyler's M-estimator by fixed point: ``(sigma, tau)``, normalised to determinant 1 or trace p.

    The textures belong to the scatter of the round before the last; they are at least ``least``.  With 0 an observation at the centre
    isn't passed over: its sample has no fixed point and is NaN.
    """
    p, n = x.shape
    sigma = scm(x) if start is None else start
    sigma = sigma * p / np.real(np.trace(sigma))
    for _ in range(max_iter):
        tau = np.maximum(_quadratics(x, sigma) / p, least)
        new = hermitian_part(_weighed(x, tau) @ herm(x) / n)
        change = np.linalg.norm(new - sigma) / np.linalg.norm(sigma)
        sigma = new
        if change <= tol:
            break
    if normalize == "det":
        sigma, c = unit_det(sigma)
        tau = tau * c
    elif normalize == "trace":
        c = np.real(np.trace(sigma)) / p
        sigma, tau = sigma / c, tau * c
    return sigma, tau


def joint_tyler(x: np.ndarray, tol: float = 1e-3, max_iter: int = 100):
    """Location and scatter together: ``(mu, sigma, tau)`` with determinant 1."""
    p, n = x.shape
    mu, sigma = gaussian(x)
    tau = np.maximum(_quadratics(x - mu[:, None], sigma) / p, LEAST_TEXTURE)
    for _ in range(max_iter):
        w = 1 / np.sqrt(tau)
        new_mu = (x * w).sum(axis=1) / w.sum()
        c = x - new_mu[:, None]
        tau = np.maximum(_quadratics(c, sigma) / p, LEAST_TEXTURE)
        new = hermitian_part((c / tau) @ herm(c) / n)
        change = max(np.linalg.norm(new_mu - mu) / max(np.linalg.norm(mu), 1e-300), np.linalg.norm(new - sigma) / np.linalg.norm(sigma))
        mu, sigma = new_mu, new
        if change <= tol:
            break
    tau = np.maximum(_quadratics(x - mu[:, None], sigma) / p, LEAST_TEXTURE)
    sigma, c = unit_det(sigma)
    return mu, sigma, tau * c


#: Numbers of the samples that are stacked at once.
STACKED = 1 << 20


def by_length(many: Callable[[np.ndarray], object]) -> Callable[[list[np.ndarray]], object]:
    """An estimator of a batch for samples of any lengths: those of one length are stacked."""

    def run(samples: list[np.ndarray]):
        of: dict[int, list[int]] = {}
        for i, x in enumerate(samples):
            of.setdefault(x.shape[1], []).append(i)
        order, found = [], []
        for n, own in of.items():
            step = max(1, STACKED // max(1, samples[own[0]].shape[0] * n))
            for k in range(0, len(own), step):
                order += own[k : k + step]
                found.append(many(np.stack([samples[i] for i in own[k : k + step]])))
        back = np.argsort(order)
        if isinstance(found[0], tuple):
            return tuple(np.concatenate(parts)[back] for parts in zip(*found, strict=True))
        return np.concatenate(found)[back]

    return run


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((np.abs(a.reshape(len(a), -1)) ** 2).sum(axis=1))


def tyler_many(x: np.ndarray, tol: float = 1e-4, max_iter: int = 100, normalize: str | None = "det", least: float = LEAST_TEXTURE):
    """:func:`tyler` of every sample; one that has settled takes no more part."""
    p, n = x.shape[1:]
    sigma = scm(x)
    sigma = sigma * (p / np.real(np.trace(sigma, axis1=-2, axis2=-1)))[:, None, None]
    tau, going = np.ones((len(x), n)), np.arange(len(x))
    for _ in range(max_iter):
        own, old = x[going], sigma[going]
        tau[going] = np.maximum(_quadratics(own, old) / p, least)
        sigma[going] = hermitian_part(_weighed(own, tau[going][:, None]) @ herm(own) / n)
        going = going[~(_norms(sigma[going] - old) / _norms(old) <= tol)]
        if not len(going):
            break
    if normalize == "det":
        sigma, c = unit_det(sigma)
    elif normalize == "trace":
        c = np.real(np.trace(sigma, axis1=-2, axis2=-1)) / p
        sigma = sigma / c[:, None, None]
    else:
        c = np.ones(len(x))
    return sigma, tau * c[:, None]


def joint_tyler_many(x: np.ndarray, tol: float = 1e-3, max_iter: int = 100):
    """:func:`joint_tyler` of every sample."""
    p, n = x.shape[1:]
    mu, sigma = gaussian(x)
    tau, going = np.maximum(_quadratics(x - mu[..., None], sigma) / p, LEAST_TEXTURE), np.arange(len(x))
    for _ in range(max_iter):
        own, old_mu, old = x[going], mu[going], sigma[going]
        w = 1 / np.sqrt(tau[going])
        mu[going] = (own * w[:, None]).sum(axis=-1) / w.sum(axis=-1)[:, None]
        c = own - mu[going][..., None]
        tau[going] = np.maximum(_quadratics(c, old) / p, LEAST_TEXTURE)
        sigma[going] = hermitian_part((c / tau[going][:, None]) @ herm(c) / n)
        change = np.maximum(_norms(mu[going] - old_mu) / np.maximum(_norms(old_mu), 1e-300), _norms(sigma[going] - old) / _norms(old))
        going = going[~(change <= tol)]
        if not len(going):
            break
    tau = np.maximum(_quadratics(x - mu[..., None], sigma) / p, LEAST_TEXTURE)
    sigma, c = unit_det(sigma)
    return mu, sigma, tau * c[:, None]


def gaussian_unit_scatter(x: np.ndarray):
    """Gaussian as a compound: scatter of determinant 1, equal textures."""
    mu, sigma = gaussian(x)
    sigma, c = unit_det(sigma)
    return mu, sigma, np.full(x.shape[1], c)


def gaussian_unit_textures(x: np.ndarray):
    mu, sigma = gaussian(x)
    return mu, sigma, np.ones(x.shape[1])


class CompoundLikelihood:
    """Negative log-likelihood of a compound Gaussian in (mu, sigma, tau) with its Euclidean gradient.

    ``unit="scatter"`` is the form for scatters of determinant 1; ``unit="textures"``
    that for textures of product 1, divided by pN, with a penalty of weight ``beta`` on the eigenvalues of
    all covariances tau_i sigma, drawing them to ``kappa``.
    """

    def __init__(self, x: np.ndarray, unit: str = "scatter", penalty: str = "AF", beta: float = 0.0, kappa="trace_SCM"):
        self.x, self.unit, self.beta = x, unit, beta
        if isinstance(kappa, str) and kappa == "trace_SCM":
            kappa = np.real(np.trace(scm(x, assume_centered=False), axis1=-2, axis2=-1)) / x.shape[-2]
            if np.any(kappa <= 0):
                raise ValueError("a sample whose observations are all equal has no trace_SCM")
        elif not isinstance(kappa, int | float) or kappa <= 0:
            raise ValueError("kappa is 'trace_SCM' or a positive number")
        if penalty not in PENALTIES:
            raise ValueError(f"penalties are {', '.join(PENALTIES)}")
        self.kappa, self.penalty = np.asarray(kappa, dtype=float), PENALTIES[penalty]

    def of(self, samples: np.ndarray) -> CompoundLikelihood:
        """That of some samples of a batch."""
        out = copy(self)
        out.x, out.kappa = self.x[samples], self.kappa[samples] if self.kappa.ndim else self.kappa
        return out

    def _penalties(self, tau: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.penalty(tau[..., :, None] * lam[..., None, :], self.kappa[..., None, None])

    def cost(self, point):
        """A number, of a batch one for each sample."""
        mu, sigma, tau = point
        p, n = self.x.shape[-2:]
        q = _quadratics(self.x - mu[..., None], sigma)
        if self.unit == "scatter":
            return (p * np.log(tau) + q / tau).sum(axis=-1)
        out = n * log_det(sigma) + (q / tau).sum(axis=-1)
        if self.beta:
            out = out + self.beta * self._penalties(tau, np.linalg.eigvalsh(sigma))[0].sum(axis=(-2, -1))
        return out / (p * n)

    def egrad(self, point):
        """Gradients for the real inner product Re trace(u^H g)."""
        mu, sigma, tau = point
        p, n = self.x.shape[-2:]
        c = self.x - mu[..., None]
        y = np.linalg.solve(sigma, c)
        q = np.real((np.conj(c) * y).sum(axis=-2))
        weighed = y / tau[..., None, :]
        g_mu = -2 * weighed.sum(axis=-1)
        g_sigma = -weighed @ herm(y)
        if self.unit == "scatter":
            return g_mu, hermitian_part(g_sigma), p / tau - q / tau**2
        g_sigma = g_sigma + n * np.linalg.inv(sigma)
        g_tau = -q / tau**2
        if self.beta:
            lam, vec = np.linalg.eigh(sigma)
            slope = self._penalties(tau, lam)[1]
            g_tau = g_tau + self.beta * (slope @ lam[..., None])[..., 0]
            g_sigma = g_sigma + self.beta * (vec * (tau[..., None, :] @ slope)) @ herm(vec)
        return g_mu / (p * n), hermitian_part(g_sigma) / (p * n), g_tau / (p * n)

    def ehess(self, point, u, h: float = 1e-6):
        """Directional derivative of the gradient, by central differences."""
        up = self.egrad(tuple(a + h * b for a, b in zip(point, u, strict=True)))
        down = self.egrad(tuple(a - h * b for a, b in zip(point, u, strict=True)))
        return tuple((a - b) / (2 * h) for a, b in zip(up, down, strict=True))


#: Penalty and its derivative in the eigenvalue.
PENALTIES = {
    "L1": lambda v, k: (np.abs(1 / v - 1 / k), -np.sign(1 / v - 1 / k) / v**2),
    "L2": lambda v, k: ((1 / v - 1 / k) ** 2, -2 * (1 / v - 1 / k) / v**2),
    "AF": lambda v, k: (np.log(v / k) ** 2, 2 * np.log(v / k) / v),
    "BW": lambda v, k: ((v**-0.5 - k**-0.5) ** 2, -(v**-0.5 - k**-0.5) * v**-1.5),
    "KL": lambda v, k: (k / v + np.log(v), -k / v**2 + 1 / v),
}


def compound(
    x: np.ndarray,
    unit: str = "scatter",
    max_iter: int | None = None,
    information_geometry: bool = True,
    solver: str = "steepest",
    penalty: str = "AF",
    beta: float = 0.0,
    kappa="trace_SCM",
    start=None,
    least_gradient: float = 1e-5,
    least_step: float = 1e-8,
    max_seconds: float = np.inf,
):
    """Maximum likelihood of a compound Gaussian by Riemannian descent: ``(mu, sigma, tau)``."""
    p, n = x.shape
    cplx = np.iscomplexobj(x)
    if unit == "scatter":
        start = start or joint_tyler(x, max_iter=20)
        space = geo.CompoundUnitScatter(p, n, cplx) if information_geometry else geo.Product(
            [geo.Euclidean(p, complex_valued=cplx), geo.UnitDeterminant(p, cplx), geo.Positive(n)]
        )
        max_iter = max_iter or 30_000
    else:
        start = start or gaussian_unit_textures(x)
        space = geo.CompoundUnitTextures(p, n, cplx) if information_geometry else geo.Product(
            [geo.Euclidean(p, complex_valued=cplx), geo.PositiveDefinite(p, cplx), geo.UnitProduct(n)]
        )
        max_iter = max_iter or 300
    nll = CompoundLikelihood(x, unit, penalty, beta, kappa)
    found = descend(
        space, nll.cost, lambda y: space.egrad2rgrad(y, nll.egrad(y)), start, solver, max_iter,
        max_seconds, least_gradient, least_step,
    )
    return found.point


def compound_many(
    x: np.ndarray,
    unit: str = "scatter",
    max_iter: int | None = None,
    information_geometry: bool = True,
    solver: str = "steepest",
    penalty: str = "AF",
    beta: float = 0.0,
    kappa="trace_SCM",
    least_gradient: float = 1e-5,
    least_step: float = 1e-8,
):
    """:func:`compound` of every sample, all descents at once."""
    (p, n), cplx = x.shape[1:], np.iscomplexobj(x)
    if unit == "scatter":
        start, flat = joint_tyler_many(x, max_iter=20), [geo.Euclidean(p, complex_valued=cplx), geo.UnitDeterminant(p, cplx), geo.Positive(n)]
        space = geo.CompoundUnitScatter(p, n, cplx) if information_geometry else geo.Product(flat)
    else:
        start, flat = (*gaussian(x), np.ones((len(x), n))), [geo.Euclidean(p, complex_valued=cplx), geo.PositiveDefinite(p, cplx), geo.UnitProduct(n)]
        space = geo.CompoundUnitTextures(p, n, cplx) if information_geometry else geo.Product(flat)
    nll = CompoundLikelihood(x, unit, penalty, beta, kappa)
    return descend_many(
        space, lambda y, at: nll.of(at).cost(y), lambda y, at: space.egrad2rgrad(y, nll.of(at).egrad(y)), start, solver,
        max_iter or (30_000 if unit == "scatter" else 300), least_gradient, least_step,
    )


def top_subspace(sigma: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors of the k largest eigenvalues, largest first."""
    return np.linalg.eigh(sigma)[1][..., ::-1][..., :k]


def _noise(x: np.ndarray, k: int) -> float:
    """Mean of the eigenvalues of the sample covariance beyond the k largest."""
    w = np.linalg.eigvalsh(scm(x))[::-1]
    return float(np.real(w[k : min(x.shape)]).mean())


def _start(x: np.ndarray, k: int):
    p, n = x.shape
    if p > 1000:
        u = np.eye(p, k, dtype=x.dtype)
    else:
        u = top_subspace(scm(x), k)
    tau = max(float((np.abs(herm(u) @ x) ** 2).sum() / (k * n)) - 1, LEAST_TEXTURE)
    return np.full(n, tau), u


class SubspaceLikelihood:
    """Negative log-likelihood of x_i ~ CN(0, tau_i U U^H + I) up to constants, with gradients."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k = x, k

    def cost(self, point) -> float:
        tau, u = point
        e = (np.abs(herm(u) @ self.x) ** 2).sum(axis=0)
        return float((self.k * np.log1p(tau) - tau / (1 + tau) * e).sum())

    def egrad(self, point, columns: np.ndarray | None = None):
        """Over all observations, or over the given columns weighed up to all."""
        tau, u = point
        pick = slice(None) if columns is None else columns
        x, t = self.x[:, pick], tau[pick]
        y = herm(u) @ x
        e = (np.abs(y) ** 2).sum(axis=0)
        g_tau = np.zeros_like(tau)
        np.add.at(g_tau, pick if columns is not None else np.arange(len(tau)), self.k / (1 + t) - e / (1 + t) ** 2)
        g_u = -2 * (x * (t / (1 + t))) @ herm(y)
        scale = 1.0 if columns is None else len(tau) / len(columns)
        return g_tau * scale, g_u * scale


def tau_subspace(x: np.ndarray, k: int, estimate_sigma: bool = False, tol: float = 1e-3, max_iter: int = 1000):
    """Textures and subspace by block coordinate descent: ``(tau, u)``."""
    s2 = _noise(x, k) if estimate_sigma else 1.0
    x = x / np.sqrt(s2)
    tau, u = _start(x, k)
    for _ in range(max_iter):
        tau = np.maximum((np.abs(herm(u) @ x) ** 2).sum(axis=0) / k - 1, LEAST_TEXTURE)
        new = top_subspace(hermitian_part((x * (tau / (1 + tau))) @ herm(x)), k)
        # norms of projectors, from k x k products
        change = np.sqrt(max(0.0, 2 * k - 2 * float((np.abs(herm(u) @ new) ** 2).sum())) / k)
        u = new
        if change <= tol:
            break
    return tau * s2, u


def tau_subspace_many(x: np.ndarray, k: int, estimate_sigma: bool = False, tol: float = 1e-3, max_iter: int = 1000):
    """:func:`tau_subspace` of every sample."""
    s2 = np.array([_noise(a, k) for a in x]) if estimate_sigma else np.ones(len(x))
    x = x / np.sqrt(s2)[:, None, None]
    u = np.stack([_start(a, k)[1] for a in x]) if x.shape[1] > 1000 else top_subspace(scm(x), k).copy()
    tau = np.maximum((np.abs(herm(u) @ x) ** 2).sum(axis=(-2, -1)) / (k * x.shape[2]) - 1, LEAST_TEXTURE)[:, None] * np.ones((1, x.shape[2]))
    going = np.arange(len(x))
    for _ in range(max_iter):
        own, old = x[going], u[going]
        tau[going] = t = np.maximum((np.abs(herm(old) @ own) ** 2).sum(axis=-2) / k - 1, LEAST_TEXTURE)
        u[going] = top_subspace(hermitian_part((own * (t / (1 + t))[:, None]) @ herm(own)), k)
        change = np.sqrt(np.maximum(0.0, 2 * k - 2 * (np.abs(herm(old) @ u[going]) ** 2).sum(axis=(-2, -1))) / k)
        going = going[~(change <= tol)]
        if not len(going):
            break
    return tau * s2[:, None], u


def tau_subspace_riemannian(
    x: np.ndarray,
    k: int,
    estimate_sigma: bool = False,
    information_geometry: bool = False,
    max_iter: int = 1000,
    max_seconds: float = np.inf,
    least_step: float = 1e-14,
    solver: str = "conjugate",
    batch_size: int = 1000,
    seed: int = 0,
):
    """Textures and subspace by Riemannian descent; ``SGD`` draws batches with replacement."""
    p, n = x.shape
    cplx = np.iscomplexobj(x)
    s2 = _noise(x, k) if estimate_sigma else 1.0
    x = x / np.sqrt(s2)
    start, nll = _start(x, k), SubspaceLikelihood(x, k)
    info = geo.RobustSubspaceIG(n, p, k, cplx)
    if solver == "SGD":
        if not information_geometry:
            raise ValueError("SGD goes with the information geometry")
        rng, size = np.random.default_rng(seed), min(n, batch_size)
        found = stochastic(
            info, nll.cost, lambda y: info.egrad2rgrad(y, nll.egrad(y, rng.integers(0, n, size))), start,
            rate=0.1, decay=0.05, max_iter=max_iter, max_seconds=max_seconds, least_step=least_step,
        )
    else:
        space = info if information_geometry else geo.Product([geo.Positive(n), geo.Grassmann(p, k, cplx)])
        found = descend(
            space, nll.cost, lambda y: space.egrad2rgrad(y, nll.egrad(y)), start, solver, max_iter,
            max_seconds, 1e-6 * np.sqrt(n), least_step,
        )
    tau, u = found.point
    return tau * s2, u

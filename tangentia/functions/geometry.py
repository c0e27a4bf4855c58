"""Geometries of features, as batched numpy kernels.

A point is an array, or a tuple of arrays for geometries with several parts,
with any number of leading batch axes; kernels broadcast over them, so one
call serves an Arrow batch against one or many base points.

Every geometry has ``dist``, ``inner``, ``norm``, ``proj``, ``zero``, ``rand``,
``rand_tangent``, ``retract``, ``transport`` and ``frame`` (an orthonormal basis of a
tangent space, which turns real coordinates into tangents); those with a
closed form have ``exp`` and ``log`` too.
"""

from __future__ import annotations

import numpy as np

from tangentia.functions.matrix import (
    coshm, frobenius, generalized_inverse, herm, hermitian_part, invsqrtm, log_det, logm, sinhm, spectral, sqrtm, trace,
    unit_det,
)

#: Least eigenvalue or texture a retraction may return, and the halvings of a step it tries.
LEAST, HALVINGS = 1e-14, 20


def _col(x: np.ndarray) -> np.ndarray:
    return np.asarray(x)[..., None]


def _mat(x: np.ndarray) -> np.ndarray:
    return np.asarray(x)[..., None, None]


class Geometry:
    """Defaults: flat structure over arrays of ``shape``."""

    has_log = True
    has_dist = True

    def __init__(self, *shape: int, complex_valued: bool = False):
        self.shapes, self.complex_valued = [tuple(shape)], complex_valued

    @property
    def axes(self) -> tuple[int, ...]:
        return tuple(range(-len(self.shapes[0]), 0))

    def inner(self, x, u, v):
        return np.real((np.conj(u) * v).sum(axis=self.axes))

    def norm(self, x, u):
        return np.sqrt(np.maximum(self.inner(x, u, u), 0))

    def dist(self, x, y):
        return np.sqrt((np.abs(x - y) ** 2).sum(axis=self.axes))

    def dists(self, x, y) -> list[np.ndarray]:
        """Distances of the parts; the whole alone where there are none."""
        return [self.dist(x, y)]

    def proj(self, x, u):
        return u

    def egrad2rgrad(self, x, g):
        return self.proj(x, g)

    def ehess2rhess(self, x, g, h, u):
        """Of a flat geometry the Euclidean Hessian."""
        return self.proj(x, h)

    def exp(self, x, u):
        return x + u

    def retract(self, x, u):
        return self.exp(x, u)

    def log(self, x, y):
        return y - x

    def transport(self, x, y, u):
        return self.proj(y, u)

    def pair_mean(self, x, y):
        """The point halfway from x to y."""
        u = self.log(x, y)
        return self.exp(x, tuple(a / 2 for a in u) if isinstance(u, tuple) else u / 2)

    @property
    def dim(self) -> int:
        """Real dimension."""
        return len(self.frame(self.rand(np.random.default_rng(0))))

    @property
    def typical_dist(self) -> float:
        return float(np.sqrt(self.dim))

    def zero(self, x):
        return np.zeros_like(x)

    def _normal(self, rng: np.random.Generator, shape) -> np.ndarray:
        z = rng.standard_normal(shape)
        return (z + 1j * rng.standard_normal(shape)) / np.sqrt(2) if self.complex_valued else z

    def rand(self, rng: np.random.Generator):
        return self._normal(rng, self.shapes[0])

    def rand_tangent(self, x, rng: np.random.Generator):
        u = self.proj(x, self._normal(rng, np.shape(x)))
        return u / self.norm(x, u)

    def mean(self, x):
        """Closed-form Frechet mean over the first axis, None where there is none."""
        return x.mean(axis=0)

    def frame(self, x) -> list:
        """Orthonormal tangents at one point."""
        out = []
        for k in np.ndindex(*self.shapes[0]):
            for unit in (1.0, 1j) if self.complex_valued else (1.0,):
                e = np.zeros(self.shapes[0], dtype=complex if self.complex_valued else float)
                e[k] = unit
                out.append(e)
        return out

    def vectorize(self, u) -> np.ndarray:
        """Flattened part; of Hermitian or skew-Hermitian parts the upper triangle, unweighted."""
        return np.asarray(u).reshape(*np.shape(u)[: np.ndim(u) - len(self.shapes[0])], -1)


class Euclidean(Geometry):
    pass


class Positive(Geometry):
    """Vectors of positive numbers with the metric of their logarithms."""

    def __init__(self, n: int):
        super().__init__(n)

    def inner(self, x, u, v):
        return (u * v / x**2).sum(axis=-1)

    def dist(self, x, y):
        return np.sqrt(((np.log(x) - np.log(y)) ** 2).sum(axis=-1))

    def egrad2rgrad(self, x, g):
        return g * x**2

    def ehess2rhess(self, x, g, h, u):
        return h * x**2 + u * g * x

    def exp(self, x, u):
        return x * np.exp(u / x)

    def retract(self, x, u):
        return x + u + u**2 / x / 2

    def log(self, x, y):
        return x * np.log(y / x)

    def transport(self, x, y, u):
        return u * y / x

    def rand(self, rng):
        return rng.uniform(0.05, 5, self.shapes[0])

    def mean(self, x):
        return np.exp(np.log(x).mean(axis=0))

    def frame(self, x):
        return [np.where(np.arange(len(x)) == k, x, 0.0) for k in range(len(x))]


class UnitProduct(Positive):
    """Positive vectors whose product is 1."""

    @staticmethod
    def _unit(x):
        return x / np.exp(np.log(x).mean(axis=-1, keepdims=True))

    def proj(self, x, u):
        return u - (u / x).mean(axis=-1, keepdims=True) * x

    def egrad2rgrad(self, x, g):
        return self.proj(x, g * x**2)

    def ehess2rhess(self, x, g, h, u):
        return self.proj(x, super().ehess2rhess(x, g, h, u))

    def exp(self, x, u):
        return self._unit(super().exp(x, u))

    def retract(self, x, u):
        return self._unit(super().retract(x, u))

    def log(self, x, y):
        return self.proj(x, super().log(x, y))

    def rand(self, rng):
        return self._unit(super().rand(rng))

    def mean(self, x):
        return self._unit(super().mean(x))

    def frame(self, x):
        n = len(x)
        q = np.linalg.qr(np.column_stack([np.ones(n), np.eye(n)[:, : n - 1]]))[0][:, 1:]
        return [q[:, k] * x for k in range(n - 1)]


def _relative_2x2(x, y) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``x^-1 y`` of 2 x 2 Hermitian positive definite matrices, those of ``L^-1 y L^-H`` with ``x = L L^H``."""
    a, b, e = np.real(x[..., 0, 0]), x[..., 1, 0], np.real(x[..., 1, 1])
    c, u, v, w = b / a, np.real(y[..., 0, 0]), y[..., 1, 0], np.real(y[..., 1, 1])
    n = e - np.abs(b) ** 2 / a
    first, last = u / a, (np.abs(c) ** 2 * u - 2 * np.real(np.conj(c) * v) + w) / n
    side = np.abs(v - c * u) ** 2 / (n * a)
    high = (first + last) / 2 + np.sqrt(((first - last) / 2) ** 2 + side)
    return high, (first * last - side) / high


class PositiveDefinite(Geometry):
    """Hermitian positive definite matrices with the affine-invariant metric."""

    def __init__(self, p: int, complex_valued: bool = False):
        super().__init__(p, p, complex_valued=complex_valued)
        self.p = p

    def inner(self, x, u, v):
        return np.real(trace(np.linalg.solve(x, u) @ np.linalg.solve(x, v)))

    def dist(self, x, y):
        """Root of the squared logarithms of the generalised eigenvalues, from one Cholesky factor; of 2 x 2 matrices in closed form."""
        if self.p == 2:
            return np.hypot(*(np.log(w) for w in _relative_2x2(x, y)))
        c = np.linalg.cholesky(x)
        half = np.linalg.solve(c, y)
        w = np.linalg.eigvalsh(hermitian_part(np.linalg.solve(c, herm(half))))
        return np.sqrt((np.log(w) ** 2).sum(axis=-1))

    def proj(self, x, u):
        return hermitian_part(u)

    def egrad2rgrad(self, x, g):
        return x @ hermitian_part(g) @ x

    def ehess2rhess(self, x, g, h, u):
        """Riemannian Hessian along u from the Euclidean gradient g and the Euclidean Hessian h along u."""
        return x @ hermitian_part(h) @ x + hermitian_part(u @ hermitian_part(g) @ x)

    def _between(self, x, y, f):
        r, ir = sqrtm(x), invsqrtm(x)
        return hermitian_part(r @ spectral(hermitian_part(ir @ y @ ir), f) @ r)

    def exp(self, x, u):
        return self._between(x, u, np.exp)

    def log(self, x, y):
        return self._between(x, y, np.log)

    def retract(self, x, u):
        return hermitian_part(x + u + u @ np.linalg.solve(x, u) / 2)

    def transport(self, x, y, u):
        e = sqrtm(x) @ sqrtm(hermitian_part(invsqrtm(x) @ y @ invsqrtm(x))) @ invsqrtm(x)
        return hermitian_part(e @ u @ herm(e))

    def rand(self, rng):
        q = np.linalg.qr(self._normal(rng, self.shapes[0]))[0]
        return hermitian_part((q * rng.uniform(0.2, 3, self.p)) @ herm(q))

    mean = None  # iterative

    def frame(self, x):
        r, out = sqrtm(x), []
        for i in range(self.p):
            for j in range(i, self.p):
                for unit in (1.0, 1j) if self.complex_valued and i < j else (1.0,):
                    e = np.zeros((self.p, self.p), dtype=complex if self.complex_valued else float)
                    e[i, j], e[j, i] = unit, np.conj(unit)
                    out.append(r @ (e / np.sqrt(1 if i == j else 2)) @ r)
        return out

    def vectorize(self, u):
        i, j = np.triu_indices(self.p)
        return np.asarray(u)[..., i, j]


class UnitDeterminant(PositiveDefinite):
    """Positive definite matrices of determinant 1."""

    def proj(self, x, u):
        u = hermitian_part(u)
        return u - _mat(np.real(trace(np.linalg.solve(x, u))) / self.p) * x

    def egrad2rgrad(self, x, g):
        return self.proj(x, super().egrad2rgrad(x, g))

    def ehess2rhess(self, x, g, h, u):
        # determinant 1 is totally geodesic, so the Hessian is that of all matrices, projected
        return self.proj(x, super().ehess2rhess(x, g, h, u))

    def exp(self, x, u):
        return unit_det(super().exp(x, u))[0]

    def log(self, x, y):
        return self.proj(x, super().log(x, y))

    def retract(self, x, u):
        return unit_det(super().retract(x, u))[0]

    def rand(self, rng):
        return unit_det(super().rand(rng))[0]

    def frame(self, x):
        q = np.linalg.qr(np.array([self._coords(x, self.proj(x, e)) for e in super().frame(x)]).T)
        base = super().frame(x)
        keep = np.abs(np.diag(q[1])) > 1e-9
        return [sum(c * b for c, b in zip(col, base, strict=True)) for col in q[0][:, keep].T]

    def _coords(self, x, u):
        return np.array([super(UnitDeterminant, self).inner(x, u, b) for b in super().frame(x)])


class Grassmann(Geometry):
    """k-dimensional subspaces by orthonormal bases; distance is the norm of the principal angles."""

    def __init__(self, p: int, k: int, complex_valued: bool = False):
        super().__init__(p, k, complex_valued=complex_valued)

    def dist(self, x, y):
        s = np.linalg.svd(herm(x) @ y, compute_uv=False)
        return np.sqrt((np.arccos(np.clip(s, -1, 1)) ** 2).sum(axis=-1))

    def proj(self, x, u):
        return u - x @ (herm(x) @ u)

    def ehess2rhess(self, x, g, h, u):
        return self.proj(x, h) - u @ (herm(x) @ g)

    def exp(self, x, u):
        w, s, vh = np.linalg.svd(u, full_matrices=False)
        y = x @ (herm(vh) * np.cos(s)[..., None, :]) @ vh + (w * np.sin(s)[..., None, :]) @ vh
        return np.linalg.qr(y)[0]

    def retract(self, x, u):
        w, _, vh = np.linalg.svd(x + u, full_matrices=False)
        return w @ vh

    def log(self, x, y):
        a = herm(x) @ y
        w, s, vh = np.linalg.svd((y - x @ a) @ np.linalg.pinv(a), full_matrices=False)
        return (w * np.arctan(s)[..., None, :]) @ vh

    def rand(self, rng):
        return np.linalg.qr(self._normal(rng, self.shapes[0]))[0]

    mean = None

    def frame(self, x):
        p, k = self.shapes[0]
        rest = np.linalg.svd(x, full_matrices=True)[0][:, k:]
        out = []
        for i in range(p - k):
            for j in range(k):
                for unit in (1.0, 1j) if self.complex_valued else (1.0,):
                    e = np.zeros((p - k, k), dtype=complex if self.complex_valued else float)
                    e[i, j] = unit
                    out.append(rest @ e)
        return out


class Product(Geometry):
    """Parts side by side; squared distances and inner products add up with weights."""

    def __init__(self, parts: list[Geometry], weights=None):
        self.parts = parts
        self.weights = [1.0] * len(parts) if weights is None else list(weights)
        if len(self.weights) != len(parts):
            raise ValueError("one weight for each part")
        self.shapes = [s for p in parts for s in p.shapes]
        self.complex_valued = any(p.complex_valued for p in parts)
        self.has_log = all(p.has_log for p in parts)

    def _each(self, name, *points):
        return tuple(getattr(p, name)(*a) for p, a in zip(self.parts, zip(*points, strict=True), strict=True))

    def inner(self, x, u, v):
        return sum(w * i for w, i in zip(self.weights, self._each("inner", x, u, v), strict=True))

    def dists(self, x, y):
        each = list(self._each("dist", x, y))
        return [np.sqrt(sum(w * d * d for w, d in zip(self.weights, each, strict=True))), *each]

    def dist(self, x, y):
        return self.dists(x, y)[0]

    def proj(self, x, u):
        return self._each("proj", x, u)

    def egrad2rgrad(self, x, g):
        """Divided by the weights; a part of weight 0 gets no gradient."""
        return tuple(
            r / w if w else np.zeros_like(r) for r, w in zip(self._each("egrad2rgrad", x, g), self.weights, strict=True)
        )

    def ehess2rhess(self, x, g, h, u):
        """Divided by the weights, as the gradient; for parts that have one."""
        each = self._each("ehess2rhess", x, g, h, u)
        return tuple(r / w if w else np.zeros_like(r) for r, w in zip(each, self.weights, strict=True))

    def exp(self, x, u):
        return self._each("exp", x, u)

    def retract(self, x, u):
        return self._each("retract", x, u)

    def log(self, x, y):
        return self._each("log", x, y)

    def transport(self, x, y, u):
        return self._each("transport", x, y, u)

    def zero(self, x):
        return self._each("zero", x)

    def rand(self, rng):
        return tuple(p.rand(rng) for p in self.parts)

    def rand_tangent(self, x, rng):
        u = tuple(p.rand_tangent(a, rng) for p, a in zip(self.parts, x, strict=True))
        n = self.norm(x, u)
        return tuple(a / _expand(n, a) for a in u)

    def frame(self, x):
        out = []
        for k, (p, w) in enumerate(zip(self.parts, self.weights, strict=True)):
            for e in p.frame(x[k]) if w else ():
                out.append(tuple(e / np.sqrt(w) if i == k else np.zeros_like(a) for i, a in enumerate(x)))
        return out

    def vectorize(self, u):
        return np.concatenate([p.vectorize(a) for p, a in zip(self.parts, u, strict=True)], axis=-1)


def _expand(n, like):
    return np.reshape(n, np.shape(n) + (1,) * (np.ndim(like) - np.ndim(n)))


def _quadratic(delta, sigma):
    """delta^H sigma^-1 delta."""
    return np.real((np.conj(delta) * np.linalg.solve(sigma, _col(delta))[..., 0]).sum(axis=-1))


def _outer(a, b=None):
    return a[..., :, None] * np.conj(a if b is None else b)[..., None, :]


def _guarded(step, smallest, x, u):
    """``step(x, u)`` with ``u`` halved, for each point of a batch by itself, until nothing is below ``LEAST``; ``x`` if that never happens."""
    out, open_ = tuple(np.array(a) for a in x), np.ones(np.shape(x[0])[:-1], dtype=bool)
    for _ in range(HALVINGS + 1):
        y = step(tuple(a[open_] for a in x), tuple(a[open_] for a in u))
        ok = smallest(y) >= LEAST
        now = open_.copy()
        now[open_] = ok
        for a, b in zip(out, y, strict=True):
            a[now] = b[ok]
        open_ &= ~now
        if not open_.any():
            break
        u = tuple(a / 2 for a in u)
    return out


class _Divergences(Product):
    """Geometries whose ``dist`` is a divergence chosen by name."""

    has_log = False
    families = ("alpha", "alpha_sym", "alpha_real", "alpha_sym_real", "kl")

    def dists(self, x, y):
        return [self.dist(x, y)]

    def dist(self, x, y):
        return getattr(self, f"div_{self.divergence}")(x, y)

    def squared_gradient(self, x, y, second: bool = False):
        """Euclidean gradient of the squared divergence in its first argument (or its second), for Re trace(u^H g)."""
        name, one, two = self.divergence, (x, y), (y, x)
        real = name.endswith("_real")
        base = name.removesuffix("_real").removesuffix("_sym")
        if "_sym" in name:
            both = [self._one_gradient(base, real, *one, second), self._one_gradient(base, real, *two, not second)]
            return tuple((a + b) / 2 for a, b in zip(*both, strict=True))
        return self._one_gradient(base, real, *one, second)

    def _one_gradient(self, base: str, real: bool, x, y, second: bool):
        if base == "alpha" and self.alpha in (0, 1):
            base, x, y, second = ("kl", x, y, second) if self.alpha == 0 else ("kl", y, x, not second)
            scale = 0.5 if real else 1.0
            return tuple(scale * g for g in self.grad_kl(x, y, second))
        return self.grad_alpha(x, y, second, real) if base == "alpha" else getattr(self, f"grad_{base}")(x, y, second)

    def div_alpha_sym(self, x, y):
        return np.sqrt((self.div_alpha(x, y) ** 2 + self.div_alpha(y, x) ** 2) / 2)

    def div_alpha_sym_real(self, x, y):
        return np.sqrt((self.div_alpha_real(x, y) ** 2 + self.div_alpha_real(y, x) ** 2) / 2)

    def div_orth_sym(self, x, y):
        return np.sqrt((self.div_orth(x, y) ** 2 + self.div_orth(y, x) ** 2) / 2)

    def div_scale_sym(self, x, y):
        return np.sqrt((self.div_scale(x, y) ** 2 + self.div_scale(y, x) ** 2) / 2)


def _orth_squared(m1, s1, m2, s2):
    d = m2 - m1
    log = logm(hermitian_part(invsqrtm(s2) @ (s1 + _outer(d) / 2) @ invsqrtm(s2)))
    return np.arccosh(1 + _quadratic(d, s1)) ** 2 + frobenius(log) ** 2


def _scale_squared(m1, s1, m2, s2):
    p = s1.shape[-1]
    log_c = (log_det(s2) - log_det(s1)) / p
    c = np.exp(log_c)
    path = np.arccosh(np.maximum((c + 1 + _quadratic(m2 - m1, s1) / 2) / (2 * np.sqrt(c)), 1))
    log = logm(hermitian_part(_mat(c) * (invsqrtm(s2) @ s1 @ invsqrtm(s2))))
    return 4 * path**2 + (p - 1) * log_c**2 + frobenius(log) ** 2


def _inverse_outer(s, d):
    """s^-1, s^-1 d and its outer product with itself."""
    i = np.linalg.inv(s)
    v = (i @ _col(d))[..., 0]
    return i, v, _outer(v)


def _log_between(a, b):
    """b^-1/2 log(b^-1/2 a b^-1/2) b^-1/2, and the same times the inverse of the inner matrix."""
    r = invsqrtm(b)
    m = hermitian_part(r @ a @ r)
    return hermitian_part(r @ logm(m) @ r), hermitian_part(r @ spectral(m, lambda w: np.log(w) / w) @ r)


def _slope(u):
    """arccosh(u) / sqrt(u^2 - 1), which is 1 at u = 1."""
    v = np.maximum(u, 1.0)
    root = np.sqrt(np.maximum(v * v - 1, 0))
    return np.where(root > 1e-7, np.arccosh(v) / np.where(root > 1e-7, root, 1.0), 1.0)


def _orth_gradient(m1, s1, m2, s2, second):
    d = m2 - m1
    _, v, vv = _inverse_outer(s1, d)
    c = _slope(1 + _quadratic(d, s1))
    at_two, at_one = _log_between(s1 + _outer(d) / 2, s2)
    pull = 4 * _col(c) * v + 2 * (at_one @ _col(d))[..., 0]
    if second:
        return pull, -2 * at_two
    return -pull, 2 * at_one - 2 * _mat(c) * vv


def _scale_gradient(m1, s1, m2, s2, second):
    p = s1.shape[-1]
    d = m2 - m1
    i1, v, vv = _inverse_outer(s1, d)
    log_c = (log_det(s2) - log_det(s1)) / p
    root, q = np.exp(log_c / 2), _quadratic(d, s1)
    k = 8 * _slope((root + (1 + q / 2) / root) / 2)
    by_log, by_q = (root - (1 + q / 2) / root) / 4, 1 / (4 * root)
    at_two, at_one = _log_between(s1, s2)
    pull = _col(2 * k * by_q) * v
    volume = _mat((k * by_log - 2 * log_c) / p)
    if second:
        return pull, volume * np.linalg.inv(s2) - 2 * at_two
    return -pull, 2 * at_one - volume * i1 - _mat(k * by_q) * vv


class GaussianIG(_Divergences):
    """Gaussians (mean, covariance) with their information geometry; divergences are not symmetric."""

    def __init__(self, p: int, complex_valued: bool = False, divergence: str = "orth", alpha: float = 0.5):
        super().__init__([Euclidean(p, complex_valued=complex_valued), PositiveDefinite(p, complex_valued)])
        self.p, self.divergence, self.alpha, self.has_log = p, divergence, alpha, False

    def inner(self, x, u, v):
        c = np.linalg.cholesky(x[1])
        a, b = (np.linalg.solve(c, _col(w))[..., 0] for w in (u[0], v[0]))
        return 2 * np.real((np.conj(a) * b).sum(axis=-1)) + self.parts[1].inner(x[1], u[1], v[1])

    def egrad2rgrad(self, x, g):
        return (x[1] @ _col(g[0]))[..., 0] / 2, self.parts[1].egrad2rgrad(x[1], g[1])

    def frame(self, x):
        r = sqrtm(x[1])
        zero = np.zeros_like(x[1])
        out = [(r @ e / np.sqrt(2), zero) for e in self.parts[0].frame(x[0])]
        return out + [(np.zeros_like(x[0]), e) for e in self.parts[1].frame(x[1])]

    def _exp(self, x, u):
        r, ir = sqrtm(x[1]), invsqrtm(x[1])
        b, a = hermitian_part(ir @ u[1] @ ir), (ir @ _col(u[0]))[..., 0]
        g = spectral(hermitian_part(b @ b + 2 * _outer(a)), lambda w: np.sqrt(np.maximum(w, 0)))
        inverse, sinh = generalized_inverse(g), sinhm(g / 2)
        turn = herm(np.linalg.inv(coshm(g / 2) - b @ inverse @ sinh))
        move = 2 * (r @ turn @ sinh @ inverse @ _col(a))[..., 0]
        return x[0] + move, hermitian_part(r @ turn @ herm(turn) @ r)

    def exp(self, x, u):
        return _guarded(self._exp, lambda y: np.linalg.eigvalsh(y[1]).min(), x, u)

    def _retract(self, x, u):
        t = u[1] @ np.linalg.inv(x[1])
        return x[0] + u[0] + (t @ _col(u[0]))[..., 0] / 2, hermitian_part(x[1] + u[1] + (t @ u[1] - _outer(u[0])) / 2)

    def retract(self, x, u):
        return _guarded(self._retract, lambda y: np.linalg.eigvalsh(y[1]).min(), x, u)

    def transport(self, x, y, u):
        return self.proj(y, u)

    def div_orth(self, x, y):
        return np.sqrt(_orth_squared(x[0], x[1], y[0], y[1]))

    def div_scale(self, x, y):
        return np.sqrt(_scale_squared(x[0], x[1], y[0], y[1]))

    def div_kl(self, x, y):
        s = np.linalg.solve(y[1], x[1])
        kl = np.real(trace(s)) + _quadratic(y[0] - x[0], y[1]) - self.p - (log_det(x[1]) - log_det(y[1]))
        return np.sqrt(np.maximum(kl, 0) + 1e-12)

    def grad_orth(self, x, y, second=False):
        return _orth_gradient(x[0], x[1], y[0], y[1], second)

    def grad_scale(self, x, y, second=False):
        return _scale_gradient(x[0], x[1], y[0], y[1], second)

    def grad_kl(self, x, y, second=False):
        i, v, vv = _inverse_outer(y[1], y[0] - x[0])
        if second:
            return 2 * v, i - i @ x[1] @ i - vv
        return -2 * v, i - np.linalg.inv(x[1])

    def grad_alpha(self, x, y, second=False, real=False):
        a = self.alpha
        i, v, vv = _inverse_outer((1 - a) * x[1] + a * y[1], y[0] - x[0])
        w, own, sign = (a, y[1], -1) if second else (1 - a, x[1], 1)
        scale = self._integral(x, y)
        scale = np.sqrt(scale) / 2 if real else scale
        scale = -scale * np.sign((1 - self._integral(x, y)) / (a * (1 - a)) + 1e-300) / (a * (1 - a))
        slope = w * (np.linalg.inv(own) - i + a * (1 - a) * vv)
        return _col(scale) * (sign * 2 * a * (1 - a) * v), _mat(scale) * slope

    def _integral(self, x, y):
        a = self.alpha
        m = (1 - a) * x[1] + a * y[1]
        logs = (1 - a) * log_det(x[1]) + a * log_det(y[1]) - log_det(m)
        return np.exp(logs - a * (1 - a) * _quadratic(y[0] - x[0], m))

    def div_alpha(self, x, y):
        a = self.alpha
        if a in (0, 1):
            return self.div_kl(*((x, y) if a == 0 else (y, x)))
        return np.sqrt(np.abs((1 - self._integral(x, y)) / (a * (1 - a))))

    def div_alpha_real(self, x, y):
        a = self.alpha
        if a in (0, 1):
            return self.div_alpha(x, y) / np.sqrt(2)
        return np.sqrt(np.abs((1 - np.sqrt(self._integral(x, y))) / (a * (1 - a))))


class CovarianceAlpha(Geometry):
    """Centred Gaussians by their covariances, with the alpha divergences."""

    has_log = False

    def __init__(self, p: int, complex_valued: bool = False, divergence: str = "alpha", alpha: float = 0.5):
        self.gauss = GaussianIG(p, complex_valued, divergence, alpha)
        self.base = PositiveDefinite(p, complex_valued)
        self.shapes, self.complex_valued, self.p = self.base.shapes, complex_valued, p

    def _pair(self, s):
        return np.zeros(s.shape[:-1], dtype=s.dtype), s

    def dist(self, x, y):
        return self.gauss.dist(self._pair(x), self._pair(y))

    def squared_gradient(self, x, y):
        return self.gauss.squared_gradient(self._pair(x), self._pair(y))[1]

    def inner(self, x, u, v):
        return self.base.inner(x, u, v)

    def proj(self, x, u):
        return self.base.proj(x, u)

    def egrad2rgrad(self, x, g):
        return self.base.egrad2rgrad(x, g)

    def retract(self, x, u):
        return self.base.retract(x, u)

    def frame(self, x):
        return self.base.frame(x)

    def rand(self, rng):
        return self.base.rand(rng)

    def vectorize(self, u):
        return self.base.vectorize(u)

    mean = None


class _Compound(_Divergences):
    """Compound Gaussians (mean, scatter, textures); the metric weighs scatter by n and textures by p."""

    def __init__(self, p: int, n: int, scatter: Geometry, textures: Geometry, complex_valued: bool):
        super().__init__([Euclidean(p, complex_valued=complex_valued), scatter, textures])
        self.p, self.n, self.has_log = p, n, False

    def inner(self, x, u, v):
        c = np.linalg.cholesky(x[1])
        a, b = (np.linalg.solve(c, _col(w))[..., 0] for w in (u[0], v[0]))
        head = 2 * (1 / x[2]).sum(axis=-1) * np.real((np.conj(a) * b).sum(axis=-1))
        return head + self.n * self.parts[1].inner(x[1], u[1], v[1]) + self.p * self.parts[2].inner(x[2], u[2], v[2])

    def egrad2rgrad(self, x, g):
        scale = 2 * (1 / x[2]).sum(axis=-1)
        return (
            (x[1] @ _col(g[0]))[..., 0] / _col(scale),
            self.parts[1].egrad2rgrad(x[1], g[1]) / self.n,
            self.parts[2].egrad2rgrad(x[2], g[2]) / self.p,
        )

    def frame(self, x):
        r = sqrtm(x[1]) / np.sqrt(2 * (1 / x[2]).sum())
        zeros = [np.zeros_like(a) for a in x]
        out = [(r @ e, zeros[1], zeros[2]) for e in self.parts[0].frame(x[0])]
        out += [(zeros[0], e / np.sqrt(self.n), zeros[2]) for e in self.parts[1].frame(x[1])]
        return out + [(zeros[0], zeros[1], e / np.sqrt(self.p)) for e in self.parts[2].frame(x[2])]

    def _step(self, x, u):
        inverse = np.linalg.inv(x[1])
        load = (1 / x[2]).sum(axis=-1)
        drift = _mat((u[2] / x[2] ** 2).sum(axis=-1) / load) * np.eye(self.p) + u[1] @ inverse
        mean = x[0] + u[0] + (drift @ _col(u[0]))[..., 0] / 2
        bend = u[1] @ inverse @ u[1] - _mat(load / self.n) * _outer(u[0])
        lift = u[2] ** 2 / x[2] - _col(_quadratic(u[0], x[1])) / self.p
        return mean, hermitian_part(x[1] + u[1] + bend / 2), x[2] + u[2] + lift / 2

    @staticmethod
    def _smallest(y):
        return np.minimum(np.linalg.eigvalsh(y[1]).min(axis=-1), y[2].min(axis=-1))

    def transport(self, x, y, u):
        return self.proj(y, u)


class CompoundUnitScatter(_Compound):
    """Compound Gaussians whose scatter has determinant 1; no distance."""

    has_dist = False

    def __init__(self, p: int, n: int, complex_valued: bool = False):
        super().__init__(p, n, UnitDeterminant(p, complex_valued), Positive(n), complex_valued)

    def retract(self, x, u):
        m, s, t = _guarded(self._step, self._smallest, x, u)
        return m, unit_det(s)[0], t


class CompoundUnitTextures(_Compound):
    """Compound Gaussians whose textures have product 1."""

    def __init__(self, p: int, n: int, complex_valued: bool = False, divergence: str = "alpha", alpha: float = 0.5):
        super().__init__(p, n, PositiveDefinite(p, complex_valued), UnitProduct(n), complex_valued)
        self.divergence, self.alpha = divergence, alpha

    def retract(self, x, u):
        m, s, t = _guarded(self._step, self._smallest, x, u)
        return m, s, UnitProduct._unit(t)

    def div_kl(self, x, y):
        s = np.linalg.solve(y[1], x[1])
        kl = (x[2] / y[2]).sum(axis=-1) * np.real(trace(s)) + (1 / y[2]).sum(axis=-1) * _quadratic(y[0] - x[0], y[1])
        kl = kl - self.n * self.p - self.n * (log_det(x[1]) - log_det(y[1]))
        return np.sqrt(np.abs(kl))

    def log_integral(self, x, y):
        a = self.alpha
        s1, s2 = (p[2][..., None, None] * p[1][..., None, :, :] for p in (x, y))
        m = (1 - a) * s1 + a * s2
        logs = self.n * ((1 - a) * log_det(x[1]) + a * log_det(y[1])) - log_det(m).sum(axis=-1)
        d = y[0] - x[0]
        maha = np.real((np.conj(d) * (np.linalg.inv(m).sum(axis=-3) @ _col(d))[..., 0]).sum(axis=-1))
        return logs - a * (1 - a) * maha

    def grad_kl(self, x, y, second=False):
        i, v, vv = _inverse_outer(y[1], y[0] - x[0])
        ratio, load = (x[2] / y[2]).sum(axis=-1), (1 / y[2]).sum(axis=-1)
        t = np.real(trace(i @ x[1]))
        if second:
            q = _quadratic(y[0] - x[0], y[1])
            return 2 * _col(load) * v, self.n * i - _mat(ratio) * (i @ x[1] @ i) - _mat(load) * vv, -(x[2] * _col(t) + _col(q)) / y[2] ** 2
        return -2 * _col(load) * v, _mat(ratio) * i - self.n * np.linalg.inv(x[1]), _col(t) / y[2]

    def log_integral_gradient(self, x, y, second=False):
        """Of :meth:`log_integral`, in its first argument or its second."""
        a, d = self.alpha, y[0] - x[0]
        s1, s2 = (p[2][..., None, None] * p[1][..., None, :, :] for p in (x, y))
        i, v, vv = _inverse_outer((1 - a) * s1 + a * s2, d[..., None, :])
        w, own, sign = (a, y, -1) if second else (1 - a, x, 1)
        t = own[2]
        bend = a * (1 - a) * vv - i
        scatter = w * (self.n * np.linalg.inv(own[1]) + (t[..., None, None] * bend).sum(axis=-3))
        return sign * 2 * a * (1 - a) * v.sum(axis=-2), scatter, w * np.real(trace(bend @ own[1][..., None, :, :]))

    def grad_alpha(self, x, y, second=False, real=False):
        sign = np.sign(self.log_integral(x, y)) * (0.5 if real else 1.0)
        m, s, t = self.log_integral_gradient(x, y, second)
        return _col(sign) * m, _mat(sign) * s, _col(sign) * t

    def div_alpha(self, x, y):
        if self.alpha in (0, 1):
            return self.div_kl(*((x, y) if self.alpha == 0 else (y, x)))
        return np.sqrt(np.abs(self.log_integral(x, y)))

    def div_alpha_real(self, x, y):
        return self.div_alpha(x, y) / np.sqrt(2)


class CompoundTriangle(_Divergences):
    """Compound Gaussians of unit texture product as a weighted Gaussian part and a texture part."""

    def __init__(self, p: int, n: int, complex_valued: bool = False, weights=(1, 1), divergence: str = "orth"):
        gauss = GaussianIG(p, complex_valued, divergence)
        super().__init__([*gauss.parts, UnitProduct(n)])
        self.gauss, self.textures, self.w, self.divergence, self.has_log = gauss, UnitProduct(n), tuple(weights), divergence, False

    def inner(self, x, u, v):
        return self.w[0] * self.gauss.inner(x[:2], u[:2], v[:2]) + self.w[1] * self.textures.inner(x[2], u[2], v[2])

    def egrad2rgrad(self, x, g):
        a, b = self.gauss.egrad2rgrad(x[:2], g[:2])
        c = self.textures.egrad2rgrad(x[2], g[2])
        return tuple(r / w if w else np.zeros_like(r) for r, w in zip((a, b, c), (self.w[0], self.w[0], self.w[1]), strict=True))

    def frame(self, x):
        zero = np.zeros_like(x[2])
        out = [(*e, zero) for e in self.gauss.frame(x[:2])] if self.w[0] else []
        scale = [np.sqrt(w) if w else 1.0 for w in self.w]
        out = [tuple(a / scale[0] for a in e) for e in out]
        tail = [(np.zeros_like(x[0]), np.zeros_like(x[1]), e / scale[1]) for e in self.textures.frame(x[2])] if self.w[1] else []
        return out + tail

    def exp(self, x, u):
        return (*self.gauss.exp(x[:2], u[:2]), self.textures.exp(x[2], u[2]))

    def retract(self, x, u):
        return (*self.gauss.retract(x[:2], u[:2]), self.textures.retract(x[2], u[2]))

    def transport(self, x, y, u):
        return self.proj(y, u)

    def _with_textures(self, d, x, y):
        return np.sqrt(self.w[0] * d**2 + self.w[1] * self.textures.dist(x[2], y[2]) ** 2)

    def _gradient_with_textures(self, gauss, x, y, second):
        t = 2 * (np.log(x[2]) - np.log(y[2]))
        return self.w[0] * gauss[0], self.w[0] * gauss[1], self.w[1] * (-t / y[2] if second else t / x[2])

    def grad_orth(self, x, y, second=False):
        return self._gradient_with_textures(self.gauss.grad_orth(x[:2], y[:2], second), x, y, second)

    def grad_scale(self, x, y, second=False):
        return self._gradient_with_textures(self.gauss.grad_scale(x[:2], y[:2], second), x, y, second)

    def div_orth(self, x, y):
        return self._with_textures(self.gauss.div_orth(x[:2], y[:2]), x, y)

    def div_scale(self, x, y):
        return self._with_textures(self.gauss.div_scale(x[:2], y[:2]), x, y)


class RobustSubspaceIG(Product):
    """Textures and a subspace of a low-rank compound Gaussian; no distance."""

    has_dist = False

    def __init__(self, n: int, p: int, k: int, complex_valued: bool = False):
        super().__init__([Positive(n), Grassmann(p, k, complex_valued)])
        self.k, self.has_log = k, False

    def inner(self, x, u, v):
        load = 2 * (x[0] ** 2 / (1 + x[0])).sum(axis=-1)
        head = self.k * (u[0] * v[0] / (1 + x[0]) ** 2).sum(axis=-1)
        return head + load * np.real(trace(herm(u[1]) @ v[1]))

    def egrad2rgrad(self, x, g):
        load = 2 * (x[0] ** 2 / (1 + x[0])).sum(axis=-1)
        return g[0] * (1 + x[0]) ** 2 / self.k, self.parts[1].proj(x[1], g[1]) / _mat(load)

    def retract(self, x, u):
        def step(x, u):
            return x[0] + u[0] + u[0] ** 2 / x[0] / 2, self.parts[1].retract(x[1], u[1])

        return _guarded(step, lambda y: y[0].min(axis=-1), x, u)

    def transport(self, x, y, u):
        return self.proj(y, u)


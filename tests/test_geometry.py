import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tangentia.functions import geometry as geo
from tangentia.functions import matrix as mx

SMOOTH = [
    lambda c: geo.Euclidean(4, complex_valued=c),
    lambda c: geo.Positive(5),
    lambda c: geo.UnitProduct(5),
    lambda c: geo.PositiveDefinite(4, c),
    lambda c: geo.UnitDeterminant(4, c),
    lambda c: geo.Grassmann(6, 2, c),
    lambda c: geo.Product([geo.Euclidean(3), geo.UnitDeterminant(3, c), geo.Positive(4)], [1, 2, 0.5]),
]
DIVERGENT = [
    lambda c: geo.GaussianIG(3, c),
    lambda c: geo.GaussianIG(3, c, "scale"),
    lambda c: geo.GaussianIG(3, c, "alpha", 0.3),
    lambda c: geo.GaussianIG(3, c, "alpha_sym_real", 0.5),
    lambda c: geo.CompoundUnitScatter(3, 6, c),
    lambda c: geo.CompoundUnitTextures(3, 6, c),
    lambda c: geo.CompoundTriangle(3, 6, c),
    lambda c: geo.CovarianceAlpha(3, c),
]


def _spd(rng, p, c=False):
    return geo.PositiveDefinite(p, c).rand(rng)


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.sampled_from(range(len(SMOOTH))))
def test_exp_undoes_log(seed, cplx, which):
    rng, g = np.random.default_rng(seed), SMOOTH[which](cplx)
    x, y = g.rand(rng), g.rand(rng)
    log = g.log(x, y)
    assert g.norm(x, log) == pytest.approx(float(g.dist(x, y)), rel=1e-5, abs=1e-6)
    assert float(g.dist(g.exp(x, log), y)) < 1e-5
    assert float(g.dist(x, y)) == pytest.approx(float(g.dist(y, x)), rel=1e-7)


@pytest.mark.parametrize("make", SMOOTH + DIVERGENT)
@pytest.mark.parametrize("cplx", [False, True])
def test_frames_are_orthonormal_tangents(make, cplx):
    g, rng = make(cplx), np.random.default_rng(1)
    x = g.rand(rng)
    frame = g.frame(x)
    gram = np.array([[g.inner(x, a, b) for a in frame] for b in frame])
    np.testing.assert_allclose(gram, np.eye(len(frame)), atol=1e-8)
    for e in frame:
        for a, b in zip(*(z if isinstance(z, tuple) else (z,) for z in (g.proj(x, e), e)), strict=True):
            np.testing.assert_allclose(a, b, atol=1e-8)


@pytest.mark.parametrize("make", SMOOTH + DIVERGENT)
def test_retraction_is_first_order(make):
    g, rng = make(True), np.random.default_rng(2)
    x = g.rand(rng)
    u = g.rand_tangent(x, rng)
    h = 1e-5
    y = g.retract(x, tuple(h * a for a in u) if isinstance(u, tuple) else h * u)
    for a, b, v in zip(*(z if isinstance(z, tuple) else (z,) for z in (x, y, u)), strict=True):
        if not isinstance(g, geo.Grassmann):
            np.testing.assert_allclose((b - a) / h, v, atol=1e-3)


@pytest.mark.parametrize("make", DIVERGENT)
def test_divergences_vanish_only_at_equality(make):
    g, rng = make(True), np.random.default_rng(3)
    if not g.has_dist:
        pytest.skip("no distance")
    x, y = g.rand(rng), g.rand(rng)
    assert float(g.dist(x, x)) < 1e-5
    assert float(g.dist(x, y)) > 1e-2


def test_affine_invariance_and_closed_form():
    rng = np.random.default_rng(4)
    g = geo.PositiveDefinite(4, True)
    a, b = g.rand(rng), g.rand(rng)
    m = rng.standard_normal((4, 4)) + 1j * rng.standard_normal((4, 4))
    d = float(g.dist(a, b))
    assert float(g.dist(mx.hermitian_part(m @ a @ mx.herm(m)), mx.hermitian_part(m @ b @ mx.herm(m)))) == pytest.approx(d, rel=1e-8)
    r = mx.invsqrtm(a)
    assert np.linalg.norm(mx.logm(mx.hermitian_part(r @ b @ r))) == pytest.approx(d, rel=1e-10)


def test_gaussian_exponential_moves_at_unit_speed():
    g, rng = geo.GaussianIG(3, True), np.random.default_rng(5)
    x = g.rand(rng)
    u = g.rand_tangent(x, rng)
    h = 1e-4
    y = g.exp(x, tuple(h * a for a in u))
    for a, b, v in zip(x, y, u, strict=True):
        np.testing.assert_allclose((b - a) / h, v, atol=1e-3)


def test_alpha_near_its_ends_is_kullback_leibler():
    """The integral is of x^alpha y^(1 - alpha), so the limits are those of the swapped arguments; the ends themselves are fixed by name."""
    rng = np.random.default_rng(6)
    x, y = geo.GaussianIG(3).rand(rng), geo.GaussianIG(3).rand(rng)
    kl = geo.GaussianIG(3, divergence="kl")
    near = [geo.GaussianIG(3, divergence="alpha", alpha=a) for a in (1e-6, 1 - 1e-6)]
    ends = [geo.GaussianIG(3, divergence="alpha", alpha=a) for a in (0, 1)]
    assert float(near[0].dist(x, y)) == pytest.approx(float(kl.dist(y, x)), rel=1e-3)
    assert float(near[1].dist(x, y)) == pytest.approx(float(kl.dist(x, y)), rel=1e-3)
    assert float(ends[0].dist(x, y)) == pytest.approx(float(kl.dist(x, y)))
    assert float(ends[1].dist(x, y)) == pytest.approx(float(kl.dist(y, x)))


def test_batches_agree_with_single_points():
    rng = np.random.default_rng(7)
    for make in SMOOTH + DIVERGENT:
        g = make(True)
        if not g.has_dist:
            continue
        xs = [g.rand(rng) for _ in range(3)]
        m = g.rand(rng)
        batch = tuple(np.stack(z) for z in zip(*xs, strict=True)) if isinstance(m, tuple) else np.stack(xs)
        np.testing.assert_allclose(g.dist(m, batch), [float(g.dist(m, x)) for x in xs], rtol=1e-9, atol=1e-9)


def test_spectral_functions():
    rng = np.random.default_rng(8)
    a = np.stack([_spd(rng, 3, True) for _ in range(4)])
    np.testing.assert_allclose(mx.sqrtm(a) @ mx.sqrtm(a), a, atol=1e-10)
    np.testing.assert_allclose(mx.expm(mx.logm(a)), a, atol=1e-10)
    np.testing.assert_allclose(mx.invsqrtm(a) @ a @ mx.invsqrtm(a), mx.eye(3, 4), atol=1e-10)
    np.testing.assert_allclose(mx.coshm(a) + mx.sinhm(a), mx.expm(a), atol=1e-8)
    np.testing.assert_allclose(mx.powm(a, -1), np.linalg.inv(a), atol=1e-8)
    singular = np.diag([2.0, 1e-16])
    np.testing.assert_allclose(mx.generalized_inverse(singular), np.diag([0.5, 1e-16]))
    unit, c = mx.unit_det(a)
    np.testing.assert_allclose(mx.log_det(unit), 0, atol=1e-10)
    np.testing.assert_allclose(unit * c[:, None, None], a)
    np.testing.assert_allclose(mx.sym(a) + mx.skew(a), a)


@pytest.mark.parametrize("make", [SMOOTH[i] for i in (0, 1, 2, 3, 4, 5)])
@pytest.mark.parametrize("cplx", [False, True])
def test_hessians_by_differences_of_the_cost(make, cplx):
    """<u, Hess u> is the second derivative of the cost along a geodesic."""
    g, rng = make(cplx), np.random.default_rng(9)
    x = g.rand(rng)
    a = rng.standard_normal(np.shape(x)) + (1j * rng.standard_normal(np.shape(x)) if g.complex_valued else 0)

    def cost(y):
        return 0.5 * np.real(np.conj(a) * y).sum() ** 2 if not isinstance(g, geo.Grassmann) else 0.5 * np.real(np.trace(mx.herm(y) @ m @ y))

    if isinstance(g, geo.Grassmann):
        m = mx.hermitian_part(a @ mx.herm(a))
        grad, hess = (lambda y: m @ y), (lambda y, u: m @ u)
    else:
        grad, hess = (lambda y: np.real(np.conj(a) * y).sum() * a), (lambda y, u: np.real(np.conj(a) * u).sum() * a)
    u = g.rand_tangent(x, rng)
    got = float(g.inner(x, u, g.ehess2rhess(x, grad(x), hess(x, u), u)))
    h = 1e-4
    want = (cost(g.exp(x, h * u)) - 2 * cost(x) + cost(g.exp(x, -h * u))) / h**2
    assert got == pytest.approx(float(want), rel=1e-3, abs=1e-4)


def test_dimensions_and_halfway_points():
    assert geo.PositiveDefinite(3).dim == 6 and geo.PositiveDefinite(3, True).dim == 9
    assert geo.UnitDeterminant(3).dim == 5 and geo.UnitProduct(4).dim == 3
    assert geo.Grassmann(5, 2).dim == 6 and geo.Positive(4).typical_dist == 2
    rng = np.random.default_rng(10)
    for make in SMOOTH:
        g = make(False)
        x, y = g.rand(rng), g.rand(rng)
        m = g.pair_mean(x, y)
        assert float(g.dist(x, m)) == pytest.approx(float(g.dist(m, y)), rel=1e-5)


def _gradient_spaces():
    for cplx in (False, True):
        for name in ("orth", "scale", "kl", "orth_sym", "scale_sym", "alpha", "alpha_real", "alpha_sym", "alpha_sym_real"):
            for alpha in (0, 0.3, 1) if name.startswith("alpha") else (0.5,):
                yield geo.GaussianIG(3, cplx, name, alpha)
                if not name.startswith(("orth", "scale")):
                    yield geo.CovarianceAlpha(3, cplx, name, alpha)
                    yield geo.CompoundUnitTextures(3, 4, cplx, name, alpha)
                elif name in ("orth", "scale"):
                    yield geo.CompoundTriangle(3, 4, cplx, (2, 0.5), name)


def test_gradients_of_divergences_equal_differences():
    """Closed forms against central differences along a frame, for every divergence, real and complex."""
    rng = np.random.default_rng(5)
    seen = 0
    for g in _gradient_spaces():
        x, y = g.rand(rng), g.rand(rng)
        batch = tuple(a[None] for a in x) if isinstance(x, tuple) else x[None]
        other = tuple(a[None] for a in y) if isinstance(y, tuple) else y[None]
        got = g.squared_gradient(batch, other)
        got = tuple(a[0] for a in got) if isinstance(got, tuple) else got[0]
        r = g.egrad2rgrad(x, got)
        for e in g.frame(x):
            h = 1e-5
            up, down = (g.retract(x, tuple(s * h * a for a in e) if isinstance(e, tuple) else s * h * e) for s in (1, -1))
            want = (g.dist(up, y) ** 2 - g.dist(down, y) ** 2) / (2 * h)
            assert g.inner(x, r, e) == pytest.approx(float(want), rel=2e-4, abs=2e-5), (type(g).__name__, getattr(g, "divergence", ""))
            seen += 1
    assert seen > 500

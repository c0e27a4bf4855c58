import numpy as np
import pytest

from tangentia.functions import checks, estimators, generate
from tangentia.functions import geometry as geo
from tangentia.functions.solvers import descend, stochastic


def _error(a, b):
    return np.linalg.norm(a - b) / np.linalg.norm(b)


@pytest.mark.parametrize("cplx", [False, True])
def test_scm_and_tyler_recover(cplx):
    rng = np.random.default_rng(0)
    sigma = generate.covariance(5, rng, cplx, unit_determinant=True)
    assert _error(estimators.scm(generate.gaussian(sigma, 200_000, rng)), sigma) < 0.02
    x = generate.compound(sigma, generate.textures(100_000, rng), rng)
    found, tau = estimators.tyler(x)
    assert _error(found, sigma) < 0.02
    assert np.linalg.det(found).real == pytest.approx(1)
    assert np.trace(estimators.tyler(x[:, :1000], normalize="trace")[0]).real == pytest.approx(5)


def test_joint_tyler_recovers():
    rng = np.random.default_rng(1)
    sigma, mu = generate.covariance(5, rng, True, True), np.arange(5) + 1j
    found = estimators.joint_tyler(generate.compound(sigma, generate.textures(100_000, rng), rng, mu))
    assert _error(found[0], mu) < 0.01
    assert _error(found[1], sigma) < 0.05


@pytest.mark.parametrize("unit,penalty,beta", [("scatter", "AF", 0.0), *[("textures", k, 0.3) for k in ("L1", "L2", "AF", "BW", "KL")]])
def test_likelihood_gradients_by_differences(unit, penalty, beta):
    rng = np.random.default_rng(2)
    x = generate.compound(generate.covariance(3, rng, True), generate.textures(20, rng), rng, np.ones(3) * 1j)
    f = estimators.CompoundLikelihood(x, unit, penalty, beta)
    at = (x.mean(axis=1), estimators.scm(x, False), generate.textures(20, rng))
    u = (rng.standard_normal(3) + 1j * rng.standard_normal(3), geo.PositiveDefinite(3, True).proj(None, rng.standard_normal((3, 3)) + 1j * rng.standard_normal((3, 3))), rng.standard_normal(20))
    h = 1e-6
    slope = (f.cost(tuple(a + h * b for a, b in zip(at, u, strict=True))) - f.cost(tuple(a - h * b for a, b in zip(at, u, strict=True)))) / (2 * h)
    inner = sum(np.real((np.conj(a) * b).sum()) for a, b in zip(f.egrad(at), u, strict=True))
    assert inner == pytest.approx(slope, rel=1e-5)


def test_compound_maximum_likelihood():
    rng = np.random.default_rng(3)
    sigma, mu = generate.covariance(4, rng, True, True), np.arange(4) + 0j
    x = generate.compound(sigma, generate.textures(600, rng), rng, mu)
    for unit in ("scatter", "textures"):
        m, s, tau = estimators.compound(x, unit, max_iter=200)
        assert _error(m, mu) < 0.05
        assert _error(geo.unit_det(s)[0], sigma) < 0.2
        if unit == "textures":
            assert np.log(tau).sum() == pytest.approx(0, abs=1e-8)
    with pytest.raises(ValueError):
        estimators.CompoundLikelihood(x, kappa=-1)
    with pytest.raises(ValueError):
        estimators.CompoundLikelihood(x, penalty="none")


def test_low_rank_estimators_agree():
    rng = np.random.default_rng(4)
    u = generate.stiefel(8, 2, rng, True)
    x = generate.low_rank(10 * generate.textures(500, rng), u, rng)

    def gap(v):
        return np.linalg.norm(v @ v.conj().T - u @ u.conj().T) / np.sqrt(2)

    assert gap(estimators.tau_subspace(x, 2)[1]) < 0.1
    assert gap(estimators.tau_subspace(x, 2, estimate_sigma=True)[1]) < 0.1
    for options in ({}, {"information_geometry": True}, {"information_geometry": True, "solver": "SGD", "batch_size": 100}):
        assert gap(estimators.tau_subspace_riemannian(x, 2, max_iter=100, **options)[1]) < 0.1
    with pytest.raises(ValueError):
        estimators.tau_subspace_riemannian(x, 2, solver="SGD")


def test_subspace_gradient_by_differences():
    rng = np.random.default_rng(5)
    x = generate.low_rank(generate.textures(30, rng), generate.stiefel(5, 2, rng), rng)
    f = estimators.SubspaceLikelihood(x, 2)
    at, d = (generate.textures(30, rng), generate.stiefel(5, 2, rng)), (rng.standard_normal(30), rng.standard_normal((5, 2)))
    h = 1e-6
    slope = (f.cost(tuple(a + h * b for a, b in zip(at, d, strict=True))) - f.cost(tuple(a - h * b for a, b in zip(at, d, strict=True)))) / (2 * h)
    assert sum((a * b).sum() for a, b in zip(f.egrad(at), d, strict=True)) == pytest.approx(slope, rel=1e-5)


def test_solvers():
    g = geo.Euclidean(3)
    target = np.array([1.0, -2, 3])
    for method in ("steepest", "conjugate"):
        found = descend(g, lambda x: ((x - target) ** 2).sum(), lambda x: 2 * (x - target), np.zeros(3), method)
        np.testing.assert_allclose(found.point, target, atol=1e-5)
    for schedule in ("decay", "fix", "hybrid"):
        found = stochastic(g, lambda x: ((x - target) ** 2).sum(), lambda x: 2 * (x - target), np.zeros(3), rate=0.3, schedule=schedule, decay_steps=5, max_iter=200)
        np.testing.assert_allclose(found.point, target, atol=1e-3)
    with pytest.raises(ValueError):
        descend(g, None, None, None, "newton")


def test_generators():
    rng = np.random.default_rng(6)
    u = generate.stiefel(6, 3, rng, True)
    np.testing.assert_allclose(u.conj().T @ u, np.eye(3), atol=1e-12)
    assert generate.textures(20_000, rng).mean() == pytest.approx(1, abs=0.05)
    assert generate.textures(20_000, rng, "lognormal").mean() == pytest.approx(1, abs=0.1)
    t = generate.textures(100, rng, nu=0.1, least=0.2)
    assert t.min() >= 0.2
    assert np.log(generate.textures(100, rng, unit_product=True)).sum() == pytest.approx(0, abs=1e-9)
    np.testing.assert_allclose(generate.toeplitz(3, 0.5), [[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]])
    with pytest.raises(ValueError):
        generate.textures(3, rng, "none")


def test_checks():
    checks.positive("a", 1)
    checks.one_of("a", 1, (1, 2))
    checks.of_type("a", 1, int, str)
    checks.is_callable("a", print)
    for bad in (lambda: checks.positive("a", 0), lambda: checks.one_of("a", 3, (1,))):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: checks.of_type("a", 1, str), lambda: checks.is_callable("a", 1)):
        with pytest.raises(TypeError):
            bad()

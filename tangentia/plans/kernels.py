"""Further named queries: kernels, likelihoods and means of any size, run on few channels that SQL can state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.functions import estimators
from tangentia.functions import geometry as geo
from tangentia.functions import matrix as mx
from tangentia.functions.solvers import descend, descend_many
from tangentia.operators import estimate, features, images, learn, montecarlo, pairs
from tangentia.plans.catalog import (
    _BLOCKED, _COMPOUND, _COV2, _EMBEDDED, _LINES, _LOGS, _PAIRS2, _SHIFTED, _TR, _USERS, BLOCK, _blocks, _karcher, _lines, _lloyd_sql, _moments3, _own_compound,
    _projector3, _raster, _users, _vectors, query,
)

_SYM = {"s00": 0, "s01": 1, "s11": 3}


def _rounded(df: DataFrame, keys: list[str], entries: dict[str, Column], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[(F.round(v, digits) + F.lit(0.0)).alias(k) for k, v in entries.items()])


def _of(part: str, entries: dict[str, int]) -> dict[str, Column]:
    return {k: F.get(f"f.{part}", F.lit(i)) for k, i in entries.items()}


# -- pairs, criteria

@query(
    "all_pairs_distances",
    f"""WITH g AS MATERIALIZED ({_COV2}) SELECT x.id AS a, y.id AS b, round(sqrt({_LOGS.format(h=f"({_TR}/2)", d="(dx/dy)")}), 6) AS d
    FROM (SELECT id, a AS xa, b AS xb, e AS xe, a*e - b*b AS dx FROM g) x, (SELECT id, a AS ya, b AS yb, e AS ye, a*e - b*b AS dy FROM g) y""",
)
def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine-invariant distances of all ordered pairs, in blocks."""
    bound = features.covariance(assume_centered=False).bind(2, 1)
    f = bound.estimate(_lines(spark, sf_dir), ["id"], ["q", "d"])
    return pairs.distances(f, bound).select("a", "b", F.round("d", 6).alias("d"))


_FIRST4 = "SELECT s.k, v.i, v.x AS m FROM v JOIN (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings QUALIFY k < 4) s USING (id)"
_VALUES = " UNION ALL ".join(
    f"SELECT {r + 1} AS round, sum(d) AS value FROM (SELECT id, min(d) AS d FROM (SELECT v.id, c.k, sum(pow(v.x - c.m, 2)) AS d FROM v JOIN c{r} c ON c.i = v.i GROUP BY 1, 2) GROUP BY id)"
    for r in range(5)
)


@query("kmeans_criterion", f"WITH {_lloyd_sql(_EMBEDDED, _FIRST4, 5)} SELECT round::BIGINT AS round, round(value, 6) AS value FROM ({_VALUES})")
def _criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of squared distances to the nearest centroid, round by round."""
    v = _vectors(spark, sf_dir)
    p = v.select(F.size("f.c0")).first()[0]
    seeds = [r["id"] for r in v.select("id").orderBy("id").limit(4).collect()]
    model = learn.KMeans(features.mean_vector_euclidean().bind(p, 1), 4, seeds, n_init=1, max_iter=5, tol=0).fit(v)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(model.criteria[0])], "round long, value double")


# -- means of Gaussians and of products

_GAUSS = f"SELECT flag, id, avg(q) AS m0, avg(d) AS m1, var_pop(q) AS a, covar_pop(q, d) AS b, var_pop(d) AS e FROM ({_LINES}) GROUP BY flag, id"


def _gaussian_mean(name: str, sql: str, feature: features.Feature, digits: int) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = feature.bind(2, 1)
        means = bound.means(bound.estimate(_lines(spark, sf_dir), ["flag", "id"], ["q", "d"]), "flag")
        rows = [(k, *[round(float(x), digits) for x in (*m, s[0, 0], s[0, 1], s[1, 1])]) for k, (m, s) in means.items()]
        return spark.createDataFrame(rows, "flag string, m0 double, m1 double, s00 double, s01 double, s11 double")


_gaussian_mean(
    "gaussian_kl1_mean_by_flag",
    f"""SELECT flag, round(avg(m0), 6) AS m0, round(avg(m1), 6) AS m1, round(avg(a + m0*m0) - avg(m0)*avg(m0), 6) AS s00,
    round(avg(b + m0*m1) - avg(m0)*avg(m1), 6) AS s01, round(avg(e + m1*m1) - avg(m1)*avg(m1), 6) AS s11 FROM ({_GAUSS}) GROUP BY flag""",
    features.location_covariance_div_alpha(alpha=1), 6,
)
_gaussian_mean(
    "gaussian_kl0_mean_by_flag",
    f"""SELECT flag, round((e*u - b*v)/(a*e - b*b), 6) AS m0, round((a*v - b*u)/(a*e - b*b), 6) AS m1, round(e/(a*e - b*b), 6) AS s00, round(-b/(a*e - b*b), 6) AS s01,
    round(a/(a*e - b*b), 6) AS s11 FROM (SELECT flag, avg(e/z) AS a, avg(-b/z) AS b, avg(a/z) AS e, avg((e*m0 - b*m1)/z) AS u, avg((a*m1 - b*m0)/z) AS v
    FROM (SELECT *, a*e - b*b AS z FROM ({_GAUSS})) GROUP BY flag)""",
    features.location_covariance_div_alpha(alpha=0), 6,
)


def _gaussian_alpha_sql(a: float, rounds: int) -> str:
    """The stationary point by fixed-point rounds: weights are the integrals, the mean and inverse scatter weighted by the mixtures' inverses."""
    ctes = [f"s AS MATERIALIZED ({_GAUSS})", "t0 AS MATERIALIZED (SELECT flag, avg(m0) AS n0, avg(m1) AS n1, avg(a) AS ma, avg(b) AS mb, avg(e) AS me FROM s GROUP BY flag)"]
    for i in range(rounds):
        ctes.append(f"""w{i} AS MATERIALIZED (SELECT *, pow(ma*me - mb*mb, {1 - a})*pow(a*e - b*b, {a})/z*exp(-{a * (1 - a)}*(u*pu + v*pv)) AS w
        FROM (SELECT *, (ze*u - zb*v)/z AS pu, (za*v - zb*u)/z AS pv FROM (SELECT *, za*ze - zb*zb AS z, m0 - n0 AS u, m1 - n1 AS v
        FROM (SELECT *, {1 - a}*ma + {a}*a AS za, {1 - a}*mb + {a}*b AS zb, {1 - a}*me + {a}*e AS ze FROM s JOIN t{i} USING (flag)))))""")
        ctes.append(f"""t{i + 1} AS MATERIALIZED (SELECT flag, (pe*x - pb*y)/(pa*pe - pb*pb) AS n0, (pa*y - pb*x)/(pa*pe - pb*pb) AS n1, ie/(ia*ie - ib*ib) AS ma, -ib/(ia*ie - ib*ib) AS mb, ia/(ia*ie - ib*ib) AS me
        FROM (SELECT flag, sum(w*ze/z) AS pa, -sum(w*zb/z) AS pb, sum(w*za/z) AS pe, sum(w*(ze*m0 - zb*m1)/z) AS x, sum(w*(za*m1 - zb*m0)/z) AS y,
        sum(w*(ze/z - {a * (1 - a)}*pu*pu))/sum(w) AS ia, sum(w*(-zb/z - {a * (1 - a)}*pu*pv))/sum(w) AS ib, sum(w*(za/z - {a * (1 - a)}*pv*pv))/sum(w) AS ie FROM w{i} GROUP BY flag))""")
    outs = ", ".join(f"round({v}, 4) AS {k}" for k, v in {"m0": "n0", "m1": "n1", "s00": "ma", "s01": "mb", "s11": "me"}.items())
    return f"WITH {', '.join(ctes)} SELECT flag, {outs} FROM t{rounds}"


_gaussian_mean("gaussian_alpha_mean_by_flag", _gaussian_alpha_sql(0.3, 60), features.location_covariance_div_alpha(alpha=0.3, least_gradient=1e-9), 4)


def _blocks2(spark: SparkSession, sf_dir: str, name: str, estimator, space, weights=None) -> tuple[features.Feature, DataFrame]:
    bound = features.user_defined(name, estimator, space, weights, least_gradient=1e-10).bind(2, BLOCK)
    return bound, bound.estimate(_blocks(_users(spark, sf_dir)), ["id", "block"], ["v", "h"], ["obs"])


@query("unit_textures_mean", f"{_COMPOUND} SELECT obs::INTEGER AS obs, round(exp(avg(ln(tau))), 5) AS tau FROM t GROUP BY obs")
def _unit_textures_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of texture vectors of product 1."""
    bound, f = _blocks2(spark, sf_dir, "own_textures", lambda x: _own_compound(x)[2], geo.UnitProduct(BLOCK))
    tau = bound.mean(f)
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(tau)], "obs int, tau double")


@query(
    "product_mean",
    f"""{_COMPOUND}, y AS MATERIALIZED (SELECT 0 AS k, m0, m1, a, b, e FROM g), {_karcher("y", "k", "m", 30)}
    SELECT round(avg(m0), 5) AS m0, round(avg(m1), 5) AS m1, round(any_value(ma), 5) AS s00, round(any_value(mb), 5) + 0.0 AS s01, round(any_value(me), 5) AS s11 FROM y JOIN m30 USING (k)""",
)
def _product_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean in a product: of locations the average, of scatters the geometric mean, each by its own logarithm."""
    bound, f = _blocks2(spark, sf_dir, "own_pair", lambda x: _own_compound(x)[:2], [geo.Euclidean(2), geo.PositiveDefinite(2)], (1, 0.5))
    m, s = features.Means(bound, f).run(1000)[None]
    return spark.createDataFrame([tuple(round(float(x), 5) + 0.0 for x in (*m, s[0, 0], s[0, 1], s[1, 1]))], "m0 double, m1 double, s00 double, s01 double, s11 double")


# -- functions of matrices, geodesics

#: Name, kernel and the function of an eigenvalue l in SQL.
_FUNCTIONS = {
    "sqrt": (mx.sqrtm, "sqrt({l})"), "invsqrt": (mx.invsqrtm, "1/sqrt({l})"), "log": (mx.logm, "ln({l})"), "exp": (mx.expm, "exp({l})"),
    "cosh": (mx.coshm, "(exp({l}) + exp(-{l}))/2"), "sinh": (mx.sinhm, "(exp({l}) - exp(-{l}))/2"), "pow": (lambda a: mx.powm(a, 0.3), "pow({l}, 0.3)"),
    "inverse": (mx.generalized_inverse, "1/{l}"), "unit": (lambda a: mx.unit_det(a)[0], "{l}/sqrt(l1*l2)"),
}
_SPECTRAL = "SELECT *, t + r AS l1, t - r AS l2 FROM (SELECT *, (a + e)/2 AS t, sqrt(pow((a - e)/2, 2) + b*b) AS r FROM ({}))"


def _functions_sql() -> str:
    parts = []
    for name, (_, f) in _FUNCTIONS.items():
        f1, f2 = f.format(l="l1"), f.format(l="l2")
        c1 = f"(({f1}) - ({f2}))/(l1 - l2)"
        c0 = f"(({f1}) - {c1}*l1)"
        parts.append(f"SELECT id, '{name}' AS fn, round({c0} + {c1}*a, 6) + 0.0 AS s00, round({c1}*b, 6) + 0.0 AS s01, round({c0} + {c1}*e, 6) + 0.0 AS s11 FROM s")
    return f"WITH s AS MATERIALIZED ({_SPECTRAL.format(_COV2)}) " + " UNION ALL ".join(parts)


@query("matrix_functions", _functions_sql())
def _matrix_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral functions of every supplier's covariance."""

    def every(x: np.ndarray) -> np.ndarray:
        s = estimators.scm(x, assume_centered=False)
        return np.stack([f(s).ravel() for f, _ in _FUNCTIONS.values()])

    bound = features.user_defined("functions", every, geo.Euclidean(len(_FUNCTIONS), 4)).bind(2, 1)
    f = bound.estimate(_lines(spark, sf_dir), ["id"], ["q", "d"])
    names = F.array(*[F.lit(k) for k in _FUNCTIONS])
    each = f.select("id", "f", F.explode(F.sequence(F.lit(0), F.lit(len(_FUNCTIONS) - 1))).alias("k"))
    return each.select("id", F.get(names, F.col("k")).alias("fn"), *[(F.round(F.get("f.c0", 4 * F.col("k") + i), 6) + F.lit(0.0)).alias(n) for n, i in _SYM.items()])


def _at_base(name: str, sql: str, make) -> None:
    """A point made of every supplier's covariance and that of the supplier of the least id."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, plain = _lines(spark, sf_dir), features.covariance(assume_centered=False).bind(2, 1)
        base = plain.point(plain.estimate(lines, ["id"], ["q", "d"]).orderBy("id").limit(1).first()["f"])
        bound = features.user_defined(name, lambda x: make(geo.PositiveDefinite(2), base, estimators.scm(x, assume_centered=False)), geo.PositiveDefinite(2)).bind(2, 1)
        return _rounded(bound.estimate(lines, ["id"], ["q", "d"]), ["id"], _of("c0", _SYM))


_HALF = "(xa/sqrt(dx) + ya/sqrt(dy))*(xe/sqrt(dx) + ye/sqrt(dy)) - pow(xb/sqrt(dx) + yb/sqrt(dy), 2)"
_at_base(
    "geodesic_midpoint",
    "SELECT id, " + ", ".join(f"round(pow(dx*dy, 0.25)*(x{k}/sqrt(dx) + y{k}/sqrt(dy))/sqrt({_HALF}), 6) + 0.0 AS {n}" for n, k in (("s00", "a"), ("s01", "b"), ("s11", "e"))) + f" FROM ({_PAIRS2})",
    lambda g, m, x: g.pair_mean(m, x),
)
_at_base(
    "retraction",
    f"""SELECT id, round((xa + (xe*ya*ya - 2*xb*ya*yb + xa*yb*yb)/dx)/2, 6) + 0.0 AS s00, round((xb + (xe*ya*yb - xb*(ya*ye + yb*yb) + xa*yb*ye)/dx)/2, 6) + 0.0 AS s01,
    round((xe + (xe*yb*yb - 2*xb*yb*ye + xa*ye*ye)/dx)/2, 6) + 0.0 AS s11 FROM ({_PAIRS2})""",
    lambda g, m, x: g.retract(m, x - m),
)


@query(
    "kernel_grassmann",
    f"""WITH p AS MATERIALIZED ({_projector3(f"SELECT id, {_moments3('v', 'h', 'w')} FROM ({_USERS}) GROUP BY id")}), x AS (SELECT * FROM p ORDER BY id LIMIT 1)
    SELECT p.id, round(acos(sqrt(p.a*x.a + p.d*x.d + p.f*x.f + 2*(p.b*x.b + p.c*x.c + p.e*x.e))), 4) AS dist FROM p, x WHERE p.id <> x.id""",
)
def _grassmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of the users' first directions with that of the user of the least id."""
    bound = features.subspace_SCM(1).bind(3, 1)
    f = bound.estimate(_users(spark, sf_dir), ["id"], ["v", "h", "w"], ["ts", "event_id"])
    first = f.orderBy("id").limit(1).first()
    d = bound.distances_to(f.where(F.col("id") != first["id"]), [bound.point(first["f"])])
    return d.select("id", F.round(F.get("d", F.lit(0)), 4).alias("dist"))


# -- likelihoods

_BETA = 0.1
_PENALTIES = {
    "L1": "abs(1/{v} - 1/k)", "L2": "pow(1/{v} - 1/k, 2)", "AF": "pow(ln({v}/k), 2)", "BW": "pow(1/sqrt({v}) - 1/sqrt(k), 2)", "KL": "k/{v} + ln({v})",
}
_NLL = f"""{_COMPOUND}, r AS MATERIALIZED (SELECT o.id, o.block, tau, (e*u*u - 2*b*u*v + a*v*v)/z AS q, (e*u - b*v)/z AS pu, (a*v - b*u)/z AS pv, z, l1, l2, k
  FROM (SELECT o.id, o.block, o.obs, t.tau, s.*, o.v - m0 AS u, o.h - m1 AS v, a*e - b*b AS z, (a + e)/2 AS k FROM o JOIN t USING (id, block, obs)
  JOIN (SELECT * EXCLUDE (id, block), id AS i_, block AS b_ FROM ({_SPECTRAL.format("SELECT * FROM g")})) s ON s.i_ = o.id AND s.b_ = o.block) o)"""


@query(
    "compound_likelihood",
    f"""{_NLL} SELECT id, block::INTEGER AS block, round(sum(2*ln(tau) + q/tau), 4) AS scatter, round(-2*sum(pu/tau)/{2 * BLOCK}, 5) + 0.0 AS g0, round(-2*sum(pv/tau)/{2 * BLOCK}, 5) + 0.0 AS g1,
    {", ".join(f"round(({BLOCK}*ln(any_value(z)) + sum(q/tau) + {_BETA}*sum({f.format(v='(tau*l1)')} + {f.format(v='(tau*l2)')}))/{2 * BLOCK}, 4) AS {n.lower()}" for n, f in _PENALTIES.items())}
    FROM r GROUP BY id, block""",
)
def _compound_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log-likelihoods of compound Gaussians with every penalty, and the slope in the mean, at a point that the block gives."""

    def values(x: np.ndarray) -> np.ndarray:
        point = _own_compound(x)
        scatter = estimators.CompoundLikelihood(x, "scatter").cost(point)
        penal = [estimators.CompoundLikelihood(x, "textures", n, _BETA) for n in _PENALTIES]
        slope = estimators.CompoundLikelihood(x, "textures").egrad(point)[0]
        return np.array([scatter, *slope, *[nll.cost(point) for nll in penal]])

    _, f = _blocks2(spark, sf_dir, "likelihoods", values, geo.Euclidean(3 + len(_PENALTIES)))
    names = ["scatter", "g0", "g1", *[n.lower() for n in _PENALTIES]]
    out = [(F.round(F.get("f.c0", F.lit(i)), 5 if n in ("g0", "g1") else 4) + F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    return f.select("id", "block", *out)


@query(
    "subspace_likelihood",
    f"""{_COMPOUND}, r AS (SELECT id, block, tau, v, h, pow(0.6*v + 0.8*h, 2) AS p FROM o JOIN t USING (id, block, obs)),
    s AS (SELECT id, block, l2 FROM ({_SPECTRAL.format("SELECT id, block, avg(v*v) AS a, avg(v*h) AS b, avg(h*h) AS e FROM o GROUP BY 1, 2")}))
    SELECT id, block::INTEGER AS block, round(sum(ln(1 + tau) - tau/(1 + tau)*p), 4) AS cost, round(sum(1/(1 + tau) - p/pow(1 + tau, 2)), 4) AS slope,
    round(-2*sum(tau/(1 + tau)*v*(0.6*v + 0.8*h)), 4) AS u0, round(-2*sum(tau/(1 + tau)*h*(0.6*v + 0.8*h)), 4) AS u1, round(any_value(l2), 5) AS noise
    FROM r JOIN s USING (id, block) GROUP BY id, block""",
)
def _subspace_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood and slopes of the low-rank model at a fixed direction, and the noise beyond it."""
    u = np.array([[0.6], [0.8]])

    def values(x: np.ndarray) -> np.ndarray:
        nll, tau = estimators.SubspaceLikelihood(x, 1), _own_compound(x)[2]
        g_tau, g_u = nll.egrad((tau, u))
        return np.array([nll.cost((tau, u)), g_tau.sum(), *g_u[:, 0], estimators._noise(x, 1)])

    _, f = _blocks2(spark, sf_dir, "low_rank", values, geo.Euclidean(5))
    return f.select("id", "block", *[(F.round(F.get("f.c0", F.lit(i)), 5 if n == "noise" else 4) + F.lit(0.0)).alias(n) for i, n in enumerate(("cost", "slope", "u0", "u1", "noise"))])


# -- complex channels

#: Two complex channels of a line, (q + id, t + iq), and their moments.
_COMPLEX = f"SELECT id, q AS xr, d AS xi, t AS yr, q AS yi FROM ({_LINES})"
_HERMITIAN = "SELECT id, avg(xr*xr + xi*xi) AS a, avg(xr*yr + xi*yi) AS b, avg(xi*yr - xr*yi) AS c, avg(yr*yr + yi*yi) AS e FROM ({}) GROUP BY id"
_CHANNELS = [("q", "d"), ("t", "q")]
_TRC = "((x.e*y.a - 2*(x.b*y.b + x.c*y.c) + x.a*y.e)/x.z)"
_HPAIR = f"""WITH g AS MATERIALIZED (SELECT *, a*e - b*b - c*c AS z FROM ({_HERMITIAN.format(_COMPLEX)})), x AS (SELECT * FROM g ORDER BY id LIMIT 1)"""


def _complex_kernel(name: str, value: str, feature: features.Feature) -> None:
    @query(name, f"{_HPAIR} SELECT y.id, round(sqrt({value}), 6) AS dist FROM g y, x")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = feature.bind(2, 1, True)
        f = bound.estimate(_lines(spark, sf_dir), ["id"], _CHANNELS)
        base = bound.point(f.orderBy("id").limit(1).first()["f"])
        return bound.distances_to(f, [base]).select("id", F.round(F.get("d", F.lit(0)), 6).alias("dist"))


_complex_kernel("kernel_complex_airm", _LOGS.format(h=f"({_TRC}/2)", d="(y.z/x.z)"), features.covariance())
_complex_kernel(
    "kernel_complex_euclidean", "pow(x.a - y.a, 2) + 2*(pow(x.b - y.b, 2) + pow(x.c - y.c, 2)) + pow(x.e - y.e, 2)", features.covariance_euclidean()
)
_complex_kernel("kernel_complex_kl", f"{_TRC} - 2 - ln(y.z/x.z) + 1e-12", features.covariance_div_alpha(alpha=1))


def _complex_tyler_sql(rounds: int) -> str:
    """Rounds of Tyler's estimator of Hermitian 2 x 2 scatters."""
    ctes = [f"x AS MATERIALIZED ({_COMPLEX})", f"t0 AS MATERIALIZED (SELECT id, 2*a/(a+e) AS a, 2*b/(a+e) AS b, 2*c/(a+e) AS c, 2*e/(a+e) AS e FROM ({_HERMITIAN.format('SELECT * FROM x')}))"]
    for k in range(rounds):
        tau = "((e*(xr*xr + xi*xi) + a*(yr*yr + yi*yi) - 2*(b*(xr*yr + xi*yi) + c*(xi*yr - xr*yi)))/(a*e - b*b - c*c)/2)"
        ctes.append(f"""t{k + 1} AS MATERIALIZED (SELECT id, avg((xr*xr + xi*xi)/w) AS a, avg((xr*yr + xi*yi)/w) AS b, avg((xi*yr - xr*yi)/w) AS c, avg((yr*yr + yi*yi)/w) AS e
        FROM (SELECT x.*, {tau} AS w FROM x JOIN t{k} USING (id)) GROUP BY id)""")
    det = "sqrt(a*e - b*b - c*c)"
    return f"WITH {', '.join(ctes)} SELECT id, round(a/{det}, 5) AS re00, round(b/{det}, 5) + 0.0 AS re01, round(c/{det}, 5) + 0.0 AS im01, round(e/{det}, 5) AS re11 FROM t{rounds}"


@query("complex_tyler_by_supplier", _complex_tyler_sql(5))
def _complex_tyler(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = features.user_defined("tyler", lambda x: estimators.tyler(x, tol=-1, max_iter=5)[0], geo.UnitDeterminant(2, True)).bind(2, 1, True)
    f = bound.estimate(_lines(spark, sf_dir), ["id"], _CHANNELS)
    at = {"re00": ("re", 0), "re01": ("re", 1), "im01": ("im", 1), "re11": ("re", 3)}
    return _rounded(f, ["id"], {k: F.get(F.col(f"f.c0.{w}"), F.lit(i)) for k, (w, i) in at.items()}, 5)


# -- metrics of the information geometries, descents

_WTR = "((xe*(ya-xa) - 2*xb*(yb-xb) + xa*(ye-xe))/dx)"
_WDET = "(((ya-xa)*(ye-xe) - pow(yb-xb, 2))/dx)"
#: Squared affine-invariant norm at x of the difference y - x.
_NORM_S = f"(pow({_WTR}, 2) - 2*{_WDET})"


def _gaussian_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms in the metric of Gaussians at the supplier of the least id of the others' differences from it."""
    lines, plain = _lines(spark, sf_dir), features.location_covariance_orth_triangle().bind(2, 1)
    m, s = plain.point(plain.estimate(lines, ["id"], ["q", "d"]).orderBy("id").limit(1).first()["f"])
    g = geo.GaussianIG(2)

    def norm(x: np.ndarray) -> np.ndarray:
        mu, sigma = estimators.gaussian(x)
        return np.array([g.norm((m, s), (mu - m, sigma - s))])

    f = features.user_defined("norms", norm, geo.Euclidean(1)).bind(2, 1).estimate(lines, ["id"], ["q", "d"])
    return f.select("id", F.round(F.get("f.c0", F.lit(0)), 5).alias("norm"))


query("information_norm", f"SELECT id, round(sqrt(2*(xe*u*u - 2*xb*u*v + xa*v*v)/dx + {_NORM_S}), 5) AS norm FROM ({_PAIRS2})")(_gaussian_norm)


@query(
    "compound_norms",
    f"""{_COMPOUND}, s AS (SELECT id, block, sum(1/tau) AS load, sum(pow((tau - 1)/tau, 2)) AS tt, sum((tau - 1)/tau) AS t1, sum(tau*tau/(1 + tau)) AS w, sum(pow((tau - 1)/(1 + tau), 2)) AS r FROM t GROUP BY 1, 2),
    y AS (SELECT g.*, s.* EXCLUDE (id, block), a*e - b*b AS z, 0.8*m0 - 0.6*m1 AS side FROM g JOIN s USING (id, block))
    SELECT id, block::INTEGER AS block, round(2*load*(e*m0*m0 - 2*b*m0*m1 + a*m1*m1)/z + {BLOCK}*(pow((a + e)/z, 2) - 2/z) + 2*(tt - t1*t1/{BLOCK}), 4) AS compound,
    round(r + 2*w*side*side, 4) AS subspace FROM y""",
)
def _compound_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norms in the metrics of compound Gaussians and of low-rank ones, of tangents that the block gives."""
    g, sub, u = geo.CompoundUnitTextures(2, BLOCK), geo.RobustSubspaceIG(BLOCK, 2, 1), np.array([[0.6], [0.8]])

    def norms(x: np.ndarray) -> np.ndarray:
        mu, sigma, tau = point = _own_compound(x)
        tangent = (mu, np.eye(2), g.parts[2].proj(tau, tau - 1))
        side = sub.parts[1].proj(u, mu[:, None])
        return np.array([g.inner(point, tangent, tangent), sub.inner((tau, u), (tau - 1, side), (tau - 1, side))])

    _, f = _blocks2(spark, sf_dir, "norms", norms, geo.Euclidean(2))
    return f.select("id", "block", *[F.round(F.get("f.c0", F.lit(i)), 4).alias(n) for i, n in enumerate(("compound", "subspace"))])


def _minimum(name: str, solver: str) -> None:
    @query(name, f"SELECT id, round(a, 4) AS s00, round(b, 4) + 0.0 AS s01, round(e, 4) AS s11 FROM ({_COV2})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Descent from the identity to the covariance nearest to the supplier's: its own."""
        g = geo.PositiveDefinite(2)

        def least(x: np.ndarray) -> np.ndarray:
            s = estimators.scm(x, assume_centered=False)
            return descend(g, lambda y: float(g.dist(y, s)) ** 2 / 2, lambda y: -g.log(y, s), np.eye(2), solver, 500, np.inf, 1e-9, 1e-14).point

        def every(xs: list[np.ndarray]) -> np.ndarray:
            s = np.stack([estimators.scm(x, assume_centered=False) for x in xs])
            return descend_many(g, lambda y, at: g.dist(y, s[at]) ** 2 / 2, lambda y, at: -g.log(y, s[at]), np.tile(np.eye(2), (len(s), 1, 1)), solver, 500, 1e-9, 1e-14)

        bound = features.user_defined(name, least, g, many=every).bind(2, 1)
        return _rounded(bound.estimate(_lines(spark, sf_dir), ["id"], ["q", "d"]), ["id"], _of("c0", _SYM), 4)


_minimum("steepest_descent", "steepest")
_minimum("conjugate_descent", "conjugate")


# -- Monte-Carlo errors of a sampler without chance, and principal coordinates

@query(
    "monte_carlo_errors",
    f"""WITH v AS (SELECT id, var_pop(q) AS a, covar_pop(q, d) AS b, var_pop(d) AS e FROM ({_LINES}) GROUP BY id),
    m AS (SELECT id, pow(ln(4.0), 2)*2 AS airm, 9*(a*a + 2*b*b + e*e) AS euclid FROM v)
    SELECT id, 0 AS component, round(airm + 0.5*euclid, 5) AS mse FROM m UNION ALL SELECT id, 1, round(airm, 5) FROM m UNION ALL SELECT id, 2, round(euclid, 5) FROM m""",
)
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that all draw a sample of four times a supplier's covariance, so the mean squared errors are known, part by part."""
    f = estimate.covariance(_lines(spark, sf_dir), ["id"], ["q", "d"], assume_centered=False)
    both = features.user_defined("product", lambda x: (estimators.scm(x),) * 2, [geo.PositiveDefinite(2), geo.Euclidean(2, 2)], (1, 0.5)).bind(2, 2)
    points = f.select("id", F.struct(F.col("f.c0").alias("c0"), F.col("f.c0").alias("c1")).alias("f"))
    errors = montecarlo.around(points, ["id"], both, lambda point, n, rng: 2 * np.sqrt(2) * np.linalg.cholesky(point[0]), 3, 2, seed=1)
    return errors.groupBy("id", "component").agg(F.round(F.avg(F.col("error") * F.col("error")), 5).alias("mse"))


@query(
    "pca_centred_raster",
    f"SELECT 0.0::DOUBLE AS mean, round((s + u)/2 + sqrt(pow((s - u)/2, 2) + t*t), 5) AS variance FROM (SELECT var_pop(a) AS s, covar_pop(a, b) AS t, var_pop(b) AS u FROM ({_SHIFTED}))",
)
def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal coordinates have mean 0, and the first eigenvalue as their variance."""
    p = images.pca(_raster(spark, sf_dir), ["a", "b"], 1)
    return p.agg((F.round(F.avg("pc0"), 8) + F.lit(0.0)).alias("mean"), F.round(F.var_pop("pc0"), 5).alias("variance"))

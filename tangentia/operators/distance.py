"""Distances and divergences as column expressions.

Euclidean and positive-vector distances work for any length; those of
covariances have closed forms for 2 x 2 matrices, which keep them in generated
code.  Larger matrices go through the Arrow kernels of
:mod:`tangentia.operators.features`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_euclidean(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def euclidean(x: Column, y: Column) -> Column:
    """Norm of the difference; for matrices the Frobenius distance."""
    return F.sqrt(squared_euclidean(x, y))


def positive(x: Column, y: Column) -> Column:
    """Distance of positive vectors: norm of the difference of logarithms."""
    return F.sqrt(
        F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(F.log(a) - F.log(b), 2)), F.lit(0.0), lambda s, v: s + v)
    )


class Sym2:
    """A symmetric 2 x 2 matrix of column expressions."""

    def __init__(self, a: Column, b: Column, d: Column):
        self.a, self.b, self.d = a, b, d

    @classmethod
    def of(cls, flat: Column) -> Sym2:
        return cls(F.get(flat, F.lit(0)), F.get(flat, F.lit(1)), F.get(flat, F.lit(3)))

    def det(self) -> Column:
        return self.a * self.d - self.b * self.b

    def trace_with_inverse_of(self, other: Sym2) -> Column:
        """trace(other^-1 self)."""
        return (other.d * self.a - 2 * other.b * self.b + other.a * self.d) / other.det()

    def quadratic_inverse(self, u: Column, v: Column) -> Column:
        """(u, v) self^-1 (u, v)."""
        return (self.d * u * u - 2 * self.b * u * v + self.a * v * v) / self.det()

    def plus_outer(self, u: Column, v: Column, half: float = 0.5) -> Sym2:
        return Sym2(self.a + half * u * u, self.b + half * u * v, self.d + half * v * v)

    def times(self, c: Column) -> Sym2:
        return Sym2(self.a * c, self.b * c, self.d * c)

    def mix(self, other: Sym2, alpha: float) -> Sym2:
        x, y = 1 - alpha, alpha
        return Sym2(x * self.a + y * other.a, x * self.b + y * other.b, x * self.d + y * other.d)


def log_spectrum_2x2(x: Sym2, y: Sym2) -> Column:
    """Sum of squared logarithms of the eigenvalues of y^-1 x."""
    half = x.trace_with_inverse_of(y) / 2
    det = x.det() / y.det()
    root = F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    large = half + root
    return F.pow(F.log(large), 2) + F.pow(F.log(det / large), 2)


def affine_invariant_2x2(x: Sym2, y: Sym2) -> Column:
    """Affine-invariant distance of two symmetric positive definite 2 x 2 matrices."""
    return F.sqrt(log_spectrum_2x2(x, y))


def kullback_leibler_2x2(x: Sym2, y: Sym2, dx: tuple[Column, Column] | None = None) -> Column:
    """sqrt of trace + Mahalanobis - p - log det, as circular complex Gaussians have it, plus 1e-12 under the root."""
    kl = x.trace_with_inverse_of(y) - 2 - F.log(x.det() / y.det())
    if dx is not None:
        kl = kl + y.quadratic_inverse(*dx)
    return F.sqrt(kl + F.lit(1e-12))


def alpha_2x2(x: Sym2, y: Sym2, alpha: float, dx: tuple[Column, Column] | None = None, real_case: bool = False) -> Column:
    """Alpha divergence of Gaussians; 0 and 1 are the two Kullback-Leibler divergences."""
    if alpha in (0, 1):
        kl = kullback_leibler_2x2(*((x, y) if alpha == 0 else (y, x)), dx)
        return F.sqrt(kl * kl / 2) if real_case else kl
    m = x.mix(y, alpha)
    integral = F.pow(x.det(), F.lit(1 - alpha)) * F.pow(y.det(), F.lit(alpha)) / m.det()
    if dx is not None:
        integral = integral * F.exp(-alpha * (1 - alpha) * m.quadratic_inverse(*dx))
    if real_case:
        integral = F.sqrt(integral)
    return F.sqrt(F.abs((1 - integral) / (alpha * (1 - alpha))))


def orthogonal_2x2(x: Sym2, y: Sym2, dx: tuple[Column, Column]) -> Column:
    """Divergence by an orthogonal projection of the first Gaussian."""
    t = F.lit(1.0) + x.quadratic_inverse(*dx)
    first = F.pow(F.log(t + F.sqrt(t * t - 1)), 2)
    return F.sqrt(first + log_spectrum_2x2(x.plus_outer(*dx), y))


def scaling_2x2(x: Sym2, y: Sym2, dx: tuple[Column, Column]) -> Column:
    """Divergence by a path that scales the first Gaussian's covariance to the second's determinant."""
    c = F.sqrt(y.det() / x.det())
    t = (c + 1 + x.quadratic_inverse(*dx) / 2) / (2 * F.sqrt(c))
    first = 4 * F.pow(F.log(t + F.sqrt(F.greatest(t * t - 1, F.lit(0.0)))), 2) + F.pow(F.log(c), 2)
    return F.sqrt(first + log_spectrum_2x2(x.times(c), y))


#: Most centres, in numbers, that are broadcast to the rows.
BROADCAST_NUMBERS = 4_000_000


def to_centres(
    rows: DataFrame, centres: DataFrame, distance: Callable[[Column, Column], Column], k_col: str = "k", f_col: str = "f"
) -> DataFrame:
    """Rows with ``d``, an array of structs (distance, k), one for each centre, ordered by k.

    The first argument of ``distance`` is the centre.  Centres are few by nature
    (one for each class); they travel as one array in one row, whose size is checked.
    """
    size = centres.count() * max(1, _width(centres, f_col))
    if size > BROADCAST_NUMBERS:
        raise ValueError(f"{size} numbers of centres are too many to broadcast; assign in blocks of centres")
    all_ = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(k_col).alias("k"), F.col(f_col).alias("m")))).alias("_m"))
    paired = rows.join(F.broadcast(all_))
    return paired.withColumn(
        "d", F.transform("_m", lambda m: F.struct(distance(m["m"], F.col(f_col)).alias("d"), m["k"].alias("k")))
    ).drop("_m")


def _width(df: DataFrame, f_col: str) -> int:
    kind = df.schema[f_col].dataType.typeName()
    size = F.size(f_col) if kind == "array" else F.size(F.col(f"{f_col}.c0"))
    return df.agg(F.max(size)).first()[0] or 0


def nearest(d: Column) -> Column:
    """Key of the nearest centre; of equals, the least key."""
    return F.array_min(d)["k"]


def probabilities(d: Column) -> Column:
    """Softmax of minus the distances, in the order of the centres."""
    least = F.array_min(d)["d"]
    e = F.transform(d, lambda x: F.exp(least - x["d"]))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)

"""Robust estimators of samples of any length: rounds of one aggregation, observations stay rows.

Tyler's scatter, location and scatter together, and the subspace of a signal in white noise are fixed points of
weighted second moments.  Each round sends every sample's state (its scatter's inverse, or its basis) to the
observations, which weigh themselves by an expression; partial sums of the moments come back, one row for each sample and
task.  However long a sample is, none of it is gathered, and samples that have settled leave the rounds.
Weights (textures) are rows too: :meth:`Fit.textures`.

Channels are columns, or pairs (re, im) of them.  Observations with a channel that is null or NaN take no part.  Textures are at least
``LEAST_TEXTURE``, so an observation at the centre has no direction and weighs nothing, unless a caller of :func:`tyler` asks for less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions.estimators import LEAST_TEXTURE
from tangentia.functions.matrix import hermitian_part, unit_det
from tangentia.operators.tables import with_state, written

Channel = str | tuple[str, str]


@dataclass(frozen=True)
class Channels:
    """Columns of the observations: p real ones, or p pairs (re, im)."""

    of: Sequence[Channel]

    @property
    def complex_valued(self) -> bool:
        return any(not isinstance(c, str) for c in self.of)

    @property
    def flat(self) -> list[str]:
        return [x for c in self.of for x in ((c,) if isinstance(c, str) else c)]

    def parts(self, mean: str | None = None) -> list[tuple[Column, Column]]:
        """(re, im) of every channel, less the entries of the state column ``mean``."""
        out = []
        for i, c in enumerate(self.of):
            re, im = (F.col(f"`{c}`"), F.lit(0.0)) if isinstance(c, str) else (F.col(f"`{x}`") for x in c)
            if mean:
                re = re - F.get(f"{mean}.re", F.lit(i))
                im = im - F.get(f"{mean}.im", F.lit(i)) if self.complex_valued else im
            out.append((re, im))
        return out

    def products(self, x: list[tuple[Column, Column]]) -> dict[str, Column]:
        """``x_i conj(x_j)`` for i <= j by name: ``_r_i_j`` and, of complex channels off the diagonal, ``_i_i_j``."""
        out = {}
        for i, (a, b) in enumerate(x):
            for j, (c, d) in enumerate(x[i:], i):
                out[f"_r_{i}_{j}"] = a * c + b * d if self.complex_valued else a * c
                if self.complex_valued and j > i:
                    out[f"_i_{i}_{j}"] = b * c - a * d
        return out

    def quadratic(self, x: list[tuple[Column, Column]], inverse: str) -> Column:
        """``x^H A x`` of the Hermitian state column ``inverse``."""
        p, total = len(x), None
        for name, v in self.products(x).items():
            kind, i, j = name[1], *map(int, name[3:].split("_"))
            # x^H A x = sum of |x_i|^2 A_ii + 2 Re(A_ij conj(x_i) x_j), and x_i conj(x_j) = r + i*im
            entry = F.get(f"{inverse}.{'re' if kind == 'r' else 'im'}", F.lit(i * p + j))
            term = entry * v * (1 if i == j else 2)
            total = term if total is None else total + term
        return total


#: Matrices and vectors of a state.
PAIR = "struct<re: array<double>, im: array<double>>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=float).ravel()))


def _pair(x: np.ndarray) -> pa.StructArray:
    flat = x.reshape(len(x), -1)
    return pa.StructArray.from_arrays([_lists(flat.real), _lists(flat.imag)], ["re", "im"])


def _array(column: pa.StructArray, *shape: int) -> np.ndarray:
    re, im = (column.field(k).flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape) for k in ("re", "im"))
    return re + 1j * im if im.any() else re


def _summed(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """Hermitian matrices from the sums of :meth:`Channels.products`."""
    out = np.zeros((len(batch), p, p), dtype=complex)
    for name in batch.schema.names:
        if name[:3] in ("_r_", "_i_"):
            i, j = map(int, name[3:].split("_"))
            out[:, i, j] += batch.column(name).to_numpy(zero_copy_only=False) * (1 if name[1] == "r" else 1j)
    out = out + np.conj(np.swapaxes(np.triu(out, 1), -1, -2))
    return out if out.imag.any() else out.real


def inverses(s: np.ndarray) -> np.ndarray:
    """Inverses of a batch; NaN for those that have none."""
    try:
        return np.linalg.inv(s)
    except np.linalg.LinAlgError:
        out = np.full_like(s, np.nan)
        for k, m in enumerate(s):
            try:
                out[k] = np.linalg.inv(m)
            except np.linalg.LinAlgError:
                pass
        return out


def _change(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, new.ndim))
    return np.sqrt((np.abs(new - old) ** 2).sum(axes)) / np.maximum(np.sqrt((np.abs(old) ** 2).sum(axes)), 1e-300)


@dataclass(frozen=True)
class Fit:
    """``states``: a written row ``(keys, n, rounds, ...)`` for each sample; ``of``: the observations."""

    of: DataFrame
    keys: list[str]
    channels: Channels
    states: DataFrame
    numbers: int
    texture: Callable[[Channels], Column] = field(repr=False)

    def textures(self, carry: Sequence[str] = ()) -> DataFrame:
        """``(keys, carry, tau)``: a row for each observation, in one pass and without a shuffle if the states are few."""
        rows = with_state(self.of, self.states, self.keys, self.numbers)
        return rows.select(*[f"`{k}`" for k in self.keys], *carry, self.texture(self.channels).alias("tau"))

    def features(self, parts: Sequence[str], order: Sequence[str], textures_at: int | None = None) -> DataFrame:
        """``(keys, n, f)`` with the state columns ``parts`` as c0, c1, ..., and the textures in order as part ``textures_at``.

        A point with textures is as long as its sample: where that is too long for a row, read :meth:`textures` instead.
        """
        plain = not self.channels.complex_valued
        cols = [F.col(f"{c}.re") if plain else F.col(c) for c in parts]
        out = self.states.select(*[f"`{k}`" for k in self.keys], "n", *[c.alias(f"_p{i}") for i, c in enumerate(cols)])
        cols = [F.col(f"_p{i}") for i in range(len(cols))]
        if textures_at is not None:
            listed = self.textures(order).groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(*order, "tau"))).alias("_t"))
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_own_{k}`")) for k in self.keys]
            out = out.join(listed.withColumnsRenamed({k: f"_own_{k}" for k in self.keys}), same).withColumn("_t", F.transform("_t", lambda x: x["tau"]))
            cols.insert(textures_at, F.col("_t"))
        return out.select(*[f"`{k}`" for k in self.keys], "n", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).alias("f"))


def _prepared(samples: DataFrame, keys: Sequence[str], channels: Sequence[Channel], carry: Sequence[str]) -> tuple[DataFrame, Channels]:
    ch = Channels(list(channels))
    own = [k for k in dict.fromkeys([*keys, *carry]) if k not in ch.flat]
    rows = samples.select(*[f"`{k}`" for k in own], *[F.col(f"`{c}`").cast("double").alias(c) for c in ch.flat])
    return rows.dropna(subset=ch.flat), ch


def _stated(sums: DataFrame, keys: Sequence[str], columns: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """States made from sums, a batch of samples at a time."""
    kept = [f for f in sums.schema.fields if f.name in keys]
    names = [c.split()[0] for c in columns.split(";")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *make(b)], [*[f.name for f in kept], *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return sums.mapInArrow(run, f"{own}, {columns.replace(';', ',')}")


def _rounds(
    rows: DataFrame, keys: list[str], state: DataFrame, sums: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame], DataFrame], max_iter: int, width: int
) -> tuple[DataFrame, int]:
    """States after rounds of ``sums`` of the weighed rows and ``step`` of sums and states, and how many numbers they are; a sample whose state is ``done`` takes no more part.

    The sums of a round are numbers only and meet their states once they are summed: a state among them would have Spark sort all rows.
    """
    state = written(state, "state")
    numbers = state.count() * width
    for _ in range(max_iter):
        going = state.where("not done")
        if not going.limit(1).count():
            break
        found = sums(with_state(rows, going, keys, numbers))
        state = written(step(with_state(found, going, keys, numbers, deal=1)).unionByName(state.where("done")), "state")
    return state, numbers


def tyler(
    samples: DataFrame,
    keys: Sequence[str],
    channels: Sequence[Channel],
    tol: float = 1e-4,
    max_iter: int = 100,
    normalize: str | None = "det",
    carry: Sequence[str] = (),
    least: float = LEAST_TEXTURE,
) -> Fit:
    """Tyler's M-estimator of every sample: states ``(keys, n, rounds, sigma, inv, scale, change, done)``.

    The rounds are those of the estimator of one matrix, so both agree up to the order of sums: from the sample covariance, until the relative
    change is at most ``tol`` or after ``max_iter`` rounds; the textures belong to the scatter of the round before the last.
    A sample whose scatter has no inverse (fewer directions than channels) ends with NaN, and so does one with an observation
    at the centre if textures may be 0 (``least``).
    """
    keys = list(keys)
    rows, ch = _prepared(samples, keys, channels, carry)
    p = len(ch.of)
    x = ch.parts()
    sums = [F.sum(v).alias(k) for k, v in ch.products(x).items()]
    fields = f"n long; rounds int; sigma {PAIR}; inv {PAIR}; scale double; change double; done boolean"

    def state(b: pa.RecordBatch, old: np.ndarray | None, inv: np.ndarray | None) -> list[pa.Array]:
        n = b.column("n").to_numpy(zero_copy_only=False)
        new = _summed(b, p) / n[:, None, None]
        rounds = np.zeros(len(b), dtype=np.int32) if old is None else b.column("_s").field("rounds").to_numpy(zero_copy_only=False) + 1
        if old is None:
            new = new * (p / np.real(np.trace(new, axis1=-2, axis2=-1)))[:, None, None]
            change, done = np.full(len(b), np.inf), np.zeros(len(b), dtype=bool)
        else:
            new = hermitian_part(new)
            change = _change(new, old)
            done = ~(change > tol) | (rounds >= max_iter)
        scaled, scale = new, np.ones(len(b))
        if normalize and done.any():
            scale = unit_det(new)[1] if normalize == "det" else np.real(np.trace(new, axis1=-2, axis2=-1)) / p
            scale = np.where(done, scale, 1.0)
            scaled = new / scale[:, None, None]
        # textures of a settled sample are those of the round that settled it
        now = inverses(new)
        used = now if inv is None else np.where(done[:, None, None], inv, now)
        return [b.column("n"), pa.array(rounds.astype(np.int32)), _pair(scaled), _pair(used), pa.array(scale), pa.array(change), pa.array(done)]

    def first(b: pa.RecordBatch) -> list[pa.Array]:
        return state(b, None, None)

    def later(b: pa.RecordBatch) -> list[pa.Array]:
        return state(b, _array(b.column("_s").field("sigma"), p, p), _array(b.column("_s").field("inv"), p, p))

    def tau(c: Channels) -> Column:
        return F.greatest(c.quadratic(c.parts(), "_s.inv") / p, F.lit(float(least)))

    def sums_of(joined: DataFrame) -> DataFrame:
        weighed = joined.withColumn("_tau", tau(ch)).withColumn("_tau", F.when(F.col("_tau") > 0, F.col("_tau")).otherwise(F.lit(float("nan"))))
        return weighed.groupBy(*keys).agg(
            *[F.sum(v / F.col("_tau")).alias(k) for k, v in ch.products(x).items()],
            F.count("*").alias("n"),
        )

    def step(found: DataFrame) -> DataFrame:
        return _stated(found, keys, fields, later)

    start = _stated(rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums), keys, fields, first)
    states, numbers = _rounds(rows, keys, start, sums_of, step, max_iter, 4 * p * p)
    return Fit(rows, keys, ch, states, numbers, lambda c: tau(c) * F.col("_s.scale"))


def location_scatter(
    samples: DataFrame, keys: Sequence[str], channels: Sequence[Channel], tol: float = 1e-3, max_iter: int = 100, carry: Sequence[str] = ()
) -> Fit:
    """Tyler's location and scatter (determinant 1) together: states ``(keys, n, rounds, mu, sigma, inv, scale, change, done)``.

    A round needs one pass: the weights by which a scatter is summed are those of the next location, which is summed beside it.
    """
    keys = list(keys)
    rows, ch = _prepared(samples, keys, channels, carry)
    p = len(ch.of)
    fields = f"n long; rounds int; mu {PAIR}; next {PAIR}; sigma {PAIR}; inv {PAIR}; scale double; change double; done boolean"
    re_im = ("re", "im") if ch.complex_valued else ("re",)

    def located(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(b), p), dtype=complex)
        for i in range(p):
            for k, unit in zip(re_im, (1, 1j), strict=False):
                out[:, i] += b.column(f"_m{k}{i}").to_numpy(zero_copy_only=False) * unit
        out = out / b.column("_w").to_numpy(zero_copy_only=False)[:, None]
        return out if out.imag.any() else out.real

    def start(b: pa.RecordBatch) -> list[pa.Array]:
        """Mean and covariance about it; ``next`` is the mean still."""
        mu = located(b)
        sigma = _summed(b, p) / b.column("n").to_numpy(zero_copy_only=False)[:, None, None]
        sigma = hermitian_part(sigma - mu[:, :, None] * np.conj(mu)[:, None, :])
        nothing = pa.array(np.zeros(len(b)))
        return [b.column("n"), pa.array(np.full(len(b), -1, dtype=np.int32)), _pair(mu), _pair(mu), _pair(sigma), _pair(inverses(sigma)), nothing, nothing, pa.array(np.zeros(len(b), dtype=bool))]

    def later(b: pa.RecordBatch) -> list[pa.Array]:
        rounds = b.column("_s").field("rounds").to_numpy(zero_copy_only=False) + 1
        old_mu, mu, old = _array(b.column("_s").field("mu"), p), _array(b.column("_s").field("next"), p), _array(b.column("_s").field("sigma"), p, p)
        new = hermitian_part(_summed(b, p) / b.column("n").to_numpy(zero_copy_only=False)[:, None, None])
        begun = rounds > 0  # the first pass only finds weights for the first location
        new = np.where(begun[:, None, None], new, old)
        change = np.maximum(_change(mu, old_mu), _change(new, old))
        done = begun & (~(change > tol) | (rounds >= max_iter)) | (~begun & (max_iter <= 0))
        inv = inverses(new)
        scaled, scale = unit_det(new) if done.any() else (new, np.ones(len(b)))
        scaled = np.where(done[:, None, None], scaled, new)
        return [b.column("n"), pa.array(rounds.astype(np.int32)), _pair(mu), _pair(located(b)), _pair(scaled), _pair(inv), pa.array(np.where(done, scale, 1.0)), pa.array(change), pa.array(done)]

    def tau(c: Channels, mean: str) -> Column:
        return F.greatest(c.quadratic(c.parts(mean), "_s.inv") / p, F.lit(LEAST_TEXTURE))

    def means(w: Column) -> list[Column]:
        cols = [F.sum(v * w).alias(f"_m{k}{i}") for i, x in enumerate(ch.parts()) for k, v in zip(re_im, x, strict=False)]
        return [*cols, F.sum(w).alias("_w")]

    def sums_of(joined: DataFrame) -> DataFrame:
        weighed = joined.withColumn("_tau", tau(ch, "_s.next"))
        return weighed.groupBy(*keys).agg(
            *[F.sum(v / F.col("_tau")).alias(k) for k, v in ch.products(ch.parts("_s.next")).items()], *means(1 / F.sqrt("_tau")),
            F.count("*").alias("n"),
        )

    def step(found: DataFrame) -> DataFrame:
        return _stated(found, keys, fields, later)

    moments = [F.sum(v).alias(k) for k, v in ch.products(ch.parts()).items()]
    begin = _stated(rows.groupBy(*keys).agg(F.count("*").alias("n"), *moments, *means(F.lit(1.0))), keys, fields, start)
    states, numbers = _rounds(rows, keys, begin, sums_of, step, max_iter + 1, 4 * p * p + 4 * p)
    return Fit(rows, keys, ch, states, numbers, lambda c: tau(c, "_s.mu") * F.col("_s.scale"))

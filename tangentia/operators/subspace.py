"""Principal subspaces of samples of any length and of very many channels: no p x p matrix, no gathered sample.

Observations are rows with a vector.  A sample's state is an orthonormal basis of a few columns more than the subspace
asked for; a round multiplies it by the sample's (weighted) second moments without forming them: each task sums
``w x (x^H U)`` over its observations, tall blocks of p rows, which are added by row.  That is block subspace
iteration from a random start, a randomised range finder whose passes go on until the subspace rests.

Weights are 1, or those of a signal of unknown power in white noise, x_i ~ N(0, tau_i U U^H + I): then w_i =
tau_i / (1 + tau_i) with the textures tau_i = |U^H x_i|^2 / k - 1 that are best for U.  So textures need no table of their
own: they are a function of the row and the basis, by rounds over all rows or by steps over batches (:func:`descend`).

States go out by broadcast, the samples in blocks of so many that their bases are few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions.estimators import LEAST_TEXTURE
from tangentia.functions.matrix import herm
from tangentia.operators.tables import BROADCAST_NUMBERS, written

#: Columns of a basis beyond those asked for.
OVERSAMPLE = 8


def vector_of(channels: Sequence) -> Column:
    """Channels, or pairs (re, im) of them, as one vector column."""
    if all(isinstance(c, str) for c in channels):
        return F.array(*[F.col(f"`{c}`").cast("double") for c in channels])
    return F.struct(*[F.array(*[F.col(f"`{c[i]}`").cast("double") for c in channels]).alias(n) for i, n in enumerate(("re", "im"))])


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a batch's vectors, complex where they are structs (re, im)."""
    if pa.types.is_struct(column.type):
        return _vectors(column.field("re")) + 1j * _vectors(column.field("im"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class _Block:
    """Bases of some samples, by their keys' position."""

    keys: list[tuple]
    u: np.ndarray  # (samples, p, l)
    n: np.ndarray
    energy: np.ndarray  # sums of squares
    mean: np.ndarray | None = None
    noise: np.ndarray | None = None  # variances that the observations are divided by
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))  # samples whose subspace has come to rest
    rounds: int = 0
    values: np.ndarray | None = None  # eigenvalues of the basis


@dataclass(frozen=True)
class Subspaces:
    """``bases``: a written row ``(keys, n, rounds, noise, basis)`` for each sample, the basis p x k row-major as ``struct<re, im>``."""

    of: DataFrame
    keys: list[str]
    bases: DataFrame
    k: int

    def textures(self, carry: Sequence[str] = ()) -> DataFrame:
        """``(keys, carry, tau)``: a row for each observation; samples are taken in blocks of few numbers."""
        return _textures(self, list(carry))

    def features(self, order: Sequence[str] = (), complex_valued: bool = False, textured: bool = False) -> DataFrame:
        """``(keys, n, f)`` with the basis as the last part, after the textures in order if asked for."""
        basis = F.col("basis") if complex_valued else F.col("basis.re")
        if not textured:
            return self.bases.select(*[f"`{k}`" for k in self.keys], "n", F.struct(basis.alias("c0")).alias("f"))
        listed = self.textures(order).groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(*order, "tau"))).alias("_t"))
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_own_{k}`")) for k in self.keys]
        out = self.bases.join(listed.withColumnsRenamed({k: f"_own_{k}" for k in self.keys}), same)
        return out.select(*[f"`{k}`" for k in self.keys], "n", F.struct(F.transform("_t", lambda x: x["tau"]).alias("c0"), basis.alias("c1")).alias("f"))


def _prepared(samples: DataFrame, keys: Sequence[str], vector: Column, carry: Sequence[str]) -> DataFrame:
    """Rows ``(keys, carry, _x)``; vectors that are null or have a null or NaN are dropped."""
    own = list(dict.fromkeys([*keys, *carry]))
    rows = samples.select(*[f"`{c}`" for c in own], vector.alias("_x")).where("_x is not null")
    parts = ["_x.re", "_x.im"] if rows.schema["_x"].dataType.typeName() == "struct" else ["_x"]
    whole = [F.forall(F.col(p), lambda v: v.isNotNull() & ~F.isnan(v)) for p in parts]
    for w in whole:
        rows = rows.where(w)
    return rows


def _width(rows: DataFrame) -> tuple[int, bool]:
    """Length of the vectors, which must be one, and whether they are complex."""
    cplx = rows.schema["_x"].dataType.typeName() == "struct"
    sizes = rows.select(F.size("_x.re" if cplx else "_x").alias("s")).agg(F.min("s"), F.max("s")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have from {sizes[0]} to {sizes[1]} components")
    return sizes[0] or 0, cplx


def _key(rows: DataFrame, keys: Sequence[str]) -> Column:
    """A key as text, nulls apart from every value."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("-")) for k in keys]))


def _sums(rows: DataFrame, index: dict[str, int], u: np.ndarray, by: np.ndarray | None, noise: np.ndarray | None, first: bool) -> tuple[np.ndarray, ...]:
    """Sums over each sample's rows: of ``w x (x^H u)``, of x (if ``first``), and (n, squares, weights' curvature) of each sample.

    ``by`` is the basis that the weights follow, None for weights 1.  Rows of samples that aren't in ``index`` are passed over.
    """
    cplx = np.iscomplexobj(u)
    k, p, l = u.shape
    numbers = ("_n", "_squares", "_curve")
    names = [f"{c}{j}" for j in range(l + first) for c in (("re", "im") if cplx else ("re",))]
    sent = rows.sparkSession.sparkContext.broadcast((index, u, by, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, u, by, noise = sent.value
        y, told, seen = np.zeros((k, p, l + first), dtype=u.dtype), np.zeros((k, 3)), set()
        for b in batches:
            names_ = b.column("_key").dictionary_encode()
            at = np.array([index.get(v, -1) for v in names_.dictionary.to_pylist()], dtype=np.int64)[names_.indices.to_numpy(zero_copy_only=False)]
            x = _vectors(b.column("_x"))
            for g in np.unique(at[at >= 0]):
                own = x[at == g]
                if noise is not None:
                    own = own / np.sqrt(noise[g])
                weighed = own
                if by is not None:
                    tau = np.maximum((np.abs(np.conj(own) @ by[g]) ** 2).sum(1) / by.shape[2] - 1, LEAST_TEXTURE)
                    weighed = own * (tau / (1 + tau))[:, None]
                    told[g, 2] += (tau**2 / (1 + tau)).sum()
                y[g, :, :l] += weighed.T @ (np.conj(own) @ u[g])
                if first:
                    y[g, :, l] += own.sum(0)
                told[g, :2] += len(own), (np.abs(own) ** 2).sum()
                seen.add(int(g))
        for g in seen:  # a sample at a time: p rows, and one of its numbers
            flat = np.zeros((p + 1, len(names) + 3))
            flat[0, -3:] = told[g]
            flat[1:, :-3] = y[g].view(np.float64).reshape(p, -1) if cplx else y[g]
            columns = [pa.array(np.full(p + 1, g)), pa.array(np.arange(-1, p)), *[pa.array(np.ascontiguousarray(c)) for c in flat.T]]
            yield pa.RecordBatch.from_arrays(columns, ["g", "i", *names, *numbers])

    fields = ", ".join(["g long", "i long", *[f"{n} double" for n in (*names, *numbers)]])
    every = rows.select("_key", "_x").mapInArrow(run, fields).groupBy("g", "i").agg(*[F.sum(n).alias(n) for n in (*names, *numbers)])
    found = every.toArrow()  # as many numbers as the bases have
    sent.destroy()
    y, told = np.zeros((k, p, l + first), dtype=u.dtype), np.zeros((k, 3))
    if found.num_rows:
        g, i = (found.column(c).to_numpy() for c in ("g", "i"))
        flat = np.column_stack([found.column(n).to_numpy() for n in names])
        told[g[i < 0]] = np.column_stack([found.column(n).to_numpy() for n in numbers])[i < 0]
        body = np.ascontiguousarray(flat[i >= 0])
        y[g[i >= 0], i[i >= 0]] = body.view(np.complex128) if cplx else body
    return y[:, :, :l], y[:, :, l] if first else None, told


def _moved(y: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next basis from ``y = S u``, its columns by falling eigenvalue, and those eigenvalues.  Of a basis of the whole space, the eigenvectors themselves."""
    values, turn = np.linalg.eigh((herm(u) @ y + herm(herm(u) @ y)) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    if u.shape[0] == u.shape[1]:
        return u @ turn, values
    return np.linalg.qr(y @ turn)[0], values


def _blocks(rows: DataFrame, keys: list[str], numbers: int) -> Iterator[tuple[DataFrame, list]]:
    """The samples in blocks whose bases are about ``BROADCAST_NUMBERS`` numbers: rows of a block, and its samples' keys."""
    every = written(rows.groupBy("_key").agg(F.count("*").alias("n"), *[F.first(f"`{k}`").alias(k) for k in keys]), "samples")
    count = max(1, -(-every.count() * numbers // BROADCAST_NUMBERS))
    of = F.pmod(F.xxhash64("_key"), F.lit(count))
    for b in range(count):
        found = every.where(of == b).collect()
        if found:
            yield (rows.where(of == b) if count > 1 else rows), found


def _start(p: int, l: int, cplx: bool, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(p, l)) + (1j * rng.normal(size=(p, l)) if cplx else 0)
    return np.linalg.qr(x)[0]


def _change(u: np.ndarray, v: np.ndarray, k: int) -> float:
    """Norm of the difference of the projectors on the first k columns."""
    gap = u[:, :k] - v[:, :k] @ (herm(v[:, :k]) @ u[:, :k])
    return float(np.sqrt(2) * np.linalg.norm(gap))


def _result(rows: DataFrame, keys: list[str], found: list[tuple], k: int, cplx: bool) -> Subspaces:
    """``found``: (a sample's row, n, rounds, noise, basis)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "n long", "rounds int", "noise double", "basis struct<re: array<double>, im: array<double>>"])
    spark = rows.sparkSession
    parts = [
        spark.createDataFrame(
            [(*[r[c] for c in keys], int(n), int(m), float(s), (u[:, :k].real.ravel().tolist(), u[:, :k].imag.ravel().tolist())) for r, n, m, s, u in block], schema
        )
        for block in found
    ]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionAll(part)
    return Subspaces(rows, keys, written(out, "bases"), k)


def top_subspace(
    samples: DataFrame,
    keys: Sequence[str],
    vector: Column,
    k: int,
    assume_centered: bool = True,
    weighted: bool = False,
    estimate_sigma: bool = False,
    tol: float = 1e-9,
    max_iter: int = 200,
    oversample: int = OVERSAMPLE,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> Subspaces:
    """The subspace of the ``k`` largest eigenvalues of every sample's covariance; ``weighted``, that of a signal of unknown power in white noise.

    A round is one pass; a sample rests once its projector changes by at most ``tol``, or after ``max_iter`` rounds.  Weighted, the first rounds find the unweighted
    subspace, from which as many weighted ones start.  ``estimate_sigma`` divides by the noise's variance, the mean of all eigenvalues but the k largest, which
    follows from the trace.  Vectors that are null or hold a null or NaN take no part; all must be of one length.  With as many columns as
    channels, a round is exact.
    """
    keys = list(keys)
    rows = _prepared(samples, keys, vector, carry)
    rows = rows.withColumn("_key", _key(rows, keys))
    p, cplx = _width(rows)
    if not p:
        return _result(rows.drop("_key"), keys, [], k, cplx)
    if not 0 < k <= p:
        raise ValueError("k is at least 1 and at most the number of channels")
    l, out = min(p, k + oversample), []
    for own, found in _blocks(rows, keys, p * l * (2 if cplx else 1)):
        b = _iterate(own, found, k, l, p, cplx, seed, assume_centered, None, tol, max_iter)
        if estimate_sigma:
            # of fewer observations than channels, the other eigenvalues are 0 and don't count
            others = np.maximum(np.minimum(p, b.n) - k, 1)
            b.noise = np.maximum((b.energy / b.n - b.values[:, :k].sum(1)) / others, 1e-300)
        if weighted:
            b = _iterate(own, found, k, l, p, cplx, seed, True, b, tol, max_iter)
        noise = np.ones(len(found)) if b.noise is None else b.noise
        out.append([(r, b.n[g], b.rounds, noise[g], b.u[g]) for g, r in enumerate(found)])
    return _result(rows, keys, out, k, cplx)


def _iterate(rows, found, k, l, p, cplx, seed, assume_centered, before: _Block | None, tol: float, max_iter: int) -> _Block:
    """Rounds until every sample rests; from ``before`` on, weighted."""
    index = {r["_key"]: g for g, r in enumerate(found)}
    u = np.stack([_start(p, l, cplx, seed)] * len(found)) if before is None else before.u
    b = _Block([r["_key"] for r in found], u, np.zeros(len(found)), np.zeros(len(found)), noise=None if before is None else before.noise)
    b.rest, b.values = np.zeros(len(found), dtype=bool), np.zeros((len(found), l))
    for b.rounds in range(1, max_iter + 1):
        going = np.flatnonzero(~b.rest)
        part = {name: j for j, name in enumerate(b.keys[g] for g in going)}
        first = b.rounds == 1
        y, mean, told = _sums(rows, part, b.u[going], None if before is None else b.u[going][:, :, :k], None if b.noise is None else b.noise[going], first)
        if first:
            b.n, b.energy = told[:, 0], told[:, 1]
            b.mean = None if assume_centered else mean / b.n[:, None]
            if b.mean is not None:
                b.energy = b.energy - b.n * (np.abs(b.mean) ** 2).sum(1)
        for j, g in enumerate(going):
            s = y[j] / b.n[g]
            if b.mean is not None:
                s = s - b.mean[g][:, None] * (np.conj(b.mean[g]) @ b.u[g])
            new, b.values[g] = _moved(s, b.u[g])
            exact = l == p and before is None
            b.rest[g] = exact or _change(new, b.u[g], k) <= tol
            b.u[g] = new
        if b.rest.all():
            break
    return b


def descend(
    samples: DataFrame,
    keys: Sequence[str],
    vector: Column,
    k: int,
    order: Sequence[str],
    batches: int = 10,
    epochs: int = 5,
    rate: float = 1.0,
    decay: float = 0.05,
    estimate_sigma: bool = False,
    seed: int = 0,
) -> Subspaces:
    """The weighted subspace by stochastic natural-gradient steps over batches of the observations.

    Rows are dealt to ``batches`` by a hash of ``order`` and the key, so every observation is in one batch of an epoch however
    the table is partitioned, and reruns agree; the batches are written once, and a step reads its own only.  A step moves the basis along the
    batch's gradient, divided by its information (the sum of tau^2 / (1 + tau)), by ``rate / (1 + decay * step)``, and back onto the
    manifold by a QR.  A sample without a row in a batch stays where it is.  Nulls and lengths are as in :func:`top_subspace`.
    """
    keys, order = list(keys), list(order)
    rows = _prepared(samples, keys, vector, order)
    rows = rows.withColumn("_key", _key(rows, keys))
    p, cplx = _width(rows)
    if not p:
        return _result(rows.drop("_key"), keys, [], k, cplx)
    rows = written(rows.withColumn("_batch", F.pmod(F.xxhash64("_key", *order, F.lit(seed)), F.lit(batches)).cast("int")).repartition("_batch").sortWithinPartitions("_batch"), "batches")
    out = []
    for own, found in _blocks(rows, keys, p * k * (2 if cplx else 1)):
        index = {r["_key"]: g for g, r in enumerate(found)}
        b = _iterate(own, found, k, min(p, k + OVERSAMPLE), p, cplx, seed, True, None, 1.0, 2) if estimate_sigma else None
        noise = None if b is None else np.maximum((b.energy / b.n - b.values[:, :k].sum(1)) / np.maximum(np.minimum(p, b.n) - k, 1), 1e-300)
        u, step = np.stack([_start(p, k, cplx, seed)] * len(found)), 0
        for _ in range(epochs):
            for batch in range(batches):
                g, _, told = _sums(own.where(F.col("_batch") == batch), index, u, u, noise, False)
                move = (g - u @ (herm(u) @ g)) / np.maximum(told[:, 2], 1e-300)[:, None, None]
                u = np.linalg.qr(u + rate / (1 + decay * step) * np.where(told[:, :1, None] > 0, move, 0))[0]
                step += 1
        out.append([(r, r["n"], epochs, 1.0 if noise is None else noise[g], u[g]) for g, r in enumerate(found)])
    return _result(rows, keys, out, k, cplx)


def _textures(s: Subspaces, carry: list[str]) -> DataFrame:
    """Textures of all observations under their sample's basis, a block of samples after the other."""
    rows = s.of if "_key" in s.of.columns else s.of.withColumn("_key", _key(s.of, s.keys))
    bases = s.bases.withColumn("_key", _key(s.bases, s.keys))
    numbers = (bases.select(F.max(F.size("basis.re"))).first()[0] or 0) * 2
    own = list(dict.fromkeys([*s.keys, *carry]))
    fields = [f for f in rows.schema.fields if f.name in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tau double"
    out, k = None, s.k
    for part, found in _blocks(rows, s.keys, numbers):
        mine = {r["_key"]: r for r in bases.where(F.col("_key").isin([r["_key"] for r in found])).collect()}
        table = {
            key: ((np.array(r["basis"]["re"]) + 1j * np.array(r["basis"]["im"])).reshape(-1, k) if any(r["basis"]["im"]) else np.array(r["basis"]["re"]).reshape(-1, k), r["noise"])
            for key, r in mine.items()
        }
        sent = rows.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column("_key").dictionary_encode()
                at = names.indices.to_numpy(zero_copy_only=False)
                x, tau = _vectors(b.column("_x")), np.full(b.num_rows, np.nan)
                for g, name in enumerate(names.dictionary.to_pylist()):
                    u, noise = sent.value[name]
                    v = x[at == g]
                    tau[at == g] = noise * np.maximum((np.abs(np.conj(v) @ u) ** 2).sum(1) / noise / k - 1, LEAST_TEXTURE)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(tau)], [*[f.name for f in fields], "tau"])

        one = part.select("_key", "_x", *[f"`{f.name}`" for f in fields]).mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out

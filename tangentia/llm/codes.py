"""Codes of vectors: every part of a vector is replaced by the number of the nearest entry of a codebook.

The nearest entry is found as in a vector-approximation file.  Entries' coordinates are quantised to a
few bits, so an entry is a list of cells.  A part looks up, for each coordinate, how near and how far
a point of each cell can be; sums over an entry's cells bound its squared distance from both sides, and only entries whose
lower bound is no more than the least upper bound are measured, in integers.

Codebooks are a few numbers (entries times components) and go to the tasks; counts and sums come back
from them.  Rows stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm import vectors
from tangentia.llm.common import HUBS, join_one, written
from tangentia.llm.vectors import column, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a quantised coordinate.
BITS = 4
#: Rows of a part that are compared at a time.
ROWS = 4_096
#: Rows of a label from which its sum is broadcast.
OFTEN = 10_000


@dataclass(frozen=True)
class Cells:
    """Approximation of one part's entries: the cell of each coordinate, and between which numbers the entries of a cell lie."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        least, most = entries.min(0), entries.max(0)
        cell = (entries - least) * (1 << bits) // (most - least + 1)
        low = np.full(((1 << bits), entries.shape[1]), most, dtype=np.int64)
        high = np.full_like(low, 0) + least
        for j in range(entries.shape[1]):
            np.minimum.at(low[:, j], cell[:, j], entries[:, j])
            np.maximum.at(high[:, j], cell[:, j], entries[:, j])
        return cls(entries, cell, low, high)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of rows to all entries."""
        lower = np.zeros((len(x), len(self.entries)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            below, above = self.low[:, j] - x[:, j : j + 1], x[:, j : j + 1] - self.high[:, j]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry (the first of equals), its squared distance, and how many were measured in all."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        gap = x[row] - self.entries[entry]
        d = (gap * gap).sum(1)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, first) if len(x) else d
        at = np.flatnonzero(d == least[row])
        at = at[np.diff(row[at], prepend=-1) > 0]
        return entry[at], least, len(row)


def _assigned(x: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (rows, parts) of the nearest entries, and squared distances summed over the parts."""
    size = x.shape[1] // len(cells)
    codes, error = np.zeros((len(x), len(cells)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), ROWS):
        for s, c in enumerate(cells):
            codes[at : at + ROWS, s], d, _ = c.nearest(x[at : at + ROWS, s * size : (s + 1) * size])
            error[at : at + ROWS] += d
    return codes, error


def _first_entries(rows: DataFrame, scale: int, width: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) of the rows with the smallest ids."""
    first = rows.where(vectors.finite("v_")).orderBy(F.col("vec_id").asc_nulls_last(), "v_").limit(entries)
    first = first.select("v_").toArrow()
    if not first.num_rows:
        return np.zeros((parts, 0, width // parts), dtype=np.int64)
    _, x = matrix(column(first, "v_"), scale, width)
    return x.astype(np.int64).reshape(len(x), parts, -1).transpose(1, 0, 2)


def _moved(rows: DataFrame, codebooks: np.ndarray, scale: int, width: int) -> np.ndarray:
    """Codebooks whose entries are the floors of the means of their parts; entries without parts stay."""
    parts, entries, size = codebooks.shape
    cells = [Cells.of(c) for c in codebooks]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, size), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            x = matrix(b.column("v_"), scale, width)[1].astype(np.int64)
            codes, _ = _assigned(x, cells)
            for s in range(parts):
                np.add.at(total[s], codes[:, s], x[:, s * size : (s + 1) * size])
                n[s] += np.bincount(codes[:, s], minlength=entries)
        at = np.flatnonzero(np.repeat(n.ravel(), size))
        columns = [at, total.ravel()[at], np.repeat(n.ravel(), size)[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "total", "n"])

    wide = "decimal(38,0)"
    found = rows.select("v_").mapInArrow(sums, "at long, total long, n long").groupBy("at")
    out = codebooks.copy().ravel()
    for r in found.agg(F.sum(F.col("total").cast(wide)).alias("total"), F.sum(F.col("n").cast(wide)).alias("n")).collect():
        out[r["at"]] = int(r["total"]) // int(r["n"])
    return out.reshape(codebooks.shape)


@dataclass(frozen=True)
class Compressed:
    """``rows``: (vec_id, label, code, error), written; ``codebooks``: (parts, entries, components of a part)."""

    rows: DataFrame
    codebooks: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors_: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> Compressed:
    """Codebooks of the parts of vectors, and every vector's code under them with the error it makes.

    Components become floor(scale * x).  A part's codebook starts as that part of the ``entries`` rows of smallest ids (null
    ids last, rows that repeat an id by their components) and is moved ``rounds`` times.  Vectors that are null or
    have a null or non-finite component are dropped; shorter ones are padded with 0, as are all if their length is no
    multiple of ``parts``.  Fewer rows than ``entries`` give fewer entries.  Rows that repeat an id, or have none, each have a code.
    Integers saturate where distances could leave 64 bits (:func:`vectors.matrix`).  An empty table gives no rows and empty codebooks.
    """
    rows = vectors_.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v_")).where("v_ is not null")
    width = -(-vectors.extent(rows, "v_")[0] // parts) * parts
    codebooks = _first_entries(rows, scale, width, parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = _moved(rows, codebooks, scale, width)
    cells = [Cells.of(c) for c in codebooks] if codebooks.size else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, x = matrix(b.column("v_"), scale, width)
            if len(x):
                codes, error = _assigned(x.astype(np.int64), cells)
                text = codes.astype(np.uint8).tobytes().hex()
                code = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                own = b.filter(pa.array(taken))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return Compressed(written(coded, "codes"), codebooks)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``: the errors of all rows of an equal label, nulls together, summed (at most the largest long).

    Labels of very many rows are joined by broadcast, of which there are few; so no label's rows meet in one task.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    rows = rows.withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id())
    sums = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    sums = written(sums, "labels")
    most = max(OFTEN, (sums.agg(F.sum("_n")).first()[0] or 0) // HUBS)
    return join_one(rows, sums, ["_key"], "_n", most, "_row").drop("_key", "_row")

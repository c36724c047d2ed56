"""Embedding whitening: principal components by matrix-free block Lanczos over distributed passes.

The covariance matrix is never formed. A pass multiplies it by a block of vectors: every task centres its rows and adds up
Xᵀ(XQ), the tasks' sums are added by cell. The driver holds the basis, which is at most dimension x dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, release

SCALE, BASE = 64, 1_000_000  # an entry c becomes floor(SCALE * c) + BASE
LIMIT = 1 << 52  # entries are held within +-LIMIT, where doubles are exact
COMPONENTS = 16
BLOCK = 20  # vectors of a pass: some more than the components, so that equal eigenvalues are all found
TOLERANCE = 1e-13  # of a component's residual, as a share of the largest eigenvalue
LEAST = 1e-10  # eigenvalues below this share of the largest are rounding
SEED = 11


def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(SCALE * c) of their vectors as int64) for the vectors of each length without null or non-finite
    entries; null and empty vectors have none."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat, starts = column.flatten(), np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    for size in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == size)
        m = values[starts[places][:, None] + np.arange(size)]
        good = np.isfinite(m).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                yield places[good], np.clip(np.floor(SCALE * m[good]), -LIMIT, LIMIT).astype(np.int64)


def _packed(m: np.ndarray) -> list[bytes]:
    """A vector as bytes, alike for equal vectors: 16-bit entries if all fit, else 64-bit ones, behind a mark."""
    small = (np.abs(m) < 1 << 15).all(axis=1)
    return [b"\0" + row.astype("<i2").tobytes() if s else b"\1" + row.astype("<i8").tobytes() for row, s in zip(m, small)]


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(r, "<i2" if r[0] == 0 else "<i8", offset=1) for r in rows], np.int64)


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """(size, x) of each distinct vector, written once: rows are equal as integers, so they combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in entries(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]] * len(m), pa.int32()), pa.array(_packed(m), pa.binary())], names=["size", "x"])

    return cut(in_arrow(vectors.select(column), run, "size int, x binary").distinct())


class Mean(NamedTuple):
    """n vectors with their exact sums a dimension (of the entries without BASE)."""

    n: int
    sums: list[int]

    def deviations(self, m: np.ndarray) -> np.ndarray:
        """n * x - S for each entry, exact; as Python's integers where 64 bits might not do."""
        most = max(int(np.abs(m).max(initial=0)), 1)
        if 2 * self.n * most < 1 << 62:
            return self.n * m - np.array(self.sums, np.int64)
        return self.n * m.astype(object) - np.array(self.sums, object)

    def centred(self, m: np.ndarray) -> np.ndarray:
        """x - S / n as doubles, rounded once."""
        return (self.deviations(m) / self.n).astype(np.float64)


def square_sums(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null where a long can't hold it."""
    if d.dtype != object and d.shape[1] * max(int(np.abs(d).max(initial=0)), 1) ** 2 < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [x if x < 1 << 63 else None for x in (d.astype(object) ** 2).sum(axis=1)]


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all tasks of `of` (a flat array of the task's vectors), added by cell in Spark."""
    make = (lambda xs: pa.array([int(x) for x in xs], pa.int64())) if kind == "long" else (lambda xs: pa.array(xs, pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = of(_unpacked(batch.column(0).slice(at, 4096).to_pylist()))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), make(total)], names=["cell", "value"])
        release()

    rows = in_arrow(fit.select("x"), run, f"cell int, value {kind}").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")).alias("value"))
    return np.array([r["value"] for r in sorted(rows.collect(), key=lambda r: r["cell"])], object if kind == "long" else np.float64)


def mean_of(fit: DataFrame, size: int) -> Mean:
    """Exact sums: entries are split at 2^26, so that no task's sums of up to 2^36 vectors leave 64 bits."""
    parts = _summed(fit, lambda m: np.concatenate([[len(m)], (m >> 26).sum(axis=0), (m & ((1 << 26) - 1)).sum(axis=0)]), "long")
    return Mean(int(parts[0]), [(int(a) << 26) + int(b) for a, b in zip(parts[1 : size + 1], parts[size + 1 :])])


def product(fit: DataFrame, mean: Mean, q: np.ndarray) -> np.ndarray:
    """Covariance times q by one pass: rows are centred before they are multiplied."""

    def of(m: np.ndarray) -> np.ndarray:
        x = mean.centred(m)
        return (x.T @ (x @ q)).ravel()

    return _summed(fit, of).reshape(q.shape) / mean.n


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], size: int, want: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of the symmetric matrix that `times` multiplies by.

    Each new block is what the last one's image adds to the basis, orthogonalised against all of it, twice. Directions
    that vanish (a breakdown: the space is invariant) are replaced by random ones, a restart. It ends when the residuals
    of the wanted components are below tolerance x the largest eigenvalue, or the basis is the whole space.
    """
    random = np.random.default_rng(seed)
    want, basis, images = min(want, size), np.zeros((size, 0)), np.zeros((size, 0))
    new, restarted = random.standard_normal((size, min(block, size))), True
    while True:
        new = _orthogonal(new, basis, random, min(block, size - basis.shape[1]))
        basis, images = np.hstack([basis, new]), np.hstack([images, image := times(new)])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:want], turns[:, ::-1][:, :want]
        found = basis @ turns
        top = max(abs(float(values[0])), np.finfo(float).tiny)
        left = np.linalg.norm(images @ turns - found * values, axis=0)
        if basis.shape[1] == size or (not restarted and len(values) == want and left.max() <= tolerance * top):
            return values, found / np.linalg.norm(found, axis=0)
        rest = image - basis @ (basis.T @ image)
        u, s, _ = np.linalg.svd(rest - basis @ (basis.T @ rest), full_matrices=False)
        new = u[:, s > 1e-13 * top]
        restarted = new.shape[1] < block


def _orthogonal(new: np.ndarray, basis: np.ndarray, random: np.random.Generator, n: int) -> np.ndarray:
    """n unit columns, orthogonal to the basis and each other: those of `new`, and random ones for what it lacks."""
    new = np.hstack([new, random.standard_normal((len(new), n))])[:, :n] if new.shape[1] < n else new[:, :n]
    for _ in range(3):
        new, _ = np.linalg.qr(new - basis @ (basis.T @ new))
    return new


class Whitening(NamedTuple):
    mean: Mean
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray
    error: float


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on each distinct vector once; None if there is nothing to fit. Vectors must have one length: of several, the
    commonest is taken (the longest of equally common ones)."""
    every = fit_list(vectors, column)
    sizes = every.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    rows = every.where(F.col("size") == size)
    mean = mean_of(rows, size)
    trace = float(_summed(rows, lambda m: np.array([(mean.centred(m) ** 2).sum()]))[0]) / mean.n
    values, found = block_lanczos(lambda q: product(rows, mean, q), size, components)
    kept = values > LEAST * max(float(values[0]), 0.0)
    values, found = values[kept], found[:, kept]
    if not len(values):
        return Whitening(mean, values, found, values, 0.0)

    def of(m: np.ndarray) -> np.ndarray:
        z = mean.centred(m) @ found / np.sqrt(values)
        return (z.T @ z).ravel()

    covariance = _summed(rows, of).reshape(len(values), -1) / mean.n
    return Whitening(mean, values, found, values / trace, float(np.abs(covariance - np.eye(len(values))).max()))


def whiten(vectors: DataFrame, w: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component."""
    size, k = w.vectors.shape
    schema = pa.schema([(key, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for places, m in entries(part.column(1)):
                    if m.shape[1] != size or not k:
                        continue
                    d, z, n = w.mean.deviations(m), w.mean.centred(m) @ w.vectors / np.sqrt(w.values), len(places)
                    ids, spread = part.column(0).take(pa.array(places)), pa.array(np.repeat(np.arange(n), k))
                    deviation = pa.array(square_sums(d), pa.int64()).take(spread)
                    columns = [ids.cast(pa.int64()).take(spread), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.mean.n)), deviation, pa.array(z.ravel()), pa.array(np.tile(w.shares, n)), pa.array(np.full(n * k, w.error))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release()

    return in_arrow(vectors.select(key, column), run, f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11(spark, embeddings: DataFrame) -> DataFrame:
    """The contract of op11_whitening.

    Null and empty vectors and those with null or non-finite entries are dropped, and so are those of another length than
    the commonest. Null ids stay null, repeated rows repeat (the fit list has them once). Entries are held within
    +-2^52; a deviation that a long can't hold is null. Components with no variance of their own, eigenvalues below LEAST
    of the largest, don't exist, so one distinct vector, like no rows, gives no result.
    """
    w = fit(embeddings)
    if w is None:
        ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], ddl)
    return whiten(embeddings, w)

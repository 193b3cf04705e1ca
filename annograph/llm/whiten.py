"""Whitening of embeddings with exact covariances from bit planes.

Entries become whole numbers x = floor(64 * c) + 1000000. The fit list holds every distinct x vector once. In each
dimension the smallest x is subtracted, so few bits are left; a block of rows is turned into one bit plane for each bit
of each dimension, packed into 64-bit words across rows. The sum of products of two dimensions is then the sum of
2^(a+b) times the number of common bits of their planes a and b: exact whole numbers, added up by Spark. Centring
is done on them before anything is rounded. Only sums over pairs of dimensions reach the driver, so what it holds grows
with the square of the dimension, not with the rows.

Defined results: rows whose vector is null or holds null or non-finite entries are left out. Vectors have the length
that most rows have (of equally frequent ones the longest); others are left out. Entries beyond 2^55 count as 2^55. A
repeated row, also of one id, is returned for each of its occurrences and fitted once. `deviation` is null where it does
not fit 64 bits. Components without variance (eigenvalue up to 1e-12 of the largest) can't be scaled to one and are left
out, so equal vectors, or none, give no rows. Other columns of the caller are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 55)
#: Bits of a block of planes at most, a byte each before packing.
BLOCK_BITS = 1 << 24
#: Sums leave the workers in pieces of so many bits, so that Spark's 64-bit sums can't overflow.
LIMB_BITS, LIMBS = 40, 5
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Model:
    """`least + whole + part / n` is the mean; `axes` (dimension x component) holds unit eigenvectors of the covariance."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")


def scaled(vector: Column) -> Column:
    """The whole numbers of a vector, null unless every entry is finite."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bounded = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(finite, F.transform(doubles, lambda c: F.floor(bounded(c) * SCALE).cast("bigint") + SHIFT))


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that count."""
    given = rows.select(F.col(id_col).alias("id"), scaled(F.col(vector_col)).alias("x")).where("x is not null")
    lengths = given.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return given.where(F.size("x") == (lengths["d"] if lengths else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _batches(batches, rows: int) -> Iterator[np.ndarray]:
    """The vectors of Arrow batches in matrices of at most so many rows, filled up across batches."""
    held, n = [], 0
    for batch in batches:
        x = _matrix(batch.column("x"))
        for at in range(0, len(x), rows):
            held.append(x[at : at + rows])
            n += len(held[-1])
            if n >= rows:
                x_all = np.concatenate(held)
                yield x_all[:rows]
                held, n = [x_all[rows:]], n - rows
    if n:
        yield np.concatenate(held)


def ranges(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, smallest and largest entry of each dimension."""

    def extremes(batches):
        n, low, high = 0, None, None
        for x in _batches(batches, 1 << 14):
            n += len(x)
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(low)), pa.int32()), "n": pa.array([n] * len(low), pa.int64()), "low": low, "high": high})

    found = fit.mapInArrow(extremes, "dim int, n bigint, low bigint, high bigint").groupBy("dim").agg(F.sum("n"), F.min("low"), F.max("high"))
    rows = sorted(found.collect())
    return (rows[0][1] if rows else 0), np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Row p holds bit `b` of dimension `i`, a bit for each row of y, where p counts through the dimensions' bits."""
    out = np.zeros((sum(bits), -(-len(y) // 64) * 8), np.uint8)
    at = 0
    for i, width in enumerate(bits):
        shifts = np.arange(width, dtype=np.int64)
        out[at : at + width, : -(-len(y) // 8)] = np.packbits((y[:, i] >> shifts[:, None] & 1).astype(np.uint8), axis=1)
        at += width
    return out.view(np.uint64)


def scatter(planes: np.ndarray, dims: np.ndarray, shifts: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[i, j, a + b] the rows that have bit a of dimension i and bit b of dimension j, for i <= j."""
    for p in range(len(planes)):
        first = int(np.searchsorted(dims, dims[p]))
        common = np.bitwise_count(planes[first:] & planes[p]).sum(1, dtype=np.int64)
        np.add.at(counts, (dims[p], dims[first:], shifts[first:] + shifts[p]), common)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    return [(values >> (LIMB_BITS * k) & ((1 << LIMB_BITS) - 1)).astype(np.int64) for k in range(LIMBS)]


def sums_of_products(fit: DataFrame, low: np.ndarray, high: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact sums of y and of products y[i] * y[j] over the fit list (i <= j), where y = x - low."""
    size = len(low)
    bits = [max(1, int(h - a).bit_length()) for a, h in zip(low.tolist(), high.tolist())]
    dims, shifts = np.repeat(np.arange(size), bits), np.concatenate([np.arange(b) for b in bits])
    block = max(64, BLOCK_BITS // sum(bits) // 64 * 64)

    def count(batches):
        counts = np.zeros((size, size, 2 * max(bits) - 1), np.int64)
        single = np.zeros(len(dims), np.int64)
        for x in _batches(batches, block):
            planes = bit_planes(x - low, bits)
            scatter(planes, dims, shifts, counts)
            single += np.bitwise_count(planes).sum(1, dtype=np.int64)
        if not single.any():
            return
        i, j = np.triu_indices(size)
        products = sum(counts[i, j, s].astype(object) << s for s in range(counts.shape[2]))
        sums = np.zeros(size, object)
        np.add.at(sums, dims, single.astype(object) << shifts.astype(object))
        limbs = _limbs(np.concatenate([sums, products]))
        names = {"i": np.concatenate([np.arange(size), i]), "j": np.concatenate([np.full(size, -1), j])}
        yield pa.RecordBatch.from_pydict({k: v.astype(np.int32) for k, v in names.items()} | {f"l{k}": v for k, v in enumerate(limbs)})

    schema = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
    rows = fit.mapInArrow(count, schema).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    sums, products = [0] * size, np.zeros((size, size), object)
    for r in rows:
        value = sum(r[f"l{k}"] << LIMB_BITS * k for k in range(LIMBS))
        if r["j"] < 0:
            sums[r["i"]] = value
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = value
    return sums, products


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """(n * sum xy - sum x * sum y) / n^2: whole numbers up to the division, which rounds once."""
    s = np.array(sums, object)
    return ((n * products - np.outer(s, s)) / (n * n)).astype(np.float64)


def fit_model(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of the distinct vectors `x`; None where nothing varies."""
    fit = stored(vectors.select("x").distinct(), "fit")
    n, low, high = ranges(fit)
    if not n or not len(low):
        return None
    sums, products = sums_of_products(fit, low, high)
    v = covariance(n, sums, products)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = [k for k in order if values[k] > NO_VARIANCE * values.max()] if values.max() > 0 else []
    if not order:
        return None
    whole = np.array([s // n for s in sums], np.int64) + low
    part = np.array([s % n for s in sums], np.int64)
    model = Model(n, whole, part, axes[:, order], values[order], values[order] / np.trace(v))
    return Model(**{**model.__dict__, "identity_error": identity_error(fit, model)})


def project(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened rows: (x - mean) on the axes, over the root of the eigenvalue."""
    centred = (x - model.whole).astype(np.float64) - model.part / model.n
    return centred @ model.axes / np.sqrt(model.values)


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the rows."""
    k = len(model.values)

    def moments(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for x in _batches(batches, 1 << 14):
            w = project(model, x)
            total += w.sum(0)
            square += w.T @ w
        flat = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(flat)), pa.int32()), "value": flat})

    rows = fit.mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    flat = np.zeros(k + k * k)
    for at, value in rows:
        flat[at] = value
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
    off = x - model.whole
    widest = (int(np.abs(off).max()) + 1) * model.n
    if widest * widest * x.shape[1] < 1 << 63:
        return ((off * model.n - model.part) ** 2).sum(1).tolist()
    exact = ((off.astype(object) * model.n - model.part.astype(object)) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, model: Model | None = None) -> DataFrame:
    """A row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    With a `model` fitted before, new rows are projected with it.
    """
    vectors = usable_vectors(rows, id_col, vector_col)
    model = model or fit_model(vectors, components)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                if not part.num_rows:
                    continue
                x = _matrix(part.column("x"))
                repeat = np.repeat(np.arange(len(x)), k)
                count = len(repeat)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([model.n] * count, pa.int64()),
                    pa.array(deviations(model, x), pa.int64()).take(pa.array(repeat)), pa.array(project(model, x).ravel()),
                    pa.array(np.tile(model.explained, len(x))), pa.array([model.identity_error] * count),
                ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(apply, schema)

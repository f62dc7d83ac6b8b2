"""Embedding whitening from exact cross-products of bit planes.

A vector's entries c become whole numbers x = floor(scale * c) + OFFSET. The fit list holds each
distinct x vector once (an aggregate with partial sums, so hot vectors collapse before the shuffle). Its cross-products
come from bit-sliced scatter: each block of rows is shifted by its own minimum in every
dimension, and bit plane a of dimension i is packed across the rows into 64-bit words. Then

    sum over rows of x_i x_j = sum over planes of 2^(a + b) popcount(plane_ia AND plane_jb),

put right for the shifts. Every step is in whole numbers of any size; a task emits one decimal for each
pair of dimensions, and Spark adds them up. The driver gets those sums alone (a number for each pair of dimensions,
however many rows), centres them as integers, n * C - S S', and only then divides
and calls `eigh`.

Defined results: a vector that is null, or holds a null or an entry that isn't finite, is left out; so is
one whose length isn't the commonest (of ties, the longest). Entries with |scale * c| over 2^52 count as 2^52 (far
beyond the places that a float has). Equal rows have equal results. A component whose eigenvalue
is 0 (the fit list spans fewer dimensions) has a null `whitened`. A `deviation` beyond a
long is null. An empty table, or one without a usable vector, gives an empty result. Columns named like the operator's own are replaced,
all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_folder

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2**52
COMPONENTS = 16
BLOCK_ROWS = 1 << 14


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined entry."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731 - a NaN is greater than all others
    return vector.isNotNull() & F.forall(vector, finite)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """x = floor(scale * c), without the offset."""
    near = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT))
    return F.transform(vector, lambda c: near(c).cast("long"))


def planes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(shifts, words, bits): words[i, a] is bit plane a of dimension i of x - shifts, 64 rows a word."""
    shifts = x.min(axis=0)
    rest = (x - shifts).T.astype(np.uint64)
    bits = max(1, int(rest.max()).bit_length())
    padded = np.zeros((rest.shape[0], bits, -(-rest.shape[1] // 64) * 64), np.uint8)
    for a in range(bits):
        padded[:, a, : rest.shape[1]] = (rest >> np.uint64(a)) & np.uint64(1)
    return shifts, np.packbits(padded, axis=2, bitorder="little").view(np.uint64), bits


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of x, as Python's whole numbers."""
    shifts, words, bits = planes_of(x)
    d, n = words.shape[0], len(x)
    flat = words.reshape(d * bits, -1)
    weight = np.array([1 << a for a in range(bits)], object)
    ones = np.bitwise_count(flat).sum(axis=1, dtype=np.int64).reshape(d, bits).astype(object) @ weight
    cross = np.zeros((d, d), object)
    for i in range(d):
        counts = np.stack([np.bitwise_count(words[i, a] & flat[i * bits :]).sum(axis=1, dtype=np.int64) for a in range(bits)])
        cross[i, i:] = np.tensordot(weight, counts.reshape(bits, d - i, bits).astype(object), (0, 0)) @ weight
        cross[i:, i] = cross[i, i:]
    s = shifts.astype(object)
    return ones + n * s, cross + np.outer(ones, s) + np.outer(s, ones) + n * np.outer(s, s)


@dataclass
class Whitening:
    """What the fit list says: its size, sums (with the offset), eigenvalues and unit eigenvectors, by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def whiten(self, far: np.ndarray) -> np.ndarray:
        """Whitened components of rows of n * x - S; a component without variance is undefined (NaN)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (far.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out

    def far(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they are wide enough."""
        most = self.n * (int(np.abs(x).max(initial=0)) + OFFSET) + max(map(abs, self.sums))
        kind = np.int64 if most < 2**62 else object
        return self.n * (x.astype(kind) + OFFSET) - np.array(self.sums, kind)


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The last column of each batch as rows of numbers, BLOCK_ROWS at most."""
    for b in batches:
        flat = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
        for i in range(0, len(flat), BLOCK_ROWS):
            yield flat[i : i + BLOCK_ROWS]


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and the cross-products of the column x of the fit list."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for x in matrices(batches, d):
            s, c = scatter(x)
            n, sums, cross = n + len(x), sums + s, cross + c
        if n:
            i, j = np.triu_indices(d)
            values = [n, *sums.tolist(), *cross[i, j].tolist()]
            keys = [np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(map(str, values)))], ["i", "j", "value"])

    rows = distinct.select("x").mapInArrow(parts, "i int, j int, value string")
    total = rows.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # a row for each pair of dimensions
    got = {(r.i, r.j): int(r.value) for r in total}
    cross = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            cross[i, j] = cross[j, i] = got[i, j]
    return got[-1, -1], [got[-1, j] for j in range(d)], cross


def decomposed(n: int, sums: list[int], cross: np.ndarray, components: int) -> Whitening:
    """Centre in whole numbers, then divide and decompose."""
    s = np.array(sums, object)
    centred = n * cross - np.outer(s, s)
    covariance = np.array([[c / (n * n) for c in row] for row in centred.tolist()], np.float64)  # Python divides whole numbers with one rounding
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
    trace = sum(centred[i, i] for i in range(len(sums))) / (n * n)
    values[values <= max(trace, 0) * len(sums) * 1e-15] = 0.0
    return Whitening(n, [v + n * OFFSET for v in sums], float(trace), values, vectors)


def identity_error(distinct: DataFrame, d: int, fit: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, from its rows; components without variance are left out."""
    live = np.flatnonzero(fit.values > 0)
    k = len(live)
    if not k:
        return 0.0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in matrices(batches, d):
            w = fit.whiten(fit.far(x))[:, live]
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])

    rows = distinct.select("x").mapInArrow(parts, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return max(abs(r.value / fit.n - (r.i == r.j)) for r in rows.collect())  # a row for each pair of components


def fit(vectors: DataFrame, column: str, folder: str, scale: int = SCALE, components: int = COMPONENTS) -> tuple[int, Whitening] | None:
    """The commonest length among the usable vectors, and their whitening."""
    good = vectors.filter(usable(F.col(column)))
    lengths = good.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return None
    d = lengths.d
    same = good.filter(F.size(column) == d)
    distinct = materialise(same.select(whole_numbers(F.col(column), scale).alias("x")).distinct(), folder, "fit")
    found = decomposed(*exact_sums(distinct, d), components)
    found.identity_error = identity_error(distinct, d, found)
    return d, found


OWN = "deviation long, whitened array<double>"


def whiten(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """`vectors` (those with a usable vector) with `deviation` and the array `whitened`, and what was fitted."""
    others = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    if column not in others:
        raise ValueError(f"{column} is the name of a result")
    name = f"`{column}`"
    schema = T.StructType([vectors.schema[c] for c in others] + T._parse_datatype_string(OWN).fields)
    found = fit(vectors.select(F.col(name).alias("v")), "v", shared_folder(vectors.sparkSession), scale, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    d, model = found
    rows = vectors.filter(usable(F.col(name)) & (F.size(name) == d)).select(*[F.col(f"`{c}`") for c in others], whole_numbers(F.col(name), scale).alias("_x"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                far = model.far(next(matrices(iter([part]), d)))
                if far.dtype != object and int(np.abs(far).max()) ** 2 * d >= 2**63:
                    far = far.astype(object)
                deviation = [v if v < 2**63 else None for v in (far * far).sum(axis=1).tolist()]
                w = model.whiten(far)
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(deviation, pa.int64()), lists], schema.names)

    return rows.mapInArrow(project, schema), model


def components(vectors: DataFrame) -> DataFrame:
    """The contract's rows: one for each row and component."""
    found, model = whiten(vectors.select("vec_id", "embedding"))
    if model is None:
        return found.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values])
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"),
    )

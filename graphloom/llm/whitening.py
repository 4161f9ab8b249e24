"""Embedding whitening by a bit-sliced scatter.

Entries become integers (floor(scale * c) + offset). Over the distinct vectors, each dimension less its least value is cut
into bit planes, and a plane's bits of 64 rows lie in one word. The product of two dimensions is the sum of
2^(a+b) * popcount(plane a of the one AND plane b of the other), in which nothing is rounded; so n * sum(x y) - S_x S_y, the
covariance times n^2, is an exact integer that is centred before it becomes a double. `eigh` of that matrix gives the
components. Tasks send their sums in limbs of 60 bits, which Spark adds as decimals; the driver holds matrices of
dimension by dimension, which don't grow with the rows.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, zero vectors are not; a vector
that repeats, under any id, counts once in the fit and every row of it is returned; rows that repeat an id, or lack one,
come back as they are; vectors of each length are whitened among themselves, those without entries are left out;
64 * c beyond 2^60 counts as 2^60; components whose eigenvalue is within rounding of 0 can't be scaled and are left
out, so that constant data give no row; a deviation beyond 64 bits is null; an empty table gives an empty result.
Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tuned

BLOCK, LIMB, WIDEST = 4096, 60, 1 << 60
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def integers(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): the rows that take part, with x as an array of long."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(WIDEST))), F.lit(-float(WIDEST)))) + F.lit(offset)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).select("vec_id", F.transform(v, step).alias("x"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of non-negative columns: plane by plane, each a row of 64-bit words that hold 64 rows each."""
    full = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    full[: len(y)] = y.astype(np.uint64)
    out = np.empty((sum(bits), len(full) // 64), np.uint64)
    at = 0
    for d, b in enumerate(bits):
        for k in range(b):
            out[at] = np.packbits(((full[:, d] >> np.uint64(k)) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64)
            at += 1
    return out


def popcounts(p: np.ndarray) -> np.ndarray:
    """popcount(a AND b) of all pairs of planes, summed over the words; the upper half and the diagonal are filled."""
    out = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p)):
        out[i, i:] = np.bitwise_count(p[i:] & p[i]).sum(1, dtype=np.int64)
    return out


def weighted(counts: np.ndarray, bits: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of two dimensions (i <= j) from the popcounts of their planes."""
    starts = np.concatenate([[0], np.cumsum(bits)]).tolist()
    dim, level = len(bits), np.concatenate([np.arange(b) for b in bits]) if bits else np.zeros(0, int)
    small = max(bits, default=0) * 2 + int(counts.max(initial=0)).bit_length() + 12 < 63
    if small:
        both = np.triu(counts, 1).T + counts if len(counts) else counts
        by = both * (np.int64(1) << (level[:, None] + level))
        some = [i for i in range(dim) if bits[i]]
        by = np.add.reduceat(np.add.reduceat(by, [starts[i] for i in some], axis=0), [starts[i] for i in some], axis=1) if some else np.zeros((0, 0), np.int64)
        return {(some[a], some[b]): int(by[a, b]) for a in range(len(some)) for b in range(a, len(some))}
    out = {}
    for i in range(dim):
        for j in range(i, dim):
            total = 0
            for a in range(bits[i]):
                for b in range(bits[j]):
                    p, q = starts[i] + a, starts[j] + b
                    total += int(counts[min(p, q), max(p, q)]) << (a + b)
            out[i, j] = total
    return out


def extent(xs: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """The number of vectors, and each dimension's least value, greatest value and exact sum."""

    def run(batches):
        n, low, high = 0, np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        top, rest = np.zeros(dim, np.int64), np.zeros(dim, np.int64)  # of a sum: multiples of 2^32, and what is left
        for b in batches:
            x = matrix(b, dim)
            if len(x):
                n, low, high = n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                top, rest = top + (x >> 32).sum(0), rest + (x & 0xFFFFFFFF).sum(0)
        if n:
            at = np.arange(dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, np.full(dim, n), low, high, top, rest)], ["i", "n", "low", "high", "top", "rest"])

    wide = "decimal(38,0)"
    sums = xs.select("x").mapInArrow(run, "i int, n long, low long, high long, top long, rest long").groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("top").cast(wide)).alias("top"), F.sum(F.col("rest").cast(wide)).alias("rest"))
    found = sorted(sums.collect(), key=lambda r: r["i"])  # one row for each dimension
    return found[0]["n"], [r["low"] for r in found], [r["high"] for r in found], [(int(r["top"]) << 32) + int(r["rest"]) for r in found]


def scatter(xs: DataFrame, low: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of (x_i - low_i) * (x_j - low_j) over all vectors, i <= j."""
    dim = len(low)
    least = np.array(low, np.int64)

    def run(batches):
        sums: dict[tuple[int, int], int] = {}
        held = np.zeros((sum(bits), sum(bits)), np.int64)
        for b in batches:
            y = matrix(b, dim) - least
            for at in range(0, len(y), BLOCK):
                held += popcounts(planes(y[at : at + BLOCK], bits))
        sums = weighted(held, bits)
        keys = [k for k, v in sums.items() if v]
        limbs = [[(sums[k] >> (LIMB * part)) & ((1 << LIMB) - 1) for k in keys] for part in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["i", "j", "l0", "l1", "l2"])

    wide = "decimal(38,0)"
    parts = xs.select("x").mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long").groupBy("i", "j").agg(*(F.sum(F.col(c).cast(wide)).alias(c) for c in ("l0", "l1", "l2")))
    return {(r["i"], r["j"]): int(r["l0"]) + (int(r["l1"]) << LIMB) + (int(r["l2"]) << (2 * LIMB)) for r in parts.collect()}  # dimension squared


def covariance(n: int, low: list[int], sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """n * sum(y_i y_j) - T_i T_j, an exact integer, over n^2; y = x - low has the covariance of x."""
    dim = len(low)
    t = [s - n * a for s, a in zip(sums, low, strict=True)]
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - t[i] * t[j]) / (n * n)
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the entry of largest size is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = np.flatnonzero(e > max(np.trace(v), 0) * len(v) * 4 * np.finfo(float).eps)[:most]
    e, u = e[keep], u[:, keep]
    if len(keep):
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return e, u


def whiten(rows: DataFrame, most: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component up to `most`."""
    tuned(rows.sparkSession)
    ready = integers(rows, scale, offset)
    out = None
    for r in ready.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect():  # the lengths of vectors
        some = _whiten(ready.where(F.size("x") == r["dim"]), r["dim"], most)
        out = some if out is None else out.unionByName(some)
    return rows.sparkSession.createDataFrame([], f"{OUT}, identity_error double") if out is None else out


def _whiten(ready: DataFrame, dim: int, most: int) -> DataFrame:
    xs = materialize(ready.select("x").distinct(), "whitening-vectors")
    n, low, high, sums = extent(xs, dim)
    v = covariance(n, low, sums, scatter(xs, low, [(b - a).bit_length() for a, b in zip(low, high, strict=True)]))
    e, u = components(v, most)
    k = len(e)
    least, t = np.array(low, np.int64), [s - n * a for s, a in zip(sums, low, strict=True)]
    mean, turn = np.array([x / n for x in t]), u / np.sqrt(e)
    share = (e / np.trace(v)).tolist() if k else []
    far = max(max(n * (b - a) - c, c) for a, b, c in zip(low, high, t, strict=True))  # the largest |n * x - S|
    exact = far * far * dim < 1 << 63

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - least).astype(np.float64) - mean) @ turn

    def deviations(x: np.ndarray) -> pa.Array:
        if exact:
            return pa.array((((x - least) * n - np.array(t, np.int64)) ** 2).sum(1))
        whole = [sum((n * a - b) ** 2 for a, b in zip(row, t, strict=True)) for row in (x - least).tolist()]
        return pa.array([s if s < 1 << 63 else None for s in whole], pa.int64())

    def moments(batches):
        held = np.zeros((k + 1, k))
        for b in batches:
            w = projected(matrix(b, dim))
            held += np.vstack([w.sum(0), w.T @ w])
        at = np.indices(held.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(held.ravel())], ["i", "j", "s"])

    error = 0.0
    if k:
        m = np.zeros((k + 1, k))
        for r in xs.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (k + 1) * k rows
            m[r["i"], r["j"]] = r["s"] / n
        error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())

    def run(batches):
        for b in batches:
            x = matrix(b, dim)
            rows = len(x)
            row = np.repeat(np.arange(rows), k)
            ids, far_off = b.column("vec_id").take(pa.array(row)), deviations(x).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), far_off, pa.array(projected(x).ravel()), pa.array(np.tile(np.array(share, np.float64), rows))], ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return ready.mapInArrow(run, OUT).withColumn("identity_error", F.lit(error))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

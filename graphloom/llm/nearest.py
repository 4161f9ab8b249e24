"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by a codebook each, fitted on at most `sample` rows; a row lies in the cell of
its two nearest centroids. For a query, pairs of centroids are visited by summed distance with a heap until the visited
cells hold a fraction of all rows; those rows are reranked by exact distance. The fraction is measured: of sampled
queries, the true neighbours among the sample are found by brute force, and as much is visited as finds the share
`target` of them. Vectors that lie in clusters need little; of isotropic noise, in which no index can rule much out,
about half. Queries of near cells travel in blocks of fixed size, and an index part meets the blocks that visit it;
parts are one first-half centroid split by a salt, so neither a popular cell nor many equal vectors gather in one task.
Each part returns its k best of each query and the k best of those win.

Defined results: vectors null, zero, or with null or non-finite components, and rows without id, take no part; vectors of
each length are searched among themselves; a query never finds its own id; of rows that share an id the nearest counts,
once, and rows that also share the vector are one; ties go to the smaller id; a query that found fewer than `k` ids
visits all cells, so `k` are returned unless fewer exist; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, pack, some_rows, unpack

BLOCK, GROUP, PART = 256, 16, 4000


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles, for rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", v.alias("v"))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means with fixed seeds."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        a = distances(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def visit(da: np.ndarray, db: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold `wanted` rows."""
    oa, ob = np.argsort(da), np.argsort(db)
    heap, seen, out, held = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(db) + int(ob[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(oa) and b < len(ob) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (da[oa[a]] + db[ob[b]], a, b))
    return out


def needed_fraction(x: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, target: float, queries: int = 200) -> float:
    """The share of rows to visit that finds the share `target` of sampled queries' true neighbours in the sample."""
    half, nb = left.shape[1], len(right)
    cell = distances(x[:, :half], left).argmin(1) * nb + distances(x[:, half:], right).argmin(1)
    counts = np.bincount(cell, minlength=len(left) * nb)
    found = []
    for i in np.random.default_rng(11).permutation(len(x))[:queries]:
        d = distances(x[i : i + 1], x)[0]
        d[i] = np.inf
        by = np.add.outer(distances(x[i : i + 1, :half], left)[0], distances(x[i : i + 1, half:], right)[0]).ravel()
        order = np.argsort(by, kind="stable")
        upto = np.empty(len(by))
        upto[order] = np.cumsum(counts[order])
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, int)
        found += (upto[cell[near]] / len(x)).tolist()
    return float(np.quantile(found, target)) if found else 1.0


def centroids_for(n: int) -> int:
    """A quarter of the root of the rows, to a power of two: 64 to 256, which the sample can still fit."""
    return min(256, max(64, 1 << round(math.log2(max(1, n) ** 0.5 / 4 + 1))))


def nearest(rows: DataFrame, every: int = 100, k: int = 10, centroids: int | None = None, sample: int = 20_000, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for every row whose id is divisible by `every`."""
    good = usable(rows)
    found = None
    for r in good.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # the lengths of vectors
        some = _nearest(good.where(F.size("v") == r["dim"]), r["dim"], every, k, centroids, sample, target)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(good: DataFrame, dim: int, every: int, k: int, centroids: int | None, sample: int, target: float) -> DataFrame:
    """(query_id, vec_id, score): candidates among vectors of one length."""
    good = materialize(good.dropDuplicates(["vec_id", "v"]), "nearest-rows")
    x = np.array([r["v"] for r in some_rows(good, sample, "vec_id").select("v").collect()])  # bounded by `sample`
    centre, half = x.mean(0), max(1, dim // 2)
    x = x - centre
    centroids = centroids or centroids_for(good.count())
    left = codebook(x[:, :half], centroids)
    right = codebook(x[:, half:], centroids) if dim > 1 else np.zeros((1, 0))
    nb = len(right)
    fraction = needed_fraction(x, left, right, k, target)

    def assign(batches):
        for b in batches:
            col = b.column("v")
            v = col.flatten().to_numpy().reshape(-1, dim) - centre
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), col, pa.array(distances(v[:, :half], left).argmin(1), pa.int32()), pa.array(distances(v[:, half:], right).argmin(1), pa.int32())], ["vec_id", "v", "a", "b"])

    index = materialize(good.mapInArrow(assign, "vec_id long, v array<double>, a int, b int"), "nearest-index")
    counts = np.zeros(len(left) * nb, np.int64)
    for r in index.groupBy("a", "b").count().collect():  # at most centroids ** 2 rows
        counts[r["a"] * nb + r["b"]] = r["count"]
    discard(good)
    total = int(counts.sum())
    wanted = min(total, int(np.ceil(fraction * total)) + k)
    salts = np.maximum(1, -(-counts.reshape(len(left), nb).sum(1) // PART)).astype(int).tolist()

    def blocks(batches, wanted):
        """Blocks of queries: ids, vectors and the cells of each as bits; one row for each first-half centroid they visit."""
        ids, vs = [], []

        def out():
            q = np.array(vs)
            bits = np.zeros((len(q), len(counts)), bool)
            for i, (da, db) in enumerate(zip(distances((q - centre)[:, :half], left), distances((q - centre)[:, half:], right), strict=True)):
                bits[i, visit(da, db, counts, wanted)] = True
            blob = pack(np.array(ids, np.int64), q.ravel(), np.packbits(bits, axis=1).ravel())
            any_a = bits.any(0).reshape(len(left), nb).any(1)
            parts = np.flatnonzero(any_a)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), zlib.crc32(blob)), pa.int64()), pa.array([blob] * len(parts), pa.binary())], ["a", "block", "blob"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids.append(i)
                vs.append(v)
                if len(ids) == BLOCK:
                    yield out()
                    ids.clear()
                    vs.clear()
        if ids:
            yield out()

    split = F.element_at(F.array(*map(F.lit, salts)), F.col("a") + 1)
    key = ["a", "salt", "turn"]

    def found_by(asked: DataFrame, wanted: int) -> DataFrame:
        groups = max(1, -(-asked.count() // (BLOCK * GROUP)))
        near = asked.select("vec_id", "v", "a", "b").repartitionByRange(groups * 4, "a", "b", "vec_id").sortWithinPartitions("a", "b", "vec_id").select("vec_id", "v")
        blocked = materialize(near.mapInArrow(lambda batches: blocks(batches, wanted), "a int, block long, blob binary").withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(groups))), "nearest-queries")
        queries = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), split - 1)))
        visits = blocked.select(F.col("a").alias("visited"), F.col("turn").alias("by")).distinct()
        parts = index.withColumn("salt", F.pmod(F.xxhash64("vec_id", "b"), split).cast("int")).join(visits, F.col("a") == F.col("visited")).select("vec_id", "v", "b", F.col("a").alias("a"), "salt", F.col("by").alias("turn"))
        return parts.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")

    def search(held: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if held.num_rows:
            a = held.column("a")[0].as_py()
            held = held.sort_by("vec_id")
            ids = held.column("vec_id").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # the rows of an id stand together
            x = held.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            moved = x - centre
            cell = a * nb + held.column("b").to_numpy()
            for blob in asking.column("blob").to_pylist():
                qid, q, bits = unpack(blob)
                q = q.reshape(len(qid), dim)
                bits = np.unpackbits(bits.reshape(len(qid), -1), axis=1, count=len(counts)).astype(bool)
                near = np.where(bits[:, cell] & (qid[:, None] != ids), distances(q - centre, moved), np.inf)
                of_id = near if len(first) == len(ids) else np.minimum.reduceat(near, first, axis=1)
                cut = np.partition(of_id, k - 1, axis=1)[:, k - 1] if len(first) > k else of_id.max(1)
                slack = 1e-12 * (((q - centre) ** 2).sum(1) + (moved * moved).sum(1).max())  # of rounding in expanded squares
                for i in range(len(qid)):
                    c = np.flatnonzero((near[i] <= cut[i] + slack[i]) & np.isfinite(near[i]))
                    d = np.sqrt(((x[c] - q[i]) ** 2).sum(1))
                    order = np.lexsort((d, ids[c]))
                    order = order[np.concatenate([[True], ids[c][order][1:] != ids[c][order][:-1]])] if len(c) else order
                    best = order[np.lexsort((ids[c][order], d[order]))[:k]]
                    found += zip([int(qid[i])] * len(best), ids[c[best]].tolist(), d[best].tolist(), strict=True)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    asked = index.where(F.col("vec_id") % every == 0)
    found = found_by(asked, wanted)
    others = index.select("vec_id").distinct().count() - 1
    if others + 1 == total:  # no id repeats: the rows visited are as many ids
        return found
    found = materialize(found, "nearest-found")
    enough = found.select("query_id", "vec_id").distinct().groupBy("query_id").count().where(F.col("count") >= min(k, others))
    return found.unionByName(found_by(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), total))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

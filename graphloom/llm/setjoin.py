"""Parts of an exact self-join of sets by Jaccard similarity, shared by line dedup and the n-gram join.

Sets are arrays of 48-bit token hashes. Equal sets are one class. A class is filed under the first tokens of its
rarest-first order: two sets that reach the threshold share such a token (prefix filter), and where it stands in both
bounds what they can share (positional filter). Rarity comes from a table of counters of fixed size over all tokens of
all rows; any order gives the same pairs, so its rounding costs time only.

Pairs are found in two rounds. The first files, for each class, its first partner that passes the filters, and names the
classes that had more; what those verified partners settle needs no second look. The second round takes all remaining
pairs of the named classes. So a large group of near copies costs about one pair each, and no pair is lost.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, discard, distinct_sorted, gathered, materialize, mix, pack, unpack

BITS, LEVELS = 48, 4
LOW = np.uint64((1 << BITS) - 1)


def segments_sorted(values: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit values of each segment (at most 65,536), ascending, with their segments."""
    x = distinct_sorted((segment.astype(np.uint64) << np.uint64(BITS)) | values)
    return x & LOW, (x >> np.uint64(BITS)).astype(np.int64)


class Rarity:
    """Counters of all tokens; level 0 is rarest."""

    def __init__(self, counts: np.ndarray):
        mean = max(1.0, counts.sum() / len(counts))
        self.level = np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean)) + 2, 0, (1 << LEVELS) - 1).astype(np.uint64)
        self.shift = np.uint64(BITS - int(np.log2(len(counts))))

    def order(self, tokens: np.ndarray) -> np.ndarray:
        """48-bit sort keys: level, then hash."""
        return (self.level[tokens >> self.shift] << np.uint64(BITS - LEVELS)) | (tokens >> np.uint64(LEVELS))


def halfway(spark) -> int:
    """Into how many groups what every task sends is gathered first, so that neither step has a group of more than that many."""
    return max(1, int(buckets(spark) ** 0.5))


def count_tokens(df: DataFrame, tokens_of, size: int = 1 << 18, slices: int = 16) -> np.ndarray:
    """How often each counter's tokens occur; `tokens_of` gives the tokens of a record batch. The result has `size` numbers."""
    shift, part, mid = np.uint64(BITS - int(np.log2(size))), size // slices, halfway(df.sparkSession)

    def run(batches):
        c = np.zeros(size, np.int64)
        for b in batches:
            for tokens in tokens_of(b):
                c += np.bincount((tokens >> shift).astype(np.int64), minlength=size)
        group = TaskContext.get().partitionId() % mid
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([group] * slices, pa.int32()), pa.array([pack(c[i * part : (i + 1) * part]) for i in range(slices)], pa.binary())], ["slice", "mid", "counts"])

    def add(key, table):
        total = np.zeros(part, np.int64)
        for x in table.column("counts").to_pylist():
            total += unpack(x)[0]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], ["slice", "counts"])

    some = df.mapInArrow(run, "slice int, mid int, counts binary").groupBy("slice", "mid").applyInArrow(add, "slice int, counts binary")
    rows = some.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()  # `size` numbers
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["slice"] * part : (r["slice"] + 1) * part] = unpack(bytes(r["counts"]))[0]
    return out


class Threshold:
    """Exact integer arithmetic for Jaccard >= num / den."""

    def __init__(self, least: Fraction):
        self.num, self.den = least.numerator, least.denominator

    def need(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of two sets with `total` elements together."""
        return -(-self.num * total // (self.num + self.den))

    def probe(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def index(self, n: np.ndarray) -> np.ndarray:
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def longest(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num

    def alone(self, n: np.ndarray) -> np.ndarray:
        """Whether a set of n elements can reach the threshold with equal sets only."""
        return (self.longest(n) == n) & (self.longest(n - 1) < n)


class Tree:
    """R-tree over (key, size, count vector), packed in that order; a box holds the range of keys and sizes and the largest counts."""

    FAN = 16

    def __init__(self, key: np.ndarray, n: np.ndarray, vectors: np.ndarray):
        self.by = np.lexsort((*vectors.T[:2], n, key))
        box = [key[self.by], key[self.by], n[self.by], n[self.by], vectors[self.by]]
        self.levels = [box]
        while len(box[0]) > self.FAN:
            at = np.arange(0, len(box[0]), self.FAN)
            box = [f.reduceat(x, at, axis=0) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.maximum), box, strict=True)]
            self.levels.append(box)

    def search(self, key: np.ndarray, n: np.ndarray, q: np.ndarray, t: Threshold):
        """Pairs (query, row) of the same key with n[row] <= n[query] that the summed coordinate minima allow."""
        top = len(self.levels[-1][0])
        a, b = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        for depth in range(len(self.levels) - 1, -1, -1):
            first, last, low, high, most = self.levels[depth]
            ok = (first[b] <= key[a]) & (key[a] <= last[b]) & (low[b] <= n[a]) & (t.longest(high[b]) >= n[a])
            a, b = a[ok], b[ok]
            ok = np.concatenate([np.minimum(q[a[i : i + 65536]], most[b[i : i + 65536]]).sum(1, dtype=np.int64) >= t.need(n[a[i : i + 65536]] + low[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            a, b = a[ok], b[ok]
            if depth:
                size = len(self.levels[depth - 1][0])
                a, b = np.repeat(a, self.FAN), (b[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                a, b = a[b < size], b[b < size]
        return a, self.by[b]


def _runs(key: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1))), len(key)) if len(key) else np.zeros(1, np.int64)


def passing_pairs(key: np.ndarray, place: np.ndarray, n: np.ndarray, t: Threshold, extra, vectors: np.ndarray | None = None, limit: int = 1 << 20):
    """Blocks of (longer row, shorter row) that share a key and pass all filters; rows are sorted by key and size.

    extra(i, j) is one more exact filter. With count vectors, pairs come from an R-tree; without, from the rows of a key
    that their sizes allow.
    """
    starts = _runs(key)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    filed = place < t.index(n)

    def keep(i, j):
        """i shorter, j longer"""
        need = t.need(n[i] + n[j])
        ok = filed[i] & (np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
        i, j = i[ok], j[ok]
        ok = extra(i, j)
        return j[ok], i[ok]

    if vectors is not None:
        shared = np.flatnonzero(np.diff(starts)[group] > 1) if len(key) else group
        if len(shared):
            tree = Tree(key[shared], n[shared], vectors[shared])
            for at in range(0, len(shared), 4096):
                some = shared[at : at + 4096]
                a, b = tree.search(key[some], n[some], vectors[some], t)
                j, i = some[a], shared[b]
                ok = i < j
                yield keep(i[ok], j[ok])
        return
    first = np.flatnonzero(filed)
    if not len(first):
        return
    width = int(n.max()) + 1
    rank = group * width + n
    last = np.minimum(np.searchsorted(rank, group[first] * width + np.minimum(t.longest(n[first]), width - 1), "right"), starts[group[first] + 1])
    count = np.maximum(0, last - first - 1)
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        c = count[at:to]
        i = np.repeat(first[at:to], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield keep(i, j)
        at = to


def open_pairs(key: np.ndarray, place: np.ndarray, n: np.ndarray, rank: np.ndarray, still: np.ndarray, t: Threshold, extra, limit: int = 1 << 20):
    """As passing_pairs, but only pairs whose later row, by rank, is still open: each open row meets the rows of its key that sizes allow."""
    starts = _runs(key)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    filed, width, own = place < t.index(n), int(n.max(initial=0)) + 1, np.flatnonzero(still)
    if not len(own):
        return
    at_size = group * width + n
    least = -(-t.num * n[own] // t.den)
    first = np.searchsorted(at_size, group[own] * width + least, "left")
    count = np.searchsorted(at_size, group[own] * width + np.minimum(t.longest(n[own]), width - 1), "right") - first
    ends = np.cumsum(count)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        c = count[at:to]
        later = np.repeat(own[at:to], c)
        other = np.repeat(first[at:to], c) + np.arange(len(later)) - np.repeat(np.cumsum(c) - c, c)
        ok = rank[other] < rank[later]
        i, j = np.minimum(later[ok], other[ok]), np.maximum(later[ok], other[ok])
        ok = filed[i] & (np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= t.need(n[i] + n[j]))
        i, j = i[ok], j[ok]
        ok = extra(i, j)
        yield j[ok], i[ok]
        at = to


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable. Nodes are 64-bit numbers.

    Each round hooks every root to its least neighbour, follows the hooks to their ends, and replaces the links by those
    between different roots; each step is a join over a written table, and what no step reads any more is deleted.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"), F.lit(True).alias("moved")), "hooks")
        while True:
            at = hook.select("node", "root")
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(at.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") < F.col("root"), F.lit(False)).alias("moved")), "jumps")
            discard(hook)
            hook = jumped
            if hook.where("moved").isEmpty():
                break
        found = hook.select("node", "root")
        if roots is None:
            longer = materialize(found, "roots")
        else:
            longer = materialize(roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        side = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        rest = materialize(edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "links")
        discard(edges, hook, roots)
        edges, roots = rest, longer
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def present(ids: DataFrame, column: str, most: int = 26) -> np.ndarray:
    """A Bloom filter with one hash of 64-bit numbers, of 2 ** most bits at most; a hit may be wrong."""
    mid = halfway(ids.sparkSession)
    bits = min(most, max(16, int(64 * ids.count()).bit_length()))

    def blob(group: int, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([pack(f)], pa.binary())], ["k", "f"])

    def run(batches):
        f = np.zeros(1 << bits, bool)
        for b in batches:
            f[(b.column(column).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield blob(TaskContext.get().partitionId() % mid, np.packbits(f))

    def join(table):
        f = np.zeros(1 << (bits - 3), np.uint8)
        for x in table.column("f").to_pylist():
            f |= unpack(x)[0]
        return pa.Table.from_batches([blob(0, f)])

    rows = ids.select(column).mapInArrow(run, "k int, f binary").groupBy("k").applyInArrow(join, "k int, f binary").groupBy("k").applyInArrow(join, "k int, f binary").collect()  # one filter
    return np.unpackbits(unpack(bytes(rows[0]["f"]))[0]).astype(bool) if rows else np.zeros(1 << bits, bool)


def maybe(f: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return f[(ids.view(np.uint64) >> np.uint64(64 - int(np.log2(len(f))))).astype(np.int64)]


def among(classes: DataFrame, named: DataFrame) -> DataFrame:
    """The classes of the named ids; a filter passes over all classes first, so that only those it may hold are shuffled."""
    known = present(named, "id")

    @F.pandas_udf("boolean")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(maybe(known, ids.to_numpy()))

    return classes.where(held("id")).join(named, "id", "left_semi")


def same_share(x: bytes, y: bytes, t: Threshold) -> bool:
    """Whether two sets of words, each joined by spaces, reach the threshold."""
    x, y = set(x.split()), set(y.split())
    common = len(x & y)
    return t.den * common >= t.num * (len(x) + len(y) - common)


def hashed_share(x: bytes, y: bytes, t: Threshold) -> bool:
    """The same for sets of 64-bit hashes."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(x) + len(y) - len(distinct_sorted(np.concatenate([x, y])))
    return t.den * common >= t.num * (len(x) + len(y) - common)


def verify(pairs: DataFrame, sets: DataFrame, t: Threshold, share) -> DataFrame:
    """(a, b, alike) of pairs of class ids, from the sets (id, tokens) themselves."""

    def run(batches):
        for b in batches:
            alike = [share(x, y, t) for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(alike, pa.bool_())], ["a", "b", "alike"])

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, alike boolean")


FILED_BYTES, BUCKET_CLASSES = 8 << 20, 25_000
LARGE, LARGE_LINES = 64, 4096  # classes under one token from which leaders go first; small sets are cheap to compare pair by pair
NO_PAIR = np.iinfo(np.int64).max


def _filed(classes: DataFrame, n_buckets: int, wide: bool) -> DataFrame:
    """The classes' prefix tokens, packed by bucket."""

    def run(batches):
        for b in gathered(batches, FILED_BYTES):
            prefix = [np.frombuffer(x, np.uint64) for x in b.column("prefix").to_pylist()]
            p = np.array([len(x) for x in prefix])
            key = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(p)), p)
            place = np.arange(len(key)) - np.repeat(np.cumsum(p) - p, p)
            bucket = (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
            by = np.lexsort((key, bucket))
            cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            cols = [b.column(c).to_numpy() for c in ("id", "n", "doc", "line", "state")]
            vectors = np.frombuffer(b"".join(b.column("vector").to_pylist()), np.uint32 if wide else np.uint64).reshape(len(p), -1) if len(p) else np.zeros((0, 1), np.uint32)
            out = []
            for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    rows, number = np.unique(row[by[x:y]], return_inverse=True)
                    out.append((k, pack(np.diff(key[by[x:y]], prepend=np.uint64(0)), place[by[x:y]].astype(np.uint32), number.astype(np.uint32), *[c[rows] for c in cols], vectors[rows].ravel())))
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["bucket", "blob"])

    return classes.mapInArrow(run, "bucket int, blob binary")


def _bucket_pairs(table: pa.Table, t: Threshold, first_round: bool, same_state: bool, wide: bool) -> pa.Table:
    keys, places, numbers, cols, vectors, base = [], [], [], [[] for _ in range(5)], [], 0
    for blob in table.column("blob").to_pylist():
        key, place, number, *own, v = unpack(blob)
        keys.append(np.cumsum(key, dtype=np.uint64))
        places.append(place.astype(np.int64))
        numbers.append(number.astype(np.int64) + base)
        for c, x in zip(cols, own, strict=True):
            c.append(x)
        vectors.append(v.reshape(len(own[0]), -1))
        base += len(own[0])
    ids, sizes, doc, line, state = map(np.concatenate, cols)
    key, place, number = map(np.concatenate, (keys, places, numbers))
    vectors = np.concatenate(vectors)
    sizes = sizes.astype(np.int64)
    by = np.lexsort((sizes[number], key))
    key, place, number = key[by], place[by], number[by]
    order = np.empty(base, np.int64)
    ranked = np.lexsort((ids, line, doc))
    order[ranked] = np.arange(base)

    def may(a, b):
        """What the vectors of classes allow: summed minima of counts, or parities that bound the symmetric difference."""
        if wide:
            return np.minimum(vectors[a], vectors[b]).sum(1, dtype=np.int64) >= t.need(sizes[a] + sizes[b])
        return (sizes[a] + sizes[b] - np.bitwise_count(vectors[a] ^ vectors[b]).sum(1, dtype=np.int64)) // 2 >= t.need(sizes[a] + sizes[b])

    def extra(i, j):
        ok = np.ones(len(i), bool) if first_round or not same_state else state[number[i]] != state[number[j]]
        for x in range(0, len(i), 1 << 16):
            at = np.flatnonzero(ok[x : x + (1 << 16)]) + x
            ok[at] = may(number[i[at]], number[j[at]])
        return ok

    best, partner_flag, codes = np.full(base, NO_PAIR), np.zeros(base, bool), []
    leaders = _lead(key, number, order, may, best, partner_flag, LARGE if wide else LARGE_LINES) if first_round else _mixed(key, state[number]) if same_state else key == key
    at = np.flatnonzero(leaders)
    more = lambda a, b: extra(at[a], at[b])
    if first_round or same_state:
        pairs = passing_pairs(key[at], place[at], sizes[number[at]], t, more, vectors[number[at]] if wide else None)
    else:
        pairs = open_pairs(key, place, sizes[number], order[number], state[number] == 0, t, more)
    for j, i in pairs:
        a, b = order[number[at[i]]], order[number[at[j]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if not first_round:
            codes.append(np.unique(lo * base + hi))
            continue
        _improve(best, partner_flag, lo, hi)
    if first_round:
        hi = np.flatnonzero(best != NO_PAIR)
        lo = best[hi]
        open_ = np.flatnonzero(partner_flag)
        a, b = np.concatenate([ids[ranked[lo]], ids[ranked[open_]]]), np.concatenate([ids[ranked[hi]], ids[ranked[open_]]])
    else:
        code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        a, b = ids[ranked[code // base]], ids[ranked[code % base]]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _improve(best: np.ndarray, flag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Keep the first partner of each class; flag the classes of the pairs that are left out."""
    old = best[hi]
    np.minimum.at(best, hi, lo)
    new = best[hi]
    out = (lo != new) | ((old != new) & (old != NO_PAIR))
    flag[lo[out]] = flag[hi[out]] = True
    lost = old[out & (old != NO_PAIR)]
    flag[lost] = True


def _lead(key, number, order, may, best, flag, over: int, leads: int = 6) -> np.ndarray:
    """In large groups, take the first class as leader and settle all that pass beside it; again with the rest.

    All classes of such a group are flagged, so the second round looks at their other pairs. Returns the rows still to be
    searched.
    """
    starts = _runs(key)
    todo = np.ones(len(key), bool)
    for g in np.flatnonzero(np.diff(starts) > over):
        rows = np.arange(starts[g], starts[g + 1])
        flag[order[number[rows]]] = True
        for _ in range(leads):
            if len(rows) < 2:
                break
            c = number[rows]
            lead = rows[np.argmin(order[c])]
            x = number[lead]
            ok = may(c, np.full(len(c), x)) & (rows != lead)
            _improve(best, flag, np.full(ok.sum(), order[x]), order[c[ok]])
            todo[rows[ok]] = False
            rows = rows[~ok & (rows != lead)]
    return todo


def _mixed(key: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of groups that hold more than one state."""
    starts = _runs(key)
    if len(starts) < 2:
        return np.zeros(len(key), bool)
    low, high = np.minimum.reduceat(state, starts[:-1]), np.maximum.reduceat(state, starts[:-1])
    return np.repeat(low != high, np.diff(starts))


def candidate_pairs(classes: DataFrame, t: Threshold, first_round: bool, same_state: bool, wide: bool) -> DataFrame:
    """(a, b): a comes first. In the first round also (a, a) for classes that had more pairs."""
    n = max(buckets(classes.sparkSession), -(-classes.count() // BUCKET_CLASSES))
    return _filed(classes, n, wide).groupBy("bucket").applyInArrow(lambda x: _bucket_pairs(x, t, first_round, same_state, wide), "a long, b long").distinct()


def sketches(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Parity bits of each set's hashed elements: as many as the set is large, rounded up to a power of two, 64 at least."""
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = max(64, 1 << int(b - a - 1).bit_length()) if b > a else 64
        out.append(np.packbits(np.bincount((mix(values[a:b]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes())
    return out


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def prune(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, maybe): whether the parity sketches, which bound the symmetric difference from below, leave a pair open."""

    def run(batches):
        for b in batches:
            ok = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                ok.append((n + m - apart) // 2 >= t.need(n + m))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "maybe"])

    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, maybe boolean")


def _judged(pairs: DataFrame, classes: DataFrame, sets_of, t: Threshold) -> DataFrame:
    """(a, b, alike), written: sketches first, then the sets of those that they leave open."""
    seen = materialize(prune(pairs, classes, t), "pruned")
    left, cut = seen.where("maybe").select("a", "b"), seen.where("NOT maybe").select("a", "b", F.lit(False).alias("alike"))
    if left.isEmpty():
        return materialize(cut, "judged")
    sets = materialize(sets_of(present(ends(left), "id")), "sets")
    out = materialize(verify(left, sets, t, hashed_share).unionByName(cut), "judged")
    discard(seen, sets)
    return out


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def similar(classes: DataFrame, sets_of, t: Threshold, same_state: bool, wide: bool, settle) -> DataFrame:
    """Pairs (a, b) of classes that reach the threshold: enough to settle everything, by the two rounds.

    sets_of(filter) gives (id, tokens) of the classes that a Bloom filter may hold; settle(links) gives (id, state) of
    the classes that the first round's links have settled. Classes without sketches have small sets: words, read once
    for both rounds.
    """
    columns = ["id", "n", "prefix", "vector", "doc", "line", "state"]
    found, sets = materialize(candidate_pairs(classes.select(*columns), t, True, same_state, wide), "pairs"), None
    if found.isEmpty():
        return found
    if "sketch" in classes.columns:
        judge = lambda pairs: _judged(pairs, classes, sets_of, t)
    else:
        sets = materialize(sets_of(present(ends(found), "id")), "sets")
        judge = lambda pairs: materialize(verify(pairs, sets, t, same_share), "judged")
    named = found.where("a = b").select(F.col("a").alias("id"))
    judged = judge(found.where("a <> b"))
    links = judged.where("alike").select("a", "b")
    if not named.isEmpty():
        second = among(classes, named).drop("state").join(settle(links), "id", "left").withColumn("state", F.coalesce("state", F.col("id") if same_state else F.lit(0).cast("long")))
        second = materialize(second.select(*columns), "named")
        rest = materialize(candidate_pairs(second, t, False, same_state, wide).join(judged.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        more = judge(rest)
        links = materialize(links.unionByName(more.where("alike").select("a", "b")), "similar")
        discard(second, rest, more, judged)
    discard(found, sets)
    return links

"""Shared helpers: durable intermediates, word hashing, packed arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, TRIM_EVERY = 1 << 19, 16
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECORDS = "1000"  # rows a record batch: long texts in batches of ten thousand would fill a worker


def tuned(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids and texts; other columns are never read."""
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only in local mode, and where none is set, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_paths: dict[int, str] = {}


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What a query in here shuffles is deleted when it ends; otherwise such files stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = tuned(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in written:
        path = _paths.pop(id(df), None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def carried(docs: DataFrame, carry: list[str] | None) -> tuple[DataFrame, list]:
    """doc_id, text and, with `carry`, a struct `carried` of those columns, so that no name can clash; and its field."""
    if carry is None:
        return docs.select("doc_id", "text"), []
    docs = docs.select("doc_id", "text", (F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))).alias("carried"))
    return docs, [docs.schema["carried"]]


def some_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, the first by a hash of the keys; a threshold on the hash, from one count, comes before the sort."""
    share = min(1.0, (n + 6 * n**0.5 + 10) / max(1, df.count()))
    h = F.xxhash64(*keys)
    return df.where(F.pmod(h, F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(F.pmod(h, F.lit(1 << 40)), *keys).limit(n)


def buckets(spark: SparkSession) -> int:
    """How many parts a shuffle has; follows the cluster's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Give freed memory back to the system; workers live long and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def gathered(batches, limit: int):
    """Record batches joined to about `limit` bytes, as small ones cost more than their share."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_batches(batches, limit: int = 2 << 20):
    """Record batches with about `limit` bytes of text each, so memory doesn't follow text length."""
    for turn, batch in enumerate(gathered(batches, limit)):
        sizes = [len(x) for x in binaries(batch.column("text"))] if batch.num_rows else []
        start = total = 0
        for i, n in enumerate(sizes):
            total += n + 64
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)
        if turn % TRIM_EVERY == TRIM_EVERY - 1:
            trim()
    trim()


_SPACE = bytes(1 if c in (9, 10, 11, 12, 13, 32) else 0 for c in range(256))
_NEXT_SPACE = re.compile(rb"[\t-\r ]")
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_piece(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word's first eight bytes and its length are mixed, then each further eight bytes; long words go through xxh3."""
    flag = np.frombuffer(b"\1" + buf.translate(_SPACE) + b"\1", np.uint8)
    at = np.flatnonzero(flag[1:] != flag[:-1])
    starts, ends = at[::2], at[1::2]
    n = ends - starts
    eight = np.ndarray((len(buf) + 1,), "<u8", buf + bytes(8), strides=(1,))
    h = mix((eight[starts] & _MASKS[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _STEP))
    more, off = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(more):
        h[more] = mix(h[more] * _STEP ^ (eight[starts[more] + off] & _MASKS[np.minimum(n[more] - off, 8)]))
        off += 8
        more = more[n[more] > off]
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
    return starts, ends, h


def hash_words(buf: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a buffer; fold: A-Z count as a-z."""
    if fold:
        buf = buf.lower()
    out, at = [], 0
    while at < len(buf) or not out:
        end = min(len(buf), at + CHUNK)
        if end < len(buf):
            space = _NEXT_SPACE.search(buf, end)
            end = space.start() if space else len(buf)
        s, e, h = _hash_piece(buf[at:end])
        out.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]


class Spans:
    """Hashes of any span of words: spans of 1, 2, 4, ... words are mixed in pairs, any other from the two that cover it."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix(x[: max(0, len(x) - half)] * _STEP + np.roll(x, -half)[: max(0, len(x) - half)]))
        return self.levels[k]

    def __call__(self, i: np.ndarray, j: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the words i..j-1 of each pair (j > i); another salt gives hashes that are independent enough to check them."""
        n = np.asarray(j - i)
        out = np.empty(len(n), np.uint64)
        power = np.frexp(n)[1] - 1
        for k in np.unique(power):
            of = np.flatnonzero(power == k)
            x = self.level(int(k))
            out[of] = mix(mix(x[i[of]] * _STEP + n[of].astype(np.uint64) + np.uint64(salt)) + x[j[of] - (1 << int(k))])
        return out


def words_of(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry than texts)."""
    s, _, h = hash_words(b" ".join(texts), fold)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return h, np.searchsorted(s, offsets)


def pack(*arrays: np.ndarray) -> bytes:
    """Numeric arrays as one compressed blob: byte planes one after the other, which suits sorted keys and small numbers."""
    import zstandard

    head = np.array([len(arrays)] + [y for x in arrays for y in (len(x), ord(x.dtype.char))], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Reads what pack() wrote."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for i in range(n):
        size, kind = int(head[2 * i]), np.dtype(chr(head[2 * i + 1]))
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, kept as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)[0], dtype=np.uint64)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; sorting is several times faster here than hashing them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def crc_mod(doc_id: int | None, mod: int) -> int:
    """crc32 of the id's decimal text modulo `mod`; a null id counts as the text 'None'."""
    return zlib.crc32(str(doc_id).encode()) % mod

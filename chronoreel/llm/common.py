"""What the training-data operators share: written tables, words, links and components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def is_local(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of our own, on a local master alone: no other has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoreel-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tags of tables of whole texts, which stay on disk beside what comes after them and are packed closer.
WHOLE = {"rooted"}


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if tag in WHOLE else None)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    atexit.register(_remove, spark, path)
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote and that nothing reads any more."""
    if path := getattr(df, "_cut_path", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


#: Rows of text that a Python worker gets at once, at most.
BATCH_ROWS = 1_000


#: Bytes of a Parquet row group; each task that writes holds one on the heap.
ROW_GROUP = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold no more than BATCH_ROWS rows, row groups no more than ROW_GROUP bytes; smaller settings stay."""
    for key, most, now in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, None), ("parquet.block.size", ROW_GROUP, "0")):
        if not 0 < int(spark.conf.get(key, now) if now else spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


#: Arrays of so many bytes get memory of their own, which goes back to the system with them.
MAPPED = 1 << 20
#: What modules keep in a worker from task to task.
KEPT: list[dict] = []


def release() -> None:
    """Give back what earlier tasks of this worker, of any operator, have kept. Results never depend on it."""
    for kept in KEPT:
        kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have them
        ctypes.CDLL(None).mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, and heap that holds nothing goes back to the system: it grows by itself, but hardly ever shrinks.

    A task for each core, so that each executor at rest gets some. On a local master the driver's heap is the executor's.
    """
    collect_garbage(spark)
    release()
    if not is_local(spark):
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").collect()


def as_bytes(column: pa.Array) -> list:
    """Values of a string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def split_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts at once: bytes (texts joined by a space), each word's start and end in them, and words per text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    stop = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(start, stop)
    return buf, start, end, np.diff(upto, prepend=0)


#: Bytes up to which words are hashed side by side; longer ones are rare, and hashed one by one.
SHORT = 256


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone: eight bytes at a time go through a finaliser."""
    size = end - start
    h = mix64(size.astype(np.uint64), 3)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    for at in range(0, SHORT, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        x = eight[start[live] + at]
        left = np.minimum(8, size[live] - at)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(np.uint64)
        h[live] = mix64(h[live] ^ x, 4)
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes(), 4)
    return h


class Forest:
    """Union-find over 0..n-1 that takes links by the array; roots are smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


#: Links that are joined in one task; more of them go by rounds of joins.
FEW = 500_000


def _joined(batches):
    """``node, root`` of all links, gathered in one place."""
    release()
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    ends = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
    node, at = np.unique(ends, return_inverse=True)
    hi, lo = at.reshape(ends.shape)
    forest = Forest(len(node))
    forest.link(hi, lo)
    for i in range(0, len(node), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(node[s]), pa.array(node[forest.root[s]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)``; root is the smallest node reachable.

    FEW links or fewer between integers are counted and joined in one task. Others go by
    large-star and small-star rounds over written tables: each round joins every node with
    the least of its neighbours, so a node's links are combined before the exchange and a
    hub's list is never gathered. Ends when a round changes nothing. Null ends are no links.
    """
    spark = edges.sparkSession
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    if {kind for _, kind in e.dtypes} == {"bigint"} and e.count() <= FEW:
        roots = cut(e.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots")
        drop(e)
        return roots
    last = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi")
        new = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(floor.select("hi", "m"))
        old, e = e, cut(new.distinct(), "links")
        drop(old)
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

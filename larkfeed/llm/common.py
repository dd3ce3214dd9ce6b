"""What the operators of this package share: scratch tables, text as numpy arrays, components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a Python worker turns into arrays at once; longer single texts are taken whole.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset
    and all tasks run in this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.larkfeed.scratch", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="larkfeed-")
            spark.conf.set("spark.larkfeed.scratch", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


def write(df: DataFrame, path: str, **options: str) -> None:
    """Write Parquet and let Spark drop the shuffle files of this execution when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared scratch folder: a lost executor costs no recomputation."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with the table's path, for `release`."""
    spark = df.sparkSession
    path = scratch(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_larkfeed_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp()}/larkfeed.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(path)
    sc._larkfeed_shipped = True


def small_batches(spark: SparkSession) -> None:
    """For Python stages: Arrow batches of bounded bytes, so that long texts don't fill a worker. Spark reads these
    settings of the session when a lazy result is run, so they stay; what the user has set otherwise is left alone."""
    ship(spark)
    for key, theirs, ours in (("maxRecordsPerBatch", "10000", "4000"), ("maxBytesPerBatch", str(64 << 20), str(4 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", theirs).lower() in (theirs, "64mb", "9223372036854775807", "2147483647", "-1"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: an operator that adds columns of its own then clashes with none."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


# ---------------------------------------------------------------- text as arrays


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but the excluded ranges (both ends included)."""
    keep = np.ones(256, bool)
    for a, b in excluded:
        keep[a : b + 1] = False
    return keep


ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Byte ranges longer than this are hashed one by one.
LONG = 64
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range. Eight bytes at a time are mixed in, each step a bijection of what went before,
    so no pattern of bytes cancels out as it can in sums of powers; long ranges are hashed by BLAKE2."""
    n = end - start
    wide = np.ndarray((len(buf) + 1,), np.dtype("<u8"), np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(n.astype(np.uint64) * _P + np.uint64(seed))
    left = np.flatnonzero((n > 0) & (n <= LONG))
    at, size = start[left], n[left]
    while len(left):
        h[left] = mix((h[left] ^ (wide[at] & _LOW[np.minimum(size, 8)])) * _Q)
        go = size > 8
        left, at, size = left[go], at[go] + 8, size[go] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    size = 1 << max(20, int(n).bit_length())
    if (k := (int(base), size)) not in _powers:
        for old in [x for x in _powers if x[0] == int(base)]:
            del _powers[old]
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[k] = np.multiply.accumulate(p)
    return _powers[k]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of the byte grams of one buffer, from prefix sums of b[i] * base ** i modulo 2 ** 64. Different grams may
    have equal hashes (patterns that cancel out are known), so these only route; `range_hashes` tells texts apart."""

    def __init__(self, buf: np.ndarray, base: np.uint64 = _P):
        self.base, self.inv = base, inverse(base)
        self.sums = np.empty(len(buf) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(base, len(buf))[: len(buf)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(self.inv, len(self.sums))[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; every row is whole."""
    if not batch.num_rows:
        return
    lengths = np.diff(text_buffer(batch.column(batch.schema.get_field_index(text)))[1])
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def words(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and the total) of the maximal runs of `keep` bytes in each document."""
    inside = keep[buf]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    before = np.empty(len(buf), bool)
    before[:1], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty(len(buf), bool)
    after[-1:], after[:-1] = False, inside[1:]
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _Q + hashes[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    n = max(0, len(x) - w + 1)
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps; minima are aggregated before each join, so that a
    node with very many neighbours is a partial sum or a skewed join that Spark splits, never a group. Whether
    anything has changed is observed while a step is written.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        seen, metrics = Observation(), [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("all")]
        back, path = stored(df.observe(seen, *metrics), name)
        try:
            return back, path, tuple(seen.get.values())
        except Py4JJavaError:  # an empty plan is never observed
            return back, path, (0, None)

    now, path, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while state != seen and state[0]:
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        now, path, state = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(spark, [old])
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

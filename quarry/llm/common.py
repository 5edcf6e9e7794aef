"""What the operators share: shared scratch tables, connected components and vectorised hashing.

Scratch tables cut lineage.  They live below ``spark.checkpoint.dir``, which every executor can read, so a
lost executor costs the tasks that ran on it and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
            sc.setCheckpointDir(base)
            spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one operator run.  ``put`` writes and rereads; ``drop`` frees a table that is not read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}", 0
        _LEFT.append((spark, self.root))

    def put(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder is then left to its owner
            _delete(spark, path)


# ------------------------------------------------------------------------------------------------- batches

CHUNK = 1 << 20


def sized(batch: pa.RecordBatch, column: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together, at least one row each."""
    if not batch.num_rows:
        return
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(n // limit)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, z - a)


# ---------------------------------------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, component)``, the smallest id reachable.

    Alternating large-star and small-star steps; every step is a pre-aggregated minimum and a join, so a hub
    with a third of all edges is split like any skewed join.  Every round but the last makes stars of what is left, so
    rounds grow with the logarithm of the longest chain.  Only nodes that have an edge are returned.
    """
    e = scratch.put(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = scratch.put(small)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        scratch.drop(e)
        e = nxt
        if now == state:
            break
        state = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ------------------------------------------------------------------------------------------------- hashing

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte ranges of one buffer from prefix sums: sum of T[byte] * B^i mod 2^64, shifted to i = 0."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    _seeds: dict[int, tuple[np.ndarray, int]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        if seed not in self._seeds:
            table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD + np.uint64(seed))
            self._seeds[seed] = table, int(mix(np.array([seed * 2 + 77], np.uint64))[0]) | 1
        table, base = self._seeds[seed]
        up, self.down = self._tables(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            inverse = pow(base, -1, 1 << 64)
            pair = []
            for b in (base, inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            cls._powers[base] = (pair[0], pair[1])
        return cls._powers[base]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + _GOLD * (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

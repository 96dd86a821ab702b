"""Helpers that several of the corpus operators share: shared-folder tables and vectorised text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK_DIR = "/tmp/plumbline-checkpoints"
#: A key with more than one in ``HOT`` of the rows is hot; there are fewer than ``HOT`` such keys.
HOT = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as literals of the plan: no RDD and no Python worker behind them."""
    import json

    names = [x.split()[0] for x in schema.split(", ")]
    kind = "array<struct<" + ", ".join(f"{n}: {x.split()[1]}" for n, x in zip(names, schema.split(", "), strict=True)) + ">>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), kind)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves
    as long as driver and executors are one process; on a cluster there is no such folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _FALLBACK_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted through Hadoop's file system when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read that back.

    A lost executor costs the tasks that it ran; it never costs the stages before the cut.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key; the rows of a hot key stay where they are.

    Fewer than ``HOT`` keys have more than one in ``HOT`` of the rows, so their part of the table may
    be broadcast. ``rows`` is read three times and should have been cut.
    """
    least = max(200, rows.count() // HOT)
    hot = rows.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > least).select(*on)
    if hot.isEmpty():
        return rows.join(table, on, how)
    hot = F.broadcast(cut(hot, "hot"))
    there = F.broadcast(table.join(hot, on, "left_semi"))
    return rows.join(hot, on, "left_semi").join(there, on, how).unionByName(rows.join(hot, on, "left_anti").join(table, on, how))


def give_back() -> None:
    """Returns what Arrow and the C library hold of memory that was freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``; its worker gives freed memory back after each task.

    Spark keeps workers for later tasks, and they count towards the executor's memory while they wait.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------------------------
# Vectorised hashing

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_ROLL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_S30, _S27, _S31, _M1, _M2 = (np.uint64(v) for v in (30, 27, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``raw``; equal bytes give equal hashes."""
    power, inverse = _power(len(raw) + 1)
    if not len(start):
        return np.empty(0, np.uint64)
    terms = _BYTE[raw]
    terms *= power[: len(raw)]
    edges = np.empty(2 * len(start), np.int64)
    edges[::2], edges[1::2] = start, end
    if edges[-1] == len(raw):
        terms = np.append(terms, np.uint64(0))
    sums = np.add.reduceat(terms, edges)[::2]
    return mix(sums * inverse[start] + (end - start).astype(np.uint64))


def span_hasher(raw: np.ndarray):
    """A function of (start, end) like ``span_hashes``, for many sets of spans of the same bytes: running sums are taken once."""
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    terms = _BYTE[raw]
    terms *= power[: len(raw)]
    np.cumsum(terms, out=total[1:])

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))

    return hashes


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased, in order."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = spans(raw, ~_SPACE[raw])
    return span_hashes(raw, start, end)


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter, non-empty text is one shingle."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < size:
        seed = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            seed = mix(seed * _ROLL[k % 5] + words[k])
        return seed
    n = len(words) - size + 1
    total = words[:n] * _ROLL[0]
    for k in range(1, size):
        total += words[k : k + n] * (_ROLL[k % 5] + np.uint64(2 * (k // 5)))
    total = mix(total)
    total.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]


def dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions an int key that ``repartition(n, key)`` deals to it.

    Keys 0..n-1 themselves would collide, so that some partitions got several and others none.
    """
    rows = spark.range(0, 64 * n + 64, 1, 1).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    found = {r.p: r.k for r in rows}
    return [found.get(p, 64 * n + 64 + p) for p in range(n)]

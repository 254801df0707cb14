"""What the operators share: shipping code to executors, cutting lineage, filters before joins, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_shipped: set[str] = set()
#: Rows of an Arrow batch at most: rows hold whole texts, so batches of Spark's default 10,000 take much memory.
BATCH, _ROWS = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, whatever the driver's working folder is, and bound its batches."""
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
        spark.conf.set(_ROWS, str(BATCH))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lexloom-")
    path = os.path.join(folder, "lexloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's own (spark.checkpoint.dir). Where none is set, a session on this machine alone, as in
    tests, gets a folder of its own; a cluster must name a shared one.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-checkpoint-"))
    return df.checkpoint(eager=True)


def task(work):
    """A task's Python function, after which its worker gives back to the system what it held. An executor keeps more
    workers than it runs tasks, and idle ones should hold little."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU C library can be told to
                ctypes.CDLL(None).malloc_trim(0)

    return run


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles and checkpoints of frames that are no longer referred to, now rather than
    at the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


BITS = 1 << 22


def bits_of(spots: DataFrame, size: int = BITS):
    """A broadcast bitmap of the column `at` (0..size-1), gathered as bitmaps: of a fixed size whatever the input."""
    at = spots.select((F.col("at") + 1).alias("at"))
    found = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    bits = np.zeros(size // 8 + 4096, np.uint8)
    for r in found:
        # bucket b holds positions (b - 1) * 32768 + 1 .. b * 32768
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return spots.sparkSession.sparkContext.broadcast(bits)


def set_at(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def spot_of(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def sift(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in keys(key), and a few others: a filter before a join moves the rest. Its size is fixed; with
    very many keys it lets all pass, and the join alone decides."""
    shared = bits_of(keys.select(spot_of(key).alias("at")))

    @task
    def run(batches):
        bits = shared.value
        for batch in batches:
            keep = set_at(bits, batch.column(batch.num_columns - 1).to_numpy())
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    return rows.withColumn("__at", spot_of(key)).mapInArrow(run, rows.schema)


class WordCache(dict):
    """word -> value, computed on a miss. Two generations bound its size: when the young one is full it becomes the
    old one, and what is still used moves back, so frequent words stay and memory is bounded."""

    def __init__(self, compute, size: int = 60_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

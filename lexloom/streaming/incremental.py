"""Incremental modes: resumable file streams, windowed counts with watermarks, upserts by key."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.sources.readers import last_by_id


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Process what is new since the last call and append it; a restarted call resumes without repeating a file."""
    transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, *by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select("window.start", *by, "n")


def keep_latest(stream: DataFrame, key: str, order: str, target: str, checkpoint: str, parts: int = 64) -> None:
    """Upsert each batch into the target by key, the highest order winning.

    The target is dealt by a hash of the key into `parts` folders, and only those that a batch touches are rewritten. Each
    version of a part is a folder of its own, and the current ones are named by a manifest that is written last, under a
    number: a run that ends before that leaves the last manifest in force, and a repeated batch gives the same one."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        at, now = _manifest(spark, target)
        if at is not None and n <= at:
            return  # this batch is in force already
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
        batch = batch.withColumn("__part", part).persist()
        touched = [r[0] for r in batch.select("__part").distinct().collect()]
        old = [now[str(p)] for p in touched if str(p) in now]
        rows = batch.unionByName(spark.read.parquet(*old).withColumn("__part", part), allowMissingColumns=True) if old else batch
        last_by_id(rows, key, order).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{target}/v{n}")
        batch.unpersist()
        now = now | {str(p): f"{target}/v{n}/__part={p}" for p in touched}
        _write_text(spark, f"{target}/manifest-{n:012d}.json", json.dumps({"batch": n, "parts": now}))

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The table that keep_latest has in force."""
    _, now = _manifest(spark, target)
    if not now:
        raise ValueError(f"{target} holds no finished batch")
    return spark.read.parquet(*sorted(now.values()))


def _manifest(spark: SparkSession, target: str) -> tuple[int | None, dict[str, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest-*.json")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in found or [])
    if not names:
        return None, {}
    data = json.loads("\n".join(r[0] for r in spark.read.text(names[-1]).collect()))
    return data["batch"], data["parts"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and then moved into place."""
    to = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(to(f"{path}.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to(path), False)
    if not fs.rename(to(f"{path}.tmp"), to(path)):
        raise OSError(f"could not write {path}")

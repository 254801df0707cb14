"""Sources: explicit schemas, provenance, line-aligned texts, archives, logs."""

from __future__ import annotations

import io
import json
import os
import time
import zipfile
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexloom.operators.ordering import record_groups


def read_parquet(spark: SparkSession, path, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(*([path] if isinstance(path, str) else path))


def read_many(spark: SparkSession, pattern: str, full, legacy_lacks: Sequence[str] = ()) -> DataFrame:
    """Many small files in one scan, conformed to `full`: columns that older files lack are null there. Adds
    source_object, schema_shape and year_from_path."""
    rows = spark.read.option("mergeSchema", True).parquet(pattern)
    lacks = [c for c in legacy_lacks if c in rows.columns]
    have = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in full.fields]
    legacy = F.lit(True)
    for c in lacks:
        legacy = legacy & F.col(c).isNull()
    path = F.col("_metadata.file_path")
    year = F.regexp_extract(path, r"year=(\d{4})", 1)
    return rows.select(*have, path.alias("source_object"), F.when(legacy if lacks else F.lit(False), "legacy").otherwise("full").alias("schema_shape"), F.when(year != "", year.cast("int")).alias("year_from_path"))


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the path if it holds a finished write, else build and write it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_ndjson(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def list_objects(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, modified) of the files of a glob; no content is read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_splits(spark: SparkSession, paths: dict[str, str], columns: Sequence[str], schema=None) -> DataFrame:
    """Tables of a dataset's splits as one, with the split's name; each is read for these columns only."""
    out = None
    for split, path in paths.items():
        part = read_parquet(spark, path, schema).select(*columns, F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits")
    return out


def load_config(path: str, key: str = "run_name") -> dict:
    """A run's settings from a YAML (where its library is there) or JSON file, which must name the file's own stem."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: reading YAML takes the yaml library; JSON works without") from e
        data = yaml.safe_load(text)
    stem = os.path.splitext(os.path.basename(path))[0]
    if not isinstance(data, dict) or data.get(key) != stem:
        raise ValueError(f"{path} says {key} {data.get(key) if isinstance(data, dict) else None!r}, not {stem!r}")
    return data


def harvest(fetch: Callable[[int], list[dict]], key: str, tries: int = 5, wait: Callable[[float], None] = time.sleep, pause: float = 1.0) -> list[dict]:
    """All records of a paged service, the last one of each key. fetch(page) gives a page's records, none after the last
    page; what it raises is tried again after twice the pause each time. The service itself is the caller's."""
    records: dict = {}
    page = 0
    while True:
        for attempt in range(tries):
            try:
                found = fetch(page)
                break
            except OSError:
                if attempt == tries - 1:
                    raise
                wait(pause * 2**attempt)
        if not found:
            return list(records.values())
        for r in found:
            records.pop(r[key], None)
            records[r[key]] = r
        page += 1


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, line): split on line feeds only, without a byte order mark, a last empty line not counted.

    The file is read in splits by Spark's text source. A line's number is its place in its block plus the lines of the
    blocks before it, so no task holds more than a block of the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = lines.select(F.col("value"), at.alias("at"), F.monotonically_increasing_id().alias("id"))
    # ids grow within a block; blocks are counted and added up in a small table
    counts = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("at", "first", before.alias("before"))
    number = F.col("before") + F.col("id") - F.col("first")
    text = F.when(number == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return placed.join(starts, "at").select(number.alias("line_no"), text.alias("line"))


def aligned_lines(spark: SparkSession, first: str, second: str, names: tuple[str, str] = ("mk", "sq")) -> DataFrame:
    """Two files paired by line number; unequal counts raise."""
    a, b = numbered_lines(spark, first).withColumnRenamed("line", names[0]), numbered_lines(spark, second).withColumnRenamed("line", names[1])
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"line counts differ: {n} and {m}")
    return a.join(b, "line_no")


def aligned_archive(spark: SparkSession, path: str, ends: tuple[str, str]) -> DataFrame:
    """Line pairs of zip archives that hold one member per side, named by its ending; anything else raises."""

    def unzip(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    sides = [[m for m in z.namelist() if m.endswith(e)] for e in ends]
                    if any(len(s) != 1 for s in sides):
                        raise ValueError(f"{name}: members by side {sides}")
                    streams = [io.TextIOWrapper(z.open(s[0]), "utf-8-sig", newline="\n") for s in sides]
                    buffer, n = [], 0
                    while True:
                        a, b = streams[0].readline(), streams[1].readline()
                        if not a and not b:
                            break
                        if not a or not b:
                            raise ValueError(f"{name}: line counts differ after {n}")
                        buffer.append((name, n, a.rstrip("\n"), b.rstrip("\n")))
                        n += 1
                        if len(buffer) == 200_000:
                            yield pd.DataFrame(buffer, columns=["archive", "line_no", "first", "second"])
                            buffer = []
                    yield pd.DataFrame(buffer, columns=["archive", "line_no", "first", "second"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, line_no long, first string, second string")


def last_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def log_records(lines: DataFrame, stamp: str = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)") -> DataFrame:
    """(record, at, message): a record is a line with a time stamp and the lines after it."""
    at = F.regexp_extract("line", stamp, 1)
    rows = record_groups(lines.withColumn("at", F.when(at != "", at)), "line_no", F.regexp_like("line", F.lit(stamp)))
    return rows.groupBy("record").agg(F.max("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("message"))


def last_invocation(records: DataFrame, begins: str) -> DataFrame:
    """The records from the last one whose message matches; all, if none does."""
    last = records.where(F.regexp_like("message", F.lit(begins))).agg(F.max("record").alias("last")).first()["last"]
    return records if last is None else records.where(F.col("record") >= last)


def find_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate name that the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} in {df.columns}")

"""Sinks. Spark's commit protocol makes each write atomic; reports are one-row or small tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), files: int | None = None) -> None:
    """Zstandard Parquet, partitioned by columns if named. files=1 gives one file."""
    out = df.coalesce(files) if files else df.repartition(*by) if by else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_named(df: DataFrame, folder: str, by: str, name: str = "{}-00000-of-00001.parquet") -> list[str]:
    """One file for each value of a column, under its own name: written beside, then moved, so a file is there whole or not
    at all. For published splits, each of which fits a file."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = to(folder).getFileSystem(conf)
    out = []
    values = [r[0] for r in df.select(by).distinct().orderBy(by).collect()]
    fs.mkdirs(to(folder))
    for value in values:
        part = f"{folder}/.{value}.tmp"
        write_parquet(df.where(F.col(by) == value).drop(by), part, files=1)
        (file,) = [s.getPath() for s in fs.globStatus(to(f"{part}/part-*"))]
        target = to(f"{folder}/{name.format(value)}")
        fs.delete(target, False)
        if not fs.rename(file, target):
            raise OSError(f"could not move {file} to {target}")
        fs.delete(to(part), True)
        out.append(target.toString())
    return out


def write_by_class(df: DataFrame, path: str, by: Sequence[str], columns: Sequence[str], floats: Sequence[str] = ()) -> None:
    """A projection of the table, some columns as 32-bit floats, partitioned by class and split."""
    kept = [F.col(c).cast("float") if c in floats else F.col(c) for c in columns]
    write_parquet(df.select(*kept, *[F.col(c) for c in by if c not in columns]), path, by)


def write_with_dropped(kept: DataFrame, dropped: DataFrame, path: str, sidecar: str, by: Sequence[str] = ()) -> dict[str, int]:
    """The rows kept and, beside them, those that were dropped; counts of both as written."""
    write_parquet(kept, path, by)
    write_parquet(dropped, sidecar)
    spark = kept.sparkSession
    return {"kept": spark.read.parquet(path).count(), "dropped": spark.read.parquet(sidecar).count()}


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read with the written schema, so that partition columns keep their types."""
    return spark.read.schema(schema).parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def verify(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Raise unless the path holds the same schema and rows."""
    again = read_back(spark, path, df.schema)
    if again.exceptAll(df).take(1) or df.exceptAll(again).take(1):
        raise ValueError(f"{path} differs from what was written")


def with_provenance(df: DataFrame, facts: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in facts.items()})


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def gate(df: DataFrame, residual: Column, what: str) -> DataFrame:
    """Refuse to go on while any row still matches."""
    if n := df.agg(F.sum(residual)).first()[0]:
        raise ValueError(f"refusing to write: {n} {what} left")
    return df


def refuse_placeholders(text: str, mark: str = "<FILL_IN") -> str:
    if mark in text:
        raise ValueError(f"refusing to publish: {text.count(mark)} placeholders left")
    return text


def dataset_card(df: DataFrame, split: str, year: str, title: str) -> str:
    """A Markdown card from counts by split and the range of years."""
    rows = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("a"), F.max(year).alias("b")).orderBy(split).collect()
    lines = [f"# {title}", "", "| split | rows | years |", "|---|---|---|", *[f"| {r[0]} | {r['n']:,} | {r['a']}-{r['b']} |" for r in rows]]
    return "\n".join(lines) + "\n"


def markdown_table(rows: Sequence[dict]) -> str:
    head = list(rows[0]) if rows else []
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows]]) + "\n"


def latex_table(rows: Sequence[dict]) -> str:
    head = list(rows[0]) if rows else []
    body = [" & ".join(str(r[c]) for c in head) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", " & ".join(head) + r" \\ \hline", *body, r"\end{tabular}"]) + "\n"


def manifest(facts: dict) -> str:
    return json.dumps(facts, sort_keys=True, ensure_ascii=False, indent=1)

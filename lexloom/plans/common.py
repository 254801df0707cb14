"""Inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned pairs: each turn of a conversation with the next one. (issue, turn, pair_id, mk, sq)."""
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("issue"), "turn", F.col("text").alias("mk"))
    b = c.select(F.col("conv_id").alias("issue"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("sq"))
    return a.join(b, ["issue", "turn"]).select("issue", "turn", (F.col("issue") * 1000 + F.col("turn")).alias("pair_id"), "mk", "sq")

"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe as _bpe, chat, fingerprint, langid, mixing, neardup, quality, repeats, sharding, topk


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs), [F.col("doc_id"), langid.held_out("doc_id").alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, shingle=3)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.read_chats(chat.format_chats(turns.unionByName(extra))))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(documents(spark, sf_dir))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


QUERIES = {"op1_langid": op1_langid, "op4_neardup": op4_neardup, "op9_quality": op9_quality, "op10_fingerprint": op10_fingerprint, "op2_mixing": op2_mixing, "op3_sharding": op3_sharding, "op5_chat": op5_chat, "op6_bpe": op6_bpe, "op7_repeats": op7_repeats, "op8_topk": op8_topk}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op4_neardup": neardup.SQL, "op5_chat": chat.SQL, "op7_repeats": repeats.SQL, "op8_topk": topk.SQL}

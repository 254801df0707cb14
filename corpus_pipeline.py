"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
extra columns, whatever their names, pass through them. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import bpe, langid, mixing, neardup, repeats


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty and blank texts, and those without a letter. Clean documents of any
    language stay. Null languages and ids only teach nothing; repeated rows share their fate; if nothing can be learned
    (no language is given anywhere), every document goes, as none gets a language."""
    named = {c: f"c{n}" for n, c in enumerate(docs.columns)}  # a column of docs may be called as one of the result
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    found = langid.identify(rows, langid.fit(docs), [F.col(n) for n in named.values()], text_col=named["text"])
    return found.where("lang_pred <> 'und'").select(*[F.col(n).alias(c) for c, n in named.items()])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row of the smallest doc_id stays; of
    rows that repeat its id and text, one stays. Rows without an id count one by one, and ids need not differ: a group of
    null ids alone keeps the row of the least hash. Null and blank texts are in no group; of those equal in id and text one
    stays. Other columns decide nothing; of rows equal in id and text any may be the one."""
    return neardup.without_duplicates(docs, percent=80, shingle=5)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat for over 50 words, or for 400 bytes, are cut out of all texts that hold them, also twice in one
    text; documents of which nothing but spaces is left go, null and blank texts among them. n_chars follows the text. Ids
    play no part."""
    left = repeats.without_passages(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.where(F.length(F.trim("text")) > 0).withColumn("n_chars", n_chars).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, every taken copy as a row, in training order. A null source is a source; texts without
    words (null, blank) take no space and stay or go by their place; reruns agree."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every copy. Null and empty texts have none; repeated rows stay repeated."""
    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("repeats", strip_repeats), ("mixing", mix), ("bpe", encode)]
#: SQL expresses neither language ID nor BPE; the pipeline is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""Quality selection by importance resampling.

Two hashed n-gram models (words and word pairs in BUCKETS buckets), one of the target text and one of all raw text,
give each document a log importance weight: the sum over its n-grams of log target - log raw. Gumbel noise from a hash
of the id is added, and the k highest keys are the sample: drawing k documents without replacement by weight.

The target model is fitted on at most TARGET labelled rows of quality 1 (those with the smallest hash of their id), the
raw model counts all documents. The model's size is fixed by BUCKETS.

The cut at k is found by counting: ranges of the key are cut into BINS parts again and again, so no task ranks rows.

Defined results: null text has no n-grams and weight 0; without any target row all weights are 0; ties in the key go to
the smaller hash of the row, and of rows equal in id and text any may be taken; null ids share one noise; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .fingerprint import mix64
from .runtime import cut, ship, task

BUCKETS, TARGET, BINS, SHARE = 1 << 14, 20_000, 4096, 0.5


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the text's words and word pairs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = mix64((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, target: int = TARGET, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, log_weight, key, selected) of every document; about `share` of them, rounded down, are selected."""
    spark = docs.sparkSession
    ship(spark)
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("t_id")).distinct()
    ids = good.orderBy(F.xxhash64("t_id"), "t_id").limit(target)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("is_target"))

    @task
    def count(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, mine in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(ngrams(text.as_py()), minlength=BUCKETS)
                counts[0] += found
                if mine:
                    counts[1] += found
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0][at], pa.int64()), pa.array(counts[1][at], pa.int64())], names=["slot", "raw", "target"])

    found = marked.mapInArrow(count, "slot int, raw long, target long").groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["slot"]], aim[found["slot"]] = found["raw"], found["target"]
    if not aim.sum():
        aim = raw.copy()
    smooth = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = spark.sparkContext.broadcast(np.log((aim + BUCKETS * smooth) / (aim.sum() + BUCKETS)) - np.log(smooth))

    @task
    def weigh(batches):
        table = ratio.value
        for batch in batches:
            weights = [float(table[ngrams(x.as_py())].sum()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), batch.column(2)], names=["doc_id", "log_weight", "tie"])

    u = (F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = rows.withColumn("tie", F.xxhash64("doc_id", "text")).mapInArrow(weigh, "doc_id long, log_weight double, tie long")
    # rows that repeat each other are one with a count until the end
    scored = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u))).groupBy("doc_id", "log_weight", "key", "tie").agg(F.count(F.lit(1)).alias("n"))
    scored = cut(scored)
    k = int((scored.agg(F.sum("n").alias("n")).first()["n"] or 0) * share)
    edge, above = kth_highest(scored, "key", k)
    # rows of the very key of the kth: by the hash of the row, as far as there is room
    equal = scored.where(F.col("key") == F.lit(edge)) if edge is not None else scored.limit(0)
    before = F.coalesce(F.sum("n").over(W.orderBy("tie", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    equal = equal.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k - above) - before)))
    rest = scored if edge is None else scored.where(F.col("key") != F.lit(edge))
    rest = rest.withColumn("taken", F.when(F.lit(edge).isNotNull() & (F.col("key") > F.lit(edge)), F.col("n")).otherwise(0).cast("long"))
    every = rest.unionByName(equal)
    copies = every.select("doc_id", "log_weight", "key", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return copies.select("doc_id", "log_weight", "key", (F.col("copy") <= F.col("taken")).alias("selected"))


def kth_highest(rows: DataFrame, value: str, k: int) -> tuple[float | None, int]:
    """(the kth highest value, rows above it) of rows counted by n; None if there are fewer than k, or k is 0.

    The range that holds it is cut into BINS equal parts, whose counts are all that comes to the driver, and the part that
    holds it is cut again. A part's least and greatest values bound the next range, so it shrinks to one value, wherever
    the values crowd."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.sum("n").alias("n")).first()
    if not k or not ends["n"] or ends["n"] < k:
        return None, 0
    low, high, above = ends["a"], ends["b"], 0
    while low < high:
        width = high / BINS - low / BINS
        spot = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.lit(low)) / F.lit(width or high - low)))).cast("int")
        spot = F.when(F.col(value) == F.lit(high), BINS - 1).when(F.col(value) == F.lit(low), 0).otherwise(spot)
        inside = rows.where((F.col(value) >= F.lit(low)) & (F.col(value) <= F.lit(high)))
        for r in inside.groupBy(spot.alias("bin")).agg(F.sum("n").alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).orderBy(F.desc("bin")).collect():
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low, above

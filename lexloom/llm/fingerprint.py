"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's words (A-Z lower-cased) give shingles of SHINGLE words; a shorter text is one shingle, a text without words
has none. Each shingle is hashed once: the high bits name its bin, and a bin keeps its least hash. An empty bin copies
the full bin that its own hash sequence names first (the same sequence for every document). Of each bin the lowest BITS
bits are kept, packed and written as hexadecimal. Likeness is (matches / BINS - 2^-BITS) / (1 - 2^-BITS), not below 0.

`fingerprint_edits` pairs every document with the next one by descending id. Documents are dealt into ranges of about
RANGE_ROWS of them in the order of id and text hash; the first document of each range is also sent to the range before
it, so every pair meets in one task and each text is moved once. The ranges' edges come from a hashed sample of positions
(id and hash, no texts) of at most some 16 a range. Tasks read their range sorted, a few rows at a time, so a range's size
bounds no memory; beyond MAX_RANGES ranges, they grow.

Defined results: null text is empty; a text without words has the empty fingerprint, of likeness 1 to another empty one
and 0 to any other; null ids come last; rows of equal id are ordered by a hash of their text; a single document is its
own next; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .runtime import ship, task

SHINGLE, BINS, BITS, TRIES = 5, 512, 4, 64
RANGE_ROWS, MAX_RANGES, PER_RANGE = 4000, 1 << 16, 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return mix64(out)


def _walks() -> np.ndarray:
    """Of each bin, the bins that it tries in turn while empty."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(TRIES) + np.arange(TRIES, dtype=np.uint64)
    return (mix64(at + np.uint64(0x632BE59BD9B4E019)) % np.uint64(BINS)).astype(np.int64)


WALKS = _walks()
OWN = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def bins(hashes: np.ndarray) -> np.ndarray | None:
    """The lowest BITS bits of every bin; None without shingles."""
    if not len(hashes):
        return None
    h = np.sort(hashes)
    spot = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    full, value = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    full[spot[first]] = True
    value[spot[first]] = h[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = full[WALKS[empty]]
        t = tries.argmax(axis=1)
        source = WALKS[empty, t]
        lost = ~tries[np.arange(len(empty)), t]
        if lost.any():  # none of its tries is full: the next full bin
            there = np.flatnonzero(full)
            source[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
        value[empty] = value[source]
    # bits of the hash and its bin: a hash that fills several bins, as in short texts, has other chance matches in each
    return (mix64(value ^ OWN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(value: np.ndarray | None) -> str:
    return "" if value is None else (value[0::2] << np.uint8(4) | value[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) of every document."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col), F.col(text_col))

    @task
    def run(batches):
        for batch in batches:
            prints = [pack(bins(shingle_hashes(x.as_py(), shingle))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, fingerprint string")


def rank(doc_id: int | None, tie: int) -> tuple[int, int, int]:
    """A document's place: descending id, null last, then descending hash."""
    return (1, 0, -tie) if doc_id is None else (0, -doc_id, -tie)


def fingerprint_edits(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    spots = rows.select("doc_id", "tie")
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    edges = []
    if ranges > 1:
        part = max(1, n // (ranges * PER_RANGE))
        sample = spots.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit("edge")), F.lit(part)) == 0).distinct().collect()
        ranked = sorted(rank(r["doc_id"], r["tie"]) for r in sample)
        edges = sorted({ranked[len(ranked) * i // ranges] for i in range(1, ranges)}) if ranked else []
    shared = spark.sparkContext.broadcast(edges)

    def place(batches):
        for batch in batches:
            at = [bisect.bisect_right(shared.value, rank(*x)) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["doc_id", "tie", "at"])

    # the first row of each range (id descending, nulls last, then hash): at most MAX_RANGES of them, without texts
    first = spots.mapInArrow(place, "doc_id long, tie long, at int").groupBy("at").agg(F.max(F.struct("doc_id", "tie")).alias("f")).orderBy("at").select("at", "f.doc_id", "f.tie").collect()
    used = [r["at"] for r in first]
    heads = spark.sparkContext.broadcast({(r["doc_id"], r["tie"]): used[i - 1] for i, r in enumerate(first)})

    @task
    def deal(batches):
        for batch in batches:
            spot = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            at = [bisect.bisect_right(shared.value, rank(*x)) for x in spot]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array([False] * len(at))], names=["doc_id", "text", "tie", "at", "end"])
            sent = [i for i, x in enumerate(spot) if x in heads.value]
            if sent:
                to = [heads.value[spot[i]] for i in sent]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(sent)).columns, pa.array(to, pa.int32()), pa.array([True] * len(to))], names=["doc_id", "text", "tie", "at", "end"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, tie long, at int, end boolean")
    dealt = dealt.repartition("at").sortWithinPartitions("at", "end", F.desc_nulls_last("doc_id"), F.desc("tie"))

    @task
    def run(batches):
        held = None
        for batch in batches:
            out = [[] for _ in range(7)]
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text, at, end in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4))):
                    if end and held is None:
                        continue  # a repeated first row
                    own = bins(shingle_hashes(text, shingle))
                    if held is not None:
                        h_id, h_text, h_own = held
                        half = len(h_text) // 2
                        edited = h_text[: len(h_text) - half] + text[:half]
                        e = bins(shingle_hashes(edited, shingle))
                        for col, x in zip(out, (h_id, len(h_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(h_own), pack(e), likeness(h_own, e), likeness(h_own, own))):
                            col.append(x)
                    held = None if end else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, KINDS.values())], names=list(KINDS))

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

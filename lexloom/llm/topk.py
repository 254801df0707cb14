"""Exact top-k inner-product search by ball-tree branch and bound, in shards that share the current kth score.

Candidates are dealt to shards of bounded size by a hash, each once. A shard's candidates stand in a ball tree; for each
query, its nodes are visited in the order of the bound q.c + |q| r, and left out once the bound is under the query's
current kth score, which the leaves raise. Shards are searched in WAVES: after each, a query's best k so far are merged,
and the kth score among them goes with the query to the shards of the next. The first waves are small, so most shards
start from a score that is nearly final. Queries are sent to every shard of a wave and stream through its task; the number
of candidates in a shard grows with the table up to MAX_SHARD, which bounds a task's memory and the queries' copies.

Components are floor(1024 x). Defined results: vectors that are null, hold null or non-finite components, or have a
null id take no part; vectors of another length are no candidates of a query; ties go to the smaller id; of repeated
rows (equal id and vector) a query leaves out one, itself, and each repeated query row gets its own results; an empty
table gives no rows. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut, ship, task

SHARD, MAX_SHARD, LEAF = 8192, 1 << 17, 192
#: Shares of the shards that have been searched after each wave.
WAVES = (1 / 32, 1 / 4, 1.0)
EXACT = float(2**53)


def ball_tree(x: np.ndarray, leaf: int = LEAF):
    """order, and nodes as (start, end, center, radius, left, right); children are -1 in leaves."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        part = x[order[start:end]]
        center = part.mean(axis=0)
        away = np.sqrt(((part - center) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([start, end, center, float(away.max()), -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if end - start > leaf and away.max() > 0:
            a = part[away.argmax()]
            far = ((part - a) ** 2).sum(axis=1)
            axis = part[far.argmax()] - a
            middle = (end - start) // 2
            split = np.argpartition(part @ axis, middle)
            order[start:end] = order[start:end][split]
            todo += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
    return order, nodes


class Shard:
    """Candidates in a ball tree. Repeated vectors of different ids stay; `many` counts repeated (id, vector) rows."""

    def __init__(self, ids, vectors, many):
        by_id = np.argsort(ids, kind="stable")
        ids, vectors, many = ids[by_id], vectors[by_id], many[by_id]
        self.x = vectors.astype(np.float64)
        order, self.nodes = ball_tree(self.x)
        self.ids, self.many, self.x, self.ints = ids[order], many[order], self.x[order], vectors[order]
        self.top = float(np.abs(self.x).max(initial=0)) * self.x.shape[1]
        self.centers = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])

    def scores(self, start, end, q, q_ints):
        if self.top * float(np.abs(q).max(initial=0)) < EXACT:
            return (self.x[start:end] @ q).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(row, q_ints)) for row in self.ints[start:end]], object)

    def search(self, q_id, q_ints, k, kth):
        """The best k as (score, id, copies), at least all with score >= kth among them."""
        q = q_ints.astype(np.float64)
        norm = float(np.sqrt(q @ q))
        bound = self.centers @ q + norm * self.radii
        bound = bound + 1e-9 * (np.abs(bound) + norm * (self.radii + 1)) + 1e-6
        heap, best = [(-bound[0], 0)], []
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            start, end, _, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            found = self.scores(start, end, q, q_ints)
            for i in np.flatnonzero(found >= kth):
                copies = int(self.many[start + i])
                if self.ids[start + i] == q_id and (self.ints[start + i] == q_ints).all():
                    copies -= 1
                if copies:
                    best.append((-int(found[i]), int(self.ids[start + i]), copies))
            best.sort()
            total = 0
            for n, (score, _, copies) in enumerate(best):
                total += copies
                if total >= k:
                    del best[n + 1 :]
                    kth = max(kth, -score)
                    break
        return best


def trees(ids: list[np.ndarray], vectors: list[pa.Array], many: list[np.ndarray]) -> dict[int, Shard]:
    """Of each length of vectors, its candidates."""
    ids_, many_ = np.concatenate(ids), np.concatenate(many)
    sizes = np.concatenate([v.value_lengths().to_numpy() for v in vectors])
    flat = np.concatenate([v.flatten().to_numpy() for v in vectors])
    ends = np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        out[int(n)] = Shard(ids_[own], flat[(ends[own] - n)[:, None] + np.arange(n)].reshape(len(own), int(n)), many_[own])
    return out


FOUND = {"query_id": pa.int64(), "query": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "many": pa.int32()}


def search_shards(candidates: DataFrame, queries: DataFrame, first: int, after: int, k: int) -> DataFrame:
    """(query_id, query, vec_id, score, many): what each query finds in the shards first..after-1, at least all of their
    candidates that belong to its best k. candidates (shard, id, v, many), queries (id, v, query, kth)."""
    own = candidates.where((F.col("shard") >= first) & (F.col("shard") < after)).select("shard", F.lit(0).alias("side"), "id", "v", "many", F.lit(0).cast("long").alias("query"), F.lit(None).cast("long").alias("kth"))
    sent = queries.select(F.explode(F.sequence(F.lit(first), F.lit(after - 1))).alias("shard"), F.lit(1).alias("side"), "id", "v", F.lit(0).alias("many"), "query", "kth")

    @task
    def run(batches):
        at, held, ready = None, ([], [], []), {}
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                shard, side = divmod(int(key[a]), 2)
                if shard != at:
                    at, held, ready = shard, ([], [], []), {}
                if not side:
                    for into, i in zip(held, (2, 3, 4)):
                        into.append(part.column(i) if i == 3 else part.column(i).to_numpy())
                    continue
                if held[0]:
                    ready, held = trees(*held), ([], [], [])
                out = {n: [] for n in FOUND}
                for q_id, v, query, kth in zip(*(part.column(i).to_pylist() for i in (2, 3, 5, 6))):
                    if len(v) in ready:
                        for score, vec_id, copies in ready[len(v)].search(q_id, np.array(v, np.int64), k, -np.inf if kth is None else kth):
                            for n, x in zip(FOUND, (q_id, query, vec_id, -score, copies)):
                                out[n].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, FOUND[n]) for n, x in out.items()], names=list(FOUND))

    dealt = own.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "side")
    return dealt.mapInArrow(run, "query_id long, query long, vec_id long, score long, many int")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, their k best other rows."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long")).alias("v"))
    rows = rows.groupBy("id", "v").agg(F.count(F.lit(1)).cast("int").alias("many"))
    total = vectors.count()
    shards = max(1, -(-total // max(shard, min(MAX_SHARD, total // 4096))))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    # what tells a query: its id, and a hash of its vector for ids that repeat
    asked = rows.where(F.col("id") % every == 0).withColumn("query", F.xxhash64("v", "id"))
    queries, best, first = asked.withColumn("kth", F.lit(None).cast("long")), None, 0
    for after in sorted({min(shards, int(np.ceil(shards * w))) for w in WAVES}):
        found = search_shards(candidates, queries, first, after, k)
        found = found if best is None else best.unionByName(found)
        # of the copies that repeat, more than k of one are never needed
        counted = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id").rowsBetween(W.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum(F.least(F.col("many"), F.lit(k))).over(counted), F.lit(0))
        best = cut(found.withColumn("ahead", ahead).where(F.col("ahead") < k).drop("ahead"))
        kth = best.groupBy("query_id", "query").agg(F.sum("many").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        kth = kth.select(F.col("query_id").alias("id"), "query", "kth")
        queries, first = asked.join(kth, ["id", "query"], "left").select("id", "v", "query", "kth"), after
    copies = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("many", F.lit(k)))))
    ranked = copies.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    again = asked.select(F.col("id").alias("query_id"), "query", F.col("many").alias("query_many"))
    out = ranked.join(again, ["query_id", "query"]).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("query_many"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same result in DuckDB.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

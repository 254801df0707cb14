"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has CELLS cells. Every shard owns VNODES virtual nodes at hashed cells, a key belongs to the next virtual node
clockwise from its cell. By the law `rows` a key's load is its count of rows, and a shard is full at its share of them:
as all capacities together are the number of rows, counts are at most one apart. By the law `bytes` the load is the
size, and a shard is full at (1 + SLACK) of the mean, give or take a document. Of an overfull shard's keys, in ring order,
those within its capacity stay; the rest continue clockwise to virtual nodes whose shards have room. Each shard's room
is dealt evenly to its virtual nodes, and the overflow fills it as a queue that moves around the ring:

    carry(v) = max(0, carry(v-1) + overflow(v) - room(v))

which prefix sums and a running minimum give in closed form over two laps. So balance is guaranteed, and only what
overflows moves.

Rows equal in id, size and text checksum are one weighted key until the end, so repeated rows never gather in a task.
The tables by cell, virtual node and shard have sizes fixed by CELLS, VNODES and the shard count.

Defined results: null text has no bytes (size OVERHEAD) and a null checksum; a null id is a key of its own text; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut

CELLS, VNODES, SLACK, OVERHEAD = 1 << 14, 64, 0.0005, 16


def ring(spark, n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(node, cell, shard): virtual nodes numbered clockwise. n_shards * vnodes rows; a shard's cells don't depend on how
    many other shards there are."""
    nodes = spark.range(0, n_shards * vnodes, 1, 1).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit("node")), F.lit(cells)).alias("cell"), "id")
    return nodes.select("cell", "shard", (F.row_number().over(W.orderBy("cell", "id")) - 1).alias("node"))


def homes(nodes: DataFrame, cells: int = CELLS) -> DataFrame:
    """(cell, node, shard): the next virtual node clockwise of each cell, by wrapping past the last to the first."""
    first = nodes.groupBy("cell").agg(F.min(F.struct("node", "shard")).alias("n"))
    every = nodes.sparkSession.range(0, cells, 1, 1).withColumnRenamed("id", "cell").join(first, "cell", "left")
    # from the last cell down, as a frame that ends at the current row takes one pass
    ahead = F.last("n", ignorenulls=True).over(W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0))
    lowest = F.min("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return every.select("cell", F.coalesce(ahead, lowest).alias("n")).select("cell", "n.node", "n.shard")


def shard(docs: DataFrame, n_shards: int, law: str = "rows", slack: float = SLACK, vnodes: int = VNODES, cells: int = CELLS, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row a document; slot counts a shard's rows from 0."""
    spark = docs.sparkSession
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    keys = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    spot = F.xxhash64("doc_id", "size", "text_crc32")
    keys = keys.withColumn("spot", spot).withColumn("cell", F.pmod("spot", F.lit(cells))).withColumn("unit", F.lit(1).cast("long") if law == "rows" else F.col("size")).withColumn("load", F.col("n") * F.col("unit"))
    nodes = F.broadcast(ring(spark, n_shards, vnodes, cells))
    home = F.broadcast(homes(nodes, cells))
    # at most CELLS rows; all of the ring's arithmetic starts from them, not from the documents
    loads = cut(keys.groupBy("cell").agg(F.sum("load").alias("load")).join(home, "cell").coalesce(1))
    total = F.lit(loads.agg(F.sum("load").alias("total")).first()["total"] or 0).cast("long")
    in_shard = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    # of each cell: what stays, and what overflows
    each, more = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    capacity = each + (F.col("shard") < more).cast("int") if law == "rows" else F.ceil(F.col("total") * F.lit((1 + slack) / n_shards))
    kept = loads.withColumn("total", total).withColumn("capacity", capacity).withColumn("upto", F.sum("load").over(in_shard))
    kept = kept.withColumn("stay", F.greatest(F.lit(0), F.least("load", F.col("capacity") - F.col("upto") + F.col("load"))))
    flow = cut(kept.withColumn("over", F.col("load") - F.col("stay")).coalesce(1))
    by_shard = flow.groupBy("shard").agg(F.sum("stay").alias("held"))
    room = nodes.join(by_shard, "shard", "left").withColumn("total", total).withColumn("capacity", capacity)
    rank = F.row_number().over(W.partitionBy("shard").orderBy("node"))
    free = F.col("capacity") - F.coalesce(F.col("held"), F.lit(0))
    room = room.withColumn("room", F.floor(free * rank / vnodes) - F.floor(free * (rank - 1) / vnodes)).select("node", "shard", "room")
    by_node = flow.groupBy("node").agg(F.sum("over").alias("over"))
    lap = room.join(by_node, "node", "left").withColumn("over", F.coalesce("over", F.lit(0)))
    laps = lap.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    order = W.orderBy("lap", "node")
    laps = laps.withColumn("net", F.sum(F.col("over") - F.col("room")).over(order))
    laps = cut(laps.withColumn("carry", F.col("net") - F.least(F.lit(0), F.min("net").over(order))))
    # the second lap has settled; what leaves node v there is what entered before minus what rooms took
    settled = laps.where("lap = 1").withColumn("ahead", F.first("carry").over(W.orderBy(F.desc("node")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    line = W.orderBy("node")
    settled = settled.withColumn("entered", F.sum("over").over(line)).withColumn("upper", F.col("entered") + F.col("ahead") - F.col("carry"))
    # overflow bytes lie on an axis that starts with what the last lap carried over: [lower, upper) goes to the node
    # whole is taken over all nodes, those that take nothing included: the overflow that entered at the last ones counts
    segments = settled.withColumn("whole", F.max("entered").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    segments = segments.withColumn("lower", F.coalesce(F.lag("upper").over(line), F.lit(0))).where("upper > lower")
    # byte b of the overflow (0 at node 0) is at b + ahead on that axis, and those that wrap are at b + ahead - whole
    spans = segments.select("shard", F.col("lower").alias("lo"), F.col("upper").alias("hi"), "ahead", "whole")
    spans = spans.select("shard", "lo", "hi", "ahead", "whole", F.explode(F.array(F.col("ahead"), F.col("ahead") - F.col("whole"))).alias("shift"))
    spans = spans.select("shard", F.greatest(F.lit(0), F.col("lo") - F.col("shift")).alias("lo"), F.least(F.col("whole"), F.col("hi") - F.col("shift")).alias("hi")).where("hi > lo")
    # cells by the overflow axis: each overflowing cell has [start, start + over) of it; cut it by the nodes' spans
    spill = flow.where("over > 0").withColumn("start", F.sum("over").over(W.orderBy("node", "cell").rowsBetween(W.unboundedPreceding, -1)))
    spill = spill.withColumn("start", F.coalesce("start", F.lit(0))).select("cell", "stay", "start", "over")
    moved = spill.join(F.broadcast(spans), (F.col("lo") < F.col("start") + F.col("over")) & (F.col("hi") > F.col("start")))
    moved = moved.select("cell", "shard", (F.greatest("lo", "start") - F.col("start") + F.col("stay")).alias("lo"), (F.least("hi", F.col("start") + F.col("over")) - F.col("start") + F.col("stay")).alias("hi"))
    stays = flow.where("stay > 0").select("cell", "shard", F.lit(0).cast("long").alias("lo"), F.col("stay").alias("hi"))
    cuts = stays.unionByName(moved).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard"))).alias("cuts"))
    cuts = F.broadcast(cut(cuts.coalesce(1)))
    # rows: bytes before them in their cell, then the copies that start inside each cut
    along = W.partitionBy("cell").orderBy("spot", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    at = keys.withColumn("at", F.coalesce(F.sum("load").over(along), F.lit(0))).join(cuts, "cell")
    hit = F.filter("cuts", lambda c: (c["lo"] < F.col("at") + F.col("load")) & (c["hi"] > F.col("at")))
    first = lambda x: F.ceil(F.greatest(F.lit(0), x - F.col("at")) / F.col("unit"))
    dealt = at.select("doc_id", "size", "text_crc32", "n", "at", "unit", "cell", "spot", F.explode(hit).alias("cut"))
    dealt = dealt.withColumn("copies", F.least("n", first(F.col("cut.hi"))) - first(F.col("cut.lo"))).where("copies > 0")
    dealt = dealt.select("doc_id", "size", "text_crc32", "cell", "spot", "copies", F.col("cut.shard").alias("shard"), F.col("cut.lo").alias("lo"))
    counts = dealt.groupBy("shard", "cell").agg(F.sum("copies").alias("rows"))
    base = counts.withColumn("base", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("shard", "cell").orderBy("lo", "spot", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    slots = dealt.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(base.select("shard", "cell", "base"), ["shard", "cell"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        F.explode(F.sequence(F.col("base") + F.col("before"), F.col("base") + F.col("before") + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Every source has a weight and a schedule of how its rate changes over training time 0..1. Its target is its weight's
share of all words, at most CAP times its own size; what is cut off is shared again by weight. A source's documents
lie one after another, in the order of a hash of their id and text, on the axis of its cumulative words, epoch after epoch; a
copy is taken if its middle lies below the target. The schedule's integral is the source's cumulative demand, so
inverting it at a copy's middle gives the copy's training position, by which the mix is range-sorted.

Prefix sums run in two levels (hash buckets of a source, then rows of a bucket), so a source with a third of all rows
is spread over many tasks. Reruns agree: the order depends on ids and texts only.

Defined results: null text has size 0 and is taken 0 words; a null source is a source, last in order; repeated rows
are separate documents; a source without words gets target 0; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Knots (time, relative rate) of each weight's schedule: heavy sources start strong, light ones end strong.
SCHEDULES = (((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4)))
CAP = 3.0
ROWS_PER_BUCKET = 4000


def invert(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear rate reaches this share (0..1) of its total."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for (t0, a), (t1, b), area in zip(knots, knots[1:], areas):
        rest = F.greatest(share * total - done, F.lit(0.0))
        slope = (b - a) / (t1 - t0)
        time = F.lit(t0) + F.least(F.lit(t1 - t0), 2 * rest / (a + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))))
        done += area
        out = F.when(share * total <= done, time) if out is None else out.when(share * total <= done, time)
    return out.otherwise(F.lit(float(knots[-1][0])))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(s, s_null, source_size) -> with weight class and target. One row a source.

    Sources are filled in the order of cap / weight: with C the caps before one and W the weights from it on, the level
    (total - C) / W rises while sources are capped and falls after, so its maximum is the common level."""
    order, every = W.orderBy("s_null", "s"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("class", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)).withColumn("limit", F.col("source_size") * F.lit(cap))
    by_fill = W.orderBy(F.col("limit") / F.col("weight"), "s_null", "s")
    before = F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap)
    left = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(every)
    level = ranked.withColumn("level", (total - before) / left)
    return level.withColumn("target", F.least("limit", F.col("weight") * F.max("level").over(every))).select("s", "s_null", "class", "source_size", "target")


def plan(docs: DataFrame, payload: dict[str, Column], weights=WEIGHTS, schedules=SCHEDULES, cap: float = CAP, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """A row for each document: payload, size, source_size, target, taken, copies, start, class."""
    rows = docs.count()
    digits = max(0, ceil(log(max(1, rows / ROWS_PER_BUCKET), 16)))
    # a hash of id and text: null ids, or one id of many texts, spread over buckets too
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    base = docs.select(
        *[c.alias(n) for n, c in payload.items()],
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), F.col(source_col).isNull().alias("s_null"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("h"),
    ).withColumn("bucket", F.substring("h", 1, digits))
    by_bucket = base.groupBy("s", "s_null", "bucket").agg(F.sum("size").alias("bucket_size"))
    sized = targets(by_bucket.groupBy("s", "s_null").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    along = W.partitionBy("s", "s_null").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))).join(sized, ["s", "s_null"])
    within = W.partitionBy("s", "s_null", "bucket").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["s", "s_null", "bucket"])
    middle = F.col("bucket_start") + F.col("in_bucket") + F.col("size") / 2
    copies = F.least(F.lit(int(cap)), F.greatest(F.lit(0), F.floor((F.col("target") - middle) / F.col("source_size")) + 1))
    placed = placed.withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(0).cast("int")).withColumn("start", middle)
    return placed.withColumn("taken", F.col("copies") * F.col("size")).select(*payload, "size", "source_size", "target", "taken", "copies", "start", "class")


def position(start: Column, schedules=SCHEDULES) -> Column:
    """Where in training (0..1) a copy comes whose middle is at `start` on its source's axis."""
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), start / F.col("target"))).otherwise(0.0)
    out = F.when(F.col("class") == 0, invert(share, schedules[0]))
    for n, knots in enumerate(schedules[1:], 1):
        out = out.when(F.col("class") == n, invert(share, knots))
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies and the position of its first copy (null if it
    isn't taken), range-sorted by position."""
    id_col = options.get("id_col", "doc_id")
    placed = plan(docs, {"doc_id": F.col(id_col)}, **options)
    out = placed.withColumn("position", F.when(F.col("copies") > 0, position(F.col("start"), options.get("schedules", SCHEDULES))))
    # documents that aren't taken share the null position, and those without words a position: a hash of the id spreads them
    return out.drop("class", "start").repartitionByRange("position", F.xxhash64("doc_id")).sortWithinPartitions("position")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken copy as a row with the columns of docs, in training order."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = plan(docs, {"row": row}, **options).where("copies > 0")
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = position(F.col("start") + F.col("epoch") * F.col("source_size"), options.get("schedules", SCHEDULES))
    return copies.select("row", at.alias("position")).repartitionByRange("position", F.xxhash64(F.col("row").getField(options.get("id_col", "doc_id")))).sortWithinPartitions("position").select("row.*")


#: The same result in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS s_null, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT s, s_null, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY s_null, s) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS lim FROM src),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY lim / weight, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0::DOUBLE)
  / sum(weight) OVER (ORDER BY lim / weight, s_null, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT s, s_null, source_size, least(lim, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY s, s_null ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE AS middle FROM d JOIN t USING (s, s_null))
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN least(3, greatest(0, floor((target - middle) / source_size) + 1)) ELSE 0 END * size)::BIGINT AS taken FROM p
"""

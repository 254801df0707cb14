"""Operators over a total order, without a window over all rows in one task.

Rows are dealt into value ranges by approximate quantiles of the ordering column; sums of the ranges are added up in a
small table, and each range is then summed on its own. A column in which one value is very frequent is aggregated by
value first (see mean_rank), so a range is bounded by the number of its distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

RANGES, ROWS = 4096, 50_000


def ranges(df: DataFrame, order: str, rows: int = ROWS) -> Column:
    """The range (0, 1, ...) of a row's value of a numeric or date column, of about `rows` rows each; nulls come first."""
    n = df.count()
    parts = max(1, min(RANGES, n // rows))
    if parts == 1:
        return F.lit(0)
    number = F.col(order).cast("double")
    edges = df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 10 * parts).alias("e")).first()["e"] or []
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.expr("cast(array() as array<double>)")
    # its place among the edges; no lambda, as the optimizer's constraints lose columns inside one
    return F.coalesce(F.array_position(F.sort_array(F.array_append(cuts, number)), number).cast("int"), F.lit(0))


def running_sum(df: DataFrame, order: str, value: Column, name: str, ties: tuple[str, ...] = (), inclusive: bool = True, rows: int = ROWS) -> DataFrame:
    """df with the sum of `value` over all rows up to (or, if not inclusive, before) each row in the order of a column and
    its ties; 0 where no row comes before."""
    dealt = df.withColumns({"__v": value, "__range": ranges(df, order, rows)})
    sums = dealt.groupBy("__range").agg(F.sum("__v").alias("__sum"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__range").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(starts, "__range")
    return out.withColumn(name, F.col("__start") + F.col("__in")).drop("__v", "__range", "__start", "__in")


def row_numbers(df: DataFrame, order: str, *ties: str, name: str = "row_number", rows: int = ROWS) -> DataFrame:
    """df with the number of each row, from 1, in the order of a column and its ties (a stable total order)."""
    return running_sum(df, order, F.lit(1), name, ties, rows=rows)


def length_batches(df: DataFrame, size: str, key: str, rows: int) -> DataFrame:
    """df with batch numbers from 0: rows in descending size, ties by key, `rows` to a batch."""
    turned = row_numbers(df.withColumn("__down", -F.col(size)), "__down", key, name="__n")
    return turned.withColumn("batch", F.floor((F.col("__n") - 1) / rows).cast("int")).drop("__down", "__n")


def record_groups(lines: DataFrame, line_no: str, starts: Column) -> DataFrame:
    """A record is a starting line with those that follow it."""
    return running_sum(lines, line_no, starts.cast("long"), "record")


def mean_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean_rank): rank of the value from 1, ties sharing their mean. Values are counted first, so the order is over
    distinct values, and a frequent value is one of them."""
    counts = df.groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sum(counts, "__value", F.col("__n"), "__before", inclusive=False)
    ranks = ranked.select("__value", (F.col("__before") + (F.col("__n") + 1) / 2).alias("mean_rank"))
    rows = df.select(key, F.col(value).alias("__value"))
    return rows.join(ranks, rows["__value"].eqNullSafe(ranks["__value"])).select(key, "mean_rank")


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, linear between neighbours, nulls left out; NaN without values. Only the values at the wanted places
    come to the driver, two a quantile; no task gathers the values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, "v", F.col("n"), "before", inclusive=False)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not total:
        return [math.nan] * len(shares)
    spots = [share * (total - 1) for share in shares]
    wanted = sorted({f(x) for x in spots for f in (math.floor, math.ceil)})
    near = F.lit(False)
    for i in wanted:
        near = near | ((F.col("before") <= i) & (F.col("before") + F.col("n") > i))
    rows = ranked.where(near).select("v", "before", "n").collect()
    at = {i: float(r["v"]) for i in wanted for r in rows if r["before"] <= i < r["before"] + r["n"]}
    return [at[math.floor(x)] + (x - math.floor(x)) * (at[math.ceil(x)] - at[math.floor(x)]) for x in spots]


def quantile_bins(df: DataFrame, value: str, bins: int) -> Column:
    """Bin numbers from 0 by quantile edges of the whole column, equal edges merged; the lowest edge belongs to bin 0."""
    inner = sorted(set(quantiles(df, value, [i / bins for i in range(bins + 1)])))[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + (F.col(value) > e).cast("int")
    return out


def separation(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """AUC of value for positive rows: the share of (positive, negative) pairs in order, ties half. Counts by value first,
    so the order is over distinct values."""
    by = df.groupBy(F.col(value).alias("v")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    below = running_sum(by, "v", F.col("n"), "below", inclusive=False)
    return below.withColumn("wins", F.col("p") * (F.col("below") + F.col("n") / 2)).agg(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")).alias("auc"))


# -- logs of a training run: short series, one row a logged step ------------------------------------------------------


class RunningMedian:
    """The median of all values so far, by two heaps."""

    def __init__(self):
        self.low, self.high = [], []  # the lower half negated

    def add(self, x: float) -> None:
        from heapq import heappush, heappushpop

        heappush(self.high, -heappushpop(self.low, -x))
        if len(self.high) > len(self.low):
            from heapq import heappop

            heappush(self.low, -heappop(self.high))

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def value(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def running_flags(df: DataFrame, order: str, value: str, times: float, least: int = 1, below: bool = False, streak: int = 1) -> DataFrame:
    """order, value, median_before, anomalous for a series (a run's log). A value is out if it exceeds `times` the median of
    all before it (with below: is under that), once `least` values came before. A row is anomalous if it completes
    `streak` rows in a row that are out; the count then starts anew. Null values are left out of the median and break no
    streak. The series is read in order by one task, a batch at a time, in n log n steps."""
    schema = T.StructType([df.schema[order], df.schema[value]]).add("median_before", "double").add("anomalous", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held = RunningMedian(), 0
        for pdf in batches:
            medians, flags = [], []
            for x in pdf[value]:
                before = seen.value()
                medians.append(before)
                if pd.isna(x):
                    flags.append(False)
                    continue
                out = before is not None and len(seen) >= least and (x < times * before if below else x > times * before)
                held = held + 1 if out else 0
                flags.append(out and held == streak)
                held = 0 if held == streak else held
                seen.add(float(x))
            yield pd.DataFrame({order: pdf[order], value: pdf[value], "median_before": pd.Series(medians, dtype="float64"), "anomalous": flags})

    return df.select(order, value).repartition(1).sortWithinPartitions(order).mapInPandas(run, schema)

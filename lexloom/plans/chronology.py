"""Queries over issues in time. An order is a pair; its issue is a third of a month, numbered through the year, or, where
inversions are wanted, its customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import chronology as C, relational as R
from .common import table
from .registry import query

ISSUES_SQL = """o AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, o_custkey,
  (month(o_orderdate) * 3 - 2 + least(2, (day(o_orderdate) - 1) // 10))::INTEGER AS no FROM orders),
k AS (SELECT *, format('{:d}-{:04d}', year, no) AS issue_key FROM o),
i AS (SELECT issue_key, year, no, min(month) AS month, count(*) AS pairs FROM k GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (ORDER BY year, no) - 1)::INTEGER AS issue_order FROM i),
c AS (SELECT *, coalesce(sum(pairs) OVER (ORDER BY issue_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(pairs) OVER () AS before FROM r),
s AS (SELECT *, CASE WHEN before < 0.9::DOUBLE THEN 'train' WHEN before < 0.9::DOUBLE + 0.05::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM c)"""


def orders(spark, d):
    """(o_orderkey, filename, slv_identifier, year) in the formats of the sources."""
    o = table(spark, d, "orders")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    no = month * 3 - 2 + F.least(F.lit(2), F.floor((F.dayofmonth("o_orderdate") - 1) / 10))
    return o.select("o_orderkey", "o_custkey", F.format_string("issue_%d.pdf", no.cast("int")).alias("filename"), F.format_string("%d-%d-%d", year, month, F.dayofmonth("o_orderdate")).alias("slv_identifier"), year.alias("year"))


def issues(spark, d):
    pairs = C.add_chronology(orders(spark, d))
    by = pairs.groupBy("issue_key", "year", "issue_no").agg(F.min("issue_month").alias("issue_month"), F.count(F.lit(1)).alias("pairs"))
    ordered = R.issue_order(pairs, "year", "issue_no").select("year", "issue_no", "issue_order")
    return R.cumulative_split(by.join(ordered, ["year", "issue_no"]))


@query(f"WITH {ISSUES_SQL} SELECT o_orderkey, no AS issue_no, month AS issue_month, issue_key FROM k")
def prj1_prj2_chronology(spark, d):
    return C.add_chronology(orders(spark, d)).select("o_orderkey", "issue_no", "issue_month", "issue_key")


@query("SELECT o_orderkey, (o_orderkey % 90)::INTEGER AS page, (o_custkey % 7)::INTEGER AS component FROM orders")
def prj4_page_component(spark, d):
    o = table(spark, d, "orders")
    ids = o.select("o_orderkey", F.format_string("x_12_p%d_c%d", F.col("o_orderkey") % 90, F.col("o_custkey") % 7).alias("id"))
    page, component = C.page_and_component(F.col("id"))
    return ids.select("o_orderkey", page.alias("page"), component.alias("component"))


@query("SELECT o_orderkey, o_orderkey || '_' || (o_custkey % 7) AS pair_id FROM orders")
def prj5_pair_id(spark, d):
    o = table(spark, d, "orders")
    return R.unique_key(o.select("o_orderkey", F.format_string("%d_%d", "o_orderkey", F.col("o_custkey") % 7).alias("pair_id")), "pair_id")


@query(f"WITH {ISSUES_SQL}, g AS (SELECT o_custkey AS no, year, min(month) AS month FROM o GROUP BY ALL) SELECT a.year AS year, count(b.no) AS inversions FROM g a LEFT JOIN g b ON a.year = b.year AND a.no < b.no AND b.month < a.month GROUP BY a.year")
def ag29_month_inversions(spark, d):
    o = table(spark, d, "orders")
    by = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("issue_no")).agg(F.min(F.month("o_orderdate")).alias("issue_month"))
    return C.month_inversions(by)


@query(f"WITH {ISSUES_SQL}, n AS (SELECT unnest(['train', 'dev', 'test']) AS split), b AS (SELECT split, count(*) AS issues, sum(pairs)::BIGINT AS pairs, arg_min(issue_key, issue_order) AS first_issue, arg_max(issue_key, issue_order) AS last_issue, min(year) AS first_year, max(year) AS last_year FROM s GROUP BY split) SELECT n.split AS split, issues, pairs, first_issue, last_issue, first_year, last_year, round(pairs::DOUBLE / sum(pairs) OVER (), 4) AS pct_of_pairs FROM n LEFT JOIN b ON n.split = b.split")
def ag4_split_profile(spark, d):
    found = issues(spark, d)
    C.assert_monotone(found)
    return C.split_profile(C.assert_ordered(found))


@query(f"WITH {ISSUES_SQL} SELECT split, count(*) FILTER (issue_order % 5 = 0) AS leaking_rows, count(*) AS rows, round(count(*) FILTER (issue_order % 5 = 0)::DOUBLE / count(*), 3) AS leak_rate, count(*) FILTER (issue_order % 5 <> 0) AS clean_rows FROM s WHERE split <> 'train' GROUP BY split")
def ag17_leak_rates(spark, d):
    return R.leak_rates(issues(spark, d), "split", F.col("issue_order") % 5 == 0)

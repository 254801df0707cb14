"""Issues in time: parsing their keys, checking their order, and profiles of a split along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .relational import require

#: The formats of file names, identifiers and component ids.
ISSUE_NO = r"_(\d+)\.pdf$"
IDENTIFIER = r"^(\d{4})-(\d{1,2})-(\d+)$"
COMPONENT = r"_p(\d+)_c(\d+)$"
SPLITS = ("train", "dev", "test")


def parsed(text: Column, pattern: str, group: int = 1, kind: str = "int") -> Column:
    """The group's number, null where the pattern doesn't match."""
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x.cast(kind))


def page_and_component(component_id: Column) -> tuple[Column, Column]:
    return parsed(component_id, COMPONENT, 1), parsed(component_id, COMPONENT, 2)


def add_chronology(df: DataFrame, filename: str = "filename", identifier: str = "slv_identifier", year: str = "year") -> DataFrame:
    """Adds issue_no, issue_month and issue_key. Raises, with examples, where a file name or an identifier doesn't parse
    or an identifier is of another year."""
    no, stated, month = parsed(F.col(filename), ISSUE_NO), parsed(F.col(identifier), IDENTIFIER, 1), parsed(F.col(identifier), IDENTIFIER, 2)
    require(df, no.isNull(), "no issue number in the file name", filename)
    require(df, stated.isNull(), "identifiers that are not <year>-<month>-<rank>", identifier)
    require(df, ~stated.eqNullSafe(F.col(year).cast("int")), "identifiers of another year", identifier)
    out = df.withColumns({"issue_no": no, "issue_month": month})
    return out.withColumn("issue_key", F.format_string("%d-%04d", F.col(year).cast("int"), F.col("issue_no")))


def month_inversions(issues: DataFrame, year: str = "year", issue_no: str = "issue_no", month: str = "issue_month") -> DataFrame:
    """(year, inversions): pairs of a year's issues of which the later number has the earlier month. One row an issue comes
    in; twelve running counts a year stand for all pairs."""
    before = W.partitionBy(year).orderBy(issue_no).rowsBetween(W.unboundedPreceding, -1)
    later = F.lit(0)
    for m in range(1, 13):
        held = F.coalesce(F.sum((F.col(month) == m).cast("long")).over(before), F.lit(0))
        later = later + F.when(F.col(month) < m, held).otherwise(0)
    return issues.withColumn("__later", later).groupBy(year).agg(F.sum("__later").alias("inversions"))


def assert_monotone(issues: DataFrame, **names: str) -> DataFrame:
    require(month_inversions(issues, **names), F.col("inversions") > 0, "issue numbers run against the months", names.get("year", "year"))
    return issues


def split_profile(issues: DataFrame) -> DataFrame:
    """Of issues (issue_order, issue_key, year, pairs, split): a row for each of train, dev and test, with the number of
    issues and pairs, the first and last issue, the years, and the share of pairs to four places."""
    spark = issues.sparkSession
    by = issues.groupBy("split").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("pairs").alias("pairs"), F.min_by("issue_key", "issue_order").alias("first_issue"), F.max_by("issue_key", "issue_order").alias("last_issue"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    named = spark.createDataFrame([(i, s) for i, s in enumerate(SPLITS)], "place int, split string")
    out = named.join(by, "split", "left").withColumn("pct_of_pairs", F.round(F.col("pairs") / F.sum("pairs").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 4))
    return out.orderBy("place").drop("place")


def assert_ordered(df: DataFrame, split: str = "split", order: str = "issue_order") -> DataFrame:
    """Every train issue before every dev issue, and these before every test issue; no issue in two splits."""
    bounds = {r[0]: (r[1], r[2]) for r in df.groupBy(split).agg(F.min(order), F.max(order)).collect()}
    present = [s for s in SPLITS if s in bounds]
    for a, b in zip(present, present[1:]):
        if bounds[a][1] >= bounds[b][0]:
            raise ValueError(f"{a} and {b} overlap in time")
    return df

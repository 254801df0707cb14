"""Queries over the relational tables: scans, aggregates, windows, joins."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from lexloom.operators import ordering as O, relational as R
from lexloom.streaming import incremental
from .common import table
from .registry import query


@query("SELECT count(*) AS n FROM lineitem")
def src7_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def src5_src6_pruned_scan(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_orderkey || '-' || lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') AS issue_key FROM orders")
def prj3_issue_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%d-%04d", F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")).alias("issue_key"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN regexp_extract(url, '([0-9]+)[^0-9]*$', 1) = '' THEN NULL ELSE regexp_extract(url, '([0-9]+)[^0-9]*$', 1)::BIGINT END AS last_number FROM pages")
def prj_url_parts(spark, d):
    n = F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.when(n != "", n.cast("long")).alias("last_number"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' END AS flag, 'lineitem' AS source FROM lineitem")
def prj6_prj9_lookup(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"R": "returned", "A": "accepted", "N": "none"}.items() for x in kv])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names[F.col("l_returnflag")].alias("flag"), F.lit("lineitem").alias("source"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, count(DISTINCT l_partkey) AS parts, avg(l_discount) AS disc FROM lineitem GROUP BY ALL")
def ag1_ag2_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.countDistinct("l_partkey").alias("parts"), F.avg("l_discount").alias("disc"))


@query("SELECT lang, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc, min(n_chars) AS lo, max(n_chars) AS hi, median(n_chars) AS med, quantile_cont(n_chars, 0.95) AS p95, avg(n_chars) AS mean FROM documents GROUP BY lang")
def ag3_ag5_profile(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.median("n_chars").alias("med"), F.percentile("n_chars", F.lit(0.95)).alias("p95"), F.avg("n_chars").alias("mean"))


@query("SELECT quantile_cont(l_extendedprice, [0.5, 0.9, 0.95, 0.99, 1.0]) AS q FROM lineitem")
def ag6_quantiles(spark, d):
    found = O.quantiles(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", (0.5, 0.9, 0.95, 0.99, 1.0))
    return spark.createDataFrame([(found,)], "q array<double>")


@query("SELECT source, count(n_chars) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS max FROM documents GROUP BY source")
def ag7_describe(spark, d):
    return R.describe(table(spark, d, "documents"), "n_chars", "source")


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def ag8_crosstab(spark, d):
    return R.crosstab(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de", "es"])


@query("SELECT source, lang, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY source, lang")
def ag9_crosstab_share(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").count()
    return c.select("source", "lang", (F.col("count") / F.sum("count").over(W.partitionBy("lang"))).alias("share"))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE coalesce(lang, '(null)') END AS lang, CASE WHEN grouping(source) = 1 THEN 'total' ELSE coalesce(source, '(null)') END AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def ag10_flt17_margins(spark, d):
    return R.margins(table(spark, d, "documents"), "lang", "source")


@query("SELECT avg(CASE WHEN (l_quantity > 25) <> (l_discount > 0.05) THEN 1.0 ELSE 0.0 END) AS mismatch FROM lineitem")
def ag11_mismatch(spark, d):
    return table(spark, d, "lineitem").agg(F.avg(((F.col("l_quantity") > 25) != (F.col("l_discount") > 0.05)).cast("double")).alias("mismatch"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def ag12_frequencies(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'doc_id' AS column, avg((doc_id IS NULL)::INT) AS null_rate FROM documents UNION ALL SELECT 'text', avg((text IS NULL)::INT) FROM documents UNION ALL SELECT 'lang', avg((lang IS NULL)::INT) FROM documents UNION ALL SELECT 'source', avg((source IS NULL)::INT) FROM documents UNION ALL SELECT 'n_chars', avg((n_chars IS NULL)::INT) FROM documents")
def ag13_null_rates(spark, d):
    return R.null_rates(table(spark, d, "documents"))


@query("SELECT count(*) - count(DISTINCT text) AS repeated_texts, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def ag14_duplicates(spark, d):
    return table(spark, d, "documents").agg((F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated_texts"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated_ids"))


_CUTS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1)


@query("SELECT c AS cutoff, count(*) FILTER (l_discount >= c) AS kept, count(*) FILTER (l_discount >= c AND l_returnflag = 'R') AS true_kept, count(*) FILTER (l_discount >= c AND l_returnflag = 'R')::DOUBLE / count(*) FILTER (l_returnflag = 'R') AS recall, count(*) FILTER (l_discount >= c AND l_returnflag = 'R')::DOUBLE / nullif(count(*) FILTER (l_discount >= c), 0) AS precision FROM lineitem, (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08, 0.1])::DOUBLE AS c) GROUP BY c")
def ag18_ag20_threshold_sweep(spark, d):
    return R.threshold_sweep(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R", _CUTS)


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM documents) SELECT len(list_filter(e[2:len(e) - 1], lambda x: n_chars > x)) AS bin, count(*) AS n, avg(doc_id) AS mean_id FROM documents, e GROUP BY bin")
def ag21_deciles(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(O.quantile_bins(docs, "n_chars", 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("doc_id").alias("mean_id"))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.04 THEN 'tax' END, CASE WHEN l_quantity > 40 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY reason")
def ag22_reasons(spark, d):
    why = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discount"), F.when(F.col("l_tax") > 0.04, "tax"), F.when(F.col("l_quantity") > 40, "quantity")))
    return table(spark, d, "lineitem").select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN b = 0 THEN NULL ELSE a::DOUBLE / b END AS rate FROM (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1)")
def ag27_safe_rate(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("a"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("b"))
    return g.select("o_orderkey", F.try_divide("a", "b").alias("rate"))


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT * FROM (VALUES ('en', 600), ('fr', 150), ('it', 5)) t(lang, n)) SELECT coalesce(s.lang, e.lang) AS lang, coalesce(s.n, 0) AS found, coalesce(e.n, 0) AS expected, coalesce(s.n, 0) - coalesce(e.n, 0) AS delta FROM s FULL JOIN e ON s.lang = e.lang")
def jn7_reconcile(spark, d):
    expected = spark.createDataFrame([("en", 600), ("fr", 150), ("it", 5)], "lang string, n long")
    return R.reconcile(table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), expected, "lang", "n")


@query("SELECT l.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jn1_one_to_one(spark, d):
    """Every label has one document; a repeated key or a lost row raises."""
    return R.join_one_to_one(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def jn3_semi_count(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_partkey = l.l_partkey AND k.l_returnflag = 'R')")
def jn5_struct_anti(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return R.anti_with_check(li, li.where("l_returnflag = 'R'"), "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey")


@query("WITH a AS (SELECT o_custkey AS c, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT o_custkey AS c, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT a.c AS custkey, orders, qty FROM a LEFT JOIN b ON a.c = b.c")
def jn6_aggregate_join(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    b = o.join(li, "o_orderkey").groupBy("custkey").agg(F.sum("l_quantity").alias("qty"))
    return o.groupBy("custkey").agg(F.count(F.lit(1)).alias("orders")).join(b, "custkey", "left")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn8_lookup(spark, d):
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("SELECT l_suppkey, n, coalesce(lag(n) OVER (ORDER BY l_suppkey) - n, 0) AS removed FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def wn6_lag(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("removed", F.coalesce(F.lag("n").over(W.orderBy("l_suppkey")) - F.col("n"), F.lit(0)))


@query("WITH v AS (SELECT l_discount AS v, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1), w AS (SELECT p * (coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) AS wins, p, n FROM v) SELECT sum(wins) / (sum(p) * sum(n))::DOUBLE AS auc FROM w")
def wn7_ev9_separation(spark, d):
    return O.separation(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS mean_rank FROM orders")
def wn7_mean_rank(spark, d):
    return O.mean_rank(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("WITH b AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, user_id FROM events) SELECT user_id, event_id FROM b WHERE r <= 3")
def wn10_latest_three(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query("SELECT vec_id, label, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER (ORDER BY vec_id) AS record FROM embeddings")
def wn12_records(spark, d):
    return O.record_groups(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", F.col("label") == 0)


@query("WITH o AS (SELECT o_orderkey, o_totalprice FROM orders), n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0) SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM o LEFT JOIN n ON o.o_orderkey = n.o_orderkey")
def wn11_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.upsert(o, o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", (F.col("o_totalprice") * 2).cast(o.schema["o_totalprice"].dataType)), "o_orderkey")


@query("SELECT l_suppkey, n, median_before, coalesce(n > median_before * 1.2, false) AS anomalous FROM (SELECT l_suppkey, n, median(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median_before FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1))")
def ag28_running_flags(spark, d):
    return O.running_flags(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey", "n", 1.2)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_windowed_counts(spark, d):
    """Daily counts as the streaming aggregate computes them; the reference has no streams."""
    return incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type")


_SLOW = "WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT l_suppkey, n, row_number() OVER (ORDER BY l_suppkey) AS i, median(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median_before FROM g), s AS (SELECT *, i > 5 AND n < 0.98 * median_before AS slow FROM m), r AS (SELECT *, i - row_number() OVER (PARTITION BY slow ORDER BY i) AS run FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY slow, run ORDER BY i) AS place FROM r) SELECT l_suppkey, n, median_before, slow AND place % 2 = 0 AS anomalous FROM k"


@query(_SLOW)
def ag28_slow_streaks(spark, d):
    """Rows that complete two in a row below a share of the running median."""
    return O.running_flags(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey", "n", 0.98, least=5, below=True, streak=2)


@query("SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS shared, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS only_first, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS only_second")
def st5_key_sets(spark, d):
    """Keys that two tables share, and those that only one has."""
    return R.key_sets(table(spark, d, "lineitem").where("l_returnflag = 'R'"), table(spark, d, "lineitem").where("l_returnflag = 'A'"), "l_partkey")

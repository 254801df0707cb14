"""Queries of filters, sweeps, reports and training sets over aligned pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ordering as O, relational as R, similarity as S
from .common import pairs, table
from .registry import query

#: Pairs with made-up scores: quality, confidence, flag, a language for each side, some letters in another script.
SCORED_SQL = """, s AS (SELECT *, (pair_id % 101) / 101.0::DOUBLE AS score, (pair_id % 37) / 37.0::DOUBLE AS conf, pair_id % 3 = 0 AS hq,
  CASE WHEN pair_id % 10 < 8 THEN 'train' WHEN pair_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split,
  CASE WHEN pair_id % 4 = 0 THEN translate(mk, 'aeocpxin', 'аеосрхии') ELSE mk END AS one,
  CASE pair_id % 9 WHEN 0 THEN 'xx' WHEN 1 THEN NULL ELSE 'aa' END AS lang_one, CASE WHEN pair_id % 13 = 0 THEN 'xx' ELSE 'bb' END AS lang_two FROM p)"""


def scored(spark, d):
    p, i = pairs(spark, d), F.col("pair_id")
    return p.select(
        "*", (i % 101 / 101.0).alias("score"), (i % 37 / 37.0).alias("conf"), (i % 3 == 0).alias("hq"),
        F.when(i % 10 < 8, "train").when(i % 10 == 8, "dev").otherwise("test").alias("split"),
        F.when(i % 4 == 0, F.translate("mk", "aeocpxin", "аеосрхии")).otherwise(F.col("mk")).alias("one"),
        F.when(i % 9 == 0, "xx").when(i % 9 != 1, "aa").alias("lang_one"), F.when(i % 13 == 0, "xx").otherwise("bb").alias("lang_two"),
    )


_N = "len(regexp_extract_all({}, '{}'))"
_LAT, _CYR = "[A-Za-zÇçËë]", "[\\x{0400}-\\x{04FF}]"
_TOK = "round_even(length({}) / {}, 0)"
_WORDS = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(SCORED_SQL + ", f AS (SELECT *, " + _N.format("one", _LAT) + " AS l1, " + _N.format("one", _CYR) + " AS c1, " + _N.format("sq", _LAT) + " AS l2, " + _N.format("sq", _CYR) + " AS c2 FROM s) SELECT pair_id, CASE WHEN trim(one) = '' OR trim(sq) = '' THEN 'empty' WHEN one = sq THEN 'identical' WHEN coalesce(l1::DOUBLE / nullif(l1 + c1, 0), 0) < 0.7 OR coalesce(l2::DOUBLE / nullif(l2 + c2, 0), 0) < 0.7 THEN 'script' WHEN length(one)::DOUBLE / greatest(length(sq), 1) > 2.0 OR length(one)::DOUBLE / greatest(length(sq), 1) < 0.5 THEN 'length_ratio' WHEN " + _WORDS.format("one") + " >= 5 AND lang_one IS DISTINCT FROM 'aa' THEN 'langid_first' WHEN " + _WORDS.format("sq") + " >= 5 AND lang_two IS DISTINCT FROM 'bb' THEN 'langid_second' WHEN " + _TOK.format("one", "3.2") + " > 192 OR " + _TOK.format("sq", "3.6") + " > 192 THEN 'too_long' END AS reject_reason FROM f", pairs=True)
def flt3_flt5_flt6_full_cascade(spark, d):
    """All rules in their order, with given languages and token counts approximated from characters (SF28)."""
    s, one, two = scored(spark, d), F.col("one"), F.col("sq")
    shares = (T.share(one, T.LATIN_NARROW, T.CYRILLIC_NARROW), T.share(two, T.LATIN_NARROW, T.CYRILLIC_NARROW))
    tokens = (T.approx_tokens(one, 3.2), T.approx_tokens(two, 3.6))
    return R.cascade(s, R.pair_rules(one, two, shares, (F.col("lang_one"), F.col("lang_two")), ("aa", "bb"), tokens)).select("pair_id", "reject_reason")


@query(SCORED_SQL + " SELECT pair_id, score < 0.4 AS by_score, NOT hq AS by_flag, hq OR conf >= 0.45 AS kept FROM s", pairs=True)
def flt10_flt12_switches(spark, d):
    s = scored(spark, d)
    by_score, _ = R.alignment_fails(0.4, F.col("score"), F.col("hq"))
    by_flag, _ = R.alignment_fails("flag", F.col("score"), F.col("hq"))
    return s.select("pair_id", by_score.alias("by_score"), by_flag.alias("by_flag"), R.flagged_or_scored(F.col("hq"), F.col("conf")).alias("kept"))


@query(SCORED_SQL + " SELECT pair_id, score FROM s WHERE score >= 0.7", pairs=True)
def flt11_score_threshold(spark, d):
    return scored(spark, d).where(F.col("score") >= 0.7).select("pair_id", "score")


@query(", t AS (SELECT " + _TOK.format("mk", "3.2") + "::INTEGER AS a, " + _TOK.format("sq", "3.6") + "::INTEGER AS b FROM p) SELECT count(*) AS rows, count(*) FILTER (a BETWEEN 40 AND 192 AND b BETWEEN 40 AND 192) AS kept, count(*) FILTER (a < 40) + count(*) FILTER (b < 40) AS too_short, count(*) FILTER (a > 192) + count(*) FILTER (b > 192) AS too_long FROM t", pairs=True)
def flt14_token_window(spark, d):
    return R.token_window(pairs(spark, d), T.approx_tokens(F.col("mk"), 3.2), T.approx_tokens(F.col("sq"), 3.6), 40, 192)[1]


_SWEEP = (0.0, 0.25, 0.5, 0.75, 0.9)


@query(SCORED_SQL + ", t AS (SELECT 'score >= ' || printf('%.2f', c) AS alignment, c, false AS f FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS c) UNION ALL SELECT 'flag', 0, true), k AS (SELECT *, (f AND hq) OR (NOT f AND score >= c) AS keep FROM s, t) SELECT alignment, count(*) FILTER (keep) AS rows, count(*) FILTER (keep)::DOUBLE / count(*) AS pct_of_clean, avg((turn % 4 = 0)::INT) FILTER (keep) AS no_shared_numbers, avg(hq::INT) FILTER (keep) AS flag_share, avg(conf) FILTER (keep) AS mean_confidence, count(*) FILTER (keep AND split = 'train') AS train, count(*) FILTER (keep AND split = 'dev') AS dev, count(*) FILTER (keep AND split = 'test') AS test FROM k GROUP BY alignment", pairs=True)
def ag19_alignment_sweep(spark, d):
    return R.alignment_sweep(scored(spark, d), "score", F.col("hq"), _SWEEP, F.col("turn") % 4 == 0, F.col("conf"), F.col("split"))


_CUTS = (0.2, 0.4, 0.6)
_CUT_SQL = """, w AS (SELECT *, CASE WHEN pair_id % 4 = 0 THEN NULL ELSE pair_id % 8 < 3 END AS verdict,
  [CASE WHEN pair_id % 5 = 0 THEN NULL ELSE (pair_id % 23) / 23.0::DOUBLE END, (pair_id % 19) / 19.0::DOUBLE] AS wrong,
  CASE WHEN length(mk) < 20 THEN '<20' WHEN length(mk) < 80 THEN '20-79' WHEN length(mk) < 300 THEN '80-299' ELSE '300+' END AS bin FROM s),
c AS (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS cutoff), x AS (SELECT *, score >= cutoff AS keep, len(list_filter(wrong, lambda v: v >= cutoff)) AS passing, len(list_filter(wrong, lambda v: v IS NOT NULL)) AS valid FROM w, c)"""


def _wrong():
    i = F.col("pair_id")
    return F.array(F.when(i % 5 != 0, i % 23 / 23.0), i % 19 / 19.0), F.when(i % 4 != 0, i % 8 < 3)


@query(SCORED_SQL + _CUT_SQL + " SELECT cutoff, count(*) FILTER (keep) AS rows_kept, avg(keep::INT) AS share_kept, count(*) FILTER (keep AND hq) AS special_kept, sum(passing)::DOUBLE / sum(valid) AS wrong_passing, count(*) FILTER (verdict AND keep)::DOUBLE / nullif(count(*) FILTER (verdict IS NOT NULL AND keep), 0) AS verdict_kept, count(*) FILTER (verdict AND NOT keep)::DOUBLE / nullif(count(*) FILTER (verdict IS NOT NULL AND NOT keep), 0) AS verdict_dropped FROM x GROUP BY cutoff", pairs=True)
def ag20_cutoff_table(spark, d):
    wrong, verdict = _wrong()
    return R.cutoff_table(scored(spark, d), F.col("score"), _CUTS, F.col("hq"), wrong, verdict)


_BINS = (("<20", "tiny"), ("20-79", "short"), ("80-299", "middle"), ("300+", "long"))


@query(SCORED_SQL + _CUT_SQL + " SELECT cutoff, " + ", ".join(f"sum(keep::INT) FILTER (bin = '{b}')::BIGINT AS {n}_rows_kept, sum(passing) FILTER (bin = '{b}')::DOUBLE / nullif(sum(valid) FILTER (bin = '{b}'), 0) AS {n}_wrong_passing" for b, n in _BINS) + " FROM x GROUP BY cutoff", pairs=True)
def ag20_cutoff_by_bin(spark, d):
    s, (wrong, _) = scored(spark, d), _wrong()
    names = F.create_map(*[F.lit(x) for kv in _BINS for x in kv])
    return R.cutoff_by_bin(s, F.col("score"), _CUTS, names[T.length_bin(F.length("mk"))], [n for _, n in _BINS], wrong)


@query(", b AS (SELECT 'mk' AS src_lang, issue % 4 AS source FROM p UNION ALL SELECT 'sq', issue % 4 FROM p) SELECT 'source' AS kind, source::VARCHAR AS name, count(*) AS examples, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM b GROUP BY source UNION ALL SELECT 'direction', src_lang, count(*), 100.0::DOUBLE * count(*) / sum(count(*)) OVER () FROM b GROUP BY src_lang", pairs=True)
def ag25_composition(spark, d):
    both = R.both_directions(pairs(spark, d).select((F.col("issue") % 4).alias("source"), "mk", "sq"), "mk", "sq", ("mk", "sq"))
    one = lambda kind, c: R.composition(both, c).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), "examples", "pct")
    return one("source", "source").unionByName(one("direction", "src_lang"))


_FIRST_BEST = "SELECT l_suppkey, n FROM g ORDER BY n DESC, l_suppkey LIMIT 1"


@query(f"WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS ({_FIRST_BEST}), t AS (SELECT l_suppkey, n FROM g ORDER BY l_suppkey DESC LIMIT 3) SELECT * FROM b UNION SELECT * FROM t")
def wn10_keep_checkpoints(spark, d):
    return R.keep_checkpoints(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey", "n")


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS row_number FROM documents")
def so2_stable_sort(spark, d):
    return O.row_numbers(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", rows=100)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 32)::INTEGER AS batch FROM documents")
def so4_length_batches(spark, d):
    return O.length_batches(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32).select("doc_id", "batch")


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM documents), b AS (SELECT doc_id, len(list_filter(e[2:len(e) - 1], lambda x: n_chars > x))::INTEGER AS bin FROM documents, e), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha1('42:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT doc_id, bin FROM r WHERE r <= least(20, n)")
def so6_sample_per_decile(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return R.stratified_sample(docs.select("doc_id", O.quantile_bins(docs, "n_chars", 10).alias("bin")), "bin", "doc_id", 1.0, 1, 20)


@query(", x AS (SELECT 'mk-sq' AS direction, pair_id, mk AS src FROM p UNION ALL SELECT 'sq-mk', pair_id, sq FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY sha1('42:' || direction || ':' || pair_id::VARCHAR), pair_id) AS r FROM x) SELECT direction, pair_id, length(src) AS src_chars FROM r WHERE r <= 50", pairs=True)
def so8_sample_and_gather(spark, d):
    """Row ids per direction, then their rows."""
    p = pairs(spark, d)
    ids = R.sample_per_direction(p, "pair_id", 50, ("mk-sq", "sq-mk"))
    return ids.join(p.select("pair_id", "mk", "sq"), "pair_id").select("direction", "pair_id", F.length(F.when(F.col("direction") == "mk-sq", F.col("mk")).otherwise(F.col("sq"))).alias("src_chars"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1('42:' || doc_id::VARCHAR), doc_id) - 1 AS place FROM documents")
def so9_shuffle(spark, d):
    """The place of each row in the shuffled order. The shuffle itself is a range sort; its hash dealt into ranges gives the
    places without one window over all rows."""
    docs = R.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("h", R.hash_order(F.col("doc_id")))
    first = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
    return O.row_numbers(docs.withColumn("first", first), "first", "h", "doc_id", name="place", rows=100).select("doc_id", (F.col("place") - 1).alias("place"))


@query(", x AS (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE (pair_id % 11) / 11.0::DOUBLE END AS a, CASE WHEN pair_id % 7 = 0 THEN NULL ELSE (pair_id % 13) / 13.0::DOUBLE END AS b FROM p) SELECT pair_id, CASE WHEN a >= 0.5 AND b >= 0.5 THEN 'both' WHEN a >= 0.5 THEN 'mk' WHEN b >= 0.5 THEN 'sq' END AS side, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(a, -1) >= coalesce(b, -1) THEN pair_id + 1 ELSE pair_id + 2 END AS match_key FROM x", pairs=True)
def sk8_sk9_sides(spark, d):
    i = F.col("pair_id")
    p = pairs(spark, d).select("pair_id", F.when(i % 5 != 0, i % 11 / 11.0).alias("a"), F.when(i % 7 != 0, i % 13 / 13.0).alias("b"))
    return p.select("pair_id", S.side_label(F.col("a") >= 0.5, F.col("b") >= 0.5).alias("side"), S.best_side_key(F.col("a"), F.col("b"), i + 1, i + 2).alias("match_key"))


@query(None)
def jn9_snk7_near_duplicate_report(spark, d):
    """The report of pairs left out as near copies of train pairs, with the texts that they match. LSH has no SQL; tested
    against brute force."""
    docs = table(spark, d, "documents").select("doc_id", T.norm_lower_ws(F.col("text")).alias("mk"), F.reverse(T.norm_lower_ws(F.col("text"))).alias("sq"), R.hash_split(R.hash_bucket(F.col("doc_id"))).alias("split"))
    out = S.near_duplicate_report(docs, "doc_id", "split", ("mk", "sq"))
    return out.select("doc_id", "split", "side", "near_dup_max_jaccard", "train_match", F.md5("train_match_mk").alias("train_match_mk"), F.md5("train_match_sq").alias("train_match_sq"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn9_fetch_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return R.fetch_rows(docs, "doc_id", table(spark, d, "labels"), "doc_id", {"quality": "quality", "toxic": "toxic"})


@query("SELECT count(*) AS rows FROM lineitem")
def jn15_lined_up(spark, d):
    """The rows of two tables agree position by position; a difference raises."""
    li = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    again = li.repartition("l_partkey").select("at", F.col("l_quantity") + 0.0, "l_shipdate").toDF("at", "l_quantity", "l_shipdate")
    by = ["at"]
    one = li.groupBy(*by).agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate"))
    two = again.groupBy(*by).agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate"))
    R.assert_lined_up(one, two, "at", "l_quantity", "l_shipdate")
    return li.agg(F.count(F.lit(1)).alias("rows"))


@query("WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id, r AS rank, (vec_id + r * 7) % (SELECT count(*) FROM v) AS partner FROM v, (SELECT unnest([1, 2, 3]) AS r) WHERE r <> 2 OR vec_id % 2 = 0), c AS (SELECT q.vec_id AS vec_id, rank, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM q JOIN v a ON a.vec_id = q.vec_id JOIN v b ON b.vec_id = q.partner) SELECT vec_id, round(max(c) FILTER (rank = 1), 9) AS c1, round(max(c) FILTER (rank = 2), 9) AS c2, round(max(c) FILTER (rank = 3), 9) AS c3 FROM c GROUP BY vec_id")
def sk12_partner_cosines(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = v.count()
    q = v.select("vec_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).where("rank <> 2 or vec_id % 2 = 0").withColumn("partner", (F.col("vec_id") + F.col("rank") * 7) % n)
    out = S.partner_cosines(v, "vec_id", "embedding", q, 3)
    return out.select("vec_id", *[F.round(F.col("cosines")[r], 9).alias(f"c{r + 1}") for r in range(3)])


@query("SELECT doc_id, ('0x' || substr(sha1(text), 1, 15))::BIGINT AS code FROM documents")
def sk16_factor_codes(spark, d):
    return S.factor_codes(table(spark, d, "documents"), F.col("text")).select("doc_id", "code")


@query("WITH b AS (SELECT item_id, sha256('[\"' || item_id || '\", \"' || replace(text, chr(10), '\\n') || '\"]') AS h FROM benchmark) SELECT sha256(unhex(string_agg(h, '' ORDER BY item_id))) AS digest FROM b")
def sk15_content_digest(spark, d):
    digest = S.content_sha256(table(spark, d, "benchmark"), "item_id", "item_id", "text")
    return spark.createDataFrame([(digest,)], "digest string")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, '{\"event\":' || event_id || ',\"k\":' || (props->>'k') || '}' AS encoded FROM events")
def sf30_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("event_id").alias("event"), "k")).alias("encoded"))


@query("WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' WHEN 'P' THEN 'test' END AS split FROM orders) SELECT split, count(*) AS n FROM f GROUP BY split")
def prj6_split_names(spark, d):
    """Labels are renamed; an unknown one raises."""
    out = R.renamed(table(spark, d, "orders"), "o_orderstatus", {"F": "train", "O": "validation", "P": "test"}, "split")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT corpus, pairs FROM (SELECT source AS corpus, count(*) FILTER (n_chars > 300) AS pairs FROM documents GROUP BY source) WHERE pairs > 0 AND upper(replace(replace(corpus, '-', ''), '_', '')) NOT IN ('SRC3', 'SRC5')")
def src17_catalogue(spark, d):
    """Corpora by size, smallest first, without evaluation sets and empty ones."""
    c = table(spark, d, "documents").groupBy(F.col("source").alias("corpus")).agg(F.sum((F.col("n_chars") > 300).cast("long")).alias("pairs"))
    return R.catalogue(c, "corpus", "pairs", ["SRC-3", "src_5"])


@query("SELECT sum(len(regexp_extract_all(text, ' e'))) AS gone_before, 0 AS gone_after, 0 AS added_before, sum(len(regexp_extract_all(text, ' e'))) AS added_after FROM documents")
def ag24_conservation(spark, d):
    docs = table(spark, d, "documents").select("text")
    return R.conserved(docs, docs.select(F.regexp_replace("text", " e", "Ѐ").alias("text")), "text", " e", "Ѐ")


_X = " N[ fjal[ve [1] Shqipрi 1234567890123 AB1234567 "
_RULES_SQL = """WITH t AS (SELECT doc_id, text || ' N[ fjal[ve [1] Shqipрi 1234567890123 AB1234567 ' AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, x, regexp_replace(regexp_replace(x, '([A-Za-zÇçËë])\\[', '\\1ë', 'g'), '\\[([A-Za-zÇçËë])', 'ë\\1', 'g') AS y,
  regexp_replace(regexp_replace(x, '(^|[^0-9])[0-9]{13}([^0-9]|$)', '\\1[ID-NUMBER]\\2', 'g'), '(^|[^\\p{L}\\p{N}_])[A-Za-z]{1,2}[0-9]{6,9}($|[^\\p{L}\\p{N}_])', '\\1[DOC-NUMBER]\\2', 'g') AS z FROM t)
SELECT doc_id, md5(replace(y, 'Shqipрi', 'Shqippi')) AS repaired, md5(z) AS redacted, len(regexp_extract_all(z, '\\[ID-NUMBER\\]')) AS ids, len(regexp_extract_all(z, '\\[DOC-NUMBER\\]')) AS documents, 0 AS residual, true AS is_redacted FROM r"""


@query(_RULES_SQL)
def sf16_sf17_sf19_release_rules(spark, d):
    """Repair, folding, redaction and its counts, over texts with something to repair."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(_X)).alias("x"))
    x = F.col("x")
    counts, redacted = T.redaction_counts(x), T.redact(x)
    return docs.select("doc_id", F.md5(T.fold_mixed_words(T.repair_bracket(x))).alias("repaired"), F.md5(redacted).alias("redacted"), counts["national_id"].alias("ids"), counts["passport"].alias("documents"), T.residual_identifiers(redacted).alias("residual"), T.is_redacted(redacted, F.lit("")).alias("is_redacted"))


@query("WITH c AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN ['issued in the name of'] WHEN 1 THEN ['lost document notice', 'passport'] WHEN 2 THEN ['diploma / certificate', 'lost'] WHEN 3 THEN ['declared invalid'] WHEN 4 THEN ['passport', 'identity card'] ELSE [] END AS cues FROM c")
def flt16_person_cues(spark, d):
    k = F.col("doc_id") % 6
    first = F.when(k == 0, "Издаден НА  ИМЕ Петар").when(k == 1, "ИЗГУБЕН пасош").when(k == 2, "диплома").otherwise("закон")
    second = F.when(k == 2, "i  humbur").when(k == 3, "shpallet i pavlefshëm").when(k == 4, "LETËRNJOFTIM, pasaporta").otherwise("ligj")
    return table(spark, d, "documents").select("doc_id", T.person_cues(first, second).alias("cues"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'word ' || doc_id WHEN 1 THEN 'ar' || doc_id WHEN 2 THEN 'alternative' WHEN 3 THEN 'x (y) z' ELSE 'ABCD' END AS headword FROM documents")
def sf22_headwords(spark, d):
    k = F.col("doc_id") % 5
    entry = F.when(k == 0, F.concat(F.lit(" word  "), "doc_id", F.lit(" (A) ; (b c),"))).when(k == 1, F.concat(F.lit("ar"), "doc_id", F.lit(",-i, -ja ")))
    entry = entry.when(k == 2, "ALTERNATIVE,-A (X);").when(k == 3, "x (y) z (n.),").otherwise("ABCD:")
    return table(spark, d, "documents").select("doc_id", T.clean_headword(entry).alias("headword"))

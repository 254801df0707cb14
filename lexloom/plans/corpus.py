"""Queries over texts and aligned pairs."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from lexloom.functions import text as T
from lexloom.operators import relational as R, similarity as S
from .common import pairs, table
from .registry import query

WS = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDS = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"
JACC = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN NULL WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@query("SELECT pair_id, length(mk) AS mk_chars, length(sq) AS sq_chars, " + WORDS.format("mk") + " AS mk_words, " + WORDS.format("sq") + " AS sq_words, CASE WHEN greatest(length(mk), length(sq)) > 0 THEN least(length(mk), length(sq))::DOUBLE / greatest(length(mk), length(sq)) ELSE 0.0 END AS length_ratio FROM p", pairs=True)
def sf1_sf2_lengths(spark, d):
    p = pairs(spark, d)
    return p.select("pair_id", F.length("mk").alias("mk_chars"), F.length("sq").alias("sq_chars"), T.word_count(F.col("mk")).alias("mk_words"), T.word_count(F.col("sq")).alias("sq_words"), T.length_ratio(F.col("mk"), F.col("sq")).alias("length_ratio"))


_L, _C = "len(regexp_extract_all({}, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]'))", "len(regexp_extract_all({}, '[\\x{{0400}}-\\x{{052F}}]'))"
_share = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN {a}::DOUBLE / ({a} + {b}) END"


@query("SELECT doc_id, " + _share(_L.format("text"), _C.format("text")) + " AS latin_share, (coalesce(" + _share(_C.format("text"), _L.format("text")) + ", 0.5) + coalesce(" + _share(_L.format("text"), _C.format("text")) + ", 0.5)) / 2 AS script_purity FROM documents")
def sf3_sf4_script_shares(spark, d):
    x = F.col("text")
    latin, cyr = T.share(x, T.LATIN_WIDE, T.CYRILLIC_WIDE), T.share(x, T.CYRILLIC_WIDE, T.LATIN_WIDE)
    return table(spark, d, "documents").select("doc_id", latin.alias("latin_share"), T.script_purity(cyr, latin).alias("script_purity"))


_NUM = r"regexp_extract_all({}, '\d+(?:[./\-]\d+)*')"
_RICH = r"regexp_extract_all({}, '\d+(?:[./\-]\d+)+|\d{{3,}}')"


_NUMBERED = ", q AS (SELECT pair_id, mk || ' 12 25-309/' || (pair_id % 3) || ' x' || (pair_id % 5) AS mk, sq || ' 25-309/' || (pair_id % 2) || ' 12 y' || (pair_id % 4) AS sq FROM p WHERE pair_id % 7 <> 0 UNION ALL SELECT pair_id, mk, sq FROM p WHERE pair_id % 7 = 0)"


def _numbered(spark, d):
    """Pairs whose texts mention numbers, but for one in seven."""
    p, i = pairs(spark, d), F.col("pair_id")
    mk, sq = F.concat("mk", F.lit(" 12 25-309/"), i % 3, F.lit(" x"), i % 5), F.concat("sq", F.lit(" 25-309/"), i % 2, F.lit(" 12 y"), i % 4)
    return p.withColumns({"mk": F.when(i % 7 != 0, mk).otherwise(F.col("mk")), "sq": F.when(i % 7 != 0, sq).otherwise(F.col("sq"))})


@query(_NUMBERED + ", n AS (SELECT pair_id, " + _NUM.format("mk") + " AS a, " + _NUM.format("sq") + " AS b, " + _RICH.format("mk") + " AS x, " + _RICH.format("sq") + " AS y, regexp_extract_all(mk, '[0-9]+') AS r, regexp_extract_all(sq, '[0-9]+') AS t FROM q), o AS (SELECT *, " + JACC.format(a="a", b="b") + " AS j FROM n) SELECT pair_id, len(a) AS mk_numerals, j AS numeric_overlap, CASE WHEN j IS NULL THEN 'no numerals' WHEN j = 1 THEN 'full' WHEN j = 0 THEN 'none' ELSE 'partial' END AS category, CASE WHEN len(x) = 0 OR len(y) = 0 THEN NULL ELSE NOT list_has_any(x, y) END AS contradicts, list_sort(r) = list_sort(t) AS same_runs FROM o", pairs=True)
def sf5_sf7_sf9_numerals(spark, d):
    mk, sq = F.col("mk"), F.col("sq")
    a, b = T.numerals(mk), T.numerals(sq)
    p = _numbered(spark, d).select("pair_id", F.size(a).alias("mk_numerals"), T.set_jaccard(a, b).alias("numeric_overlap"), T.contradicts(mk, sq).alias("contradicts"), T.same_digit_runs(mk, sq).alias("same_runs"))
    return p.withColumn("category", T.overlap_category(F.col("numeric_overlap")))


_QUALITY_SQL = ", q AS (SELECT pair_id, " + JACC.format(a=_NUM.format("mk"), b=_NUM.format("sq")) + " AS j, CASE WHEN greatest(length(mk), length(sq)) > 0 THEN least(length(mk), length(sq))::DOUBLE / greatest(length(mk), length(sq)) ELSE 0.0 END AS lr, trim(mk) = '' OR trim(sq) = '' AS empty, ((pair_id % 97) / 97.0)::DOUBLE AS conf, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE ((pair_id % 31) / 31.0)::DOUBLE END AS ocr_a, CASE WHEN pair_id % 7 = 0 THEN NULL ELSE ((pair_id % 13) / 13.0)::DOUBLE END AS ocr_b FROM p), m AS (SELECT pair_id, greatest(0.0, least(1.0, (conf - 0.76::DOUBLE) / (0.95::DOUBLE - 0.76::DOUBLE))) * (CASE WHEN ocr_a IS NULL AND ocr_b IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, (least(ocr_a, ocr_b) - 0.5::DOUBLE) / (0.85::DOUBLE - 0.5::DOUBLE))) END) * (CASE WHEN conf < 0.76::DOUBLE THEN 0.35::DOUBLE ELSE 1.0 END) * (CASE WHEN empty THEN 0.0 ELSE 1.0 END) AS matcher_term, coalesce(j, 0.5) * 0.35::DOUBLE + 0.5 * 0.3::DOUBLE + 0.5 * 0.2::DOUBLE + lr * 0.15::DOUBLE AS text_term FROM q) SELECT pair_id, matcher_term, text_term, sqrt(matcher_term * text_term) AS quality_confidence FROM m"


@query(_QUALITY_SQL, pairs=True)
def p1_quality_score(spark, d):
    """SF12-SF14: the quality score of each pair; the matcher's confidences are derived from the pair id."""
    p = pairs(spark, d)
    frac = lambda n: (F.col("pair_id") % n) / float(n)
    mk, sq = F.col("mk"), F.col("sq")
    a, b = F.when(F.col("pair_id") % 5 != 0, frac(31)), F.when(F.col("pair_id") % 7 != 0, frac(13))
    p = p.select("pair_id", T.matcher_term(frac(97), a, b, T.gale_church_inferred(F.lit("other"), frac(97)), (F.trim(mk) == "") | (F.trim(sq) == "")).alias("matcher_term"), T.text_term(
        numeric_overlap=F.coalesce(T.set_jaccard(T.numerals(mk), T.numerals(sq)), F.lit(T.NO_EVIDENCE)), lingua_agreement=F.lit(0.5), script_purity=F.lit(0.5), length_ratio=T.length_ratio(mk, sq)).alias("text_term"))
    return p.withColumn("quality_confidence", F.sqrt(F.col("matcher_term") * F.col("text_term")))


_ODD_SQL = ", q AS (SELECT pair_id, CASE pair_id % 5 WHEN 0 THEN '' WHEN 1 THEN '12 !' WHEN 2 THEN upper(sq) || '!' ELSE mk END AS mk, sq FROM p), f AS (SELECT *, trim(mk) = '' OR trim(sq) = '' AS e, trim(regexp_replace(regexp_replace(replace(lower(mk), 'ß', 'ss'), '[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\v]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(replace(lower(sq), 'ß', 'ss'), '[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\v]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS b FROM q)"


@query(_ODD_SQL + " SELECT pair_id, e AS either_empty, length(mk) < 20 OR length(sq) < 20 AS very_short, NOT regexp_matches(mk, '\\p{L}') OR NOT regexp_matches(sq, '\\p{L}') AS no_letters, mk = sq AND NOT e AS copy_through, a = b AND NOT e AS copy_through_norm FROM f", pairs=True)
def sf15_degeneracy(spark, d):
    """All five flags, over pairs of which some are blank, without letters or copied in capitals."""
    k = F.col("pair_id") % 5
    odd = pairs(spark, d).withColumn("mk", F.when(k == 0, "").when(k == 1, "12 !").when(k == 2, F.concat(F.upper("sq"), F.lit("!"))).otherwise(F.col("mk")))
    flags = T.degeneracy(F.col("mk"), F.col("sq"))
    return odd.select("pair_id", *[c.alias(n) for n, c in flags.items()])


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS lower_ws, md5(trim(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS digit0 FROM documents")
def sf_normal_forms(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.norm_lower_ws(x).alias("lower_ws"), F.md5(T.norm_lower_digit0(x)).alias("digit0"))


_SPACED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("WITH x AS (SELECT doc_id, text || ' ﬁne Straße e' || chr(769) AS t FROM documents) SELECT doc_id, md5(" + _SPACED.format("replace(replace(lower(nfc_normalize(t)), 'ß', 'ss'), 'ﬁ', 'fi')") + ") AS nfkc, md5(" + _SPACED.format("lower(nfc_normalize(t))") + ") AS nfc, md5(" + _SPACED.format("regexp_replace(replace(replace(lower(t), 'ß', 'ss'), 'ﬁ', 'fi'), '[^\\p{L}\\p{M}\\p{N}_ \\t\\n\\r\\f\\v]', '', 'g')") + ") AS nopunct, md5(trim(regexp_replace(replace(replace(lower(t), 'ß', 'ss'), 'ﬁ', 'fi'), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'))) AS nonword FROM x")
def sf_unicode_forms(spark, d):
    """NFKC-casefold, NFC-lower and the two casefolds without punctuation, over texts with a ligature, a sharp s and a
    combining accent."""
    x = F.col("t")
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" ﬁne Straße e\u0301")).alias("t"))
    return docs.select("doc_id", F.md5(T.norm_nfkc_casefold(x)).alias("nfkc"), F.md5(T.norm_nfc_lower(x)).alias("nfc"), F.md5(T.norm_casefold_nopunct(x)).alias("nopunct"), F.md5(T.norm_casefold_nonword(x)).alias("nonword"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS dup_key, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 60) AS preview, CASE WHEN length(text) < 20 THEN '<20' WHEN length(text) < 80 THEN '20-79' WHEN length(text) < 300 THEN '80-299' ELSE '300+' END AS length_bin, CASE WHEN doc_id % 4 = 0 THEN 1.0 WHEN doc_id % 4 = 1 THEN 0.4 WHEN doc_id % 4 = 2 THEN 0.5 ELSE 0.0 END AS language_score FROM documents")
def sk13_sf23_sf26_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", S.text_key(F.col("text")).alias("dup_key"), T.preview(F.col("text")).alias("preview"), T.length_bin(F.length("text")).alias("length_bin"), T.language_score(F.element_at(F.array(*map(F.lit, ("MK", "SR", None, "BG"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("language_score"))


@query("SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS bucket, CASE WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'train' WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 95 THEN 'dev' ELSE 'test' END AS split FROM documents")
def sk14_hash_split(spark, d):
    b = R.hash_bucket(F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", b.alias("bucket"), R.hash_split(b).alias("split"))


@query("WITH s AS (SELECT doc_id, sha1(text) AS k, CASE WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'eval' END AS split FROM documents) SELECT doc_id, split, count(*) OVER (PARTITION BY k) AS copies, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY k) = 1 AND split <> 'train' AS leaks FROM s")
def sk17_ag15_leaks(spark, d):
    """Evaluation rows whose text occurs in train. Counts by text first, then joined back, so a hot text stays spread."""
    s = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("k"), F.when(R.hash_bucket(F.col("doc_id")) < 90, "train").otherwise("eval").alias("split"))
    by = s.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("split") == "train").alias("in_train"))
    return s.join(by, "k").select("doc_id", "split", "copies", (F.col("in_train") & (F.col("split") != "train")).alias("leaks"))


@query("WITH s AS (SELECT doc_id, sha1(text) AS k, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, source, doc_id) AS r FROM documents) SELECT doc_id, r AS dup_rank FROM s")
def wn3_duplicate_rank(spark, d):
    s = table(spark, d, "documents").withColumn("k", F.sha1("text"))
    return R.duplicate_rank(s, ["k"], [F.desc("n_chars"), F.asc("source"), F.asc("doc_id")]).select("doc_id", "dup_rank")


@query("SELECT source, count(*) AS kept FROM (SELECT source, row_number() OVER (PARTITION BY sha1(text) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, source, doc_id) AS r FROM documents) WHERE r = 1 GROUP BY source")
def wn4_wn5_priority_dedup(spark, d):
    s = table(spark, d, "documents").select("doc_id", "source", F.sha1("text").alias("k"))
    return R.best_copy(s, ["k"], [F.when(F.col("source") == "src0", 0).otherwise(1), F.asc("source"), F.asc("doc_id")]).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


_CASCADE_SQL = "CASE WHEN trim(mk) = '' OR trim(sq) = '' THEN 'empty' WHEN mk = sq THEN 'identical' WHEN length(mk)::DOUBLE / greatest(length(sq), 1) > 2.0 OR length(mk)::DOUBLE / greatest(length(sq), 1) < 0.5 THEN 'length_ratio' END"


def _rules():
    ratio = F.length("mk") / F.greatest(F.length("sq"), F.lit(1))
    return [("empty", (F.trim("mk") == "") | (F.trim("sq") == "")), ("identical", F.col("mk") == F.col("sq")), ("length_ratio", (ratio > 2.0) | (ratio < 0.5))]


@query("SELECT coalesce(" + _CASCADE_SQL + ", 'kept') AS reason, count(*) AS n FROM p GROUP BY ALL", pairs=True)
def flt1_flt7_cascade(spark, d):
    return R.cascade(pairs(spark, d), _rules()).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(", s AS (SELECT count(*) AS r0, count(*) FILTER (length(mk) >= 100) AS r1, count(*) FILTER (length(mk) >= 100 AND length(sq) >= 100) AS r2, count(*) FILTER (mk LIKE '%.%') AS f0, count(*) FILTER (mk LIKE '%.%' AND length(mk) >= 100) AS f1, count(*) FILTER (mk LIKE '%.%' AND length(mk) >= 100 AND length(sq) >= 100) AS f2 FROM p) SELECT 0 AS step_no, 'start' AS step, r0 AS rows, f0 AS flagged, 0 AS removed, r0::DOUBLE / r0 AS pct_of_start FROM s UNION ALL SELECT 1, 'mk', r1, f1, r0 - r1, r1::DOUBLE / r0 FROM s UNION ALL SELECT 2, 'sq', r2, f2, r1 - r2, r2::DOUBLE / r0 FROM s", pairs=True)
def flt18_waterfall(spark, d):
    return R.waterfall(pairs(spark, d), [("mk", F.length("mk") >= 100), ("sq", F.length("sq") >= 100)], F.col("mk").contains("."))


@query("SELECT doc_id, coalesce(least(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars / 5000.0 END, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars / 2000.0 END) < 0.6, false) AS ocr_bad FROM documents")
def flt8_ocr_mask(spark, d):
    a, b = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 5000.0), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 2000.0)
    return table(spark, d, "documents").select("doc_id", F.coalesce(R.min_of_known(a, b) < 0.6, F.lit(False)).alias("ocr_bad"))


@query("SELECT doc_id, lang IN ('de', 'es') OR (lang IS NULL AND length(trim(substr(text, 1, 300))) >= 15) AS rejected FROM documents")
def flt9_language_mask(spark, d):
    checked = F.length(F.trim(F.substring("text", 1, 300))) >= 15
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("lang").isin("de", "es"), F.lit(False)).__or__(F.col("lang").isNull() & checked).alias("rejected"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars < 2000 AND lang IN ('en', 'fr')")
def flt13_flt15_band(spark, d):
    return table(spark, d, "documents").where(R.half_open(F.col("n_chars"), 500, 2000) & F.col("lang").isin("en", "fr")).select("doc_id", "n_chars")


@query("SELECT p.pair_id, regexp_replace(regexp_replace(p.mk || ' 1234567890123, b1234567 ' || (100000 + pair_id), '(^|[^0-9])[0-9]{13}([^0-9]|$)', '\\1[ID-NUMBER]\\2', 'g'), ' [A-Za-z]{1,2}[0-9]{6,9} ', ' [DOC-NUMBER] ', 'g') AS redacted FROM p", pairs=True)
def sf19_redaction(spark, d):
    return pairs(spark, d).select("pair_id", T.redact(F.concat("mk", F.lit(" 1234567890123, b1234567 "), 100000 + F.col("pair_id"))).alias("redacted"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS runs, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def ag24_pattern_totals(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.count_of(F.col("text"), "[0-9]+").alias("runs"), F.length("text").cast("long").alias("n"))


_CANON = "trim(regexp_replace(lower({}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("WITH k AS (SELECT DISTINCT " + _CANON.format("text") + " AS t FROM benchmark) SELECT p.pair_id, " + _CANON.format("p.mk") + " IN (SELECT t FROM k) AS hit_first, " + _CANON.format("p.sq") + " IN (SELECT t FROM k) AS hit_second FROM (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS mk, b.text AS sq FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) p")
def jn2_jn4_leakage(spark, d):
    return R.two_sided_anti(pairs(spark, d), table(spark, d, "benchmark"), "mk", "sq", T.norm_lower_ws).select("pair_id", "hit_first", "hit_second")


@query("SELECT pair_id, 'mk' AS src_lang, length(mk) AS src_chars, length(sq) AS tgt_chars FROM p UNION ALL SELECT pair_id, 'sq', length(sq), length(mk) FROM p", pairs=True)
def st6_both_directions(spark, d):
    both = R.both_directions(pairs(spark, d).select("pair_id", "mk", "sq"), "mk", "sq", ("mk", "sq"))
    return both.select("pair_id", "src_lang", F.length("src_text").alias("src_chars"), F.length("tgt_text").alias("tgt_chars"))


@query(", m AS (SELECT a.pair_id AS row_id, b.pair_id AS partner_id, length(a.mk) AS n1, length(b.mk) AS n2 FROM p a JOIN p b ON a.issue = b.issue AND a.pair_id <> b.pair_id AND sha1(a.mk) <> sha1(b.mk) AND sha1(a.sq) <> sha1(b.sq)), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN n2::DOUBLE / greatest(n1, 1) BETWEEN 0.5 AND 2.0 THEN 0 ELSE 1 END, abs(n2 - n1), partner_id) AS rank FROM m) SELECT row_id, partner_id, rank FROM r WHERE rank <= 5", pairs=True)
def jn12_wrong_pairs(spark, d):
    p = pairs(spark, d).select("issue", "pair_id", F.sha1("mk").alias("a"), F.sha1("sq").alias("b"), F.length("mk").alias("n"))
    return R.wrong_pairs(p, "issue", "pair_id", "a", "b", F.col("n"))


@query(r", x AS (SELECT pair_id, regexp_extract_all(lower(mk), '[\p{L}\p{N}_]+') AS w FROM p) SELECT pair_id AS row_id, array_to_string(w, ' ') AS tokens, len(w) AS n FROM x", pairs=True)
def sf25_tokens(spark, d):
    w = T.word_tokens(F.col("mk"))
    return pairs(spark, d).select(F.col("pair_id").alias("row_id"), w.alias("w")).select("row_id", F.array_join("w", " ").alias("tokens"), F.size("w").alias("n"))


_TOKENS = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), ' ')"


@query("WITH i AS (SELECT item_id AS term_id, " + _TOKENS.format("text") + " AS need FROM benchmark), s AS (SELECT 1000000 + item_id AS term_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 3, 3 + item_id % 4), ' ') AS need FROM benchmark), t AS (SELECT * FROM i UNION ALL SELECT * FROM s), d AS (SELECT doc_id, " + _TOKENS.format("text") + " AS line FROM documents) SELECT doc_id AS row_id, term_id FROM d JOIN t ON need <> '' AND contains(' ' || line || ' ', ' ' || need || ' ')")
def jn14_term_lookup(spark, d):
    """Documents that hold a whole benchmark item as a token sequence, or one to four tokens from the middle of one."""
    b = table(spark, d, "benchmark").select("item_id", T.word_tokens(F.col("text")).alias("w"))
    short = b.select((F.col("item_id") + 1000000).alias("term_id"), F.expr("slice(w, 3, cast(1 + item_id % 4 as int))").alias("need"))
    terms = b.select(F.col("item_id").alias("term_id"), F.col("w").alias("need")).unionByName(short)
    return R.find_terms(table(spark, d, "documents"), "doc_id", T.word_tokens(F.col("text")), terms)


@query(r"WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, length(text) - 4) + 1), lambda i: substr(text, i, 5))) AS g FROM documents WHERE length(text) > 0) SELECT doc_id, len(g) AS n_shingles, md5(array_to_string(list_sort(g), chr(31))) AS digest FROM s")
def sk1_sk2_shingles(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    found = docs.select("doc_id", F.array_distinct(S.char_shingles(F.col("text"))).alias("g"))
    return found.select("doc_id", F.size("g").alias("n_shingles"), F.md5(F.array_join(F.sort_array("g"), "\x1f")).alias("digest"))


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)")
def sk11_cosine(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    a = v.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("x"), ((F.col("vec_id") * 7 + 3) % v.count()).alias("b_id"))
    b = v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("y"))
    return a.join(b, "b_id").select("a_id", "b_id", F.round(S.cosine(F.col("x"), F.col("y")), 9).alias("dot"))


@query(None)
def jn10_best_match(spark, d):
    """Cross-split sweep: the best train match of every held-out document by LSH (threshold 0.85); the estimate decides."""
    docs = table(spark, d, "documents").select("doc_id", T.norm_lower_ws(F.col("text")).alias("text"), R.hash_bucket(F.col("doc_id")).alias("b"))
    out = S.best_match(docs.where("b < 90"), docs.where("b >= 90"), "doc_id", "text")
    return out.withColumn("near_duplicate", F.col("max_jaccard") >= 0.85)


_AUDIT = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM documents),
s AS (SELECT doc_id, t, b, t IN (SELECT t FROM d WHERE b < 90) AS known, list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substr(t, i, 5))) AS g FROM d),
u AS (SELECT min(doc_id) AS t_id, any_value(g) AS g FROM s WHERE b < 90 GROUP BY t),
l AS (SELECT t_id, len(g) AS n, unnest(g) AS x FROM u), r AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s WHERE b >= 90 AND NOT known),
m AS (SELECT r.doc_id AS doc_id, t_id, any_value(r.n) AS a, any_value(l.n) AS b, count(*) AS common FROM r JOIN l ON r.x = l.x AND least(r.n, l.n) >= 0.8 * greatest(r.n, l.n) GROUP BY r.doc_id, t_id),
j AS (SELECT doc_id, max(common::DOUBLE / (a + b - common)) AS j FROM m GROUP BY doc_id)
SELECT s.doc_id AS doc_id, CASE WHEN known THEN 'exact_template' WHEN j >= 0.8 THEN 'near_duplicate' ELSE 'novel' END AS class, CASE WHEN known THEN 1.0 WHEN j >= 0.8 THEN j END AS best_jaccard FROM s LEFT JOIN j ON s.doc_id = j.doc_id WHERE b >= 90"""


@query(_AUDIT)
def jn11_sk10_overlap_audit(spark, d):
    """exact_template, near_duplicate or novel for every held-out document against train; the SQL compares all of them."""
    docs = table(spark, d, "documents").select("doc_id", T.norm_lower_digit0(F.col("text")).alias("text"), R.hash_bucket(F.col("doc_id")).alias("b"))
    train, probes = docs.where("b < 90"), docs.where("b >= 90")
    exact = probes.join(train.select("text").distinct(), "text", "left_semi").select("doc_id", F.lit(True).alias("exact"))
    rest = probes.join(exact, "doc_id", "left_anti")
    near = S.near_matches(train, rest, "doc_id", "text")
    out = probes.select("doc_id").join(exact, "doc_id", "left").join(near, "doc_id", "left")
    return out.select("doc_id", S.overlap_class(F.coalesce("exact", F.lit(False)), F.col("best_jaccard")).alias("class"), F.when(F.col("exact"), 1.0).otherwise(F.col("best_jaccard")).alias("best_jaccard"))


@query("WITH i AS (SELECT source, count(*) AS pairs FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS issue_order FROM i), c AS (SELECT *, coalesce(sum(pairs) OVER (ORDER BY issue_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(pairs) OVER () AS share_before FROM o) SELECT source, pairs, issue_order, share_before, CASE WHEN share_before < 0.9::DOUBLE THEN 'train' WHEN share_before < 0.9::DOUBLE + 0.05::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM c")
def wn1_wn2_chronological_split(spark, d):
    return R.cumulative_split(R.issue_order(table(spark, d, "documents"), "source"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha1(source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM g) SELECT source, n, b < t * 0.015 AS held_out, (c // 100)::INTEGER AS shard FROM o")
def wn8_wn9_group_holdout(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return R.pack_groups(R.greedy_holdout(g, "source", "n"), "source", "n", 100)


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE r <= least(1000, greatest(1, floor(n * 0.1)))")
def so5_stratified_sample(spark, d):
    return R.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query("SELECT doc_id FROM documents ORDER BY sha1('42:' || doc_id::VARCHAR), doc_id LIMIT 100")
def so7_uniform_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(R.hash_order(F.col("doc_id")), "doc_id").limit(100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def so3_top_k(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT doc_id, 'document' AS kind, text FROM documents WHERE text IN (SELECT text FROM benchmark) UNION ALL SELECT item_id, 'item', text FROM benchmark")
def st1_union(spark, d):
    b = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").join(b.select("text").distinct(), "text", "left_semi").select("doc_id", F.lit("document").alias("kind"), "text")
    return docs.unionByName(b.select(F.col("item_id").alias("doc_id"), F.lit("item").alias("kind"), "text"))


@query("SELECT DISTINCT source, lang FROM documents")
def st3_st4_distinct(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT lang) > 1 AS spans FROM documents GROUP BY source")
def jn13_ag16_disjointness(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs")).withColumn("spans", F.col("langs") > 1)


@query("SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)")
def jn16_containment(spark, d):
    """Documents that contain a whole benchmark item."""
    items, docs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")), table(spark, d, "documents").select("doc_id", "text")
    return R.contained(docs, items)

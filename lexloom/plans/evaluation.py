"""Queries of evaluation metrics. The hypothesis of a pair is its source text, its reference the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import metrics as M
from .common import pairs, table
from .registry import query


_13A = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(replace(replace(replace({}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', chr(34)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ', '([{{-~\\[-`\\x20-&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'), '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g')"
_LIST = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_CHARS = "list_transform(range(1, length(regexp_replace({0}, '\\s', '', 'g')) + 1), lambda i: substr(regexp_replace({0}, '\\s', '', 'g'), i, 1))"
_MARK = "[!-/:-@\\[-`{{-~]"
_WORDS = "flatten(list_transform(" + _LIST + ", lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '" + _MARK + "$') THEN [w[1:length(w) - 1], w[length(w):]] WHEN length(w) > 1 AND regexp_matches(w, '^" + _MARK + "') THEN [w[1:1], w[2:]] ELSE [w] END))"
#: Corpus BLEU and chrF++ from n-gram counts of pairs (pair_id, class, hyp, ref), an independent statement.
SCORES_SQL = f"""u AS (SELECT pair_id, class, 'b' AS kind, 4 AS most, {_LIST.format(_13A.format('hyp'))} AS h, {_LIST.format(_13A.format('ref'))} AS r FROM e
  UNION ALL SELECT pair_id, class, 'c', 6, {_CHARS.format('hyp')}, {_CHARS.format('ref')} FROM e UNION ALL SELECT pair_id, class, 'w', 2, {_WORDS.format('hyp')}, {_WORDS.format('ref')} FROM e),
o AS (SELECT *, unnest(range(1, most + 1)) AS n FROM u),
g AS (SELECT pair_id, kind, n, list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], chr(1))) AS h, list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1))) AS r FROM o),
a AS (SELECT pair_id, kind, n, x, count(*) AS c FROM (SELECT pair_id, kind, n, unnest(h) AS x FROM g) GROUP BY ALL), b AS (SELECT pair_id, kind, n, x, count(*) AS c FROM (SELECT pair_id, kind, n, unnest(r) AS x FROM g) GROUP BY ALL),
m AS (SELECT a.pair_id AS pair_id, a.kind AS kind, a.n AS n, sum(least(a.c, b.c)) AS m FROM a JOIN b ON a.pair_id = b.pair_id AND a.kind = b.kind AND a.n = b.n AND a.x = b.x GROUP BY ALL),
f AS (SELECT o.pair_id AS pair_id, class, o.kind AS kind, o.n AS n, len(h) AS hl, len(r) AS rl, greatest(0, len(h) - o.n + 1) AS ht, greatest(0, len(r) - o.n + 1) AS rt, coalesce(m, 0) AS m FROM o LEFT JOIN m ON o.pair_id = m.pair_id AND o.kind = m.kind AND o.n = m.n),
k AS (SELECT class, kind, n, ht, rt, m, hl, rl FROM f UNION ALL SELECT 'all', kind, n, ht, rt, m, hl, rl FROM f),
t AS (SELECT class, kind, n, sum(m)::DOUBLE AS m, sum(ht)::DOUBLE AS ht, sum(CASE WHEN rt > 0 THEN ht ELSE 0 END)::DOUBLE AS hc, sum(rt)::DOUBLE AS rt, sum(hl)::DOUBLE AS hl, sum(rl)::DOUBLE AS rl, count(*) AS rows FROM k GROUP BY ALL),
z AS (SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY class, kind ORDER BY n) AS zeros FROM t),
bleu AS (SELECT class, any_value(rows) AS n, CASE WHEN min(ht) = 0 OR max(m) FILTER (n = 1) = 0 THEN 0 ELSE 100 * least(1, exp(1 - any_value(rl) / any_value(hl))) * exp(sum(CASE WHEN ht = 0 THEN 0 WHEN m = 0 THEN -ln(pow(2, zeros) * ht) ELSE ln(m / ht) END) / 4) END AS bleu FROM z WHERE kind = 'b' GROUP BY class),
chrf AS (SELECT class, avg(m / hc) AS p, avg(m / rt) AS r FROM t WHERE kind <> 'b' AND hc > 0 AND rt > 0 GROUP BY class),
scores AS (SELECT bleu.class AS class, n, bleu, coalesce(CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) END, 0) AS chrf FROM bleu LEFT JOIN chrf ON bleu.class = chrf.class)"""


@query(", e AS (SELECT pair_id, CASE WHEN length(mk) < 300 THEN 'short' ELSE 'long' END AS class, mk || ', 3.5% (' || sq[1:40] || ')' AS hyp, sq AS ref FROM p), " + SCORES_SQL + " SELECT class, n, bleu, chrf FROM scores", pairs=True)
def ev1_ev3_corpus_scores(spark, d):
    """Corpus BLEU and chrF++ by class and in all. A hypothesis is the source, some marks, and the start of its target."""
    p = pairs(spark, d).withColumn("class", F.when(F.length("mk") < 300, "short").otherwise("long"))
    return M.corpus_scores(p.withColumn("hyp", F.concat("mk", F.lit(", 3.5% ("), F.substring("sq", 1, 40), F.lit(")"))), "hyp", "sq", "class")


@query(None)
def ev8_paired_bootstrap(spark, d):
    """1,000 resamples: the target with one letter changed against the source, both whole texts. The weights are drawn from
    seeded generators, which SQL has not; tested against a loop."""
    return M.paired_bootstrap(pairs(spark, d), F.col("pair_id"), F.col("mk"), F.translate("sq", "e", "é"), F.col("sq"))


_RUNS = "list_sort(regexp_extract_all({}, '[0-9]+'))"


@query(", m AS (SELECT turn, (" + _RUNS.format("mk") + " = " + _RUNS.format("sq") + ")::INT AS m, (len(" + _RUNS.format("mk") + ") > 0)::INT AS w FROM p) SELECT turn, count(*) AS n_sentences, avg(m) * 100 AS match_rate_all, sum(w)::BIGINT AS n_with_numbers, sum(m * w) * 100.0::DOUBLE / nullif(sum(w), 0) AS match_rate_with_numbers FROM m GROUP BY turn", pairs=True)
def ev6_number_fidelity(spark, d):
    return M.number_fidelity(pairs(spark, d), F.col("mk"), F.col("sq"), "turn")


_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_HIT = "len(need) > 0 AND len(list_filter(need, lambda t: len(list_filter({}, lambda x: starts_with(x, substr(t, 1, greatest(4, length(t) - 2))))) > 0)) = len(need)"


@query(", t AS (SELECT pair_id, " + _W.format("mk") + " AS h, list_slice(" + _W.format("sq") + ", 1, 1 + pair_id % 4) AS need FROM p) SELECT pair_id, " + _HIT.format("h") + " AS hit FROM t", pairs=True)
def sf24_term_hits(spark, d):
    need = F.expr("slice(w, 1, cast(1 + pair_id % 4 as int))")
    p = pairs(spark, d).select("pair_id", T.word_tokens(F.col("mk")).alias("h"), T.word_tokens(F.col("sq")).alias("w")).select("pair_id", "h", need.alias("need"))
    return p.select("pair_id", T.term_hit(F.col("h"), F.col("need")).alias("hit"))


_TERMS_SQL = ", w AS (SELECT item_id, " + _W.format("text") + " AS w FROM benchmark), tt AS (SELECT DISTINCT w[i] AS mk, w[i + 1] AS sq FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) WHERE length(w[i]) >= 4 UNION SELECT w[3] || ' ' || w[4], w[5] FROM w), g AS (SELECT mk, list(DISTINCT sq) AS targets FROM tt GROUP BY mk)"


@query(_TERMS_SQL + ", s AS (SELECT pair_id, ' ' || array_to_string(" + _W.format("mk") + ", ' ') || ' ' AS line, " + _W.format("sq") + " AS a, " + _W.format("mk") + " AS b FROM p), d AS (SELECT doc_id, ' ' || array_to_string(" + _W.format("text") + ", ' ') || ' ' AS line FROM documents WHERE lang = 'en'), f AS (SELECT pair_id, mk, targets, a, b FROM s JOIN g ON contains(line, ' ' || mk || ' ')), q AS (SELECT mk, count(*) AS seen FROM d JOIN g ON contains(line, ' ' || mk || ' ') GROUP BY mk), x AS (SELECT pair_id, coalesce(seen, 0) <= 5 AS rare, a, b, list_transform(targets, lambda t: " + _W.format("t") + ") AS targets FROM f LEFT JOIN q ON f.mk = q.mk), y AS (SELECT pair_id, rare, 'sq' AS model, len(list_filter(targets, lambda need: " + _HIT.format("a") + ")) > 0 AS hit FROM x UNION ALL SELECT pair_id, rare, 'mk', len(list_filter(targets, lambda need: " + _HIT.format("b") + ")) > 0 FROM x) SELECT model, count(DISTINCT pair_id) AS n_sentences_with_terms, count(*) AS n_term_occurrences, count(*) FILTER (hit) AS n_success, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS tsr, count(*) FILTER (rare) AS n_rare_occurrences, count(*) FILTER (rare AND hit) AS n_rare_success, round(100.0::DOUBLE * count(*) FILTER (rare AND hit) / nullif(count(*) FILTER (rare), 0), 2) AS rare_tsr FROM y GROUP BY model", pairs=True)
def ev5_term_success(spark, d):
    """Micro and rare rates. A benchmark word of four letters is a term that the next word translates; so are its third and
    fourth word together. English documents are the training text."""
    w = table(spark, d, "benchmark").select(T.word_tokens(F.col("text")).alias("w"))
    single = w.select(F.explode(F.arrays_zip(F.col("w").alias("mk"), F.expr("slice(w, 2, size(w))").alias("sq"))).alias("x")).select("x.mk", "x.sq").where("sq is not null")
    double = w.select(F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("mk"), F.get("w", F.lit(4)).alias("sq"))
    train = table(spark, d, "documents").where("lang = 'en'")
    return M.term_success(pairs(spark, d), "pair_id", "mk", ("sq", "mk"), single.unionByName(double), train, "doc_id", "text")


_FAMILY = """, x AS (SELECT pair_id, 'article' AS family, [(pair_id % 7)::VARCHAR] AS a, CASE WHEN pair_id % 3 = 0 THEN [] ELSE [(pair_id % 5)::VARCHAR] END AS b FROM p
  UNION ALL SELECT pair_id, 'paragraph', [(pair_id % 4)::VARCHAR], [(pair_id % 4)::VARCHAR] FROM p
  UNION ALL SELECT pair_id, 'date', [(1 + pair_id % 28) || '-' || (1 + pair_id % 12) || '-2024'], ['3-' || (1 + pair_id % 12) || '-2024'] FROM p
  UNION ALL SELECT pair_id, 'money', ['1250.5 MKD', '7 EUR'], CASE WHEN pair_id % 2 = 0 THEN ['1250.5 MKD'] ELSE ['7 EUR', '1250.5 MKD'] END FROM p
  UNION ALL SELECT pair_id, 'percent', [(pair_id % 4) || '.5'], [(pair_id % 8) || '.5'] FROM p)
SELECT family, count(*) AS segments_with_pattern, avg((list_sort(list_distinct(a)) = list_sort(list_distinct(b)))::INT) AS exact_set_match, sum(len(list_intersect(a, b)))::DOUBLE / sum(len(a)) AS value_recall, sum(len(list_intersect(a, b)))::DOUBLE / nullif(sum(len(b)), 0) AS value_precision FROM x GROUP BY family"""


@query(_FAMILY, pairs=True)
def ev7_pattern_fidelity(spark, d):
    """Sets of values by pattern family on both sides of a pair. The texts get clauses in either language whose values the
    SQL states plainly."""
    i, f = F.col("pair_id"), F.format_string
    mk = f(" член %d став %d на %02d.%d.2024 износ 1.250,50 денари или 7 евра, %d,5 %%", i % 7, i % 4, 1 + i % 28, 1 + i % 12, i % 4)
    sq = F.concat(F.when(i % 3 == 0, F.lit("")).otherwise(f(" nenit %d", i % 5)), f(" paragrafi %d me 3/%d/2024 shuma ", i % 4, 1 + i % 12), F.when(i % 2 == 0, "1.250,50 denarë").otherwise("7,0 euro dhe 1 250,5 MKD"), f(", %d.50%%", i % 8))
    p, aggs = pairs(spark, d).select("pair_id", F.concat("mk", mk).alias("mk"), F.concat("sq", sq).alias("sq")), []
    families = [x for x in T.FAMILIES if x != "numeral"]
    for family in families:
        a, b = T.family_values(F.col("mk"), family), T.family_values(F.col("sq"), family)
        p = p.withColumns({f"a_{family}": a, f"b_{family}": b})
    for family in families:
        a, b = F.col(f"a_{family}"), F.col(f"b_{family}")
        fired = F.size(a) > 0
        aggs.append(F.struct(
            F.lit(family).alias("family"), F.count(F.when(fired, 1)).alias("segments_with_pattern"),
            F.avg(F.when(fired, (F.array_sort(a) == F.array_sort(b)).cast("double"))).alias("exact_set_match"),
            F.try_divide(F.sum(F.when(fired, F.size(F.array_intersect(a, b)))), F.sum(F.when(fired, F.size(a)))).alias("value_recall"),
            F.try_divide(F.sum(F.when(fired, F.size(F.array_intersect(a, b)))), F.sum(F.when(fired, F.size(b)))).alias("value_precision"),
        ))
    return p.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("WITH s AS (SELECT source AS model, lang AS direction, avg(n_chars) AS score FROM documents GROUP BY ALL) SELECT a.model, a.direction, a.score, a.score - b.score AS delta FROM s a LEFT JOIN s b ON a.direction = b.direction AND b.model = 'src0'")
def ev4_deltas(spark, d):
    s = table(spark, d, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("direction")).agg(F.avg("n_chars").alias("score"))
    base = s.where("model = 'src0'").select("direction", F.col("score").alias("base"))
    return s.join(base, "direction", "left").select("model", "direction", "score", (F.col("score") - F.col("base")).alias("delta"))


@query("WITH r AS (SELECT source AS exp_id, lang AS direction, CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'm' || (doc_id % 3) END AS model, avg(n_chars) AS mean, CASE WHEN count(*) > 1 THEN max(n_chars)::DOUBLE END AS top, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY exp_id, direction) * 100.0::DOUBLE / sum(n) OVER (PARTITION BY exp_id) AS pct, max(n) OVER (PARTITION BY exp_id, direction) AS most FROM r WHERE exp_id NOT IN ('src4', 'src7')), v AS (SELECT *, CASE WHEN exp_id = 'src0' THEN model = 'base' ELSE model <> 'base' END AS mine FROM a) SELECT exp_id, 'arm-' || exp_id AS paper_arm, 'all' AS test_set, direction AS subset, 'any' AS direction, model AS model_variant, n, 'mean' AS metric, mean AS value FROM v WHERE mine UNION ALL SELECT exp_id, 'arm-' || exp_id, 'all', direction, 'any', model, n, 'top', top FROM v WHERE mine AND top IS NOT NULL UNION ALL SELECT DISTINCT exp_id, 'arm-' || exp_id, 'all', direction, 'any', '-', most, 'share_of_pairs_pct', pct FROM a WHERE exp_id <> 'src0'")
def ev11_registry(spark, d):
    """Sources are experiments, languages subsets; two experiments are not done."""
    k = F.col("doc_id") % 3
    model = F.when(k == 0, F.lit("base")).otherwise(F.concat(F.lit("m"), k))
    r = table(spark, d, "documents").groupBy(F.col("source").alias("exp_id"), F.col("lang").alias("subset"), model.alias("model")).agg(F.avg("n_chars").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.max("n_chars").cast("double")).alias("top"), F.count(F.lit(1)).alias("n"))
    whole = r.groupBy("exp_id").agg(F.sum("n").alias("whole"))
    shares = r.groupBy("exp_id", "subset").agg(F.sum("n").alias("part")).join(whole, "exp_id").select("exp_id", "subset", (F.col("part") * 100.0 / F.col("whole")).alias("pct"))
    results = r.join(shares, ["exp_id", "subset"]).withColumns({"test_set": F.lit("all"), "direction": F.lit("any")})
    experiments = r.select("exp_id").distinct().select("exp_id", F.concat(F.lit("arm-"), "exp_id").alias("paper_arm"), F.when(F.col("exp_id").isin("src4", "src7"), "running").otherwise("done").alias("status"))
    return M.registry_rows(results, experiments, ["mean", "top"], "pct", "src0")


@query("SELECT pair_id, trim(sq) = '' AS empty, sq = mk AS copied, length(sq) AS n FROM p", pairs=True)
def sf31_hypothesis_flags(spark, d):
    return pairs(spark, d).select("pair_id", (F.trim("sq") == "").alias("empty"), (F.col("sq") == F.col("mk")).alias("copied"), F.length("sq").alias("n"))


_RESULTS_SQL = "r AS (SELECT lang AS direction, CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'm' || (doc_id % 3) END AS model, avg(n_chars) AS score, count(*)::DOUBLE AS n FROM documents GROUP BY ALL)"


def _results(spark, d):
    k = F.col("doc_id") % 3
    model = F.when(k == 0, F.lit("base")).otherwise(F.concat(F.lit("m"), k))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("direction"), model.alias("model")).agg(F.avg("n_chars").alias("score"), F.count(F.lit(1)).cast("double").alias("n"))


@query(f"WITH {_RESULTS_SQL} SELECT direction, model, score, n FROM r WHERE model = 'base'")
def ev12_base_rows(spark, d):
    r = _results(spark, d)
    return M.base_rows(r.withColumn("score_delta_vs_base", F.lit(0.0)))


@query(f"WITH {_RESULTS_SQL}, x AS (SELECT a.direction AS direction, round(a.score - b.score, 2) AS d FROM r a JOIN r b ON a.direction = b.direction AND a.model = 'm1' AND b.model = 'base') SELECT count(*) AS n_tests, count(*) FILTER (abs(d) > 50) AS n_significant, count(*) FILTER (abs(d) > 50 AND d < 0) AS n_significant_declines, min(d) AS lowest, max(d) AS highest, max(abs(d)) AS max_abs FROM x")
def ag26_delta_summary(spark, d):
    changes = M.deltas(_results(spark, d), ["direction"], ["score"], "m1")
    return M.delta_summary(changes, "score_delta", F.abs("score_delta") > 50)


@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(replace(l, ',', ''), '\\d+(?:\\.\\d+)?')) AS number FROM (SELECT 'rows ' || o_custkey || ' of ' || printf('%.1f', o_totalprice / 3.7::DOUBLE) AS l FROM orders)), v AS (SELECT o_custkey::VARCHAR AS v FROM orders UNION SELECT printf('%.1f', o_totalprice / 3.7::DOUBLE) FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT round(o_totalprice / 3.7::DOUBLE)::BIGINT::VARCHAR FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_custkey || '.0' FROM orders) SELECT number FROM n WHERE number NOT IN (SELECT v FROM v)")
def ev13_untraced_numbers(spark, d):
    """Numbers in lines of text that the results don't hold: customers and a third of the prices are results."""
    o = table(spark, d, "orders")
    lines = o.select(F.format_string("rows %d of %.1f `17` §4.2", F.col("o_custkey").cast("long"), F.col("o_totalprice") / 3.7).alias("line"))
    values = o.select(F.col("o_custkey").cast("double").alias("v")).unionByName(o.where("o_orderkey % 3 = 0").select((F.col("o_totalprice") / 3.7).alias("v")))
    return M.untraced_numbers(lines, "line", values, "v")


@query("SELECT l_returnflag AS model, count(l_discount) AS n, avg(l_discount) AS system_score FROM lineitem GROUP BY 1")
def ev10_system_score(spark, d):
    return M.system_score(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "model"), "l_discount", "model")


@query(", s AS (SELECT turn % 3 AS grp, (pair_id % 101) / 101.0::DOUBLE AS v, unnest([(pair_id % 23) / 30.0::DOUBLE, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE (pair_id % 19) / 25.0::DOUBLE END]) AS w FROM p), a AS (SELECT DISTINCT turn % 3 AS grp, pair_id, (pair_id % 101) / 101.0::DOUBLE AS v FROM p), b AS (SELECT grp, w FROM s WHERE w IS NOT NULL), q AS (SELECT grp, count(*) AS wrong_pairs, median(w) AS median_wrong, quantile_cont(w, 0.95) AS wrong_p95 FROM b GROUP BY grp) SELECT q.grp AS grp, (SELECT count(*) FROM a WHERE a.grp = q.grp) AS rows, wrong_pairs, (SELECT median(v) FROM a WHERE a.grp = q.grp) AS median_rows, median_wrong, wrong_p95, (SELECT avg((v > q.wrong_p95)::INT) FROM a WHERE a.grp = q.grp) AS rows_above_wrong_p95, (SELECT avg(CASE WHEN a.v > b.w THEN 1.0 WHEN a.v = b.w THEN 0.5 ELSE 0.0 END::DOUBLE) FROM a JOIN b ON a.grp = b.grp WHERE a.grp = q.grp) AS separation FROM q", pairs=True)
def ev9_separation_table(spark, d):
    i = F.col("pair_id")
    p = pairs(spark, d).withColumn("grp", F.col("turn") % 3)
    return M.separation_table(p, "grp", i % 101 / 101.0, F.array(i % 23 / 30.0, F.when(i % 5 != 0, i % 19 / 25.0)))

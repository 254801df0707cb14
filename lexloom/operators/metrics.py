"""Corpus metrics as sums of per-row statistics: BLEU, chrF++, term success, number fidelity, paired bootstrap."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from lexloom.functions.text import term_hit, word_tokens
from .relational import find_terms

CHAR_ORDER, WORD_ORDER, BETA, MAX_N, ROWS = 6, 2, 2, 4, 256
BLEU_SIZE, CHRF_SIZE = 2 + 2 * MAX_N, 3 * (CHAR_ORDER + WORD_ORDER)


def tokens_13a(text: str) -> list[str]:
    """The mteval-v13a tokenisation."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


# -- statistics of a batch of rows --------------------------------------------------------------------------------------
# n-grams of all rows of a batch are 64-bit hashes of symbol numbers and row, counted by sorting.


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _grams(symbols: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie in one row, and their rows."""
    size = max(0, len(symbols) - n + 1)
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = _mix(h ^ symbols[i : size + i])
    inside = row[:size] == row[n - 1 : size + n - 1]
    own = row[:size][inside]
    return _mix(h[inside] * np.uint64(0xFF51AFD7ED558CCD) + _mix(own.astype(np.uint64) + np.uint64(1))), own


def _order(hyp: tuple, ref: tuple, n: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: n-grams of the hypothesis, of the reference, and clipped matches."""
    (a, a_row), (b, b_row) = _grams(*hyp, n), _grams(*ref, n)
    kinds, first, count = np.unique(a, return_index=True, return_counts=True)
    others, others_count = np.unique(b, return_counts=True)
    found = np.zeros(rows, np.int64)
    if len(others):
        at = np.minimum(np.searchsorted(others, kinds), len(others) - 1)
        both = np.where(others[at] == kinds, np.minimum(count, others_count[at]), 0)
        found = np.bincount(a_row[first], both, rows).astype(np.int64)
    return np.bincount(a_row, minlength=rows), np.bincount(b_row, minlength=rows), found


def _numbered(rows: list[list[str]], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    flat = [numbers.setdefault(w, len(numbers)) for ws in rows for w in ws]
    return np.array(flat, np.uint64), np.repeat(np.arange(len(rows)), [len(ws) for ws in rows])


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bare = ["".join(t.split()) for t in texts]
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(bare)), [len(t) for t in bare])


def statistics(hyps: list[str], refs: list[str]) -> np.ndarray:
    """A row of numbers for each pair. BLEU: both lengths, then matches and totals of each order. chrF++: hypothesis total
    (where the reference has any), reference total and matches of each order, first of characters, then of words."""
    n = len(hyps)
    out = np.zeros((n, BLEU_SIZE + CHRF_SIZE), np.int64)
    tokens = [[tokens_13a(t) for t in side] for side in (hyps, refs)]
    out[:, 0], out[:, 1] = ([len(t) for t in side] for side in tokens)
    numbers: dict[str, int] = {}
    hyp, ref = (_numbered(side, numbers) for side in tokens)
    for k in range(MAX_N):
        total, _, found = _order(hyp, ref, k + 1, n)
        out[:, 2 + 2 * k], out[:, 3 + 2 * k] = found, total
    at, words = BLEU_SIZE, [[_split_punctuation(t) for t in side] for side in (hyps, refs)]
    numbers = {}
    for (hyp, ref), most in (((_characters(hyps), _characters(refs)), CHAR_ORDER), (tuple(_numbered(side, numbers) for side in words), WORD_ORDER)):
        for k in range(1, most + 1):
            a, b, found = _order(hyp, ref, k, n)
            out[:, at], out[:, at + 1], out[:, at + 2] = np.where(b > 0, a, 0), b, found
            at += 3
    return out


def bleu_row(hyp: str, ref: str) -> list[int]:
    """Lengths, then matches and totals of each order."""
    return statistics([hyp], [ref])[0][:BLEU_SIZE].tolist()


def chrf_row(hyp: str, ref: str) -> list[int]:
    """Hypothesis total, reference total and matches of each order: characters without white space, then words."""
    return statistics([hyp], [ref])[0][BLEU_SIZE:].tolist()


def bleu_score(s) -> float:
    """Exponential smoothing of orders without a match, brevity penalty, no effective order."""
    if s[0] == 0 or any(s[3 + 2 * n] == 0 for n in range(MAX_N)) or s[2] == 0:
        return 0.0
    logs, smooth = 0.0, 1.0
    for n in range(MAX_N):
        match, total = s[2 + 2 * n], s[3 + 2 * n]
        if match == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * total))
        else:
            logs += math.log(match / total)
    return 100 * min(1.0, math.exp(1 - s[1] / s[0])) * math.exp(logs / MAX_N)


def _split_punctuation(text: str) -> list[str]:
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _MARKS:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _MARKS:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


_MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def chrf_score(s) -> float:
    """F-score of the mean precision and recall over the orders that both sides have."""
    precision = recall = orders = 0
    for i in range(0, len(s), 3):
        if s[i] > 0 and s[i + 1] > 0:
            precision, recall, orders = precision + s[i + 2] / s[i], recall + s[i + 2] / s[i + 1], orders + 1
    if not orders or precision + recall == 0:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)


@F.pandas_udf(ArrayType(LongType()))
def row_statistics(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    parts = [statistics([x or "" for x in hyp[i : i + ROWS]], [x or "" for x in ref[i : i + ROWS]]) for i in range(0, len(hyp), ROWS)]
    return pd.Series([row for part in parts for row in part])


@F.pandas_udf(StructType().add("bleu", DoubleType()).add("chrf", DoubleType()))
def final_scores(sums: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"bleu": [bleu_score(s[:BLEU_SIZE]) for s in sums], "chrf": [chrf_score(s[BLEU_SIZE:]) for s in sums]})


def _summed(df: DataFrame, by: list[str]) -> DataFrame:
    size = BLEU_SIZE + CHRF_SIZE
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.element_at("stats", i + 1)) for i in range(size)]).alias("sums"))


def corpus_scores(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    """(by..., n, bleu, chrf), each level of `by` also as `all`."""
    rows = df.withColumn("stats", row_statistics(F.col(hyp), F.col(ref)))
    parts = _summed(rows, list(by))
    if by:
        last = by[-1]
        whole = parts.groupBy(*by[:-1]).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(BLEU_SIZE + CHRF_SIZE)]).alias("sums")).withColumn(last, F.lit("all"))
        parts = parts.withColumn(last, F.col(last).cast("string")).unionByName(whole)
    return parts.withColumn("s", final_scores("sums")).select(*by, "n", "s.bleu", "s.chrf")


def number_fidelity(df: DataFrame, source: Column, hyp: Column, *by: str) -> DataFrame:
    runs = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    rows = df.withColumns({"__a": runs(source), "__b": runs(hyp)}).withColumns({"__m": (F.col("__a") == F.col("__b")).cast("int"), "__w": (F.size("__a") > 0).cast("int")})
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sentences"), (F.avg("__m") * 100).alias("match_rate_all"), F.sum("__w").alias("n_with_numbers"),
        (F.try_divide(F.sum(F.col("__m") * F.col("__w")), F.sum("__w")) * 100).alias("match_rate_with_numbers"),
    )


def term_success(sentences: DataFrame, key: str, source: str, models: Sequence[str], terms: DataFrame, train: DataFrame, train_key: str, train_text: str, rare: int = 5, least: int = 4) -> DataFrame:
    """(model, n_sentences_with_terms, n_term_occurrences, n_success, tsr, n_rare_occurrences, n_rare_success, rare_tsr).

    terms (mk, sq): a source term and a translation; all translations of a term count, and terms under `least` characters
    are left out. A term occurs once in a sentence, however often. It is rare if at most `rare` train sentences hold it.
    Rates are in percent to two places, null without an occurrence."""
    low = terms.select(F.lower("mk").alias("mk"), F.lower("sq").alias("sq")).where(F.length("mk") >= least)
    grouped = low.groupBy("mk").agg(F.collect_set("sq").alias("targets"))
    ids = grouped.select(F.col("mk").alias("term_id"), word_tokens(F.col("mk")).alias("need"), F.transform("targets", word_tokens).alias("targets"))
    found = find_terms(sentences, key, word_tokens(F.col(source)), ids.select("term_id", "need"))
    freq = find_terms(train, train_key, word_tokens(F.col(train_text)), ids.select("term_id", "need")).groupBy("term_id").agg(F.count(F.lit(1)).alias("seen"))
    facts = ids.select("term_id", "targets").join(freq, "term_id", "left").select("term_id", "targets", (F.coalesce("seen", F.lit(0)) <= rare).alias("is_rare"))
    tokens = sentences.select(F.col(key).alias("row_id"), *[word_tokens(F.col(m)).alias(f"__{m}") for m in models])
    hit = lambda m: F.exists("targets", lambda need: term_hit(F.col(f"__{m}"), need))
    marked = found.join(facts, "term_id").join(tokens, "row_id").select("row_id", "is_rare", *[hit(m).alias(m) for m in models])
    long = marked.unpivot(["row_id", "is_rare"], list(models), "model", "hit")
    one = lambda c: F.sum(c.cast("long"))
    counts = long.groupBy("model").agg(F.countDistinct("row_id").alias("n_sentences_with_terms"), F.count(F.lit(1)).alias("n_term_occurrences"), one(F.col("hit")).alias("n_success"), one(F.col("is_rare")).alias("n_rare_occurrences"), one(F.col("is_rare") & F.col("hit")).alias("n_rare_success"))
    rate = lambda a, b: F.round(F.try_divide(100 * F.col(a), F.col(b)), 2)
    return counts.withColumns({"tsr": rate("n_success", "n_term_occurrences"), "rare_tsr": rate("n_rare_success", "n_rare_occurrences")})


def separation_table(df: DataFrame, by: str, real: Column, wrong: Column) -> DataFrame:
    """Of each group: rows and wrong_pairs with a score, their medians, the wrong scores' 95th percentile, the share of rows
    above it, and the separation (AUC). `wrong` is an array of scores; nulls and NaN count nowhere."""
    fine = F.filter(F.coalesce(wrong, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.where(real.isNotNull()).select(F.col(by).alias("g"), real.alias("v"), F.lit(True).alias("is_row"))
    scores = rows.unionByName(df.select(F.col(by).alias("g"), F.explode(fine).alias("v"), F.lit(False).alias("is_row")))
    # by distinct score: all that follows is over these counts
    n = lambda flag: F.sum((F.col("is_row") == flag).cast("long"))
    counts = scores.groupBy("g", "v").agg(n(True).alias("p"), n(False).alias("n"))
    p95 = counts.groupBy("g").agg(F.sum("p").alias("rows"), F.sum("n").alias("wrong_pairs"), *[F.percentile("v", F.lit(q), F.col(c)).alias(a) for q, c, a in ((0.5, "p", "median_rows"), (0.5, "n", "median_wrong"), (0.95, "n", "wrong_p95"))])
    below = W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    wins = counts.withColumn("wins", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2))
    out = wins.join(p95, "g").groupBy("g", "rows", "wrong_pairs", "median_rows", "median_wrong", "wrong_p95").agg(
        F.try_divide(F.sum(F.when(F.col("v") > F.col("wrong_p95"), F.col("p")).otherwise(0)), F.sum("p")).alias("rows_above_wrong_p95"), F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")).alias("separation"))
    return out.withColumnRenamed("g", by)


def base_rows(results: DataFrame, model: str = "base") -> DataFrame:
    """The rows of the base model, without the columns that compare with it."""
    return results.where(F.col("model") == model).drop(*[c for c in results.columns if c.endswith("_delta_vs_base")])


def registry_rows(results: DataFrame, experiments: DataFrame, metrics: Sequence[str], share: str, owner: str, base: str = "base") -> DataFrame:
    """The tall registry of (exp_id, test_set, subset, direction, model, n, a column for each metric, share): a row for each
    metric that has a value, and one for each share of a subset, whatever the models. experiments (exp_id, paper_arm,
    status): only those that are done count. Rows of the base model belong to its owner: the owner's own results give them,
    and other experiments' copies are left out. Sorted by all that names a value."""
    done = experiments.where(F.col("status") == "done").select("exp_id", "paper_arm")
    rows = results.join(done, "exp_id")
    names = ["exp_id", "paper_arm", "test_set", "subset", "direction"]
    mine = rows.where((F.col("exp_id") == owner) == (F.col("model") == base))
    scores = mine.unpivot([*names, "model", "n"], list(metrics), "metric", "value").withColumnRenamed("model", "model_variant").where(F.col("value").isNotNull())
    shares = rows.where(F.col("exp_id") != owner).groupBy(*names).agg(F.max("n").alias("n"), F.max(share).alias("value"))
    shares = shares.select(*names, F.lit("-").alias("model_variant"), "n", F.lit("share_of_pairs_pct").alias("metric"), F.col("value").cast("double").alias("value"))
    order = ["exp_id", "test_set", "subset", "direction", "model_variant", "metric"]
    return scores.withColumn("value", F.col("value").cast("double")).unionByName(shares).dropDuplicates(order).orderBy(*order)


def deltas(results: DataFrame, by: Sequence[str], scores: Sequence[str], other: str, base: str = "base") -> DataFrame:
    """(by..., score_delta...) of one model over another, to two places."""
    pick = lambda m, end: results.where(F.col("model") == m).select(*by, *[F.col(s).alias(f"{s}{end}") for s in scores])
    return pick(other, "").join(pick(base, "__b"), list(by)).select(*by, *[F.round(F.col(s) - F.col(f"{s}__b"), 2).alias(f"{s}_delta") for s in scores])


def delta_summary(changes: DataFrame, delta: str, significant: Column) -> DataFrame:
    """(n_tests, n_significant, n_significant_declines, lowest, highest, max_abs) of a table of score changes."""
    n = lambda c: F.sum(c.cast("long"))
    return changes.agg(F.count(F.lit(1)).alias("n_tests"), n(significant).alias("n_significant"), n(significant & (F.col(delta) < 0)).alias("n_significant_declines"), F.min(delta).alias("lowest"), F.max(delta).alias("highest"), F.max(F.abs(delta)).alias("max_abs"))


#: What counts as a number in a report, and what is left out of it: code, section signs, time stamps.
NUMBER_IN_TEXT = r"-?\d[\d,]*(?:\.\d+)?"
NOT_TEXT = (r"`[^`]*`", r"§\d+(\.\d+)?", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(\+00:00|Z)?")


def untraced_numbers(lines: DataFrame, line: str, values: DataFrame, value: str) -> DataFrame:
    """(number) in a report's lines that no result shows: results count with 0 to 4 decimals, whole or as they are, with or
    without sign. Headings, images and table rules are left out."""
    text = F.col(line)
    for pattern in NOT_TEXT:
        text = F.regexp_replace(text, pattern, "")
    body = lines.where(~F.regexp_like(line, F.lit(r"^(#|!\[|\|---)")))
    stated = body.select(F.explode(F.regexp_extract_all(text, F.lit(f"({NUMBER_IN_TEXT})"), F.lit(1))).alias("number")).distinct()
    x = F.col(value).cast("double")
    shown = [F.format_string(f"%.{d}f", x) for d in range(5)] + [F.col(value).cast("string"), F.when(x == F.floor(x), x.cast("long").cast("string"))]
    allowed = values.select(F.explode(F.array_compact(F.array(*shown))).alias("v")).select(F.regexp_replace("v", "^-", "").alias("v")).distinct()
    bare = F.regexp_replace(F.regexp_replace("number", ",", ""), "^-", "")
    return stated.join(allowed, bare == F.col("v"), "left_anti")


def system_score(df: DataFrame, score: str, *by: str) -> DataFrame:
    """Sentence scores of a model that ran elsewhere (a column) as a system score by group."""
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("system_score"))


def paired_bootstrap(df: DataFrame, key: Column, base: Column, other: Column, ref: Column, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, delta_mean, low, high, p) of other - base. Each row has a Poisson(1) weight in each resample, from a hash
    of seed and key; partitions add up weighted statistics, so rows never meet in one place."""
    size = BLEU_SIZE + CHRF_SIZE
    rows = df.select(F.xxhash64(F.lit(seed), key.cast("string")).alias("h"), row_statistics(base, ref).alias("a"), row_statistics(other, ref).alias("b"))

    def add(batches):
        total = np.zeros((resamples, 2 * size))
        for pdf in batches:
            if len(pdf):
                stats = np.hstack([np.vstack(pdf["a"].to_numpy()), np.vstack(pdf["b"].to_numpy())]).astype(float)
                weights = np.vstack([np.random.default_rng(int(h) & (2**63 - 1)).poisson(1.0, resamples) for h in pdf["h"]])
                total += weights.T @ stats
        yield pd.DataFrame({"resample": np.arange(resamples), "sums": list(total)})

    parts = rows.mapInPandas(add, "resample int, sums array<double>")
    sums = parts.groupBy("resample").agg(F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(2 * size)]).alias("sums"))

    def finish(batches):
        for pdf in batches:
            d = [(bleu_score(s[size : size + BLEU_SIZE]) - bleu_score(s[:BLEU_SIZE]), chrf_score(s[size + BLEU_SIZE :]) - chrf_score(s[BLEU_SIZE:size])) for s in pdf["sums"]]
            yield pd.DataFrame({"bleu": [x for x, _ in d], "chrf": [y for _, y in d]})

    deltas = sums.mapInPandas(finish, "bleu double, chrf double").unpivot([], ["bleu", "chrf"], "metric", "delta")
    out = deltas.groupBy("metric").agg(F.avg("delta").alias("delta_mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.avg((F.col("delta") <= 0).cast("double")).alias("share"))
    p = F.greatest(F.lit(1.0 / resamples), 2 * F.least(F.col("share"), 1 - F.col("share")))
    return out.select("metric", "delta_mean", "low", "high", F.least(F.lit(1.0), p).alias("p"))

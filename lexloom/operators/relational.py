"""Filters, joins, aggregates, windows, samples and set operations over corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexloom.functions.text import words

# -- schema ----------------------------------------------------------------------------------------------------------


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast to an explicit schema; a missing column raises."""
    if missing := [f.name for f in schema.fields if f.name not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def check_deletions(before: Sequence[str], after: Sequence[str], reasons: dict[str, str]) -> list[str]:
    """Columns that go, each of which needs a reason."""
    gone = [c for c in before if c not in set(after)]
    if unexplained := [c for c in gone if c not in reasons]:
        raise ValueError(f"columns deleted without a reason: {unexplained}")
    return gone


def require(df: DataFrame, bad: Column, what: str, key: str) -> DataFrame:
    """Raise, naming five examples, if any row is bad."""
    if found := df.where(bad).select(key).limit(5).collect():
        raise ValueError(f"{what}: {[r[0] for r in found]}")
    return df


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    if found := df.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise ValueError(f"not unique by {keys}: {[r.asDict() for r in found]}")
    return df


def renamed(df: DataFrame, column: str, names: dict[str, str], to: str) -> DataFrame:
    """df with the new name of each label; a label without one raises."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    require(df, F.col(column).isNull() | ~F.col(column).isin(*names), "labels without a name", column)
    return df.withColumn(to, lookup[F.col(column)])


def catalogue(df: DataFrame, name: str, size: str, skip: Sequence[str]) -> DataFrame:
    """Corpora that are neither empty nor in `skip` (case, hyphens and underscores aside), smallest first."""
    bare = F.upper(F.translate(F.col(name), "-_", ""))
    return df.where((F.coalesce(F.col(size), F.lit(0)) > 0) & ~bare.isin(*[s.upper().replace("-", "").replace("_", "") for s in skip])).orderBy(size, name)


# -- filters ---------------------------------------------------------------------------------------------------------


def cascade(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """reject_reason: the first rule that a row fails, null if it passes all."""
    out = F
    for name, bad in rules:
        out = out.when(bad, name)
    return df.withColumn("reject_reason", out.otherwise(F.lit(None).cast("string")))


def waterfall(df: DataFrame, steps: Sequence[tuple[str, Column]], flag: Column) -> DataFrame:
    """(step_no, step, rows, flagged, removed, pct_of_start) of cumulative filters, from one pass."""
    keep, aggs, names = F.lit(True), [F.count(F.lit(1)).alias("r0"), F.sum(flag.cast("long")).alias("f0")], ["start"]
    for n, (name, cond) in enumerate(steps, 1):
        keep = keep & F.coalesce(cond, F.lit(False))
        aggs += [F.count(F.when(keep, 1)).alias(f"r{n}"), F.sum(F.when(keep & flag, 1).otherwise(0)).alias(f"f{n}")]
        names.append(name)
    rows = F.array(*[F.struct(F.lit(n).alias("step_no"), F.lit(x).alias("step"), F.col(f"r{n}").alias("rows"), F.col(f"f{n}").alias("flagged")) for n, x in enumerate(names)])
    long = df.agg(*aggs).select(F.explode(rows).alias("x"), F.col("r0").alias("start")).select("x.*", "start")
    return long.withColumn("removed", F.coalesce(F.lag("rows").over(W.orderBy("step_no")) - F.col("rows"), F.lit(0))).withColumn("pct_of_start", F.try_divide("rows", "start")).drop("start")


def min_of_known(*sides: Column) -> Column:
    return F.least(*sides)


def half_open(x: Column, low, high) -> Column:
    return (x >= low) & (x < high)


def language_verdict(text: Column, found: Column, wanted: str, least: int = 5) -> Column:
    """Whether a text fails by its language: only texts of at least `least` words are judged; no verdict fails."""
    return (F.size(words(text)) >= least) & ~found.eqNullSafe(F.lit(wanted))


def pair_rules(first: Column, second: Column, shares: tuple[Column, Column], langs: tuple[Column, Column], wanted: tuple[str, str], tokens: tuple[Column, Column], purity: float = 0.70, ratio: float = 2.0, most: int = 192) -> list[tuple[str, Column]]:
    """The rules of a corpus of pairs in their order, for cascade(). Texts are stripped; a share is null or 0 without
    letters; tokens are counted elsewhere, and a pair over the cap is dropped, not cut."""
    rate = F.length(first) / F.greatest(F.length(second), F.lit(1))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    return [
        ("empty", blank(first) | blank(second)), ("identical", first == second),
        ("script", (F.coalesce(shares[0], F.lit(0.0)) < purity) | (F.coalesce(shares[1], F.lit(0.0)) < purity)),
        ("length_ratio", (rate > ratio) | (rate < 1 / ratio)),
        ("langid_first", language_verdict(first, langs[0], wanted[0])), ("langid_second", language_verdict(second, langs[1], wanted[1])),
        ("too_long", (tokens[0] > most) | (tokens[1] > most)),
    ]


def alignment_fails(rule: float | str | None, score: Column, flag: Column) -> tuple[Column, str]:
    """(which rows fail, label) by a threshold of the score or by the flag; a rule that was not chosen raises."""
    if rule is None:
        raise ValueError("choose an alignment rule: a threshold, or 'flag'")
    if rule == "flag":
        return ~flag, "flag"
    return score < float(rule), f"score >= {float(rule):.2f}"


def flagged_or_scored(flag: Column, score: Column, least: float = 0.45) -> Column:
    """Flagged rows stay without a score; others need one of at least `least`."""
    return F.coalesce(flag | (score >= least), F.lit(False))


def token_window(df: DataFrame, first: Column, second: Column, low: int = 3, high: int = 192) -> tuple[DataFrame, DataFrame]:
    """(the rows whose sides both have low..high tokens, one row of tallies). A side that is short or long counts as one."""
    inside = first.between(low, high) & second.between(low, high)
    one = lambda c: F.sum(c.cast("long"))
    tallies = df.agg(F.count(F.lit(1)).alias("rows"), one(inside).alias("kept"), (one(first < low) + one(second < low)).alias("too_short"), (one(first > high) + one(second > high)).alias("too_long"))
    return df.where(inside), tallies


# -- joins -----------------------------------------------------------------------------------------------------------


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must be unique by key and lose no row."""
    out = unique_key(a, key).join(unique_key(b, key), key)
    if a.count() != out.count():
        raise ValueError(f"rows without a partner by {key}")
    return out


def two_sided_anti(pairs: DataFrame, held_out: DataFrame, first: str, second: str, norm) -> DataFrame:
    """Marks hit_first and hit_second: whose normalised text is in held_out(text). Equal held-out texts are one."""
    known = held_out.select(norm(F.col("text")).alias("known")).distinct()
    keyed = pairs.withColumn("__a", norm(F.col(first))).withColumn("__b", norm(F.col(second)))
    a, b = known.select(F.col("known").alias("__a"), F.lit(True).alias("hit_first")), known.select(F.col("known").alias("__b"), F.lit(True).alias("hit_second"))
    out = keyed.join(a, "__a", "left").join(b, "__b", "left").drop("__a", "__b")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("hit_first", "hit_second")})


def fetch_rows(df: DataFrame, key: str, other: DataFrame, other_key: str, columns: dict[str, str]) -> DataFrame:
    """df with columns {of other: new name} of the row of another role that its key names; null where there is none."""
    side = unique_key(other, other_key).select(F.col(other_key).alias("__k"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(side, df[key] == side["__k"], "left").drop("__k")


def assert_lined_up(a: DataFrame, b: DataFrame, position: str, *columns: str) -> DataFrame:
    """Raise unless both tables hold the same rows at the same positions. A position that one lacks differs."""
    x, y = (d.select(F.col(position).alias("__p"), F.struct(*columns).alias(n)) for d, n in ((a, "__a"), (b, "__b")))
    both = x.join(y, "__p", "full_outer")
    require(both, ~F.col("__a").eqNullSafe(F.col("__b")), "rows that do not line up at", "__p")
    return a


def anti_with_check(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows of df without those whose keys are in `gone`; raises unless kept and gone rows make up df."""
    known = gone.select(*keys).distinct()
    out = df.join(known, list(keys), "left_anti")
    n, kept, left = df.count(), out.count(), df.join(known, list(keys), "left_semi").count()
    if n != kept + left:
        raise ValueError(f"{kept} rows kept and {left} gone, of {n}: keys with nulls match neither")
    return out


def reconcile(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    out = found.withColumnRenamed(value, "found").join(expected.withColumnRenamed(value, "expected"), key, "full_outer")
    return out.select(key, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected")).withColumn("delta", F.col("found") - F.col("expected"))


def wrong_pairs(df: DataFrame, group: str, row_id: str, first: str, second: str, size: Column, partners: int = 5, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(row_id, partner_id, rank): within a group, rows whose two texts both differ; those in the length band first, then
    the nearest in length. Equal ids never meet, and ties go by id."""
    a = df.select(F.col(group).alias("g"), F.col(row_id).alias("row_id"), F.col(first).alias("a1"), F.col(second).alias("a2"), size.alias("n1"))
    b = df.select(F.col(group).alias("g"), F.col(row_id).alias("partner_id"), F.col(first).alias("b1"), F.col(second).alias("b2"), size.alias("n2"))
    met = a.join(b, "g").where("row_id <> partner_id and a1 <> b1 and a2 <> b2")
    band = (F.col("n2") / F.greatest("n1", F.lit(1))).between(low, high)
    best = W.partitionBy("row_id").orderBy(F.when(band, 0).otherwise(1), F.abs(F.col("n2") - F.col("n1")), "partner_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= partners).select("row_id", "partner_id", "rank")


def find_terms(texts: DataFrame, row_id: str, tokens: Column, terms: DataFrame, gram: int = 4) -> DataFrame:
    """(row_id, term_id) of terms (term_id, need array) that occur in a text's tokens as a sequence, whatever their length.

    A term is looked up by its first `gram` tokens (all, if it has fewer), and only the lengths that occur are taken from
    the texts. What meets is narrow: a text's distinct hashes. Candidates are then compared whole. Tokens hold no space."""
    need = terms.where(F.size("need") > 0).select("term_id", F.array_join("need", " ").alias("__need"), F.least(F.size("need"), F.lit(gram)).alias("__g"))
    need = need.withColumn("__key", F.xxhash64(F.substring_index("__need", " ", gram)))
    lines = texts.select(F.col(row_id).alias("row_id"), F.array_join(tokens, " ").alias("__line"))
    used = sorted(r[0] for r in need.select("__g").distinct().collect())  # at most `gram` numbers
    if not used:
        return lines.join(need, F.lit(False)).select("row_id", "term_id")
    # overlapping grams by look-ahead, from one pass over the line
    grams = F.concat(*[F.regexp_extract_all("__line", F.lit(rf"(?<!\S)(?=(\S+(?: \S+){{{g - 1}}})(?!\S))"), F.lit(1)) for g in used])
    keys = lines.select("row_id", F.explode(F.array_distinct(F.transform(grams, lambda x: F.xxhash64(x)))).alias("__key"))
    met = keys.join(need.select("__key", "term_id", "__need"), "__key").select("row_id", "term_id", "__need").distinct()
    whole = F.contains(F.concat(F.lit(" "), F.col("__line"), F.lit(" ")), F.concat(F.lit(" "), F.col("__need"), F.lit(" ")))
    return met.join(lines, "row_id").where(whole).select("row_id", "term_id").distinct()


def contained(docs: DataFrame, items: DataFrame, most: int = 10_000, most_chars: int = 1 << 25) -> DataFrame:
    """(item_id, doc_id) of documents (doc_id, text) that contain an item (item_id, needle) as a substring, for each pair of
    rows. Up to `most` items of `most_chars` characters in all are broadcast; of more, those with three whole words between
    their first and last join on these words, cut by the same white space on both sides, and the others are broadcast in
    blocks of that size."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("needle")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // most), -(-(size["chars"] or 0) // most_chars))
    if blocks == 1:
        return docs.join(F.broadcast(items), F.contains("text", "needle")).select("item_id", "doc_id")
    pieces = lambda c: F.split(F.col(c), r"\s+")
    # the first and the last piece of an item may go on in the document; what is between is whole there too
    keyed = items.withColumn("__w", pieces("needle"))
    long_ = keyed.where("size(__w) >= 5").select("item_id", "needle", F.expr("slice(__w, 2, 3)").alias("__k"))
    grams = F.expr("transform(sequence(1, size(__w) - 2), i -> slice(__w, i, 3))")
    key = lambda c: F.transform(c, lambda x: F.xxhash64(F.array_join(x, " ")))
    at = docs.withColumn("__w", pieces("text")).where("size(__w) >= 3").select("doc_id", "text", F.explode(F.array_distinct(key(grams))).alias("__k"))
    out = at.join(long_.withColumn("__k", F.xxhash64(F.array_join("__k", " "))), "__k").where(F.contains("text", "needle")).select("item_id", "doc_id")
    short = keyed.where("size(__w) < 5 and needle is not null").select("item_id", "needle")
    for b in range(blocks):
        part = short.where(F.pmod(F.xxhash64("item_id", "needle"), F.lit(blocks)) == b)
        out = out.unionByName(docs.join(F.broadcast(part), F.contains("text", "needle")).select("item_id", "doc_id"))
    return out


# -- windows ---------------------------------------------------------------------------------------------------------


def issue_order(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct issues with a dense rank from 0. One row an issue, so the ranking window is over a small table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")).withColumn("issue_order", F.dense_rank().over(W.orderBy(*keys)) - 1)


def cumulative_split(issues: DataFrame, train: float = 0.90, dev: float = 0.05) -> DataFrame:
    """train/dev/test by the share of rows before each issue. The dev bound is the double sum of both fractions."""
    before = F.coalesce(F.sum("pairs").over(W.orderBy("issue_order").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("pairs").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return issues.withColumn("share_before", share).withColumn("split", F.when(share < train, "train").when(share < train + dev, "dev").otherwise("test"))


def duplicate_rank(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("dup_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def best_copy(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return duplicate_rank(df, key, order).where("dup_rank = 1").drop("dup_rank")


def hash_bucket(key: Column, of: int = 100) -> Column:
    """The first 8 hex digits of SHA-1, modulo `of`."""
    return (F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long") % of).cast("int")


def hash_split(bucket: Column, train: int = 90, dev: int = 95) -> Column:
    return F.when(bucket < train, "train").when(bucket < dev, "dev").otherwise("test")


def greedy_holdout(groups: DataFrame, key: str, size: str, share: float = 0.015) -> DataFrame:
    """Whole groups in hash order until their rows reach the share of all rows."""
    order = W.orderBy(F.sha1(F.col(key).cast("string")), key)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return groups.withColumn("held_out", before < total * share)


def pack_groups(groups: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """Shards of whole groups in order of key: a new one starts when the rows so far reach a multiple of target."""
    before = F.coalesce(F.sum(size).over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("shard", F.floor(before / target).cast("int"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new ones replacing old ones of equal key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("__new")))).where("__r = 1").drop("__r", "__new")


# -- samples ---------------------------------------------------------------------------------------------------------


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, share: float, least: int = 1, most: int = 1000, seed: int = 42) -> DataFrame:
    """Of each stratum its share of rows, at least `least` and at most `most`, in hash order. A stratum is first cut down to
    the rows whose hash is under a bound that its quota passes almost surely, so no task sorts a large one whole; should
    the bound hold too few rows of one, all its rows are ranked."""
    quota = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("__n") * share)))
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__q", quota)
    order = hash_order(F.col(key), seed)
    rows = df.withColumn("__h", order)
    rows = rows.join(sizes, rows[stratum].eqNullSafe(sizes["__s"])).withColumn("__u", F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 2.0**32)
    bound = (F.col("__q") + 8 * F.sqrt(F.col("__q")) + 32) / F.col("__n")
    few = rows.where(F.col("__u") <= bound)
    got = few.groupBy(F.col("__s").alias("__t")).agg(F.count(F.lit(1)).alias("__got"))
    short = sizes.join(got, F.col("__s").eqNullSafe(F.col("__t")), "left").where(F.coalesce("__got", F.lit(0)) < F.col("__q")).select(F.col("__s").alias("__t"))
    rest = rows.where(F.col("__u") > bound).join(short, F.col("__s").eqNullSafe(F.col("__t")), "left_semi")
    best = W.partitionBy("__s").orderBy("__h", key)
    return few.unionByName(rest).withColumn("__r", F.row_number().over(best)).where("__r <= __q").select(*df.columns)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a random order that depends on seed and key only."""
    return df.orderBy(hash_order(F.col(key), seed), key)


def sample_per_direction(df: DataFrame, key: str, n: int, directions: Sequence[str], seed: int = 42) -> DataFrame:
    """(direction, key): of each direction its own n rows, drawn without replacement. Each draw is a top-n of hashes."""
    out = None
    for d in directions:
        own = df.select(F.lit(d).alias("direction"), key).orderBy(F.sha1(F.concat(F.lit(f"{seed}:{d}:"), F.col(key).cast("string"))), key).limit(n)
        out = own if out is None else out.unionByName(own)
    return out.orderBy("direction", key)


def keep_checkpoints(df: DataFrame, step: str, score: str, latest: int = 3) -> DataFrame:
    """The `latest` rows by step and the first of the best score."""
    best = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), step).limit(1)
    return df.orderBy(F.desc(step)).limit(latest).union(best).distinct()


def both_directions(pairs: DataFrame, first: str, second: str, langs: tuple[str, str]) -> DataFrame:
    """Every pair as two examples, from one scan."""
    one = lambda a, b, x, y: F.struct(F.col(a).alias("src_text"), F.col(b).alias("tgt_text"), F.lit(x).alias("src_lang"), F.lit(y).alias("tgt_lang"))
    rest = [c for c in pairs.columns if c not in (first, second)]
    return pairs.select(*rest, F.explode(F.array(one(first, second, *langs), one(second, first, *reversed(langs)))).alias("x")).select(*rest, "x.*")


# -- aggregates ------------------------------------------------------------------------------------------------------


def leak_rates(df: DataFrame, split: str, leaks: Column) -> DataFrame:
    """(split, leaking_rows, rows, leak_rate, clean_rows) of the splits but train; the rate to three places."""
    n, bad = F.count(F.lit(1)), F.sum(F.coalesce(leaks, F.lit(False)).cast("long"))
    out = df.where(F.col(split) != "train").groupBy(split).agg(bad.alias("leaking_rows"), n.alias("rows"))
    return out.withColumns({"leak_rate": F.round(F.col("leaking_rows") / F.col("rows"), 3), "clean_rows": F.col("rows") - F.col("leaking_rows")})


def composition(df: DataFrame, by: str) -> DataFrame:
    """(by, examples, pct), largest first."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("examples"))
    whole = F.sum("examples").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.withColumn("pct", 100 * F.col("examples") / whole).orderBy(F.desc("examples"), by)


def alignment_sweep(df: DataFrame, score: str, flag: Column, thresholds: Sequence[float], no_overlap: Column, confidence: Column, split: Column, flagged: DataFrame | None = None, splits: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """A row for each threshold of the score and one for the flag: rows, share of all, shares and means of what is kept, and
    counts by split. df holds one copy of each pair, the best by score, so filtering it equals deduplicating what is
    filtered; the flag's rows may come as a frame of their own (with the same columns), deduplicated after its filter.
    All thresholds take one pass."""

    def facts(keep: Column) -> list[Column]:
        n = F.sum(keep.cast("long"))
        mean = lambda x: F.avg(F.when(keep, x.cast("double")))
        return [n.alias("rows"), (n / F.count(F.lit(1))).alias("pct_of_clean"), mean(no_overlap).alias("no_shared_numbers"), mean(flag).alias("flag_share"), mean(confidence).alias("mean_confidence"),
                *[F.coalesce(F.sum((keep & (split == s)).cast("long")), F.lit(0)).alias(s) for s in splits]]

    steps = [(f"score >= {t:.2f}", F.coalesce(F.col(score) >= t, F.lit(False))) for t in thresholds]
    if flagged is None:
        steps.append(("flag", F.coalesce(flag, F.lit(False))))
    wide = df.agg(*[F.struct(*facts(keep)).alias(f"x{n}") for n, (_, keep) in enumerate(steps)])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(label).alias("alignment"), F.col(f"x{n}").alias("x")) for n, (label, _) in enumerate(steps)])).alias("r")).select("r.alignment", "r.x.*")
    if flagged is not None:
        own = flagged.agg(*facts(F.lit(True))).withColumn("pct_of_clean", F.col("rows") / df.count())
        out = out.unionByName(own.withColumn("alignment", F.lit("flag")))
    return out


def cutoff_table(df: DataFrame, score: Column, cutoffs: Sequence[float], special: Column, wrong: Column, verdict: Column) -> DataFrame:
    """What keeping score >= cutoff would do: rows_kept, share_kept, special_kept (of those, rows of a kind),
    wrong_passing (share of the wrong pairs' scores in an array that would pass too, nulls and NaN left out), and the rate of
    a three-valued verdict among the rows kept and dropped that have one. Rates without a row are null; one pass."""
    valid = F.filter(F.coalesce(wrong, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    n = lambda cond: F.sum(cond.cast("long"))

    def row(c: float) -> Column:
        keep, has = F.coalesce(score >= c, F.lit(False)), verdict.isNotNull()
        return F.struct(
            F.lit(float(c)).alias("cutoff"), n(keep).alias("rows_kept"), F.avg(keep.cast("double")).alias("share_kept"), n(keep & special).alias("special_kept"),
            F.try_divide(F.sum(F.size(F.filter(valid, lambda x: x >= c))), F.sum(F.size(valid))).alias("wrong_passing"),
            F.try_divide(n(F.coalesce(verdict, F.lit(False)) & keep), n(keep & has)).alias("verdict_kept"), F.try_divide(n(F.coalesce(verdict, F.lit(False)) & ~keep), n(~keep & has)).alias("verdict_dropped"),
        )

    return df.agg(F.array(*map(row, cutoffs)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def cutoff_by_bin(df: DataFrame, score: Column, cutoffs: Sequence[float], bin_: Column, labels: Sequence[str], wrong: Column) -> DataFrame:
    """(cutoff, then rows_kept and wrong_passing of each bin): the sweep by bin, pivoted."""
    valid = F.filter(F.coalesce(wrong, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    long = df.select(bin_.alias("__bin"), score.alias("__score"), valid.alias("__wrong")).select("__bin", "__score", "__wrong", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff"))
    passing = F.try_divide(F.sum(F.size(F.filter("__wrong", lambda x: x >= F.col("cutoff")))), F.sum(F.size("__wrong")))
    return long.groupBy("cutoff").pivot("__bin", list(labels)).agg(F.sum((F.col("__score") >= F.col("cutoff")).cast("long")).alias("rows_kept"), passing.alias("wrong_passing"))


def conserved(before: DataFrame, after: DataFrame, column: str, gone: str, added: str) -> DataFrame:
    """Totals of two patterns before and after a repair; raises unless as many of one went as came of the other."""
    n = lambda side, p: F.sum(F.when(F.col("__side") == side, F.regexp_count(F.col(column), F.lit(p))).otherwise(0))
    both = before.select(F.lit(0).alias("__side"), column).unionByName(after.select(F.lit(1).alias("__side"), column))
    out = both.agg(n(0, gone).alias("gone_before"), n(1, gone).alias("gone_after"), n(0, added).alias("added_before"), n(1, added).alias("added_after"))
    return require(out, F.col("gone_before") - F.col("gone_after") != F.col("added_after") - F.col("added_before"), "patterns that went and came differ", "gone_before")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(shared, only_first, only_second): how many distinct keys two tables share, and how many only one has."""
    sides = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    by = sides.groupBy(key).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(n(F.col("a") * F.col("b")).alias("shared"), n(F.col("a") * (1 - F.col("b"))).alias("only_first"), n(F.col("b") * (1 - F.col("a"))).alias("only_second"))


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate), from one pass."""
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_rate")) for c in df.columns])).alias("x")).select("x.*")


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    v, q = F.col(value), lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(v).alias("max"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) with totals; a null value is named apart from a total."""
    name = lambda c: F.when(F.grouping(c) == 1, "total").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("(null)"))).alias(f"__{c}")
    out = df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), name(row), name(column))
    return out.select(F.col(f"__{row}").alias(row), F.col(f"__{column}").alias(column), "n")


def threshold_sweep(df: DataFrame, score: str, truth: Column, cutoffs: Sequence[float]) -> DataFrame:
    """(cutoff, kept, true_kept, recall, precision), all cutoffs from one pass."""
    aggs = [F.sum(truth.cast("long")).alias("t")]
    for n, c in enumerate(cutoffs):
        aggs += [F.sum((F.col(score) >= c).cast("long")).alias(f"k{n}"), F.sum(((F.col(score) >= c) & truth).cast("long")).alias(f"t{n}")]
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"k{n}").alias("kept"), F.col(f"t{n}").alias("true_kept"), F.col("t").alias("t")) for n, c in enumerate(cutoffs)])
    out = df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")
    return out.select("cutoff", "kept", "true_kept", F.try_divide("true_kept", "t").alias("recall"), F.try_divide("true_kept", "kept").alias("precision"))

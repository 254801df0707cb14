import random
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chronology as C, metrics as M, ordering as O, relational as R, similarity as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- order


@pytest.mark.parametrize("rows", [1, 7, 50_000])
def test_running_sums_and_row_numbers(spark, rows):
    rng = random.Random(rows)
    data = [(i, rng.choice([None, 1, 2, 2, 2, 5, 9]), rng.randint(-3, 3)) for i in range(60)]
    df = frame(spark, data, "k int, v int, x int")
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = {r["k"]: r["row_number"] for r in O.row_numbers(df, "v", "k", rows=rows).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in order] and sorted(got.values()) == list(range(1, 61))
    sums = {r["k"]: r["s"] for r in O.running_sum(df, "v", F.col("x"), "s", ("k",), inclusive=False, rows=rows).collect()}
    total = 0
    for k, _, x in order:
        assert sums[k] == total
        total += x
    assert O.row_numbers(df.limit(0), "v", "k").count() == 0


def test_mean_rank_with_ties_and_nulls(spark):
    df = frame(spark, [(1, 5.0), (2, 1.0), (3, 5.0), (4, 7.0), (5, None)], "k int, v double")
    assert {r["k"]: r["mean_rank"] for r in O.mean_rank(df, "k", "v").collect()} == {5: 1.0, 2: 2.0, 1: 3.5, 3: 3.5, 4: 5.0}


def test_quantiles_are_numpys(spark):
    import numpy as np

    rng = random.Random(3)
    for values in ([1.0], [2.0, 2.0, 7.0], [float(rng.randint(0, 30)) for _ in range(200)]):
        df = frame(spark, [(v,) for v in [*values, None]], "v double")
        shares = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
        assert O.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert str(O.quantiles(frame(spark, [(None,)], "v double"), "v", [0.5])) == "[nan]"


def test_running_flags_against_a_loop(spark):
    rng = random.Random(2)
    data = [(i, None if rng.random() < 0.1 else rng.choice([1.0, 1.1, 0.9, 0.3, 40.0])) for i in range(200)]
    df = frame(spark, data, "step int, x double").repartition(5)
    for below, times, least, streak in ((False, 10.0, 10, 1), (True, 0.5, 5, 3), (True, 0.5, 5, 2)):
        seen, held, want = [], 0, []
        for step, x in data:
            before = statistics.median(seen) if seen else None
            flag = False
            if x is not None:
                out = len(seen) >= least and (x < times * before if below else x > times * before)
                held = held + 1 if out else 0
                if held == streak:
                    flag, held = True, 0
                seen.append(x)
            want.append((step, before, flag))
        got = [(r["step"], r["median_before"], r["anomalous"]) for r in O.running_flags(df, "step", "x", times, least, below, streak).orderBy("step").collect()]
        assert [(s, None if m is None else pytest.approx(m), f) for s, m, f in want] == got


# -- chronology


def test_chronology_raises(spark):
    rows = [("g_1.pdf", "2020-1-5", 2020), ("g_2.pdf", "2020-2-6", 2020)]
    schema = "filename string, slv_identifier string, year int"
    assert [r["issue_key"] for r in C.add_chronology(frame(spark, rows, schema)).orderBy("issue_no").collect()] == ["2020-0001", "2020-0002"]
    for bad in (("g1.pdf", "2020-1-5", 2020), (None, "2020-1-5", 2020), ("g_1.pdf", "2020-1", 2020), ("g_1.pdf", "2019-1-5", 2020), ("g_1.pdf", "2020-1-5", None)):
        with pytest.raises(ValueError):
            C.add_chronology(frame(spark, [*rows, bad], schema))


def test_inversions_profile_and_order(spark):
    rng = random.Random(1)
    data = [(y, n, rng.randint(1, 12)) for y in (2001, 2002) for n in range(40)]
    df = frame(spark, data, "year int, issue_no int, issue_month int")
    want = {y: sum(a[2] > b[2] for a in data for b in data if a[0] == b[0] == y and a[1] < b[1]) for y in (2001, 2002)}
    assert {r["year"]: r["inversions"] for r in C.month_inversions(df).collect()} == want
    with pytest.raises(ValueError):
        C.assert_monotone(df)
    issues = frame(spark, [(0, "a", 2001, 85, "train"), (1, "b", 2002, 15, "test")], "issue_order int, issue_key string, year int, pairs long, split string")
    assert [(r["split"], r["pairs"], r["pct_of_pairs"]) for r in C.split_profile(issues).collect()] == [("train", 85, 0.85), ("dev", None, None), ("test", 15, 0.15)]
    C.assert_ordered(issues)
    with pytest.raises(ValueError):
        C.assert_ordered(issues.withColumn("issue_order", -F.col("issue_order")))


def test_cumulative_split_of_the_known_case(spark):
    df = frame(spark, [(i, i) for i, n in enumerate([85, 4, 3, 2, 1, 3, 2]) for _ in range(n)], "issue int, x int")
    assert [r["split"] for r in R.cumulative_split(R.issue_order(df, "issue")).orderBy("issue").collect()] == ["train"] * 3 + ["dev"] * 3 + ["test"]


# -- filters and sweeps


def test_cascade_counts_the_first_rule(spark):
    long = "alpha beta gamma delta epsilon"
    rows = [(" ", long, "aa", "bb"), (long, None, "aa", "bb"), (long, long, "aa", "bb"), ("аб", "ab", "aa", "bb"), (long, long * 3, "aa", "bb"), (long, long + " x", "xx", "bb"), (long, long + " x", "aa", None), ("a b", "a c", "xx", "xx"), (long, long + " y", "aa", "bb")]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, la string, lb string")
    a, b = F.col("a"), F.col("b")
    shares = tuple(T.share(x, T.LATIN_NARROW, T.CYRILLIC_NARROW) for x in (a, b))
    out = R.cascade(df, R.pair_rules(a, b, shares, (F.col("la"), F.col("lb")), ("aa", "bb"), (F.length(a), F.length(b)), most=33)).orderBy("i")
    assert [r["reject_reason"] for r in out.collect()] == ["empty", "empty", "identical", "script", "length_ratio", "langid_first", "langid_second", None, None]
    tight = R.cascade(df, R.pair_rules(a, b, shares, (F.col("la"), F.col("lb")), ("aa", "bb"), (F.length(a), F.length(b)), most=10)).where("i = 8").first()
    assert tight["reject_reason"] == "too_long"


def test_alignment_rule_must_be_chosen(spark):
    with pytest.raises(ValueError):
        R.alignment_fails(None, F.col("s"), F.col("f"))
    df = frame(spark, [(True, None), (False, 0.5), (False, 0.4), (None, None)], "f boolean, s double")
    assert df.where(R.flagged_or_scored(F.col("f"), F.col("s"))).count() == 2


def test_flagged_rows_may_be_deduplicated_on_their_own(spark):
    df = frame(spark, [(0.9, True, "train"), (0.2, False, "dev")], "s double, f boolean, split string")
    flagged = df.where("f").unionByName(df.where("f"))
    out = {r["alignment"]: r for r in R.alignment_sweep(df, "s", F.col("f"), [0.5], F.lit(False), F.col("s"), F.col("split"), flagged).collect()}
    assert out["flag"]["rows"] == 2 and out["flag"]["pct_of_clean"] == 1.0 and out["score >= 0.50"]["train"] == 1


def test_stratified_sample_matches_a_sort(spark):
    data = [(i, "hot" if i % 3 else str(i % 40)) for i in range(4000)] + [(i, None) for i in range(5000, 5003)]
    df = frame(spark, data, "k long, s string")
    import hashlib

    groups = {}
    for k, s in data:
        groups.setdefault(s, []).append((hashlib.sha1(f"42:{k}".encode()).hexdigest(), k))
    want = sorted(k for g in groups.values() for _, k in sorted(g)[: min(20, max(1, len(g) // 10))])
    assert sorted(r["k"] for r in R.stratified_sample(df, "s", "k", 0.1, most=20).collect()) == want


def test_samples_and_shuffles_agree_between_runs(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a, b = (R.sample_per_direction(d, "k", 20, ("x-y", "y-x")).collect() for d in (df, df.repartition(7)))
    assert a == b and len(a) == 40 and len({r["k"] for r in a}) > 20
    first, again = ([r["k"] for r in R.shuffled(d, "k").collect()] for d in (df, df.repartition(3)))
    assert first == again and first != sorted(first) and sorted(first) == list(range(500))


# -- joins


def test_joins_that_check(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, t string"), frame(spark, [(1, "p"), (2, "q")], "k int, u string")
    assert R.join_one_to_one(a, b, "k").count() == 2
    for bad in (b.limit(1), b.unionByName(b)):
        with pytest.raises(ValueError):
            R.join_one_to_one(a, bad, "k")
    assert R.anti_with_check(a, b.where("k = 1"), "k").collect()[0]["k"] == 2
    with pytest.raises(ValueError):
        R.renamed(a, "t", {"x": "z"}, "n")
    R.assert_lined_up(a, a.repartition(2), "k", "t")
    for other in (a.limit(1), a.withColumn("t", F.lit("x")), a.unionByName(frame(spark, [(3, "w")], "k int, t string"))):
        with pytest.raises(ValueError):
            R.assert_lined_up(a, other, "k", "t")
    assert [r["u2"] for r in R.fetch_rows(a.withColumn("other", F.col("k") + 1), "other", b, "k", {"u": "u2"}).orderBy("k").collect()] == ["q", None]


def test_terms_of_every_length(spark):
    rng = random.Random(4)
    texts = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 40))]) for i in range(60)]
    terms = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for i in range(40)] + [(99, texts[5][1])]
    got = R.find_terms(frame(spark, texts, "id int, w array<string>"), "id", F.col("w"), frame(spark, terms, "term_id int, need array<string>"))
    want = {(i, t) for i, w in texts for t, need in terms if need and any(w[j : j + len(need)] == need for j in range(len(w)))}
    assert Counter(map(tuple, got.collect())) == Counter(want)
    none = frame(spark, [], "term_id int, need array<string>")
    assert R.find_terms(frame(spark, texts, "id int, w array<string>"), "id", F.col("w"), none).count() == 0


def test_conservation(spark):
    before, after = frame(spark, [("a[b",), (None,)], "t string"), frame(spark, [("aëb",), (None,)], "t string")
    assert R.conserved(before, after, "t", r"\[", "ë").first()["gone_before"] == 1
    with pytest.raises(ValueError):
        R.conserved(before, frame(spark, [("ab",)], "t string"), "t", r"\[", "ë")


# -- similarity


def grams(t, k=5):
    return {t[i : i + k] for i in range(max(1, len(t) - k + 1))} if t else set()


def near_texts(seed, n=150):
    rng, out = random.Random(seed), []
    for _ in range(n):
        t = list(rng.choice(out)) if out and rng.random() < 0.6 else [chr(97 + rng.randint(0, 25)) for _ in range(rng.randint(30, 250))]
        for _ in range(rng.choice([0, 1, 1, 2, 8])):
            t[rng.randrange(len(t))] = chr(97 + rng.randint(0, 25))
        out.append(t)
    return ["".join(t) for t in out]


def test_near_matches_and_best_match_have_recall(spark):
    """Recall against all pairs, at the threshold of each banding or above."""
    texts = near_texts(3, 400)
    train, probes = frame(spark, list(enumerate(texts[:300])), "k int, t string"), frame(spark, list(enumerate(texts[300:], 300)), "k int, t string")
    best = {}
    for i, p in enumerate(texts[300:], 300):
        best[i] = max((len(grams(p) & grams(t)) / len(grams(p) | grams(t)), k) for k, t in enumerate(texts[:300]))
    close = {i for i, (j, _) in best.items() if j >= 0.8}
    got = {r["k"]: r["best_jaccard"] for r in S.near_matches(train, probes, "k", "t").collect()}
    assert set(got) <= close and len(got) >= 0.9 * len(close) > 10
    assert sum(got[i] == pytest.approx(best[i][0]) for i in got) >= 0.9 * len(got)
    very = {i for i, (j, _) in best.items() if j >= 0.9}
    found = {r["k"]: r["max_jaccard"] for r in S.best_match(train, probes, "k", "t").collect()}
    assert sum(found[i] > 0.8 for i in very) >= 0.9 * len(very) > 5 and len(found) == 100


def test_minhash_families_against_plain_loops(spark):
    import hashlib
    import zlib

    import numpy as np

    texts = ["", "abc", "some text of a few words", "é" * 30]
    rng = np.random.default_rng(42)
    a, b = [int(x) for x in rng.integers(1, 1 << 31, 128)], [int(x) for x in rng.integers(0, 1 << 31, 128)]
    rng = np.random.RandomState(1)
    ab = [(int(rng.randint(1, (1 << 61) - 1, dtype=np.uint64)), int(rng.randint(0, (1 << 61) - 1, dtype=np.uint64))) for _ in range(128)]
    df = frame(spark, list(enumerate(texts)), "i int, t string")
    for r in df.select("t", S.minhash_affine(F.col("t")).alias("x"), S.minhash_sha(F.col("t")).alias("y")).collect():
        crc, sha = [zlib.crc32(g.encode()) for g in grams(r["t"])], [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams(r["t"])]
        assert r["x"] == ([min((p * h + q) % S.PRIME_31 for h in crc) for p, q in zip(a, b)] if crc else None)
        assert r["y"] == ([min((p * h + q) % 2**64 % ((1 << 61) - 1) & 0xFFFFFFFF for h in sha) for p, q in ab] if sha else None)


def test_sha_minima_of_many_letters_and_long_texts(monkeypatch):
    """Stores and alphabets that overflow, pieces of long texts and the rare plain path give the signatures of the formula."""
    import hashlib

    import numpy as np

    rng = random.Random(8)
    texts = ["", "abc", "".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "".join(rng.choice("abcdefgh") for _ in range(9000)), "😀é" * 40, "".join(chr(rng.randint(32, 900)) for _ in range(3000))]
    ab = np.random.RandomState(1)
    ab = [(int(ab.randint(1, (1 << 61) - 1, dtype=np.uint64)), int(ab.randint(0, (1 << 61) - 1, dtype=np.uint64))) for _ in range(128)]
    plain = lambda hs: [min((p * h + q) % 2**64 % ((1 << 61) - 1) & 0xFFFFFFFF for h in hs) for p, q in ab]
    sha = lambda t: {int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams(t)}
    for name, size in (("STORE", 500), ("LETTERS", 1024), ("CHUNK", 700)):
        monkeypatch.setattr(S._Grams, name, size)
    for t, got in zip(texts, S._Grams().signatures(texts)):
        assert (got is None) if not t else got.tolist() == plain(sha(t))
    h = [rng.randrange(1 << 32) for _ in range(1000)]
    monkeypatch.setattr(S, "_SHA_COEFFICIENTS", [np.array([[0, 1, 0, 0] + [7] * 124, [(1 << 61) - 1, (1 << 61) - 1 - h[0], (1 << 61) - 2, (1 << 64) - 1] + [5] * 124], np.uint64)])
    ab = list(zip(*map(np.ndarray.tolist, S._sha_coefficients())))
    assert S._sha_minima(np.array(h, np.uint64)).tolist() == plain(h)


def test_signatures_hold_one_text_at_a_time():
    """A batch of texts without common grams takes little memory, as what is held doesn't grow with the batch."""
    import tracemalloc

    rng = random.Random(9)
    texts = ["".join(map(chr, rng.choices(range(97, 123), k=2000))) for _ in range(800)]
    S._Grams().signatures(texts[:1])
    tracemalloc.start()
    S._Grams().signatures(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # sets of strings for the whole batch take over twice as much


def test_best_match_against_all_collisions(spark):
    """Equal to scoring every pair that collides in a band, with copies, groups of near copies, ties and texts without grams."""
    import numpy as np

    rng = random.Random(10)
    base = "".join(rng.choices("abcdefghij ", k=400))
    near = lambda: "".join(rng.choice("xyz") if rng.random() < 0.004 else c for c in base)
    texts = [near() for _ in range(160)] + [base] * 20 + near_texts(4, 100) + ["", None] * 4
    rng.shuffle(texts)
    rows = [(f"k{i:03}", t, i % 3 > 0) for i, t in enumerate(texts)]
    df = frame(spark, rows, "k string, t string, train boolean")
    sig = {k: s for (k, t, _), s in zip(rows, S._Grams().signatures([t or "" for t in texts]))}
    want = {}
    for k, t, train in rows:
        if not train:
            met = [(float((sig[k] == sig[o]).sum()) / 128, o) for o, _, ok in rows if ok and sig[k] is not None and sig[o] is not None and (sig[k] == sig[o]).reshape(8, 16).all(axis=1).any()]
            want[k] = max(met) if met else (0.0, None)
    held, S.BLOCK = S.BLOCK, 16  # so that large bands are dealt to many parts
    try:
        got = {r["k"]: (r["max_jaccard"], r["match_key"]) for r in S.best_match(df.where("train"), df.where("not train"), "k", "t").collect()}
    finally:
        S.BLOCK = held
    assert got == want and sum(s == 1.0 for s, _ in want.values()) > 3 < sum(0 < s < 1 for s, _ in want.values())


def test_best_match_makes_signatures_once(spark):
    """The family's function sees each row once, and no join makes a row for each pair of a group of near copies."""
    from pyspark.sql.types import ArrayType, LongType

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(ArrayType(LongType()))
    def counted(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return pd.Series([x if x is None else x.tolist() for x in S._sha_signatures(list(texts))], dtype=object)

    df = frame(spark, [(i, t, i % 2 > 0) for i, t in enumerate(near_texts(5, 60))], "k int, t string, train boolean")
    assert S.best_match(df.where("train"), df.where("not train"), "k", "t", family=counted).count() == 30 and seen.value == 60


def test_near_duplicate_report(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly box " * 3
    other = "entirely different text about other things that nobody has written before " * 3
    rows = [(1, base, other, "train"), (2, base + "x", "nothing of the kind, not one word of it " * 5, "test"), (3, "zz " * 60, other + "y", "dev"), (4, base, other + "z", "test"), (5, "q" * 90, "w" * 80, "dev")]
    out = {r["k"]: r for r in S.near_duplicate_report(frame(spark, rows, "k int, mk string, sq string, split string"), "k", "split", ("mk", "sq")).collect()}
    assert {k: r["side"] for k, r in out.items()} == {2: "mk", 3: "sq", 4: "both"} and all(r["train_match"] == 1 and r["train_match_mk"] == base and r["train_match_sq"] == other for r in out.values())


def test_digests(spark):
    import hashlib
    import json

    rows = [(0, "a", "é"), (1, 'q"', "b\\n\nx"), (2, "", "z")]
    df = frame(spark, rows, "i int, x string, y string").repartition(3)
    lines = [json.dumps([x, y], ensure_ascii=False) for _, x, y in rows]
    want = hashlib.sha256(b"".join(hashlib.sha256(t.encode()).digest() for t in lines)).hexdigest()
    assert S.content_sha256(df, "i", "x", "y") == want != S.content_sha256(df.where("i > 0"), "i", "x", "y")
    one = S.run_fingerprint({"b": 1, "a": 2}, df, "i", "x")
    assert one == S.run_fingerprint({"a": 2, "b": 1}, df, "i", "x") and S.refuse_mixed_runs(None, one, "here") == one
    with pytest.raises(ValueError):
        S.refuse_mixed_runs(one, S.run_fingerprint({"a": 3}, df, "i", "x"), "here")


def test_partner_cosines(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "k int, v array<double>")
    p = frame(spark, [(1, 3, 1), (1, 2, 2), (2, 9, 1)], "k int, partner int, rank int")
    assert {r["k"]: r["cosines"] for r in S.partner_cosines(v, "k", "v", p, 2).collect()} == {1: [0.6, 0.0], 2: [None, None], 3: [None, None]}


# -- metrics


def test_statistics_against_counters():
    rng = random.Random(6)
    make = lambda: " ".join(rng.choice(["ab", "a", "b,", "(c)", "d.", "é1", "2.5", "-"]) for _ in range(rng.randint(0, 25)))
    hyps, refs = [make() for _ in range(80)], [make() for _ in range(80)]

    def counts(a, b, n):
        x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
        return sum(x.values()), sum(y.values()), sum((x & y).values())

    for h, r, got in zip(hyps, refs, M.statistics(hyps, refs).tolist()):
        t, u = M.tokens_13a(h), M.tokens_13a(r)
        want = [len(t), len(u)]
        for n in range(1, 5):
            a, _, both = counts(t, u, n)
            want += [both, a]
        for x, y, most in (("".join(h.split()), "".join(r.split()), 6), (M._split_punctuation(h), M._split_punctuation(r), 2)):
            for n in range(1, most + 1):
                a, b, both = counts(x, y, n)
                want += [a if b else 0, b, both]
        assert got == want


def test_chrf_by_hand():
    # "abc" against "abd": characters 2/3 and 2/3, 1/2 and 1/2, 0 and 0; words 0 of 1
    assert M.chrf_score(M.chrf_row("abc", "abd")) == pytest.approx(100 * (2 / 3 + 1 / 2) / 4)


def test_bootstrap_against_a_loop(spark):
    import numpy as np

    rng = random.Random(9)
    words = "a b c d e f g h".split()
    rows = [(i, *(" ".join(rng.choice(words) for _ in range(12)) for _ in range(3))) for i in range(30)]
    df = frame(spark, rows, "i long, base string, other string, ref string")
    n = 50
    out = {r["metric"]: r for r in M.paired_bootstrap(df.repartition(3), F.col("i"), F.col("base"), F.col("other"), F.col("ref"), n).collect()}
    seeds = {r["i"]: r["h"] for r in df.select("i", F.xxhash64(F.lit(42), F.col("i").cast("string")).alias("h")).collect()}
    stats = [M.statistics([r[c] for r in rows], [r[3] for r in rows]) for c in (1, 2)]
    weights = np.array([np.random.default_rng(seeds[r[0]] & (2**63 - 1)).poisson(1.0, n) for r in rows])
    d = []
    for b in range(n):
        x, y = (weights[:, b] @ s for s in stats)
        d.append((M.bleu_score(y[: M.BLEU_SIZE]) - M.bleu_score(x[: M.BLEU_SIZE]), M.chrf_score(y[M.BLEU_SIZE :]) - M.chrf_score(x[M.BLEU_SIZE :])))
    for m, column in (("bleu", 0), ("chrf", 1)):
        v = np.array([x[column] for x in d])
        low = (v <= 0).mean()
        want = (v.mean(), np.quantile(v, 0.025), np.quantile(v, 0.975), min(1.0, max(1 / n, 2 * min(low, 1 - low))))
        assert tuple(out[m][c] for c in ("delta_mean", "low", "high", "p")) == pytest.approx(want)


def test_untraced_numbers(spark):
    lines = frame(spark, [("# 99 head",), ("score 12.35 and 1,234 (`77`) §3.1 at 2020-01-01T10:00:00Z",), ("delta -0.5 and 8",), ("| 41 |",)], "l string")
    values = frame(spark, [(12.3456,), (1234.0,), (0.5,), (-8.0,)], "v double")
    assert sorted(r["number"] for r in M.untraced_numbers(lines, "l", values, "v").collect()) == ["41"]

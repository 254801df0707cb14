import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import rows
from compare import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import bpe, chat, fingerprint, langid, mixing, neardup, quality, queries, repeats, sharding, suffixes, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


# -- 1 language ID


def test_langid_held_out_accuracy(spark, docs):
    out = queries.op1_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 30 and sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_langid_edges(edge, empty, docs):
    model = langid.fit(docs)
    out = langid.identify(edge, model, [F.col("doc_id"), F.col("text")]).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(edge, nothing).collect()} == {"und"}


def test_langid_spans_and_scripts(spark):
    rows_ = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog were in the house", "en"), ("кот и собака были в доме", "ru"), ("le chat et le chien sont dans la maison", "fr")] * 40)]
    model = langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    assert [s[2] for s in model.spans("the cat and the dog were in the house кот и собака были в доме")] == ["en", "ru"]
    assert model.predict(["кот дом"])[0][0] == "ru"


def test_langid_viterbi_is_best(docs):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), np.ones((langid.OTHER + 1, 3), bool))
    words = {f"w{chr(97 + i)}": rng.normal(0, 4, 3).astype(np.float32) for i in range(6)}
    model.remember(list(words), np.stack(list(words.values())), np.ones(len(words), np.int64))
    import itertools

    for n in (1, 2, 5):
        text = [list(words)[i] for i in rng.integers(0, 6, n)]
        value = lambda p: sum(words[w][x] for w, x in zip(text, p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        got = model.label([" ".join(text)])[0][0]
        assert value(got) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-4)


# -- 2 mixing


def test_mixing_targets_and_edges(edge, empty):
    out = mixing.mix(edge).toPandas()
    assert len(out) == edge.count() and (out.taken <= 3 * out["size"]).all()
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(edge)
    assert copies.columns == edge.columns and copies.count() == out.copies.sum()
    assert rows(mixing.mix(edge).toPandas()) == rows(mixing.mix(edge.repartition(3)).toPandas())


def test_mixing_levels():
    knots = ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6))
    area = lambda t: sum(min(max(t - a, 0), b - a) * (x + (y - x) * min(max(t - a, 0), b - a) / (b - a) / 2) for (a, x), (b, y) in zip(knots, knots[1:]))
    assert area(1.0) == pytest.approx(1.0)


def test_mixing_inverts_its_schedule(spark):
    knots = ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6))
    got = spark.range(0, 101).select((F.col("id") / 100).alias("y")).select("y", mixing.invert(F.col("y"), knots).alias("t")).collect()
    for r in got:
        t, total = r["t"], 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            u = min(max(t - a, 0.0), b - a)
            total += u * x + (y - x) / (b - a) * u * u / 2
        assert total == pytest.approx(r["y"], abs=1e-9)


# -- 3 sharding


def check_shards(out, held, n, law):
    """Every row once, with its size and checksum; gapless slots; balance by the law."""
    want = Counter((r["doc_id"], 16 + len((r["text"] or "").encode()), zlib.crc32((r["text"] or "").encode())) for r in held)
    assert Counter(zip(out.doc_id, out["size"], out.text_crc32)) == want
    sizes = out.groupby("shard")["slot"].agg(["min", "max", "count", "nunique"])
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all() and out["shard"].between(0, n - 1).all()
    if law == "rows":
        assert len(sizes) == min(n, len(held)) and sizes["count"].max() - sizes["count"].min() <= 1
    else:
        assert out.groupby("shard")["size"].sum().max() <= out["size"].sum() / n * (1 + sharding.SLACK) + 30 * out["size"].max()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_loses_and_repeats_no_row(spark, law):
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    held = more.collect()
    for n in (2, 3, 20, 40, 41, 64):
        check_shards(sharding.shard(more, n, law=law).toPandas(), held, n, law)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_is_balanced_and_gapless(docs, law):
    out = sharding.shard(docs.unionByName(docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(90)))).drop("n")), 7, law=law).toPandas()
    assert len(out) == docs.count() + 90
    groups = out.groupby("shard")
    assert all(sorted(g) == list(range(len(g))) for _, g in groups["slot"])
    if law == "rows":
        assert groups.size().max() - groups.size().min() <= 1
    else:
        assert groups["size"].sum().max() <= out["size"].sum() / 7 * (1 + sharding.SLACK) + 30 * out["size"].max()


def test_sharding_edges(edge, empty):
    out = sharding.shard(edge, 4).toPandas()
    want = sorted((16 + len((r["text"] or "").encode()), zlib.crc32(r["text"].encode()) if r["text"] is not None else -1) for r in edge.collect())
    assert sorted(zip(out["size"], out.text_crc32.fillna(-1).astype(int))) == want
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_moves_little(docs):
    a, b = (sharding.shard(docs, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (10, 11))
    moved = a.join(b, "doc_id").where("s10 <> s11").count() / docs.count()
    assert moved < 0.5  # dealing anew would move ten in eleven


# -- 4 near duplicates


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return set(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else set()


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(n=120, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))] if rng.random() < 0.3 or not out else list(rng.choice(out))
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = f"v{rng.randint(0, 50)}"
        out.append(base)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("small", [8000, 6])
def test_neardup_matches_brute_force(spark, small):
    """With small=6 nodes are branched and cut into blocks."""
    texts = near_texts()
    out = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 85, 3, small=small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_neardup_query_matches_brute_force(spark, docs):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_neardup(spark, SF).collect()}
    assert out == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 85)


def test_neardup_edges(edge, empty):
    out = neardup.near_duplicates(edge, 85, 3).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert len(out) == edge.count() and [r["component_id"] for r in by[1]] == [1, 1] and by[9][0]["component_id"] == 1
    assert by[3][0]["n_shingles"] == 0 and by[3][0]["kept"] and by[4][0]["component_id"] == 4 and by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert neardup.near_duplicates(empty, 85, 3).count() == 0


# -- 5 chat


def test_chat_edges(spark):
    odd = [(1, 2, "assistant", "b"), (1, 1, "user", "### a </turn>\n\\"), (1, 3, "assistant", None), (2, 1, None, "####"), (None, 1, "a\n:b", "x"), (1, 2, "assistant", "b"), (3, None, "user", "\\#\\###")]
    df = spark.createDataFrame(odd, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(1))
    out = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text in odd:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in out[c]["turns"]] == [x[1:] for x in sorted(turns)]
    assert out[1]["learned"] == ["b", "b", ""] and out[1]["formatted"].count(chat.HEAD) == 2
    assert chat.format_chats(df.limit(0)).count() == 0


# -- 6 BPE


def test_bpe_equals_the_library(spark, edge, empty, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "1", "'s", "<|endoftext|>", ".", "日本", "😀", " the", "ing", "²", "x" * 150]
    odd = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 15)))) for i in range(400)]
    every = edge.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe(every, path).collect())
    want = Counter()
    for r in every.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.bpe(empty, path).count() == 0


# -- 7 repeats


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 14))] + [0]
        order = suffixes.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffixes.common_prefixes(s, order)
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removal(texts, length=400):
    seen = Counter(b[j : j + length] for _, t in texts for b in [(t or "").encode()] for j in range(len(b) - length + 1))
    for i, t in texts:
        b = (t or "").encode()
        flags = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                flags[j : j + length] = True
        yield i, len(b), int(flags.sum()), len(repeats.runs(flags)), hashlib.sha256(np.frombuffer(b, np.uint8)[~flags].tobytes()).hexdigest()


@pytest.mark.parametrize("crowd", [1000, 2])
def test_repeats_match_brute_force(spark, empty, monkeypatch, crowd):
    """With crowd=2 most cores have their windows dealt one by one."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abc é") for _ in range(rng.randint(300, 900))) for _ in range(8)]
    make = [lambda: rng.choice(passages), lambda: passages[0][rng.randint(0, 200) :][: rng.randint(350, 600)], lambda: "".join(rng.choice("xyz ") for _ in range(rng.randint(1, 300))), lambda: "ab" * rng.randint(1, 300), lambda: "a" * rng.randint(1, 500)]
    texts = [(i, "".join(rng.choice(make)() for _ in range(rng.randint(0, 5)))) for i in range(120)] + [(200, None), (201, ""), (None, passages[1])]
    out = repeats.removal(spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit(1))).collect()
    assert Counter(map(tuple, out)) == Counter(brute_removal(texts))
    assert repeats.removal(empty).count() == 0


def test_texts_without_repeats(spark):
    """The texts themselves, by a shorter length; a character that is cut goes whole, copies become empty."""
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcé 日") for _ in range(rng.randint(60, 200))) for _ in range(5)]
    texts = ["".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(0, 4))) for _ in range(60)] + [passages[0]] * 2 + ["", None]
    seen = Counter(b[j : j + 90] for t in texts for b in [(t or "").encode()] for j in range(len(b) - 89))
    want = Counter()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        flags = np.ones(len(raw), bool)
        for j in range(len(raw) - 89):
            if seen[raw[j : j + 90]] > 1:
                flags[j : j + 90] = False
        want[i, None if t is None else np.frombuffer(raw, np.uint8)[flags].tobytes().decode("utf-8", "ignore")] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("mine"))
    out = repeats.without_repeats(df, 90)
    assert out.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_repeats_query_matches_brute_force(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, queries.op7_repeats(spark, SF).collect())) == sorted(brute_removal(texts))


# -- 8 top-k


def test_topk_edges(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(301)]
    data += [(400, [1.0, float("nan"), 0.0, 0.0]), (500, None), (600, [1.0, None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (100, data[100][1]), (50, data[50][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = Counter(map(tuple, topk.top_k(df, shard=20).collect()))
    fine = [(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in data if i is not None and v and all(x is not None and x == x for x in v)]
    want = Counter()
    for n, (i, v) in enumerate(fine):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(fine) if m != n and len(w) == len(v))[:10]
            for rank, (s, j) in enumerate(scored, 1):
                want[i, rank, j, -s] += 1
    assert got == want == Counter(map(tuple, topk.top_k(df, shard=4000).collect()))
    assert topk.top_k(df.limit(0)).count() == 0


def test_ball_tree_search_is_exact():
    """Several levels of nodes, crowded and equal vectors, with and without a score to start from."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-300, 300, (2000, 6)), np.repeat(rng.integers(-300, 300, (3, 6)), 300, axis=0)])
    ids, many = np.arange(len(x)), np.ones(len(x), np.int32)
    tree = topk.Shard(ids, x, many)
    assert len(tree.nodes) > 10
    for q in (0, 7, 1999, 2000, 2700):
        scores = x @ x[q]
        want = sorted((-int(s), int(i)) for i, s in zip(ids, scores) if i != q)[:10]
        for kth in (-np.inf, -want[9][0]):
            assert [(s, i) for s, i, _ in tree.search(q, x[q], 10, kth)][:10] == want


def test_topk_waves_pass_the_kth_score_on(spark):
    """The search of later shards starts from the kth score of the first ones, and so returns less."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(400)], "id long, v array<double>").select("id", F.transform("v", lambda x: F.floor(x * 1024).cast("long")).alias("v"))
    candidates = df.withColumns({"many": F.lit(1), "shard": F.pmod(F.xxhash64("id", "v"), F.lit(4)).cast("int")})
    queries = df.where("id % 100 = 0").withColumns({"query": F.col("id"), "kth": F.lit(None).cast("long")})
    first = topk.search_shards(candidates, queries, 0, 1, 5).groupBy("query").agg(F.min("score").alias("low"))
    known = queries.drop("kth").join(first, "query").withColumnRenamed("low", "kth")
    assert topk.search_shards(candidates, known, 1, 4, 5).count() < topk.search_shards(candidates, queries, 1, 4, 5).count()


# -- 9 quality


def test_quality(spark, docs, edge, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.resample(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg("log_weight").alias("w"), F.avg(F.col("selected").cast("int")).alias("s")).collect()
    by = {r["quality"]: r for r in out}
    assert by[1]["w"] > by[0]["w"] and by[1]["s"] > by[0]["s"]
    whole = quality.resample(docs, labels)
    assert whole.where("selected").count() == docs.count() // 2 and rows(whole.toPandas()) == rows(quality.resample(docs.repartition(3), labels).toPandas())
    kept, rest = whole.where("selected").agg(F.min("key")).first()[0], whole.where("not selected").agg(F.max("key")).first()[0]
    assert kept >= rest
    assert quality.resample(edge, labels.limit(0)).count() == edge.count() and quality.resample(empty, labels).count() == 0


def plain_quality(rows_, good, share):
    """Log weights by loops over words and pairs, and the k highest keys."""
    counts = {i: Counter(quality.ngrams(t).tolist()) for i, (_, t) in enumerate(rows_)}
    raw, aim = sum(counts.values(), Counter()), sum((counts[i] for i, (d, _) in enumerate(rows_) if d in good), Counter())
    aim = aim or raw
    n, total, wanted = quality.BUCKETS, sum(raw.values()), sum(aim.values())
    smooth = {b: (raw[b] + 1) / (total + n) for b in raw}
    ratio = {b: np.log((aim[b] + n * smooth[b]) / (wanted + n)) - np.log(smooth[b]) for b in raw}
    return {i: sum(c * ratio[b] for b, c in counts[i].items()) for i in counts}


def test_quality_weights_and_sample_are_exact(spark):
    rng = random.Random(12)
    rows_ = [(rng.choice([None, *range(60)]), rng.choice([None, "", "x", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(40))])) for _ in range(300)]
    rows_ += [(7, "same text")] * 80
    good = set(range(0, 60, 3))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good] * 2 + [(1, 0), (None, 1)], "doc_id long, quality int")
    out = quality.resample(df, labels, 0.3).collect()
    want = plain_quality(rows_, good, 0.3)
    got = Counter((r["doc_id"], round(r["log_weight"], 6)) for r in out)
    assert got == Counter((d, round(want[i], 6)) for i, (d, _) in enumerate(rows_))
    noise = {r["doc_id"]: r["g"] for r in df.select("doc_id").distinct().select("doc_id", (-F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 40)) + 0.5) / float(1 << 40)))).alias("g")).collect()}
    assert all(r["key"] == pytest.approx(r["log_weight"] + noise[r["doc_id"]]) for r in out)
    keys = sorted((r["key"] for r in out), reverse=True)
    k = int(len(rows_) * 0.3)
    assert sum(r["selected"] for r in out) == k and all(r["selected"] if r["key"] > keys[k - 1] else not r["selected"] if r["key"] < keys[k - 1] else True for r in out)


@pytest.mark.parametrize("values", [[1.0] * 50, [1e300, -1e300, 0.0, 1e-300, 5.0] * 4, [float(i) for i in range(100)] + [1e9], [0.0, 5e-324]])
def test_kth_highest_is_a_sort(spark, values):
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "v double, n long")
    every = sorted((v for i, v in enumerate(values) for _ in range(1 + i % 3)), reverse=True)
    for k in (1, 2, len(every) // 2, len(every)):
        assert quality.kth_highest(df, "v", k) == (every[k - 1], sum(v > every[k - 1] for v in every))
    assert quality.kth_highest(df, "v", 0)[0] is None and quality.kth_highest(df.limit(0), "v", 3)[0] is None


# -- 10 fingerprints


def test_fingerprints(spark, docs, edge, empty):
    out = {r["doc_id"]: r for r in queries.op10_fingerprint(spark, SF).collect()}
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    error = []
    for n, (i, t) in enumerate(texts):
        nxt = texts[(n + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = shingles(t, 5), shingles(other, 5)
            error.append(abs(len(a & b) / max(1, len(a | b)) - out[i][column]))
    assert max(error) < 0.2 and sum(error) / len(error) < 0.03
    prints = {}
    assert all(prints.setdefault(t, out[i]["fingerprint"]) == out[i]["fingerprint"] for i, t in texts)
    assert fingerprint.fingerprint_edits(edge).count() == edge.count() and fingerprint.fingerprint_edits(empty).count() == 0
    assert fingerprint.fingerprints(edge).count() == edge.count()


def test_fingerprint_ranges_change_no_result(spark, monkeypatch):
    """Null and repeated ids lie in several ranges; pairs are those of one sorted list."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(rng.choice([None, 5, *range(40)]), t) for t in texts], "doc_id long, text string")
    one = Counter(map(tuple, fingerprint.fingerprint_edits(df).collect()))
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    assert Counter(map(tuple, fingerprint.fingerprint_edits(df).collect())) == one
    ties = {r["text"]: r["tie"] for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: fingerprint.rank(x[0], ties[x[1]]))
    want = Counter()
    for n, (i, t) in enumerate(order):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + order[(n + 1) % len(order)][1][:half]).encode()).hexdigest()] += 1
    assert Counter(x[:3] for x in one.elements()) == want


def test_langid_matches_a_plain_version(spark, docs):
    """Scores of every word by a loop over its n-grams, and Viterbi by a loop over languages."""
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(25).collect()] + ["", "12 ?", "the der le el кот", "x" * 60]

    def word_scores(word):
        total = np.zeros(len(model.langs))
        for piece in langid.pieces(word):
            spots = langid.features([piece])[0]
            likely = model.table[spots].astype(float).sum(axis=0) * min(len(piece), 8) / max(len(spots), 1)
            allowed = model.allowed[langid.script(piece[0])]
            if allowed.any():
                likely = np.where(allowed, likely, likely[allowed].min() - 8.0)
            total += likely - likely.max()
        return total - total.max()

    for text, (lang, score) in zip(texts, model.predict(texts)):
        words = text.split()
        table = [word_scores(w) for w in words]
        best, came = np.zeros(len(model.langs)), []
        for n, s in enumerate(table):
            if n:
                jump = best.max() - langid.SWITCH
                came.append([i if best[i] >= jump else int(best.argmax()) for i in range(len(best))])
                best = np.maximum(best, jump)
            best = best + s
        path = [int(best.argmax())] if words else []
        for back in reversed(came):
            path.append(back[path[-1]])
        letters = [sum(map(len, langid.pieces(w))) for w in words]
        held = Counter()
        for x, n in zip(reversed(path), letters):
            held[model.langs[x]] += n
        assert lang == ("und" if not sum(letters) else max(sorted(held), key=held.__getitem__)) and 0 <= score <= 1

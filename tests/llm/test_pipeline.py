import corpus_pipeline as cp
import hashlib
import public_tokenizers
import random
from compare import SF
from pyspark.sql import functions as F
from test_operators import brute_components, near_texts
from tokenizers import Tokenizer

import numpy as np


def test_stages_against_plain_versions(spark, docs, tmp_path):
    held = docs.collect()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        rows = new.collect()
        if name == "language_id":
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in held if any(c.isalpha() for c in r["text"] or ""))
        elif name == "near_dedup":
            want = brute_components([(r["doc_id"], r["text"]) for r in held], 5, 80)
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, c in want.values()})
        elif name == "repeats":
            want = dict(zip([r["doc_id"] for r in held], brute_passages([r["text"] for r in held])))
            assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t in want.items() if t.strip(" ")}
        elif name == "mixing":
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in held}
            words, taken = sum(len(r["text"].encode().split()) for r in held), sum(len(r["text"].encode().split()) for r in rows)
            assert abs(taken - words) < 0.2 * words
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            texts = sorted((r["doc_id"], hashlib.sha256(np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in held)
            assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == texts
        if name != "bpe":
            assert new.columns == docs.columns
        docs, held = new, rows


def test_near_dedup_keeps_one_row_of_every_component(spark):
    """Null ids, and ids that several texts share; survivors are told by their place in n_chars."""
    texts = [t for _, t in near_texts(150, 4)]
    rng = random.Random(8)
    ids = [None if rng.random() < 0.4 else rng.randint(1, 25) for _ in texts]
    held = [(i, t, "en", "a", n) for n, (i, t) in enumerate(zip(ids, texts))]
    comp = brute_components(list(enumerate(texts)), 5, 80)
    groups = {}
    for n, (_, c) in comp.items():
        groups.setdefault(c if texts[n] else ("empty", ids[n]), []).append(n)
    out = [r["n_chars"] for r in cp.deduplicate(spark, spark.createDataFrame(held, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()]
    assert len(out) == len(groups) and sum(ids[n] is None for n in out) > 5
    for rows in groups.values():
        (one,) = [n for n in out if n in rows]
        assert ids[one] == min((ids[n] for n in rows if ids[n] is not None), default=None)
    five = [(None, "a b c d e f g", "en", "a", 1), (None, "h i j k l m n", "en", "a", 2), (7, "o p q r s t u", "en", "a", 3), (7, "v w x y z a b", "en", "a", 4), (None, "o p q r s t u", "en", "a", 5), (None, "a b c d e f g", "en", "a", 6)]
    out = cp.deduplicate(spark, spark.createDataFrame(five, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(min(r["n_chars"], 1) if r["text"][0] == "a" else r["n_chars"] for r in out) == [1, 2, 3, 4]


def test_stages_on_edges(spark, edge, empty):
    for frame in (edge, empty):
        for _, stage in cp.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= 3 * max(1, frame.count())


def brute_passages(texts, words=50, length=400):
    """Texts without every repeat of over 50 words or of 400 bytes, judged on the input."""
    import re
    from collections import Counter

    spans = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    names = [[t[a:b] for a, b in s] for t, s in zip(texts, spans)]
    seen = Counter(tuple(w[j : j + words + 1]) for w in names for j in range(len(w) - words))
    held = Counter(t.encode()[j : j + length] for t in texts for j in range(len(t.encode()) - length + 1))
    for t, s, w in zip(texts, spans, names):
        raw = t.encode()
        flags = np.ones(len(raw), bool)
        gone = {k for j in range(len(w) - words) if seen[tuple(w[j : j + words + 1])] > 1 for k in range(j, j + words + 1)}
        for k in gone:  # with the white space between words that go
            flags[len(t[: s[k][0]].encode()) : len(t[: s[k + 1][0] if k + 1 in gone else s[k][1]].encode())] = False
        for j in range(len(raw) - length + 1):
            if held[raw[j : j + length]] > 1:
                flags[j : j + length] = False
        yield np.frombuffer(raw, np.uint8)[flags].tobytes().decode("utf-8", "ignore")


def test_repeats_of_over_fifty_words(spark, docs):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(1, k)))
    make = lambda n, k=3: " ".join(word(k) for _ in range(n))
    short, limit, wide, chinese = make(51), make(50), make(51), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(150))
    assert len(short.encode()) < 400
    texts = [f"{make(20, 9)} {x} {make(15, 9)}" for x in (short, short, limit, limit, wide, wide.replace(" ", "\n\u00a0", 20), f"{short} {short}", chinese, chinese)]
    texts += [make(60), "", " \n "] + [make(51)] * 2
    texts += [r["text"] for r in docs.collect()]
    out = cp.strip_repeats(spark, spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long"), SF).collect()
    want = {i: t for i, t in enumerate(brute_passages(texts)) if t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert short not in want[0] and limit in want[2] and chinese not in want[7] and all(r["n_chars"] == len(r["text"]) for r in out)

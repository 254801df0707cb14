"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script (by code point ranges) leaves as candidates the languages that use it. Each candidate's score is the
mean log-likelihood of the word's hashed character n-grams (1 to 4, with word ends) times a damped length. Over a text's
words, Viterbi with a cost for each switch finds the best sequence of languages, so mixed texts fall into spans. The
text's language is the one with most letters; its score is the share of letters that it labels, times the mean
posterior of its words.

The model is fitted on a bounded sample: per language at most SAMPLE whole texts, those with the smallest hash of their
id, from rows that are not held out (crc32 of the id as text, mod 4, is not 2). Its size is fixed by BUCKETS and the
number of languages. Prediction sees the text only.

Defined results: null text and texts without a letter are `und` with score 0; if nothing can be learned, all are; rows
with null lang or null id teach nothing, a null id is not held out; ties go to the first language by code point;
repeated rows give repeated results; whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .runtime import ship, task

BUCKETS, ORDERS, SAMPLE, SWITCH, MIN_SHARE, KNOWN = 1 << 16, (1, 2, 3, 4), 1500, 6.0, 0.02, 150_000
#: Code point ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("cyrillic", ((0x400, 0x52F),)), ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)), ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("devanagari", ((0x900, 0x97F),)), ("bengali", ((0x980, 0x9FF),)), ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)), ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)), ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
OTHER = len(SCRIPTS)
PIECE = 24


@lru_cache(1 << 16)
def script(letter: str) -> int:
    c = ord(letter)
    return next((n for n, (_, ranges) in enumerate(SCRIPTS) if any(a <= c <= b for a, b in ranges)), OTHER)


def pieces(word: str) -> list[str]:
    """The word's lower-case letters, cut where the script changes and at PIECE letters."""
    word = word.lower()
    if word.isascii():
        bare = word if word.isalpha() else word[:-1] if word[:-1].isalpha() else "".join(filter(str.isalpha, word))
        if len(bare) <= PIECE:
            return [bare] if bare else []
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return []
    out, last = [[letters[0]]], script(letters[0])
    for c in letters[1:]:
        now = last if c < "\x7f" and last == 0 else script(c)
        if now != last or len(out[-1]) >= PIECE:
            out.append([])
        out[-1].append(c)
        last = now
    return ["".join(x) for x in out]


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, part) of every n-gram of these pieces, with a space at either end of each."""
    codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    part = np.cumsum(space) - 1
    buckets, owners = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            break
        h, ok = np.full(size, n, np.uint64), np.ones(size, bool)
        for i in range(n):
            h = (h ^ codes[i : size + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n == 1 or 0 < i < n - 1:
                ok &= ~space[i : size + i]
        if n == 2:
            ok &= ~(space[:size] & space[1 : size + 1])
        buckets.append((h[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(part[:size][ok])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """langs, log-likelihood table (buckets x langs), allowed (scripts x langs)."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed
        self.clear()

    def clear(self) -> None:
        """Known words by their row in `scores` (relative to the best) and `letters`, and an older generation of them."""
        self.known: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        self.older: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, self.scores, self.letters)

    def remember(self, words: list[str], scores: np.ndarray, letters: np.ndarray) -> None:
        start, end = len(self.known), len(self.known) + len(words)
        if end > len(self.scores):
            grown = max(end, 2 * len(self.scores), 1024)
            self.scores, self.letters = (np.concatenate([x, np.zeros((grown - len(x), *x.shape[1:]), x.dtype)]) for x in (self.scores, self.letters))
        self.scores[start:end], self.letters[start:end] = scores, letters
        self.known.update(zip(words, range(start, end)))

    def learn(self, words: set[str]) -> None:
        """Makes all these words known. Scores of a batch's new words are computed together; what is known is kept in two
        generations of bounded size, and words of the older one that are met again come back."""
        if len(self.known) > KNOWN:
            older = self.known, self.scores, self.letters
            self.clear()
            self.older = older
        new = list(words.difference(self.known))
        names, scores, letters = self.older
        if again := [w for w in new if w in names]:
            rows = np.fromiter(map(names.__getitem__, again), np.int64, len(again))
            self.remember(again, scores[rows], letters[rows])
            new = [w for w in new if w not in names]
        k = len(self.langs)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            cut = [pieces(w) for w in part]
            flat = [p for ps in cut for p in ps]
            total = np.zeros((len(part), k))
            counts = np.fromiter((sum(map(len, ps)) for ps in cut), np.int64, len(part))
            if flat:
                sizes = np.fromiter(map(len, flat), np.int64, len(flat))
                owner = np.repeat(np.arange(len(part)), np.fromiter(map(len, cut), np.int64, len(cut)))
                buckets, of = features(flat)
                many = np.maximum(np.bincount(of, minlength=len(flat)), 1)
                likely = np.stack([np.bincount(of, self.table[buckets, n], len(flat)) for n in range(k)], axis=1)
                likely *= (np.minimum(sizes, 8) / many)[:, None]
                allowed = self.allowed[[script(p[0]) for p in flat]]
                least = np.where(allowed, likely, np.inf).min(axis=1, keepdims=True)
                likely = np.where(allowed | ~np.isfinite(least), likely, least - 8.0)
                likely -= likely.max(axis=1, keepdims=True)
                total = np.stack([np.bincount(owner, likely[:, n], len(part)) for n in range(k)], axis=1)
                total -= total.max(axis=1, keepdims=True)
            self.remember(part, total.astype(np.float32), counts)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Each text's words' languages by Viterbi, their letters, and the posterior of that language for each word."""
        words = [x.split() for x in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        self.learn(set().union(*words))
        k = len(self.langs)
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        scores, letters = self.scores[rows], self.letters[rows]
        # lanes, longest first, advance one word a step; at each step only those that still have words are active
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order] if len(sizes) else np.zeros(0, np.int64)
        longest = sizes[order]
        steps = int(longest[0]) if len(longest) else 0
        active = np.searchsorted(-longest, -np.arange(steps), side="left")
        best = np.zeros((len(sizes), k), np.float32)
        kind = np.int8 if k <= 127 else np.int16
        came = np.zeros((len(scores), k), kind)
        stay = np.arange(k, dtype=kind)
        for t in range(steps):
            n = active[t]
            at = starts[:n] + t
            b = best[:n]
            if t:
                top = b.argmax(axis=1)
                jump = (b[np.arange(n), top] - np.float32(SWITCH))[:, None]
                came[at] = np.where(b >= jump, stay, top[:, None].astype(kind))
                b = np.maximum(b, jump)
            best[:n] = b + scores[at]
        state = best.argmax(axis=1) if len(best) else np.zeros(0, np.int64)
        path = np.zeros(len(scores), kind)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = came[at, state[:n]]
        spread = np.exp(scores)
        post = spread[np.arange(len(scores)), path] / spread.sum(axis=1) if len(scores) else np.zeros(0)
        cuts = np.cumsum(sizes)[:-1]
        return np.split(path, cuts), np.split(letters, cuts), np.split(post, cuts)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each span of one language."""
        path = self.label([text])[0][0]
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else [0]
        return [(a, b, self.langs[path[a]]) for a, b in zip(edges, edges[1:])]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for path, letters, post in zip(*self.label([x or "" for x in texts])) if self.langs and texts else ():
            held = np.bincount(path, weights=letters, minlength=len(self.langs)) if len(path) else np.zeros(len(self.langs))
            if not held.sum():
                out.append(("und", 0.0))
                continue
            top = int(held.argmax())
            own = path == top
            out.append((self.langs[top], float(held[top] / held.sum() * (letters[own] * post[own]).sum() / held[top])))
        return out or [("und", 0.0)] * len(texts)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Counts of n-gram buckets by language over the sampled texts."""
    ship(docs.sparkSession)
    mine = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in mine.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((OTHER + 1, 0), bool))
    langs = sorted(sizes)
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    pick = F.lit(False)
    for lang in langs:
        pick = pick | ((F.col(lang_col) == lang) & (spot < int((1 << 30) * min(1.0, sample / sizes[lang]))))

    @task
    def count(batches):
        table, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), OTHER + 1), np.int64)
        words: dict[str, Counter] = {x: Counter() for x in langs}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                words[lang].update(text.as_py().split())
        for n, lang in enumerate(langs):
            items = list(words[lang].items())
            for start in range(0, len(items), 20_000):
                flat = [(p, c) for w, c in items[start : start + 20_000] for p in pieces(w)]
                if flat:
                    buckets, of = features([p for p, _ in flat])
                    table[n] += np.bincount(buckets, np.array([c for _, c in flat], float)[of], BUCKETS)
                    for p, c in flat:
                        scripts[n, script(p[0])] += c * len(p)
        for n in range(len(langs)):
            for kind, counts in ((0, table[n]), (1, scripts[n])):
                i = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n), pa.int32()), pa.array(np.full(len(i), kind), pa.int32()), pa.array(i, pa.int32()), pa.array(counts[i].astype(np.int64), pa.int64())], names=["lang", "kind", "slot", "n"])

    found = mine.where(pick).select(text_col, lang_col).mapInArrow(count, "lang int, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((OTHER + 1, len(langs)))
    for kind, into in ((0, table), (1, scripts)):
        part = found[found["kind"] == kind]
        into[part["slot"], part["lang"]] = part["n"]
    prior = (table.sum(axis=1, keepdims=True) + 1) / (table.sum() + BUCKETS)
    likely = np.log((table + 4 * BUCKETS ** 0.5 * prior) / (table.sum(axis=0) + 4 * BUCKETS ** 0.5)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, likely, share >= MIN_SHARE)


def identify(docs: DataFrame, model: Model, payload: list[Column] | None = None, id_col="doc_id", text_col="text", spans: bool = False) -> DataFrame:
    """payload columns (the id), lang_pred, score; with spans=True also array<struct<first,after,lang>> by words."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.allowed))
    kept = docs.select(*(payload or [F.col(id_col)]))
    names = kept.columns
    if text_col not in names:  # a text that is handed on anyway is sent once
        kept = docs.select(*(payload or [F.col(id_col)]), F.col(text_col).alias("__text"))
    place = names.index(text_col) if text_col in names else len(names)

    @task
    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(place).to_pylist()
                found = m.predict(texts)
                out = [*(part.column(n) for n in range(len(names))), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())]))
                    out.append(pa.array([[dict(zip(("first", "after", "lang"), s)) for s in m.spans(x or "")] if m.langs else [] for x in texts], kind))
                yield pa.RecordBatch.from_arrays(out, names=[*names, "lang_pred", "score", *["spans"] * spans])

    schema = T.StructType(kept.schema.fields[: len(names)]).add("lang_pred", "string").add("score", "double")
    if spans:
        schema.add("spans", "array<struct<first:int,after:int,lang:string>>")
    return kept.mapInArrow(run, schema)

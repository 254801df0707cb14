"""Shingles, MinHash with banded LSH, exact Jaccard and cosine."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

PERMUTATIONS = 128
PRIME_31 = 4294967311
MERSENNE = np.uint64((1 << 61) - 1)


def char_shingles(text: Column, k: int = 5) -> Column:
    """All k-grams; a shorter text yields itself, the empty text none."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))  # linear, where substring() is not
    return F.when(F.length(text) >= k, every).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def shingle_set(text: Column, k: int = 5) -> Column:
    """Distinct CRC-32 values of the shingles, in one place: materialise it before nesting it in a lambda."""
    return F.array_distinct(F.transform(char_shingles(text, k), lambda s: F.crc32(s.cast("binary"))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def text_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def _grams(text: str, k: int = 5) -> list[str]:
    return [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []


@F.pandas_udf(ArrayType(LongType()))
def minhash_affine(texts: pd.Series) -> pd.Series:
    """128 minima of (a h + b) mod 4294967311 over CRC-32 shingle hashes, coefficients from seed 42."""
    rng = np.random.default_rng(42)
    a, b = rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.int64), rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.int64)

    def one(text):
        h = np.unique(np.array([zlib.crc32(g.encode()) for g in _grams(text or "")], np.int64))
        if not len(h):
            return None
        low = np.full(PERMUTATIONS, PRIME_31, np.int64)
        for start in range(0, len(h), 2048):
            low = np.minimum(low, ((a[:, None] * h[start : start + 2048] + b[:, None]) % PRIME_31).min(axis=1))
        return low

    return texts.map(one)


_SHA_COEFFICIENTS: list[np.ndarray] = []


def _sha_coefficients() -> np.ndarray:
    if not _SHA_COEFFICIENTS:
        rng = np.random.RandomState(1)
        _SHA_COEFFICIENTS.append(np.array([(rng.randint(1, int(MERSENNE), dtype=np.uint64), rng.randint(0, int(MERSENNE), dtype=np.uint64)) for _ in range(PERMUTATIONS)], np.uint64).T)
    return _SHA_COEFFICIENTS[0]


_BUFFERS: list[np.ndarray] = []


def _sha_minima(h: np.ndarray) -> np.ndarray:
    """The low 32 bits of (a h + b) mod 2^61 - 1, their minima for each of the 128 (a, b). With x = a h + b + 1 they are
    x + (x >> 61) - 1, but for the few x whose fold passes the prime; those show as at most 8, and then all is done plainly."""
    a, b = (v[:, None] for v in _sha_coefficients())
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    if not _BUFFERS:
        _BUFFERS.extend(np.empty((PERMUTATIONS, 448), t) for t in (np.uint64, np.uint64, np.uint32))
    x, top, part = _BUFFERS
    for start in range(0, len(h), 448):
        some = h[start : start + 448]
        n = len(some)
        np.multiply(a, some, out=x[:, :n])
        np.add(x[:, :n], b + np.uint64(1), out=x[:, :n])
        np.right_shift(x[:, :n], np.uint64(61), out=top[:, :n])
        np.add(x[:, :n], top[:, :n], out=top[:, :n])
        np.copyto(part[:, :n], top[:, :n], casting="unsafe")
        np.minimum(low, part[:, :n].min(axis=1), out=low)
    if low.min() > 8:
        return low - np.uint32(1)
    low[:] = 0xFFFFFFFF
    for start in range(0, len(h), 2048):
        x = a * h[start : start + 2048] + b
        x = (x & MERSENNE) + (x >> np.uint64(61))
        x = np.where(x >= MERSENNE, x - MERSENNE, x)
        low = np.minimum(low, (x & np.uint64(0xFFFFFFFF)).min(axis=1).astype(np.uint32))
    return low


def _sha_hash(gram: str) -> int:
    return int.from_bytes(hashlib.sha1(gram.encode()).digest()[:4], "little")


class _Grams:
    """Hashes of 5-grams, each made once while it is known: a gram is five letters of 12 bits, the letters are numbered as
    they come. Full alphabets and full stores begin anew, so both are bounded."""

    LETTERS, STORE, CHUNK = 1 << 12, 1 << 20, 1 << 16

    def __init__(self):
        self.clear()

    def clear(self):
        self.number, self.letters = np.full(0x110000, -1, np.int32), np.empty(0, np.uint32)
        self.codes, self.hashes = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def numbered(self, points: np.ndarray) -> np.ndarray | None:
        """The distinct codes of the grams of these code points, None where the alphabet has no room for them."""
        ids = self.number[points]
        if ids.min() < 0:
            new = np.unique(points[ids < 0])
            if len(self.letters) + len(new) > self.LETTERS:
                return None
            self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, new])
            ids = self.number[points]
        ids, n = ids.astype(np.uint64), len(points) - 4
        code = ids[:n].copy()
        for i in range(1, 5):
            code = (code << np.uint64(12)) | ids[i : i + n]
        return _distinct(code)

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        """The hashes of codes that are distinct and in order."""
        at = np.searchsorted(self.codes, codes)
        new = np.ones(len(codes), bool)
        inside = at < len(self.codes)
        new[inside] = self.codes[at[inside]] != codes[inside]
        out = np.empty(len(codes), np.uint64)
        out[~new] = self.hashes[at[~new]]
        if new.any():
            fresh = codes[new]
            ids = (fresh[:, None] >> np.array([48, 36, 24, 12, 0], np.uint64)) & np.uint64(self.LETTERS - 1)
            text = self.letters[ids.astype(np.int64)].astype("<u4").tobytes().decode("utf-32-le")
            out[new] = np.array([_sha_hash(text[i : i + 5]) for i in range(0, len(text), 5)], np.uint64)
            if len(self.codes) + len(fresh) > self.STORE:
                self.codes, self.hashes = codes, out
            else:
                self.codes, self.hashes = np.insert(self.codes, at[new], fresh), np.insert(self.hashes, at[new], out[new])
        return out

    def signatures(self, texts: list[str]) -> list[np.ndarray | None]:
        found: list = [None] * len(texts)
        waiting, held = [], 0

        def put(row, low):
            found[row] = low if found[row] is None else np.minimum(found[row], low)

        def settle():
            if waiting:
                every = _distinct(np.concatenate([c for _, c in waiting]))
                hashes = self.hashed(every)
                for row, codes in waiting:
                    put(row, _sha_minima(hashes[np.searchsorted(every, codes)]))
                waiting.clear()

        for row, text in enumerate(texts):
            if 0 < len(text) < 5:
                put(row, _sha_minima(np.array([_sha_hash(text)], np.uint64)))
            for start in range(0, len(text) - 4, self.CHUNK):
                piece = text[start : start + self.CHUNK + 4]
                points = np.frombuffer(piece.encode("utf-32-le"), "<u4")
                codes = self.numbered(points)
                if codes is None:
                    settle()
                    self.clear()
                    held, codes = 0, self.numbered(points)
                if codes is None:  # more than 4,096 different letters in one piece
                    put(row, _sha_minima(np.array([_sha_hash(g) for g in set(_grams(piece))], np.uint64)))
                    continue
                waiting.append((row, codes))
                held += len(codes)
                if held > 4 * self.CHUNK:
                    settle()
                    held = 0
        settle()
        return found


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


_GRAMS: list[_Grams] = []


def _sha_signatures(texts: list[str]) -> list[np.ndarray | None]:
    """By the store of this worker."""
    if not _GRAMS:
        _GRAMS.append(_Grams())
    return _GRAMS[0].signatures(texts)


@F.pandas_udf(ArrayType(LongType()))
def minhash_sha(texts: pd.Series) -> pd.Series:
    """128 minima over the first four SHA-1 bytes of each shingle, permuted modulo the Mersenne prime 2^61 - 1."""
    return pd.Series([x if x is None else x.astype(np.int64) for x in _sha_signatures([x or "" for x in texts])], dtype=object)


def bands(signature: Column, number: int = 16) -> Column:
    size = PERMUTATIONS // number
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.xxhash64(i, F.slice(signature, i * size + 1, F.lit(size))))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / PERMUTATIONS


def _met(probes: DataFrame, train: DataFrame, number: int) -> DataFrame:
    """(p, t) that collide in a band, and in how many. Only ids and band hashes meet."""
    banded = lambda df, n: df.select(n, F.explode(bands(F.col(f"{n}_sig"), number)).alias("band"))
    return banded(probes, "p").join(banded(train, "t"), "band").groupBy("p", "t").agg(F.count(F.lit(1)).alias("bands"))


def _once(df: DataFrame) -> DataFrame:
    """df, computed now and only once: in the checkpoint folder if the session has one, else on the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.localCheckpoint()


#: Train signatures of a band that one task compares with the band's probes, about.
BLOCK = 4096


def _best_of_blocks(placed: DataFrame, key_type) -> DataFrame:
    """(c, score, t) from (c, t, sig, band, part, probe): each probe class against the train classes of its band and part."""

    def run(batches):
        at, ts, sigs = None, [], []
        for batch in batches:
            c, t, sig = batch.column(0), batch.column(1), batch.column(2)
            values = sig.flatten().to_numpy().reshape(-1, PERMUTATIONS)
            band, part, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            if not len(band):
                continue
            turns = np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1]) | (probe[1:] != probe[:-1])) + 1
            of, scores, keys = [], [], []
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(band)]):
                if at != (band[lo], part[lo]):
                    at, ts, sigs = (band[lo], part[lo]), [], []
                if not probe[lo]:
                    ts.append(t.slice(lo, hi - lo))
                    sigs.append(values[lo:hi])
                    continue
                if not ts:
                    continue
                if len(ts) > 1:
                    ts, sigs = [pa.concat_arrays(ts)], [np.concatenate(sigs)]
                places = []
                for row in values[lo:hi]:
                    equal = (sigs[0] == row).sum(axis=1)
                    places.append(len(equal) - 1 - int(equal[::-1].argmax()))  # the last of the best: the larger key
                    scores.append(equal[places[-1]] / PERMUTATIONS)
                of.append(c.slice(lo, hi - lo))
                keys.append(ts[0].take(pa.array(places)))
            if of:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(of), pa.array(scores, pa.float64()), pa.concat_arrays(keys)], ["c", "score", "t"])

    schema = StructType([placed.schema["c"], StructField("score", DoubleType()), StructField("t", key_type)])
    return placed.select("c", "t", "sig", "band", "part", "probe").repartition("band", "part").sortWithinPartitions("band", "part", "probe", "t").mapInArrow(run, schema)


def best_match(train: DataFrame, probes: DataFrame, key: str, text: str, number: int = 8, family=minhash_sha) -> DataFrame:
    """For each probe, the train row of the highest estimated Jaccard among band collisions (ties: the larger key).
    Columns: key, match_key, max_jaccard (0 without a candidate). A text without shingles has no candidate.

    Signatures are made once. Rows of equal signatures are one class, which a train row in it settles. The other probe classes
    meet the train classes of their bands in blocks that make one row a probe, not one a pair.
    """
    side = lambda df, is_train: df.select(F.col(key).alias("k"), F.lit(is_train).alias("train"), family(F.col(text)).alias("sig"))
    c = F.when(F.col("sig").isNotNull(), F.concat_ws(" ", F.xxhash64("sig"), F.xxhash64(F.lit(1), F.col("sig"))))
    rows = _once(side(train, True).unionByName(side(probes, False)).withColumn("c", c))
    grouped = rows.where(F.col("c").isNotNull()).groupBy("c")
    role = F.max(F.when(F.col("train"), F.col("k"))).alias("t"), F.max(~F.col("train")).alias("probe")
    classes = grouped.agg(*role, F.first("sig").alias("sig"))
    banded = classes.select("c", F.col("t").isNull().alias("probe"), F.explode(bands(F.col("sig"), number)).alias("band"))
    met = banded.groupBy("band").agg(F.count_if(~F.col("probe")).alias("trains"), F.count(F.lit(1)).alias("all")).where("trains > 0 and trains < all")
    met = met.select("band", F.ceil(F.col("trains") / BLOCK).cast("int").alias("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    part = F.when(F.col("probe"), every).otherwise(F.array(F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")))
    placed = banded.join(met, "band").select("c", "probe", "band", F.explode(part).alias("part")).join(classes.select("c", "t", "sig"), "c")
    best = F.struct("score", "t").alias("m")
    searched = _best_of_blocks(placed, rows.schema["k"].dataType).groupBy("c").agg(F.max(best).alias("m"))
    settled = grouped.agg(*role).where(F.col("probe") & F.col("t").isNotNull()).select("c", F.struct(F.lit(1.0).alias("score"), "t").alias("m"))
    out = rows.where(~F.col("train")).select("k", "c").join(settled.unionByName(searched), "c", "left")
    return out.select(F.col("k").alias(key), F.col("m.t").alias("match_key"), F.coalesce("m.score", F.lit(0.0)).alias("max_jaccard"))


def near_matches(train: DataFrame, probes: DataFrame, key: str, text: str, threshold: float = 0.8, most: int | None = None) -> DataFrame:
    """(key, best_jaccard) of probes with a train text of at least the threshold. All texts that collide in a band are
    compared exactly; with `most`, only the candidates that collide in most bands, as a cost limit."""
    norm = lambda df, n: df.select(F.col(key).alias(n), F.col(text).alias(f"{n}_text")).withColumn(f"{n}_sig", minhash_affine(F.col(f"{n}_text")))
    t = norm(train.dropDuplicates([text]), "t")
    p = norm(probes, "p")
    met = _met(p, t, 16)
    if most is not None:
        met = met.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy(F.desc("bands"), "t"))).where(F.col("r") <= most)
    sets = lambda df, n: df.select(n, shingle_set(F.col(f"{n}_text")).alias(f"{n}_set"))
    scored = met.select("p", "t").join(sets(p, "p"), "p").join(sets(t, "t"), "t").withColumn("j", jaccard(F.col("p_set"), F.col("t_set")))
    return scored.where(F.col("j") >= threshold).groupBy(F.col("p").alias(key)).agg(F.max("j").alias("best_jaccard"))


def side_label(first_hit: Column, second_hit: Column, names: tuple[str, str] = ("mk", "sq")) -> Column:
    return F.when(first_hit & second_hit, "both").when(first_hit, names[0]).when(second_hit, names[1])


def overlap_class(exact: Column, best: Column, threshold: float = 0.8) -> Column:
    return F.when(exact, "exact_template").when(F.coalesce(best, F.lit(0.0)) >= threshold, "near_duplicate").otherwise("novel")


def best_side_key(first_score: Column, second_score: Column, first_key: Column, second_key: Column) -> Column:
    """The match behind the higher score; the first side wins ties, and a null score loses."""
    a, b = F.coalesce(first_score, F.lit(-1.0)), F.coalesce(second_score, F.lit(-1.0))
    return F.when(first_score.isNull() & second_score.isNull(), None).when(a >= b, first_key).otherwise(second_key)


#: Keys up to which a list of them is sent to all executors, so that the rows with texts stay where they are.
FEW = 200_000


def near_duplicate_report(df: DataFrame, key: str, split: str, sides: tuple[str, str], threshold: float = 0.85, number: int = 8, family=minhash_sha) -> DataFrame:
    """Of every pair that is not in train and whose first or second text (sides) nearly repeats one in train: the row, side
    (which), near_dup_max_jaccard, the key of the train pair behind the higher score, and its texts. Keys decide; texts are
    read again for the pairs found and their matches alone."""
    train, held = df.where(F.col(split) == "train"), df.where(F.col(split) != "train")
    first, second = (best_match(train, held, key, s, number, family).toDF("__k", f"__m{i}", f"__j{i}") for i, s in enumerate(sides))
    hits = [F.col(f"__j{i}") >= threshold for i in range(2)]
    found = _once(
        first.join(second, "__k").where(hits[0] | hits[1])
        .select("__k", side_label(*hits, names=sides).alias("side"), F.greatest("__j0", "__j1").alias("near_dup_max_jaccard"), best_side_key(F.col("__j0"), F.col("__j1"), F.col("__m0"), F.col("__m1")).alias("train_match"))
    )
    sent = F.broadcast if found.count() <= FEW else lambda x: x
    out = held.join(sent(found), held[key] == F.col("__k")).drop("__k")
    matches = found.select(F.col("train_match").alias("__m")).distinct()
    texts = train.join(sent(matches), train[key] == F.col("__m"), "left_semi").select(F.col(key).alias("__t"), *[F.col(s).alias(f"train_match_{s}") for s in sides])
    return out.join(texts, F.col("train_match") == F.col("__t"), "left").drop("__t")


def partner_cosines(rows: DataFrame, key: str, vector: str, partners: DataFrame, k: int) -> DataFrame:
    """(key, cosines): of each row the cosines with its partners (key, partner, rank), in order of rank, null where a rank
    up to k has none or the partner has no vector."""
    own = rows.select(F.col(key).alias("__a"), F.col(vector).alias("__x"))
    other = rows.select(F.col(key).alias("__b"), F.col(vector).alias("__y"))
    met = partners.where(F.col("rank") <= k).join(own, F.col(key) == F.col("__a")).join(other, F.col("partner") == F.col("__b"), "left")
    scored = met.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", cosine(F.col("__x"), F.col("__y")).alias("c")))).alias("__m"))
    every = rows.select(key).join(scored, key, "left")
    return every.select(key, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda r: F.try_element_at("__m", r)).alias("cosines"))


def factor_codes(df: DataFrame, text: Column, name: str = "code") -> DataFrame:
    """df with a code for each distinct text: 63 bits of its SHA-1, equal in every run. It needs no order of all texts."""
    return df.withColumn(name, F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("long"))


def content_sha256(df: DataFrame, position: str, *columns: str) -> str:
    """SHA-256 of the rows in the order of their positions, each as a JSON array of strings. Row digests are made on the
    executors; the driver streams them in order, a partition at a time, so the table never gathers there."""
    values = [F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"')) for c in columns]
    line = F.concat(F.lit("["), F.concat_ws(", ", *values), F.lit("]"))
    total = hashlib.sha256()
    for r in df.select(position, F.sha2(line, 256).alias("d")).orderBy(position).select("d").toLocalIterator():
        total.update(bytes.fromhex(r["d"]))
    return total.hexdigest()


def run_fingerprint(settings: dict, ids: DataFrame, position: str, key: str) -> str:
    """SHA-256 over a run's settings and its rows' ids in order."""
    import json

    return hashlib.sha256(f"{json.dumps(settings, sort_keys=True)}\n{content_sha256(ids, position, key)}".encode()).hexdigest()


def refuse_mixed_runs(stored: str | None, current: str, where: str) -> str:
    """The fingerprint to store; parts of two runs must not lie in one folder."""
    if stored is not None and stored != current:
        raise ValueError(f"{where} holds parts of another run: {stored[:12]}, not {current[:12]}")
    return current

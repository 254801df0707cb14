"""Removal of repeated substrings with suffix arrays, without one array over the corpus.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Texts are UTF-8 bytes, and strings
are judged on the input. Three steps lead to suffix arrays of bounded parts that together see every repeated string:

1. Anchors. In each window of LENGTH bytes the GRAM-byte string with the least hash (the last of equals) is its anchor.
   Equal windows have equal anchors at equal places, so windows are dealt by anchor; anchors that occur once are out.
2. Pieces. For a repeated anchor, the stretch of a text that the windows with this anchor cover is a piece. Each is cut
   into ranges of at most STEP window starts (on a grid from the anchor); all windows of a range contain the range's
   core, so pieces are dealt again by a hash of the core, which only texts that share those bytes have. Equal pieces
   are one with a count.
3. Suffix arrays. The pieces of one core are aligned. Each is trimmed to what can match any other; columns in which all
   agree become one symbol, others a symbol for each column and byte; and one suffix array over the pieces, each with
   an end symbol of its own, is built by Lyndon grouping (suffixes.py). A window is repeated if its longest common
   prefix with a neighbour in the array, in bytes, is at least LENGTH.

A core's group holds as many distinct pieces as there are ways to go on within STEP bytes on either side of it, whatever
the number of texts that share it. A passage that very many texts share, each in its own surroundings, has as many ways;
where a core has more than CROWD pieces, their windows are dealt one by one, by core, place and hash, and counted instead,
so no group gathers in a task. Texts with exact copies are one text with a count. Only texts with a repeated anchor
move; filters of fixed size find them, and letting more through changes no result.

A passage is also told by its words (without_passages): the same search runs over a view of the texts in which every
word is a code of CODE bytes, so that a number of words is a number of bytes, whatever the length of the words.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; all of a text of at least LENGTH bytes
that occurs twice goes; a null id is kept as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .fingerprint import mix64
from .neardup import by_group
from .runtime import bits_of, cut, release, set_at, ship, sift, spot_of, task, WordCache
from .suffixes import common_prefixes, suffix_array

LENGTH, GRAM, STEP, CHUNK, ANCHOR_BITS = 400, 64, 96, 1 << 19, 1 << 25
#: Pieces that a task sorts at most: 5,000 with shared surroundings were measured at 390 MB.
CROWD = 2000
PLACE = np.uint64((1 << 20) - 1)
#: Repeats of more than WORDS words are passages; a word is CODE bytes of its hash.
WORDS, CODE = 50, 6


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    h, size, power = b.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64) | 1
        power = (power * 0xD1342543DE82EF95 + 2 * size) % (1 << 64) | 1
        size *= 2
    return mix64(h)


def anchors(b: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, ...]]:
    """(hash, first window start, last window start, place of the anchor) of each run of windows with one anchor."""
    out = []
    width = length - GRAM + 1
    for base in range(0, max(0, len(b) - length + 1), CHUNK):
        part = b[base : base + CHUNK + length - 1]
        h = gram_hashes(part)
        n = len(h)
        keys = (h & ~PLACE) | (PLACE - np.arange(n, dtype=np.uint64))
        pad = -n % width
        blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        place = (PLACE - (low[start] & PLACE)).astype(np.int64)
        out.append((h[place].view(np.int64), start + base, np.concatenate([start[1:], [len(low)]]) - 1 + base, place + base))
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def repeated(pieces: list[bytes], places: list[int], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For distinct pieces that share an anchor at these places: which window starts are repeated."""
    m = len(pieces)
    out = [np.full(len(p) - length + 1, n > 1) for p, n in zip(pieces, counts)]
    if m == 1:
        return out
    zero = max(places)
    reach = max(len(p) - a for p, a in zip(pieces, places))
    grid = np.zeros((m, zero + reach), np.int16)  # 0: beyond the piece
    for r, (p, a) in enumerate(zip(pieces, places)):
        grid[r, zero - a : zero - a + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    # how far each piece agrees with any other, to the right and to the left of the anchor's place
    right, left = _agreement(grid[:, zero:]), _agreement(grid[:, :zero][:, ::-1])
    begin, end = zero - left, zero + right
    for r in range(m):
        if counts[r] > 1:
            begin[r], end[r] = zero - places[r], zero - places[r] + len(pieces[r])
    rows = np.flatnonzero(end - begin >= length)
    if not len(rows) or all(counts[r] > 1 for r in rows):
        return out
    part = grid[rows]
    low, high = int(begin[rows].min()), int(end[rows].max())
    columns = np.arange(low, high)
    inside = (columns >= begin[rows, None]) & (columns < end[rows, None])
    part = np.where(inside, part[:, low:high], 0)
    same = (part == part[0]).all(axis=0) & (part[0] > 0)
    head = np.flatnonzero(np.concatenate([[True], ~(same[1:] & same[:-1])]))  # first column of each symbol
    wide = np.diff(np.concatenate([head, [high - low]]))
    code = np.where(same[head], 0, part[:, head])  # within its column
    text, row_of, col_of = [], [], []
    for k in range(len(rows)):
        here = np.flatnonzero(part[k, head] > 0)
        text += (len(rows) + 1 + here * 300 + code[k, here]).tolist() + [k + 1]
        row_of += [k] * (len(here) + 1)
        col_of += [*here.tolist(), -1]
    text.append(0)
    order = suffix_array(text)
    lcp = common_prefixes(text, order)
    weight = np.concatenate([[0], np.cumsum([wide[c] if c >= 0 else 0 for c in col_of])])
    best = np.zeros(len(text) + 1, np.int64)
    for k in range(1, len(order)):
        for i in (order[k], order[k - 1]):
            if lcp[k]:
                best[i] = max(best[i], weight[i + lcp[k]] - weight[i])
    for i in range(len(col_of)):
        c = col_of[i]
        if c < 0 or not best[i]:
            continue
        # windows that start inside a symbol on which all agree go on with what follows it
        r = rows[row_of[i]]
        first = low + int(head[c]) - (zero - places[r])
        for o in range(int(wide[c]) if same[head[c]] else 1):
            reach_ = int(wide[c]) - o + int(best[i + 1]) if o else int(best[i])
            if reach_ < length:
                break
            if 0 <= first + o < len(out[r]):
                out[r][first + o] = True
    return out


def _agreement(grid: np.ndarray) -> np.ndarray:
    """For each row, the longest common beginning (without zeros) with any other row."""
    m, width = grid.shape
    if not width:
        return np.zeros(m, np.int64)
    order = np.argsort(np.ascontiguousarray(grid.astype(">i2")).view(f"V{2 * width}").ravel(), kind="stable")
    g = grid[order]
    differ = (g[1:] != g[:-1]) | (g[1:] == 0)
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    best = np.zeros(m, np.int64)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    out = np.empty(m, np.int64)
    out[order] = best
    return out


def ranges(lo: int, hi: int, at: int, step: int = STEP):
    """(first start, last start, last start of the grid cell) of the window starts lo..hi cut on the anchor's grid."""
    while lo <= hi:
        edge = at - (at - lo) // step * step
        yield lo, min(hi, edge), edge
        lo = edge + 1


def digest(raw: bytes, found: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes and runs to remove, and the hash of what is left, for byte ranges [a, b)."""
    flags = np.zeros(len(raw), bool)
    for a, b in found:
        flags[a:b] = True
    kept = np.frombuffer(raw, np.uint8)[~flags]
    return int(flags.sum()), len(runs(flags)), hashlib.sha256(kept.tobytes()).hexdigest()


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, raw, sha, n_bytes, key) of every document."""
    raw = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), raw.alias("raw"))
    texts = texts.select("row", "raw", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").cast("long").alias("n_bytes"))
    return texts.withColumn("key", F.substring(F.unhex("sha"), 1, 16))


def _once(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, raw) of the distinct texts with these keys, joined with the other columns of keys. Texts are read anew where
    they are needed rather than stored; copies are combined before they move."""
    return sift(texts, "key", keys).groupBy("key").agg(F.first("raw").alias("raw")).join(keys, "key")


def _as_is():
    return lambda raw: raw


def find_repeats(texts: DataFrame, length: int = LENGTH, view=_as_is, least: int | None = None) -> DataFrame:
    """(key, whole, spans array<struct<a,b>>) of the texts (key, raw, n_bytes) that hold repeats: byte ranges to remove,
    or all of a text that has copies. Other texts have no row.

    view() gives a function from a text's bytes to those that are searched; texts under `least` bytes hold none."""
    spark = texts.sparkSession
    ship(spark)
    long_ = texts.where(F.col("n_bytes") >= (length if least is None else least)).select("key", "raw")

    @task
    def find(batches):
        seen = view()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                keys, last, out = [], [], []
                for key, x in zip(part.column(0), part.column(1)):
                    b = seen(x.as_py())
                    if len(b) >= length:
                        h, lo, _, at = (np.concatenate(x) for x in zip(*anchors(np.frombuffer(b, np.uint8), length)))
                        keys.append(key.as_py())
                        last.append(len(b) - length)
                        out.append((h, lo, at))
                sizes = pa.array(np.concatenate([[0], np.cumsum([len(o[0]) for o in out])]), pa.int32())
                none = np.zeros(0, np.int64)
                lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([none, *(o[i] for o in out)]), kind)) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(last, pa.int32()), *lists], names=["key", "last", "h", "lo", "at"])

    listed = long_.mapInArrow(find, "key binary, last int, h array<long>, lo array<int>, at array<int>")
    listed = cut(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("last", "h", "lo", "at")]))
    copies = cut(listed.where("n > 1").select("key"))
    # cut, so that the join below has plain shuffles on both sides and a hot anchor's rows are split among tasks
    again = cut(listed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    shared = bits_of(again.select(F.pmod("h", F.lit(ANCHOR_BITS)).alias("at")), ANCHOR_BITS)

    @task
    def few(batches):
        bits = shared.value
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            h, lo, at = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))
            ends = np.cumsum(sizes)
            hi = np.concatenate([lo[1:], [0]]).astype(np.int64) - 1  # a run ends where the next one starts
            hi[ends - 1] = batch.column(1).to_numpy()
            keep = np.flatnonzero(set_at(bits, h & (ANCHOR_BITS - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.searchsorted(ends, keep, side="right"))), *(pa.array(x[keep], kind) for x, kind in ((h, pa.int64()), (lo, pa.int32()), (hi, pa.int32()), (at, pa.int32())))], names=["key", "h", "lo", "hi", "at"])

    every = listed.select("key", "last", "h", "lo", "at").mapInArrow(few, "key binary, h long, lo int, hi int, at int")
    wanted = cut(every.join(again, "h").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("found")))
    del listed, every, again
    release(spark)

    @task
    def cores(batches):
        seen = view()
        for batch in batches:
            for key, raw, found in zip(*(batch.column(i) for i in range(3))):
                rows, x, key = [], seen(raw.as_py()), key.as_py()
                for f in found.as_py():
                    at = f["at"]
                    for lo, hi, edge in ranges(f["lo"], f["hi"], at):
                        core = xxhash.xxh3_64_intdigest(x[edge : edge - STEP + 1 + length], at - edge) - (1 << 63)
                        rows.append((core, xxhash.xxh3_128_digest(x[lo : hi + length], at - lo), lo, hi, at))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([key] * len(rows), pa.binary()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3, 4))], names=["core", "piece", "key", "lo", "hi", "at"])

    held = cut(_once(long_, wanted).select("key", "raw", "found").mapInArrow(cores, "core long, piece binary, key binary, lo int, hi int, at int"))
    del wanted
    pieces = held.groupBy("core", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi", "at")).alias("one"))
    groups = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    pieces = cut(pieces.join(groups, "core").select("core", "piece", "n", "one", "kinds"))
    del groups
    release(spark)
    # a core with one piece only: all its windows are repeated; the others' pieces meet in suffix arrays
    whole = pieces.where("kinds = 1").select("core", "piece", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b"))).alias("starts"))
    of_text = lambda rows: cut(rows.groupBy("one.key").agg(F.collect_list(F.struct("core", "piece", "n", "one.lo", "one.hi", "one.at")).alias("asked")))
    asked = of_text(pieces.where((F.col("kinds") > 1) & (F.col("kinds") <= CROWD)))

    def fetch(batches):
        seen = view()
        for batch in batches:
            for raw, asked_ in zip(batch.column(0), batch.column(1)):
                x, asked_ = seen(raw.as_py()), asked_.as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["core"] for p in asked_], pa.int64()), pa.array([p["piece"] for p in asked_], pa.binary()), pa.array([p["n"] for p in asked_], pa.int64()),
                    pa.array([p["at"] - p["lo"] for p in asked_], pa.int32()), pa.array([x[p["lo"] : p["hi"] + length] for p in asked_], pa.binary()),
                ], names=["core", "piece", "n", "place", "bytes"])

    @task
    def windows(batches):
        seen = view()
        for batch in batches:
            for raw, asked_ in zip(batch.column(0), batch.column(1)):
                x = seen(raw.as_py())
                rows = [(p["core"], s - p["at"], xxhash.xxh3_128_digest(x[s : s + length]), p["piece"], s - p["lo"], p["n"]) for p in asked_.as_py() for s in range(p["lo"], p["hi"] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()))], names=["core", "off", "window", "piece", "start", "n"])

    @task
    def sort(batches):
        for group in by_group(batches, "core"):
            names, counts, places, content = (group.column(i).to_pylist() for i in range(1, 5))
            flags = repeated(content, places, counts, length)
            got = [[{"a": a, "b": b} for a, b in runs(f)] for f in flags]
            yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks(), pa.array(names, pa.binary()), pa.array(got, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["core", "piece", "starts"])

    fetched = _once(long_, asked).select("raw", "asked").mapInArrow(fetch, "core long, piece binary, n long, place int, bytes binary")
    sorted_ = fetched.repartition("core").sortWithinPartitions("core", "piece").mapInArrow(sort, "core long, piece binary, starts array<struct<a:int,b:int>>")
    starts = whole.unionByName(sorted_.where(F.size("starts") > 0))
    crowded = pieces.where(F.col("kinds") > CROWD)
    if crowded.take(1):
        crowd = of_text(crowded)
        # twice made rather than stored: a piece has up to STEP windows
        every = _once(long_, crowd).select("raw", "asked").mapInArrow(windows, "core long, off int, window binary, piece binary, start int, n long")
        twice = cut(every.groupBy("core", "off", "window").agg(F.sum("n").alias("all")).where("`all` > 1").select("core", "off", "window"))
        # a piece's starts lie within STEP, so its windows overlap where they are longer: one span covers them
        first, last = F.min("start").alias("a"), F.max("start").alias("b")
        spans = F.array(F.struct(first, last)) if length >= STEP else F.collect_list(F.struct(F.col("start").alias("a"), F.col("start").alias("b")))
        found = every.join(twice, ["core", "off", "window"]).groupBy("core", "piece").agg(spans.alias("starts"))
        starts = starts.unionByName(found)
    marks = held.select("core", "piece", "key", "lo").join(starts, ["core", "piece"]).select("key", F.explode(F.transform("starts", lambda x: F.struct((F.col("lo") + x["a"]).alias("a"), (F.col("lo") + x["b"] + length).alias("b")))).alias("span"))
    spans = marks.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    found = cut(copies.withColumn("whole", F.lit(True)).join(spans, "key", "full").select("key", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"))
    del held, pieces, whole, asked, fetched, sorted_, starts, marks, spans
    release(spark)
    return found


def removal(docs: DataFrame, length: int = LENGTH, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    texts = _texts(docs, text_col)
    found = find_repeats(texts, length)

    @task
    def digests(batches):
        for batch in batches:
            got = [digest(x, [(s["a"], s["b"]) for s in spans]) for x, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["key", "removed", "runs", "kept"])

    part = _once(texts.select("key", "raw"), found.where("not whole")).select("key", "raw", "spans").mapInArrow(digests, "key binary, removed long, runs long, kept string")
    empty = hashlib.sha256(b"").hexdigest()
    all_ = found.where("whole").select("key", F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("runs"), F.lit(empty).alias("kept"))
    out = texts.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_bytes", "sha", "key").join(part.unionByName(all_), "key", "left")
    removed = F.coalesce(F.when(F.col("removed") < 0, F.col("n_bytes")).otherwise(F.col("removed")), F.lit(0))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def _rewritten(docs: DataFrame, texts: DataFrame, found: DataFrame, kept: Column, text_col: str) -> DataFrame:
    """The columns of docs, the text replaced by `kept` where found(key, ...) has a row. Only rows that pass the filter of
    found's keys move; the others stay where they are."""
    bits = bits_of(found.select(spot_of("key").alias("at")))

    @task
    def mark(batches):
        shared = bits.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(set_at(shared, batch.column(batch.num_columns - 1).to_numpy()))], names=[*batch.schema.names[:-1], "may"])

    rows = texts.select("row", "key", spot_of("key").alias("at"))
    marked = rows.mapInArrow(mark, T.StructType(rows.schema.fields[:-1]).add("may", "boolean"))
    own = lambda c: F.col(f"row.`{c}`")
    moved = marked.where("may").drop("may").join(found, "key", "left")
    moved = moved.select(*[F.coalesce(F.when(F.col("whole"), F.lit("")).otherwise(kept), own(c).cast("string")).alias(c) if c == text_col else own(c).alias(c) for c in docs.columns])
    return marked.where("not may").select(*[own(c).cast("string").alias(c) if c == text_col else own(c).alias(c) for c in docs.columns]).unionAll(moved)


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, spans: pa.Array, coded: pa.Array) -> pa.Array:
    pairs = lambda x: [(s["a"], s["b"]) for s in x or []]
    return pa.array([None if t is None else without_words(t, pairs(s), pairs(c)) for t, s, c in zip(text.to_pylist(), spans.to_pylist(), coded.to_pylist())], pa.string())


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col="text") -> DataFrame:
    """The columns of docs, each text without its removed bytes. Where a removed run cuts a character, its rest goes
    too. Texts of which nothing is left stay as empty texts."""
    texts = _texts(docs, text_col)
    found = find_repeats(texts, length).withColumn("coded", F.lit(None).cast("array<struct<a:int,b:int>>"))
    text = F.when(~F.col("whole"), F.col(f"row.`{text_col}`").cast("string"))
    return _rewritten(docs, texts, found, _without(text, "spans", "coded"), text_col)


def without_words(text: str, spans: list[tuple[int, int]], coded: list[tuple[int, int]]) -> str:
    """A text without these ranges of its bytes and these ranges of its words' codes, of which only whole words go."""
    raw = text.encode()
    flags = np.ones(len(raw), bool)
    for a, b in spans:
        flags[a:b] = False
    if coded:
        words = [m.span() for m in re.finditer(r"\S+", text)]
        codes = np.zeros(len(words) * CODE, bool)
        for a, b in coded:
            codes[a:b] = True
        for a, b in runs(codes):
            first, last = -(-a // CODE), (b + 1) // CODE - 1
            if first <= last:
                start, end = words[first][0], words[last][1]
                at = len(text[:start].encode())
                flags[at : at + len(text[start:end].encode())] = False
    return np.frombuffer(raw, np.uint8)[flags].tobytes().decode("utf-8", "ignore")


def word_codes():
    """A view of texts in which every word (between white space) is CODE bytes of its hash."""
    cache = WordCache(lambda w: xxhash.xxh3_64_digest(w.encode())[:CODE])
    return lambda raw: b"".join([cache[w] for w in raw.decode().split()])


def without_passages(docs: DataFrame, words: int = WORDS, length: int = LENGTH, text_col="text") -> DataFrame:
    """The columns of docs, each text without what repeats for more than `words` words (between white space, which may
    differ) or for at least `length` bytes: scripts without spaces have passages of few words. Both are judged on the
    input."""
    texts = _texts(docs, text_col)
    by_bytes = find_repeats(texts, length)
    by_words = find_repeats(texts, (words + 1) * CODE, word_codes, least=2 * words + 1).select("key", F.col("whole").alias("all"), F.col("spans").alias("coded"))
    whole = F.coalesce("whole", F.lit(False)) | F.coalesce("all", F.lit(False))
    found = by_bytes.join(by_words, "key", "full").select("key", whole.alias("whole"), "spans", "coded")
    text = F.when(~F.col("whole"), F.col(f"row.`{text_col}`").cast("string"))
    return _rewritten(docs, texts, found, _without(text, "spans", "coded"), text_col)


#: The result of removal() for 400 bytes, in DuckDB: a polynomial hash modulo 2^61 - 1 of every window of every text, from
#: prefix sums, so that equal windows have equal hashes wherever they start. Texts have at most 2^30 bytes.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS raw FROM documents),
q AS (SELECT 2305843009213693951::HUGEINT AS p, 1234567890123456789::HUGEINT AS base),
lo AS (SELECT 0 AS j, 1::HUGEINT AS v UNION ALL SELECT j + 1, v * base % p FROM lo, q WHERE j < 1023),
step AS (SELECT v * base % p AS v FROM lo, q WHERE j = 1023),
hi AS (SELECT 0 AS j, 1::HUGEINT AS v UNION ALL SELECT j + 1, hi.v * step.v % p FROM hi, step, q WHERE j < (SELECT max(len(raw)) // 1024 + 1 FROM d)),
b AS (SELECT k, unnest(raw) AS h, generate_subscripts(raw, 1) - 1 AS i FROM d),
m AS (SELECT coalesce(max(i), 0) AS m FROM b),
t AS (SELECT k, h, i, (('0x' || h)::INTEGER + 1) * lo.v % p * hi.v % p AS t FROM b JOIN lo ON lo.j = i % 1024 JOIN hi ON hi.j = i // 1024, q),
s AS (SELECT k, h, i, t, sum(t) OVER (PARTITION BY k ORDER BY i) AS s FROM t),
w AS (SELECT k, i, lead(s, 399) OVER (PARTITION BY k ORDER BY i) - s + t AS w FROM s),
z AS (SELECT k, i, w % p * lo.v % p * hi.v % p AS z FROM w JOIN m ON true JOIN lo ON lo.j = (m - i) % 1024 JOIN hi ON hi.j = (m - i) // 1024, q WHERE w IS NOT NULL),
r AS (SELECT z FROM z GROUP BY z HAVING count(*) > 1),
f AS (SELECT k, i FROM z WHERE z IN (SELECT z FROM r)),
c AS (SELECT b.k AS k, b.i AS i, h, max(f.i) OVER (PARTITION BY b.k ORDER BY b.i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN f ON b.k = f.k AND b.i = f.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS first FROM c),
g AS (SELECT k, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(h, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY k)
SELECT doc_id, len(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g ON d.k = g.k
"""
